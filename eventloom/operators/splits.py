"""Reproducible splits and permutations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.scale import attach_totals, shuffled_rank


def stratified_split(df: DataFrame, strata: Sequence[str], key: Sequence[str], val: float, test: float, seed: int, out: str = "split") -> DataFrame:
    """train / val / test inside every stratum, in an order drawn from the key.

    Counts are rounded half to even; the test part shrinks so that at least one
    training row stays.
    """
    rows = shuffled_rank(attach_totals(df, strata, _total=F.count(F.lit(1))), "_rank", key, strata, seed)
    n = F.col("_total")
    n_val = F.bround(n * F.lit(val), 0).cast("long")
    want = F.bround(n * F.lit(test), 0).cast("long")
    over = n_val + want - (n - 1)
    n_test = F.when((n_val + want >= n) & (n > 1), F.greatest(F.lit(0), want - over)).otherwise(want)
    n_train = F.greatest(F.lit(0), n - n_val - n_test)
    label = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    return rows.withColumn(out, label).select(*df.columns, out)


def region_split(df: DataFrame, same_sign: str, channel: str, channels_os: Sequence[str], channels_ss: Sequence[str], out: str = "region") -> DataFrame:
    """Opposite-sign rows of allowed channels for training, same-sign ones held out."""
    ss = F.col(same_sign)
    label = F.when(~ss & F.col(channel).isin(*channels_os), "os").when(ss & F.col(channel).isin(*channels_ss), "sr")
    return df.withColumn(out, label).filter(F.col(out).isNotNull())


def permute(df: DataFrame, key: Sequence[str], columns: Sequence[str], seed: int) -> DataFrame:
    """Give every row the ``columns`` of another row (one permutation for all of
    them). Both sides are ranked by different digests of the key and joined on
    the rank, so nothing is collected and any size works."""
    target = shuffled_rank(df.drop(*columns), "_rank", key, seed=f"{seed}a")
    source = shuffled_rank(df.select(*key, *columns), "_rank", key, seed=f"{seed}b").select("_rank", *columns)
    return target.join(source, "_rank").select(*df.columns)


def prompt_flags(df: DataFrame, lead: Column, sublead: Column) -> DataFrame:
    """Flags for splitting a table into complementary parts at write time."""
    return df.withColumns({"lead_prompt": lead, "sublead_prompt": sublead})
