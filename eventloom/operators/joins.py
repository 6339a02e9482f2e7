"""Joins on event keys, row numbers, names and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_listed(raw: DataFrame, listed: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``raw`` whose key occurs in ``listed`` (semi join)."""
    out = raw.join(listed.select(*key), list(key), "left_semi")
    return out if columns is None else out.select(*key, *[c for c in columns if c not in key])


def one_per_key(src: DataFrame, key: Sequence[str], values: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """Reduce duplicates to the first (or last) row in ``order``.

    An aggregate instead of a window: it combines before the shuffle, so a key
    with very many duplicates does not end up in one task.
    """
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*values), order).alias("_row")
    return src.groupBy(*key).agg(row).select(*key, *[F.col(f"_row.{v}").alias(v) for v in values])


def lookup_by_key(
    target: DataFrame,
    src: DataFrame,
    key: Sequence[str],
    defaults: dict[str, Column],
    order: Column,
    last: bool = False,
    matched: str | None = None,
    prefix: str = "",
) -> DataFrame:
    """Attach columns of ``src`` by key, with a default where nothing matches.

    ``defaults`` names the columns and their typed defaults. Duplicates in
    ``src`` are reduced first, so the result has the rows of ``target``.
    """
    single = one_per_key(src, key, list(defaults), order, last).select(
        *key, *[F.col(c).alias(f"_v_{c}") for c in defaults], F.lit(True).alias("_hit")
    )
    joined = target.join(single, list(key), "left")
    # a matched row keeps its own value even if that is NULL-free; only a miss takes the default
    cols = {prefix + c: F.when(F.col("_hit"), F.col(f"_v_{c}")).otherwise(d) for c, d in defaults.items()}
    if matched is not None:
        cols[prefix + matched] = F.coalesce(F.col("_hit"), F.lit(False))
    return joined.withColumns(cols).drop("_hit", *[f"_v_{c}" for c in defaults])


def match_by_base_name(skims: DataFrame, raws: DataFrame) -> DataFrame:
    """Pair skim files (``<folder>-<base>``) with raw files of the same base
    name; the first raw path wins."""
    base = F.regexp_extract("skim_path", r"/[^/-]*-([^/]+)$", 1)
    raw = raws.groupBy(F.regexp_extract("raw_path", r"([^/]+)$", 1).alias("base")).agg(F.min("raw_path").alias("raw_path"))
    return skims.withColumn("base", base).join(raw, "base", "left")


def with_factor(df: DataFrame, key: str, factors: Sequence[DataFrame], out: str) -> DataFrame:
    """Product of several ``(key, factor)`` tables; a missing entry counts 1."""
    value = F.lit(1.0)
    for i, table in enumerate(factors):
        t = table.select(F.col(key), F.col("factor").alias(f"_f{i}"))
        df = df.join(t, key, "left")
        value = value * F.coalesce(F.col(f"_f{i}"), F.lit(1.0))
    return df.withColumn(out, value).drop(*[f"_f{i}" for i in range(len(factors))])


def expand_aliases(df: DataFrame, name: str, aliases: DataFrame, strict: bool = True) -> DataFrame:
    """Replace aliases by the names they stand for; other names stay.

    ``aliases`` has (alias, members). Duplicates after expansion raise when the
    plan runs if ``strict``, else the first occurrence wins (``pos`` order).
    """
    out = df.join(aliases, F.col(name) == F.col("alias"), "left")
    members = F.coalesce(F.col("members"), F.array(F.col(name)))
    out = out.select(*[c for c in df.columns if c != name], F.posexplode(members).alias("_m", name))
    if strict:
        seen = out.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
        checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate after expansion: "), F.col(name)))).otherwise(
            F.col(name)
        )
        return seen.select(checked.alias(name))
    firsts = out.groupBy(name).agg(F.min(F.struct("pos", "_m")).alias("_o"))
    return firsts.select(name, F.col("_o.pos").alias("pos"), F.col("_o._m").alias("member"))


def expand_nested(names: Sequence[str], groups: dict[str, Sequence[str]]) -> list[str]:
    """Expand aliases of aliases (configuration, on the driver); an unknown
    ``group:`` entry and a cycle are errors, duplicates keep the first place."""
    out: dict[str, None] = {}

    def visit(name: str, trail: tuple[str, ...]) -> None:
        if name in trail:
            raise ValueError("alias cycle: " + " -> ".join([*trail, name]))
        if name in groups:
            for member in groups[name]:
                visit(member, (*trail, name))
        elif name.startswith("group:"):
            raise ValueError(f"unknown group {name}")
        else:
            out.setdefault(name)

    for n in names:
        visit(n, ())
    return list(out)


def first_label(df: DataFrame, name: str, labels: Sequence[tuple[str, str, str]], channel: str = "channel", klass: str = "klass") -> DataFrame:
    """Channel and class of a sample: the first alias contained in its
    upper-cased name; NULL when none fits.

    ``labels`` is the ordered schema (alias, channel, class), a short list, so
    it becomes one CASE instead of a join on containment.
    """
    up = F.upper(F.col(name))
    hit = None
    for alias, chan, cls in labels:
        pair = F.struct(F.lit(chan).alias("c"), F.lit(cls).alias("k"))
        cond = up.contains(alias.upper())
        hit = F.when(cond, pair) if hit is None else hit.when(cond, pair)
    out = df.withColumn("_hit", hit)
    return out.withColumns({channel: F.col("_hit.c"), klass: F.col("_hit.k")}).drop("_hit")


def longest_contained(text: Column, keys: Sequence[str]) -> Column:
    """Longest key contained in a text, NULL when none is."""
    out = None
    for k in sorted(keys, key=lambda k: (-len(k), k)):
        out = F.when(text.contains(k), F.lit(k)) if out is None else out.when(text.contains(k), F.lit(k))
    return out


def on_row_number(left: DataFrame, right: DataFrame, column: str = "row_index") -> DataFrame:
    """Join two tables that store the same explicit row number."""
    return left.join(right, column, "inner")


def total_luminosity(lumi: DataFrame, year: str) -> DataFrame:
    """Sum over the eras of a year; over all eras when the year has none."""
    mine = F.col("era").startswith(year)
    return lumi.agg(
        F.coalesce(F.sum(F.when(mine, F.col("lumi"))), F.sum("lumi")).alias("lumi"),
    )


def variation_of(weight: Column, families: Sequence[str]) -> Column:
    """Variation part of a weight name, shared by several weight families
    (``DDTotalWeight_x`` and ``MCTotalWeight_x`` both give ``x``)."""
    return F.regexp_replace(weight, "^(" + "|".join(families) + ")_?", "")
