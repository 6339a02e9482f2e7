"""Keyed, interval and binned lookups.

A binned table is small by nature (one value per calibration cell). Up to
``INLINE_CELLS`` cells it becomes one array literal and the lookup is index
arithmetic inside the row: no join, usable inside lambdas over collections.
A larger table, or one that is a DataFrame (``StoredTable``), is joined on the cell
number, an equi join; ``looked_up_fields`` chooses by table.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions.vectors import bind, double_array
from eventloom.operators.scale import bucket_count, values_table, written

INLINE_CELLS = 1 << 20
#: cells up to which a joined table is sent to the tasks (about 64 MB), so that objects
#: stay where they are
SENT_CELLS = 1 << 21
#: inner edges of an axis from which a bin is found by halving
SEARCHED = 64


class _Layout:
    """Category keys and binned axes of a table, and the number of a cell in it."""

    axes: Sequence[tuple[str, Sequence[float]]]
    categories: Sequence[tuple[str, Sequence]]
    flow: str

    def size(self) -> int:
        cells = 1
        for _, keys in self.categories:
            cells *= len(keys)
        for name, edges in self.axes:
            if any(b <= a for a, b in zip(edges, edges[1:])):
                raise ValueError(f"axis {name}: edges must increase")
            cells *= len(edges) - 1
        if self.flow not in ("clamp", "error"):
            raise ValueError("flow must be clamp or error")
        return cells

    def bin_no(self, axis: int, x: Column) -> Column:
        """0-based bin of ``x`` on an axis."""
        name, edges = self.axes[axis]
        inner = edges[1:-1]
        if not inner:
            b = F.lit(0)
        elif len(inner) == 1:
            b = (x >= float(inner[0])).cast("int")
        elif len(inner) > SEARCHED:
            b = F.when(x.isNotNull(), bind(F.struct(double_array(inner).alias("e"), x.alias("x")), lambda v: count_up_to(v["e"], v["x"])))
        else:
            b = bind(x, lambda v: F.size(F.filter(double_array(inner), lambda e: e <= v)))
        if self.flow == "error":
            outside = (x < float(edges[0])) | (x >= float(edges[-1]))
            b = F.when(outside, F.raise_error(F.lit(f"{name} outside the table")).cast("int")).otherwise(b)
        return b

    def key_no(self, category: int, key: Column) -> Column:
        """0-based number of a key, NULL for an unknown one."""
        keys = self.categories[category][1]
        known = F.array(*[F.lit(k) for k in keys])
        return F.nullif(F.array_position(known, key), F.lit(0)) - 1

    def cell(self, *inputs: Column, bins: dict[int, Column] | None = None) -> Column:
        """Flat cell number for category keys followed by axis coordinates.
        Several tables (or parts) with the same layout can share it. ``bins`` are bins
        already found, by axis."""
        flat = None
        for i, (_, keys) in enumerate(self.categories):
            no = self.key_no(i, inputs[i])
            flat = no if flat is None else flat * len(keys) + no
        for j, (_, edges) in enumerate(self.axes):
            no = bins[j] if bins and j in bins else self.bin_no(j, inputs[len(self.categories) + j])
            flat = no if flat is None else flat * (len(edges) - 1) + no
        return flat.cast("int")


@dataclass(frozen=True)
class BinnedTable(_Layout):
    """Values over category keys and binned axes, last axis fastest.

    ``flow`` is ``clamp`` (inputs are moved into the table) or ``error``.
    """

    axes: Sequence[tuple[str, Sequence[float]]]
    values: Sequence[float]
    categories: Sequence[tuple[str, Sequence]] = field(default_factory=tuple)
    flow: str = "clamp"

    def __post_init__(self) -> None:
        if self.size() != len(self.values):
            raise ValueError(f"table has {len(self.values)} values for {self.size()} cells")

    @property
    def inline(self) -> bool:
        return len(self.values) <= INLINE_CELLS

    def fixed(self, *keys) -> "BinnedTable":
        """The part of the table with literal leading category keys."""
        values = list(self.values)
        for (name, known), k in zip(self.categories, keys):
            size = len(values) // len(known)
            no = list(known).index(k)
            values = values[no * size : (no + 1) * size]
        return BinnedTable(self.axes, values, self.categories[len(keys) :], self.flow)

    def value(self, cell: Column) -> Column:
        if len(self.values) > INLINE_CELLS:
            raise ValueError("table too large to inline, use join_lookup")
        return F.get(double_array(self.values), cell)

    def at(self, *inputs: Column | str | int) -> Column:
        """Value for the category keys followed by the axis coordinates; NULL
        for an unknown key. Leading literals select a part of the table."""
        given = list(itertools.takewhile(lambda x: isinstance(x, (str, int)), inputs))
        part = self.fixed(*given)
        return part.value(part.cell(*inputs[len(given) :]))

    def cells(self) -> Iterator[tuple]:
        """Rows (keys..., bin numbers..., value)."""
        spans = [list(k) for _, k in self.categories] + [range(len(e) - 1) for _, e in self.axes]
        for idx, value in zip(itertools.product(*spans), self.values):
            yield (*idx, float(value))

    def frame(self, spark: SparkSession) -> DataFrame:
        kinds = ["string" if isinstance(k[0], str) else "int" for _, k in self.categories]
        names = [f"{n} {t}" for (n, _), t in zip(self.categories, kinds)]
        names += [f"bin_{n} int" for n, _ in self.axes]
        return values_table(spark, ", ".join([*names, "value double"]), list(self.cells()))


@dataclass(frozen=True)
class StoredTable(_Layout):
    """A table of any size whose values are a DataFrame ``cell, value`` (cells numbered
    as in ``BinnedTable``). Cells without a row have no value."""

    axes: Sequence[tuple[str, Sequence[float]]]
    values: DataFrame
    categories: Sequence[tuple[str, Sequence]] = field(default_factory=tuple)
    flow: str = "clamp"
    inline = False

    def __post_init__(self) -> None:
        self.size()

    def fixed(self, *keys) -> "StoredTable":
        """The part with literal leading category keys."""
        first, size = 0, self.size()
        for (_, known), k in zip(self.categories, keys):
            size //= len(known)
            first += list(known).index(k) * size
        part = self.values.where(F.col("cell").between(first, first + size - 1)).select((F.col("cell") - first).alias("cell"), "value")
        return StoredTable(self.axes, part, self.categories[len(keys) :], self.flow)


def stored(spark: SparkSession, table: BinnedTable) -> StoredTable:
    """A table of the driver as one that is joined; its values are stored once."""
    import pandas as pd

    frame = pd.DataFrame({"cell": range(len(table.values)), "value": [float(v) for v in table.values]})
    return StoredTable(table.axes, written(spark.createDataFrame(frame)), table.categories, table.flow)


@dataclass(frozen=True)
class Lookup:
    """A field of objects that comes from a table: ``inputs`` gives, for an object, the
    category keys and coordinates; leading literals select a part of the table."""

    table: BinnedTable | StoredTable
    inputs: Callable[[Column], Sequence[Column | str | int]]

    def here(self) -> tuple[Sequence, _Layout, Callable[[Column], Sequence[Column]]]:
        """The literal keys, and the rest of the inputs for the part they select."""
        given = list(itertools.takewhile(lambda x: isinstance(x, (str, int)), self.inputs(F.col("_o"))))
        return given, self.table.fixed(*given) if given else self.table, lambda o: list(self.inputs(o))[len(given) :]


def looked_up_fields(df: DataFrame, coll: str, stages: Sequence[dict[str, Callable[[Column], Column] | Lookup]], key: Sequence[str]) -> DataFrame:
    """Add fields to the objects of a collection, stage by stage: each a function of the
    object or a ``Lookup``; a stage may use the fields of the ones before.

    With tables that fit into the plan all is done inside the row. If one does not, the
    collection is taken apart once, the objects go through all stages as rows, joined
    with the tables on the cell, and are put together once, by ``key``, in their order.
    """
    looks = [f for stage in stages for f in stage.values() if isinstance(f, Lookup)]
    if all(f.table.inline for f in looks):
        for stage in stages:
            made = {n: (lambda o, f=f: f.table.at(*f.inputs(o))) if isinstance(f, Lookup) else f for n, f in stage.items()}
            extended = lambda o, made=made: _with_fields(o, {n: f(o) for n, f in made.items()})
            df = df.withColumn(coll, F.transform(coll, lambda o: extended(o)))
        return df
    if not key:
        raise ValueError("a table of this size needs the key of the events")
    spark = df.sparkSession
    # the outer form keeps Spark from adding a size filter that would compute a
    # derived collection a second time
    rows = df.select(*[c for c in df.columns if c != coll], F.posexplode_outer(coll).alias("_p", "_o")).filter(F.col("_p").isNotNull())
    for stage in stages:
        new: dict[str, Column] = {}
        for n, f in stage.items():
            if not isinstance(f, Lookup):
                new[n] = f(F.col("_o"))
            elif f.table.inline:
                new[n] = f.table.at(*f.inputs(F.col("_o")))
            else:
                _, part, inputs = f.here()
                part = part if isinstance(part, StoredTable) else stored(spark, part)
                cells = part.values.select(F.col("cell").cast("long").alias(f"_c_{n}"), F.col("value").alias(f"_v_{n}"))
                if part.size() <= SENT_CELLS:
                    cells = F.broadcast(cells.where(F.col(f"_c_{n}").between(0, part.size() - 1)))
                rows = _with_cell(rows, part, inputs(F.col("_o"))).join(cells, F.col("_cell") == F.col(f"_c_{n}"), "left").drop("_cell", f"_c_{n}")
                new[n] = F.col(f"_v_{n}")
        rows = rows.withColumn("_o", _with_fields(F.col("_o"), new)).drop(*[f"_v_{n}" for n in stage])
    parts = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_p", "_o"))).alias("_all"))
    kind = rows.schema["_o"].dataType.simpleString()
    out = df.drop(coll).join(parts, list(key), "left")
    objects = F.coalesce(F.transform("_all", lambda x: x["_o"]), F.array().cast(f"array<{kind}>"))
    return out.select(*[(objects.alias(coll) if c == coll else F.col(c)) for c in df.columns])


def _with_cell(rows: DataFrame, layout: _Layout, inputs: Sequence[Column]) -> DataFrame:
    """Adds ``_cell``, the number of the cell (long). Rows, unlike objects inside a
    collection, go through Spark's ``Bucketizer``."""
    bins: dict[int, Column] = {}
    names, first = rows.columns, len(layout.categories)
    for j, (_, edges) in enumerate(layout.axes):
        inner = [float(e) + 0.0 for e in edges[1:-1]]
        if len(inner) > 1 and layout.flow == "clamp":
            find = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="_x", outputCol=f"_bin_{j}", handleInvalid="keep")
            # it tells zeros of both signs apart, and gives NaN a bin of its own
            rows = find.transform(rows.withColumn("_x", inputs[first + j].cast("double") + F.lit(0.0))).drop("_x")
            bin_no = F.col(f"_bin_{j}")
            # a missing number is in the first bin of a short axis, in none of a long one
            missing = F.lit(None) if len(inner) > SEARCHED else F.lit(0.0)
            bins[j] = F.when(bin_no.isNull(), missing).otherwise(F.least(bin_no, F.lit(float(len(inner))))).cast("int")
    return rows.select(*names, layout.cell(*inputs, bins=bins).cast("long").alias("_cell"))


def _with_fields(o: Column, fields: dict[str, Column]) -> Column:
    for n, value in fields.items():
        o = o.withField(n, value)
    return o


def side_by_side(columns: Sequence[Sequence[float]]) -> Callable[[Column], Column]:
    """Several tables (or parts) of one layout as one array literal: from a cell number
    to the array of their values there, one lookup for all of them."""
    sizes = {len(c) for c in columns}
    if len(sizes) != 1:
        raise ValueError("tables of different layouts")
    flat = [float(v) for cell in zip(*columns) for v in cell]
    if len(flat) > INLINE_CELLS:
        raise ValueError("tables too large to inline")
    n = len(columns)
    return lambda cell: F.slice(double_array(flat), cell * n + 1, F.lit(n))


def join_lookup(df: DataFrame, table: BinnedTable, inputs: dict[str, Column], out: str) -> DataFrame:
    """Lookup by a join on category keys and bin numbers. The table is an inline
    relation, so Spark broadcasts it only when its size allows."""
    names = [n for n, _ in table.categories] + [f"bin_{n}" for n, _ in table.axes]
    keyed = {f"_{n}": inputs[n] for n, _ in table.categories}
    keyed |= {f"_bin_{n}": table.bin_no(j, inputs[n]) for j, (n, _) in enumerate(table.axes)}
    right = table.frame(df.sparkSession).select(*[F.col(n).alias(f"_{n}") for n in names], F.col("value").alias(out))
    return df.withColumns(keyed).join(right, [f"_{n}" for n in names], "left").drop(*[f"_{n}" for n in names])


def join_lookup_array(
    df: DataFrame, key: Sequence[str], coll: str, table: BinnedTable, inputs: dict[str, str], out: str
) -> DataFrame:
    """Table lookup for every object of a collection through a join, for tables
    too large to inline: explode with the position, join, collect by position."""
    # the outer form keeps Spark from adding a size filter that would compute a
    # derived collection a second time
    parts = df.select(*key, F.posexplode_outer(coll).alias("_p", "_o")).filter(F.col("_p").isNotNull())
    looked = join_lookup(parts, table, {n: F.col(f"_o.{f}") for n, f in inputs.items()}, "_v")
    per_row = looked.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_p", "_v"))).alias("_vs"))
    joined = df.join(per_row, list(key), "left")
    values = F.coalesce(F.transform("_vs", lambda x: x["_v"]), F.array().cast("array<double>"))
    return joined.withColumn(out, values).drop("_vs")


#: ranges of a run that one row carries at most
RANGE_CHUNK = 128


def last_not_after(items: Column, x: Column, start: str) -> Column:
    """Position of the last of the sorted ``items`` whose field ``start`` is at most
    ``x``, by halving; -1 if there is none or ``x`` is missing."""
    return count_up_to(items, x, lambda i: i[start]) - 1


def count_up_to(items: Column, x: Column, value: Callable[[Column], Column] = lambda i: i) -> Column:
    """How many of the sorted ``items`` are at most ``x``, by halving."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(items) + 1.0)).cast("int")))

    def halve(at: Column, _: Column) -> Column:
        lo, hi = at["lo"], at["hi"]
        middle = F.floor((lo + hi) / 2).cast("int")
        right = (lo < hi) & F.coalesce(value(F.get(items, middle)) <= x, F.lit(False))
        return F.struct(F.when(right, middle + 1).otherwise(lo).alias("lo"), F.when(right | (lo >= hi), hi).otherwise(middle).alias("hi"))

    whole = F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi"))
    return F.aggregate(steps, whole, halve, lambda at: at["lo"])


def _longest(ranges: DataFrame) -> int:
    """Ranges of the run that has most; the table of ranges is read for it."""
    return ranges.groupBy("run").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _cut_points(df: DataFrame, value: str, parts: int) -> tuple[list, list]:
    """Finite cut points of a column into parts of about equal size, and the values that
    more than a part holds (those that whole doubles tell apart from all others)."""
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(value, shares, 10 * parts).alias("e")).first()["e"] or []
    often = [v for v, n in Counter(map(_nan_alike, found)).items() if n > 1 and (v != v or abs(v) <= 1 << 53 and float(v) == v)]
    return [c for c in set(found) if math.isfinite(c)], often


def _nan_alike(v):
    return v if v == v else math.nan


def _greatest(begin: DataFrame, out: str) -> DataFrame:
    """The greatest ``_most`` of a run and cell. That of structs, which begin with ``_x``,
    is among the rows with the greatest ``_x``, so that only numbers are compared first."""
    cell = ["_run", "_cell"]
    if begin.schema["_most"].dataType.typeName() == "struct":
        tops = written(begin.groupBy(*cell).agg(F.max("_x").alias("_top")))
        begin = begin.join(tops, cell).where("_x = _top")
    return begin.groupBy(*cell).agg(F.max("_most").alias(out))


def _upto(df: DataFrame, run: str, block: str, ranges: DataFrame, most: Column) -> DataFrame:
    """Adds ``_range``, the greatest ``most`` of the ranges of the row's run that begin
    at or before its block, for any number of ranges; a struct begins with ``lo``.

    Rows and ranges are dealt once, by cut points of both, into cells of about equal
    size; within a cell a running maximum goes in order, and the maximum of the cells
    before comes by a join, so no task holds a run. A block that more rows ask for than a
    cell has begins a cell of its own: its rows are not put in order, as the table of
    cells has their answer."""
    begin = ranges.where("run IS NOT NULL AND lo IS NOT NULL").select(F.col("run").alias("_run"), F.col("lo").alias("_x"), F.lit(True).alias("_begins"), most.alias("_most"))
    rows = df.select(*df.columns, F.col(run).alias("_run"), F.col(block).alias("_x"), F.lit(False).alias("_begins"))
    parts = bucket_count(df)
    cuts, often = _cut_points(rows.where("_run IS NOT NULL"), "_x", parts)
    cuts = sorted({float(c) for c in cuts + _cut_points(begin, "_x", parts)[0]}) or [0.0]
    dealt = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_d", outputCol="_cell", handleInvalid="keep")
    celled = lambda t: dealt.transform(t.withColumn("_d", F.col("_x").cast("double"))).drop("_d")
    begin, rows = celled(begin), celled(rows)
    at_once = F.col("_x").isin(often) if often else F.lit(False)

    cells = _greatest(begin, "_total").join(_greatest(begin.where(at_once), "_first"), ["_run", "_cell"], "left")
    asked = rows.select("_run", "_cell").where("_run IS NOT NULL").distinct()
    span = written(asked.join(cells, ["_run", "_cell"], "full"))
    earlier = Window.partitionBy("_run").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = span.select(F.col("_run").alias("_r"), F.col("_cell").alias("_c"), F.max("_total").over(earlier).alias("_before"), "_first")

    # rows that need no order stay apart by the task they come from
    alone = F.coalesce(at_once, F.lit(True)) | F.col("_run").isNull() | F.col("_x").isNull()
    placed = rows.withColumn("_alone", alone).withColumn("_part", F.when(F.col("_alone"), -1.0 - F.spark_partition_id()).otherwise(F.col("_cell")))
    marks = placed.unionByName(begin.withColumn("_part", F.col("_cell")), allowMissingColumns=True)
    inside = Window.partitionBy("_part", "_run").orderBy("_x", F.desc("_begins")).rowsBetween(Window.unboundedPreceding, 0)
    here = marks.withColumn("_here", F.max("_most").over(inside)).where("NOT _begins")
    found = here.join(before, (F.col("_run") == F.col("_r")) & (F.col("_cell") == F.col("_c")), "left")
    # greatest passes over nulls but takes no structs
    own = F.when(F.col("_alone"), F.col("_first")).otherwise(F.col("_here"))
    later = F.col("_before").isNull() | (own > F.col("_before"))
    return found.select(*df.columns, F.when(F.col("_x").isNotNull(), F.when(later & own.isNotNull(), own).otherwise(F.col("_before"))).alias("_range"))


def _last_range(df: DataFrame, run: str, block: str, ranges: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds ``_range``, the last range of the row's run that begins at or before its
    block. Where no run has more ranges than a chunk, one join brings those of the run,
    searched by halving; else blocks and ranges are put in one order."""
    order = [f for f in fields if f not in ("lo", "hi")]
    if _longest(ranges) <= RANGE_CHUNK:
        whole = ranges.groupBy(F.col("run").alias("_run")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", *order))).alias("_ranges"))
        found = df.join(whole, df[run] == F.col("_run"), "left")
        hit = F.get("_ranges", last_not_after(F.col("_ranges"), F.col(block), "lo"))
        return found.withColumn("_range", hit).drop("_run", "_ranges")
    return _upto(df, run, block, ranges, F.struct("lo", "hi", *order))


def in_ranges(df: DataFrame, run: str, block: str, ranges: DataFrame) -> DataFrame:
    """Keep rows whose run is listed and whose block lies in any closed range.

    ``ranges`` has (run, lo, hi), any number per run, also overlapping ones: a block is
    inside if some range that begins at or before it ends at or after it. Short lists
    are a condition of the join, long ones are put in one order with the blocks.
    """
    if _longest(ranges) <= RANGE_CHUNK:
        r = ranges.select(F.col("run").alias("_run"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        return df.join(r, (df[run] == r["_run"]) & df[block].between(r["_lo"], r["_hi"]), "left_semi")
    found = _upto(df, run, block, ranges, F.col("hi"))
    return found.filter(F.col(block) <= F.col("_range")).select(*df.columns)


def interval_value(df: DataFrame, run: str, block: str, tables: dict[str, DataFrame], default: float = 0.0) -> DataFrame:
    """Per table the value of the range that contains the block, else the
    default. Of overlapping ranges the one that begins last counts.

    The row count of ``df`` never changes, and a run may have any number of ranges.
    """
    for name, table in tables.items():
        found = _last_range(df, run, block, table, ["lo", "hi", "value"])
        value = F.when(F.col(block) <= F.col("_range")["hi"], F.col("_range")["value"])
        df = found.withColumn(name, F.coalesce(value, F.lit(default))).drop("_range")
    return df
