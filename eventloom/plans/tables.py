"""The given star-schema tables seen as events with objects.

An order is an event, its lines are the objects of the event. ``SQL_*`` are the
same definitions for the checking statements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.nested import attach, collect_children

ORDER = ("l_linenumber", "l_extendedprice")

OBJECT = {
    "pt": "l_extendedprice / 1000D",
    "eta": "(l_partkey % 481) / 100D - 2.4D",
    "phi": "(l_suppkey * 37 + l_linenumber * 101) % 628 / 100D - 3.14D",
    "mass": "l_quantity / 10D",
    "charge": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END",
    "score": "l_discount * 10D",
    "rel": "l_tax",
    "flag": "l_returnflag",
    "part": "l_partkey",
    "supp": "l_suppkey",
}

EVENT = {
    "w": "o_totalprice / 100000D",
    "channel": "o_orderpriority",
    "era": "year(o_orderdate)",
    "run": "year(o_orderdate)",
    "block": "dayofyear(o_orderdate)",
    "status": "o_orderstatus",
    "cust": "o_custkey",
    "day": "o_orderdate",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def objects(spark: SparkSession, sf: str, *fields: str, raw: Sequence[str] = ()) -> DataFrame:
    """Flat objects: event key ``k`` and the named fields; only their columns are read."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), *[F.expr(OBJECT[f]).alias(f) for f in fields], *raw)


def heads(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """Events without objects: key ``k`` and the named columns."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("k"), *[F.expr(EVENT[f]).alias(f) for f in fields])


def nested(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """Key ``k`` and the collection ``obj`` of every event that has objects."""
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    return collect_children(li, "k", ORDER, {f: F.expr(OBJECT[f]) for f in fields}, "obj")


def events(spark: SparkSession, sf: str, fields: Sequence[str], head: Sequence[str] = ()) -> DataFrame:
    """All events with ``obj`` (empty without lines) and the named columns."""
    return attach(heads(spark, sf, *head), "k", nested(spark, sf, *fields), "obj")


def flat_events(spark: SparkSession, sf: str, fields: Sequence[str], head: Sequence[str]) -> DataFrame:
    """One row per object with the columns of its event."""
    return objects(spark, sf, *fields).join(heads(spark, sf, *head), "k")


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounding of reported numbers."""
    return F.round(x, digits)


SQL_OBJ = """obj AS (
  SELECT l_orderkey AS k,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS INTEGER) AS i,
         l_extendedprice / 1000 AS pt,
         CAST(l_partkey % 481 AS DOUBLE) / 100 - CAST(2.4 AS DOUBLE) AS eta,
         CAST((l_suppkey * 37 + l_linenumber * 101) % 628 AS DOUBLE) / 100 - CAST(3.14 AS DOUBLE) AS phi,
         l_quantity / 10 AS mass,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS charge,
         l_discount * 10 AS score,
         l_tax AS rel, l_returnflag AS flag, l_partkey AS part, l_suppkey AS supp
  FROM lineitem)"""

SQL_EV = """ev AS (
  SELECT o_orderkey AS k, o_totalprice / 100000 AS w, o_orderpriority AS channel,
         CAST(year(o_orderdate) AS INTEGER) AS era, CAST(year(o_orderdate) AS INTEGER) AS run,
         CAST(dayofyear(o_orderdate) AS INTEGER) AS block, o_orderstatus AS status, o_custkey AS cust, o_orderdate AS day
  FROM orders)"""

PI = "3.141592653589793::DOUBLE"


def sql_dphi(a: str, b: str) -> str:
    return f"(({a}) - ({b}) - 2 * {PI} * ceil((({a}) - ({b}) - {PI}) / (2 * {PI})))"


def sql_dr(a: str, b: str) -> str:
    """Distance of two aliases with eta and phi."""
    d = sql_dphi(f"{a}.phi", f"{b}.phi")
    return f"sqrt(({a}.eta - {b}.eta) * ({a}.eta - {b}.eta) + {d} * {d})"


def sql_folded(a: str, b: str) -> str:
    g = f"abs({a}.phi - {b}.phi)"
    d = f"(CASE WHEN {g} > {PI} THEN 2 * {PI} - {g} ELSE {g} END)"
    return f"sqrt(({a}.eta - {b}.eta) * ({a}.eta - {b}.eta) + {d} * {d})"


def sql_p4(a: str) -> str:
    """px, py, pz, e of an alias with pt, eta, phi, mass."""
    return (
        f"{a}.pt * cos({a}.phi) AS px, {a}.pt * sin({a}.phi) AS py, {a}.pt * sinh({a}.eta) AS pz, "
        f"sqrt({a}.pt * cosh({a}.eta) * {a}.pt * cosh({a}.eta) + {a}.mass * {a}.mass) AS e"
    )


def sql_mass(a: str, b: str) -> str:
    """Mass of two aliases with px, py, pz, e."""
    return (
        f"sqrt(greatest(0.0::DOUBLE, ({a}.e + {b}.e) * ({a}.e + {b}.e) - (({a}.px + {b}.px) * ({a}.px + {b}.px)"
        f" + ({a}.py + {b}.py) * ({a}.py + {b}.py) + ({a}.pz + {b}.pz) * ({a}.pz + {b}.pz))))"
    )


def sql_bin(x: str, n: int, lo: float, hi: float) -> str:
    """Bin number on a fixed axis."""
    return (
        f"CAST(CASE WHEN {x} < {lo}::DOUBLE THEN 0 WHEN {x} >= {hi}::DOUBLE THEN {n + 1} "
        f"ELSE 1 + floor({n} * ({x} - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE)) END AS INTEGER)"
    )


def sql_edges(x: str, edges: Sequence[float]) -> str:
    """Bin number on a variable axis."""
    return "CAST(" + " + ".join(f"CASE WHEN {x} >= {e}::DOUBLE THEN 1 ELSE 0 END" for e in edges) + " AS INTEGER)"
