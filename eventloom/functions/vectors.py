"""Functions on object collections (``ARRAY<STRUCT>`` columns).

All of them are built from Spark's higher-order functions, stay inside one row
and never shuffle. A link to another object is a 0-based position; -1 means no
link. Values used by several lambdas are materialised as struct fields first,
because lambdas get no common subexpression elimination.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.kinematics import delta_r, energy, p4_from_mass, pair_mass

Predicate = Callable[[Column], Column]

# fixed values: codes that end an origin trace
ORIGIN_CODES = (6, 23, 24, 25)


def double_array(values) -> Column:
    """Constant array of doubles as one parsed expression, however long."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside a lambda, where
    a repeated expression would be evaluated at every place it appears."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# --- masks, selection, positions ------------------------------------------------


def mask(coll: Column, pred: Predicate) -> Column:
    """One boolean per object; an unknown condition counts as false."""
    return F.transform(coll, lambda o: F.coalesce(pred(o), F.lit(False)))


def select(coll: Column, pred: Predicate) -> Column:
    return F.filter(coll, pred)


def select_by_mask(coll: Column, flags: Column) -> Column:
    return F.filter(coll, lambda o, i: F.get(flags, i))


def positions(flags: Column) -> Column:
    """0-based positions of the true entries."""
    marked = F.transform(flags, lambda m, i: F.when(m, i))
    return F.filter(marked, lambda i: i.isNotNull())


def count_true(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda m: m))


def count_where(coll: Column, pred: Predicate) -> Column:
    return F.size(F.filter(coll, pred))


def kth_position(flags: Column, k: int) -> Column:
    """Position of the k-th true entry (k from 0); NULL when there is none."""
    return F.get(positions(flags), F.lit(k))


def first_true(flags: Column) -> Column:
    """Position of the first true entry, else -1."""
    return (F.array_position(flags, True) - 1).cast("int")


# --- gathers and links ----------------------------------------------------------


def linked_field(coll: Column, link: str, targets: Column, field: str, missing: float) -> Column:
    """For every object the field of the object it links to."""
    return F.transform(coll, lambda o: F.coalesce(F.get(targets, o[link])[field], F.lit(missing)))


def linked_distance(coll: Column, link: str, targets: Column, missing: float = 999.0) -> Column:
    """For every object the distance to the object it links to."""

    def one(o: Column) -> Column:
        dr = bind(F.get(targets, o[link]), lambda t: delta_r(o["eta"], o["phi"], t["eta"], t["phi"]))
        return F.coalesce(dr, F.lit(missing))

    return F.transform(coll, one)


def keep_link(links: Column, flags: Column) -> Column:
    """Links whose target passes; all others become -1."""
    return F.transform(links, lambda i: F.when(F.get(flags, i), i).otherwise(F.lit(-1)).cast("int"))


def follow(start: Column, *tables: Column, passed: tuple[int, ...] = (-1, -2, -13)) -> Column:
    """Chase a position through arrays of positions; sentinels pass through."""
    value = start
    for table in tables:
        value = F.when(value.isin(*passed), value).otherwise(F.get(table, value))
    return value


# --- bits, codes, ranges --------------------------------------------------------


def has_bit(status: Column, bit: int) -> Column:
    return F.getbit(status.cast("long"), F.lit(bit)) == 1


def heavy_flavour(code: Column) -> Column:
    """5 for codes 5xx, 5xxx, 5xxxx; 4 for the same with 4; 0 otherwise."""
    a = F.abs(code)

    def family(d: int) -> Column:
        return (
            a.between(d * 100, d * 100 + 99)
            | a.between(d * 1000, d * 1000 + 999)
            | a.between(d * 10000, d * 10000 + 9999)
        )

    return F.when(family(5), 5).when(family(4), 4).otherwise(0)


def is_b_hadron(code: Column) -> Column:
    """The digit test: hundreds or thousands digit is 5."""
    a = F.abs(code).cast("long")
    hundreds = F.pmod(F.floor(a / 100), F.lit(10))
    thousands = F.pmod(F.floor(a / 1000), F.lit(10))
    return (a >= 500) & ((hundreds == 5) | (thousands == 5))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


# --- distances ------------------------------------------------------------------


def distances_from(coll: Column, eta: Column, phi: Column) -> Column:
    """Distance of every object from one direction."""
    return F.transform(coll, lambda o: delta_r(o["eta"], o["phi"], eta, phi))


def min_distance(
    coll: Column, refs: Column, selected: Predicate | None = None, start: float = 999.0
) -> Column:
    """Distance to the nearest reference object, capped by ``start``; objects
    that are not selected get 0."""

    def one(o: Column, rs: Column) -> Column:
        dr = F.array_min(F.transform(rs, lambda r: delta_r(r["eta"], r["phi"], o["eta"], o["phi"])))
        near = F.least(F.coalesce(dr, F.lit(start)), F.lit(start))
        return near if selected is None else F.when(selected(o), near).otherwise(F.lit(0.0))

    return bind(refs, lambda rs: F.transform(coll, lambda o: one(o, rs)))


def nearest(
    coll: Column,
    targets: Column,
    max_dr: float,
    eligible: Predicate | None = None,
    distance: Callable[[Column, Column], Column] | None = None,
    missing: int = -1,
) -> Column:
    """For every object the position of the nearest eligible target closer than
    ``max_dr``; the first one wins a tie. Nothing is emitted per pair."""
    gap = distance or (lambda o, t: delta_r(o["eta"], o["phi"], t["eta"], t["phi"]))

    def one(o: Column, pool: Column) -> Column:
        def candidate(t: Column, i: Column) -> Column:
            d = gap(o, t)
            d = d if eligible is None else F.when(eligible(t), d)
            return F.struct(d.alias("d"), i.alias("i"))

        # NULL distances go last after the filter, so the minimum is a real one
        near = F.array_min(F.filter(F.transform(pool, candidate), lambda c: c["d"] < max_dr))
        return F.coalesce(near["i"], F.lit(missing)).cast("int")

    return bind(targets, lambda pool: F.transform(coll, lambda o: one(o, pool)))


def with_p4(coll: Column) -> Column:
    """Add the field ``p4`` to every object (needs pt, eta, phi, mass)."""
    return F.transform(coll, lambda o: o.withField("p4", p4_from_mass(o["pt"], o["eta"], o["phi"], o["mass"])))


def opposite_pair_near(coll: Column, mass: float = 91.2, window: float = 10.0) -> Column:
    """Is there an opposite-charge pair with an invariant mass inside the
    window? Objects need ``p4`` and ``charge``. The test is symmetric and an
    object never pairs with itself (equal charges), so no positions are needed."""
    return bind(
        coll,
        lambda c: F.exists(
            c,
            lambda a: F.exists(
                c, lambda b: (a["charge"] * b["charge"] < 0) & (F.abs(pair_mass(a["p4"], b["p4"]) - mass) < window)
            ),
        ),
    )


def pairs_of(coll: Column, k: int) -> list[tuple[int, int, Column, Column]]:
    """The k*(k-1)/2 pairs among the first k objects, in order 01, 02, ..."""
    return [(i, j, F.get(coll, F.lit(i)), F.get(coll, F.lit(j))) for i in range(k) for j in range(i + 1, k)]


def top_by(coll: Column, field: str, k: int) -> Column:
    """First k objects by falling ``field``; the earlier position wins a tie."""
    keyed = F.transform(coll, lambda o, i: F.struct((-o[field]).alias("s"), i.alias("i"), o.alias("o")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["o"])


# --- walks over parent links ----------------------------------------------------


def _walk(parents: Column, start: Column, depth: int, state: Column, visit: Callable[[Column, Column], Column]) -> Column:
    """Visit start, its parent, and so on: at most ``depth`` objects, and never
    more than there are objects, which also ends a cycle."""
    n = F.size(parents)
    init = F.struct(start.cast("int").alias("at"), state.alias("s"))

    def step(acc: Column, _: Column) -> Column:
        inside = (acc["at"] >= 0) & (acc["at"] < n)
        return F.when(
            inside,
            F.struct(
                F.get(parents, acc["at"]).cast("int").alias("at"),
                visit(acc["s"], acc["at"]).alias("s"),
            ),
        ).otherwise(acc)

    rounds = F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(depth)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, init, step)["s"]


def ancestry_flavour(start: Column, codes: Column, parents: Column, status: Column | None = None, depth: int = 100) -> Column:
    """Origin class of the object at ``start``: 5 when it or an ancestor is of
    the 5 family, else 4 for the 4 family, else 3; 0 without a link. With status
    words 15 (bits 3 or 5) and 1 (bit 0) of the object itself come first."""
    best = bind(
        F.struct(F.transform(codes, heavy_flavour).alias("flav"), parents.alias("up")),
        lambda v: _walk(v["up"], start, depth, F.lit(0), lambda s, at: F.greatest(s, F.get(v["flav"], at))),
    )
    walked = F.greatest(best, F.lit(3))
    if status is None:
        return F.when(start < 0, 0).otherwise(walked).cast("int")
    word = F.get(status, start)
    return (
        F.when((start < 0) | (start >= F.size(codes)), 0)
        .when(has_bit(word, 5) | has_bit(word, 3), 15)
        .when(has_bit(word, 0), 1)
        .otherwise(walked)
        .cast("int")
    )


def trace_origin(start: Column, codes: Column, parents: Column, depth: int = 100, soft: int = 1) -> Column:
    """First code among 6, 23, 24, 25 met on the way up, else ``soft``."""
    known = F.transform(codes, lambda c: F.when(F.abs(c).isin(*ORIGIN_CODES), F.abs(c)).otherwise(F.lit(0)).cast("int"))
    return bind(F.struct(known.alias("known"), parents.alias("up")), lambda v: _first_known(v, start, depth, soft))


def _first_known(v: Column, start: Column, depth: int, soft: int) -> Column:
    def visit(s: Column, at: Column) -> Column:
        return F.when(s != 0, s).otherwise(F.get(v["known"], at))

    found = _walk(v["up"], start, depth, F.lit(0), visit)
    return F.coalesce(F.nullif(found, F.lit(0)), F.lit(soft)).cast("int")


def terminal_sources(codes: Column, parents: Column, depth: int = 100, soft: int = 1, keep: Column | None = None) -> Column:
    """Per object: 0 unless it is a terminal b hadron (not the parent of another
    one), else its origin. ``keep`` further restricts which hadrons count."""
    flags = F.transform(codes, lambda c: is_b_hadron(c))
    if keep is not None:
        flags = F.transform(flags, lambda f, i: f & F.get(keep, i))
    known = F.transform(codes, lambda c: F.when(F.abs(c).isin(*ORIGIN_CODES), F.abs(c)).otherwise(F.lit(0)).cast("int"))

    def sources(v: Column) -> Column:
        inner = F.filter(F.transform(v["flags"], lambda f, i: F.when(f, F.get(v["up"], i).cast("int"))), lambda p: p >= 0)
        return bind(
            inner,
            lambda taken: F.transform(
                v["flags"],
                lambda f, i: F.when(f & ~F.array_contains(taken, i), _first_known(v, i, depth, soft)).otherwise(F.lit(0)),
            ),
        )

    return bind(F.struct(flags.alias("flags"), known.alias("known"), parents.alias("up")), sources)


# --- arithmetic -----------------------------------------------------------------


def quadrature(*sources: Column) -> Column:
    """Element-wise root of the sum of squares; different sizes are an error."""
    total = F.transform(sources[0], lambda x: x * x)
    for src in sources[1:]:
        same = F.size(src) == F.size(sources[0])
        total = F.when(same, F.zip_with(total, src, lambda t, x: t + x * x)).otherwise(
            F.raise_error(F.lit("quadrature: sources of different size"))
        )
    return F.transform(total, F.sqrt)


def up_envelope(pt: Column, scale: Column, raw: Column, up: Column, down: Column) -> Column:
    """Largest upward value of ``pt``: scale part and resolution part (only
    when it moves up) in quadrature."""
    jes = pt * scale
    rise = F.greatest(F.lit(0.0), F.greatest(raw * up, raw * down) - pt)
    return pt + F.sqrt(jes * jes + rise * rise)


def product(coll: Column, factor: Callable[[Column], Column], where: Predicate | None = None) -> Column:
    def step(acc: Column, o: Column) -> Column:
        f = factor(o) if where is None else F.when(where(o), factor(o)).otherwise(F.lit(1.0))
        return acc * f

    return F.aggregate(coll, F.lit(1.0), step)


def products(coll: Column, factors: Callable[[Column], Column], count: int) -> Column:
    """Element-wise product of ``count`` factors over the objects: all products in one
    walk over the collection."""
    ones = F.array_repeat(F.lit(1.0), count)
    return F.aggregate(coll, ones, lambda acc, o: F.zip_with(acc, factors(o), lambda a, b: a * b))


def total(coll: Column, value: Callable[[Column], Column], where: Predicate | None = None) -> Column:
    chosen = coll if where is None else F.filter(coll, where)
    return F.aggregate(chosen, F.lit(0.0), lambda acc, o: acc + value(o))


def centrality(coll: Column) -> Column:
    """Sum of pt over sum of energies, 0 when the latter is not positive."""
    e = total(coll, lambda o: energy(o["pt"], o["eta"], o["mass"]))
    return F.when(e > 0, total(coll, lambda o: o["pt"]) / e).otherwise(F.lit(0.0))


def zip_records(**arrays: Column) -> Column:
    """Parallel arrays to one array of records named by the keywords."""
    names = list(arrays)
    zipped = F.arrays_zip(*[arrays[n].alias(n) for n in names])
    return zipped
