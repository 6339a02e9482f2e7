"""Flat feature tables from nested events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import vectors as V
from eventloom.functions.kinematics import delta_r, eta_of, folded_delta_r, p4_from_mass, pair_mass
from eventloom.operators.corrections import settle

PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]

JET_FIELDS = ("px", "py", "pz", "mass", "btag", "dr_mu1", "dr_mu2")
MUON_FIELDS = ("miniPFRelIso_all", "jetRelIso", "jetDF", "promptMVA")

JET_FEATURES = [f"jet{n}_{f}" for n in range(1, 5) for f in JET_FIELDS]
PAIR_FEATURES = [f"bjet_dr_{i}{j}" for i, j in PAIRS] + [f"bjet_m_{i}{j}" for i, j in PAIRS]
MUON_FEATURES = (
    [f"{who}_mu_{c}" for who in ("lead", "sublead") for c in ("px", "py", "pz")]
    + [f"{who}_mu_{f}" for f in MUON_FIELDS for who in ("lead", "sublead")]
    + ["dimuon_dr", "dimuon_mass"]
)
EVENT_FEATURES = ["nGoodJet", "nBJet", "sumjet_pt", "sumbjet_pt", "jet_cent"]
FEATURES = JET_FEATURES + PAIR_FEATURES + MUON_FEATURES + EVENT_FEATURES

GROUPS = {"jets": JET_FEATURES, "pairs": PAIR_FEATURES, "muons": MUON_FEATURES, "event": EVENT_FEATURES}


def check_groups(groups: dict[str, Sequence[str]], features: Sequence[str]) -> None:
    """Groups must contain every feature exactly once."""
    flat = [f for g in groups.values() for f in g]
    if sorted(flat) != sorted(features):
        extra = sorted(set(flat) ^ set(features)) or sorted(f for f in set(flat) if flat.count(f) > 1)
        raise ValueError(f"groups do not partition the features: {extra}")


def keep_groups(df: DataFrame, groups: dict[str, Sequence[str]], keep: Sequence[str], zero: bool = False) -> DataFrame:
    """Keep some feature groups; drop the others or set them to 0."""
    unknown = set(keep) - set(groups)
    if unknown:
        raise ValueError(f"unknown groups {sorted(unknown)}")
    off = [f for g, fs in groups.items() if g not in keep for f in fs if f in df.columns]
    return df.withColumns({f: F.lit(0.0) for f in off}) if zero else df.drop(*off)


def shift_jets(
    df: DataFrame, coll: str, source: str | None = None, direction: str = "up", resolution: bool = False, scale_mass: bool = False
) -> DataFrame:
    """Vary the jet pt by a relative source or by the resolution factor, never
    both; optionally the mass with it."""
    if source is not None and resolution:
        raise ValueError("vary either by a source or by the resolution")

    def varied(o: Column) -> Column:
        if source is not None:
            return o["pt"] * (1.0 + (1.0 if direction == "up" else -1.0) * o[source])
        if resolution:
            return o["pt"] / o["jer"] * o[f"jer_{direction}"]
        return o["pt"]

    def update(o: Column) -> Column:
        new = varied(o)
        out = o.withField("pt", new)
        if scale_mass:
            out = out.withField("mass", o["mass"] * new / F.greatest(o["pt"], F.lit(1e-6)))
        return out

    return df.withColumn(coll, F.transform(coll, update))


def with_selection(df: DataFrame, coll: str, good: Callable[[Column], Column], tagged: Callable[[Column], Column]) -> DataFrame:
    """Good and tagged jets as their own collections, best score first."""
    df = df.withColumn("_good", F.filter(coll, good))
    df = df.withColumn("_top", V.with_p4(V.top_by(F.col("_good"), "score", 4)))
    return df.withColumn("_tag", F.filter("_good", tagged))


def _feature_columns(top: Sequence[Column], good: Column, tag: Column, m1: Column, m2: Column, fields: dict[str, str]) -> dict[str, Column]:
    """All features by name from the best four jets, the good and the tagged jets and
    two muons; jets of ``top`` and the muons have ``p4``."""
    out: dict[str, Column] = {}
    for n, j in enumerate(top, start=1):
        out |= {f"jet{n}_{c}": j["p4"][c] for c in ("px", "py", "pz")}
        out |= {
            f"jet{n}_mass": j["mass"],
            f"jet{n}_btag": j["score"],
            f"jet{n}_dr_mu1": delta_r(j["eta"], j["phi"], m1["eta"], m1["phi"]),
            f"jet{n}_dr_mu2": delta_r(j["eta"], j["phi"], m2["eta"], m2["phi"]),
        }
    out |= {f"bjet_dr_{i}{j}": delta_r(top[i]["eta"], top[i]["phi"], top[j]["eta"], top[j]["phi"]) for i, j in PAIRS}
    out |= {f"bjet_m_{i}{j}": pair_mass(top[i]["p4"], top[j]["p4"]) for i, j in PAIRS}
    out |= {f"{w}_mu_{c}": m["p4"][c] for w, m in (("lead", m1), ("sublead", m2)) for c in ("px", "py", "pz")}
    out |= {f"{w}_mu_{f}": m[fields[f]] for f in MUON_FIELDS for w, m in (("lead", m1), ("sublead", m2))}
    out |= {
        "dimuon_dr": delta_r(m1["eta"], m1["phi"], m2["eta"], m2["phi"]),
        "dimuon_mass": pair_mass(m1["p4"], m2["p4"]),
        "nGoodJet": F.size(good),
        "nBJet": F.size(tag),
        "sumjet_pt": V.total(good, lambda j: j["pt"]),
        "sumbjet_pt": V.total(tag, lambda j: j["pt"]),
        "jet_cent": V.centrality(good),
    }
    return out


def extract_features(
    df: DataFrame,
    keep: Sequence[str],
    jets: str = "jets",
    muons: str = "muons",
    lead: str = "lead_idx",
    sublead: str = "sublead_idx",
    good: Callable[[Column], Column] = lambda j: j["good"],
    tagged: Callable[[Column], Column] = lambda j: j["score"] > 0.1272,
    muon_fields: dict[str, str] | None = None,
) -> DataFrame:
    """The flat feature table: four best-scored good jets, their pairs, the two
    leading muons and event sums. Events with fewer than four good jets or an
    invalid muon index are dropped. ``muon_fields`` maps feature to field."""
    fields = muon_fields or {f: f for f in MUON_FIELDS}
    df = with_selection(df, jets, good, tagged).filter(F.size("_good") >= 4)
    n = F.size(muons)
    df = df.filter(F.col(lead).between(0, n - 1) & F.col(sublead).between(0, n - 1))
    df = df.withColumns({"_m1": F.get(F.col(muons), F.col(lead)), "_m2": F.get(F.col(muons), F.col(sublead))})
    p4 = lambda m: m.withField("p4", p4_from_mass(m["pt"], m["eta"], m["phi"], m["mass"]))
    df = df.withColumns({"_m1": p4(F.col("_m1")), "_m2": p4(F.col("_m2"))})
    m1, m2 = F.col("_m1"), F.col("_m2")
    top = [F.get("_top", F.lit(i)) for i in range(4)]
    out = _feature_columns(top, F.col("_good"), F.col("_tag"), m1, m2, fields)
    same = (m1["charge"] * m2["charge"] > 0).alias("isSameSign")
    return df.select(*keep, *[out[f].cast("double").alias(f) for f in FEATURES], same)


@dataclass(frozen=True)
class JetVariation:
    """A variation of the inputs: the pt of a jet and the pt of a muon. The nominal one
    changes neither."""

    name: str
    jet: Callable[[Column], Column] = lambda j: j["pt"]
    muon: Callable[[Column], Column] = lambda m: m["pt"]


def jet_variations(sources: Sequence[str] = (), resolution: bool = False, muon_scale: tuple[str, str] | None = None, muon_resolution: tuple[str, str] | None = None) -> list[JetVariation]:
    """Nominal, every relative jet source up and down, the jet resolution, and the muon
    pt taken from other fields (up, down)."""

    def relative(source: str, sign: float) -> Callable[[Column], Column]:
        return lambda j: j["pt"] * (1.0 + sign * j[source])

    def smeared(d: str) -> Callable[[Column], Column]:
        return lambda j: j["pt"] / j["jer"] * j[f"jer_{d}"]

    def other(field: str) -> Callable[[Column], Column]:
        return lambda m: m[field]

    sides = (("up", 1.0), ("down", -1.0))
    out = [JetVariation("nominal")]
    out += [JetVariation(f"{s}_{d}", jet=relative(s, sign)) for s in sources for d, sign in sides]
    if resolution:
        out += [JetVariation(f"JER_corr_{d}", jet=smeared(d)) for d, _ in sides]
    for label, pair in (("scale", muon_scale), ("resol", muon_resolution)):
        if pair:
            out += [JetVariation(f"MuonRoch_{label}_{d}", muon=other(f)) for (d, _), f in zip(sides, pair)]
    return out


#: numbers of a jet and a muon in a batch, after their varied pt: products of the angles
#: come from Spark, so that batches and single rows agree to the last digit
_TURN = {"c": lambda o: F.cos(o["phi"]), "s": lambda o: F.sin(o["phi"]), "sh": lambda o: F.sinh(o["eta"]), "ch": lambda o: F.cosh(o["eta"])}


def _numbers(o: Column, fields: Sequence[str]) -> list[Column]:
    cols = [o[f].cast("double").alias(f"n{i}") for i, f in enumerate(("pt", "eta", "phi", "mass", *fields))]
    return cols + [f(o).alias(n) for n, f in _TURN.items()]


#: events whose vectors are made at once, so that their numbers stay in a core's cache
_BLOCK = 512


class _Reads:
    """An object that only lets fields be read, and remembers which."""

    def __init__(self, o: Column):
        self.object, self.fields = o, set()

    def __getitem__(self, field: str) -> Column:
        self.fields.add(field)
        return self.object[field]


def _reads_any(function: Callable[[Column], Column], o: Column, fields: set[str]) -> bool:
    """Can the function of an object depend on one of the fields? True if it does more than
    read fields."""
    seen = _Reads(o)
    try:
        function(seen)
    except Exception:  # what is no column is refused by various errors
        return True
    return bool(seen.fields & fields)


def _columns_of(structs: pa.Array, lists: int, names: Sequence[str], kinds: int) -> tuple[list[np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """The leading list fields of structs as matrices, the numbers by name, and which
    structs have only finite numbers."""
    parts = structs.flatten()
    rows = [pc.fill_null(p.flatten(), float("nan") if pa.types.is_floating(p.type.value_type) else False).to_numpy(zero_copy_only=False) for p in parts[:lists]]
    # a list has a value for each kind, or one for all
    rows = [x.reshape(len(structs), -1) if len(structs) else x.reshape(0, kinds) for x in rows]
    numbers = {n: pc.fill_null(p, float("nan")).to_numpy(zero_copy_only=False) for n, p in zip(names, parts[lists:])}
    fine = np.isfinite(rows[0]).all(axis=1)
    for x in numbers.values():
        fine &= np.isfinite(x)
    return rows, numbers, fine


def _vectors_of_batch(jet_kinds: Sequence[int], muon_kinds: Sequence[int], jet_pt: float, scale_mass: bool) -> Callable:
    """Vectors of all variations of the events of a batch, block by block, in the order
    of ``FEATURES``. Variations are given as places in the varied pt of jets and of muons.
    An event with a missing or infinite number gets null, as one without jets does."""
    jet_names = ("pt", "eta", "phi", "mass", "score", *_TURN)
    muon_names = ("pt", "eta", "phi", "mass", *MUON_FIELDS, *_TURN)
    variations = len(jet_kinds)
    jet_kinds, muon_kinds = np.asarray(jet_kinds), np.asarray(muon_kinds)
    kinds, muon_size = jet_kinds.max() + 1, muon_kinds.max() + 1
    at = {f: i for i, f in enumerate(FEATURES)}
    one, two = np.array(PAIRS).T
    jet_at = {f: [at[f"jet{n}_{f}"] for n in range(1, 5)] for f in JET_FIELDS}
    pair_at = {f: [at[f"bjet_{f}_{i}{j}"] for i, j in PAIRS] for f in ("dr", "m")}
    muon_at = {f: [at[f"{w}_mu_{f}"] for w in ("lead", "sublead")] for f in ("px", "py", "pz", *MUON_FIELDS)}

    def distance(a: dict, b: dict, i=slice(None), j=slice(None)) -> np.ndarray:
        deta, d = a["eta"][i] - b["eta"][j], a["phi"][i] - b["phi"][j]
        d = d - 2.0 * np.pi * np.ceil((d - np.pi) / (2.0 * np.pi))
        return np.sqrt(deta * deta + d * d)

    def moved(o: dict, new: np.ndarray, row: np.ndarray, scaled: bool) -> dict:
        """Objects ``row`` with the pt ``new``."""
        out = {n: x[row] for n, x in o.items()}
        if scaled:
            out["mass"] = out["mass"] * new / np.maximum(out["pt"], 1e-6)
        p = new * out["ch"]
        return out | {"pt": new, "px": new * out["c"], "py": new * out["s"], "pz": new * out["sh"], "e": np.sqrt(p * p + out["mass"] * out["mass"])}

    def mass_of(a: dict, i, j) -> np.ndarray:
        e, px, py, pz = (a[n][i] + a[n][j] for n in ("e", "px", "py", "pz"))
        return np.sqrt(np.maximum(e * e - (px * px + py * py + pz * pz), 0.0))

    def block(jets: pa.Array, muons: pa.Array, last: pa.Array) -> tuple[np.ndarray, ...]:
        """The vectors in a row, which variations of the events have one, how many
        variations an event has, and which events were made."""
        sizes = pc.fill_null(pc.list_value_length(jets), 0).to_numpy(zero_copy_only=False)
        event = np.repeat(np.arange(len(jets)), sizes)
        (pts, tags), jet, fine = _columns_of(jets.flatten(), 2, jet_names, kinds)
        (mu_pts,), mu, mu_fine = _columns_of(muons.flatten(), 1, muon_names, muon_size)
        paired = pc.fill_null(pc.list_value_length(muons), 0).to_numpy(zero_copy_only=False) == 2
        at_muon = np.cumsum(2 * paired) - 2
        there = (sizes > 0) & paired
        there[event[~fine]] = False
        there &= np.concatenate([mu_fine, [True, True]])[np.maximum(at_muon[:, None], 0) + [0, 1]].all(axis=1)
        count = np.where(there, pc.fill_null(last, 0).to_numpy(zero_copy_only=False) + 1, 0)
        given = np.arange(variations) < count[:, None]

        good = (pts > jet_pt) & there[event][:, None]
        m = jet["mass"][:, None] * pts / np.maximum(jet["pt"], 1e-6)[:, None] if scale_mass else jet["mass"][:, None]
        p = pts * jet["ch"][:, None]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0].astype(np.int64)

        # added jet by jet, as in a row
        nth = np.arange(len(event)) - np.repeat(begins, sizes[sizes > 0])
        rounds = np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])

        def summed(x: np.ndarray) -> np.ndarray:
            x, out = np.where(good, x, 0.0), np.zeros((len(jets), kinds))
            for rows in rounds:
                out[event[rows]] += x[rows]
            return out

        sums = {"n": summed(np.ones(1)), "b": summed(tags * 1.0), "pt": summed(pts), "b_pt": summed(tags * pts), "e": summed(np.sqrt(p * p + m * m))}
        full = (sums["n"] >= 4)[:, jet_kinds] & given
        # places among the good jets of an event, best score first, earlier ones before
        order = np.lexsort((np.arange(len(event)), -jet["score"], event))
        ranked = good[order]
        place = np.cumsum(ranked, axis=0)
        place -= np.concatenate([np.zeros((1, kinds), place.dtype), place])[np.repeat(begins, sizes[sizes > 0])]
        j, kind = np.nonzero(ranked & (place <= 4))
        best = np.zeros((4, len(jets), kinds), np.int64)
        best[place[j, kind] - 1, event[order[j]], kind] = order[j]

        who, no = np.nonzero(full)
        kind = jet_kinds[no]
        row = best[:, who, kind]
        top = moved(jet, pts[row, kind], row, scale_mass)
        row = at_muon[who] + np.array([[0], [1]])
        pair = moved(mu, mu_pts[row, muon_kinds[no]], row, False)

        x = np.empty((len(FEATURES), len(who)))
        for f in ("px", "py", "pz", "mass"):
            x[jet_at[f]] = top[f]
        x[jet_at["btag"]] = top["score"]
        for n in (0, 1):
            x[jet_at[f"dr_mu{n + 1}"]] = distance(top, pair, j=n)
        x[pair_at["dr"]], x[pair_at["m"]] = distance(top, top, one, two), mass_of(top, one, two)
        for f, rows in muon_at.items():
            x[rows] = pair[f]
        x[at["dimuon_dr"]], x[at["dimuon_mass"]] = distance(pair, pair, 0, 1), mass_of(pair, 0, 1)
        n, b, pt, b_pt, e = (sums[k][who, kind] for k in ("n", "b", "pt", "b_pt", "e"))
        for f, v in (("nGoodJet", n), ("nBJet", b), ("sumjet_pt", pt), ("sumbjet_pt", b_pt), ("jet_cent", np.where(e > 0, pt / np.where(e > 0, e, 1.0), 0.0))):
            x[at[f]] = v
        return x.T.ravel(), full[given], count, there

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def vectors(jets: pa.Array, muons: pa.Array, last: pa.Array) -> pa.Array:
        parts = [block(*(c.slice(k, _BLOCK) for c in (jets, muons, last))) for k in range(0, max(len(jets), 1), _BLOCK)]
        flat, full, count, there = (np.concatenate(c) for c in zip(*parts))
        ends = np.concatenate([[0], np.cumsum(full) * len(FEATURES)]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(~full))
        outer = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(outer), each, mask=pa.array(~there))

    return vectors


def varied_vectors(
    df: DataFrame,
    variations: Sequence[JetVariation],
    out: str = "vectors",
    is_data: Column | bool = False,
    jets: str = "jets",
    muons: str = "muons",
    lead: str = "lead_idx",
    sublead: str = "sublead_idx",
    fit: Callable[[Column], Column] = lambda j: j["fit"],
    jet_pt: float = 30.0,
    tagged: Callable[[Column], Column] = lambda j: j["score"] > 0.1272,
    scale_mass: bool = False,
    muon_fields: dict[str, str] | None = None,
    use: Callable[[Column], Column] = lambda vectors: vectors,
    as_jet: Callable[[Column], Column] = lambda o: o,
    as_muon: Callable[[Column], Column] = lambda o: o,
) -> DataFrame:
    """Add ``out``: for every variation the vector of all features (in the order of
    ``FEATURES``), rebuilt from the varied jets and muons, or null where the event fails
    the selection under it. Rows of data only have the first one.

    A good jet has the varied pt above ``jet_pt`` and is ``fit``, whatever its pt. The
    numbers of a jet with its varied pt are made in one step, for events with four fit
    jets; variations with the same function share a pt, likewise for muons. Arrow batches
    go through the features of all their events and variations at once; an event with a
    missing or infinite number goes through the same features in its row, over the number
    of the variation. Nothing is exploded or joined.

    ``use`` is an Arrow function from an array of vectors to an array of lists of numbers,
    one or null for each; ``out`` is then what it gives. It gets the vectors in the batch
    that makes them, so they do not pass through the row. ``as_jet`` and ``as_muon`` make
    the struct of a jet or muon from an object; batches compute only the fields in use.
    """
    fields = muon_fields or {f: f for f in MUON_FIELDS}
    jet_moves, muon_moves = (list(dict.fromkeys(moves)) for moves in ([v.jet for v in variations], [v.muon for v in variations]))
    jet_kinds, muon_kinds = [jet_moves.index(v.jet) for v in variations], [muon_moves.index(v.muon) for v in variations]
    n = F.size(muons)
    valid = F.col(lead).between(0, n - 1) & F.col(sublead).between(0, n - 1)
    pair = F.array(*[F.get(F.col(muons), F.col(i)) for i in (lead, sublead)])
    fits = F.filter(jets, lambda o: fit(as_jet(o)))

    def varied(o: Column, moves: Sequence[Callable[[Column], Column]]) -> Column:
        return F.array(*[move(o).cast("double") for move in moves])

    def with_pt(j: Column, new: Column) -> Column:
        jet = j.withField("pt", new)
        return jet.withField("mass", j["mass"] * new / F.greatest(j["pt"], F.lit(1e-6))) if scale_mass else jet

    def jet_numbers(o: Column) -> Column:
        j = as_jet(o)
        # one tag for all variations if it does not read what they change
        changing = jet_moves if _reads_any(tagged, j, {"pt", "mass"}) else jet_moves[:1]
        tags = F.array(*[F.coalesce(tagged(with_pt(j, move(j).cast("double"))), F.lit(False)) for move in changing])
        return F.struct(varied(j, jet_moves).alias("_pts"), tags.alias("_tags"), *_numbers(j, ["score"]))

    def muon_numbers(o: Column) -> Column:
        m = as_muon(o)
        return F.struct(varied(m, muon_moves).alias("_pts"), *_numbers(m, [fields[f] for f in MUON_FIELDS]))

    def where(kept: Column, coll: Column) -> Column:
        """The collection, or none of it: an empty list costs a batch less than a missing one."""
        return F.when(kept, coll).otherwise(F.slice(coll, 1, 0))

    four = V.bind(fits, lambda js: F.transform(where((F.size(js) >= 4) & valid, js), jet_numbers))
    df = settle(df.withColumn("_vj", four), "_vj")
    missed = F.coalesce(F.size("_vj") == 0, F.lit(True))
    both = V.bind(pair, lambda ms: F.transform(where(~missed & ~F.exists(ms, lambda m: m.isNull()), ms), muon_numbers))

    def walk(js: Column, ms: Column) -> Column:
        def vector(no: Column) -> Column:
            kind, muon_kind = F.get(F.lit(jet_kinds), no), F.get(F.lit(muon_kinds), no)

            def of_good(good: Column) -> Column:
                def of_top(top: Column) -> Column:
                    def of_muons(turned: Column) -> Column:
                        cols = _feature_columns([top[i] for i in range(4)], good, F.filter(good, tagged), turned[0], turned[1], fields)
                        return F.array(*[cols[f].cast("double") for f in FEATURES])

                    return V.bind(V.with_p4(F.transform(ms, lambda m: m.withField("pt", m["_pts"][muon_kind]))), of_muons)

                return F.when(F.size(good) >= 4, V.bind(V.with_p4(V.top_by(good, "score", 4)), of_top))

            kept = F.filter(js, lambda j: j["_pts"][kind] > jet_pt)
            return V.bind(F.transform(kept, lambda j: with_pt(j, j["_pts"][kind])), of_good)

        return F.transform(F.sequence(F.lit(0), last), vector)

    data = is_data if isinstance(is_data, Column) else F.lit(is_data)
    last = F.when(data, 0).otherwise(F.lit(len(variations) - 1))
    none = F.array_repeat(F.lit(None).cast("array<double>"), last + 1)
    batch = _vectors_of_batch(jet_kinds, muon_kinds, jet_pt, scale_mass)(F.col("_vj"), both, last)
    df = settle(df.withColumn("_vv", use(batch)), "_vv")
    full_jets = F.transform(fits, lambda o: V.bind(as_jet(o), lambda j: j.withField("_pts", varied(j, jet_moves))))
    full_muons = F.transform(pair, lambda o: V.bind(as_muon(o), lambda m: m.withField("_pts", varied(m, muon_moves))))
    walked = V.bind(full_jets, lambda js: V.bind(full_muons, lambda ms: walk(js, ms)))
    walked = F.when(~missed & F.col("_vv").isNull(), walked).otherwise(F.slice(none, 1, 0))
    # settled for Spark to see that the function takes a column, and the jets are no longer needed
    df = settle(df.withColumns({"_vw": walked, "_vn": missed}), "_vw", "_vn").drop("_vj")
    made = F.when(F.col("_vn"), none).otherwise(F.coalesce("_vv", "_vw"))
    return df.withColumn("_vw", use(F.col("_vw"))).withColumn(out, made).drop("_vv", "_vw", "_vn")


def assignment_features(
    df: DataFrame,
    keep: Sequence[str],
    jets: str = "jets",
    muons: str = "muons",
    muon_good: Callable[[Column], Column] = lambda m: m["good"],
    jet_good: Callable[[Column], Column] = lambda j: j["good"],
    tagged: Callable[[Column], Column] = lambda j: j["score"] > 0.1272,
    source: str | None = "source",
    first_good: bool = True,
    unit: float = 125.0,
) -> DataFrame:
    """Features of the jet-pair assignment: per jet three-momentum, mass, score
    and distances to two muons; per pair distance and mass; sums; the label
    (first pair whose jets both come from code 25, else -1).

    The distance cut uses the first two good muons, or the first two of all
    with ``first_good=False``. Without ``source`` (inference) there is no label.
    """
    df = df.withColumn("_gm", F.filter(muons, muon_good)).filter(F.size("_gm") > 1)
    pool = F.col("_gm") if first_good else F.col(muons)
    df = df.withColumns({"_a": F.get(pool, F.lit(0)), "_b": F.get(pool, F.lit(1))})
    a, b = F.col("_a"), F.col("_b")

    def away(j: Column) -> Column:
        return (folded_delta_r(j["eta"], j["phi"], a["eta"], a["phi"]) > 0.4) & (
            folded_delta_r(j["eta"], j["phi"], b["eta"], b["phi"]) > 0.4
        )

    df = with_selection(df, jets, lambda j: jet_good(j) & away(j), tagged).filter(F.size("_good") > 3)
    top = [F.get("_top", F.lit(i)) for i in range(4)]
    out: dict[str, Column] = {}
    for n, j in enumerate(top, start=1):
        out |= {f"jet{n}_{c}": j["p4"][c] for c in ("px", "py", "pz")}
        out |= {
            f"jet{n}_mass": j["mass"],
            f"jet{n}_score": j["score"],
            f"jet{n}_dr_mu1": folded_delta_r(j["eta"], j["phi"], a["eta"], a["phi"]),
            f"jet{n}_dr_mu2": folded_delta_r(j["eta"], j["phi"], b["eta"], b["phi"]),
        }
    out |= {f"pair_dr_{i}{j}": folded_delta_r(top[i]["eta"], top[i]["phi"], top[j]["eta"], top[j]["phi"]) for i, j in PAIRS}
    out |= {f"pair_m_{i}{j}": pair_mass(top[i]["p4"], top[j]["p4"], unit) for i, j in PAIRS}
    out |= {
        "n_good_jet": F.size("_good"),
        "n_bjet": F.size("_tag"),
        "sum_jet_pt": V.total(F.col("_good"), lambda j: j["pt"]),
        "sum_bjet_pt": V.total(F.col("_tag"), lambda j: j["pt"]),
        "n_good_muon": F.size("_gm"),
        "pass_ss": (F.size("_gm") == 2) & (F.abs(F.get("_gm", F.lit(0))["charge"] + F.get("_gm", F.lit(1))["charge"]) == 2),
    }
    if source is not None:
        ok = F.array(*[(top[i][source] == 25) & (top[j][source] == 25) for i, j in PAIRS])
        out["label"] = V.first_true(ok)
    return df.select(*keep, *[c.alias(n) for n, c in out.items()])


def yield_weight(lumi: Column, xsec: Column, gen: Column, total: Column, pileup: Column) -> Column:
    return lumi * xsec * 1000.0 * gen / total * pileup


#: fixed values: standardisation constants of the stored features
MOMENTUM_STD = 146.2224842392
PT_MEAN, PT_STD = 97.1714688314, 79.3298290615
MASS_MEAN, MASS_STD = 14.4182656164, 10.6231408469
SCORE_MEAN, SCORE_STD = 0.7925129098, 0.2690405989


def undo_standardisation(px: Column, py: Column, pz: Column, mass: Column, score: Column) -> dict[str, Column]:
    return {
        "px": px * MOMENTUM_STD,
        "py": py * MOMENTUM_STD,
        "pz": pz * MOMENTUM_STD,
        "mass": mass * MASS_STD + MASS_MEAN,
        "score": score * SCORE_STD + SCORE_MEAN,
    }


def undo_standardisation_polar(pt: Column, mass: Column, score: Column) -> dict[str, Column]:
    return {"pt": pt * PT_STD + PT_MEAN, "mass": mass * MASS_STD + MASS_MEAN, "score": score * SCORE_STD + SCORE_MEAN}


def refold_distance(dr: Column, deta: Column) -> Column:
    """Distance again from a stored one whose angle was not folded."""
    import math

    dphi = F.sqrt(F.greatest(dr * dr - deta * deta, F.lit(0.0)))
    dphi = F.when(dphi > math.pi, F.lit(2.0 * math.pi) - dphi).otherwise(dphi)
    return F.sqrt(deta * deta + dphi * dphi)


def momentum_eta(p: Column) -> Column:
    return eta_of(p["px"], p["py"], p["pz"])
