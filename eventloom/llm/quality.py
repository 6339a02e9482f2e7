"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Two
hidden facts are estimated by expectation-maximisation over the counts of vote
patterns of all documents: whether the text is prose (shape labellers), and whether
it is abusive (lexicon labellers, whose terms come from a bounded sample of labelled
rows). The posterior labels of a bounded sample train a hashed linear scorer, and
the scorer decides on every document.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from eventloom.llm.common import arrow_map, text_of

#: labelled rows from which lexicon terms are taken
LABELLED_ROWS = 8000
#: documents that train the scorer
SCORER_ROWS = 8000
#: hashed word features of the scorer
BUCKETS = 1 << 18
#: lengths of word beginnings that may be terms
STEMS = (4, 5, 6)

GOOD, BAD, NONE = "g", "b", "-"
#: labellers on prose; the others are on abuse
N_SHAPE = 7

_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[%$#*&|~^<>{}\\]|!!")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


_NUMERIC = str.maketrans("", "", string.digits + ".,;:?!()\"'-@+/_’")


def _vote(value: float, good: float, bad: float) -> str:
    """Good up to ``good``, bad from ``bad``, between them no vote."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def _plain(word: str) -> bool:
    """Numbers, addresses and compounds of letters are no junk."""
    left = word.translate(_NUMERIC)
    return not left or left.isalpha()


def shape_votes(text: str) -> str:
    """Votes of the labellers on prose: marks, plain words, capitals, stutter,
    repeated triples, vocabulary, word length. Short texts get fewer votes."""
    w = text.split()
    n = len(w)
    if not n:
        return BAD + NONE * 6
    kinds = set(w)
    odd = {x for x in kinds if not x.strip(".,;:?!()\"'").isalpha() and not _plain(x)}
    return "".join(
        (
            _vote(len(_MARKS.findall(text)) / len(text), 0.002, 0.008),
            _vote(sum(map(odd.__contains__, w)) / n if odd else 0, 0.08, 0.15) if n >= 8 else NONE,
            _vote(len(_UPPER.findall(text)) / len(text), 0.1, 0.3) if n >= 8 else NONE,
            _vote(sum(map(eq, w, w[1:])) / n, 0.03, 0.08) if n >= 30 else NONE,
            _vote(1 - len(set(zip(w, w[1:], w[2:]))) / (n - 2), 0.2, 0.55) if n >= 30 else NONE,
            _vote(1 - math.log(len(kinds)) / math.log(n), 0.12, 0.25) if n >= 30 else NONE,
            _vote(abs(len(text) / n - 7), 3, 6) if n >= 8 else NONE,
        )
    )


def terms_of(text: str) -> set[str]:
    """Lower-case words, and their beginnings as ``abcd*``."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{x[:k]}*" for x in words for k in STEMS if len(x) > k}


def cover_terms(rows: list[tuple[str, bool]], least: int = 4, precision: float = 0.9) -> list[str]:
    """Terms that tell flagged rows from others, found greedily: each next term covers
    the most flagged rows that are still uncovered, so a group of copies adds one
    term at most. A term must be precise and cover ``least`` new rows."""
    often = Counter(t for text, flag in rows if flag for t in terms_of(text))
    inside, outside = {t: set() for t, c in often.items() if c >= least}, defaultdict(int)
    del often
    for no, (text, flag) in enumerate(rows):
        if flag:
            for t in terms_of(text) & inside.keys():
                inside[t].add(no)
    for text, flag in rows:
        if not flag:
            for t in terms_of(text) & inside.keys():
                outside[t] += 1
    fit = {t: s for t, s in inside.items() if len(s) >= precision * (len(s) + outside.get(t, 0))}
    out: list[str] = []
    while fit:
        best = min(fit, key=lambda t: (-len(fit[t]), t.endswith("*"), len(t), t))
        covered = fit[best]
        out.append(best)
        fit = {t: left for t, s in fit.items() if len(left := s - covered) >= least}
    return out


@dataclass
class Lexicons:
    """Term lists of the labellers on abuse: two halves of the sample, and all of it."""

    lists: list[list[str]] = field(default_factory=lambda: [[], [], []])

    def votes(self, words: set[str]) -> str:
        stems = {f"{x[:k]}*" for x in words for k in STEMS if len(x) > k} if any(self.lists) else set()
        return "".join(NONE if not t else BAD if any(x in words or x in stems for x in t) else GOOD for t in self.lists)


def learn_lexicons(labelled: DataFrame, flag: str = "toxic", rows: int = LABELLED_ROWS) -> Lexicons:
    """From columns ``id, text, flag``: at most ``rows`` rows, the first in the order
    of a hash of the id; repeated texts count once."""
    got = labelled.where(F.col(flag).isNotNull()).orderBy(F.xxhash64("id"), "id").limit(rows).collect()
    seen: dict[int, tuple[str, bool]] = {}
    for r in got:
        seen.setdefault(xxhash.xxh64_intdigest(r["text"]), (r["text"], bool(r[flag])))
    parts = [[v for k, v in sorted(seen.items()) if k % 2 == half] for half in (0, 1)]
    return Lexicons([cover_terms(parts[0], 3), cover_terms(parts[1], 3), cover_terms(parts[0] + parts[1], 4)])


@dataclass
class LabelModel:
    """Two-class model of conditionally independent voters; no vote says nothing."""

    good: float = 0.5
    #: by labeller and vote: probability among its votes given good, given bad
    table: list[dict[str, tuple[float, float]]] = field(default_factory=list)

    def posterior(self, votes: str) -> float:
        g, b = math.log(self.good), math.log(1 - self.good)
        for t, v in zip(self.table, votes):
            if v != NONE:
                g, b = g + math.log(t[v][0]), b + math.log(t[v][1])
        return 1 / (1 + math.exp(min(700, b - g)))


def fit_label_model(counts: dict[str, int], rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over vote patterns and how often they occur. Starts
    from the vote: a single bad vote weighs more than a good one, as labellers are
    made to be precise when they object."""
    total = sum(counts.values())
    if not total:
        raise ValueError("no votes to learn from")
    width = len(next(iter(counts)))
    post = {p: 1 / (1 + math.exp(-(0.5 + 0.5 * p.count(GOOD) - 3 * p.count(BAD)))) for p in counts}
    model = LabelModel()
    for _ in range(rounds):
        n_good = sum(post[p] * c for p, c in counts.items())
        table = []
        for k in range(width):
            tally = {v: [0.5, 0.5] for v in (GOOD, BAD)}
            for p, c in counts.items():
                if p[k] != NONE:
                    tally[p[k]][0] += post[p] * c
                    tally[p[k]][1] += (1 - post[p]) * c
            sums = [sum(x[y] for x in tally.values()) for y in (0, 1)]
            table.append({v: (a / sums[0], b / sums[1]) for v, (a, b) in tally.items()})
        model = LabelModel(min(max(n_good / total, 0.001), 0.999), table)
        new = {p: model.posterior(p) for p in counts}
        moved = max(abs(new[p] - post[p]) for p in counts)
        post = new
        if moved < 1e-6:
            break
    return model


def indicators(votes: str) -> list[str]:
    """Features of the votes: each of them, and whether any of a kind objects."""
    parts = (votes[:N_SHAPE], votes[N_SHAPE:])
    return [f"{k}{v}" for k, v in enumerate(votes)] + [f"any{k}{BAD if BAD in p else GOOD}" for k, p in enumerate(parts)]


@dataclass
class Scorer:
    """Linear score of vote indicators and hashed words."""

    votes: dict[str, float]
    words: np.ndarray
    bias: float

    def score(self, votes: str, hashed: np.ndarray) -> float:
        z = self.bias + sum(self.votes.get(x, 0.0) for x in indicators(votes))
        if len(hashed):
            z += float(self.words[hashed].sum()) / math.sqrt(len(hashed))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def hashed_words(words: set[str]) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((digest(x) % BUCKETS for x in words), np.int32, len(words)))


def fit_scorer(rows: list[tuple[str, np.ndarray, float]], rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Scorer:
    """Logistic regression on posterior labels by gradient steps with AdaGrad."""
    names = sorted({x for votes, _, _ in rows for x in indicators(votes)})
    place = {x: i for i, x in enumerate(names)}
    dense = np.array([[place[x] for x in indicators(votes)] for votes, _, _ in rows])
    width = dense.shape[1]
    goal = np.array([p for _, _, p in rows])
    size = np.array([len(h) for _, h, _ in rows])
    flat = np.concatenate([h for _, h, _ in rows]) if size.sum() else np.zeros(0, np.int32)
    owner, scale = np.repeat(np.arange(len(rows)), size), np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
    wv, ww, bias = np.zeros(len(names)), np.zeros(BUCKETS), 0.0
    said = np.array([not x.endswith(NONE) for x in names], float)
    gv, gw, gb = np.full(len(names), 1e-8), np.full(BUCKETS, 1e-4), 1e-8
    for _ in range(rounds):
        z = bias + wv[dense].sum(1) + np.bincount(owner, ww[flat] * scale, len(rows))
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - goal) / len(rows)
        dv = np.bincount(dense.ravel(), np.repeat(err, width), len(names)) * said + decay * wv
        dw = np.bincount(flat, err[owner] * scale, BUCKETS) + decay * ww
        gv, gw, gb = gv + dv * dv, gw + dw * dw, gb + err.sum() ** 2
        wv, ww, bias = wv - rate * dv / np.sqrt(gv), ww - 0.1 * rate * dw / np.sqrt(gw), bias - rate * err.sum() / math.sqrt(gb)
    return Scorer({x: float(wv[i]) for x, i in place.items() if said[i]}, ww.astype(np.float32), float(bias))


@dataclass
class Classifier:
    lexicons: Lexicons
    prose: LabelModel
    civil: LabelModel
    scorer: Scorer

    def score(self, text: str) -> float:
        votes, words = votes_and_words(text, self.lexicons)
        return self.scorer.score(votes, hashed_words(words))




def votes_and_words(text: str, lexicons: Lexicons) -> tuple[str, set[str]]:
    words = set(_WORD.findall(text.lower()))
    return shape_votes(text) + lexicons.votes(words), words


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag: str = "toxic") -> Classifier:
    """Learn from all documents and the labelled rows among them. ``labels`` has
    ``id_col`` and ``flag`` (null: unknown) and may be empty: then the labellers on
    abuse do not vote. Votes are counted over all documents; the collected patterns
    are bounded by the number of labellers."""
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    known = labels.where(F.col(flag).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(flag).alias(flag))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(LABELLED_ROWS)
    lexicons = learn_lexicons(docs.join(picked, "id"), flag)

    def vote(cols: dict) -> dict:
        return {"votes": [votes_and_words(t, lexicons)[0] for t in cols["text"]]}

    seen = arrow_map(docs.select("text"), vote, "votes string", pa.schema([("votes", pa.string())]))
    patterns = {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not patterns:
        return Classifier(lexicons, LabelModel(), LabelModel(), Scorer({}, np.zeros(BUCKETS, np.float32), 0.0))
    parts: list[dict[str, int]] = [defaultdict(int), defaultdict(int)]
    for p in sorted(patterns):
        parts[0][p[:N_SHAPE]] += patterns[p]
        parts[1][p[N_SHAPE:]] += patterns[p]
    prose = fit_label_model(parts[0])
    # labellers without terms do not vote; then nothing is known of abuse
    civil = fit_label_model(parts[1]) if any(set(p) != {NONE} for p in parts[1]) else LabelModel(0.999, [dict.fromkeys((GOOD, BAD), (1.0, 1.0))] * 3)

    def features(cols: dict) -> dict:
        got = [votes_and_words(t, lexicons) for t in cols["text"]]
        return {"votes": [v for v, _ in got], "hashed": [hashed_words(w).tolist() for _, w in got]}

    sample_ids = docs.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(SCORER_ROWS)
    kind = pa.schema([("votes", pa.string()), ("hashed", pa.list_(pa.int32()))])
    sample = arrow_map(docs.join(sample_ids, "id").select("text"), features, "votes string, hashed array<int>", kind).toArrow()

    def goal(votes: str) -> float:
        return prose.posterior(votes[:N_SHAPE]) * civil.posterior(votes[N_SHAPE:])

    rows = [(v, h.values.to_numpy(), goal(v)) for v, h in zip(sample.column("votes").to_pylist(), sample.column("hashed"))]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    # patterns the sample has missed are learned from the pattern alone
    drawn = {v for v, _, _ in rows}
    rows += [(p, np.zeros(0, np.int32), goal(p)) for p in sorted(patterns) if p not in drawn]
    return Classifier(lexicons, prose, civil, fit_scorer(rows))


def with_score(df: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``_x_score``, double: the probability that the text is
    fit for training. A null text is scored as an empty one; an empty text is bad by
    the shape labellers. Rows are independent of each other."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            scores = [model.score(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "_x_score"])

    schema = StructType([*df.schema.fields, StructField("_x_score", DoubleType())])
    return df.mapInArrow(run, schema)
