"""Documents that contain benchmark items, by edit distance between word sequences.

The CGK random walk turns edit distance into Hamming distance: it reads the words of
a window, copies the current word at every step and moves on or stays by a random
bit of that word, so that two walks over similar windows fall into step again. Bits
of a walk are its words at sampled steps; the hash of a few sampled steps is an LSH
key. Edits of one kind only put walks out of step for good, so keys do not decide:
windows of the size of an item that share a key with it are verified first by exact
edit distance, which bounds the verification of the others.

Only windows that can match are walked: an item of ``n`` words found with ``e``
edits shares at least one run of ``q = (n - e) // (e + 1)`` words with the text, and
at least ``n - q + 1 - q * e`` of its runs of ``q`` words (the counting lemma), at
positions that fix the window to within ``e`` words.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import text_of

#: share of an item's words that may be edited
EDITS = 0.2
#: independent walks, and steps sampled from each
WALKS, STEPS = 48, 3
#: longest run of words used as a seed
SEED_WORDS = 4

#: distinct written words whose hashes a task keeps
MEMO = 1 << 18
#: words searched at a time
SLICE = 1 << 20


#: marks taken off the ends of a word
MARKS = string.punctuation + "\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u2026"


class _Memo(dict):
    """Hash of a white-space separated part: lower-cased, without marks around it;
    zero if nothing is left."""

    def __missing__(self, part: str) -> int:
        word = part.lower()
        if not word.isalnum():
            word = word.strip(MARKS)
        got = xxhash.xxh64_intdigest(word) if word else 0
        if len(self) >= MEMO:
            self.clear()
        self[part] = got
        return got


def word_hashes(text: str, memo: _Memo) -> np.ndarray:
    parts = text.split()
    h = np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))
    return h[h != 0]


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _runs(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` words."""
    out = np.zeros(max(0, len(h) - q + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            out = out * np.uint64(0x100000001B3) + _mix(h[k : k + len(out)], k + 1)
    return out


@dataclass
class Walks:
    """The random choices of all walks: steps whose words make the keys."""

    steps: list[np.ndarray]

    @staticmethod
    def draw(walks: int = WALKS, steps: int = STEPS, reach: float = 2.0, size: int = 1024, seed: int = 11) -> Walks:
        """Steps are drawn as shares of the walk, which is ``reach`` times as long as
        the window: half of the steps read on, so all of it is read."""
        rng = np.random.default_rng(seed)
        return Walks([np.sort(rng.random(steps)) * reach for _ in range(walks)])

    def keys(self, h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """LSH keys, walks by windows, of the windows of ``length`` words at ``starts``.
        Past the end of a window a walk reads a fixed word."""
        padded = np.append(h, np.uint64(0))
        wanted = (np.array(self.steps) * length).astype(np.int64)
        walk = np.arange(len(wanted), dtype=np.uint64)[:, None]
        key = np.repeat(walk + np.uint64(1), len(starts), axis=1)
        end = np.minimum(starts + length, len(h))
        at = np.repeat(starts.astype(np.int64)[None, :], len(wanted), axis=0)
        with np.errstate(over="ignore"):
            salt = walk * np.uint64(0xD6E8FEB86659FD93)
            for step in range(int(wanted.max()) + 1):
                word = padded[np.where(at < end, at, len(h))]
                read = (wanted == step).any(axis=1)
                if read.any():
                    key[read] = key[read] * np.uint64(0x100000001B3) ^ _mix(word[read], step + 1)
                at += ((_mix(word ^ salt, step + 7) >> np.uint64(17)) & np.uint64(1)).astype(np.int64)
        return key


def edit_distance(a: list, b: list, most: int) -> int:
    """Smallest number of word edits that turn ``a`` into a beginning-to-end stretch
    starting at the first word of ``b`` and ending anywhere in it; ``most + 1`` if
    there is none within ``most``. Banded."""
    width = most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - width), min(len(b), i + width)
        new = [most + 1] * (len(b) + 1)
        if i - width <= 0:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row) > most:
            return most + 1
    return min(row)


class Items:
    """Benchmark items prepared for the search; small enough to be sent to tasks."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS, walks: int = WALKS, steps: int = STEPS):
        self.walks = Walks.draw(walks, steps)
        self.items = []
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        memo = _Memo()
        for item, text in items:
            h = word_hashes(text or "", memo)
            if not len(h):
                continue
            n, most = len(h), int(edits * len(h))
            q = max(1, min(SEED_WORDS, (n - most) // (most + 1)))
            shared = max(1, n - q + 1 - q * most)
            for at, run in enumerate(_runs(h, q).tolist()):
                self.seeds.setdefault(q, {}).setdefault(run, []).append((len(self.items), at))
            self.items.append((item, h.tolist(), most, shared, self.walks.keys(h, np.zeros(1, np.int64), n)))
        self.known = {q: np.array(sorted(s), np.uint64) for q, s in self.seeds.items()}
        self.maybe = {}
        for q, known in self.known.items():
            self.maybe[q] = np.zeros(1 << 20, bool)
            self.maybe[q][known & np.uint64((1 << 20) - 1)] = True

    def _starts(self, h: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """By text and item, the places (from the beginning of ``h``) where windows may
        start. ``h`` holds several texts; ``ends`` are the places after them."""
        shifts: dict[tuple[int, int], list[int]] = {}
        for q, known in self.known.items():
            runs = _runs(h, q)
            pos = np.flatnonzero(self.maybe[q][runs & np.uint64((1 << 20) - 1)])
            pos = pos[np.isin(runs[pos], known)]
            for p, text in zip(pos.tolist(), np.searchsorted(ends, pos, "right").tolist()):
                if p + q <= ends[text]:
                    for no, at in self.seeds[q][int(runs[p])]:
                        shifts.setdefault((text, no), []).append(p - at)
        out = {}
        for (text, no), diagonals in shifts.items():
            _, _, most, shared, _ = self.items[no]
            if len(diagonals) < shared:
                continue
            d = np.sort(np.array(diagonals))
            near = np.unique(np.unique(d)[:, None] + np.arange(-most, most + 1)[None, :])
            near = near[(near >= (ends[text - 1] if text else 0)) & (near < ends[text])]
            count = np.searchsorted(d, near + most, "right") - np.searchsorted(d, near - most, "left")
            if (near := near[count >= shared]).size:
                out[text, no] = near
        return out

    def _best(self, h: np.ndarray, starts: np.ndarray, no: int) -> tuple[int, int, int, int] | None:
        item, mine, most, _, keys = self.items[no]
        keyed = (self.walks.keys(h, starts, len(mine)) == keys).any(axis=0)
        best = None
        # a shared key tells which windows come first; none is passed over
        for s in [*starts[keyed].tolist(), *starts[~keyed].tolist()]:
            # a later start must be closer than the best, an earlier one as close
            bound = most if best is None else best[3] - (s > best[1])
            if bound < 0:
                continue
            d = edit_distance(mine, h[s : s + len(mine) + bound].tolist(), bound)
            if d <= bound:
                best = (item, s, len(mine), d)
        return best

    def search(self, texts: list[str], memo: _Memo | None = None) -> list[list[tuple[int, int, int, int]]]:
        """For each text ``item, start, words, edits`` of the closest window of each
        item it contains, the first of equals; ``start`` counts words."""
        memo, out, todo, held = _Memo() if memo is None else memo, [], [], 0

        def flush() -> None:
            ends = np.cumsum([len(x) for x in todo])
            found: list[list] = [[] for _ in todo]
            for (text, no), starts in self._starts(np.concatenate(todo), ends).items():
                first = int(ends[text]) - len(todo[text])
                if best := self._best(todo[text], starts - first, no):
                    found[text].append(best)
            out.extend(sorted(x) for x in found)

        for t in texts:
            todo.append(word_hashes(t, memo))
            held += len(todo[-1])
            if held >= SLICE:
                flush()
                todo, held = [], 0
        if todo:
            flush()
        return out


def load_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most_bytes: int = 64 << 20) -> Items:
    """The benchmark on the driver; it must be small, or this stops with an error."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"benchmark has {size} bytes of text, more than {most_bytes}; search it in parts")
    return Items(sorted((r["id"] if r["id"] is not None else -1, r["text"]) for r in rows.collect()))


HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("edits", pa.int64())]))


def with_hits(df: DataFrame, items: Items, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``_x_hits``: ``item_id, start, words, edits`` of every
    item that the text contains with at most a fifth of its words edited. Words are
    separated by white space, lower-cased, without marks around them. Null and empty texts, and
    items without words, give no hit; rows are independent of each other."""

    def run(batches):
        memo = _Memo()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = items.search([t or "" for t in texts], memo)
            hits = [[dict(zip(("item_id", "start", "words", "edits"), x)) for x in hits] for hits in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, HITS)], names=[*batch.schema.names, "_x_hits"])

    schema = df.limit(0).withColumn("_x_hits", F.lit(None).cast("array<struct<item_id:bigint,start:bigint,words:bigint,edits:bigint>>")).schema
    return df.mapInArrow(run, schema)
