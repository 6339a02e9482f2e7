"""Scores of documents under a gated recurrent language model trained here.

Every token's probability is that of its class, given the state, times that of the
word in its class. The most frequent words form classes of equal size whose words are
told apart by the state as well; less frequent words form a few bands, and a word's
share of its band is its smoothed count over the whole corpus. The last band holds the
words that are too many to send to tasks, and unknown ones: their counts come by a
join, so all statistics cover the whole corpus.

The model is trained by truncated backpropagation on all training documents. It starts
as the model of the counts alone. In every round the tasks take the weights of the last
one through a part of the documents, each document in one round, and return them; the
mean of the weights by tokens begins the next round. Scoring carries the state over the
windows of a document to its end.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import kept_in_worker, text_of, written

#: token that ends a document; no word holds a space
END = b" "
#: classes of frequent words, and words of a class
CLASSES, CLASS_WORDS = 32, 64
#: first ranks of the bands of the less frequent words; the last is in no task's list
BANDS = (CLASSES * CLASS_WORDS, 1 << 13, 1 << 15, 1 << 18)
#: state of the network
STATE = 16
#: ends of the rounds of training, in 64ths of the documents by a hash of their id
ROUNDS = (1, 4, 16, 64)
#: steps of a window, lanes side by side in training and scoring
STEPS, TRAIN_LANES, LANES = 32, 256, 512
#: size of a step at the beginning and at the end of a task's part
RATE, LAST_RATE = 0.01, 0.001
#: windows that a task's lanes are to make at least; parts of fewer tokens have fewer lanes
LEAST_WINDOWS = 64
#: tokens scored, and learned from, at a time
SLICE, TRAIN_SLICE = 3 << 20, 1 << 20
#: parts in which the weights of the tasks are added up
SLOTS = 16


def held_out(doc_id: int | None) -> bool:
    """Documents that training does not see; a missing id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def words_of(text: str) -> list[bytes]:
    """Words without their end token: A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "replace").lower().split()


@dataclass
class Vocabulary:
    """The most frequent training tokens by rank, with what a task needs of the rest."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int

    def __post_init__(self):
        self.rank = {w: i for i, w in enumerate(self.words)}
        self.last = BANDS[-1]  # rank of every word that is not listed
        c = self.counts + 0.5
        edges = [min(b, len(c)) for b in BANDS]
        masses = [c[a:b].sum() for a, b in zip(edges, edges[1:])]
        # all tokens, half a count for each, and half a count for the unknown
        rest = self.total + 0.5 * self.distinct - c.sum() + 0.5
        self.log_mass = np.log10(np.maximum([*masses, rest], 1e-300))
        self.log_count = np.log10(c)
        self.log_all = float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.rank.get, words, repeat(self.last))), np.int32)


def _shared(spark: SparkSession, vocabulary: Vocabulary) -> Callable[[], Vocabulary]:
    """The vocabulary in tasks, made once per worker; what is sent has a bounded size."""
    words = spark.sparkContext.broadcast(vocabulary.words)
    counts, name = (vocabulary.counts, vocabulary.total, vocabulary.distinct), ("vocabulary", uuid.uuid4().hex)
    return lambda: kept_in_worker(name, lambda: Vocabulary(words.value, *counts))


def _classes(ranks: np.ndarray) -> np.ndarray:
    band = np.searchsorted(np.array(BANDS), ranks, "right")  # 0: frequent words
    return np.where(band == 0, ranks // CLASS_WORDS, CLASSES + band - 1)


def _inputs(ranks: np.ndarray) -> np.ndarray:
    """Rows of the input table: a word, or its band."""
    band = np.searchsorted(np.array(BANDS), ranks, "right")
    return np.where(band == 0, ranks, BANDS[0] + band - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Gated recurrent unit with a softmax over classes and one over the words of a
    class. ``begin`` is the input before the first token."""

    N_INPUT = BANDS[0] + len(BANDS) + 1
    N_CLASS = CLASSES + len(BANDS)
    BEGIN = N_INPUT - 1

    def __init__(self, seed: int = 5, p: dict[str, np.ndarray] | None = None, vocabulary: Vocabulary | None = None):
        if p is not None:
            self.p = p
            return
        rng = np.random.default_rng(seed)
        s = 1 / np.sqrt(STATE)

        def draw(*shape):
            return (rng.standard_normal(shape) * s).astype(np.float32)

        self.p = {
            "x": draw(self.N_INPUT, 3 * STATE) * np.float32(0.5), "u": draw(STATE, 2 * STATE), "v": draw(STATE, STATE), "b": np.zeros(3 * STATE, np.float32),
            "c": draw(STATE, self.N_CLASS), "cb": np.zeros(self.N_CLASS, np.float32),
            "w": draw(CLASSES, STATE, CLASS_WORDS) * np.float32(0.5), "wb": np.zeros((CLASSES, CLASS_WORDS), np.float32),
        }
        if vocabulary is not None:
            # what the counts say without any state; ranks without a word get half a count
            heads = np.full(BANDS[0], 0.5)
            listed = vocabulary.counts[: BANDS[0]] + 0.5
            heads[: len(listed)] = listed
            heads = heads.reshape(CLASSES, CLASS_WORDS)
            self.p["wb"][:] = np.log(heads)
            self.p["cb"][:] = np.log(np.append(heads.sum(1), np.maximum(0.5, 10**vocabulary.log_mass)))
            for k in ("c", "w"):
                self.p[k] *= np.float32(0.1)

    def packed(self) -> bytes:
        return b"".join(self.p[k].astype("<f4").tobytes() for k in sorted(self.p))

    def unpacked(self, data: bytes) -> "Network":
        """A network of this one's shape from packed weights."""
        out, at = {}, 0
        for k in sorted(self.p):
            n = self.p[k].size
            out[k] = np.frombuffer(data, "<f4", n, at).reshape(self.p[k].shape).astype(np.float32)
            at += 4 * n
        return Network(p=out)

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state from the old one and rows of the input table."""
        p = self.p
        a = x + p["b"]
        zr = _sigmoid(a[:, : 2 * STATE] + h @ p["u"])
        z, r = zr[:, :STATE], zr[:, STATE:]
        n = np.tanh(a[:, 2 * STATE :] + (r * h) @ p["v"])
        return z * h + (1 - z) * n, z, r, n

    def class_log(self, h: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Log probability of a class for every state."""
        return _picked(h @ self.p["c"] + self.p["cb"], kinds)

    def word_log(self, h: np.ndarray, k: int, words: np.ndarray) -> np.ndarray:
        """Log probability of a word of class ``k`` for every state."""
        return _picked(h @ self.p["w"][k] + self.p["wb"][k], words)


def _powers(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of all rows, in place, and the sums of rows, with a common shift;
    rows far below the largest one get a shift of their own."""
    ones = np.ones(y.shape[1], y.dtype)
    if y.size and y.max() - y.min() > 60:
        y -= y.max(axis=1, keepdims=True)
    else:
        y -= y.max(initial=0)
    np.exp(y, out=y)
    return y, y @ ones


def _picked(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of every row the log of the share of one exponential."""
    e, total = _powers(y)
    # a share too small for the type is the smallest it knows
    return np.log(np.maximum(e[np.arange(len(e)), at], np.finfo(e.dtype).tiny) / total)


def _lanes(lengths: list[int], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, long ones first, each to the shortest lane; the
    longest lane comes first."""
    import heapq

    out: list[list[int]] = [[] for _ in range(max(1, min(lanes, len(lengths))))]
    heap = [(0, k) for k in range(len(out))]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (size + lengths[i], k))
    return sorted(out, key=lambda lane: -sum(lengths[i] for i in lane))


class _Layout:
    """Documents in lanes, window by window. Lanes are in order of length, so those that
    still have tokens come first; nothing is padded."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        dealt = _lanes([len(d) for d in docs], lanes)
        order = [i for lane in dealt for i in lane]
        lengths = np.array([len(docs[i]) for i in order], np.int64)
        self.flat = np.concatenate([docs[i] for i in order])
        self.owner = np.repeat(np.array(order, np.int32), lengths)
        self.fresh = np.zeros(len(self.flat), bool)
        self.fresh[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        self.size = np.array([sum(len(docs[i]) for i in lane) for lane in dealt], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.lanes, self.steps = len(dealt), int(self.size.max(initial=0))

    def window(self, at: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks by step and lane (-1: no token), whether a document begins there, and the
        number of the document, of the lanes that have tokens at step ``at``."""
        on = int(np.searchsorted(-self.size, -at, "left"))
        step = np.arange(at, min(at + steps, self.steps))[:, None]
        place = self.start[:on] + step
        over = step >= self.size[:on]
        if over.any():
            place[over] = 0
            return np.where(over, -1, self.flat[place]), self.fresh[place] & ~over, self.owner[place]
        return self.flat[place], self.fresh[place], self.owner[place]


class Trainer:
    """Truncated backpropagation over windows of ``STEPS`` words; the state goes on from
    one window to the next of a lane. Steps are Adam's."""

    def __init__(self, net: Network):
        self.net, self.count, self.tokens = net, 0, 0
        self.first = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in net.p.items()}

    def learn(self, docs: list[np.ndarray]) -> None:
        """One walk over documents (ranks with the end token)."""
        size = sum(map(len, docs))
        if not size:
            return
        self.tokens += size
        lanes = min(TRAIN_LANES, max(8, size // (STEPS * LEAST_WINDOWS)))
        # longer than the mean lane, a text goes on in another lane with a new state
        most = max(STEPS, -(-size // lanes))
        parts = [d[at : at + most] for d in docs for at in range(0, len(d), most)]
        layout = _Layout(parts, lanes)
        h = np.zeros((layout.lanes, STATE), np.float32)
        before = np.full(layout.lanes, Network.BEGIN)
        windows = -(-layout.steps // STEPS)
        for w in range(windows):
            # lanes that have ended take no more part
            token, fresh, _ = layout.window(w * STEPS, STEPS)
            on = token.shape[1]
            grads, h, before = _window(self.net, token, fresh, h[:on], before[:on])
            self._step(grads, RATE + (LAST_RATE - RATE) * w / windows)

    def _step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.count += 1
        fast, slow = 1 - 0.9**self.count, 1 - 0.999**self.count
        for k, g in grads.items():
            np.clip(g, -1, 1, out=g)
            first, second = self.first[k], self.second[k]
            first += np.float32(0.1) * (g - first)
            second += np.float32(0.001) * (g * g - second)
            self.net.p[k] -= np.float32(rate / fast) * first / (np.sqrt(second / np.float32(slow)) + np.float32(1e-8))


def _window(net: Network, token: np.ndarray, fresh: np.ndarray, h: np.ndarray, before: np.ndarray):
    """Gradients of the mean loss of one window, and where the next begins."""
    p, (steps, lanes) = net.p, token.shape
    kind = p["x"].dtype
    old, new, z, gate, r, n = (np.empty((steps, lanes, STATE), kind) for _ in range(6))
    live, after = token >= 0, _inputs(token)
    source = np.empty((steps, lanes), np.int64)
    begins, full = fresh.any(1).tolist(), live.all(1).tolist()
    for s in range(steps):
        if begins[s]:
            h = np.where(fresh[s][:, None], kind.type(0), h)
            before = np.where(fresh[s], Network.BEGIN, before)
        old[s], source[s] = h, before
        a = p["x"][before] + p["b"]
        zr = _sigmoid(a[:, : 2 * STATE] + h @ p["u"])
        z[s], gate[s] = zr[:, :STATE], zr[:, STATE:]
        np.multiply(gate[s], h, out=r[s])
        np.tanh(a[:, 2 * STATE :] + r[s] @ p["v"], out=n[s])
        np.multiply(z[s], h - n[s], out=new[s])
        new[s] += n[s]
        if full[s]:
            h, before = new[s], after[s]
        else:
            h = np.where(live[s][:, None], new[s], h)
            before = np.where(live[s], after[s], before)
    flat = np.flatnonzero(live.ravel())
    scale = kind.type(1 / max(1, len(flat)))
    hs, ranks = new.reshape(-1, STATE)[flat], token.ravel()[flat]
    kinds = _classes(ranks)
    # by class, so that the words of one lie together
    order = np.argsort(kinds.astype(np.int16), kind="stable")
    flat, hs, ranks, kinds = flat[order], hs[order], ranks[order], kinds[order]
    grads = {"w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"]), "x": np.zeros_like(p["x"])}
    prob = _softmax(hs @ p["c"] + p["cb"])
    prob[np.arange(len(flat)), kinds] -= 1
    prob *= scale
    grads["c"], grads["cb"] = hs.T @ prob, _column_sums(prob)
    dh = prob @ p["c"].T
    edges = np.searchsorted(kinds, np.arange(CLASSES + 1)).tolist()
    for k in range(CLASSES):
        lo, hi = edges[k], edges[k + 1]
        if lo < hi:
            q = _softmax(hs[lo:hi] @ p["w"][k] + p["wb"][k])
            q[np.arange(hi - lo), ranks[lo:hi] - k * CLASS_WORDS] -= 1
            q *= scale
            grads["w"][k], grads["wb"][k] = hs[lo:hi].T @ q, _column_sums(q)
            dh[lo:hi] += q @ p["w"][k].T
    back = np.zeros((steps * lanes, STATE), kind)
    back[flat] = dh
    back = back.reshape(steps, lanes, STATE)
    left = 1 - z
    to_z = old - n
    to_z *= z
    to_z *= left
    np.multiply(n, n, out=n)
    to_n = left
    to_n *= 1 - n
    slope = gate * (1 - gate)
    slope *= old
    rows = np.empty((steps, lanes, 3 * STATE), kind)
    carry = np.zeros((lanes, STATE), kind)
    vt, ut = p["v"].T.copy(), p["u"].T.copy()
    for s in range(steps - 1, -1, -1):
        g = carry + back[s]
        if not full[s]:
            through = np.where(live[s][:, None], kind.type(0), carry)
            g = np.where(live[s][:, None], g, kind.type(0))
        row = rows[s]
        dn = row[:, 2 * STATE :]
        np.multiply(g, to_n[s], out=dn)
        drh = dn @ vt
        np.multiply(g, to_z[s], out=row[:, :STATE])
        np.multiply(drh, slope[s], out=row[:, STATE : 2 * STATE])
        carry = row[:, : 2 * STATE] @ ut
        carry += g * z[s]
        drh *= gate[s]
        carry += drh
        if not full[s]:
            carry += through
        if begins[s]:
            carry = np.where(fresh[s][:, None], kind.type(0), carry)
    rows = rows.reshape(-1, 3 * STATE)
    grads["u"] = old.reshape(-1, STATE).T @ rows[:, : 2 * STATE]
    grads["v"] = r.reshape(-1, STATE).T @ rows[:, 2 * STATE :]
    grads["b"] = _column_sums(rows)
    # rows of the input table that occur, summed up
    source = source.ravel()
    order = np.argsort(source.astype(np.int16), kind="stable")
    heads = np.flatnonzero(np.diff(source[order], prepend=-1))
    grads["x"][source[order[heads]]] = np.add.reduceat(rows[order], heads, axis=0)
    return grads, h, before


def _softmax(y: np.ndarray) -> np.ndarray:
    e, total = _powers(y)
    e *= (1 / total)[:, None]
    return e


def _column_sums(y: np.ndarray) -> np.ndarray:
    return np.ones(len(y), y.dtype) @ y


def log10_scores(net: Network, vocabulary: Vocabulary, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document (ranks with the end token) but for the counts
    of unlisted words, which are to be added."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    layout = _Layout(docs, LANES)
    h = np.zeros((layout.lanes, STATE), np.float32)
    before = np.full(layout.lanes, Network.BEGIN)
    rows = net.p["x"]
    for at in range(0, layout.steps, STEPS):
        # lanes that have ended take no more part
        t, f, owner = layout.window(at, STEPS)
        h, before = h[: t.shape[1]], before[: t.shape[1]]
        after = _inputs(t)
        states = np.empty((*t.shape, STATE), np.float32)
        for s in range(len(t)):
            if f[s].any():
                h = np.where(f[s][:, None], np.float32(0), h)
                before = np.where(f[s], Network.BEGIN, before)
            h = states[s] = net.step(h, rows[before])[0]
            before = after[s]  # past the end of a lane anything will do
        flat, who = t.ravel(), owner.ravel()
        live = np.flatnonzero(flat >= 0)
        ranks, hs = flat[live], states.reshape(-1, STATE)[live]
        kinds = _classes(ranks)
        logs = net.class_log(hs, kinds).astype(np.float64)
        order = np.argsort(kinds.astype(np.int16), kind="stable")
        edges = np.searchsorted(kinds[order], np.arange(CLASSES + 1)).tolist()
        for k in range(CLASSES):
            idx = order[edges[k] : edges[k + 1]]
            if len(idx):
                logs[idx] += net.word_log(hs[idx], k, ranks[idx] - k * CLASS_WORDS)
        logs /= np.log(10)
        tail = np.flatnonzero(kinds >= CLASSES)
        logs[tail] -= vocabulary.log_mass[kinds[tail] - CLASSES]
        listed = tail[ranks[tail] < vocabulary.last]
        logs[listed] += vocabulary.log_count[ranks[listed]]
        out += np.bincount(who[live], logs, len(docs))
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """``word, c``: how often each token occurs in the training documents (``id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not held_out(i):
                    counts.update(words_of(text))
                    counts[END] += 1
                if len(counts) > SLICE // 2:
                    yield send(counts)
                    counts = Counter()
        if counts:
            yield send(counts)

    return docs.select("id", "text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """Vocabulary from the counts of all training documents."""
    size = counts.agg(F.sum("c").alias("total"), F.count("*").alias("distinct")).first()
    # the smallest count that no more words reach than fit the list; equal counts are
    # listed together or not at all, so no task sorts the words
    most, least = 0, None
    for r in sorted(counts.groupBy("c").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["c"]):
        most += r["n"]
        if most > BANDS[-1]:
            break
        least = r["c"]
    top = counts.where(F.col("c") >= (least if least is not None else size["total"] or 0)).toArrow()
    top = top.sort_by([("c", "descending"), ("word", "ascending")]).slice(0, BANDS[-1])
    return Vocabulary(top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.float64), size["total"] or 0, size["distinct"])


def trained(docs: DataFrame, vocabulary: Vocabulary, shared: Callable[[], Vocabulary] | None = None) -> tuple[Network, int]:
    """The network after all rounds, and the number of tokens it has learned from: every
    token of every training document (``id, text``) once. A task returns its weights and
    tokens, which have a fixed size; they are added up in parts before the driver takes
    the mean."""
    net = Network(vocabulary=vocabulary)
    shared = shared or _shared(docs.sparkSession, vocabulary)
    training = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    place = F.pmod(F.xxhash64("id", F.lit("round")), F.lit(ROUNDS[-1]))
    learned, begin = 0, 0
    for end in ROUNDS:
        start = docs.sparkSession.sparkContext.broadcast(net.packed())

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            vocabulary = shared()
            trainer, held, size = Trainer(Network().unpacked(start.value)), [], 0
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    held.append(vocabulary.ranks([*words_of(text), END]))
                    size += len(held[-1])
                    if size >= TRAIN_SLICE:
                        trainer.learn(held)
                        held, size = [], 0
            trainer.learn(held)
            if trainer.tokens:
                slot = TaskContext.get().partitionId() % SLOTS
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([trainer.tokens]), pa.array([trainer.net.packed()], pa.binary())], names=["slot", "n", "weights"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0, 0
            for batch in batches:
                for tokens, data in zip(batch.column("n").to_pylist(), batch.column("weights").to_pylist()):
                    total, n = total + tokens * np.frombuffer(data, "<f4").astype(np.float64), n + tokens
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

        part = docs.where(training & (place >= begin) & (place < end)).select("text")
        sent = part.mapInArrow(learn, "slot int, n long, weights binary")
        sums = sent.repartition(SLOTS, "slot").mapInArrow(add, "n long, total binary").collect()
        n = sum(r["n"] for r in sums)
        if n:
            mean = sum(np.frombuffer(r["total"], np.float64) for r in sums) / n
            net = net.unpacked(mean.astype("<f4").tobytes())
        learned, begin = learned + n, end
    return net, learned


_ROW = "k long, id long, held_out boolean, n_tokens long, n_known long, n_open long, base double, score double, h long, n long"
_ROW_ARROW = pa.schema(
    [("k", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_open", pa.int64()),
     ("base", pa.float64()), ("score", pa.float64()), ("h", pa.int64()), ("n", pa.int64())]
)


def _parts(docs: DataFrame, shared: Callable[[], Vocabulary], net: Network) -> DataFrame:
    """Two kinds of rows: per document what listed words give (``h`` is null), and per
    document and unlisted word its hash ``h`` and number ``n``."""
    weights = docs.sparkSession.sparkContext.broadcast(net.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, net = shared(), Network().unpacked(weights.value)

        def solve(keys: list, ids: list, ranks: list[np.ndarray], opened: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            scores = log10_scores(net, vocabulary, ranks)
            listed = [r[r < vocabulary.last] for r in ranks]
            base = [float(vocabulary.log_count[r].sum()) - len(a) * vocabulary.log_all for r, a in zip(listed, ranks)]
            none = [None] * len(keys)
            cols = [keys, ids, [held_out(i) for i in ids], [len(r) for r in ranks], [len(r) for r in listed], [len(o) for o in opened], base, scores, none, none]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW_ARROW)], schema=_ROW_ARROW)
            digest = xxhash.xxh64_intdigest
            k, h, n = [], [], []
            for key, o in zip(keys, opened):
                for w, c in Counter(o).items():
                    k.append(key)
                    h.append(digest(w, 42))
                    n.append(c)
            if k:
                blank = [None] * len(k)
                cols = [k, *[blank] * 7, np.array(h, np.uint64).view(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW_ARROW)], schema=_ROW_ARROW)

        keys, ids, ranks, opened, size = [], [], [], [], 0
        for batch in batches:
            for key, i, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words = [*words_of(text), END]
                r = vocabulary.ranks(words)
                keys.append(key)
                ids.append(i)
                ranks.append(r)
                opened.append([words[j] for j in np.flatnonzero(r == vocabulary.last).tolist()])
                size += len(r)
                if size >= SLICE:
                    yield from solve(keys, ids, ranks, opened)
                    keys, ids, ranks, opened, size = [], [], [], [], 0
        if keys:
            yield from solve(keys, ids, ranks, opened)

    return docs.select("k", "id", "text").mapInArrow(run, _ROW)


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col, held_out, n_tokens, n_known, train_tokens,
    base_score, score``; both scores are log10 probabilities of the whole text.

    Null and empty texts are the end token alone. A row without an id is a training
    row. Repeated rows count each in training and are scored alike. If there is no
    training document, all tokens are unknown. An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("k", F.xxhash64("id", "text"))
    counts = written(token_counts(docs))
    vocabulary = vocabulary_of(counts)
    shared = _shared(df.sparkSession, vocabulary)
    net, _ = trained(docs, vocabulary, shared)
    parts = written(_parts(docs, shared, net))
    rows, words = parts.where("h IS NULL"), parts.where("h IS NOT NULL").select("k", "h", "n")
    rare = counts.select(F.xxhash64("word").alias("h"), "c")
    looked = words.join(rare, "h", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    sums = looked.groupBy("k").agg(
        F.sum(F.col("n") * log).alias("log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.sum("n").alias("all")
    )
    # rows that repeat id and text have a common key: each gets its share of the sum
    share = F.col("n_open") / F.col("all")
    more = F.coalesce(F.col("log") * share, F.lit(0.0))
    return rows.join(sums, "k", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.round(F.col("known") * share).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
