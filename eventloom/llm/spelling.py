"""Spelling variants: words one edit apart, by Gram matrices of letter counts.

Words are points whose coordinates count their letters; one edit moves a point by a
squared distance of at most two. Words are dealt into cells by how many letters of each
of five classes they have, hence by length too, and cells into blocks of bounded size.
One edit leads to the same cell or to one where a class has one letter more or a letter
has changed class, so only these blocks meet, those of one length or of adjacent ones.
For two blocks NumPy multiplies the count matrices, ``|a|^2 + |b|^2 - 2ab`` gives all
squared distances, and pairs at most two apart are verified letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written

#: classes of letters that make up a cell, bits of a class in its number, and
#: coordinates of a point (rare letters share them, which only brings points nearer)
CLASSES, BITS, DIMENSIONS = 5, 12, 32
#: words and letters of a block
BLOCK, BLOCK_LETTERS = 1024, 1 << 18
#: words that a task counts before it hands them on
HELD = 300_000
#: words with neighbours that a task hands on at a time
PASSED_ON = 20_000
#: letters compared at a time when candidates are verified
VERIFIED = 1 << 22
#: words longer than this are compared one by one
LONG = 64


def _word_letters() -> bytes:
    """Latin-1 letters of words for themselves, A-Z in lower case, all else a space."""
    table = bytearray(b" " * 256)
    for c in (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)):
        table[c] = c | 32
    table[0xC0:] = range(0xC0, 0x100)
    return bytes(table)


_LETTERS = _word_letters()


def words_in(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF as Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def without_one(word: bytes, doc_id: bytes, every: int) -> bytes:
    """The word, rid of one letter where ``every`` divides the CRC-32 of id and word."""
    h = zlib.crc32(b"%b:%b" % (doc_id, word if word.isascii() else word.decode("latin-1").encode()))
    if h % every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, drop_every: int | None = None) -> DataFrame:
    """``word, n``: words of at least ``least_letters`` letters that occur at least
    ``least_count`` times in all texts. With ``drop_every`` a letter is left out of a
    word in those documents where a digest of id and word is divisible by it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # a letter may go, so none shorter than this can count
                found = Counter(w for w in words_in(text or "") if len(w) >= least_letters)
                if drop_every:
                    key = (doc_id or "").encode()
                    for w, n in found.items():
                        w = without_one(w, key, drop_every)
                        if len(w) >= least_letters:
                            held[w] += n
                else:
                    held.update(found)
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    slim = df.select(F.col(id_col).cast("string").alias("_x_id"), F.col(text_col).cast("string").alias("_x_text"))
    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _latin(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words, one after the other, and the lengths of the words."""
    raw = [w.encode("latin-1") for w in words]
    return np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))


def _counted(letters: np.ndarray, sizes: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Counts by word and place of letter."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(row * width + place[letters], minlength=len(sizes) * width).reshape(len(sizes), width)


def _places(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class and coordinate of each letter, by its frequency in all words: classes are
    dealt to and fro so that they are about equally frequent."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            letters, _ = _latin(batch.column(0).to_pylist())
            total += np.bincount(letters, minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["letter", "n"])

    # 256 rows at most
    seen = words.select("word").mapInArrow(add, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    total = dict(seen)
    order = sorted(range(256), key=lambda c: (-total.get(c, 0), c))
    classes, places = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for rank, c in enumerate(order):
        turn, k = divmod(rank, CLASSES)
        classes[c] = CLASSES - 1 - k if turn % 2 else k
        places[c] = rank if rank < DIMENSIONS else rank % DIMENSIONS
    return classes, places


def _blocks(words: DataFrame, classes: np.ndarray, block: int) -> DataFrame:
    """``id, cell, words, ns``: blocks of the words of a cell, numbered."""
    most = (1 << BITS) - 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, sizes = _latin(batch.column(0).to_pylist())
            counts = np.minimum(_counted(letters, sizes, classes, CLASSES), most)
            cell = (counts << (BITS * np.arange(CLASSES))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64())], names=["word", "n", "cell"])

    placed = words.select("word", "n").mapInArrow(cells, "word string, n long, cell long")
    sizes = placed.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.length("word")) / BLOCK_LETTERS)).alias("parts"))
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("word"), "parts"))
    # a part holds about ``block`` words
    packed = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("word", "n")).alias("w"))
    return written(packed.select(F.monotonically_increasing_id().alias("id"), "cell", "w.word", "w.n"))


def _meeting(blocks: DataFrame) -> DataFrame:
    """``lid, rid``: blocks of cells that one edit may join, each pair once."""
    one = [1 << (BITS * k) for k in range(CLASSES)]
    steps = [0, *one, *(one[i] - one[j] for i in range(CLASSES) for j in range(i))]
    ids = blocks.select(F.col("id").alias("lid"), "cell")
    stepped = ids.select("lid", F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step"), "cell")
    right = blocks.select(F.col("id").alias("rid"), F.col("cell").alias("to"))
    return stepped.join(right, F.col("cell") + F.col("step") == F.col("to")).where("step <> 0 OR lid <= rid").select("lid", "rid")


class _Block:
    """Words of a block with their points, letters and order of preference."""

    def __init__(self, words: list[str], ns: list[int], places: np.ndarray):
        self.words, self.ns = words, ns
        letters, self.sizes = _latin(words)
        longest = int(self.sizes.max())
        # 32-bit floats hold whole numbers up to 2^24
        kind = np.float32 if longest < 2000 else np.float64
        self.points = _counted(letters, self.sizes, places, DIMENSIONS).astype(kind)
        self.norms = (self.points**2).sum(1)
        self.letters = np.zeros((len(words), min(longest, LONG)), np.uint8)
        short = np.repeat(self.sizes <= LONG, self.sizes)
        row = np.repeat(np.arange(len(words)), self.sizes)[short]
        first = np.cumsum(self.sizes) - self.sizes
        self.letters[row, (np.arange(len(letters)) - np.repeat(first, self.sizes))[short]] = letters[short]
        order = sorted(range(len(words)), key=lambda k: (-ns[k], words[k]))
        self.preferred = np.array(order)
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.preferred] = np.arange(len(words))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _verified(a: _Block, i: np.ndarray, b: _Block, j: np.ndarray) -> np.ndarray:
    """Which of the pairs are one edit apart."""
    ok = np.zeros(len(i), bool)
    gap = b.sizes[j] - a.sizes[i]
    long = (a.sizes[i] > LONG) | (b.sizes[j] > LONG)
    for k in np.flatnonzero(long & (np.abs(gap) <= 1)).tolist():
        ok[k] = one_edit(a.words[i[k]], b.words[j[k]])
    width = max(a.letters.shape[1], b.letters.shape[1])
    x, y = (np.pad(m.letters, ((0, 0), (0, width + 1 - m.letters.shape[1]))) for m in (a, b))
    same = np.flatnonzero(~long & (gap == 0))
    at = max(1, VERIFIED // (width + 1))
    for k in range(0, len(same), at):
        part = same[k : k + at]
        ok[part] = (x[i[part]] != y[j[part]]).sum(1) == 1
    for few, many, si, mj, who in ((x, y, i, j, gap == 1), (y, x, j, i, gap == -1)):
        pick = np.flatnonzero(~long & who)
        for k in range(0, len(pick), at):
            part = pick[k : k + at]
            u, v = few[si[part]], many[mj[part]]
            # v without the letter at the first difference is u
            before = u[:, :-1] == v[:, :-1]
            after = u[:, :-1] == v[:, 1:]
            first = np.where(before.all(1), width, before.argmin(1))
            last = np.where(after.all(1), -1, width - 1 - after[:, ::-1].argmin(1))
            ok[part] = last < first
    return ok


def near_pairs(a: _Block, b: _Block | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words of two blocks, or of one (``b`` None), one edit apart."""
    other = b or a
    apart = a.norms[:, None] + other.norms[None, :] - 2 * (a.points @ other.points.T)
    i, j = np.nonzero(apart <= 2)
    if b is None:
        i, j = i[i < j], j[i < j]
    close = np.abs(a.sizes[i] - other.sizes[j]) <= 1
    i, j = i[close], j[close]
    ok = _verified(a, i, other, j)
    return i[ok], j[ok]


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, near_n, near``: for every word that has words one edit apart their
    number, and the one of largest ``n`` (ties: smallest in code point order) with its
    ``n``. ``words`` is stored and has distinct words of Latin-1 letters."""
    classes, places = _places(words)
    blocks = _blocks(words, classes, block)
    left = blocks.select(F.col("id").alias("lid"), F.col("word").alias("lw"), F.col("n").alias("ln"))
    right = blocks.select(F.col("id").alias("rid"), F.col("word").alias("rw"), F.col("n").alias("rn"))
    met = _meeting(blocks).join(left, "lid").join(right, "rid").select("lid", "rid", "lw", "ln", "rw", "rn")
    names = ["word", "n_near", "near_n", "near"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def sums(own: _Block, i: np.ndarray, other: _Block, j: np.ndarray) -> list:
        found = np.bincount(i, minlength=len(own.words))
        best = np.full(len(own.words), len(other.words))
        np.minimum.at(best, i, other.rank[j])
        some = np.flatnonzero(found)
        top = other.preferred[best[some]].tolist()
        return [[own.words[k] for k in some.tolist()], found[some].tolist(), [other.ns[k] for k in top], [other.words[k] for k in top]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, _Block] | None = None
        held: list[list] = [[], [], [], []]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(held, kinds)], names=names)
            held[:] = [[], [], [], []]
            return batch

        for batch in batches:
            for k in range(batch.num_rows):
                lid, rid, lw, ln, rw, rn = (batch.column(c)[k].as_py() for c in range(6))
                if last is None or last[0] != rid:
                    last = rid, _Block(rw, rn, places)
                b = last[1]
                a = b if lid == rid else _Block(lw, ln, places)
                i, j = near_pairs(a, None if a is b else b)
                if len(i):
                    if a is b:
                        i, j = np.concatenate([i, j]), np.concatenate([j, i])
                    for out in [sums(a, i, b, j)] + ([] if a is b else [sums(b, j, a, i)]):
                        for into, more in zip(held, out):
                            into += more
                if len(held[0]) >= PASSED_ON:
                    yield flush()
        yield flush()

    part = met.mapInArrow(compare, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.less")).alias("near_n"), "b.near")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every ``word, form``: the last word on the way from form to
    form. Each round doubles the steps; forms must not lead back to a word."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, times: int = 2, drop_every: int | None = None, block: int = BLOCK) -> DataFrame:
    """Words of all texts with their spelling group: ``word, form, root, n, n_near,
    form_n``.

    A word's form is the word one edit apart with the largest count (ties: smallest in
    code point order) if it is at least ``times`` its own, else null; the root is reached
    by following forms, and is the word itself where it has none. ``n_near`` counts the
    words one edit apart. Null and empty texts hold no words; a null id counts as an
    empty one in ``drop_every`` (see ``word_counts``); repeated rows count as often as
    they occur; other columns are ignored; an empty table gives an empty result. Words
    of any length are compared; those of over 64 letters one by one.
    """
    if times < 2:
        raise ValueError("forms could lead back to a word")
    words = written(word_counts(df, id_col, text_col, least_letters, least_count, drop_every))
    near = words.join(written(neighbours(words, block)), "word", "left")
    formed = F.col("near_n") >= times * F.col("n")
    whole = written(
        near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    )
    ends = roots(whole.where("form IS NOT NULL"))
    return whole.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
