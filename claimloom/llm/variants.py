"""Spelling variants: words that differ by one code point, grouped under the more frequent form.

Near words are found by two-dimensional range reporting.  The vocabulary is ordered by (length, word) and by (length,
reversed word); a word is a point of its two places.  A word with code point ``i`` replaced, or one inserted before
it, has the prefix ``w[:i]`` and a suffix of ``w``: it lies in an interval of the first order and in one of the second,
and a wavelet tree over the places reports exactly the points in both.

The vocabulary is stored twice, range-partitioned by each order into blocks of about ``BLOCK`` words.  A word asks the
blocks of its first order about edits in its latter half and those of the second about edits in its first half, so that
half of the word is always in the interval and few blocks are asked; the blocks' first words (one for ``BLOCK`` words)
are all that the driver holds.  A task holds one block's trees at a time while questions stream through it.  Words are
of Latin-1 letters, so a word is a row of bytes whose order is that of code points.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.automaton import LETTERS, START, advance, find, finished, pieces, step
from claimloom.llm.common import frugal, stored

BLOCK = 1 << 16
PIECE_BYTES = 4 << 20


# -- words and their counts ---------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", least_chars: int = 5, least_uses: int = 3, slip: int | None = None) -> DataFrame:
    """``word``, ``n``: runs of Latin letters, A-Z lower-cased, of at least ``least_chars`` code points, used ``least_uses`` times.

    With ``slip``, a run loses the code point ``h % length`` wherever ``slip`` divides ``h``, the CRC-32 of
    ``id:run``: slips of the pen that are the same on every run.  Null texts have no words, a null id is an empty one;
    rows that share an id count each.
    """

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1, PIECE_BYTES):
            words = _words(piece, slip)
            words = words.filter(pc.greater_equal(_chars(words), least_chars))
            counted = words.value_counts()
            yield pa.record_batch([counted.field(0).cast(pa.string()), counted.field(1)], names=["word", "n"])

    runs = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    counted = runs.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_uses)


def _chars(words: pa.Array) -> pa.Array:
    return pc.utf8_length(words.cast(pa.large_string()))


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Spans of ``data`` as an Arrow array."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def _words(piece: pa.RecordBatch, slip: int | None) -> pa.Array:
    found = find(piece.column(1), LETTERS)
    words = _packed(found.data, found.starts, found.lengths)
    if slip is None or not len(words):
        return words
    colon, nothing = (pa.scalar(x, pa.large_binary()) for x in (b":", b""))
    heads = pc.binary_join_element_wise(piece.column(0).cast(pa.large_binary()), colon, nothing)
    ends = np.frombuffer(heads.buffers()[1], np.int64)[heads.offset : heads.offset + len(heads) + 1]
    state = advance(np.full(len(heads), START), np.frombuffer(heads.buffers()[2], np.uint8), ends[:-1], np.diff(ends))
    crc = finished(advance(state[found.owners()], found.data, found.starts, found.lengths))
    slips = np.flatnonzero(crc % np.uint32(slip) == 0)
    if not len(slips):
        return words
    changed = []
    for word, h in zip(words.take(pa.array(slips)).to_pylist(), crc[slips].tolist(), strict=True):
        run = word.decode()
        cut = h % len(run)
        changed.append((run[:cut] + run[cut + 1 :]).encode())
    keep = np.ones(len(words), bool)
    keep[slips] = False
    return pa.concat_arrays([words.filter(pa.array(keep)), pa.array(changed, pa.large_binary())])


# -- range reporting in a block -----------------------------------------------------------------------------------


class Order:
    """Words of one length in order, as rows of bytes; narrows intervals of a common prefix by one byte at a time."""

    def __init__(self, rows: np.ndarray):
        self.size, self.length = rows.shape
        self.place = np.argsort(_keys(rows), kind="stable")
        self.rows = rows[self.place]
        differs = self.rows[1:] != self.rows[:-1]
        self.shared = np.concatenate([[-1], differs.argmax(1)]) if self.size > 1 else np.array([-1])
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.parent = np.zeros(self.size, np.int64)  # of each word: where the prefix of the last step begins

    def _step(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all prefixes of ``j`` + 1 bytes: the place of the prefix less its last byte together with that byte; places, and the end."""
        while len(self.steps) <= j:
            begins = np.flatnonzero(self.shared <= len(self.steps))
            child = self.parent[begins] << 8 | self.rows[begins, len(self.steps)]
            begins = np.append(begins, self.size)
            self.steps.append((child, begins))
            self.parent = np.repeat(begins[:-1], np.diff(begins))
        return self.steps[j]

    def intervals(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows ``asked`` and all j: the words that begin with the first j bytes, from ``low[j]`` to before ``high[j]``."""
        n, length = asked.shape
        low, high = np.zeros((length + 1, n), np.int64), np.zeros((length + 1, n), np.int64)
        high[0] = self.size
        live = np.arange(n)
        for j in range(length):
            child, begins = self._step(j)
            wanted = low[j, live] << 8 | asked[live, j]
            at = np.searchsorted(child, wanted)
            hit = at < len(child)
            hit[hit] = child[at[hit]] == wanted[hit]
            live, at = live[hit], at[hit]
            if not len(live):
                break
            low[j + 1, live] = begins[at]
            high[j + 1, live] = begins[at + 1]
        return low, high


def _keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


class Wavelet:
    """A wavelet tree over a permutation, level by level, with ranks of zeros; reports the points of many rectangles at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for level in reversed(range(self.bits)):
            one = values >> level & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the rectangle, value): positions from ``left`` to before ``right``, values from ``low`` to before ``high``."""
        asker = np.flatnonzero((left < right) & (low < high))
        left, right, node = left[asker], right[asker], np.zeros(len(asker), np.int64)
        for level, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            l0, r0 = zeros[left], zeros[right]
            asker = np.concatenate([asker, asker])
            node = np.concatenate([node, node | 1 << level])
            left, right = np.concatenate([l0, zeros[-1] + left - l0]), np.concatenate([r0, zeros[-1] + right - r0])
            keep = (left < right) & (node < high[asker]) & (node + (1 << level) > low[asker])
            asker, node, left, right = asker[keep], node[keep], left[keep], right[keep]
        return asker, node


@dataclass
class Shelf:
    """The words of one length in a block, in both orders, and the tree of their places."""

    forward: Order
    reverse: Order
    tree: Wavelet
    uses: np.ndarray  # by forward place
    of_reverse: np.ndarray  # forward place by reverse place

    @classmethod
    def of(cls, rows: np.ndarray, uses: np.ndarray) -> Shelf:
        forward, reverse = Order(rows), Order(rows[:, ::-1])
        place = np.empty(len(rows), np.int64)
        place[reverse.place] = np.arange(len(rows))
        seen = np.empty(len(rows), np.int64)
        seen[forward.place] = np.arange(len(rows))
        return cls(forward, reverse, Wavelet(place[forward.place]), uses[forward.place], seen[reverse.place])

    def near(self, asked: np.ndarray, latter: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``asked``, forward place of a near word here) by edits in the latter or the first half.

        Words here are as long as those asked, or longer by one.  An edit position is tried where its prefix has words
        and its suffix too.  A word inserted into a run of the same letter has several positions; the last one counts.
        """
        length, longer = asked.shape[1], self.forward.length - asked.shape[1]
        half = length // 2
        low, high = self.forward.intervals(asked)
        back, front = self.reverse.intervals(asked[:, ::-1])
        positions = np.arange(half, length + longer) if latter else np.arange(half)
        suffix = length - positions - (1 - longer)
        asker, place = self.tree.report(low[positions].ravel(), high[positions].ravel(), back[suffix].ravel(), front[suffix].ravel())
        at, row = positions[asker // len(asked)], asker % len(asked)
        found = self.of_reverse[place]
        inside = at < length
        true = ~inside
        true[inside] = self.forward.rows[found[inside], at[inside]] != asked[row[inside], at[inside]]
        return row[true], found[true]


def _rows(words: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words.tolist()), np.uint8).reshape(len(words), length)


def _text(rows: np.ndarray) -> list[str]:
    length = rows.shape[1]
    joined = rows.tobytes().decode("latin-1")
    return [joined[i : i + length] for i in range(0, len(joined), length)]


#: Words of one length that are asked together: bounded by bytes of the words, as intervals of every prefix are held.
ASKED_BYTES = 1 << 19


def _by_length(words: list[str], uses: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    plain = np.empty(len(words), object)
    plain[:] = [w.encode("latin-1") for w in words]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), _rows(plain[at], int(length)), uses[at]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (side, block, asks, word, n), a block's own words first: near pairs in both directions."""
    now, own, shelves = None, [], None
    for batch in batches:
        side, block, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        turns = np.flatnonzero((np.diff(side) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
        for start, stop in zip([0, *turns], [*turns, len(side)], strict=True):
            if start == stop:
                continue
            if now != (side[start], block[start]):
                now, own, shelves = (side[start], block[start]), [], None
            part = batch.slice(start, stop - start)
            words, uses = part.column(3).to_pylist(), part.column(4).to_numpy(zero_copy_only=False)
            if not asks[start]:
                own.append((words, uses))
                continue
            if shelves is None:
                mine, counts = [w for ws, _ in own for w in ws], np.concatenate([np.zeros(0, np.int64), *(n for _, n in own)])
                shelves, own = {length: Shelf.of(rows, n) for length, rows, n in _by_length(mine, counts)}, []
            for length, rows, n in _by_length(words, uses):
                for shelf in filter(None, (shelves.get(length), shelves.get(length + 1))):
                    most = max(1, ASKED_BYTES // length)
                    for at in range(0, len(rows), most):
                        yield from _pairs(shelf, rows[at : at + most], n[at : at + most], side[start] == 0)


def _pairs(shelf: Shelf, rows: np.ndarray, uses: np.ndarray, latter: bool) -> Iterator[pa.RecordBatch]:
    asker, found = shelf.near(rows, latter)
    if not len(asker):
        return
    words, near = _text(rows[asker]), _text(shelf.forward.rows[found])
    n = shelf.uses[found]
    yield pa.record_batch([pa.array(words), pa.array(near), pa.array(n)], names=["word", "near", "near_n"])
    if shelf.forward.length > rows.shape[1]:  # of two lengths only the shorter word asks
        yield pa.record_batch([pa.array(near), pa.array(words), pa.array(uses[asker])], names=["word", "near", "near_n"])


# -- over the whole vocabulary ------------------------------------------------------------------------------------


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word``, ``near``, ``near_n``: every ordered pair of distinct words (columns ``word``, ``n``) one edit apart, once.

    Words must be distinct, not empty and of Latin-1 code points but U+0000.  A block holds about ``block`` words; where
    one half of a word is shared by more words than a block holds, its questions go to all blocks that hold them.
    """
    spark = vocabulary.sparkSession
    blocks = max(1, -(-vocabulary.count() // block))
    own, firsts = [], []
    for side, key in enumerate((F.col("word"), F.reverse("word"))):
        ordered = vocabulary.select("word", "n", F.length("word").alias("len"), key.alias("key")).repartitionByRange(blocks, "len", "key")
        placed = stored(ordered.withColumn("block", F.spark_partition_id()), f"vocabulary-{side}")
        starts = sorted(placed.groupBy("block").agg(F.min(F.struct("len", "key")).alias("first")).collect())
        firsts.append([(b, (f["len"], f["key"])) for b, f in starts])
        own.append(placed.select(F.lit(side).alias("side"), "block", F.lit(False).alias("asks"), "word", "n"))
    shipped = spark.sparkContext.broadcast(firsts)

    @frugal
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for row, word in enumerate(batch.column(0).to_pylist()):
                for side, to in _asked(word, shipped.value):
                    for column, value in zip(out, (side, to, row), strict=True):
                        column.append(value)
            yield pa.record_batch(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array([True] * len(out[0])), *(c.take(pa.array(out[2], pa.int64())) for c in batch.columns)],
                names=["side", "block", "asks", "word", "n"],
            )

    questions = vocabulary.select("word", "n").mapInArrow(ask, "side int, block int, asks boolean, word string, n bigint")
    rows = own[0].union(own[1]).union(questions)
    return rows.repartition("side", "block").sortWithinPartitions("side", "block", "asks").mapInArrow(frugal(_answers), "word string, near string, near_n bigint")


def _asked(word: str, firsts: list[list[tuple[int, tuple[int, str]]]]) -> Iterator[tuple[int, int]]:
    """Blocks (side, number) that may hold words as long as ``word``, or longer by one, with its first or latter half."""
    half = len(word) // 2
    for side, common in enumerate((word[:half], word[half:][::-1])):
        starts = [f for _, f in firsts[side]]
        last = -1
        for length in (len(word), len(word) + 1):
            low = bisect_right(starts, (length, common)) - 1
            high = bisect_right(starts, (length, common + "\xff" * (length - len(common)))) - 1
            for at in range(max(low, last + 1, 0), high + 1):
                yield side, firsts[side][at][0]
                last = at


def group_variants(vocabulary: DataFrame, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of every word of a stored ``vocabulary``.

    ``form`` is the near word of largest ``n`` (ties: smallest in code-point order) if it is used at least ``ratio``
    times as often; ``root`` follows forms to the last.  A word without near words has no form and is its own root; an
    empty vocabulary gives no rows.
    """
    near = near_words(vocabulary, block).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    )
    frequent = -F.col("best.less") >= ratio * F.col("n")
    joined = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    formed = stored(joined, "forms")
    links = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # a form is used at least twice as often, so a chain has under 63 links: six doublings reach the end of any
    for _ in range(6):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
