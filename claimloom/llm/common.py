"""Helpers shared by the corpus operators: shared storage, batching, chunk dictionaries."""

from __future__ import annotations

import ctypes
import gc
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.storage import scratch, shared_folder, stored

__all__ = [
    "Chunks", "Words", "bounded_sample", "frugal", "load", "logistic", "scratch", "shared_folder", "sigmoid", "slices", "stored", "text_segments", "train_row", "unused",
]

#: Text bytes gathered before a segment is processed; bounds a Python worker's memory.
SEGMENT_BYTES = 12 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def train_row(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learned from: crc32 of the id's text mod 5 is not 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def text_segments(batches: Iterator[pa.RecordBatch], limit: int = SEGMENT_BYTES) -> Iterator[tuple[pa.Array, list]]:
    """Gather (first column as Arrow array, second column's values as UTF-8 bytes or None) up to about ``limit`` bytes."""
    ids: list[pa.Array] = []
    texts: list = []
    size = 0
    for batch in batches:
        values = batch.column(1)
        if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
            values = values.cast(pa.large_binary())
        for at in range(0, batch.num_rows, 256):
            part = values.slice(at, 256).to_pylist()
            texts += part
            ids.append(batch.column(0).slice(at, 256))
            size += sum(len(t) for t in part if t)
            if size >= limit:
                yield pa.concat_arrays(ids), texts
                ids, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(ids), texts


def frugal(run: Callable) -> Callable:
    """An Arrow function that gives a task's memory back at its end; Spark keeps Python workers for later tasks."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)

    return all_of


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SEGMENT_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Pieces of whole rows, each with its texts (of ``column``, as UTF-8 bytes or None) of up to about ``limit`` bytes or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            gone = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, gone + limit, "right")))
            part = batch.slice(at, stop - at)
            yield part, part.column(column).cast(pa.large_binary()).to_pylist()
            at = stop


def unused(columns: list[str], name: str) -> str:
    """``name`` behind as many underscores as it takes to be none of ``columns``; Spark's names don't tell cases apart."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Chunks:
    """Texts cut before single blanks, with each distinct chunk numbered once.

    ``first[i]`` codes the start of text ``i`` in ``heads``; ``codes`` hold the other chunks of all
    texts, numbered in ``tails``, each of which stands for a blank and that string; ``counts[i]``
    tells how many belong to text ``i``.  A cut is made only where a blank has a character that is not
    white space before or behind it, so no token of the tokenizers used here crosses it.
    """

    UNSAFE = re.compile(r"\s (?:\s|\Z)")
    SAFE = re.compile(r"(?<=\S)(?= )|(?= \S)")

    def __init__(self, texts: list[str], anywhere: bool = False):
        heads: dict[str, int] = defaultdict(count().__next__)
        tails: dict[str, int] = defaultdict(count().__next__)
        first, codes, counts = [], [], []
        for text in texts:
            if anywhere or not self.UNSAFE.search(text):
                parts = text.split(" ")
            else:
                parts = self.SAFE.split(text)
                parts = [parts[0], *(p[1:] for p in parts[1:])]
            first.append(heads[parts[0]])
            counts.append(len(parts) - 1)
            if len(parts) > 1:
                del parts[0]
                codes.append(np.fromiter(map(tails.__getitem__, parts), np.int32, len(parts)))
        self.heads, self.tails = list(heads), list(tails)
        self.first = np.array(first, np.int64)
        self.counts = np.array(counts, np.int64)
        self.codes = np.concatenate(codes) if codes else np.empty(0, np.int32)

    def sums(self, head_values: np.ndarray, tail_values: np.ndarray) -> np.ndarray:
        """Per text: the sum of its chunks' values."""
        total = np.concatenate([[0], np.cumsum(tail_values[self.codes])]) if len(self.codes) else np.zeros(1, np.int64)
        ends = np.cumsum(self.counts)
        return head_values[self.first] + total[ends] - total[ends - self.counts]


class Words:
    """Texts cut at white space, with each distinct word numbered once; text ``i`` owns ``counts[i]`` of ``codes``."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = defaultdict(count().__next__)
        codes, counts = [], []
        for text in texts:
            words = text.split()
            counts.append(len(words))
            if words:
                codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.distinct = list(number)
        self.counts = np.array(counts, np.int64)
        self.codes = np.concatenate(codes) if codes else np.empty(0, np.int32)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text: the sum over its words of their values (one value per word, not per distinct word)."""
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return total[self.ends] - total[self.starts]

    def highest(self, values: np.ndarray, empty: float) -> np.ndarray:
        out = np.full(len(self.counts), empty)
        has = self.counts > 0
        if has.any():
            out[has] = np.maximum.reduceat(values, self.starts[has])
        return out


def bounded_sample(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each class, chosen by a hash of ``key``: the same ones on every run."""
    parts = [rows.where(F.col(label) == c).orderBy(F.xxhash64(key), key).limit(most) for c in (0, 1)]
    return parts[0].union(parts[1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of ``x`` is the constant and isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w = w + step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
