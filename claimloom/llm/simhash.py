"""SimHash near-duplicates through an inverted index of positional fingerprint bytes.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 bytes.  The eight
byte positions are cut into two halves of four; whichever 5 agree, 3 of them share a half.  So each
fingerprint is posted under the eight triples of positional bytes that stay within a half, and every pair
that has to be found meets in at least one posting list.  Pairs of a list are then tallied over all
eight positions, those with fewer than 5 shared bytes leave, and the rest is verified bit by bit.
Lists of more than ``SMALL_LIST`` fingerprints are cut into blocks whose pairs of blocks are compared as
tiles; a tile returns a spanning forest of its links, so output stays linear in the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import frugal, stored, text_segments
from claimloom.operators.components import components

SHINGLE = 3
SEED = 42
BITS = 64
MAX_DISTANCE = 3
#: Byte positions that at most MAX_DISTANCE differing bits leave equal.
MIN_SHARED_BYTES = 8 - MAX_DISTANCE
TRIPLES = [t for half in (range(0, 4), range(4, 8)) for t in combinations(half, 3)]
SMALL_LIST = 24
BLOCK = 1024
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of the ``width``-word shingles of a UTF-8 text, repeats included; no words give 0."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    joined = b" ".join(words)
    if len(words) <= width:
        starts, stops = [0], [len(joined)]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
        stops = ends[width - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _STEP], stops[at : at + _STEP])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_segments(batches):
        bits = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(bits)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of ``docs``; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(_fingerprints), f"id {kind}, fp bigint")


def forest(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Least node reachable from each of ``n`` nodes over links (rows, cols)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1)):
            a = np.asarray(left.values).view(np.uint64)
            b = np.asarray(right.values).view(np.uint64)
            x = a[:, None] ^ b[None, :]
            shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2)
            r, c = np.nonzero(shared >= MIN_SHARED_BYTES)
            ok = np.bitwise_count(x[r, c]) <= MAX_DISTANCE
            r, c = r[ok], c[ok] + len(a)
            both = np.concatenate([a, b]).view(np.int64)
            label = forest(len(both), r, c)
            moved = np.nonzero(label != np.arange(len(both)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(both[moved]), pa.array(both[label[moved]])], names=["u", "v"])


def _byte(column: str, position: int):
    return F.shiftrightunsigned(F.col(column), 8 * position).bitwiseAND(F.lit(255))


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect exactly what the threshold connects.

    Every linked pair of short posting lists is returned; of long lists a spanning forest of each tile.
    """
    posts = prints.select(
        "fp",
        F.explode(
            F.array(
                *(
                    sum((_byte("fp", p) * (1 << 8 * k) for k, p in enumerate(t)), F.lit(k0 << 24).cast("bigint"))
                    for k0, t in enumerate(TRIPLES)
                )
            )
        ).alias("key"),
    )
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posts = stored(posts.join(sizes, "key"), "simhash-postings")
    short = posts.where(F.col("n") <= SMALL_LIST)
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    tally = sum(
        (F.when(F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(8)), F.lit(0)
    )
    pairs = (
        short.alias("a")
        .join(
            short.alias("b"),
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.fp") < F.col("b.fp"))
            & (tally >= MIN_SHARED_BYTES)
            & (F.bit_count(x) <= MAX_DISTANCE),
        )
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    parts = F.ceil(F.col("n") / BLOCK)
    salt = F.pmod(F.xxhash64("fp", F.lit(7)), parts)
    blocks = (
        posts.where(F.col("n") > SMALL_LIST)
        .groupBy("key", parts.alias("parts"), salt.alias("salt"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    # each block goes to its partners, so the tiles of one list are dealt out by list and block
    sent = blocks.select("key", F.explode(F.sequence("salt", F.col("parts") - 1)).alias("salt"), F.col("fps").alias("x"))
    tiles = sent.join(blocks.select("key", "salt", F.col("fps").alias("y")), ["key", "salt"]).select("x", "y")
    return pairs.union(tiles.mapInArrow(_tiles, "u bigint, v bigint")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): every row's fingerprint and the least id reachable over links of fingerprints.

    Null and empty texts and texts of white space only have fingerprint 0, which links like any other.
    Repeated rows give repeated rows.  A row with a null id is returned; it never names a component
    unless all ids of the component are null.  Other columns of ``docs`` are ignored.  An empty table gives an
    empty table.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "simhash-prints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    comp = components(links(prints.select("fp")))
    named = prints.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("c")
    )
    names = named.groupBy("c").agg(F.min("least").alias("component"))
    of_print = stored(named.join(names, "c").select("fp", "component"), "simhash-classes")
    return rows.join(of_print, "fp").select("id", "fp", "component")
