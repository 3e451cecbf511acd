"""Importance resampling towards a target corpus by hashed features.

Features are runs of 1 to ``longest`` consecutive words, each counted in the bucket of its CRC-32.  A bucket's gain is
the logarithm of the target's smoothed share over that of all documents, in whole thousandths; a document's weight is
the sum of its features' gains.  Gumbel noise drawn from a hash of the id turns "the highest scores" into a draw
without replacement.  Words are found and hashed over Arrow buffers (``automaton``); bucket counts leave a task as one
row a bucket, the gains (one whole number a bucket) are all that the driver holds, and ranks come from a range
partitioning by score, so no task sorts all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.automaton import START, WORDS, Found, advance, find, finished, pieces, step
from claimloom.llm.common import frugal, stored

#: Bytes of text whose words are hashed at once.
PIECE_BYTES = 4 << 20


def _features(found: Found, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: the text that each belongs to, and its CRC-32."""
    owner = found.owners()
    state = np.full(len(found.starts), START)
    for more in range(longest):
        if more:
            same = owner[more:] == owner[:-more] if more < len(owner) else np.zeros(0, bool)
            at = np.flatnonzero(same)
            # runs of one word less that have a further word in the same text: a space, then that word
            state = advance(step(state[at], np.uint32(0x20)), found.data, found.starts[at + more], found.lengths[at + more])
            full = np.zeros(len(owner), np.uint32)
            full[at] = state
            yield owner[at], finished(state)
            state = full
        else:
            state = advance(state, found.data, found.starts, found.lengths)
            yield owner, finished(state)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """``bucket``, ``n``: features of all ``texts``, counted whole; buckets without features have no row."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for piece in pieces(batches, 0, PIECE_BYTES):
            for _, crc in _features(find(piece.column(0), WORDS), longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.record_batch([pa.array(filled, pa.int64()), pa.array(total[filled], pa.int64())], names=["bucket", "n"])

    return texts.select(text).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Gain of every bucket in whole thousandths: bounded by ``buckets``, whatever the size of the corpora."""
    both = bucket_counts(docs, text, longest, buckets).withColumn("t", F.lit(0).cast("bigint")).select("bucket", F.col("n").alias("s"), "t").unionByName(
        bucket_counts(target, text, longest, buckets).select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t"))
    )
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for row in rows:
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    ratio = (t + 1.0) * (s.sum() + float(buckets)) / ((s + 1.0) * (t.sum() + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` of every document; no features weigh 0."""
    kind = docs.schema[id].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(gain)  # one whole number a bucket

    @frugal
    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        for piece in pieces(batches, 1, PIECE_BYTES):
            found = find(piece.column(1), WORDS)
            n, weight = np.zeros(piece.num_rows, np.int64), np.zeros(piece.num_rows, np.int64)
            for owner, crc in _features(found, longest):
                sums = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                ends = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                n += np.diff(ends)
                weight += np.diff(sums[ends])
            yield pa.record_batch(
                [piece.column(0), pa.array(np.diff(found.firsts), pa.int64()), pa.array(n), pa.array(weight)],
                names=["id", "n_words", "n_features", "weight"],
            )

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        weights, f"id {kind}, n_words bigint, n_features bigint, weight bigint"
    )


def noise(id: Column, seed: str) -> Column:
    """Gumbel noise in whole thousandths from the first 32 bits of a hash of seed and id (none: an empty one)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 10, least_words: int = 20,
    longest: int = 1, buckets: int = 10_000, seed: str = "2024",
) -> DataFrame:
    """``id``, ``n_features``, ``weight``, ``score``, ``rank`` of every document: 1, 2, ... for those drawn, null for others.

    Of the documents with at least ``least_words`` words ``percent`` in a hundred are drawn, rounded down: highest scores
    first, ties to smaller ids, rows without an id last.  Null and empty texts have no features, weigh 0 and are scored
    all the same.  Rows that repeat an id are ranked one by one (equal rows in any order).  With no target text all
    gains follow the documents alone; an empty table gives no rows.  Texts of any length are read whole; other columns
    are not read.
    """
    gain = gains(docs, target, text, longest, buckets)
    weighed = weigh(docs, gain, id, text, longest).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    key = F.when(F.col("n_words") >= least_words, F.col("score"))
    order = [F.desc_nulls_last("key"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]
    placed = stored(weighed.withColumn("key", key).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resample")
    counts = sorted(placed.where(F.col("key").isNotNull()).groupBy("part").count().collect())  # a row for each partition
    drawn = sum(n for _, n in counts) * percent // 100
    before, reach = {}, 0
    for part, n in counts:
        if reach < drawn:
            before[part] = reach
        reach += n
    last = max(before, default=-1)
    out = ["id", "n_features", "weight", "score"]
    rest = placed.where(F.col("part") > last).select(*out, F.lit(None).cast("bigint").alias("rank"))
    if not before:
        return rest
    offset = F.element_at(F.array(*(F.lit(before.get(p, 0)).cast("bigint") for p in range(last + 1))), F.col("part") + 1)
    rank = offset + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    head = placed.where(F.col("part") <= last).withColumn("rank", rank)
    taken = F.col("key").isNotNull() & (F.col("rank") <= drawn)
    return head.select(*out, F.when(taken, F.col("rank")).alias("rank")).union(rest)
