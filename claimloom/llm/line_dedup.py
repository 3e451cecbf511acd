"""Lines that many documents share, dropped from all but one of them.

Every text is split at line feeds.  A line's key is the line without white space at both ends and with A-Z
lower-cased; it is told by 128 bits of hash, so lines that merely collide aren't to be expected at any size.  A key of
at least ``least_chars`` code points that ``least_docs`` documents or more hold loses its lines in all documents but
the one of the largest id.  Only DataFrame functions run: lines are exploded to hashes and positions, counted by
distinct documents with partial sums before the shuffle, and the positions to drop come back to the document, whose
kept lines are joined in their order.  No text of a line is shuffled; a line that a third of all documents hold is one
row of the counted side, and its many rows on the other side of the join are split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that is stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(value: Column) -> list[Column]:
    """Two hashes of 64 bits with different seeds."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def shared_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """Hashes ``h1``, ``h2`` of the keys that at least ``least_docs`` documents hold, with ``n_docs`` and ``keeper``.

    A document is its id here: rows that share an id, or have none, count once.  ``keeper`` is the largest id, null
    only where no holder has one.
    """
    held = _exploded(_read(docs, id, text), least_chars)
    found = held.groupBy("h1", "h2").agg(
        (F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("n_docs"), F.max("id").alias("keeper")
    )
    return found.where(F.col("n_docs") >= least_docs)


def _read(docs: DataFrame, id: str, text: str) -> DataFrame:
    read = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t1, t2 = _hash(F.col("text"))
    return read.select("id", "text", t1.alias("t1"), t2.alias("t2"))


def _exploded(read: DataFrame, least_chars: int) -> DataFrame:
    lines = read.select("id", "t1", "t2", F.posexplode(_lines(F.translate("text", UPPER, LOWER))).alias("pos", "line"))
    keys = lines.select("id", "t1", "t2", "pos", F.btrim("line", F.lit(SPACE)).alias("key")).where(F.char_length("key") >= least_chars)
    h1, h2 = _hash(F.col("key"))
    return keys.select("id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))


def drop_shared_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text`` (its kept lines), ``n_lines`` before dropping, ``n_dropped``.

    A null or empty text is one empty line and stays.  A line repeated inside one document only is not shared.  Rows
    that share an id are one document when holders are counted, and each keeps the lines its id may keep; rows without
    an id are one document, less than all others.  Repeated rows give repeated results, an empty table gives none, a
    text of any length is handled whole (its positions travel, not its lines), further columns of ``docs`` are not
    read.  Equal texts under one id are told by id and hash of the text, so nothing depends on row order.
    """
    read = _read(docs, id, text)
    shared = shared_lines(docs, id, text, least_docs, least_chars).select("h1", "h2", "keeper")
    lost = (
        _exploded(read, least_chars)
        .join(shared, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "t1", "t2")
        .agg(F.collect_set("pos").alias("lost"))
        .select(F.col("id").alias("lost_id"), F.col("t1").alias("lost_t1"), F.col("t2").alias("lost_t2"), "lost")
    )
    same = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("t1") == F.col("lost_t1")) & (F.col("t2") == F.col("lost_t2"))
    # split below the join: above it the split would be folded into the lambda and run for every line
    joined = read.select("id", "t1", "t2", _lines(F.col("text")).alias("lines")).join(lost, same, "left")
    # array_except keeps the order of its first list and looks up by hashing: linear in a document's lines
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    return joined.select(
        "id",
        F.array_join(F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(kept, lambda p: F.get("lines", p))), "\n").alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
