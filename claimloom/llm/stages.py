"""Pipeline stages: each takes and returns rows of documents, keeping all their columns whatever their names.

A stage's decision hangs on the text alone, so rows are known by their text's digest: repeated rows and rows that share an id or
have none are judged each by its own text.  A null text is no text: not toxic, not contaminated, without personal data, and a copy of
other empty texts.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm import byte_bpe, decontaminate, pii, simhash, toxicity
from claimloom.llm.common import frugal, load, slices, train_row, unused

TOXIC = 0.5


def _others(docs: DataFrame) -> Column:
    """A hash of all columns but the text."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return F.xxhash64(*others) if others else F.lit(0).cast("bigint")


def _key(docs: DataFrame) -> Column:
    """A text's digest; rows without a text are spread over keys that are no digests."""
    return F.coalesce(F.sha2("text", 256), F.xxhash64("doc_id", _others(docs)).cast("string"))


def _calm(held, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part, raw in slices(batches, column, toxicity.SEGMENT):
            texts = [t.decode("utf-8", "replace") if t else "" for t in raw]
            yield part.filter(pa.array(model.scores(texts) < TOXIC))

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go; it learns from the labelled documents that are still here."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels").where(train_row()))
    held = spark.sparkContext.broadcast(model)
    return docs.mapInArrow(frugal(_calm(held, docs.columns.index("text"))), docs.schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near copies stays: the one with the least doc_id, then the least digest of its text.

    Rows without a doc_id come last in that order.  Rows of one doc_id with texts that are no near copies all stay.
    """
    key, rest = unused(docs.columns, "key"), unused(docs.columns, "rest")
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))
    keyed = docs.withColumn(key, digest).withColumn(rest, _others(docs))
    found = simhash.near_duplicates(docs.select(digest.alias("key"), "text"), "key")
    groups = found.select(F.col("id").alias(key), F.col("component").alias("component")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col(key).alias("key"), F.col(rest).alias("rest"))
    least = keyed.groupBy(key).agg(F.min(order).alias("best")).join(groups, key).groupBy("component").agg(F.min("best").alias("best"))
    best = least.select("best.*")
    same = (keyed[key] == best["key"]) & keyed["doc_id"].eqNullSafe(best["id"]) & (keyed[rest] == best["rest"])
    return keyed.join(best, same, "left_semi").dropDuplicates([key]).drop(key, rest)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    key = unused(docs.columns, "key")
    keyed = docs.select(F.sha2("text", 256).alias("key"), "text").where("text is not null")
    found = decontaminate.contamination(keyed, load(spark, sf_dir, "benchmark"), id_col="key")
    bad = found.where("n_hit > 0").select(F.col("id").alias(key)).distinct()
    return docs.withColumn(key, _key(docs)).join(bad, key, "left_anti").drop(key)


@F.pandas_udf(T.StringType())
def _redacted(text: pd.Series, kinds: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    return pd.Series(
        [
            t if t is None or k is None or not len(k) else pii.redact_text(t, list(zip(k, map(int, a), map(int, b))))
            for t, k, a, b in zip(text, kinds, starts, stops)
        ],
        dtype=object,
    )


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; ``n_chars`` follows the text."""
    key, own = unused(docs.columns, "key"), unused(docs.columns, "spans")
    found = pii.detect(docs.select(F.sha2("text", 256).alias("key"), "text").where("text is not null"), id_col="key")
    spans = found.where("size(spans) > 0").groupBy("id").agg(F.first("spans").alias(own)).withColumnRenamed("id", key)
    joined = docs.withColumn(key, _key(docs)).join(spans, key, "left")
    has = F.col(own).isNotNull()
    text = F.when(has, _redacted("text", *(F.col(own)[part] for part in ("kind", "start", "stop")))).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and ``n_tokens`` and ``ids`` (in the place of columns of these names): ``text`` is what the ids decode to.

    A null text counts as empty.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_tokens", "ids")]
    row = F.struct(F.struct(*kept).alias("row"), F.lit(True).alias("there")).alias("row")
    found = byte_bpe.encode(docs.select(row, "text"), path, public_tokenizers.PATTERN, id_col="row", memo_words=0)
    columns = [F.col("decoded").cast("string").alias(c) if c == "text" else F.col("id")["row"][c].alias(c) for c in docs.columns if c not in ("n_tokens", "ids")]
    return found.select(*columns, "n_tokens", "ids")
