"""Optional enrichment: prose about a profile may fill empty text fields, from a cache of answers or a given client.

Off by default.  Answers never overwrite a value and never change a confidence; each fill is traced and reported.
"""

from __future__ import annotations

import importlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import company_key, content_key, strip
from claimloom.operators.link import attribute_sources

TEMPLATE = "headline-and-summaries-1"
#: What an answer must look like; other keys are ignored.
ANSWER = "struct<headline:string,experience:array<struct<company:string,summary:string>>>"
# Confidence of a filled field, characters of prose in a prompt, live calls in a run.
CONFIDENCE, CONTEXT_CHARS, LIVE_CALLS = 0.4, 8000, 1000


def has_gaps(fields: tuple[str, ...] = ("headline", "summary")) -> Column:
    """Whether a profile lacks a headline or the summary of a job, of the fields that may be filled."""
    head = F.coalesce("headline", F.lit("")) == ""
    jobs = F.exists("experience", lambda e: F.coalesce(e["summary"], F.lit("")) == "")
    return (head if "headline" in fields else F.lit(False)) | (jobs if "summary" in fields else F.lit(False))


def contexts(profiles: DataFrame, claims: DataFrame, prose: DataFrame) -> DataFrame:
    """(candidate_id, context): the prose (source, record_key, seq, text) of all sources that belong to a profile."""
    mine = attribute_sources(profiles, claims).join(prose.where("trim(text) != ''"), ["source", "record_key"])
    part = F.concat(F.lit("[source: "), F.col("source"), F.lit("]\n"), strip(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "source", "record_key", part.alias("part"))))
    joined = F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n")
    return mine.groupBy("candidate_id").agg(F.left(joined, F.lit(CONTEXT_CHARS)).alias("context"))


def cache_key(context: Column, model: str) -> Column:
    return content_key(F.lit(model), F.lit(TEMPLATE), context, F.lit(ANSWER))


def prompt(context: Column) -> Column:
    """What a client is asked: to report only what the text says, or null."""
    ask = (
        "Report facts of the text below as JSON and nothing that it does not say; use null where it is silent.\n"
        'Keys: "headline" (the person\'s title in a few words) and "experience" (a list of "company" and "summary").\n\nTEXT:\n'
    )
    return F.concat(F.lit(ask), context)


def misses(profiles: DataFrame, context: DataFrame, cache: DataFrame, model: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, candidate_id, prompt) of profiles with gaps whose answer is not in ``cache`` (key, answer)."""
    asked = profiles.where(has_gaps(fields)).select("candidate_id").join(context, "candidate_id")
    asked = asked.select("candidate_id", cache_key(F.col("context"), model).alias("key"), prompt(F.col("context")).alias("prompt"))
    asked = asked.groupBy("key").agg(F.min("candidate_id").alias("candidate_id"), F.min("prompt").alias("prompt"))  # profiles with the same prose ask once
    return asked.join(cache.select("key"), "key", "left_anti")


def complete(asked: DataFrame, client: Callable[[str], str], most: int = LIVE_CALLS) -> DataFrame:
    """(key, answer) from a client for the first ``most`` prompts by candidate; a failing call gives no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text in zip(frame["key"], frame["prompt"]):
                try:
                    out.append((key, client(text)))
                except Exception:  # noqa: BLE001, S112  the field stays empty
                    continue
            yield pd.DataFrame(out, columns=["key", "answer"])

    return asked.orderBy("candidate_id", "key").limit(most).mapInPandas(run, "key string, answer string")


def answers(context: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(candidate_id, answer) as ``ANSWER``; text that is no such JSON gives nothing."""
    keyed = context.select("candidate_id", cache_key(F.col("context"), model).alias("key"))
    read = F.from_json("answer", ANSWER, {"mode": "PERMISSIVE"})
    return keyed.join(cache.groupBy("key").agg(F.min("answer").alias("answer")), "key").select("candidate_id", read.alias("answer")).where("answer is not null")


def fill(profiles: DataFrame, given: DataFrame, model: str, fields: tuple[str, ...] = ("headline", "summary")) -> DataFrame:
    """Profiles with gaps filled; ``given`` is (candidate_id, answer).  The confidence stays as it is."""
    joined = profiles.join(given, "candidate_id", "left")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    offered = F.nullif(F.col("answer.headline"), F.lit(""))
    head = F.when(empty(F.col("headline")) & F.lit("headline" in fields), offered)
    pairs = F.filter("answer.experience", lambda a: ~empty(a["summary"]))

    def summary(job: Column) -> Column:
        same = F.filter(pairs, lambda a: company_key(a["company"]) == company_key(F.coalesce(job["company"], F.lit(""))))
        return F.when(empty(job["summary"]) & F.lit("summary" in fields), F.try_element_at(same, F.lit(-1))["summary"])

    jobs = F.transform("experience", lambda e: e.withField("summary", F.coalesce(summary(e), e["summary"])))
    trace = lambda field: F.struct(F.lit(field).alias("field"), F.lit(f"llm:{model}").alias("source"), F.lit("llm_extraction").alias("method"))
    added = F.array_compact(
        F.array(
            F.when(head.isNotNull(), trace("headline")),
            F.when(F.exists("experience", lambda e: summary(e).isNotNull()), trace("experience.summary")),
        )
    )
    return joined.select(
        *(
            F.coalesce(head, F.col("headline")).alias(c) if c == "headline"
            else jobs.alias(c) if c == "experience"
            else F.array_sort(F.array_union("provenance", added)).alias(c) if c == "provenance"
            else F.col(c)
            for c in profiles.columns
        )
    )


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer) of a cache, one row a key; one that isn't there yet is empty.

    Of several answers to a key that of the earliest run holds, answers without a run before all others: runs that go on at the
    same time, or again, never change what has been answered.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "key string, answer string")
    kept = spark.read.option("mergeSchema", "true").parquet(path)
    run = F.coalesce("run", F.lit("")) if "run" in kept.columns else F.lit("")
    return kept.where("key is not null").groupBy("key").agg(F.min(F.struct(run.alias("run"), "answer"))["answer"].alias("answer"))


def put(given: DataFrame, path: str) -> None:
    """Add answers (key, answer) to a cache as those of a run of their own."""
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    given.select("key", "answer", F.lit(run).alias("run")).write.mode("append").parquet(path)


def client_named(name: str) -> Callable[[str], str]:
    """The client ``module:function`` (prompt -> answer), which executors must be able to import."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"a client is named module:function, not {name!r}")
    return getattr(importlib.import_module(module), function)


def run(
    profiles: DataFrame, context: DataFrame, cache: str, model: str, fields: tuple[str, ...] = ("headline", "summary"),
    client: Callable[[str], str] | None = None, most: int = LIVE_CALLS,
) -> DataFrame:
    """Profiles with gaps filled from the cache at ``cache`` (Parquet); a client's answers are put there first, as they come."""
    spark = profiles.sparkSession
    if client is not None:
        put(complete(misses(profiles, context, read_cache(spark, cache), model, fields), client, most), cache)
    return fill(profiles, answers(context, read_cache(spark, cache), model), model, fields)


def report(before: DataFrame, after: DataFrame, model: str) -> DataFrame:
    """(candidate_id, field, value, confidence, source, method): what was filled."""
    b = before.select("candidate_id", F.col("headline").alias("h0"), F.col("experience").alias("e0"))
    both = after.select("candidate_id", "headline", "experience").join(b, "candidate_id")
    head = both.where("headline is distinct from h0").select("candidate_id", F.lit("headline").alias("field"), F.col("headline").alias("value"))
    jobs = both.select("candidate_id", F.explode(F.arrays_zip("experience", "e0")).alias("p"))
    jobs = jobs.where("p.experience.summary is distinct from p.e0.summary").select("candidate_id", F.lit("experience.summary").alias("field"), F.col("p.experience.summary").alias("value"))
    return head.union(jobs).select("*", F.lit(CONFIDENCE).alias("confidence"), F.lit(f"llm:{model}").alias("source"), F.lit("llm_extraction").alias("method"))
