"""What queries do with rows of a large file: tasks, plans and ranges that do not grow faster than their input."""

import pytest
from pyspark.sql import functions as F

from claimloom.config import FieldSpec, OutputConfig
from claimloom.functions import text
from claimloom.operators import assemble, fuse
from claimloom.plans import file_queries, project, queries
from claimloom.schema import CLAIMS


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables of one row group each."""
    folder = str(tmp_path_factory.mktemp("tables"))
    keys = spark.range(1, 201).coalesce(1)
    made = {
        "customer": keys.select(F.col("id").alias("c_custkey"), F.format_string("Customer %d", "id").alias("c_name"), (F.col("id") % 3).cast("int").alias("c_nationkey"), F.lit("MACHINERY").alias("c_mktsegment")),
        "nation": spark.range(3).coalesce(1).select(F.col("id").cast("int").alias("n_nationkey"), F.format_string("N%d", "id").alias("n_name")),
        "part": keys.select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("TIN").alias("p_type")),
        "documents": keys.select(F.col("id").alias("doc_id"), F.lit("one\ntwo").alias("text"), F.lit("en").alias("lang")),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["resume_name", "resume_links", "resume_jobs", "resume_education", "resume_skills", "resume_schools", "resume_sections", "skill_fuzzy", "skill_near_misses"])
def test_rows_of_one_row_group_are_dealt_out_and_worked_on_once(spark, tables, name):
    found = queries.QUERIES[name](spark, tables)
    assert found.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # lines are split by one expression with two patterns; a filter inferred from an explosion would hold it again
    assert plan.count(r"\r\n|[\n\x0B") <= 2


def test_ranges_are_those_of_whole_files(spark):
    lines = [(f, k, "é" * (k % 7) + f"{f}:{k}" * (k % 3)) for f in (1, 2) for k in range(0, 9000, 90)] + [(3, 5, "x" * 50), (4, 5, "")]
    got = file_queries._ranges(spark.createDataFrame(lines, "f int, k bigint, line string"), "f", "k", "Kopf é\r\n", "\r\n\n", 7).collect()
    want = {}
    for f in (1, 2, 3, 4):
        whole = ("Kopf é\r\n" + "\r\n\n".join(line for g, _, line in lines if g == f)).encode()
        want |= {(f, n): whole[7 * n : 7 * n + 7] for n in range(-(-len(whole) // 7))}
    assert {(r["f"], r["part"]): bytes(r["content"]) for r in got} == want and len(got) == len(want)


def test_claims_that_a_projection_does_not_read_are_not_fused(spark):
    job = ("Acme", "Clerk", "2020-01", None, None)
    rows = [("csv_recruiter", "a", k, "experience", None, None, (f"Acme{k}", *job[1:]), None, None, "m", None) for k in range(50)]
    rows += [("csv_recruiter", r, 90, f, v, None, None, None, None, "m", None) for r, f, v in (("a", "emails", "x@y.z"), ("b", "location.region", "R"), ("c", None, "v"), ("c", "skills", "go"))]
    claims = spark.createDataFrame(rows, CLAIMS).withColumn("raw_confidence", F.lit("0.90").cast("decimal(3,2)"))
    config = OutputConfig((FieldSpec("candidate_id"), FieldSpec("mail", "emails[0]"), FieldSpec("region", "location.region")))
    assert project.roots(config) == {"candidate_id", "emails", "location"}
    assert project.roots(OutputConfig(config.fields, include_confidence=True)) is None
    assert project.roots(OutputConfig((FieldSpec("t", "provenance"),))) is None
    kept = fuse.asked(claims, project.roots(config))
    assert kept.schema == claims.schema and kept.where("value_exp is not null").isEmpty() and kept.count() == 4
    clusters = claims.select("source", "record_key").distinct().withColumn("cluster", F.col("record_key"))
    of = lambda fields: sorted(map(tuple, project.project(fuse.fuse(claims, clusters, fields), config).collect()), key=str)
    assert of(project.roots(config)) == of(None) and len(of(None)) == 3


def _odd_claims(spark):
    """Claims of two clusters: ties between values, a value backed by a less trusted source that sorts first, empty and missing parts."""
    job = lambda company, title, start=None: (company, title, start, None, None)
    said = [
        ("resume", "r", "headline", "late", None, None), ("resume", "s", "headline", "by notes too", None, None), ("notes", "n", "headline", "by notes too", None, None),
        ("resume", "r", "experience", None, job("Acme, Inc.", "T1"), None), ("resume", "s", "experience", None, job("ACME", "T0", "2020-01"), None),
        ("notes", "n", "experience", None, job("acme", "", "2019-01"), None), ("resume", "r", "experience", None, job(None, "T9"), None),
        ("resume", "r", "education", None, None, (None, "B.S.", None, None)), ("resume", "r", "emails", "", None, None), ("resume", "s", "emails", "b@c.de", None, None),
        ("resume", "r", "skills", "go", None, None), ("notes", "n", "skills", "go", None, None), ("notes", "m", None, "v", None, None),
    ]
    rows = [(s, r, k, f, v, None, e, d, None, f"by-{s}", "norm" if f == "skills" else None) for k, (s, r, f, v, e, d) in enumerate(said)]
    claims = spark.createDataFrame(rows, CLAIMS).withColumn("raw_confidence", F.lit("0.80").cast("decimal(3,2)"))
    return fuse.clustered(claims, claims.select("source", "record_key").distinct().withColumn("cluster", F.when(F.col("record_key") == "m", "two").otherwise("one")))


def test_values_of_a_cluster_are_not_collected_before_its_profile(spark):
    parts = fuse.Parts(_odd_claims(spark))
    for rows in (parts.overall(), parts.experience, parts.education, parts.scalars, parts.provenance()):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_" not in plan and plan.count("RepartitionByExpression") <= 2
    # the sources of a value over rows in order, and the lists of a profile
    untraced = assemble.profiles(_odd_claims(spark), False)._jdf.queryExecution().optimizedPlan().toString()
    assert untraced.count("collect_list") == 2 and "collect_set" not in untraced and untraced.count("RepartitionByExpression") == 1


def test_odd_claims_fuse_as_before(spark):
    parts = fuse.Parts(_odd_claims(spark))
    assert [tuple(r) for r in parts.scalars.select("value", "winner", "conflict", "units").collect()] == [("by notes too", "resume", True, 3150)]
    jobs = sorted((tuple(r) for r in parts.experience.drop("cluster").collect()), key=str)
    assert jobs == [("Acme, Inc.", "T1", "2020-01", None, 3150, "resume"), (None, "T9", None, None, 4000, None)]
    assert [tuple(r) for r in parts.education.drop("cluster").collect()] == [(None, "B.S.", None, None, 4000)]
    assert [tuple(r) for r in parts.skills.drop("cluster").collect()] == [("go", ["notes", "resume"], 4500)]
    want = {("headline", "resume", "by-resume"), ("headline", "notes", "by-notes"), ("headline", "resume", "merge_winner"), ("education", "resume", "by-resume")}
    want |= {("experience", s, f"by-{s}") for s in ("resume", "notes")} | {("experience.title", "resume", "merge_winner"), ("emails", "resume", "by-resume")}
    want |= {("skills", s, "skill_canonicalize") for s in ("resume", "notes")}
    traced = parts.provenance().collect()
    derived = ("candidate_id", "merge", "derived_id")
    assert {tuple(r)[1:] for r in traced if r["cluster"] == "one"} == want | {derived} and len(traced) == len(want) + 2
    whole = {r["cluster"]: r for r in assemble.profiles(_odd_claims(spark)).collect()}
    assert {tuple(t) for t in whole["one"]["provenance"]} == want | {derived} and [tuple(t) for t in whole["two"]["provenance"]] == [derived]
    assert whole["one"]["emails"] == ["", "b@c.de"] and whole["two"]["emails"] == [] and whole["two"]["candidate_id"] == "m"
    assert [tuple(r) for r in parts.overall().collect()] == [("one", whole["one"]["overall_confidence"])] and whole["two"]["overall_confidence"] == 0


def test_plain_company_names_have_the_key_of_their_tokens(spark):
    names = ["Acme", "Acme, Inc.", "inc", "Co Co", "A  B", " a", "a ", "a\tb", "x\n", "Income Co-op", "Ltd Acme", "Acme LTD", "ÉCOLE co", "a b", "", ".", "4-NOT SPECIFIED", "A-B/C", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    slow = F.coalesce(F.nullif(F.array_join(F.filter(text._tokens(F.col("n")), lambda t: (t != "") & ~t.isin(*text.LEGAL_FORMS)), " "), F.lit("")), text.strip(F.regexp_replace(F.lower("n"), "[.,]", " ")))
    assert all(r[0] == r[1] for r in rows.select(text.company_key(F.col("n")), slow).collect())
