"""Queries of the engine's operators over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom import render
from claimloom.config import FieldSpec, OutputConfig, default_config
from claimloom.functions import dates, phones, places, skills, text
from claimloom.operators import enrich, fuse, link
from claimloom.plans import file_queries, project
from claimloom.plans.tables import CLAIMS_SQL, CLUSTERS_SQL, FUSED_SQL, claims_from_tables, dealt, load
from claimloom.sources import resume
from claimloom.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _strong(claims: DataFrame) -> DataFrame:
    recs = stored(link.records(claims), "records")
    return recs.select("rid", "source", "record_key").join(link.strong_clusters(recs), "rid").drop("rid")


def _parts(spark: SparkSession, sf_dir: str) -> fuse.Parts:
    claims = stored(claims_from_tables(spark, sf_dir), "claims")
    # each branch joins its own fields' claims only
    return fuse.Parts(fuse.clustered(claims, stored(_strong(claims), "clusters")))


def _profiles(spark: SparkSession, sf_dir: str, fields: set[str] | None = None, traced: bool = True) -> DataFrame:
    claims = stored(claims_from_tables(spark, sf_dir), "claims")
    return fuse.fuse(claims, stored(_strong(claims), "clusters"), fields, traced)


@query(f"WITH {CLAIMS_SQL} SELECT source, record_key, CAST(seq AS BIGINT) AS seq, field_path, value_str, value_num, company, start, institution, end_year, CAST(conf AS INT) AS conf, method, norm FROM claims")
def claims_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims_from_tables(spark, sf_dir).select(
        "source", "record_key", "seq", "field_path", "value_str", "value_num", F.col("value_exp.company").alias("company"),
        F.col("value_exp.start").alias("start"), F.col("value_edu.institution").alias("institution"), F.col("value_edu.end_year").alias("end_year"),
        (F.col("raw_confidence") * 100).cast("int").alias("conf"), "method", F.col("normalize_method").alias("norm"),
    )


@query(f"""WITH {CLAIMS_SQL} SELECT source, record_key, coalesce(string_agg(DISTINCT value_str, ',' ORDER BY value_str) FILTER (field_path = 'candidate_id'), '') AS candidate_ids,
 coalesce(string_agg(DISTINCT value_str, ',' ORDER BY value_str) FILTER (field_path = 'emails'), '') AS emails,
 coalesce(string_agg(DISTINCT lower(value_str), ',' ORDER BY lower(value_str)) FILTER (field_path = 'full_name'), '') AS names FROM claims GROUP BY source, record_key""")
def records_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = link.records(claims_from_tables(spark, sf_dir))
    return recs.select("source", "record_key", *(F.array_join(c, ",").alias(c) for c in ("candidate_ids", "emails", "names")))


@query(r"""SELECT s_suppkey, array_to_string(list_filter(string_split_regex(regexp_replace(lower(raw), '[.,]', ' ', 'g'), '\s+'), lambda x: length(x) > 1), ' ') AS name_key
 FROM (SELECT s_suppkey, s_name || ' J. van ' || n_name || ', Jr.' AS raw FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = F.concat("s_name", F.lit(" J. van "), "n_name", F.lit(", Jr."))
    return rows.select("s_suppkey", text.name_key(raw).alias("name_key"))


@query(r"""SELECT p_partkey, coalesce(nullif(array_to_string(list_filter(string_split_regex(regexp_replace(lower(raw), '[.,]', ' ', 'g'), '\s+'),
 lambda x: x NOT IN ('', 'inc', 'corp', 'corporation', 'llc', 'ltd', 'co', 'gmbh', 'plc', 'company', 'limited')), ' '), ''), trim(regexp_replace(lower(raw), '[.,]', ' ', 'g'))) AS company_key
 FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Inc.' WHEN 1 THEN p_brand || ' Corp.' WHEN 2 THEN p_brand || ', Ltd' WHEN 3 THEN p_brand || ' GmbH Co' ELSE p_brand END AS raw FROM part)""")
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, brand = F.col("p_partkey") % 5, F.col("p_brand")
    add = lambda s: F.concat(brand, F.lit(s))
    raw = F.when(k == 0, "Inc.").when(k == 1, add(" Corp.")).when(k == 2, add(", Ltd")).when(k == 3, add(" GmbH Co")).otherwise(brand)
    return load(spark, sf_dir, "part").select("p_partkey", text.company_key(raw).alias("company_key"))


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT source, record_key, cluster FROM recs JOIN clusters USING (rid)")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strong(claims_from_tables(spark, sf_dir)).select("source", "record_key", "cluster")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that share names; every fifth has an explicit id."""
    c = load(spark, sf_dir, "customer").select("c_custkey")
    key, name = F.col("c_custkey").cast("string"), F.concat(F.lit("Pat N. Person"), (F.col("c_custkey") % 97).cast("string"), F.lit("x"), F.floor(F.col("c_custkey") / 970).cast("string"))
    claims = F.array(
        F.when(F.col("c_custkey") % 5 == 0, F.struct(F.lit("candidate_id").alias("field_path"), F.concat(F.lit("id-"), key).alias("value_str"))),
        F.struct(F.lit("full_name").alias("field_path"), name.alias("value_str")),
    )
    return c.select(F.lit("csv_recruiter").alias("source"), key.alias("record_key"), F.explode(F.array_compact(claims)).alias("c")).select("source", "record_key", "c.*")


@query("""WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS record_key, 'csv_recruiter' || chr(1) || CAST(c_custkey AS VARCHAR) AS rid,
   'person' || CAST(c_custkey % 97 AS VARCHAR) || 'x' || CAST(c_custkey // 970 AS VARCHAR) AS k, c_custkey % 5 = 0 AS has FROM customer),
 g AS (SELECT k, count(*) FILTER (has) AS ids, min(rid) AS least FROM p GROUP BY k)
 SELECT record_key, CASE WHEN ids < 2 THEN least ELSE rid END AS cluster FROM p JOIN g USING (k)""")
def name_attach_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.link(_people(spark, sf_dir)).select("record_key", "cluster")


@query("""WITH p AS (SELECT c_custkey AS k, c_custkey // 40 AS g, 'csv_recruiter' || chr(1) || CAST(c_custkey AS VARCHAR) AS rid, c_custkey % 7 = 3 OR c_mktsegment = 'MACHINERY' AS has,
   md5(CAST(c_custkey AS VARCHAR)) AS back FROM customer),
 s AS (SELECT *, sum(CAST(has AS INT)) OVER (PARTITION BY g ORDER BY k) AS seg, sum(CAST(has AS INT)) OVER (PARTITION BY g) AS ids, k = min(k) OVER (PARTITION BY g) AS first FROM p),
 e AS (SELECT *, CASE WHEN has THEN seg - 1 ELSE seg END AS gap FROM s),
 m AS (SELECT *, NOT first AND gap >= 1 AND gap < ids AND back = max(back) FILTER (NOT first) OVER (PARTITION BY g, gap) AS cut FROM e),
 c AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY g ORDER BY k) AS part FROM m)
 SELECT CAST(k AS VARCHAR) AS record_key, min(rid) OVER (PARTITION BY g, part) AS cluster FROM c""")
def name_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 40 customers, each with a name in common with the one before; between two ids the last name in order is cut."""
    c = dealt(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    k = F.col("c_custkey")
    claim = lambda field, value: F.struct(F.lit(field).alias("field_path"), value.alias("value_str"))
    has = (k % 7 == 3) | (F.col("c_mktsegment") == "MACHINERY")
    claims = F.array(
        F.when(has, claim("candidate_id", k.cast("string"))),
        F.when(k % 40 != 0, claim("full_name", F.md5(k.cast("string").cast("binary")))),
        F.when(k % 40 != 39, claim("full_name", F.md5((k + 1).cast("string").cast("binary")))),
    )
    rows = c.select(F.lit("csv_recruiter").alias("source"), k.cast("string").alias("record_key"), F.explode(F.array_compact(claims)).alias("c"))
    return link.link(rows.select("source", "record_key", "c.*")).select("record_key", "cluster")


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT cluster, string_agg(DISTINCT value_str, ',' ORDER BY value_str) AS candidate_ids FROM cl WHERE field_path = 'candidate_id' GROUP BY cluster HAVING count(DISTINCT value_str) > 1")
def over_merge_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = claims_from_tables(spark, sf_dir)
    return link.over_merged(claims, _strong(claims)).select("cluster", F.array_join("candidate_ids", ",").alias("candidate_ids"))


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT cluster, field_path, CASE field_path WHEN 'years_experience' THEN CAST(CAST(value AS DOUBLE) AS VARCHAR) ELSE value END AS value, winner, conflict FROM scalars")
def resolve_scalar_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).scalars.select("cluster", "field_path", "value", "winner", "conflict")


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT cluster, field_path, array_to_string(items, ',') AS items FROM lists")
def string_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).lists.select("cluster", "field_path", F.array_join("items", ",").alias("items"))


@query(f"""WITH RECURSIVE {FUSED_SQL} SELECT cluster, field_path AS field, units / 10000.0::DOUBLE AS confidence FROM scalars
 UNION ALL SELECT cluster, field_path, units / 10000.0::DOUBLE FROM lists""")
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    both = parts.scalars.select("cluster", "field_path", "units").union(parts.lists.select("cluster", "field_path", "units"))
    return both.select("cluster", F.col("field_path").alias("field"), (F.col("units") / 10000).alias("confidence"))


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT cluster, overall_confidence FROM overall")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).overall()


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT cluster, name, array_to_string(sources, ',') AS sources, units / 10000.0::DOUBLE AS confidence FROM skills")
def skills_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).skills.select("cluster", "name", F.array_join("sources", ",").alias("sources"), (F.col("units") / 10000).alias("confidence"))


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT cluster, company, title, start, title_winner, units / 10000.0::DOUBLE AS confidence FROM (SELECT * REPLACE (CASE WHEN conflict THEN title_winner END AS title_winner) FROM experience)")
def experience_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).experience.select("cluster", "company", "title", "start", "title_winner", (F.col("units") / 10000).alias("confidence"))


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT cluster, institution, degree, field, end_year, units / 10000.0::DOUBLE AS confidence FROM education")
def education_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).education.select("cluster", "institution", "degree", "field", "end_year", (F.col("units") / 10000).alias("confidence"))


@query(f"""WITH RECURSIVE {FUSED_SQL}, backers AS (
   SELECT c.cluster, c.field_path, c.source, c.method, c.norm FROM cl c JOIN scalars s ON s.cluster = c.cluster AND s.field_path = c.field_path
     AND coalesce(c.value_str, CAST(c.value_num AS VARCHAR)) = s.value
   UNION ALL SELECT cluster, field_path, source, method, norm FROM cl WHERE field_path IN ('emails', 'experience', 'education'))
 SELECT DISTINCT * FROM (
   SELECT cluster, field_path AS field, source, method FROM backers
   UNION ALL SELECT cluster, field_path, source, norm FROM backers WHERE norm IS NOT NULL
   UNION ALL SELECT cluster, field_path, winner, 'merge_winner' FROM scalars WHERE conflict
   UNION ALL SELECT cluster, 'experience.title', title_winner, 'merge_winner' FROM experience WHERE conflict
   UNION ALL SELECT cluster, 'skills', source, 'skill_canonicalize' FROM cl WHERE field_path = 'skills'
   UNION ALL SELECT cluster, 'candidate_id', 'merge', 'derived_id' FROM cids WHERE derived)""")
def provenance_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).provenance()


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT cluster, candidate_id, derived FROM cids")
def derived_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).candidate_ids()


_ALIAS_VALUES = ", ".join(f"('{a}', '{n}')" for a, n in sorted(skills.aliases().items()))


@query(f"""WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' ReactJS ' WHEN 1 THEN 'K8S' WHEN 2 THEN 'c#' WHEN 3 THEN 'google cloud' WHEN 4 THEN o_orderpriority ELSE 'py' END AS raw FROM orders)
 SELECT o_orderkey, name AS skill FROM raw LEFT JOIN (VALUES {_ALIAS_VALUES}) a(alias, name) ON lower(trim(raw)) = alias""")
def skill_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, " ReactJS ").when(k == 1, "K8S").when(k == 2, "c#").when(k == 3, "google cloud").when(k == 4, F.col("o_orderpriority")).otherwise("py")
    return load(spark, sf_dir, "orders").select("o_orderkey", skills.exact_skill(raw).alias("skill"))


@query()
def skill_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelled names; the likeness of common subsequences has no SQL form."""
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, "kubernets").when(k == 1, "pythonn").when(k == 2, "machne learning").when(k == 3, "apis rest").when(k == 4, F.col("p_brand")).otherwise("postgresq")
    parts = dealt(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return parts.select("p_partkey", skills.canonical_skill(raw).alias("s")).select("p_partkey", "s.*")


_SCAN_VALUES = ", ".join(f"('{a}', '{skills.aliases()[a]}')" for a in skills.prose_aliases())


@query(f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) || CASE doc_id % 3 WHEN 0 THEN ' java script and mentorship' WHEN 1 THEN ' redis, sql' ELSE '' END AS low FROM documents)
 SELECT doc_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS skills FROM t
 LEFT JOIN (VALUES {_SCAN_VALUES}) a(alias, name) ON contains(low, alias) AND regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])' || alias || '($|[^\\p{{L}}\\p{{N}}_])') GROUP BY doc_id""")
def skill_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, " java script and mentorship").when(F.col("doc_id") % 3 == 1, " redis, sql").otherwise("")
    body = F.concat(F.coalesce("text", F.lit("")), tail)
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(skills.skills_in(body), ",").alias("skills"))


@query(r"""SELECT k, id, array_to_string(list_distinct(list_transform(regexp_extract_all(coalesce(body, ''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'), lambda e: lower(e))), ',') AS emails, 0 AS n FROM (
 SELECT 'd' AS k, doc_id AS id, text AS body FROM documents UNION ALL SELECT 'p', page_id, html FROM pages)""".replace("list_distinct(list_transform", "list_sort(list_distinct(list_transform").replace("lower(e))), ',') AS emails, 0 AS n", "lower(e)))), ',') AS emails"))
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.lit("d").alias("k"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    pages = load(spark, sf_dir, "pages").select(F.lit("p"), "page_id", "html")
    return docs.union(pages).select("k", "id", F.array_join(F.array_sort(text.emails_in(F.col("body"))), ",").alias("emails"))


@query()
def extract_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid numbers of documents; the candidate pattern needs look-around, which DuckDB's expressions lack."""
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(phones.phones_in(F.col("text")), ",").alias("phones"))


@query(r"""SELECT o_orderkey, CASE WHEN regexp_full_match(d, '[2-9][0-9]{9}') AND d[2] != '9' AND d[2:3] != '11' AND d[4] NOT IN ('0', '1') AND d[5:6] != '11' THEN '+1' || d END AS phone
 FROM (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919 + 2015550100) % 10000000000 AS VARCHAR), 10, '0') AS d FROM orders)""")
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.lpad(((F.col("o_orderkey") * 7919 + 2015550100) % 10000000000).cast("string"), 10, "0")
    raw = F.concat(F.lit(" ("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))
    return load(spark, sf_dir, "orders").select("o_orderkey", phones.normalize_phone(raw).alias("phone"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN strftime(o_orderdate, '%Y') || '-01' WHEN 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders""")
def year_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, fmt = F.col("o_orderkey") % 6, lambda f: F.date_format("o_orderdate", f)
    raw = F.when(k == 0, fmt("MMM yyyy")).when(k == 1, fmt("MMMM yyyy")).when(k == 2, fmt("MM/yyyy")).when(k == 3, fmt("yyyy-MM")).when(k == 4, fmt("yyyy")).otherwise("Q1 soon")
    return load(spark, sf_dir, "orders").select("o_orderkey", dates.year_month(raw).alias("month"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN strftime(o_orderdate, '%Y') || '-01' ELSE strftime(o_orderdate, '%Y-%m') END AS start,
 CASE o_orderkey % 4 WHEN 1 THEN CAST(year(o_orderdate) + 2 AS VARCHAR) || '-01' WHEN 2 THEN CAST(year(o_orderdate) + 1 AS VARCHAR) || '-12' END AS "end" FROM orders""")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, year = F.col("o_orderkey") % 4, F.year("o_orderdate")
    fmt = lambda f: F.date_format("o_orderdate", f)
    raw = (
        F.when(k == 0, F.concat(fmt("MMM yyyy"), F.lit(" – Present")))
        .when(k == 1, F.concat(year.cast("string"), F.lit("-"), (year + 2).cast("string")))
        .when(k == 2, F.concat(fmt("MM/yyyy"), F.lit(" to Dec "), (year + 1).cast("string")))
        .otherwise(fmt("yyyy-MM"))
    )
    return load(spark, sf_dir, "orders").select("o_orderkey", dates.date_range(raw).alias("r")).select("o_orderkey", "r.start", "r.end")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN n_name WHEN c_custkey % 5 = 4 THEN 'Remote' END AS city, CASE c_custkey % 5 WHEN 0 THEN 'CA' WHEN 1 THEN 'CA' END AS region,
 CASE c_custkey % 5 WHEN 0 THEN 'US' WHEN 2 THEN 'GB' WHEN 3 THEN 'DE' END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def location_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, n = F.col("c_custkey") % 5, F.col("n_name")
    raw = F.when(k == 0, F.concat(n, F.lit(", CA, U.S.A."))).when(k == 1, F.concat(n, F.lit(", CA."))).when(k == 2, F.concat(n, F.lit(", England"))).when(k == 3, "DEU").otherwise("Remote")
    return rows.select("c_custkey", raw.alias("raw")).select("c_custkey", places.split_location(F.col("raw")).alias("l")).select("c_custkey", "l.*")


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'FR' WHEN 3 THEN 'KR' WHEN 4 THEN 'JP' END AS country FROM supplier""")
def country_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 6
    raw = F.when(k == 0, "U.S.A.").when(k == 1, " uk ").when(k == 2, "fra").when(k == 3, "Seoul, South Korea").when(k == 4, "Japan").otherwise(F.col("s_name"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw")).select("s_suppkey", places.normalize_country(F.col("raw")).alias("country"))


@query("""WITH l AS (SELECT doc_id, k, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents)),
 h AS (SELECT *, CASE WHEN length(trim(line)) <= 30 AND (k % 7 = 3) THEN 'section' || CAST(k // 7 AS VARCHAR) END AS opened FROM l)
 SELECT doc_id, CAST(k AS INT) AS pos, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k), 'header') AS section FROM h""")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    opened = F.when((F.length(F.trim("line")) <= 30) & (F.col("pos") % 7 == 3), F.concat(F.lit("section"), F.floor(F.col("pos") / 7).cast("string")))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.select("doc_id", "pos", F.coalesce(F.last(opened, ignorenulls=True).over(w), F.lit("header")).alias("section"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN coalesce(CASE WHEN r1 != 'user' THEN substr(t1, 1, 20) END, CASE WHEN r2 != 'user' THEN substr(t2, 1, 20) END) END AS answer FROM (
 SELECT conv_id, turn, role, lead(role, 1) OVER w AS r1, lead(text, 1) OVER w AS t1, lead(role, 2) OVER w AS r2, lead(text, 2) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))""")
def lookahead_next_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-ahead of a following line within two, as the schools of a résumé need it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ahead = [F.when(F.lead("role", n).over(w) != "user", F.substring(F.lead("text", n).over(w), 1, 20)) for n in (1, 2)]
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.coalesce(*ahead)).alias("answer"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN coalesce(CASE WHEN r1 != 'user' THEN t1 END, CASE WHEN r2 != 'user' THEN t2 END) END AS answer FROM (
 SELECT conv_id, turn, role, lead(role, 1) OVER w AS r1, lead(text, 1) OVER w AS t1, lead(role, 2) OVER w AS r2, lead(text, 2) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))""")
def lookahead_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``lookahead_next_lines``, with the whole text that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ahead = [F.when(F.lead("role", n).over(w) != "user", F.lead("text", n).over(w)) for n in (1, 2)]
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.coalesce(*ahead)).alias("answer"))


def _resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): whole documents under headings, one of them repeated, with a school whose name stands in the text."""
    whole = F.coalesce("text", F.lit(""))
    entry = F.concat(F.lit("B.S. in "), F.coalesce("lang", F.lit("x")), F.lit(", 2014 - 2018"))
    parts = [whole, F.lit("Education:"), entry, F.lit("GPA 3.9"), whole, F.lit(" SUMMARY "), whole, F.lit("education"), entry, whole]
    return dealt(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id").select("doc_id", F.concat_ws("\n", *parts).alias("text"))


def _unrolled(rows: DataFrame, key: str, items: Column) -> DataFrame:
    """(key, pos, *fields) of each of the structs in ``items``.

    Of an outer explosion Spark infers no filter on the array's size, which it would push below and work out again, unfolded, for every row.
    """
    each = rows.select(key, items.alias("items")).select(key, F.posexplode_outer("items").alias("pos", "item"))
    return each.where("pos is not null").select(key, "pos", "item.*")


_HEADING_VALUES = ", ".join(f"('{h}', '{s}')" for h, s in resume.HEADINGS.items())


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS w, 'B.S. in ' || coalesce(lang, 'x') || ', 2014 - 2018' AS e FROM documents),
 b AS (SELECT doc_id, regexp_replace(concat_ws(chr(10), w, 'Education:', e, 'GPA 3.9', w, ' SUMMARY ', w, 'education', e, w), '\\n\\z', '') AS body FROM t),
 l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS k FROM b),
 s AS (SELECT doc_id, k, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
 h AS (SELECT doc_id, k, line, section AS opened FROM s LEFT JOIN (VALUES {_HEADING_VALUES}) v(heading, section) ON heading = trim(rtrim(lower(line), ':'))),
 o AS (SELECT *, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k), 'header') AS section FROM h),
 every AS (SELECT doc_id, section FROM o UNION SELECT doc_id, 'header' FROM t)
 SELECT doc_id, every.section, CAST(count(k) FILTER (opened IS NULL) AS INT) AS n_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (opened IS NULL), '')) AS lines_sha256
 FROM every LEFT JOIN o USING (doc_id, section) GROUP BY doc_id, every.section""")
def resume_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each section by the résumé reader, as count and digest; every document has a header, if an empty one."""
    cut = _resumes(spark, sf_dir).select("doc_id", resume.spans(resume.lines_of(F.col("text"))).alias("spans"))
    of = lambda spans, name: F.flatten(F.transform(F.filter(spans, lambda s: s["section"] == name), lambda s: s["lines"]))
    told = lambda name, lines: F.struct(name.alias("section"), F.size(lines).alias("n_lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("lines_sha256"))
    each = text.once(F.col("spans"), lambda spans: F.transform(F.array_distinct(spans["section"]), lambda name: text.once(of(spans, name), lambda lines: told(name, lines))))
    return _unrolled(cut.select("doc_id", each.alias("each")), "doc_id", F.col("each")).drop("pos")


@query()
def resume_schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools by the résumé reader, which looks ahead for the institution."""
    found = resume.take_apart(_resumes(spark, sf_dir))
    return _unrolled(found, "doc_id", F.col("found.schools"))


def _curricula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, found): a résumé of every customer, taken apart."""
    customers = dealt(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    rows = customers.join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key, segment = F.col("c_custkey").cast("string"), F.lower("c_mktsegment")
    year = lambda start, of: (F.col("c_custkey") % of + start).cast("string")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    lines = [
        text("Pat ", F.initcap(segment), " | Data Lead"),
        text("u", key, "@example.com github.com/user", key, "/ https://www.linkedin.com/in/p", key, "/ https://", segment, ".example.org/", key, ". https://more.example.net/", key),
        F.lit("EXPERIENCE"),
        text("Engineer, ", segment, " Corp (Jan 2019 - Present)"),
        text(F.col("n_name"), " Analyst at Firm ", key, "  2011 to 2014"),
        F.lit("- a bullet 2010 - 2011"),
        F.lit(" Education: "),
        text("B.S. in ", segment, ", ", F.col("n_name"), " College, ", year(1990, 30)),
        text("MBA in ", F.col("n_name"), " 1999 - ", year(2000, 20)),
        F.lit("GPA 3.5"),
        text(F.col("n_name"), " School, Town"),
        text("Class XII ", year(1980, 10)),
        F.lit("Diploma 1979"),
        F.lit("Technical Skills"),
        text("Tools & more: ", segment, ", k8s / c++ (3 years)"),
        text("- ", F.col("n_name"), "; Python."),
    ]
    return resume.take_apart(rows.select("c_custkey", F.concat_ws("\n", *lines).alias("text"))).select("c_custkey", "found")


@query("SELECT c_custkey, 'Pat ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS name FROM customer")
def resume_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curricula(spark, sf_dir).select("c_custkey", F.col("found.name").alias("name"))


@query("""SELECT c_custkey, unnest(['links.github', 'links.linkedin', 'links.portfolio', 'links.other']) AS field,
 unnest(['https://github.com/user' || c_custkey, 'https://linkedin.com/in/p' || c_custkey, 'https://' || lower(c_mktsegment) || '.example.org/' || c_custkey, 'https://more.example.net/' || c_custkey]) AS url FROM customer""")
def resume_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unrolled(_curricula(spark, sf_dir), "c_custkey", F.col("found.links")).drop("pos")


@query("""SELECT c_custkey, 0 AS pos, 'Engineer' AS title, lower(c_mktsegment) || ' Corp' AS company, 'Jan 2019 - Present' AS dates FROM customer
 UNION ALL SELECT c_custkey, 1, n_name || ' Analyst', 'Firm ' || c_custkey, '2011 to 2014' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def resume_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unrolled(_curricula(spark, sf_dir), "c_custkey", F.col("found.jobs"))


@query("""WITH c AS (SELECT c_custkey, lower(c_mktsegment) AS s, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT c_custkey, 0 AS pos, n || ' College' AS institution, 'B.S.' AS degree, s AS field, CAST(1990 + c_custkey % 30 AS INT) AS end_year FROM c
 UNION ALL SELECT c_custkey, 1, n || ' School', 'MBA', n, CAST(2000 + c_custkey % 20 AS INT) FROM c
 UNION ALL SELECT c_custkey, 2, NULL, 'Class XII', NULL, CAST(1980 + c_custkey % 10 AS INT) FROM c
 UNION ALL SELECT c_custkey, 3, NULL, 'Diploma', NULL, 1979 FROM c""")
def resume_education(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unrolled(_curricula(spark, sf_dir), "c_custkey", F.col("found.schools"))


@query("""SELECT c_custkey, concat_ws(',', lower(c_mktsegment), 'k8s', 'c++', n_name, 'Python') AS skills FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def resume_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curricula(spark, sf_dir).select("c_custkey", F.array_join("found.skills", ",").alias("skills"))


@query("""SELECT min('csv_recruiter' || chr(1) || CAST(c_custkey AS VARCHAR)) AS cluster, string_agg('id-' || CAST(c_custkey AS VARCHAR), ',' ORDER BY 'id-' || CAST(c_custkey AS VARCHAR)) AS candidate_ids
 FROM customer GROUP BY c_custkey // 3 HAVING count(*) > 1""")
def over_merge_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with ids of their own of whom three share an address."""
    key = F.col("c_custkey").cast("string")
    mail = F.concat(F.lit("m"), F.floor(F.col("c_custkey") / 3).cast("string"), F.lit("@example.com"))
    said = F.array(
        F.struct(F.lit("candidate_id").alias("field_path"), F.concat(F.lit("id-"), key).alias("value_str")),
        F.struct(F.lit("emails").alias("field_path"), mail.alias("value_str")),
    )
    claims = load(spark, sf_dir, "customer").select(F.lit("csv_recruiter").alias("source"), key.alias("record_key"), F.explode(said).alias("c")).select("source", "record_key", "c.*")
    return link.over_merged(claims, _strong(claims)).select("cluster", F.array_join("candidate_ids", ",").alias("candidate_ids"))


_SCALAR = lambda f: f"(SELECT value FROM scalars s WHERE s.cluster = c.cluster AND s.field_path = '{f}')"


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT candidate_id AS id, {_SCALAR('full_name')} AS name, {_SCALAR('location.region')} AS area, overall_confidence FROM cids c JOIN overall USING (cluster)")
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = OutputConfig((FieldSpec("id", "candidate_id", "string", True), FieldSpec("name", "full_name"), FieldSpec("area", "location.region", "string")), include_confidence=True)
    return project.project(_profiles(spark, sf_dir, project.roots(config), config.include_provenance), config)


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT candidate_id, items[1] AS first_email, items[3] AS third_email FROM cids c LEFT JOIN lists l ON l.cluster = c.cluster")
def project_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = OutputConfig((FieldSpec("candidate_id"), FieldSpec("first_email", "emails[0]", "string"), FieldSpec("third_email", "emails[2]", "string")))
    return project.project(_profiles(spark, sf_dir, project.roots(config)), config)


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT candidate_id, coalesce((SELECT string_agg(upper(name), ',' ORDER BY name) FROM skills s WHERE s.cluster = c.cluster), '') AS skills FROM cids c")
def project_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = OutputConfig((FieldSpec("candidate_id"), FieldSpec("skills", "skills[].name", "string[]", normalize="upper")))
    return project.project(_profiles(spark, sf_dir, project.roots(config)), config).withColumn("skills", F.array_join("skills", ","))


@query(f"""WITH RECURSIVE {FUSED_SQL} SELECT candidate_id, '{{"candidate_id":"' || candidate_id || '"' || coalesce(',"region":"' || {_SCALAR('location.region')} || '"', '') || ',"headline":null}}' AS json FROM cids c""")
def project_on_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = OutputConfig((FieldSpec("candidate_id"), FieldSpec("region", "location.region", on_missing="omit"), FieldSpec("headline")))
    return project.to_json(_profiles(spark, sf_dir, project.roots(config)), config)


@query(f"""WITH RECURSIVE {FUSED_SQL} SELECT candidate_id, CASE WHEN {_SCALAR('full_name')} IS NULL THEN 'required field ''full_name'' is missing or null' ELSE '' END
 || CASE WHEN {_SCALAR('years_experience')} IS NOT NULL THEN CASE WHEN {_SCALAR('full_name')} IS NULL THEN '|' ELSE '' END || 'field ''years'' expected type ''string'' but got ''number''' ELSE '' END AS errors FROM cids c""")
def project_type_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = OutputConfig((FieldSpec("candidate_id"), FieldSpec("full_name", required=True), FieldSpec("years", "years_experience", "string")))
    rows = project.project(_profiles(spark, sf_dir, project.roots(config)), config, "permissive")
    return rows.select("candidate_id", F.array_join("_errors", "|").alias("errors"))


@query(f"""WITH RECURSIVE {FUSED_SQL}, mine AS (
   SELECT candidate_id, unnest(items) AS id FROM cids JOIN lists USING (cluster) UNION SELECT candidate_id, candidate_id FROM cids
   UNION SELECT candidate_id, lower(value) FROM cids JOIN scalars USING (cluster) WHERE field_path = 'full_name'),
 theirs AS (SELECT DISTINCT source, record_key, CASE WHEN field_path = 'full_name' THEN lower(value_str) ELSE value_str END AS id FROM claims WHERE field_path IN ('emails', 'phones', 'candidate_id', 'full_name'))
 SELECT DISTINCT candidate_id, source, record_key FROM theirs JOIN mine USING (id)""")
def identifier_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.attribute_sources(_profiles(spark, sf_dir, {"candidate_id", "emails", "phones", "full_name"}), claims_from_tables(spark, sf_dir))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS candidate_id, CASE WHEN c_custkey % 4 = 0 THEN 'Set' WHEN c_custkey % 2 = 0 THEN 'Works on ' || c_mktsegment END AS headline,
 CASE WHEN c_custkey % 2 = 0 THEN 'Did ' || lower(c_mktsegment) END AS summary, sha256('m' || chr(0) || 'headline-and-summaries-1' || chr(0) || '[source: notes]' || chr(10) || c_name || chr(0)
 || 'struct<headline:string,experience:array<struct<company:string,summary:string>>>' || chr(0)) AS key FROM customer""")
def gap_fill_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    rows = load(spark, sf_dir, "customer").withColumn("context", F.concat(F.lit("[source: notes]\n"), F.col("c_name")))
    rows = rows.withColumn("key", enrich.cache_key(F.col("context"), "m")).withColumn("candidate_id", key)
    cache = rows.where("c_custkey % 2 = 0").select(
        "key",
        F.concat(
            F.lit('{"headline":"Works on '), "c_mktsegment", F.lit('","experience":[{"company":"Acme, Inc.","summary":"Did '), F.lower("c_mktsegment"), F.lit('"}],"more":1}')
        ).alias("answer"),
    )
    job = F.struct(F.lit("ACME").alias("company"), *(F.lit(None).cast("string").alias(n) for n in ("title", "start", "end", "summary")))
    trace = F.array().cast("array<struct<field:string,source:string,method:string>>")
    profiles = rows.select("candidate_id", "key", F.when(F.col("c_custkey") % 4 == 0, "Set").alias("headline"), F.array(job).alias("experience"), trace.alias("provenance"))
    filled = enrich.fill(profiles, enrich.answers(rows.select("candidate_id", "context"), cache, "m"), "m")
    return filled.select("candidate_id", "headline", F.col("experience")[0]["summary"].alias("summary"), "key")


@query(f"""WITH RECURSIVE {FUSED_SQL} SELECT cluster, candidate_id, {_SCALAR('full_name')} AS full_name, coalesce(array_to_string(l.items, ','), '') AS emails, {_SCALAR('location.region')} AS region,
 CAST({_SCALAR('years_experience')} AS DOUBLE) AS years_experience, CAST((SELECT count(*) FROM skills s WHERE s.cluster = c.cluster) AS INT) AS n_skills,
 (SELECT max(start) FROM experience e WHERE e.cluster = c.cluster) AS latest, CAST((SELECT count(*) FROM education e WHERE e.cluster = c.cluster) AS INT) AS n_schools, coalesce(overall_confidence, 0) AS overall_confidence
 FROM cids c LEFT JOIN lists l USING (cluster) LEFT JOIN overall USING (cluster)""")
def profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: claims, links, fusion, profile."""
    return _profiles(spark, sf_dir, traced=False).select(
        "cluster", "candidate_id", "full_name", F.array_join("emails", ",").alias("emails"), F.col("location.region").alias("region"), "years_experience",
        F.size("skills").alias("n_skills"), F.get(F.col("experience.start"), F.lit(0)).alias("latest"), F.size("education").alias("n_schools"), "overall_confidence",
    )


@query()
def render_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as lines of JSON with sorted keys; the order of keys in nested text has no SQL form."""
    return render.ndjson(_profiles(spark, sf_dir), default_config())


for _f, _sql in (
    (file_queries.listed_files, file_queries.LISTED_FILES), (file_queries.table_claims, file_queries.TABLE_CLAIMS),
    (file_queries.ats_claims, file_queries.ATS_CLAIMS), (file_queries.routed_kinds, file_queries.ROUTED_KINDS), (file_queries.free_dates, file_queries.FREE_DATES),
    (file_queries.skill_near_misses, file_queries.SKILL_NEAR_MISSES), (file_queries.phone_plans, file_queries.PHONE_PLANS),
):
    query(_sql)(_f)
