"""Claims from the driver's star-schema tables, for queries over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.schema import EDUCATION, EXPERIENCE


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Tasks a core that rows with much work each are dealt out to.
TASKS_A_CORE = 4


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key: a small file is one range or row group, so one task would do all the work on its rows."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * TASKS_A_CORE, key)


def _claim(path: str, conf: str, seq, value: Column | None = None, num: Column | None = None, exp: Column | None = None, edu: Column | None = None, norm: str | None = None) -> Column:
    empty = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        (seq if isinstance(seq, Column) else F.lit(seq)).cast("bigint").alias("seq"),
        F.lit(path).alias("field_path"),
        (value if value is not None else empty("string")).alias("value_str"),
        (num if num is not None else empty("double")).alias("value_num"),
        (exp if exp is not None else empty(EXPERIENCE)).alias("value_exp"),
        (edu if edu is not None else empty(EDUCATION)).alias("value_edu"),
        F.lit(conf).cast("decimal(3,2)").alias("raw_confidence"),
        empty("string").alias("normalize_method") if norm is None else F.lit(norm).alias("normalize_method"),
    )


def _rows(df: DataFrame, source: str, key: Column, method: str, *claims: Column) -> DataFrame:
    out = df.select(F.lit(source).alias("source"), key.cast("string").alias("record_key"), F.explode(F.array(*claims)).alias("c"), F.lit(method).alias("method"))
    names = ("seq", "field_path", "value_str", "value_num", "value_exp", "value_edu", "raw_confidence")
    return out.select("source", "record_key", *(F.col(f"c.{n}").alias(n) for n in names), "method", F.col("c.normalize_method").alias("normalize_method"))


def claims_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, event users, orders and parts as claims of five sources; see the queries' SQL for the recipe."""
    t = lambda name: load(spark, sf_dir, name)
    nation = t("nation").select("n_nationkey", "n_name")
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    col = F.col
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    third = F.floor(col("c_custkey") / 3).cast("bigint").cast("string")
    key = lambda c: col(c).cast("string")
    parts = [
        _rows(
            customer, "csv_recruiter", col("c_custkey"), "csv_column",
            _claim("candidate_id", "1.00", 1, text("cand-", third)),
            _claim("full_name", "0.95", 2, col("c_name")),
            _claim("emails", "0.95", 3, text("u", key("c_custkey"), "@example.com")),
            _claim("location.region", "0.90", 4, col("n_name")),
            _claim("skills", "0.90", 5, F.lower("c_mktsegment"), norm="skill_canonicalize"),
        ),
        _rows(
            supplier, "ats_json", col("s_suppkey"), "ats_field_map",
            _claim("candidate_id", "1.00", 1, text("cand-", key("s_suppkey"))),
            _claim("full_name", "0.95", 2, col("s_name")),
            _claim("location.region", "0.90", 3, col("n_name")),
            _claim("years_experience", "0.90", 4, num=(col("s_suppkey") % 30).cast("double")),
        ),
        _rows(t("events").select("user_id").distinct(), "github", col("user_id"), "github_api", _claim("emails", "0.80", 1, text("u", key("user_id"), "@example.com"))),
        _rows(
            t("events").select("user_id", "event_type").distinct(), "github", col("user_id"), "github_api",
            _claim("skills", "0.75", 2, col("event_type"), norm="skill_canonicalize"),
        ),
        _rows(
            t("orders"), "csv_recruiter", col("o_custkey"), "csv_column",
            _claim("experience", "0.90", col("o_orderkey") + 10, exp=F.struct(
                col("o_orderpriority").alias("company"), col("o_orderstatus").alias("title"),
                F.date_format("o_orderdate", "yyyy-MM").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("summary"),
            )),
        ),
        _rows(
            t("part"), "resume", text("p", F.floor(col("p_partkey") / 4).cast("bigint").cast("string")), "regex_extraction",
            _claim("education", "0.70", col("p_partkey"), edu=F.struct(
                col("p_brand").alias("institution"), col("p_type").alias("degree"), col("p_name").alias("field"), (col("p_size") + 1950).cast("int").alias("end_year"),
            )),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


#: The same claims in SQL; structs as separate columns.
CLAIMS_SQL = """
claims AS (
  SELECT 'csv_recruiter' AS source, CAST(c_custkey AS VARCHAR) AS record_key, x.seq, x.field_path, x.value_str, CAST(NULL AS DOUBLE) AS value_num,
    CAST(NULL AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS start, CAST(NULL AS VARCHAR) AS institution,
    CAST(NULL AS VARCHAR) AS degree, CAST(NULL AS VARCHAR) AS edu_field, CAST(NULL AS INT) AS end_year, x.conf, 'csv_column' AS method, x.norm
  FROM customer JOIN nation ON c_nationkey = n_nationkey, LATERAL (VALUES
    (1, 'candidate_id', 'cand-' || CAST(c_custkey // 3 AS VARCHAR), 100, NULL), (2, 'full_name', c_name, 95, NULL),
    (3, 'emails', 'u' || CAST(c_custkey AS VARCHAR) || '@example.com', 95, NULL), (4, 'location.region', n_name, 90, NULL),
    (5, 'skills', lower(c_mktsegment), 90, 'skill_canonicalize')) AS x(seq, field_path, value_str, conf, norm)
  UNION ALL
  SELECT 'ats_json', CAST(s_suppkey AS VARCHAR), x.seq, x.field_path, x.value_str, x.num, NULL, NULL, NULL, NULL, NULL, NULL, NULL, x.conf, 'ats_field_map', NULL
  FROM supplier JOIN nation ON s_nationkey = n_nationkey, LATERAL (VALUES
    (1, 'candidate_id', 'cand-' || CAST(s_suppkey AS VARCHAR), CAST(NULL AS DOUBLE), 100), (2, 'full_name', s_name, NULL, 95),
    (3, 'location.region', n_name, NULL, 90), (4, 'years_experience', NULL, CAST(s_suppkey % 30 AS DOUBLE), 90)) AS x(seq, field_path, value_str, num, conf)
  UNION ALL
  SELECT DISTINCT 'github', CAST(user_id AS VARCHAR), 1, 'emails', 'u' || CAST(user_id AS VARCHAR) || '@example.com', CAST(NULL AS DOUBLE),
    NULL, NULL, NULL, NULL, NULL, NULL, CAST(NULL AS INT), 80, 'github_api', NULL FROM events
  UNION ALL
  SELECT DISTINCT 'github', CAST(user_id AS VARCHAR), 2, 'skills', event_type, CAST(NULL AS DOUBLE),
    NULL, NULL, NULL, NULL, NULL, NULL, CAST(NULL AS INT), 75, 'github_api', 'skill_canonicalize' FROM events
  UNION ALL
  SELECT 'csv_recruiter', CAST(o_custkey AS VARCHAR), o_orderkey + 10, 'experience', NULL, NULL, o_orderpriority, o_orderstatus,
    strftime(o_orderdate, '%Y-%m'), NULL, NULL, NULL, NULL, 90, 'csv_column', NULL FROM orders
  UNION ALL
  SELECT 'resume', 'p' || CAST(p_partkey // 4 AS VARCHAR), p_partkey, 'education', NULL, NULL, NULL, NULL, NULL, p_brand, p_type, p_name,
    CAST(p_size + 1950 AS INT), 70, 'regex_extraction', NULL FROM part
)"""

#: Records, their strong components by reachability, and claims with cluster, trust and support in ten-thousandths.
CLUSTERS_SQL = (
    CLAIMS_SQL
    + """, recs AS (SELECT DISTINCT source || chr(1) || record_key AS rid, source, record_key FROM claims),
ids AS (
  SELECT DISTINCT source || chr(1) || record_key AS rid, field_path AS kind, value_str AS value FROM claims
  WHERE field_path IN ('candidate_id', 'emails', 'phones')
), least_owner AS (SELECT kind, value, min(rid) AS v FROM ids GROUP BY ALL),
ties AS (SELECT DISTINCT rid AS u, v FROM ids JOIN least_owner USING (kind, value) WHERE rid != v),
edges AS (SELECT u, v FROM ties UNION SELECT v, u FROM ties),
reach(a, b) AS (SELECT rid, rid FROM recs UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u),
clusters AS (SELECT a AS rid, min(b) AS cluster FROM reach GROUP BY a),
cl AS (
  SELECT c.*, k.cluster, t.trust, t.trust * conf AS support,
    c.source || chr(1) || c.record_key || chr(1) || lpad(CAST(seq AS VARCHAR), 12, '0') AS ord
  FROM claims c JOIN clusters k ON c.source || chr(1) || c.record_key = k.rid
  JOIN (VALUES ('ats_json', 100), ('csv_recruiter', 90), ('github', 70), ('resume', 50)) t(source, trust) ON t.source = c.source
)"""
)


def _resolved(rows: str, keys: str, name: str) -> str:
    """SQL of the winner per keys among rows (keys, value, source, trust, support, ord)."""
    return f"""{name}_v AS (
  SELECT {keys}, value, max(trust) AS t, arg_min(source, lpad(CAST(100 - trust AS VARCHAR), 3, '0') || source) AS winner, min(ord) AS o,
    max(support) AS support, count(DISTINCT source) AS n FROM {rows} GROUP BY {keys}, value
), {name} AS (
  SELECT *, CAST(CASE WHEN conflict THEN round(least(9900, support + least(1500, 500 * (n - 1))) * 0.7)
    ELSE least(9900, support + least(1500, 500 * (n - 1))) END AS INT) AS units
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t DESC, winner, o) AS place,
    count(*) OVER (PARTITION BY {keys}) > 1 AS conflict FROM {name}_v) WHERE place = 1
)"""


#: All branches of the fusion.
FUSED_SQL = (
    CLUSTERS_SQL
    + """, sc AS (SELECT cluster, field_path, coalesce(value_str, CAST(value_num AS VARCHAR)) AS value, source, trust, support, ord FROM cl
  WHERE field_path IN ('candidate_id', 'full_name', 'location.region', 'years_experience')), """
    + _resolved("sc", "cluster, field_path", "scalars")
    + """, lists AS (
  SELECT cluster, field_path, list_sort(list_distinct(list(value_str))) AS items,
    CAST(least(9900, max(support) + least(1500, 500 * (count(DISTINCT source) - 1))) AS INT) AS units
  FROM cl WHERE field_path = 'emails' GROUP BY cluster, field_path
), skills AS (
  SELECT cluster, value_str AS name, list_sort(list_distinct(list(source))) AS sources,
    CAST(least(9900, max(support) + least(1500, 500 * (count(DISTINCT source) - 1))) AS INT) AS units
  FROM cl WHERE field_path = 'skills' GROUP BY cluster, value_str
), ex AS (SELECT *, lower(company) AS entry FROM cl WHERE field_path = 'experience'),
ext AS (SELECT cluster, entry, title AS value, source, trust, support, ord FROM ex),
exs AS (SELECT cluster, entry, start AS value, source, trust, support, ord FROM ex),
exc AS (SELECT cluster, entry, company AS value, source, trust, support, ord FROM ex), """
    + _resolved("ext", "cluster, entry", "won_title")
    + ", "
    + _resolved("exs", "cluster, entry", "won_start")
    + ", "
    + _resolved("exc", "cluster, entry", "won_company")
    + """, whole AS (SELECT cluster, entry, max(support) AS support, count(DISTINCT source) AS n FROM ex GROUP BY cluster, entry),
experience AS (
  SELECT w.cluster, c.value AS company, t.value AS title, s.value AS start, t.conflict, t.winner AS title_winner,
    CAST(CASE WHEN t.conflict THEN round(least(9900, w.support + least(1500, 500 * (w.n - 1))) * 0.7)
      ELSE least(9900, w.support + least(1500, 500 * (w.n - 1))) END AS INT) AS units
  FROM whole w JOIN won_title t USING (cluster, entry) JOIN won_start s USING (cluster, entry) JOIN won_company c USING (cluster, entry)
), ed AS (SELECT *, lower(institution) AS entry FROM cl WHERE field_path = 'education'),
edd AS (SELECT cluster, entry, end_year, degree AS value, source, trust, support, ord FROM ed),
edf AS (SELECT cluster, entry, end_year, edu_field AS value, source, trust, support, ord FROM ed),
edi AS (SELECT cluster, entry, end_year, institution AS value, source, trust, support, ord FROM ed), """
    + _resolved("edd", "cluster, entry, end_year", "won_degree")
    + ", "
    + _resolved("edf", "cluster, entry, end_year", "won_field")
    + ", "
    + _resolved("edi", "cluster, entry, end_year", "won_inst")
    + """, education AS (
  SELECT d.cluster, i.value AS institution, d.value AS degree, f.value AS field, d.end_year, i.units
  FROM won_degree d JOIN won_field f USING (cluster, entry, end_year) JOIN won_inst i USING (cluster, entry, end_year)
), confidences AS (
  SELECT cluster, units, CASE WHEN field_path IN ('candidate_id', 'full_name') THEN 2 ELSE 1 END AS w FROM scalars
  UNION ALL SELECT cluster, units, 2 FROM lists UNION ALL SELECT cluster, units, 1 FROM skills
  UNION ALL SELECT cluster, units, 2 FROM experience UNION ALL SELECT cluster, units, 1 FROM education
), overall AS (SELECT cluster, round_even(sum(w * units) / sum(w), 0) / 10000 AS overall_confidence FROM confidences GROUP BY cluster
), cids AS (
  SELECT o.cluster, coalesce(s.value, email, key) AS candidate_id, s.value IS NULL AS derived FROM (
    SELECT cluster, min(value_str) FILTER (field_path = 'emails') AS email, min(record_key) AS key FROM cl GROUP BY cluster) o
  LEFT JOIN scalars s ON s.cluster = o.cluster AND s.field_path = 'candidate_id'
)"""
)
