"""Queries of the sources: files and records made of the driver's tables go through listing, routing and the parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import dates, phones, skills
from claimloom.plans.tables import dealt, load
from claimloom.sources import files, listing, tables
from claimloom.storage import scratch


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of its own, under plain, hidden and pattern-like names in nested folders, listed and read again."""
    pages = load(spark, sf_dir, "pages")
    k = F.col("page_id").cast("string")
    name = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("_"), k, F.lit(".html")))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit(".deep/."), k, F.lit(".html")))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("a b/page["), k, F.lit("].html")))
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("{x}/"), k, F.lit("*.html")))
        .otherwise(F.concat(k, F.lit(".html")))
    )
    folder = scratch(spark, "pages")
    listing.write_named(pages.select(name.alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content")), folder)
    read = files.read_files(spark, [folder])
    return read.select(
        F.regexp_extract("path", r"pages-[0-9a-f]+/(.*)$", 1).alias("name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), (F.length("content")).cast("bigint").alias("n_bytes")
    )


LISTED_FILES = """SELECT CASE page_id % 5 WHEN 0 THEN '_' || page_id || '.html' WHEN 1 THEN '.deep/.' || page_id || '.html' WHEN 2 THEN 'a b/page[' || page_id || '].html'
 WHEN 3 THEN '{x}/' || page_id || '*.html' ELSE page_id || '.html' END AS name, sha256(coalesce(html, '')) AS sha256, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes FROM pages"""


def _claims(rows: DataFrame) -> DataFrame:
    return files.normalized(rows).select(
        "source", "record_key", "field_path", "value_str", "value_num", F.col("value_exp.company").alias("company"), F.col("value_exp.title").alias("title"),
        (F.col("raw_confidence") * 100).cast("int").alias("conf"), "method", F.col("normalize_method").alias("norm"),
    )


#: Keys that one window over the lines of a file spans.
KEYS_A_WINDOW = 4096


def _ranges(lines: DataFrame, file: str, key: str, header: str, end: str, size: int) -> DataFrame:
    """(``file``, part, content): files of lines in order of a key, below a header and ``end`` between them, in ranges of ``size`` bytes.

    No file is put together: sums of the lengths over windows of keys, and inside of them, tell where a line stands, and each
    range gathers the lines that it holds.
    """
    spaced = lines.withColumn("_window", F.floor(F.col(key) / KEYS_A_WINDOW)).withColumn("_size", F.octet_length("line") + len(end))
    windows = spaced.groupBy(file, "_window").agg(F.sum("_size").alias("_all"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    windows = windows.select(file, "_window", F.coalesce(F.sum("_all").over(earlier(file).orderBy("_window")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_size").over(earlier(file, "_window").orderBy(key, "line")), F.lit(0))
    placed = spaced.withColumn("_inside", inside).join(windows, [file, "_window"]).withColumn("_told", F.col("_before") + F.col("_inside"))
    first = F.col("_told") == 0
    bytes = F.concat(F.when(first, header).otherwise(end), "line").cast("binary")
    start = F.when(first, 0).otherwise(F.col("_told") + len(header.encode()) - len(end)).cast("bigint")
    pieces = placed.select(file, start.alias("start"), bytes.alias("bytes"))
    to = F.floor((F.col("start") + F.octet_length("bytes") - 1) / size)
    cut = pieces.select("*", F.explode(F.sequence(F.floor(F.col("start") / size), to)).alias("part"))
    at = F.greatest(F.lit(0), F.col("part") * size - F.col("start")).cast("int")
    upto = F.least(F.octet_length("bytes"), (F.col("part") + 1) * size - F.col("start")).cast("int")
    cut = cut.select(file, "part", "start", F.decode(F.substring("bytes", at + 1, upto - at), "ISO-8859-1").alias("plain"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "plain"))), lambda p: p["plain"]), "")
    return cut.groupBy(file, "part").agg(F.encode(whole, "ISO-8859-1").alias("content"))


def table_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as recruiters' tables, one for each nation, cut into ranges of 997 bytes that split quotes and characters."""
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey").cast("string")
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, ', "É"\nJr.').otherwise(""))
    cells = [
        F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("cand-"), key)),
        quote(name),
        F.when(F.col("c_custkey") % 8 == 0, " ").otherwise(F.concat(F.lit("U"), key, F.lit("@Example.com "))),
        F.when(F.col("c_custkey") % 2 == 0, quote("c_mktsegment")).otherwise(F.col("c_mktsegment")),
        F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("n_name")),
    ]
    lines = rows.select("n_nationkey", "c_custkey", F.concat_ws(",", *cells).alias("line"))
    path = F.concat(F.lit("nation"), "n_nationkey", F.lit(".csv"))
    ranges = _ranges(lines, "n_nationkey", "c_custkey", "Candidate ID,Full Name,E-Mail,employer,Role\r\n", "\r\n\n", 997)
    ranges = ranges.select(path.alias("path"), "part", "content")
    return _claims(files.table_rows(ranges))


_TABLE_ROWS = r"""r AS (
 SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS k, 'cand-' || c_custkey AS own,
   c_name || CASE WHEN c_custkey % 3 = 0 THEN ', "É"' || chr(10) || 'Jr.' ELSE '' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
 t AS (SELECT *, CASE WHEN c_custkey % 4 != 0 THEN own WHEN c_custkey % 8 != 0 THEN 'u' || c_custkey || '@example.com' ELSE 'nation' || n_nationkey || '#row' || k END AS record_key FROM r)"""
TABLE_CLAIMS = f"""WITH {_TABLE_ROWS}
 SELECT 'csv_recruiter' AS source, record_key, field_path, value_str, NULL::DOUBLE AS value_num, company, title, conf, 'csv_column' AS method, NULL::VARCHAR AS norm FROM (
   SELECT record_key, 'candidate_id' AS field_path, own AS value_str, NULL AS company, NULL AS title, 100 AS conf FROM t WHERE c_custkey % 4 != 0
   UNION ALL SELECT record_key, 'full_name', name, NULL, NULL, 95 FROM t
   UNION ALL SELECT record_key, 'emails', 'u' || c_custkey || '@example.com', NULL, NULL, 95 FROM t WHERE c_custkey % 8 != 0
   UNION ALL SELECT record_key, 'experience', NULL, c_mktsegment, CASE WHEN c_custkey % 5 != 0 THEN n_name END, 90 FROM t)"""


def ats_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as applicant systems' envelopes: one list for each nation, ``candidates`` for every third, and broken files."""
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    member = F.to_json(
        F.struct(
            F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("cand-"), key)).alias("candidateId"),
            F.concat(F.lit(" "), "s_name").alias("givenName"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).alias("surname"),
            F.array(F.concat(F.lit("S"), key, F.lit("@Example.com")), F.lit("none"), F.concat(F.lit("s"), key, F.lit("@example.com"))).alias("emails"),
            F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 30).alias("yearsExperience"), F.col("n_name").alias("city"), F.lit("").alias("state"),
            F.lit("Germany").alias("country"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("Clerk")).alias("jobTitle"),
            F.array(F.lit("k8s"), F.col("n_name")).alias("skillTags"),
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("s_suppkey", member.alias("m"))))
    listed = F.concat(F.lit('[7, "text", '), F.array_join(F.transform(ordered, lambda r: r["m"]), ", "), F.lit("]"))
    texts = rows.groupBy("n_nationkey").agg(listed.alias("text"))
    wrapped = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('{"candidates": '), "text", F.lit("}"))).otherwise(F.col("text"))
    whole = texts.select(F.concat(F.lit("nation"), "n_nationkey", F.lit(".json")).alias("path"), wrapped.alias("text"))
    broken = texts.select(F.concat(F.lit("broken"), "n_nationkey", F.lit(".json")).alias("path"), F.expr("substr(text, 1, length(text) - 2)").alias("text"))
    return _claims(files.ats_rows(whole.union(broken)))


ATS_CLAIMS = """WITH t AS (SELECT *, CASE WHEN s_suppkey % 3 != 0 THEN 'cand-' || s_suppkey ELSE 's' || s_suppkey || '@example.com' END AS record_key FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT 'ats_json' AS source, record_key, field_path, value_str, value_num, NULL::VARCHAR AS company, title, conf, 'ats_field_map' AS method, norm FROM (
   SELECT record_key, 'candidate_id' AS field_path, record_key AS value_str, NULL::DOUBLE AS value_num, NULL AS title, 100 AS conf, NULL AS norm FROM t WHERE s_suppkey % 3 != 0
   UNION ALL SELECT record_key, 'full_name', s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' ' || n_name ELSE '' END, NULL, NULL, 95, NULL FROM t
   UNION ALL SELECT record_key, 'emails', 's' || s_suppkey || '@example.com', NULL, NULL, 95, NULL FROM t
   UNION ALL SELECT record_key, 'experience', NULL, NULL, 'Clerk', 92, NULL FROM t WHERE s_suppkey % 5 = 0
   UNION ALL SELECT record_key, 'location.city', n_name, NULL, NULL, 90, NULL FROM t
   UNION ALL SELECT record_key, 'location.country', 'DE', NULL, NULL, 90, 'country_normalize' FROM t
   UNION ALL SELECT record_key, 'years_experience', NULL, s_suppkey % 30, NULL, 90, NULL FROM t WHERE s_suppkey % 7 != 0
   UNION ALL SELECT record_key, 'skills', 'Kubernetes', NULL, NULL, 90, 'skill_canonicalize' FROM t
   UNION ALL SELECT record_key, 'skills', n_name, NULL, NULL, 60, 'skill_canonicalize' FROM t)"""


def routed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kind documents would be read as under names and marks of all kinds."""
    k = F.col("doc_id") % 8
    suffix = F.when(k == 0, ".CSV").when(k.isin(1, 2, 3), ".json").when(k == 4, ".docx").when(k == 5, ".md").when(k == 6, ".dat").otherwise("")
    head = F.when(k == 1, ' {"surname": 1}').when(k == 2, '{"user": {}, "repos": []}').when(k == 3, '{"users": {}}').when(k == 6, "a,b\n").otherwise("")
    rows = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("x/"), "doc_id", suffix).alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select("doc_id", files.kind_of(F.col("path"), F.col("text")).alias("kind"), tables.stem(F.col("path")).alias("stem"))


ROUTED_KINDS = r"""WITH t AS (SELECT doc_id, doc_id % 8 AS k, ltrim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(133)) AS body, coalesce(text, '') AS text FROM documents),
 s AS (SELECT *, NOT regexp_matches(body, '^[\[{]') AND contains(regexp_extract(body, '^[^\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]*'), ',') AS tabular FROM t)
 SELECT doc_id, CASE WHEN k IN (0, 6) THEN 'csv_recruiter' WHEN k = 1 THEN 'ats_json' WHEN k = 2 THEN 'github' WHEN k = 3 THEN
   CASE WHEN regexp_matches(text, '"(givenName|surname|skillTags|currentTitle|phoneNumber|candidates)"') THEN 'ats_json' END
   WHEN tabular THEN 'csv_recruiter' WHEN k = 4 THEN 'resume' WHEN k = 5 THEN 'notes' END AS kind, CAST(doc_id AS VARCHAR) AS stem FROM s"""


def free_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in thirteen ways, times, zones and days of the week among them, and one that is no date."""
    k, fmt = F.col("o_orderkey") % 14, lambda f: F.date_format("o_orderdate", f)
    day = F.dayofmonth("o_orderdate").cast("string")
    shapes = [
        fmt("yyyy MMM d"), fmt("yyyyMMdd"), F.concat(fmt("EEE "), day, fmt(" MMM yyyy")), fmt("yyyy-MM-dd'T'10:30:00+02:00"), F.concat(fmt("M"), F.lit(" "), fmt("yyyy")),
        F.concat(fmt("MM/dd/yyyy "), F.lit("11:59 PM EST")), F.concat(day, F.lit("th of "), fmt("MMMM, yyyy")), fmt("dd-MMM-yyyy"), fmt("yyyyMMdd'T'1030"),
        fmt("yyyy.MM.dd"), F.concat(F.lit("10:30 "), fmt("MMM yyyy")), F.concat(fmt("EEEE, "), fmt("MMMM d, yyyy")), F.concat(fmt("yyyy/MM")),
    ]
    raw = F.when(k == 0, shapes[0])
    for n, shape in enumerate(shapes[1:], 1):
        raw = raw.when(k == n, shape)
    raw = raw.otherwise(F.concat(F.lit("fiscal "), fmt("yyyy")))
    return load(spark, sf_dir, "orders").select("o_orderkey", dates.year_month(raw).alias("month"))


FREE_DATES = "SELECT o_orderkey, CASE WHEN o_orderkey % 14 < 13 THEN strftime(o_orderdate, '%Y-%m') END AS month FROM orders"


def skill_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, spellings with a letter lost or doubled at places that the key tells, and words of documents as skills."""
    known = sorted(skills.aliases())
    alias = F.element_at(F.array(*map(F.lit, known)), (F.col("p_partkey") % len(known)).cast("int") + 1)
    at = (F.col("p_partkey") % F.length("alias")).cast("int")
    lost = F.concat(F.substring("alias", F.lit(1), at), F.substring("alias", at + 2, F.lit(99)))
    doubled = F.concat(F.substring("alias", F.lit(1), at + 1), F.substring("alias", at + 1, F.lit(99)))
    parts = dealt(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_partkey").withColumn("alias", alias)
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, lost).when(k == 1, F.upper(doubled)).when(k == 2, F.concat(F.lit(" "), F.col("p_name"))).otherwise(F.concat("p_type", F.lit(" "), "alias"))
    made = parts.select(F.lit("p").alias("k"), F.col("p_partkey").alias("id"), raw.alias("raw"))
    firsts = load(spark, sf_dir, "documents").select(F.lit("d"), "doc_id", F.substring_index(F.coalesce("text", F.lit("")), " ", 1).alias("raw"))
    firsts = dealt(firsts, "doc_id")
    return made.union(firsts).select("k", "id", skills.canonical_skill(F.col("raw")).alias("s")).select("k", "id", "s.*")


_SPELLED = ", ".join(f"({n}, '{a}', '{' '.join(sorted(a.split()))}', '{skills.aliases()[a]}')" for n, a in enumerate(sorted(skills.aliases())))
SKILL_NEAR_MISSES = rf"""WITH known(i, alias, words, name) AS (VALUES {_SPELLED}),
 part2 AS (SELECT *, p_partkey % length(alias) AS pos FROM part JOIN known ON i = p_partkey % (SELECT count(*) FROM known)),
 raw AS (SELECT 'p' AS k, p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN left(alias, pos) || substr(alias, pos + 2) WHEN 1 THEN upper(left(alias, pos + 1) || substr(alias, pos + 1))
   WHEN 2 THEN ' ' || p_name ELSE p_type || ' ' || alias END AS raw FROM part2
   UNION ALL SELECT 'd', doc_id, string_split(coalesce(text, ''), ' ')[1] FROM documents),
 clean AS (SELECT k, id, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS c FROM raw),
 vals AS (SELECT DISTINCT lower(c) AS low, array_to_string(list_sort(string_split_regex(lower(c), '\s+')), ' ') AS w FROM clean WHERE c != ''),
 pairs AS (SELECT low, w, words, name, CAST((1 << length(words)) - 1 AS BIGINT) AS full_row, length(w) + length(words) AS total FROM vals, known),
 reduced AS (SELECT *, list_reduce(list_concat([full_row], list_transform(range(1, length(w) + 1), lambda j:
     list_sum(list_transform(range(length(words)), lambda i: CASE WHEN words[i + 1] = w[j] THEN CAST(1 << i AS BIGINT) ELSE 0 END))::BIGINT)),
     lambda r, m: ((r + (r & m)) | (r - (r & m))) & full_row) AS r FROM pairs),
 scored AS (SELECT low, name, 200.0::DOUBLE * (length(words) - bit_count(r)) / total AS score FROM reduced),
 best AS (SELECT low, name, score FROM scored QUALIFY row_number() OVER (PARTITION BY low ORDER BY score DESC, name) = 1)
 SELECT k, id, CASE WHEN e.name IS NOT NULL THEN e.name WHEN score >= 90 THEN b.name ELSE c END AS name, c != '' AND (e.name IS NOT NULL OR score >= 90) AS canonical,
   CASE WHEN c = '' THEN 'empty' WHEN e.name IS NOT NULL THEN 'exact_alias' WHEN score >= 90 THEN 'fuzzy_match' ELSE 'passthrough' END AS method,
   CASE WHEN c = '' THEN 0.0::DOUBLE WHEN e.name IS NOT NULL THEN 100.0::DOUBLE ELSE score END AS score
 FROM clean LEFT JOIN known e ON lower(c) = e.alias LEFT JOIN best b ON lower(c) = b.low"""


def phone_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that keys are spread to, with the calling codes of eight plans in turn, written with marks; many are not valid."""
    n = F.lpad(((F.col("o_orderkey") * 7368787 + 1234567) % 10000000000).cast("string"), 10, "0")
    codes = ["44", "49", "33", "91", "61", "55", "353", "1"]
    code = F.element_at(F.array(*map(F.lit, codes)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    national = F.substring(n, F.lit(1), 8 + (F.col("o_orderkey") % 3).cast("int"))
    raw = F.concat(F.lit(" +"), code, F.lit(" ("), F.substring(national, 1, 3), F.lit(") "), F.substring(national, 4, 3), F.lit("-"), F.substring(national, 7, 9))
    return load(spark, sf_dir, "orders").select("o_orderkey", phones.normalize_phone(raw).alias("phone"))


_PLAN_VALUES = ", ".join(f"({k}, '{c}', '{phones.PLANS[c]}')" for k, c in enumerate(("44", "49", "33", "91", "61", "55", "353", "1")))
PHONE_PLANS = f"""SELECT o_orderkey, CASE WHEN regexp_full_match(d, plan) THEN '+' || code || d END AS phone FROM (
 SELECT o_orderkey, code, plan, left(lpad(CAST((o_orderkey * 7368787 + 1234567) % 10000000000 AS VARCHAR), 10, '0'), 8 + o_orderkey % 3) AS d
 FROM orders JOIN (VALUES {_PLAN_VALUES}) p(k, code, plan) ON k = o_orderkey % 8)"""
