"""Driver queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import load, stored, train_row


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.embeddings import near_duplicates

    found = near_duplicates(load(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm import quality

    docs = load(spark, sf_dir, "documents")
    model = quality.train(docs, load(spark, sf_dir, "labels").where(train_row()))
    return _judged(quality.score(docs, model), 0.3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm import toxicity

    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(docs, load(spark, sf_dir, "labels").where(train_row()))
    return _judged(toxicity.score(docs, model), 0.5)


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        F.col("id").alias("doc_id"),
        (~train_row("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


#: Fixed rules of the url query: (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.urls import filter_urls

    return filter_urls(load(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.pii import KINDS, detect, text_of_spans

    found = detect(load(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k) for k in KINDS),
        F.sha2(text_of_spans("base").cast("binary"), 256).alias("base_sha256"),
        text_of_spans("spans").alias("spans"),
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.simhash import near_duplicates

    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.token_counts import count_tokens

    found = count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit")
    )


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.byte_bpe import encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = encode(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)
    return found.withColumnRenamed("id", "doc_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.decontaminate import contamination

    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.repair import round_trip

    found = round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.importance import resample

    found = resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.line_dedup import drop_shared_lines

    found = drop_shared_lines(load(spark, sf_dir, "documents"))
    kept = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", kept)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.llm.variants import group_variants, word_counts

    vocabulary = stored(word_counts(load(spark, sf_dir, "documents"), slip=97), "vocabulary")
    return group_variants(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op4_url_filter": op4_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_byte_level_bpe": op8_byte_level_bpe,
    "op9_pii": op9_pii,
    "op10_repair_token_shards": op10_repair_token_shards,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_line_dedup": op12_line_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Words as the decontamination query defines them, windows as joined strings.
_OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i
        FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM q), p AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (
  SELECT p.doc_id, p.n, p.i, q.item_id FROM p JOIN q ON p.s = q.s AND p.n = q.n
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM m) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP4 = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS k FROM pages
), s AS (
  SELECT page_id, CASE WHEN k > 0 THEN translate(regexp_extract(substr(url, k + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN k > 0 THEN regexp_extract(substr(url, k + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u
), r(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT s.*, h || p AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS place
  FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE place = 1
"""

_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(u, w) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN l ON r.w = l.u
), c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.u LEFT JOIN n ON vec_id = n.u
"""

#: CRC-32 by bytes: the table from its polynomial, and a fold over a text's UTF-8 bytes (``$text``), started and complemented.
_CRC_TABLE = """ct AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
)"""
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen($text) + 1),
    lambda k: CAST('0x' || substr(hex(encode($text)), 2 * k - 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"""

_OP11 = r"""
WITH """ + _CRC_TABLE + r""", d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), f AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
q AS (SELECT w, count(*) AS n FROM b GROUP BY w),
u AS (SELECT w FROM f UNION SELECT w FROM q),
k AS (SELECT w, """ + _CRC.replace("$text", "w") + r""" % 10000 AS bucket FROM u, ct),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM q JOIN k USING (w) GROUP BY bucket),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS ss, coalesce((SELECT sum(t) FROM t), 0) AS tt),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), total
), x AS (SELECT doc_id, sum(n * gain) AS weight FROM f JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
y AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN x USING (doc_id)
), z AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM z
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM r
"""

_OP12 = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT k.*, keeper IS NOT NULL AND doc_id != keeper AS dropped FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: Near words share a text with one code point cut out (a replaced one, marked by its place) or are such a text.
_OP13 = r"""
WITH RECURSIVE """ + _CRC_TABLE + r""", runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), f AS (SELECT doc_id || ':' || w AS s, w, count(*) AS n FROM runs GROUP BY doc_id, w),
h AS (SELECT w, n, """ + _CRC.replace("$text", "s") + r""" AS h FROM f, ct),
c AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n) AS n
  FROM h GROUP BY 1
), v AS (SELECT word, n::BIGINT AS n FROM c WHERE length(word) >= 5 AND n >= 3),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
), forms AS (
  SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
    CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)
), chain(word, seen) AS (
  SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.seen = f.word WHERE f.form IS NOT NULL
), roots AS (SELECT c.word, c.seen AS root FROM chain c JOIN forms f ON c.seen = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": _OP1,
    "op4_url_filter": _OP4,
    "op3_benchmark_decontamination": _OP3,
    "op11_importance_resampling": _OP11,
    "op12_line_dedup": _OP12,
    "op13_spelling_variants": _OP13,
}
