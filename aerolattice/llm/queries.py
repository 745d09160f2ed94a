"""Registered queries opN_<name> over the test tables, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolattice.llm import (
    compact_windows,
    decontamination,
    exact_dedup,
    filter_audit,
    html_extraction,
    jaccard_join,
    lm_scoring,
    lpf_dedup,
    packing,
    quality,
    secrets,
    token_alignment,
    toxicity,
)
from aerolattice.llm.bytetext import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_exact_dedup(spark, sf_dir):
    found = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op7_exact_dedup"] = """
WITH rows AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM rows WINDOW same AS (PARTITION BY text_sha256)"""


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op10_best_fit_packing(spark, sf_dir):
    return packing.best_fit_packing(documents(spark, sf_dir), byte_bpe())


@query
def op8_benchmark_decontamination(spark, sf_dir):
    return decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op8_benchmark_decontamination"] = """
WITH plain AS (
  SELECT doc_id AS id, false AS test, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT item_id, true, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
split AS (
  SELECT id, test, list_filter(string_split_regex(coalesce(t, ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM plain),
item AS (
  SELECT DISTINCT id, least(len(w), 13) AS size, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS words
  FROM split, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(s) WHERE test AND len(w) > 0),
found AS (
  SELECT doc, start, k.size, item.id AS item FROM
    (SELECT id AS doc, s AS start, size, array_to_string(w[s:s + size - 1], ' ') AS words
     FROM split, (SELECT DISTINCT size FROM item) AS z, unnest(range(1, len(w) - size + 2)) AS u(s) WHERE NOT test) AS k
  JOIN item USING (words, size)),
hit AS (SELECT doc, count(DISTINCT start + o) AS n FROM found, unnest(range(size)) AS u(o) GROUP BY doc),
named AS (SELECT doc, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc, item::VARCHAR AS i FROM found) GROUP BY doc)
SELECT id AS doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM split LEFT JOIN hit ON hit.doc = id LEFT JOIN named ON named.doc = id WHERE NOT test"""


@query
def op5_toxicity(spark, sf_dir):
    found = toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    first = F.get("offending", 0)
    return found.select(
        "doc_id",
        "held_out",
        "score",
        "predicted",
        F.size("offending").alias("n_offending"),
        first["start"].alias("first_start"),
        first["end"].alias("first_end"),
    )


@query
def op4_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op1_secret_scan(spark, sf_dir):
    return secrets.secret_scan(documents(spark, sf_dir)).drop("findings")


@query
def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


@query
def op3_suffix_array_dedup(spark, sf_dir):
    return lpf_dedup.remove_repeats(documents(spark, sf_dir)).drop("spans")


@query
def op9_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(documents(spark, sf_dir))


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLES["op11_filter_audit"] = """
WITH label AS (
  SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
plain AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
judged AS (
  SELECT doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM plain LEFT JOIN label USING (doc_id)),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM judged GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s::INT AS step, filter_order[s] AS f, filter_order[:s - 1] AS earlier FROM orders, range(1, 6) AS r(s)),
told AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, contains(fails, f) AS hit,
         length(regexp_replace(fails, '[^' || earlier || '0]', '', 'g')) > 0 AS gone, fails = f AS alone
  FROM kinds, steps),
tallied AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(n_good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost,
         coalesce(sum(n_toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM tallied"""


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op12_token_alignment(spark, sf_dir):
    return token_alignment.alignment(documents(spark, sf_dir), byte_bpe(), piece_model())


@query
def op13_html_extraction(spark, sf_dir):
    return html_extraction.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For pages that declare their article, as all of the tables do, and the references that stand in it.
ORACLES["op13_html_extraction"] = """
WITH split AS (
  SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(p|h1)>') AS pieces FROM pages),
plain AS (
  SELECT page_id, url, list_transform(pieces, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS found FROM split),
joined AS (SELECT page_id, url, array_to_string(list_filter(found, lambda x: x <> ''), chr(10)) AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM joined"""


@query
def op2_substring_dedup(spark, sf_dir):
    found = compact_windows.substring_dedup(documents(spark, sf_dir))
    return found.withColumn("first_ids", F.array_join(F.transform("first_ids", lambda x: x.cast("string")), ","))
