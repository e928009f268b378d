"""The queries of this subpackage, by name, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_tree, language, mixing, multi_index, ppm, quality, simhash, tool_calls, url_filter
from .common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1)


#: The rules of the url query (host, path, action).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in URL_RULES])))
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
named AS (SELECT *, row_number() OVER () AS r FROM parts),
best AS (
  SELECT r, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM named LEFT JOIN best USING (r)
"""


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "root")


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(F.col("doc_id"), 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (part == 0).alias("held_out"))
    scored = quality.score(docs, table(spark, sf_dir, "labels"), part != 0, part == 4, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    return language.identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


#: The tool of the chat query: each user turn asks it, the next assistant turn is its result; turns of other roles are context.
CHAT_SCHEMAS = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}}}


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    asked = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    calls = turns.where("role = 'user'").select("conv_id", name(0).alias("call_id"), name(2).alias("parent"), "turn", F.lit("reply").alias("name"), asked.alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), "turn", F.col("text").alias("content"))
    other = ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    context = turns.where(other).select("conv_id", F.concat(F.lit("t"), "turn", F.lit("-"), F.coalesce("role", F.lit(""))).alias("call_id"), "turn", "role", F.col("text").alias("content"))
    return tool_calls.link(calls, results, CHAT_SCHEMAS, context).withColumn("errors", F.array_join("errors", "; "))


OP9_SQL = """
WITH turns AS (SELECT conv_id, turn::BIGINT AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (SELECT conv_id, turn, arg_min(text, coalesce(to_json(text)::VARCHAR, '')) AS text, count(text) < count(*) AS bare, count(*) AS copies FROM turns WHERE role = 'user' GROUP BY conv_id, turn),
islands AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM calls),
deep AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS depth FROM islands),
answers AS (SELECT conv_id, turn - 1 AS at, min(turn) AS turn, min(text) AS content FROM turns WHERE role = 'assistant' GROUP BY conv_id, turn),
rows AS (
  SELECT coalesce(d.conv_id, a.conv_id) AS conv_id, 'c' || coalesce(d.turn, a.at) AS call_id, CASE WHEN d.conv_id IS NOT NULL THEN 'reply' END AS name, depth, coalesce(d.turn, a.turn) AS turn, coalesce(copies, 0) AS copies,
    CASE WHEN d.conv_id IS NULL THEN 'orphan' WHEN bare THEN 'invalid' WHEN a.conv_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, CASE WHEN bare THEN '$.prompt: missing' ELSE '' END AS errors,
    CASE WHEN d.conv_id IS NULL THEN '{"id":"c' || a.at || '","result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || '}'
      ELSE '{"arguments":{' || CASE WHEN bare THEN '' ELSE '"prompt":' || to_json(d.text)::VARCHAR || ',' END || '"turn":' || d.turn || '},"depth":' || depth || ',"id":"c' || d.turn || '","name":"reply","parent":"c' || (d.turn - 2)
        || '","result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || ',"valid":' || CASE WHEN bare THEN 'false' ELSE 'true' END || '}' END AS json, false AS context
  FROM deep d FULL JOIN answers a ON a.conv_id = d.conv_id AND a.at = d.turn
  UNION ALL
  SELECT conv_id, 't' || turn || '-' || coalesce(role, ''), role, NULL, turn, count(*), 'context', '',
    '{"content":' || coalesce(to_json(min(text))::VARCHAR, 'null') || ',"id":' || to_json('t' || turn || '-' || coalesce(role, ''))::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}', true
  FROM turns WHERE coalesce(role NOT IN ('user', 'assistant'), true) GROUP BY conv_id, turn, role)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(depth, 4611686018427387904), context, turn, call_id) AS position, call_id, name, depth, turn, copies, status, errors, json FROM rows
"""


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1') AS h
  FROM documents),
src AS (SELECT s, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS w FROM d GROUP BY s),
capped AS (SELECT *, source_size * 3 AS cap FROM src),
poured AS (
  SELECT *, (cap / w)::DOUBLE AS ratio,
    ((SELECT sum(source_size) FROM src) - sum(cap) OVER o + cap)::DOUBLE / ((SELECT sum(w) FROM src) - sum(w) OVER o + w)::DOUBLE AS lvl
  FROM capped WINDOW o AS (ORDER BY cap / w, s ROWS UNBOUNDED PRECEDING)),
fair AS (SELECT lvl FROM poured WHERE lvl <= ratio ORDER BY ratio, s LIMIT 1),
targets AS (SELECT s, source_size, least(cap::DOUBLE, coalesce(w * (SELECT lvl FROM fair), cap::DOUBLE)) AS target FROM poured),
queued AS (SELECT row_number() OVER () AS r, d.*, sum(size) OVER (PARTITION BY s ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS pos FROM d),
entries AS (
  SELECT r, s, size, pos, e, (source_size * e + pos)::DOUBLE / target AS finish
  FROM queued JOIN targets USING (s), (VALUES (0), (1), (2)) AS rounds(e) WHERE size > 0),
runs AS (SELECT *, sum(size) OVER (ORDER BY finish, s, e, pos ROWS UNBOUNDED PRECEDING) AS run FROM entries),
taken AS (SELECT r, sum(greatest(0, least(size, (SELECT sum(size) FROM d) - (run - size))))::BIGINT AS taken FROM runs GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued JOIN targets USING (s) LEFT JOIN taken USING (r)
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hits(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


OP10_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT r, doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered),
items AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)),
windows AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
found AS (SELECT r, i, windows.n, item_id FROM windows JOIN phrases ON windows.p = phrases.p AND windows.n = phrases.n),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM found) GROUP BY r),
which AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN which USING (r)
"""


QUERIES: dict[str, Query] = {
    "op1_ppm_score": op1_ppm_score,
    "op2_url_filter": op2_url_filter,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_nearest": op4_nearest,
    "op5_fair_mix": op5_fair_mix,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_main_text": op8_main_text,
    "op9_tool_calls": op9_tool_calls,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": OP2_SQL, "op5_fair_mix": OP5_SQL, "op9_tool_calls": OP9_SQL, "op10_decontaminate": OP10_SQL}
