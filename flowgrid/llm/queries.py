"""The registered queries of this subpackage and their SQL, where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.llm import chat, crosstok, decontam, langid, licenses, line_dedup, packing, pages, quality, repair, simhash, store, tokens, toxicity
from flowgrid.llm.shared import fresh_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), links=True)
    links = F.array_join(F.transform("line_links", lambda x: F.concat_ws(":", *[x[k].cast("string") for k in ("line_no", "class_id", "n_links")])), ",")
    return out.select("doc_id", "text", "n_lines", "n_removed", links.alias("line_links"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("spans", spans)


OP4_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body, cast(floor(turn / 1024.0) AS BIGINT) AS part
  FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS speaker FROM c WHERE role <> 'system'),
seg AS (
  SELECT conv_id, speaker, part, turn, role, body,
    '<|' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user:' || role END || '|>' || chr(10)
    || replace(body, '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS s
  FROM c JOIN people USING (conv_id)),
placed AS (
  SELECT *, cast(sum(length(s)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, body ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM seg)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(s, '' ORDER BY turn, role, body) AS text,
  coalesce(string_agg((e - length(s) + 14) || '-' || (e - 1), ',' ORDER BY turn, role, body) FILTER (role = speaker), '') AS spans
FROM placed GROUP BY ALL
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    store.write_tokens(table(spark, sf_dir, "documents"), path, tokens.default_path(), end_id=2)
    return store.digest(store.read_tokens(spark, path))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align_tokens(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_language_id, op2_line_dedup, op3_decontamination, op4_chat_rotation, op5_toxicity, op6_license_scan, op7_token_store, op8_simhash, op9_best_fit_packing, op10_quality_rules, op11_conversation_repair, op12_html_extraction, op13_token_alignment)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_rotation": OP4_SQL}
