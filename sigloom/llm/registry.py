"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import chat, decontamination, fingerprints, html, mixing, ngramjoin, sharding, suffixes, tokenids, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard_documents(table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(chat.probe(spark)))
    return chat.digest(chat.format_turns(turns))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op7_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenids.read_ids(tokenids.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents")).drop("h")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"), kept=False).drop("kept")


QUERIES = {"op2_sharding": op2_sharding, "op5_mixing": op5_mixing, "op8_chat": op8_chat, "op10_html": op10_html, "op3_fingerprints": op3_fingerprints, "op7_tokenids": op7_tokenids, "op1_toxicity": op1_toxicity, "op4_ngram_join": op4_ngram_join, "op6_suffix_dedup": op6_suffix_dedup, "op9_decontamination": op9_decontamination}

#: Where DuckDB can say the same: the Jaccard join by brute force, and the chat digests from the turns themselves.
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
 l AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN ['text:' || text] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
 sh AS (SELECT doc_id, unnest(s) AS s FROM l),
 n AS (SELECT doc_id, len(s) AS n FROM l),
 common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c / (nx.n + ny.n - c) >= 0.8),
 reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, links.y FROM reach r JOIN links ON links.x = r.y),
 class AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1),
 rep AS (SELECT n.doc_id, least(n.doc_id, coalesce(min(y), n.doc_id)) AS rep FROM n LEFT JOIN links ON x = n.doc_id AND same GROUP BY n.doc_id),
 counted AS (SELECT x AS doc_id, count(*) AS n_links, count(DISTINCT rep) FILTER (NOT same) AS text_links, count(*) FILTER (same) AS copies FROM links JOIN rep ON rep.doc_id = y GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(text_links, 0) AS text_links, coalesce(copies, 0) + 1 AS n_copies, doc_id = class_id AS keep FROM class LEFT JOIN counted USING (doc_id)""",
    "op8_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(23 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'gs'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY 1""",
}
