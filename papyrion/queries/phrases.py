"""Queries on phrases in texts and on requests packed by a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrion.functions import expressions as E
from papyrion.operators import packing, phrases, topics
from papyrion.queries.base import query, table


def _words(spark, d):
    return table(spark, d, "documents").select("doc_id", topics.tokens(F.col("text")).alias("words"))


@query()
def phrase_texts(spark, d):
    """Every document with its phrases joined: tokens, joined ones among them, and a digest of the text."""
    merged, _ = phrases.detect_phrases(_words(spark, d), "doc_id", "words")
    joined = F.size(F.filter("words", lambda t: F.contains(t, F.lit("_"))))
    return merged.select("doc_id", F.size("words").alias("tokens"), joined.alias("phrases"), F.md5(F.array_join("words", " ")).alias("digest"))


@query()
def phrase_matches(spark, d):
    """How often, and in how many documents, the collocations of all documents stand in their texts."""
    docs = table(spark, d, "documents")
    found = phrases.phrase_table(_words(spark, d), "words", key="doc_id")
    hits = phrases.match_phrases(docs, "doc_id", "text", found.select("phrase"))
    return hits.groupBy("phrase").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query("""WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, 120 + greatest(50, length(text) // 4) AS tokens FROM documents),
r AS (SELECT i, 1 AS chunk, tokens AS used FROM t WHERE i = 1
      UNION ALL
      SELECT t.i, CASE WHEN used + tokens > 20000 THEN chunk + 1 ELSE chunk END, CASE WHEN used + tokens > 20000 THEN tokens ELSE used + tokens END
      FROM r JOIN t ON t.i = r.i + 1)
SELECT doc_id, tokens::BIGINT AS tokens, chunk::BIGINT AS chunk FROM t JOIN r USING (i)""")
def packed_requests(spark, d):
    """Requests over all documents, packed in order under a budget of tokens."""
    rows = table(spark, d, "documents").select("doc_id", E.approx_tokens(F.col("text"), 120).alias("tokens"))
    return packing.pack(rows, ["doc_id"], "tokens", 20000)
