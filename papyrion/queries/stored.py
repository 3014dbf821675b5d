"""Queries on stored frames, scope maps and topic runs; each writes what it needs in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrion.functions import expressions as E
from papyrion.operators import runs, topics
from papyrion.plans.freshness import FrameStore
from papyrion.plans.registry import Scope
from papyrion.plans.tables import new_path, shared_folder
from papyrion.queries.base import ORACLE_SQL, QUERIES, query, table
from papyrion.sources.sinks import filter_scopes
from papyrion.streaming import results


@query(ORACLE_SQL["rater_frame"])
def stored_rater_frame(spark, d):
    """rater_frame from a store that builds it once for each state of the tables' files."""
    store = FrameStore(spark, f"{shared_folder(spark)}/frames")
    return store.frame("rater_frame", [f"{d}/{t}.parquet" for t in ("orders", "customer", "nation", "lineitem")], lambda: QUERIES["rater_frame"](spark, d))


@query(r"""WITH p AS (SELECT *, regexp_replace(regexp_replace(url, '^https?://', ''), '[^0-9A-Za-z]+', '.', 'g') AS u FROM pages),
s AS (SELECT 'secure' AS scope, * FROM p WHERE url LIKE 'https:%' UNION ALL SELECT 'short', * FROM p WHERE length(html) < 4000),
m AS (SELECT DISTINCT u FROM p WHERE contains(url, 'utm_source'))
SELECT scope, 'filtered' AS status, (SELECT count(*) FROM m)::BIGINT AS map_dois, count(*) AS scope_papers, count(*) FILTER (u IN (FROM m)) AS retained, count(*) FILTER (u NOT IN (FROM m)) AS dropped,
round(count(*) FILTER (u IN (FROM m)) / count(*), 4) AS retained_share FROM s GROUP BY scope UNION ALL SELECT 'all', 'missing', NULL, NULL, NULL, NULL, NULL""")
def scope_map_filter(spark, d):
    """Pages by scope, split by a map of the pages that a campaign links to; a scope without a map is reported as such."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[^0-9A-Za-z]+", ".")
    pages = table(spark, d, "pages").withColumn("doi", F.concat(F.lit("https://doi.org/10.5555/"), path))
    place = new_path(spark, "scope-maps")
    pages.where(F.contains("url", F.lit("utm_source"))).select("doi").write.option("header", True).csv(f"{place}/map")
    scopes = [Scope("secure", lambda: F.col("url").startswith("https:")), Scope("short", lambda: F.char_length("html") < 4000), Scope("all", lambda: F.lit(True))]
    return filter_scopes(pages, F.col("doi"), scopes, {s: f"{place}/map" for s in ("secure", "short")}, f"{d}/pages.parquet", f"{place}/scopes")


def stored_run(spark, d, k=8, dimensions=16):
    """A run over the embeddings, with counts of two words in the documents of their ids as term families."""
    folder = new_path(spark, "topic-run")
    words = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), topics.tokens(F.col("text")).alias("w"))
    counts = {w: words.select("vec_id", F.size(F.filter("w", lambda x: x == w)).alias("n")) for w in ("the", "and")}  # noqa: B023
    runs.save_run(table(spark, d, "embeddings"), "vec_id", "embedding", folder, k, counts, dimensions=dimensions)
    return folder


@query()
def topic_rerun(spark, d):
    """Topics of the embeddings by a stored run that is loaded and applied again."""
    return runs.rerun(spark, stored_run(spark, d), table(spark, d, "embeddings")).withColumn("probability", F.round("probability", 6))


@query()
def topic_rerun_terms(spark, d):
    """Topics of a stored run by papers with two or more of both words, from the stored tables alone."""
    return runs.refiltered(spark, stored_run(spark, d), "the", "and", 2)


@query("""WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, 120 + greatest(50, length(text) // 4) AS tokens
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)),
r AS (SELECT i, 1 AS chunk, tokens AS used FROM t WHERE i = 1
      UNION ALL
      SELECT t.i, CASE WHEN used + tokens > 20000 THEN chunk + 1 ELSE chunk END, CASE WHEN used + tokens > 20000 THEN tokens ELSE used + tokens END
      FROM r JOIN t ON t.i = r.i + 1)
SELECT doc_id, tokens::BIGINT AS tokens, chunk::BIGINT AS chunk FROM t JOIN r USING (i)""")
def open_requests(spark, d):
    """Requests over all documents of which the labelled ones have results, toxic ones failed ones: a stream takes
    the result files in, and what is open is packed for the next submission."""
    place = new_path(spark, "results")
    status = F.when(F.col("toxic") == 0, 200).otherwise(429)
    body = F.struct(F.lit("coded").alias("output_text"), F.struct(F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens")).alias("usage"))
    line = F.struct(F.col("doc_id").cast("string").alias("custom_id"), F.struct(status.alias("status_code"), body.alias("body")).alias("response"))
    table(spark, d, "labels").select(F.to_json(line)).write.text(f"{place}/inbox")
    results.guarded_ingest(spark, f"{place}/inbox", f"{place}/log", f"{place}/mark", share=1.0)
    wanted = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("custom_id"), E.approx_tokens(F.col("text"), 120).alias("tokens"))
    return results.open_requests(wanted, spark.read.parquet(f"{place}/log"), ["doc_id"], "tokens", 20000).select("doc_id", "tokens", "chunk")
