"""Queries on corpora: composition, convergence, growth, ingest and relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrion.functions import expressions as E
from papyrion.operators import composition, convergence, growth, ingest
from papyrion.plans.registry import Panel, scope_bridge, scope_frame
from papyrion.queries.base import LONG, PANELS, PRIORITY, SCOPE_SQL, SCOPES, P, papers, query, table


@query(P + "SELECT status, value, papers, papers / sum(papers) OVER (PARTITION BY status) AS share FROM (SELECT status, priority AS value, count(*) AS papers FROM papers WHERE priority <> '4-NOT SPECIFIED' GROUP BY ALL)")
def distribution_observed(spark, d):
    """The observed distribution of priority for each status."""
    rows = papers(spark, d)
    parts = [composition.distribution(composition.filter_status(rows, s, "status", ("F", "O", "P")), PRIORITY, "observed").withColumn("status", F.lit(s)) for s in ("F", "O", "P")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(P + "SELECT priority AS value, count(*) AS papers, count(*) / sum(count(*)) OVER () AS share FROM papers GROUP BY priority")
def distribution_full(spark, d):
    return composition.distribution(papers(spark, d), PRIORITY, "full")


@query(P + LONG + """, c AS (SELECT panel, value, count(*) AS papers, count(*) FILTER (observed) AS observed_papers FROM long GROUP BY ALL)
SELECT panel, value, papers, observed_papers, papers / sum(papers) OVER (PARTITION BY panel) AS full_share,
CASE WHEN observed_papers > 0 THEN observed_papers / sum(observed_papers) OVER (PARTITION BY panel) END AS observed_share,
CASE WHEN observed_papers > 0 THEN row_number() OVER (PARTITION BY panel ORDER BY observed_papers DESC, value) END AS rank,
observed_papers > 0 AND row_number() OVER (PARTITION BY panel ORDER BY observed_papers DESC, value) <= CASE panel WHEN 'priority' THEN 3 WHEN 'status' THEN 2 ELSE 4 END AS charted FROM c""")
def panel_composition(spark, d):
    return composition.composition(papers(spark, d), PANELS)


@query(P + """, c AS (SELECT priority AS row_value, journal AS column_value, count(*) AS n FROM papers WHERE priority <> '4-NOT SPECIFIED' GROUP BY ALL),
g AS (SELECT row_value, column_value FROM (SELECT DISTINCT row_value FROM c), (SELECT DISTINCT column_value FROM c)),
x AS (SELECT g.row_value, g.column_value, coalesce(n, 0)::BIGINT AS papers FROM g LEFT JOIN c USING (row_value, column_value))
SELECT *, papers / sum(papers) OVER () AS share_of_analyzed, papers / sum(papers) OVER (PARTITION BY row_value) AS share_within_row,
papers / sum(papers) OVER (PARTITION BY column_value) AS share_within_column FROM x""")
def relationship_matrix_dense(spark, d):
    return composition.relationship_matrix(papers(spark, d), PRIORITY, Panel("journal", "journal"), "observed")


@query(P + """SELECT * FROM (SELECT priority, status, segment, count(*) AS papers, count(*) / sum(count(*)) OVER () AS share FROM papers
WHERE priority <> '4-NOT SPECIFIED' AND status <> 'P' GROUP BY ALL) WHERE papers >= 10""")
def recurring_configurations(spark, d):
    return composition.recurring_configurations(papers(spark, d), PANELS, "observed", 10)


@query(P + LONG + """SELECT control, control_value, outcome, outcome_value, papers, observed_papers, papers / sum(papers) OVER w AS share,
CASE WHEN sum(observed_papers) OVER w > 0 THEN observed_papers / sum(observed_papers) OVER w ELSE 0 END AS observed_share FROM (
SELECT a.panel AS control, a.value AS control_value, b.panel AS outcome, b.value AS outcome_value, count(*) AS papers, count(*) FILTER (a.observed AND b.observed) AS observed_papers
FROM long a JOIN long b ON a.paper_id = b.paper_id AND a.panel <> b.panel GROUP BY ALL) WINDOW w AS (PARTITION BY control, control_value, outcome)""")
def nested_distributions(spark, d):
    return composition.nested_distributions(papers(spark, d), PANELS, "paper_id")


@query(SCOPE_SQL + LONG + """SELECT population, control, control_value, outcome, outcome_value, papers, observed_papers, papers / sum(papers) OVER w AS share,
CASE WHEN sum(observed_papers) OVER w > 0 THEN observed_papers / sum(observed_papers) OVER w ELSE 0 END AS observed_share FROM (
SELECT s.scope AS population, a.panel AS control, a.value AS control_value, b.panel AS outcome, b.value AS outcome_value,
count(*) AS papers, count(*) FILTER (a.observed AND b.observed) AS observed_papers
FROM scoped s JOIN long a ON a.paper_id = s.paper_id JOIN long b ON b.paper_id = a.paper_id AND a.panel <> b.panel GROUP BY ALL)
WINDOW w AS (PARTITION BY population, control, control_value, outcome)""")
def population_tables(spark, d):
    """Every panel by every other, in four overlapping populations and both views."""
    return composition.population_tables(papers(spark, d), PANELS, list(SCOPES.values()))


@query(P + "SELECT paper_id, year, citations FROM papers WHERE priority = '2-HIGH' AND status = 'O' AND year >= 1999")
def evidence_rows(spark, d):
    rows = scope_frame(papers(spark, d), SCOPES, "recent")
    return composition.evidence(rows, {"priority": "2-HIGH", "status": "O", "absent": "x"}).select("paper_id", "year", "citations")


@query(P + "SELECT paper_id, year, citations, journal FROM papers WHERE segment = 'BUILDING' ORDER BY year DESC, citations DESC, journal LIMIT 50")
def evidence_ordered(spark, d):
    rows = composition.evidence(papers(spark, d), {"segment": "BUILDING"}, strict=True)
    return composition.ordered_evidence(rows, "year", "citations", "journal", 50).select("paper_id", "year", "citations", "journal")


@query(P + "SELECT DISTINCT journal AS value FROM papers")
def distinct_values(spark, d):
    return composition.distinct_values(papers(spark, d), "journal")


@query(SCOPE_SQL + "SELECT scope, count(*) AS papers, count(DISTINCT journal) AS journals FROM scoped GROUP BY scope")
def scope_counts(spark, d):
    rows = scope_bridge(papers(spark, d), SCOPES, ["paper_id", "journal"])
    return rows.groupBy("scope").agg(F.count("*").alias("papers"), F.count_distinct("journal").alias("journals"))


@query(P + """, f AS (SELECT priority IN ('1-URGENT', '2-HIGH') AS urgent, status = 'O' AS open_, year >= 1999 AS recent FROM papers),
s AS (SELECT 'urgent' AS left_scope, 'open' AS right_scope, count(*) FILTER (urgent) AS left_n, count(*) FILTER (open_) AS right_n, count(*) FILTER (urgent AND open_) AS both_n FROM f
UNION ALL SELECT 'urgent', 'recent', count(*) FILTER (urgent), count(*) FILTER (recent), count(*) FILTER (urgent AND recent) FROM f
UNION ALL SELECT 'open', 'recent', count(*) FILTER (open_), count(*) FILTER (recent), count(*) FILTER (open_ AND recent) FROM f)
SELECT *, left_n + right_n - both_n AS union_n, both_n / (left_n + right_n - both_n) AS jaccard FROM s""")
def scope_overlap_jaccard(spark, d):
    return composition.pairwise_overlap(papers(spark, d), {"urgent": "priority IN ('1-URGENT', '2-HIGH')", "open": "status = 'O'", "recent": "year >= 1999"})


@query(P + """, v AS (SELECT journal AS g, 'priority' AS c, priority AS v FROM papers UNION ALL SELECT journal, 'status', status FROM papers UNION ALL SELECT journal, 'segment', segment FROM papers),
n AS (SELECT g, c, v, count(*) AS n FROM v GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY g, c) AS p FROM n),
s AS (SELECT g, c, CASE WHEN count(*) > 1 THEN 1 - sum(-p * log2(p)) / log2(count(*)) ELSE 1 END AS s FROM p GROUP BY ALL),
z AS (SELECT journal, count(*) AS papers FROM papers GROUP BY journal HAVING count(*) >= 2)
SELECT journal AS "group", papers, round(avg(round(s, 4)), 4) AS convergence, round(1 - round(avg(round(s, 4)), 4), 4) AS fragmentation FROM z JOIN s ON g = journal GROUP BY ALL""")
def group_convergence(spark, d):
    return convergence.convergence_by(papers(spark, d), ["priority", "status", "segment"], "journal")


@query(P + """, n AS (SELECT 'all' AS g, c, v, count(*) AS n FROM (SELECT 'priority' AS c, priority AS v FROM papers UNION ALL SELECT 'segment', segment FROM papers) GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY c) AS t, n / sum(n) OVER (PARTITION BY c) AS p, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS r FROM n)
SELECT g AS "group", c AS "column", max(t)::BIGINT AS total, count(*) AS unique_values, max(v) FILTER (r = 1) AS dominant_value, max(p) AS dominant_share,
round(sum(-p * log2(p)) / log2(count(*)), 6) AS normalized_entropy, round(1 - sum(-p * log2(p)) / log2(count(*)), 6) AS convergence FROM p GROUP BY ALL""")
def dimension_profile(spark, d):
    out = convergence.summaries(papers(spark, d), ["priority", "segment"])
    return out.withColumn("normalized_entropy", F.round("normalized_entropy", 6)).withColumn("convergence", F.round("convergence", 6))


@query(P + """, n AS (SELECT journal AS shared_value, priority AS contrast_value, count(*) AS papers FROM papers GROUP BY ALL),
r AS (SELECT journal AS shared_value, priority AS contrast_value, paper_id, row_number() OVER (PARTITION BY journal, priority ORDER BY paper_id) AS r FROM papers)
SELECT n.shared_value, n.contrast_value, papers, count(*) OVER (PARTITION BY n.shared_value) AS contrast_values, (sum(papers) OVER (PARTITION BY n.shared_value))::BIGINT AS shared_papers, example_ids
FROM n JOIN (SELECT shared_value, contrast_value, string_agg(paper_id, ';' ORDER BY paper_id) AS example_ids FROM r WHERE r <= 5 GROUP BY ALL) e USING (shared_value, contrast_value)""")
def construct_contrast(spark, d):
    return convergence.construct_contrast(papers(spark, d), "journal", "priority", "paper_id")


@query(P + """, base AS (SELECT priority AS value, count(*) / sum(count(*)) OVER () AS b FROM papers WHERE priority <> '4-NOT SPECIFIED' GROUP BY priority),
br AS (SELECT DISTINCT l_orderkey AS paper_id, p_type AS "group" FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT "group", priority AS value, count(*) AS n FROM papers JOIN br USING (paper_id) WHERE priority <> '4-NOT SPECIFIED' GROUP BY ALL),
g AS (SELECT "group", value, b, coalesce(n, 0)::BIGINT AS papers FROM (SELECT DISTINCT "group" FROM br) CROSS JOIN base LEFT JOIN c USING ("group", value)),
s AS (SELECT *, papers / sum(papers) OVER (PARTITION BY "group") AS share FROM g)
SELECT "group", value, papers, share, b AS baseline_share, (share - b) * 100 AS difference_pp FROM s""")
def horizontal_contrast(spark, d):
    bridge = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper_id"), "p_type")
    return composition.horizontal_contrast(papers(spark, d), bridge, PRIORITY, "paper_id", "p_type")


@query(P + """, a AS (SELECT journal AS k, count(*) AS n FROM papers WHERE year <= 1997 GROUP BY 1), b AS (SELECT journal AS k, count(*) AS n FROM papers WHERE year >= 2000 GROUP BY 1),
s AS (SELECT coalesce(a.n, 0) / sum(a.n) OVER () AS p, coalesce(b.n, 0) / sum(b.n) OVER () AS q FROM a FULL JOIN b USING (k))
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 9) AS js_divergence FROM s""")
def js_divergence(spark, d):
    rows = papers(spark, d)
    counts = lambda r: r.groupBy("journal").agg(F.count("*").alias("n"))
    aligned = composition.count_alignment(counts(rows.where("year <= 1997")), counts(rows.where("year >= 2000")), "journal")
    return composition.js_divergence(aligned).withColumn("js_divergence", F.round("js_divergence", 9))


@query(P + """, a AS (SELECT journal, count(*) AS n FROM papers WHERE year <= 1997 GROUP BY 1), b AS (SELECT journal, count(*) AS n FROM papers WHERE year >= 2000 AND journal <> 'NATION_3' GROUP BY 1),
s AS (SELECT journal, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM a FULL JOIN b USING (journal)), t AS (SELECT *, left_n / sum(left_n) OVER () AS left_share, right_n / sum(right_n) OVER () AS right_share FROM s)
SELECT *, (right_share - left_share) * 100 AS difference_pp, CASE WHEN left_share > 0 THEN right_share / left_share END AS ratio FROM t""")
def count_alignment(spark, d):
    rows = papers(spark, d)
    counts = lambda r: r.groupBy("journal").agg(F.count("*").alias("n"))
    return composition.count_alignment(counts(rows.where("year <= 1997")), counts(rows.where("year >= 2000 AND journal <> 'NATION_3'")), "journal")


@query(P + "SELECT count(*) AS papers, round(sum(citations), 2) AS citations, round(avg(citations), 6) AS mean_citations, median(citations) AS median_citations, avg((citations > 0)::INT) AS cited_share, min(year) AS first_year, max(year) AS last_year FROM papers")
def performance_summary(spark, d):
    out = growth.performance_summary(papers(spark, d), "citations", "year")
    return out.withColumn("citations", F.round("citations", 2)).withColumn("mean_citations", F.round("mean_citations", 6))


@query(P + ", n AS (SELECT year, count(*) AS papers FROM papers GROUP BY year) SELECT year, papers, (sum(papers) OVER (ORDER BY year))::BIGINT AS cumulative FROM n")
def annual_production(spark, d):
    return growth.annual_production(papers(spark, d), "year")


@query(P + """, w AS (SELECT 1996 AS start_year, 1998 AS end_year UNION ALL SELECT 1998, 2001 UNION ALL SELECT 1990, 1995),
s AS (SELECT start_year, end_year, (SELECT count(*) FROM papers WHERE year <= start_year) AS start_stock, (SELECT count(*) FROM papers WHERE year <= end_year) AS end_stock FROM w)
SELECT *, end_stock - start_stock AS added, CASE WHEN start_stock > 0 THEN (end_stock - start_stock) / start_stock END AS growth FROM s""")
def growth_periods(spark, d):
    return growth.growth_periods(papers(spark, d), "year", [(1996, 1998), (1998, 2001), (1990, 1995)])


@query(SCOPE_SQL + """, g AS (SELECT DISTINCT scope FROM scoped), y AS (SELECT unnest(range(1997, 2002))::INT AS year),
n AS (SELECT scope, year, count(*) AS n FROM scoped GROUP BY ALL)
SELECT g.scope AS "group", y.year, coalesce(n.n, 0)::BIGINT AS added, (SELECT count(*) FROM scoped s WHERE s.scope = g.scope AND s.year <= y.year) AS cumulative FROM g, y LEFT JOIN n ON n.scope = g.scope AND n.year = y.year""")
def cumulative_trace(spark, d):
    return growth.cumulative_trace(scope_bridge(papers(spark, d), SCOPES, ["paper_id", "year"]), "year", 1997, 2001, "scope")


@query(P + "SELECT journal AS value, count(*) AS papers FROM papers GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_groups(spark, d):
    return growth.top_groups(papers(spark, d), F.col("journal"), 10)


@query(P + "SELECT paper_id, citations, journal FROM papers ORDER BY citations DESC, paper_id LIMIT 20")
def most_cited(spark, d):
    return growth.most_cited(papers(spark, d), "citations", "paper_id", 20).select("paper_id", "citations", "journal")


@query("""WITH w AS (SELECT sha256(lower(trim(regexp_replace(text, '[\\x{1C}-\\x{1F}\\t-\\r \\x{85}\\p{Z}]+', ' ', 'g')))) AS k, source, doc_id FROM documents),
m AS (SELECT k, min(doc_id) AS doc_id, string_agg(DISTINCT source, ';' ORDER BY source) AS query_sources, count(DISTINCT source)::INT AS query_count,
bool_or(source = 'src0')::INT AS in_src0 FROM w GROUP BY k)
SELECT doc_id, k AS dedup_key, query_sources, query_count, in_src0 FROM m""")
def membership_flags(spark, d):
    """Documents with the same text but for case and white space are one record, found by several sources."""
    key = F.sha2(F.lower(E.collapse_space(F.col("text"))), 256)
    docs = table(spark, d, "documents").select("doc_id", "source", key.alias("dedup_key"))
    out = ingest.merge_queries(docs, "dedup_key", "source", [F.col("doc_id")], [f"src{i}" for i in range(20)])
    return out.select("doc_id", "dedup_key", "query_sources", "query_count", "in_src0")


@query("SELECT c_nationkey AS k, min(c_custkey) AS first_seen, arg_min(CASE WHEN c_acctbal > 0 THEN c_name END, CASE WHEN c_acctbal > 0 THEN c_custkey END) AS name, arg_min(c_mktsegment, c_custkey) AS segment FROM customer GROUP BY 1")
def dedup_coalesce_blanks(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(" ").alias("name"), F.col("c_mktsegment").alias("segment"))
    return ingest.merge_filling_blanks(rows, "k", F.col("c_custkey"), ["name", "segment"])


@query("SELECT c_custkey, c_nationkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def dedup_first_wins(spark, d):
    return ingest.first_wins(table(spark, d, "customer"), "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "c_nationkey", "c_name")


_TERMS = {"primary": ["the", "les"], "secondary": ["and", "of the", "that"], "strong": ["idiot", "scum*"], "broad": ["ing*"]}


def _count_sql(name, terms):
    tests = {t: r"(^|[^\p{L}\p{M}\p{N}_])" + t.replace("*", r"[\p{L}\p{M}\p{N}_]*").replace(" ", r"\s+") + r"($|[^\p{L}\p{M}\p{N}_])" for t in terms}
    return " + ".join(f"regexp_matches(b, '{p}')::INT" for p in tests.values())


@query("WITH d AS (SELECT doc_id, lower(text) AS b FROM documents), c AS (SELECT doc_id, "
       + ", ".join(f"{_count_sql(g, t)} AS {g}_count" for g, t in _TERMS.items())
       + " FROM d), s AS (SELECT *, primary_count >= 1 AND (strong_count >= 1 OR secondary_count >= 2) AS strict FROM c) SELECT *, strict OR (primary_count >= 1 AND broad_count >= 1) AS broad FROM s")
def relevance_scores(spark, d):
    out = ingest.score_relevance(table(spark, d, "documents"), F.col("text"), _TERMS)
    return out.select("doc_id", *[f"{g}_count" for g in _TERMS], "strict", "broad")


@query("""WITH u AS (SELECT DISTINCT p_brand AS title FROM part WHERE p_size < 5) SELECT p_partkey, coalesce(title IS NOT NULL, false)::INT AS source_valid, title AS matched_title FROM part LEFT JOIN u ON lower(p_brand) = lower(title)""")
def source_title_validation(spark, d):
    part = table(spark, d, "part")
    universe = part.where("p_size < 5").select(F.col("p_brand").alias("title")).distinct()
    return ingest.validate_titles(part.select("p_partkey", F.upper("p_brand").alias("b")), universe, F.col("b"), E.norm_title_registry).select("p_partkey", "source_valid", "matched_title")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_flatten(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
