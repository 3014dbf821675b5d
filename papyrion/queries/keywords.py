"""Queries on keywords, domains, sampling and curation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyrion.functions import expressions as E
from papyrion.operators import domains, growth, ingest, keywords, sampling
from papyrion.plans.tables import spread, written
from papyrion.queries.base import P, papers, query, table

_BRIDGE = """WITH b AS (SELECT DISTINCT l_orderkey AS paper_id, year(o_orderdate)::INT AS year, unnest(string_split(p_name, ' ')) AS keyword
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
"""
_PERIODS = [("early", None, 1996), ("middle", 1997, 1999), ("late", 2000, None)]
_GRID = _BRIDGE + """, r AS (SELECT *, CASE WHEN year <= 1996 THEN 'early' WHEN year <= 1999 THEN 'middle' ELSE 'late' END AS period FROM b),
z AS (SELECT period, count(DISTINCT paper_id) AS denominator FROM r GROUP BY 1), n AS (SELECT period, keyword, count(DISTINCT paper_id) AS papers FROM r GROUP BY ALL),
o AS (SELECT * FROM (VALUES (0, 'early'), (1, 'middle'), (2, 'late')) AS v(place, period)),
g AS (SELECT place, o.period, k.keyword, coalesce(papers, 0)::BIGINT AS papers, denominator FROM o CROSS JOIN (SELECT DISTINCT keyword FROM n) k LEFT JOIN n ON n.period = o.period AND n.keyword = k.keyword JOIN z ON z.period = o.period),
v AS (SELECT *, papers / denominator AS prevalence FROM g),
p AS (SELECT period, keyword, papers, denominator, prevalence, lag(papers) OVER w AS previous_papers, (prevalence - lag(prevalence) OVER w) * 100 AS change_pp,
row_number() OVER (PARTITION BY period ORDER BY papers DESC, keyword) AS rank FROM v WINDOW w AS (PARTITION BY keyword ORDER BY place))
"""


def _items(spark, d):
    """Line items with their parts, an order's in one task, and a task's share of them the same at any size."""
    items, part, orders = (table(spark, d, t) for t in ("lineitem", "part", "orders"))
    n = items.count()
    rows = spread(items.select("l_orderkey", "l_partkey"), ["l_partkey"], n).join(part.select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return spread(rows.select("l_orderkey", "p_name", "p_type"), ["l_orderkey"], n), orders


def bridge(spark, d):
    rows, orders = _items(spark, d)
    rows = rows.select("l_orderkey", "p_name").distinct().join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("l_orderkey").alias("paper_id"), F.year("o_orderdate").cast("int").alias("year"), F.translate("p_name", " ", ";").alias("words"))
    return keywords.keyword_bridge(rows, ["words"], ["paper_id", "year"])


@query(_GRID + "SELECT * FROM p")
def keyword_period_prevalence(spark, d):
    rows = bridge(spark, d).select("paper_id", "year", "keyword")
    return keywords.prevalence(rows, "paper_id", E.period(F.col("year"), _PERIODS), [p[0] for p in _PERIODS])


@query(_GRID + """, m AS (SELECT *, CASE WHEN change_pp > 0 THEN 'emerging' ELSE 'declining' END AS direction FROM p WHERE greatest(papers, previous_papers) >= 10 AND change_pp <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY period, direction ORDER BY abs(change_pp) DESC, papers DESC, keyword) AS place FROM m) SELECT period, direction, place, keyword, papers FROM q WHERE place <= 5""")
def keyword_movers(spark, d):
    rows = keywords.prevalence(bridge(spark, d), "paper_id", E.period(F.col("year"), _PERIODS), [p[0] for p in _PERIODS])
    return keywords.movers(rows, 10, 5).select("period", "direction", "place", "keyword", "papers")


@query(_BRIDGE + "SELECT keyword, count(DISTINCT paper_id) AS papers, (SELECT count(DISTINCT paper_id) FROM b WHERE year = 1998) AS denominator, count(DISTINCT paper_id) / (SELECT count(DISTINCT paper_id) FROM b WHERE year = 1998) AS prevalence FROM b WHERE year = 1998 GROUP BY keyword ORDER BY papers DESC, keyword LIMIT 8")
def keyword_year(spark, d):
    return keywords.keyword_year(bridge(spark, d), "paper_id", "year", 1998, 8)


@query(_BRIDGE + "SELECT keyword, count(DISTINCT paper_id) AS papers FROM b WHERE contains(keyword, 'g') GROUP BY keyword ORDER BY keyword <> 'g', NOT starts_with(keyword, 'g'), papers DESC, keyword LIMIT 6")
def keyword_search(spark, d):
    return keywords.search_keywords(bridge(spark, d), "g", 6)


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS raw FROM documents),
c AS (SELECT raw, count(DISTINCT doc_id) AS papers, replace(lower(raw), 'ß', 'ss') AS canonical FROM w GROUP BY raw),
f AS (SELECT raw, papers, CASE canonical WHEN 'thes' THEN 'the' WHEN 'ands' THEN 'and' ELSE canonical END AS canonical FROM c)
SELECT raw, papers, canonical, count(*) OVER (PARTITION BY canonical) AS variants FROM f""")
def keyword_variants(spark, d):
    """Words of texts as keywords, normalised once per different word."""
    docs = table(spark, d, "documents")
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    counts = docs.select(F.explode(F.array_distinct(words)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("papers"))
    counts = written(counts, "keyword-counts")
    return keywords.variant_audit(counts, keywords.canonical_terms(counts, "keyword", {"thes": "the"}, {}, {"ands": "and"}))


@query("WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS c FROM part UNION SELECT 'rings') SELECT a.c AS singular, b.c AS plural FROM t b JOIN t a ON b.c = a.c || 's'")
def unresolved_plurals(spark, d):
    terms = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("canonical")).unionByName(spark.createDataFrame([("rings",)], "canonical string"))
    return keywords.unresolved_plurals(terms)


_RULES = [("PROMO", "offer"), ("ECONOMY", "offer"), ("STANDARD", "core"), ("ECONOMY", "core")]


@query("""WITH r AS (SELECT * FROM (VALUES ('PROMO', 'offer'), ('ECONOMY', 'offer'), ('STANDARD', 'core'), ('ECONOMY', 'core')) AS v(code, domain)),
x AS (SELECT DISTINCT l_orderkey, p_type AS code FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, domain, string_agg(code, ';' ORDER BY code) AS basis FROM x JOIN r USING (code) GROUP BY ALL""")
def domain_assignment_multilabel(spark, d):
    rows, _ = _items(spark, d)
    return domains.assign_by_codes(rows, "l_orderkey", F.col("p_type"), spark.createDataFrame(_RULES, "code string, domain string"))


@query("""WITH r AS (SELECT * FROM (VALUES ('PROMO', 'offer'), ('ECONOMY', 'offer'), ('STANDARD', 'core'), ('ECONOMY', 'core')) AS v(code, domain)),
x AS (SELECT DISTINCT l_orderkey, domain FROM lineitem JOIN part ON l_partkey = p_partkey JOIN r ON p_type = code),
c AS (SELECT domain, count(DISTINCT l_orderkey) AS papers FROM x GROUP BY 1 UNION ALL SELECT '(residual)', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM x))
SELECT domain, papers, papers / (SELECT count(*) FROM orders) AS share FROM c""")
def domain_coverage_residual(spark, d):
    assigned = domain_assignment_multilabel(spark, d).withColumnRenamed("l_orderkey", "o_orderkey")
    return domains.domain_coverage(table(spark, d, "orders"), assigned, "o_orderkey")


@query("""WITH a AS (SELECT * FROM (VALUES ('NATION_1', 'n one')) AS v(registered_title, corpus_title)),
c AS (SELECT c_custkey, CASE n_name WHEN 'NATION_1' THEN 'n one' ELSE lower(n_name) END AS t FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT lower(n_name) AS t, r_name AS domain, 'title' AS basis FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT corpus_title, r_name, 'alias' FROM a JOIN nation ON n_name = registered_title JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, domain, max(basis) AS basis FROM c JOIN g USING (t) GROUP BY ALL""")
def domain_assignment_titles(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("title", F.when(F.col("n_name") == "NATION_1", "N  one").otherwise(F.col("n_name")))
    registry = nation.select(F.col("n_name").alias("title"), F.col("r_name").alias("domain"))
    aliases = spark.createDataFrame([("NATION_1", "n One")], "registered_title string, corpus_title string")
    return domains.assign_by_titles(rows, "c_custkey", F.col("title"), registry, aliases, E.norm_title_registry)


@query(P + """, f AS (SELECT *, (status = 'O')::INT AS is_open, (year >= 1999)::INT AS is_recent FROM papers)
SELECT paper_id, 'open' AS domain FROM f WHERE is_open = 1 UNION ALL SELECT paper_id, 'recent' FROM f WHERE is_recent = 1""")
def unpivot_flags(spark, d):
    rows = papers(spark, d).select("paper_id", (F.col("status") == "O").cast("int").alias("is_open"), (F.col("year") >= 1999).cast("int").alias("is_recent"))
    return domains.unpivot_flags(rows, "paper_id", {"is_open": "open", "is_recent": "recent"})


@query(P + """, r AS (SELECT priority AS value, 'open' AS population FROM papers WHERE status = 'O' UNION ALL SELECT priority, 'recent' FROM papers WHERE year >= 1999
UNION ALL SELECT priority, 'union' FROM papers WHERE status = 'O' OR year >= 1999), n AS (SELECT value, population, count(*) AS papers FROM r GROUP BY ALL),
s AS (SELECT *, papers / sum(papers) OVER (PARTITION BY population) AS share FROM n)
SELECT value, population, papers, share, (share - max(CASE WHEN population = 'union' THEN share END) OVER (PARTITION BY value)) * 100 AS difference_pp FROM s""")
def union_comparison(spark, d):
    return domains.union_comparison(papers(spark, d), {"open": F.col("status") == "O", "recent": F.col("year") >= 1999}, F.col("priority"))


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, text FROM benchmark),
t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS b
      FROM documents d JOIN b ON b.place = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 1 END AS overlap,
       CASE WHEN len(a) > 0 AND len(list_intersect(a, b)) / len(a) < 0.5 THEN 'GROUNDING_LOW' ELSE '' END AS issues FROM t""")
def evidence_grounding(spark, d):
    """Documents as evidence, each grounded in one of the benchmark texts, which are few."""
    items = table(spark, d, "benchmark")
    source = items.select(F.col("text").alias("source_text"), (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("place"))
    place = F.pmod("doc_id", F.lit(items.count()))
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("evidence"), F.lit("inferred").alias("kind"), F.lit(0.5).alias("confidence"), place.alias("place")).join(source, "place")
    out = domains.validate_evidence(rows, "evidence", "source_text", "kind", "confidence", F.lit(False))
    return out.select("doc_id", "overlap", "issues")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag AS value, CASE WHEN l_linestatus = 'O' THEN 'stated' ELSE 'inferred' END AS evidence_type, l_discount * 10 AS confidence FROM lineitem),
d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN 'X' END AS decision, l_tax < 0.01 AS deferred FROM lineitem WHERE l_tax > 0.07 OR l_tax < 0.01),
s AS (SELECT c.*, decision, CASE WHEN decision IS NOT NULL THEN 'decided' WHEN coalesce(deferred, false) THEN 'deferred' WHEN evidence_type = 'stated' AND confidence >= 0.8 THEN 'accepted' ELSE 'unreviewed' END AS status FROM c LEFT JOIN d USING (l_orderkey, l_linenumber))
SELECT status, coalesce(CASE status WHEN 'decided' THEN decision WHEN 'accepted' THEN value END, '-') AS final_value, count(*) AS n FROM s GROUP BY ALL""")
def review_queue(spark, d):
    li = table(spark, d, "lineitem")
    codes = li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("value"), F.when(F.col("l_linestatus") == "O", "stated").otherwise("inferred").alias("evidence_type"), (F.col("l_discount") * 10).alias("confidence"))
    decisions = li.where("l_tax > 0.07 OR l_tax < 0.01").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.07, "X").alias("decision"), (F.col("l_tax") < 0.01).alias("deferred"))
    out = domains.review_queue(codes, decisions, ["l_orderkey", "l_linenumber"])
    return out.groupBy("status", F.coalesce("final_value", F.lit("-")).alias("final_value")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount, l_linenumber) = 1")
def retained_relations(spark, d):
    out = domains.select_retained(table(spark, d, "lineitem"), "l_orderkey", [F.desc("l_quantity"), F.asc("l_discount"), F.asc("l_linenumber")])
    return out.select("l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH p AS (SELECT o_orderkey, o_custkey, o_orderstatus AS f1, o_orderpriority AS f2 FROM orders),
m AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT o_custkey, o_orderstatus AS f1, o_orderpriority AS f2 FROM orders WHERE o_orderpriority <> '5-LOW'),
x AS (SELECT p.o_orderkey, m.o_custkey AS k, p.f1 AS a1, p.f2 AS a2, r.f1 AS b1, r.f2 AS b2 FROM p LEFT JOIN m ON m.o_orderkey = p.o_orderkey LEFT JOIN r ON r.o_custkey = m.o_custkey)
SELECT o_orderkey, bool_or(k IS NOT NULL) AS in_master, count(b1) AS raw_rows, coalesce(bool_or(a1 = b1), false) AS o_orderstatus_matches, coalesce(bool_or(a2 = b2), false) AS o_orderpriority_matches, coalesce(bool_or(a1 = b1 AND a2 = b2), false) AS all_in_one_row FROM x GROUP BY 1""")
def provenance_audit(spark, d):
    orders = table(spark, d, "orders")
    return ingest.provenance_audit(orders, orders.where("o_orderstatus <> 'P'"), orders.where("o_orderpriority <> '5-LOW'"), "o_orderkey", "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("""WITH o AS (SELECT p_partkey AS record_id, p_brand AS title, (p_partkey % 900)::VARCHAR AS issn, (p_size + 5000)::VARCHAR AS eissn FROM part),
q AS (SELECT DISTINCT p_brand AS title, (p_partkey % 950)::VARCHAR AS issn FROM part),
i AS (SELECT DISTINCT record_id, title AS t, unnest([issn, eissn]) AS i FROM o),
e AS (SELECT t, i, CASE WHEN count(DISTINCT record_id) = 1 THEN min(record_id) END AS r FROM i GROUP BY ALL),
b AS (SELECT title AS t, CASE WHEN count(DISTINCT record_id) = 1 THEN min(record_id) END AS r FROM o GROUP BY ALL),
s AS (SELECT i, CASE WHEN count(DISTINCT record_id) = 1 THEN min(record_id) END AS r FROM i GROUP BY ALL),
m AS (SELECT q.title, q.issn, e.r AS er, CASE WHEN q.issn = '949' THEN -1 END AS vr, b.r AS br, s.r AS sr FROM q LEFT JOIN e ON e.t = q.title AND e.i = q.issn LEFT JOIN b ON b.t = q.title LEFT JOIN s ON s.i = q.issn)
SELECT title, issn, coalesce(er, vr, br, sr)::BIGINT AS record_id, CASE WHEN er IS NOT NULL THEN 'exact' WHEN vr IS NOT NULL THEN 'override' WHEN br IS NOT NULL THEN 'title_only' WHEN sr IS NOT NULL THEN 'issn_only' ELSE 'unresolved' END AS match,
er IS NULL AND vr IS NULL AND (br IS NOT NULL OR sr IS NOT NULL) AS review_required, er IS NULL AND br IS NOT NULL AS identifier_conflict FROM m""")
def source_crosswalk(spark, d):
    part = table(spark, d, "part")
    official = part.select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("title"), (F.col("p_partkey") % 900).cast("string").alias("issn"), (F.col("p_size") + 5000).cast("string").alias("eissn"))
    pairs = part.select(F.col("p_brand").alias("title"), (F.col("p_partkey") % 950).cast("string").alias("issn"))
    overrides = pairs.where("issn = '949'").distinct().withColumn("record_id", F.lit(-1).cast("long"))
    return ingest.crosswalk(pairs, official, overrides, E.norm_title_plain, E.norm_issn)


_STRATA = P + """, n AS (SELECT journal, count(*) AS n FROM papers GROUP BY 1), s AS (SELECT paper_id, concat_ws('|', CASE WHEN year <= 1996 THEN 'early' WHEN year <= 1999 THEN 'middle' ELSE 'late' END, status,
CASE WHEN n.n <= 590 THEN 'small' WHEN n.n <= 620 THEN 'medium' ELSE 'large' END) AS stratum FROM papers JOIN n USING (journal))
"""


def _strata(spark, d):
    rows = sampling.size_band(papers(spark, d), "journal", [("small", 590), ("medium", 620), ("large", 1 << 60)])
    return sampling.strata(rows, [E.period(F.col("year"), _PERIODS), F.col("status"), F.col("band")])


@query(_STRATA + "SELECT stratum, count(*) AS papers FROM s GROUP BY stratum")
def sampling_strata(spark, d):
    return _strata(spark, d).groupBy("stratum").agg(F.count("*").alias("papers"))


@query()
def stratified_draw(spark, d):
    """A tenth of the papers, exactly, by stratum."""
    rows = _strata(spark, d)
    sizes = {r.stratum: r.n for r in rows.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    allocation = sampling.proportional_allocation(sizes, max(len(sizes), sum(sizes.values()) // 10))
    return sampling.draw_stratified(rows, "paper_id", allocation, 20260712).select("paper_id", "stratum", "population", "sample", "weight")


@query()
def sampling_stability(spark, d):
    """Two raters' agreement on two dimensions in stratified samples of three sizes, and the smallest that is stable."""
    dear = lambda least: F.when(F.col("citations") > least, "dear").when(F.col("citations") > least / 2, "fair").when(F.col("citations") > 5000, "cheap")
    rows = _strata(spark, d).withColumns({"a": dear(200000), "b": dear(210000), "c": F.col("status"), "e": F.when(F.col("priority") != "1-URGENT", F.col("status")).otherwise("P")})
    out = sampling.stability(rows, {"price": ("a", "b"), "state": ("c", "e")}, [0.1, 0.25, 0.4], 1000, 20260711)
    return sampling.recommend_fraction(out)


@query("SELECT o_orderkey, sha256('s|' || o_orderkey::VARCHAR) AS blind_key FROM orders")
def blinded_order(spark, d):
    return sampling.blinded_order(table(spark, d, "orders"), "s", "o_orderkey").select("o_orderkey", "blind_key")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS k, count(*) OVER () AS n FROM part)
SELECT p_partkey, CASE WHEN k <= 1 + (n - 1) * (1 / 3.0::DOUBLE * 100 / 100) THEN 1 WHEN k <= 1 + (n - 1) * (2 / 3.0::DOUBLE * 100 / 100) THEN 2 ELSE 3 END AS tertile FROM r""")
def length_tertiles(spark, d):
    part = table(spark, d, "part")
    return growth.tertiles(part, "p_size", [F.col("p_partkey")], part.count()).select("p_partkey", "tertile")


@query("SELECT doc_id, 120 + greatest(50, length(text) // 4) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", E.approx_tokens(F.col("text"), 120).alias("tokens"))
