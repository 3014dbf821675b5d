"""Queries on robustness, records, labels, progress and topic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrion.functions import expressions as E
from papyrion.operators import graph, growth, ingest, keywords, raters, records, robustness, topics
from papyrion.queries.base import LONG, PANELS, PRIORITY, STATUS, P, papers, query, table
from papyrion.queries.graph import _WORDS, _docs
from papyrion.queries.keywords import _BRIDGE, bridge
from papyrion.queries.raters import _L, ratings

_ERAS = [("before 1996", None, 1995), ("1996-1998", 1996, 1998), ("1999-2000", 1999, 2000)]


@query(P + "SELECT CASE WHEN year <= 1995 THEN 'before 1996' WHEN year <= 1998 THEN '1996-1998' WHEN year <= 2000 THEN '1999-2000' ELSE 'Unknown year' END AS era, count(*) AS papers FROM papers GROUP BY 1")
def publication_era(spark, d):
    era = F.coalesce(E.period(F.col("year"), _ERAS), F.lit("Unknown year"))
    return papers(spark, d).groupBy(era.alias("era")).agg(F.count("*").alias("papers"))


@query(_L + """, h AS (SELECT unit, count(DISTINCT rater) AS n_agreeing FROM l WHERE dimension = 'flag' AND value = 'A' GROUP BY unit)
SELECT unit, n_agreeing, n_agreeing = 3 AS unanimous FROM h WHERE n_agreeing >= 2""")
def agreement_evidence(spark, d):
    return robustness.agreement_evidence(raters.pattern_agreement(ratings(spark, d), {"flag": "A"}), 3, 2)


@query(_L + """, h AS (SELECT unit, bool_or(rater = 'one') AS a, bool_or(rater = 'two') AS b FROM l WHERE value = 'R' AND rater IN ('one', 'two') GROUP BY unit)
SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'reference' ELSE 'comparison' END AS mode, count(*) AS units FROM h GROUP BY 1""")
def evidence_modes(spark, d):
    return robustness.evidence_modes(ratings(spark, d), "flag", "R", "one", "two").groupBy("mode").agg(F.sum("n").alias("units"))


_RATED = _L + ", g AS (SELECT l_orderkey * 20 + l_linenumber AS unit, max(CASE WHEN l_tax < 0.04 THEN 'low' ELSE 'high' END) AS tax FROM lineitem GROUP BY 1), rl AS (SELECT l.*, tax FROM l JOIN g USING (unit) WHERE value IS NOT NULL)\n"


def _rated(spark, d):
    return ratings(spark, d, F.max(F.expr("CASE WHEN l_tax < 0.04 THEN 'low' ELSE 'high' END")).alias("tax"))


@query(_RATED + """, c AS (SELECT rater, value, count(*) FILTER (tax = 'low') AS l, count(*) FILTER (tax = 'high') AS r FROM rl GROUP BY ALL),
s AS (SELECT rater, value, (r / sum(r) OVER (PARTITION BY rater) - l / sum(l) OVER (PARTITION BY rater)) * 100 AS difference_pp FROM c),
q AS (SELECT *, CASE WHEN abs(difference_pp) <= 1e-10 THEN 0 WHEN difference_pp > 0 THEN 1 ELSE -1 END AS direction FROM s)
SELECT rater, value, round(difference_pp, 9) AS difference_pp, direction, min(direction) OVER (PARTITION BY value) = max(direction) OVER (PARTITION BY value) AS retained FROM q""")
def contrast_directions(spark, d):
    return robustness.contrast_directions(_rated(spark, d), "tax", "low", "high").withColumn("difference_pp", F.round("difference_pp", 9))


@query(_RATED + """, n AS (SELECT tax, rater, value, count(*) AS n FROM rl GROUP BY ALL), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY tax, rater ORDER BY n DESC, value) = 1)
SELECT *, min(value) OVER (PARTITION BY tax) = max(value) OVER (PARTITION BY tax) AS same FROM f""")
def nested_leaders(spark, d):
    return robustness.leading_by(_rated(spark, d), ["tax"])


@query("""WITH c AS (SELECT l_linestatus, l_returnflag AS value, count(*) AS n, count(*) FILTER (l_discount >= 0.05) AS wanted FROM lineitem GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY l_linestatus) AS share, wanted / sum(wanted) OVER (PARTITION BY l_linestatus) AS wanted_share FROM c) SELECT *, round((wanted_share - share) * 100, 9) AS difference_pp FROM s""")
def evidence_type_sensitivity(spark, d):
    li = table(spark, d, "lineitem").withColumn("kind", F.when(F.col("l_discount") >= 0.05, "stated").otherwise("inferred"))
    return robustness.evidence_type_sensitivity(li, "l_returnflag", "kind", ["l_linestatus"]).withColumn("difference_pp", F.round("difference_pp", 9))


@query(P + LONG + """, o AS (SELECT * FROM (VALUES ('priority', 0), ('status', 1), ('segment', 2)) AS v(panel, i)),
c AS (SELECT a.panel AS control, b.panel AS outcome, a.value AS control_value, b.value AS outcome_value, count(*) AS papers FROM long a JOIN long b ON a.paper_id = b.paper_id
JOIN o oa ON oa.panel = a.panel JOIN o ob ON ob.panel = b.panel AND oa.i < ob.i GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY control, outcome ORDER BY papers DESC, control_value, outcome_value) = 1""")
def strongest_cells(spark, d):
    return robustness.strongest_cells(papers(spark, d), PANELS, "paper_id")


@query(P + """SELECT * FROM (SELECT priority, status, count(*) AS papers, count(*) FILTER (year >= 1999) AS recent, count(*) FILTER (segment = 'BUILDING') AS building
FROM papers WHERE year >= 1999 OR segment = 'BUILDING' GROUP BY ALL) WHERE papers >= 5""")
def supported_configurations(spark, d):
    return robustness.supported_configurations(papers(spark, d), [PRIORITY, STATUS], {"recent": F.col("year") >= 1999, "building": F.col("segment") == "BUILDING"}, 5)


@query(P + """, t AS (SELECT journal AS topic, count(*) AS papers, 100 * avg((priority <> '4-NOT SPECIFIED')::INT) AS a, 100 * avg((status <> 'P')::INT) AS b, 100.0::DOUBLE AS c FROM papers GROUP BY 1 ORDER BY papers DESC, topic LIMIT 6)
SELECT 'priority' AS panel, topic, papers, round(a, 9) AS percent FROM t UNION ALL SELECT 'status', topic, papers, round(b, 9) FROM t UNION ALL SELECT 'segment', topic, papers, round(c, 9) FROM t""")
def topic_observability(spark, d):
    return robustness.observability(papers(spark, d), PANELS, "journal", 6).withColumn("percent", F.round("percent", 9))


@query(P + "SELECT priority, count(*) FILTER (status = 'F') AS F, count(*) FILTER (status = 'O') AS O, count(*) FILTER (status = 'P') AS P FROM papers GROUP BY priority")
def status_pivot(spark, d):
    return papers(spark, d).groupBy("priority").pivot("status", ["F", "O", "P"]).count().fillna(0)


@query(P + "SELECT segment, status, count(DISTINCT journal) AS journals, count(DISTINCT paper_id) AS papers FROM papers GROUP BY ALL")
def group_journals(spark, d):
    return papers(spark, d).groupBy("segment", "status").agg(F.count_distinct("journal").alias("journals"), F.count_distinct("paper_id").alias("papers"))


@query("SELECT p_partkey, p_type FROM part WHERE p_brand = 'Brand#12' OR contains(lower(p_name), 'brand#12') OR contains(lower(p_type), 'brand#12')")
def connected_papers(spark, d):
    return records.connected(table(spark, d, "part"), "Brand#12", ["p_brand"], ["p_name", "p_type"]).select("p_partkey", "p_type")


@query(r"""WITH d AS (SELECT doc_id, source, regexp_extract(coalesce(text, ''), ',([^,.]*)', 1) AS logic, string_split(translate(coalesce(text, ''), ' ', ';'), ';') AS problems FROM documents)
SELECT doc_id, source AS mechanism_raw, CASE WHEN regexp_matches(logic, '[^\t-\r \x{85}\p{Z}]') THEN source ELSE 'mechanism missing' END AS mechanism,
len(list_filter(problems, lambda x: regexp_matches(x, '[^\t-\r \x{85}\p{Z}]')))::INT AS problem_count, list_contains(problems, 'the') AS is_box FROM d""")
def analysis_enrichment(spark, d):
    """A document's source as its mechanism, whose logic is what follows its first comma, and its words as problems."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("mechanism"), F.regexp_extract("text", ",([^,.]*)", 1).alias("logic"), F.translate("text", " ", ";").alias("problems"))
    return records.enriched(docs, "mechanism", "logic", "problems", "the").select("doc_id", "mechanism_raw", "mechanism", "problem_count", "is_box")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS bad_code, l_quantity > 40 AS bad_kind, l_discount * 20 > 1 AS bad_confidence, l_tax < 0.02 AS no_evidence FROM lineitem)
SELECT concat_ws(';', CASE WHEN bad_code THEN 'flag: code' END, CASE WHEN bad_kind THEN 'flag: evidence type' END, CASE WHEN bad_confidence THEN 'flag: confidence' END, CASE WHEN no_evidence THEN 'flag: evidence' END) AS faults, count(*) AS n FROM f GROUP BY 1""")
def payload_faults(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_quantity") > 40, "guess").otherwise("stated").alias("flag_evidence_type"), (F.col("l_discount") * 20).alias("flag_confidence"), F.when(F.col("l_tax") < 0.02, "").otherwise("text").alias("flag_evidence"))
    return records.payload_faults(rows, {"flag": ["A", "N"]}, ["stated", "inferred", "absent"]).groupBy(F.array_join("faults", ";").alias("faults")).agg(F.count("*").alias("n"))


@query(P + "SELECT paper_id, 'priority=' || priority || ':' || (priority = '2-HIGH')::VARCHAR || ' status=' || status || ':false' AS record FROM papers")
def paper_inspection(spark, d):
    rows = records.inspection(papers(spark, d), "paper_id", ["priority", "status"], {"priority": "2-HIGH"})
    return rows.select("paper_id", F.array_join(F.transform("dimensions", lambda x: F.concat(x["dimension"], F.lit("="), x["value"], F.lit(":"), x["selected"].cast("string"))), " ").alias("record"))


@query("""WITH a AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Approved ' || n_nationkey WHEN n_nationkey % 3 = 1 THEN NULL END AS approved FROM nation WHERE n_nationkey < 20)
SELECT n_nationkey, coalesce(approved, n_name) AS label FROM nation LEFT JOIN a USING (n_nationkey)""")
def label_overlay(spark, d):
    nation = table(spark, d, "nation")
    key = F.col("n_nationkey")
    labels = nation.where(key < 20).select("n_nationkey", F.when(key % 3 == 0, F.concat(F.lit(" Approved "), key)).when(key % 3 == 1, F.lit("  ")).alias("approved"))
    return records.overlaid(nation.select("n_nationkey", "n_name"), labels, ["n_nationkey"], "n_name").select("n_nationkey", "label")


@query("SELECT o_orderkey, o_orderpriority AS left__o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN '1-URGENT' ELSE o_orderpriority END AS right__o_orderpriority FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'")
def pairs_left_right_join(spark, d):
    orders = table(spark, d, "orders")
    right = orders.where("o_orderpriority <> '5-LOW'").withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "1-URGENT").otherwise(F.col("o_orderpriority")))
    return records.aligned(orders.where("o_orderstatus <> 'P'"), right, "o_orderkey", ["o_orderpriority"])


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'rated' END AS o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS qc_o_orderpriority FROM orders""")
def primary_dataset(spark, d):
    orders = table(spark, d, "orders")
    rated = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("rated").alias("o_orderstatus"))
    out = records.combined(orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), rated, orders.where("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return out.select("o_orderkey", "o_totalprice", "o_orderstatus", "qc_o_orderpriority")


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersection_ids(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    return records.in_all([orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), table(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "id")], "id")


@query("SELECT p_partkey, p_name, (1000 - p_partkey)::BIGINT AS position FROM part WHERE p_size < 10")
def requested_order(spark, d):
    part = table(spark, d, "part")
    wanted = part.where("p_size < 10").select("p_partkey", (1000 - F.col("p_partkey")).alias("position"))
    return records.in_order(part.select("p_partkey", "p_name"), wanted, "p_partkey")


@query("SELECT o_orderstatus AS scope, count(*) AS topics, count(*) FILTER (o_orderpriority <> '5-LOW') AS done, count(*) FILTER (o_orderpriority = '5-LOW') = 0 AS complete FROM orders GROUP BY 1")
def review_progress(spark, d):
    orders = table(spark, d, "orders").withColumn("state", F.when(F.col("o_orderpriority") == "5-LOW", "open").otherwise("approved"))
    return records.review_progress(orders, "o_orderstatus", "state")


@query("""WITH n AS (SELECT DISTINCT o_orderstatus AS scope, o_custkey AS n FROM orders), m AS (SELECT scope, max(n) AS hi FROM n GROUP BY 1)
SELECT m.scope, i AS missing FROM m, unnest(range(0, hi)) AS r(i) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.scope = m.scope AND n.n = i)""")
def review_coverage(spark, d):
    return records.missing_numbers(table(spark, d, "orders"), "o_orderstatus", "o_custkey")


@query(_L + ", u AS (SELECT rater, unit, count(DISTINCT dimension) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL) SELECT rater, count(*) AS started, count(*) FILTER (n >= 1) AS completed, count(*) FILTER (n >= 1) / 100000.0::DOUBLE AS share FROM u GROUP BY rater")
def rater_progress(spark, d):
    return records.rater_progress(ratings(spark, d), 100000, 1)


@query("SELECT count(*) AS papers, avg(len(regexp_extract_all(text, '\\S+'))) AS mean_words, median(n_chars) AS median_year, avg((lang = 'en')::INT) AS english, avg((source = 'src0')::INT) AS first_source FROM documents")
def selection_diagnostics(spark, d):
    return records.selection_diagnostics(table(spark, d, "documents"), "text", "n_chars", {"english": F.col("lang") == "en", "first_source": F.col("source") == "src0"})


@query(P + ", r AS (SELECT priority, paper_id, row_number() OVER (PARTITION BY priority ORDER BY paper_id) AS r FROM papers) SELECT priority AS value, count(*) AS papers, string_agg(CASE WHEN r <= 4 THEN paper_id END, ';' ORDER BY paper_id) AS ids FROM r GROUP BY 1")
def dimension_ids(spark, d):
    return records.listed_ids(papers(spark, d), "priority", "paper_id", 4)


@query(f"""WITH d AS (SELECT doc_id, source, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, source, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x IN ('and', 'of'))) AS b FROM d)
SELECT source AS topic, count(*) AS papers, avg(a) AS left_mean, avg(b) AS right_mean FROM c WHERE a >= 2 AND b >= 2 GROUP BY 1""")
def assigned_papers_filter(spark, d):
    docs = _docs(spark, d)
    count = lambda *terms: topics.phrase_counts(docs, "doc_id", F.col("w"), spark.createDataFrame([(t,) for t in terms], "phrase string"), [1])
    return records.assigned_above(docs, count("the"), count("and", "of"), "doc_id", "source", 2)


_TRIMMED = r"list_filter(list_transform(string_split({list}, '{mark}'), lambda x: regexp_replace(x, '^[\t-\r \x{{85}}\p{{Z}}]+|[\t-\r \x{{85}}\p{{Z}}]+$', '', 'g')), lambda x: x <> '')"


@query(f"""WITH e AS (SELECT doc_id, unnest({_TRIMMED.format(list="translate(coalesce(text, ''), '.', ';')", mark=";")}) AS entry FROM documents),
p AS (SELECT doc_id, {_TRIMMED.format(list="entry", mark=",")} AS parts FROM e)
SELECT doc_id, parts[1] AS author, coalesce(list_filter(parts[2:], lambda p: contains(lower(p), 'the') OR contains(lower(p), 'und'))[1], parts[2]) AS institution FROM p""")
def affiliations(spark, d):
    """Every sentence as an entry, whose parts lie between commas."""
    entries = graph.affiliations(F.translate("text", ".", ";"), ["the", "und"])
    return table(spark, d, "documents").select("doc_id", F.explode(entries).alias("x")).select("doc_id", "x.author", "x.institution")


@query("SELECT p_partkey, 'Topic::' || replace(replace(p_name, '%', '%25'), ' ', '%20') || '%2F' || p_size AS node FROM part")
def node_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", E.node_id(F.lit("Topic"), F.concat_ws("/", "p_name", F.col("p_size").cast("string"))).alias("node"))


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
w AS (SELECT p_brand, max(p_partkey) FILTER (r = 1) AS a, max(p_partkey) FILTER (r = 2) AS b, max(p_partkey) FILTER (r = 3) AS c FROM r GROUP BY 1)
SELECT p_brand, 1 AS rank, a AS paper FROM w WHERE a IS NOT NULL UNION ALL SELECT p_brand, 2, b FROM w WHERE b IS NOT NULL UNION ALL SELECT p_brand, 3, c FROM w WHERE c IS NOT NULL""")
def representative_papers(spark, d):
    wide = graph.rank_columns(table(spark, d, "part"), "p_brand", "p_partkey", [F.desc("p_retailprice"), F.asc("p_partkey")])
    return graph.representative_edges(wide, "p_brand", ["representative_1", "representative_2", "representative_3"])


@query("""WITH s AS (SELECT p_partkey, unnest([{'scope': 'brand', 'topic': p_brand}, {'scope': 'size', 'topic': CASE WHEN p_size > 25 THEN '-1' ELSE p_size::VARCHAR END}]) AS x FROM part)
SELECT x.scope || ':' || x.topic AS topic, count(*) AS papers FROM s WHERE x.topic <> '-1' GROUP BY 1""")
def topic_nodes(spark, d):
    part = table(spark, d, "part")
    topic = F.when(F.col("p_size") > 25, "-1").otherwise(F.col("p_size").cast("string"))
    cells = F.array(F.struct(F.lit("brand").alias("scope"), F.col("p_brand").alias("topic")), F.struct(F.lit("size").alias("scope"), topic.alias("topic")))
    rows = part.select("p_partkey", F.explode(cells).alias("x")).select("p_partkey", "x.*").where((E.clean(F.col("topic")) != "") & ~F.col("topic").startswith("-1"))
    return rows.groupBy(F.concat_ws(":", "scope", "topic").alias("topic")).agg(F.count("*").alias("papers"))


@query("SELECT word AS value, count(*) AS papers FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> 'green' GROUP BY 1 ORDER BY papers DESC, value LIMIT 12")
def top_listed(spark, d):
    return growth.top_listed(table(spark, d, "part").withColumn("words", F.translate("p_name", " ", ";")), "words", 12, "green")


@query("SELECT p_partkey, p_name || '. ' || CASE WHEN p_size > 25 THEN p_type || '. ' ELSE '' END || p_brand AS unified_text FROM part WHERE length(p_name || '. ' || CASE WHEN p_size > 25 THEN p_type || '. ' ELSE '' END || p_brand) >= 25")
def unified_texts(spark, d):
    part = table(spark, d, "part").withColumn("abstract", F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("[No abstract available]"))
    return ingest.unified_texts(part, ["p_name", "abstract", "p_brand"], min_chars=25).select("p_partkey", "unified_text")


@query(f"""WITH d AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), n AS (SELECT doc_id, w, count(*) AS n FROM d WHERE w IN ('the', 'and', 'of') GROUP BY ALL)
SELECT doc_id, string_agg(w || ':' || n, ';' ORDER BY n DESC, w) AS terms FROM n GROUP BY doc_id""")
def paper_term_columns(spark, d):
    phrases = spark.createDataFrame([("the",), ("and",), ("of",)], "phrase string")
    return topics.term_column(topics.phrase_counts(_docs(spark, d), "doc_id", F.col("w"), phrases, [1]), "doc_id")


@query(f"""WITH d AS (SELECT source AS topic, unnest({_WORDS}) AS term FROM documents), n AS (SELECT topic, term, count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT *, n / sum(n) OVER (PARTITION BY topic) AS tf, sum(n) OVER (PARTITION BY term) AS f, (SELECT sum(n) / count(DISTINCT topic) FROM n) AS a FROM n),
w AS (SELECT topic, term, round(tf * ln(1 + a / f), 12) AS weight FROM f WHERE f >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM w)
SELECT topic, string_agg(term, ' / ' ORDER BY rank) AS label FROM r WHERE rank <= 2 GROUP BY topic""")
def topic_labels(spark, d):
    return topics.label_from_terms(topics.ctfidf(_docs(spark, d), "source", F.col("w"), 2, 2))


@query(f"""WITH s AS (SELECT label, count(*) AS n FROM embeddings WHERE label < 8 GROUP BY 1),
d AS (SELECT source AS topic, unnest({_WORDS}) AS term FROM documents), n AS (SELECT topic, term, count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT *, n / sum(n) OVER (PARTITION BY topic) AS tf, sum(n) OVER (PARTITION BY term) AS f, (SELECT sum(n) / count(DISTINCT topic) FROM n) AS a FROM n),
w AS (SELECT topic, term, round(tf * ln(1 + a / f), 12) AS weight FROM f WHERE f >= 2), r AS (SELECT term FROM w QUALIFY row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) <= 10)
SELECT (SELECT count(*) FROM s) AS topics, (SELECT stddev_pop(n) / avg(n) FROM s) AS size_cv, (SELECT avg((label >= 8)::INT) FROM embeddings) AS outlier_rate,
(SELECT count(DISTINCT term) / count(*) FROM r) AS diversity""")
def topic_quality(spark, d):
    """Sizes of the embeddings' topics, and the diversity of the sources' heaviest words."""
    assigned = table(spark, d, "embeddings").select(F.when(F.col("label") >= 8, -1).otherwise(F.col("label")).alias("topic"))
    return topics.topic_quality(assigned, topics.ctfidf(_docs(spark, d), "source", F.col("w"), 2, 10))


@query(_BRIDGE + """, k AS (SELECT keyword FROM b GROUP BY keyword ORDER BY count(DISTINCT paper_id) DESC, keyword LIMIT 5)
SELECT keyword, year, count(DISTINCT paper_id) AS papers FROM b JOIN k USING (keyword) GROUP BY ALL""")
def keyword_trajectories(spark, d):
    return keywords.trajectories(bridge(spark, d), "paper_id", "year", 5)


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 20 THEN NULL ELSE p_size END DESC NULLS LAST, p_retailprice DESC, p_name, p_partkey) <= 4")
def fitted_papers(spark, d):
    part = table(spark, d, "part").withColumn("probability", F.when(F.col("p_size") <= 20, F.col("p_size")))
    out = topics.fitted(part, "p_brand", [F.desc_nulls_last("probability"), F.desc("p_retailprice"), F.asc("p_name"), F.asc("p_partkey")], 4)
    return out.select("p_brand", "p_partkey", "p_retailprice")


@query("""SELECT l_returnflag AS rater, count(DISTINCT l_orderkey) AS coded,
       count(DISTINCT l_orderkey) / (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS coverage,
       l_returnflag = 'A' OR (l_returnflag = 'N' AND count(DISTINCT l_orderkey) >= 20) OR (l_returnflag = 'R' AND count(DISTINCT l_orderkey) >= 1000000000) AS eligible
FROM lineitem GROUP BY 1""")
def rater_registry(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("rater"), F.col("l_orderkey").alias("unit"), F.lit("x").alias("value"))
    return records.rater_registry(rows, ["A"], {"N": 20, "R": 1_000_000_000})


@query(P + """, r AS (SELECT l_orderkey AS paper_id, max(l_returnflag) AS priority, max(l_linestatus) AS mode FROM lineitem GROUP BY 1)
SELECT paper_id, year, status, r.priority, mode FROM papers JOIN r USING (paper_id)""")
def rater_frame(spark, d):
    rater = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.max("l_returnflag").alias("priority"), F.max("l_linestatus").alias("mode"))
    return records.rater_frame(papers(spark, d), rater, "paper_id").select("paper_id", "year", "status", "priority", "mode")


@query(P + """SELECT paper_id, papers.status, orders.o_orderstatus AS status_prior, (o_totalprice * 100)::BIGINT AS sample_order
FROM papers JOIN orders ON o_orderkey = paper_id WHERE o_orderpriority = '1-URGENT'""")
def targeted_reading(spark, d):
    sample = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    sample = sample.select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") * 100).cast("decimal(38,0)").cast("long").alias("place"))
    return records.targeted_reading(papers(spark, d), sample, "paper_id", "place").select("paper_id", "status", "status_prior", "sample_order")


@query("""WITH a AS (SELECT l_orderkey, max(l_linestatus) AS mode FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
r AS (SELECT l_orderkey, max(l_linestatus) AS mode FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, o_orderstatus, c_mktsegment, a.mode AS a__mode, r.mode AS r__mode FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN r ON r.l_orderkey = o_orderkey""")
def relation_evidence(spark, d):
    orders, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    primary = orders.join(people, "o_custkey").select("o_orderkey", "c_mktsegment")
    by = {f: li.where(F.col("l_returnflag") == f.upper()).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("mode")) for f in ("a", "r")}
    return records.relation_evidence(orders.select("o_orderkey", "o_orderstatus"), primary, by, "o_orderkey")


_REVIEW = """WITH r AS (SELECT r_name AS scope, n_nationkey // 5 AS topic, CASE WHEN n_nationkey % 7 = 0 THEN 'open' WHEN n_nationkey % 11 = 0 THEN 'odd' ELSE 'approved' END AS status,
CASE WHEN n_nationkey % 4 <> 0 THEN n_name ELSE ' ' END AS approved, lower(n_name) AS automatic FROM nation JOIN region ON r_regionkey = n_regionkey)
"""


def _review(spark, d):
    key = F.col("n_nationkey")
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.col("r_name").alias("scope"), F.floor(key / 5).cast("int").alias("topic"), F.when(key % 7 == 0, "open").when(key % 11 == 0, "odd").otherwise("approved").alias("status"),
        F.when(key % 4 != 0, F.col("n_name")).otherwise(" ").alias("approved"), F.lower("n_name").alias("automatic"),
    )


@query(_REVIEW + """, w AS (SELECT r_name AS scope, unnest(range(0, 4)) AS topic FROM region), c AS (SELECT scope, topic, count(*) AS n FROM r GROUP BY ALL)
SELECT 'duplicate' AS fault, scope, topic::INT AS topic FROM c WHERE n > 1 UNION ALL SELECT 'missing', scope, topic::INT FROM w ANTI JOIN c USING (scope, topic)
UNION ALL SELECT 'not expected', scope, topic::INT FROM c ANTI JOIN w USING (scope, topic) UNION ALL SELECT 'status', scope, topic::INT FROM r WHERE status NOT IN ('open', 'approved')
UNION ALL SELECT 'approved without label', scope, topic::INT FROM r WHERE status = 'approved' AND trim(approved) = ''""")
def review_validation(spark, d):
    expected = table(spark, d, "region").select(F.col("r_name").alias("scope"), F.lit(4).alias("topics"))
    return records.review_faults(_review(spark, d), expected, ["open", "approved"])


@query(_REVIEW + """, g AS (SELECT scope, bool_and(status = 'approved' AND trim(approved) <> '') AS complete FROM r GROUP BY 1)
SELECT scope, topic::INT AS topic, CASE WHEN complete THEN approved ELSE automatic END AS label FROM r JOIN g USING (scope)""")
def approval_gate(spark, d):
    return records.gated(_review(spark, d)).select("scope", "topic", "label")
