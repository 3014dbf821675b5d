"""Queries on the property graph and on topics and text."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from papyrion.operators import density, graph, topics
from papyrion.queries.base import P, papers, query, table


def _parts(spark, d):
    rows = papers(spark, d).withColumn("paper", F.col("paper_id").cast("string"))
    nodes = graph.merged_nodes([
        graph.node_rows(rows, "Publication", F.col("paper"), {"year": F.col("year"), "status": F.col("status")}, F.col("paper_id")),
        graph.node_rows(rows, "Journal", F.col("journal"), {}, F.col("paper_id")),
        graph.node_rows(rows, "Segment", F.col("segment"), {"last_priority": F.col("priority")}, F.col("paper_id")),
    ])
    edges = graph.edge_rows(rows, "PUBLISHED_IN", ("Publication", F.col("paper")), ("Journal", F.col("journal")))
    return nodes, edges.unionByName(graph.edge_rows(rows, "IN_SEGMENT", ("Publication", F.col("paper")), ("Segment", F.col("segment"))))


_NODES = P + """, e AS (SELECT 'Publication::' || paper_id AS src, 'Journal::' || journal AS dst, 'PUBLISHED_IN' AS type FROM papers UNION ALL SELECT 'Publication::' || paper_id, 'Segment::' || segment, 'IN_SEGMENT' FROM papers),
n AS (SELECT 'Publication::' || paper_id AS node, 'Publication' AS label, paper_id::VARCHAR AS value FROM papers UNION ALL SELECT DISTINCT 'Journal::' || journal, 'Journal', journal FROM papers UNION ALL SELECT DISTINCT 'Segment::' || segment, 'Segment', segment FROM papers),
u AS (SELECT src, dst, type FROM e UNION ALL SELECT dst, src, type FROM e), g AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY 1)
"""


@query(_NODES + ", s AS (SELECT segment, arg_max(priority, paper_id) AS p FROM papers GROUP BY 1) SELECT n.node, label, value, CASE label WHEN 'Segment' THEN s.p WHEN 'Publication' THEN status END AS prop FROM n LEFT JOIN s ON s.segment = n.value LEFT JOIN papers ON n.value = paper_id::VARCHAR")
def graph_nodes(spark, d):
    nodes, _ = _parts(spark, d)
    return nodes.select("node", "label", "value", F.coalesce(F.element_at("props", "last_priority"), F.element_at("props", "status")).alias("prop"))


@query(_NODES + "SELECT src, dst, type, count(*) AS weight FROM e GROUP BY ALL")
def graph_edges(spark, d):
    return graph.merged_edges(_parts(spark, d)[1])


@query(_NODES + "SELECT 'node' AS kind, label AS name, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY 2")
def graph_counts(spark, d):
    return graph.graph_counts(*_parts(spark, d))


@query("""SELECT 'label' AS fault, 'Customer' AS value UNION ALL SELECT 'type', 'ORDERED_BY'
UNION ALL SELECT DISTINCT 'end', 'Customer::' || o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal <= 0""")
def graph_contract(spark, d):
    """What breaks the contract once customers join the graph: their label, their edges, and those without a node."""
    nodes, edges = _parts(spark, d)
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0").withColumn("id", F.col("c_custkey").cast("string"))
    nodes = nodes.unionByName(graph.merged_nodes([graph.node_rows(customers, "Customer", F.col("id"), {"name": F.col("c_name")}, F.col("c_custkey"))]))
    more = graph.edge_rows(orders, "ORDERED_BY", ("Publication", F.col("o_orderkey").cast("string")), ("Customer", F.col("o_custkey").cast("string")))
    return graph.check_closed(edges.unionByName(more), nodes, ["Publication", "Journal", "Segment"], ["PUBLISHED_IN", "IN_SEGMENT"])


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT l_orderkey FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25)
SELECT a.l_partkey AS left_member, b.l_partkey AS right_member, a.l_orderkey FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_orderkey IN (SELECT l_orderkey FROM s)""")
def coauthor_pairs(spark, d):
    return graph.member_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query(_NODES + ", t AS (SELECT n.node AS src, degree FROM n JOIN g USING (node) WHERE label = 'Journal' ORDER BY degree DESC, node LIMIT 5) SELECT src, degree, dst, type FROM t JOIN u USING (src) ORDER BY src, type, dst LIMIT 1500")
def graph_degree_seed(spark, d):
    nodes, edges = _parts(spark, d)
    return graph.seed(nodes, edges, "Journal", F.lit(0), 5)


_CITED = _NODES + """, k AS (SELECT p_partkey, count(*)::INT AS citations FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1),
c AS (SELECT 'Part::' || p_partkey AS node, citations FROM k ORDER BY citations DESC, node LIMIT 25),
f AS (SELECT 'Part::' || l_partkey AS src, 'Supplier::' || l_suppkey AS dst, 'SUPPLIED_BY' AS type, count(*) AS weight FROM lineitem GROUP BY ALL UNION ALL SELECT 'Part::' || p_partkey, 'Brand::' || replace(p_brand, '#', '%23'), 'OF_BRAND', 1 FROM part)
"""


def _cited(spark, d):
    part, items = table(spark, d, "part"), table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    text = lambda c: F.col(c).cast("string")
    nodes = graph.merged_nodes([
        graph.node_rows(part, "Part", text("p_partkey"), {"name": F.col("p_name")}, F.col("p_partkey")),
        graph.node_rows(part, "Brand", F.col("p_brand"), {}, F.col("p_partkey")),
        graph.node_rows(table(spark, d, "supplier"), "Supplier", text("s_suppkey"), {}, F.col("s_suppkey")),
    ])
    edges = graph.edge_rows(items, "SUPPLIED_BY", ("Part", text("l_partkey")), ("Supplier", text("l_suppkey")))
    edges = edges.unionByName(graph.edge_rows(part, "OF_BRAND", ("Part", text("p_partkey")), ("Brand", F.col("p_brand"))))
    sold = items.join(part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("citations"))
    cited = sold.select(F.concat(F.lit("Part::"), text("l_partkey")).alias("node"), "citations")
    return graph.cited_graph(nodes, edges, cited, 25, ["Supplier", "Brand"])


@query(_CITED + """SELECT c.node, 'Part' AS label, split_part(c.node, '::', 2) AS value, 8 + least(citations, 60) AS size FROM c
UNION ALL SELECT DISTINCT dst, split_part(dst, '::', 1), replace(split_part(dst, '::', 2), '%23', '#'), 5 FROM f WHERE src IN (SELECT node FROM c) AND (type = 'OF_BRAND' OR dst IN (SELECT 'Supplier::' || s_suppkey FROM supplier))""")
def cited_graph_nodes(spark, d):
    """The most sold parts with their suppliers and brands."""
    return _cited(spark, d)[0]


@query(_CITED + "SELECT src, dst, type, weight FROM f WHERE src IN (SELECT node FROM c) AND (type = 'OF_BRAND' OR dst IN (SELECT 'Supplier::' || s_suppkey FROM supplier))")
def cited_graph_edges(spark, d):
    return _cited(spark, d)[1]


@query(_NODES + "SELECT DISTINCT n.node, type, label, value FROM u JOIN n ON n.node = u.dst WHERE u.src = 'Journal::NATION_7'")
def graph_neighborhood(spark, d):
    nodes, edges = _parts(spark, d)
    return graph.neighborhood(nodes, edges, "Journal::NATION_7")


_BITS = _NODES + """, p AS (SELECT 'Publication::' || paper_id AS node, (priority IN ('1-URGENT', '2-HIGH'))::BIGINT + 2 * (status = 'O')::BIGINT + 4 * (year >= 1998)::BIGINT AS bits, citations FROM papers),
h AS (SELECT dst AS node, bit_or(bits) AS bits FROM u JOIN p ON p.node = u.src GROUP BY dst),
h2 AS (SELECT node, bit_or(bits) AS bits FROM (SELECT * FROM h UNION ALL SELECT dst, h.bits FROM u JOIN h ON h.node = u.src) GROUP BY node),
b AS (SELECT n.node, label, value, coalesce(p.bits, h2.bits, 0)::BIGINT AS bits, citations FROM n LEFT JOIN p ON p.node = n.node LEFT JOIN h2 ON h2.node = n.node)
"""


def _scoped(spark, d):
    nodes, edges = _parts(spark, d)
    scope = lambda condition, bit: F.when(F.expr(condition), 1 << bit).otherwise(0).cast("long")
    bits = scope("priority IN ('1-URGENT', '2-HIGH')", 0) + scope("status = 'O'", 1) + scope("year >= 1998", 2)
    own = papers(spark, d).select(F.concat(F.lit("Publication::"), F.col("paper_id").cast("string")).alias("node"), bits.alias("bits"), "citations")
    return graph.scope_bits(nodes, edges, own).join(own.select("node", "citations"), "node", "left"), edges


@query(_BITS + "SELECT node, label, bits FROM b")
def graph_scope_bits(spark, d):
    """Which of three scopes each node is in, or has publications of within two edges."""
    return _scoped(spark, d)[0].select("node", "label", "bits")


@query(_BITS + "SELECT b.node, type, label, value FROM u JOIN b ON b.node = u.dst WHERE u.src = 'Journal::NATION_7' AND b.bits & 2 <> 0 ORDER BY type, b.node LIMIT 1500")
def graph_scoped_neighborhood(spark, d):
    """A journal's open papers."""
    scoped, edges = _scoped(spark, d)
    return graph.scoped_neighborhood(scoped, edges, "Journal::NATION_7", 1)


@query(_BITS + """, m AS (SELECT src AS node FROM e WHERE type = 'IN_SEGMENT' AND dst = 'Segment::BUILDING'),
t AS (SELECT b.node, degree, row_number() OVER (ORDER BY degree DESC, citations DESC, b.node) AS place FROM b JOIN g USING (node) SEMI JOIN m ON m.node = b.node WHERE label = 'Publication' AND bits & 4 <> 0 QUALIFY place <= 40)
SELECT t.node AS src, place::INT AS place, degree, u.dst, u.type FROM t JOIN u ON u.src = t.node WHERE type = 'PUBLISHED_IN' ORDER BY place, u.dst LIMIT 1500""")
def graph_scoped_seed(spark, d):
    """The journals of the best connected and cited recent papers of one segment."""
    scoped, edges = _scoped(spark, d)
    among = graph.matching(scoped, edges, [("IN_SEGMENT", "Segment")], "BUILDING")
    return graph.scoped_seed(scoped, edges, "Publication", F.col("citations"), 40, 2, ["PUBLISHED_IN"], ["Journal"], among)


_NETWORK = """WITH m AS (SELECT doc_id, n_chars::DOUBLE AS w, source AS cluster, doc_id IN (SELECT doc_id FROM labels) AS read, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER () AS n FROM documents),
c AS (SELECT cluster, count(*) AS nodes, count(*) FILTER (read) AS papers, count(*) / (SELECT count(*) FROM m) AS node_share, count(*) FILTER (read) / (SELECT count(*) FROM m WHERE read) AS paper_share FROM m GROUP BY cluster)
"""


def _coverage(spark, d):
    docs = table(spark, d, "documents")
    return graph.network_coverage(docs, "doc_id", "n_chars", "source", table(spark, d, "labels"), docs.count())


@query(_NETWORK + """SELECT count(*) FILTER (read) AS reading_papers, count(*) AS nodes, 1.0::DOUBLE AS map_coverage, median(w) AS full_median, avg(w) AS full_mean, avg(w) FILTER (read) AS reading_mean,
count(*) FILTER (read AND rank <= ceil(n * 0.1)) AS top_decile, count(*) FILTER (read AND rank <= ceil(n * 0.25)) AS top_quartile, count(*) FILTER (read AND rank > ceil(n * 0.75)) AS bottom_quartile,
median(w) FILTER (read) AS reading_median, median(rank) FILTER (read) AS median_rank, (SELECT count(*) FROM c) AS clusters, (SELECT count(*) FROM c WHERE papers > 0) AS clusters_read,
(SELECT sum(node_share) FROM c WHERE papers > 0) AS read_mass FROM m""")
def network_coverage(spark, d):
    """How the labelled documents cover all, by rank of length and by source."""
    return _coverage(spark, d)[0]


@query(_NETWORK + "SELECT q::INT AS quartile, count(rank) AS papers, count(rank) / (SELECT count(*) FROM m WHERE read) AS share FROM range(1, 5) AS r(q) LEFT JOIN (SELECT rank, n FROM m WHERE read) ON least(greatest(ceil(rank / n * 4), 1), 4) = q GROUP BY q")
def network_quartiles(spark, d):
    return _coverage(spark, d)[1]


@query(_NETWORK + "SELECT * FROM c")
def network_clusters(spark, d):
    return _coverage(spark, d)[2]


@query(_NODES + """, z AS (SELECT node FROM n WHERE label = 'Publication' AND value IN ('1', '2', '3')), o AS (SELECT DISTINCT dst AS node FROM u WHERE src IN (SELECT node FROM z)),
w AS (SELECT DISTINCT dst AS node FROM u WHERE src IN (SELECT node FROM o)), h AS (SELECT node, 0 AS hops FROM z UNION ALL SELECT node, 1 FROM o UNION ALL SELECT node, 2 FROM w)
SELECT h.node, min(hops) AS hops, label FROM h JOIN n USING (node) GROUP BY h.node, label""")
def graph_two_hop_scope(spark, d):
    nodes, edges = _parts(spark, d)
    return graph.two_hop_scope(nodes, edges, nodes.where("label = 'Publication' AND value IN ('1', '2', '3')"))


@query(_NODES + "SELECT n.node, label, value, coalesce(degree, 0)::BIGINT AS degree FROM n LEFT JOIN g USING (node) WHERE label IN ('Journal', 'Segment') AND (contains(lower(value), 'ma') OR contains(lower(value), 'nation_1')) ORDER BY degree DESC, node LIMIT 50")
def graph_search(spark, d):
    nodes, edges = _parts(spark, d)
    both = graph.search(nodes.drop("props").withColumn("props", F.lit(None).cast("map<string,string>")), edges, "ma", ["Journal", "Segment"])
    return both.unionByName(graph.search(nodes.where("label = 'Journal'"), edges, "nation_1", ["Journal"]))


@query("SELECT p_partkey, (p_brand = b)::INT + (p_type = t)::INT + (p_size = s)::INT AS score FROM part, (SELECT p_brand AS b, p_type AS t, p_size AS s FROM part WHERE p_partkey = 5) WHERE p_partkey <> 5 ORDER BY score DESC, p_partkey LIMIT 25")
def nearest_by_matches(spark, d):
    return graph.nearest_by_matches(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"], 5, 25)


@query(r"""WITH x AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, 'href="/([0-9A-Za-z]+)"', ' https://doi.org/10.1000/\1 ', 'g'), '10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+')) AS r FROM pages),
i AS (SELECT lower(regexp_extract(html, '<title>([0-9A-Za-z]+)', 1)) AS word, min(page_id) AS target FROM pages GROUP BY 1 HAVING word <> '')
SELECT DISTINCT page_id AS paper, coalesce(target::VARCHAR, lower(r)) AS target, CASE WHEN target IS NULL THEN 'REFERENCES' ELSE 'CITES' END AS type
FROM x LEFT JOIN i ON '10.1000/' || word = lower(r) WHERE target IS NULL OR target <> page_id""")
def reference_resolution(spark, d):
    """Pages cite each other by their menus' links: a link's word is the DOI of the first page whose title begins with it."""
    links = F.regexp_replace("html", 'href="/([0-9A-Za-z]+)"', " https://doi.org/10.1000/$1 ")
    word = F.nullif(F.regexp_extract("html", "<title>([0-9A-Za-z]+)", 1), F.lit(""))
    return graph.resolve_references(table(spark, d, "pages"), "page_id", links, F.concat(F.lit("10.1000/"), word), F.col("page_id"))


_PUNCT = r"[!-/:-@\[-^`{-~]+"
_WORDS = (
    r"list_filter(list_transform(string_split_regex(lower(text), '[\t-\r \x{85}\p{Z}]+'), "
    rf"lambda x: regexp_replace(regexp_replace(x, '^{_PUNCT}', ''), '{_PUNCT}$', '')), "
    r"lambda x: length(x) >= 2 AND regexp_matches(x, '[\p{L}\p{M}\p{N}_]'))"
)


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", topics.tokens(F.col("text")).alias("w"))


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM d WHERE len(w) > 1
UNION ALL SELECT doc_id, unnest(w) FROM d) SELECT doc_id, phrase, count(*) AS n FROM g WHERE phrase IN ('of the', 'and the', 'the', 'with') GROUP BY ALL""")
def ngram_phrase_counts(spark, d):
    phrases = spark.createDataFrame([("of the",), ("and the",), ("the",), ("with",)], "phrase string")
    return topics.phrase_counts(_docs(spark, d), "doc_id", F.col("w"), phrases, [1, 2])


@query(f"""WITH d AS (SELECT {_WORDS} AS w FROM documents), s AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM d) GROUP BY 1), t AS (SELECT sum(c)::BIGINT AS t FROM s),
p AS (SELECT a AS left_word, b AS right_word, count(*) AS n FROM (SELECT unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM d WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= 20),
m AS (SELECT left_word, right_word, n, ln((n / t) / ((l.c / t) * (r.c / t))) / -ln(n / t) AS npmi FROM p JOIN s l ON l.word = left_word JOIN s r ON r.word = right_word, t)
SELECT left_word, right_word, n, round(npmi, 6) AS npmi FROM m WHERE npmi >= 0.5""")
def npmi_bigrams(spark, d):
    return topics.npmi_bigrams(table(spark, d, "documents"), "text", 20, 0.5).withColumn("npmi", F.round("npmi", 6))


@query(f"""WITH d AS (SELECT source AS topic, unnest({_WORDS}) AS term FROM documents), n AS (SELECT topic, term, count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT *, n / sum(n) OVER (PARTITION BY topic) AS tf, sum(n) OVER (PARTITION BY term) AS f, (SELECT sum(n) / count(DISTINCT topic) FROM n) AS a FROM n),
w AS (SELECT topic, term, n, round(tf * ln(1 + a / f), 12) AS weight FROM f WHERE f >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM w)
SELECT topic, term, n, round(weight, 9) AS weight, rank FROM r WHERE rank <= 10""")
def ctfidf_terms(spark, d):
    return topics.ctfidf(_docs(spark, d), "source", F.col("w"), 2, 10).withColumn("weight", F.round("weight", 9))


@query(f"""WITH d AS (SELECT source AS topic, doc_id, unnest(list_distinct({_WORDS})) AS term FROM documents), n AS (SELECT topic, term, count(*) AS papers FROM d GROUP BY ALL),
z AS (SELECT source AS topic, count(*) AS total FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY papers DESC, term) AS rank FROM n)
SELECT topic, term, papers, rank, 100 * (papers / total) AS percent FROM r JOIN z USING (topic) WHERE rank <= 20""")
def topic_term_frequency(spark, d):
    return topics.terms_by_topic(_docs(spark, d), "doc_id", "source", F.col("w"), 20)


@query("""WITH t AS (SELECT CASE WHEN label < 9 THEN label END AS topic, embedding[1]::DOUBLE AS x FROM embeddings), g AS (SELECT topic, count(*) AS papers, median(x) AS median_value, count(*) FILTER (x > 0) AS hits FROM t GROUP BY topic)
SELECT *, CASE WHEN topic IS NOT NULL THEN papers / sum(CASE WHEN topic IS NOT NULL THEN papers END) OVER () END AS share, hits / papers AS hit_share FROM g""")
def topic_prevalence(spark, d):
    rows = table(spark, d, "embeddings").select(F.when(F.col("label") < 9, F.col("label")).alias("topic"), F.col("embedding")[0].cast("double").alias("x"))
    return topics.topic_prevalence(rows, "topic", "x", F.col("x") > 0)


@query("SELECT source AS \"group\", lang AS topic, count(*) AS papers, 100 * count(*) / sum(count(*)) OVER (PARTITION BY source) AS percent FROM documents GROUP BY source, lang")
def topic_by_group(spark, d):
    return topics.topic_by_group(table(spark, d, "documents"), "lang", "source")


@query("""WITH e AS (SELECT event_type, epoch_us(ts) AS t FROM events), s AS (SELECT min(t) AS lo, max(t) AS hi FROM e)
SELECT event_type AS topic, coalesce(least(((t - lo) * 20) // (hi - lo), 19), 0)::INT AS bin, count(*) AS papers FROM e, s GROUP BY ALL""")
def topics_over_time(spark, d):
    rows = table(spark, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return topics.topics_over_time(rows, "event_type", "t")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL),
s AS (SELECT vec_id, label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS similarity FROM x JOIN c USING (label, i) GROUP BY ALL)
SELECT vec_id, label AS topic, round(similarity, 9) AS similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM s QUALIFY rank <= 3""")
def centroid_nearest(spark, d):
    return topics.centroid_nearest(table(spark, d, "embeddings"), "vec_id", "label", "embedding").withColumn("similarity", F.round("similarity", 9))


@query("""WITH a AS (SELECT vec_id, CASE WHEN label % 4 = 0 THEN -1 ELSE label END AS topic, list_transform(embedding[:10], lambda x: greatest(x::DOUBLE, 0)) AS p FROM embeddings)
SELECT vec_id, topic = -1 AS was_outlier, CASE WHEN topic <> -1 THEN topic WHEN list_max(p) >= 0.3 THEN (list_position(p, list_max(p)) - 1)::INT END AS assigned_topic FROM a""")
def topic_assignment(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") % 4 == 0, -1).otherwise(F.col("label")).alias("topic"), F.transform(F.slice("embedding", 1, 10), lambda x: F.greatest(x.cast("double"), F.lit(0.0))).alias("p"))
    return topics.assign_topics(rows, "topic", "p", 0.3).select("vec_id", "was_outlier", "assigned_topic")


@query()
def topic_model(spark, d):
    """k-means topics of the embeddings with their sizes."""
    fitted = topics.fit_topics(table(spark, d, "embeddings"), "vec_id", "embedding", 10, dimensions=16)
    return fitted.groupBy("topic").agg(F.count("*").alias("papers"))


def density_points(spark, d):
    """The embeddings on their first eight principal components."""
    fitted = topics.fit_topics(table(spark, d, "embeddings"), "vec_id", "embedding", 2, dimensions=8)
    return fitted.select(F.col("vec_id").cast("long").alias("id"), vector_to_array("features").alias("x"))


@query()
def topic_density(spark, d):
    """Density topics of the embeddings: most of these, near to random directions, are outliers."""
    return density.density_topics(density_points(spark, d), 5, 5).withColumn("strength", F.round("strength", 9))


@query()
def topic_count_choice(spark, d):
    """The figures of three candidate sizes over the embeddings, by the words of the documents of their ids, and the recommended one."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), topics.tokens(F.col("text")).alias("w"))
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return topics.choose_topic_count(rows, "vec_id", "embedding", F.col("w"), [4, 8, 16], dimensions=16, texts=words)


@query()
def topic_reduction(spark, d):
    """Topics of the embeddings merged up to the largest jump of distance, with sizes and mean probability."""
    fitted = topics.fit_topics(table(spark, d, "embeddings"), "vec_id", "embedding", 20, dimensions=16)
    out = topics.reduced_topics(fitted, 5, 15)
    return out.groupBy("topic", "reduced_topic").agg(F.count("*").alias("papers"), F.round(F.avg("probability"), 6).alias("probability"))
