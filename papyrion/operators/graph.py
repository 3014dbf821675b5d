"""A property graph as two DataFrames.

nodes: node (label::value), label, value, props (map). edges: src, dst, type, props. Node properties
merge by key, the last non-empty value by order winning; edges are kept as often as they are listed
until ``merged_edges``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import graph_clean, node_id, norm_doi, split_list
from papyrion.operators.packing import ranked
from papyrion.plans.tables import written


def node_rows(df: DataFrame, label: str, value: Column, props: dict[str, Column], order: Column) -> DataFrame:
    """Node listings of one label; a null value lists none. Null properties are left out."""
    kept = F.map_filter(F.create_map(*[x for k, c in props.items() for x in (F.lit(k), graph_clean(c))]), lambda _, v: v.isNotNull()) if props else F.create_map().cast("map<string,string>")
    rows = df.select(F.lit(label).alias("label"), graph_clean(value).alias("value"), kept.alias("props"), order.cast("long").alias("ord"))
    return rows.where("value IS NOT NULL")


def merged_nodes(listings: list[DataFrame]) -> DataFrame:
    """One node per (label, value) with merged properties; degree-neutral and order-stable."""
    rows = reduce(DataFrame.unionByName, listings)
    nodes = rows.select("label", "value").distinct()
    cells = rows.select("label", "value", "ord", F.explode("props").alias("k", "v"))
    last = cells.groupBy("label", "value", "k").agg(F.max_by("v", F.struct("ord", "v")).alias("v"))
    props = last.groupBy("label", "value").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    out = nodes.join(props, ["label", "value"], "left")
    return out.select(node_id(F.col("label"), F.col("value")).alias("node"), "label", "value", "props")


def edge_rows(df: DataFrame, kind: str, src: tuple[str, Column], dst: tuple[str, Column]) -> DataFrame:
    """Edge listings between (label, value) ends; a null end lists none."""
    a, b = graph_clean(src[1]), graph_clean(dst[1])
    rows = df.select(F.lit(kind).alias("type"), a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return rows.select(node_id(F.lit(src[0]), F.col("a")).alias("src"), node_id(F.lit(dst[0]), F.col("b")).alias("dst"), "type")


def merged_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, with weight: how often it was listed."""
    return edges.groupBy("src", "dst", "type").agg(F.count("*").alias("weight"))


def check_closed(edges: DataFrame, nodes: DataFrame, labels: list[str], kinds: list[str]) -> DataFrame:
    """What breaks the closed world: unknown labels and types, and ends without a node."""
    bad_labels = nodes.where(~F.col("label").isin(*labels)).select(F.lit("label").alias("fault"), F.col("label").alias("value")).distinct()
    bad_kinds = edges.where(~F.col("type").isin(*kinds)).select(F.lit("type").alias("fault"), F.col("type").alias("value")).distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    loose = ends.join(nodes, "node", "left_anti").select(F.lit("end").alias("fault"), F.col("node").alias("value"))
    return bad_labels.unionByName(bad_kinds).unionByName(loose)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")))


def member_pairs(df: DataFrame, group: str, member: str, most: int = 25) -> DataFrame:
    """Unordered pairs of different members of each group of 2 to ``most`` different members. Larger
    groups are left out before anything is paired, so a group makes at most most * (most - 1) / 2."""
    rows = df.select(group, member).distinct()
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n").between(2, most))
    lists = rows.join(sizes, group).groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("m"))
    left = lists.select(group, "m", F.posexplode("m").alias("i", "left_member"))
    return left.select(group, "left_member", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("right_member"))


# Fixed value: what counts as a DOI in running text.
DOI = r"(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)"


def resolve_references(df: DataFrame, paper: str, references: Column, doi: Column, order: Column) -> DataFrame:
    """(paper, target, type): DOIs found in a reference text, CITES for those of a paper at hand (the
    first by order with that DOI), REFERENCES for others; a paper's own DOI is left out."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(references, F.lit("")), F.lit(DOI), F.lit(1)))
    refs = df.select(F.col(paper).alias("paper"), F.explode(F.transform(found, norm_doi)).alias("doi")).where("doi IS NOT NULL").distinct()
    index = df.select(norm_doi(doi).alias("doi"), F.col(paper).alias("target"), order.alias("o")).where("doi IS NOT NULL").groupBy("doi").agg(F.min_by("target", "o").alias("target"))
    out = refs.join(index, "doi", "left").where("target IS NULL OR target <> paper")
    kind = F.when(F.col("target").isNotNull(), "CITES").otherwise("REFERENCES")
    return out.select("paper", F.coalesce(F.col("target").cast("string"), "doi").alias("target"), kind.alias("type"))


def affiliations(text: Column, hints: list[str]) -> Column:
    """"name, part, part" entries of a ";" list as structs (author, institution): the institution is
    the first part with a hint, else the first part."""

    def parsed(entry: Column) -> Column:
        parts = split_list(entry, ",")
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        hinted = F.filter(rest, lambda p: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(p), h)))
        return F.struct(F.get(parts, F.lit(0)).alias("author"), F.coalesce(F.get(hinted, F.lit(0)), F.get(rest, F.lit(0))).alias("institution"))

    return F.transform(split_list(text), parsed)


# How large nodes are drawn; a publication grows by its citations up to the most.
OTHER_SIZE, LEAST_SIZE, MOST_CITED = 5, 8, 60


def cited_graph(nodes: DataFrame, edges: DataFrame, cited: DataFrame, limit: int, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """The graph around the ``limit`` most cited publications, where no graph store answers: nodes (node,
    label, value, size) and edges (src, dst, type, weight), with the publications' own edges to nodes of
    the labels, equal ones counted. cited has (node, citations); a missing count is 0, ties go by node."""
    citations = F.coalesce(F.col("citations"), F.lit(0))
    focus = cited.select("node", citations.alias("citations")).orderBy(F.desc("citations"), "node").limit(limit)
    near = F.broadcast(focus.select(F.col("node").alias("src")))  # limit rows
    own = merged_edges(edges.join(near, "src", "left_semi"))
    ends = nodes.where(F.col("label").isin(labels)).select("node", "label", "value")
    kept = own.join(ends.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "type", "weight")
    size = F.lit(LEAST_SIZE) + F.least(F.floor("citations"), F.lit(MOST_CITED))
    centre = nodes.join(F.broadcast(focus), "node").select("node", "label", "value", size.cast("int").alias("size"))
    around = ends.join(kept.select(F.col("dst").alias("node")), "node", "left_semi").join(near.withColumnRenamed("src", "node"), "node", "left_anti")
    return centre.unionByName(around.withColumn("size", F.lit(OTHER_SIZE))), kept


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def seed(nodes: DataFrame, edges: DataFrame, label: str, rank_by: Column, n: int, most_edges: int = 1500) -> DataFrame:
    """The edges around the n nodes of a label with the highest degree (then rank_by, then name), up
    to most_edges in the order of their ends."""
    if not 1 <= n <= 100:
        raise ValueError("n must be between 1 and 100")
    tops = nodes.where(F.col("label") == label).join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    tops = tops.withColumn("_rank", rank_by).orderBy(F.desc("degree"), F.desc_nulls_last("_rank"), "node").limit(n).select("node", "degree")
    out = undirected(edges).join(F.broadcast(tops.withColumnRenamed("node", "src")), "src")  # n rows
    return out.select("src", "degree", "dst", "type").orderBy("src", "type", "dst").limit(most_edges)


def neighborhood(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """The undirected one-hop neighbours of a node."""
    near = undirected(edges).where(F.col("src") == node).select(F.col("dst").alias("node"), "type").distinct()
    return near.join(nodes, "node").select("node", "type", "label", "value")


def scope_bits(nodes: DataFrame, edges: DataFrame, publications: DataFrame) -> DataFrame:
    """nodes with bits: a bit for each scope that a node belongs to. publications (node, bits) have their
    own; any other node has those of the publications within two edges of it. Bits are combined on the
    way, so two aggregations settle every scope at once."""
    both = undirected(edges).select("src", "dst").distinct()
    step = lambda near: near.withColumnRenamed("node", "src").join(both, "src").groupBy(F.col("dst").alias("node")).agg(F.bit_or("bits").alias("bits"))
    one = step(publications.select("node", "bits"))
    around = one.unionByName(step(one)).groupBy("node").agg(F.bit_or("bits").alias("around"))
    out = nodes.join(publications.select("node", F.col("bits").alias("own")), "node", "left").join(around, "node", "left")
    return out.withColumn("bits", F.coalesce("own", "around", F.lit(0).cast("long"))).drop("own", "around")


def in_scope(scope: int) -> Column:
    """Nodes of scope_bits() in a scope; below 0 all."""
    return F.lit(True) if scope < 0 else F.col("bits").bitwiseAND(F.lit(1 << scope).cast("long")) != 0


def matching(nodes: DataFrame, edges: DataFrame, path: list[tuple[str | None, str]], value: str) -> DataFrame:
    """(node) where a path of directed edges (type or any, label of the end) begins that ends at a node
    of that value: semi-joins from the end back."""
    ends = nodes.where((F.col("label") == path[-1][1]) & (F.col("value") == value)).select("node")
    for i in range(len(path) - 1, -1, -1):
        own = edges.where(F.col("type") == path[i][0]) if path[i][0] else edges
        ends = own.join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        if i:
            ends = ends.join(nodes.where(F.col("label") == path[i - 1][1]), "node", "left_semi")
    return ends


def scoped_seed(scoped: DataFrame, edges: DataFrame, label: str, rank_by: Column, n: int, scope: int = -1, kinds: list[str] = (), labels: list[str] = (), among: DataFrame | None = None, most_edges: int = 1500) -> DataFrame:
    """(src, place, degree, dst, type): the edges of the n nodes of a label in a scope (and in ``among``,
    if given) with the highest degree over all edges, then rank_by, then name. Edges are of the kinds and
    lead to the labels, if those are given, and the first most_edges by the seeds' places stay."""
    if not 1 <= n <= 100:
        raise ValueError("n must be between 1 and 100")
    tops = scoped.where((F.col("label") == label) & in_scope(scope))
    tops = tops.join(among.select("node"), "node", "left_semi") if among is not None else tops
    tops = tops.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("_rank", rank_by)
    order = [F.desc("degree"), F.desc_nulls_last("_rank"), F.col("node")]
    tops = tops.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    out = undirected(edges.where(F.col("type").isin(*kinds)) if kinds else edges)
    out = out.join(F.broadcast(tops.select(F.col("node").alias("src"), "place", "degree")), "src")  # n rows
    if labels:
        out = out.join(scoped.where(F.col("label").isin(*labels)).select(F.col("node").alias("dst")), "dst", "left_semi")
    return out.select("src", "place", "degree", "dst", "type").orderBy("place", "type", "dst").limit(most_edges)


def scoped_neighborhood(scoped: DataFrame, edges: DataFrame, node: str, scope: int = -1, kinds: list[str] = (), most: int = 1500) -> DataFrame:
    """The undirected one-hop neighbours of a node that are in a scope, none if the node itself is not."""
    centre = scoped.where((F.col("node") == node) & in_scope(scope)).select(F.col("node").alias("src"))
    own = undirected(edges.where(F.col("type").isin(*kinds)) if kinds else edges).where(F.col("src") == node)
    near = own.join(F.broadcast(centre), "src", "left_semi").select(F.col("dst").alias("node"), "type").distinct()  # one row
    return near.join(scoped.where(in_scope(scope)), "node").select("node", "type", "label", "value").orderBy("type", "node").limit(most)


def network_coverage(nodes: DataFrame, key: str, weight: str, cluster: str, reading: DataFrame, papers: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How a reading list (distinct keys) covers a weighted network: one row of figures, the list's
    papers by quartile of the weight's rank, and nodes and papers by cluster. Ranks go by weight
    descending, then key, over ranges of both, so no window holds all nodes; medians are read at ranks."""
    places = ranked(nodes.select(key, F.col(weight).cast("double").alias("w"), F.col(cluster).alias("cluster")), [F.desc("w"), F.col(key)])
    mark = reading.select(F.col(key)).distinct().withColumn("read", F.lit(True))
    marked = written(places.join(mark, key, "left").withColumn("read", F.coalesce("read", F.lit(False))), "network-ranks")
    read = written(ranked(marked.where("read"), [F.col("rank")], name="place"), "reading-ranks")
    sizes = marked.agg(F.count("*").alias("n"), F.count_if("read").alias("r")).first()
    n, r = sizes["n"], sizes["r"]
    middle = lambda size: [(size + 1) // 2, size // 2 + 1]
    a, b = F.col("rank"), n or 1
    figures = marked.agg(
        F.count_if("read").alias("reading_papers"), F.count("*").alias("nodes"), (F.count("*") / F.lit(papers)).alias("map_coverage"),
        F.avg(F.when(a.isin(*middle(n)), F.col("w"))).alias("full_median"), F.avg("w").alias("full_mean"), F.avg(F.when(F.col("read"), F.col("w"))).alias("reading_mean"),
        F.count_if(F.col("read") & (a <= -(-b // 10))).alias("top_decile"), F.count_if(F.col("read") & (a <= -(-b // 4))).alias("top_quartile"),
        F.count_if(F.col("read") & (a > -(-3 * b // 4))).alias("bottom_quartile"),
    )
    at = F.col("place").isin(*middle(r))
    halves = read.agg(F.avg(F.when(at, F.col("w"))).alias("reading_median"), F.avg(F.when(at, a)).alias("median_rank"))
    clusters = marked.groupBy("cluster").agg(F.count("*").alias("nodes"), F.count_if("read").alias("papers"))
    clusters = clusters.withColumn("node_share", F.col("nodes") / F.lit(n or 1)).withColumn("paper_share", F.try_divide(F.col("papers").cast("double"), F.lit(float(r))))
    mass = clusters.agg(F.count("*").alias("clusters"), F.count_if(F.col("papers") > 0).alias("clusters_read"), F.coalesce(F.sum(F.when(F.col("papers") > 0, F.col("node_share"))), F.lit(0.0)).alias("read_mass"))
    one = lambda df: F.broadcast(df.withColumn("_k", F.lit(1)))  # noqa: E731  one row
    summary = figures.withColumn("_k", F.lit(1)).join(one(halves), "_k").join(one(mass), "_k").drop("_k")
    quartile = F.least(F.greatest(F.ceil(a / b * 4), F.lit(1)), F.lit(4)).cast("int")
    counts = read.groupBy(quartile.alias("quartile")).agg(F.count("*").alias("papers"))
    quartiles = marked.sparkSession.range(1, 5).select(F.col("id").cast("int").alias("quartile")).join(counts, "quartile", "left").fillna(0, ["papers"])
    return summary, quartiles.withColumn("share", F.try_divide(F.col("papers").cast("double"), F.lit(float(r)))), clusters


def two_hop_scope(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes within two hops of a seed node (column node), with their least distance. Each hop is a
    join on distinct frontier nodes, so no path is listed twice."""
    both = undirected(edges).select("src", "dst").distinct()
    step = lambda front: front.select(F.col("node").alias("src")).join(both, "src").select(F.col("dst").alias("node")).distinct()
    zero = seeds.select("node").distinct()
    one = step(zero)
    two = step(one)
    hops = zero.withColumn("hops", F.lit(0)).unionByName(one.withColumn("hops", F.lit(1))).unionByName(two.withColumn("hops", F.lit(2)))
    return hops.groupBy("node").agg(F.min("hops").alias("hops")).join(nodes.select("node", "label"), "node")


def search(nodes: DataFrame, edges: DataFrame, text: str, labels: list[str] | None = None, n: int = 50) -> DataFrame:
    """Nodes whose value or any property contains the text in any case, by degree."""
    hit = F.exists(F.coalesce(F.map_values("props"), F.array().cast("array<string>")), lambda v: F.contains(F.lower(v), F.lit(text.lower()))) | F.contains(F.lower("value"), F.lit(text.lower()))
    rows = nodes.where(hit & F.col("label").isin(*labels)) if labels else nodes.where(hit)
    out = rows.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.orderBy(F.desc("degree"), "node").limit(n).select("node", "label", "value", "degree")


def nearest_by_matches(df: DataFrame, key: str, columns: list[str], wanted: str | int, n: int) -> DataFrame:
    """The n rows that agree with one row in most columns: its values are looked up and compared as
    literals in one pass."""
    row = df.where(F.col(key) == wanted).select(*columns).limit(1).collect()
    if not row:
        return df.limit(0).select(key).withColumn("score", F.lit(0))
    score = reduce(lambda a, b: a + b, [(F.col(c).eqNullSafe(F.lit(row[0][c]))).cast("int") for c in columns])
    return df.where(F.col(key) != wanted).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(n)


def caption(props: Column, precedence: list[str], value: Column) -> Column:
    """The first property of a precedence list, else the value."""
    return F.coalesce(*[F.element_at(props, F.lit(p)) for p in precedence], value)


def representative_edges(wide: DataFrame, topic: str, columns: list[str]) -> DataFrame:
    """(topic, rank, paper) of the representative columns."""
    cells = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.col(c).alias("paper")) for i, c in enumerate(columns)])
    return wide.select(topic, F.explode(cells).alias("x")).select(topic, "x.*").where("paper IS NOT NULL")


def rank_columns(df: DataFrame, topic: str, paper: str, order: list, n: int = 3) -> DataFrame:
    """The n first papers of each topic as columns representative_1..n."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(topic).orderBy(*order))).where(F.col("_r") <= n)
    return ranked.groupBy(topic).pivot("_r", list(range(1, n + 1))).agg(F.first(paper)).toDF(topic, *[f"representative_{i}" for i in range(1, n + 1)])
