"""Multi-label domain assignment, coverage and validation of coded records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import clean, share


def assign_by_codes(papers: DataFrame, paper: str, code: Column, rules: DataFrame) -> DataFrame:
    """(paper, domain, basis): every domain one of whose codes the paper has, with the matched codes
    sorted. rules: (code, domain)."""
    rows = papers.select(F.col(paper), code.alias("code")).distinct().join(rules, "code")
    return rows.groupBy(paper, "domain").agg(F.array_join(F.array_sort(F.collect_set("code")), ";").alias("basis"))


def assign_by_titles(papers: DataFrame, paper: str, title: Column, registry: DataFrame, aliases: DataFrame, norm) -> DataFrame:
    """(paper, domain, basis): by normalised title, or by a reviewed alias of it; one row a domain."""
    p = papers.select(paper, norm(title).alias("t"))
    r = registry.select(norm(F.col("title")).alias("t"), "domain").distinct()
    by_alias = aliases.select(norm(F.col("registered_title")).alias("t"), norm(F.col("corpus_title")).alias("c")).join(r, "t").select(F.col("c").alias("t"), "domain")
    both = r.withColumn("basis", F.lit("title")).unionByName(by_alias.withColumn("basis", F.lit("alias")))
    return p.join(both, "t").groupBy(paper, "domain").agg(F.max("basis").alias("basis"))


def unpivot_flags(papers: DataFrame, paper: str, flags: dict[str, str]) -> DataFrame:
    """(paper, domain) for every flag column that is 1; a value other than 0 and 1 is an error."""
    checked = lambda c: F.when(F.col(c).isin(0, 1), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is neither 0 nor 1")))
    cells = F.array(*[F.struct(F.lit(domain).alias("domain"), checked(c).alias("on")) for c, domain in flags.items()])
    return papers.select(paper, F.explode(cells).alias("x")).where("x.on = 1").select(paper, "x.domain")


def domain_coverage(papers: DataFrame, bridge: DataFrame, paper: str) -> DataFrame:
    """Papers in each domain and in none (residual), with their share of all papers."""
    inside = bridge.groupBy("domain").agg(F.count_distinct(paper).alias("papers"))
    rest = papers.join(bridge, paper, "left_anti").agg(F.count("*").alias("papers")).select(F.lit("(residual)").alias("domain"), "papers")
    total = papers.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    out = inside.unionByName(rest).withColumn("k", F.lit(1)).join(F.broadcast(total), "k")  # one row
    return out.select("domain", "papers", share(F.col("papers"), F.col("n")).alias("share"))


def union_comparison(df: DataFrame, populations: dict[str, Column], value: Column, benchmark: str = "union") -> DataFrame:
    """The distribution of a value in each population and in their union, with the difference from
    the union in percentage points; values a population lacks count 0."""
    held = F.array(*[F.when(p, F.lit(name)) for name, p in populations.items()])
    rows = df.select(value.alias("value"), F.filter(held, lambda x: x.isNotNull()).alias("in")).where(F.size("in") > 0)
    rows = rows.select("value", F.explode(F.concat("in", F.array(F.lit(benchmark)))).alias("population"))
    counts = rows.groupBy("value").pivot("population", [*populations, benchmark]).count().fillna(0)
    names = [*populations, benchmark]
    out = counts.select("value", F.explode(F.array(*[F.struct(F.lit(n).alias("population"), F.col(n).alias("papers")) for n in names])).alias("x")).select("value", "x.*")
    out = out.withColumn("share", share(F.col("papers"), F.sum("papers").over(Window.partitionBy("population"))))
    base = F.max(F.when(F.col("population") == benchmark, F.col("share"))).over(Window.partitionBy("value"))
    return out.withColumn("difference_pp", (F.col("share") - base) * 100)


def token_overlap(text: Column, source: Column) -> Column:
    """The share of the text's different a-z0-9 tokens that the source has; 1 for none."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))
    found = F.size(F.array_intersect(tokens(text), tokens(source))) / F.nullif(F.size(tokens(text)), F.lit(0))
    return F.coalesce(found, F.lit(1.0))


def validate_evidence(df: DataFrame, evidence: str, source: str, kind: str, confidence: str, needs_full_text: Column, min_overlap: float = 0.5) -> DataFrame:
    """df with overlap and issues: GROUNDING_LOW for a non-empty evidence below min_overlap,
    NEEDS_FULL_TEXT for stated evidence of 0.8 confidence or more that is marked as needing it."""
    out = df.withColumn("overlap", token_overlap(F.col(evidence), F.col(source)))
    low = (clean(F.col(evidence)) != "") & (F.col("overlap") < min_overlap)
    conflict = needs_full_text & (F.col(kind) == "stated") & (F.col(confidence) >= 0.8)
    issues = F.filter(F.array(F.when(low, F.lit("GROUNDING_LOW")), F.when(conflict, F.lit("NEEDS_FULL_TEXT"))), lambda x: x.isNotNull())
    return out.withColumn("issues", F.array_join(issues, ";"))


def review_queue(codes: DataFrame, decisions: DataFrame, keys: list[str], accept_at: float = 0.8) -> DataFrame:
    """codes with status and final_value: a decision before a deferral before automatic acceptance
    (stated, confident) before unreviewed; and queue_place for what is open, missing confidence
    first, then the least confident. decisions: keys, decision (value or null), deferred."""
    out = codes.join(decisions, keys, "left")
    status = (
        F.when(F.col("decision").isNotNull(), "decided").when(F.coalesce(F.col("deferred"), F.lit(False)), "deferred")
        .when((F.col("evidence_type") == "stated") & (F.col("confidence") >= accept_at), "accepted").otherwise("unreviewed")
    )
    out = out.withColumn("status", status).withColumn("final_value", F.when(F.col("status") == "decided", F.col("decision")).when(F.col("status") == "accepted", F.col("value")))
    return out.drop("decision", "deferred")


def select_retained(df: DataFrame, group: str, order: list) -> DataFrame:
    """The first row of each group by a mixed-direction ranking."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")
