"""Keyword normalisation, prevalence by period, movers, search and variant audit.

A keyword counts once per paper. Denominators are papers with at least one keyword.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import share, split_list
from papyrion.functions.unicode import nfkc_casefold
from papyrion.operators.packing import ranked


def canonical_terms(terms: DataFrame, column: str, aliases: dict[str, str], spelling: dict[str, str], plurals: dict[str, str]) -> DataFrame:
    """(raw, canonical) for the different values of a column: compatibility composition and case
    folding, & as "and", hyphens and other punctuation as spaces; then an exact alias; then
    spelling variants of whole tokens; then the singular of the last token. Python sees each
    different term once."""
    raw = terms.select(F.col(column).alias("raw")).where("raw IS NOT NULL").distinct()
    base = F.regexp_replace(F.regexp_replace(nfkc_casefold("raw"), "&", " and "), r"(?U)[^\w]+|_+", " ")
    out = raw.withColumn("base", F.regexp_replace(F.trim(base), " +", " "))
    known = lambda m, c: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c) if m else F.lit(None).cast("string")
    tokens = F.transform(F.split(F.coalesce(known(aliases, F.col("base")), F.col("base")), " "), lambda t: F.coalesce(known(spelling, t), t))
    last = F.element_at("tokens", -1)
    return out.withColumn("tokens", tokens).select("raw", F.array_join(F.concat(F.expr("slice(tokens, 1, size(tokens) - 1)"), F.array(F.coalesce(known(plurals, last), last))), " ").alias("canonical")).where("canonical <> ''")


def keyword_bridge(df: DataFrame, columns: list[str], keep: list[str], canonical: DataFrame | None = None) -> DataFrame:
    """One row per paper and different keyword of the ";" columns. With ``canonical`` (raw,
    canonical) raw terms are replaced by an equi-join, so normalisation never runs per row."""
    rows = df.select(*keep, F.explode(F.array_distinct(F.concat(*[split_list(F.col(c)) for c in columns]))).alias("keyword"))
    if canonical is not None:
        rows = rows.join(canonical.select(F.col("raw").alias("keyword"), "canonical"), "keyword").select(*keep, F.col("canonical").alias("keyword"))
    return rows.distinct()


def prevalence(bridge: DataFrame, paper: str, period: Column, periods: list[str]) -> DataFrame:
    """period, keyword, papers, denominator, prevalence, previous_papers, change_pp, rank over the
    full grid of ordered periods and keywords: the previous period is always the one before, and
    change is null in the first."""
    rows = bridge.withColumn("period", period).where(F.col("period").isNotNull())
    sizes = rows.groupBy("period").agg(F.count_distinct(paper).alias("denominator"))
    counts = rows.groupBy("period", "keyword").agg(F.count("*").alias("papers"))
    order = F.array(*map(F.lit, periods))
    grid = counts.select("keyword").distinct().select("keyword", F.posexplode(order).alias("place", "period"))
    out = grid.join(counts, ["period", "keyword"], "left").join(sizes, "period", "left").fillna(0, ["papers", "denominator"])
    out = out.withColumn("prevalence", share(F.col("papers"), F.col("denominator")))
    w = Window.partitionBy("keyword").orderBy("place")
    out = out.withColumn("previous_papers", F.lag("papers").over(w)).withColumn("change_pp", (F.col("prevalence") - F.lag("prevalence").over(w)) * 100)
    # A period ranks the whole vocabulary: by ranges, not in one task a period.
    return ranked(out.drop("place"), [F.desc("papers"), F.col("keyword")], ["period"])


def movers(prevalences: DataFrame, least_papers: int, n: int) -> DataFrame:
    """The n keywords of each period that rose, and that fell, most against the period before,
    among those with least_papers in either: direction, place."""
    rows = prevalences.where((F.greatest("papers", "previous_papers") >= least_papers) & (F.col("change_pp") != 0))
    rows = rows.withColumn("direction", F.when(F.col("change_pp") > 0, "emerging").otherwise("declining"))
    w = Window.partitionBy("period", "direction").orderBy(F.desc(F.abs("change_pp")), F.desc("papers"), "keyword")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def keyword_year(bridge: DataFrame, paper: str, year: str, wanted: int, n: int) -> DataFrame:
    """The n commonest keywords of one year with their prevalence; 1 <= n <= 100."""
    if not 1 <= n <= 100:
        raise ValueError("n must be between 1 and 100")
    rows = bridge.where(F.col(year) == wanted)
    counts = rows.groupBy("keyword").agg(F.count("*").alias("papers")).withColumn("k", F.lit(1))
    sizes = rows.agg(F.count_distinct(paper).alias("denominator")).withColumn("k", F.lit(1))
    out = counts.join(F.broadcast(sizes), "k").drop("k").withColumn("prevalence", share(F.col("papers"), F.col("denominator")))
    return out.orderBy(F.desc("papers"), "keyword").limit(n)


def search_keywords(bridge: DataFrame, text: str, n: int) -> DataFrame:
    """Keywords that contain the text: the exact one, then those that begin with it, then by papers,
    then by name."""
    counts = bridge.where(F.col("keyword").contains(text)).groupBy("keyword").agg(F.count("*").alias("papers"))
    return counts.orderBy((F.col("keyword") != text).cast("int"), (~F.col("keyword").startswith(text)).cast("int"), F.desc("papers"), "keyword").limit(n)


def variant_audit(counts: DataFrame, canonical: DataFrame) -> DataFrame:
    """Every raw variant of (keyword, papers) with its canonical term, and how many variants that term has."""
    out = counts.withColumnRenamed("keyword", "raw").join(canonical, "raw")
    return out.withColumn("variants", F.count("*").over(Window.partitionBy("canonical")))


def unresolved_plurals(canonical: DataFrame) -> DataFrame:
    """Canonical terms whose form without a final s is a canonical term too."""
    terms = canonical.select("canonical").distinct()
    plural = terms.where(F.col("canonical").endswith("s")).select(F.col("canonical").alias("plural"), F.expr("left(canonical, length(canonical) - 1)").alias("canonical"))
    return plural.join(terms, "canonical").select(F.col("canonical").alias("singular"), "plural")


def trajectories(bridge: DataFrame, paper: str, year: str, n: int) -> DataFrame:
    """(keyword, year, papers) of the n keywords with the most papers over all years (ties: the smaller
    keyword). The n keywords are a bounded list, so they go to every task."""
    tops = bridge.groupBy("keyword").agg(F.count_distinct(paper).alias("_n")).orderBy(F.desc("_n"), "keyword").limit(n).select("keyword")
    return bridge.join(F.broadcast(tops), "keyword").groupBy("keyword", year).agg(F.count_distinct(paper).alias("papers"))
