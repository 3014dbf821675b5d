"""Column expressions for cleaning, coercion, identifiers and lists. All run in the JVM.

Each rule is named for what it does; rules that look alike but differ are kept apart on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space at either end, which trim() leaves.
_ENDS = r"(?U)^\s+|\s+$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean(c: Column) -> Column:
    """Text without white space at its ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), _ENDS, "")


def clean_or_null(c: Column) -> Column:
    """clean(), with empty as null. The text "nan" is a value like any other."""
    return F.nullif(clean(c), F.lit(""))


def graph_clean(c: Column) -> Column:
    """clean(), with empty, nan, none and null in any case as null."""
    v = clean(c)
    return F.when(~F.lower(v).isin("", "nan", "none", "null"), v)


def or_missing(c: Column, label: str = "Missing value") -> Column:
    """clean(), with a label for empty."""
    v = clean(c)
    return F.when(v == "", F.lit(label)).otherwise(v)


def truthy(c: Column) -> Column:
    """1, true, yes, y and x in any case."""
    return F.lower(clean(c)).isin("1", "true", "yes", "y", "x")


def truthy_narrow(c: Column) -> Column:
    """1, true and yes in any case."""
    return F.lower(clean(c)).isin("1", "true", "yes")


def number(c: Column) -> Column:
    """Text as double where all of it is a plain number, else null (never NaN, never an error)."""
    v = clean(c)
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


def flag(c: Column) -> Column:
    """Text that is numerically 1."""
    return F.coalesce(number(c), F.lit(0.0)) == 1


def split_list(c: Column, separator: str = ";") -> Column:
    """The non-empty parts of a delimited list, in order."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator, -1), clean), lambda x: x != "")


def distinct_codes(c: Column, separator: str = ";") -> Column:
    """The different parts of a delimited list, in order of first appearance."""
    return F.array_distinct(split_list(c, separator))


def strip_scores(c: Column) -> Column:
    """"phrase:score;..." as "phrase;..."."""
    return F.array_join(F.filter(F.transform(split_list(c), lambda x: clean(F.split(x, ":").getItem(0))), lambda x: x != ""), ";")


def collapse_space(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return clean(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _words_only(c: Column) -> Column:
    return clean(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def dedup_key(eid: Column, doi: Column, title: Column, year: Column) -> Column:
    """eid: before doi: before title_year:, null where none of them can be made."""
    e = F.regexp_replace(F.lower(F.coalesce(eid, F.lit(""))), r"(?U)\s+", "")
    d = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(doi, F.lit(""))), r"(?U)\s+", ""), r"^https?://(dx\.)?doi\.org/", "")
    t, y = _words_only(title), clean(year)
    return F.when(e != "", F.concat(F.lit("eid:"), e)).when(d != "", F.concat(F.lit("doi:"), d)).when((t != "") & (y != ""), F.concat(F.lit("title_year:"), t, F.lit(":"), y))


def norm_title_plain(c: Column) -> Column:
    """Lower case, all but a-z and 0-9 as spaces: no accent folding."""
    return _words_only(c)


def norm_title_registry(c: Column) -> Column:
    """Lower case with white space collapsed, nothing else."""
    return F.lower(collapse_space(c))


def norm_issn(c: Column) -> Column:
    """Upper case, digits and X alone."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^0-9X]", "")


def norm_doi(c: Column) -> Column:
    """Lower case, no address prefix, no white space, no closing punctuation; null if nothing is left."""
    v = F.regexp_replace(F.regexp_replace(F.lower(clean(c)), r"^https?://(dx\.)?doi\.org/", ""), r"(?U)\s+", "")
    return F.nullif(F.regexp_replace(v, r"[.,;)]+$", ""), F.lit(""))


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def period(year: Column, bounds: list[tuple[str, int | None, int | None]]) -> Column:
    """The id of the first (id, first year, last year) that holds the year; a null bound is open."""
    out = None
    for name, lo, hi in bounds:
        inside = year.isNotNull() & (F.lit(True) if lo is None else year >= lo) & (F.lit(True) if hi is None else year <= hi)
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out


def stable_seed(*parts: str) -> int:
    """A seed from text parts, the same everywhere."""
    import hashlib

    return int(hashlib.sha256("|".join(parts).encode()).hexdigest()[:15], 16)


def approx_tokens(text: Column, overhead: int) -> Column:
    """A cost estimate: overhead + max(50, a quarter of the characters)."""
    return (F.lit(overhead) + F.greatest(F.lit(50), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4))).cast("long")


def node_id(label: Column, value: Column) -> Column:
    """label::value, both percent-encoded with %20 for spaces."""
    quote = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(quote(label), F.lit("::"), quote(value))
