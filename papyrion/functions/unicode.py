"""Unicode rules that Spark has no expression for, as Pandas UDFs. Apply them to distinct terms and
join the result back, not to every row of a large table."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc_casefold(values: pd.Series) -> pd.Series:
    """Compatibility composition and full case folding; null stays null."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(StringType())
def fold_title(values: pd.Series) -> pd.Series:
    """Accents dropped, lower case, & as "and", all but letters and digits as single spaces."""

    def fold(v: str | None) -> str | None:
        if v is None:
            return None
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch))
        plain = plain.lower().replace("&", " and ")
        return " ".join("".join(ch if ch.isalnum() else " " for ch in plain).split())

    return values.map(fold)
