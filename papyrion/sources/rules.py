"""Rules kept in files: term groups, source titles, aliases and dates, in YAML or JSON.

Rule files are small and read on the driver, by Spark, so that they may lie wherever it reads; what
comes of them goes into plans as literals or as small tables.
"""

from __future__ import annotations

import json
import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

# Fixed value: how a search names an exact source title.
_TITLE = re.compile(r'LIMIT-TO\s*\(\s*EXACTSRCTITLE\s*,\s*"([^"]+)"', re.I)


def load_rules(spark: SparkSession, path: str) -> dict:
    """The file's mapping; an empty file gives an empty one."""
    text = spark.read.text(path, wholetext=True).first()
    if path.lower().endswith(".json"):
        found = json.loads(text[0]) if text else {}
    else:
        import yaml

        found = yaml.safe_load(text[0]) if text else {}
    if not isinstance(found or {}, dict):
        raise ValueError(f"{path} holds no mapping")
    return found or {}


def term_groups(rules: dict, names: dict[str, str]) -> dict[str, list[str]]:
    """Term lists by group: names gives each group's key in the file; a missing one is empty."""
    return {group: [str(t) for t in rules.get(key) or []] for group, key in names.items()}


def source_titles(spark: SparkSession, rules: dict) -> DataFrame:
    """(query, title): the exact source titles that each of the file's queries names, each once, and
    all of them again as the query "combined"."""
    rows = {(name, title.strip()) for name, q in (rules.get("queries") or {}).items() for title in _TITLE.findall(q.get("scopus_query") or "") if title.strip()}
    rows |= {("combined", title) for _, title in rows}
    return spark.createDataFrame(sorted(rows), "query string, title string")


def aliases(rules: dict) -> dict[str, str]:
    """Aliases, both sides in lower case with single spaces."""
    plain = lambda x: " ".join(str(x).split()).casefold()
    return {plain(a): plain(b) for a, b in (rules.get("aliases") or {}).items()}


def cutoff(rules: dict, key: str = "date_updated") -> date:
    """The date of the search; an error where the file lacks it."""
    value = rules.get(key)
    if not value:
        raise ValueError(f"the rules have no {key}")
    return value if isinstance(value, date) else date.fromisoformat(str(value))
