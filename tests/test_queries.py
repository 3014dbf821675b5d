"""Every registered query of the core against its DuckDB equivalent, and the driver's contract."""

import pytest
from oracle import compare

import __spark_entry__ as entry
from papyrion.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
# Held to brute force elsewhere: test_reviewed.py, test_phrases.py, test_density.py and test_stored.py.
ROWS_ONLY = {
    "topic_model", "stratified_draw", "sampling_stability", "bootstrap_ci", "topic_count_choice", "topic_reduction", "topic_density", "phrase_texts", "phrase_matches",
    "topic_rerun", "topic_rerun_terms",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name], D) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert name in ROWS_ONLY and QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    first, again = entry.entry(spark), entry.entry(spark)
    assert first.schema == again.schema and first.count() > 0


def test_registries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
