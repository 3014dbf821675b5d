"""The review store: versions, conflicts, compaction."""

from papyrion.sources.reviews import ReviewStore

ENTRY = "rater string, paper string, label string, note string, expected_version long, moment string, writer string"


def test_two_writers_from_one_version_and_compaction(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path), ["rater", "paper"], "label string, note string")
    rows = lambda df: sorted((tuple(r) for r in df.select("rater", "paper", "label", "version").collect()), key=repr)
    put = lambda *entries: store.append(spark.createDataFrame(list(entries), ENTRY))
    assert rows(store.read()) == [] and store.conflicts().count() == 0
    put(("a", "1", "x", None, 0, "2026-01-01 00:00:00", "w1"), ("a", "2", "x", "n", 0, "2026-01-01 00:00:00", "w1"))
    # Both writers have seen version 1 of (a, 1): the earlier wins, whichever comes first into the log.
    put(("a", "1", "late", None, 1, "2026-01-03 00:00:00", "w2"))
    put(("a", "1", "early", None, 1, "2026-01-02 00:00:00", "w1"))
    want = [("a", "1", "early", 2), ("a", "2", "x", 1)]
    assert rows(store.read()) == want
    (lost,) = store.conflicts().collect()
    assert (lost.label, lost.writer, lost.expected_version, lost.met_version) == ("late", "w2", 1, 2)
    history = sorted((r.entry, r.accepted) for r in store.audit().collect())

    store.compact()
    assert rows(store.read()) == want and store.judged().count() == 0 and sorted((r.entry, r.accepted) for r in store.audit().collect()) == history
    # Entries after it are judged by the versions it kept; the loser tries again.
    put(("a", "1", "late", None, 2, "2026-01-04 00:00:00", "w2"), ("a", "2", "y", None, 0, "2026-01-04 00:00:00", "w3"), ("b", "1", "z", None, 0, "2026-01-04 00:00:00", "w3"))
    want = [("a", "1", "late", 3), ("a", "2", "x", 1), ("b", "1", "z", 1)]
    assert rows(store.read()) == want and store.conflicts().count() == 2
    store.compact()
    store.compact()
    assert rows(store.read()) == want and store.audit().count() == 7
    # A compaction that broke off before its base was whole counts for nothing.
    store.judged().write.parquet(f"{tmp_path}/audit/9")
    assert rows(store.read()) == want and store.audit().count() == 7
