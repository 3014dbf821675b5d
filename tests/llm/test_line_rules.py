import os
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from papyrion.llm import line_rules
from papyrion.llm.queries import OP3_SQL, op3_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, source string, text string, removed string, n_words int"


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def kept(rows, most=20, remain=30):
    """The verdict of every (id, host, text) row, ids differing."""
    normal = lambda x: " ".join(WORD.findall(x.translate({c: c + 32 for c in range(65, 91)})))
    lines = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    texts = defaultdict(set)
    for _, host, text in rows:
        texts[host].add(text or "")
    often = {h: Counter(x for t in ts for x in {normal(x) for x in lines(t)}) for h, ts in texts.items()}
    out = {}
    for i, host, text in rows:
        n, *_, repeats = statistics(text)
        gone = sum(len(WORD.findall(x)) for x in lines(text) if often[host][normal(x)] > most)
        out[i] = n >= 50 and 100 * repeats <= 50 * n and (n - gone) * 100 >= n * remain
    return out


@given(st.lists(st.text(alphabet=st.sampled_from("ab#<é \n\t\x1f"), max_size=60), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_statistics(spark, texts):
    rows = [(i, "h", t, None, None) for i, t in enumerate(texts)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = line_rules.base_statistics(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: tuple(r[n] for n in names) for r in got} == {i: statistics(t) for i, t in enumerate(texts)}


def test_long_text(spark):
    text = "one two three four five " * 40000 + "\nlast"
    row = line_rules.base_statistics(spark.createDataFrame([(1, "h", text, None, None)], SCHEMA)).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (200001, 200000, True)


BODY = " ".join(f"w{i}" for i in range(60))


def corpus():
    rows = [(i, "a", f"Share   THIS page\n{BODY} {i}\n") for i in range(30)]
    rows += [(100 + i, "b", f"share this page\n{BODY} b{i}") for i in range(20)]  # too few documents
    rows += [(200 + i, "c", f"{BODY}\nown {i}") for i in range(22)]  # depleted
    rows += [(300 + i, "d", f"only copy\n{BODY}") for i in range(40)]  # one document, however often
    rows += [(400 + i, None, f"null host\n{BODY} n{i}") for i in range(21)]
    return rows + [(500, "a", None), (501, "a", ""), (502, None, " \n\t"), (503, "a", BODY + " plain")]


def test_verdicts(spark):
    rows = corpus()
    got = line_rules.judge(spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.kept for r in got} == kept(rows)
    assert not any(kept(rows)[200 + i] for i in range(22)) and all(kept(rows)[300 + i] for i in range(40))


def test_frequent_lines_go_and_the_rest_stays(spark):
    df = spark.createDataFrame([(*r, "x", 7) for r in corpus()], SCHEMA)
    texts = {r.doc_id: r.text for r in line_rules.without_removed(line_rules.judge(df)).collect()}
    assert texts[3] == f"{BODY} 3\n" and texts[103] == f"share this page\n{BODY} b3" and texts[404] == f"{BODY} n4" and texts[500] is None


def test_repeated_ids_and_null_ids(spark):
    rows = [(1, "a", BODY, None, None)] * 2 + [(None, "a", BODY, None, None), (None, None, None, None, None)]
    got = line_rules.judge(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id or 0, r.kept) for r in got.collect()) == [(0, False), (0, True), (1, True), (1, True)]
    assert {"removed", "removed_words", "source", "text"} <= set(got.columns) and len(set(got.columns)) == len(got.columns)


def test_sql_agrees_on_nulls_ties_and_copies(spark, tmp_path):
    rows = [*corpus(), *corpus()[:40], *[(None, h, t) for _, h, t in corpus()[::7]], (200, "a", BODY), (5, "a", "\n".join(["share this page"] * 60))]
    tables = "/root/testdata/sf0.001"
    for name in os.listdir(tables):
        if name != "documents.parquet":
            os.symlink(f"{tables}/{name}", tmp_path / name)
    spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA).select("doc_id", "source", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert compare(spark, op3_quality_rules, OP3_SQL, str(tmp_path)) == ""


def test_empty_table(spark):
    assert line_rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    assert compare(spark, op3_quality_rules, OP3_SQL, "/root/testdata/sf0.001") == ""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text").collect()]
    got = op3_quality_rules(spark, "/root/testdata/sf0.001").select("doc_id", "kept", F.array("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").alias("s")).collect()
    assert {r.doc_id: r.kept for r in got} == kept(docs)
    assert {r.doc_id: tuple(r.s) for r in got} == {i: statistics(t) for i, _, t in docs}
