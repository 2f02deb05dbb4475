import re
from collections import Counter

import duckdb

from veritab.llm import quality
from veritab.llm.oracle import ORACLE
from veritab.llm.queries import QUERIES
from tests.llm.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force(documents, odd_documents):
    for table in (documents.select("doc_id", "text"), odd_documents):
        got = quality.measured(table, "text", ["doc_id", "text"]).collect()
        assert len(got) == table.count()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


def test_repeats_at_edges(spark):
    texts = ["a b c a b c", "a a a a", "a b c d a b c", "x a b c y a b c z", "a b", "a\nb c\n\na\na"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n_repeat_words for r in quality.measured(table, "text", ["text"]).collect()] == [
        brute(t)[3] for t in texts
    ]


def test_votes_find_planted_junk(spark):
    prose = "the rain over hills and meadows turned slowly into fog while people walked home along quiet roads "
    filler = [[chr(97 + (k + i) % 26) * 5 for i in range(90)] for k in range(80)]
    good = [(k, " ".join(prose.split()[k % 15 :] + filler[k]), True) for k in range(80)]
    junk = [(100 + k, " ".join(f"{chr(97 + (k + i) % 26) * 4}***" for i in range(100)), False) for k in range(20)]
    table = spark.createDataFrame(good + junk, "doc_id long, text string, fine boolean")
    judged = quality.judge(table, keep=("doc_id", "fine"))
    assert judged.where("good <> fine").count() == 0
    assert judged.where("quality < 0 OR quality > 1").count() == 0


def test_odd_and_empty_tables(odd_documents, no_documents):
    judged = quality.judge(odd_documents, keep=("doc_id", "score", "size"))
    assert judged.count() == odd_documents.count()
    assert quality.judge(no_documents).count() == 0


def test_query_equals_sql(spark):
    got = QUERIES["op1_quality_rules"](spark, DATA).toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(ORACLE["op1_quality_rules"]).df().sort_values("doc_id", ignore_index=True)
    assert got.equals(want[list(got.columns)])
    assert not (got.base_failed & got.kept).any()


def test_no_python_in_the_plan(documents):
    plan = quality.judge(documents.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
