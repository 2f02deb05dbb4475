import random
import re

import pytest
from pyspark.sql import functions as F

from catalog.queries import DEMO_DOCUMENT
from veritab.functions.numbers import relative_deviation
from veritab.functions.text import strip_separators
from veritab.operators import churn, compare
from veritab.operators.compare import compare_with_all_rows, compare_with_block_rows
from veritab.operators.confidence import FEATURES, ConfidenceModel, synthetic_history
from veritab.operators.extract import PATTERNS, extract, extraction_summary, flat_fields, long_fields
from veritab.plans import crosscheck as cc
from veritab.sources.fixtures import field_mapping, seed_master
from veritab.streaming.checks import crosscheck_batch, crosscheck_stream, drain, read_files


def documents(spark, *docs):
    schema = "doc_id string, " + ", ".join(f"{f} string" for f in DEMO_DOCUMENT)
    return spark.createDataFrame([(f"d{i}", *d.values()) for i, d in enumerate(docs)], schema)


def test_demo_document(spark, tmp_path):
    stranger = {f: None for f in DEMO_DOCUMENT} | {"nama_pelanggan": "QQQ"}
    right = DEMO_DOCUMENT | {"stand_meter_akhir": "15.480", "pemakaian_kwh": "250", "biaya_listrik": "Rp 352.500"}
    model = ConfidenceModel.trained_on_synthetic(spark)
    assert model.metrics["samples"] == 500 and model.metrics["valid_count"] == 300
    assert model.metrics["train_accuracy"] > 0.95
    done = cc.crosscheck(documents(spark, DEMO_DOCUMENT, stranger, right), seed_master(spark), model=model).cache()
    demo, lost, good = done.orderBy("doc_id").collect()
    assert (demo.matched_row_number, demo.total_match, demo.total_mismatch, demo.total_missing) == (1, 9, 2, 0)
    assert (demo.match_percentage, demo.verdict, demo.report_status) == (81.8, "MISMATCH DETECTED", "PARTIAL MATCH")
    assert demo.anomaly_flags == [] and demo.billing_deviation == 0
    assert demo.meter_deviation == pytest.approx(30 / 15480)
    assert (lost.verdict, lost.matched_row_index, lost.total_missing, lost.confidence_score) == ("UNVERIFIED", None, 11, None)
    assert (good.verdict, good.risk_level, good.prediction) == ("VERIFIED", "LOW", "VALID")
    assert [f.feature for f in good.feature_contributions] == list(FEATURES)
    errors = cc.error_log(done).collect()
    assert [(e.error_number, e.field_name) for e in errors] == [(1, "Stand Meter Akhir"), (2, "Pemakaian (kWh)")]
    root = cc.write_crosscheck_report(done, str(tmp_path), "demo")
    assert spark.read.parquet(f"{root}/detail").count() == 33
    assert model.explain(spark).count() == 7


def test_all_rows(spark):
    done = compare_with_all_rows(DEMO_DOCUMENT, seed_master(spark)).orderBy("row_idx").collect()
    assert [r.match_percentage for r in done] == [81.8, 18.2, 18.2, 36.4, 18.2]
    assert field_mapping(spark).count() == 12


@pytest.mark.parametrize("cell", [2, 100])
def test_block_rows(spark, cell):
    """A third of all documents in one block, cut into cells or not: the pairs of the blocks, compared as one by one."""
    given = [DEMO_DOCUMENT | {"nomor_meter": str(i), "periode": str(i % 3)} for i in range(12)]
    rows = seed_master(spark).withColumn("Periode", (F.col("row_idx") % 2).cast("string"))
    docs = documents(spark, *given).withColumn("periode", F.when(F.col("periode") != "2", F.col("periode")))
    done = compare_with_block_rows(docs, rows, F.col("periode"), F.col("Periode"), cell=cell).collect()
    want = {}
    for i, d in enumerate(given):
        for r in compare_with_all_rows(d, rows).collect() if i % 3 != 2 else []:
            if r.row_idx % 2 == i % 3:
                want[f"d{i}", r.row_idx] = (r.match_count, r.match_percentage, r.results)
    assert len(done) == len(want)
    assert {(r.doc_id, r.row_idx): (r.match_count, r.match_percentage, r.results) for r in done} == want
    every = compare_with_block_rows(docs, rows, F.lit(1), F.lit(1), use_ml=False, cell=cell)
    assert every.count() == 60 and every.select("doc_id", "row_idx").distinct().count() == 60
    assert compare_with_block_rows(docs.limit(0), rows, F.lit(1), F.lit(1)).count() == 0


def test_stream_keeps_to_its_master(spark, tmp_path):
    docs = documents(spark, DEMO_DOCUMENT, DEMO_DOCUMENT | {"id_pelanggan": "532100012346"})
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    seed_master(spark).write.parquet(f"{tmp_path}/v1")
    seed_master(spark).filter("row_idx > 90").write.parquet(f"{tmp_path}/v2")
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    crosscheck_stream(read_files(spark, f"{tmp_path}/in", docs.schema), lambda: f"{tmp_path}/v1", out, state)
    once = sorted(spark.read.parquet(out).drop("checked_at").collect())
    assert len(once) == 2 and once[0].matched_row_index == 0
    crosscheck_batch(docs, 0, lambda: f"{tmp_path}/v2", out, state)
    assert sorted(spark.read.parquet(out).drop("checked_at").collect()) == once
    crosscheck_batch(docs, 1, lambda: f"{tmp_path}/v2", out, state)
    assert spark.read.parquet(f"{out}/batch=1").filter("matched_row_index is not null").count() == 0


PAGES = {
    "lines": ["ID Pelanggan : 532100012345\nNama : SUHARTO\nAlamat : JL. ELOK NO.23 JAKARTA\nPemakaian : 250 kWh\nBiaya Listrik : Rp 352.500"],
    "bare": ["x 532100012345 y JTX476", "Pemakaian (kWh) : 250"],
    "across": ["page one ends with Nomor Meter :", "JTX99 begins page two"],
    "far": ["Stand Awal", "", "  ", "", ": 1.250"],
    "empty": [""],
}


def by_hand(pages):
    out = {}
    full = "\n".join(pages)
    for field, patterns in PATTERNS.items():
        for p in patterns:
            grade = "high" if len(patterns) == 1 else "medium"
            for number, where, conf in [*((i + 1, t, grade) for i, t in enumerate(pages)), (None, full, "low")]:
                m = re.search(p, where, re.I | re.M)
                if m:
                    out[field] = ((m.group(1) if m.lastindex else m.group(0)).strip(), conf, number)
                    break
            if field in out:
                break
    return out


@pytest.mark.parametrize("window", [256, 4])
def test_extraction(spark, window):
    rows = [(d, i + 1, t) for d, ts in PAGES.items() for i, t in enumerate(ts)]
    filler = [f"words here {i}" for i in range(11)]
    filler[3], filler[4], filler[8] = "No Ref", "AB-7", "Periode Januari 2026"
    rows += [("long", i + 1, t) for i, t in enumerate(filler)]
    done = extract(spark.createDataFrame(rows, "doc_id string, page_number int, text string"), window_pages=window).cache()
    got = {}
    for r in long_fields(done).collect():
        got.setdefault(r.doc_id, {})[r.field] = (r.value, r.confidence, r.page)
    want = {d: by_hand(ts) for d, ts in [*PAGES.items(), ("long", filler)]}
    assert got == {d: f for d, f in want.items() if f}
    assert got["across"]["nomor_meter"] == ("JTX99", "low", None)
    assert flat_fields(done).count() == 6
    counts = {r.doc_id: (r.pages, r.fields_found) for r in extraction_summary(done).collect()}
    assert counts["empty"] == (1, 0) and counts["long"][0] == 11


def test_extraction_over_runs_of_empty_and_numeric_pages(spark):
    long = {
        "blank": ["Stand Awal", *[""] * 700, ": 77", "Nama Pelanggan", *["  "] * 300, "SUHARTO"],
        "numeric": ["ID Pelanggan : 53", *["1 2 3"] * 40, "end", "Stand Akhir 5"],
        "nothing": [""] * 600,
    }
    rows = [(d, i + 1, t) for d, ts in long.items() for i, t in enumerate(ts)]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    want = {d: by_hand([t.strip() for t in ts]) for d, ts in long.items()}
    for window in (256, 3):
        got = {d: {} for d in long}
        done = extract(pages, window_pages=window)
        for r in long_fields(done).collect():
            got[r.doc_id][r.field] = (r.value, r.confidence, r.page)
        assert got == want
        assert {r.doc_id: r.pages for r in done.collect()} == {d: len(ts) for d, ts in long.items()}


def test_own_patterns_are_searched_in_whole_documents(spark):
    rows = [("d", 1, "from here")] + [("d", i, f"word {i}") for i in range(2, 40)] + [("d", 40, "to there")]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    found = long_fields(extract(pages, {"span": [r"here([\s\S]*)to"]}, window_pages=2)).first()
    assert found.value.startswith("word 2") and found.value.endswith("word 39")


def test_split_and_trees(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 5 = 0 as int) as y", "cast(id % 5 as double) + rand(1) * 0.1 as x", "rand(2) as z")
    split = churn.stratified_split(df, "y", ["id"]).cache()
    counts = {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert counts == {(1, "train"): 120, (1, "validate"): 40, (1, "test"): 40, (0, "train"): 480, (0, "validate"): 160, (0, "test"): 160}
    tuned = churn.tune_boosted_trees(split.filter("split = 'train'"), ["x", "z"], "y", {"maxDepth": [2], "maxIter": [2]}, folds=2)
    predicted = tuned.bestModel.transform(split.filter("split = 'test'"))
    assert churn.recall(predicted, "y").first().recall == 1.0
    assert churn.feature_importances(tuned.bestModel, ["x", "z"], spark).first().feature == "x"
    curve = churn.partial_dependence(tuned.bestModel, df, ["x"], 3).orderBy("value").collect()
    assert curve[0].average_probability > curve[-1].average_probability


def test_synthetic_history(spark):
    rows = synthetic_history(spark, 500).collect()
    valid = [r for r in rows if r.label == 1]
    assert len(valid) == 300 and all(r.match_ratio >= 0.85 and r.anomaly_count <= 1 for r in valid)
    assert {r.missing_fields for r in rows if r.label == 0} == {1, 2, 3, 4}


def test_stream(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) as doc_id", "0L as n").write.parquet(str(tmp_path / "in"))
    stream = read_files(spark, str(tmp_path / "in"), "doc_id string, n long")
    drain(stream, lambda df: df.filter("doc_id > '4'"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_registered_boosted_trees_search_the_whole_grid(spark, monkeypatch):
    from catalog import queries

    asked = []
    monkeypatch.setattr(churn, "tune_boosted_trees", lambda *args, **more: asked.append((args, more)))
    queries._tuned.__wrapped__(spark, "/root/testdata/sf0.001")
    (train, features, label, grid), more = asked[0]
    assert grid == churn.GRID and more == {"folds": 5} and label == "quality" and features == queries.FEATURES
    assert [len(v) for v in grid.values()] == [2, 2, 3, 2]
    n = queries._labelled(spark, "/root/testdata/sf0.001").count()
    assert abs(train.count() - 0.6 * n) <= 2


def test_counts_of_block_pairs_are_those_of_the_results(spark):
    """Counts come from the tests alone: the same numbers as from the results, and no result is made where only they are asked."""
    rng = random.Random(4)
    given = {f: [None, "", " ", "a", "A b", "jl. a no 5", "jalan a b no 5", "1.000", "Rp 1000", "1000"] for f in compare.COLUMN_TO_FIELD.values()}
    docs = spark.createDataFrame([(f"d{i}", *(rng.choice(v) for v in given.values())) for i in range(40)], "doc_id string, " + ", ".join(f"{f} string" for f in given))
    master = spark.createDataFrame([(i, *(rng.choice(v) for v in given.values())) for i in range(60)], "row_idx long, " + ", ".join(f"`{c}` string" for c in compare.COLUMN_TO_FIELD))
    for use_ml in (True, False):
        done = compare.compare_with_block_rows(docs, master, F.lit("x"), F.lit("x"), cell=7, use_ml=use_ml)
        rows = done.collect()
        assert len(rows) == 40 * 60
        for r in rows:
            n = sum(x.match_status == compare.MATCH for x in r.results)
            assert (r.match_count, r.match_percentage) == (n, round(n / 11 * 1000) / 10)
        assert sum(r.match_count for r in rows) > 0
        plan = done.select("doc_id", "row_idx", "match_count", "match_percentage")._jdf.queryExecution().optimizedPlan().toString()
        assert "match_status" not in plan and "named_struct" not in plan
        if use_ml:
            waiting = plan[plan.index("ArrowEvalPython"):].split("\n")[1]
            assert "Project" in waiting and "Contains" in waiting, waiting


def test_deviations_parse_each_side_once(spark):
    """The same numbers as relative_deviation, with one removal of separators for each of the four texts."""
    values = ["1.000", "Rp 2000", "", None, "abc", "0", "15,5"]
    joined = spark.createDataFrame([(a, b, b, a) for a in values for b in values], "d_x string, m_x string, d_y string, m_y string")
    done = cc._with_deviations(joined, {"x": "dx", "y": "dy"})
    plain = {c: F.expr(strip_separators(c)) for c in joined.columns}
    want = joined.select("*", relative_deviation(plain["d_x"], plain["m_x"]).alias("dx"), relative_deviation(plain["d_y"], plain["m_y"]).alias("dy"))
    assert sorted(map(str, done.collect())) == sorted(map(str, want.collect()))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("[Rr][Pp]") == 4
