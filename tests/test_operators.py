import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab import session
from veritab.functions import grams, numbers, text
from veritab.operators import anomaly, clean, compare, isolation, profile, quantiles, similarity
from veritab.operators.isolation import isolation_forest
from veritab.plans.batch import NUMBERS, check_batch
from veritab.plans.players import player_tables
from veritab.plans.profile_report import profile_report, write_profile_report
from veritab.sources import readers, sinks


def col(df):
    return [r[0] for r in df.collect()]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Ab.c"), (2, "xabxc"), (3, None)], "id int, s string")

    def keep(op, v, c="s", **k):
        return col(clean.filter_rows(df, [{"column": c, "operator": op, "value": v, **k}]))

    assert keep("contains", "b.C") == [1, 2]
    assert keep("contains", "B.c", literal=True) == [1]
    assert keep("startswith", "ab") == []
    assert keep("!=", "Ab.c") == [2, 3]
    assert keep(">=", 2, "id") == [2, 3]
    with pytest.raises(ValueError, match="contains, startswith"):
        clean.filter_rows(df, [{"column": "s", "operator": "~", "value": 1}])


def test_numbers(spark):
    df = spark.createDataFrame([("Rp 352.500",), ("RP 5",), ("250 kWh",), ("1d",), ("inf",), (None,)], "x string")
    assert col(df.select(numbers.amount("x"))) == [352500.0, None, 250.0, None, None, None]
    halves = spark.createDataFrame([(0.445,), (0.125,), (0.995,), (0.4451,), (1.0,)], "x double")
    assert col(halves.select(F.expr(numbers.score_text("x")))) == [f"{v:.2f}" for (v,) in [tuple(r) for r in halves.collect()]]
    assert col(spark.range(1).select(numbers.float_text(F.lit(15230000.0)))) == ["15230000.0"]
    assert col(spark.range(1).select(numbers.parse_date(F.lit("1-1-2023")))) is not None
    with pytest.raises(Exception, match="CAST"):
        df.select(numbers.strict_number("x")).collect()


def test_text(spark):
    df = spark.createDataFrame([(" Rp.  12.500,-\t",), ("jl. X no.23 Jkt",), ("ﬁé€",)], "x string")
    assert col(df.select(F.expr(text.normalize("x"))))[0] == "RP. 12.500,-"
    assert col(df.select(F.expr(text.strip_separators("x"))))[0] == "12500-"
    assert col(df.select(F.expr(text.normalize_address("x"))))[1] == "jalan x nomor23 jakarta"
    assert col(df.select(text.latin1_text("x")))[2] == "fie??"
    assert col(spark.range(1).select(F.expr(text.tariff_key("' r1-1300 VA'")))) == ["R1/1300"]
    assert text.snake_case("average_montly_hours", {"average_montly_hours": "monthly_hours"}) == "monthly_hours"


PAIRS = [
    ("SUHARTO", "SUHARTA", 0.5586),
    ("SUHARTO", "DEWI SARTIKA", 0.0833),
    ("BAMBANG WIJAYA", "BAMBANG WIJAYANTO", 0.743),
    ("Jkt Tmr", "Jakarta Timur", 1.0),
    ("", "x", 0.0),
]


def test_similarity(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string, s double")
    score = F.expr(grams.similarity(text.normalize_address("a"), text.normalize_address("b")))
    assert [tuple(r) for r in df.select("s", score).collect()] == [(s, s) for _, _, s in PAIRS]
    long = similarity.pair_scores(df, ["a", "b"], "a", "b")
    assert {(r.a, r.b): r.score for r in long.collect()} == {(a, b): s for a, b, s in PAIRS}


def test_best_candidate(spark):
    q = spark.createDataFrame([(1, "suharto"), (2, "none"), (3, "")], "query_id int, query string")
    c = spark.createDataFrame([(1, 0, "dewi"), (1, 1, "suharto"), (1, 2, "suharto"), (3, 0, "a")], "query_id int, idx int, candidate string")
    got = {r.query_id: (r.best_index, r.best_score) for r in similarity.best_candidates(q, c).collect()}
    assert got == {1: (1, 1.0), 2: (-1, 0.0), 3: (0, 0.0)}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.gamma(2, 50, 60000), 2)
    values[:20000] = 77.0  # a third of all rows is one value
    df = spark.createDataFrame([(int(i % 3 > 0), float(v)) for i, v in enumerate(values)], "k int, v double").repartition(8)
    got = {(r.k, r.q): r.value for r in quantiles.group_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.999, 1.0]).collect()}
    for (k, q), v in got.items():
        mine = values[[i for i in range(len(values)) if int(i % 3 > 0) == k]]
        assert v == pytest.approx(np.quantile(mine, q))
    assert len(got) == 10


def test_quantiles_of_wide_and_odd_values(spark):
    """Whole numbers beyond 2 ** 53, infinities, tiny and huge doubles, decimals: ranks stay exact."""
    rng = np.random.default_rng(7)
    big = [2**62 + int(x) for x in rng.integers(0, 5000, 3000)] + [-(2**62), 5, 5, 5]
    wide = [*(10.0 ** rng.uniform(-300, 300, 2000)), *(-(10.0 ** rng.uniform(-300, 300, 2000))), 0.0, -0.0, float("inf"), float("-inf"), 5e-324]
    for values, kind in ((big, "bigint"), (wide, "double"), ([f"{x}.5" for x in big], "decimal(38,1)")):
        df = spark.createDataFrame([(str(v),) for v in values], "s string").selectExpr(f"cast(s as {kind}) as v")
        order = sorted(r.v for r in df.collect())
        got = quantiles.select_ranks(df, [], "v", [0.0, 0.3, 0.5, 0.77, 1.0], cells=16, last=8).collect()
        assert len(got) == 5
        for r in got:
            at = r.q * (len(order) - 1)
            assert (r.lower, r.upper) == (order[int(np.floor(at))], order[int(np.ceil(at))])


def test_quantiles_sort_few_values_at_once(spark, monkeypatch):
    """Ranges are narrowed until they hold LAST values at most, or one value."""
    seen = []
    held = quantiles._held

    def watched(present, ranges, keys):
        out = held(present, ranges, keys)
        on = [*keys, "lo", "hi", "below"]
        seen.append(out.groupBy(*on).agg(F.countDistinct("_v").alias("n")).agg(F.max("n")).first()[0] or 0)
        return out

    monkeypatch.setattr(quantiles, "_held", watched)
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), (F.exp(F.rand(3) * 40)).alias("v"))
    quantiles.select_ranks(df, ["k"], "v", [0.5], cells=64, last=100).count()
    assert len(seen) > 2 and seen[0] > 60_000 and seen[-1] <= 100


def test_missing_numbers_count_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, -0.0), (1, nan, 0.0), (1, 3.0, nan), (2, nan, None)], "k int, v double, z double")
    assert col(profile.group_summary(df, "k", "v")) == [1, 2]
    assert [r.v_mean for r in profile.group_summary(df, "k", "v").collect()] == [2.0, None]
    assert [r.v_median for r in profile.group_summary(df, "k", "v", "median").collect()] == [2.0, None]
    assert profile.top_n(df, "v", 1, ties=["k"]).first().v == 3.0
    assert {r.column: r.unique for r in profile.column_info(df).collect()} == {"k": 2, "v": 2, "z": 1}


def test_estimated_distinct_counts(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as few", "if(id % 2 = 0, null, double('NaN')) as none")
    exact = {r.column: r for r in profile.column_info(df).collect()}
    for r in profile.column_info(df, relative_error=0.02).collect():
        e = exact[r.column]
        assert (r.type, r.non_null, r["null"]) == (e.type, e.non_null, e["null"]) and abs(r.unique - e.unique) <= 0.1 * e.unique


def test_batch_check_joins_rules_and_forest(spark):
    rows = [(i, str(1000 + i), str(1100 + i), "100", str(144_400 + 7 * i), "R1/1300 VA") for i in range(40)]
    rows.append((40, "999999", "5", "99999", "1", "R1/1300 VA"))
    df = spark.createDataFrame(rows, "id int, stand_meter_awal string, stand_meter_akhir string, pemakaian_kwh string, biaya_listrik string, tarif_daya string")
    done = check_batch(df, ["id"], contamination=0.05).collect()
    forest = isolation_forest(df, ["id"], NUMBERS, contamination=0.05).collect()
    rules = anomaly.check_rules(df).collect()
    key = lambda r: r.id
    for a, b, c in zip(sorted(done, key=key), sorted(forest, key=key), sorted(rules, key=key)):
        assert (a.anomaly_score, a.is_anomaly, a.anomaly_flags) == (b.anomaly_score, b.is_anomaly, c.anomaly_flags)
    assert next(r for r in done if r.id == 40).is_anomaly
    few = check_batch(df.limit(3).drop("tarif_daya", "biaya_listrik"), ["id"]).collect()
    assert all(r.anomaly_score == 1 and not r.is_anomaly for r in few)


# Employee id, department, salary.
EMPLOYEES = [
    (1001, "Engineering", 95000),
    (1002, "Marketing", 78000),
    (1003, "Engineering", 62000),
    (1004, "Sales", 55000),
    (1005, "Engineering", 110000),
    (1006, "Marketing", 65000),
    (1007, "Sales", 82000),
    (1008, "Engineering", 92000),
    (1009, "HR", 58000),
    (1010, "Engineering", 98000),
    (1011, "Sales", 53000),
    (1012, "Engineering", 60000),
    (1013, "Marketing", 61000),
    (1014, "HR", 75000),
    (1015, "Engineering", 125000),
    (1016, "Sales", 70000),
    (1017, "Marketing", 95000),
    (1018, "Engineering", 72000),
    (1019, "Sales", 105000),
    (1020, "HR", 52000),
    (1021, "Engineering", 88000),
    (1022, "Marketing", 73000),
    (1023, "Sales", 54000),
    (1024, "Engineering", 97000),
    (1025, "HR", 56000),
]


def test_profile_of_employees(spark):
    df = spark.createDataFrame(EMPLOYEES, "employee_id int, department string, salary int")
    tables = profile_report(
        df, filters=[{"column": "salary", "operator": ">=", "value": 60000}],
        group_by={"group_col": "department", "agg_col": "salary"}, top_n={"column": "salary"}, ties=["employee_id"],
    )
    assert tables["filtered"].count() == 19
    means = {r.department: round(r.salary_mean, 2) for r in tables["grouped"].collect()}
    assert means == {"Engineering": 89900, "HR": 60250, "Marketing": 74400, "Sales": 69833.33}
    assert col(tables["top_records"]) == [1015, 1005, 1019, 1010, 1024, 1001, 1017, 1008, 1021, 1007]
    assert [r.salary for r in tables["statistics"].collect()] == [25, 77240, 20474.13, 52000, 60000, 73000, 95000, 125000]
    with pytest.raises(TypeError):
        profile.top_n(df, "name")
    with pytest.raises(ValueError):
        profile.group_summary(df, "city", "salary", "mode")


def test_players(spark):
    rows = [("1", "2100", "CM", "A"), ("2", "2101", "CM", "A"), ("2", "2101", "CM", "A"), ("e", "N", "CM", "A"),
            ("3", "2800", "GM", "FIDE"), ("4", "2799", None, "B"), ("5", "2799", "GM", "B"), ("6", "2500", "FM", "B")]
    df = spark.createDataFrame([(*r, "1-1-2023", "l", "i") for r in rows], "rank string, rating string, title string, country string, lastupdated string, profilelink string, profileimage string")
    out = player_tables(df)
    assert sorted((r["rank"], r.rating_category) for r in out["chess_df"].collect()) == [
        (1, "Below 2500"), (2, "Below 2500"), (5, "2700-2799"), (6, "2500-2599")]
    assert [tuple(r) for r in out["avg_title"].collect()] == [("CM", 2100, 2), ("FM", 2500, 1), ("GM", 2799, 1)]


def bill(start, end, usage, cost, tariff="R1/1300 VA"):
    return (start, end, usage, cost, tariff)


def test_rules(spark):
    cases = {
        bill("100", "90", "200", "288800"): ["CRITICAL", "CRITICAL"],
        bill("100", "301", "200", "288800"): [],
        bill("100", "302", "200", "288800"): ["CRITICAL"],
        bill(None, "302", "40", "57760"): [],
        bill(None, None, "39", "56316"): ["WARNING"],
        bill(None, None, "751", "1084444"): ["WARNING"],
        bill(None, None, "100", str(int(1444 * 1.29)) + "00"): [],
        bill(None, None, "100", str(int(1444 * 1.31)) + "00"): ["WARNING"],
        bill(None, None, "0", "0", "R9/1"): ["WARNING", "WARNING"],
        bill(None, None, "RP 5", "5", None): [],
    }
    df = spark.createDataFrame(list(cases), "stand_meter_awal string, stand_meter_akhir string, pemakaian_kwh string, biaya_listrik string, tarif_daya string")
    for r in anomaly.check_rules(df).collect():
        assert [f.severity for f in r.anomaly_flags] == cases[tuple(r)[:5]]
    first = anomaly.check_rules(df).filter("stand_meter_akhir = '90'").first().anomaly_flags
    assert first[0].expected == "> 100.0"
    assert first[1].message == "Pemakaian (200.0) doesn't match meter difference (-10.0)"


def test_isolation_finds_planted(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(1000, 10, (2000, 2)).round())]
    rows[:20] = [(i, 5000.0 + 90 * i, 10.0 * i) for i in range(20)]
    df = spark.createDataFrame([(i, str(int(a)), str(int(b))) for i, a, b in rows], "id int, a string, b string")
    done = isolation_forest(df, ["id"], ["a", "b"], contamination=0.02)
    found = {r.id for r in done.filter("is_anomaly").collect()}
    assert len(found & set(range(20))) >= 19 and len(found) <= 41
    assert isolation_forest(df.limit(3), ["id"], ["a", "b"]).filter("is_anomaly").count() == 0


def test_dedup_and_domain(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "")], "a int, b string")
    assert clean.duplicate_members(df).count() == 2
    assert col(clean.duplicate_count(df)) == [1]
    assert clean.drop_duplicate_rows(df).count() == 3
    assert col(clean.check_domain(df, "b", ["y"])) == [2]


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "sheet.csv")
    with open(path, "w") as f:
        f.write("TITLE\nnote\n\nID,Name\n007,\"a, b\"\n8,c\n")
    rows = readers.load_table(spark, path, header_row=3).collect()
    assert [tuple(r) for r in rows] == [("007", "a, b"), ("8", "c")]
    with pytest.raises(FileNotFoundError):
        readers.load_table(spark, str(tmp_path / "no.csv"))
    with pytest.raises(ValueError, match="Unsupported"):
        readers.load_table(spark, str(tmp_path / "a.docx"))
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "a int, b double")
    root = write_profile_report(profile_report(df, filters=[{"column": "a", "operator": ">", "value": 9}]), str(tmp_path), "t")
    assert spark.read.parquet(f"{root}/full_data").filter("b is null").count() == 1
    assert not (tmp_path / root.rsplit("/", 1)[1] / "filtered").exists()
    assert sinks.without_nan(df).filter("b is null").count() == 1


def test_profile_beside_write(spark, tmp_path):
    rows = [(1, "e", 1.0), (2, None, float("nan")), (3, "x", None), (3, "7", 2.0)]
    df = spark.createDataFrame(rows, "k long, `a b` string, v double").repartition(3)
    got = {(r["metric"], r["column"]): r["value"] for r in profile.profile_beside_write(df, f"{tmp_path}/t", {"a b": "e"}, ["a b", "v"]).collect()}
    assert (got["rows", None], got["columns", None], got["numeric_columns", None], got["total_nulls", None]) == (4, 3, 2, 3)
    assert (got["nulls", "v"], got["non_null", "a b"], got["non_numeric", "a b"], got["equals", "a b"]) == (2, 3, 3, 1)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    empty = profile.profile_beside_write(df.limit(0), f"{tmp_path}/none").collect()
    assert all(r["value"] == 0 for r in empty if r["metric"] in ("rows", "nulls", "non_null", "total_nulls"))


def test_pair_similarity_of_columns_is_the_similarity(spark):
    texts = ["", "a", "jalan mawar nomor 1", "mawar jalan nomor 1", "aaaa aaaa aaaa", "aaaa aaa", "zq", "né en ñ", "x" * 300, "x" * 300 + " y"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    scored = pairs.select(F.expr(grams.similarity("a", "b")).alias("x"), grams.pair_similarity("a", "b").alias("y"))
    assert all(r.x == r.y for r in scored.collect())


def test_block_rows_normalise_before_they_meet(spark):
    mapping = {"Nama Pelanggan": "nama_pelanggan", "Biaya Listrik (Rp)": "biaya_listrik"}
    docs = spark.createDataFrame([("d", "Budi", "Rp 1.000")], "doc_id string, nama_pelanggan string, biaya_listrik string")
    master = spark.createDataFrame([(0, "BUDI", "1000")], "row_idx long, `Nama Pelanggan` string, `Biaya Listrik (Rp)` string")
    met = compare.compare_with_block_rows(docs, master, F.lit(1), F.lit(1), mapping)
    assert [r.match_count for r in met.collect()] == [2]
    above_join = met._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "regexp_replace" not in above_join


def test_grams_are_counted_where_pairs_are_spread(spark):
    pairs = spark.createDataFrame([(i, f"text {i}", "text") for i in range(64)], "k long, a string, b string").coalesce(1)
    used = similarity._pair_grams(pairs, ["k"], "a", "b").select(F.spark_partition_id()).distinct().count()
    assert used > 1
    asked = spark.createDataFrame([("q", "text 7")], "query_id string, query string")
    found = similarity.best_candidates(asked, pairs.select(F.lit("q").alias("query_id"), F.col("k").alias("idx"), F.col("a").alias("candidate")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and [r.best_index for r in found.collect()] == [7]


def test_bounded_batches_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        session.bound_batches(spark)
        assert int(spark.conf.get(key)) <= 1 << 20
        texts = spark.createDataFrame([("\ufb01n\u20ac",), (None,), ("",)], "t string").select(text.latin1_text("t"))
        assert col(texts) == ["fin?", None, ""]
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_leaves_of_a_tree_lead_to_themselves():
    child, leaf = np.array([1, 1, 3, 3, 4]), np.array([False, True, False, True, True])
    assert isolation._depth(child, leaf) == 2


def test_pair_similarity_of_batches_where_most_texts_meet(spark):
    """Every text with every other in one batch: the same doubles as one by one, for repeated grams, short and long texts."""
    words = ["suharto", "aa aa", "jalan elok", "x", "nomor 5 rt 5", "ratna sari", "", "sari ratna"]
    texts = [f"{a} {b}".strip() for a in words for b in words]
    for most in (texts, [*texts, "long " * 60]):
        pairs = spark.createDataFrame([(a, b) for a in most for b in most], "a string, b string").coalesce(1)
        scored = pairs.select("a", "b", grams.pair_similarity("a", "b").alias("y"))
        one_by_one = {(r.a, r.b): r.x for r in pairs.repartition(8).select("a", "b", F.expr(grams.similarity("a", "b")).alias("x")).collect()}
        assert {(r.a, r.b): r.y for r in scored.collect()} == one_by_one


def test_addresses_with_rare_and_common_abbreviations(spark):
    """A text is searched for the abbreviations it may have; the result is that of all of them in turn."""
    def in_turn(s):
        s = s.lower().strip()
        for short, long in text.ABBREVIATIONS:
            s = re.sub(rf"\b{short}\.?\b", long, s)
        return re.sub(r"\s+", " ", re.sub(r"[,.\-/\\]+", " ", s)).strip()

    given = ["Jl. A No.5", "jl.gg.x", "rt.gg kel.b", "RT.05/RW.06", "no", "jl", "Komp. X Blk.C", "rt.w.ds", "jl.no.rt.1", "dsa nor", "perum. jl.", "a.b", ""]
    df = spark.createDataFrame([(g,) for g in given], "x string")
    assert [r[0] for r in df.coalesce(1).select(F.expr(text.normalize_address("x"))).collect()] == [in_turn(g) for g in given]


def test_best_candidates_broadcast_nothing_that_grows(spark, monkeypatch):
    """Queries cut into slices of two candidates: the same winners as in one, ties to the lowest idx, and no table of rows is broadcast."""
    queries = spark.createDataFrame([(1, "dewi sartika"), (2, "zzz"), (3, "budi"), (None, "x")], "query_id int, query string")
    rows = [(1, i, f"dewi {t}") for i, t in enumerate(["sari", "sartyka", "sartika", "sartika", "x", "y"])] + [(2, 5, "abc"), (2, 4, "def"), (None, 1, "x")]
    candidates = spark.createDataFrame(rows, "query_id int, idx long, candidate string")
    want = [(None, -1, 0.0), (1, 2, 1.0), (2, 4, 0.0), (3, -1, 0.0)]
    for slice_ in (2, 5000):
        monkeypatch.setattr(similarity, "SLICE", slice_)
        best = similarity.best_candidates(queries, candidates)
        assert sorted((tuple(r) for r in best.collect()), key=lambda r: r[0] or 0) == want
        assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()
