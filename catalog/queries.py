"""One function per query: (spark, folder) -> DataFrame."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import bills
from catalog.bills import table
from veritab.functions import grams, numbers, text
from veritab.operators import anomaly, churn, clean, compare, extract, profile, quantiles, similarity
from veritab.operators.confidence import ConfidenceModel
from veritab.operators.isolation import isolation_forest, standardize
from veritab.operators.match import best_match
from veritab.plans import crosscheck as cc
from veritab.plans.batch import check_batch
from veritab.plans.players import average_rating, clean_players
from veritab.plans.profile_report import profile_report, write_profile_report
from veritab.session import bound_batches, durable, shared_folder
from veritab.sources import readers, sinks
from veritab.streaming import checks

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _every(column: str, n: int, value: str, key: str) -> str:
    return f"case when {key} % {n} = 0 then {value} else {column} end as {column}"


# --- filters, projections, cleaning -----------------------------------------------------


@query
def filter_chain(spark, folder):
    return clean.filter_rows(
        table(spark, folder, "orders"),
        [
            {"column": "o_totalprice", "operator": ">=", "value": 100000},
            {"column": "o_totalprice", "operator": "<", "value": 400000},
            {"column": "o_orderstatus", "operator": "==", "value": "F"},
            {"column": "o_orderkey", "operator": ">", "value": 10},
        ],
    )


@query
def filter_contains(spark, folder):
    return clean.filter_rows(
        table(spark, folder, "part"),
        [
            {"column": "p_name", "operator": "contains", "value": "RING|bo.t"},
            {"column": "p_brand", "operator": "startswith", "value": "Brand#1"},
            {"column": "p_size", "operator": "<=", "value": 40},
        ],
    )


@query
def filter_ne_null(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.expr(_every("o_orderpriority", 10, "null", "o_orderkey"))
    )
    return clean.filter_rows(orders, [{"column": "o_orderpriority", "operator": "!=", "value": "5-LOW"}])


@query
def computed_column(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    df = clean.computed_column(df, "net", "l_extendedprice * (1 - l_discount)")
    df = clean.computed_column(df, "net_per_tax", "try_divide(net, l_tax)")
    return clean.computed_column(df, "l_quantity", "l_quantity * 2")


@query
def bucketize(spark, folder):
    price = clean.bucketize("o_totalprice", [400000, 300000, 200000, 100000], ["400+", "300-399", "200-299", "100-199", "below 100"])
    orders = table(spark, folder, "orders").select("o_orderkey", F.expr(_every("o_totalprice", 10, "null", "o_orderkey")))
    return orders.select("o_orderkey", price.alias("bucket"))


@query
def drop_rename(spark, folder):
    part = table(spark, folder, "part").withColumnsRenamed({"p_retailprice": "Retail Prise", "p_size": "PartSize"})
    return clean.rename_snake_case(part.drop("p_brand"), {"retail_prise": "retail_price"})


@query
def numeric_columns(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    return lineitem.select(*clean.numeric_columns(lineitem))


@query
def map_columns(spark, folder):
    return compare.map_master(bills.master(spark, folder))


def _with_junk(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr("case when o_orderkey % 11 = 0 then 'e' when o_orderkey % 13 = 0 then null else cast(o_custkey as string) end as rank"),
        F.expr("case when o_orderkey % 22 = 0 then 'N' when o_orderkey % 7 = 0 then null else cast(cast(o_totalprice as bigint) as string) end as rating"),
    )


@query
def junk_drop(spark, folder):
    return clean.drop_where_all(_with_junk(spark, folder), {"rank": "e", "rating": "N"})


@query
def non_numeric_rows(spark, folder):
    return clean.non_numeric_rows(_with_junk(spark, folder), "rating")


@query
def non_numeric_count(spark, folder):
    return profile.non_numeric_count(_with_junk(spark, folder), "rank")


@query
def value_count(spark, folder):
    return profile.value_counts_of(_with_junk(spark, folder), {"rank": "e", "rating": "N"})


@query
def dropna_subset(spark, folder):
    return clean.drop_missing(_with_junk(spark, folder), ["rating"])


@query
def domain_check(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr("case when o_orderkey % 9 = 0 then '' when o_orderkey % 8 = 0 then null else o_orderstatus end as status"),
    )
    return clean.check_domain(orders, "status", ["F", "O"])


@query
def coerce_numbers(spark, folder):
    return _with_junk(spark, folder).select("o_orderkey", numbers.parse_number("rating").alias("rating"))


@query
def strict_cast_dates(spark, folder):
    shown = table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "d-M-yyyy").alias("day"),
        F.expr("cast(cast(o_totalprice as bigint) as string) as price"),
    )
    return shown.select(
        "o_orderkey",
        numbers.strict_date("day").alias("day"),
        numbers.parse_date(F.expr("case when o_orderkey % 5 = 0 then 'soon' else day end")).alias("day_or_null"),
        numbers.strict_number("price", "bigint").alias("price"),
    )


@query
def dedup(spark, folder):
    return clean.drop_duplicate_rows(table(spark, folder, "documents").select("text", "lang"))


@query
def duplicate_members(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.expr("case when l_linenumber = 7 then null else l_linenumber end as line"))
    return clean.duplicate_members(lines)


@query
def duplicate_count(spark, folder):
    return clean.duplicate_count(table(spark, folder, "documents").select("text", "lang"))


# --- profile ----------------------------------------------------------------------------


@query
def group_mean(spark, folder):
    joined = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    rounded = profile.group_summary(joined, "n_name", "c_acctbal")
    return rounded.select("n_name", numbers.round_half_even("c_acctbal_mean", 4).alias("c_acctbal_mean"))


@query
def group_each_function(spark, folder):
    part = table(spark, folder, "part").select(
        "p_brand", F.expr("if(p_partkey % 13 = 0, double('NaN'), cast(p_size as double)) as p_size"), "p_partkey",
        F.expr("1 + p_size / 100000D as factor"), F.expr("p_size > 1 as big")
    )
    column = {"prod": "factor", "any": "big", "all": "big"}
    out = None
    for f in profile.FUNCTIONS:
        c = column.get(f, "p_size")
        one = profile.group_summary(part, "p_brand", c, f, order_col="p_partkey").select(
            F.lit(f).alias("func"), "p_brand", numbers.round_half_even(F.col(f"{c}_{f}"), 6).alias("value")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query
def group_median_hot(spark, folder):
    medians = profile.group_summary(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice", "median")
    return medians.select("l_returnflag", numbers.round_half_even("l_extendedprice_median", 4).alias("median"))


@query
def mean_count_bround(spark, folder):
    part = table(spark, folder, "part").select("p_name", F.expr("if(p_partkey % 13 = 0, double('NaN'), p_size) as p_size"))
    return profile.mean_and_count(part, "p_name", "p_size", "average_size", "part_count")


@query
def describe(spark, folder):
    return profile.describe(table(spark, folder, "lineitem"))


@query
def column_info(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.expr(_every("o_custkey", 10, "null", "o_orderkey")), "o_orderstatus", "o_orderpriority",
        F.expr("case o_orderkey % 4 when 0 then -0.0D when 1 then 0.0D when 2 then double('NaN') else o_totalprice end as price"),
    )
    return profile.column_info(orders)


@query
def column_info_text(spark, folder):
    return profile.column_info(table(spark, folder, "documents"))


@query
def overview(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_custkey", F.expr("if(o_orderkey % 10 = 0, null, o_custkey)"))
    return profile.overview(orders)


@query
def null_counts(spark, folder):
    return profile.null_counts(_with_junk(spark, folder))


@query
def class_share(spark, folder):
    labelled = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return profile.class_share(labelled, "toxic", "lang")


@query
def class_share_overall(spark, folder):
    return profile.class_share(table(spark, folder, "labels"), "quality")


@query
def top_n(spark, folder):
    """Prices that are no number come last, as if missing."""
    orders = table(spark, folder, "orders").withColumn(
        "o_totalprice", F.expr("if(o_orderkey % 9 = 0, double('NaN'), o_totalprice)")
    )
    return profile.top_n(orders, "o_totalprice", 10, ties=["o_orderkey"])


@query
def bottom_n(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.expr(_every("o_totalprice", 10, "null", "o_orderkey")))
    return profile.top_n(orders, "o_totalprice", 25, ascending=True, ties=["o_orderkey"])


@query
def preview(spark, folder):
    return profile.preview(table(spark, folder, "orders"), 30, ["o_orderdate", "o_orderkey"])


@query
def preview_note(spark, folder):
    return profile.preview_note(table(spark, folder, "orders"), 50)


@query
def exact_quantiles(spark, folder):
    q = quantiles.group_quantiles(table(spark, folder, "lineitem"), ["l_linestatus"], "l_extendedprice", [0.01, 0.5, 0.999])
    return q.select("l_linestatus", "q", "n", numbers.round_half_even("value", 4).alias("value"))


# --- text and numbers -------------------------------------------------------------------


@query
def text_normalize(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.expr(f"md5({text.normalize('text')}) as normalized"))


@query
def address_normalize(spark, folder):
    return bills.documents(spark, folder).select(
        "doc_id", F.expr(text.normalize_address("alamat")).alias("alamat"), F.expr(text.normalize_address("nama_pelanggan")).alias("nama")
    )


@query
def numeric_normalize(spark, folder):
    shown = table(spark, folder, "orders").select("o_orderkey", F.expr("concat(' Rp. ', cast(cast(o_totalprice as bigint) as string), ',-') as price"))
    return shown.select("o_orderkey", F.expr(text.strip_separators("price")).alias("price"))


@query
def amounts(spark, folder):
    shown = table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr("case o_orderkey % 4 when 0 then concat('Rp ', cast(cast(o_totalprice as bigint) as string)) when 1 then concat('RP ', cast(o_custkey as string)) when 2 then concat(cast(o_custkey as string), '.000 kWh') end as price"),
    )
    return shown.select("o_orderkey", numbers.amount("price").alias("price"))


@query
def tariff_keys(spark, folder):
    return bills.documents(spark, folder).select("doc_id", F.expr(text.tariff_key("tarif_daya")).alias("tarif_key"))


@query
def contains_two_way(spark, folder):
    docs = bills.documents(spark, folder).select(
        "doc_id", F.expr(text.normalize("nama_pelanggan")).alias("a"), F.expr(text.normalize("substring(alamat, 5, 9)")).alias("b")
    )
    return docs.select("doc_id", F.expr(text.contains_either("a", "b")).alias("inside"))


@query
def number_formats(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        numbers.thousands("l_extendedprice").alias("whole"),
        numbers.two_places("l_extendedprice").alias("two"),
        numbers.signed_weight("l_discount").alias("signed"),
        numbers.percent_text("l_tax").alias("percent"),
    )


@query
def fixed_width(spark, folder):
    docs = bills.documents(spark, folder)
    return docs.select("doc_id", F.expr(text.fixed_width("alamat", 20)).alias("address"), F.expr(text.fixed_width("nama_pelanggan", 25, "—")).alias("name"))


@query
def latin1_text(spark, folder):
    bound_batches(spark)
    return table(spark, folder, "documents").select("doc_id", text.latin1_text("text").alias("text"))


@query
def relative_deviation(spark, folder):
    docs = table(spark, folder, "part").select(
        "p_partkey",
        F.expr("case when p_partkey % 9 = 0 then 'n/a' when p_partkey % 8 = 0 then '' else cast(p_size * 3 as string) end as a"),
        F.expr("case when p_partkey % 7 = 0 then '0' else cast(p_size + 10 as string) end as b"),
    )
    return docs.select("p_partkey", numbers.round_half_even(numbers.relative_deviation("a", "b"), 6).alias("deviation"))


@query
def missing_fields(spark, folder):
    docs = bills.documents(spark, folder)
    names = ["nomor_meter", "id_pelanggan", "nama_pelanggan"]
    found = F.filter(F.array(*(F.when(F.col(n).isNotNull(), n) for n in names)), lambda x: x.isNotNull())
    return docs.select("doc_id", F.array_join(clean.missing_fields(found, names), ",").alias("missing"))


# --- sources and sinks ------------------------------------------------------------------


@query
def source_summary(spark, folder):
    return readers.source_summary(table(spark, folder, "orders"), ".parquet")


@query
def file_metadata(spark, folder):
    files = table(spark, folder, "orders")
    return readers.with_file_metadata(files).groupBy("file_name").agg(F.count(F.lit(1)).alias("row_count"))


@query
def page_totals(spark, folder):
    return readers.page_totals(bills.pages(spark, folder))


@query
def printable_pages(spark, folder):
    return readers.printable_pages(bills.pages(spark, folder))


def _run_folder(spark) -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, folder):
    path = f"{_run_folder(spark)}.csv"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.write_table(orders, path, "csv")
    return readers.load_table(spark, path, schema=orders.schema)


@query
def csv_title_rows(spark, folder):
    """A CSV file with two title lines above its header, written and read again."""
    path = f"{_run_folder(spark)}.csv"
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    line = F.concat_ws(",", F.format_string("%03d", "n_nationkey"), "n_name", "n_regionkey")
    title = "Nations\nall of them\nkey,name,region\n"
    one = nation.agg(F.concat(F.lit(title), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("value"))
    one.write.text(path)
    read = readers.load_table(spark, path, header_row=2)
    return read.select(F.expr("cast(key as bigint) as key"), "name", F.expr("cast(region as bigint) as region"))


@query
def report_sink(spark, folder):
    tables = profile_report(
        table(spark, folder, "customer"),
        "Customers",
        filters=[{"column": "c_acctbal", "operator": ">", "value": 1e9}],
        group_by={"group_col": "c_mktsegment", "agg_col": "c_acctbal"},
        top_n={"column": "c_acctbal", "n": 10},
        ties=["c_custkey"],
    )
    root = write_profile_report(tables, _run_folder(spark), "customer")
    out = None
    for name in ("overview", "column_info", "statistics", "full_data", "grouped", "top_records"):
        one = spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def stream_rules(spark, folder):
    schema = table(spark, folder, "part").schema
    target = _run_folder(spark)

    def check(parts: DataFrame) -> DataFrame:
        docs = parts.select(F.expr("concat('D', cast(p_partkey as string)) as doc_id"), *(F.expr(s).alias(n) for n, s in bills.DOCUMENT.items()))
        return anomaly.check_rules(docs).select("doc_id", F.size("anomaly_flags").alias("flags"))

    checks.drain(checks.read_files(spark, folder, schema, "part.parquet"), check, f"{target}/out", f"{target}/state")
    return spark.read.schema("doc_id string, flags int").parquet(f"{target}/out")


@query
def observed_profile(spark, folder):
    """Junk rows of both kinds, profiled in the pass that writes them."""
    junk = _with_junk(spark, folder)
    return profile.profile_beside_write(junk, _run_folder(spark), {"rank": "e", "rating": "N"}, ["rank", "rating"])


# --- extraction -------------------------------------------------------------------------


@query
def extract_fields(spark, folder):
    found = extract.long_fields(extract.extract(bills.pages(spark, folder)))
    return found.select("doc_id", "field", "value", "confidence", "page")


@query
def extract_flat(spark, folder):
    return extract.flat_fields(extract.extract(bills.pages(spark, folder)))


@query
def extract_long(spark, folder):
    """Documents of more than 600 pages, all but three of them blank; one label's value is on the far side."""
    pages = table(spark, folder, "supplier").select(
        F.expr("concat('S', cast(s_suppkey as string)) as doc_id"), "s_suppkey",
        F.explode(F.expr("sequence(1, cast(621 + s_suppkey % 50 as int))")).alias("page_number"),
    )
    text_of = F.expr(
        "case when page_number = 1 then concat('Periode Januari 2026', chr(10), 'Nomor Meter') "
        "when page_number = 620 + s_suppkey % 50 then concat(': MTR', cast(s_suppkey as string)) "
        "when page_number = 621 + s_suppkey % 50 then 'Stand Awal 77' "
        "when page_number % 7 = 0 then ' ' else '' end"
    )
    done = extract.extract(pages.select("doc_id", "page_number", text_of.alias("text")))
    return extract.long_fields(done).select("doc_id", "field", "value", "confidence", "page")


@query
def extract_summary(spark, folder):
    done = extract.extraction_summary(extract.extract(bills.pages(spark, folder)))
    return done.select("doc_id", "pages", "fields_found", "fields_missing", F.array_join("missing", ",").alias("missing"))


@query
def extract_coverage(spark, folder):
    return extract.extraction_coverage(extract.extract(bills.pages(spark, folder)))


# Contacts in running text, by the same search.
CONTACTS = {
    "email": [r"([A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.]+)"],
    "phone": [r"(\+?[0-9][0-9-]{7,}[0-9])"],
}


@query
def extract_contacts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")
    return extract.long_fields(extract.extract(docs, CONTACTS)).select("doc_id", "field", "value", "confidence", "page")


# --- similarity -------------------------------------------------------------------------


def _text_pairs(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        F.expr("concat_ws(' ', p_name, p_brand, p_type, p_size) as a"),
        F.expr("case p_partkey % 4 when 0 then replace(concat_ws(' ', p_name, p_brand, p_type), 'i', 'y') when 1 then concat_ws(' ', p_type, p_name) when 2 then concat_ws(' ', p_name, p_brand, p_type, p_size) else '' end as b"),
    )


@query
def pair_similarity(spark, folder):
    pairs = _text_pairs(spark, folder)
    score = grams.similarity(text.normalize_address("a"), text.normalize_address("b"))
    scored = pairs.select("p_partkey", F.expr(score).alias("score"))
    return scored.select(
        "p_partkey", numbers.round_half_even("score", 3).alias("score"), F.expr(text.similarity_class("score")).alias("class")
    )


@query
def pair_similarity_long(spark, folder):
    scored = similarity.pair_scores(_text_pairs(spark, folder), ["p_partkey"], "a", "b")
    return scored.select("p_partkey", numbers.round_half_even("score", 3).alias("score"))


@query
def batch_similarity(spark, folder):
    scored = similarity.batch_scores(_text_pairs(spark, folder), ["p_partkey"], "a", "b")
    return scored.select("p_partkey", numbers.round_half_even("score", 3).alias("score"))


@query
def best_candidate(spark, folder):
    part = table(spark, folder, "part")
    candidates = part.select("p_brand", F.expr("p_partkey as idx"), F.expr("concat_ws(' ', p_name, p_type, p_size) as candidate"))
    asked = part.groupBy("p_brand").agg(F.max_by(F.expr("concat_ws(' ', p_name, p_type, p_size)"), "p_partkey").alias("query"))
    asked = asked.select(F.col("p_brand").alias("query_id"), F.expr("replace(query, 'i', 'y') as query"))
    best = similarity.best_candidates(asked, candidates.withColumnRenamed("p_brand", "query_id"))
    return best.select("query_id", "best_index", numbers.round_half_even("best_score", 3).alias("best_score"))


# --- reconciliation ---------------------------------------------------------------------


@query
def best_match_rows(spark, folder):
    found = best_match(bills.documents(spark, folder), bills.master(spark, folder))
    return found.select("doc_id", "row_idx", numbers.round_half_even("match_score", 3).alias("match_score"))


@query
def best_match_plain(spark, folder):
    found = best_match(bills.documents(spark, folder), bills.master(spark, folder), use_ml=False)
    return found.select("doc_id", "row_idx", numbers.round_half_even("match_score", 3).alias("match_score"))


def _own_rows(spark, folder):
    """Documents beside the rows they were made from."""
    docs = bills.documents(spark, folder)
    docs = docs.withColumn("row_idx", F.expr("cast(substring(doc_id, 2) as bigint)"))
    docs = docs.withColumnsRenamed({f: f"d_{f}" for f in bills.DOCUMENT})
    return docs.join(compare.map_master(bills.master(spark, folder)), "row_idx")


@query
def compare_fields(spark, folder):
    done = compare.compare_rows(_own_rows(spark, folder), ["doc_id"])
    cells = cc.detail(done)
    return cells.withColumn("similarity_score", numbers.round_half_even("similarity_score", 3))


@query
def compare_fields_plain(spark, folder):
    done = compare.compare_rows(_own_rows(spark, folder), ["doc_id"], use_ml=False)
    return cc.detail(done).select("doc_id", "position", "field_name", "match_status", "notes")


# The demo document, the first seed row with two wrong readings.
DEMO_DOCUMENT = {
    "id_pelanggan": "532100012345",
    "nama_pelanggan": "SUHARTO",
    "alamat": "JL. PENGGILINGAN ELOK NO.23 RT005/RW012, PENGGILINGAN, CAKUNG, JAKARTA TIMUR",
    "tarif_daya": "R1/1300 VA",
    "nomor_meter": "JTX476",
    "nomor_kwh": "85201234",
    "periode": "Januari 2026",
    "stand_meter_awal": "15230",
    "stand_meter_akhir": "15510",
    "pemakaian_kwh": "280",
    "biaya_listrik": "352500",
}


@query
def all_rows(spark, folder):
    done = compare.compare_with_all_rows(DEMO_DOCUMENT, bills.master(spark, folder))
    return done.select("row_idx", "row_number", "match_count", "match_percentage")


@query
def all_rows_blocked(spark, folder):
    """Every 20th document against all rows of its brand; a third of all keys is one block."""

    def block(key: str, address: str):
        return F.expr(f"if({key} % 3 = 0, 'THIRD', regexp_extract({address}, ', ([^,]*)$', 1))")

    key = "cast(substring(doc_id, 2) as bigint)"
    asked = bills.documents(spark, folder).filter(f"{key} % 20 = 0")
    done = compare.compare_with_block_rows(asked, bills.master(spark, folder), block(key, "alamat"), block("row_idx", "Alamat"))
    return done.select("doc_id", "row_idx", "row_number", "match_count", "match_percentage")


@lru_cache(maxsize=2)
def _checked(spark, folder):
    """The checked and scored documents, written once for the reports that read them."""
    model = ConfidenceModel.trained_on_synthetic(spark)
    return durable(cc.crosscheck(bills.documents(spark, folder), bills.master(spark, folder), model=model))


@query
def crosscheck_summary(spark, folder):
    return cc.summary(_checked(spark, folder)).drop("checked_at")


@query
def crosscheck_report(spark, folder):
    """Rows of each table of a written report."""
    root = cc.write_crosscheck_report(_checked(spark, folder), _run_folder(spark), "bills")
    out = None
    for name in ("detail", "summary", "error_log", "ml_scores", "anomalies"):
        one = spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def crosscheck_errors(spark, folder):
    return cc.error_log(_checked(spark, folder))


@query
def crosscheck_detail(spark, folder):
    return cc.detail(_checked(spark, folder)).select("doc_id", "position", "field_name", "pdf_value", "excel_value", "match_status", "notes")


@query
def crosscheck_features(spark, folder):
    done = _checked(spark, folder)
    rounded = ["match_ratio", "name_similarity", "address_similarity", "meter_deviation", "billing_deviation"]
    return done.select("doc_id", *(numbers.round_half_even(c, 3).alias(c) for c in rounded), "anomaly_count", "missing_fields")


@query
def crosscheck_from_pages(spark, folder):
    docs = extract.flat_fields(extract.extract(bills.pages(spark, folder)))
    return cc.summary(cc.crosscheck(docs, bills.master(spark, folder))).drop("checked_at")


@query
def stream_crosscheck(spark, folder):
    """The documents as two files of a stream, each file a batch; the first batch is run a second time."""
    root = _run_folder(spark)
    halves = bills.documents(spark, folder).withColumn("half", F.expr("cast(substring(doc_id, 2) as bigint) % 2"))
    for half in (0, 1):
        halves.filter(f"half = {half}").drop("half").coalesce(1).write.mode("append").parquet(f"{root}/in")
    bills.master(spark, folder).write.parquet(f"{root}/master")
    schema = bills.documents(spark, folder).schema
    stream = checks.read_files(spark, f"{root}/in", schema, files_per_batch=1)
    checks.crosscheck_stream(stream, lambda: f"{root}/master", f"{root}/out", f"{root}/state")
    again = spark.read.parquet(f"{root}/in").filter("cast(substring(doc_id, 2) as bigint) % 2 = 0")
    checks.crosscheck_batch(again, 0, lambda: f"{root}/other", f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").drop("checked_at", "batch")


# --- anomalies --------------------------------------------------------------------------


@query
def tariff_lookup(spark, folder):
    return anomaly.with_tariff(bills.documents(spark, folder), "tarif_daya").select("doc_id", "tarif_key", "low", "high", "rate")


@query
def anomaly_rules(spark, folder):
    checked = anomaly.check_rules(bills.documents(spark, folder))
    return anomaly.long_flags(checked, ["doc_id"])


@query
def anomaly_rules_lines(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.expr("cast(l_orderkey as string) as stand_meter_awal"),
        F.expr("cast(l_orderkey + cast(l_quantity as bigint) * 10 - 3 as string) as stand_meter_akhir"),
        F.expr("cast(cast(l_quantity as bigint) * 10 as string) as pemakaian_kwh"),
        F.expr("concat('Rp ', cast(cast(l_extendedprice as bigint) * 5 as string)) as biaya_listrik"),
        F.expr("case l_linenumber % 3 when 0 then 'R1-1300 VA' when 1 then 'r1m/900va' else 'P/1 W' end as tarif_daya"),
    )
    checked = anomaly.check_rules(lines)
    return anomaly.long_flags(checked, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query
def standardized(spark, folder):
    lines = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    done = standardize(lines, ["size", "price"])
    return done.select("p_partkey", *(numbers.round_half_even(c, 6).alias(c) for c in ("size", "price")))


def _line_ids():
    return ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


@query
def isolation_forest_lines(spark, folder):
    done = isolation_forest(table(spark, folder, "lineitem"), _line_ids(), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return done.select("l_orderkey", "l_partkey", "l_linenumber", "isolation", "anomaly_score", "is_anomaly")


@query
def isolation_share(spark, folder):
    """Every 500th order is far off in both numbers: the forest must call all of these anomalies."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr("o_orderkey % 500 = 0 as planted"),
        F.expr("cast(o_totalprice * if(o_orderkey % 500 = 0, 900, 1) as bigint) as price"),
        F.expr("o_custkey + if(o_orderkey % 500 = 0, 90000000, 0) as customer"),
    )
    done = isolation_forest(rows, ["o_orderkey"], ["price", "customer"], contamination=0.05)
    return done.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("planted").alias("planted"),
        F.count_if(F.col("planted") & F.col("is_anomaly")).alias("found"),
    )


@query
def anomaly_batch(spark, folder):
    """Rules and forest label of every bill in one call: flags of each, and which planted bills the forest finds."""
    done = check_batch(bills.planted(spark, folder), ["doc_id"])
    planted = F.expr("cast(substring(doc_id, 2) as bigint) % 97 = 0")
    return done.select(
        "doc_id", F.size("anomaly_flags").alias("flags"), planted.alias("planted"),
        (planted & F.col("is_anomaly")).alias("found"),
    )


# --- models -----------------------------------------------------------------------------


def _history(spark, folder):
    """Checked documents as labelled history: digit 0, 4 and 8 are the faithful ones."""
    done = _checked(spark, folder)
    return done.filter("matched_row_index is not null").withColumn(
        "label", F.expr("cast(cast(substring(doc_id, 2) as bigint) % 10 in (0, 4, 8) as int)")
    )


@query
def confidence_train(spark, folder):
    metrics = ConfidenceModel.train(_history(spark, folder)).metrics
    rows = [(k, float(metrics[k])) for k in ("samples", "valid_count", "invalid_count")]
    return spark.createDataFrame(rows, "metric string, value double")


@query
def confidence_score(spark, folder):
    """Who is scored, and whether prediction and risk level follow from the score."""
    done = _checked(spark, folder)
    c = F.col("confidence_score")
    predicted = F.when(c >= 60, "VALID").otherwise("SUSPICIOUS")
    level = F.when(c >= 85, "LOW").when(c >= 60, "MEDIUM").otherwise("HIGH")
    fits = (c >= 0) & (c <= 100) & (F.col("prediction") == predicted) & (F.col("risk_level") == level)
    return done.select("doc_id", c.isNotNull().alias("scored"), fits.alias("fits"))


@query
def confidence_explain(spark, folder):
    return ConfidenceModel.train(_history(spark, folder)).explain(spark)


def _labelled(spark, folder):
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    plain = joined.select(
        "doc_id", "quality", "toxic", "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("words"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("digits"),
    )
    ranked = plain.withColumn("length_class", F.expr("case when n_chars < 500 then 'low' when n_chars < 2000 then 'medium' else 'high' end"))
    ranked = ranked.withColumn("length_rank", clean.ordinal("length_class", ["low", "medium", "high"]).cast("double"))
    return clean.one_hot(ranked, "lang", ["de", "en", "es", "fr"])


FEATURES = ["n_chars", "words", "lines", "digits", "length_rank", "lang_de", "lang_en", "lang_es", "lang_fr"]


@query
def ordinal_onehot(spark, folder):
    return _labelled(spark, folder).select("doc_id", "length_class", "length_rank", "lang_de", "lang_en", "lang_es", "lang_fr")


@query
def stratified_split(spark, folder):
    split = churn.stratified_split(table(spark, folder, "orders"), "o_orderstatus", ["o_orderkey"])
    return split.groupBy("o_orderstatus", "split").agg(F.count(F.lit(1)).alias("n"))


def _guess(spark, folder):
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return joined.select("quality", F.expr("cast(n_chars > 500 as int) as prediction"))


@query
def confusion(spark, folder):
    return churn.confusion(_guess(spark, folder), "quality")


@query
def recall(spark, folder):
    return churn.recall(_guess(spark, folder), "quality")


@lru_cache(maxsize=2)
def _tuned(spark: SparkSession, folder: str):
    split = durable(churn.stratified_split(_labelled(spark, folder), "quality", ["doc_id"]))
    train = split.filter("split = 'train'")
    return split, churn.tune_boosted_trees(train, FEATURES, "quality", churn.GRID, folds=5)


@query
def boosted_grid(spark, folder):
    _, tuned = _tuned(spark, folder)
    return churn.grid_results(tuned, spark)


@query
def boosted_recall(spark, folder):
    split, tuned = _tuned(spark, folder)
    out = None
    for part in ("validate", "test"):
        predicted = tuned.bestModel.transform(split.filter(F.col("split") == part))
        one = churn.recall(predicted, "quality").select(F.lit(part).alias("split"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query
def boosted_importances(spark, folder):
    _, tuned = _tuned(spark, folder)
    return churn.feature_importances(tuned.bestModel, FEATURES, spark)


@query
def partial_dependence(spark, folder):
    split, tuned = _tuned(spark, folder)
    return churn.partial_dependence(tuned.bestModel, split, ["n_chars", "words", "lines", "digits", "length_rank"])


# --- player cleaning --------------------------------------------------------------------


def _players(spark, folder):
    """Orders as rankings: junk rows, missing countries and titles, and exact copies."""
    orders = table(spark, folder, "orders")
    rows = orders.select(
        F.expr("case when o_orderkey % 17 = 0 then 'e' else cast(o_custkey as string) end as rank"),
        F.expr("case when o_orderkey % 17 = 0 then 'N' else cast(2000 + cast(o_totalprice / 500 as bigint) as string) end as rating"),
        F.expr("case when o_orderkey % 5 = 0 then null else o_orderpriority end as title"),
        F.expr("case when o_orderkey % 19 = 0 then 'FIDE' else concat('C', cast(o_custkey % 40 as string)) end as country"),
        F.date_format("o_orderdate", "d-M-yyyy").alias("lastupdated"),
        F.expr("'p' as profilelink"),
        F.expr("'i' as profileimage"),
        F.expr("explode(if(o_orderkey % 3 = 0, array(1, 2), array(1))) as copy"),
    )
    return rows.drop("copy")


@query
def players_clean(spark, folder):
    return clean_players(_players(spark, folder))


@query
def players_by_title(spark, folder):
    return average_rating(clean_players(_players(spark, folder)), "title")


@query
def players_by_country(spark, folder):
    return average_rating(clean_players(_players(spark, folder)), "country")
