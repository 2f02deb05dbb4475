"""Labelled fields from page texts by an ordered pattern bank."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators.clean import missing_fields

# Search patterns of each field, tried in order. Group 1 is the value, or
# the whole match where there is no group.
PATTERNS = {
    "id_pelanggan": [
        r"(?:ID\s*Pelanggan|IDPEL|No\.?\s*Pelanggan|Nomor\s*Pelanggan)\s*[:\-]?\s*(\d[\d\s\.\-]{6,})",
        r"(\d{12})",
    ],
    "nama_pelanggan": [
        r"(?:Nama\s*Pelanggan|Nama\s*Pemilik|Nama|Pelanggan|Atas\s*Nama)\s*[:\-]?\s*([A-Z][A-Za-z\s\.\,\']{2,50})",
    ],
    "alamat": [
        r"(?:Alamat|Alamat\s*Pelanggan|Alamat\s*Rumah)\s*[:\-]?\s*(.{10,100})",
    ],
    "tarif_daya": [
        r"(?:Tarif\s*/?\s*Daya|Tarif|Daya\s*Tersambung|Gol\.?\s*Tarif)\s*[:\-]?\s*([\w\d]+\s*/?\s*[\d\.]+\s*(?:VA|W|KVA|kVA)?)",
        r"(R[- ]?\d[A-Z]?\s*/?\s*[\d\.]+\s*(?:VA|W|KVA)?)",
    ],
    "nomor_meter": [
        r"(?:No\.?\s*Meter|Nomor\s*Meter|No\.?\s*APP|Meter\s*No)\s*[:\-]?\s*(\w[\w\d\-\.]{3,20})",
    ],
    "nomor_kwh": [
        r"(?:No\.?\s*KWH|kWh\s*Meter|Nomor\s*kWh)\s*[:\-]?\s*(\w[\w\d\-\.]{3,20})",
    ],
    "stand_meter_awal": [
        r"(?:Stand\s*(?:Meter\s*)?Awal|Meter\s*Awal|LWBP\s*Awal|Stand\s*Awal)\s*[:\-]?\s*([\d\.\,]+)",
    ],
    "stand_meter_akhir": [
        r"(?:Stand\s*(?:Meter\s*)?Akhir|Meter\s*Akhir|LWBP\s*Akhir|Stand\s*Akhir)\s*[:\-]?\s*([\d\.\,]+)",
    ],
    "pemakaian_kwh": [
        r"(?:Pemakaian|Jumlah\s*(?:Pemakaian|kWh)|Total\s*(?:Pemakaian|kWh)|kWh\s*Pakai)\s*[:\-]?\s*([\d\.\,]+)\s*(?:kWh|kwh)?",
    ],
    "biaya_listrik": [
        r"(?:Total\s*(?:Tagihan|Bayar|Rekening)|Jumlah\s*(?:Tagihan|Bayar)|Biaya\s*(?:Listrik|Total)|RP\s*Tag)\s*[:\-]?\s*(?:Rp\.?\s*)?([\d\.\,]+)",
    ],
    "periode": [
        r"(?:Periode|Bulan|Bln|Periode\s*Rekening)\s*[:\-]?\s*(\w+\s*\d{4}|\d{2}\s*/?\-?\s*\d{4})",
    ],
    "nomor_referensi": [
        r"(?:No\.?\s*(?:Ref|Referensi|Agenda)|Ref\.?\s*No)\s*[:\-]?\s*([\w\d\-\/\.]+)",
        r"JTX\d+",
    ],
}

#: Only '\n' ends a line, case is ignored, ^ and $ match at lines, classes are Unicode.
_FLAGS = "(?dimU)"

#: Pages with text per window; a window also sees all such pages of the next one.
WINDOW_PAGES = 256
#: Pages whose positions are counted together.
COUNTED_PAGES = 256
#: What a match of the bank above can run over without an end: digits, blanks and signs between them.
_RUNS_ON = r"(?U)\A[\d\s.\-]*\z"


def _search(text: Column, pattern: str) -> Column:
    """First match, unstripped; null if there is none. No pattern matches empty text."""
    group = 1 if re.compile(pattern).groups else 0
    return F.nullif(F.regexp_extract(text, _FLAGS + pattern, group), F.lit(""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _with_text(pages: DataFrame) -> DataFrame:
    """Pages that are not blank: (doc_id, page_number, text, _lead, _index).

    _lead: line ends between the page and the one with text before it; _index: pages with text before it. Both are
    counted in blocks of pages and summed over the blocks, so no document passes through one task page by page.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pages.select(
        "doc_id", "page_number", text.alias("text"), text.rlike(r"(?U)\S").alias("_full"),
        F.floor((F.col("page_number") - 1) / COUNTED_PAGES).alias("_block"),
    )
    inside = Window.partitionBy("doc_id", "_block").orderBy("page_number")
    placed = rows.withColumn("_at", F.row_number().over(inside))
    before = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("doc_id", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_full").alias("_f"), F.max(F.when(F.col("_full"), F.col("_at"))).alias("_l")
    )
    blocks = blocks.withColumn("_rows", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    blocks = blocks.select(
        "doc_id", "_block", "_rows",
        F.coalesce(F.sum("_f").over(before), F.lit(0)).alias("_filled"),
        F.max(F.col("_rows") + F.col("_l")).over(before).alias("_last"),
    )
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    within = placed.select(
        "*",
        F.coalesce(F.count_if("_full").over(earlier), F.lit(0)).alias("_i"),
        F.max(F.when(F.col("_full"), F.col("_at"))).over(earlier).alias("_p"),
    )
    position = F.col("_rows") + F.col("_at")
    previous = F.coalesce(F.col("_rows") + F.col("_p"), F.col("_last"))
    return (
        within.filter("_full").join(blocks, ["doc_id", "_block"])
        .select(
            "doc_id", "page_number", "text",
            (position - F.coalesce(previous, F.lit(1))).cast("int").alias("_lead"),
            (F.col("_filled") + F.col("_i")).alias("_index"),
        )
    )


def _windowed(full: DataFrame, window_pages: int | None) -> DataFrame:
    """``full`` with the window ``_own`` of each page.

    A window that holds nothing a match must stop at could be outrun by one: such a document is one window, as its
    value would be as long as the document anyway. So is every document if ``window_pages`` is None.
    """
    if window_pages is None:
        return full.withColumn("_own", F.lit(0))
    own = F.floor(F.col("_index") / window_pages).cast("int")
    placed = full.withColumn("_own", own)
    endless = (
        placed.groupBy("doc_id", "_own")
        .agg(F.bool_and(F.col("text").rlike(_RUNS_ON)).alias("_open"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_open") & (F.col("_n") >= window_pages))
        .select("doc_id", F.lit(True).alias("_whole")).distinct()
    )
    return placed.join(endless, "doc_id", "left").withColumn(
        "_own", F.when(F.col("_whole"), 0).otherwise(F.col("_own"))
    ).drop("_whole")


def extract(
    pages: DataFrame, patterns: dict[str, list[str]] | None = None, window_pages: int = WINDOW_PAGES
) -> DataFrame:
    """(doc_id, pages, fields): one row per document with an array of found fields.

    ``pages`` is (doc_id, page_number, text) with pages numbered from 1; a page of nothing but white space counts
    as an empty one. Each pattern is tried on the pages in order, then on the pages joined by a line end, before
    the next pattern. A page hit has confidence 'high' ('medium' if the field has several patterns) and its page; a
    hit in the joined text has 'low' and no page.

    Joined text is searched in windows of pages with text that overlap by a whole window; empty pages between them
    are kept as line ends. A bank of one's own is searched in whole documents, as its matches may be of any length.
    """
    bank = patterns or PATTERNS
    flat = [(field, p) for field, ps in bank.items() for p in ps]
    ids = range(len(flat))

    totals = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    hits = _windowed(_with_text(pages), None if patterns else window_pages).select(
        "doc_id",
        "page_number",
        F.concat(F.repeat(F.lit("\n"), F.col("_lead")), F.col("text")).alias("text"),
        "_own",
        *(_strip(_search(F.col("text"), p)).alias(f"_h{i}") for i, (_, p) in enumerate(flat)),
    )
    seen_in = F.when(F.col("_own") > 0, F.array(F.col("_own") - 1, F.col("_own"))).otherwise(F.array("_own"))
    placed = hits.withColumn("_window", F.explode(seen_in))
    own = F.col("_own") == F.col("_window")
    grouped = placed.groupBy("doc_id", "_window").agg(
        F.count_if(own).alias("_pages"),
        F.collect_list(F.struct("page_number", own.alias("own"), "text")).alias("_texts"),
        *(
            F.min(F.when(own & F.col(f"_h{i}").isNotNull(), F.struct("page_number", f"_h{i}"))).alias(f"_p{i}")
            for i in ids
        ),
    )
    ordered = F.array_sort("_texts")
    texts = lambda kept: F.array_join(F.transform(kept, lambda x: x["text"]), "")
    windows = grouped.filter(F.col("_pages") > 0).select(
        "doc_id",
        "_window",
        (F.size("_texts") > 1).alias("_several"),
        texts(ordered).alias("_joined"),
        F.length(texts(F.filter(ordered, lambda x: x["own"]))).alias("_own_length"),
        *(f"_p{i}" for i in ids),
    )

    def across(i: int, field: str, pattern: str) -> Column:
        """The first match in the joined text, if it begins in the window's own pages.

        Not looked for where a pattern of the same rank or a better one has a hit on a page of the window.
        """
        at = F.regexp_instr("_joined", F.lit(_FLAGS + pattern))
        better = [F.col(f"_p{j}").isNull() for j in range(i + 1) if flat[j][0] == field]
        wanted = reduce(and_, better, F.col("_several"))
        begins_here = (at > 0) & (at <= F.col("_own_length"))
        found = _strip(_search(F.col("_joined"), pattern))
        return F.when(wanted & begins_here, F.struct("_window", found.alias("value")))

    per_window = windows.select(
        "doc_id", *(f"_p{i}" for i in ids), *(across(i, f, p).alias(f"_f{i}") for i, (f, p) in enumerate(flat))
    )
    per_text = per_window.groupBy("doc_id").agg(
        *(F.min(f"_p{i}").alias(f"_p{i}") for i in ids),
        *(F.min(f"_f{i}").alias(f"_f{i}") for i in ids),
    )
    per_doc = totals.join(per_text, "doc_id", "left")

    def resolve(field: str) -> Column:
        options = []
        grade = "high" if len(bank[field]) == 1 else "medium"
        for i, (name, pattern) in enumerate(flat):
            if name != field:
                continue
            for hit, value, page, confidence in (
                (f"_p{i}", f"_p{i}._h{i}", F.col(f"_p{i}.page_number"), grade),
                (f"_f{i}", f"_f{i}.value", F.lit(None).cast("int"), "low"),
            ):
                options.append(
                    F.when(
                        F.col(hit).isNotNull(),
                        F.struct(
                            F.lit(field).alias("field"),
                            F.col(value).alias("value"),
                            F.lit(confidence).alias("confidence"),
                            page.cast("int").alias("page"),
                            F.lit(pattern).alias("pattern"),
                        ),
                    )
                )
        return F.coalesce(*options)

    found = F.filter(F.array(*(resolve(field) for field in bank)), lambda x: x.isNotNull())
    return per_doc.select("doc_id", "pages", found.alias("fields"))


def long_fields(extracted: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, page, pattern): one row per found field."""
    return extracted.select("doc_id", F.inline_outer("fields")).filter(F.col("field").isNotNull())


def flat_fields(extracted: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One column per field; null where it was not found."""

    def value(field: str) -> Column:
        return F.get(F.filter("fields", lambda x: x["field"] == field), F.lit(0))["value"]

    return extracted.select("doc_id", *(value(f).alias(f) for f in fields or PATTERNS))


def extraction_summary(extracted: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Found and missing counts and the sorted names of the missing fields, per document."""
    names = list(fields or PATTERNS)
    found = F.transform("fields", lambda x: x["field"])
    return extracted.select(
        "doc_id",
        "pages",
        F.size("fields").alias("fields_found"),
        (F.lit(len(names)) - F.size("fields")).alias("fields_missing"),
        missing_fields(found, names).alias("missing"),
    )


def extraction_coverage(extracted: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Documents with and without each field, over a whole collection; one pass."""
    names = list(fields or PATTERNS)
    has = {n: F.expr(f"exists(fields, x -> x.field = '{n}')") for n in names}
    counts = extracted.agg(
        F.count(F.lit(1)).alias("_all"), *(F.count_if(test).alias(f"_{i}") for i, test in enumerate(has.values()))
    )
    rows = (
        F.struct(
            F.lit(n).alias("field"),
            F.col(f"_{i}").alias("documents_found"),
            (F.col("_all") - F.col(f"_{i}")).alias("documents_missing"),
        )
        for i, n in enumerate(names)
    )
    return counts.select(F.inline(F.array(*rows)))


def extract_page_fields(pages: DataFrame, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """Fields of each page by itself, without grouping: also for streams of one-page documents."""
    bank = patterns or PATTERNS
    values = {f: F.coalesce(*(_strip(_search(F.col("text"), p)) for p in ps)) for f, ps in bank.items()}
    return pages.select("doc_id", "page_number", *(v.alias(f) for f, v in values.items()))
