"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import (
    alignment,
    language,
    licences,
    maintext,
    mixing,
    neardup,
    pieces,
    quality,
    secretscan,
    sharding,
    simhash,
    urlrules,
    whitening,
)
from veritab.session import durable

#: Words below which a document fails the base rule.
FEWEST_WORDS = 50


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_read(spark, folder, "documents"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("good")).alias("kept"),
        F.round("quality", 6).alias("quality"),
    )


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.train(documents.where(~held_out))
    told = language.identify(documents.select("doc_id", "text"), model)
    return told.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.allocate(_read(spark, folder, "documents"))
    return mixed.select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op4_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    grouped = neardup.groups(_read(spark, folder, "documents")).withColumnsRenamed({"key": "doc_id", "kept": "kept_row"})
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return grouped.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "kept_row")


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents").select("doc_id", "text")
    decoded = pieces.decode(pieces.encode(documents))
    return decoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        "piece_ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Besides the contract's columns, n_near: for documents whose id is divisible by 20, how many others' fingerprints
    lie within the Hamming radius; null for the rest, which aren't asked."""
    documents = _read(spark, folder, "documents").select("doc_id", "text")
    rows = simhash.with_next(documents, "doc_id", "text")
    changed = simhash.edited(F.col("text"), F.col("next_text"))
    facts = ["key", "range", "place", "next_range", "next_place", "n_chars", "edited_sha256", "edited"]
    sides = (
        rows.select("*", changed.alias("changed"))
        .select(
            *facts[:5],
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
            F.explode(
                F.array(
                    F.struct(F.lit(False).alias("edited"), F.col("text").alias("t")),
                    F.struct(F.lit(True).alias("edited"), F.col("changed").alias("t")),
                )
            ).alias("side"),
        )
        .select(*facts[:7], "side.edited", "side.t")
    )
    prints = durable(
        simhash.fingerprints(sides, "t", facts)
        .groupBy(*facts[:7])
        .agg(
            *(
                F.max(F.when(F.col("edited") == changed, F.col(half))).alias(f"{side}_{half}")
                for side, changed in (("a", False), ("b", True))
                for half in ("hi", "lo")
            )
        )
        .select(
            *facts[:7],
            *(F.struct(F.col(f"{s}_hi").alias("hi"), F.col(f"{s}_lo").alias("lo")).alias(s) for s in ("a", "b")),
            simhash.spelled(F.col("a_hi"), F.col("a_lo")).alias("fingerprint"),
        )
    )
    after = prints.select(F.col("range").alias("next_range"), F.col("place").alias("next_place"), F.col("a").alias("c"))
    asked = prints.where("key % 20 = 0")
    near = (
        simhash.within_radius(prints, asked)
        .groupBy("fingerprint")
        .agg((F.sum("copies") - 1).alias("near"))
        .withColumnRenamed("fingerprint", "asked")
    )
    part = lambda c: (F.col(f"{c}.hi"), F.col(f"{c}.lo"))
    joined = prints.join(after, ["next_range", "next_place"]).join(
        near, F.when(F.col("key") % 20 == 0, F.col("fingerprint")) == F.col("asked"), "left"
    )
    return joined.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        simhash.spelled(F.col("b.hi"), F.col("b.lo")).alias("edited_fingerprint"),
        simhash.likeness(part("a"), part("b")).alias("near_edited"),
        simhash.likeness(part("a"), part("c")).alias("near_next"),
        F.col("near").alias("n_near"),
    )


#: The rules of the URL filter: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages").select("page_id", "url", "html")
    text = maintext.main_text(pages, maintext.train(pages))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Documents as a file tree: every 1000 ids a folder of their source, every 50 ids a folder in that one; the first
#: document of a folder is its licence file.
FILE_PATH = """concat(source, '/', doc_id div 1000, '/', CASE
    WHEN doc_id % 1000 = 0 THEN 'LICENSE'
    WHEN doc_id % 50 = 0 THEN concat(doc_id div 50, '/LICENSE')
    ELSE concat(doc_id div 50, '/', doc_id, '.txt') END)"""


def op9_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    files = _read(spark, folder, "documents").select("doc_id", F.expr(FILE_PATH).alias("path"), "text")
    listed = lambda c: F.array_join(c, ",")
    return licences.scan(files).select(
        "doc_id",
        "path",
        listed("own").alias("own"),
        "cosine",
        listed("licences").alias("licences"),
        "inherited_from",
    )


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents").select("doc_id", "text")
    scanned = secretscan.scan(documents, secretscan.train(documents))
    spelled = lambda xs: F.array_join(
        F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spelled(F.filter("secrets", lambda x: x["kind"] != "format")), 256).alias("base_sha256"),
        spelled(F.col("secrets")).alias("spans"),
    )


#: Bytes that a document takes besides its text.
ROW_BYTES = 16


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sizes = _read(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    dealt = sharding.shard(durable(sizes))
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _read(spark, folder, "embeddings").select("vec_id", "embedding")
    whitened = whitening.whiten(vectors)
    return whitened.select(
        "vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "value")
    ).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("value").alias("whitened"),
        F.col("explained")[F.col("place")].alias("explained"),
        "identity_error",
    )


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents").select("doc_id", "text")
    return alignment.align(documents, keep=["doc_id"], digest=True).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_source_mixing": op3_source_mixing,
    "op4_minhash_neardup": op4_minhash_neardup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op7_url_filters": op7_url_filters,
    "op8_html_extraction": op8_html_extraction,
    "op9_license_scans": op9_license_scans,
    "op10_secret_scans": op10_secret_scans,
    "op11_sharding": op11_sharding,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_alignment": op13_token_alignment,
}
