"""Field-by-field comparison of a document with a master row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.grams import pair_similarity
from veritab.functions.numbers import score_text
from veritab.functions.text import (
    contains_either,
    normalize,
    normalize_address,
    quoted,
    similarity_class,
    strip_separators,
)
from veritab.sources.fixtures import COLUMN_TO_FIELD

# Which fields compare as numbers, which as free text, and the bound above
# which similar text counts as equal.
NUMERIC_FIELDS = {"stand_meter_awal", "stand_meter_akhir", "pemakaian_kwh", "biaya_listrik"}
TEXT_FIELDS = {"nama_pelanggan", "alamat"}
SIMILAR_ENOUGH = 0.75

MATCH, MISMATCH, MISSING = "MATCH", "MISMATCH", "MISSING"

# The notes of a comparison.
NO_ROW = "No matching row found in Excel template"
BOTH_EMPTY = "Both PDF and Excel values are empty"
NO_DOCUMENT_VALUE = "Not found in PDF document"
NO_MASTER_VALUE = "Not found in Excel template"
SAME_NUMBER = "Exact numeric match"
SAME_TEXT = "Exact match"
PART_OF = "Partial/contains match"


def prepared(fields: list[str], side: str, use_ml: bool) -> list[Column]:
    """The values of one side (``d`` or ``m``): d_<field>, null when empty; dn_<field>, as it is compared; with ML
    da_<field> of a free-text field, as its similarity is taken. A value is normalised once, however many it meets.
    """
    value = {f: f"nullif(cast({side}_{f} as string), '')" for f in fields}
    plain = {f: strip_separators(v) if f in NUMERIC_FIELDS else normalize(v) for f, v in value.items()}
    rated = [f for f in fields if f in TEXT_FIELDS] if use_ml else []
    return [
        *(F.expr(v).alias(f"{side}_{f}") for f, v in value.items()),
        *(F.expr(v).alias(f"{side}n_{f}") for f, v in plain.items()),
        *(F.expr(normalize_address(value[f])).alias(f"{side}a_{f}") for f in rated),
    ]


def _differ(x: str, y: str) -> str:
    return f"concat('PDF=\\'', {x}, '\\' vs Excel=\\'', {y}, '\\'')"


def compare_field(column: str, field: str, d: str, m: str, score: str | None, matched: str | None) -> str:
    """SQL text of the result struct of one field; the first rule that fits decides.

    ``d`` and ``m`` name the two values, null when empty; dn_<field> and mn_<field> hold them as they are compared.
    ``score`` names the similarity of a free-text field, absent without ML; ``matched`` tells whether there is a
    master row.
    """
    rules: list[tuple[str, str, str]] = []
    if matched:
        rules.append((f"not {matched}", MISSING, quoted(NO_ROW)))
    rules += [
        (f"{d} is null and {m} is null", MISSING, quoted(BOTH_EMPTY)),
        (f"{d} is null", MISSING, quoted(NO_DOCUMENT_VALUE)),
        (f"{m} is null", MISSING, quoted(NO_MASTER_VALUE)),
    ]
    scored = score if field in TEXT_FIELDS else None
    nd, nm = f"dn_{field}", f"mn_{field}"
    if field in NUMERIC_FIELDS:
        rules.append((f"{nd} = {nm}", MATCH, quoted(SAME_NUMBER)))
        rules.append(("true", MISMATCH, _differ(nd, nm)))
    else:
        rules.append((f"{nd} = {nm}", MATCH, quoted(SAME_TEXT)))
        rules.append((contains_either(nd, nm), MATCH, quoted(PART_OF)))
        if scored:
            grade, shown = similarity_class(scored), score_text(scored)
            close = f"concat('ML similarity match (', {grade}, ', score=', {shown}, ')')"
            far = f"concat('ML similarity=', {shown}, ' (', {grade}, '). ', {_differ(d, m)})"
            rules.append((f"{scored} >= {SIMILAR_ENOUGH}", MATCH, close))
            rules.append(("true", MISMATCH, far))
        else:
            rules.append(("true", MISMATCH, _differ(d, m)))
    outcome = " ".join(
        f"when {test} then named_struct('status', '{status}', 'notes', {notes})" for test, status, notes in rules
    )
    rated = f"if({matched}, {scored}, null)" if scored and matched else scored or "cast(null as double)"
    return (
        f"transform(array(case {outcome} end), o -> named_struct("
        f"'field_name', {quoted(column)}, 'pdf_key', {quoted(field)}, 'pdf_value', {d}, 'excel_value', {m}, "
        f"'match_status', o.status, 'notes', o.notes, 'similarity_score', {rated}, "
        f"'similarity_class', if({rated} is null, null, {similarity_class(rated)})))[0]"
    )


def compare_rows(
    rows: DataFrame, keep: list[str], mapping: dict[str, str] | None = None,
    use_ml: bool = True, matched: str | None = None,
) -> DataFrame:
    """``keep``, the array ``results`` in mapping order, and with ML name_sim and addr_sim.

    ``rows`` holds the values of document and master row as d_<field> and m_<field>.
    """
    mapping = mapping or COLUMN_TO_FIELD
    fields = list(mapping.values())
    return compare_prepared(
        rows.select(*keep, *prepared(fields, "d", use_ml), *prepared(fields, "m", use_ml)), keep, mapping, use_ml, matched
    )


def compare_prepared(
    rows: DataFrame, keep: list[str], mapping: dict[str, str], use_ml: bool = True, matched: str | None = None
) -> DataFrame:
    """``compare_rows`` of rows that hold the columns of ``prepared`` for both sides."""
    rated, scores = _rated(rows, mapping, use_ml)
    return compare_rated(rated, keep, mapping, scores, matched)


def compare_rated(
    rated: DataFrame, keep: list[str], mapping: dict[str, str], scores: dict[str, str], matched: str | None = None
) -> DataFrame:
    """``compare_prepared`` of rows that hold the similarities, too, in the columns that ``scores`` names by field."""
    results = ", ".join(
        compare_field(column, field, f"d_{field}", f"m_{field}", scores.get(field), matched)
        for column, field in mapping.items()
    )
    return rated.select(*keep, *scores.values(), F.expr(f"array({results})").alias("results"))


def _rated(rows: DataFrame, mapping: dict[str, str], use_ml: bool) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with the similarity of each free-text field, and the names of these columns by field."""
    scores = {"nama_pelanggan": "name_sim", "alamat": "addr_sim"} if use_ml else {}
    scores = {f: s for f, s in scores.items() if f in mapping.values()}
    return rows.withColumns({s: pair_similarity(f"da_{f}", f"ma_{f}") for f, s in scores.items()}), scores


def _plain_test(field: str) -> str:
    """SQL text: whether ``compare_field`` calls the field of a row that is there a MATCH without a similarity. Never null."""
    nd, nm = f"dn_{field}", f"mn_{field}"
    test = f"{nd} = {nm}" if field in NUMERIC_FIELDS else f"{nd} = {nm} or {contains_either(nd, nm)}"
    return f"({_both_there(field)} and ({test}))"


def _both_there(field: str) -> str:
    return f"d_{field} is not null and m_{field} is not null"


def status_count(status: str) -> str:
    return f"size(filter(results, r -> r.match_status = '{status}'))"


def match_percentage(total: int) -> str:
    return f"rint({status_count(MATCH)} / {float(total)}D * 100 * 10) / 10"


def map_master(master: DataFrame, mapping: dict[str, str] | None = None, row_id: str = "row_idx") -> DataFrame:
    """The row id and the mapped columns as m_<field>."""
    return master.select(
        row_id,
        *(F.col(f"`{column}`").cast("string").alias(f"m_{f}") for column, f in (mapping or COLUMN_TO_FIELD).items()),
    )


def compare_with_all_rows(
    document: dict[str, str | None], master: DataFrame, mapping: dict[str, str] | None = None,
    row_id: str = "row_idx", use_ml: bool = True,
) -> DataFrame:
    """One document against every master row: (row_id, row_number, results, match_count, match_percentage).

    The document's values are literals of a single pass over the master table: no join.
    """
    mapping = mapping or COLUMN_TO_FIELD
    literals = (F.lit(document.get(f)).cast("string").alias(f"d_{f}") for f in mapping.values())
    rows = map_master(master, mapping, row_id).select("*", *literals)
    return compare_rows(rows, [row_id], mapping, use_ml).select(
        row_id,
        (F.col(row_id) + 1).alias("row_number"),
        "results",
        F.expr(status_count(MATCH)).alias("match_count"),
        F.expr(match_percentage(len(mapping))).alias("match_percentage"),
    )


#: Most documents and most rows that meet in one cell of a block.
CELL = 500


def compare_with_block_rows(
    docs: DataFrame, master: DataFrame, doc_block: Column, row_block: Column, mapping: dict[str, str] | None = None,
    doc_id: str = "doc_id", row_id: str = "row_idx", use_ml: bool = True, cell: int = CELL,
) -> DataFrame:
    """Every document against every master row of its block: (doc_id, row_id, row_number, results, match_count, match_percentage).

    ``doc_block`` and ``row_block`` give the block of a document and of a row; a null block meets nothing. A constant
    block compares with all rows. The number of pairs is what is asked for; how they are spread is not left to the
    sizes of blocks: one of d documents and r rows is cut into ceil(d / cell) by ceil(r / cell) cells, a document goes
    to each cell of its row of the grid, a master row to each of its column, and a cell is a join key of its own. So no
    key joins more than about cell by cell rows, and of a block of one cell nothing is copied. Places in the grid
    are hashes of the row, so repeated attempts agree; rows equal in every column share a cell. Repeated ids are kept.
    """
    mapping = mapping or COLUMN_TO_FIELD
    fields = list(mapping.values())
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def placeable(side: DataFrame, own: str) -> DataFrame:
        # Hashed before the values are normalised; spread, since that is the work of a row.
        keys = [c for c in side.columns if c != "_block"]
        hashed = side.filter("_block is not null").withColumn("_hash", F.xxhash64(*keys)).repartition(spread, "_hash")
        return hashed.select(keys[0], "_block", "_hash", *prepared(fields, own, use_ml))

    left = placeable(docs.select(
        F.col(doc_id).alias("_doc"), doc_block.alias("_block"), *(F.col(f).cast("string").alias(f"d_{f}") for f in fields)
    ), "d")
    right = placeable(master.select(
        F.col(row_id).alias("_row"), row_block.alias("_block"),
        *(F.col(f"`{column}`").cast("string").alias(f"m_{f}") for column, f in mapping.items()),
    ), "m")
    sizes = left.groupBy("_block").agg(F.count(F.lit(1)).alias("_d")).join(
        right.groupBy("_block").agg(F.count(F.lit(1)).alias("_r")), "_block"
    )
    parts = sizes.select("_block", *(F.expr(f"cast(ceil({n} / {cell}) as int) as {n}s") for n in ("_d", "_r")))

    def placed(side: DataFrame, own: str, other: str) -> DataFrame:
        columns = [c for c in side.columns if c not in ("_block", "_hash")]
        spot = F.expr(f"cast(pmod(_hash, {own}) as int)").alias(own + "_at")
        return side.join(parts, "_block").select(
            "_block", *columns, spot, F.explode(F.expr(f"sequence(0, {other} - 1)")).alias(other + "_at")
        )

    cells = ["_block", "_ds_at", "_rs_at"]
    # A given number of partitions: by their bytes alone, AQE would put many costly cells into one task.
    pairs = placed(left, "_ds", "_rs").repartition(spread, *cells).join(placed(right, "_rs", "_ds"), cells)
    # Counted by the tests alone, so that no texts of results are made for pairs of which only the count is asked; what needs
    # no similarity before the similarities, so that a pair waits for those without all its texts. Spark would merge the
    # two steps, but for an expression that it holds to differ from call to call; it is 0.
    zero = "int(monotonically_increasing_id() < 0)"
    plain = pairs.withColumns(
        {"_plain": F.expr(" + ".join([zero, *(f"int({_plain_test(f)})" for f in fields)]))}
        | {f"_open_{f}": F.expr(f"{_both_there(f)} and not {_plain_test(f)}") for f in fields if use_ml and f in TEXT_FIELDS}
    )
    rated, scores = _rated(plain, mapping, use_ml)
    similar = "".join(f" + int(_open_{f} and {s} >= {SIMILAR_ENOUGH})" for f, s in scores.items())
    counted = rated.withColumn("_n", F.expr(f"_plain{similar}"))
    return compare_rated(counted, ["_doc", "_row", "_n"], mapping, scores).select(
        F.col("_doc").alias(doc_id),
        F.col("_row").alias(row_id),
        (F.col("_row") + 1).alias("row_number"),
        "results",
        F.col("_n").alias("match_count"),
        F.expr(f"rint(_n / {float(len(mapping))}D * 100 * 10) / 10").alias("match_percentage"),
    )
