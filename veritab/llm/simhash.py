"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius by permuted block tables.

Terms are the distinct words of a text, each with its characters as weight (24 at most), so frequent short words don't
make strangers alike and one changed word moves few bits. A term's 128 hash bits
vote for or against the bits of the fingerprint. Votes are summed by ordinary aggregation: two bits share a long, 32 bits apart, so 64
sums of packed lanes hold all 128 and stay inside generated code.

``with_next`` pairs each row with the one after it in key order without sorting the table in one task: keys are cut
into ranges at quantiles of a bounded sample, and the first row of each range is also sent, marked, to the end of
the range before it (the first range's to the last), so a window within a range sees every successor. Whole texts
are shuffled once.

``within_radius``: a fingerprint's bits are cut into blocks. Two fingerprints that differ in at most ``radius``
bits differ in at most radius // blocks bits of some block, so one table for each block, keyed by its bits, finds every
such pair when it is asked for the block and for all values within so many flipped bits. Only the asked fingerprints
are multiplied by these flips. Equal fingerprints are one entry with a count, so copies cost nothing.

Defined cases: a null text counts as empty; without words all bits are 0. Null keys come last, ties by text,
null texts first. If all keys are null, the last row has no next row and gets the empty text for it. Repeated rows are
rows of their own; an empty table gives no rows. Only key and text are read. Column expressions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.columns import let, words

BITS = 128
HEAVIEST = 24
#: Rows in a range of keys, about, sampled keys for each range, and ranges at most: beyond that ranges grow, so that
#: the boundaries, which travel with the plan, stay a short list. A range is sorted with spilling, never held.
RANGE_ROWS, SAMPLED, MOST_RANGES = 8192, 64, 20_000
RADIUS, BLOCKS = 17, 6

_LANES = (1 << 32) | 1


def terms(text: Column) -> Column:
    """(h: hash, l: length) of each distinct word of ``text``."""
    return F.transform(
        F.array_distinct(words(text)),
        lambda w: F.struct(F.xxhash64(w).alias("h"), F.least(F.length(w), F.lit(HEAVIEST)).alias("l")),
    )


def _assembled(word: int) -> Column:
    """64 of the fingerprint's bits from the lanes ``v{word}_{j}``: bit j in the low lane, j + 32 in the high one.

    Folded over an array of the lanes: written out, 64 branches for each word take longer to compile than to run.
    """
    lanes = F.array(*[F.col(f"v{word}_{j}") for j in range(32)])

    def bit(votes: Column, place: Column) -> Column:
        return F.when(2 * votes > F.col("weight"), F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(0)

    def bits(lane: Column, j: Column) -> Column:
        return bit(lane.bitwiseAND((1 << 32) - 1), j).bitwiseOR(bit(F.shiftrightunsigned(lane, 32), j + 32))

    return F.aggregate(F.transform(lanes, bits), F.lit(0).cast("long"), lambda total, x: total.bitwiseOR(x))


def fingerprints(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """``by`` and the fingerprint (hi, lo: long) of each row of ``df``; ``by`` must tell rows apart.

    Sums of longs are hashed, not sorted, so rows of words are never stored; a column to keep belongs into ``by``, as
    the maximum of a string would need a sort.
    """
    voted = df.select(*by, F.explode_outer(terms(F.col(text))).alias("t")).select(
        *by, F.coalesce("t.l", F.lit(0)).cast("long").alias("w"),
        F.coalesce("t.h", F.lit(0)).alias("h0"), F.xxhash64("t.h", F.lit(1)).alias("h1"),
    )
    sums = [
        F.sum(F.shiftrightunsigned(f"h{word}", j).bitwiseAND(_LANES) * F.col("w")).alias(f"v{word}_{j}")
        for word in (0, 1)
        for j in range(32)
    ]
    summed = voted.groupBy(*by).agg(F.sum("w").alias("weight"), *sums)
    return summed.select(*by, _assembled(0).alias("hi"), _assembled(1).alias("lo"))


def spelled(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / BITS


def _rank(cuts: list, key: Column, kind: str) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``: every s-th cut first, then the s cuts after that one."""
    if not cuts:
        return F.lit(0)
    s = max(1, int(len(cuts) ** 0.5))
    values = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>")
    coarse = F.array(*[F.lit(c) for c in cuts[::s]]).cast(f"array<{kind}>")
    reached = F.size(F.filter(coarse, lambda c: c <= key))
    fine = lambda m: F.when(m == 0, 0).otherwise(
        (m - 1) * s + F.size(F.filter(F.slice(values, (m - 1) * s + 1, s), lambda c: c <= key))
    )
    return F.when(key.isNull(), len(cuts)).otherwise(let(reached, fine))


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, next_text, range, place, next_range, next_place) for each row of ``df``, by ascending key."""
    kind = df.schema[key].dataType.simpleString()
    keyed = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, least = keyed.agg(F.count("*"), F.min("key")).first()
    wanted = min(-(-rows // RANGE_ROWS), MOST_RANGES)
    share = SAMPLED * wanted / max(1, rows)
    sample = keyed.select("key").where("key IS NOT NULL")
    picked = sorted(
        r["key"]
        for r in sample.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < min(1.0, share) * 1_000_000)
        .distinct()
        .collect()  # SAMPLED for each range, about
    )
    cuts = sorted({picked[len(picked) * k // wanted] for k in range(1, wanted)} - {least}) if picked else []
    ranges = len(cuts) + 1
    firsts = F.array(*[F.lit(c) for c in [least, *cuts]]).cast(f"array<{kind}>")
    here = keyed.withColumn("range", _rank(cuts, F.col("key"), kind)).withColumn(
        "first", F.coalesce(F.col("key") == F.get(firsts, F.col("range")), F.lit(False))
    )
    both = F.array(
        F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")),
        F.struct(F.pmod(F.col("range") - 1, F.lit(ranges)).alias("range"), F.lit(True).alias("guest")),
    )
    sent = here.withColumn("to", F.explode(F.when(F.col("first"), both).otherwise(F.slice(both, 1, 1)))).select(
        "key", "text", F.col("to.range").alias("range"), F.col("to.guest").alias("guest")
    )
    order = Window.partitionBy("range").orderBy("guest", F.col("key").asc_nulls_last(), "text")
    seen = sent.select(
        "*",
        F.row_number().over(order).alias("place"),
        F.lead("text").over(order).alias("next_text"),
        F.coalesce(F.lead("guest").over(order), F.lit(True)).alias("last"),
    ).where(~F.col("guest"))
    return seen.select(
        "key",
        "text",
        F.coalesce("next_text", F.lit("")).alias("next_text"),
        "range",
        "place",
        F.when(F.col("last"), F.pmod(F.col("range") + 1, F.lit(ranges))).otherwise(F.col("range")).alias("next_range"),
        F.when(F.col("last"), 1).otherwise(F.col("place") + 1).alias("next_place"),
    )


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half replaced by as many first characters of ``other``, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def block_keys(flipped: int, blocks: int = BLOCKS) -> Column:
    """Array of each block's number and bits of hi and lo, in one number, for all values within ``flipped`` bits."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    widest = max(b - a for a, b in zip(edges, edges[1:]))
    half = BITS // 2

    def block(start: int, end: int) -> Column:
        """Bits ``start`` to ``end``, as a number."""
        if end <= half:
            bits = F.shiftrightunsigned("hi", half - end)
        elif start >= half:
            bits = F.shiftrightunsigned("lo", BITS - end)
        else:
            bits = F.shiftleft("hi", end - half).bitwiseOR(F.shiftrightunsigned("lo", BITS - end))
        return bits.bitwiseAND((1 << end - start) - 1)

    def flips(k: int, start: int, end: int) -> Column:
        masks = [sum(1 << b for b in bits) for n in range(flipped + 1) for bits in combinations(range(end - start), n)]
        numbered = block(start, end) + F.lit(k << widest)
        # One parameter only: to a second one, even with a default, Spark gives the place in the array.
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: numbered.bitwiseXOR(m))

    return F.flatten(F.array(*[flips(k, start, end) for k, (start, end) in enumerate(zip(edges, edges[1:]))]))


def within_radius(prints: DataFrame, asked: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, near, copies): for each of ``asked``, the ones of ``prints`` at most ``radius`` bits away.

    Both have a column ``fingerprint`` of 32 hex digits; copies: rows of ``prints`` that bear ``near``.
    """
    # Grouped as numbers, so that the digits are read once for each row and not once for each key.
    number = lambda at: F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("long")
    as_numbers = lambda df: df.select(number(1).alias("hi"), number(17).alias("lo"))
    stored = as_numbers(prints).groupBy("hi", "lo").agg(F.count("*").alias("copies"))
    # A given number of partitions: by their bytes alone, AQE would list the keys of all in one task.
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = as_numbers(asked).repartition(tasks, "hi", "lo").distinct()
    table = stored.select(
        F.col("hi").alias("near_hi"), F.col("lo").alias("near_lo"), "copies", F.explode(block_keys(0, blocks)).alias("k")
    )
    apart = F.bit_count(F.col("hi").bitwiseXOR(F.col("near_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("near_lo")))
    probes = wanted.select("hi", "lo", F.explode(block_keys(radius // blocks, blocks)).alias("k"))
    # Spark guesses the size before the keys are listed, far too low; sides that grow with the data aren't broadcast.
    found = probes.join(table.hint("merge"), "k").where(apart <= radius)
    return found.select("hi", "lo", "near_hi", "near_lo", "copies").distinct().select(
        spelled(F.col("hi"), F.col("lo")).alias("fingerprint"),
        spelled(F.col("near_hi"), F.col("near_lo")).alias("near"),
        "copies",
    )
