"""Similarity over columns of texts: one row per gram instead of arrays per text."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions import grams as G
from veritab.functions.text import normalize_address
from veritab.session import durable

_WEIGHT2 = G.UNSHARED


def _pair_grams(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys, gram, ta, tb): how often either text of a pair has each gram.

    Pairs are spread first and keep their place: a task counts the grams of its pairs, few of them at a time.
    """
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = pairs.repartition(spread, *keys).select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("side"), F.expr(normalize_address(a)).alias("text")),
                F.struct(F.lit(1).alias("side"), F.expr(normalize_address(b)).alias("text")),
            )
        ),
    )
    return (
        sides.select(*keys, "side", F.explode_outer(F.expr(G.grams("text"))).alias("gram"))
        .filter(F.col("gram").isNotNull())
        .groupBy(*keys, "gram")
        .agg(F.count_if(F.col("side") == 0).alias("ta"), F.count_if(F.col("side") == 1).alias("tb"))
    )


def _cosine(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    value = F.try_divide(dot, F.sqrt(norm_a * norm_b))
    return F.coalesce(F.rint(value * 10000) / F.lit(10000.0), F.lit(0.0))


def pair_scores(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys, score) of each pair for itself, for texts of any length."""
    weight = F.when((F.col("ta") > 0) & (F.col("tb") > 0), F.lit(1.0)).otherwise(F.lit(_WEIGHT2))
    scored = (
        _pair_grams(pairs, keys, a, b)
        .groupBy(*keys)
        .agg(
            F.sum((F.col("ta") * F.col("tb")).cast("double")).alias("dot"),
            F.sum(F.col("ta") * F.col("ta") * weight).alias("na"),
            F.sum(F.col("tb") * F.col("tb") * weight).alias("nb"),
        )
        .select(*keys, _cosine(F.col("dot"), F.col("na"), F.col("nb")).alias("_score"))
    )
    na, nb = F.expr(normalize_address(a)), F.expr(normalize_address(b))
    score = (
        F.when((na == "") | (nb == ""), F.lit(0.0))
        .when(na == nb, F.lit(1.0))
        .otherwise(F.coalesce("_score", F.lit(0.0)))
    )
    return pairs.join(scored, list(keys), "left").select(*keys, score.alias("score"))


def batch_scores(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys, score) with one idf fitted over all texts of all pairs.

    Not equal to ``pair_scores``: weights depend on the whole set and equal texts take
    no shortcut.
    """
    counts = _pair_grams(pairs, keys, a, b)
    texts = pairs.agg(F.count(F.lit(1)) * 2).scalar()
    seen = F.sum((F.col("ta") > 0).cast("int") + (F.col("tb") > 0).cast("int"))
    idf = counts.groupBy("gram").agg(seen.alias("df"))
    idf = idf.select("gram", (F.log((texts + 1) / (F.col("df") + 1)) + 1).alias("w"))
    w2 = F.col("w") * F.col("w")
    scored = (
        counts.join(idf, "gram")
        .groupBy(*keys)
        .agg(
            F.sum(F.col("ta") * F.col("tb") * w2).alias("dot"),
            F.sum(F.col("ta") * F.col("ta") * w2).alias("na"),
            F.sum(F.col("tb") * F.col("tb") * w2).alias("nb"),
        )
        .select(*keys, _cosine(F.col("dot"), F.col("na"), F.col("nb")).alias("_score"))
    )
    return pairs.join(scored, list(keys), "left").select(
        *keys, F.coalesce("_score", F.lit(0.0)).alias("score")
    )


def best_candidates(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, best_index, best_score): the candidate most similar to each query.

    ``queries`` is (query_id, query), ``candidates`` (query_id, idx, candidate). The idf is
    fitted over a query and its candidates; of equal scores the lowest idx wins. Without
    candidates the result is (-1, 0.0).
    """
    kind = queries.schema["query_id"].dataType
    spread = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = queries.select(
        "query_id", F.lit(None).cast("bigint").alias("idx"), F.expr(normalize_address("query")).alias("text")
    ).unionByName(
        candidates.select(
            F.col("query_id").cast(kind), F.col("idx").cast("bigint"), F.expr(normalize_address("candidate")).alias("text")
        )
    )
    # Spread before texts become grams: a task counts those of its candidates, and sums them up where they are.
    texts = durable(texts.filter(F.col("query_id").isNotNull()).repartition(spread, "query_id", "idx"))
    none = F.struct(F.lit(-0.0).alias("neg"), F.col("idx").cast("bigint").alias("idx"))
    sizes = candidates.groupBy(F.col("query_id").cast(kind).alias("query_id")).agg(
        (F.count(F.lit(1)) + 1).alias("texts"), F.min(none).alias("none")
    )
    sizes = durable(sizes.filter(F.col("query_id").isNotNull()).withColumn("slices", F.expr(f"int(ceil(texts / {SLICE}))")))

    # What grows with the candidates is joined by merging, if at all: a file of a few MB may hold grams that fill the driver.
    # The written table is small for its rows, so it is spread again before its texts become grams.
    seen = texts.repartition(spread, "query_id", "idx").select("query_id", F.explode_outer(F.expr(f"array_distinct({G.grams('text')})")).alias("gram"))
    seen = seen.filter(F.col("gram").isNotNull()).groupBy("query_id", "gram").agg(F.count(F.lit(1)).alias("df"))
    asked = texts.filter(F.col("idx").isNull()).select("query_id", F.inline_outer(F.expr(G.gram_counts("text"))))
    asked = asked.filter(F.col("gram").isNotNull()).groupBy("query_id", "gram").agg(F.max("t").alias("tq"))
    stats = seen.join(asked.hint("merge"), ["query_id", "gram"], "left").join(sizes.hint("merge"), "query_id")
    weights = stats.select(
        "query_id", "gram", F.coalesce("tq", F.lit(0)).cast("double").alias("tq"),
        F.pow(F.log((F.col("texts") + 1) / (F.col("df") + 1)) + 1, 2).alias("w2"),
        F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"),
    )
    # A query's candidates are cut into slices, and slices of all queries dealt to groups; each brings the weights of its query.
    own = texts.filter(F.col("idx").isNotNull()).join(sizes.hint("merge"), "query_id").select(
        "query_id", "idx", "text", F.expr("cast(pmod(xxhash64(idx), slices) as int)").alias("slice")
    )
    groups = max(spread, -(-texts.count() // SLICE))
    group = F.expr(f"cast(pmod(xxhash64(query_id, slice), {groups}) as int)").alias("_group")
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("neg", T.DoubleType()), T.StructField("idx", T.LongType())])
    found = (
        own.select(group, "query_id", "idx", "text").groupBy("_group")
        .cogroup(weights.select(group, F.col("query_id").alias("of"), "gram", "tq", "w2").groupBy("_group"))
        .applyInPandas(_best_of_slices, schema)
    )
    ranked = found.select("query_id", F.struct("neg", "idx").alias("best"))
    best = ranked.unionByName(sizes.select("query_id", F.col("none").alias("best"))).groupBy("query_id").agg(F.min("best").alias("best"))
    return queries.select("query_id").join(best.hint("merge"), "query_id", "left").select(
        "query_id",
        F.coalesce("best.idx", F.lit(-1)).alias("best_index"),
        F.coalesce(F.rint(-F.col("best.neg") / 1e6) / 10000.0, F.lit(0.0)).alias("best_score"),
    )


#: Candidates that are scored together, about.
SLICE = 5000


def _best_of_slices(candidates: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
    """(query_id, neg, idx): of each query in the group the candidate with the highest rank, the lowest idx among equals."""
    of: dict = {}
    for query, gram, tq, w2 in zip(weights["of"], weights["gram"], weights["tq"], weights["w2"]):
        of.setdefault(query, {})[gram] = (tq * w2, w2, tq * tq * w2)
    norms = {query: math.fsum(w[2] for w in own.values()) for query, own in of.items()}
    sums: dict = {}
    for query, idx, text in zip(candidates["query_id"], candidates["idx"], candidates["text"]):
        counts = G.counts(text)
        if counts:
            own = of[query]
            parts = sums.setdefault((query, idx), ([], []))
            parts[0].extend(t * own[g][0] for g, t in counts.items())
            parts[1].extend(t * t * own[g][1] for g, t in counts.items())
    best: dict = {}
    for (query, idx), (dots, squares) in sums.items():
        if norms[query] > 0:
            # Sums without rounding and ten places rank, so that the order of grams cannot break a tie.
            rank = round(math.fsum(dots) / math.sqrt(norms[query] * math.fsum(squares)) * 1e10)
            best[query] = min(best.get(query, (0.0, idx)), (-float(rank), idx))
    return pd.DataFrame([(query, *found) for query, found in best.items()], columns=["query_id", "neg", "idx"])
