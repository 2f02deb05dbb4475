"""Quality rules as weak supervision: rules vote, EM weighs them, a posterior decides.

Each rule votes good (1), bad (-1) or abstains (0). The votes of a document form a pattern; there are at most
3 ** len(RULES) patterns, whatever the input, so documents are reduced to pattern counts in one aggregation and
expectation-maximisation runs on that bounded table, inside one expression. The model: a document is good with
probability ``prior``; rule j, if it votes, is right about a good document with probability ``good_j`` and about a
bad one with probability ``bad_j``, independently. Two accuracies per rule, because junk of one kind trips the rule
made for it and passes the others. All of it is column expressions.

Defined cases: a null text counts as the empty text. A document without words gets votes from the length rule
only. An empty table gives no rows. Repeated rows are judged alike, each on its own. Input columns other than the
text are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.columns import WHITE_SPACE, let, words
from veritab.session import durable

ITERATIONS = 20
START_PRIOR = 0.7
#: Accuracy of a vote to start from, on good and on bad documents.
START_GOOD = 0.95
START_BAD = 0.4
#: Pseudo-votes, right and wrong alike, that keep an accuracy off 0 and 1.
SMOOTHING = 2.0
LOWEST_QUALITY = 0.5


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


#: Name and vote of each rule, over the columns of ``measured``; whole numbers only, so that any engine agrees.
RULES = {
    "length": lambda c: _vote(c["n_words"] >= 80, c["n_words"] < 20),
    "symbols": lambda c: _vote(
        (c["n_words"] > 0) & (100 * c["n_symbols"] <= c["n_words"]), 20 * c["n_symbols"] > c["n_words"]
    ),
    "repeats": lambda c: _vote(
        (c["n_words"] > 0) & (10 * c["n_repeat_words"] <= c["n_words"]),
        10 * c["n_repeat_words"] > 3 * c["n_words"],
    ),
    "lines": lambda c: _vote(
        (c["n_lines"] > 1) & (10 * c["n_dup_lines"] <= c["n_lines"]), 10 * c["n_dup_lines"] > 3 * c["n_lines"]
    ),
    "capitals": lambda c: _vote(
        (c["word_chars"] > 0) & (10 * c["n_capitals"] <= c["word_chars"]), 10 * c["n_capitals"] > 3 * c["word_chars"]
    ),
    "word_length": lambda c: _vote(
        (10 * c["word_chars"] >= 30 * c["n_words"]) & (10 * c["word_chars"] <= 65 * c["n_words"]) & (c["n_words"] > 0),
        10 * c["word_chars"] > 80 * c["n_words"],
    ),
    "letters": lambda c: _vote(
        (c["word_chars"] > 0) & (100 * c["n_letters"] >= 92 * c["word_chars"]),
        100 * c["n_letters"] < 87 * c["word_chars"],
    ),
}


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: sort the windows, keep equal neighbours, join their spans."""
    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, i, step: F.coalesce(F.get(s, i + step)["w"] == x["w"], F.lit(False))
        return F.sort_array(
            F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])
        )

    def spans(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 2, F.size(at)), at, lambda b, a: b - a)  # the last has no pair: null
        return F.aggregate(
            F.filter(gaps, lambda g: g.isNotNull()), F.lit(3), lambda total, g: total + F.least(g, F.lit(3))
        )

    return let(let(ordered, repeated), spans)


def repeat_words(w: Column) -> Column:
    """Words of ``w`` that lie in a window of three words found twice or more, the first time included."""
    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return let(
        windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g))
    ).cast("long")


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measured(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the counts that the rules read, one row for each row of ``df``."""
    t = F.coalesce(df[text], F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return df.select(
        *[df[c] for c in keep],
        by_words.alias("_words"),
        by_lines.alias("_lines"),
        (F.length(t) - _removed(t, WHITE_SPACE)).cast("long").alias("word_chars"),
        _removed(t, r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long").alias("n_letters"),
    ).select(
        *keep,
        F.col("_words.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"),
        F.col("_words.r").alias("n_repeat_words"),
        F.col("_lines.n").cast("long").alias("n_lines"),
        "n_capitals",
        "n_letters",
    )


def votes(df: DataFrame) -> Column:
    return F.array(*[rule(df) for rule in RULES.values()])


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _posterior(state: Column, pattern: Column) -> Column:
    weight = F.zip_with(
        pattern,
        F.arrays_zip(state["good"], state["bad"]),
        lambda v, a: F.when(v == 1, F.log(a["good"] / (1 - a["bad"])))
        .when(v == -1, F.log((1 - a["good"]) / a["bad"]))
        .otherwise(0.0),
    )
    return 1 / (1 + F.exp(-F.aggregate(weight, _log_odds(state["prior"]), lambda total, x: total + x)))


def label_model(patterns: DataFrame) -> DataFrame:
    """(votes, quality) for each row (votes, n) of ``patterns``: EM over the bounded pattern counts."""
    rules = len(RULES)
    table = F.sort_array(F.collect_list(F.struct("votes", "n")))

    def total(rows: Column, term) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, x: s + term(x))

    def step(table: Column, state: Column) -> Column:
        judged = F.transform(
            table, lambda p: F.struct(p["votes"].alias("v"), p["n"].alias("n"), _posterior(state, p["votes"]).alias("q"))
        )

        def updated(rows: Column) -> Column:
            def accuracy(vote: int, of_class) -> Column:
                def of_rule(j: Column) -> Column:
                    hit = lambda x: F.get(x["v"], j)
                    right = total(rows, lambda x: x["n"] * F.when(hit(x) == vote, of_class(x)).otherwise(0.0))
                    cast = total(rows, lambda x: x["n"] * F.when(hit(x) == 0, 0.0).otherwise(of_class(x)))
                    return (right + SMOOTHING) / (cast + 2 * SMOOTHING)

                return F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), of_rule)

            prior = (total(rows, lambda x: x["n"] * x["q"]) + 1) / (total(rows, lambda x: x["n"].cast("double")) + 2)
            return F.struct(
                prior.alias("prior"),
                accuracy(1, lambda x: x["q"]).alias("good"),
                accuracy(-1, lambda x: 1 - x["q"]).alias("bad"),
            )

        return let(judged, updated)

    start = F.struct(
        F.lit(START_PRIOR).alias("prior"),
        F.array(*[F.lit(START_GOOD)] * rules).alias("good"),
        F.array(*[F.lit(START_BAD)] * rules).alias("bad"),
    )
    fitted = lambda t: F.aggregate(
        F.sequence(F.lit(1), F.lit(ITERATIONS)), start, lambda state, _: step(t, state)
    )
    judged = let(
        F.col("patterns"),
        lambda t: let(
            fitted(t),
            lambda state: F.transform(
                t, lambda p: F.struct(p["votes"].alias("votes"), _posterior(state, p["votes"]).alias("quality"))
            ),
        ),
    )
    return patterns.agg(table.alias("patterns")).select(F.explode(judged).alias("x")).select("x.*")


def judge(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the counts, ``quality`` (posterior, 0 to 1) and ``good`` for each row of ``df``.

    The counts are written once to the shared folder: the pattern counts and the verdicts both read them. The
    join is a broadcast of at most 3 ** len(RULES) rows.
    """
    facts = durable(measured(df, text, list(keep)))
    voted = facts.withColumn("votes", votes(facts))
    model = label_model(voted.groupBy("votes").agg(F.count("*").alias("n")))
    return voted.join(F.broadcast(model), "votes").withColumn("good", F.col("quality") >= LOWEST_QUALITY)
