"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations of the product of its pieces' probabilities, which the forward algorithm gives in one
pass over the word; a text's is the product over its words. The language with the highest posterior (all languages
equally likely beforehand) wins; ``score`` is that posterior.

Training is expectation-maximisation on word counts of a bounded sample of labelled rows: at most
``per_language`` rows of each language, those with the lowest hashes of their keys, with their whole texts. The
expected piece counts of a step are computed in tasks and summed by Spark; the driver sees at most one number per
piece and language. Only text and language of training rows are read.

Words are runs of letters, lower-cased, with a word mark in front. A letter that the vocabulary lacks costs the same
in every language.

Defined cases: null text, empty text and text without a letter give ``und`` and score 0. Ties go to the first
language in code point order. Without a labelled row every text gives ``und``. Repeated rows are judged alike;
an empty table gives no rows; other columns are kept and never read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.columns import fresh_name
from veritab.llm.lattice import Trie, backward, forward
from veritab.llm.vocabulary import SPACE, VOCABULARY, bound_batches, load
from veritab.llm.worker import held
from veritab.session import durable

PER_LANGUAGE = 1000
STEPS = 4
UNDETERMINED = "und"
#: Added to each expected piece count.
SMOOTHING = 0.1
UNKNOWN_LETTER = 1e-6
#: Words whose lattices are held at once.
AT_ONCE = 4096
#: Scored words that a worker keeps; once there are more, the half used most stays.
KEPT_WORDS = 150_000
#: Characters of the words that a worker keeps.
KEPT_CHARACTERS = 4_000_000
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """weights[row, language]: log-probability of the trie's pieces by their rows, the last row of any other letter."""

    languages: list[str]
    trie: Trie
    weights: np.ndarray


def expected(model: Model, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each row of the model, by language, in words that occur ``counts`` times (by language)."""
    x = model.trie.lattice(words)
    alpha, beta = forward(x, model.weights), backward(x, model.weights)
    total = alpha[x.first + x.lengths]
    cells = np.repeat(np.arange(len(words)), x.lengths + 1)[x.begin]
    share = np.exp(alpha[x.begin] + model.weights[x.row] + beta[x.end] - total[cells]) * counts[cells]
    return np.stack([np.bincount(x.row, share[:, k], len(model.weights)) for k in range(share.shape[1])], axis=1)


def runs(token: str) -> list[str]:
    """The marked letter runs of a token that hold a letter."""
    return [SPACE + run for run in LETTERS.findall(token) if any(c.isalpha() for c in run)]


def log_likelihoods(model: Model, words: list[str]) -> np.ndarray:
    """Natural log of each word's probability, by language."""
    out = np.empty((len(words), len(model.languages)))
    by_length = sorted(range(len(words)), key=lambda k: len(words[k]))
    for c in range(0, len(words), AT_ONCE):
        at = by_length[c : c + AT_ONCE]
        x = model.trie.lattice([words[k] for k in at])
        out[at] = forward(x, model.weights)[x.first + x.lengths]
    return out


def _weighted(uses: np.ndarray) -> np.ndarray:
    """Log-probabilities from the (expected) uses of the pieces; row 0 stands for nothing."""
    shares = np.full((len(uses), uses.shape[1]), UNKNOWN_LETTER)
    shares[1:-1] = uses[1:-1] / uses[1:-1].sum(0)
    shares[0] = 1e-300
    return np.log(shares)


def _start(vocabulary_path: str, languages: list[str]) -> Model:
    """Every language alike: a piece's share falls with its place in the vocabulary."""
    usable = {}
    for rank, piece in enumerate(load(vocabulary_path).pieces):
        letters = piece.removeprefix(SPACE)
        if piece and piece == piece.lower() and (letters == "" or LETTERS.fullmatch(letters)) and piece not in usable:
            usable[piece] = 1.0 / (rank + 100)
    uses = np.ones((len(usable) + 2, len(languages)))
    uses[1:-1] = np.array(list(usable.values()))[:, None]
    return Model(languages, Trie(usable), _weighted(uses))


def training_counts(
    df: DataFrame, key: str, text: str, lang: str, per_language: int = PER_LANGUAGE
) -> tuple[DataFrame, list[str]]:
    """Word counts (word, lang, n) of a bounded sample of the rows of ``df``, and its languages in order."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    order = Window.partitionBy("_l").orderBy("_h", "_k")
    picked = (
        labelled.select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.xxhash64(F.col(key)).alias("_h"))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= per_language)
        .select("_k", "_l")
        .distinct()
    )
    sample = (
        labelled.select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.col(text).alias("_t"))
        .join(F.broadcast(picked), ["_k", "_l"], "left_semi")  # per_language rows a language at most
        .dropDuplicates(["_k", "_l"])
    )
    run = F.explode(F.regexp_extract_all(F.lower("_t"), F.lit(r"\p{L}+"), F.lit(0)))
    counts = durable(
        sample.select(F.col("_l").alias("lang"), run.alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    return counts, sorted(r["lang"] for r in counts.select("lang").distinct().collect())


def train(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    vocabulary: str = VOCABULARY,
    steps: int = STEPS,
) -> Model:
    """A model of the languages of ``df``'s labelled rows."""
    spark = df.sparkSession
    counts, languages = training_counts(df, key, text, lang, per_language)
    model = _start(vocabulary, languages)
    if not languages:
        return model
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(model)

        def step(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            model = shared.value
            place = {name: k for k, name in enumerate(model.languages)}
            uses = np.zeros_like(model.weights)
            for batch in batches:
                counts = np.zeros((len(batch), len(place)))
                counts[np.arange(len(batch)), batch["lang"].map(place)] = batch["n"]
                for c in range(0, len(batch), AT_ONCE):
                    uses += expected(model, [SPACE + w for w in batch["word"][c : c + AT_ONCE]], counts[c : c + AT_ONCE])
            row, language = np.nonzero(uses)
            yield pd.DataFrame({"row": row, "language": language, "uses": uses[row, language]})

        summed = (
            counts.mapInPandas(step, "row long, language long, uses double")
            .groupBy("row", "language")
            .agg(F.sum("uses").alias("uses"))
            .toPandas()  # pieces x languages at most
        )
        uses = np.full_like(model.weights, SMOOTHING)
        np.add.at(uses, (summed["row"], summed["language"]), summed["uses"])
        model = Model(languages, model.trie, _weighted(uses))
        shared.unpersist()
    return model


class _Tokens(dict):
    """Place of each token in the table of scores; new tokens wait in ``new`` until they are scored."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.characters = 0

    def __missing__(self, token: str) -> int:
        self[token] = k = len(self)
        self.characters += len(token)
        self.new.append(token)
        return k


class Scorer:
    """Scores texts with a model; remembers tokens, as most come again."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.tokens = _Tokens()
        self.scores = np.zeros((0, len(self.model.languages)))
        self.lettered = np.zeros(0, bool)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the tokens used most since the last time; what is kept changes no result."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: KEPT_WORDS // 2])
        names = list(self.tokens)
        tokens = _Tokens()
        tokens.update((names[k], place) for place, k in enumerate(kept.tolist()))
        tokens.characters = sum(map(len, tokens))
        self.tokens, self.scores, self.lettered = tokens, self.scores[kept], self.lettered[kept]
        self.uses = np.zeros(len(kept), np.int64)

    def _learn(self) -> None:
        new, self.tokens.new = self.tokens.new, []
        parts = [runs(t) for t in new]
        distinct = sorted({r for p in parts for r in p})
        scores = np.zeros((len(new), len(self.model.languages)))
        if distinct:
            at = {r: k for k, r in enumerate(distinct)}
            flat = np.fromiter((at[r] for p in parts for r in p), np.int64)
            owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
            np.add.at(scores, owner, log_likelihoods(self.model, distinct)[flat])
        self.scores = np.concatenate([self.scores, scores])
        self.lettered = np.concatenate([self.lettered, np.array([bool(p) for p in parts], bool)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if self.tokens.characters > KEPT_CHARACTERS:
            self.clear()
        elif len(self.tokens) > KEPT_WORDS:
            self._forget()
        place = self.tokens.__getitem__
        at = [np.fromiter(map(place, (t or "").lower().split()), np.int64) for t in texts]
        if self.tokens.new:
            self._learn()
        names, scores = [], []
        for ids in at:
            self.uses[ids] += 1
            if not self.model.languages or not self.lettered[ids].any():
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.scores[ids].sum(0)
            best = int(total.argmax())
            names.append(self.model.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (underscores are added to names it has already)."""
    spark: SparkSession = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    name_of_scorer = f"scorer {uuid.uuid4().hex}"

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = held(name_of_scorer, lambda: Scorer(shared.value))
        for batch in batches:
            names, scores = scorer.predict(batch.where(batch.notna(), None).tolist())
            yield pd.DataFrame({"lang": names, "score": scores})

    name, score, both = fresh_name(df, "lang_pred"), fresh_name(df, "score"), fresh_name(df, "_predicted")
    return (
        df.withColumn(both, predict(df[text]))
        .withColumn(name, F.col(f"`{both}`.lang"))
        .withColumn(score, F.col(f"`{both}`.score"))
        .drop(both)
    )
