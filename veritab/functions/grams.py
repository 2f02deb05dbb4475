"""Similarity of short texts by character 2- to 4-grams.

A gram never crosses a word border; each word is padded with one blank on both sides. The
score of a pair is the cosine of tf-idf vectors whose idf is fitted on these two texts
alone, so a shared gram weighs 1 and any other 1 + ln 1.5.

Like ``functions.text``, these functions take and return SQL text. An array of one element
binds a value that the body uses several times, so that it is computed once. For many pairs
there is ``pair_similarity``, the same score over two columns: Spark interprets functions over
arrays, while a task can keep the grams of a text for its other pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORTEST, LONGEST = 2, 4
#: Squared weight of a gram that only one of the two texts has.
UNSHARED = (1.0 + math.log(1.5)) ** 2


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def grams(x: str) -> str:
    """Every gram of a normalised text, repetitions included."""
    of_length = "transform(sequence(1, length(w) - n + 1), i -> substring(w, i, n))"
    of_word = f"flatten(transform(sequence({SHORTEST}, least({LONGEST}, length(w))), n -> {of_length}))"
    words = f"transform(filter(split({x}, ' '), v -> v <> ''), v -> concat(' ', v, ' '))"
    return f"flatten(transform({words}, w -> {of_word}))"


def profile(x: str) -> str:
    """struct(grams: distinct grams, multi: gram -> count where it repeats, norm: sum of count^2)."""
    again = "filter(s, (g, i) -> i > 0 and get(s, i - 1) = g)"
    counts = "transform(array_distinct(e), g -> 1 + size(filter(e, o -> o = g)))"
    norm = "aggregate(c, cast(size(d) as double), (acc, t) -> acc + t * t - 1)"
    struct = f"named_struct('grams', d, 'multi', map_from_arrays(array_distinct(e), c), 'norm', {norm})"
    body = let("d", "array_distinct(s)", let("e", again, let("c", counts, struct)))
    return let("s", f"array_sort({grams(x)})", body)


def gram_counts(x: str) -> str:
    """Array of struct(gram, t) of a normalised text."""
    return let("p", profile(x), "transform(p.grams, g -> named_struct('gram', g, 't', coalesce(p.multi[g], 1)))")


def _cosine(p: str, q: str) -> str:
    """Cosine of two profiles. Only shared grams that repeat need their counts."""

    def total(weight: str) -> str:
        return f"aggregate(r, cast(size(h) as double), (acc, g) -> acc + {weight} - 1)"

    tp, tq = f"coalesce({p}.multi[g], 1)", f"coalesce({q}.multi[g], 1)"

    def norm(profiled: str, mass: str) -> str:
        return f"({mass} + {UNSHARED}D * ({profiled}.norm - {mass}))"

    value = f"{total(f'{tp} * {tq}')} / sqrt({norm(p, 'mp')} * {norm(q, 'mq')})"
    body = let("mp", total(f"{tp} * {tp}"), let("mq", total(f"{tq} * {tq}"), value))
    repeated = f"array_intersect(h, array_union(map_keys({p}.multi), map_keys({q}.multi)))"
    shared = f"array_intersect({p}.grams, {q}.grams)"
    return let("h", shared, f"if(size(h) = 0, 0D, {let('r', repeated, body)})")


def similarity(x: str, y: str) -> str:
    """Score of two texts already through ``normalize_address``; four decimals.

    Made for names and addresses. For long texts use ``operators.similarity``, whose cost
    does not grow with the square of the number of repeated grams.
    """
    scored = let("p", profile("a"), let("q", profile("b"), _cosine("p", "q")))
    chosen = f"case when a = '' or b = '' then 0D when a = b then 1D else rint({scored} * 10000) / 10000 end"
    return let("a", x, let("b", y, chosen))


#: A worker keeps the grams of this many texts and words, none of them longer than that.
KEPT_TEXTS, KEPT_LENGTH = 2048, 200


def _cut(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(w) - n + 1)]


_kept_word = lru_cache(KEPT_TEXTS)(_cut)


def _counted(x: str) -> tuple[Counter, dict[str, int], int]:
    """Gram -> count of a normalised text, those that repeat, and the sum of count^2."""
    found: list[str] = []
    for word in x.split(" "):
        if word:
            found += _kept_word(word) if len(word) <= KEPT_LENGTH else _cut(word)
    counts = Counter(found)
    multi = {g: t for g, t in counts.items() if t > 1} if len(counts) < len(found) else {}
    return counts, multi, len(counts) + sum(t * t - 1 for t in multi.values())


_kept = lru_cache(KEPT_TEXTS)(_counted)


#: From this share of all pairs of a batch's texts on, and for this many numbers at most, all are scored as a product.
DENSE, MOST_CELLS = 0.25, 1 << 22


def counts(x: str) -> Counter:
    """Gram -> count of a normalised text, for Python in tasks."""
    return _counted(x)[0]


def _grams_of(x: str) -> tuple[Counter, dict[str, int], int]:
    return _kept(x) if len(x) <= KEPT_LENGTH else _counted(x)


def _score(x: str, y: str) -> float:
    (p, multi_p, norm_p), (q, multi_q, norm_q) = _grams_of(x), _grams_of(y)
    shared = p.keys() & q.keys()
    dot = mass_p = mass_q = len(shared)
    for gram in shared & (multi_p.keys() | multi_q.keys()) if multi_p or multi_q else ():
        tp, tq = p[gram], q[gram]
        dot += tp * tq - 1
        mass_p += tp * tp - 1
        mass_q += tq * tq - 1
    if not dot:
        return 0.0
    squared = (mass_p + UNSHARED * (norm_p - mass_p)) * (mass_q + UNSHARED * (norm_q - mass_q))
    return round(dot / math.sqrt(squared) * 10000) / 10000


def _filled(texts: Sequence[str], number: dict[str, int]) -> np.ndarray:
    """The counts of the texts' grams, texts x grams; a gram without a number is left out."""
    # Of 200 characters at most: sums of products stay far below 2 ** 24 and are exact.
    table = np.zeros((len(texts), len(number) + 1), "float32")
    for row, text in zip(table, texts):
        counts = _grams_of(text)[0]
        row[[number.get(g, -1) for g in counts]] = [*counts.values()]
    table[:, -1] = 0
    return table


def _norms(texts: Sequence[str]) -> np.ndarray:
    return np.array([_grams_of(t)[2] for t in texts], "float64")


@lru_cache(2)
def _table(texts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, dict[str, int]] | None:
    """The counts of the texts' grams, their norms and the place of each gram; None if that is too large."""
    number = {g: k for k, g in enumerate(dict.fromkeys(g for t in texts for g in _grams_of(t)[0]))}
    return (_filled(texts, number), _norms(texts), number) if len(texts) * len(number) <= MOST_CELLS else None


def _all_scores(xs: Sequence[str], ys: tuple[str, ...]) -> np.ndarray | None:
    """The score of each of ``xs`` with each of ``ys``; None if there are too many grams."""
    if (table := _table(ys)) is None or len(xs) * len(table[2]) > MOST_CELLS:
        return None
    q, norm_q, number = table
    p, norm_p = _filled(xs, number), _norms(xs)
    dot = (p @ q.T).astype("float64")
    mass_p, mass_q = (p * p) @ (q > 0).astype("float32").T, (p > 0).astype("float32") @ (q * q).T
    squared = (mass_p + UNSHARED * (norm_p[:, None] - mass_p)) * (mass_q + UNSHARED * (norm_q - mass_q))
    return np.rint(np.divide(dot, np.sqrt(squared), out=np.zeros_like(dot), where=dot > 0) * 10000) / 10000


def _distinct(a: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The number of each text, -1 for null, and the texts by number."""
    coded = a.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64"), coded.dictionary.to_pylist()


@F.arrow_udf(T.DoubleType())
def pair_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """``similarity`` of two columns of texts already through ``normalize_address``; the same doubles.

    Equal pairs of a batch are scored once. Where most texts of a batch meet, they are scored together.
    """
    (x, xs), (y, ys) = _distinct(a), _distinct(b)
    at = {t: i for i, t in enumerate(xs)}
    empty = (x == at.get("", -2)) | (y == (ys.index("") if "" in ys else -2))
    same = np.array([*(at.get(t, -2) for t in ys), -3], "int64")[y] == x
    null = ((x < 0) | (y < 0)) & ~empty
    out = np.where(same & ~empty, 1.0, 0.0)
    rest = np.flatnonzero(~(empty | null | same))
    x, y = x[rest], y[rest]
    scores = None
    if len(rest) >= DENSE * len(xs) * len(ys) > 0 and max(map(len, filter(None, (*xs, *ys))), default=0) <= KEPT_LENGTH:
        order = sorted(range(len(ys)), key=ys.__getitem__)
        table = _all_scores(xs, tuple(ys[k] for k in order))
        if table is not None:
            scores = table[x, np.argsort(order)[y]]
    if scores is None:
        pairs, place = np.unique(x * len(ys) + y, return_inverse=True)
        met = zip((pairs // max(len(ys), 1)).tolist(), (pairs % max(len(ys), 1)).tolist())
        scores = np.array([_score(xs[k], ys[m]) for k, m in met], "float64")[place]
    out[rest] = scores
    return pa.array(out, pa.float64(), mask=null)
