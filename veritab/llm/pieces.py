"""SentencePiece encoding by sampling a segmentation, and lossless decoding.

A text is a lattice of vocabulary pieces. Forward filtering sums the weights of all segmentations of every prefix;
backward sampling then draws a segmentation from the end, each piece in proportion to the filtered weight before it
times its own. A draw is a hash of seed, row key, place in the text and step: no state is carried, so reruns and
other partitionings give the same pieces.

The vocabulary gives no probabilities, so a piece's weight falls with its place: 1 / (place + 100) to the power
``sharpness``. A character without a piece is written as the pieces of its UTF-8 bytes. The vocabulary's word mark
stands for a blank, and one more blank is put before the text; a mark in the text itself has no piece, so it is
written as bytes. Decoding gives back every text, byte for byte.

No piece has a blank after another character and none spans a character that occurs in no longer piece, so the
lattice falls apart at those places into units. A worker filters each distinct unit once and keeps the result;
all units of a batch are then sampled together, a step at a time.

Defined cases: null text gives null ids and null text; empty text gives no ids. Null keys count as one key. Repeated
rows get equal ids. An empty table gives no rows. Other columns are kept; added names get underscores where they
clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.columns import fresh_name
from veritab.llm.lattice import Trie, forward
from veritab.llm.vocabulary import SPACE, VOCABULARY, Vocabulary, bound_batches, load
from veritab.llm.worker import held

SHARPNESS = 1.0
SEED = 1
#: States (characters of distinct units) that a worker keeps before it starts anew.
KEPT_STATES = 600_000
#: Weight of a character written as bytes.
IN_BYTES = 1e-9


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Units(dict):
    """Number of each unit; units not met before wait in ``new`` until their lattices are filtered."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = k = len(self)
        self.new.append(unit)
        return k


class Sampler:
    """The filtered lattices of the units seen so far, as flat arrays.

    State s stands for a unit up to one of its characters. Its candidates are neighbours in the arrays ``code``
    (piece or, from len(pieces) on, a character in bytes) and ``before`` (the state before the piece, -1 at the
    unit's start) from ``first[s]`` on; ``top`` has the cumulated probability, so the first one above a draw is drawn.
    A state has few candidates, so stepping through them costs less than searching all arrays.
    """

    def __init__(self, vocabulary: Vocabulary, sharpness: float = SHARPNESS) -> None:
        self.vocabulary, n = vocabulary, len(vocabulary.pieces)
        self.ids: dict[str, int] = {}
        for i, marked in enumerate(vocabulary.pieces):
            if marked:
                self.ids.setdefault(marked.replace(SPACE, " "), i)
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece of this vocabulary spans words")
        self.trie = Trie(self.ids)
        self.id_of_row = np.array([-1, *self.ids.values(), -1])
        self.weights = np.concatenate(
            [[-np.inf], -sharpness * np.log(self.id_of_row[1:-1] + 100.0), [np.log(IN_BYTES)]]
        )[:, None]
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        # Blanks and the characters after them that longer pieces can span, or one other character.
        self.units = re.compile(f" *[{''.join(map(re.escape, sorted(inner - {' '})))}]+| +|.", re.S)
        self.bytes_of: dict[str, int] = {}
        self.byte_codes: list[tuple[int, ...]] = []
        self.first_byte_code = n
        self.clear()

    def clear(self) -> None:
        self.known = _Units()
        self.states = 0
        self.last = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.top, self.code, self.before = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _in_bytes(self, char: str) -> int:
        if char not in self.bytes_of:
            self.bytes_of[char] = self.first_byte_code + len(self.byte_codes)
            self.byte_codes.append(tuple(self.vocabulary.byte_ids[b] for b in char.encode()))
        return self.bytes_of[char]

    def _filter(self) -> None:
        """Filter the lattices of the new units and add their states."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        x = self.trie.lattice(new)
        alpha = forward(x, self.weights)[:, 0]
        share = np.exp(alpha[x.begin] + self.weights[x.row, 0] - alpha[x.end])
        order = np.argsort(x.end, kind="stable")
        begin, end, row, share = x.begin[order], x.end[order], x.row[order], share[order]
        code = self.id_of_row[row]
        starts = np.zeros(len(alpha), bool)
        starts[x.first] = True
        unit = np.repeat(np.arange(len(new)), x.lengths + 1)
        for k in np.flatnonzero(row == self.trie.unknown):
            w = unit[begin[k]]
            code[k] = self._in_bytes(new[w][begin[k] - x.first[w]])
        run = np.cumsum(share)
        first = np.flatnonzero(np.diff(end, prepend=-1))
        count = np.diff(first, append=len(end))
        run -= np.repeat(run[first] - share[first], count)
        run[first + count - 1] = 1.0
        first_of = np.zeros(len(alpha), np.int64)
        first_of[end[first]] = len(self.top) + first
        self.first = np.concatenate([self.first, first_of])
        self.top = np.concatenate([self.top, np.minimum(run, 1.0)])
        self.code = np.concatenate([self.code, code.astype(np.int32)])
        before = np.where(starts[begin], -1, self.states + begin)
        self.before = np.concatenate([self.before, before.astype(np.int32)])
        self.last = np.concatenate([self.last, self.states + x.first + x.lengths])
        self.states += len(alpha)

    def encode(self, texts: list[str | None], keys: np.ndarray, seed: int) -> list[np.ndarray | None]:
        """The sampled ids of each text; ``keys``: a number for each row."""
        if self.states > KEPT_STATES:
            self.clear()
        place_of = self.known.__getitem__
        units = [
            np.fromiter(map(place_of, self.units.findall(" " + t)), np.int64) if t else np.zeros(0, np.int64)
            for t in texts
        ]
        self._filter()
        sizes = np.array([len(u) for u in units], np.int64)
        token = np.concatenate(units) if units else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            row = _mixed(keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
            source = _mixed(row[owner] + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        state, active, step = self.last[token], np.arange(len(token)), 0
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(token), np.int64)
        while len(active):
            with np.errstate(over="ignore"):
                u = _mixed(source[active] + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(12)
            u = u.astype(np.float64) / 2.0**52
            at = self.first[state]
            below = np.flatnonzero(self.top[at] <= u)
            while len(below):
                at[below] += 1
                below = below[self.top[at[below]] <= u[below]]
            drawn.append((active, self.code[at]))
            count[active] += 1
            state = self.before[at]
            more = state >= 0
            state, active, step = state[more], active[more], step + 1
        offset = np.cumsum(count) - count
        codes = np.empty(int(count.sum()), np.int64)
        for step, (tokens, code) in enumerate(drawn):
            codes[offset[tokens] + count[tokens] - 1 - step] = code
        sizes_out = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        ids, ends = self._spelled(codes, np.cumsum(sizes_out))
        parts = np.split(ids, ends[:-1]) if len(texts) else []
        return [None if t is None else p for t, p in zip(texts, parts, strict=True)]

    def _spelled(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``codes``, and where the texts that end at ``ends`` end in them."""
        spelled = np.flatnonzero(codes >= self.first_byte_code)
        if not len(spelled):
            return codes.astype(np.int32), ends
        which, nth = np.unique(codes[spelled] - self.first_byte_code, return_inverse=True)
        in_bytes = [self.byte_codes[k] for k in which.tolist()]
        table = np.array([(*ids, 0, 0, 0)[:4] for ids in in_bytes], np.int32)[nth]
        size = np.ones(len(codes), np.int64)
        size[spelled] = np.array([len(ids) for ids in in_bytes])[nth]
        stop = np.cumsum(size)
        out = np.zeros(int(stop[-1]), np.int32)
        out[stop - size] = codes
        for k in range(4):
            longer = size[spelled] > k
            at = spelled[longer]
            out[stop[at] - size[at] + k] = table[longer, k]
        return out, np.concatenate([[0], stop])[ends]


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.bytes_of[i] = bytes([b])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    sharpness: float = SHARPNESS,
    seed: int = SEED,
) -> DataFrame:
    """``df`` with the column ``piece_ids`` (array of int)."""
    spark = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(load(vocabulary))
    name = f"sampler {vocabulary} {sharpness}"

    @F.pandas_udf("array<int>")
    def sampled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sampler = held(name, lambda: Sampler(shared.value, sharpness))
        for keys, texts in batches:
            yield pd.Series(sampler.encode(texts.where(texts.notna(), None).tolist(), keys.to_numpy(np.int64), seed))

    return df.withColumn(fresh_name(df, "piece_ids"), sampled(F.xxhash64(df[key]), df[text]))


def decode(df: DataFrame, ids: str = "piece_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the column ``decoded``: the text whose pieces are in ``ids``."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = held(f"decoder {vocabulary}", lambda: Decoder(shared.value))
        for batch in batches:
            yield pd.Series([None if x is None else decoder.decode(x.tolist()) for x in batch], dtype=object)

    return df.withColumn(fresh_name(df, "decoded"), text_of(df[ids]))
