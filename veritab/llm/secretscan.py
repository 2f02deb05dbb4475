"""Secret scans: fixed patterns, and automata learned from what they find.

The patterns find labelled credentials of three kinds. A bounded sample of each kind's distinct values (those with
the lowest hashes) makes a prefix tree, whose statistically compatible states are merged into a probabilistic
automaton. What the patterns' spans leave of every run of token characters anywhere in a text is a candidate, and if it
fails, so are its parts between '=', those between '/' in parts that fail, and so on for '.', '-' and '_'. A candidate
has as many characters as the shortest learned value, or SHORTEST if that is less. It is reported as kind ``format``
if, under some automaton, its mean log-likelihood per character is no more than DEVIATIONS standard errors (for its
length) below the labelled values' and above that of uniformly random characters.

Short values give false alarms: automata of 11 distinct values of 40 hex digits accept 30 of the 148,527 runs of 6 to 19
letters and digits in the documents of sf0.01, 16 of them numbers of 16 digits, the others of 6 letters.

Patterns are matched per kind, leftmost and without overlap, over whole texts; positions count code points, ends are
exclusive. Spans are ordered by start, then by kind as in KINDS. Defined cases: null text counts as empty and has no
span. Repeated rows are scanned alike. Without labelled values only the patterns report. An empty table gives no
rows. Other columns are kept; added names get underscores where they clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.automata import Automaton, learn
from veritab.llm.columns import fresh_name
from veritab.llm.vocabulary import bound_batches

# The patterns, and the lengths below which a match is dropped.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST_VALUE, SHORTEST_ACCESS, SHORTEST_HEX = 6, 20, 24
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
SEPARATORS = "=/.-_"
KINDS = ("assign", "access", "hex", "format")
#: Found in every text that ASSIGN matches, once it is lower-cased.
HINTS = ("passw", "secret", "token", "api")
SHORTEST = 20
#: Labelled values for each kind, at most.
SAMPLE = 300
DEVIATIONS = 3.0
REPLACEMENT = "<SECRET>"

_IN_TOKEN = np.zeros(256, np.int8)
_IN_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = 1
ALPHABET = int(_IN_TOKEN.sum())

Span = tuple[int, int, int]  # start, place in KINDS, end


def has_long_token(text: str, size: int = SHORTEST) -> bool:
    """Whether ``size`` token characters stand in a row; one pass over the bytes."""
    b = np.frombuffer(text.encode(), np.uint8)
    outside = np.flatnonzero(_IN_TOKEN[b] == 0)
    if not len(outside):
        return len(b) >= size
    return bool(outside[0] >= size or len(b) - 1 - outside[-1] >= size or np.diff(outside).max(initial=0) > size)


def labelled_spans(text: str) -> list[tuple[Span, str]]:
    """The spans of the patterns with the credentials in them."""
    found = []
    low = text.lower()
    if any(hint in low for hint in HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= SHORTEST_VALUE:
                found.append(((m.start(), 0, m.end()), m[2]))
    if has_long_token(text):
        for m in ACCESS.finditer(text):
            if len(m[0]) >= SHORTEST_ACCESS:
                found.append(((m.start(), 1, m.end()), m[0]))
        for token in CANDIDATE.finditer(text):  # a run of hex digits this long lies in a candidate
            for m in HEX.finditer(text, token.start(), token.end()):
                if m.end() - m.start() >= SHORTEST_HEX:
                    found.append(((m.start(), 2, m.end()), m[0]))
    return sorted(found)


@dataclass(frozen=True)
class Formats:
    """Automata of the labelled kinds, each with the mean and standard deviation of a character's log-likelihood."""

    automata: tuple[tuple[Automaton, float, float], ...] = ()
    shortest: int = SHORTEST

    def accepts(self, token: str) -> bool:
        if not token:
            return False
        least = ((a.rate(token), mean - DEVIATIONS * spread / len(token) ** 0.5) for a, mean, spread in self.automata)
        return any(rate >= max(bound, -log(ALPHABET)) for rate, bound in least)


def learn_formats(values: dict[str, list[str]]) -> Formats:
    """One automaton for each kind of labelled ``values``."""
    out = []
    for _, words in sorted(values.items()):
        automaton = learn(words)
        logs = np.array([x for w in words for x in automaton.logs(w)])
        out.append((automaton, float(logs.mean()), float(logs.std())))
    return Formats(tuple(out), min([SHORTEST, *(len(w) for words in values.values() for w in words)]))


def spans(text: str, formats: Formats) -> list[Span]:
    base = [s for s, _ in labelled_spans(text)]
    if not formats.automata or not has_long_token(text, formats.shortest):
        return base
    added: list[Span] = []
    at = 0
    for m in TOKEN.finditer(text):
        if m.end() - m.start() < formats.shortest:
            continue
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        left, k = m.start(), at
        while k < len(base) and base[k][0] < m.end():
            added += _parts(text, left, base[k][0], formats)
            left = max(left, base[k][2])
            k += 1
        added += _parts(text, left, m.end(), formats)
    return sorted(base + added)


def _parts(text: str, start: int, end: int, formats: Formats) -> Iterator[Span]:
    """The accepted candidates in ``text[start:end]``: all of it, or parts between the first separator, and so on."""
    todo = [(start, end, 0)]
    while todo:
        start, end, k = todo.pop()
        if end - start < formats.shortest:
            continue
        if formats.accepts(text[start:end].strip(".=-_/+")):
            yield start, 3, end
            continue
        while k < len(SEPARATORS) and text.find(SEPARATORS[k], start, end) < 0:
            k += 1
        if k < len(SEPARATORS):
            for part in text[start:end].split(SEPARATORS[k]):
                todo.append((start, start + len(part), k + 1))
                start += len(part) + 1


def train(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> Formats:
    """Automata from the credentials that the patterns find in ``df``."""
    bound_batches(df.sparkSession)

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = {(s[1], v) for t in batch["text"] if t for s, v in labelled_spans(t)}
            yield pd.DataFrame(sorted(pairs), columns=["kind", "value"])

    found = df.select(F.col(text).alias("text")).mapInPandas(labelled, "kind int, value string").distinct()
    values: dict[str, list[str]] = {}
    for k, kind in enumerate(KINDS[:3]):
        lowest = found.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        if lowest:
            values[kind] = [r["value"] for r in lowest]  # ``sample`` at most
    return learn_formats(values)


def scan(df: DataFrame, formats: Formats, text: str = "text") -> DataFrame:
    """``df`` with ``secrets``: an array of (kind, start, end)."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(formats)

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [
                    [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t, shared.value)] if t else []
                    for t in batch
                ]
            )

    return df.withColumn(fresh_name(df, "secrets"), found(df[text]))


def redact(df: DataFrame, formats: Formats, text: str = "text") -> DataFrame:
    """``df`` with every span in ``text`` written as REPLACEMENT; overlapping spans are replaced together."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(formats)

    def cleaned(t: str | None) -> str | None:
        if not t:
            return t
        parts, at = [], 0
        for start, _, end in spans(t, shared.value):
            if start >= at:
                parts += [t[at:start], REPLACEMENT]
            at = max(at, end)
        return "".join([*parts, t[at:]])

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([cleaned(t) for t in batch.where(batch.notna(), None)], dtype=object)

    return df.withColumn(text, of(df[text]))
