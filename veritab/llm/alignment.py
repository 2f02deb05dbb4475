"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in a corpus.

Both tokenizers cover the text with a blank before it, so a token ends at a byte offset in each. Where a token of A and
one of B end together, the text is cut; the tokens between two cuts are a group. Offsets that both have are found by
galloping: the shorter list of ends drives a search into the longer one, from the place of an earlier end in steps that
double, then by halving. All searches of a batch gallop side by side: every eighth end first, in the same way, then the
ends between from there. The places so found are ranks, and the difference of neighbouring ranks is the range of the
other's tokens that a token overlaps: the links.

An id pair's count is the number of documents that hold it linked. Documents are aligned in blocks (a batch of bounded
bytes), and a block lists each of its pairs once, with the number of its documents that hold it. These lists are summed
for the counts and joined with them; the counts then go back to the block, never to each document's links. So what is
shuffled are pairs by block, and a pair has at most one row a block, however common it is. An A id's highest count is
broadcast: one row for each id of the vocabulary at most.

Long texts are tokenized in parts, cut before single blanks between word characters: neither tokenizer has a token
across such a place, so the tokens are those of the whole.

Defined cases: a text that is null, empty, or that either tokenizer doesn't give back byte for byte has no tokens: all
its numbers are 0 and its groups are ''. Special tokens in texts are plain text. Null keys, repeated rows (each counts
as a document) and other columns are kept; an empty table gives no rows; added names get underscores where they clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm.columns import fresh_name
from veritab.llm.vocabulary import SPACE, VOCABULARY, batches_of
from veritab.session import durable

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text in a block, unless one document has more.
BLOCK_BYTES = 4_000_000
#: Characters that are tokenized at once, up to the next place for a cut.
PART = 100_000
CUT = re.compile(r"(?<=\w) (?=\w)")
#: Every so many ends are searched first.
STRIDE = 8


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of the ascending ``short`` the first place in the ascending ``long`` with at least that value."""
    if not len(short):
        return np.zeros(0, np.int64)
    low = np.zeros(len(short), np.int64)
    if len(short) > 1:
        low = np.repeat(gallop(short[::STRIDE], long), STRIDE)[: len(short)]
    high, n = low.copy(), len(long)
    # All places before ``low`` hold less; double the step until ``high`` holds enough or is the end.
    active, step = np.arange(len(short)), 1
    while True:
        active = active[high[active] < n]
        active = active[long[high[active]] < short[active]]
        if not len(active):
            break
        low[active] = high[active] + 1
        high[active] = np.minimum(high[active] + step, n)
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) // 2
        less = long[middle] < short[active]
        low[active[less]] = middle[less] + 1
        high[active[~less]] = middle[~less]
        active = active[low[active] < high[active]]
    return low


def meet(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common ends and links of two lists of ends over the same bytes.

    Gives the places of the common ends in both lists, and for each token of ``short`` the first token of ``long`` that
    it overlaps and how many.
    """
    rank = gallop(short, long)
    common = long[rank] == short if len(short) else np.zeros(0, bool)
    first = np.concatenate([[0], (rank + common)[:-1]]) if len(short) else rank
    return np.flatnonzero(common), rank[common], first, rank - first + 1


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it prints, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, from the contents of their files, with the bytes of all their tokens."""

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        place = byte_of()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(place[c] for c in entry)
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.a_sizes = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        self.cuts = not any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.b.get_piece_size()))
        # How tokens are written: A ends with ',' within a group and '|' at its end, B with ',' and ';'.
        self.written = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.b_written = len(self.written)
        self.written += [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]

    def parts(self, text: str, size: int) -> list[str]:
        """The blank and ``text``, in parts that each start with a blank."""
        text = " " + text
        if len(text) <= size or not self.cuts:
            return [text]
        parts, start = [], 0
        while start + size < len(text):
            cut = CUT.search(text, start + size)
            if not cut:
                break
            parts.append(text[start : cut.start()])
            start = cut.start()
        return [*parts, text[start:]]

    def encode(self, texts: list[str], size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        split = [self.parts(t, size) for t in texts]
        flat = list(chain.from_iterable(split))
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(flat, add_special_tokens=False)]
        b = [np.array(x, np.int64) for x in self.b.encode([p[1:] for p in flat], num_threads=1)]
        if len(flat) == len(texts):
            return a, b
        ends = np.cumsum([len(s) for s in split])
        joined = lambda ids: [np.concatenate(ids[e - len(s) : e]) for s, e in zip(split, ends, strict=True)]
        return joined(a), joined(b)


class Block:
    """The tokens of the documents of one block, aligned.

    a, b: ids of all documents that have tokens; a_counts, b_counts, groups, links: numbers by document (all documents);
    pairs: the distinct linked pairs as a * (size of B's vocabulary) + b; held: by how many documents; document, pair,
    times: how often each document links each pair (its place in ``pairs``), by document.
    """

    def __init__(self, tokenizers: Tokenizers, texts: list[str | None], part: int = PART) -> None:
        given = [k for k, t in enumerate(texts) if t]
        a, b = tokenizers.encode([texts[k] for k in given], part)
        kept = [
            k
            for k, i in enumerate(given)
            if _spells(tokenizers.a_bytes, a[k], texts[i]) and _spells(tokenizers.b_bytes, b[k], texts[i])
        ]
        where = np.array([given[k] for k in kept], np.int64)
        a, b = [a[k] for k in kept], [b[k] for k in kept]
        n_a, n_b = _lengths(a), _lengths(b)
        self.a, self.b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        a_cut, b_cut = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        linked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for driven_by_a in (True, False):
            chosen = np.flatnonzero((n_a <= n_b) == driven_by_a)
            if not len(chosen):
                continue
            own_a, own_b = _ranges(a_first[chosen], n_a[chosen]), _ranges(b_first[chosen], n_b[chosen])
            ends_a, ends_b = np.cumsum(tokenizers.a_sizes[self.a[own_a]]), np.cumsum(tokenizers.b_sizes[self.b[own_b]])
            short, long = (ends_a, ends_b) if driven_by_a else (ends_b, ends_a)
            at_short, at_long, first, count = meet(short, long)
            at_a, at_b = (at_short, at_long) if driven_by_a else (at_long, at_short)
            a_cut[own_a[at_a]], b_cut[own_b[at_b]] = True, True
            one, other = np.repeat(np.arange(len(short)), count), _ranges(first, count)
            to_a, to_b = (one, other) if driven_by_a else (other, one)
            owner = np.repeat(chosen, n_a[chosen])[to_a]
            linked.append((owner, own_a[to_a], own_b[to_b]))
        owner, to_a, to_b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*linked) if linked else [[]] * 3))
        spread = lambda values: _spread(values, where, len(texts))
        a_owner = np.repeat(np.arange(len(where)), n_a)
        self.a_counts, self.b_counts = spread(n_a), spread(n_b)
        self.groups = spread(np.bincount(a_owner[a_cut], minlength=len(where)))
        self.links = spread(np.bincount(owner, minlength=len(where)))
        place, self.pairs = pd.factorize(self.a[to_a] * len(tokenizers.b_bytes) + self.b[to_b])
        key, self.times = np.unique(owner * max(len(self.pairs), 1) + place, return_counts=True)
        self.document, self.pair = where[key // max(len(self.pairs), 1)], key % max(len(self.pairs), 1)
        self.held = np.bincount(self.pair, minlength=len(self.pairs))
        self._where, self._n_a, self._n_b, self._a_cut, self._b_cut = where, n_a, n_b, a_cut, b_cut
        self._tokenizers, self._size = tokenizers, len(texts)

    def written(self) -> list[str]:
        """The groups of each document: a1,a2|b1;a3|b2,b3."""
        a_group, b_group = (np.cumsum(cut) - cut for cut in (self._a_cut, self._b_cut))
        a_in = np.bincount(a_group, minlength=int(self._a_cut.sum()))
        b_in = np.bincount(b_group, minlength=int(self._b_cut.sum()))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + (np.cumsum(b_in) - b_in)[a_group]] = self.a * 2 + self._a_cut
        codes[np.arange(len(self.b)) + np.cumsum(a_in)[b_group]] = self._tokenizers.b_written + self.b * 2 + self._b_cut
        out, start = [""] * self._size, 0
        token = self._tokenizers.written.__getitem__
        for k, count in zip(self._where.tolist(), (self._n_a + self._n_b).tolist(), strict=True):
            out[k] = "".join(map(token, codes[start : start + count].tolist()))[:-1]
            start += count
        return out


def _spells(table: list[bytes], ids: np.ndarray, text: str) -> bool:
    return b"".join(map(table.__getitem__, ids.tolist())) == (" " + text).encode("utf-8", "surrogatepass")


def _lengths(arrays: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(len, arrays), np.int64, len(arrays))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ..., count[k] of them, for all k in turn."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(first - before, count)


def _spread(values: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[where] = values
    return out


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


ADDED = ["n_a", "n_b", "n_groups", "n_links", "groups"]
INNER = "_block long, _links array<int>, _times array<int>, _pairs array<long>, _held array<int>"


def tokens_aligned(
    df: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    byte_level: str = BYTE_LEVEL,
    pieces: str = VOCABULARY,
    part: int = PART,
) -> DataFrame:
    """The ``keep`` columns of ``df`` (all) with n_a, n_b, n_groups, n_links (long) and groups (string, the ids), and
    what ``counted`` needs: the document's links by place in its block's list of pairs, which its first row holds."""
    keep = df.columns if keep is None else keep
    names = [fresh_name(df.select(*keep), c) for c in ADDED]
    schema = T.StructType(df.select(*keep).schema.fields)
    for name in names[:-1]:
        schema.add(name, "long")
    schema.add(names[-1], "string")
    for field in T._parse_datatype_string(INNER).fields:
        schema.add(field)
    files = df.sparkSession.sparkContext.broadcast((Path(byte_level).read_text("utf-8"), Path(pieces).read_bytes()))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, number = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            tokenizers = tokenizers or Tokenizers(*files.value)
            block = Block(tokenizers, batch.column("_text").to_pylist(), part)
            first = np.zeros(batch.num_rows, np.int64)
            first[0] = len(block.pairs)
            per_row = np.bincount(block.document, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    *[pa.array(x, pa.int64()) for x in (block.a_counts, block.b_counts, block.groups, block.links)],
                    pa.array(block.written(), pa.string()),
                    pa.array(np.full(batch.num_rows, number), pa.int64()),
                    _lists(block.pair, per_row, pa.int32()),
                    _lists(block.times, per_row, pa.int32()),
                    _lists(block.pairs, first, pa.int64()),
                    _lists(block.held, first, pa.int32()),
                ],
                names=[*keep, *names, "_block", "_links", "_times", "_pairs", "_held"],
            )
            number += 1

    return df.select(*keep, df[text].alias("_text")).mapInArrow(tokenize, schema)


def pair_counts(listed: DataFrame, b_size: int) -> DataFrame:
    """(pair, documents, best) of (pair, held): how many documents hold a pair, and whether none of its A id has more."""
    counts = listed.groupBy("pair").agg(F.sum("held").alias("documents"))
    counts = durable(counts.withColumn("a", F.expr(f"pair div {b_size}")))
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))  # one row an id of A's vocabulary
    return counts.join(F.broadcast(highest), "a").select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def _settled(blocks: DataFrame, found: DataFrame, names: tuple[str, str]) -> DataFrame:
    """The rows of ``blocks`` with sums over their links of what ``found`` (_of: the block, _place, documents, best) says."""
    kept = [f for f in blocks.schema.fields if f.name not in ("_block", "_links", "_times")]
    schema = T.StructType(kept).add(names[0], "long").add(names[1], "long")

    def sums(rows: pa.Table, counts: pa.Table) -> pa.Table:
        size = counts.num_rows
        documents, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = counts.column("_place").to_numpy()
        documents[place] = counts.column("documents").to_numpy()
        best[place] = counts.column("best").to_numpy()
        links, times = (rows.column(c).combine_chunks() for c in ("_links", "_times"))
        at, weight = links.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))])
        out = rows.drop_columns(["_block", "_links", "_times"])
        for name, value in zip(names, (best, documents), strict=True):
            total = np.concatenate([[0], np.cumsum(weight * value[at])])
            out = out.append_column(name, pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
        return out

    return blocks.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(sums, schema)


def align(
    df: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    digest: bool = False,
    byte_level: str = BYTE_LEVEL,
    pieces: str = VOCABULARY,
    block_bytes: int = BLOCK_BYTES,
    part: int = PART,
) -> DataFrame:
    """The ``keep`` columns of ``df`` (all) with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups: the ids
    of both sides as ``a1,a2|b1;a3|b2,b3``, or with ``digest`` groups_sha256, the SHA-256 of that text ('' for none).

    ``block_bytes`` and ``part`` never change the result.
    """
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    aligned = tokens_aligned(df, text, keep, byte_level, pieces, part)
    columns = aligned.columns[:-5]
    groups = columns.pop()
    shown, name = F.col(f"`{groups}`"), groups
    if digest:
        shown = F.when(shown == "", "").otherwise(F.sha2(shown.cast("binary"), 256))
        name = fresh_name(aligned.select(*columns), "groups_sha256")
    plain = [F.col(f"`{c}`") for c in columns]
    with batches_of(df.sparkSession, block_bytes):
        blocks = durable(aligned.select(*plain, shown.alias(name), "_block", "_links", "_times", "_pairs", "_held"))
    lists = blocks.where(F.size("_pairs") > 0).select("_block", F.arrays_zip("_pairs", "_held").alias("_list"))
    listed = lists.select("_block", F.posexplode("_list").alias("_place", "_entry")).select(
        "_block", "_place", F.col("_entry._pairs").alias("pair"), F.col("_entry._held").cast("long").alias("held")
    )
    found = listed.join(pair_counts(listed, b_size), "pair").select(
        F.col("_block").alias("_of"), "_place", "documents", "best"
    )
    given = blocks.drop("_pairs", "_held")
    names = fresh_name(given, "n_best"), fresh_name(given, "count_sum")
    return _settled(given, found, names)
