"""Piece lattices of many words at once: a trie as a sorted array, and the forward algorithm in logarithms."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Lattice:
    """The pieces in some words, sorted by end, then word.

    Word k has ``lengths[k] + 1`` cells from ``first[k]`` on, one before each character and one after the last. A
    piece with row ``row`` leads from cell ``begin`` to cell ``end``; ``place`` is its end within the word.
    """

    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    place: np.ndarray
    lengths: np.ndarray
    first: np.ndarray


class Trie:
    """Pieces by their characters: the child of node s for character code c is child[k] where keys[k] = s * codes + c.

    Rows count from 1 in the order given; characters that are no piece themselves have the row ``unknown``.
    """

    def __init__(self, pieces: Iterable[str]) -> None:
        pieces = list(pieces)
        self.unknown = len(pieces) + 1
        use: dict[str, int] = {}
        for p in pieces:
            for c in p:
                use[c] = use.get(c, 0) + 1
        # Code 0 is for characters in no piece and for the end of a word.
        codes = {c: k + 1 for k, c in enumerate(sorted(use, key=lambda c: (-use[c], c)))}
        self.codes = np.zeros(0x110000, np.int32)
        for c, k in codes.items():
            self.codes[ord(c)] = k
        children: list[dict[int, int]] = [{}]
        rows = [0]
        for row, p in enumerate(pieces, 1):
            node = 0
            for c in p:
                k = codes[c]
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    rows.append(0)
                node = children[node][k]
            rows[node] = row
        self.size = len(codes) + 1
        edges = sorted((node * self.size + k, to) for node, kids in enumerate(children) for k, to in kids.items())
        self.keys = np.array([key for key, _ in edges] + [np.iinfo(np.int64).max], np.int64)
        self.child = np.array([to for _, to in edges] + [0], np.int64)
        self.roots = np.zeros(self.size, np.int64)  # the root's child for each code, 0 for none
        for k, to in children[0].items():
            self.roots[k] = to
        self.rows = np.array(rows, np.int32)
        self.longest = max(map(len, pieces), default=1)

    def lattice(self, words: list[str]) -> Lattice:
        """All starts of all words walk down the trie together, a character a step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths + 1) - lengths - 1
        text = "\0".join(words) + "\0" * (self.longest + 1)
        codes = self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        inside = np.ones(int((lengths + 1).sum()), bool)
        inside[first + lengths] = False  # the cell after a word is where its zero stands
        codes[: len(inside)][~inside] = 0
        start = np.flatnonzero(inside)
        node = None
        alone = np.zeros(len(inside), bool)
        begins, ends, rows = [], [], []
        at = start
        for depth in range(self.longest):
            if depth:
                key = node * self.size + codes[at + depth]
                slot = np.searchsorted(self.keys, key)
                alive = self.keys[slot] == key
                at, node = at[alive], self.child[slot[alive]]
            else:
                child = self.roots[codes[at]]
                alive = child > 0
                at, node = at[alive], child[alive]
            if not len(at):
                break
            row = self.rows[node]
            hit = row > 0
            begins.append(at[hit])
            ends.append(at[hit] + depth + 1)
            rows.append(row[hit])
            if depth == 0:
                alone[at[hit]] = True
        missing = start[~alone[start]]
        begin = np.concatenate([missing, *begins])
        end = np.concatenate([missing + 1, *ends])
        row = np.concatenate([np.full(len(missing), self.unknown, np.int32), *rows])
        place = end - np.repeat(first, lengths + 1)[begin]
        order = np.lexsort((end, place))
        return Lattice(begin[order], end[order], row[order], place[order], lengths, first)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.diff(values, prepend=-1))


def log_sums(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the logarithms of the sums of exp(values) of each run of equal keys."""
    at = _runs(keys)
    top = np.maximum.reduceat(values, at, axis=0)
    spread = np.exp(values - np.repeat(top, np.diff(at, append=len(keys)), axis=0))
    return keys[at], top + np.log(np.add.reduceat(spread, at, axis=0))


def steps(places: np.ndarray) -> list[slice]:
    at = _runs(places)
    return [slice(a, b) for a, b in zip(at, [*at[1:], len(places)])]


def forward(x: Lattice, weights: np.ndarray) -> np.ndarray:
    """For each cell the log of the summed weights of all segmentations before it.

    ``weights``: log weight of each row, one column for each model.
    """
    alpha = np.full((int((x.lengths + 1).sum()), weights.shape[1]), -np.inf)
    alpha[x.first] = 0.0
    for s in steps(x.place):
        cells, sums = log_sums(alpha[x.begin[s]] + weights[x.row[s]], x.end[s])
        alpha[cells] = sums
    return alpha


def backward(x: Lattice, weights: np.ndarray) -> np.ndarray:
    """For each cell the log of the summed weights of all segmentations after it."""
    beta = np.full((int((x.lengths + 1).sum()), weights.shape[1]), -np.inf)
    beta[x.first + x.lengths] = 0.0
    # Begin within the word, last ones first; cells of a word lie together, so equal begins do, too.
    length = x.end - x.begin
    order = np.lexsort((x.begin, -(x.place - length)))
    begin, end, row, place = x.begin[order], x.end[order], x.row[order], (x.place - length)[order]
    for s in steps(place):
        cells, sums = log_sums(beta[end[s]] + weights[row[s]], begin[s])
        beta[cells] = sums
    return beta
