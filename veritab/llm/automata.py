"""Probabilistic automata learned from examples by merging compatible states of a prefix tree."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log, sqrt

#: Probability of a character that a state has never seen.
UNSEEN = 1e-4


@dataclass(frozen=True)
class Automaton:
    """follow[q][c]: next state and log-probability of character c in state q; stop[q]: of ending there."""

    follow: tuple[dict[str, tuple[int, float]], ...]
    stop: tuple[float, ...]

    def logs(self, word: str) -> list[float]:
        """Log-likelihood of each character of ``word`` after those before it."""
        out, q, unseen = [], 0, log(UNSEEN)
        for c in word:
            q, p = self.follow[q].get(c, (0, unseen))
            out.append(p)
        return out

    def rate(self, word: str) -> float:
        """Mean of ``logs``. The end is left out: a key half as long has the same format."""
        found = self.logs(word)
        return sum(found) / max(1, len(found))


class _Prefixes:
    def __init__(self, words: list[str]) -> None:
        self.n, self.ends, self.to, self.count = [0], [0], [{}], [{}]
        for word in words:
            q = 0
            self.n[0] += 1
            for c in word:
                if c not in self.to[q]:
                    self.to[q][c], self.count[q][c] = len(self.n), 0
                    for column, empty in ((self.n, 0), (self.ends, 0)):
                        column.append(empty)
                    self.to.append({})
                    self.count.append({})
                self.count[q][c] += 1
                q = self.to[q][c]
                self.n[q] += 1
            self.ends[q] += 1

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether no ending or continuation of both differs by more than chance allows (Hoeffding's bound)."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            na, nb = self.n[a], self.n[b]
            reach = bound * (1 / sqrt(na) + 1 / sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > reach:
                return False
            for c in self.to[a].keys() | self.to[b].keys():
                if abs(self.count[a].get(c, 0) / na - self.count[b].get(c, 0) / nb) > reach:
                    return False
                if c in self.to[a] and c in self.to[b]:
                    pairs.append((self.to[a][c], self.to[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to state ``a``."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for c, child in self.to[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + self.count[b][c]
                if c in self.to[a]:
                    pairs.append((self.to[a][c], child))
                else:
                    self.to[a][c] = child


def learn(words: list[str], alpha: float = 0.05) -> Automaton:
    """Merge each state with the first settled one it is compatible with; one that fits none becomes settled itself."""
    tree = _Prefixes(sorted(words))
    bound = sqrt(0.5 * log(2 / alpha))
    settled, known = [0], {0}

    def unsettled() -> tuple[int, str] | None:
        """The first edge out of a settled state that leads to one that isn't; folding may add some anywhere."""
        return next(((q, c) for q in settled for c in sorted(tree.to[q]) if tree.to[q][c] not in known), None)

    while edge := unsettled():
        q, c = edge
        b = tree.to[q][c]
        fit = next((r for r in settled if tree.compatible(r, b, bound)), None)
        if fit is None:
            settled.append(b)
            known.add(b)
        else:
            tree.to[q][c] = fit
            tree.fold(fit, b)
    place = {q: k for k, q in enumerate(settled)}
    follow, stop = [], []
    for q in settled:
        total = tree.n[q] + 1.0
        follow.append({c: (place[r], log(tree.count[q][c] / total)) for c, r in tree.to[q].items()})
        stop.append(log(max(tree.ends[q], exp(-9)) / total))
    return Automaton(tuple(follow), tuple(stop))
