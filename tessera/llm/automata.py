"""Probabilistic automata inferred by state merging from labelled strings."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable

import numpy as np

#: Symbols of the alphabet: letters fall into classes by case, by vowel or consonant and by whether they are hex
#: digits, decimal digits are one class, marks stand for themselves; 0 is anything else.
CLASSES = ("ghjklmnpqrstvwxyz", "iou", "bcdf", "ae", "GHJKLMNPQRSTVWXYZ", "IOU", "BCDF", "AE", "0123456789", "+", "/", "_", ".", "=", "-")
SYMBOLS = len(CLASSES) + 1
END = SYMBOLS
TO_SYMBOL = bytes(next((i + 1 for i, c in enumerate(CLASSES) if chr(b) in c), 0) for b in range(256))


def symbols(text: str) -> bytes:
    return text.encode("latin-1", "replace").translate(TO_SYMBOL)


class _Tree:
    """Prefix tree with counts: for each state its arrivals, its ends and its children by symbol."""

    def __init__(self, samples: Iterable[bytes]):
        self.arrived, self.ended, self.next, self.passed = [0], [0], [{}], [{}]
        for s in samples:
            at = 0
            self.arrived[0] += 1
            for x in s:
                if x not in self.next[at]:
                    self.next[at][x] = len(self.arrived)
                    for column, new in ((self.arrived, 0), (self.ended, 0), (self.next, {}), (self.passed, {})):
                        column.append(new)
                self.passed[at][x] = self.passed[at].get(x, 0) + 1
                at = self.next[at][x]
                self.arrived[at] += 1
            self.ended[at] += 1

    def alike(self, a: int, b: int, root: float) -> bool:
        """Hoeffding's test on ends and moves of two states, and of what follows alike from both."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.arrived[a], self.arrived[b]
            slack = root * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ended[a] / n - self.ended[b] / m) > slack:
                return False
            for x in self.passed[a].keys() | self.passed[b].keys():
                if abs(self.passed[a].get(x, 0) / n - self.passed[b].get(x, 0) / m) > slack:
                    return False
            todo += [(self.next[a][x], self.next[b][x]) for x in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, into: int, gone: int) -> None:
        """Add a state that is a tree of its own, and all below it, to another."""
        todo = [(into, gone)]
        while todo:
            a, b = todo.pop()
            self.arrived[a] += self.arrived[b]
            self.ended[a] += self.ended[b]
            for x, n in self.passed[b].items():
                self.passed[a][x] = self.passed[a].get(x, 0) + n
                if x in self.next[a]:
                    todo.append((self.next[a][x], self.next[b][x]))
                else:
                    self.next[a][x] = self.next[b][x]


class Automaton:
    """Log-probabilities of symbols and ends by state, and the next states."""

    def __init__(self, moves: np.ndarray, logs: np.ndarray):
        self.moves, self.logs = moves.tolist(), logs.tolist()

    def score(self, s: bytes) -> float:
        """The log-likelihood of a whole string; a move never seen leads back to the start at its smoothed cost."""
        at, total = 0, 0.0
        for x in s:
            total += self.logs[at][x]
            at = self.moves[at][x]
        return total + self.logs[at][END]


def infer(samples: Iterable[str], alpha: float = 0.01, smooth: float = 0.05) -> Automaton:
    """Merge compatible states of the samples' prefix tree: settled states are tried in the order in which they were
    found, a state that none of them is like becomes settled, its children are then tried in turn."""
    tree = _Tree(map(symbols, samples))
    root = math.sqrt(0.5 * math.log(2 / alpha))
    settled, waiting = [0], deque((0, x) for x in sorted(tree.next[0]))
    while waiting:
        parent, x = waiting.popleft()
        state = tree.next[parent][x]
        if state in settled:
            continue
        like = next((s for s in settled if tree.alike(s, state, root)), None)
        if like is None:
            settled.append(state)
            waiting += [(state, y) for y in sorted(tree.next[state])]
        else:
            tree.next[parent][x] = like
            before = {s: set(tree.next[s]) for s in settled}
            tree.fold(like, state)
            waiting += [(s, y) for s in settled for y in sorted(set(tree.next[s]) - before[s])]
            # folding may have reached settled states below; their new children were queued above
    place = {s: i for i, s in enumerate(settled)}
    moves = np.zeros((len(settled), SYMBOLS), np.int64)
    logs = np.zeros((len(settled), SYMBOLS + 1))
    for s, i in place.items():
        counts = np.array([tree.passed[s].get(x, 0) for x in range(SYMBOLS)] + [tree.ended[s]], float) + smooth
        logs[i] = np.log(counts / counts.sum())
        for x, to in tree.next[s].items():
            moves[i, x] = place.get(to, 0)
    return Automaton(moves, logs)
