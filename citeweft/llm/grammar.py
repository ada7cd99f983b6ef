"""Probabilistic automata inferred from example strings (state merging on a prefix tree).

Three steps, of which the first and the last are sums over strings, so that tasks can take them in parts:
``prefix_counts``, what follows each prefix; ``Automaton``, the states, by merging the tree of the prefixes that enough
strings begin with; and ``steps``, how often each state took each symbol, for ``counted``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log, sqrt

#: Prefixes longer than this are no states of their own; the symbols behind them count as all others.
DEEPEST = 256
#: Added to each count of a symbol, and of an end.
SMOOTH = 0.1


def _after(h: int, c: str) -> int:
    """A prefix's hash, 63 bits, from that of the prefix without its last symbol; the empty one has 0."""
    h = (h ^ ord(c) + 1) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 63) - 1
    return (h ^ h >> 31) * 0xD6E8FEB86659FD93 & (1 << 63) - 1


def prefixes(s: str) -> Iterator[tuple[int, str]]:
    """The hash of each prefix of a string, up to the longest that counts, and what follows: a symbol, or "" at the end."""
    h = 0
    for c in s[:DEEPEST]:
        yield h, c
        h = _after(h, c)
    if len(s) <= DEEPEST:
        yield h, ""


@dataclass
class _State:
    n: int = 0  # strings that come here
    ends: int = 0  # and stop
    to: dict[str, list] = field(default_factory=dict)  # symbol -> [count, state or None: too few strings]


class Automaton:
    """A deterministic automaton with probabilities, from labelled strings.

    The strings' prefix tree is taken state by state, nearest to the root first. A state is merged with a kept state
    if their frequencies of stopping and of each next symbol agree by Hoeffding's bound at level ``alpha``, and those
    of the states behind them as well; otherwise it is kept. Prefixes of fewer than ``least`` strings tell nothing and
    lead to the root. Then all strings are counted along the automaton; a symbol that no state foresaw leads to the root.
    """

    def __init__(self, strings: list[str], alpha: float = 0.05, least: int = 8, alphabet: int = 70):
        follow: dict[int, Counter] = {}
        for s in strings:
            for h, c in prefixes(s):
                follow.setdefault(h, Counter())[c] += 1
        self._infer({h: f for h, f in follow.items() if sum(f.values()) >= least or not h}, alpha, least, alphabet)
        steps = Counter(x for s in strings for x in self.steps(s))
        self.counted({x: steps[x] for x in sorted(steps)})

    @classmethod
    def from_prefixes(cls, follow: dict[int, dict[str, int]], alpha: float = 0.05, least: int = 8, alphabet: int = 70) -> Automaton:
        """From what follows each prefix of at least ``least`` strings, by ``prefixes``' hashes; not yet counted."""
        out = cls.__new__(cls)
        out._infer(follow, alpha, least, alphabet)
        return out

    def _infer(self, follow: dict[int, dict[str, int]], alpha: float, least: int, alphabet: int) -> None:
        self.alphabet, self.least, self.width = alphabet, least, sqrt(0.5 * log(2 / alpha))
        root = _State()
        todo = [(root, 0)]
        while todo:
            state, h = todo.pop()
            for c, n in sorted(follow.get(h, {}).items()):
                state.n += n
                if not c:
                    state.ends += n
                    continue
                child = _State() if _after(h, c) in follow else None
                state.to[c] = [n, child]
                if child:
                    todo.append((child, _after(h, c)))
        kept = self._merge(root)
        number = {id(s): k for k, s in enumerate(kept)}
        #: for each state, where a symbol leads
        self.next = [{c: number[id(x)] if x else 0 for c, (_, x) in s.to.items()} for s in kept]
        self.states: list[tuple[float, float, dict[str, tuple[float, int]]]] = []

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.width * (1 / sqrt(n1) + 1 / sqrt(n2))

    def _agree(self, a: _State, b: _State) -> bool:
        todo = [(a, b)]
        seen = set()
        while todo:
            a, b = todo.pop()
            if (id(a), id(b)) in seen or a is b or min(a.n, b.n) < self.least:
                continue
            seen.add((id(a), id(b)))
            if self._differ(a.ends, a.n, b.ends, b.n):
                return False
            for c in a.to.keys() | b.to.keys():
                x, y = a.to.get(c), b.to.get(c)
                if self._differ(x[0] if x else 0, a.n, y[0] if y else 0, b.n):
                    return False
                if x and y and x[1] and y[1]:
                    todo.append((x[1], y[1]))
        return True

    def _fold(self, into: _State, tree: _State) -> None:
        """Adds a subtree of the prefix tree to a state."""
        todo = [(into, tree)]
        while todo:
            into, tree = todo.pop()
            into.n += tree.n
            into.ends += tree.ends
            for c, (count, state) in sorted(tree.to.items()):
                edge = into.to.setdefault(c, [0, None])
                edge[0] += count
                if edge[1] is None:
                    edge[1] = state
                elif state:
                    todo.append((edge[1], state))

    def _merge(self, root: _State) -> list[_State]:
        kept = [root]
        known = {id(root)}
        while True:
            # edges from kept states to states not yet kept, those with most strings first
            edges = [(-edge[0], k, c, edge) for k, s in enumerate(kept) for c, edge in s.to.items() if edge[1] and id(edge[1]) not in known]
            if not edges:
                return kept
            *_, edge = min(edges, key=lambda e: e[:3])
            blue = edge[1]
            for red in kept:
                if self._agree(red, blue):
                    edge[1] = red
                    self._fold(red, blue)
                    break
            else:
                kept.append(blue)
                known.add(id(blue))

    def steps(self, s: str) -> Iterator[tuple[int, str]]:
        """The states that a string goes through, with the symbol taken there, "" at the end."""
        at = 0
        for c in s:
            yield at, c
            at = self.next[at].get(c, 0)
        yield at, ""

    def counted(self, steps: dict[tuple[int, str], int]) -> None:
        """Sets the probabilities from how often each state took each symbol; ``states`` has their logs."""
        sums = [0] * len(self.next)
        for (k, _), n in steps.items():
            sums[k] += n
        whole = [n + SMOOTH * (self.alphabet + 1) for n in sums]
        self.states = [(log(SMOOTH / w), log((steps.get((k, ""), 0) + SMOOTH) / w), {}) for k, w in enumerate(whole)]
        for (k, c), n in steps.items():
            if c:
                self.states[k][2][c] = (log((n + SMOOTH) / whole[k]), self.next[k].get(c, 0))

    def log_likelihood(self, s: str) -> float:
        """Natural log of the smoothed probability of a string; a symbol never seen in a state leaves it in place."""
        at, out = self.states[0], 0.0
        for c in s:
            edge = at[2].get(c)
            if edge:
                out += edge[0]
                at = self.states[edge[1]]
            else:
                out += at[0]
        return out + at[1]
