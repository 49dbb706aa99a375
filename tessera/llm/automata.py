"""Grammar inference: probabilistic automata from labelled strings, by merging statistically compatible prefix-tree states."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

STOP = ""
#: Visits from which a state's symbol frequencies are tested symbol by symbol, and the test's confidence.
MIN_VISITS, ALPHA = 30, 0.01
#: Largest difference of class frequencies (half the summed differences) between states that merge.
MAX_DIFFERENCE = 0.35
#: Share of a state's probability that goes to symbols unseen there.
NOVELTY = 0.01


def char_class(c: str) -> str:
    """Upper case, lower case, digit; any other symbol is its own class."""
    return "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c


_CLASS_SIZE = {"A": 26, "a": 26, "0": 10}


@dataclass
class Node:
    n: int = 0
    next: dict[str, int] = field(default_factory=dict)
    seen: Counter = field(default_factory=Counter)  # symbols that followed, STOP among them


def prefix_tree(strings: list[str]) -> list[Node]:
    nodes = [Node()]
    for s in strings:
        at = 0
        for c in s:
            nodes[at].n += 1
            nodes[at].seen[c] += 1
            if c not in nodes[at].next:
                nodes[at].next[c] = len(nodes)
                nodes.append(Node())
            at = nodes[at].next[c]
        nodes[at].n += 1
        nodes[at].seen[STOP] += 1
    return nodes


def _classes(node: Node) -> Counter:
    out: Counter = Counter()
    for c, k in node.seen.items():
        out[char_class(c) if c else STOP] += k
    return out


def difference(a: Node, b: Node) -> float:
    """Total variation between the class frequencies of two states."""
    x, y = _classes(a), _classes(b)
    return sum(abs(x[k] / a.n - y[k] / b.n) for k in x.keys() | y.keys()) / 2


def compatible(nodes: list[Node], a: int, b: int, depth: int = 6) -> bool:
    """Whether two states and what follows them can't be told apart: Hoeffding's bound on each symbol's frequency."""
    x, y = nodes[a], nodes[b]
    bound = math.sqrt(math.log(2 / ALPHA) / 2) * (1 / math.sqrt(x.n) + 1 / math.sqrt(y.n))
    if min(x.n, y.n) >= MIN_VISITS and any(abs(x.seen[c] / x.n - y.seen[c] / y.n) > bound for c in x.seen.keys() | y.seen.keys()):
        return False
    if difference(x, y) > max(MAX_DIFFERENCE, bound):
        return False
    return depth == 0 or all(compatible(nodes, x.next[c], y.next[c], depth - 1) for c in x.next.keys() & y.next.keys() if x.next[c] != y.next[c] and min(nodes[x.next[c]].n, nodes[y.next[c]].n) >= MIN_VISITS)


def _fold(nodes: list[Node], into: int, what: int) -> None:
    """Adds the subtree of `what` to state `into`."""
    todo = [(into, what)]
    while todo:
        a, b = todo.pop()
        x, y = nodes[a], nodes[b]
        x.n += y.n
        x.seen.update(y.seen)
        for c, k in y.next.items():
            if c in x.next:
                if x.next[c] != k:
                    todo.append((x.next[c], k))
            else:
                x.next[c] = k


@dataclass(frozen=True)
class Automaton:
    """Transition and log2-probability tables; a symbol unseen in a state takes the commonest way of its class there."""

    step: tuple[dict[str, tuple[int, float]], ...]
    by_class: tuple[dict[str, tuple[int, float]], ...]
    stop: tuple[float, ...]

    def way(self, at: int, c: str) -> tuple[int, float] | None:
        return self.step[at].get(c) or self.by_class[at].get(char_class(c))

    def log2_likelihood(self, s: str) -> float:
        at, total = 0, 0.0
        for c in s:
            way = self.way(at, c)
            if way is None:
                return -math.inf
            at, p = way
            total += p
        return total + self.stop[at]

    def walk(self, s: str, start: int) -> Iterator[tuple[int, float, float]]:
        """(end, log2 likelihood of s[start:end] without the stop, that of the stop) after each symbol, as far as the automaton goes."""
        at, total = 0, 0.0
        for k in range(start, len(s)):
            way = self.way(at, s[k])
            if way is None:
                return
            at, p = way
            total += p
            yield k + 1, total, self.stop[at]


def infer(strings: list[str]) -> Automaton:
    """A probabilistic automaton of the strings: tree states in breadth-first order merge into the most alike compatible state."""
    nodes = prefix_tree(strings)
    red: list[int] = [0]
    blue = [k for _, k in sorted(nodes[0].next.items())]
    while blue:
        blue.sort(key=lambda k: -nodes[k].n)
        b = blue.pop(0)
        fits = [(difference(nodes[r], nodes[b]), -r, r) for r in red if compatible(nodes, r, b)]
        if fits:
            into = min(fits)[2]
            for r in red:
                nodes[r].next = {c: into if k == b else k for c, k in nodes[r].next.items()}
            _fold(nodes, into, b)
        else:
            red.append(b)
        known = set(red)
        blue = sorted({k for r in red for k in nodes[r].next.values()} - known)
    name = {r: i for i, r in enumerate(red)}
    step, by_class, stop = [], [], []
    for r in red:
        x, ways = nodes[r], {}
        step.append({c: (name[k], math.log2((1 - NOVELTY) * x.seen[c] / x.n)) for c, k in x.next.items()})
        for c, k in x.next.items():
            ways.setdefault(char_class(c), Counter())[name[k]] += x.seen[c]
        spread = {cl: w.most_common(1)[0][0] for cl, w in ways.items()}
        by_class.append({cl: (k, math.log2(NOVELTY * sum(ways[cl].values()) / x.n / _CLASS_SIZE.get(cl, 1))) for cl, k in spread.items()})
        stop.append(math.log2(max(x.seen[STOP], NOVELTY) / x.n))
    return Automaton(tuple(step), tuple(by_class), tuple(stop))
