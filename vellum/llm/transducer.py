"""Weighted finite-state transducers over symbols, in the semiring of maximum and sum.

An arc reads one symbol, writes one symbol and has a weight; a path's weight is the sum of its arcs' weights, and a
sequence of symbols weighs as much as its heaviest path from the start to a final state.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable

Arc = tuple[Hashable, float, Hashable]  # written symbol, weight, next state


class Transducer:
    def __init__(self, start: Hashable, finals: Iterable[Hashable]):
        self.start, self.finals = start, set(finals)
        self.arcs: dict[Hashable, dict[Hashable, list[Arc]]] = {}

    def add(self, state: Hashable, read: Hashable, write: Hashable, to: Hashable, weight: float = 0.0) -> None:
        self.arcs.setdefault(state, {}).setdefault(read, []).append((write, weight, to))

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes is what ``other`` reads. Only pairs of states that can be reached and can end are kept."""
        out = Transducer((self.start, other.start), ())
        todo, seen = [out.start], {out.start}
        while todo:
            a, b = state = todo.pop()
            if a in self.finals and b in other.finals:
                out.finals.add(state)
            there = other.arcs.get(b, {})
            for read, arcs in self.arcs.get(a, {}).items():
                for middle, w, to in arcs:
                    for write, v, after in there.get(middle, ()):
                        out.add(state, read, write, (to, after), w + v)
                        if (to, after) not in seen:
                            seen.add((to, after))
                            todo.append((to, after))
        return out.trimmed()

    def trimmed(self) -> Transducer:
        """Without the states that lead to no final one, and with numbers for states."""
        before: dict[Hashable, set] = {}
        for s, by in self.arcs.items():
            for arcs in by.values():
                for _, _, to in arcs:
                    before.setdefault(to, set()).add(s)
        live, todo = set(self.finals), list(self.finals)
        while todo:
            for s in before.get(todo.pop(), ()):
                if s not in live:
                    live.add(s)
                    todo.append(s)
        number: dict[Hashable, int] = {}
        name = lambda s: number.setdefault(s, len(number))
        out = Transducer(name(self.start), ())
        for s, by in self.arcs.items():
            for read, arcs in by.items():
                for write, w, to in arcs:
                    if s in live and to in live:
                        out.add(name(s), read, write, name(to), w)
        out.finals = {name(s) for s in self.finals}
        return out

    def heaviest(self) -> Heaviest:
        return Heaviest(self)


class Heaviest:
    """A transducer for weighing only: written symbols are dropped, of arcs between the same states the heaviest stays."""

    def __init__(self, t: Transducer):
        self.start, self.finals = t.start, t.finals
        self.arcs: dict[Hashable, dict[Hashable, list[tuple[Hashable, float]]]] = {}
        for s, by in t.arcs.items():
            for read, arcs in by.items():
                best: dict[Hashable, float] = {}
                for _, w, to in arcs:
                    best[to] = max(best.get(to, w), w)
                self.arcs.setdefault(read, {})[s] = list(best.items())

    def weigh(self, symbols: Iterable[Hashable]) -> float | None:
        """The weight of the heaviest accepting path; None if there is none."""
        now = {self.start: 0.0}
        for x in symbols:
            by, after = self.arcs.get(x, {}), {}
            for s, so_far in now.items():
                for to, w in by.get(s, ()):
                    if so_far + w > after.get(to, -1e300):
                        after[to] = so_far + w
            now = after
        return max((w for s, w in now.items() if s in self.finals), default=None)
