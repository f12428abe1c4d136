"""Regular expressions to one minimal deterministic automaton over bytes.

Supported syntax: literals, ``\\xHH`` and escaped characters, ``[...]`` classes,
groups, ``|``, and the quantifiers ``? * + {n} {n,} {n,m}``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class _Parser:
    """A pattern to a tree of tuples: ('set', bytes), ('cat', ...), ('alt', ...), ('rep', node, low, high)."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def parse(self):
        node = self.alt()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} of {self.p!r}")
        return node

    def alt(self):
        parts = [self.cat()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def cat(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            node = self.atom()
            while self.i < len(self.p) and self.p[self.i] in "?*+{":
                node = self.repeat(node)
            parts.append(node)
        return ("cat", *parts)

    def repeat(self, node):
        c = self.p[self.i]
        self.i += 1
        if c != "{":
            return ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        end = self.p.index("}", self.i)
        low, comma, high = self.p[self.i : end].partition(",")
        self.i = end + 1
        return ("rep", node, int(low), int(high) if high else None if comma else int(low))

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def folded(self, values: set[int]) -> frozenset[int]:
        if self.fold:
            values |= {v ^ 32 for v in values if 65 <= v & ~32 <= 90}
        return frozenset(values)

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            node = self.alt()
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            negated = self.p[self.i] == "^"
            self.i += negated
            values: set[int] = set()
            while self.p[self.i] != "]":
                a = self.char()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    values |= set(range(a, self.char() + 1))
                else:
                    values.add(a)
            self.i += 1
            whole = self.folded(values)
            return ("set", frozenset(range(256)) - whole if negated else whole)
        return ("set", self.folded({self.char()}))


@dataclass
class Nfa:
    """Thompson's construction; ``rank`` marks states that a higher rank of the same rule makes needless."""

    step: list[tuple[frozenset[int], int] | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    rank: dict[int, tuple[int, int]] = field(default_factory=dict)

    def new(self) -> int:
        self.step.append(None)
        self.free.append([])
        return len(self.step) - 1

    def add(self, node, start: int) -> int:
        """Wires ``node`` after ``start`` and returns its end."""
        kind = node[0]
        if kind == "set":
            a, b = self.new(), self.new()
            self.free[start].append(a)
            self.step[a] = (node[1], b)
            return b
        if kind == "cat":
            for part in node[1:]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.new()
            for part in node[1:]:
                self.free[self.add(part, start)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop, end = self.new(), self.new()
            self.free[start].append(loop)
            self.free[loop].append(end)
            self.free[self.add(inner, loop)].append(loop)
            return end
        end = self.new()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(inner, start)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        best: dict[int, int] = {}
        for s in seen:
            if s in self.rank:
                rule, rank = self.rank[s]
                best[rule] = max(best.get(rule, 0), rank)
        return frozenset(s for s in seen if s not in self.rank or self.rank[s][1] == best[self.rank[s][0]])


@dataclass(frozen=True)
class Dfa:
    """State 0 is the start.  next[state, class_of[byte]]; accept[state] has a bit for each pattern."""

    class_of: np.ndarray
    next: np.ndarray
    accept: np.ndarray

    @property
    def dead(self) -> np.ndarray:
        """States that no further byte leads out of, and that accept nothing."""
        own = np.arange(len(self.next))[:, None]
        return (self.next == own).all(axis=1) & (self.accept == 0)

    @property
    def resets(self) -> np.ndarray:
        """For each byte: from every state it leads to the start."""
        return (self.next == 0).all(axis=0)[self.class_of]


def determinise(nfa: Nfa, start: int, accepts: dict[int, int], everywhere: bool) -> Dfa:
    """Subset construction, then partition refinement.  everywhere: matches may start at any byte."""
    sets = [s[0] for s in nfa.step if s]
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
    class_of = np.array([kinds[sig] for sig in signature], np.uint8)
    sample = [signature.index(sig) for sig in kinds]
    first = nfa.closure([start])
    ids, rows, accept, todo = {first: 0}, [], [], [first]
    while todo:
        now, row = todo.pop(0), []
        accept.append(sum({1 << accepts[s] for s in now if s in accepts}))
        for b in sample:
            to = [nfa.step[s][1] for s in now if nfa.step[s] and b in nfa.step[s][0]]
            then = nfa.closure([*to, start] if everywhere else to)
            if then not in ids:
                ids[then] = len(ids)
                todo.append(then)
            row.append(ids[then])
        rows.append(row)
    table, accept = np.array(rows, np.int64), np.array(accept, np.int64)
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.unique(block, return_index=True)[1]
    name = np.empty(len(order), np.int64)
    ranked = sorted(range(len(order)), key=lambda b: order[b])
    name[ranked] = np.arange(len(order))
    keep = order[ranked]
    return Dfa(class_of, name[block[table[keep]]].astype(np.int32), accept[keep])


def anchored(pattern: str, ignore_case: bool = False) -> Dfa:
    nfa = Nfa()
    start = nfa.new()
    end = nfa.add(_Parser(pattern, ignore_case).parse(), start)
    return determinise(nfa, start, {end: 0}, False)


def parse(pattern: str, ignore_case: bool = False):
    return _Parser(pattern, ignore_case).parse()
