"""Byte automata from regular expressions: subset construction, minimisation, transition arrays.

The patterns are byte patterns with literals, classes, groups, ``|``, ``*``, ``+``, ``?`` and ``{m,n}``.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

_ESCAPES = {"n": 10, "t": 9, "r": 13}


class _Parser:
    """Pattern -> tree of ("set", bytes), ("cat", ...), ("alt", ...), ("rep", node, least, most or None)."""

    def __init__(self, pattern: str, fold: bool) -> None:
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self) -> tuple:
        tree = self.alt()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return tree

    def alt(self) -> tuple:
        parts = [self.cat()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def cat(self) -> tuple:
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self.repeat())
        return ("cat", *parts)

    def repeat(self) -> tuple:
        node = self.atom()
        while self.i < len(self.p) and self.p[self.i] in "*+?{":
            c = self.p[self.i]
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i + 1 : end].partition(",")
                least, most = int(low), int(high) if high else None if _ else int(low)
                self.i = end
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            self.i += 1
            node = ("rep", node, least, most)
        return node

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return _ESCAPES.get(c, ord(c))

    def atom(self) -> tuple:
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
            own: set[int] = set()
            while self.p[self.i] != "]":
                low = self.byte()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    own |= set(range(low, self.byte() + 1))
                else:
                    own.add(low)
            self.i += 1
            return ("set", frozenset(range(256)) - own if negated else frozenset(own))
        own = {self.byte()}
        if self.fold:
            own = {x for b in own for x in chr(b).lower().encode("latin1") + chr(b).upper().encode("latin1")} if next(iter(own)) < 128 else own
        return ("set", frozenset(own))


def parse(pattern: str, fold: bool = False) -> tuple:
    """``fold``: letters outside classes match in either case."""
    return _Parser(pattern, fold).parse()


def reverse(tree: tuple) -> tuple:
    kind = tree[0]
    if kind == "cat":
        return ("cat", *(reverse(x) for x in reversed(tree[1:])))
    if kind == "alt":
        return ("alt", *(reverse(x) for x in tree[1:]))
    return ("rep", reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


def shortest(tree: tuple) -> tuple:
    """What tells that the tree matches somewhere: its last repeat only as often as it must be."""
    if tree[0] == "cat" and len(tree) > 1:
        return ("cat", *tree[1:-1], shortest(tree[-1]))
    return ("rep", tree[1], tree[2], tree[2]) if tree[0] == "rep" else tree


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Append the tree's states after ``start``; returns where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for x in tree[1:]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1:]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(x, own)].append(end)
            return end
        _, node, least, most = tree
        for _ in range(least):
            start = self.add(node, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(node, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(node, start)
            self.empty[start].append(end)
        return end


class Dfa:
    """``table[state, byte]`` is the next state and ``accepts[state]`` the rules whose match ends there; 0 starts."""

    def __init__(self, table: np.ndarray, accepts: list[tuple[int, ...]]) -> None:
        self.table, self.accepts = table, accepts
        rows: list[list] = [[] for _ in accepts]
        for row, to, rules in zip(rows, table.tolist(), accepts, strict=True):
            row.extend(rows[t] for t in to)
            row.append(rules)
        #: each state as a list of its 256 next states, then its rules; the scan indexes these lists
        self.rows = rows

    def ends(self, data: bytes) -> dict[int, int]:
        """rule -> the first offset where a match ends, from one pass over ``data``."""
        row, found = self.rows[0], {}
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                for rule in row[256]:
                    found.setdefault(rule, i + 1)
        return found

    def all_ends(self, data: bytes) -> list[int]:
        """Every offset where a match of any rule ends."""
        row, out = self.rows[0], []
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                out.append(i + 1)
        return out

    def longest(self, data: bytes, start: int) -> int | None:
        """The end of the longest match that begins at ``start``; for anchored automata."""
        row, end, dead = self.rows[0], None, self.dead
        if row[256]:
            end = start
        for i in range(start, len(data)):
            row = row[data[i]]
            if row[256]:
                end = i + 1
            elif row is dead:
                break
        return end

    @cached_property
    def dead(self) -> list | None:
        """The state that never leads to a match, if there is one."""
        own = np.flatnonzero((self.table == np.arange(len(self.table))[:, None]).all(axis=1))
        return next((self.rows[s] for s in own if not self.accepts[s]), None)


def compile_rules(trees: list[tuple], anchored: bool) -> Dfa:
    """One minimal automaton for all rules; unanchored ones find matches that begin anywhere."""
    nfa = _Nfa()
    root = nfa.state()
    final = {}
    for rule, tree in enumerate(trees):
        own = nfa.state()
        nfa.empty[root].append(own)
        final.setdefault(nfa.add(tree, own), set()).add(rule)

    def close(states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    # bytes that all moves treat alike form one class
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    classes = {x: k for k, x in enumerate(dict.fromkeys(signature))}
    of_byte = np.array([classes[x] for x in signature])
    some_byte = [signature.index(x) for x in classes]

    begin = close({root})
    number, order, steps = {begin: 0}, [begin], []
    for states in order:  # grows while it is walked
        own = []
        for b in some_byte:
            to = {t for s in states for chars, t in nfa.moves[s] if b in chars}
            to = close(to | ({root} if not anchored else set()))
            if to not in number:
                number[to] = len(order)
                order.append(to)
            own.append(number[to])
        steps.append(own)
    step = np.array(steps)
    accepts = [tuple(sorted(set().union(*(final.get(s, set()) for s in states)))) for states in order]

    # Moore's refinement: states stay together while they accept alike and move alike
    group = np.unique([hash(x) for x in map(str, accepts)], return_inverse=True)[1]
    while True:
        _, new = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == group.max():
            break
        group = new
    rank = {g: k for k, g in enumerate(dict.fromkeys(group.tolist()))}
    first = [int(np.flatnonzero(group == g)[0]) for g in rank]
    small = np.array([[rank[g] for g in group[step[s]].tolist()] for s in first])
    return Dfa(small[:, of_byte], [accepts[s] for s in first])
