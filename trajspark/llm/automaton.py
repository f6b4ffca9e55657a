"""Rule regexes to one deterministic automaton: positions, subset construction, product, minimisation, arrays.

A rule is searched like `re.finditer` would: leftmost matches, longest for their start, none overlapping another of
its own rule. Rules don't hinder each other. Texts are scanned as UTF-8 bytes, each byte once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K, _parser  # the standard library's own regex parser

import numpy as np

END = 0xFF  # never a byte of UTF-8: ends every match


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (of ASCII characters) whose group `group` has at least `least` characters."""
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


class Positions:
    """The position automaton of a regex: each character class of it is a state."""

    def __init__(self, pattern: str):
        self.sets: list[frozenset[int]] = []
        self.next: list[set[int]] = []
        first, last, empty = self._walk(_parser.parse(pattern, re.ASCII))
        if empty:
            raise ValueError(f"{pattern!r} matches the empty text")
        self.first, self.last = frozenset(first), frozenset(last)

    def _leaf(self, chars: frozenset[int]):
        self.sets.append(chars)
        self.next.append(set())
        at = {len(self.sets) - 1}
        return at, set(at), False

    def _chain(self, parts):
        first, last, empty = set(), set(), True
        for f, l, e in parts:
            for x in last:
                self.next[x] |= f
            first |= f if empty else set()
            last = last | l if e else set(l)
            empty = empty and e
        return first, last, empty

    def _walk(self, tree):
        return self._chain(self._node(op, arg) for op, arg in tree)

    def _chars(self, items) -> frozenset[int]:
        out: set[int] = set()
        items = list(items)
        negate = items and items[0][0] is K.NEGATE
        for op, arg in items[1:] if negate else items:
            if op is K.LITERAL:
                out.add(arg)
            elif op is K.RANGE:
                out.update(range(arg[0], arg[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {op}")
        if negate:
            out = set(range(128)) - out
        if max(out) > 127:
            raise ValueError("rules are of ASCII characters")
        return frozenset(out)

    def _node(self, op, arg):
        if op is K.LITERAL:
            return self._leaf(self._chars([(op, arg)]))
        if op is K.IN:
            return self._leaf(self._chars(arg))
        if op is K.SUBPATTERN:
            return self._walk(arg[3])
        if op is K.BRANCH:
            parts = [self._walk(x) for x in arg[1]]
            return (set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts))
        if op is K.MAX_REPEAT:
            low, high, tree = arg
            parts = [self._walk(tree) for _ in range(low if high is K.MAXREPEAT else high)] or [self._walk(tree)]
            if high is K.MAXREPEAT:
                f, l, _ = parts[-1]
                for x in l:
                    self.next[x] |= f
            return self._chain((f, l, e or i >= low) for i, (f, l, e) in enumerate(parts))
        raise ValueError(f"not supported in a rule: {op}")


class Search:
    """Leftmost search for one rule. A state: (matched, sets of positions by start, the oldest first)."""
    start = (False, ())

    def __init__(self, rule: Rule):
        self.rule, self.p = rule, Positions(rule.pattern)

    def step(self, state, byte: int):
        """(state after the byte, whether a match ended before it)."""
        matched, threads = state
        new, hit = self._on(threads if matched else (*threads, None), byte)
        if matched and not hit:
            if new:
                raise ValueError(f"{self.rule.pattern!r}: a match must end where it can't go on")
            new, hit = self._on((None,), byte)
            return (hit, new), True
        return (hit, new), False

    def _on(self, threads, byte):
        p, out, seen, hit = self.p, [], set(), False
        for thread in threads:
            follow = p.first if thread is None else set().union(*(p.next[x] for x in thread))
            now = frozenset(x for x in follow if byte in p.sets[x]) - seen
            if now:
                out.append(now)
                seen |= now
                if now & p.last:  # younger starts lose
                    hit = True
                    break
        return tuple(out), hit

    def begin(self, data: bytes, end: int, floor: int) -> int:
        """Leftmost start, not before `floor`, of a match that ends at `end`: the automaton run backwards."""
        p, live, found = self.p, self.p.last, end
        back = [{x for x in range(len(p.sets)) if y in p.next[x]} for y in range(len(p.sets))]
        for at in range(end - 1, floor - 1, -1):
            live = {x for x in live if data[at] in p.sets[x]}
            if not live:
                break
            if live & p.first:
                found = at
            live = set().union(*(back[x] for x in live))
        return found


class Automaton:
    """All rules in one. `table[state + class]` is the next state, or below 0: an entry of `events`."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.searches = list(rules), [Search(r) for r in rules]
        # The last group of a rule ends its match, and the text before it is fixed by what follows.
        self.groups = [re.compile(r.pattern.encode()) if r.group else None for r in rules]
        members = [frozenset(i for i, (s, x) in enumerate(
            (s, x) for s in self.searches for x in s.p.sets) if b in x) for b in range(256)]
        kinds = {m: i for i, m in enumerate(dict.fromkeys(members))}
        classes = np.array([kinds[m] for m in members])
        width = len(kinds)
        byte = [members.index(m) for m in kinds]
        start = tuple(s.start for s in self.searches)
        ids, todo, nexts, ends = {start: 0}, [start], [], []
        while todo:  # subset construction of the product
            state = todo.pop(0)
            row, out = [], []
            for b in byte:
                steps = [s.step(x, b) for s, x in zip(self.searches, state)]
                to = tuple(x for x, _ in steps)
                if to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append(ids[to])
                out.append(tuple(i for i, (_, e) in enumerate(steps) if e))
            nexts.append(row)
            ends.append(out)
        outs = {o: i for i, o in enumerate(dict.fromkeys(x for r in ends for x in r))}
        nexts, out = np.array(nexts), np.array([[outs[x] for x in r] for r in ends])
        block = np.zeros(len(ids), np.int64)
        while True:  # minimisation: split blocks until outputs and next blocks agree
            _, new = np.unique(np.hstack([block[:, None], out, block[nexts]]), axis=0, return_inverse=True)
            new = new.ravel()
            if new.max() == block.max():
                break
            block = new
        _, one = np.unique(block, return_index=True)
        self.states, self.width = len(one), width
        names = list(outs)
        self.start, self.events, table = int(block[0]) * width, [], []
        for s in one:
            for c in range(width):
                to = int(block[nexts[s, c]]) * width
                if names[out[s, c]]:
                    self.events.append((names[out[s, c]], to))
                    to = -len(self.events)
                table.append(to)
        self.table = table
        self.classes = bytes(classes.astype(np.uint8))

    def ends(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(rule, end) of all matches."""
        table, events, state = self.table, self.events, self.start
        for at, c in enumerate((data + bytes([END])).translate(self.classes)):
            state = table[state + c]
            if state < 0:
                found, state = events[-state - 1]
                for rule in found:
                    yield rule, at

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes of the matches that pass, ordered by start, then rule."""
        out, floor = [], [0] * len(self.rules)
        for rule, end in self.ends(data):
            start = self.searches[rule].begin(data, end, floor[rule])
            floor[rule] = end
            size = end - start
            if self.rules[rule].group:
                a, b = self.groups[rule].match(data, start, end).span(self.rules[rule].group)
                size = b - a
            if size >= self.rules[rule].least:
                out.append((rule, start, end))
        return sorted(out, key=lambda x: (x[1], x[0], x[2]))
