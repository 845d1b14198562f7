"""Combined byte automaton: regexes to one minimal deterministic automaton.

Patterns are read with the standard library's regex parser (byte patterns of
literals, classes, groups, alternatives and greedy repeats), joined into one
unanchored nondeterministic automaton, made deterministic by subset
construction over byte classes and minimised by partition refinement.  The
result is a flat transition array, so a whole batch of texts is scanned for
all rules in one pass, many lanes at a time."""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp

import numpy as np


class _Nfa:
    """Thompson construction: byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int) -> int:
        """Append a parsed pattern after ``start``; returns its end state."""
        for op, arg in tree:
            start = self._one(op, arg, start)
        return start

    def _one(self, op, arg, start: int) -> int:
        if op in (rc.LITERAL, rc.NOT_LITERAL, rc.IN, rc.ANY):
            end = self.state()
            self.edges[start].append((_bytes_of(op, arg), end))
            return end
        if op is rc.SUBPATTERN:
            _, on, off, inner = arg
            return self.add(_fold(inner) if on & re.IGNORECASE.value else inner, start)
        if op is rc.BRANCH:
            end = self.state()
            for option in arg[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(option, first)].append(end)
            return end
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, inner = arg
            for _ in range(least):
                start = self.add(inner, start)
            if most is rc.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.empty[start].append(loop)
                self.empty[self.add(inner, loop)].append(loop)
                self.empty[loop].append(end)
                return end
            end = self.state()
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(inner, start)
                self.empty[start].append(end)
            return end
        raise ValueError(f"pattern element {op} is not supported")


def _fold(tree):
    """Letters of a case-insensitive group in either case."""
    out = []
    for op, arg in tree:
        if op is rc.LITERAL and chr(arg).isalpha():
            out.append((rc.IN, [(rc.LITERAL, ord(chr(arg).lower())), (rc.LITERAL, ord(chr(arg).upper()))]))
        elif op is rc.BRANCH:
            out.append((op, (arg[0], [_fold(x) for x in arg[1]])))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            out.append((op, (arg[0], arg[1], _fold(arg[2]))))
        elif op is rc.SUBPATTERN:
            out.append((op, (*arg[:3], _fold(arg[3]))))
        else:
            out.append((op, arg))
    return out


def _bytes_of(op, arg) -> frozenset[int]:
    if op is rc.LITERAL:
        return frozenset([arg])
    if op is rc.NOT_LITERAL:
        return frozenset(range(256)) - {arg}
    if op is rc.ANY:
        return frozenset(range(256)) - {10}
    chosen: set[int] = set()
    negate = False
    for kind, x in arg:
        if kind is rc.NEGATE:
            negate = True
        elif kind is rc.LITERAL:
            chosen.add(x)
        elif kind is rc.RANGE:
            chosen.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"class element {kind} is not supported")
    return frozenset(set(range(256)) - chosen if negate else chosen)


def _reversed(tree):
    """The pattern of the mirrored language."""
    out = []
    for op, arg in reversed(list(tree)):
        if op is rc.BRANCH:
            out.append((op, (arg[0], [_reversed(x) for x in arg[1]])))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            out.append((op, (arg[0], arg[1], _reversed(arg[2]))))
        elif op is rc.SUBPATTERN:
            out.append((op, (*arg[:3], _reversed(_fold(arg[3]) if arg[1] & re.IGNORECASE.value else arg[3]))))
        else:
            out.append((op, arg))
    return out


class Automaton:
    """Minimal deterministic automaton of several patterns.

    ``table[state, byte]`` is the next state, ``accepts[state]`` a bit mask of
    the patterns that end there; accepting states have the highest numbers
    (from ``first_accept``).  State ``dead`` (anchored automata) never accepts
    again."""

    def __init__(self, patterns: list[str], anchored: bool = False, mirror: bool = False):
        nfa = _Nfa()
        root = nfa.state()
        ends: dict[int, int] = {}
        for bit, pattern in enumerate(patterns):
            tree = rp.parse(pattern.encode())
            first = nfa.state()
            nfa.empty[root].append(first)
            end = nfa.add(_reversed(tree) if mirror else tree, first)
            ends[end] = ends.get(end, 0) | 1 << bit
        if not anchored:
            nfa.edges[root].append((frozenset(range(256)), root))
        kind = _byte_classes(nfa)
        sample = [int(np.flatnonzero(kind == k)[0]) for k in range(kind.max() + 1)]
        start = _closure(nfa, {root})
        index, rows, todo = {start: 0}, [], [start]
        while todo:
            current = todo.pop(0)
            row = []
            for byte in sample:
                step = _closure(nfa, {t for s in current for chars, t in nfa.edges[s] if byte in chars})
                if step not in index:
                    index[step] = len(index)
                    todo.append(step)
                row.append(index[step])
            rows.append(row)
        moves = np.array(rows, np.int64)
        masks = np.array([sum_bits(ends.get(s, 0) for s in states) for states in index], np.int64)
        block = _refine(moves, masks)
        count = block.max() + 1
        member = np.array([np.flatnonzero(block == b)[0] for b in range(count)])
        order = np.argsort(masks[member] != 0, kind="stable")
        rank = np.empty(count, np.int64)
        rank[order] = np.arange(count)
        self.table = rank[block[moves[member[order]]]][:, kind].astype(np.int32)
        self.accepts = masks[member[order]]
        self.first_accept = int((self.accepts == 0).sum())
        self.start = int(rank[block[0]])
        loops = (self.table == np.arange(count)[:, None]).all(axis=1) & (self.accepts == 0)
        self.dead = int(np.flatnonzero(loops)[0]) if anchored and loops.any() else -1

    @property
    def states(self) -> int:
        return len(self.table)


def sum_bits(masks) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


def _closure(nfa: _Nfa, states: set[int]) -> frozenset[int]:
    stack, seen = list(states), set(states)
    while stack:
        for t in nfa.empty[stack.pop()]:
            if t not in seen:
                seen.add(t)
                stack.append(t)
    return frozenset(seen)


def _byte_classes(nfa: _Nfa) -> np.ndarray:
    """Bytes that every edge treats alike share a class number."""
    sets = {chars for edges in nfa.edges for chars, _ in edges}
    marks = np.array([[b in s for s in sets] for b in range(256)]).reshape(256, -1)
    return np.unique(marks, axis=0, return_inverse=True)[1].ravel()


def _refine(moves: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Coarsest partition of the states that keeps masks and moves."""
    block = np.unique(masks, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            return block
        block = finer


def scan(auto: Automaton, data: np.ndarray, lanes: int = 4096, least: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(end offsets, states) of every accepting position in ``data``, sorted.

    The bytes are cut into lanes that step together.  A lane begins in the
    start state, which is checked afterwards against the state its
    predecessor ended in; lanes that began wrongly are scanned again from the
    right state until all agree, so the result is that of one sequential
    pass."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    width = max(least, -(-n // lanes))
    cuts = np.arange(0, n, width)
    soft = np.flatnonzero((data == 32) | (data == 10))
    if len(soft):
        near = soft[np.minimum(np.searchsorted(soft, cuts), len(soft) - 1)] + 1
        cuts = np.where((near > cuts) & (near < cuts + width // 2), near, cuts)
    cuts[0] = 0
    cuts = np.unique(cuts[cuts < n])
    stops = np.append(cuts[1:], n)
    flat = (auto.table.astype(np.int32) << 8).ravel()
    entry = np.full(len(cuts), auto.start << 8, np.int32)
    final = np.zeros(len(cuts), np.int32)
    todo = np.arange(len(cuts))
    hit_at, hit_state, hit_lane = [], [], []
    while len(todo):
        if hit_at:
            lane = np.concatenate(hit_lane)
            keep = ~np.isin(lane, todo)
            hit_at, hit_state, hit_lane = [np.concatenate(hit_at)[keep]], [np.concatenate(hit_state)[keep]], [lane[keep]]
        order = todo[np.argsort(stops[todo] - cuts[todo], kind="stable")[::-1]]
        length = stops[order] - cuts[order]
        state, pos = entry[order].copy(), cuts[order].copy()
        active, first = len(order), auto.first_accept << 8
        for t in range(int(length[0])):
            while length[active - 1] <= t:
                active -= 1
            state[:active] = flat[state[:active] | data[pos[:active]]]
            pos[:active] += 1
            hit = np.flatnonzero(state[:active] >= first)
            if len(hit):
                hit_at.append(pos[hit])
                hit_state.append(state[hit] >> 8)
                hit_lane.append(order[hit])
        final[order] = state
        right = np.append(np.int32(auto.start << 8), final[:-1])
        todo = np.flatnonzero(right != entry)
        entry = right.copy()
    if not hit_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    at, state = np.concatenate(hit_at), np.concatenate(hit_state)
    order = np.argsort(at, kind="stable")
    return at[order], state[order]


def run_back(auto: Automaton, data: bytes, end: int, floor: int) -> int:
    """Smallest start >= floor from which the mirrored pattern reads up to
    ``end``; -1 when there is none."""
    state, best = auto.start, -1
    for i in range(end - 1, floor - 1, -1):
        state = auto.table[state, data[i]]
        if state == auto.dead:
            break
        if state >= auto.first_accept:
            best = i
    return best


def run_on(auto: Automaton, data: bytes, start: int, stop: int) -> int:
    """Largest end at which the pattern started at ``start`` accepts."""
    state, best = auto.start, -1
    for i in range(start, stop):
        state = auto.table[state, data[i]]
        if state == auto.dead:
            break
        if state >= auto.first_accept:
            best = i + 1
    return best
