"""Piece vocabulary and lattice recursions shared by encoding and scoring.

Texts become arrays of character numbers.  A blank is written as the word
mark and every mark begins a new unit, because no piece of the vocabulary has
a mark after its first character; a character outside the vocabulary is a
unit of its own, spelled in byte pieces.  Units of one length are processed
together: the recursions loop over positions and piece lengths and work on
all units at once."""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass

import numpy as np

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
#: Stands for a word mark that is part of the text itself.
OTHER_MARK = 0x110000
NEVER = -1e8
UNKNOWN_PENALTY = 10.0
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """What workers need: pieces by id, their scores and the byte pieces."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]

    @staticmethod
    def load(path: str = MODEL) -> "Vocabulary":
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        scores = [model.get_score(i) if ok else float("-inf") for i, ok in enumerate(plain)]
        return Vocabulary(names, scores, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def usable(self) -> list[int]:
        """Pieces of the lattice: ordinary ones without a word mark after
        their first character.  (The vocabulary's runs of marks have the score
        "never"; the single mark, scored so too, counts as its last piece.)"""
        return [i for i, s in enumerate(self.scores) if s > float("-inf") and self.pieces[i] and chr(MARK) not in self.pieces[i][1:]]


class Lattice:
    """Array trie of a vocabulary, with one score per piece id."""

    def __init__(self, vocabulary: Vocabulary, scores=None):
        self.vocabulary = vocabulary
        given = np.array(vocabulary.scores if scores is None else scores, float)
        usable = vocabulary.usable()
        low = min(vocabulary.scores[i] for i in usable if vocabulary.scores[i] > NEVER)
        if scores is None:
            given[given < NEVER] = low - 1
        self.scores = given
        self.longest = max(len(vocabulary.pieces[i]) for i in usable)
        letters = sorted({c for i in usable for c in vocabulary.pieces[i]})
        self.number = np.zeros(0x110001, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        child: dict[tuple[int, int], int] = {}
        ends, level = {}, 1
        for i in usable:
            node = 0
            for c in vocabulary.pieces[i]:
                key = (node, int(self.number[ord(c)]))
                if key not in child:
                    child[key] = level
                    level += 1
                node = child[key]
            ends[node] = i
        self.piece_at = np.full(level, -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        self._hash({a * self.letters + b: t for (a, b), t in child.items()})
        self.unknown = low - UNKNOWN_PENALTY if scores is None else None
        self.byte_scores = given[vocabulary.byte_ids]

    def rescored(self, scores: np.ndarray) -> "Lattice":
        """The same trie with other scores per piece id."""
        made = copy(self)
        made.scores, made.unknown, made.byte_scores = scores, None, scores[self.vocabulary.byte_ids]
        return made

    def _hash(self, moves: dict[int, int], bits: int = 19) -> None:
        """Open hash table of (node, letter) -> node with few probes."""
        keys = np.array(list(moves), np.int64)
        values = np.array(list(moves.values()), np.int32)
        slot = self._slot(keys, bits)
        self.keys, self.nodes, self.bits = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, -1, np.int32), bits
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            at = slot[todo] + self.probes
            _, first = np.unique(at, return_index=True)
            free = first[self.keys[at[first]] < 0]
            self.keys[at[free]], self.nodes[at[free]] = keys[todo[free]], values[todo[free]]
            left = np.ones(len(todo), bool)
            left[free] = False
            todo = todo[left]
            self.probes += 1

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Child nodes (-1: none)."""
        keys = nodes.astype(np.int64) * self.letters + letters
        at = self._slot(keys, self.bits)
        out = np.where(self.keys[at] == keys, self.nodes[at], -1)
        miss = np.flatnonzero((out < 0) & (self.keys[at] >= 0))
        for probe in range(1, self.probes):
            if not len(miss):
                break
            slot = at[miss] + probe
            out[miss] = np.where(self.keys[slot] == keys[miss], self.nodes[slot], out[miss])
            miss = miss[(out[miss] < 0) & (self.keys[slot] >= 0)]
        return out

    def edges(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each length l (1..longest) the piece id of ``rows[:, i:i+l]``
        at every start i, -1 where there is none.  Letter 0 has no pieces."""
        count, width = rows.shape
        out = []
        flat = rows.ravel()
        start = np.flatnonzero(flat > 0)
        node = np.zeros(len(start), np.int64)
        column = start % width
        for length in range(1, min(self.longest, width) + 1):
            fits = column + length <= width
            start, node, column = start[fits], node[fits], column[fits]
            node = self.step(node, flat[start + length - 1])
            alive = node >= 0
            start, node, column = start[alive], node[alive], column[alive]
            ids = np.full(count * width, -1, np.int32)
            ids[start] = self.piece_at[node]
            out.append(ids.reshape(count, width))
        return out

    def edge_scores(self, rows: np.ndarray, ids: list[np.ndarray], codes: np.ndarray) -> list[np.ndarray]:
        """Scores of the edges, -inf where none; a character that is no piece
        of its own can always be spelled in byte pieces."""
        out = []
        for n, x in enumerate(ids):
            s = np.where(x >= 0, self.scores[x], -np.inf)
            if n == 0:
                none = x < 0
                if none.any():
                    s[none] = self.unknown if self.unknown is not None else self.spelled(codes[none])
            out.append(s)
        return out

    def spelled(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the byte pieces' scores of characters."""
        kinds, where = np.unique(codes, return_inverse=True)
        return np.array([sum(self.byte_scores[b] for b in char_bytes(c)) for c in kinds.tolist()])[where]

    def byte_ids(self, code: int) -> list[int]:
        return [self.vocabulary.byte_ids[b] for b in char_bytes(code)]


def char_bytes(code: int) -> bytes:
    return chr(MARK if code == OTHER_MARK else code).encode("utf-8", "surrogatepass")


def escape(text: str) -> np.ndarray:
    """Code points of a text with its leading blank, blanks as word marks."""
    codes = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[codes == MARK] = OTHER_MARK
    codes[codes == 0x20] = MARK
    return codes


def best_paths(lattice: Lattice, rows: np.ndarray, codes: np.ndarray):
    """Max-plus recursion over units of one length: (scores, back) where
    ``back[u, j]`` is the length of the last piece of the best path to j; on
    a tie the longest piece."""
    count, width = rows.shape
    ids = lattice.edges(rows)
    scores = lattice.edge_scores(rows, ids, codes)
    best = np.full((width + 1, count), -np.inf)
    best[0] = 0
    back = np.zeros((width + 1, count), np.uint8)
    scores = [np.ascontiguousarray(s.T) for s in scores]
    for j in range(1, width + 1):
        top, take = best[j], back[j]
        for length in range(min(j, len(scores)), 0, -1):
            new = best[j - length] + scores[length - 1][j - length]
            better = new > top
            np.copyto(top, new, where=better)
            take[better] = length
    return best[width], back.T, ids


def cut_units(codes: np.ndarray, letters: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the units: at every mark, at and after every character
    outside the vocabulary, at every document."""
    cut = (codes == MARK) | (letters == 0)
    cut[1:] |= letters[:-1] == 0
    cut[doc_starts] = True
    return np.flatnonzero(cut)


def unit_groups(letters: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """Units by length: (length, unit numbers, their distinct rows' starts,
    inverse).  Distinct rows are found by a 64-bit hash and compared whole."""
    width = stops - starts
    order = np.argsort(width, kind="stable")
    cuts = np.flatnonzero(np.diff(width[order])) + 1
    for members in np.split(order, cuts):
        if not len(members):
            continue
        n = int(width[members[0]])
        rows = letters[starts[members][:, None] + np.arange(n)]
        key = np.zeros(len(members), np.uint64)
        for k in range(n):
            key = (key ^ rows[:, k].astype(np.uint64)) * _MULT
            key ^= key >> np.uint64(29)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if not (rows == rows[first][inverse]).all():
            first, inverse = np.arange(len(members)), np.arange(len(members))
        yield n, members, rows[first], starts[members[first]], inverse
