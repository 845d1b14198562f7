"""Secret scan of whole texts with one combined deterministic automaton.

All rule patterns are compiled into one minimal byte automaton
(:mod:`healthwatch.llm.automaton`).  A batch of texts is laid out as one byte
array and scanned once for every rule; only around its hits does the rule's
own automaton look for the start (mirrored) and the longest end of the match,
so matches are leftmost and do not overlap per rule.  A final check drops
matches that are too short.  The pass is narrow: no shuffle."""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from healthwatch.llm.automaton import Automaton, run_back, run_on, scan
from healthwatch.llm.common import map_arrow


@dataclass(frozen=True)
class Rule:
    """``trigger``, the shortest beginning of ``pattern`` that is a hit, goes
    into the combined automaton, so no loop of one rule multiplies its states;
    a match of ``pattern`` stays when its group ``group`` has at least
    ``least`` characters."""

    kind: str
    trigger: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed patterns of the three base kinds, then further kinds.
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]", _ASSIGN + r"([A-Za-z0-9+/_.=-]+)", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]+", 0, 24),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("cloud", r"AIza[0-9A-Za-z_-]", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
#: Bytes laid out for one scan.
SCAN_BYTES = 8_000_000


@cache
def compiled(rules: tuple[Rule, ...] = RULES):
    """The combined automaton of all triggers, and per rule the anchored
    automaton of its pattern, the mirrored one of its trigger and the final
    check (built once per Python worker)."""
    return (Automaton([r.trigger for r in rules]),
            [(Automaton([r.pattern], anchored=True), Automaton([r.trigger], anchored=True, mirror=True), re.compile(r.pattern.encode()))
             for r in rules])


def _matches(rule: Rule, parts, data: bytes, start: int, stop: int, ends: list[int]) -> list[tuple[int, int]]:
    """Leftmost, longest, non-overlapping matches of one rule in
    ``data[start:stop]`` from the rule's hit ends (sorted)."""
    on, back, check = parts
    out, cursor, i = [], start, 0
    while i < len(ends):
        first = run_back(back, data, ends[i], cursor)
        if first < 0:
            i += 1
            continue
        last = run_on(on, data, first, stop)
        found = check.fullmatch(data, first, last)
        if found and found.end(rule.group) - found.start(rule.group) >= rule.least:
            out.append((first, last))
        cursor = last
        i = bisect.bisect_right(ends, last)
    return out


def find_secrets(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) in code points for every text, by start and
    then rule."""
    auto, parts = compiled(rules)
    data = b"\n".join(texts) + b"\n"
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    at, states = scan(auto, np.frombuffer(data, np.uint8))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(at):
        return out
    doc = np.searchsorted(starts, at - 1, side="right") - 1
    masks = auto.accepts[states]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for piece in np.split(np.arange(len(at)), cuts):
        d = int(doc[piece[0]])
        lo, hi = int(starts[d]), int(starts[d]) + len(texts[d])
        spans = []
        for k, rule in enumerate(rules):
            mine = at[piece[(masks[piece] >> k) & 1 == 1]].tolist()
            if mine:
                spans += [(s - lo, k, e - lo) for s, e in _matches(rule, parts[k], data, lo, hi, mine)]
        if spans:
            bytes_ = np.frombuffer(texts[d], np.uint8)
            points = np.concatenate([[0], np.cumsum((bytes_ & 0xC0) != 0x80)])
            out[d] = sorted((int(points[s]), k, int(points[e])) for s, k, e in spans)
    return out


def _join(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def _batches(rules: tuple[Rule, ...]):
    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            found, i = [], 0
            while i < len(texts):
                j, held = i, 0
                while j < len(texts) and (j == i or held + len(texts[j]) <= SCAN_BYTES):
                    held += len(texts[j])
                    j += 1
                found += find_secrets(texts[i:j], rules)
                i = j
            base = len([r for r in rules if r.kind in BASE_KINDS])
            counts = [pa.array([sum(k == n for _, k, _ in f) for f in found], pa.int64()) for n in range(base)]
            sha = [hashlib.sha256(_join([x for x in f if x[1] < base], rules).encode()).hexdigest() for f in found]
            cols = [b.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([_join(f, rules) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[f"n_{r.kind}" for r in rules[:base]], "base_sha256", "spans"])
    return run


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256
    and spans (kind:start:end, code points, end exclusive, comma-joined).

    Defined cases: null and empty texts have no spans (the hash of the empty
    string); any text length is scanned whole; repeated rows give equal rows;
    a null doc_id stays null; other columns are ignored; an empty table gives
    an empty result."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _batches(tuple(rules)), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
