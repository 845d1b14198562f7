"""Token counts per section from one encoding of the whole document.

A document is encoded once.  The byte lengths of its tokens give every
token's character span, and the spans are joined to the section intervals by
binary search (both sides are ordered, so the join is linear).  A token that
crosses a section boundary is allocated by an explicit rule:

* ``most``  - the section that holds most of its characters, the earlier one
  on a tie (the production rule);
* ``first`` / ``last`` - the section of its first / last character;
* ``split`` - its weight is divided by characters (counts become fractions).

Sections are the lines of each field; a line owns its line end.  Fields are
encoded together, joined by one line end that belongs to the earlier field."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from healthwatch.llm.common import map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[int, tuple] = {}


def load_ranks(path: str = VOCABULARY) -> bytes:
    """The rank file's bytes (about 1 MB; read on the driver and sent along)."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """(encode function, byte length of each token id), once per worker."""
    key = hash(ranks)
    if key not in _ENCODERS:
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        width = np.zeros(max(table.values()) + 1, np.int64)
        for piece, rank in table.items():
            width[rank] = len(piece)
        words, run = regex.compile(PATTERN), re.compile(r"\s{1000}")

        def encode(text: str) -> np.ndarray:
            if len(text) >= 1000 and run.search(text):  # too long for the library's matcher
                ids = [i for m in words.finditer(text) for i in enc._encode_single_piece(m.group().encode())]
            else:
                ids = enc.encode_ordinary(text)
            return np.array(ids, np.int64)

        _ENCODERS[key] = encode, width
    return _ENCODERS[key]


def token_spans(data: bytes, ids: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character (exclusive) that each token touches;
    the pieces of a character split over tokens all touch it."""
    ends = np.cumsum(width[ids])
    starts = ends - width[ids]
    lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return lead[starts] - 1, lead[ends - 1]


def allocate(first: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int]:
    """Tokens per section and how many tokens cross a boundary.  ``bounds``
    has the sections' first characters followed by the text's length."""
    sections = len(bounds) - 1
    a = np.searchsorted(bounds, first, side="right") - 1
    b = np.searchsorted(bounds, end - 1, side="right") - 1
    # empty sections share a bound with the next one; searchsorted picks the last
    cross = np.flatnonzero(a != b)
    if rule == "first":
        owner = a
    elif rule == "last":
        owner = b
    elif rule in ("most", "split"):
        owner = a.copy()
        shares = np.zeros(sections)
        for i in cross:
            own = np.minimum(bounds[a[i] + 1:b[i] + 2], end[i]) - np.maximum(bounds[a[i]:b[i] + 1], first[i])
            owner[i] = a[i] + int(np.argmax(own))
            if rule == "split":
                shares[a[i]:b[i] + 1] += own / own.sum()
        if rule == "split":
            whole = np.delete(owner, cross)
            return np.bincount(whole, minlength=sections) + shares, len(cross)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return np.bincount(owner, minlength=sections).astype(float), len(cross)


def line_bounds(fields: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, section bounds in characters and each section's field
    number.  An empty field has one empty section."""
    text = "\n".join(fields)
    bounds, owner, at = [], [], 0
    for n, field in enumerate(fields):
        lines = field.split("\n")
        for k, line in enumerate(lines):
            if k == len(lines) - 1 and line == "" and k > 0:
                continue  # the text after a final line end is no section
            bounds.append(at)
            owner.append(n)
            at += len(line) + 1
        at = sum(len(f) + 1 for f in fields[:n + 1])
    return text, np.array([*bounds, len(text)], np.int64), np.array(owner, np.int64)


def count_sections(fields: list[str], encode, width, rule: str):
    text, bounds, owner = line_bounds(fields)
    bounds = np.minimum(bounds, len(text))
    if not text:
        return 0, 0, np.zeros(len(owner)), owner
    ids = encode(text)
    data = text.encode()
    first, end = token_spans(data, ids, width)
    counts, crossing = allocate(first, end, bounds, rule)
    return len(ids), crossing, counts, owner


def _batches(ranks, fields: int, rule: str):
    def run(batches):
        encode, width = encoder(ranks.value)
        for b in batches:
            cols = [b.column(f"f{i}").to_pylist() for i in range(fields)]
            out = []
            for row in zip(*cols):
                n, crossing, counts, owner = count_sections([x or "" for x in row], encode, width, rule)
                out.append((n, crossing, counts, np.bincount(owner, counts, minlength=fields)))
            kept = [b.column("doc_id")]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array([o[0] for o in out], pa.int64()), pa.array([len(o[2]) for o in out], pa.int64()),
                        pa.array([o[1] for o in out], pa.int64()),
                        pa.array([o[3] for o in out], pa.list_(pa.float64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                names=["doc_id", "n_tokens", "n_sections", "n_crossing", "field_tokens", "section_tokens"])
    return run


def token_counts(docs: DataFrame, fields: tuple[str, ...] = ("text",), rule: str = "most", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_sections, n_crossing,
    field_tokens and section_tokens (tokens per field and per line).

    Defined cases: a null field is empty; an empty document has no tokens and
    one empty section per field; texts of any length are encoded whole;
    repeated rows give equal rows; a null doc_id stays null; columns other
    than ``fields`` are ignored; an empty table gives an empty result."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return map_arrow(rows, _batches(ranks, len(fields), rule), "doc_id bigint, n_tokens bigint, n_sections bigint, "
                     "n_crossing bigint, field_tokens array<double>, section_tokens array<double>")
