"""Removal of long repeated word sequences by recompression.

A *window* is :data:`WINDOW` consecutive words of one document.  Every word
covered by a window whose word sequence also starts anywhere else is removed.

*Naming.*  A text is a row of symbols, at first its words.  A level renames
every maximal run ``a a .. a`` to one symbol (a, length), then draws a side for
every symbol from its name and replaces every pair (left side, right side) by
one symbol.  A name is a hash of what it stands for, so all tasks give equal
substrings equal symbols without a shared dictionary; only symbols near the
ends of a substring depend on what surrounds it.  Each symbol carries its
*context*: the words that fix it.  Wherever these words occur, the same symbol
occurs at the same place.

*Spark rounds.*  Each round counts symbols over the whole corpus.

* A window that holds the context of a symbol of :data:`LEVELS` that occurs
  once cannot be repeated and is dead; later rounds look at living windows.
* A high symbol (:data:`LONG`, up to whole documents) that occurs twice proves
  all windows inside it repeated.  Only its first occurrence still stands for
  them in the next round, so copies and long passages cost a few rows each.

Symbols seen twice inside one task are settled there, and one row stands for
them, so a passage that a third of all documents share is one row a task.

*Verification.*  The windows left are compared by two independent 64-bit
hashes of their words, as are the high symbols.  Windows without a whole
context (such as one word repeated) are never dead and are settled here, so
nothing is lost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from healthwatch.llm.common import RID, map_arrow, release, with_row_id, write_table
from healthwatch.llm.near_dup import _BLANK, _powers, mix

WINDOW = 35
#: Levels whose symbols are counted to find dead windows, one Spark round each (level 6: about 6 words).
LEVELS = (6,)
#: Levels whose symbols prove repeats when they have at least LONG_WORDS words (level 14: about 56).
LONG, LONG_WORDS = tuple(range(14, 60, 3)), 48
#: Bytes of text that are parsed together (about 16 times that in memory).
BATCH_BYTES = 6_000_000
#: Rows and bytes up to which per-document answers are broadcast.
BROADCAST_DOCS, BROADCAST_BYTES = 250_000, 24_000_000
#: A place is row position * PLACES + index inside the document.
PLACES = 1 << 27

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


# ------------------------------------------------------------------- symbols

def flat_words(texts: list[bytes], base: int = _BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts in one row, a 0 before each text
    and after the last, and the number of words per text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    solid = ~_BLANK[data]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8)]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _powers(base, len(data)), dtype=_U)])
    back = _powers(pow(base, -1, 1 << 64), len(data) + 1)
    hashes = mix((prefix[stop] - prefix[start]) * back[start] + (stop - start).astype(_U)) | _U(1)
    doc = np.searchsorted(begins, start, side="right") - 1
    out = np.zeros(len(hashes) + len(texts) + 1, _U)
    out[np.arange(len(hashes)) + doc + 1] = hashes
    return out, np.bincount(doc, minlength=len(texts))


def _runs(word, sym, start, stop, low, high, level):
    """Rename maximal runs.  That a neighbour differs is fixed by its word
    next to the run, or else by its whole context."""
    first = np.ones(len(sym), bool)
    first[1:] = (sym[1:] != sym[:-1]) | (sym[1:] == 0)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(sym)) - 1
    length = last - at + 1
    name = np.where(length > 1, mix(sym[at] * _U(_BASES[0]) + length.astype(_U) + _U(level << 40)) | _U(1), sym[at])
    lo, hi = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
    begin, end = start[at], stop[last]
    k = np.flatnonzero(name)
    left, right, own = last[k - 1], at[k + 1], at[k]
    alike_left = word[stop[left] - 1] == word[stop[own] - 1]
    alike_right = word[start[right]] == word[start[own]]
    lo_k = np.minimum(lo[k], np.where(alike_left, low[left], begin[k] - 1))
    lo[k] = np.minimum(lo_k, np.where(alike_right, low[right], lo_k))
    hi_k = np.maximum(hi[k], np.where(alike_right, high[right], end[k] + 1))
    hi[k] = np.maximum(hi_k, np.where(alike_left, high[left], hi_k))
    return name, begin, end, lo, hi


def _pairs(sym, start, stop, low, high, level):
    """Replace pairs (left side, right side).  A symbol that stays alone is
    fixed together with the neighbour it could have joined."""
    side = (mix(sym + _U((level * _BASES[1]) & _MASK)) >> _U(63)).astype(np.int8)
    side[sym == 0] = 2
    joins = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
    taken = np.zeros(len(sym), bool)
    taken[joins] = taken[joins + 1] = True
    name, end, lo, hi = sym.copy(), stop.copy(), low.copy(), high.copy()
    for which, step in ((0, 1), (1, -1)):
        k = np.flatnonzero((side == which) & ~taken)
        lo[k], hi[k] = np.minimum(low[k], low[k + step]), np.maximum(high[k], high[k + step])
    name[joins] = mix(mix(sym[joins] + _U(level << 48)) * _U(_BASES[0]) + sym[joins + 1]) | _U(1)
    end[joins] = stop[joins + 1]
    lo[joins], hi[joins] = np.minimum(low[joins], low[joins + 1]), np.maximum(high[joins], high[joins + 1])
    keep = np.ones(len(sym), bool)
    keep[joins + 1] = False
    return name[keep], start[keep], end[keep], lo[keep], hi[keep]


def symbols(word: np.ndarray, levels: tuple[int, ...], window: int = WINDOW):
    """For each of ``levels``: (level, names, first, last, start, stop).  The
    windows that hold the whole context of a symbol start at ``first`` to
    ``last`` (none if ``first`` is larger); its words are start .. stop - 1."""
    place = np.arange(len(word), dtype=np.int32)
    state = (word, place, place + 1, place, place + 1)
    for level in range(1, max(levels, default=0) + 1):
        state = _pairs(*_runs(word, *state, level), level)
        if level in levels:
            name, start, stop, low, high = (x[state[0] != 0] for x in state)
            yield level, name, high - window, low, start, stop


def _marked(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Places inside any of the ranges first..last."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, np.maximum(first, 0), 1)
    np.add.at(steps, last + 1, -1)
    return np.cumsum(steps[:-1]) > 0


class Parsed:
    """The words of some documents, the windows still alive after the rounds
    whose answers are given, and the symbols that the next round counts.

    An answer holds per document the indices of its symbols that occur
    elsewhere as a bitmap (None: none does)."""

    def __init__(self, texts: list[bytes], levels: tuple[int, ...], answers: list[list], long: tuple[int, ...], window: int,
                 long_words: int = LONG_WORDS):
        self.window = window
        self.word, self.counts = flat_words(texts)
        self.second = flat_words(texts, _BASES[1])[0]
        edge = np.flatnonzero(self.word == 0)
        self.edge = edge[:-1]
        self.edges = np.concatenate([[0], np.cumsum(self.word == 0)])
        self.alive = ~_marked(edge - window + 1, edge, len(self.word))
        self.found, done, before = [], 0, np.zeros(0, np.int64)
        for level, name, first, last, start, stop in symbols(self.word, (*levels, *long), window):
            if level in levels:
                fits = np.flatnonzero(first <= last)
                fits = fits[self.edges[first[fits] + window] == self.edges[np.maximum(last[fits], 0)]]
                name, first, last = name[fits], first[fits], last[fits]
                doc, index = self.number(last)
                if done < len(answers):
                    shared = np.zeros(len(name), bool)
                    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
                    for d, bits in enumerate(answers[done]):
                        if bits is not None:
                            own = shared[begin[d]:begin[d + 1]]
                            own[:] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)) if len(bits) * 8 >= len(own) else \
                                np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8)), np.zeros(len(own) - 8 * len(bits), np.uint8)])
                    self.alive &= ~_marked(first[~shared], last[~shared], len(self.word))
                    done += 1
                else:
                    living = np.concatenate([[0], np.cumsum(self.alive)])
                    use = living[last + 1] > living[np.maximum(first, 0)]
                    self.found.append((name[use], np.zeros(use.sum(), _U), doc[use], index[use], np.zeros(use.sum(), np.int64)))
            else:
                span = start.astype(np.int64) << 32 | stop
                use = (stop - start >= max(long_words, window)) & ~np.isin(span, before)
                before = span
                start, stop = start[use].astype(np.int64), stop[use].astype(np.int64)
                doc = np.searchsorted(self.edge, start, side="right") - 1
                self.found.append((name[use], self.checks(start, stop), doc, start - self.edge[doc] - 1, stop - start))

    def number(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document of each place and its number among the document's places."""
        doc = np.searchsorted(self.edge, place, side="right") - 1
        return doc, np.arange(len(doc)) - np.searchsorted(doc, doc)

    def checks(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A second hash of word ranges."""
        base = _BASES[0]
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.second * _powers(base, len(self.second)), dtype=_U)])
        back = _powers(pow(base, -1, 1 << 64), len(self.second) + 1)
        return mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(_U))

    def settle(self, proofs: list) -> None:
        """Take out the windows of proven symbols of which an earlier
        occurrence stands for them."""
        first, last = [], []
        for d, own in enumerate(proofs):
            for p in own or ():
                if not p["first"]:
                    first.append(self.edge[d] + 1 + p["start"])
                    last.append(first[-1] + p["words"] - self.window)
        if first:
            self.alive &= ~_marked(np.array(first), np.array(last), len(self.word))

    def windows(self):
        """Two hashes, document and first word of the windows alive."""
        at = np.flatnonzero(self.alive)
        doc = np.searchsorted(self.edge, at, side="right") - 1
        factor = mix(np.arange(1, self.window + 1).astype(_U) * _U(_BASES[1])) | _U(1)
        hashes = []
        for word in (self.word, self.second):
            total = np.zeros(len(at), _U)
            for k in range(self.window):
                total += word[at + k] * factor[k]
            hashes.append(mix(total))
        return *hashes, doc, at - self.edge[doc] - 1, np.zeros(len(at), np.int64)


def _sliced(batch: pa.RecordBatch, column: str, slice_bytes: int = BATCH_BYTES):
    """(slice, texts) of about ``slice_bytes`` each."""
    texts = [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= slice_bytes):
            held += len(texts[j])
            j += 1
        yield batch.slice(i, j - i), texts[i:j]
        i = j


_ROWS = "name bigint, name2 bigint, file bigint, place bigint, code bigint"


def _occurrences(levels: tuple[int, ...], answered: int, long: tuple[int, ...], window: int, last: bool, slice_bytes: int, long_words: int):
    """Rows (name, name2, file, place, code) of symbols or windows, ``code`` =
    4 * words + kind.  Kind 1: alone in its slice.  What occurs again in one
    slice is settled there: its first row (kind 2) counts for two, the others
    (kind 3) get a key of their own."""
    def run(batches):
        for b in batches:
            for part, texts in _sliced(b, "text", slice_bytes):
                parsed = Parsed(texts, levels, [part.column(f"answer{k}").to_pylist() for k in range(answered)], long, window, long_words)
                if last:
                    parsed.settle(part.column("proofs").to_pylist())
                name, name2, doc, index, size = parsed.windows() if last else (np.concatenate(x) for x in zip(*parsed.found))
                file, pos = (part.column(c).to_numpy()[doc] for c in RID)
                place = pos * PLACES + index
                order = np.lexsort((place, file, size, name2, name))
                name, name2, file, place, size = (x[order] for x in (name, name2, file, place, size))
                same = (name[1:] == name[:-1]) & (name2[1:] == name2[:-1]) & (size[1:] == size[:-1])
                again, before = np.concatenate([[False], same])[:len(name)], np.concatenate([same, [False]])[:len(name)]
                own = mix(place.astype(_U) + mix(file.astype(_U) + size.astype(_U)))
                kind = np.where(again, 3, np.where(before, 2, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(again, own, name).view(np.int64)), pa.array(np.where(again, mix(own), name2 + size.astype(_U)).view(np.int64)),
                     pa.array(file), pa.array(place), pa.array(4 * size + kind)], names=["name", "name2", "file", "place", "code"])
    return run


def _shared(rows: DataFrame) -> DataFrame:
    """Row id, index, words and ``first`` of what occurs twice or more.  A hot
    name has one row a task slice, so its sorted group stays small and may
    spill."""
    same = Window.partitionBy("name", "name2")
    kind = F.col("code") % 4
    counted = rows.withColumn("total", F.sum(kind).over(same)).withColumn("least", F.min(F.struct("file", "place")).over(same)).filter("total > 1")
    return counted.select(
        F.col("file").alias(RID[0]), F.floor(F.col("place") / PLACES).cast("bigint").alias(RID[1]), F.pmod("place", F.lit(PLACES)).cast("int").alias("index"),
        F.floor(F.col("code") / 4).cast("int").alias("words"), ((kind < 3) & (F.struct("file", "place") == F.col("least"))).alias("first"))


def _bitmaps(batches):
    """Lists of indices to bitmaps."""
    for b in batches:
        bits = []
        for own in b.column("places").to_pylist():
            flags = np.zeros(max(own) + 1 if own else 0, np.uint8)
            flags[own] = 1
            bits.append(np.packbits(flags).tobytes() if own else None)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in RID), pa.array(bits, pa.binary()), b.column("proofs")], names=[*RID, "answer", "proofs"])


_PROOFS = "array<struct<start:int,words:int,first:boolean>>"


def _answers(rows: DataFrame) -> DataFrame:
    """Per document ``answer`` (bitmap of its shared symbols) and ``proofs``."""
    proof = F.when(F.col("words") > 0, F.struct(F.col("index").alias("start"), "words", "first"))
    lists = _shared(rows).groupBy(*RID).agg(F.collect_list(F.when(F.col("words") == 0, F.col("index"))).alias("places"), F.collect_list(proof).alias("proofs"))
    return map_arrow(lists, _bitmaps, f"{RID[0]} bigint, {RID[1]} bigint, answer binary, proofs {_PROOFS}")


def _joined(docs: DataFrame, answers: DataFrame, size) -> DataFrame:
    """``docs`` with its answers; they are broadcast only when both their rows
    and their bytes are counted to be few."""
    rows, held = answers.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    small = rows <= BROADCAST_DOCS and held <= BROADCAST_BYTES
    return docs.join(F.broadcast(answers) if small else answers.hint("merge"), RID, "left")


def _merged(window: int):
    """Starts of repeated windows and proven symbols to ranges of words."""
    def run(batches):
        for b in batches:
            out = []
            for starts, proofs in zip(b.column("starts").to_pylist(), b.column("proofs").to_pylist()):
                ranges = sorted([(s, s + window) for s in starts or ()] + [(p["start"], p["start"] + p["words"]) for p in proofs or ()])
                spans: list[list[int]] = []
                for a, z in ranges:
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                out.append([{"start": a, "stop": z} for a, z in spans])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in RID), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                                             names=[*RID, "spans"])
    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, levels: tuple[int, ...] = LEVELS, long: tuple[int, ...] = LONG,
                   slice_bytes: int = BATCH_BYTES, long_words: int = LONG_WORDS) -> DataFrame:
    """Row id and ``spans``: the word ranges (stop exclusive) covered by
    windows that occur elsewhere; documents without any are left out."""
    spark = docs.sparkSession
    text = with_row_id(docs, ["text"]).withColumn("text", F.col("text").cast("string"))
    base, proofs = text, None
    for k in range(len(levels)):
        rows = map_arrow(base, _occurrences(levels[:k + 1], k, () if k else long, window, False, slice_bytes, long_words), _ROWS)
        found = write_table(_answers(rows), "shared-symbols")
        if proofs is None:
            proofs = found.select(*RID, "proofs").filter(F.size("proofs") > 0)
        else:
            found = found.drop("proofs")
        base = _joined(base, found.withColumnRenamed("answer", f"answer{k}"), F.coalesce(F.octet_length(f"answer{k}"), F.lit(0)) + (16 * F.size("proofs") if not k else 0))
        release(spark)
    if proofs is None:
        base = base.withColumn("proofs", F.lit(None).cast(_PROOFS))
    rows = map_arrow(base, _occurrences(tuple(levels), len(levels), (), window, True, slice_bytes, long_words), _ROWS)
    starts = _shared(rows).groupBy(*RID).agg(F.collect_list("index").alias("starts"))
    both = starts.join(proofs, RID, "full") if proofs is not None else starts.withColumn("proofs", F.lit(None).cast(_PROOFS))
    schema = f"{RID[0]} bigint, {RID[1]} bigint, spans array<struct<start:int,stop:int>>"
    spans = write_table(map_arrow(both, _merged(window), schema), "repeated-spans")
    release(spark)
    return spans


def _kept(batches):
    for b in batches:
        for part, texts in _sliced(b, "text"):
            out = []
            for text, spans in zip(texts, part.column("spans").to_pylist()):
                words = text.split()
                n = len(words)
                for span in reversed(spans or ()):
                    del words[span["start"]:span["stop"]]
                out.append((n, n - len(words), spans or [], b" ".join(words).decode()))
            n, removed, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in (*RID, "doc_id")), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.string())],
                names=[*RID, "doc_id", "n_words", "n_removed", "spans", "kept_text"])


def without_repeats(docs: DataFrame, window: int = WINDOW, levels: tuple[int, ...] = LEVELS, long: tuple[int, ...] = LONG, **sizes) -> DataFrame:
    """One row per input row: row id, doc_id, n_words, n_removed, ``spans``
    (removed word ranges, stop exclusive) and ``kept_text`` (the kept words
    joined by one space).

    Defined cases: words are cut at the six blanks and compared as they are;
    null counts as a text without words; windows are judged on the input, so
    all copies of a passage go, also overlapping ones inside one document and
    those of repeated rows; texts with fewer words than a window keep all;
    texts of any length are read whole; other columns are ignored; an empty
    table gives an empty result."""
    spans = repeated_spans(docs, window, levels, long, **sizes)
    base = with_row_id(docs, ["doc_id", "text"]).select(*RID, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = (f"{RID[0]} bigint, {RID[1]} bigint, doc_id bigint, n_words bigint, n_removed bigint, "
              "spans array<struct<start:int,stop:int>>, kept_text string")
    return map_arrow(_joined(base, spans, 16 * F.size("spans")), _kept, schema)
