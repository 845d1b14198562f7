"""SentencePiece encoding and decoding by a max-plus scan.

The best segmentation maximises the sum of the vocabulary's piece scores; on
a tie the path whose last piece is longer wins, at every position.  Scores of
the vocabulary are whole numbers, so sums are exact and max-plus products
associative.

* Documents up to :data:`GIANT` characters are one chunk with the trivial
  boundary state and are encoded in place, without a shuffle.
* A longer document is split into chunks of :data:`CHUNK` characters.  Each
  chunk yields a transfer matrix: entry (a, b) is the best score from a
  characters into the chunk (left by a piece that crossed its beginning) to b
  characters past its end.  Matrices are combined associatively, first within
  blocks of chunks, then over blocks, to the exact forward scores at every
  chunk's beginning.  With those each chunk is backtraced on its own for all
  exit states; the resulting small state maps are composed from the end of
  the document, which fixes every chunk's exit state, and each chunk emits the
  pieces that begin in it.  The result is that of one sequential pass.

Decoding maps ids to bytes and drops the leading blank; characters outside
the vocabulary, and word marks that are part of the text, are spelled in byte
pieces, so every text round-trips exactly."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from healthwatch.llm.common import DOCUMENT_COLUMNS, RID, map_arrow, ship_package, with_row_id, write_table
from healthwatch.llm.pieces import MODEL, Lattice, Vocabulary, best_paths, cut_units, escape, unit_groups

GIANT = 65_536
CHUNK = 2_048
BLOCK = 64
#: Chunks whose recursions step together.
LANES = 64
#: Characters encoded together.
BATCH_CHARS = 1_500_000


@lru_cache(maxsize=2)
def _lattice(key: int, holder) -> Lattice:
    return Lattice(holder.value)


def lattice_of(broadcast) -> Lattice:
    """The lattice of a broadcast vocabulary, built once per worker."""
    return _lattice(0, broadcast)


# ------------------------------------------------------------ whole documents

def _ragged(offsets: np.ndarray, flat: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Concatenate flat[offsets[p]:offsets[p+1]] for every pick."""
    counts = (offsets[1:] - offsets[:-1])[picks]
    ends = np.cumsum(counts)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(offsets[:-1][picks], counts)
    return flat[at]


def _walk(back: np.ndarray, ids: list[np.ndarray]):
    """(owner, piece) of each step of the best paths, in order per unit;
    piece -1 stands for a spelled character, whose column is also given."""
    count, width = back.shape[0], back.shape[1] - 1
    at = np.full(count, width, np.int64)
    units = np.arange(count)
    owner, piece, column = [], [], []
    while len(units):
        length = back[units, at[units]].astype(np.int64)
        start = at[units] - length
        found = np.full(len(units), -1, np.int32)
        for n in np.unique(length):
            mine = length == n
            found[mine] = ids[n - 1][units[mine], start[mine]]
        owner.append(units)
        piece.append(found)
        column.append(start)
        at[units] = start
        units = units[start > 0]
    owner, piece, column = (np.concatenate(x) for x in (owner, piece, column))
    order = np.lexsort((column, owner))
    return owner[order], piece[order], column[order]


def _spell(lattice: Lattice, owner, piece, codes, units: int):
    """Replace spelled characters by their byte pieces; (offsets, flat)."""
    spelled = np.flatnonzero(piece < 0)
    counts = np.ones(len(piece), np.int64)
    kinds = {c: lattice.byte_ids(c) for c in np.unique(codes[spelled]).tolist()}
    counts[spelled] = [len(kinds[c]) for c in codes[spelled].tolist()]
    flat = np.repeat(piece, counts)
    begin = np.cumsum(counts) - counts
    for c, spelling in kinds.items():
        rows = begin[spelled[codes[spelled] == c]]
        for k, b in enumerate(spelling):
            flat[rows + k] = b
    per = np.bincount(owner, counts, minlength=units).astype(np.int64)
    return np.concatenate([[0], np.cumsum(per)]), flat


def encode_texts(lattice: Lattice, texts: list[str]) -> list[np.ndarray]:
    """Piece ids of every text (an empty text has none)."""
    arrays = [escape(t) if t else np.zeros(0, np.int64) for t in texts]
    sizes = np.array([len(a) for a in arrays])
    codes = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    if not len(codes):
        return [np.zeros(0, np.int32) for _ in texts]
    letters = lattice.number[codes]
    begins = np.cumsum(sizes) - sizes
    starts = cut_units(codes, letters, begins[sizes > 0])
    stops = np.append(starts[1:], len(codes))
    pick = np.zeros(len(starts), np.int64)
    all_counts, all_flat, base = [], [], 0
    for n, members, rows, where, inverse in unit_groups(letters, starts, stops):
        row_codes = codes[where[:, None] + np.arange(n)]
        if n == 1 and (rows == 0).any():  # spelled characters differ by code, not by letter
            row_codes = codes[starts[members]][:, None]
            rows = letters[starts[members]][:, None]
            kinds, first, inverse = np.unique(row_codes.ravel(), return_index=True, return_inverse=True)
            rows, row_codes = rows[first], row_codes[first]
        _, back, ids = best_paths(lattice, rows, row_codes)
        owner, piece, column = _walk(back, ids)
        offsets, flat = _spell(lattice, owner, piece, row_codes[owner, column], len(rows))
        pick[members] = base + inverse
        all_counts.append(np.diff(offsets))
        all_flat.append(flat)
        base += len(rows)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(all_counts))])
    flat = _ragged(offsets, np.concatenate(all_flat), pick)
    per_unit = np.diff(offsets)[pick]
    doc_of = np.searchsorted(begins[sizes > 0], starts, side="right") - 1
    per_doc = np.zeros(len(texts), np.int64)
    per_doc[sizes > 0] = np.bincount(doc_of, per_unit, minlength=int((sizes > 0).sum()))
    return np.split(flat, np.cumsum(per_doc)[:-1])


# ------------------------------------------------------- chunks of giant ones

def padded(codes: list[np.ndarray], width: int) -> np.ndarray:
    """Chunks as rows of one array, filled up with characters outside the
    vocabulary (no piece begins there: the recursion stops before)."""
    out = np.zeros((len(codes), width), np.int64)
    for row, c in zip(out, codes):
        row[:len(c)] = c
    return out


def transfer(lattice: Lattice, codes: list[np.ndarray], sizes: list[int], entry: np.ndarray | None = None):
    """Forward recursion of several chunks at once, from the entry states
    0..longest-1; pieces begin in a chunk's first ``sizes[k]`` characters and
    may end past them (``codes`` has the look-ahead).

    Without ``entry``: transfer matrices (chunks x states x states).  With
    the forward scores of the entry states (chunks x states): back lengths
    per position, 0 where the entry state itself is best.  Of equal scores
    the piece that begins first wins."""
    states, count = lattice.longest, len(codes)
    size = np.array(sizes)
    width = int(size.max()) + states
    rows = padded(codes, width)
    letters = lattice.number[rows]
    scores = lattice.edge_scores(letters, lattice.edges(letters), rows)
    table_of = np.full((width, states, count), -np.inf)
    for n, s in enumerate(scores):
        table_of[:, n] = s.T
    for k in range(count):
        table_of[size[k]:, :, k] = -np.inf          # no piece begins past the chunk
        ends = np.add.outer(np.arange(width), np.arange(1, states + 1))
        table_of[:, :, k][ends > len(codes[k])] = -np.inf
    lanes = states if entry is None else 1
    table = np.full((width + states + 1, count, lanes), -np.inf)
    if entry is None:
        table[np.arange(states), :, np.arange(states)] = 0
        back = None
    else:
        table[:states, :, 0] = entry.T
        back = np.zeros((width + states + 1, count), np.uint8)
    lengths = np.arange(1, states + 1, dtype=np.uint8)[:, None]
    for p in range(int(size.max())):
        new = table_of[p][:, :, None] + table[p][None]
        window = table[p + 1:p + 1 + states]
        better = new > window
        np.copyto(window, new, where=better)
        if back is not None:
            np.copyto(back[p + 1:p + 1 + states], lengths, where=better[:, :, 0])
    if back is not None:
        return [back[:size[k] + states, k].copy() for k in range(count)]
    return [table[size[k]:size[k] + states, k].T.copy() for k in range(count)]


def compose(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product of transfer matrices."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def entry_map(back: np.ndarray, size: int, states: int) -> np.ndarray:
    """For every exit state the entry state its backtrace reaches (0 for
    exit states that no path reaches; they are never asked for)."""
    origin: list[int] = []
    for p, n in enumerate(back.tolist()):
        origin.append(origin[p - n] if n else p)
    return np.array([o if o < states else 0 for o in origin[size:size + states]], np.uint8)


def emit(lattice: Lattice, codes: np.ndarray, size: int, back: np.ndarray, leave: int) -> np.ndarray:
    """Ids of the pieces that begin in a chunk left in state ``leave``."""
    ids = lattice.edges(lattice.number[codes][None, :])
    out, p, steps = [], size + leave, back.tolist()
    while steps[p]:
        n = steps[p]
        p -= n
        piece = int(ids[n - 1][0, p])
        out.append([piece] if piece >= 0 else lattice.byte_ids(int(codes[p])))
    return np.array([x for part in reversed(out) for x in part], np.int32)


_CHUNK = f"{RID[0]} bigint, {RID[1]} bigint, chunk int, chunks int, size int, codes binary"


def _split_batches(longest: int, chunk: int):
    def run(batches):
        for b in batches:
            for f, r, text in zip(*(b.column(c).to_pylist() for c in (*RID, "text"))):
                codes = escape(text)
                count = -(-len(codes) // chunk)
                for first in range(0, count, 64):
                    rows = [(f, r, k, count, min(chunk, len(codes) - k * chunk),
                             codes[k * chunk:(k + 1) * chunk + longest].astype("<i4").tobytes()) for k in range(first, min(first + 64, count))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                        names=[c.split()[0] for c in _CHUNK.split(", ")])
    return run


def _codes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i4").astype(np.int64)


def _matrix_batches(vocabulary):
    def run(batches):
        lattice = lattice_of(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, LANES):
                part = b.slice(i, LANES)
                made = transfer(lattice, [_codes(c) for c in part.column("codes").to_pylist()], part.column("size").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*RID, "chunk")), pa.array([m.astype("<f8").tobytes() for m in made], pa.binary())],
                                                 names=[*RID, "chunk", "matrix"])
    return run


def _matrices(table: pa.Table, column: str, order: str, states: int):
    rows = sorted(zip(table[order].to_pylist(), table[column].to_pylist()))
    return [k for k, _ in rows], [np.frombuffer(m, "<f8").reshape(states, states) for _, m in rows]


def _keyed(table: pa.Table, **columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({**{c: pa.array([table[c][0].as_py()] * n, pa.int64()) for c in RID}, **columns})


def _block_product(states: int):
    def run(table: pa.Table) -> pa.Table:
        _, ms = _matrices(table, "matrix", "chunk", states)
        product = ms[0]
        for m in ms[1:]:
            product = compose(product, m)
        return _keyed(table, block=pa.array([table["block"][0].as_py()], pa.int32()), matrix=pa.array([product.tobytes()], pa.binary()))
    return run


def _start_vector(states: int) -> np.ndarray:
    v = np.full(states, -np.inf)
    v[0] = 0
    return v


def _block_entries(states: int):
    def run(table: pa.Table) -> pa.Table:
        blocks, ms = _matrices(table, "matrix", "block", states)
        vectors, v = [], _start_vector(states)
        for m in ms:
            vectors.append(v.tobytes())
            v = (v[:, None] + m).max(axis=0)
        return _keyed(table, block=pa.array(blocks, pa.int32()), entry=pa.array(vectors, pa.binary()))
    return run


def _chunk_entries(states: int):
    def run(chunks: pa.Table, entries: pa.Table) -> pa.Table:
        order, ms = _matrices(chunks, "matrix", "chunk", states)
        vectors, v = [], np.frombuffer(entries["entry"][0].as_py(), "<f8")
        for m in ms:
            vectors.append(v.tobytes())
            v = (v[:, None] + m).max(axis=0)
        return _keyed(chunks, chunk=pa.array(order, pa.int32()), entry=pa.array(vectors, pa.binary()))
    return run


def _back_batches(vocabulary):
    def run(batches):
        lattice = lattice_of(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, LANES):
                part = b.slice(i, LANES)
                sizes = part.column("size").to_pylist()
                entry = np.stack([np.frombuffer(e, "<f8") for e in part.column("entry").to_pylist()])
                backs = transfer(lattice, [_codes(c) for c in part.column("codes").to_pylist()], sizes, entry)
                maps = [entry_map(k, s, lattice.longest).tobytes() for k, s in zip(backs, sizes)]
                cols = [part.column(c) for c in (*RID, "chunk", "chunks", "size", "codes")] + [
                    pa.array([k.tobytes() for k in backs], pa.binary()), pa.array(maps, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*RID, "chunk", "chunks", "size", "codes", "back", "map"])
    return run


def _exits(table: pa.Table) -> pa.Table:
    """Exit state of every chunk of one document, from its end."""
    rows = sorted(zip(table["chunk"].to_pylist(), table["map"].to_pylist()), reverse=True)
    state, order, exits = 0, [], []
    for chunk, states in rows:
        order.append(chunk)
        exits.append(state)
        state = states[state]
    return _keyed(table, chunk=pa.array(order, pa.int32()), leave=pa.array(exits, pa.int32()))


def _emit_batches(vocabulary):
    def run(batches):
        lattice = lattice_of(vocabulary)
        for b in batches:
            made = [emit(lattice, _codes(c.as_py()), s.as_py(), np.frombuffer(k.as_py(), np.uint8), x.as_py())
                    for c, s, k, x in zip(b.column("codes"), b.column("size"), b.column("back"), b.column("leave"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*RID, "chunk")), pa.array(made, pa.list_(pa.int32()))], names=[*RID, "chunk", "ids"])
    return run


def encode_giants(giants: DataFrame, vocabulary, states: int, chunk: int = CHUNK) -> DataFrame:
    """Row id and ids of giant documents (row id, text), chunk by chunk."""
    ship_package(giants.sparkSession)
    spread = (*RID, "chunk")
    chunks = write_table(map_arrow(giants, _split_batches(states, chunk), _CHUNK), "spm-chunks")
    key, block = f"{RID[0]} bigint, {RID[1]} bigint", F.floor(F.col("chunk") / F.lit(BLOCK)).cast("int").alias("block")
    matrices = map_arrow(chunks.repartition(*spread), _matrix_batches(vocabulary), f"{key}, chunk int, matrix binary")
    matrices = write_table(matrices.select("*", block), "spm-matrices")
    products = matrices.groupBy(*RID, "block").applyInArrow(_block_product(states), f"{key}, block int, matrix binary")
    blocks = products.groupBy(*RID).applyInArrow(_block_entries(states), f"{key}, block int, entry binary")
    entries = (matrices.groupBy(*RID, "block").cogroup(blocks.groupBy(*RID, "block"))
               .applyInArrow(_chunk_entries(states), f"{key}, chunk int, entry binary"))
    traced = map_arrow(chunks.join(entries, [*spread]), _back_batches(vocabulary), _CHUNK + ", back binary, map binary")
    traced = write_table(traced, "spm-traces")
    exits = traced.select(*RID, "chunk", "map").groupBy(*RID).applyInArrow(_exits, f"{key}, chunk int, leave int")
    parts = map_arrow(traced.join(exits, [*spread]), _emit_batches(vocabulary), f"{key}, chunk int, ids array<int>")
    return (parts.groupBy(*RID).agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
            .select(*RID, F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")))


# ----------------------------------------------------------------- operators

def _slices(texts: list[str]):
    """Runs of texts of about BATCH_CHARS characters."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > BATCH_CHARS:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def _encode_batches(vocabulary):
    def run(batches):
        lattice = lattice_of(vocabulary)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in _slices(texts):
                ids = encode_texts(lattice, texts[i:j])
                sizes = np.array([len(x) for x in ids])
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                                pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in b.schema.names), flat], names=[*b.schema.names, "ids"])
    return run


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``keep`` columns, ``text`` (null as empty) and ``ids`` (array of piece
    ids) of every document.

    Defined cases: null and empty texts have no pieces; texts of any length
    are encoded whole; repeated rows (mixing takes some documents twice) stay
    apart; columns besides ``keep`` and ``text`` are ignored; an empty table
    gives an empty result."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model))
    states = Lattice(vocabulary.value).longest
    names = [c for c in keep if c != "text"]
    rows = with_row_id(docs, [*names, "text"]).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    long = F.char_length("text") > giant
    small = rows.filter(~long)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    short = map_arrow(small, _encode_batches(vocabulary), f"{schema}, ids array<int>")
    giants = write_table(rows.filter(long), "spm-giants")
    if giants.isEmpty():
        return short.select(*names, "text", "ids")
    ids = write_table(encode_giants(giants.select(*RID, "text"), vocabulary, states, chunk), "spm-ids")
    return short.unionByName(giants.join(ids, RID)).select(*names, "text", "ids")


def piece_bytes(vocabulary: Vocabulary) -> list[bytes]:
    """Bytes of every id (control ids decode to nothing)."""
    out = [p.replace(chr(0x2581), " ").encode() if s > float("-inf") else b"" for p, s in zip(vocabulary.pieces, vocabulary.scores)]
    for b, i in enumerate(vocabulary.byte_ids):
        out[i] = bytes([b])
    return out


def decode_ids(table: list[bytes], ids) -> str:
    return b"".join([table[i] for i in ids])[1:].decode("utf-8", "replace")


def _decode_batches(vocabulary):
    def run(batches):
        table = piece_bytes(vocabulary.value)
        for b in batches:
            texts = [decode_ids(table, x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])
    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns plus ``decoded``, the text of ``ids`` (null ids: empty)."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return map_arrow(encoded, _decode_batches(vocabulary), ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + ", decoded string")


def _digest_batches(vocabulary):
    def run(batches):
        table = piece_bytes(vocabulary.value)
        for b in batches:
            rows = []
            ids = b.column("ids")
            flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            for k, text in enumerate(b.column("text").to_pylist()):
                mine = flat[offsets[k]:offsets[k + 1]]
                back = decode_ids(table, mine.tolist())
                rows.append((len(text), len(mine), hashlib.sha256(mine.astype("<i4").tobytes()).hexdigest(),
                             hashlib.sha256(back.encode()).hexdigest(), back == text))
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
    return run


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_tokens, SHA-256 of the ids (little-endian int32)
    and of the decoded text, and whether decoding gave the text back."""
    encoded = encode(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text") if docs.schema["doc_id"].dataType.simpleString() != "bigint" else docs, ("doc_id",), model)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return map_arrow(encoded, _digest_batches(vocabulary), "doc_id bigint, n_chars bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): every document with its piece ids."""
    encoded = encode(docs, tuple(c for c in DOCUMENT_COLUMNS if c != "text"))
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("bigint").alias("n_tokens"), F.col("ids").alias("token_ids"))
