import random

import numpy as np
from cases import frame, rows_of, sample
from healthwatch.llm import pieces as P
from healthwatch.llm import spm

VOCABULARY = P.Vocabulary.load()
LATTICE = P.Lattice(VOCABULARY)
TABLE = spm.piece_bytes(VOCABULARY)
SCORES = {VOCABULARY.pieces[i]: (float(LATTICE.scores[i]), i) for i in VOCABULARY.usable()}


def brute(text):
    """Sequential Viterbi; on a tie the longest last piece."""
    if not text:
        return []
    codes = P.escape(text).tolist()
    chars = ["\0" if c == P.OTHER_MARK else chr(c) for c in codes]
    best, back = [0.0] + [-1e300] * len(chars), [None] * (len(chars) + 1)
    for j in range(1, len(chars) + 1):
        for n in range(min(j, LATTICE.longest), 0, -1):
            piece = "".join(chars[j - n:j])
            if piece in SCORES:
                score, ids = SCORES[piece][0], [SCORES[piece][1]]
            elif n == 1:
                score, ids = LATTICE.unknown, LATTICE.byte_ids(codes[j - 1])
            else:
                continue
            if best[j - n] + score > best[j]:
                best[j], back[j] = best[j - n] + score, (n, ids)
    out, j = [], len(chars)
    while j:
        out.append(back[j][1])
        j -= back[j][0]
    return [x for part in reversed(out) for x in part]


def texts(n=400):
    rnd = random.Random(5)
    bits = ["the", "▁", " ", "  ", "\n", "é", "漢字", "🙂", "word", "\t", "ation", "ing", "xyz", "A", "Ünder", "0", "123", "...", "--", "ß"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 40))) for _ in range(n)]


def test_whole_documents_match_viterbi_and_round_trip():
    made = texts()
    ids = spm.encode_texts(LATTICE, made)
    assert [list(x) for x in ids] == [brute(t) for t in made]
    assert [spm.decode_ids(TABLE, x.tolist()) for x in ids] == made


def chunked(text, size):
    codes = P.escape(text)
    n = -(-len(codes) // size)
    parts = [codes[k * size:(k + 1) * size + LATTICE.longest] for k in range(n)]
    sizes = [min(size, len(codes) - k * size) for k in range(n)]
    vectors, v = [], spm._start_vector(LATTICE.longest)
    for m in spm.transfer(LATTICE, parts, sizes):
        vectors.append(v)
        v = (v[:, None] + m).max(axis=0)
    backs = spm.transfer(LATTICE, parts, sizes, np.stack(vectors))
    state, leave = 0, [0] * n
    for k in range(n - 1, -1, -1):
        leave[k] = state
        state = int(spm.entry_map(backs[k], sizes[k], LATTICE.longest)[state])
    return [int(x) for k in range(n) for x in spm.emit(LATTICE, parts[k], sizes[k], backs[k], leave[k])]


def test_chunks_give_the_sequential_result():
    for t in texts(150):
        if t:
            assert chunked(t, 20) == chunked(t, 37) == brute(t)


def test_products_are_associative():
    t = "".join(texts(40))
    codes = P.escape(t)
    a, b, c = spm.transfer(LATTICE, [codes[k * 60:k * 60 + 60 + LATTICE.longest] for k in range(3)], [60, 60, 60])
    assert (spm.compose(spm.compose(a, b), c) == spm.compose(a, spm.compose(b, c))).all()


def test_operator(spark):
    for df in (frame(spark), sample(spark)):
        rows = rows_of(df)
        whole = {}
        for r in spm.decode(spm.encode(df)).collect():
            assert r["decoded"] == r["text"]
            whole.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
        parts = {}
        for r in spm.encode(df, giant=500, chunk=128).collect():
            parts.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
        assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in parts.items()}
        checked = spm.round_trip(df).collect()
        assert len(checked) == len(rows) and all(r["round_trip"] for r in checked)
    assert spm.round_trip(frame(spark, [])).count() == 0
