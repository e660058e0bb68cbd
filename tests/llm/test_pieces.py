"""Pairs of pieces that may stand together against plain merging, and the bytes of ids."""

import random

import numpy as np
import pyarrow as pa

from larkspur.llm import pieces
from larkspur.llm.q_pieces import MODEL


def merged(m, text):
    parts = list(text)
    while True:
        scored = [(-m.score[m.id[x + y]], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in m.id]
        if not scored:
            return parts
        k = min(scored)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_pairs_part_as_plain_merging_does():
    m, rng = pieces.encoder(MODEL).m, random.Random(5)
    texts = rng.sample(sorted(m.id), 300)
    pairs = [(a, b) for a in texts[:60] for b in texts[60:120]] + [(p[:k], p[k:]) for p in texts for k in range(1, len(p)) if p[:k] in m.id and p[k:] in m.id]
    found = [m.parted(a, b) for a, b in pairs]
    assert found == [merged(m, a + b) == [a, b] for a, b in pairs] and 0 < sum(found) < len(found)


def test_ids_are_joined_as_bytes():
    one = pieces.encoder(MODEL)
    text = "a😀\x00é  x" * 3
    ids = one.encode([text, None, ""])
    assert all(isinstance(v, bytes) for v in one.known.values()) and [len(x) for x in ids[1:]] == [0, 0]
    assert pieces.decode(one.m, ids[0].tolist()) == text and len(one.m.raw) == len(one.m.text)


def test_prefixes_that_have_their_piece_are_not_looked_at_again(monkeypatch):
    one, looked = pieces.Encoder(pieces.encoder(MODEL).m), []
    plain = one._lookup
    monkeypatch.setattr(one, "_lookup", lambda h: looked.append(len(h)) or plain(h))
    rng = random.Random(11)
    texts = ["".join(rng.choice(["th", "in", "er", "an", "on", "he"]) for _ in range(rng.randint(2, 8))) for _ in range(500)]
    one.encode(texts)
    chunks = [k for k in one.known]
    assert sum(looked) < sum(n * (n + 1) // 2 for n in map(len, chunks)) / 2  # every pair of places in each chunk before


def test_columns_of_odd_texts_equal_the_library():
    import sentencepiece

    one, lib, rng = pieces.encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(12)
    texts = [None, "", " ", "\n", " \n ", "a", "▁", "a▁b", "  a  b\n\n c ", "é😀" * 20, "x" * 100, " " * 40, "▁▁ ▁"]
    texts += ["".join(rng.choice("abthe é▁\n 😀\t한Q.,'") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for column in (pa.array(texts), pa.array(["x", *texts])[1:]):
        sizes, ids, doubtful = one.encode_column(column)
        got = np.split(ids.to_numpy(), np.cumsum(sizes)[:-1])
        for t, x, d in zip(texts, got, doubtful, strict=True):
            assert x.tolist() == lib.encode(t or "") and d == ("▁" in (t or ""))
            assert d or pieces.decode(one.m, x.tolist()) == (t or "")


def test_memory_of_chunks_keeps_those_in_use(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNKS", 40)
    one, learnt = pieces.Encoder(pieces.encoder(MODEL).m), []
    plain = one._learn
    monkeypatch.setattr(one, "_learn", lambda chunks: learnt.extend(chunks) or plain(chunks))
    for k in range(30):
        one.encode([f"often here {k * k + 1000} {k * 7 + 5000}"])
    assert learnt.count(" often") == 1 and len(one.known) + len(one.before) <= 80


def test_parts_hold_bounded_bytes():
    texts = pa.array(["a" * 5, None, "b" * 9, "", "c" * 30, "d"])
    assert list(pieces.parts(texts, 10)) == [(0, 2), (2, 2), (4, 1), (5, 1)]
