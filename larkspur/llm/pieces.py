"""SentencePiece encoding and decoding by streaming Viterbi.

A text is normalised as the model says (a leading space is added, spaces become U+2581) and segmented over the
lattice of the model's pieces. Positions are taken in order; only the last max-piece-length of them can begin
a further piece. Whenever the backpointer paths of all of those meet at one boundary, what lies before it is
final: its ids are given out and its backpointers dropped, so the memory held does not grow with the text.

A unigram model keeps the best sum of scores at each boundary. A BPE model has no such sums, and sums of its
scores do not give its ids. Its lattice is a Viterbi lattice all the same: a transition from the piece that
ends at a boundary to the next piece is allowed only if merging their joint text gives just these two, and
each prefix has one piece that can end it. This gives the ids of the model's own merges.

Characters in no piece are given as bytes, if the model has byte pieces, else as the unknown id; paths always
converge there, and before a U+2581 after another character. Between such places stand chunks; those of up to
MATRIX characters are segmented many at once as numpy matrices, by the same recurrence, and remembered. Texts are
cut into chunks in Arrow's buffers, a dictionary of which shows Python each distinct chunk once.

A null or empty text has no ids. Decoding gives the text back but for U+2581, which becomes a space, and
characters that Unicode text cannot hold. Every row gives one row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"
#: Longest chunk that is segmented in matrices, and chunks a matrix; chunks and pairs of pieces that are remembered; bytes of text that are cut at once.
MATRIX, COLUMNS, CHUNKS, PAIRS, PAIR_BITS, PART = 32, 20_000, 300_000, 2_000_000, 21, 4_000_000
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Model:
    """Pieces, scores and byte ids of a model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._load(f.read())

    def _load(self, blob: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(blob)
        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        kinds = proto.SentencePiece
        self.bpe = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        plain = proto.normalizer_spec.name == "identity" and not proto.normalizer_spec.remove_extra_whitespaces
        if not plain or not proto.normalizer_spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and a leading space are supported")
        self.unknown = sp.unk_id()
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        #: bytes that each id stands for
        self.raw = [bytes([self.of_byte[i]]) if i in self.of_byte else b"" if i in self.control else p.piece.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(proto.pieces)]
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.longest = max(map(len, self.id))
        self.alphabet = {c for c in self.id if len(c) == 1}
        #: chunks end before a space that follows another character, unless pieces can span such places
        self.inner = any(SPACE in p.lstrip(SPACE) for p in self.id)
        self._pairs: dict[int, bool] = {}

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece holds."""
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def parted(self, a: str, b: str) -> bool:
        """Whether merging the best neighbours of a and b first, the leftmost at ties, ends in just these two; a merge across the two settles it."""
        parts, edge = [*a, *b], len(a)  # the first edge parts are of a
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts == [a, b]
            if at == edge - 1:
                return False
            edge -= at < edge
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b can stand after piece a."""
        if not self.bpe:
            return True
        key = a * len(self.text) + b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.parted(self.text[a], self.text[b])
        return known


class Stream:
    """Segments text that comes in parts; feed() and end() give out the ids that have become final."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.buffer = ""  # characters since the last final boundary
        self.best = [0.0]
        self.back: list[tuple[int, int] | None] = [(0, -1)]

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        for char in text:
            if char not in self.m.alphabet:
                out += self.end()
                out += self.m.fallback(char)
                continue
            self._step(char)
            if len(self.buffer) % self.m.longest == 0:
                out += self._settle()
        return out

    def _step(self, char: str) -> None:
        self.buffer += char
        j, m = len(self.buffer), self.m
        top, back = -np.inf, None
        for i in range(max(0, j - m.longest), j):
            piece = m.id.get(self.buffer[i:j])
            if piece is None or self.back[i] is None:
                continue
            before = self.back[i][1]
            if before >= 0 and not m.follows(before, piece):
                continue
            score = self.best[i] + (0.0 if m.bpe else m.score[piece])
            if back is None or score > top:
                top, back = score, (i, piece)
        self.best.append(top)
        self.back.append(back)

    def _path(self, end: int) -> list[int]:
        ids = []
        while end:
            end, piece = self.back[end]
            ids.append(piece)
        return ids[::-1]

    def _settle(self) -> list[int]:
        """Ids up to the last boundary that all surviving paths share."""
        n = len(self.buffer)
        live = {j for j in range(max(1, n - self.m.longest + 1), n + 1) if self.back[j] is not None}
        while len(live) > 1:
            j = max(live)
            live.remove(j)
            live.add(self.back[j][0])
        meet = live.pop() if live else 0
        if not meet:
            return []
        ids = self._path(meet)
        # the piece before the boundary is kept: it decides what may follow
        self.back = [(0, self.back[meet][1])] + [None if b is None or b[0] < meet else (b[0] - meet, b[1]) for b in self.back[meet + 1 :]]
        self.best, self.buffer = self.best[meet:], self.buffer[meet:]
        return ids

    def end(self) -> list[int]:
        ids = self._path(len(self.buffer))
        self.buffer, self.best, self.back = "", [0.0], [(0, -1)]
        return ids


class Encoder:
    def __init__(self, model: Model) -> None:
        self.m = model
        #: ids of a chunk, as the bytes of whole numbers of 32 bits: those of a text are joined at once
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: chunks that decoding does not give back
        self.lossy: set[str] = set()
        size = 1 << 19
        self.slots, self.slot_ids = self._table(size)
        self.scores = np.array(model.score)
        self.power = np.array([pow(_BASE, k, 1 << 64) for k in range(MATRIX + 1)], np.uint64)
        # a direct-mapped memory of pairs: a pair that takes another's slot only costs a new look-up
        self.pair_keys, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def _table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Open-addressed table of piece hashes."""
        slots, ids = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        for text, i in self.m.id.items():
            h = 0
            for c in text:
                h = (h * _BASE + ord(c) + 1) & ((1 << 64) - 1)
            at = (h * _SPREAD & ((1 << 64) - 1)) >> (64 - size.bit_length() + 1)
            while ids[at] >= 0:
                at = (at + 1) % size
            slots[at], ids[at] = h, i
        return slots, ids

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        at = ((h * np.uint64(_SPREAD)) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)
        ids, hit = self.slot_ids[at], self.slots[at] == h
        out = np.where(hit, ids, np.int32(-1))
        rest = np.flatnonzero(~hit & (ids >= 0))  # only a slot that another piece holds is followed by a look at the next
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self.slots)
            ids, hit = self.slot_ids[at[rest]], self.slots[at[rest]] == h[rest]
            out[rest[hit]] = ids[hit]
            rest = rest[~hit & (ids >= 0)]
        return out

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.m.text) + b
        at = ((key.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok, known = self.pair_ok[at], self.pair_keys[at] == key
        if not known.all():
            miss = np.flatnonzero(~known)
            new, inverse = np.unique(key[miss], return_inverse=True)
            found = np.fromiter((self.m.follows(*divmod(int(k), len(self.m.text))) for k in new), bool, len(new))
            ok[miss] = found[inverse]
            self.pair_keys[at[miss]], self.pair_ok[at[miss]] = key[miss], ok[miss]
        return ok

    def _matrix(self, chunks: list[str]) -> None:
        """Segments chunks whose characters are all in the alphabet, the longest first; row j holds those of j characters or more."""
        n, bpe, length = len(chunks), self.m.bpe, len(chunks[0])
        sizes = np.array([len(c) for c in chunks])
        code = np.ascontiguousarray(np.array(chunks, f"U{length}").view(np.uint32).reshape(n, length).T)
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * np.uint64(_BASE) + code[j] + np.uint64(1)
        last = np.full((length + 1, n), -1, np.int32)
        back = np.zeros((length + 1, n), np.int32)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        for j in range(1, length + 1):
            left = np.arange(np.searchsorted(-sizes, -j, "right"))
            # in a BPE lattice one piece can end a prefix: what has it is done, and short pieces are the likeliest
            for i in range(j - 1, max(0, j - self.m.longest) - 1, -1) if bpe else range(max(0, j - self.m.longest), j):
                piece = self._lookup(prefix[j, left] - prefix[i, left] * self.power[j - i])
                ok = np.flatnonzero((piece >= 0) & (best[i, left] > -np.inf))
                if bpe and i and len(ok):
                    ok = ok[self._follows(last[i, left[ok]], piece[ok])]
                at, piece = left[ok], piece[ok]
                score = best[i, at] + (0.0 if bpe else self.scores[piece])
                win = score > best[j, at]
                best[j, at[win]], last[j, at[win]], back[j, at[win]] = score[win], piece[win], i
                if bpe and len(ok):
                    left = np.delete(left, ok)
                    if not len(left):
                        break
        at, rows, steps = sizes, np.arange(n), []
        while at.any():
            steps.append(np.where(at > 0, last[at, rows], -1))
            at = np.where(at > 0, back[at, rows], 0)
        ids = np.array(steps[::-1]).T
        self._keep(chunks, ids[ids >= 0], (ids >= 0).sum(1))

    def _learn(self, chunks: set[str]) -> None:
        short, m = [], self.m
        for chunk in (c.replace(" ", SPACE) for c in chunks):
            if len(chunk) <= MATRIX and m.alphabet.issuperset(chunk) and chunk.strip(SPACE):
                short.append(chunk)
            else:
                ids = self._streamed(chunk)
                self._keep([chunk], np.array(ids, np.int64), [len(ids)])
        short.sort(key=len, reverse=True)
        for start in range(0, len(short), COLUMNS):
            self._matrix(short[start : start + COLUMNS])

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: list[int] | np.ndarray) -> None:
        """Remembers the ids of chunks, one after another, and which chunks decoding does not give back."""
        ends, blob = np.cumsum([0, *sizes]).tolist(), ids.astype(np.int32).tobytes()
        keys = [c.replace(SPACE, " ") for c in chunks]
        self.known.update((k, blob[4 * i : 4 * j]) for k, i, j in zip(keys, ends, ends[1:], strict=False))
        raw = [self.m.raw[i] for i in ids.tolist()]
        if b"".join(raw) != "".join(keys).encode("utf-8"):
            self.lossy.update(k for k, i, j in zip(keys, ends, ends[1:], strict=False) if b"".join(raw[i:j]) != k.encode("utf-8"))

    def _streamed(self, chunk: str) -> list[int]:
        stream = Stream(self.m)
        return stream.feed(chunk) + stream.end()

    def _know(self, chunks: list[str]) -> None:
        """Has the ids of chunks in known; of those before the last CHUNKS only what is asked for again is kept."""
        new = set(chunks).difference(self.known)
        if len(self.known) + len(new) > CHUNKS:
            self.before, self.known, new = self.known, {}, set(chunks)
            self.lossy.intersection_update(self.before)
        again = new.intersection(self.before)
        self.known.update((c, self.before[c]) for c in again)
        self._learn(new - again)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Ids of each text in number, the ids of all in a row, and whether decoding them may not give the text back.

        Chunks are cut and told apart in Arrow's buffers; Python sees each distinct one of the column once.
        """
        some = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
        given = texts.filter(some)
        sizes, doubtful = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        if not len(given):
            return sizes, pa.array([], pa.int32()), doubtful
        norm = pc.binary_join_element_wise(" " if self.m.prefix else "", pc.replace_substring(given, SPACE, " "), "")
        bounds = np.frombuffer(norm.buffers()[1], np.int32)[norm.offset : norm.offset + len(norm) + 1]
        data, begins = np.frombuffer(norm.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds[:-1] - bounds[0]
        line, space = data == 10, data == 32
        cut = line.copy()
        cut[1:] |= line[:-1]
        cut[begins] = True
        if not self.m.inner:
            cut[1:] |= space[1:] & ~space[:-1]
        at = np.flatnonzero(cut)
        chunks = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        self._know(distinct)
        packed = [self.known[c] for c in distinct]
        ends = np.cumsum([0, *map(len, packed)], dtype=np.int32) // 4
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32))).take(chunks.indices).flatten()
        of, first, rows = chunks.indices.to_numpy(), np.searchsorted(at, begins), np.flatnonzero(some.to_numpy(zero_copy_only=False))
        sizes[rows] = np.add.reduceat(np.diff(ends).astype(np.int64)[of], first)
        lossy = np.fromiter((c in self.lossy for c in distinct), bool, len(distinct))
        doubtful[rows] = np.logical_or.reduceat(lossy[of], first) | pc.match_substring(given, SPACE).to_numpy(zero_copy_only=False)
        return sizes, ids, doubtful

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        sizes, ids, _ = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids.to_numpy(), np.cumsum(sizes)[:-1])


def decode(model: Model, ids: list[int]) -> str:
    text = b"".join(map(model.raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Model(path))


def parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of texts of so many bytes together, a longer one alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, end - start
        start = end


def encode(docs: DataFrame, path: str, part: int = PART) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_ids, ids, round_trip): ids, and whether decoding them gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for b in batches:
            column = b.column(1).cast(pa.string())
            for start, rows in parts(column, part):
                texts = column.slice(start, rows)
                sizes, ids, doubtful = one.encode_column(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                same = ~doubtful
                for i in np.flatnonzero(doubtful):
                    same[i] = decode(one.m, ids[offsets[i] : offsets[i + 1]].to_pylist()) == texts[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, rows).cast(pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), ids), pa.array(same)],
                    names=["doc_id", "n_ids", "ids", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")
