"""Unigram encoding and decoding over a vocabulary of pieces.

Pieces with log scores stand in a double-array trie over UTF-8 bytes.  The best segmentation of a text is found by Viterbi;
characters that no piece covers fall back to byte pieces.  A space is the marker U+2581, one is put before the text.  Decoding
turns markers into spaces, byte pieces into bytes and takes the first space away, so that decoding what was encoded gives the
same text.  (A marker that stands in the text itself is encoded in bytes, so that it comes back, too.)

No piece has a marker after another character and none has a line break, so the best segmentation of a text is that of its
chunks: a run of spaces with what follows up to the next space or line break.  Distinct chunks are encoded once, many at a time:
the Viterbi steps are numpy operations over all chunks of one length.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices
from .wordmemo import WordMemo, ragged, sums

MARK = "▁".encode()
#: Cost of a character without a piece below the lowest score, as in the published unigram model.
FALLBACK = 10.0
_CHUNK = re.compile(r" +[^ \n]*|\n|[^ \n]+")


def double_array(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and piece number (-1: none) of a double-array trie; the child of s by byte c is base[s] + c + 1."""
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for k, piece in enumerate(pieces):
        at = 0
        for c in piece:
            if c not in tree[at]:
                tree[at][c] = len(tree)
                tree.append({})
            at = tree[at][c]
        ends.setdefault(at, k)
    room = 8 * len(tree) + 4096
    base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    used = bytearray(room)
    used[0], free, top, todo = 1, 257, 257, [(0, 0)]
    while todo:
        node, slot = todo.pop()
        value[slot] = ends.get(node, -1)
        kids = sorted(tree[node])
        if not kids:
            continue
        while used[free]:
            free += 1
        # Single children fill the gaps; families start near the end, so the search stays short.
        spot = max(free, top - 256 if len(kids) > 1 else 0)
        while any(used[spot + c - kids[0]] for c in kids):
            spot += 1
        b = base[slot] = spot - kids[0] - 1
        for c in kids:
            used[b + c + 1], check[b + c + 1] = 1, slot
            todo.append((tree[node][c], b + c + 1))
        top = max(top, b + kids[-1] + 2)
    last = int(np.flatnonzero(check >= 0).max(initial=0)) + 258
    return base[:last], check[:last], value[:last]


#: Fixed values of the model file: kinds of models and of pieces.
_UNIGRAM, _MERGES = 1, 2
_NORMAL, _USER, _BYTE = 1, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields in the protocol-buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Pieces:
    """A vocabulary: text pieces with scores and ids, and the ids of the 256 byte pieces.

    dummy: a space is put before texts; squeeze: spaces at the ends and after a space are taken away.
    """

    pieces: list[bytes]
    scores: np.ndarray
    ids: np.ndarray
    byte_ids: np.ndarray
    size: int
    trie: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default=None)
    dummy: bool = True
    squeeze: bool = False

    def __post_init__(self):
        for p in self.pieces:
            if b"\n" in p or not _leading(p):
                raise ValueError(f"the piece {p!r} crosses a chunk's edge")
        if self.trie is None:
            self.trie = double_array(self.pieces)
        self.longest = max(map(len, self.pieces), default=1)
        self.low = float(self.scores.min()) - FALLBACK if len(self.scores) else -FALLBACK

    @staticmethod
    def load(path: str) -> Pieces:
        """Reads a SentencePiece model file, whose own settings say what kind it is and how texts are prepared.

        Scores of a unigram model are taken as they are.  A model of merges has ranks instead of scores; its pieces get the log
        of a Zipf frequency, -ln(rank + 1), which is a rule and trains nothing.  Files with other kinds, user-defined pieces, a
        character map, markers after words, or without byte pieces are refused, as their texts would be encoded otherwise.
        """
        with open(path, "rb") as f:
            return Pieces.parse(f.read())

    @staticmethod
    def parse(data: bytes) -> Pieces:
        parts = list(_fields(data))
        trainer, normal = ({k: v for k, v in _fields(dict(parts).get(f, b""))} for f in (2, 3))
        plain, raw, ids, byte_ids, size = [], [], [], np.full(256, -1, np.int32), 0
        for field_number, message in parts:
            if field_number != 1:
                continue
            one = dict(_fields(message))
            kind = one.get(3, _NORMAL)
            if kind == _BYTE:
                byte_ids[int(one[1][3:5], 16)] = size
            elif kind == _NORMAL:
                plain.append(one[1])
                raw.append(struct.unpack("<f", one.get(2, bytes(4)))[0])
                ids.append(size)
            elif kind == _USER:
                raise ValueError("user-defined pieces are not supported")
            size += 1
        kind = trainer.get(3, _UNIGRAM)
        if kind not in (_UNIGRAM, _MERGES) or normal.get(2) or trainer.get(24) or (byte_ids < 0).any() or not normal.get(5, 1):
            raise ValueError("the file's settings are not supported")
        scores = np.array(raw, float)
        if kind == _MERGES:
            scores = -np.log(scores.max() - scores + 1.0) - np.log(len(scores))
        return Pieces(plain, scores, np.array(ids, np.int32), byte_ids, size, dummy=bool(normal.get(3, 1)), squeeze=bool(normal.get(4, 1)))

    def prepared(self, text: str) -> str:
        """The text as it is encoded: extra spaces taken away where the file says so, and a space put before it."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return " " + text if self.dummy and text else text

    def _viterbi(self, texts: list[bytes], blocked: list[list[int]]) -> list[list[int]]:
        """The ids of texts of one byte length; ``blocked``: where a marker of the text itself starts."""
        base, check, value = self.trie
        n, size = len(texts), len(texts[0])
        x = np.frombuffer(b"".join(texts), np.uint8).reshape(n, size).astype(np.int32)
        start = (x & 0xC0) != 0x80
        stop = np.zeros((n, size + 4), bool)
        for i, places in enumerate(blocked):
            for p in places:
                stop[i, p] = True
        best = np.full((n, size + 1), -np.inf)
        back = np.zeros((n, size + 1), np.int32)
        piece = np.full((n, size + 1), -1, np.int32)
        best[:, 0] = 0
        every = np.arange(n)
        for s in range(size):
            live = every[start[:, s]]
            if not len(live):
                continue
            state = np.zeros(len(live), np.int32)
            single = np.zeros(n, bool)
            width = np.where(x[live, s] >= 0xF0, 4, np.where(x[live, s] >= 0xE0, 3, np.where(x[live, s] >= 0xC0, 2, 1)))
            widths = np.zeros(n, np.int32)
            widths[live] = width
            for k in range(min(self.longest, size - s)):
                go = ~stop[live, s + k]
                live, state = live[go], state[go]
                to = base[state] + x[live, s + k] + 1
                ok = check[to] == state
                live, state = live[ok], to[ok]
                if not len(live):
                    break
                v = value[state]
                end = v >= 0
                if end.any():
                    at, found = live[end], v[end]
                    single[at[widths[at] == k + 1]] = True
                    score = best[at, s] + self.scores[found]
                    win = score > best[at, s + k + 1]
                    at, found = at[win], found[win]
                    best[at, s + k + 1], back[at, s + k + 1], piece[at, s + k + 1] = score[win], s, found
            none = every[start[:, s] & ~single]
            to = np.minimum(s + widths[none], size)
            score = best[none, s] + self.low
            win = score > best[none, to]
            none, to = none[win], to[win]
            best[none, to], back[none, to], piece[none, to] = score[win], s, -1
        out = []
        for i, (b, p) in enumerate(zip(back.tolist(), piece.tolist(), strict=True)):
            at, ids = size, []
            while at:
                if p[at] >= 0:
                    ids.append(int(self.ids[p[at]]))
                else:
                    ids += [int(z) for z in self.byte_ids[x[i, b[at] : at]][::-1]]
                at = b[at]
            out.append(ids[::-1])
        return out

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """The ids of chunks in which a space stands for the marker."""
        by: dict[int, list[int]] = {}
        data, blocked = [], []
        for i, c in enumerate(chunks):
            own = [m.start() for m in re.finditer(MARK, c.encode("utf-8", "surrogatepass").replace(b" ", b"\0\0\0"))] if "▁" in c else []
            data.append(c.encode("utf-8", "surrogatepass").replace(b" ", MARK))
            blocked.append(own)
            by.setdefault(len(data[-1]), []).append(i)
        out: list[list[int]] = [[]] * len(chunks)
        for size, rows in by.items():
            step = max(1, 4_000_000 // (size + 1) // 16)
            for a in range(0, len(rows) if size else 0, step):
                part = rows[a : a + step]
                for i, ids in zip(part, self._viterbi([data[i] for i in part], [blocked[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_chunks(_CHUNK.findall(self.prepared(text))) for i in ids]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all ids, one after the other, with starts and sizes; ids that stand for no text have none."""
        each = [b""] * self.size
        for i, p in zip(self.ids.tolist(), self.pieces, strict=True):
            each[i] = p.replace(MARK, b" ")
        for b, i in enumerate(self.byte_ids.tolist()):
            if i >= 0:
                each[i] = bytes([b])
        sizes = np.array([len(e) for e in each], np.int64)
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: list[int]) -> str:
        flat, starts, sizes = self.table()
        got = np.array(ids, np.int64)
        return flat[ragged(starts[got], sizes[got])].tobytes().decode("utf-8", "replace")[self.dummy :]


def _leading(piece: bytes) -> bool:
    """Whether markers stand only at the front."""
    while piece.startswith(MARK):
        piece = piece[len(MARK) :]
    return MARK not in piece


def encode_batches(batches: Iterator[pa.RecordBatch], vocabulary: Pieces) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, ids) of batches (doc_id, text), in slices of bounded size."""
    memo = WordMemo(vocabulary.encode_chunks)
    for whole in batches:
        for b in slices(whole, "text", 2_000_000):
            chunks = [_CHUNK.findall(vocabulary.prepared(t)) if t else [] for t in b.column(1).to_numpy(zero_copy_only=False)]
            offsets = np.append(0, np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))))
            ids, sizes = memo.ids(pa.array([c for row in chunks for c in row], pa.string()))
            bounds = np.append(0, np.cumsum(sums(sizes, offsets))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids, pa.int32()))], ["doc_id", "ids"])


def encode_texts(docs: DataFrame, vocabulary: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids), one row per input row, whole texts.  Null and empty texts have no ids.  Vocabularies have a fixed size."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: encode_batches(batches, shared.value), "doc_id long, ids array<int>")


def decode_texts(coded: DataFrame, vocabulary: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids).  Null ids give null; no ids give the empty text; broken bytes give U+FFFD."""
    bound_batches(coded.sparkSession)
    shared, skip = coded.sparkSession.sparkContext.broadcast(vocabulary.table()), int(vocabulary.dummy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, sizes = shared.value
        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy()
            got = lists.values.to_numpy(zero_copy_only=False)
            some = lists.is_valid().to_numpy(zero_copy_only=False)
            out = []
            for a, e, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), some.tolist(), strict=True):
                ids = got[a:e]
                out.append(flat[ragged(starts[ids], sizes[ids])].tobytes().decode("utf-8", "replace")[skip:] if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])

    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
