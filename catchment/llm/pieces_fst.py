"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The transducer is the composition of a normaliser (a space before the text; spaces written as U+2581),
the pieces (one path each, weight the negated score), and a byte fallback (a path of byte pieces for a
character without a piece, at a cost above any piece). Composed with an input its states are the input's
positions, and the encoding is the shortest path in the tropical semiring: costs add along a path, the
cheaper of two paths into a state stays. That is the unigram model's encoding as it stands.

For a model trained by byte-pair encoding the states also hold the last piece: an arc may follow a piece only
if merging both pieces' characters by rank gives these two pieces again. A merge sequence is valid exactly if
all its neighbours are, so one path alone is left, whatever its cost: the search then takes the only valid arc
into each position and has no costs to compare. Models of other types, with a table of character replacements
or with pieces that run on over a space are refused.

Pieces never cross the start of a run of spaces or a line break, so texts are composed unit by unit and equal
units of a chunk once. A null or empty text has no pieces. The character U+2581 in a text reads as a space.
Rows are encoded on their own, so repeated rows get equal results.
"""

from __future__ import annotations

import math
import os
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Chunk, first_of, map_texts, prefix_hash, span_hash

#: Units whose encodings a worker remembers before it starts afresh.
CACHE = 600_000
_SPACE = "▁"
#: Folder of public tokenizers' files, on the driver; the model travels with the tasks.
TOKENIZERS = "/opt/tokenizers"


def default_model() -> str:
    return os.path.join(TOKENIZERS, "piece_bpe_32k.model")


def _fields(b: bytes):
    """(number, value) of the fields of a serialised message; numbers and length-delimited bytes."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            out |= (b[at] & 127) << shift
            shift += 7
            at += 1
            if b[at - 1] < 128:
                return out

    while at < len(b):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, b[at : at + size]
            at += size


# fixed values: numbers of the model file's format
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Transducer:
    """Compiled from a model's pieces and scores; ``kind`` is _UNIGRAM or _BPE."""

    def __init__(self, pieces: list[str], scores: list[float], fallback: list[int], unknown: int, special: set[int], kind: int = _BPE):
        self.pieces, self.fallback, self.unknown, self.kind = pieces, fallback, unknown, kind
        plain = [i for i in range(len(pieces)) if i not in special]
        self.id = {pieces[i]: i for i in plain}
        self.cost = {pieces[i]: -scores[i] for i in plain}
        self.dearest = max(self.cost.values(), default=0.0)
        self.trie: dict = {}
        for p in self.id:
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = p
        self.follows: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.seen: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}
        raw = [p.replace(_SPACE, " ").encode() for p in pieces]
        for byte, i in enumerate(fallback):
            if i >= 0:
                raw[i] = bytes([byte])
        for i in special - set(fallback):
            raw[i] = b""
        self.size = np.array([len(r) for r in raw])
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    @staticmethod
    def load(path: str) -> Transducer:
        with open(path, "rb") as f:
            return Transducer.of(f.read())

    @staticmethod
    def of(model: bytes) -> Transducer:
        """Compiles a serialised model; one whose encoding would come out wrong raises ValueError."""
        pieces, scores, kinds, trainer, rules = [], [], [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                kinds.append(one.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        kind = trainer.get(3, _UNIGRAM)
        if kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and byte-pair models can be encoded")
        if rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or not rules.get(5, 1) or trainer.get(24, 0):
            raise ValueError("the model's normaliser does more than put a space before the text and write spaces as U+2581")
        if any(k not in (_NORMAL, _UNKNOWN, _CONTROL, 5, _BYTE) for k in kinds):
            raise ValueError("models with user-defined pieces cannot be encoded")
        if any("\n" in p or _SPACE in p.lstrip(_SPACE) for p, k in zip(pieces, kinds) if k == _NORMAL):
            raise ValueError("pieces that run on over a space or a line break cannot be encoded")
        fallback = [-1] * 256
        for i, k in enumerate(kinds):
            if k == _BYTE:
                fallback[int(pieces[i][1:-1], 16)] = i
        return Transducer(pieces, scores, fallback, kinds.index(_UNKNOWN), {i for i, k in enumerate(kinds) if k != _NORMAL}, kind)

    def _merged(self, s: str, border: int) -> bool:
        """Whether merging the characters of s by rank leaves exactly the two parts that meet at ``border``."""
        ends = list(range(1, len(s) + 1))
        starts = [0, *ends[:-1]]
        while len(starts) > 1:
            best, at = None, -1
            for k in range(len(starts) - 1):
                c = self.cost.get(s[starts[k] : ends[k + 1]])
                if c is not None and (best is None or c < best):
                    best, at = c, k
            if best is None:
                break
            ends[at] = ends[at + 1]
            del starts[at + 1], ends[at + 1]
            if starts[at] < border < ends[at]:
                return False
        return starts == ([0, border] if border < len(s) else [0])

    def _whole(self, a: str) -> bool:
        """Whether merging makes one piece of a."""
        got = self.whole.get(a)
        if got is None:
            got = self.whole[a] = self._merged(a, len(a))
        return got

    def _may_follow(self, a: str, b: str) -> bool:
        got = self.follows.get((a, b))
        if got is None:
            if len(self.follows) > 4 * CACHE:
                self.follows.clear()
            got = self.follows[a, b] = self._merged(a + b, len(a))
        return got

    def lightest(self, s: str) -> list[str]:
        """Pieces (or single characters without one) on the shortest path, for pieces that may follow freely."""
        n = len(s)
        cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        unknown = self.dearest + 10.0
        for i in range(n):
            node, j, single = self.trie, i, False
            while j < n and (node := node.get(s[j])) is not None:
                j += 1
                piece = node.get("")
                if piece is not None:
                    single = single or j == i + 1
                    if cost[i] + self.cost[piece] < cost[j]:
                        cost[j], back[j] = cost[i] + self.cost[piece], i
            if not single and cost[i] + unknown < cost[i + 1]:
                cost[i + 1], back[i + 1] = cost[i] + unknown, i
        out, j = [], n
        while j:
            out.append(s[back[j] : j])
            j = back[j]
        return out[::-1]

    def shortest(self, s: str) -> list[str]:
        """Pieces (or single characters without one) on the shortest path through the composition with s.

        A position is a state with its last piece. Since a prefix has one valid encoding, the first valid
        arc into a position is the only one, and its cost (the sum of its pieces') needs no comparison.
        """
        n, root, follows = len(s), self.trie, self.follows
        last = [""] * (n + 1)
        for i in range(n):
            before = last[i]
            if i and not before:
                continue
            node = root.get(s[i])
            if not last[i + 1]:
                arc = s[i]
                if not before or self._may_follow(before, arc):
                    last[i + 1] = arc
            j = i + 1
            while node is not None:
                if j > i + 1 and not last[j]:
                    arc = node.get("")
                    if arc is not None:
                        if before:
                            fits = follows.get((before, arc))
                            if fits is None:
                                fits = self._may_follow(before, arc)
                        else:
                            fits = self._whole(arc)
                        if fits:
                            last[j] = arc
                if j == n:
                    break
                node = node.get(s[j])
                j += 1
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def unit(self, s: str) -> tuple[int, ...]:
        out: list[int] = []
        for p in self.lightest(s) if self.kind == _UNIGRAM else self.shortest(s):
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.kind == _UNIGRAM and max(self.fallback) < 0:
                if out[-1:] != [self.unknown]:  # neighbouring characters without a piece are one unknown
                    out.append(self.unknown)
            else:
                out += [self.fallback[b] if self.fallback[b] >= 0 else self.unknown for b in p.encode("utf-8", "replace")]
        return tuple(out)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text)."""
        texts = [" " + t.replace(_SPACE, " ") if t else "" for t in texts]  # the normaliser's leading space
        c = Chunk(texts)
        d = c.data
        gap = np.concatenate([[10], d[:-1]])
        begin = ((d == 32) & (gap != 32)) | (d == 10) | (gap == 10)
        sep = np.zeros(len(d) + 1, bool)
        sep[c.end] = True
        begin[sep[:-1]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(d))
        real = ~sep[starts]
        starts, ends = starts[real], ends[real]
        prefix = prefix_hash(d)
        order, fresh = first_of(span_hash(prefix, starts, ends) + (ends - starts).astype(np.uint64))
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(fresh) - 1
        if len(self.seen) > CACHE // 2:
            self.seen, self.older = {}, self.seen
        blob, seen, older, found = d.tobytes(), self.seen, self.older, []
        for a, b in zip(starts[order[fresh]].tolist(), ends[order[fresh]].tolist()):
            key = blob[a:b]
            got = seen.get(key)
            if got is None:
                got = older.get(key)
                if got is None:
                    got = self.unit(key.decode("utf-8").replace(" ", _SPACE))
                seen[key] = got
            found.append(got)
        size = np.array([len(f) for f in found], np.int64)
        flat = np.array([i for f in found for i in f], np.int32)
        at = np.concatenate([[0], np.cumsum(size)])[:-1] if len(size) else np.empty(0, np.int64)
        per, first = size[kind], at[kind] if len(size) else np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(per)])
        ids = flat[np.repeat(first - total[:-1], per) + np.arange(total[-1])] if total[-1] else np.empty(0, np.int32)
        return ids, total[np.searchsorted(starts, np.append(c.start, len(d)))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The inverse transduction: the bytes of each text, without the normaliser's space."""
        per = self.size[ids]
        total = np.concatenate([[0], np.cumsum(per)])
        blob = self.bytes[np.repeat(self.at[ids] - total[:-1], per) + np.arange(total[-1])].tobytes() if total[-1] else b""
        cut = total[offsets]
        return [blob[a + (blob[a : a + 1] == b" ") : b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


@lru_cache(maxsize=2)
def _worker(model: bytes) -> Transducer:
    return Transducer.of(model)


def _shipped(path: str | None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip (decoding gives the text's bytes back); the model file (0.5 MB) travels with the tasks."""
    proto = _shipped(model)

    def make():
        fst = _worker(proto)

        def kernel(cols):
            ids, offsets = fst.encode(cols["text"])
            back = fst.decode(ids, offsets)
            same = [(t or "").encode("utf-8", "replace") == b for t, b in zip(cols["text"], back)]
            return pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(same)], names=["doc_id", "n_pieces", "ids", "round_trip"])

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    proto = _shipped(model)

    def run(batches):
        fst = _worker(proto)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                ids = part.column("ids").fill_null([]) if part.column("ids").null_count == 0 else pa.array([x or [] for x in part.column("ids").to_pylist()], pa.list_(pa.int32()))
                sizes = np.array([len(x) for x in ids], np.int64)
                back = fst.decode(ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in back], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
