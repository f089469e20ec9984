"""Removal of repeated windows of N words by super-k-mer partitioning.

A word goes if a window of N words that covers it also starts in a document with a smaller id. Sending each
window to its bucket would move the corpus N times. Instead the minimiser of a window - the least hash among
its runs of MINIMISER words - names its bucket; windows that follow one another mostly share it, and travel
together as one packed string, their words joined by one space. Equal windows have equal minimisers and meet
in one bucket, where they are cut out of the strings again, sorted by a hash, and neighbours of equal hash
compared byte by byte, so that counts are exact.

The same kernel runs up to three times, and each run leaves of each window only what its least document has:

* in each chunk of texts, before the shuffle, so that copies within a chunk leave one;
* for windows of hot minimisers (a first pass counts strings in slots of minimisers; a slot of many times the
  mean is hot), which are dealt one by one by their own hash and a salt instead of by the minimiser;
* in the bucket.

What a run decides is exact whatever the slots hold: they only choose the way. A null text has no words. A null
id sorts below all others. Rows that share an id have no smaller one among them, so what they share with each
other stays; rows equal in id and text are judged alike. Each row of the input gives one row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, SPACE, Chunk, cut, first_of, gram_hash, keyed, map_texts, mix, prefix_hash, release, scan_bytes, span_hash

N = 13
MINIMISER = 3
#: Bytes of input for each bucket of packed strings that meets in one task, and for each slot in which minimisers are counted.
PART_BYTES = 1 << 20
SLOT_BYTES = 1 << 20
SLOTS = 1 << 12, 1 << 22
#: A slot with more than so many times the mean is hot.
HOT = 8
#: Groups among which a hot window's holders are parted before they meet.
SALTS = 1024
#: Bytes of words that are hashed at a time, and an odd factor.
SLAB = 1 << 20
ODD = np.uint64(0xBF58476D1CE4E5B9)
#: Packed strings of more bytes are compressed.
SMALL = 1 << 10


class Words(Chunk):
    """A chunk whose words lie in ``flat`` with one space after each; ``first``, ``last`` are their byte spans there."""

    def __init__(self, texts: list[str | None]):
        super().__init__(texts)
        solid = np.zeros(len(self.data) + 2, np.int8)
        solid[1:-1] = ~SPACE[self.data]
        step = np.diff(solid)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        take = solid[1:-1] == 1
        take[end] = True
        self.flat = np.where(solid[1:-1] == 1, self.data, 32)[take]
        self.last = np.cumsum(end - start + 1) - 1
        self.first = self.last - (end - start)
        self.w_lo, self.w_hi = np.searchsorted(start, self.start), np.searchsorted(start, self.end)
        self.w_doc = np.repeat(np.arange(len(self.size)), self.w_hi - self.w_lo)


def word_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, end) of ``flat``, ascending, some SLAB bytes at a time."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + SLAB)))
        prefix = prefix_hash(flat[start[lo] : end[hi - 1]])
        out[lo:hi] = span_hash(prefix, start[lo:hi] - start[lo], end[lo:hi] - start[lo])
        lo = hi
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row: of runs of 2, 4, 8 and so on, and of two such runs that overlap."""
    p = 1
    while 2 * p <= n:
        words = mix(words[: max(0, len(words) - p)] * ODD + words[p:])
        p *= 2
    return mix(words[: max(0, len(words) - n + p)] * ODD + words[n - p :]) if p < n else words


@dataclass
class Windows:
    """Windows cut out of strings of words: ``at`` is a window's first word, ``place`` its number in its document."""

    flat: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    twin: np.ndarray
    place: np.ndarray
    count: np.ndarray
    n: int
    words: np.ndarray | None = None

    def hashes(self) -> np.ndarray:
        words = word_hashes(self.flat, self.start, self.end) if self.words is None else self.words
        return window_hashes(words, self.n)[self.at]


def judge(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: whether a smaller document has it, all its occurrences (given to one of those left, 0 to the rest), its hash."""
    h = w.hashes()
    if not len(h):
        return np.empty(0, bool), np.empty(0, np.int64), h
    order, fresh = first_of(h)
    lo, hi = w.start[w.at][order], w.end[w.at + w.n - 1][order]
    again = np.flatnonzero(~fresh)
    blob = w.flat.tobytes()
    if any(blob[a:b] != blob[c:d] for a, b, c, d in zip(*(x.tolist() for x in (lo[again], hi[again], lo[again - 1], hi[again - 1])))):  # windows of one hash differ
        words = [blob[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        by = sorted(range(len(words)), key=words.__getitem__)
        fresh = np.array([k == 0 or words[i] != words[by[k - 1]] for k, i in enumerate(by)])
        order = order[by]
    starts, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    doc = w.doc[order]
    lost = doc > np.minimum.reduceat(doc, starts)[group]
    total = np.zeros(len(order), np.int64)
    left = np.flatnonzero(~lost)
    lead = left[np.concatenate([[True], group[left][1:] != group[left][:-1]])]
    total[lead] = np.add.reduceat(w.count[order], starts)
    out_lost, out_total = np.empty(len(order), bool), np.empty(len(order), np.int64)
    out_lost[order], out_total[order] = lost, total
    return out_lost, out_total, h


def minimisers(word_hash: np.ndarray, n: int) -> np.ndarray:
    """The least hash among the runs of MINIMISER words of each window of n words."""
    m = min(MINIMISER, n)
    grams = gram_hash(word_hash, m)
    wide = n - m + 1
    if len(grams) < wide:
        return np.empty(0, np.uint64)
    least = grams[: len(grams) - wide + 1].copy()
    for k in range(1, wide):
        np.minimum(least, grams[k : k + len(least)], out=least)
    return least


def _windows(c: Words, n: int) -> np.ndarray:
    """First words of the windows of a chunk."""
    return np.flatnonzero(c.w_doc[: max(0, len(c.w_doc) - n + 1)] == c.w_doc[n - 1 :])


def _slot(minimiser: np.ndarray, slots: int) -> np.ndarray:
    return (mix(minimiser) >> np.uint64(20)) % np.uint64(slots)


def _runs(at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where runs begin of windows that follow one another and agree in ``same``."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def hot_slots(docs: DataFrame, n: int, slots: int) -> list[int]:
    """Slots of minimisers with more than HOT times the mean of packed strings: fewer than slots / HOT."""

    def make():
        def kernel(cols):
            c = Words(cols["text"])
            at = _windows(c, n)
            least = minimisers(word_hashes(c.flat, c.first, c.last), n)[at]
            runs = _runs(at, least)
            slot, count = np.unique(_slot(least[runs], slots), return_counts=True)
            return {"slot": slot.astype(np.int64), "n": count.astype(np.int64)}

        return kernel

    counted = cut(map_texts(docs.select("text"), make, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = sorted(r.slot for r in counted.filter(F.col("n") * slots > total * HOT).select("slot").collect())
    release(counted)
    return hot


def _pack(w: Windows, keep: np.ndarray, total: np.ndarray, cuts: np.ndarray, part: np.ndarray) -> dict[int, bytes]:
    """Packed strings by part: ``keep`` are the windows left, runs of them begin at ``cuts``, each of which goes to its ``part``."""
    blob = w.flat.tobytes()
    first, last = keep[cuts], keep[np.append(cuts, len(keep))[1:] - 1]
    size = last - first + 1  # windows of a run have consecutive numbers
    lo, hi = w.start[w.at[first]].tolist(), w.end[w.at[last] + w.n - 1].tolist()
    order = np.argsort(part, kind="stable")
    names, begin = np.unique(part[order], return_index=True)
    out = {}
    for p, a, b in zip(names.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
        s = order[a:b]
        f = first[s]
        counts = total[np.repeat(f - np.concatenate([[0], np.cumsum(size[s])[:-1]]), size[s]) + np.arange(size[s].sum())]
        body = b"".join(x.tobytes() for x in (w.doc[f].astype("<i8"), w.twin[f].astype("<i4"), w.place[f].astype("<i4"), size[s].astype("<i4"), counts.astype("<i8")))
        body += b"\n".join(blob[lo[i] : hi[i]] for i in s.tolist())
        head = np.array([len(s), len(counts), len(body)], "<i8").tobytes()
        out[p] = b"z" + head + pa.compress(body, "zstd", asbytes=True) if len(body) > SMALL else b"r" + head + body
    return out


def _unpack(blobs: list[bytes], n: int) -> Windows:
    parts: list[list[np.ndarray]] = [[] for _ in range(5)]
    texts = []
    for b in blobs:
        runs, windows, size = np.frombuffer(b, "<i8", 3, 1).tolist()
        body = pa.decompress(b[25:], size, "zstd", asbytes=True) if b[:1] == b"z" else b[25:]
        at = 0
        for x, kind, k in zip(parts, ("<i8", "<i4", "<i4", "<i4", "<i8"), (runs, runs, runs, runs, windows)):
            x.append(np.frombuffer(body, kind, k, at))
            at += k * int(kind[2])
        texts.append(body[at:])
    doc, twin, place, size, count = (np.concatenate(x) if x else np.empty(0, np.int64) for x in parts)
    flat = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
    end = np.flatnonzero((flat == 32) | (flat == 10))
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    size = size.astype(np.int64)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    words = size + n - 1
    return Windows(flat, start, end, np.repeat(np.cumsum(words) - words, size) + within, np.repeat(doc, size), np.repeat(twin, size), np.repeat(place, size) + within, count, n)


def _spans(w: Windows, which: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, twin, lo, hi): the words that the windows ``which`` cover; windows of a string follow one another in w."""
    at = w.at[which]
    cuts = _runs(at, w.doc[which], w.twin[which])
    last = np.append(cuts, len(at))[1:] - 1
    return w.doc[which][cuts], w.twin[which][cuts], w.place[which][cuts], w.place[which][last] + w.n


def _deal(docs: DataFrame, n: int, parts: int, slots: int, hot: list[int]) -> DataFrame:
    """part, open, lost: packed strings dealt by minimiser (parts from 0) or, of hot ones, by window and salt (from ``parts``)."""
    table = np.zeros(slots, bool)
    table[hot] = True

    def make():
        def kernel(cols):
            c = Words(cols["text"])
            word_hash = word_hashes(c.flat, c.first, c.last)
            at = _windows(c, n)
            row = c.w_doc[at]
            doc, twin = np.array(cols["doc"], np.int64), np.array(cols["twin"], np.int64)
            w = Windows(c.flat, c.first, c.last, at, doc[row], twin[row], at - c.w_lo[row], np.ones(len(at), np.int64), n, word_hash)
            lost, total, h = judge(w)
            out: dict = {"part": [], "open": [], "lost": []}
            keep = np.flatnonzero(~lost)
            if len(keep):
                least = minimisers(word_hash, n)[at[keep]]
                single = table[_slot(least, slots)]
                cuts = _runs(np.where(single, -2 * keep, at[keep]), least)
                key = mix(least[cuts]) % np.uint64(parts)
                salt = mix(w.doc[keep[cuts]].view(np.uint64) ^ mix(w.twin[keep[cuts]].view(np.uint64))) % np.uint64(SALTS)
                part = np.where(single[cuts], np.uint64(parts) + mix(h[keep[cuts]] ^ mix(salt)) % np.uint64(parts), key).astype(np.int64)
                for p, b in _pack(w, keep, total, cuts, part).items():
                    out["part"].append(p)
                    out["open"].append(b)
                    out["lost"].append(None)
            gone = np.flatnonzero(lost)
            if len(gone):
                spans = _spans(w, gone)
                part = (mix(spans[0].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                names, begin = np.unique(part[order], return_index=True)
                for p, a, b in zip(names.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
                    out["part"].append(p)
                    out["open"].append(None)
                    out["lost"].append(np.stack([x[order[a:b]].astype("<i8") for x in spans]).tobytes())
            return out

        return kernel

    return map_texts(docs, make, "part long, open binary, lost binary")


_JUDGED = "doc long, twin int, lo int, hi int, part long, open binary, window string, n long"


def _meet(dealt: DataFrame, n: int, parts: int, counts: bool) -> DataFrame:
    """Of each part the spans lost, the windows left of hot minimisers (part, open), and with ``counts`` each window and its occurrences."""
    schema = pa.schema([("doc", pa.int64()), ("twin", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("part", pa.int64()), ("open", pa.binary()), ("window", pa.string()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        w = _unpack([b for b in table.column("open").to_pylist() if b is not None], n)
        lost, total, h = judge(w)
        known = [np.frombuffer(b, "<i8").reshape(4, -1) for b in table.column("lost").to_pylist() if b is not None]
        spans = [np.concatenate(x) for x in zip(_spans(w, np.flatnonzero(lost)), *known)]
        out = [pa.table({"doc": spans[0], "twin": spans[1].astype(np.int32), "lo": spans[2].astype(np.int32), "hi": spans[3].astype(np.int32)})]
        if part >= parts:
            keep = np.flatnonzero(~lost)
            later = _pack(w, keep, total, np.arange(len(keep)), (mix(h[keep]) % np.uint64(parts)).astype(np.int64))
            out.append(pa.table({"part": pa.array(list(later), pa.int64()), "open": pa.array(list(later.values()), pa.binary())}))
        elif counts:
            lead = np.flatnonzero(total > 0)
            blob = w.flat.tobytes()
            words = [blob[a:b].decode("utf-8", "replace") for a, b in zip(w.start[w.at[lead]].tolist(), w.end[w.at[lead] + n - 1].tolist())]
            out.append(pa.table({"doc": w.doc[lead], "window": pa.array(words, pa.string()), "n": total[lead]}))
        whole = pa.concat_tables([pa.table({f.name: t.column(f.name).cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema}) for t in out])
        return whole.cast(schema)

    return dealt.groupBy("part").applyInArrow(run, _JUDGED)


def _judged(base: DataFrame, n: int, counts: bool = False) -> tuple[DataFrame, DataFrame]:
    """The results of both meetings: of all windows, and again of those of hot minimisers."""
    if n < 2:
        raise ValueError("a window has two words or more")
    size = scan_bytes(base)
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    slots = min(max(SLOTS[0], 1 << int(size // SLOT_BYTES).bit_length()), SLOTS[1])
    dealt = _deal(base, n, parts, slots, hot_slots(base, n, slots))
    first = cut(_meet(dealt, n, parts, counts))
    second = cut(_meet(first.filter("open is not null").select("part", "open", F.lit(None).cast("binary").alias("lost")), n, parts, counts))
    return first, second


def window_counts(docs: DataFrame, n: int = N) -> DataFrame:
    """window (its words joined by one space), n (occurrences), first_doc_id: every window that occurs twice or more."""
    first, second = _judged(keyed(docs), n, True)
    found = first.unionByName(second).filter("window is not null and n > 1")
    return found.select("window", "n", F.when(F.col("doc") != LOWEST, F.col("doc")).alias("first_doc_id"))


def remove_windows(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one space); one row per row of ``docs``."""
    return _cut_words(docs, n, False)


def without_windows(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, text: the words left of each text, joined by one space."""
    return _cut_words(docs, n, True)


def _cut_words(docs: DataFrame, n: int, give_text: bool) -> DataFrame:
    base = keyed(docs)
    first, second = _judged(base, n)
    covered = first.select("doc", "twin", "lo", "hi").unionByName(second.select("doc", "twin", "lo", "hi")).filter("lo is not null")
    spans = cut(covered.groupBy("doc", "twin").agg(F.collect_list(F.col("lo").cast("long") * (1 << 31) + F.col("hi")).alias("spans")))
    release(first, second)
    schema = "doc_id long, text string" if give_text else "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def make():
        def kernel(cols):
            c = Words(cols["text"])
            flat, start, end = c.flat, c.first, c.last
            step = np.zeros(len(start) + 1, np.int64)
            for i, s in enumerate(cols["spans"]):
                if s:
                    s = np.array(s, np.int64)
                    np.add.at(step, c.w_lo[i] + (s >> 31), 1)
                    np.add.at(step, c.w_lo[i] + (s & ((1 << 31) - 1)), -1)
            gone = np.cumsum(step[:-1]) > 0
            stay = flat[np.repeat(~gone, end - start + 1)].tobytes()
            left = np.concatenate([[0], np.cumsum(np.where(gone, 0, end - start + 1))]).tolist()
            removed = np.concatenate([[0], np.cumsum(gone)])
            kept = [stay[left[a] : max(left[a], left[b] - 1)] for a, b in zip(c.w_lo.tolist(), c.w_hi.tolist())]
            out: dict = {"doc_id": [None if d == LOWEST else d for d in cols["doc"]]}
            if give_text:
                return out | {"text": [k.decode("utf-8", "replace") for k in kept]}
            return out | {"n_words": c.w_hi - c.w_lo, "n_removed": removed[c.w_hi] - removed[c.w_lo], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}

        return kernel

    return map_texts(base.join(spans, ["doc", "twin"], "left"), make, schema)
