"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller doc_id, or earlier in
the same document). Sorting every suffix of the corpus would move a hundred times its size, so suffixes
are first thinned without loss: anchors are positions chosen by content alone, such that each string of
LENGTH bytes holds an anchor and its equal strings hold the same one. Anchors meet by hash (contexts by 122 bits):

* An anchor whose whole context (all strings through it) occurs earlier is settled: all of them repeat.
* An anchor whose first GRAM bytes occur nowhere else with another context is settled: none repeats.
* The others - borders of repeats - are contested. Each task sorts the suffixes at its contested anchors
  into front-coded runs (length shared with the suffix before, then the new bytes); runs that begin alike
  meet in one task, where a loser tree merges them. The tree keeps for each entry the prefix it shares
  with the last output, so known prefixes are never compared again, and it yields the shared prefixes of
  the merged order. These cut the order into classes of equal right sides for each depth; with the
  hashes of the left sides they tell which strings through an anchor start earlier elsewhere.

Copies of a passage within a chunk of rows leave one row before the first exchange. A null text is empty.
A null id sorts below all others; rows that share an id are ordered by text, and rows equal in both are
one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWEST, Chunk, cut, first_of, keyed, map_texts, mix, prefix_hash, scan_bytes, span_hash

LENGTH = 100
GRAM = 24
#: Grams in a string of LENGTH bytes; also one more than the furthest an anchor lies from its string's start.
WINDOW = LENGTH - GRAM + 1
#: Bytes of text whose suffixes form a run.
RUN_BYTES = CHUNK_BYTES
#: Bytes of input for each group of anchors that meets in one task.
PART_BYTES = 16 << 20
_TOP = np.uint32(0xFFFFFFFF)
SALT = np.uint64(0xD6E8FEB86659FD93)


def _sliding(values: np.ndarray, width: int, op, fill) -> np.ndarray:
    """op over values[i : i + width] for each full window, in time that does not depend on the width."""
    m = len(values) - width + 1
    rows = np.full(-(-len(values) // width) * width, fill, values.dtype)
    rows[: len(values)] = values
    rows = rows.reshape(-1, width)
    ahead = op.accumulate(rows, axis=1).ravel()
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:m], ahead[width - 1 : width - 1 + m])


def anchors(c: Chunk, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the chunk, text) of the anchors: grams whose hash is least in some window of WINDOW grams."""
    n = len(c.data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(n - GRAM + 1)
    h = (span_hash(prefix, at, at + GRAM) >> np.uint64(32)).astype(np.uint32)
    inside = np.zeros(n + 1, np.int32)
    long = c.size >= LENGTH
    np.add.at(inside, c.start[long], 1)
    np.add.at(inside, c.end[long] - GRAM + 1, -1)
    h[np.cumsum(inside[: len(h)]) == 0] = _TOP
    least = _sliding(h, WINDOW, np.minimum, _TOP)
    padded = np.zeros(len(h) + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 : WINDOW - 1 + len(least)] = least
    pos = np.flatnonzero((_sliding(padded, WINDOW, np.maximum, 0) == h) & (h != _TOP))
    return pos, np.searchsorted(c.start, pos, "right") - 1


def _anchor_blobs(docs: DataFrame, parts: int) -> DataFrame:
    """part, blob: anchors of a chunk dealt by gram; kind 1 rows are copies within the chunk, dealt by document."""

    def make():
        def kernel(cols):
            c = Chunk(cols["text"])
            prefix = prefix_hash(c.data)
            pos, row = anchors(c, prefix)
            doc, twin = np.array(cols["doc"], np.int64), np.array(cols["twin"], np.int64)
            lo, hi = np.maximum(pos - (WINDOW - 1), c.start[row]), np.minimum(pos + LENGTH, c.end[row])
            shape = ((pos - lo) * 1000 + (hi - pos)).astype(np.uint64)
            context = mix(span_hash(prefix, lo, hi) ^ shape)
            more = mix(span_hash(prefix_hash(c.data, 1), lo, hi, 1) ^ shape)
            gram = span_hash(prefix, pos, pos + GRAM)
            own = pos - c.start[row]
            order = np.lexsort((own, twin[row], doc[row], more, context)) if len(pos) else np.empty(0, np.int64)
            again = np.zeros(len(pos), bool)
            again[order[1:]] = (context[order[1:]] == context[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
            part = np.where(again, mix(doc[row].view(np.uint64)), gram) % np.uint64(parts)
            by = np.lexsort((own, twin[row], doc[row], again, part))
            held, begin = np.unique(part[by], return_index=True)
            out = {"part": [], "blob": []}
            for p, lo_, hi_ in zip(held.tolist(), begin.tolist(), [*begin[1:].tolist(), len(by)]):  # the parts present alone
                s = by[lo_:hi_]
                k = int((~again[s]).sum())
                first, d = s[:k], doc[row[s]]
                step = np.concatenate([d[:1], np.diff(d[:k]), d[k : k + 1] if k else [], np.diff(d[k:])]) if k else np.concatenate([d[:1], np.diff(d)])
                g = gram[first] >> np.uint64(24)
                columns = [step.astype("<i8"), twin[row[s]].astype("<i4"), own[s].astype("<i4"), (g & np.uint64(0xFFFFFFFF)).astype("<u4"), (g >> np.uint64(32)).astype("<u1"), context[first].astype("<u8"), more[first].astype("<u8")]
                out["part"].append(p)
                out["blob"].append(np.array([len(s), k], "<i8").tobytes() + b"".join(x.tobytes() for x in columns))
            return out

        return kernel

    return map_texts(docs, make, "part int, blob binary", limit=RUN_BYTES)


def _read_blob(b: bytes):
    n, k = np.frombuffer(b, "<i8", 2).tolist()
    at, out = 16, []
    for kind, m in (("<i8", n), ("<i4", n), ("<i4", n), ("<u4", k), ("<u1", k), ("<u8", k), ("<u8", k)):
        out.append(np.frombuffer(b, kind, m, at))
        at += m * int(kind[2])
    step, twin, pos, low, high, context, more = out
    doc = np.concatenate([np.cumsum(step[:k]), np.cumsum(step[k:])]) if k else np.cumsum(step)
    return doc, twin, pos, low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), context, more, k


def _settle(blobs: DataFrame) -> DataFrame:
    """doc, twin, pos, contested: anchors that repeat as a whole, and those that need the sort."""

    def run(table: pa.Table) -> pa.Table:
        got = [_read_blob(b) for b in table.column("blob").to_pylist()]
        doc, twin, pos = (np.concatenate([g[i][: g[6]] for g in got]) for i in range(3))
        copies = [np.concatenate([g[i][g[6] :] for g in got]) for i in range(3)]
        gram, context, more = (np.concatenate([g[i] for g in got]) for i in (3, 4, 5))
        order = np.lexsort((pos, twin, doc, more, context))
        doc, twin, pos, gram, context, more = (x[order] for x in (doc, twin, pos, gram, context, more))
        begins = np.concatenate([[True], (context[1:] != context[:-1]) | (more[1:] != more[:-1])])
        lead = np.maximum.accumulate(np.where(begins, np.arange(len(context)), 0)) if len(context) else np.empty(0, np.int64)
        covered = (doc != doc[lead]) | (twin != twin[lead]) | (pos != pos[lead])
        leads = np.flatnonzero(lead == np.arange(len(lead)))
        by, fresh = first_of(gram[leads])
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        contested = np.zeros(len(doc), bool)
        contested[leads[by[shared]]] = True
        rows = np.flatnonzero(covered | contested)
        cols = [np.concatenate([x[rows], y]) for x, y in zip((doc, twin, pos), copies)]
        return pa.table({"doc": cols[0], "twin": cols[1].astype(np.int32), "pos": cols[2].astype(np.int32), "contested": np.concatenate([contested[rows], np.zeros(len(copies[0]), bool)])})

    return blobs.groupBy("part").applyInArrow(run, "doc long, twin int, pos int, contested boolean")


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, bytes]:
    """(shared lengths, new bytes) of sorted suffixes."""
    if not suffixes:
        return np.empty(0, np.uint8), b""
    size = np.array([len(s) for s in suffixes])
    wide = np.zeros((len(suffixes), LENGTH + 1), np.uint8)
    wide[np.arange(LENGTH + 1) < size[:, None]] = np.frombuffer(b"".join(suffixes), np.uint8)
    differ = wide[1:] != wide[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), LENGTH)
    shared = np.concatenate([[0], np.minimum(shared, np.minimum(size[1:], size[:-1]))])
    return shared.astype(np.uint8), b"".join(s[k:] for s, k in zip(suffixes, shared.tolist()))


def _runs(docs: DataFrame, contested: DataFrame, parts: int) -> DataFrame:
    """part, run: each chunk's suffixes at contested anchors as sorted front-coded runs, with their left sides."""
    spots = contested.groupBy("doc", "twin").agg(F.collect_list("pos").alias("spots"))

    def make():
        def kernel(cols):
            c = Chunk(cols["text"])
            n = [len(s) for s in cols["spots"]]
            row = np.repeat(np.arange(len(n)), n)
            pos = c.start[row] + np.array([p for s in cols["spots"] for p in s], np.int64)
            part = (span_hash(prefix_hash(c.data), pos, pos + GRAM) % np.uint64(parts)).astype(np.int64)
            blob = c.data.tobytes()
            right = [blob[a:b] for a, b in zip(pos.tolist(), np.minimum(pos + LENGTH, c.end[row]).tolist())]
            doc, twin = np.array(cols["doc"], np.int64)[row], np.array(cols["twin"], np.int32)[row]
            out: dict = {"part": [], "run": []}
            todo: dict[int, list[int]] = {}
            for i, p in enumerate(part.tolist()):
                todo.setdefault(p, []).append(i)
            for p, items in todo.items():
                items.sort(key=right.__getitem__)
                at = np.array(items)
                shared, new = front_code([right[i] for i in items])
                left = [blob[a:b] for a, b in zip(np.maximum(pos[at] - (WINDOW - 1), c.start[row[at]]).tolist(), pos[at].tolist())]
                columns = [doc[at].astype("<i8"), twin[at].astype("<i4"), (pos[at] - c.start[row[at]]).astype("<i4"), np.array([len(right[i]) for i in items], "<u1"), shared, np.array([len(x) for x in left], "<u1")]
                out["part"].append(p)
                out["run"].append(np.array([len(at), len(new)], "<i8").tobytes() + b"".join(x.tobytes() for x in columns) + new + b"".join(left))
            return out

        return kernel

    return map_texts(docs.join(spots, ["doc", "twin"]), make, "part int, run binary", limit=RUN_BYTES)


class Run:
    """A front-coded run being read."""

    def __init__(self, b: bytes):
        n, new = np.frombuffer(b, "<i8", 2).tolist()
        at, got = 16, []
        for kind in ("<i8", "<i4", "<i4", "<u1", "<u1", "<u1"):
            got.append(np.frombuffer(b, kind, n, at))
            at += n * int(kind[2])
        self.doc, self.twin, self.pos, self.right, shared, self.left_size = got
        self.shared = shared.tolist()
        self.sizes = self.right.tolist()
        self.new, self.left = b[at : at + new], b[at + new :]
        self.n, self.next, self.at, self.text = n, 0, 0, b""

    def advance(self) -> int:
        """Moves to the next suffix; its prefix shared with the one before, or -1 at the end."""
        i = self.next
        if i >= self.n:
            self.text = None
            return -1
        k = self.shared[i]
        end = self.at + self.sizes[i] - k
        self.text = self.text[:k] + self.new[self.at : end]
        self.at, self.next = end, i + 1
        return k


def _beats(a: Run, b: Run, known: int) -> tuple[bool, int]:
    """Whether a comes before b, both sharing ``known`` bytes, and how many they share in all."""
    s, t = a.text, b.text
    m = min(len(s), len(t))
    if s[known:m] == t[known:m]:
        return len(s) <= len(t), m
    while s[known] == t[known]:
        known += 1
    return s[known] < t[known], known


def merge_runs(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in it, bytes shared with the one before) of the merged order, by a loser tree over known prefixes."""
    k = len(runs)
    share = [0] * k
    total = sum(r.n for r in runs)
    who, shared = np.empty(total, np.int32), np.empty(total, np.int32)
    for r in runs:
        r.advance()
    if k == 1:
        return np.zeros(total, np.int32), np.arange(total), np.array(runs[0].shared, np.int32)
    loser = [-1] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two entries; the loser learns what it shares with the winner."""
        if runs[i].text is None or runs[j].text is None:
            return (j, i) if runs[i].text is None else (i, j)
        if share[i] != share[j]:
            return (i, j) if share[i] > share[j] else (j, i)
        first, both = _beats(runs[i], runs[j], share[i])
        win, lose = (i, j) if first else (j, i)
        share[lose] = both
        return win, lose

    def seed(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = play(seed(2 * node), seed(2 * node + 1))
        return win

    best = seed(1)
    for out in range(total):
        who[out], shared[out] = best, share[best]
        share[best] = runs[best].advance()
        node = (best + k) >> 1
        while node:
            best, loser[node] = play(best, loser[node])
            node >>= 1
    place = np.empty(total, np.int64)
    by = np.argsort(who, kind="stable")
    counts = np.bincount(who, minlength=k)
    place[by] = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return who, place, shared


def _verdicts(runs: DataFrame) -> DataFrame:
    """doc, twin, lo, hi: the bytes that each contested anchor's repeated strings cover."""

    def run(table: pa.Table) -> pa.Table:
        got = [Run(b) for b in table.column("run").to_pylist()]
        who, place, shared = merge_runs(got)
        base = np.concatenate([[0], np.cumsum([r.n for r in got])])[who] + place
        doc, twin, pos, right, size = (np.concatenate([getattr(r, x) for r in got])[base] for x in ("doc", "twin", "pos", "right", "left_size"))
        flat = np.frombuffer(b"".join(r.left for r in got) + b"\0", np.uint8)  # never empty: all anchors may begin their texts
        ends = np.cumsum(np.concatenate([r.left_size for r in got]).astype(np.int64))[base]
        by = np.lexsort((pos, twin, doc))  # from here in order of the corpus
        lo, hi = np.full(len(by), np.iinfo(np.int32).max, np.int64), np.full(len(by), -1, np.int64)
        h = np.zeros(len(by), np.uint64)
        for j in range(WINDOW):
            if j:
                h = mix(h ^ flat[np.maximum(ends - j, 0)].astype(np.uint64))
            depth = LENGTH - j
            ok = by[(size[by] >= j) & (right[by] >= depth)]
            if not len(ok):
                continue
            side = np.cumsum(shared < depth).astype(np.uint64)
            order, fresh = first_of(mix(mix(h[ok] ^ SALT) ^ side[ok]))  # salted: a byte and a class must not change places
            group = np.cumsum(fresh) - 1
            lead = ok[order[fresh]][group]
            item = ok[order]
            later = (doc[item] != doc[lead]) | (twin[item] != twin[lead]) | (pos[item] != pos[lead])
            hit = item[later]
            lo[hit] = np.minimum(lo[hit], pos[hit] - j)
            hi[hit] = np.maximum(hi[hit], pos[hit] - j + LENGTH)
        rows = np.flatnonzero(hi >= 0)
        return pa.table({"doc": doc[rows], "twin": twin[rows].astype(np.int32), "lo": lo[rows].astype(np.int32), "hi": hi[rows].astype(np.int32)})

    return runs.groupBy("part").applyInArrow(run, "doc long, twin int, lo int, hi int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, twin, lo, hi: byte ranges (overlapping, end perhaps beyond the text) that repeat earlier strings."""
    parts = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), scan_bytes(docs) // PART_BYTES)
    settled = cut(_settle(_anchor_blobs(docs, parts)))
    sorted_out = _verdicts(_runs(docs, settled.filter("contested"), parts))
    whole = settled.filter("not contested").select("doc", "twin", F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0)).alias("lo"), (F.col("pos") + LENGTH).alias("hi"))
    return whole.unionByName(sorted_out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per row of ``docs``."""
    return _cut_texts(docs, False)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: what is left of each text; bytes of a character cut in two become U+FFFD."""
    return _cut_texts(docs, True)


def _cut_texts(docs: DataFrame, give_text: bool) -> DataFrame:
    base = keyed(docs)
    spans = repeated_spans(base).groupBy("doc", "twin").agg(F.collect_list(F.col("lo").cast("long") * (1 << 31) + F.col("hi")).alias("spans"))
    schema = "doc_id long, text string" if give_text else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def make():
        def kernel(cols):
            out: dict = {x.split()[0]: [] for x in schema.split(", ")}
            for doc, text, spans in zip(cols["doc"], cols["text"], cols["spans"]):
                data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
                gone = np.zeros(len(data), bool)
                if spans:
                    s = np.array(spans, np.int64)
                    step = np.zeros(len(data) + 1, np.int64)
                    np.add.at(step, np.minimum(s >> 31, len(data)), 1)
                    np.add.at(step, np.minimum(s & ((1 << 31) - 1), len(data)), -1)
                    gone = np.cumsum(step[:-1]) > 0
                kept = data[~gone].tobytes()
                out["doc_id"].append(None if doc == LOWEST else doc)
                if give_text:
                    out["text"].append(kept.decode("utf-8", "replace"))
                else:
                    out["n_bytes"].append(len(data))
                    out["n_removed"].append(int(gone.sum()))
                    out["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            return out

        return kernel

    return map_texts(base.join(spans, ["doc", "twin"], "left"), make, schema)
