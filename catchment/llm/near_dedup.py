"""MinHash near-duplicate detection on word shingles.

One pass over the texts hashes each set of shingles once (one-permutation hashing): a shingle falls into
one of the slots and the slot keeps its minimum; empty slots borrow by optimal densification. Slots form
bands, and documents whose bands agree share a bucket. Equal sets are one node from then on, so exact
copies cost one row each. Within a bucket candidate edges are stars: members get tiers by a hash, tier r
having about 4**r members, and in round r the members of tier r are compared with the members above, but
only across components not yet joined. So a bucket of near copies ends after its first star, while a
bucket of strangers is still compared completely; no bucket or partner is capped. A pair leaves the
bucket's join only if its sketches allow the similarity: each shingle flips one of SKETCH bits, so the bits
in which two sketches differ are at most the shingles in which the sets differ. Pairs just below the
threshold end there. Every link is confirmed on full sets, exactly.

Rows with a null id or without words are linked with nothing (component_id is their own id). Rows that
share an id count as one document with several sets. n_shingles is each row's own set size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, cut, first_of, gram_hash, map_texts, mix
from .components import merge_components

SLOTS = 256
#: A pair right at the threshold may miss all bands with at most this probability.
MISS = 1e-5
#: Bits of a sketch; a multiple of 64.
SKETCH = 1024


def banding(percent: int, slots: int = SLOTS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the longest bands whose miss probability at the threshold stays below ``miss``."""
    t = percent / 100
    rows = max([r for r in range(1, 33) if (1 - t**r) ** (slots // r) <= miss], default=1)
    return slots // rows, rows


def shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of each text, in order of text."""
    c = Chunk(texts, lower=True)
    c.words()
    grams = gram_hash(c.w_hash, words)
    inside = np.flatnonzero(c.w_doc[: len(grams)] == c.w_doc[words - 1 :]) if len(grams) else np.empty(0, np.int64)
    count = c.w_hi - c.w_lo
    h, doc = [grams[inside]], [c.w_doc[inside]]
    for m in range(1, words):
        short = np.flatnonzero(count == m)
        g = np.full(len(short), m, np.uint64)
        for k in range(m):
            g = mix(g ^ c.w_hash[c.w_lo[short] + k])
        h.append(g)
        doc.append(short)
    h, doc = np.concatenate(h), np.concatenate(doc)
    order, fresh = first_of(mix(h ^ mix(doc.astype(np.uint64))))
    one = np.sort(order[fresh])
    h, doc = h[one], doc[one]
    by = np.argsort(doc, kind="stable")
    return h[by], doc[by]


_EMPTY = np.uint32(0xFFFFFFFF)


def signatures(h: np.ndarray, doc: np.ndarray, n: int, slots: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification; a row without shingles stays empty."""
    x = mix(h ^ np.uint64(0x1F83D9ABFB41BD6B))
    slot = ((x >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
    sig = np.full(n * slots, _EMPTY)
    np.minimum.at(sig, doc * slots + slot.astype(np.int64), x.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    sig = sig.reshape(n, slots)
    filled = sig != _EMPTY
    row, col = np.nonzero(~filled & filled.any(1)[:, None])
    for attempt in range(1, 33):
        if not len(row):
            return sig
        to = ((mix((col * 64 + attempt).astype(np.uint64)) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        ok = filled[row, to]
        sig[row[ok], col[ok]] = sig[row[ok], to[ok]]
        row, col = row[~ok], col[~ok]
    # small sets: the filled slot that comes first in the empty slot's own order of all slots
    order = mix(np.arange(slots * slots, dtype=np.uint64)).reshape(slots, slots)
    for lo in range(0, len(row), 4096):
        r, k = row[lo : lo + 4096], col[lo : lo + 4096]
        sig[r, k] = sig[r, np.where(filled[r], order[k], np.iinfo(np.uint64).max).argmin(1)]
    return sig


def _digest(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
    return (total[hi] - total[lo]).view(np.int64)


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), bits (parity sketch), bands (null for an empty set)."""
    bands, rows = banding(percent)

    def make():
        def kernel(cols):
            n = len(cols["text"])
            h, doc = shingles(cols["text"], words)
            cuts = np.searchsorted(doc, np.arange(n + 1))
            size = np.diff(cuts)
            sig = signatures(h, doc, n, bands * rows).reshape(n, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands))
            for r in range(rows):
                key = mix(key ^ mix(sig[:, :, r] + np.uint64(r << 32)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(np.ascontiguousarray(key).view(np.int64).ravel()), mask=pa.array(size == 0))
            odd = np.bincount(doc * SKETCH + (mix(h ^ np.uint64(3)) % np.uint64(SKETCH)).astype(np.int64), minlength=n * SKETCH).astype(np.uint8) & 1
            bits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (SKETCH // 64), pa.int32()), pa.array(np.packbits(odd).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.array(size), pa.array(_digest(h, cuts[:-1], cuts[1:], 1)), pa.array(_digest(h, cuts[:-1], cuts[1:], 2)), bits, lists], names=["doc_id", "n", "d1", "d2", "bits", "bands"])

        return kernel

    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, n long, d1 long, d2 long, bits array<long>, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, shingles of the texts of the given nodes."""

    def make():
        def kernel(cols):
            h, doc = shingles(cols["text"], words)
            cuts = np.searchsorted(doc, np.arange(len(cols["text"]) + 1))
            return pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h.view(np.int64)))], names=["node", "shingles"])

        return kernel

    wanted = docs.select("doc_id", "text").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return map_texts(wanted, make, "node long, shingles array<long>")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``, linked if 100 * intersection >= percent * union."""
    signed = cut(_signed(docs, words, percent))
    some = signed.filter("n > 0 and doc_id is not null")
    classes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"))
    firsts = some.join(classes.select(F.col("node").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi").withColumnRenamed("doc_id", "node")
    banded = firsts.select("node", "n", F.explode("bands").alias("key"))
    rank = F.xxhash64("node", "key")
    shared = banded.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.min(rank).alias("least")).filter("lo < hi").select("key", "m", "least")
    share = (rank.cast("double") / 2.0**64 + 0.5) * F.col("m")
    tier = F.when(rank == F.col("least"), 0).otherwise(1 + F.greatest(F.lit(0), F.floor(F.log(share) / math.log(4)))).cast("int")
    members = cut(banded.join(shared, "key").select("key", "node", "n", tier.alias("tier")).join(firsts.select("node", "bits").distinct(), "node"))
    nodes = cut(members.select("node").distinct())
    last = members.agg(F.max("tier")).first()[0]
    comp = nodes.select("node", F.col("node").alias("comp"))
    if last is not None:
        sets = cut(_sets(docs, nodes, words))
        for r in range(last + 1):
            now = members.filter(F.col("tier") >= r).join(comp, "node") if r else members.withColumn("comp", F.col("node"))
            if r:
                # of a bucket only this round's hubs go on, and the members that a hub of another component still has to meet
                seen = F.when(F.col("tier") == r, F.col("comp"))
                mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(seen).alias("hub_lo"), F.max(seen).alias("hub_hi")).filter("lo < hi and hub_lo is not null")
                mixed = mixed.select(F.col("key").alias("at"), "hub_lo", "hub_hi")
                meets = (F.col("tier") == r) | (F.col("comp") != F.col("hub_lo")) | (F.col("comp") != F.col("hub_hi"))
                now = cut(now.join(mixed, (F.col("key") == F.col("at")) & meets, "left_semi"))
            hub = now.filter(F.col("tier") == r).select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("bits").alias("ba"))
            near = (F.col("comp") != F.col("ca")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na")) & ((F.col("tier") > r) | (F.col("node") > F.col("a")))
            differ = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("ba")[k])) for k in range(SKETCH // 64)), F.lit(0))
            near = near & (differ <= F.col("n") + F.col("na") - 2 * F.ceil((F.col("n") + F.col("na")) * percent / (100.0 + percent) - 1e-9))
            pairs = now.join(hub, "key").filter(near).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
            pairs = cut(pairs)
            if not pairs.take(1):
                continue
            both = F.size(F.array_intersect("sa", "sb"))
            confirmed = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")
            comp = merge_components(comp, confirmed.distinct())
    label = classes.join(comp, "node", "left").select("d1", "d2", F.coalesce("comp", "node").alias("comp"))
    labelled = signed.join(label, ["d1", "d2"], "left")
    ids = labelled.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("comp")), "doc_id").alias("component_id"))
    return _one_component(cut(ids)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _one_component(ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id, n_shingles, component_id) with the components of each id's rows joined."""
    spread = ids.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).filter("a < b").select("doc_id", "a")
    if not spread.take(1):
        return ids
    links = cut(ids.join(spread, "doc_id").filter("component_id <> a").select("a", F.col("component_id").alias("b")).distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    joined = merge_components(nodes.select("node", F.col("node").alias("comp")), links).select(F.col("node").alias("component_id"), "comp")
    return ids.join(joined, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "component_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is its group's first; all columns kept."""
    gone = near_duplicates(docs, words, percent).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
