"""SimHash fingerprints of documents.

Terms are pairs of neighbouring words, lower-cased (the word itself where there is but one); a term
votes on each of BITS signed bits of its hash, weighted by the square root of its length, once for each
occurrence. A fingerprint is written as hexadecimal. A null text counts as empty; an empty text has the
zero fingerprint. Equal texts have equal fingerprints, repeated rows equal results.

``within_radius`` finds all pairs of distinct fingerprints within a Hamming radius by permuted block
tables: a table for each choice of blocks that must agree, so no pair within the radius is missed.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import LOWER, Chunk, cut, gram_hash, map_texts, mix, pieces, scan_bytes

BITS = 128
#: Bytes of input for each range of ids.
RANGE_BYTES = 16 << 20
_HALF = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1


def simhash(texts: list[str | None], bits: int = BITS) -> np.ndarray:
    """Rows of bits // 8 bytes."""
    n = len(texts)
    c = Chunk(texts)
    c.data = LOWER[c.data]
    c.words()
    size = (c.w_end - c.w_start).astype(float)
    pair = gram_hash(c.w_hash, 2)
    inside = np.flatnonzero(c.w_doc[:-1] == c.w_doc[1:])
    alone = c.w_lo[c.w_hi - c.w_lo == 1]
    term = np.concatenate([pair[inside], c.w_hash[alone]])
    doc = np.concatenate([c.w_doc[inside], c.w_doc[alone]])
    weight = np.sqrt(np.concatenate([size[inside] + size[inside + 1], size[alone]]))
    cell = doc * 256
    votes = []
    for half in range(bits // 64):
        h = mix(term ^ _HALF[half])
        for byte in range(8):
            count = np.bincount(cell + ((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64), weight, n * 256)
            votes.append(count.reshape(n, 256) @ _SIGNS)
    return np.packbits(np.hstack(votes) > 0, axis=1) if n else np.zeros((0, bits // 8), np.uint8)


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine of the term vectors from the share of differing bits; 0 where it would be negative."""
    apart = _ONES[a ^ b].sum(1) / (a.shape[1] * 8)
    return np.maximum(0.0, np.cos(np.pi * apart))


def fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (hexadecimal)."""

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "fingerprint": [r.tobytes().hex() for r in simhash(cols["text"], bits)]}

    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, fingerprint string")


def within_radius(prints: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """All pairs (left, right, distance) of distinct fingerprints at most ``radius`` bits apart, left < right.

    ``prints`` has a column fingerprint; equal ones count once, so copies never multiply. With b blocks
    there is a table for each choice of b - radius blocks; in one of them any such pair agrees.
    """
    one = prints.select("fingerprint").filter("fingerprint is not null").distinct()
    blocks = blocks or radius + 2
    digits = F.length("fingerprint")

    def block(i: int):
        lo, hi = F.floor(digits * i / blocks), F.floor(digits * (i + 1) / blocks)
        return F.substring(F.col("fingerprint"), (lo + 1).cast("int"), (hi - lo).cast("int"))

    tables = [F.concat_ws("-", F.lit(str(k)), *[block(i) for i in chosen]) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    keyed = one.withColumn("key", F.explode(F.array(*tables)))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    keyed = keyed.join(shared, "key")
    # distinct fingerprints differ in some digit; bits of differing hexadecimal digits are counted in 8-digit words
    words = F.transform(
        F.sequence(F.lit(0), (F.length("left") / 8 - 1).cast("int")),
        lambda i: F.bit_count(F.conv(F.substring(F.col("left"), i * 8 + 1, F.lit(8)), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(F.col("right"), i * 8 + 1, F.lit(8)), 16, 10).cast("long"))),
    )
    pairs = keyed.withColumnRenamed("fingerprint", "left").join(keyed.withColumnRenamed("fingerprint", "right"), "key").filter("left < right")
    return pairs.select("left", "right").distinct().withColumn("distance", F.aggregate(words, F.lit(0), lambda a, x: a + x)).filter(F.col("distance") <= radius)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = "part int, edge string, text string"


def _edited(ids: list, texts: list[str], after: list[str], prints: np.ndarray, after_prints: np.ndarray, bits: int) -> dict:
    """The columns of SCHEMA for texts, the texts that follow them, and the fingerprints of both."""
    cut_ = [len(t) // 3 for t in texts]
    edited = [t[: len(t) - k] + n[:k] for t, k, n in zip(texts, cut_, after)]
    other = simhash(edited, bits)
    return {
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "edited_sha256": [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited],
        "fingerprint": [r.tobytes().hex() for r in prints], "edited_fingerprint": [r.tobytes().hex() for r in other], "near_edited": likeness(prints, other), "near_next": likeness(prints, after_prints),
    }


def edited_fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third comes from the next document (descending id).

    Rows are sorted by id in ranges, so that the next document is the row before; rows of equal id are ordered by text and lie in one range, a null id sorts below all
    others, and after the last document comes the first. Of each range the first row and the text of the last go on to meet
    those of the ranges beside it.
    """
    whole = to_arrow_schema(StructType.fromDDL(f"{SCHEMA}, {_EDGES}"))

    def batch(columns: dict, rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in whole], schema=whole)

    def in_range(batches):
        part, before, before_print, last = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            texts, ids = [t or "" for t in b.column("text").to_pylist()], b.column("doc_id").to_pylist()
            for lo, hi in pieces(texts, 1 << 20):
                prints = simhash(texts[lo:hi], bits)
                if before is None:
                    yield batch({"doc_id": [ids[lo]], "part": [part], "edge": ["first"], "text": [texts[lo]]}, 1)
                rows = list(range(lo + (before is None), hi))
                after = [texts[i - 1] if i > lo else before for i in rows]
                after_prints = np.array([prints[i - lo - 1] if i > lo else before_print for i in rows]).reshape(len(rows), bits // 8)
                if rows:
                    yield batch(_edited([ids[i] for i in rows], [texts[i] for i in rows], after, prints[rows[0] - lo :], after_prints, bits), len(rows))
                before, before_print, last = texts[hi - 1], prints[-1], ids[hi - 1]
        if before is not None:
            yield batch({"doc_id": [last], "part": [part], "edge": ["last"], "text": [before]}, 1)

    def across(batches):
        for b in batches:
            texts, after = b.column("text").to_pylist(), b.column("after").to_pylist()
            yield pa.RecordBatch.from_pydict(_edited(b.column("doc_id").to_pylist(), texts, after, simhash(texts, bits), simhash(after, bits), bits))

    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), scan_bytes(docs) // RANGE_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    done = cut(ranges.mapInArrow(in_range, f"{SCHEMA}, {_EDGES}"))
    firsts, lasts = done.filter("edge = 'first'").select("doc_id", "part", "text"), done.filter("edge = 'last'").select(F.col("part").alias("lower"), F.col("text").alias("after"))
    order = Window.orderBy("part")  # a number for each range
    lower = firsts.select("part", F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy())).alias("lower"))
    edges = firsts.join(lower, "part").join(lasts, "lower").select("doc_id", "text", "after")
    return done.filter("edge is null").select(*[f.split()[0] for f in SCHEMA.split(", ")]).unionByName(edges.mapInArrow(across, SCHEMA))
