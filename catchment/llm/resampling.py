"""Importance resampling towards a target distribution, over hashed features of one and two words.

Two passes over Arrow batches. The first counts features in buckets with np.bincount, one vector for each partition,
and treeReduce merges the vectors on the executors. The driver makes the buckets' gains (log ratios of target to source,
smoothed by one) of the two merged vectors and sends them along with the second pass, which gathers
them for each feature and sums them by document with bincount weights. Both vectors have BUCKETS entries
at any size. The draw adds Gumbel noise that depends on the document's id alone and takes the highest scores, ranked
by ranges of the order instead of in one task.

The CRC of a feature is made of its words' CRCs by the shift operators of the polynomial, so no feature is built as a
string. A null text has no words. A null id counts as the empty string in the noise and sorts below all others;
rows that share an id share its noise and are ranked by the fewer features first, equal rows in any order. Each row of
the input gives one row.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, cut, map_texts, pieces, scan_bytes

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of input for each range of the ranking.
PART_BYTES = 64 << 20
#: Words of up to so many bytes take the tables; longer ones are hashed one by one.
SHORT = 32

#: Bytes of words: digits, a to z, and all of other characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
# fixed value: the reflected polynomial of CRC-32
_POLYNOMIAL = 0xEDB88320
_SPACE = np.uint32(zlib.crc32(b" "))


def _shift(values: np.ndarray) -> np.ndarray:
    """CRC registers after one more byte of zeros."""
    for _ in range(8):
        values = (values >> np.uint32(1)) ^ np.where(values & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return values


_BYTE = _shift(np.arange(256, dtype=np.uint32))


def _operators() -> np.ndarray:
    """[n, k, b]: what byte b at place k of a register becomes n zero bytes later."""
    table = np.arange(256, dtype=np.uint32) << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    out = [table]
    for _ in range(SHORT):
        out.append(_shift(out[-1]))
    return np.stack(out)


_SHIFT = _operators()


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs of texts before n more bytes (n up to SHORT), as they enter the CRC of the whole."""
    m = np.uint32(255)
    return _SHIFT[n, 0, crc & m] ^ _SHIFT[n, 1, (crc >> np.uint32(8)) & m] ^ _SHIFT[n, 2, (crc >> np.uint32(16)) & m] ^ _SHIFT[n, 3, crc >> np.uint32(24)]


class Features:
    """The features of some texts: ``bucket`` and ``row`` (its text) of each, and the words of each text."""

    def __init__(self, texts: list[str | None]):
        blobs = [(t or "").encode("utf-8", "replace") for t in texts]
        data = LOWER[np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)]
        size = np.fromiter((len(b) for b in blobs), np.int64, len(blobs))
        solid = np.zeros(len(data) + 2, np.int8)
        solid[1:-1] = WORD[data]
        step = np.diff(solid)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        text_end = np.cumsum(size + 1) - 1
        self.words = np.diff(np.searchsorted(start, np.concatenate([[0], text_end])))
        row = np.repeat(np.arange(len(blobs)), self.words)
        length = end - start
        register = np.full(len(start), 0xFFFFFFFF, np.uint32)
        active = np.flatnonzero(length <= SHORT)
        for j in range(SHORT):
            active = active[length[active] > j]
            if not len(active):
                break
            register[active] = _BYTE[(register[active] ^ data[start[active] + j]) & np.uint32(255)] ^ (register[active] >> np.uint32(8))
        crc = ~register
        long = np.flatnonzero(length > SHORT)
        for i in long.tolist():
            crc[i] = zlib.crc32(data[start[i] : end[i]])
        pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else row
        spaced = _moved(crc, np.ones(len(crc), np.int64)) ^ _SPACE if len(crc) else crc
        second = _moved(spaced[pair], np.minimum(length[pair + 1], SHORT)) ^ crc[pair + 1]
        for k in np.flatnonzero(length[pair + 1] > SHORT).tolist():
            i = pair[k] + 1
            second[k] = zlib.crc32(data[start[i] : end[i]], int(spaced[i - 1]))
        self.bucket = np.concatenate([crc, second]) % np.uint32(BUCKETS)
        self.row = np.concatenate([row, row[pair]])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in pieces(texts):
                total += np.bincount(Features(texts[lo:hi]).bucket, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = docs.select("text").mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural log of each bucket's smoothed share in the target over that in the source, rounded down."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel number, rounded down, chosen by the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (mean gain of a text's features), score (weight and noise)."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))  # BUCKETS numbers

    def make():
        def kernel(cols):
            f, n = Features(cols["text"]), len(cols["text"])
            count = np.bincount(f.row, minlength=n)
            # gains are whole numbers, and their sums stay exact in doubles
            total = np.bincount(f.row, weights=gain.value[f.bucket], minlength=n).astype(np.int64)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            return {"doc_id": cols["doc_id"], "n_words": f.words, "n_features": count, "weight": weight, "score": weight + np.array([noise(d, seed) for d in cols["doc_id"]], np.int64)}

        return kernel

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the drawn texts are ranked from 1, the others have no rank.

    Drawn is ``percent`` of the texts with ``least_words`` words or more.
    """
    scored = weights(docs, target, seed).withColumn("late", F.col("n_words") < least_words)
    order = [F.asc("late"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")]
    parts = max(4, scan_bytes(docs) // PART_BYTES)
    placed = cut(scored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(~F.col("late")).alias("eligible")).collect()  # a row for each range
    quota = sum(r.eligible for r in sizes) * percent // 100
    base, total = [], 0
    for r in sorted(sizes, key=lambda r: r.part):
        base.append((r.part, total))
        total += r.n
    offset = docs.sparkSession.createDataFrame(base, "part int, base long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("base")
    ranked = placed.join(F.broadcast(offset), "part").withColumn("place", place)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= quota, F.col("place")).cast("long").alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (each column) whose ids are drawn."""
    ids = resample(docs, target, percent, least_words, seed).filter("rank is not null").select("doc_id").distinct()
    return docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("i.doc_id")), "left_semi")
