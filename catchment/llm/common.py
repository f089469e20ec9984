"""Shared helpers of the text operators: batches of texts as byte arrays, hashing, keys, training rows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..checkpoints import checkpoint_dir, marks, seen_in, with_seen  # noqa: F401
from ..checkpoints import materialize as cut  # noqa: F401
from ..checkpoints import release as _release

#: Word separators of every operator here: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one numpy step works on.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000
#: Stands for a null id in orderings.
LOWEST = -(1 << 63)

#: Text operators shuffle several times their input, so the files of a finished step go before the next begins.
release = functools.partial(_release, collect=True)

_R = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64."""
    h = h + _R
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def paired(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Hashes of pairs of a hash and a small number. The product keeps them apart: a hash may itself be the mix of a small number (a text of one byte), and two of those must not change places."""
    return mix(h * _M1 ^ mix(number.astype(np.uint64)))


#: Spans of bytes are hashed as polynomials modulo this prime: no family of texts collides whatever the base.
PRIME = np.uint64((1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_S1, _S30, _S31, _S61 = (np.uint64(k) for k in (1, 30, 31, 61))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x of 64 bits."""
    x = (x & PRIME) + (x >> _S61)
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, both reduced; products are made of halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _S1) + (middle >> _S30) + ((middle & _LOW30) << _S31) + a0 * b0)


class Powers:
    """Powers of a base (as halves of 32 bits) and of its inverse modulo PRIME, grown on demand, by steps, and kept for a worker."""

    STEP = 1 << 18

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, int(PRIME))
        self.low = self.high = np.empty(0, np.uint32)
        self.down = np.empty(0, np.uint64)

    def grow(self, n: int) -> None:
        had = len(self.down)
        if n <= had:
            return
        size = -(-n // self.STEP) * self.STEP if n > 1 << 16 else 1 << 16
        low, high, down = np.empty(size, np.uint32), np.empty(size, np.uint32), np.empty(size, np.uint64)
        low[:had], high[:had], down[:had] = self.low, self.high, self.down
        first = np.ones(1, np.uint64), np.ones(1, np.uint64)
        while len(first[0]) < min(size, 1 << 16):
            first = tuple(np.concatenate([p, times(p, np.uint64(pow(b, len(p), int(PRIME))))]) for p, b in zip(first, (self.base, self.inverse)))
        for at in range(had, size, len(first[0])):
            end = min(size, at + len(first[0]))
            up, back = (times(p[: end - at], np.uint64(pow(b, at, int(PRIME)))) for p, b in zip(first, (self.base, self.inverse)))
            low[at:end], high[at:end], down[at:end] = up & _LOW31, up >> _S31, back
        self.low, self.high, self.down = low, high, down


# fixed values: two bases drawn once
POWERS = Powers(0x0545F4914F6CDD1D), Powers(0x19E3779B97F4A7C3)


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Running sums over data of byte times power, for both halves of the powers; spans are then hashed by ``span_hash``."""
    powers = POWERS[which]
    powers.grow(len(data) + 1)
    out = np.zeros((2, len(data) + 1), np.uint64)
    d = data.astype(np.uint64) + np.uint64(1)
    np.cumsum(d * powers.low[: len(d)], out=out[0, 1:])
    np.cumsum(d * powers.high[: len(d)], out=out[1, 1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Position-independent 64-bit hashes of the spans [start, end), mixed from 61 bits; spans stay below 16 MB each to be exact."""
    low, high = (_reduced(row[end] - row[start]) for row in prefix)
    value = _reduced(((high & _LOW30) << _S31) + (high >> _S30) + low)
    return mix(times(value, POWERS[which].down[start]))


class Chunk:
    """Some whole texts laid out in one byte array with a newline after each.

    ``data`` holds the bytes, text i is data[start[i]:end[i]]; words are found on first use.
    """

    def __init__(self, texts: list[str | None], lower: bool = False):
        blobs = [(t or "").encode("utf-8", "replace") for t in texts]
        self.blobs = blobs
        self.size = np.fromiter((len(b) for b in blobs), np.int64, len(blobs))
        self.end = np.cumsum(self.size + 1) - 1
        self.start = self.end - self.size
        data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
        self.data = LOWER[data] if lower else data

    def words(self) -> None:
        """Sets w_start, w_end (byte spans), w_doc, and w_lo/w_hi (each text's range of words)."""
        solid = np.zeros(len(self.data) + 2, np.int8)
        solid[1:-1] = ~SPACE[self.data]
        step = np.diff(solid)
        self.w_start, self.w_end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.w_lo, self.w_hi = np.searchsorted(self.w_start, self.start), np.searchsorted(self.w_start, self.end)
        self.w_doc = np.repeat(np.arange(len(self.size)), self.w_hi - self.w_lo)
        self.prefix = prefix_hash(self.data)
        self.w_hash = span_hash(self.prefix, self.w_start, self.w_end)


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries; out[i] covers words[i:i+n], so n - 1 fewer entries come out."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out * _M1 + words[k : k + len(out)])
    return out


def pieces(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters each; a longer text stands alone."""
    lo = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def map_texts(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list] | pa.RecordBatch]], schema: str, text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """Runs a kernel over bounded chunks of rows in Arrow batches.

    ``make`` is called once in each task and returns the kernel; the kernel gets the columns of a
    chunk as Python lists (about ``limit`` characters of text) and returns columns of ``schema``. The
    session's rows per Arrow batch are lowered to BATCH_ROWS and stay so: Spark reads that setting only when
    the query runs, and batches of ten thousand long texts would not fit a worker.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            whole = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for lo, hi in pieces(whole, limit):
                part = batch.slice(lo, hi - lo)
                cols = {n: whole[lo:hi] if n == text else part.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
                out = kernel(cols)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that ``df`` reads, without a job; for sizing partitions. 0 where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 56 else 0


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc (id, a null one as the lowest number), twin (number of the text among those of its id), text, columns.

    Rows equal in id and text get the same key.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc"), "text", *columns)
    if base.groupBy("doc").count().filter("count > 1").take(1):
        w = Window.partitionBy("doc").orderBy(F.coalesce("text", F.lit("")))
        return base.withColumn("twin", F.dense_rank().over(w) - 1)
    out = base.withColumn("twin", F.lit(0))
    out.one_each = True  # no two rows have the same key
    return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text is divisible by five: such rows never train a model. A null id is not held out (and has no label)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most ``bound`` training labels (doc_id, column): the first in hash order of rows outside the held-out fifth.

    Null ids and labels are left out; of repeated ids the largest label counts.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out())
    one = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias(column))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, fresh): a stable order that brings equal keys together, and whether an entry of it begins a new key."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, fresh


class Lines:
    """The \n-split lines of a chunk: start, end, doc, hash, words (counts) and repeated (equals an earlier line of its text and has a word)."""

    def __init__(self, c: Chunk):
        self.end = np.flatnonzero(c.data == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        self.doc = np.searchsorted(c.end, self.end)
        self.hash = span_hash(c.prefix, self.start, self.end)
        self.w_lo, self.w_hi = np.searchsorted(c.w_start, self.start), np.searchsorted(c.w_start, self.end)
        self.words = self.w_hi - self.w_lo
        order, fresh = first_of(paired(self.hash, self.doc))
        self.repeated = np.zeros(len(self.end), bool)
        self.repeated[order] = ~fresh
        self.repeated &= self.words > 0


def repeated_words(c: Chunk, n: int = 5) -> np.ndarray:
    """For each word: whether it lies in a window of n words that its text has twice or more, the first included."""
    inside = np.zeros(len(c.w_doc) + 1, np.int64)
    grams = gram_hash(c.w_hash, n)
    if len(grams):
        at = np.flatnonzero(c.w_doc[: len(grams)] == c.w_doc[n - 1 :])
        order, fresh = first_of(paired(grams[at], c.w_doc[at]))
        twice = ~fresh
        twice[:-1] |= ~fresh[1:]
        hit = at[order[twice]]
        np.add.at(inside, hit, 1)
        np.add.at(inside, hit + n, -1)
    return np.cumsum(inside[:-1]) > 0


def count_in(c: Chunk, mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each span the mask marks."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[end] - total[start]


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


def training_rows(docs: DataFrame, chosen: DataFrame, make, schema: str, most_lines: int | None = None) -> list:
    """Features of the chosen labelled texts (a bounded sample, so broadcast is safe), ordered by id and text.

    With ``most_lines`` documents are taken whole, in hash order of their ids, while their lines together are no more than that.
    """
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    if most_lines is not None:
        sizes = joined.groupBy("doc_id").agg(F.sum(F.coalesce(F.size(F.split("text", "\n")), F.lit(1))).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
        total, ids = 0, []
        for r in sizes:
            if total + r.n <= most_lines:
                total += r.n
                ids.append((r.doc_id,))
        joined = joined.join(F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long")), "doc_id")
    return sorted(map_texts(joined, make, schema).collect(), key=lambda r: (r.doc_id, bytes(r.features)))
