"""Draws documents that look like a target corpus: hashed features, bucket gains, and a Gumbel draw without replacement.

A feature is a run of words joined by one space; its bucket is the CRC of its UTF-8 bytes. CRC is linear over XOR but for a
constant of the length, so each byte adds a value that depends on the byte and its distance from the feature's end only:
``bitwise_xor.reduceat`` over looked-up values gives the CRC of all features of a batch at once. Spans longer than the
table are cut into blocks, whose values are carried over the bytes behind them by doubled zero-byte operators.

Two passes over the texts: tasks count features by bucket (at most BUCKETS rows each), then look the gains up. Only the
BUCKETS gains go to the tasks, a fixed number. The draw sorts narrow rows by range, so no task ranks them all.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catchwater.llm import kernel as K
from catchwater.llm.session import cut, documents

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Distances from a feature's end that the table of contributions holds.
TABLE = 64

_POLY, _ONES = 0xEDB88320, np.uint32(0xFFFFFFFF)
#: Bytes of words, in lower case; all others become spaces.
_WORDS = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORDS[_b] = K.LOWER[_b]


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What each byte adds at each distance; and operators for 1, 2, 4, ... zero bytes behind a value, by its four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & 1, np.uint32(_POLY), np.uint32(0))
    at = np.empty((TABLE, 256), np.uint32)
    at[0] = step
    for d in range(1, TABLE):
        at[d] = (at[d - 1] >> np.uint32(8)) ^ step[at[d - 1] & 255]
    parts = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    operators = [(parts >> np.uint32(8)) ^ step[parts & 255]]
    for _ in range(40):
        operators.append(_carried(operators[-1], operators[-1]))
    return at, operators


def _carried(operator: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = operator[0][value & 255]
    for k in range(1, 4):
        out = out ^ operator[k][(value >> np.uint32(8 * k)) & 255]
    return out


_AT, _ZEROS = _tables()


def _behind(value: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each value with that many zero bytes behind it."""
    for k in range(int(zeros.max(initial=0)).bit_length()):
        some = np.flatnonzero((zeros >> k) & 1)
        value[some] = _carried(_ZEROS[k], value[some])
    return value


_LENGTHS = _behind(np.full(TABLE + 1, _ONES), np.arange(TABLE + 1)) ^ _ONES


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC of data[s:e] for each span; spans may overlap, and none may be empty."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    size = ends - starts
    blocks = -(-size // TABLE)
    first = np.cumsum(blocks) - blocks
    left = np.repeat(first + blocks - 1, blocks) - np.arange(blocks.sum())  # whole blocks behind each block
    until = np.repeat(ends, blocks) - left * TABLE
    since = np.maximum(until - TABLE, np.repeat(starts, blocks))
    n = until - since
    begin = np.cumsum(n) - n
    spot = np.repeat(since - begin, n) + np.arange(n.sum())
    value = np.bitwise_xor.reduceat(_AT.reshape(-1)[(np.repeat(until, n) - 1 - spot) * 256 + data[spot]], begin)
    if len(blocks) < len(n):
        value = np.bitwise_xor.reduceat(_behind(value, left * TABLE), first)
    constant = _LENGTHS[np.minimum(size, TABLE)]
    large = np.flatnonzero(size > TABLE)
    constant[large] = _behind(np.full(len(large), _ONES), size[large]) ^ _ONES
    return value ^ constant


def features(data: np.ndarray, off: np.ndarray, longest: int, buckets: int):
    """For runs of 1 to ``longest`` words: the buckets of all features in order of texts, and where each text's begin."""
    low = _WORDS[data]
    starts, ends, first = K.word_spans(low, off)
    size = ends - starts
    base = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(base, size) + within] = low[np.repeat(starts, size) + within]
    for n in range(1, longest + 1):
        count = np.maximum(np.diff(first) - n + 1, 0)
        at = np.concatenate([[0], np.cumsum(count)])
        word = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
        yield (crc32(joined, base[word], base[word + n - 1] + size[word + n - 1]) % np.uint32(buckets)).astype(np.int64), at


def bucket_counts(texts: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """text -> bucket, n: how many features of all texts fall into each bucket; a null text has none."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, off = K.flat(batch.column("text"))
            for _, _, part, at in K.groups(data, off):
                for found, _ in features(part, at, longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """A thousand times the log ratio of each bucket's share in target to that in docs, both smoothed by one, floored."""
    both = bucket_counts(docs, longest, buckets).withColumnRenamed("n", "s").join(bucket_counts(target, longest, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    found = np.zeros((2, buckets), np.int64)
    for row in both.collect():  # at most one row a bucket
        found[:, row.bucket] = row.s or 0, row.t or 0
    s, t = found.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(docs: DataFrame, table: np.ndarray, longest: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def apply(batches):
        gain = shared.value
        for batch in batches:
            ids, (data, off) = batch.column("doc_id"), K.flat(batch.column("text"))
            for i, j, part, at in K.groups(data, off):
                total, count, words = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), None
                for found, begin in features(part, at, longest, len(gain)):
                    sums = np.concatenate([[0], np.cumsum(gain[found])])
                    total += sums[begin[1:]] - sums[begin[:-1]]
                    count += np.diff(begin)
                    words = np.diff(begin) if words is None else words
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(count), pa.array(words), pa.array(total // np.maximum(count, 1))], ["doc_id", "n_features", "n_words", "weight"])

    return docs.mapInArrow(apply, "doc_id long, n_features long, n_words long, weight long")


def chance(seed: int = SEED) -> Column:
    """A thousandfold Gumbel draw from the hash of seed and doc_id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _places(rows: DataFrame, *order) -> DataFrame:
    """Adds place (1, 2, 3, ...) in the given order. Rows are sorted by range; tasks count on from those before them."""
    ordered = cut(cut(rows.withColumn("own", F.monotonically_increasing_id())).orderBy(*order, "own")).drop("own")
    sizes = sorted(tuple(r) for r in ordered.groupBy(F.spark_partition_id().alias("p")).count().collect())  # one row a partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    starts = ordered.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "p int, before long")
    numbered = ordered.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.join(F.broadcast(starts), "p").withColumn("place", F.col("before") + F.col("i") + 1).drop("p", "i", "before")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """documents -> doc_id, n_features, weight, score, rank; rank is null for documents that are not drawn.

    A null or empty text, or one without words, has no features and weight 0, and is never drawn; whole texts count, however
    long. Rows with a null doc_id are left out everywhere; rows that share an id are weighed one by one and share their
    chance. Equal scores go to the smaller doc_id, then to fewer features. An empty target gives gains against an even
    spread, an empty table no rows; other columns are left behind.
    """
    docs = documents(docs)
    scored = _weigh(docs, gains(docs, target, longest, buckets), longest).withColumn("score", F.col("weight") + chance(seed))
    may = F.col("n_words") >= least_words
    placed = cut(_places(scored, F.desc(may), F.desc("score"), "doc_id", "n_features"))
    drawn = percent * placed.where(may).count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
