"""Near-duplicate groups by b-bit MinHash.

Per document 256 minima; their low 4 bits are packed into 16 longs, and 32 bands of 4 whole minima give the buckets.
Documents with the same shingle set are one class and only its smallest id goes on. Candidates come in passes:

1. every member of a bucket against the bucket's smallest id (as many pairs as members), which ties large groups;
2. buckets whose members are still in different components: those with the same lowest component form one cluster, and
   the cluster's members meet block by block inside a task, which estimates the similarity of all pairs of different
   components, checks likely ones on whole sets at once and passes on only links that tie components together.

Both passes estimate the similarity by bit counts, corrected for chance agreement of 4 bits, drop pairs far below the
threshold (0.13 is over 4 standard errors) and confirm the rest on whole shingle sets. Pairs already in one component
need no check, so a large group costs about as many checks as members. A pair at 0.75 shares no band with probability
(1 - 0.75^4)^32 < 6e-6.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catchwater.llm import kernel as K
from catchwater.llm.graph import components
from catchwater.llm.session import cut, documents, few, release

SHINGLE, HASHES, BANDS, ROWS, BITS = 5, 256, 32, 4, 4
THRESHOLD, SLACK = 75, 0.13
#: Members of a cluster that meet others in one row of the second pass.
BLOCK = 256

_rng = np.random.default_rng(20240917)
_XOR = _rng.integers(0, 1 << 32, HASHES, np.uint32)
_MUL = _rng.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = K.mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_SALT = np.uint64(0xA5A5A5A55A5A5A5A)

SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, bits array<long>"
SETS = "doc_id long, h1 long, h2 long, items array<long>"


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of each text in order of texts, and where each text's begin."""
    low = K.LOWER[data]
    starts, ends, first = K.word_spans(low, off)
    words = K.hash_spans(low, starts, ends)
    count = np.diff(first)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(n)])
    full = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        full += words[k : k + len(full)] * _STEP[k]
    pos = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    out = K.mix(full[np.minimum(pos, max(len(full) - 1, 0))]) if len(full) else np.zeros(at[-1], np.uint64)
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        out[at[i]] = K.mix(np.array([(words[first[i] : first[i + 1]] * _STEP[: count[i]]).sum() + np.uint64(count[i])], np.uint64))[0]
    for i in np.flatnonzero(n > 1):
        out[at[i] : at[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][n > 0]] = True
    sums = np.concatenate([[0], np.cumsum(new)])
    return out[new], sums[at]


def _sketch(batches):
    for batch in batches:
        ids, (data, off) = batch.column("doc_id"), K.flat(batch.column("text"))
        for i, j, part, at in K.groups(data, off):
            items, start = shingles(part, at)
            n, full = np.diff(start), np.flatnonzero(np.diff(start))
            begin = start[:-1][full]
            h, bands, bits = np.zeros((2, j - i), np.uint64), np.zeros((j - i, BANDS), np.uint64), np.zeros((j - i, HASHES * BITS // 64), np.uint64)
            if len(full):
                for k, salt in enumerate((np.uint64(0), _SALT)):
                    h[k, full] = np.add.reduceat(K.mix(items ^ salt), begin)
                x = (items >> np.uint64(32)).astype(np.uint32)
                minima = np.empty((len(full), HASHES), np.uint32)
                for k in range(HASHES):
                    minima[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], begin)
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, np.uint64)
                    for k in range(b * ROWS, b * ROWS + ROWS):
                        key = K.mix(key ^ minima[:, k].astype(np.uint64))
                    bands[full, b] = key
                low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64)
                for k in range(HASHES):
                    bits[full, k * BITS // 64] |= low[:, k] << np.uint64(k * BITS % 64)
            whole = np.where(n > 0, BANDS, 0)
            keep = n > 0
            yield pa.RecordBatch.from_arrays([
                ids.slice(i, j - i), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)),
                K.list_array(bands[keep].reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum(whole)])),
                K.list_array(bits.reshape(-1).view(np.int64), np.arange(j - i + 1) * bits.shape[1]),
            ], ["doc_id", "n_shingles", "h1", "h2", "bands", "bits"])


def _sets(batches):
    for batch in batches:
        ids, (data, off) = batch.column("doc_id"), K.flat(batch.column("text"))
        for i, j, part, at in K.groups(data, off):
            items, start = shingles(part, at)
            h, full = np.zeros((2, j - i), np.uint64), np.flatnonzero(np.diff(start))
            if len(full):
                for k, salt in enumerate((np.uint64(0), _SALT)):
                    h[k, full] = np.add.reduceat(K.mix(items ^ salt), start[:-1][full])
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), K.list_array(items.view(np.int64), start)], ["doc_id", "h1", "h2", "items"])


def estimate(x: str, y: str) -> Column:
    """Similarity of two packed signatures: the share of equal 4-bit fields, less what chance makes equal."""
    fields = (1 << 64) // 15
    differ = F.lit(0)
    for k in range(HASHES * BITS // 64):
        d = F.expr(f"{x}[{k}] ^ {y}[{k}]")
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(fields)))
    chance = 2.0**-BITS
    return (F.lit(1.0) - differ / F.lit(float(HASHES)) - chance) / (1.0 - chance)


def _meet(batches):
    """Links (a, b) between components among each row's members, as few as tie together what is linked in the row.

    Members of side 0 meet those of side 1, those of side 2 each other. Sizes and signatures go first, then whole sets.
    """
    nibble = np.uint64(((1 << 64) - 1) // 15)
    least = HASHES * ((THRESHOLD / 100 - SLACK) * (1 - 2.0**-BITS) + 2.0**-BITS)
    for batch in batches:
        column, links = batch.column("members"), []
        rows, field = column.offsets.to_numpy(), column.values.field
        ids_, side_, group_, size_ = (field(k).to_numpy(zero_copy_only=False) for k in ("id", "side", "c", "n"))
        bits_ = field("bits").values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, HASHES * BITS // 64)
        at_, items_ = field("items").offsets.to_numpy(), field("items").values.to_numpy(zero_copy_only=False).view(np.uint64)
        for i, j in zip(rows[:-1], rows[1:]):
            ids, side, group, size, bits = ids_[i:j], side_[i:j], group_[i:j].copy(), size_[i:j], bits_[i:j]
            for p in np.flatnonzero(side != 1):
                q = np.flatnonzero((side != 0) & (group != group[p]) & (100 * np.minimum(size, size[p]) >= THRESHOLD * np.maximum(size, size[p])))
                q = q[q > p] if side[p] == 2 else q
                d = bits[q] ^ bits[p]
                d |= d >> np.uint64(1)
                d |= d >> np.uint64(2)
                same = HASHES - np.bitwise_count(d & nibble).sum(1, dtype=np.int64)
                own = items_[at_[i + p] : at_[i + p + 1]]
                for k in q[same >= least][np.argsort(-same[same >= least], kind="stable")]:
                    if group[k] == group[p]:
                        continue
                    other = items_[at_[i + k] : at_[i + k + 1]]
                    spot = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    common = int((own[spot] == other).sum())
                    if 100 * common >= THRESHOLD * (len(own) + len(other) - common):
                        links.append(sorted((int(ids[p]), int(ids[k]))))
                        group[group == group[k]] = group[p]
        yield pa.RecordBatch.from_arrays([pa.array([x[e] for x in links], pa.int64()) for e in (0, 1)], ["a", "b"])


def _sets_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """doc_id and items: the whole shingle sets of the wanted ids."""
    named = few(wanted.join(reps.select("doc_id", "h1", "h2"), "doc_id"), rows)
    texts = few(docs.join(wanted, "doc_id", "left_semi"), rows)
    sets = few(texts.mapInArrow(_sets, SETS).join(named, ["doc_id", "h1", "h2"], "left_semi"), rows)
    return cut(few(sets.dropDuplicates(["doc_id"]).select("doc_id", "items"), rows))


def _confirm(docs: DataFrame, reps: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """Those (a, b) whose whole sets have 100 * intersection >= 75 * union."""
    wanted = few(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), rows)
    sets = _sets_of(docs, reps, wanted, rows)
    both = few(pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a"), rows)
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("n"), (F.size("x") + F.size("y")).alias("m")).where(f"100 * n >= {THRESHOLD} * (m - n)").select("a", "b")


def _ties(docs: DataFrame, reps: DataFrame, members: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """The second pass: links between components of members that share a bucket."""
    placed = few(members.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "key", "doc_id", F.coalesce("component_id", "doc_id").alias("c")), rows)
    mixed = placed.groupBy("band", "key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    clusters = cut(few(few(placed.join(mixed, ["band", "key"]).select("low", "doc_id", "c"), rows).distinct(), rows))
    sets = _sets_of(docs, reps, few(clusters.select("doc_id").distinct(), rows), rows)
    blocks = clusters.groupBy("low").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    left = few(clusters.join(blocks, "low"), rows).withColumn("block", F.pmod(F.xxhash64("doc_id"), "nb"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side")
    full = left.join(reps.select("doc_id", F.col("n_shingles").alias("n"), "bits"), "doc_id").join(sets, "doc_id")
    member = F.struct(F.col("doc_id").alias("id"), side, "c", "n", "bits", "items")
    met = full.groupBy("low", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(member).alias("members"))
    return cut(few(met.select("members").mapInArrow(_meet, "a long, b long").distinct(), rows))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept: one row per doc_id.

    Texts without words have no shingles and stay alone; a null text is such a text; rows with a null doc_id are left
    out. Of rows that repeat a doc_id the one with the smallest set hash counts. An empty table gives an empty table.
    """
    docs = documents(docs)
    rows = docs.count()
    sketch = docs.mapInArrow(_sketch, SKETCH)
    all_rows = cut(few(sketch.select(F.struct("doc_id", "h1", "h2", "n_shingles", "bands", "bits").alias("r")).groupBy("r.doc_id").agg(F.min("r").alias("r")).select("r.*"), rows))
    same = cut(few(all_rows.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), rows))
    reps = cut(few(all_rows.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), rows))
    bands = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).where("n > 1")
    members = cut(few(bands.join(shared, ["band", "key"]), rows))
    about = reps.select("doc_id", F.col("n_shingles").alias("size"), "bits")

    def of(name: str, end: str) -> DataFrame:
        return about.select(F.col("doc_id").alias(end), F.col("bits").alias(name), F.col("size").alias(f"n{name}"))

    star = few(members.where("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct(), rows)
    star = few(star.join(of("x", "a"), "a"), rows).join(of("y", "b"), "b")
    star = star.where(f"100 * least(nx, ny) >= {THRESHOLD} * greatest(nx, ny)").where(estimate("x", "y") >= THRESHOLD / 100 - SLACK)
    links = cut(few(_confirm(docs, reps, cut(few(star.select("a", "b"), rows)), rows), rows))
    found = components(links)
    release(docs.sparkSession)
    ties = _ties(docs, reps, members, found, rows)
    if ties.limit(1).count():
        found = components(links.union(ties))

    by_class = few(all_rows.select("doc_id", "n_shingles", "h1", "h2").join(same, ["h1", "h2", "n_shingles"], "left"), rows).join(found.withColumnRenamed("id", "rep"), "rep", "left")
    out = few(by_class.select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id")), rows)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
