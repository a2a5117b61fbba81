"""Exact join of documents by the Jaccard distance of their shingle sets, as a join in a metric space.

Documents with the same set are one class, of which only the smallest id goes on. Linked documents are at most RADIUS apart.
Almost all other documents share no shingle and lie at distance 1, where no pivot can part them, so the space first falls
apart along shingles: in one order of all shingles, rarer ones first, two linked documents have one in common among the first
n - ceil(0.8 n) + 1 of each, whatever the order. Who shares such a shingle lies in one region.

A profile bounds distances from below at a fraction of a set's size: how many shingles fall into each of PROFILE classes by
hash. Sets differ in at least as many shingles as their profiles do, and linked sets differ in at most a ninth of their sizes'
sum, so only what the profiles allow is compared shingle by shingle; no linked pair is lost.

1. A region's pivot is its smallest document, and regions with the same pivot are one. Distances to it are taken once, and who is within RADIUS joins its ball: a
   region of copies of any size costs as many distances as it has members.
2. Regions whose members are still in different components become one region for each lowest component; members whose
   profiles, first coarse, then fine, allow no link to another component leave, and the others are joined recursively. Within a task, pivots create Voronoi cells: each document belongs to its nearest pivot, and also visits each
   cell where the triangle inequality allows a linked member, that is, where it is no more than 2 RADIUS further from the
   cell's pivot than from its own, and no more than RADIUS beyond the cell's farthest member. What shares nothing with any
   pivot is one more cell, visited by all that are within RADIUS of that. Cells are cut again until they are small or pivots
   spare no pairs; pairs of one component are passed over. A region too large for a task is
   dealt to blocks, and each two blocks meet in one task.

The order of the shingles comes from CELLS counters by hash, a fixed number; ties and collisions only change the cost.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catchwater.llm import kernel as K
from catchwater.llm.graph import components
from catchwater.llm.minhash import shingles
from catchwater.llm.session import cut, documents, release

THRESHOLD = 80
RADIUS = 1 - THRESHOLD / 100
#: Counters of shingles by their top bits.
CELLS = 1 << 18
#: Classes of shingles in a profile, counted to 255, and in the finer one that only what is left by the first gets.
PROFILE, FINE = 256, 4096
#: Ids that are broadcast, at most; more of them are joined by a shuffle.
SMALL = 1_000_000
#: Members of a region that meet others in one task; documents that are joined pair by pair; pivots of one cut.
BLOCK, LEAF, PIVOTS = 256, 24, 8

_SALT = np.uint64(0xA5A5A5A55A5A5A5A)
_SHIFT = np.uint64(64 - CELLS.bit_length() + 1)


def _counts(batches):
    """How often each counter is hit by the distinct shingles of a task's documents."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        data, off = K.flat(batch.column("text"))
        for _, _, part, at in K.groups(data, off):
            total += np.bincount((shingles(part, at)[0] >> _SHIFT).astype(np.int64), minlength=CELLS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])


def _frequencies(docs: DataFrame) -> np.ndarray:
    found = docs.select("text").mapInArrow(_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()  # at most one row a counter
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def _hashes(items: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each whole set; 0 for an empty one."""
    full, out = np.flatnonzero(np.diff(start)), []
    for salt in (np.uint64(0), _SALT):
        h = np.zeros(len(start) - 1, np.uint64)
        if len(full):
            h[full] = np.add.reduceat(K.mix(items ^ salt), start[:-1][full])
        out.append(h.view(np.int64))
    return out


def _heads(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1, h2, keys: each document's first shingles in the common order, as 32-bit keys."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequencies(docs))

    def apply(batches):
        often = shared.value
        for batch in batches:
            ids, (data, off) = batch.column("doc_id"), K.flat(batch.column("text"))
            for i, j, part, at in K.groups(data, off):
                items, start = shingles(part, at)
                n = np.diff(start)
                order = np.lexsort((items, often[(items >> _SHIFT).astype(np.int64)], np.repeat(np.arange(j - i), n)))
                take = np.where(n > 0, n - (THRESHOLD * n + 99) // 100 + 1, 0)
                begin = np.concatenate([[0], np.cumsum(take)])
                spot = np.repeat(start[:-1] - begin[:-1], take) + np.arange(begin[-1])
                keys = items[order[spot]].astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), *map(pa.array, _hashes(items, start)), K.list_array(keys, begin), _profiled(items, start, PROFILE)], ["doc_id", "n_shingles", "h1", "h2", "keys", "profile"])

    return docs.mapInArrow(apply, "doc_id long, n_shingles long, h1 long, h2 long, keys array<int>, profile binary")


def _profiles(column) -> np.ndarray:
    data, off = K.flat(column)
    return data[off[0] : off[-1]].reshape(len(column), -1) if len(column) else np.zeros((0, PROFILE), np.uint8)


def _profiled(items: np.ndarray, at: np.ndarray, classes: int) -> pa.Array:
    """How many shingles of each set fall into each class, by their upper bits."""
    kind = np.repeat(np.arange(len(at) - 1) * classes, np.diff(at)) + ((items >> np.uint64(32)) % np.uint64(classes)).astype(np.int64)
    profile = np.minimum(np.bincount(kind, minlength=(len(at) - 1) * classes), 255).astype(np.uint8)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(classes), len(at) - 1, [None, pa.py_buffer(profile.tobytes())]).cast(pa.binary())


def _finer(batches):
    """doc_id, n and the finer profile of whole sets."""
    for batch in batches:
        for i in range(0, len(batch), 512):
            part = batch.slice(i, 512)
            sets = part.column("items")
            at = sets.offsets.to_numpy().astype(np.int64)
            items = sets.values.to_numpy(zero_copy_only=False).view(np.uint64)[at[0] : at[-1]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), _profiled(items, at - at[0], FINE)], ["doc_id", "n", "profile"])


def _may_link(profile: np.ndarray, size: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sizes and profiles leave it open that the sets are linked."""
    least = np.abs(profile.astype(np.int16) - others).sum(-1, dtype=np.int64)
    return (100 * np.minimum(size, sizes) >= THRESHOLD * np.maximum(size, sizes)) & (least * (100 + THRESHOLD) <= (100 - THRESHOLD) * (size + sizes))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _regions(batches):
    """Rows sorted by key and id -> pivot, doc_id for each other document that has a pivot's key."""
    last_key = pivot = None
    for batch in batches:
        key, ids = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = key[0] != last_key
        heads = np.flatnonzero(new)
        first = ids[heads] if new[0] else np.concatenate([[pivot], ids[heads]])
        of = np.cumsum(new) - (1 if new[0] else 0)
        pivots = first[of]
        last_key, pivot = key[-1], pivots[-1]
        some = ids != pivots
        yield pa.RecordBatch.from_arrays([pa.array(pivots[some]), pa.array(ids[some])], ["pivot", "doc_id"])


def _sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """doc_id and items: the whole shingle sets of the wanted ids. repeated: rows may share an id."""

    def apply(batches):
        for batch in batches:
            ids, (data, off) = batch.column("doc_id"), K.flat(batch.column("text"))
            for i, j, part, at in K.groups(data, off):
                items, start = shingles(part, at)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *map(pa.array, _hashes(items, start)), K.list_array(items.view(np.int64), start)], ["doc_id", "h1", "h2", "items"])

    named = _small(cut(_small(wanted).join(reps.select("doc_id", "h1", "h2"), "doc_id")))
    texts = docs.join(named.select("doc_id"), "doc_id", "left_semi").mapInArrow(apply, "doc_id long, h1 long, h2 long, items array<long>")
    found = texts.join(named, ["doc_id", "h1", "h2"], "left_semi").select("doc_id", "items")
    return cut(found.dropDuplicates(["doc_id"]) if repeated else found)


class Space:
    """Some documents' sets, their components and the links found among them."""

    def __init__(self, ids, side, group, items, at):
        self.ids, self.side, self.group, self.items, self.at, self.links = ids, side, group.copy(), items, at, []
        self.size = np.diff(at)

    def common(self, p: int, among: np.ndarray) -> np.ndarray:
        """How many shingles p shares with each of the others."""
        own, n = self.items[self.at[p] : self.at[p + 1]], self.size[among]
        begin = np.cumsum(n) - n
        other = self.items[np.repeat(self.at[among] - begin, n) + np.arange(n.sum())]
        spot = np.minimum(np.searchsorted(own, other), len(own) - 1)
        return np.add.reduceat((own[spot] == other).astype(np.int64), begin) if len(among) else np.zeros(0, np.int64)

    def tie(self, p: int, among: np.ndarray, common: np.ndarray) -> None:
        """Links p with those close enough that may meet it, unless they are in its component already."""
        near = (100 * common >= THRESHOLD * (self.size[p] + self.size[among] - common)) & self._meets(p, among)
        for q in among[near]:
            if self.group[q] != self.group[p]:
                self.links.append(sorted((int(self.ids[p]), int(self.ids[q]))))
                self.group[self.group == self.group[q]] = self.group[p]

    def _meets(self, p: int, among: np.ndarray) -> np.ndarray:
        """Sides 0 and 1 meet each other, side 2 itself."""
        return (self.side[among] == 2) if self.side[p] == 2 else (self.side[among] == 1 - self.side[p])

    def pairwise(self, members: np.ndarray) -> None:
        for i, p in enumerate(members):
            q = members[i + 1 :]
            q = q[self._meets(p, q) & (self.group[q] != self.group[p])]
            q = q[100 * np.minimum(self.size[q], self.size[p]) >= THRESHOLD * np.maximum(self.size[q], self.size[p])]
            self.tie(p, q, self.common(p, q))

    def join(self, members: np.ndarray) -> None:
        """Links members, cell by cell, until all that are close are in one component."""
        todo = [members]
        while todo:
            members = todo.pop()
            if (self.group[members] == self.group[members[0]]).all():
                continue
            if len(members) <= LEAF:
                self.pairwise(members)
                continue
            pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(np.int64)]
            shared = np.stack([self.common(p, members) for p in pivots])
            apart = 1 - shared / (self.size[pivots][:, None] + self.size[members] - shared)
            for p, common in zip(pivots, shared):
                self.tie(p, members, common)
            nearest = apart.min(0)
            far = nearest > 1 - 1e-9  # shares nothing with any pivot
            home = np.where(far, -1, apart.argmin(0))
            cells = [members[nearest >= 1 - RADIUS - 1e-9]] if far.any() else []
            for k in range(len(pivots)):
                mine = home == k
                if mine.any():
                    visits = (apart[k] <= nearest + 2 * RADIUS + 1e-9) & (apart[k] <= apart[k][mine].max() + RADIUS + 1e-9)
                    cells.append(members[mine | visits])
            pairs, n = sum(len(c) * (len(c) - 1) // 2 for c in cells), len(members)
            if len(pivots) * n + pairs < n * (n - 1) // 2:
                todo += [c for c in cells if len(c) > 1]
            else:
                self.pairwise(members)  # the pivots do not part them


def _meet(batches):
    """Links (a, b) between components of each row's members, as few as tie together what is linked in the row."""
    for batch in batches:
        column, links = batch.column("members"), []
        rows, field = column.offsets.to_numpy(), column.values.field
        ids, side, group = (field(k).to_numpy(zero_copy_only=False) for k in ("id", "side", "c"))
        at, items = field("items").offsets.to_numpy(), field("items").values.to_numpy(zero_copy_only=False).view(np.uint64)
        for i, j in zip(rows[:-1], rows[1:]):
            space = Space(ids[i:j], side[i:j], group[i:j], items[at[i] : at[j]], at[i : j + 1].astype(np.int64) - at[i])
            space.join(np.argsort(space.ids, kind="stable"))
            links += space.links
        yield pa.RecordBatch.from_arrays([pa.array([x[e] for x in links], pa.int64()) for e in (0, 1)], ["a", "b"])


def _near(batches):
    """Those pairs whose sizes and profiles allow a link."""
    for batch in batches:
        na, nb, x, y = batch.column("na").to_numpy(), batch.column("nb").to_numpy(), _profiles(batch.column("x")), _profiles(batch.column("y"))
        yield batch.select(["a", "b"]).filter(pa.array(_may_link(x, na, y, nb)))


def _balls(docs: DataFrame, reps: DataFrame, regions: DataFrame, repeated: bool) -> DataFrame:
    """Links (a, b) between the pivots of regions and those members that are within RADIUS."""
    pairs = _small(regions.toDF("a", "b"))
    size = reps.select("doc_id", "n_shingles", "profile")
    pairs = cut(pairs.join(size.toDF("a", "na", "x"), "a").join(size.toDF("b", "nb", "y"), "b").where(f"100 * least(na, nb) >= {THRESHOLD} * greatest(na, nb)").mapInArrow(_near, "a long, b long"))
    sets = _sets(docs, reps, cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()), repeated)
    both = _small(pairs).join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.select("a", "b", common.alias("n"), (F.size("x") + F.size("y")).alias("m")).where(f"100 * n >= {THRESHOLD} * (m - n)").select("a", "b"))


def _open(batches):
    """Members of each row that may be linked with one of another component: low, doc_id, c."""
    for batch in batches:
        column = batch.column("members")
        rows, field = column.offsets.to_numpy(), column.values.field
        ids, side, group, size = (field(k).to_numpy(zero_copy_only=False) for k in ("id", "side", "c", "n"))
        profiles, keep = _profiles(field("profile")), np.zeros(len(ids), bool)
        for i, j in zip(rows[:-1], rows[1:]):
            for p in range(i, j):
                q = np.arange(i, j) if side[p] == 2 else np.flatnonzero(side[i:j] == 1) + i if side[p] == 0 else np.arange(0)
                q = q[group[q] != group[p]]
                q = q[_may_link(profiles[p], size[p], profiles[q], size[q])]
                keep[q] = True
                keep[p] |= len(q) > 0
        low = np.repeat(batch.column("low").to_numpy(), np.diff(rows))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (low, ids, group)], ["low", "doc_id", "c"])


def _met(clusters: DataFrame, about: DataFrame, *more: str) -> DataFrame:
    """low, members: blocks of each cluster's members, each two of them in one row, with columns of about."""
    blocks = _small(cut(clusters.groupBy("low").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))))
    dealt = clusters.join(blocks, "low").withColumn("block", F.pmod(F.xxhash64("doc_id"), "nb"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side")
    member = F.struct(F.col("doc_id").alias("id"), side, "c", *more)
    return _small(dealt).join(about, "doc_id").groupBy("low", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(member).alias("members")).select("low", "members")


def _ties(docs: DataFrame, reps: DataFrame, regions: DataFrame, found: DataFrame, repeated: bool) -> DataFrame:
    """Links between components within regions, joined recursively."""
    members = regions.union(regions.select("pivot", F.col("pivot").alias("doc_id")).distinct())
    placed = cut(members.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("pivot", "doc_id", F.coalesce("component_id", "doc_id").alias("c")))
    mixed = placed.groupBy("pivot").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    clusters = cut(placed.join(mixed, "pivot").select("low", "doc_id", "c").distinct())
    about = reps.select("doc_id", F.col("n_shingles").alias("n"), "profile")
    opened = cut(_met(clusters, about, "n", "profile").mapInArrow(_open, "low long, doc_id long, c long").distinct())
    release(docs.sparkSession)
    sets = _sets(docs, reps, cut(opened.select("doc_id").distinct()), repeated)
    fine = sets.mapInArrow(_finer, "doc_id long, n long, profile binary")
    opened = cut(_met(opened, fine, "n", "profile").mapInArrow(_open, "low long, doc_id long, c long").distinct())
    return cut(_met(opened, sets, "items").select("members").mapInArrow(_meet, "a long, b long").distinct())


def linked(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id: one row per doc_id.

    Texts without words have no shingles and stay alone; a null text is such a text, and a text of fewer than five words is
    one shingle. Rows with a null doc_id are left out. Of rows that repeat a doc_id the one with the smallest set hash
    counts. Distances are exact, ties at the threshold included; 64-bit hashes stand for shingles. An empty table gives an
    empty table; other columns are left behind.
    """
    docs = documents(docs)
    heads = cut(_heads(docs))
    every = cut(heads.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n_shingles")).alias("r"), F.count("*").alias("times")).select("doc_id", "r.*", "times"))
    same = cut(every.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = heads.join(_small(same.select(F.col("rep").alias("doc_id"), "h1", "h2")), ["doc_id", "h1", "h2"], "left_semi")
    repeated = every.where("times > 1").limit(1).count() > 0
    if repeated:
        reps = cut(reps.dropDuplicates(["doc_id"]))
    keyed = reps.select("doc_id", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key", "doc_id")
    regions = cut(keyed.mapInArrow(_regions, "pivot long, doc_id long").distinct())
    reps = cut(reps.drop("keys"))
    del heads, keyed
    release(docs.sparkSession)
    links = _balls(docs, reps, regions, repeated)
    release(docs.sparkSession)
    found = components(links)
    ties = _ties(docs, reps, regions, found, repeated)
    if ties.limit(1).count():
        found = components(links.union(ties))
    by_class = every.select("doc_id", "n_shingles", "h1", "h2").join(same, ["h1", "h2", "n_shingles"], "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return by_class.select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
