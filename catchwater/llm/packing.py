"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Texts become pieces of at most CAPACITY tokens map-side; only (id, length, checksum) rows move on. Full pieces are
sequences. The others are dealt to blocks of about BLOCK pieces, and each block lives on ISLANDS islands. An island's
population starts from best fit in random orders; a crossover injects whole well-filled bins of one parent into another,
drops the bins that hold their documents already, and puts the displaced documents where they fit best. After each epoch
the best packing of an island migrates to the next one of its block, as a bin number for each piece. A block is done when
one of its islands needs no more bins than its tokens do; after EPOCHS its best island counts. An island that is not
done half the way takes plain best fit into its population, so no result is worse than that. Bins that are (nearly) full are then kept, and the documents of all others meet on fewer, newly dealt blocks.
"""

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from catchwater.llm import kernel as K
from catchwater.llm.bpe import RUN, Encoder, Library, rank_text
from catchwater.llm.session import cut, documents

CAPACITY, BLOCK, ISLANDS, EPOCHS = 2048, 4096, 2, 3
PARENTS, GENERATIONS = 4, 48
#: Tokens that a kept bin may leave free in each round but the last, which keeps all.
SPARE = (0, 2)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """documents -> doc_id, piece, start, length, ids_crc32: each text's ids and one id 0, cut if longer than capacity.

    All pieces of a cut text but the first are full.
    """
    spec = docs.sparkSession.sparkContext.broadcast(rank_text(path))

    def apply(batches):
        encoder = Encoder(Library.of_json(spec.value))
        for batch in batches:
            names, (data, off) = batch.column("doc_id").to_pylist(), K.flat(batch.column("text"))
            for i, j, part, at in K.groups(data, off, RUN):
                ids, begin = encoder.run(part, at)
                every = np.zeros(len(ids) + j - i, "<u4")
                every[np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(begin))] = ids
                raw, begin, rows = memoryview(every.tobytes()), (begin + np.arange(j - i + 1)).tolist(), []
                for name, a, b in zip(names[i:j], begin, begin[1:]):
                    n = b - a
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    rows += [(name, k, s, e - s, zlib.crc32(raw[4 * (a + s) : 4 * (a + e)])) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(apply, PIECES)


class Bins:
    """Bins of item numbers; a set bit of ``free`` says that some bin has just that much room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity, self.bins, self.fill, self.room, self.free = sizes, capacity, [], [], {}, 0

    def open(self, items: list[int]) -> None:
        self._place(len(self.bins), sum(self.sizes[i] for i in items))
        self.bins.append(items)

    def _place(self, b: int, fill: int) -> None:
        if b == len(self.fill):
            self.fill.append(fill)
        else:
            self.fill[b] = fill
        left = self.capacity - fill
        self.room.setdefault(left, []).append(b)
        self.free |= 1 << left

    def best_fit(self, items) -> "Bins":
        """Puts items, largest first, each into the bin that it fills most, or a new one."""
        return self.fit(sorted(items, key=lambda i: -self.sizes[i]))

    def fit(self, items) -> "Bins":
        """As best_fit, in the given order."""
        for i in items:
            size = self.sizes[i]
            fits = self.free >> size
            if not fits:
                self.open([i])
                continue
            left = size + (fits & -fits).bit_length() - 1
            spots = self.room[left]
            b = spots.pop()
            if not spots:
                self.free &= ~(1 << left)
            self.bins[b].append(i)
            self._place(b, self.fill[b] + size)
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then bins as unequally filled as may be."""
        return -len(self.bins), sum(f * f for f in self.fill)

    def cross(self, other: "Bins", rng: random.Random) -> "Bins":
        """A child: whole well-filled bins of ``other``, the bins of self that share no item with them, the rest best-fit."""
        good = sorted(range(len(other.bins)), key=lambda b: (-other.fill[b], rng.random()))
        inject = [other.bins[b] for b in good[: max(1, int(len(good) * rng.uniform(0.1, 0.6)))]]
        taken = {i for items in inject for i in items}
        child, displaced = Bins(self.sizes, self.capacity), []
        for items in inject:
            child.open(list(items))
        least = sorted(self.fill)[int(len(self.fill) * rng.uniform(0, 0.6))]  # a mutation: break the emptiest bins up
        for items, fill in zip(self.bins, self.fill):
            if fill <= least or not taken.isdisjoint(items):
                displaced += [i for i in items if i not in taken]
            else:
                child.open(list(items))
        return child.best_fit(displaced)


def bound(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: what the tokens fill, or the pieces of over half a bin."""
    return max(-(-sum(sizes) // capacity), sum(2 * x > capacity for x in sizes))


def breed(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]] = ()) -> tuple[Bins, int]:
    """The best packing of a population that starts from elites and best fit in random orders, and how many generations it ran."""
    rng, goal, people = random.Random(seed), bound(sizes, capacity), []
    for bins in elites:
        people.append(Bins(sizes, capacity))
        for items in bins:
            people[-1].open(items)
    while len(people) < PARENTS:
        order = list(range(len(sizes)))
        rng.shuffle(order)
        people.append(Bins(sizes, capacity).fit(order))
    for generation in range(GENERATIONS + 1):
        people.sort(key=Bins.fitness, reverse=True)
        if len(people[0].bins) <= goal or generation == GENERATIONS:
            return people[0], generation
        if generation == GENERATIONS // 2:  # half the way without the goal: plain best fit joins
            people[-1] = Bins(sizes, capacity).best_fit(range(len(sizes)))
            people.sort(key=Bins.fitness, reverse=True)
        a, b = rng.sample(people[:3], 2)
        child = a.cross(b, rng)
        if child.fitness() > people[-1].fitness():
            people[-1] = child
    return people[0], GENERATIONS


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for number, items in enumerate(bins):
        out[items] = number
    return out


def _bins(numbers: np.ndarray) -> list[list[int]]:
    order = np.argsort(numbers, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)]


def _epoch(number: int, capacity: int):
    """Breeds one island of a block; own and guest are bin numbers of its elite and of its neighbour's."""

    def evolve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        sizes, block, island = rows["length"].tolist(), int(rows["block"][0]), int(rows["island"][0])
        elites = [_bins(rows[c].to_numpy()) for c in ("own", "guest") if rows[c][0] >= 0]
        best, ran = breed(sizes, capacity, 7919 * number + 31 * block + island, elites)
        squares = float(best.fitness()[1])
        return rows.assign(own=_numbers(best.bins, len(rows)), guest=np.int32(-1), n_bins=len(best.bins), squares=squares, done=len(best.bins) <= bound(sizes, capacity), generations=rows["generations"] + ran)

    return evolve


_STATE = "row long, length long, block long, island int, own int, guest int, n_bins long, squares double, done boolean, generations int"


def evolve(rows: DataFrame, capacity: int, seed: int = 0) -> DataFrame:
    """row, length, block -> row, block, number, generations: the bin of each piece in its block's best packing."""
    first = {"own": F.lit(-1), "guest": F.lit(-1), "n_bins": F.lit(0).cast("long"), "squares": F.lit(0.0), "done": F.lit(False), "generations": F.lit(0)}
    state = rows.select("row", "length", "block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")).withColumns(first)
    over = None
    for epoch in range(EPOCHS):
        state = cut(state.groupBy("block", "island").applyInPandas(_epoch(seed * EPOCHS + epoch, capacity), _STATE))
        # A row an island: the smallest is the best.
        best = state.groupBy("block").agg(F.min(F.struct("n_bins", -F.col("squares"), "island")).alias("b"), F.max("done").alias("over")).select("block", F.col("b.island").alias("best"), "over")
        if epoch == EPOCHS - 1:
            best = best.withColumn("over", F.lit(True))
        ranked = cut(state.join(best, "block"))
        out = ranked.where("over and island = best").select("row", "block", F.col("own").alias("number"), "generations")
        over = out if over is None else over.union(out)
        state = ranked.where("not over").drop("best", "over")
        if not state.limit(1).count():
            break
        guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "row", F.col("own").alias("guest"))
        state = state.drop("guest").join(guests, ["block", "island", "row"]).select(*(c.split()[0] for c in _STATE.split(", ")))
    return over


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """documents -> PIECES' columns, sequence_id, offset, generations: one row per piece, in as few sequences as found.

    A null or empty text is the single id 0; rows with a null doc_id are left out; repeated rows are packed as often
    as they come. An empty table gives an empty table. Sequence ids are unique, not dense. generations: how many
    crossovers the island behind a piece's bin has tried, 0 for full pieces.
    """
    pieces = cut(token_pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()))
    none = F.lit(0).cast("long")
    out = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": none, "generations": F.lit(0)})
    rest = pieces.where(F.col("length") < capacity)
    for turn in range(len(SPARE) + 1):
        count = rest.count()
        if not count:
            break
        spare = SPARE[turn] if turn < len(SPARE) and count > BLOCK else None
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(-(-count // BLOCK))))
        placed = evolve(dealt.select("row", "length", "block"), capacity, turn)
        # A bin's pieces: bins are as large as a sequence at most.
        w = Window.partitionBy("block", "number").orderBy("row")
        fill = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        offset = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
        number = F.lit(turn).cast("long") * (1 << 56) + F.col("block") * (1 << 24) + F.col("number")
        packed = cut(dealt.drop("block").join(placed, "row").withColumns({"sequence_id": number, "offset": offset, "fill": fill}).select(*rest.columns, "sequence_id", "offset", "generations", "fill"))
        kept = F.lit(True) if spare is None else F.lit(capacity) - F.col("fill") <= spare
        out = out.unionByName(packed.where(kept).drop("fill"))
        if spare is None:
            break
        rest = packed.where(~kept).select(*rest.columns)
    return out.drop("row")
