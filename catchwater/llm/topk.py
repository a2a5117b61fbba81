"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's dimensions form LISTS lists; in each, every candidate has a partial score for a query.

1. Each block of candidates gives, per query and list, its k largest partial scores; their candidates' whole scores are
   true scores, so the k-th best of all blocks is a safe cutoff t: the true k-th score is t or more.
2. The cutoffs go to all blocks. A score of t or more needs a partial score of t / LISTS or more in some list: only the
   entries of a list that reach it are collected.
3. Only collected entries get their other lists' partial scores, pair by pair, and exact sums decide.

Candidates are packed in blocks and dealt to slices; blocks of queries visit every slice, as small whole numbers. Each
block passes on k rows a query at most, as a row that k others of its block beat cannot be among the first k.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from catchwater.llm.session import cut

K, LISTS, ROWS, QUERIES = 5, 2, 1024, 256
_NONE = np.iinfo(np.int64).min
_BLOCK = "dim int, block long, kind string, rows binary, ids binary, vectors binary, cut binary"


def integers(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v, row: each component times 256, rounded down; without vectors that are null or hold null or non-finite ones.

    Every row stays, also where vec_ids repeat. Write the result before it is used twice: row is a number given as it runs.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * 256)).alias("v"), F.monotonically_increasing_id().alias("row"))


def _blocks(size: int):
    def pack(batches):
        for batch in batches:
            ids, row, v = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("row").to_numpy(zero_copy_only=False), batch.column("v")
            off, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            least = batch.column("t").fill_null(_NONE).to_numpy(zero_copy_only=False)
            dims, out = np.diff(off), []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), size):
                    some = at[i : i + size]
                    matrix = flat[off[some][:, None] + np.arange(dim)]
                    kind = next((x for x in ("i2", "i4") if np.abs(matrix).max(initial=0) <= np.iinfo(x).max), "i8")
                    out.append({"dim": int(dim), "block": int(row[some[0]]), "kind": kind, "rows": row[some].tobytes(), "ids": ids[some].tobytes(), "vectors": matrix.astype(kind).tobytes(), "cut": least[some].tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("kind", pa.string()), *((x, pa.binary()) for x in ("rows", "ids", "vectors", "cut"))]))

    return pack


def _lists(dim: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dim, LISTS + 1).astype(int)
    return list(zip(cuts, cuts[1:]))


def _floats(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in float64 where all sums are exact there, which is far faster, or else in int64."""
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(q.shape[1], 1)
    kind = np.float64 if bound < 2.0**52 else np.int64
    return q.astype(kind), c.astype(kind)


def heads(q: np.ndarray, c: np.ndarray, k: int) -> list[np.ndarray]:
    """Phase 1: for each query the candidates with the k largest partial scores of each list."""
    n, found = min(k, len(c)), []
    for a, b in _lists(q.shape[1]):
        partial = q[:, a:b] @ c[:, a:b].T
        found.append(np.argpartition(-partial, n - 1, axis=1)[:, :n])
    return [np.unique(x) for x in np.concatenate(found, axis=1)]


def collected(q: np.ndarray, c: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, candidate, whole score) of all entries with a partial score of least / LISTS in some list."""
    pairs = [np.zeros(0, np.int64)]
    low = np.where(least == _NONE, -np.inf, least.astype(float))
    for a, b in _lists(q.shape[1]):
        # Rounded down by a hair: a few entries too many do not hurt, and the exact sums decide.
        pairs.append(np.flatnonzero(q[:, a:b] @ c[:, a:b].T >= (low / LISTS - 1 - np.abs(low) * 1e-15)[:, None]))
    i, j = np.divmod(np.unique(np.concatenate(pairs)), len(c))
    score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("nd,nd->n", q[i[s : s + 65536]], c[j[s : s + 65536]]).astype(np.int64) for s in range(0, len(i), 65536))])
    keep = score >= np.where(least == _NONE, _NONE, least)[i]
    return i[keep], j[keep], score[keep]


def _meet(k: int, last: bool):
    def meet(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            for x in batch.to_pylist():
                c_row, c_ids, q_row, q_ids, least = (np.frombuffer(x[name], np.int64) for name in ("rows", "ids", "q_rows", "q_ids", "q_cut"))
                c, q = np.frombuffer(x["vectors"], x["kind"]).reshape(len(c_ids), x["dim"]), np.frombuffer(x["q_vectors"], x["q_kind"]).reshape(len(q_ids), x["dim"])
                q, c = _floats(q, c)
                if last:
                    i, j, score = collected(q, c, least)
                    spots = [(j[a:b], score[a:b]) for a, b in zip(*(np.searchsorted(i, np.arange(len(q)) + z) for z in (0, 1)))]
                else:
                    spots = [(at, (c[at] @ one).astype(np.int64)) for at, one in zip(heads(q, c, k + 1), q)]
                for n, (at, score) in enumerate(spots):
                    other = c_row[at] != q_row[n]
                    at, score = at[other], score[other]
                    best = np.lexsort((c_row[at], c_ids[at], -score))[:k]
                    for column, value in zip(out, (np.full(len(best), q_row[n]), np.full(len(best), q_ids[n]), c_ids[at][best], score[best])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], ["row", "query_id", "vec_id", "score"])

    return meet


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """integers()'s rows of candidates and of queries -> query_id, rank, vec_id, score: each query's k best other rows.

    Ties go to the smaller vec_id. Vectors meet only vectors of their own length. Rows that repeat a vec_id are queries
    and candidates of their own. A query without candidates has no rows; an empty table gives an empty table.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("long").alias("t")
    blocks = cut(rows.select("vec_id", "row", "v", none).mapInArrow(_blocks(ROWS), _BLOCK)).withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices))).drop("cut")

    def meet(asked: DataFrame, last: bool) -> DataFrame:
        own = [F.col(x).alias(f"q_{x}") for x in ("kind", "rows", "ids", "vectors", "cut")]
        packed = asked.mapInArrow(_blocks(QUERIES), _BLOCK).select("dim", F.explode(F.expr(f"sequence(0L, {slices - 1}L)")).alias("slice"), *own)
        return blocks.join(packed, ["dim", "slice"]).drop("slice", "block").mapInArrow(_meet(k, last), "row long, query_id long, vec_id long, score long")

    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    found = meet(queries.select("vec_id", "row", "v", none), False).withColumn("rank", F.row_number().over(order)).where(f"rank = {k}")
    asked = cut(queries.select("vec_id", "row", "v").join(found.select("row", F.col("score").alias("t")), "row", "left"))
    return meet(asked, True).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
