"""Quality scores: random-indexing word vectors, pooled per document, into a two-layer network with calibrated output.

Words are runs of letters, digits or signs. A word's place is a hash of it, so every word of the corpus has one and no
vocabulary is cut off; besides, each word has a place for its shape (kind of signs, case, length), or, if it repeats a
word just before, one for that. Each place has a fixed random ternary index vector, and its vector is the sum of the
index vectors of its words' neighbours, rolled by their distance, over all documents, made unit length. A document is
the mean of its words' vectors beside the mean of their shapes' vectors. A numpy network of two layers is trained on a
bounded sample of labelled rows, and one temperature, fitted on rows that the training left out, calibrates it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catchwater.llm import kernel as K
from catchwater.llm.labels import held_out, sample
from catchwater.llm.session import cut, documents

#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 12_000
#: Places of words and of shapes, and which neighbours count: the table of all vectors has a fixed size of 6 MB.
PLACES, SHAPES, SIZE, ONES, WINDOW, NEAR, HIDDEN, THRESHOLD = 1 << 14, 64, 96, 4, 2, 4, 32, 0.7

_KIND = np.full(256, 2, np.uint8)  # signs
_KIND[K.SPACE] = 0
for _a, _b in ((48, 58),):
    _KIND[_a:_b] = 1
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 3
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """A fixed sparse ternary vector for each place: where its entries are, and their signs."""
    rng = np.random.default_rng(71)
    at = np.argpartition(rng.random((PLACES + SHAPES, SIZE)), ONES, axis=1)[:, :ONES]
    return at, rng.choice([-1.0, 1.0], (PLACES + SHAPES, ONES))


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of the runs, and how many come before each text."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    change = edge.copy()
    change[1:-1] |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(change)
    s, e = cuts[:-1], cuts[1:]
    keep = kind[s] > 0 if len(s) else np.zeros(0, bool)
    s, e = s[keep], e[keep]
    caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
    n = caps[e] - caps[s]
    case = np.where(n == 0, 0, np.where(n * 2 > e - s, 2, 1))
    case = np.where((n == 1) & (e - s == 1), 1, case)
    shape = (kind[s].astype(np.int64) - 1) * 20 + case * 6 + np.minimum((e - s - 1) // 2, 5)
    h, first = K.hash_spans(data, s, e).view(np.int64), np.searchsorted(s, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    for d in range(1, NEAR + 1):
        again = (h[d:] == h[:-d]) & (text[d:] == text[:-d]) & (kind[s[d:]] == 3) & (e[d:] - s[d:] > 2)
        shape[d:][again] = SHAPES - 1
    return h, shape, first


def _places(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of words and of their shapes, and how many words come before each text."""
    h, shape, first = _words(data, off)
    return (h.view(np.uint64) >> np.uint64(64 - 14)).astype(np.int64), PLACES + shape, first


def neighbours(batches):
    """Of a task's texts: for each place that occurs the sum of its neighbours' index vectors, as rows of bytes."""
    at, sign = index_vectors()
    total = np.zeros((PLACES + SHAPES) * SIZE)
    for batch in batches:
        data, off = K.flat(batch.column("text"))
        for _, _, part, begin in K.groups(data, off, 2 << 20):
            word, shape, first = _places(part, begin)
            text = np.repeat(np.arange(len(begin) - 1), np.diff(first))
            for d in range(1, WINDOW + 1):
                same = np.flatnonzero(text[d:] == text[:-d])
                for far, one, other in ((-d, same + d, same), (d, same, same + d)):
                    spot, signs = (at[word[other]] + far) % SIZE, sign[word[other]].reshape(-1)
                    key = [(place[one][:, None] * SIZE + spot).reshape(-1) for place in (word, shape)]
                    total += np.bincount(np.concatenate(key), np.concatenate([signs, signs]), len(total))
    rows = total.reshape(-1, SIZE)
    some = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some), K.list_array(rows[some].reshape(-1), np.arange(len(some) + 1) * SIZE)], ["place", "v"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit vectors of all places, over all documents; tasks' sums meet by place."""
    found = docs.select("text").mapInArrow(neighbours, "place long, v array<double>")
    summed = found.groupBy("place").agg(F.array(*(F.sum(F.get("v", F.lit(k))) for k in range(SIZE))).alias("v"))
    out = np.zeros((PLACES + SHAPES, SIZE))
    for batch in summed.select("place", F.transform("v", lambda x: x.cast("float")).alias("v")).toArrow().to_batches():  # a row a place
        out[batch.column("place").to_numpy()] = batch.column("v").flatten().to_numpy().reshape(-1, SIZE)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pooled(vectors):
    """doc_id, and the means of the text's word vectors and of its shape vectors."""

    def apply(batches):
        v = vectors.value
        for batch in batches:
            data, off = K.flat(batch.column("text"))
            for i, j, part, at in K.groups(data, off, 1 << 19):
                word, shape, first = _places(part, at)
                n, out = np.diff(first), np.zeros((j - i, 2 * SIZE), np.float32)
                full = np.flatnonzero(n)
                for half, place in enumerate((word, shape) if len(full) else ()):
                    out[full, half * SIZE : (half + 1) * SIZE] = np.add.reduceat(v[place], first[:-1][full], axis=0)
                out /= np.maximum(n, 1)[:, None]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), K.list_array(out.reshape(-1), np.arange(j - i + 1) * 2 * SIZE)], ["doc_id", "x"])

    return apply


class Network:
    """tanh layer and logistic output, trained by Adam on balanced batches; a temperature divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, rate: float = 0.01, decay: float = 1e-4):
        rng = np.random.default_rng(5)
        self.mean, self.scale, self.temperature = x.mean(0), x.std(0) + 1e-6, 1.0
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
        m, s = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for step in range(1, steps + 1):
            at = rng.integers(0, len(z), min(256, len(z)))
            a = np.tanh(z[at] @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30))) - y[at]) / len(at)
            back = d[:, None] * w[2] * (1 - a * a)
            for k, g in enumerate((z[at].T @ back + decay * w[0], back.sum(0), a.T @ d + decay * w[2], d.sum(keepdims=True))):
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        return np.tanh((x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Network":
        """The temperature with the least log loss on rows that training has not seen."""
        if len(x):
            z = self.logit(x)
            loss = lambda t: np.mean(np.logaddexp(0, z / t) - y * z / t)
            self.temperature = min(np.geomspace(0.2, 10, 80), key=loss)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """documents and labels(doc_id, quality) -> doc_id, held_out, score, predicted: one row for each document.

    A text without words (null, empty, white space) pools to the zero vector and gets that vector's score. Rows with a
    null doc_id are left out; repeated rows each get their row. Without labels, or with one class only, every score is
    0.5 or that class. An empty table gives an empty table.
    """
    docs = documents(docs)
    context = docs.sparkSession.sparkContext
    chosen = cut(sample(labels, "quality", max_rows))
    learn = cut(docs.join(F.broadcast(chosen), "doc_id").repartition(16, "doc_id"))  # max_rows rows at most
    model = context.broadcast(word_vectors(docs))
    rows = learn.select("doc_id", "text").mapInArrow(_pooled(model), "doc_id long, x array<float>").join(chosen, "doc_id").orderBy("doc_id").collect()
    x = np.array([r.x for r in rows], np.float64).reshape(-1, 2 * SIZE)
    y, part = np.array([r.y for r in rows], np.float64), np.array([r.part for r in rows])
    if len(rows) and (part == 0).any():
        network = Network(x[part == 0], y[part == 0]).calibrate(x[part == 1], y[part == 1])
    else:
        network = Network(np.zeros((1, 2 * SIZE)), np.array([0.5]))
    net = context.broadcast(network)

    def scored(batches):
        for batch in _pooled(model)(batches):
            at = batch.column("x").values.to_numpy().reshape(-1, 2 * SIZE)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.value.score(at))], ["doc_id", "score"])

    out = docs.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
