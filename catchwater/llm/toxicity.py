"""Toxicity by two Kneser-Ney models of the letters of words, one of toxic and one of ordinary documents.

Both models have order 6 over the bytes of a word between a start and an end mark, and count a document's distinct words
once. Each class has its own counts of whole 6-grams, all of them; what their discounts leave goes to one shared model,
which is Kneser-Ney over all documents down to the single letter: whole counts at the top, continuation counts below. A
context of a class counts BACK events of the shared model besides its own, so a class that has hardly seen a context says
there what the shared model says. Both models sum to one over the letters after each context.

A word's evidence is the difference of both log-likelihoods; within DEAD of 0 it is chance and counts 0, for with the plain
sum the chance of a long text's ordinary words outweighs its few toxic ones (README). A document's evidence is the sum
over its words by their number; a logistic curve fitted on a fifth of the labelled sample makes it a probability.

The whole corpus gives the shared counts. Labels are learnt from at most labels.MAX_ROWS rows; the tables that go to the
executors hold all grams and contexts of these rows' texts, 16 bytes each.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from catchwater.llm import kernel as K
from catchwater.llm.labels import MAX_ROWS, held_out, logistic, sample
from catchwater.llm.session import cut, documents

ORDER, DISCOUNT, BACK, DEAD, THRESHOLD = 6, 0.75, 300.0, 1.5, 0.3
_START, _END, _LEAST = 2, 3, 4


def _distinct_words(data: np.ndarray, off: np.ndarray):
    """Of a run of texts: each distinct word's first start and end, each word's place among them, words before each text."""
    starts, ends, first = K.word_spans(data, off)
    _, at, where = np.unique(K.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    return starts[at], ends[at], where, first


def _grams(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams of each span between its marks, up to ORDER bytes each, and where each span's begin."""
    size = e - s + 2
    at = np.concatenate([[0], np.cumsum(size)])
    text = np.full(at[-1], _END, np.uint8)
    text[at[:-1]] = _START
    inner = np.arange(at[-1]) - np.repeat(at[:-1], size)
    body = (inner > 0) & (inner < np.repeat(size, size) - 1)
    text[body] = np.maximum(data[(inner - 1 + np.repeat(s, size))[body]], _LEAST)  # marks, and no gram with a leading 0
    key = text.astype(np.int64)
    for k in range(1, ORDER):
        key[k:] |= text[:-k].astype(np.int64) << (8 * k)
    key &= (np.int64(1) << 8 * np.minimum(inner + 1, ORDER)) - 1
    return key[inner > 0], at[:-1] - np.arange(len(s))


def _count(batches):
    """(gram, n0, n1, n): in ordinary, in toxic and in all documents of a batch, in each of their distinct words once.

    y is null where no label counts.
    """
    for batch in batches:
        y = batch.column("y").fill_null(2).to_numpy(zero_copy_only=False)
        data, off = K.flat(batch.column("text"))
        for i, j, part, at in K.groups(data, off):
            part = K.LOWER[part]
            s, e, where, first = _distinct_words(part, at)
            if not len(s):
                continue
            text, word = np.divmod(np.unique(np.repeat(np.arange(j - i), np.diff(first)) * len(s) + where), len(s))
            kind = y[i:j][text]
            keys, begin = _grams(part, s, e)
            per = np.diff(np.append(begin, len(keys)))
            grams, back = np.unique(keys, return_inverse=True)
            n = [np.bincount(back, np.repeat(np.bincount(word[kind == c] if c < 2 else word, minlength=len(s)), per), len(grams)).astype(np.int64) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grams, *n)], ["gram", "n0", "n1", "n"])


def _evidence(model, more=()):
    def score(batches):
        (keys, value), (contexts, apart) = model.value
        for batch in batches:
            data, off = K.flat(batch.column("text"))
            out = np.zeros(len(off) - 1)
            for i, j, part, at in K.groups(data, off):
                part = K.LOWER[part]
                s, e, where, first = _distinct_words(part, at)
                if len(s) and len(keys):
                    g, begin = _grams(part, s, e)
                    k, c = np.minimum(np.searchsorted(keys, g), len(keys) - 1), np.minimum(np.searchsorted(contexts, g >> 8), len(contexts) - 1)
                    words = np.add.reduceat(np.where(keys[k] == g, value[k], np.where(contexts[c] == g >> 8, apart[c], 0.0)), begin)
                    words[np.abs(words) <= DEAD] = 0.0
                    total = np.concatenate([[0], np.cumsum(words[where])])[first]
                    out[i:j] = np.diff(total) / np.maximum(np.diff(first), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), *(batch.column(c) for c in more)], ["doc_id", "x", *more])

    return score


def _shorter(column: str, length: int):
    """The last ``length`` letters."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * length) - 1))


def _discounted(count: str, kinds: str, below, total: str):
    return (F.greatest(F.col(count) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(kinds) * below) / F.col(total)


def continuations(grams: DataFrame) -> dict[int, DataFrame]:
    """By length from ORDER - 1 to 1: s, cont, the number of letters that come before the string s; ``grams``: gram."""
    out, above = {}, grams.where(F.col("gram") >= 1 << 8 * (ORDER - 1)).select(F.col("gram").alias("s"))
    for length in range(ORDER - 1, 0, -1):
        out[length] = cut(above.groupBy(_shorter("s", length).alias("s")).agg(F.count("*").alias("cont")))
        begin = grams.where(F.col("gram").between(1 << 8 * (length - 1), (1 << 8 * length) - 1)).select(F.col("gram").alias("s"))
        above = out[length].select("s").union(begin)
    return out


def lower_orders(levels: dict[int, DataFrame]) -> DataFrame:
    """s, below: the shared probability of the last letter of s after the others, for strings of each length."""
    last, every = None, None
    for length, rows in sorted(levels.items()):
        rows = rows.withColumn("ctx", F.shiftright("s", 8))
        rows = rows.join(rows.groupBy("ctx").agg(F.sum("cont").alias("total"), F.count("*").alias("kinds")), "ctx")
        if last is None:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            rows = rows.withColumn("short", _shorter("s", length - 1)).join(last.select(F.col("s").alias("short"), F.col("below").alias("lower")), "short")
        last = cut(rows.select("s", _discounted("cont", "kinds", F.col("lower"), "total").alias("below")))
        every = last if every is None else every.union(last)
    return every


def ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, value) and (ctx, apart): log ratios of toxic to ordinary, of each gram that a class has, and of any other
    letter after a context that a class has; ``grams``: gram, n0, n1, n.

    After a context that neither class has, both say what the shared model says, so the log ratio is 0.
    """
    own = [f(c) for c in ("n0", "n1") for f in (lambda c: F.sum(c).alias(f"own_{c}"), lambda c: F.count_if(F.col(c) > 0).alias(f"many_{c}"))]
    whole = grams.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("n").alias("seen"), F.count("*").alias("kinds"), *own).where("own_n0 + own_n1 > 0")
    apart = lambda c: F.log((DISCOUNT * F.col(f"many_{c}") + BACK) / (F.col(f"own_{c}") + BACK))
    whole = cut(whole.withColumn("apart", apart("n1") - apart("n0")))
    first = F.expr("case " + " ".join(f"when gram < {1 << 8 * (k + 1)}L then gram & {(1 << 8 * k) - 1}L" for k in range(1, ORDER)) + f" else gram & {(1 << 8 * (ORDER - 1)) - 1}L end")
    mine = grams.where("n0 + n1 > 0").withColumns({"s": first, "ctx": F.shiftright("gram", 8)})
    mine = mine.join(lower_orders(continuations(grams)), "s").join(whole, "ctx").withColumn("shared", _discounted("n", "kinds", F.col("below"), "seen"))
    log = lambda c: F.log((F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + (DISCOUNT * F.col(f"many_{c}") + BACK) * F.col("shared")) / (F.col(f"own_{c}") + BACK))
    return mine.select("gram", (log("n1") - log("n0")).alias("value")), whole.select("ctx", "apart")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, more: tuple[str, ...] = ()) -> DataFrame:
    """documents and labels(doc_id, toxic) -> doc_id, held_out, score, predicted, and the columns in ``more``: one row for each document.

    A text without words (null, empty, white space) has no evidence and gets the score of evidence 0. Rows with a null
    doc_id are left out; repeated rows each get their row. Without labels every score is 0.5 and less sure classes
    follow the labels' rates. An empty table gives an empty table.
    """
    docs = documents(docs, *more)
    spark = docs.sparkSession
    chosen = cut(sample(labels, "toxic", max_rows))
    learn = F.broadcast(chosen.where("part = 0").select("doc_id", "y"))  # bounded by max_rows
    grams = cut(docs.join(learn, "doc_id", "left").select("text", "y").mapInArrow(_count, "gram long, n0 long, n1 long, n long").groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "n"))))
    tables = [df.orderBy(df.columns[0]).toPandas() for df in ratios(grams)]  # grams and contexts of the max_rows labelled texts
    model = spark.sparkContext.broadcast([(x.iloc[:, 0].to_numpy(np.int64), x.iloc[:, 1].to_numpy(np.float64)) for x in tables])
    seen = docs.join(F.broadcast(chosen.where("part = 1").select("doc_id", "y")), "doc_id")
    x, y = (np.array(c, np.float64) for c in zip(*[(r.x, r.y) for r in seen.select("doc_id", "text").mapInArrow(_evidence(model), "doc_id long, x double").join(chosen, "doc_id").select("x", "y").collect()] or [(0.0, 0)]))
    w = logistic(x[:, None], y)
    out = docs.mapInArrow(_evidence(model, more), StructType([StructField("doc_id", LongType()), StructField("x", DoubleType()), *(docs.schema[c] for c in more)]))
    score = 1 / (1 + F.exp(-(F.col("x") * float(w[0]) + float(w[1]))))
    return out.select("doc_id", held_out().alias("held_out"), score.alias("score"), *more).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
