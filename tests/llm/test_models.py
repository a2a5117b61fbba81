"""The two classifiers on made-up documents, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.llm.labels import logistic
from catchwater.llm.quality import Network, quality
from catchwater.llm.toxicity import toxicity

WORDS = [a + b for a in "ba ro ti lu me ska".split() for b in "na ki do re sum vel".split()]


def say(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def labelled(spark, make_docs, spoil, column):
    rng = random.Random(6)
    texts, marks = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = say(rng, 60)
        texts.append(spoil(rng, text) if bad else text)
        marks.append((i, int(bad)))
    texts += [None, "", "\n"]
    y = spark.createDataFrame([(i, b if column == "toxic" else 1 - b) for i, b in marks] + [(None, 1), (5, None)], f"doc_id long, {column} int")
    return make_docs(texts), y, dict(marks)


@pytest.mark.parametrize("case", ["toxic", "quality"])
def test_held_out(spark, make_docs, case):
    def insult(rng, text):
        words = text.split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(["grubfex", "grubmol", "snarlig"]))
        return " ".join(words)

    spoil, score = (insult, toxicity) if case == "toxic" else (lambda rng, t: t.replace(" ", rng.choice(["*** ", "%% ", "!! "])).upper(), quality)
    docs, y, marks = labelled(spark, make_docs, spoil, case)
    rows = score(docs, y).collect()
    assert len(rows) == 903 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    right = np.mean([(r.predicted == 1) == (marks[r.doc_id] == (1 if case == "toxic" else 0)) for r in held])
    assert len(held) > 100 and right > 0.97


@pytest.mark.parametrize("case,score", [("toxic", toxicity), ("quality", quality)])
def test_no_labels_and_empty_tables(spark, make_docs, case, score):
    none = spark.createDataFrame([], f"doc_id long, {case} int")
    docs = make_docs([(1, "some text"), (None, "x"), (2, None), (2, None)])
    assert len(score(docs, none).collect()) == 3
    assert score(docs.where("doc_id > 9"), none).count() == 0
    one = spark.createDataFrame([(1, 1)], f"doc_id long, {case} int")
    assert len(score(docs, one).collect()) == 3


def test_temperature_and_logistic():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + rng.normal(0, 0.3, 600) > 0).astype(float)
    net = Network(x[:400], y[:400], steps=300).calibrate(x[400:], y[400:])
    assert np.mean((net.score(x[400:]) > 0.5) == y[400:]) > 0.85 and 0.2 <= net.temperature <= 10
    w = logistic(x[:, :1], y)
    assert w[0] > 1


def brute_kneser_ney(texts, marks, order=6):
    """(class, context, letter) -> probability, over dictionaries and strings; class 2 is the shared model."""
    from catchwater.llm import toxicity as t

    count = [{}, {}, {}]
    for text, mark in zip(texts, marks):
        for word in set(text.encode().lower().split()):
            whole = b"\2" + bytes(max(x, 4) for x in word) + b"\3"
            for k in range(1, len(whole)):
                g = whole[max(0, k - order + 1) : k + 1]
                for c in {2, mark} - {None}:
                    count[c][g] = count[c].get(g, 0) + 1
    cont, above = {}, {g for g in count[2] if len(g) == order}
    for m in range(order - 1, 0, -1):
        cont[m] = {}
        for g in above:
            cont[m][g[1:]] = cont[m].get(g[1:], 0) + 1
        above = set(cont[m]) | {g for g in count[2] if len(g) == m}

    def kn(table, s, below):
        after = [n for g, n in table.items() if g[:-1] == s[:-1] and len(g) == len(s)]
        return (max(table.get(s, 0) - t.DISCOUNT, 0) + t.DISCOUNT * len(after) * below) / sum(after)

    def lower(s):
        return kn(cont[len(s)], s, lower(s[1:])) if s else 1 / 256

    def p(c, g):
        shared = kn(count[2], g, lower(g[1:]))
        if c == 2:
            return shared
        after = [n for x, n in count[c].items() if x[:-1] == g[:-1]]
        return (max(count[c].get(g, 0) - t.DISCOUNT, 0) + (t.DISCOUNT * len(after) + t.BACK) * shared) / (sum(after) + t.BACK)

    return count, p


def test_kneser_ney_by_dictionaries(spark, make_docs):
    from catchwater.llm import toxicity as t

    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abc\x00\x02é") for _ in range(rng.randrange(1, 9))) for _ in range(12)) for _ in range(50)] + ["abcabc abc", "abc abc"]
    marks = [rng.choice((0, 0, 1, None)) for _ in texts]
    rows = make_docs(texts).join(spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, y int"), "doc_id")
    grams = rows.select("text", "y").mapInArrow(t._count, "gram long, n0 long, n1 long, n long").groupBy("gram").sum("n0", "n1", "n").toDF("gram", "n0", "n1", "n")
    count, p = brute_kneser_ney(texts, marks)
    name = lambda g: g.to_bytes(6, "big").lstrip(b"\0")
    assert {name(r.gram): (r.n0, r.n1, r.n) for r in grams.collect()} == {g: tuple(count[c].get(g, 0) for c in range(3)) for g in count[2]}
    values, contexts = ({name(r[0]): r[1] for r in df.collect()} for df in t.ratios(grams))
    assert set(values) == set(count[0]) | set(count[1]) and set(contexts) == {g[:-1] for g in values}
    for g in values:
        assert values[g] == pytest.approx(np.log(p(1, g) / p(0, g)), abs=1e-9)
    for g in set(count[2]) - set(values):
        assert contexts.get(g[:-1], 0.0) == pytest.approx(np.log(p(1, g) / p(0, g)), abs=1e-9)
    for ctx in (b"\2", b"\2a", b"\2abca"):
        for c in range(3):
            assert sum(p(c, ctx + bytes([x])) for x in range(256)) == pytest.approx(1, abs=0.02)  # the base gives unseen letters 1 / 256


def test_word_vectors_and_pooling_by_loops(spark, make_docs):
    import re

    from catchwater.llm import quality as q

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "Cd", "EFG", "12", "#*", "naïve", "longword"]) for _ in range(rng.randrange(0, 30))) for _ in range(40)] + [None, "", " \n", "ab#12 ab"]
    at, sign = q.index_vectors()

    def words(text):
        data = np.frombuffer(text.encode(), np.uint8)
        w, s, _ = q._places(data, np.array([0, len(data)]))
        assert len(w) == len(re.findall(rb"[0-9]+|[A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", text.encode()))
        return list(zip(w.tolist(), s.tolist()))

    want = np.zeros((q.PLACES + q.SHAPES, q.SIZE))
    for text in texts:
        own = words(text or "")
        for i, pair in enumerate(own):
            for d in range(-q.WINDOW, q.WINDOW + 1):
                if d and 0 <= i + d < len(own):
                    for k, x in zip(at[own[i + d][0]], sign[own[i + d][0]]):
                        for place in pair:
                            want[place, (k + d) % q.SIZE] += x
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    docs = make_docs(texts).repartition(5)
    got = q.word_vectors(docs)
    assert np.allclose(got, want, atol=1e-5)
    model = spark.sparkContext.broadcast(got)
    for r in docs.selectExpr("doc_id", "coalesce(text, '') as text").mapInArrow(q._pooled(model), "doc_id long, x array<float>").collect():
        own = words(texts[r.doc_id] or "")
        mean = [np.mean([want[p[k]] for p in own], axis=0) if own else np.zeros(q.SIZE) for k in (0, 1)]
        assert np.allclose(r.x, np.concatenate(mean), atol=1e-5)


def test_long_texts_and_clashing_columns(spark, make_docs):
    docs = make_docs([(1, "word " * 300_000), (2, "x" * 500_000), (3, None), (4, " \n"), (4, " \n")]).withColumns({n: F.lit("x") for n in ("x", "y", "h", "n", "score", "held_out", "toxic", "quality", "gram")})
    y = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 1, "x"), (2, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for score in (toxicity, quality):
        rows = score(docs, y).collect()
        assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 4] and all(0 <= r.score <= 1 for r in rows)
        assert len({round(r.score, 9) for r in rows if r.doc_id > 2}) == 1
