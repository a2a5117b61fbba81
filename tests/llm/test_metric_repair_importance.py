"""Metric join, conversation repair and importance resampling against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.llm import importance, metric, repair

WORD = re.compile("[^\x20\x09-\x0d]+")
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def with_odd_rows(docs):
    none = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    extra = docs.limit(1).withColumns({"doc_id": F.lit(999).cast("long"), "text": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    return docs.union(none).union(extra).union(extra).withColumns({n: F.lit("x") for n in ("n_shingles", "items", "key", "pivot", "weight", "score", "place", "p", "own", "component_id")})


def components(sets):
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            least[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("block, small", [(256, 3), (4, 24)])
def test_metric_join(make_docs, odd_texts, block, small, monkeypatch):
    for name, value in (("BLOCK", block), ("LEAF", small), ("PIVOTS", 3)):
        monkeypatch.setattr(metric, name, value)
    rng = random.Random(7)
    texts = list(odd_texts)
    for family in range(4):  # copies at every distance from each other, and a passage that all share
        base = [f"w{family}x{i}" for i in range(80)]
        for _ in range(16):
            words = [w if rng.random() > 0.012 * family else f"z{rng.randrange(10**6)}" for w in base]
            texts.append(" ".join(words + ["common"] * rng.randrange(3) + [f"p{i}" for i in range(30)]))
    texts += ["a b c d", "A  b\tc d", "a b c", "a b c d e", "x " * 300, "y " * 300, " ".join(f"q{i}" for i in range(9)), " ".join(f"q{i}" for i in range(10))]  # 5 of 6 shingles; 4 of 4 and 5 ...
    texts += [" ".join(f"r{i}" for i in range(8)), " ".join(f"r{i}" for i in range(9)), "long " + " ".join(f"l{i}" for i in range(20_000)), "longer " + " ".join(f"l{i}" for i in range(20_000))]  # exactly 4 of 5
    got = {r.doc_id: r for r in metric.linked(with_odd_rows(make_docs(texts))).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)} | {999: set()}
    assert {i: r.component_id for i, r in got.items()} == components(sets)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_space_joins_by_cells(monkeypatch):
    rng = np.random.default_rng(3)
    sets = []
    for family in range(30):
        base = rng.integers(0, 1 << 60, 60, np.uint64)
        for _ in range(int(rng.integers(1, 12))):
            some = base.copy()
            k = int(rng.integers(0, 12))
            some[:k] = rng.integers(0, 1 << 60, k, np.uint64)
            sets.append(np.unique(some))
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ids = np.arange(len(sets))
    space = metric.Space(ids, np.full(len(sets), 2), ids, np.concatenate(sets), at)
    pairs = []
    whole = metric.Space.pairwise
    monkeypatch.setattr(metric.Space, "pairwise", lambda self, members: (pairs.append(len(members)), whole(self, members)))
    space.join(ids)
    assert len(pairs) > 5 and sum(n * n for n in pairs) < len(sets) ** 2 / 4
    want = components({i: set(s.tolist()) for i, s in enumerate(sets)})
    found = {}
    for i, g in enumerate(space.group):
        found.setdefault(int(g), []).append(i)
    assert all(len({want[i] for i in m}) == 1 and len(m) == sum(want[j] == want[m[0]] for j in ids) for m in found.values())


def language(roles):
    return bool(re.fullmatch("(s?(ua)+)?", roles))


def cheapest(rows):
    """(cost, audit, repaired) by trying all edits: rows are (role, text, fault)."""
    best = None
    slots = [("", ())] + [("I" * n, roles) for n in (1, 2) for roles in itertools.product(("user", "assistant"), repeat=n)]
    options = []
    for role, text, fault in rows:
        extra = 3 if fault == "truncated" else 0
        some = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            some += [(extra, "K", (role, text)), (3 + extra, "R", ("user", text)), (3 + extra, "R", ("assistant", text))]
        options.append(some)
    for gaps in itertools.product(slots, repeat=len(rows) + 1):
        inserts = sum(3 * len(g[0]) for g in gaps)
        if best and inserts > best[0]:
            continue
        for edits in itertools.product(*options):
            cost = inserts + sum(e[0] for e in edits)
            if best and cost > best[0]:
                continue
            out, audit = [(r, "") for r in gaps[0][1]], gaps[0][0]
            for (_, letter, kept), gap in zip(edits, gaps[1:]):
                out += ([kept] if kept else []) + [(r, "") for r in gap[1]]
                audit += letter + gap[0]
            if language("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (-1 if r[0] is None else r[0], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


def report(rows):
    rows, seen, faults = damage(rows), set(), []
    for _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return rows, faults, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, illegal


def conversations(seed, n, longest):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["One.", "Two!", "cut", "cut.", " \n", None, "Three? \t", "é."]
    rows = [(i, rng.choice([t, t, t, t + 1, None]) if rng.random() < 0.2 else t, rng.choice(roles), rng.choice(texts)) for i in range(n) for t in range(rng.randrange(longest) + 1)]
    return [(None if i == 3 else i, *r) for i, *r in rows]


def test_repair_against_all_edits(spark):
    rows = conversations(5, 60, 3) + [(70, 4, None, None), (70, 4, None, None), (71, None, None, None)]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({n: F.lit("x") for n in ("k", "same", "copies", "audit", "code", "kind")})
    got = {r.conv_id: r for r in repair.repair(repair.damaged(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own, faults, gaps, illegal = report([x for x in rows if x[0] == conv])
        assert (r.gaps, r.illegal, r.blank, r.duplicate, r.truncated) == (gaps, illegal, *(faults.count(f) for f in ("blank", "duplicate", "truncated")))
        if len(own) <= 3:
            cost, audit, text = cheapest([(role, text, f) for (_, role, text), f in zip(own, faults)])
            assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def by_states(rows, faults):
    """(cost, audit) row by row, by the last role."""
    ways = {0: (0, "")}
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def closed(ways):
        for _ in range(3):
            for (q, x), r in steps.items():
                if q in ways and x != "s":
                    ways[r] = min(ways.get(r, (10**9, "")), (ways[q][0] + 3, ways[q][1] + "I"))
        return ways

    ways = closed(ways)
    for (_, role, _), fault in zip(rows, faults):
        after = {q: (c + 4, a + "D") for q, (c, a) in ways.items()}
        for (q, x), r in steps.items():
            if q in ways and fault not in ("blank", "duplicate"):
                own = role[:1] == x
                if own or x != "s":
                    cost = ways[q][0] + (0 if own else 3) + (3 if fault == "truncated" else 0)
                    after[r] = min(after.get(r, (10**9, "")), (cost, ways[q][1] + ("K" if own else "R")))
        ways = closed(after)
    return min(ways[q] for q in (0, 3) if q in ways)


def test_long_conversations_go_by_stretches(spark):
    rows = conversations(9, 12, 40) + conversations(10, 1, 1) + [(500, t, ["user", "assistant", "system", "x"][t * 7 % 11 % 4], f"line {t}" + ".,"[t % 5 == 0]) for t in range(700)]
    got = {r.conv_id: r for r in repair.repair(repair.damaged(spark.createDataFrame(rows, CONVERSATIONS))).collect()}
    for conv, r in got.items():
        own, faults, _, _ = report([x for x in rows if x[0] == conv])
        assert (r.cost, r.audit) == by_states(own, faults)
        k, out, total = 0, [], (len(r.audit) - r.audit.count("D")) % 2
        for letter in r.audit:
            target = "assistant" if (len(out) - total) % 2 else "user"
            if letter in "KR":
                out.append(f"{own[k][1] if letter == 'K' else target}:{own[k][2]}")
            elif letter == "I":
                out.append(f"{target}:")
            k += letter != "I"
        assert k == len(own) and r.repaired_sha256 == hashlib.sha256("\n".join(out).encode()).hexdigest()
    assert len(got[500].audit) > 600


def test_charts_take_every_split():
    rng = random.Random(1)
    for _ in range(200):
        codes = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(1, 12)))
        names = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "tool"}
        faults = ["blank" if c == "d" else "truncated" if c.isupper() else "" for c in codes]
        whole = repair.parsed(codes)
        assert min(whole[0, end] for end in repair.ENDS if (0, end) in whole) == by_states([(0, names[c.lower()], "") for c in codes], faults)


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 50)])
def test_resample(make_docs, spark, odd_texts, longest, buckets):
    texts = odd_texts + ["A1 b-C_d" * 30, "é" * 70 + " " + "x" * 3000, "same text of words " * 8, "same text of words " * 8]
    target = spark.createDataFrame([(1, "heath shore x1 don't"), (2, None), (3, "ring ring")], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    docs = with_odd_rows(make_docs(texts))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = word.findall(lower(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    all_docs = list(enumerate(texts)) + [(999, None), (999, None)]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, text in all_docs:
        np.add.at(s, features(text)[1], 1)
    for text in ("heath shore x1 don't", "ring ring"):
        np.add.at(t, features(text)[1], 1)
    gain = np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(int)
    want = []
    for i, text in all_docs:
        n_words, found = features(text)
        weight = int(gain[found].sum()) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(found), weight, weight + int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296)))), n_words])
    order = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    drawn = {r[0]: k + 1 for k, r in enumerate(order[: 10 * len(order) // 100])}
    got = importance.resample(docs, target, longest, buckets).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(tuple(r[:4]) for r in want)
    assert {r.doc_id: r["rank"] for r in got if r["rank"]} == drawn and drawn


def test_crc_of_long_and_short_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 60_000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 40_000, 900))
    ends = starts + rng.choice([1, 2, 5, 63, 64, 65, 128, 129, 1000, 9000], 900)
    assert importance.crc32(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def test_empty_tables(make_docs, spark):
    none = make_docs(["x"]).where("doc_id < 0")
    assert metric.linked(none).count() == 0
    assert importance.resample(none, none).count() == 0
    assert repair.repair(repair.damaged(spark.createDataFrame([], CONVERSATIONS))).count() == 0
    few = importance.resample(make_docs(["word " * 30] * 12), none).collect()
    assert sorted(r["rank"] for r in few if r["rank"]) == [1] and [r.doc_id for r in few if r["rank"]] == [max(few, key=lambda r: (r.score, -r.doc_id)).doc_id]
