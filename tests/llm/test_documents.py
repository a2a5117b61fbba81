"""Document operators against brute force, with nulls, empties, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from catchwater.llm import bpe, graph, kernel, minhash, packing, rules, suffix, toxicity
from catchwater.llm.minhash import near_duplicates
from catchwater.llm.packing import breed, pack
from catchwater.llm.rules import judge
from catchwater.llm.suffix import remove_repeats


def clash(docs):
    """Extra columns whose names the operators use inside."""
    names = ["n_shingles", "h1", "kept", "chunk", "row", "sequence_id", "text_", "score", "component_id", "key"]
    return docs.withColumns({n: F.lit("x") for n in names})


def with_odd_rows(docs):
    """A row without id, and every row of id 7 twice."""
    return docs.union(docs.where("doc_id = 7")).union(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(make_docs, odd_texts, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = {r.doc_id: r for r in near_duplicates(clash(with_odd_rows(make_docs(odd_texts)))).collect()}
    sets = {i: shingles(t) for i, t in enumerate(odd_texts)}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in sets}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_small_tables_take_few_tasks(spark, make_docs, monkeypatch):
    """With many shuffle partitions the tables between steps don't get one task for each, and the groups stay the same."""
    words = [f"w{i}" for i in range(60)]
    docs = make_docs([(i, " ".join(words[:-1] + [f"x{i}"])) for i in range(0, 90, 3)] + [(i, f"{i} alone") for i in range(1, 90, 3)])
    tasks, cut = [], minhash.cut

    def counted(df):
        tasks.append((out := cut(df)).rdd.getNumPartitions())
        return out

    for module in (minhash, graph):
        monkeypatch.setattr(module, "cut", counted)
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 0 if i % 3 == 0 else i for i in got} and len(got) == 60
    assert sum(n > 8 for n in tasks) <= 1  # only the links on the way to their count


@pytest.mark.parametrize("hot", [20_000, 2])
def test_remove_repeats(make_docs, odd_texts, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    first, want = {}, {}
    for i, t in enumerate(odd_texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        want[i] = bytes(np.frombuffer(b, np.uint8)[~gone])
    rows = remove_repeats(clash(with_odd_rows(make_docs(odd_texts)))).collect()
    assert len(rows) == len(odd_texts) + 1
    assert all(bytes(r.kept) == want[r.doc_id] for r in rows)
    assert all(sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_bytes - len(r.kept) for r in rows)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n in (1, 2, 60, 900):
        text = rng.integers(97, 99, n).astype(np.uint8)
        order, words = suffix.suffix_array(text)
        cut = [text.tobytes()[i : i + 56].ljust(56, b"\0") for i in order]
        assert sorted(order.tolist()) == list(range(n)) and all(a <= b for a, b in zip(cut, cut[1:]))
        want = [0] + [next((k for k in range(56) if a[k] != b[k]), 56) for a, b in zip(cut, cut[1:])]
        assert suffix.common_prefixes(order, words).tolist() == want


def test_bpe_matches_the_library(make_docs, odd_texts):
    import base64

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = clash(with_odd_rows(make_docs(odd_texts)))
    coded = bpe.encode(docs, path)
    for r in coded.collect():
        text = odd_texts[r.doc_id] or ""
        assert list(r.ids) == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    for r in bpe.digests(coded).collect():
        ids = library.encode_ordinary(odd_texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_pieces_follow_the_pattern():
    import random

    import regex

    rng, signs = random.Random(2), list("ab'stlmd \n\t1٢中é!. \x00") + ["'ll", "'re", "  ", "\r\n", " '", "''s"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    off = np.cumsum([0, *map(len, texts)])
    want = [o + m.start() for o, t in zip(off, texts) for m in regex.finditer(public_tokenizers.PATTERN, t)]
    assert bpe.pieces(points, off).tolist() == want


def test_packing(make_docs, odd_texts, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK", 16)
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    odd_texts = [*odd_texts, "a<|endoftext|>b", "<|endoftext|><|endoftext|> 's", "<|endoftext", "|> x"]
    rows = pack(clash(with_odd_rows(make_docs(odd_texts))), path, 256).collect()
    fill, copies = {}, Counter((r.doc_id, r.piece) for r in rows)
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = np.array([*coder.encode(odd_texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert len(ids) > 256 or (r.start, r.length) == (0, len(ids))
        assert r.piece == 0 or r.length == 256
    for parts in fill.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 256
    assert copies[7, 0] == 2
    short = [r.length for r in rows if r.length < 256]
    plain = packing.Bins(short, 256).best_fit(range(len(short)))
    assert len(fill) <= len(rows) - len(short) + len(plain.bins) + 2


def test_crossover_keeps_every_item():
    import random

    rng = random.Random(9)
    sizes = [rng.randrange(1, 90) for _ in range(300)]
    a, b = packing.Bins(sizes, 100).best_fit(range(300)), packing.Bins(sizes, 100).best_fit(range(0, 300, 2)).best_fit(range(1, 300, 2))
    for _ in range(20):
        child = a.cross(b, rng)
        assert sorted(i for items in child.bins for i in items) == list(range(300))
        assert all(sum(sizes[i] for i in items) == f <= 100 for items, f in zip(child.bins, child.fill))
    best, ran = breed(sizes, 100, 1)
    assert len(best.bins) <= len(a.bins) and 0 <= ran <= packing.GENERATIONS


def test_breeding_beats_plain_best_fit(spark):
    import random

    rng = random.Random(3)
    sizes = []
    for _ in range(40):  # three pieces fill each bin, and none of two do
        a = rng.randrange(380, 490)
        b = rng.randrange(250, (1000 - a) // 2 + 1)
        sizes += [a, b, 1000 - a - b]
    plain = packing.Bins(sizes, 1000).best_fit(range(len(sizes)))
    best, ran = breed(sizes, 1000, 1)
    assert 40 <= len(best.bins) < len(plain.bins) and ran > 0
    rows = spark.createDataFrame([(i, x, 0) for i, x in enumerate(sizes)], "row long, length long, block long")
    got = packing.evolve(rows, 1000).collect()
    assert len(got) == len(sizes) and len({r.number for r in got}) < len(plain.bins)
    # With migration: what the neighbour found comes back no worse.
    guest, _ = breed(sizes, 1000, 2, [best.bins])
    assert guest.fitness() >= best.fitness()


def test_rules(make_docs, odd_texts):
    import re

    rows = judge(clash(with_odd_rows(make_docs(odd_texts)))).collect()
    assert len(rows) == len(odd_texts) + 1
    for r in rows:
        t = odd_texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_rules_drop_what_sticks_out(make_docs):
    import random

    rng = random.Random(1)
    texts = [" ".join("w%d" % rng.randrange(5000) for _ in range(80)) for _ in range(300)]
    texts += [t.replace(" ", "*** ") for t in texts[:20]]
    got = {r.doc_id: r.kept for r in judge(make_docs(texts)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 320))


def test_rules_hold_in_a_source_with_much_junk(make_docs):
    import random

    rng = random.Random(2)
    texts = [" ".join("w%d" % rng.randrange(5000) for _ in range(80)) for _ in range(560)]
    texts += [t.replace(" ", "*** ") if i % 2 else "\n".join([*(t[k : k + 100] for k in range(0, len(t), 100)), *["same line"] * 9]) for i, t in enumerate(texts[:240])]
    texts += [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80)) for _ in range(9)]
    got = {r.doc_id: r.kept for r in judge(make_docs(texts)).collect()}
    assert all(got[i] for i in range(560)) and not any(got[i] for i in range(560, 809))


def by_chance(middle, of, unit):
    return max(unit / max(of, 1), (max(middle, 0) * unit / max(of, 1)) ** 0.5)


def exact_fences(rates, units):
    """The walk over exact quantiles of one group: rates by name, each with its denominators."""
    out = {}
    for name, (values, of) in rates.items():
        at = lambda xs, q: sorted(xs)[max(0, int(np.ceil(round(q * len(xs), 9))) - 1)]
        middle = at(values, 0.5)
        start = max(by_chance(middle, at(of, rules.LONG), units[name]), min(at(values, 0.75) - middle, middle - at(values, 0.25)))
        ends = []
        for qs in (rules.WALK, [1 - q for q in rules.WALK]):
            reach = start
            for q in qs:
                d = abs(at(values, q) - middle)
                if d > rules.GROWTH * reach:
                    break
                reach = max(reach, d)
            ends.append(reach)
        out[name] = np.array([middle, middle + rules.GROWTH * ends[0], middle - rules.GROWTH * ends[1]])
    return out


def test_rules_verdict_by_exact_quantiles(spark):
    import random

    rng, rows = random.Random(5), []
    say = lambda n, size: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(size, size + 4))) for _ in range(n))
    for i in range(900):
        lang, source = rng.choice(("en", None, "xx")), rng.choice(("a", "b", None))
        text = say(rng.randrange(40, 120), 3 if lang else 6)
        if source == "a":
            text = "\n".join(text[k : k + 80] for k in range(0, len(text), 80))
        if rng.random() < 0.3:
            line = say(6, 3)
            text += f"\n{line}" * rng.randrange(2, 9)
        if rng.random() < 0.2:
            text = text.replace(" ", " & ", rng.randrange(1, 40))
        rows.append((i, text, lang, source))
    rows += [(900, None, None, None), (901, "", "zz", "b"), (902, say(80, 3), "zz", "once"), (903, "a " * 80, "zz", "b")]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    lines = {i: [x for x in (t or "").split("\n") if x.strip()] for i, t, _, _ in rows}
    of = {i: {"word_chars": r.word_chars, "n_words": r.n_words, "n_lines": len(lines[i])} for i, r in got.items()}
    rate = {i: {name: (getattr(r, e) if hasattr(r, e) else 0) / max(of[i][d], 1) for name, (e, d, _) in rules.RATES.items()} for i, r in got.items()}
    units = {name: unit for name, (_, _, unit) in rules.RATES.items()}
    fine = [x for x in rows if not got[x[0]].base_failed]

    def fences(group):
        return exact_fences({name: ([rate[i][name] for i, *_ in group], [of[i][d] for i, *_ in group]) for name, (_, d, _) in rules.RATES.items()}, units)

    everything, kept, differ = fences(fine), {}, set()
    for i, _, lang, source in rows:
        tongue = [x for x in fine if x[2] == lang]
        own = [x for x in tongue if x[3] == source]
        kept[i] = bool(own)
        if own:
            a, b = fences(tongue), fences(own)
            for name, (_, d, unit) in rules.RATES.items():
                event = max(unit, 2 * of[i]["n_words"] / of[i]["n_lines"]) if name == "repeat_rate" and got[i].n_dup_lines else unit
                middle, fence, floor = [(len(own) * s + rules.PRIOR * (len(tongue) * t + rules.PRIOR * e) / (len(tongue) + rules.PRIOR)) / (len(own) + rules.PRIOR) for s, t, e in zip(b[name], a[name], everything[name])]
                differ.add((name, lang, round(fence, 9)))
                some = rules.GROWTH * by_chance(middle, of[i][d], event)
                kept[i] &= min(floor, middle - some) - 1e-6 <= rate[i][name] <= max(fence, middle + some) + 1e-6
        kept[i] &= not got[i].base_failed
    assert {i: r.kept for i, r in got.items()} == kept and 0 < sum(kept.values()) < len(fine)
    assert all(len({f for n, _, f in differ if n == name}) > 5 for name in rules.RATES)


def test_rules_are_the_same_however_rows_are_dealt(make_docs):
    import random

    rng = random.Random(3)
    texts = [" ".join("w%d" % rng.randrange(900) for _ in range(rng.randrange(50, 200))) + "\nline" * rng.randrange(3) for _ in range(700)]
    docs = make_docs(texts)
    one, many = docs.coalesce(1), docs.repartition(13)
    fences = lambda d: sorted(map(tuple, rules._fences(rated(d)).collect()))

    def rated(d):
        rows = rules.measure(d)
        return rows.withColumns({rate: F.col(events) / F.greatest(F.col(of), F.lit(1)) for rate, (events, of, _) in rules.RATES.items()})

    assert fences(one) == fences(many) == fences(one.orderBy("text"))
    assert sorted(map(tuple, judge(one).collect())) == sorted(map(tuple, judge(many).collect()))


def test_rules_on_ties_and_very_long_texts(make_docs):
    import random

    rng = random.Random(6)
    long = " ".join("w%d" % rng.randrange(50_000) for _ in range(150_000))
    same = " ".join("w%d" % i for i in range(100, 200))
    got = {r.doc_id: r for r in judge(make_docs([same] * 300 + [long])).collect()}
    assert all(got[i].kept for i in range(300)) and got[300].n_words == 150_000 and not got[300].base_failed


def test_a_line_said_twice_is_no_reason_to_go(make_docs):
    import random

    rng = random.Random(4)
    say = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    texts = ["\n".join(say(12) for _ in range(10)) for _ in range(400)]
    texts += [t + "\n" + t.split("\n")[3] for t in texts[:8]]  # one line more, said before
    texts += ["\n".join([t.split("\n")[0]] * 9 + t.split("\n")[1:]) for t in texts[:12]]
    got = {r.doc_id: r.kept for r in judge(make_docs(texts)).collect()}
    assert all(got[i] for i in range(408)) and not any(got[i] for i in range(408, 420))


def test_empty_tables(make_docs):
    none = make_docs([(1, "x")]).where("doc_id < 0")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (near_duplicates(none), remove_repeats(none), judge(none), pack(none, path), bpe.encode(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))):
        assert out.count() == 0


def test_workers_stay_small(monkeypatch):
    """Two workers share an executor with its JVM: what each allocates over large batches and buckets."""
    rng = np.random.default_rng(3)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghij"), (3000, 6))])
    texts = pa.RecordBatch.from_pydict({"doc_id": range(3000), "text": [" ".join(w) for w in rng.choice(words, (3000, 400))], "y": pa.array([0] * 3000, pa.int32())})
    full = np.full(30_000, suffix.BACK, np.uint8), np.full(30_000, suffix.LENGTH, np.uint8)
    mail = suffix._squeeze(np.arange(30_000), *full, rng.integers(97, 123, (30_000, suffix.WIDE), dtype=np.uint8))
    bucket = pa.Table.from_batches([suffix._mails([(0, 1, mail)])])
    for work in (lambda: list(toxicity._count([texts])), lambda: list(minhash._sketch([texts])), lambda: list(minhash._sets([texts])), lambda: suffix._answer_contexts(bucket)):
        monkeypatch.setattr(kernel, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 110 << 20


def test_chunks_of_a_batch_send_their_messages_one_by_one():
    rng = np.random.default_rng(4)
    texts = pa.RecordBatch.from_pydict({"doc_id": range(6), "text": ["".join(map(chr, rng.integers(97, 123, 400_000))) for _ in range(6)]})
    data, off = kernel.flat(texts.column("text"))
    chunks = pa.RecordBatch.from_pydict({"chunk": range(6), "ids": [[k] for k in range(6)], "lens": [[400_000]] * 6, "blob": [suffix.zstandard.compress(data[i:j].tobytes()) for i, j in zip(off, off[1:])]})
    sent = [x.column("chunk").to_pylist() for x in suffix._ask_anchors(4)([chunks])]
    assert sent == [[k] * 4 for k in range(6)]


def test_a_bucket_of_many_messages_stays_small():
    """Messages go once their parts are copied, and first owners are places in 4 bytes; each context gets its least owner."""
    rng = np.random.default_rng(3)
    full = np.full(30_000, suffix.BACK, np.uint8), np.full(30_000, suffix.LENGTH, np.uint8)
    texts, owners = rng.integers(97, 123, (30_000, suffix.WIDE), dtype=np.uint8), [rng.integers(0, 1 << 40, 30_000) for _ in range(5)]
    bucket = pa.Table.from_batches([suffix._mails([(0, k, suffix._squeeze(owners[k], *full, texts if k % 2 else rng.permutation(texts.T).T)) for k in range(5)])])
    tracemalloc.start()
    out = suffix._answer_contexts(bucket)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    one, three = (suffix._spread(out.column("blob")[k].as_py(), np.int64)[0].reshape(-1, suffix.SPAN) for k in (1, 3))
    least = np.minimum(owners[1], owners[3])
    assert (one == (least - owners[1])[:, None]).all() and (three == (least - owners[3])[:, None]).all()
