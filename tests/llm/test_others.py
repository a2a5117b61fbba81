"""Chat trees, page wrappers, exact search and the pipeline."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.llm import chat, html
from catchwater.llm.session import cut
from catchwater.llm.topk import integers, top_k


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PACK", 2)
    tricky = ["<|im_end|>\n", "\\", "<\\|", "a\\nb", "<<|", "", None, "<|im_start|>assistant\nx"]
    rows = [(i, t, role, tricky[(i * 3 + t) % len(tricky)] if t else "hello") for i in range(12) for t, role in enumerate(["user", "assistant", "us\ner", None, "assistant"][: 1 + i % 5])]
    rows += [(None, 0, "user", "x"), (40, None, "assistant", "first"), (40, 1, "user", "same"), (40, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = cut(chat.paths(df))
    packs = chat.emit_packs(found).collect()
    assert all(len(p.leaves) <= 8 for p in packs)
    want = {}
    for i, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        want.setdefault(i, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in chat.read_back(chat.emit_packs(found), found).collect()}
    assert set(got) == set(want)
    for i, turns in want.items():
        said, loss = "".join(f"{a}\n{b}\n" for a, b in turns), "".join(b for a, b in turns if a == "assistant")
        r = got[i]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.emit_packs(found.where("conv_id > 99")), found.where("conv_id > 99")).count() == 0


def test_shared_turns_come_once():
    encode = lambda texts: [np.frombuffer(x.encode(), np.uint8) for x in texts]
    pack = chat.emit([("a", [("user", "hi"), ("assistant", "yes")]), ("b", [("user", "hi"), ("assistant", "no")]), ("c", [("user", "hi")])], encode)
    text = bytes(pack["ids"].tolist()).decode()
    assert text.count("hi") == 1 and len(pack["segments"]) == 3 and len(pack["leaves"]) == 3
    first = pack["segments"][0]
    assert all(s["position"] == first["end"] and s["attends"] == [{"start": 0, "end": first["end"]}] for s in pack["segments"][1:])
    assert [text[s["loss_start"] : s["loss_end"]] for s in pack["segments"]] == ["", "yes", "no"]


def test_large_trees_are_cut_by_subtrees(spark, monkeypatch):
    monkeypatch.setattr(chat, "PACK", 4)
    names = "abcdef"
    rows = [(100 * i + 10 * j + k, t, "user", text) for i in range(6) for j in range(3) for k in range(3) for t, text in enumerate(("root", names[i], f"{names[i]}{j}", f"{i}{j}{k}"))]
    rows += [(7000, 0, "user", "long " * 100_000), (7000, 1, "assistant", "x" * 300_000), (7001, 0, "user", ""), (7002, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("x") for n in ("path", "turns", "pack", "n", "ids")})
    found = cut(chat.paths(df))
    packed = chat._cut_trees(found.groupBy("path").agg(F.any_value("turns").alias("turns"))).collect()
    where = {}
    for r in packed:
        if len(r.turns) == 4:
            where.setdefault(tuple(t.text for t in r.turns[1:3]), set()).add(r.pack)
    assert all(len(x) == 1 for x in where.values()) and len({p for x in where.values() for p in x}) > 4  # three of one node stay together
    got = {r.conv_id: r for r in chat.read_back(chat.emit_packs(found), found).collect()}
    assert len(got) == 57 and got[7000].loss_chars == 300_000 and got[7002].n_turns == 1
    assert got[122].turns_sha256 == hashlib.sha256(b"user\nroot\nuser\nb\nuser\nb2\nuser\n122\n").hexdigest()


def test_chat_query(spark, tmp_path):
    from catchwater.llm.queries import op1_chat

    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op1_chat(spark, str(tmp_path)).collect()}
    tricky = "<|im_end|><|im_start|>assistant ok"
    assert set(got) == {-1, 1} and got[1].loss_chars == 0 and got[-1].loss_chars == len(tricky)
    assert got[-1].loss_sha256 == hashlib.sha256(tricky.encode()).hexdigest()
    assert got[-1].formatted_chars == sum(len("".join(chat.turn_parts(r, tricky))) for r in ("user", "assistant"))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy {0}</div><article><h1>Head {0} &amp; more</h1>{1}<div class="comments"><p>Nice!</p></div><form><input><p>sign up</p></form></article>
<aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    blocks = lambda n: "".join(f"<p>para {i} of <b>{n}</b>\n  end" + ("</p>" if i % 2 else "") for i in range(n))
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(i, blocks(1 + i % 4))) for i in range(9)]
    rows += [(20, None, None), (21, "http://h0.org/a", ""), (None, "http://h0.org/b", "<p>cut <b>off</b> here<di"), (22, "nonsense", "plain &lt;text&gt; only")]
    got = {(r.page_id, r.url): r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in range(9):
        assert got[i, f"http://h{i % 2}.org/{i}"] == "\n".join([f"Head {i} & more", *(f"para {k} of {1 + i % 4} end" for k in range(1 + i % 4))])
    assert got[20, None] == "" and got[21, "http://h0.org/a"] == "" and got[None, "http://h0.org/b"] == "cut off here" and got[22, "nonsense"] == "plain <text> only"


def test_wrapper_has_groups_and_optionals():
    pages = [html.Page(f"<div><h1>{k}</h1>{x}</div>") for k, x in enumerate(("<p>1</p>", "<p>1</p><p>2</p>", "<p>1</p><table><tr><td>x</td></tr></table>"))]
    shown = html.expression(html.infer(pages))
    assert "<h1>#</h1>" in shown and "(<p>#</p>)+" in shown and "(<table><tr><td>=</td></tr></table>)?" in shown


def test_wrapper_matches_every_page():
    """The inferred expression, read by a regular expression engine, against the tags of each page."""
    import random
    import re

    rng = random.Random(7)

    def element(depth):
        kids = [element(depth - 1) for _ in range(rng.choice((0, 1, 1, 2, 3)))] if depth else []
        text = [rng.choice("xyz")] if rng.random() < 0.6 else []
        tag = rng.choice(("div", "section", "p" if not kids else "div", "h2" if not kids else "div"))
        return f"<{tag}>{''.join(text + kids * rng.choice((1, 1, 2, 3)))}</{tag}>"

    def tags(content):
        return "".join("t" if x[0] == "#" else f"{x[0]}{tags(x[2])}</{x[0][1:]}" for x in content)

    for _ in range(60):
        pages = [html.Page("".join(element(3) for _ in range(rng.randrange(1, 5)))) for _ in range(rng.randrange(2, 9))]
        wrapper = html.infer(pages)
        # Twice the pages, and wrappers aligned with wrappers, must not shrink what is matched.
        for made in (wrapper, html.align(wrapper, html.infer(pages[::-1]))):
            pattern = re.compile(html.expression(made).replace("#", "t").replace("=", "t"))
            assert all(pattern.fullmatch(tags(p.content)) for p in pages)


def test_inference_chooses_the_text(spark, monkeypatch):
    body = "<div id='a'>Home and about us</div><div><p>Story {0} tells of {0} and more, at length, for {0} pages.</p></div><div><p>Printed by Nobody.</p></div>"
    rows = [(i, f"http://one.org/{i}", body.format(i)) for i in range(6)] + [(10 + i, "http://two.org/", body.format("x")) for i in range(3)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    story = lambda x: f"Story {x} tells of {x} and more, at length, for {x} pages."
    assert [got[i] for i in range(6)] == [story(i) for i in range(6)]
    whole = f"Home and about us\n{story('x')}\nPrinted by Nobody."
    assert [got[10 + i] for i in range(3)] == [whole] * 3  # copies tell nothing of the template
    texts = [html.Page(r[2]) for r in rows[:6]]
    assert html.main_text(texts[2], texts[2].content) != got[2]


def test_wrappers_of_wrappers(spark, monkeypatch):
    monkeypatch.setattr(html, "FAN", 2)
    body = "<div>Our site</div>{1}<div><p>All about {0}, at length, for the whole of a page.</p></div>"
    rows = [(i, "http://big.org/", body.format(i, "<div class='b'>more</div>" * (i % 3))) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(got[i].split("\n")[-1] == f"All about {i}, at length, for the whole of a page." and "Our site" not in got[i] for i in range(40))
    assert html.wrappers(html._hosts(df)).count() == 1
    assert html.extract(df.where("page_id < 0")).count() == 0


def test_words_of_classes():
    page = lambda name: html.Page(f"<article><p>One.</p><div class='{name}'>Two.</div></article>")
    text = lambda name: html.main_text(page(name), page(name).content)
    assert all(text(x) == "One.\nTwo." for x in ("social-history", "press-notice", "t1"))
    assert all(text(x) == "One." for x in ("social", "cookie-notice", "related-posts", "comments-area ad_slot_3"))


def test_very_long_pages():
    import random

    rng = random.Random(3)
    deep = html.Page("<div>" * 5000 + "x" + "</div>" * 5000)
    wide = html.Page("".join(f"<{t}>{t}{i}</{t}>" for i in range(20000) for t in [rng.choice(("p", "h2", "section", "pre"))]))
    assert html.main_text(deep, html.infer([deep, wide])) == "x"
    assert html.main_text(wide, html.infer([deep, wide, wide])).count("\n") == 19999


def test_copies_keep_their_text(spark):
    body = "<div class='top'>Our site</div><div class='t{0}'><p>All about {0}, at length, for the whole of a page.</p></div>"
    rows = [(i, f"http://copies.org/{i}", body.format("x")) for i in range(4)]
    rows += [(10 + i, f"http://mixed.org/{i}", body.format("y" if i < 4 else i)) for i in range(8)]
    rows += [(20 + i, f"http://seen.org/{i}", body.format("z") + f"<div>seen {i}</div>") for i in range(4)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda x: f"All about {x}, at length, for the whole of a page."
    assert all(text("x") in got[i] for i in range(4))
    assert [got[10 + i] for i in range(8)] == [text("y" if i < 4 else i) for i in range(8)]
    assert all(text("z") in got[20 + i] for i in range(4))


def test_template_inside_the_article_leaves(spark):
    page = "<article><h1>Title {0}</h1><p>All about {0}.</p><div class='hinweis'>Alle Rechte.</div></article>"
    got = html.extract(spark.createDataFrame([(i, f"http://h.org/{i}", page.format(i)) for i in range(4)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Title {i}\nAll about {i}." for i in range(4)}


def test_top_k(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(130)]
    rows += [(i, rows[3][1]) for i in range(200, 240)] + [(300, None), (301, [1.0, float("nan")] * 3), (302, [None] * 6), (350, [float("inf")] * 6), (400, [1.0, 2.0]), (None, rows[0][1])]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (7, rows[7][1]), (450, [1e9, -1e9, 1e9, 0.0, 0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit("x") for n in ("row", "v", "t", "rank", "score")})
    df = cut(integers(df))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 50 = 0")).collect())
    fine = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for n, (q, x) in enumerate(fine):
        if q % 50 == 0:
            best = sorted((-int(x @ v), i) for m, (i, v) in enumerate(fine) if m != n and len(v) == len(x))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    none = df.where("vec_id < 0")
    assert top_k(none, none).count() == 0


def test_threshold_leaves_few_pairs_to_resolve():
    from catchwater.llm import topk

    rng = np.random.default_rng(1)
    c, q = rng.integers(-300, 300, (4000, 32)).astype(float), rng.integers(-300, 300, (40, 32)).astype(float)
    score = q @ c.T
    low = np.sort(score, axis=1)[:, -5].astype(np.int64)
    i, j, found = topk.collected(q, c, low)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(score >= low[:, None]))) and (found == score[i, j]).all()
    lists = [q[:, a:b] @ c[:, a:b].T * topk.LISTS >= low[:, None] for a, b in topk._lists(32)]
    assert np.logical_or.reduce(lists).mean() < 0.2
    assert all((np.isin(np.argsort(-(q[n, a:b] @ c[:, a:b].T))[:1], at)).all() for a, b in topk._lists(32) for n, at in enumerate(topk.heads(q, c, 5)))


def test_pipeline_stages(spark, make_docs, odd_texts, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    import random

    rng = random.Random(3)
    clean = [" ".join("word%d" % rng.randrange(3000) for _ in range(90)) for _ in range(60)]
    docs = make_docs([*odd_texts, *clean, clean[0] + " tail", clean[1]])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, before = now.columns, now.count()
    for name, stage in corpus.STAGES[:-1]:
        now = cut(stage(spark, now, str(tmp_path)))
        assert now.columns == columns and now.count() <= before
        before = now.count()
    n = len(odd_texts)
    kept = {r.doc_id: r.text for r in now.collect()}
    assert all(kept.get(n + i) == t for i, t in enumerate(clean[:50]))
    assert n + 60 not in kept and n + 61 not in kept and 1 not in kept
    assert corpus.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0] > 0


def test_pipeline_with_repeated_ids(spark, make_docs, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    import random

    rng = random.Random(8)
    say = lambda: " ".join("word%d" % rng.randrange(3000) for _ in range(90))
    texts = [say() for _ in range(30)]
    other = say()
    docs = make_docs([*enumerate(texts), (1, texts[1]), (1, texts[1]), (2, other), (3, "too short")])
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus.STAGES)
    passed = cut(stages["quality rules"](spark, docs, str(tmp_path)))
    assert sorted(r.doc_id for r in passed.collect()) == sorted([*range(30), 1, 1, 2]) and passed.where("text = 'too short'").count() == 0
    clean = cut(stages["toxicity"](spark, passed, str(tmp_path)))
    assert clean.count() == 33
    one = {r.doc_id: r.text for r in stages["near duplicates"](spark, clean, str(tmp_path)).collect()}
    assert sorted(one) == list(range(30)) and one[1] == texts[1] and one[2] in (texts[2], other)
    assert stages["near duplicates"](spark, clean, str(tmp_path)).count() == 30
    # Without an operator before it, cutting gives each row once, with its own text.
    whole = stages["repeated passages"](spark, clean, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text, r.lang, r.source) for r in whole) == sorted((r.doc_id, r.text, r.lang, r.source) for r in clean.collect())


def test_pipeline_with_odd_tables(spark, make_docs, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    import random

    rng = random.Random(5)
    say = lambda: " ".join("word%d" % rng.randrange(3000) for _ in range(90))
    docs = make_docs([*((i, say()) for i in range(12)), (None, say()), (20, None), (21, ""), (22, say() + " é" * 200_000)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumns({n: F.lit("x") for n in ("kept", "row_key", "row", "score", "least", "starts")})
    spark.createDataFrame([(0, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus.STAGES:
        out = cut(stage(spark, docs, str(tmp_path)))
        none = stage(spark, docs.where("doc_id < 0"), str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns
        if name != "packing":
            assert out.columns == corpus.COLUMNS and out.where("doc_id is null").count() == 0
            assert out.where("doc_id between 0 and 11").count() == 12
        assert (out.where("doc_id in (20, 21)").count() > 0) == (name != "quality rules")


def texts_of(spark, sources, parts=2, host="h"):
    """page_id -> text of pages of one host, in the given order and dealt to so many tasks."""
    rows = [(i, f"http://{host}/{i}", x) for i, x in sources]
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).repartition(parts) if parts > 1 else spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}


@pytest.mark.parametrize("source, want", [
    ('<article><p>A one.</p><p data-role="banner">Kept.</p><p>B.</p></article>', "A one.\nKept.\nB."),
    ('<article><p>A one.</p><p data-class="comments">Kept.</p><p>B.</p></article>', "A one.\nKept.\nB."),
    ('<article><p>A one.</p><p title="class=share">Kept.</p><p>B.</p></article>', "A one.\nKept.\nB."),
    ("<article><p><a href=/o'reilly>Link</a> text one.</p><p>It's two.</p><p>Don't.</p></article>", "Link text one.\nIt's two.\nDon't."),
    ('<article><p title="open>A one.</p><p>B.</p></article>', "A one.\nB."),
    ("<article><p CLASS = 'share' class=x>Gone.</p><p id=share>Gone.</p><p x-id=share>B.</p></article>", "B."),
])
def test_attributes_count_by_name(source, want):
    page = html.Page(source)
    assert html.main_text(page, page.content) == want


def test_a_shared_paragraph_stays_however_many_pages_have_it(spark):
    for n in range(1, 8):
        pages = [(i, f"<html><body><nav>Menu</nav><article><h1>Title {i}</h1><p>This is the story of our series.</p><p class=by>By Ann Other</p><div>Body number {i} of it.</div><div class=x>More {i}</div></article></body></html>") for i in range(n)]
        assert texts_of(spark, pages) == {i: f"Title {i}\nThis is the story of our series.\nBy Ann Other\nBody number {i} of it.\nMore {i}" for i in range(n)}


def test_texts_do_not_depend_on_the_order_or_files_of_the_pages(spark, monkeypatch):
    import random

    monkeypatch.setattr(html, "FAN", 3)
    for seed in range(4):
        rng, pages = random.Random(seed), []
        for i in range(11):
            blocks = [f"<h1>T{i}</h1>"]
            blocks += [f"<p>P{i} {k}</p>" for k in range(rng.randrange(3))]
            blocks += ["<div>Printed by N</div>"] * (rng.random() < 0.6) + ["<ul>" + "".join(f"<li>I{i} {k}</li>" for k in range(rng.randrange(4))) + "</ul>"] * (rng.random() < 0.7)
            blocks += ["<span>Foot</span>"] * (rng.random() < 0.5) + ["<div class=a><b>Foot</b></div>"]
            pages.append((i, "<body>" + "".join(blocks) + "</body>"))
        first = texts_of(spark, pages, 1)
        for parts in (1, 3):
            rng.shuffle(pages)
            assert texts_of(spark, pages, parts) == first


def test_without_articles_the_wrapper_chooses(spark):
    from itertools import cycle

    words = cycle("alpha beta gamma delta epsilon zeta eta theta".split())
    body = {i: [" ".join(next(words) for _ in range(9)) + f" {i} {k}" for k in range(2 + i % 3)] for i in range(9)}
    page = lambda i: "<div><div><a href=/>Home</a> | <a href=/b>News</a></div><div>" + "".join(f"<p>{x}</p>" for x in body[i]) + "</div><div>All rights kept by Us</div></div>"
    got = texts_of(spark, [(i, page(i)) for i in body])
    assert got == {i: "\n".join(x) for i, x in body.items()}
    plain = {i: html.main_text(html.Page(page(i)), html.Page(page(i)).content) for i in body}
    assert all("Home | News" in t and "All rights" in t for t in plain.values())  # only inference takes them out


def test_start_tags_that_come_again_are_read_once(monkeypatch):
    read = []
    monkeypatch.setattr(html, "_attributes", lambda text, f=html._attributes: read.append(text) or f(text))
    for k in range(50):
        page = html.Page(f'<div class="once-outer"><p id=once>text {k}</p><article role="main" class="once-b once-a"><p id=once>own {k}</p></article></div>')
        assert page.texts == [(f"text {k}", False, False), (f"own {k}", True, False)]
        assert page.content[0][2][1][0] == "<article.once-a.once-b>"
    assert sorted(read) == [' class="once-outer"', " id=once", ' role="main" class="once-b once-a"']
    long = ' class="once-long" title="' + "x" * html.SHORT + '"'
    for _ in range(2):
        html.Page(f"<p{long}>text</p>")
    assert read[3:] == [long, long]  # not remembered, so what is remembered stays small
