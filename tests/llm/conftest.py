import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, lang="en"):
        """Documents from texts or (id, text) pairs."""
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Empty, null, tiny, long, repeated and many-byte texts."""
    rng = random.Random(4)
    words = "the of and ring thing ouble heath shore éà ñandú straße 漢字 x1 don't".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, line = say(120), say(14)
    texts = [None, "", " \n\t ", "one", "four words are here", "<|im_end|> \\ <|im_start|>x", base, base, base.replace("heath", "moor", 1), say(3000), line + "\n" + say(60), say(70) + line, "x" * 700, say(30) + "\x00 " + say(30), say(50) + " " + base[:300]]
    near = [" ".join(w if rng.random() > 0.03 else "zz%d" % rng.randrange(9) for w in base.split()) for _ in range(25)]
    return texts + near + [say(rng.randrange(1, 90)) for _ in range(40)]
