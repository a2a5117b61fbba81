"""Quality rules with adaptive thresholds, in DataFrame functions only.

Four rates per text (symbols a character, repeated lines a line, repeated words a word, characters a word) feed one
quantile sketch each per language and source, which merge into those of languages and of all. A sketch holds the count and
the largest value of each bucket of a logarithmic scale, BUCKET wide: counts add up and maxima merge in any order, so the
same rows give the same thresholds however they are dealt. A fence is the median plus GROWTH times the group's reach. The
reach starts with what chance makes in a long document of the group (one event, or the counting error of the median rate, and
so a few documents alike do not make a fence too close) and walks out over the group's quantiles while each lies no further
than GROWTH times what was reached so far: a clean group's whole tail is within, and the jump to a minority of junk ends the
walk. Fences of few documents are drawn towards those of their language, and these towards those of all, as if PRIOR more
documents stood there. A document is never out for less than GROWTH times what chance makes at its own length. A line that is
said twice is one event of repeated words too, and counts as many as two of the document's lines have.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from catchwater.llm.session import cut

#: Rates: events, of how many, and the events of one occurrence (a window that repeats marks two times three words).
RATES = {"symbol_rate": ("n_symbols", "word_chars", 1), "dup_line_rate": ("n_dup_lines", "n_lines", 1), "repeat_rate": ("n_repeat_words", "n_words", 6), "word_length": ("word_chars", "n_words", 1)}
GROWTH, PRIOR, BUCKET = 3.0, 200, 1.0005
#: Groups of language and source whose fences are broadcast, at most.
SMALL = 100_000
#: Ranks that the walk visits upwards, each with its mirror image downwards, and that of a long document.
WALK, LONG = (0.75, 0.9, 0.95, 0.975, 0.99), 0.9
RANKS = (0.5, *WALK, *(1.0 - q for q in WALK))


def repeated_words(windows: str) -> Column:
    """Words within 3-word windows found twice or more; ``windows``: (h, i) structs of each window, sorted."""
    twin = F.filter(windows, lambda x, k: (x["h"] == F.get(windows, k - 1)["h"]) | (x["h"] == F.get(windows, k + 1)["h"]))
    return F.sort_array(F.transform(twin, lambda x: x["i"]))


def measure(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the columns in ``more`` and the base measures of each text."""
    text = docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    words = text.withColumn("w", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = words.select(
        *more, "doc_id", "lang", "source", "w", lines.alias("lines"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    hashed = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))
    sorted_ = words.select(
        *more, "doc_id", "lang", "source", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.sort_array(hashed)).alias("windows"),
    )
    at = sorted_.withColumn("at", repeated_words("windows")).drop("windows")
    gaps = F.zip_with(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("at") > 0, F.aggregate(gaps, F.lit(3), lambda t, x: t + x)).otherwise(0)
    return at.select(*more, "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def _reach(walk: Column, start: Column) -> Column:
    """The largest of the distances of a walk up to its first jump."""
    first = F.struct(start.alias("r"), F.lit(True).alias("on"))

    def step(now: Column, d: Column) -> Column:
        on = now["on"] & (d <= GROWTH * now["r"])
        return F.struct(F.when(on, F.greatest(now["r"], d)).otherwise(now["r"]).alias("r"), on.alias("on"))

    return F.aggregate(walk, first, step, lambda now: now["r"])


def chance(middle, of, unit: int) -> Column:
    """What one event adds to a rate of so many, or the counting error of a rate of ``middle`` if that is more."""
    n = F.greatest(of, F.lit(1.0))
    return F.greatest(unit / n, F.sqrt(F.greatest(middle, F.lit(0.0)) * unit / n))


def _fences(rows: DataFrame) -> DataFrame:
    """(lang, source) -> middle, floor and fence of each rate, from the merged sketches of source, language and all."""
    merged = {"source": ["lang", "source"], "lang": ["lang"], "all": []}
    columns = [*RATES, *dict.fromkeys(of for _, of, _ in RATES.values())]
    value = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns)))
    bucket = F.when(F.col("v") > 0, F.floor(F.log("v") / F.log(F.lit(BUCKET)))).otherwise(-(1 << 40))
    sketch = cut(rows.select("lang", "source", value.alias("x")).select("lang", "source", "x.*").groupBy("lang", "source", "name", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("v").alias("most")))
    at = {}
    for level, keys in merged.items():
        sketch = sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "name").orderBy("bucket"))
        ranked = sketch.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy(*keys, "name"))})
        reached = lambda q: F.col("upto") >= F.greatest(F.ceil(F.round(q * F.col("total"), 9)), F.lit(1))
        found = ranked.groupBy(*keys, "name").agg(F.first("total").alias("total"), F.array(*(F.min(F.when(reached(q), F.struct("bucket", "most")))["most"] for q in RANKS)).alias("q"))
        at[level] = found.groupBy(*keys).agg(F.max("total").alias(f"n_{level}"), *(F.max(F.when(F.col("name") == c, F.col("q"))).alias(f"{c}_{level}") for c in columns))
    wide = at["source"].join(at["lang"], "lang").join(F.broadcast(at["all"]), how="cross")  # one row
    ranks = lambda quantiles, qs: F.array(*(F.col(quantiles)[RANKS.index(q)] for q in qs))
    for rate, (_, of, unit) in RATES.items():
        for level in merged:
            up, down = ranks(f"{rate}_{level}", (0.5, *WALK)), ranks(f"{rate}_{level}", (0.5, *(1.0 - q for q in WALK)))
            wide = wide.withColumns({"up": up, "down": down, "long": ranks(f"{of}_{level}", (LONG,))[0]})
            middle = F.get("up", F.lit(0))
            start = F.greatest(chance(middle, F.col("long"), unit), F.least(F.get("up", F.lit(1)) - middle, middle - F.get("down", F.lit(1))))
            higher, lower = (_reach(F.transform(F.slice(c, 2, len(WALK)), lambda q: F.abs(q - middle)), start) for c in ("up", "down"))
            wide = wide.withColumns({f"{rate}_middle_{level}": middle, f"{rate}_fence_{level}": middle + GROWTH * higher, f"{rate}_floor_{level}": middle - GROWTH * lower})
        for end in ("middle", "fence", "floor"):
            drawn = F.col(f"{rate}_{end}_all")
            for level in ("lang", "source"):
                drawn = (F.col(f"n_{level}") * F.col(f"{rate}_{end}_{level}") + PRIOR * drawn) / (F.col(f"n_{level}") + PRIOR)
            wide = wide.withColumn(f"{rate}_{end}", drawn)
    return wide.select("lang", "source", *(f"{r}_{end}" for r in RATES for end in ("middle", "floor", "fence")))


def judge(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """documents -> doc_id, the measures, base_failed, kept, and the columns in ``more``; one row for each row of docs.

    base_failed: fewer than 50 words, or over half of the words repeated. Null texts have no words; a null language or
    source is a group of its own; rows with a null doc_id are left out; repeated rows each count. Whole texts are measured,
    however long. Equal rates fall into one bucket and are judged alike; a rate at its fence stays. Thresholds come only
    from documents that pass the base rules; if none do, nothing is kept. An empty table gives an empty table.
    """
    rows = measure(docs, more).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    rows = cut(rows.withColumns({rate: F.col(events) / F.greatest(F.col(of), F.lit(1)) for rate, (events, of, _) in RATES.items()}))
    fences = cut(_fences(rows.where("not base_failed")))
    judged = rows.join(F.broadcast(fences) if fences.limit(SMALL + 1).count() <= SMALL else fences, ["lang", "source"], "left")
    within = F.lit(True)
    for rate, (_, of, unit) in RATES.items():
        x, middle = F.col(rate), F.col(f"{rate}_middle")
        event = F.greatest(F.lit(float(unit)), F.when(F.col("n_dup_lines") > 0, 2.0 * F.col("n_words") / F.col("n_lines")).otherwise(0.0)) if rate == "repeat_rate" else unit
        some = GROWTH * chance(middle, F.col(of).cast("double"), event)
        # One part in a million allows for rounding.
        within = within & (x <= F.greatest(f"{rate}_fence", middle + some) + 1e-6) & (x >= F.least(f"{rate}_floor", middle - some) - 1e-6)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"), *more)
