"""Repairs the turn structure of conversations by weighted interval parsing.

The roles that are left must read as an optional system turn and pairs of user and assistant turns. That language has four
states: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end. The repair
grammar is in Chomsky normal form: its nonterminal (q, r) stands for rows that, once edited, lead from state q to r; its
binary rules are (q, r) -> (q, p) (p, r), and its lexical rules edit one row. The insertion closure adds rows at no input:
it is the empty span's cell, and every lexical rule carries it on both sides. A span's cell holds the least (cost, audit)
of each nonterminal, from all its splits, and spans are combined bottom-up by length. Among edits of equal cost no audit
begins another one, since what is left over would be insertions, which cost; so the least audits of the parts make
the least audit of the whole.

A conversation is parsed in stretches of STRETCH rows, and the cells of stretches are the leaves of the next chart, until
one is left: no task meets more than STRETCH leaves, and the work grows with the rows. Only flags and hashes are shuffled up
to there. Texts are shuffled once, at the end, to be hashed in order as they stream through a task, never held together.
"""

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from catchwater.llm.session import cut

#: Leaves of one chart.
STRETCH = 16
INSERT, RELABEL, DELETE, CUT_SHORT = 3, 3, 4, 3
SPACES = " \t\n\x0b\f\r"

STATES, ENDS = range(4), (0, 3)
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: A cell: least (cost, audit) by nonterminal.
Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell, best: Cell | None = None) -> Cell:
    """The binary rules over one split, keeping what is already best."""
    best = {} if best is None else best
    for (q, p), (c1, a1) in left.items():
        for (p2, r), (c2, a2) in right.items():
            if p == p2:
                found = (c1 + c2, a1 + a2)
                if (q, r) not in best or found < best[q, r]:
                    best[q, r] = found
    return best


def _closure() -> Cell:
    one = {(q, r): (INSERT, "I") for (q, x), r in STEPS.items() if x != "s"}
    out = {(q, q): (0, "") for q in STATES}
    for _ in STATES:
        out = joined(out, one, dict(out))
    return out


EMPTY = _closure()


@lru_cache(maxsize=None)
def leaf(code: str) -> Cell:
    """The cell of a row: d must go; s, u, a or x by its role, in capitals if it is cut short."""
    out: Cell = {(q, q): (DELETE, "D") for q in STATES}
    extra = CUT_SHORT if code.isupper() else 0
    for (q, x), r in STEPS.items():
        if code != "d" and x == code.lower():
            out[q, r] = (extra, "K")
        elif code != "d" and x != "s":
            out[q, r] = (extra + RELABEL, "R")
    return joined(joined(EMPTY, out), EMPTY)


def chart(leaves: list[Cell]) -> Cell:
    """The cell of the whole span, from all shorter spans."""
    if not leaves:
        return EMPTY
    spans = {(i, i + 1): cell for i, cell in enumerate(leaves)}
    for length in range(2, len(leaves) + 1):
        for i in range(len(leaves) - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                joined(spans[i, k], spans[k, i + length], cell)
            spans[i, i + length] = cell
    return spans[0, len(leaves)]


@lru_cache(maxsize=1 << 15)
def parsed(codes: str) -> Cell:
    return chart([leaf(c) for c in codes])


_PAIRS = [(q, r) for q in STATES for r in STATES if q <= r or (q, r) == (3, 2)]
CELL = "costs array<long>, audits array<string>"


def _cells(batches):
    """Codes of stretches -> their cells."""
    for batch in batches:
        cells = [parsed(c) for c in batch.column("codes").to_pylist()]
        yield _with(batch, "codes", cells)


def _charts(batches):
    """Cells of neighbouring stretches, in order -> one cell each."""
    for batch in batches:
        cells = [chart([{p: (c, a) for p, c, a in zip(_PAIRS, x["costs"], x["audits"]) if c is not None} for x in row]) for row in batch.column("cells").to_pylist()]
        yield _with(batch, "cells", cells)


def _with(batch, name: str, cells: list[Cell]):
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    values = [[[c.get(p, (None, None))[k] for p in _PAIRS] for c in cells] for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(values[0], pa.list_(pa.int64())), pa.array(values[1], pa.list_(pa.string()))], [*(batch.schema.names[i] for i in keep), "costs", "audits"])


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """conversations -> conv_id, turn, role, text, copies: every row, damaged by crc32(conv_id:turn) % 20, and how often it stands.

    Nulls in role and text, and in the ids as far as the checksum reads them, become one space.
    """
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_text("text"), ".!?", "")).otherwise(_text("text"))
    role = F.when(kind == 4, "user").otherwise(_text("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def _same() -> Column:
    """Equal for rows of equal role and text."""
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)


def _flags(rows: DataFrame) -> DataFrame:
    """One narrow row for each row that stands: its place k in its conversation, its code, and what the reports count."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    narrow = rows.select("conv_id", "turn", _same().alias("same"), F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("is_blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"), F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"), "copies")
    narrow = narrow.where("copies > 0").drop("copies", "copy")
    by_turn = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "same")
    numbered = narrow.select("*", (F.row_number().over(by_turn) - 1).cast("long").alias("k"), F.lag("initial").over(by_turn).alias("before"), F.lag("turn").over(by_turn).alias("last_turn"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "same").orderBy("k")) > 1
    fault = F.when(F.col("is_blank"), "blank").when(seen, "duplicate").when(F.col("open"), "truncated")
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    flagged = numbered.withColumn("fault", fault)
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & (F.col("last_turn").isNull() | (F.col("last_turn") != F.col("turn")))
    return flagged.select("conv_id", "turn", "same", "k", code.alias("code"), "fault", illegal.alias("illegal"), new_turn.alias("new_turn"))


def _parse(flags: DataFrame) -> DataFrame:
    """conv_id, cost, audit of each conversation that has rows."""
    by_stretch = flags.groupBy("conv_id", F.expr(f"k div {STRETCH}").alias("k"))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("k").alias("i"), "code"))), lambda x: x["code"]), "")
    cells = cut(by_stretch.agg(codes.alias("codes")).mapInArrow(_cells, f"conv_id long, k long, {CELL}"))
    whole = None
    while True:
        last = F.max("k").over(Window.partitionBy("conv_id"))
        cells = cells.withColumn("last", last)
        done = cells.where("last = 0").drop("last")
        whole = done if whole is None else whole.union(done)
        more = cells.where("last > 0").drop("last")
        if not more.limit(1).count():
            break
        order = F.array_sort(F.collect_list(F.struct(F.col("k").alias("i"), "costs", "audits")))
        more = more.groupBy("conv_id", F.expr(f"k div {STRETCH}").alias("k")).agg(order.alias("cells"))
        cells = cut(more.mapInArrow(_charts, f"conv_id long, k long, {CELL}"))
    best = F.array_min(F.filter(F.array(*(F.struct(F.col("costs")[i].alias("cost"), F.col("audits")[i].alias("audit")) for i in (_PAIRS.index((0, end)) for end in ENDS))), lambda x: x["cost"].isNotNull()))
    return whole.select("conv_id", best.alias("best")).select("conv_id", "best.*")


def _edits(batches):
    """conv_id, audit -> the edits that leave rows: for row k the lines to add before and after it, and its role (null: its own).

    The number of rows left tells their roles: an odd one starts with a system turn.
    """
    for batch in batches:
        out = []
        for conv, audit in zip(batch.column("conv_id").to_pylist(), batch.column("audit").to_pylist()):
            lead = (len(audit) - audit.count("D")) % 2
            k, left, lines, last = 0, 0, [], None
            for letter in audit:
                role = "assistant" if (left - lead) % 2 else "user"
                left += letter != "D"
                if letter == "I":
                    lines.append(f"{role}:")
                    continue
                row = [conv, k, lines, letter != "D", role if letter == "R" else None, []]
                if letter != "D" or lines:
                    out.append(row)
                k, lines, last = k + 1, [], row
            if lines:
                last[5] = lines
                if not (last[3] or last[2]):
                    out.append(last)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["conv_id", "k", "ahead", "keep", "new_role", "behind"])


def _hash(batches):
    """Rows by conversation, turn and hash, edits before their text -> the hash of each conversation's repaired rows."""
    names = ("conv_id", "turn", "same", "text_row", "ahead", "keep", "new_role", "behind", "role", "text")
    rows = (r for batch in batches for r in zip(*(batch.column(n).to_pylist() for n in names)))
    out = []
    for conv, own in groupby(rows, key=lambda r: r[0]):
        digest, between = hashlib.sha256(), ""
        for _, group in groupby(own, key=lambda r: r[1:3]):
            edits = []
            for _, _, _, is_text, ahead, keep, new_role, behind, role, text in group:
                if not is_text:
                    edits.append((ahead, keep, new_role, behind))
                    continue
                for ahead, keep, new_role, behind in edits:
                    for line in [*ahead, *([f"{new_role or role}:{text}"] if keep else []), *behind]:
                        digest.update(f"{between}{line}".encode())
                        between = "\n"
                edits = []  # a repeated row brings the same text again
        out.append((conv, digest.hexdigest()))
        if len(out) == 4096:
            yield _hashes(out)
            out = []
    yield _hashes(out)


def _hashes(rows: list):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])


def repaired_rows(rows: DataFrame, flags: DataFrame, audits: DataFrame) -> DataFrame:
    """The edits that leave rows and the texts they apply to, in one table: text_row false and true."""
    edits = audits.select("conv_id", "audit").mapInArrow(_edits, "conv_id long, k long, ahead array<string>, keep boolean, new_role string, behind array<string>")
    f, e = flags.select("conv_id", "turn", "same", "k").alias("f"), edits.alias("e")
    placed = e.join(f, F.expr("e.conv_id <=> f.conv_id and e.k = f.k")).select("f.conv_id", "turn", "same", "e.k", F.lit(False).alias("text_row"), "ahead", "keep", "new_role", "behind")
    texts = rows.where("copies > 0").select("conv_id", "turn", _same().alias("same"), F.lit(True).alias("text_row"), "role", "text")
    return placed.unionByName(texts, allowMissingColumns=True)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies -> one row per conv_id: faults, the cheapest edits, and the hash of what they leave.

    ``damaged`` gives such rows from conversations; copies says how often a row stands (0: the row is gone, yet its
    conversation is reported). Rows go by turn, nulls first; rows of one turn by the hash of role and text, equal ones side
    by side, and all of them count. A null conv_id is a conversation of its own. Roles count by their first letter; any
    other than s, u, a has to be relabelled or deleted, an empty one too. A conversation without rows has zeros, an empty
    audit and the hash of nothing; an empty table gives no rows; other columns are left behind. The texts of a conversation,
    however many and long, are hashed in order as they pass through one task.
    """
    flags = cut(_flags(rows))
    count = lambda x: F.sum(x.cast("long"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn")), F.lit(0))
    told = flags.groupBy("conv_id").agg(gaps.alias("gaps"), *(count(F.coalesce(F.col("fault") == x, F.lit(False))).alias(x) for x in ("blank", "duplicate", "truncated")), count(F.col("illegal")).alias("illegal"))
    audits = cut(_parse(flags))
    merged = repaired_rows(rows, flags, audits).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "same", "text_row", "k")
    hashed = merged.mapInArrow(_hash, "conv_id long, repaired_sha256 string")
    every = rows.select("conv_id").unionByName(told, True).unionByName(audits, True).unionByName(hashed, True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = every.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return found
