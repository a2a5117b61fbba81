"""Chat formatting on prefix trees.

Conversations that share initial turns are merged: each distinct turn after the same turns is one node, whose tokens are
emitted once, depth first. Every segment carries the position id of its first token (positions go on from its parent's)
and the intervals of the emitted tokens that it may attend to: those of its ancestors. A turn's head, text and end are
encoded apart, so the loss mask covers whole tokens. Equal conversations are one path. A tree of over PACK paths or
LARGE characters is cut: subtrees are dealt to parts whole, and one that is still too large is cut deeper, so only turns
above a cut come again, once a part.
"""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catchwater.llm.bpe import RUN, Encoder, Library, decode, rank_text
from catchwater.llm.session import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Paths and characters of a pack, about, and the tokenizer of the emitted ids.
PACK, LARGE, TOKENIZER = 1000, 8 << 20, "byte_bpe_multi_50k.tiktoken"

_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.S)

PACKS = "pack long, ids array<int>, segments array<struct<start:int,end:int,position:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>, leaves array<struct<path:string,segment:int>>"


def escape(text: str) -> str:
    """A text in which no control string can start."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """A formatted turn: head, text and end; the loss covers an assistant's text."""
    return OPEN + escape(role).replace("\n", "\\n") + "\n", escape(text), CLOSE


def parse(text: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def paths(turns: DataFrame) -> DataFrame:
    """conversations -> conv_id, path (a digest of all its turns), turns in order."""
    rows = turns.selectExpr("cast(conv_id as bigint) as conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as text").where("conv_id is not null")
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")).withColumn("path", F.sha2(F.to_json("turns"), 256))


def emit(conversations: list[tuple[str, list]], encode) -> dict:
    """One pack: conversations as (path, [(role, text)]); encode gives the ids of each of a list of texts."""
    root: dict = {"kids": {}, "ends": []}
    for path, turns in sorted(conversations):
        node = root
        for turn in turns:
            node = node["kids"].setdefault(turn, {"kids": {}, "ends": []})
        node["ends"].append(path)
    order, parts, todo = [], [], [(None, root, -1)]
    while todo:  # depth first: each node's turn, and its parent's segment
        turn, node, above = todo.pop()
        own = above
        if turn:
            own = len(order)
            order.append((turn, node, above))
            parts += turn_parts(*turn)
        todo += [(t, kid, own) for t, kid in reversed(node["kids"].items())]
    ids, segments, leaves, size = encode(parts), [], [], 0
    for k, (turn, node, above) in enumerate(order):
        head, body, end = (len(x) for x in ids[3 * k : 3 * k + 3])
        attends, position = [], 0
        if above >= 0:
            up = segments[above]
            attends, position = list(up["attends"]), up["position"] + up["end"] - up["start"]
            if attends and attends[-1]["end"] == up["start"]:
                attends[-1] = {"start": attends[-1]["start"], "end": up["end"]}
            else:
                attends.append({"start": up["start"], "end": up["end"]})
        loss = size + head, size + head + (body if turn[0] == "assistant" else 0)
        leaves += [{"path": p, "segment": k} for p in node["ends"]]
        segments.append({"start": size, "end": size + head + body + end, "position": position, "loss_start": loss[0], "loss_end": loss[1], "attends": attends})
        size = segments[-1]["end"]
    return {"ids": np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32), "segments": segments, "leaves": leaves}


def _coder(ranks: str):
    """Ids of each of a list of texts; runs of texts are encoded together."""
    encoder = Encoder(Library.of_ranks(ranks))

    def encode(texts: list[str]) -> list[np.ndarray]:
        raw, out, i = [t.encode() for t in texts], [], 0
        size = np.cumsum([0, *map(len, raw)])
        while i < len(raw):
            j = max(i + 1, int(np.searchsorted(size, size[i] + RUN, "right")) - 1)
            ids, begin = encoder.run(np.frombuffer(b"".join(raw[i:j]), np.uint8), size[i : j + 1] - size[i])
            out += np.split(ids, begin[1:-1])
            i = j
        return out

    return encode


def _bucket(ranks):
    def apply(table: pa.Table) -> pa.Table:
        encode, trees = _coder(ranks.value), {}
        for row in table.to_pylist():
            trees.setdefault(row["pack"], []).append((row["path"], [(t["role"], t["text"]) for t in row["turns"]]))
        rows = [{"pack": k, **emit(v, encode)} for k, v in sorted(trees.items())]
        return pa.Table.from_pylist(rows, SCHEMA)

    return apply


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
SCHEMA = pa.schema([
    ("pack", pa.int64()), ("ids", pa.list_(pa.int32())),
    ("segments", pa.list_(pa.struct([*((k, pa.int32()) for k in ("start", "end", "position", "loss_start", "loss_end")), ("attends", pa.list_(_SPAN))]))),
    ("leaves", pa.list_(pa.struct([("path", pa.string()), ("segment", pa.int32())]))),
])


def _cut_trees(one: DataFrame) -> DataFrame:
    """path, turns -> also pack and chars: trees by their first turn, those too large by their subtrees, level by level.

    A subtree of more than a pack's worth is one by itself and may be cut deeper; the others are dealt to packs whole.
    """
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(t["text"]))
    now = cut(one.withColumns({"pack": F.xxhash64(F.get("turns", F.lit(0))), "chars": chars, "more": F.lit(True)}))
    deepest = now.agg(F.max(F.size("turns"))).first()[0] or 0
    parts = F.ceil(F.greatest(F.sum("n") / PACK, F.sum("chars") / LARGE)).alias("parts")
    for depth in range(2, deepest + 1):
        sized = now.where("more").groupBy("pack").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
        large = cut(sized.where(f"n > 1 and (n > {PACK} or chars > {LARGE})").select("pack", F.lit(True).alias("large")))
        if not large.limit(1).count():
            break
        now = now.withColumn("subtree", F.xxhash64(F.slice("turns", 1, depth))).join(large, "pack", "left")
        each = now.where("large and more").groupBy("pack", "subtree").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).withColumn("alone", F.expr(f"n > 1 and (n > {PACK} or chars > {LARGE})"))
        each = each.join(each.where("not alone").groupBy("pack").agg(parts), "pack", "left").select("pack", "subtree", "alone", "parts")
        now = now.join(each, ["pack", "subtree"], "left")
        part = F.when(F.col("alone"), F.col("subtree")).otherwise(F.pmod("subtree", "parts"))
        pack = F.when(F.col("large") & F.col("more"), F.xxhash64("pack", part, "alone", F.lit(depth))).otherwise(F.col("pack"))
        now = cut(now.select("path", "turns", "chars", pack.alias("pack"), F.coalesce(F.col("alone") & F.col("more"), F.lit(False)).alias("more")))
    return now


def emit_packs(found: DataFrame, path: str | None = None) -> DataFrame:
    """paths()'s rows -> PACKS: of each tree (or part of a large one) its ids once, segments and paths' last segments.

    ``path``: the tokenizer's rank file; the public TOKENIZER if None.
    """
    ranks = found.sparkSession.sparkContext.broadcast(rank_text(path or public_tokenizers.path(TOKENIZER)))
    packed = _cut_trees(found.groupBy("path").agg(F.any_value("turns").alias("turns")))
    n, chars = packed.agg(F.count("*"), F.sum("chars")).first()
    buckets = max(1, -(-n // (4 * PACK)), -(-(chars or 0) // (4 * LARGE)))
    # Packs are dealt by their own key, so a hot tree's parts spread over tasks.
    rows = packed.select("path", "turns", "pack", F.pmod("pack", F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").applyInArrow(_bucket(ranks), PACKS)


def _read(ranks):
    """Each path's digests, from the ids that its last segment attends to and that segment's own."""

    def apply(batches):
        replay = Library.of_ranks(ranks.value)
        for batch in batches:
            rows = []
            for pack in batch.to_pylist():
                ids, segments = pack["ids"], pack["segments"]
                begins = {s["start"]: s for s in segments}
                for leaf in pack["leaves"]:
                    last = segments[leaf["segment"]]
                    spans = [*last["attends"], {"start": last["start"], "end": last["end"]}]
                    seen = [x for s in spans for x in ids[s["start"] : s["end"]]]
                    assert len(seen) == last["position"] + last["end"] - last["start"]
                    whole, under = decode(replay, seen).decode(), []
                    for s in spans:
                        at = s["start"]
                        while at < s["end"]:
                            under.append(unescape(decode(replay, ids[begins[at]["loss_start"] : begins[at]["loss_end"]]).decode()))
                            at = begins[at]["end"]
                    turns, loss = parse(whole), "".join(under)
                    said = "".join(f"{role}\n{body}\n" for role, body in turns)
                    rows.append((leaf["path"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole), len(seen)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted_tokens"])

    return apply


def read_back(packs: DataFrame, found: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each conversation, read from the packs: turns, text under the loss mask, formatted length.

    Null roles and texts are empty; rows with a null conv_id are left out; turns go by turn (nulls first), then role
    and text, and repeated rows stay. An empty table gives an empty table.
    """
    ranks = packs.sparkSession.sparkContext.broadcast(rank_text(path or public_tokenizers.path(TOKENIZER)))
    read = packs.mapInArrow(_read(ranks), "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted_tokens long")
    return found.select("conv_id", "path").join(read, "path").drop("path")
