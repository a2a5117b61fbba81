"""Removal of byte strings that already start in a document with a smaller id, by two-stage suffix sorting.

A whole corpus has no one suffix array here: it is cut so that equal 50-byte strings always meet.

1. Texts go into chunks of about 2 MB, compressed and written once.
2. Anchors: of the 31 grams of 20 bytes in a 50-byte string, those with the least hash; about one byte in 16 is one.
   Equal strings have equal anchors. Each chunk sends its distinct anchor hashes to buckets; back comes which of them
   other documents have too.
3. For those, the 80 bytes around (distinct within the chunk, with the smallest doc_id) go to buckets by anchor. An anchor of very
   many documents is split: each of its 50-byte strings goes alone, to a bucket by its own hash.
4. A bucket lays its distinct contexts end to end, sorts the suffixes by two-stage sorting, and takes adjacent common
   prefixes: a run of 50 or more is one string, its smallest doc_id that of the run. The answers return to the chunks.

Hashes only decide what meets; a byte goes only where the suffix array shows equal bytes.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from catchwater.llm import kernel as K
from catchwater.llm.session import cut, documents, release

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
BACK, WIDE = SPAN - 1, SPAN - 1 + LENGTH
CHUNK = K.GROUP
#: Text bytes for each bucket, rows of one suffix array, and documents from which an anchor is split.
PER_BUCKET, ROWS, HOT = 16 << 20, 10_000, 20_000

_PACK = "chunk long, n_bytes long, ids array<long>, lens array<long>, blob binary"
_MAIL = "bucket long, chunk long, blob binary"
_FAR = np.iinfo(np.int64).max


def _squeeze(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a.tobytes()) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _spread(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw[:at], np.int64), kinds):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


# --- suffix sorting -------------------------------------------------------------------------------------------------


def _ranked(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes that start at ``at`` by their first ``depth`` bytes: 8 bytes, then 5 more a pass."""
    key, k = words[at], 8
    while True:
        order = np.argsort(key)
        if k >= depth or not len(at):
            return order
        rank = np.empty(len(at), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], key[order[1:]] != key[order[:-1]]])).astype(np.uint64)
        key = (rank << np.uint64(40)) | (words[at + k] >> np.uint64(24))
        k += 5


def suffix_array(text: np.ndarray, needed: np.ndarray | None = None, depth: int = 56) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a byte array in order of at least their first ``depth`` bytes, and the big-endian words of all places.

    Stage one sorts the suffixes that are smaller than their successor. Stage two scans the buckets of first bytes in
    order: the predecessor of each entry, if larger than it, is next in its own bucket. Only the suffixes marked in
    ``needed`` (all, if None) are placed, and those up to the next smaller-than-successor one, which they hang on.
    """
    n = len(text)
    words = np.zeros(n + depth + 16, np.uint64)
    words[:n] = text
    for step in (1, 2, 4):
        words[: -step or None] = (words[: -step or None] << np.uint64(8 * step)) | np.append(words[step:], np.zeros(step, np.uint64))[: len(words) - step]
    smaller = np.zeros(n, bool)
    if n > 1:
        grows, differs = text[:-1] < text[1:], text[:-1] != text[1:]
        last = np.flatnonzero(differs)
        run = np.diff(np.concatenate([[-1], last]))
        smaller[: last[-1] + 1 if len(last) else 0] = np.repeat(grows[last], run)
    placed = np.ones(n, bool)
    if needed is not None:
        hang = np.flatnonzero(smaller | (np.arange(n) == n - 1))
        placed = needed.copy()
        stop = np.zeros(n + 1, np.int32)
        starts = np.flatnonzero(needed & ~smaller)
        np.add.at(stop, starts, 1)
        np.add.at(stop, hang[np.searchsorted(hang, starts)] + 1, -1)
        placed |= np.cumsum(stop[:-1]) > 0
    direct = np.flatnonzero(smaller & placed)
    direct = direct[_ranked(words, direct, depth)]
    first = np.searchsorted(text[direct], np.arange(257))
    induced = placed & ~smaller
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and placed[-1]:
        waiting[text[-1]].append(np.array([n - 1]))
    done = []
    for c in range(256):
        while waiting[c]:
            wave = waiting[c][0] if len(waiting[c]) == 1 else np.concatenate(waiting[c])
            waiting[c] = []
            done.append(wave)
            _deal(text, induced, wave, waiting)
        part = direct[first[c] : first[c + 1]]
        if len(part):
            done.append(part)
            _deal(text, induced, part, waiting)
    return np.concatenate(done) if done else np.zeros(0, np.int64), words


def _deal(text: np.ndarray, induced: np.ndarray, entries: np.ndarray, waiting: list[list[np.ndarray]]) -> None:
    """Appends the larger predecessors of entries, in order, to the buckets of their first bytes."""
    before = entries[entries > 0] - 1
    before = before[induced[before]]
    if len(before):
        key = text[before]
        order = np.argsort(key, kind="stable")
        before, key = before[order], key[order]
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for i, j in zip(cuts, cuts[1:]):
            waiting[key[i]].append(before[i:j])


def common_prefixes(order: np.ndarray, words: np.ndarray, depth: int = 56) -> np.ndarray:
    """For each suffix the bytes that it shares with the one before it, up to ``depth``; 0 for the first."""
    out, same = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for k in range(0, depth, 8):
        x = words[order[same] + k] ^ words[order[same - 1] + k]
        equal = x == 0
        part, x = same[~equal], x[~equal]
        out[part] = k + sum((x < np.uint64(1 << 64 - 8 * b)).astype(np.int64) for b in range(1, 8))
        same = same[equal]
    out[same] = depth
    return out


def first_owners(contexts: np.ndarray, owners: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest owner of each 50-byte string that starts in columns low..high of a context (rows of bytes)."""
    m = len(contexts)
    wide = np.zeros((m, WIDE + 1), np.uint8)
    wide[:, :WIDE] = contexts
    cols = np.arange(WIDE + 1)
    order, words = suffix_array(wide.reshape(-1), ((cols >= low[:, None]) & (cols <= high[:, None])).reshape(-1))
    run = np.cumsum(common_prefixes(order, words) < LENGTH) - 1
    row, col = order // (WIDE + 1), order % (WIDE + 1)
    good = (col >= low[row]) & (col <= high[row])
    row, col, run = row[good], col[good], run[good]
    out = np.full((m, SPAN), _FAR, np.int64)
    if len(run):
        begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        least = np.minimum.reduceat(owners[row], begin)
        out[row, col] = np.repeat(least, np.diff(np.append(begin, len(run))))
    return out


# --- anchors and contexts of a chunk --------------------------------------------------------------------------------


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and documents of the grams that are least in some 50-byte string of a document."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = [np.uint64(pow(K._P, 1 << k, 1 << 64)) for k in range(4)]
    h = data.astype(np.uint64) + np.uint64(1)
    for k in range(2):
        h = h[: -(1 << k)] * p[k] + h[1 << k :]
    quad = h
    for k in (2, 3):
        h = h[: -(1 << k)] * p[k] + h[1 << k :]
    h = h[:-4] * p[2] + quad[16:]
    g = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    least = g
    for k in (1, 2, 4, 8):
        least = np.minimum(least[:-k], least[k:])
    least = np.minimum(least[: -(SPAN - 16)], least[SPAN - 16 :])
    size = np.diff(off)
    least[np.arange(n - LENGTH + 1) + LENGTH > np.repeat(off[1:], size)[: n - LENGTH + 1]] = 0
    most = np.zeros(len(g) + BACK, np.uint32)
    most[BACK : BACK + len(least)] = least
    for k in (1, 2, 4, 8):
        most = np.maximum(most[:-k], most[k:])
    most = np.maximum(most[: -(SPAN - 16)], most[SPAN - 16 :])
    at = np.flatnonzero((most == g) & (g > 0))
    return at, K.mix(h[at].copy()), np.searchsorted(off, at, "right") - 1


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _known(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by bucket, for each its place among them, and in how many of the chunk's documents each is."""
    by = np.lexsort((doc, h))
    hs, ds = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = hs[1:] != hs[:-1]
    apart = new.copy()
    apart[1:] |= ds[1:] != ds[:-1]
    distinct = hs[new]
    docs = np.bincount(np.cumsum(new) - 1, apart, len(distinct)).astype(np.int64) if len(h) else np.zeros(0, np.int64)
    order = np.argsort(_buckets(distinct, n), kind="stable")
    place = np.empty(len(distinct), np.int64)
    place[order] = np.arange(len(distinct))
    where = np.empty(len(h), np.int64)
    where[by] = place[np.cumsum(new) - 1]
    return distinct[order], where, docs[order]


def _contexts(data: np.ndarray, off: np.ndarray, codes: np.ndarray, at, h, doc, where):
    """Occurrences to look up: position, document, bytes before and after it, hash that it meets others by, hash of all its bytes."""
    code = codes[where]
    p, d = at[code > 0], doc[code > 0]
    key, hot = h[code > 0], code[code > 0] == 2
    back, ahead = np.minimum(BACK, p - off[d]), np.minimum(LENGTH, off[d + 1] - p)
    if hot.any():
        s = (p[hot, None] - np.arange(SPAN)).reshape(-1)
        e = np.repeat(d[hot], SPAN)
        good = (s >= off[e]) & (s + LENGTH <= off[e + 1])
        s, first = np.unique(s[good], return_index=True)
        e = e[good][first]
        alone = K.hash_spans(data, s, s + LENGTH)
        p, d, key = np.append(p[~hot], s), np.append(d[~hot], e), np.append(key[~hot], alone)
        back, ahead = np.append(back[~hot], np.zeros_like(s)), np.append(ahead[~hot], np.full_like(s, LENGTH))
    whole = K.hash_spans(data, p - back, p + ahead) + back.astype(np.uint64) * np.uint64(K._P)
    return p, d, back, ahead, key, K.mix(whole ^ K.mix(key.copy()))


def _distinct(key: np.ndarray, whole: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One occurrence of each context, by bucket and key; and of each occurrence the place of its context."""
    by = np.lexsort((whole, key, _buckets(key, n)))
    new = np.ones(len(by), bool)
    new[1:] = whole[by][1:] != whole[by][:-1]
    where = np.empty(len(by), np.int64)
    where[by] = np.cumsum(new) - 1
    return by[new], where


def _opened(batch):
    """Of each chunk: id, document ids, bytes, offsets, and its answers by round, in order of buckets."""
    for k in range(len(batch)):  # one by one, for a batch holds all chunks of a file
        row = batch.slice(k, 1).to_pylist()[0]
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"]), np.uint8)
        off = np.concatenate([[0], np.cumsum(np.array(row["lens"], np.int64))])
        yield row["chunk"], np.array(row["ids"], np.int64), data, off, [[x["blob"] for x in sorted(row.get(k) or (), key=lambda x: x["bucket"])] for k in ("one", "two")]


def _mails(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "chunk", "blob"])


def _codes(answers: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *(_spread(x, np.uint8)[0] for x in answers)])


def _ask_anchors(n):
    def ask(batches):
        for batch in batches:
            for chunk, _, data, off, _ in _opened(batch):
                h, _, docs = _known(*anchors(data, off)[1:], n)
                cuts = np.searchsorted(_buckets(h, n), np.arange(n + 1))
                yield _mails([(b, chunk, _squeeze(h[i:j], np.minimum(docs[i:j], 65535).astype(np.uint16))) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j])

    return ask


def _answer_anchors(table: pa.Table) -> pa.Table:
    chunks = table.column("chunk").to_pylist()
    sent = [_spread(x, np.uint64, np.uint16) for x in table.column("blob").to_pylist()]
    h, back = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
    total = np.bincount(back, np.concatenate([x[1] for x in sent]).astype(np.float64), len(h))
    code = ((total > 1).astype(np.uint8) + (total > HOT))[back].astype(np.uint8)
    cuts = np.cumsum([len(x[0]) for x in sent])[:-1]
    bucket = table.column("bucket")[0].as_py()
    return pa.Table.from_batches([_mails([(bucket, c, _squeeze(x)) for c, x in zip(chunks, np.split(code, cuts))])])


def _ask_contexts(n):
    def ask(batches):
        for batch in batches:
            for chunk, ids, data, off, (one, _) in _opened(batch):
                if not one:
                    continue
                rows = []
                at, h, doc = anchors(data, off)
                p, d, back, ahead, key, whole = _contexts(data, off, _codes(one), at, h, doc, _known(h, doc, n)[1])
                pick, where = _distinct(key, whole, n)
                owner = np.full(len(pick), _FAR, np.int64)
                np.minimum.at(owner, where, ids[d])
                span = np.concatenate([data, np.zeros(WIDE, np.uint8)])
                cols = np.arange(WIDE)
                b = _buckets(key[pick], n)
                cuts = np.searchsorted(b, np.arange(n + 1))
                for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if i < j:
                        q = pick[i:j]
                        text = span[np.maximum(p[q, None] - BACK + cols, 0)]
                        text[(cols < BACK - back[q, None]) | (cols >= BACK + ahead[q, None])] = 0
                        rows.append((k, chunk, _squeeze(owner[i:j], back[q].astype(np.uint8), ahead[q].astype(np.uint8), text)))
                yield _mails(rows)

    return ask


def _row_hashes(text: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: a hash of the gram in its middle, and of all its bytes and place."""
    power = K.powers(WIDE)[0]
    total = (back.astype(np.uint64) + np.uint64(1)) * np.uint64(K._P)
    for k in range(WIDE):
        if k == BACK:
            gram = np.zeros(len(text), np.uint64)
        step = (text[:, k].astype(np.uint64) + np.uint64(1)) * power[k]
        if BACK <= k < BACK + GRAM:
            gram += step
        total += step
    return K.mix(gram), K.mix(total)


def _answer_contexts(table: pa.Table) -> pa.Table:
    chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    sent = []
    for blob in table.column("blob"):  # copies, so that no message stays whole behind its parts
        sent.append([x.copy() for x in _spread(blob.as_py(), np.int64, np.uint8, np.uint8, np.uint8)])
    del table
    cuts = np.cumsum([0] + [len(x[0]) for x in sent])
    text = np.empty((cuts[-1], WIDE), np.uint8)
    for x, i, j in zip(sent, cuts[:-1], cuts[1:]):
        text[i:j] = x.pop().reshape(-1, WIDE)
    owner, back, ahead = (np.concatenate([x[k] for x in sent]) for k in range(3))
    del sent
    key, whole = _row_hashes(text, back)
    by = np.lexsort((whole, key))
    new = np.ones(len(by), bool)
    new[1:] = whole[by[1:]] != whole[by[:-1]]
    del whole
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[by], begin)
    pick = by[begin]
    heads = np.append(np.flatnonzero(np.concatenate([[True], key[pick[1:]] != key[pick[:-1]]])), len(pick))
    del key
    # First owners as places among all owners, in half the bytes; the last place stands for none.
    owners = np.append(np.unique(least), _FAR)
    found = np.empty((len(pick), SPAN), np.int32)
    i = 0
    while i < len(pick):  # whole anchors, about ROWS contexts at a time
        k = np.searchsorted(heads, i + ROWS, "right") - 1
        j = int(heads[k] if heads[k] > i else heads[k + 1])
        q = pick[i:j]
        found[i:j] = np.searchsorted(owners, first_owners(text[q], least[i:j], BACK - back[q].astype(np.int64), BACK + ahead[q].astype(np.int64) - LENGTH))
        i = j
    del text, back, ahead
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new) - 1
    return pa.Table.from_batches([_mails([(bucket, c, _squeeze(owners[found[place[i:j]]] - owner[i:j, None])) for c, i, j in zip(chunks, cuts[:-1], cuts[1:])])])


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Of the removed bytes those whose UTF-8 character is removed whole."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return gone
    whole = np.logical_and.reduceat(gone[:-1], lead)
    return np.append(np.repeat(whole, np.diff(np.append(lead, len(data)))), False)


def _removed(n, as_text, more):
    """Cuts each chunk's covered bytes out; the answers give each distinct context's first owners, less its own."""

    def apply(batches):
        for batch in batches:
            carried = batch.column("more") if more else [None] * len(batch)
            for (_, ids, data, off, (one, two)), rest in zip(_opened(batch), carried):
                gone = np.zeros(len(data) + 1, bool)
                if two:
                    at, h, doc = anchors(data, off)
                    p, d, _, _, key, whole = _contexts(data, off, _codes(one), at, h, doc, _known(h, doc, n)[1])
                    pick, where = _distinct(key, whole, n)
                    owner = np.full(len(pick), _FAR, np.int64)
                    np.minimum.at(owner, where, ids[d])
                    less = np.concatenate([_spread(x, np.int64)[0] for x in two]).reshape(-1, SPAN)
                    row, col = np.nonzero(less[where] + (owner[where] - ids[d])[:, None] < 0)
                    starts = np.zeros(len(data) + 1, np.int32)
                    starts[p[row] - BACK + col] = 1
                    run = np.cumsum(starts, dtype=np.int32)
                    gone = run.copy()
                    gone[LENGTH:] -= run[:-LENGTH]
                    gone = gone > 0
                    if as_text:
                        gone = _whole_characters(data, gone)
                edge = np.zeros(len(data) + 1, bool)
                edge[off] = True
                begin = gone & (edge | ~np.concatenate([[False], gone[:-1]]))
                begin[-1] = False
                ends = gone & (np.append(edge[1:], True) | ~np.append(gone[1:], False))
                ends[-1] = False
                s, e = np.flatnonzero(begin), np.flatnonzero(ends) + 1
                per = np.searchsorted(s, off)
                local = np.searchsorted(off, s, "right") - 1
                kept = np.concatenate([[0], np.cumsum(~gone[:-1])])[off]
                left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone[:-1]]))])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(off)), K.list_array(s - off[local], per), K.list_array(e - off[local], per), left.cast(pa.binary()), *(rest.values.flatten() if more else ())], ["doc_id", "n_bytes", "starts", "ends", "kept", *more])

    return apply


def _chunks(more):
    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, (data, off) = batch.column("doc_id").to_numpy(zero_copy_only=False), K.flat(batch.column("text"))
            for i, j, some, at in K.groups(data, off, CHUNK):
                blob = zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(some).tobytes())
                rest = [pa.ListArray.from_arrays([0, j - i], pa.StructArray.from_arrays([batch.column(c).slice(i, j - i) for c in more], list(more)))] if more else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([part << 32 | number]), pa.array([len(some)]), K.list_array(ids[i:j].astype(np.int64), np.array([0, j - i])), K.list_array(np.diff(at), np.array([0, j - i])), pa.array([blob], pa.binary()), *rest,
                ], ["chunk", "n_bytes", "ids", "lens", "blob", *(["more"] if more else [])])
                number += 1

    return pack


def remove_repeats(docs: DataFrame, as_text: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """documents -> doc_id, n_bytes, starts and ends of the removed runs, kept (the bytes that stay) and the columns in
    ``more``, a row for each document.

    A null text is empty; rows with a null doc_id are left out. Rows that share a doc_id never take bytes from each
    other. Texts under 50 bytes stay whole. An empty table gives an empty table. With ``as_text`` a run gives up the
    characters that it covers only in part, so that what is kept is text again.
    """
    docs = documents(docs, *more)
    rest = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in more)
    chunks = cut(docs.mapInArrow(_chunks(more), _PACK + (f", more array<struct<{rest}>>" if more else "")))
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(4, -(-total // PER_BUCKET))

    def back(mail: DataFrame, name: str) -> DataFrame:
        out = cut(mail.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias(name)))
        release(docs.sparkSession)
        return out

    one = back(chunks.mapInArrow(_ask_anchors(n), _MAIL).groupBy("bucket").applyInArrow(_answer_anchors, _MAIL), "one")
    two = back(chunks.join(one, "chunk", "left").mapInArrow(_ask_contexts(n), _MAIL).groupBy("bucket").applyInArrow(_answer_contexts, _MAIL), "two")
    done = chunks.join(one, "chunk", "left").join(two, "chunk", "left")
    return done.mapInArrow(_removed(n, as_text, more), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more))
