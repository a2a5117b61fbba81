"""Byte-level BPE by corpus-level merge replay.

Texts are cut into pieces by the pattern's rules, worked out over whole runs of texts at once. The distinct pieces of a
run form a small corpus of token sequences; an inverted index leads from each token pair to its positions, and every
merge is replayed in rank order over all its positions, after which only the touched neighbours' pairs are indexed
anew. Each text's ids are then gathered from its pieces. Everything happens map-side: no shuffle.
"""

import base64
import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from catchwater.llm import kernel as K
from catchwater.llm.session import documents

#: Characters of text handled at once, and distinct pieces kept between runs of a task.
RUN, KEPT = 2 << 20, 1 << 20
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@lru_cache(maxsize=None)
def letter_classes() -> np.ndarray:
    """The class of every code point."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            for a in (m.start(), m.end() - 1):
                assert points[a]
            out[ord(points[m.start()]) : ord(points[m.end() - 1]) + 1] = kind
    out[0xD800:0xE000] = _OTHER
    return out


def pieces(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where each match of the pattern starts in texts of code points that lie end to end; matches leave no gap.

    A match is a contraction, a run of letters, of numbers or of other signs, each with one blank before it if there is
    one, or white space: all of a run but the character that touches the next run, which stands alone if not a blank.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = letter_classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    before = np.zeros(n, bool)  # the last white space of a run that more text follows
    before[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    at = np.flatnonzero(before)
    start[at] = True
    blank = at[points[at] == 32]
    start[blank + 1] = False
    for p in np.flatnonzero(start & (points == 39)):  # an apostrophe that begins a match
        if p + 1 < n and not edge[p + 1]:
            two = points[p + 1 : p + 3]
            one = two[0] in (115, 116, 109, 100)
            if one or (len(two) == 2 and not edge[p + 2] and tuple(two) in ((114, 101), (118, 101), (108, 108))):
                start[p + 1] = False
                end = p + 2 if one else p + 3
                if end < n and not edge[end] and not (space[end] and not start[end]):
                    start[end] = True
    return np.flatnonzero(start)


class Replay:
    """Merges by rank; ``ranks`` leads from byte strings to ids, and lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.merge: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.merge[a, b] = rank

    @classmethod
    @lru_cache(maxsize=None)
    def load(cls, text: str) -> "Replay":
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines())})

    def whole(self, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of strings that are pieces of their own, whatever the pattern says."""
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and where each word's begin."""
        known = [self.ranks.get(w) for w in words]
        long = [w for w, k in zip(words, known) if k is None]
        size = np.fromiter(map(len, long), np.int64, len(long))
        end = np.cumsum(size)
        token = self.single[np.frombuffer(b"".join(long), np.uint8)].tolist()
        n = len(token)
        ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
        for e, s in zip(end.tolist(), (end - size).tolist()):
            ahead[e - 1], back[s] = -1, -1
        merge, index, heap = self.merge, {}, []
        for i, (a, b) in enumerate(zip(token, token[1:])):
            if ahead[i] >= 0 and (r := merge.get((a, b))) is not None:
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            spots = index.pop(rank, None)
            if spots is None:
                continue
            spots.sort()
            again, lower = [], -1
            for i in spots:
                if i < lower:  # a merge in this word now comes before this one
                    again.append(i)
                    continue
                j = ahead[i]
                if token[i] < 0 or j < 0 or merge.get((token[i], token[j])) != rank:
                    continue
                k = ahead[j]
                token[i], token[j], ahead[i] = rank, -1, k
                if k >= 0:
                    back[k] = i
                for p, q in ((back[i], i), (i, k)):
                    if p >= 0 and q >= 0 and (r := merge.get((token[p], token[q]))) is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(heap, r)
                        index[r].append(p)
                        if r < rank:
                            lower = int(end[np.searchsorted(end, i, "right")])
            if again:
                if rank not in index:
                    index[rank] = []
                heapq.heappush(heap, rank)
                index[rank] += again
        flat = np.array(token, np.int64)
        live = flat >= 0
        per_long = np.add.reduceat(live, end - size) if n else np.zeros(0, np.int64)
        flat = flat[live]
        whole = np.array([-1 if k is None else k for k in known], np.int64)
        count = np.ones(len(words), np.int64)
        count[whole < 0] = per_long
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], np.int64)
        inside = np.repeat(whole < 0, count)
        out[inside], out[~inside] = flat, whole[whole >= 0]
        return out, begin


class Encoder:
    """Ids of many texts; remembers the distinct pieces of earlier runs, up to KEPT."""

    def __init__(self, replay: Replay):
        self.replay = replay
        self.forget()

    def forget(self):
        self.keys, self.begin, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def run(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 texts that lie end to end -> ids, and where each text's begin."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        raw = data.tobytes()
        a, b = self.replay.whole(raw, off)
        p = pieces(points, np.searchsorted(lead, np.union1d(off, np.concatenate([a, b]))))
        s = lead[p]
        if len(a):
            k = np.searchsorted(a, s, "right") - 1
            s = s[(k < 0) | (s == a[k]) | (s >= b[k])]
        e = np.append(s[1:], len(data))
        key, first, where = np.unique(K.hash_spans(data, s, e), return_index=True, return_inverse=True)
        if len(self.keys) > KEPT:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = self.keys[at] != key if len(self.keys) else np.ones(len(key), bool)
        if new.any():
            ids, begin = self.replay.encode([raw[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist())])
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys)
            self.keys = keys[order]
            self.begin = np.concatenate([self.begin, begin[:-1] + len(self.ids)])[order]
            self.count = np.concatenate([self.count, np.diff(begin)])[order]
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.keys, key)
        begin, count = self.begin[at][where], self.count[at][where]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(s, off)]


def decode(replay: Replay, ids: list[int]) -> bytes:
    return b"".join(map(replay.bytes_of.__getitem__, ids))


class Library(Replay):
    """The same ids from the tiktoken library, piece by piece; for jobs that need ids and not this operator.

    Added tokens are single pieces wherever a text holds them, as the tokenizers library has it.
    """

    def __init__(self, ranks: dict[bytes, int], added: dict[bytes, int]):
        self.core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.added, self.bytes_of = added, {v: k for k, v in ranks.items()}
        self.find = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    @classmethod
    @lru_cache(maxsize=None)
    def of_ranks(cls, text: str) -> "Library":
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines())}, {})

    @classmethod
    @lru_cache(maxsize=None)
    def of_json(cls, text: str) -> "Library":
        """From a byte-level tokenizer file whose ids follow the order of merges; signs stand for bytes. Others raise ValueError."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        spec = json.loads(text)
        model, before, vocab = spec["model"], spec.get("pre_tokenizer") or {}, spec["model"]["vocab"]
        merges = [vocab[x.replace(" ", "") if isinstance(x, str) else "".join(x)] for x in model["merges"]]
        plain = model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(a >= b for a, b in zip(merges, merges[1:])):
            raise ValueError("not a plain byte-level file with merges in the order of ids")
        added = {x["content"]: x for x in spec.get("added_tokens", ())}
        if any(x.get(k) for x in added.values() for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that take in more than themselves")
        ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items() if token not in added}
        return cls(ranks, {token.encode(): x["id"] for token, x in added.items()})

    def whole(self, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.find:
            return super().whole(raw, off)
        spans = np.array([m.span() for m in self.find.finditer(raw)], np.int64).reshape(-1, 2)
        text = np.searchsorted(off, spans[:, 0], "right") - 1  # a match over two texts' ends is none
        spans = spans[spans[:, 1] <= off[text + 1]] if len(spans) else spans
        return spans[:, 0], spans[:, 1]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[self.added[w]] if w in self.added else self.core(w) for w in words]
        return np.fromiter((i for x in ids for i in x), np.int64), np.cumsum([0, *map(len, ids)])


def rank_text(path: str) -> str:
    """The rank file as text, read once on the driver; it is as large as the vocabulary, not as the data."""
    with open(path) as f:
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """documents -> doc_id, ids (array), decoded (bytes): the ids of each whole text and what they decode to.

    A null text is empty and has no ids; rows with a null doc_id are left out; repeated rows each get their row. No
    special tokens: their strings are ordinary text. An empty table gives an empty table.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(rank_text(path))

    def apply(batches):
        replay = Replay.load(ranks.value)
        encoder = Encoder(replay)
        for batch in batches:
            data, off = K.flat(batch.column("text"))
            for i, j, part, at in K.groups(data, off, RUN):
                ids, begin = encoder.run(part, at)
                every = ids.tolist()
                decoded = [decode(replay, every[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), K.list_array(ids.astype(np.int32), begin), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return documents(docs).mapInArrow(apply, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """encode()'s rows -> doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256."""

    def apply(batches):
        for batch in batches:
            flat, off = batch.column("ids").flatten().to_numpy(zero_copy_only=False).astype("<u4"), batch.column("ids").offsets.to_numpy()
            off = off - off[0]
            raw = flat.tobytes()
            ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            text = [hashlib.sha256(x).hexdigest() for x in batch.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off).astype(np.int64)), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(apply, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
