"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token is a row of byte symbols.  The leaves of its segment tree hold, for every pair of neighbouring symbols,
``rank * 2**SHIFT + position``; the root is then the leftmost pair of lowest rank.  A merge changes three leaves, each
in logarithmic time, until the root says that no pair can be merged.  Trees of many short pre-tokens advance together
as NumPy rows; a pre-token of more than ``BATCHED`` bytes has a tree of its own.

Nulls count as empty texts; an empty text has no ids and decodes to the empty text.  Repeated rows are encoded as often
as they occur, other columns are not read, whatever their names; an empty table gives no rows.  Of equal ranks the
leftmost pair merges first.  Very long texts are encoded whole; the memory of a very long pre-token is that of its tree.
"""

from __future__ import annotations

import hashlib
import json
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the byte-level format: the pre-token pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHIFT = 32
NONE = np.iinfo(np.int64).max
BATCHED = 64  # bytes of a pre-token whose tree shares arrays with others
CACHED = 100_000  # pre-tokens remembered by a Python worker, in two generations
CHUNK = 1 << 20  # characters split into pre-tokens at a time


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """What encoding needs of a tokenizer file; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, symbols = spec["model"]["vocab"], byte_symbols()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    byte_of = {c: b for b, c in enumerate(symbols)}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    pieces = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if all(c in byte_of for c in s)}
    pieces |= {i: s.encode() for s, i in added.items()}
    return {
        "bytes": np.array([vocab[c] for c in symbols], np.int64),
        "keys": keys[order],
        "ranks": order.astype(np.int64),
        "merged": np.array([vocab[a + b] for a, b in pairs], np.int64),  # by rank
        "pieces": pieces,
        "added": added,
    }


class Encoder:
    """Encodes and decodes texts; remembers at most ``CACHED`` pre-tokens."""

    def __init__(self, spec: dict) -> None:
        self.byte_ids, self.keys, self.ranks, self.merged = (spec[k] for k in ("bytes", "keys", "ranks", "merged"))
        self.of_pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged[self.ranks].tolist())))
        self.pieces, self.added = spec["pieces"], spec["added"]
        self.split = regex.compile(PATTERN).findall
        names = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.known: dict[str, bytes] = {}  # what recent chunks used
        self.older: dict[str, bytes] = {}  # what those before used

    # -- trees -------------------------------------------------------------------------------------------------------

    def _pairs(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of neighbouring symbols."""
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i] << SHIFT | at, NONE)

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens of one power-of-two class of lengths, all trees advancing at once."""
        n, lengths = max(map(len, words)), np.array([len(w) for w in words])
        width = 1 << max(1, (n - 1).bit_length())
        raw = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(len(words), n)
        ids = self.byte_ids[raw]
        at = np.arange(n)
        alive = at < lengths[:, None]
        after = np.where(at + 1 < lengths[:, None], at + 1, n)
        before = np.broadcast_to(at - 1, ids.shape).copy()
        tree = np.full((len(words), 2 * width), NONE)
        tree[:, width : width + n - 1] = np.where(alive[:, 1:], self._pairs(ids[:, :-1], ids[:, 1:], at[:-1]), NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            root = tree[rows, 1]
            i, new = root & ((1 << SHIFT) - 1), self.merged[root >> SHIFT]
            j = after[rows, i]
            ids[rows, i] = new
            alive[rows, j] = False
            k = after[rows, j]
            after[rows, i] = k
            more = k < n
            before[rows[more], k[more]] = i[more]
            value = self._pairs(new, ids[rows, np.minimum(k, n - 1)], i)
            self._set(tree, width, rows, i, np.where(more, value, NONE))
            self._set(tree, width, rows, j, NONE)
            p = before[rows, i]
            has = p >= 0
            self._set(tree, width, rows[has], p[has], self._pairs(ids[rows[has], p[has]], new[has], p[has]))
            rows = rows[tree[rows, 1] != NONE]
        ids = ids.astype("<u4")
        return [ids[r, a].tobytes() for r, a in enumerate(alive)]

    @staticmethod
    def _set(tree: np.ndarray, width: int, rows: np.ndarray, leaf: np.ndarray, value) -> None:
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node, width = node >> 1, width >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _alone(self, word: bytes) -> bytes:
        """Ids of one long pre-token.  The tree of n leaves is an array of 2 * n numbers, the leaves last; a node is the
        least of nodes 2 * i and 2 * i + 1, so the root is that of all leaves for any n.  28 bytes a byte of the word."""
        first = self.byte_ids[np.frombuffer(word, np.uint8)].astype(np.int32)
        n, none = len(first), int(NONE)
        leaves = np.full(2 * n, NONE)
        for at in range(0, n - 1, CHUNK):
            stop = min(n - 1, at + CHUNK)
            leaves[n + at : n + stop] = self._pairs(first[at:stop].astype(np.int64), first[at + 1 : stop + 1].astype(np.int64), np.arange(at, stop))
        level = n  # nodes whose children are done, from the last ones on
        while level > 1:
            low = (level + 1) // 2
            own = np.arange(low, level)
            leaves[low:level] = np.minimum(leaves[2 * own], leaves[2 * own + 1])
            level = low
        tree, ids = array("q", leaves.tobytes()), array("i", first.tobytes())
        del leaves, first
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        get = self.of_pair.get

        def leaf(a: int, b: int) -> int:
            found = get(ids[a] << 32 | ids[b])
            return none if found is None else found[0] << SHIFT | a

        def put(node: int, value: int) -> None:
            node += n
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != none:
            i = tree[1] & ((1 << SHIFT) - 1)
            j = after[i]
            ids[i] = get(ids[i] << 32 | ids[j])[1]
            k = after[i] = after[j]
            ids[j] = -1
            if k < n:
                before[k] = i
            put(j, none)
            put(i, leaf(i, k) if k < n else none)
            if (p := before[i]) >= 0:
                put(p, leaf(p, i))
        out = np.frombuffer(ids, np.int32)
        return out[out >= 0].astype("<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                self.known[w] = struct.pack("<I", self.byte_ids[raw[0]])
            elif len(raw) > BATCHED:
                self.known[w] = self._alone(raw)
            else:
                classes.setdefault((len(raw) - 1).bit_length(), []).append((w, raw))
        for own in classes.values():
            for i in range(0, len(own), 8192):
                part = own[i : i + 8192]
                self.known.update(zip((w for w, _ in part), self._together([raw for _, raw in part])))

    # -- texts -------------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; names of added tokens stand for these."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            parts = [[(p, None) if p not in self.added else (None, p) for p in self.cut(t)] if self.cut else [(t, None)] for t in texts[start:end]]
            split = [[self.split(p) if p is not None else struct.pack("<I", self.added[a]) for p, a in own] for own in parts]
            if len(self.known) > CACHED // 2:
                self.known, self.older = {}, self.known
            words = {w for own in split for p in own if isinstance(p, list) for w in p}
            new = words - self.known.keys()
            again = new & self.older.keys()
            self.known.update((w, self.older[w]) for w in again)
            self._learn(new - again)
            ids = self.known.__getitem__
            out += [b"".join(b"".join(map(ids, p)) if isinstance(p, list) else p for p in own) for own in split]
            for w in words:
                if len(w) > BATCHED:
                    del self.known[w]
            start = end
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids, malformed UTF-8 replaced."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of long) and ``decoded`` of every row."""
    return _run(docs, path, id_col, text_col, digest=False)


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row, without moving the ids."""
    return _run(docs, path, id_col, text_col, digest=True)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # a vocabulary: bounded by its file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path)
        if encoder is None:
            encoder = _encoders[path] = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                if digest:
                    columns = [
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns = [
                        pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())),
                        pa.array([encoder.decode(x) for x in ids], pa.string()),
                    ]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<long>, decoded string"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {more}")
