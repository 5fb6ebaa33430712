"""Byte-level BPE encoding and decoding by a contiguous rank array.

A word is a short row of symbols whose boundaries stand side by side with the ranks of the
pairs they part. Again and again the row is scanned for its smallest rank (the leftmost of
equals), that boundary is deleted and the ranks on either side are looked up anew. The rows
of all new words of a batch are stepped together as one matrix, so a step costs a few NumPy
calls for thousands of words; words longer than ``SHORT`` bytes take a heap instead, which
gives the same merges without the quadratic scan.
"""

from __future__ import annotations

import gc
import heapq
import json
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

SHORT = 48
#: Parts of texts kept with their ids in each Python worker. Beyond it, and when a task ends,
#: only the first are kept: what is met early is what is met often.
CACHE, KEPT = 500_000, 300_000
#: The rank of a pair that is no merge; with a place of six bits beside it, it fits 32 bits.
_NONE = np.uint32(1 << 25)
_LOADED: dict[str, "Codec"] = {}


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Codec:
    """Ranks, ids and byte strings of one vocabulary file; made once in each worker."""

    PATTERN = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    BLANK = regex.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        symbols = _byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        specials = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *specials.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            if token not in specials:
                self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in specials.items():
            self.bytes_of[i] = token.encode()
        self.specials = specials
        self.odd = not all("<" in x for x in specials)
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.byte_id = np.array([vocab[c] for c in symbols], np.uint32)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self._table([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        self.ranks = {(vocab[a] << 20) | vocab[b]: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        every = np.arange(1 << 16)
        self.first = self.rank(self.byte_id[every >> 8], self.byte_id[every & 255])  # by two bytes
        self.known: dict[str, bytes] = {}

    def _table(self, pairs: list[tuple[int, int]], merged: list[int]) -> None:
        """An open-addressed table from pair to rank, probed for whole arrays at once."""
        bits = max(4, (4 * len(pairs) - 1).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.values, self.merged = np.full(size, np.uint64(2**64 - 1)), np.full(size, _NONE), np.array(merged or [0], np.uint32)
        for rank, (a, b) in enumerate(pairs):
            key = (a << 20) | b
            at = (key * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> int(self.shift)
            while int(self.keys[at]) not in (2**64 - 1, key):
                at = (at + 1) % size
            if int(self.keys[at]) != key:
                self.keys[at], self.values[at] = key, rank

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        at = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = np.full(key.shape, _NONE)
        todo = np.arange(key.size)
        while todo.size:
            k, q = self.keys[at[todo]], key[todo]
            hit = k == q
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (k != np.uint64(2**64 - 1))]
            at[todo] = (at[todo] + 1) % self.keys.size
        return out

    def _rows(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian bytes, of words of one length; the matrix form of the scan.

        A column holds a word's parts, another its ranks. Each step takes one boundary from
        every word that still has a rank, so the words under way are always equally long.
        """
        n, width = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, width)
        part = np.ascontiguousarray(self.byte_id[raw].T)
        ranks = np.ascontiguousarray(self.first[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]].T)
        done, sizes, who = np.zeros((n, width), "<u4"), np.full(n, width), np.arange(n)
        place = np.arange(width, dtype=np.uint32)[:, None]
        for size in range(width, 0, -1):
            if size > 1:
                least = (ranks << np.uint32(6) | place[: size - 1]).min(0)
                best, at = least >> np.uint32(6), (least & np.uint32(63)).astype(np.int64)
                over = best == _NONE
            else:
                over = np.ones(who.size, bool)
            if over.any():
                done[who[over], :size] = part[:, over].T
                sizes[who[over]] = size
                go = np.flatnonzero(~over)
                if not go.size:
                    break
                who, part, ranks, best, at = who[go], part[:, go], ranks[:, go], best[go], at[go]
            columns = np.arange(who.size)
            part[at, columns] = self.merged[best]
            # Delete the boundary: what stands right of it moves one place up.
            part = np.where(place[: size - 1] > at, part[1:], part[:-1])
            ranks = np.where(place[: size - 2] >= at, ranks[1:], ranks[:-1])
            left = np.flatnonzero(at > 0)
            if left.size:
                k = at[left]
                ranks[k - 1, left] = self.rank(part[k - 1, left], part[k, left])
            right = np.flatnonzero(at + 1 < size - 1)
            if right.size:
                k = at[right]
                ranks[k, right] = self.rank(part[k, right], part[k + 1, right])
        flat, stride = done.tobytes(), 4 * width
        return [flat[stride * i : stride * i + 4 * k] for i, k in enumerate(sizes.tolist())]

    def _long(self, word: bytes) -> bytes:
        """The same merges for a long word, from a heap of (rank, place) over a linked list."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, ranks, merged = len(ids), self.ranks, self.merged.tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = merged[r], 0, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] >= 0 and (q := ranks.get((ids[p] << 20) | ids[after[p]])) is not None:
                    heapq.heappush(heap, (q, p, ids[p], ids[after[p]]))
        kept = [ids[i] for i in range(n) if alive[i]]
        return struct.pack(f"<{len(kept)}I", *kept)

    def words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words, each a match of the pattern."""
        named = list(words)
        raw = [w.encode("utf-8", "replace") for w in named]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        out: dict[str, bytes] = {}
        for same in np.split(order, cuts):
            for at in range(0, same.size, 8_000):
                part = same[at : at + 8_000].tolist()
                own = [raw[i] for i in part]
                out.update(zip([named[i] for i in part], self._rows(own) if len(own[0]) <= SHORT else map(self._long, own)))
        return out

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks, which are texts that no word crosses. Letters alone, or letters and
        one stop or comma, are the commonest shapes and need no regular expression."""
        words: set[str] = set()
        tailed, mixed = [], {}
        for c in chunks:
            bare = c[1:] if c[:1] == " " else c
            if bare.isalpha():
                words.add(c)
            elif bare[-1:] in (".", ",") and bare[:-1].isalpha():
                tailed.append(c)
                if c[:1] != " " or c[1:-1] not in self.known:
                    words.add(c[:-1])
            else:
                mixed[c] = own = self.PATTERN.findall(c)
                words.update(own)
        out = self.words(words)
        if tailed:
            ends = {x: self.byte_id[ord(x)].astype("<u4").tobytes() for x in ".,"}
            out.update([(c, (out[c[:-1]] if c[:-1] in out else self.known[c[1:-1]]) + ends[c[-1]]) for c in tailed])
        for c, own in mixed.items():
            out[c] = b"".join([out[w] for w in own])
        return out

    def trim(self) -> None:
        self.known = dict(islice(self.known.items(), KEPT))

    def _general(self, texts: list[str]) -> list[bytes]:
        """Texts with runs of white space: they are cut only at a blank between two other characters."""
        lists = [self.BLANK.split(t) if t else [] for t in texts]
        ids = self.learn({c if not i else " " + c for own in lists for i, c in enumerate(own)})
        return [b"".join([ids[c if not i else " " + c] for i, c in enumerate(own)]) for own in lists]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Cuts at every blank. A part with white space at an edge is never known, which sends
        its text to ``_general``; other parts are independent of their neighbours."""
        if len(self.known) > CACHE:
            self.trim()
        lists = [t.split(" ") for t in texts]
        get = self.known.get
        parts = [list(map(get, own)) for own in lists]
        holes = [[i for i, x in enumerate(p) if x is None] if None in p else [] for p in parts]
        new = {own[i] for own, at in zip(lists, holes) for i in at}
        new = [" " + c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        ids = self.learn(new)
        self.known.update([(c[1:], ids[c]) for c in new])
        heads = self.learn({own[0] for own in lists})
        out, rest = [], []
        for k, (own, p, at) in enumerate(zip(lists, parts, holes)):
            for i in at:
                p[i] = get(own[i])
            p[0] = heads[own[0]]
            if None in p or len(own) > 1 and (not own[0] or own[0][-1].isspace()):
                rest.append(k)
                out.append(b"")
            else:
                out.append(b"".join(p))
        for i, ids in zip(rest, self._general([texts[i] for i in rest])):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and collections would walk the lists of parts
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = [self.special.search(t) is not None if self.special and ("<" in t or self.odd) else False for t in texts]
        if not any(found):
            return self._plain(texts)
        flat, shape = [], []
        for t, has in zip(texts, found):
            own, at = [], 0
            for m in self.special.finditer(t) if has else ():
                own += [len(flat), -self.specials[m.group()] - 1]
                flat.append(t[at : m.start()])
                at = m.end()
            shape.append([*own, len(flat)])
            flat.append(t[at:])
        ids = self._plain(flat)
        return [b"".join([ids[k] if k >= 0 else struct.pack("<I", -k - 1) for k in own]) for own in shape]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[tuple[pa.RecordBatch, list[str], list[bytes]]]:
    c = codec(path)
    for batch in slices(batches, text, 2 << 20):
        texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        yield batch, texts, c.encode(texts)
    c.trim()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and ``ids array<int>``; null and empty texts give an empty array.

    Repeated rows stay repeated; other columns are not read, so their names cannot clash.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch, _, ids in encoded_batches(batches, path, "__text"):
            flat, ends = np.frombuffer(b"".join(ids), "<u4").astype(np.int32), np.cumsum([0, *[len(x) // 4 for x in ids]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], [id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(lean(run), f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: its id and the decoded ``text``; null ids give an empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(F.col(id_col), F.col(ids_col).alias("__ids")).mapInArrow(lean(run), f"`{id_col}` {kind}, text string")


def digests(df: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes whole texts in one pass; per document the counts and digests of both."""
    import hashlib

    def run(batches):
        c = codec(path)
        for batch, _, ids in encoded_batches(batches, path, "text"):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
