"""Removal of repeated byte strings by a hash-compared suffix sort.

Every 200-byte string that occurs twice shows, wherever it occurs, the same smallest-hashed
100-byte gram. So the starts of a text are cut into runs that share a gram, and runs whose
gram is found nowhere else are done with. Of all others each distinct text goes once, with
its multiplicity, into a mergesort of the suffixes at its starts: prefix polynomial hashes and
a binary search give the common extension of two suffixes and with it their order, and
neighbours that agree over the whole length are verified byte by byte. What the sort finds in
a text holds for all its occurrences. A gram with very many different texts around it is split
by longer grams, and its parts are sorted in the same way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, bitmap, bits_for, encoded, has_bits, lean, slices, unused

LENGTH, GRAM = 200, 100
#: Distinct texts around one gram that are sorted in one task (about 1 MB); more are split by grams
#: of ``STEP`` bytes more, at last by whole 200-byte strings, around each of which there is one text.
HOT, STEP = 4096, 50
#: Bytes of text taken at once in a Python worker.
SLICE = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(5).integers(0, 2**64 - 1, 256, np.uint64)


class _Powers:
    power = back = np.ones(1, _U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.power.size <= n:
            n = max(n, 1 << 16) * 5 // 4
            cls.power = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, _U(_BASE))]))
            cls.back = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, _U(pow(_BASE, -1, 1 << 64)))]))
        return cls.power, cls.back


class Prefix:
    """Prefix polynomial hashes of bytes: the hash of any part is one difference."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        power, self.back = _Powers.upto(self.bytes.size)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_TABLE[self.bytes] * power[: self.bytes.size])])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]

    def grams(self, k: int) -> np.ndarray:
        g = (self.sums[k:] - self.sums[:-k]) * self.back[: max(0, self.bytes.size - k + 1)]
        g ^= g >> _U(32)
        g *= _U(0xD6E8FEB86659FD93)
        return g ^ (g >> _U(32))

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common start of the suffixes at a and b, ``most`` at most, by binary search."""
        out = np.full(a.size, most)
        todo = np.flatnonzero(self.of(a, most) != self.of(b, most))
        if todo.size:
            p, q = a[todo], b[todo]
            low, high = np.zeros(todo.size, np.int64), np.full(todo.size, most - 1)
            while (low < high).any():
                mid = (low + high + 1) // 2
                same = self.of(p, mid) == self.of(q, mid)
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            out[todo] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray, most: int, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b, as far as ``most`` bytes go; ``ties`` if they agree so far."""
        n = self.extension(a, b, most)
        at = np.minimum(n, most - 1)
        return np.where(n == most, ties, self.bytes[a + at] < self.bytes[b + at])


def mergesort(own: Prefix, starts: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Suffix starts sorted within their groups (numbers that ascend), bottom up, all groups at once.

    A run's elements find their places in the run beside it by binary search.
    """
    cur = starts.copy()
    first = np.searchsorted(group, group, "left")
    last = np.searchsorted(group, group, "right")
    place = np.arange(cur.size) - first
    width, most_items = 1, int((last - first).max()) if cur.size else 0
    while width < most_items:
        pair = first + place // (2 * width) * (2 * width)
        right = (place // width & 1).astype(bool)
        low = np.where(right, pair, pair + width)
        high = np.minimum(low + width, last)
        act = np.flatnonzero(low < high)
        who, is_right = cur[act], right[act]
        lo, hi = low[act].copy(), high[act].copy()
        todo = np.arange(act.size)
        while todo.size:
            mid = (lo[todo] + hi[todo]) // 2
            # A right element goes behind equal ones of the left run, a left one before those of the right.
            ahead = own.less(cur[mid], who[todo], most, is_right[todo])
            lo[todo] = np.where(ahead, mid + 1, lo[todo])
            hi[todo] = np.where(ahead, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        inside = act - np.where(is_right, pair[act] + width, pair[act])
        new = cur.copy()
        new[pair[act] + inside + lo - low[act]] = who
        cur = new
        width *= 2
    return cur


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, hash of the whole text, first start, last start) of each run of starts whose smallest gram lies at one place."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, w = Prefix(data).grams(gram), length - gram + 1
    blocks = -(-g.size // w)
    padded = np.full(blocks * w, _U(2**64 - 1))
    padded[: g.size] = g
    square = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(square, 1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    n = g.size - w + 1
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    # A new run where the smallest hash changes, or where its leftmost place is left behind.
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (g[: n - 1] == least[:-1])]))
    last = np.concatenate([first[1:], [n]]) - 1
    whole = np.fromiter((xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())), _U, first.size)
    return least[first].view(np.int64), whole.view(np.int64), first, last


def repeated_starts(texts: list[bytes], grams: np.ndarray, times: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """For each run's text, found ``times`` times: which of its starts have their ``length`` bytes at another
    start of a run with the same gram. One place in the sort stands for all occurrences of a text."""
    data = b"".join(texts)
    own = Prefix(data)
    size = np.array([len(t) for t in texts])
    base = np.cumsum(size) - size
    n = size - length + 1
    owner = np.repeat(np.arange(len(texts)), n)
    starts = base[owner] + np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n)
    _, number = np.unique(grams, return_inverse=True)
    at_owner = np.repeat(np.arange(len(texts)), size)[: max(0, len(data) - gram + 1)]
    hits = np.flatnonzero(own.grams(gram).view(np.int64) == grams[at_owner])
    offset = hits[np.minimum(np.searchsorted(hits, starts), hits.size - 1)] - starts  # of the gram in each string
    order = np.lexsort((offset, number[owner]))
    key = number[owner][order] * (length + 1) + offset[order]
    done = mergesort(own, starts[order], key, length)
    same = np.flatnonzero((key[1:] == key[:-1]) & (own.extension(done[:-1], done[1:], length) == length)) if done.size > 1 else np.zeros(0, np.int64)
    step = np.arange(length)
    sure = np.ones(same.size, bool)
    for s in range(0, same.size, 20_000):
        a, b = done[same[s : s + 20_000]], done[same[s : s + 20_000] + 1]
        sure[s : s + 20_000] = (own.bytes[a[:, None] + step] == own.bytes[b[:, None] + step]).all(1)
    same = same[sure]
    many = np.repeat(times > 1, size)
    flag = np.zeros(len(data), bool)
    flag[done[many[done]]] = True
    flag[done[same]] = True
    flag[done[same + 1]] = True
    return [flag[b : b + k] for b, k in zip(base.tolist(), n.tolist())]


def _pair(a: np.ndarray, b) -> np.ndarray:
    """One hash of two."""
    x = (a.view(_U) ^ (np.asarray(b, np.int64).view(_U) * _U(_BASE))) * _U(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U(31))).view(np.int64)


def _checked(low, high):
    """The text of a class; two texts that share both hashes of its key are an error, not a guess."""
    return F.when(low == high, low).otherwise(F.raise_error(F.lit("two runs share a key")).cast("binary"))


def _sorted(items: DataFrame, held: Scratch, hot: int, gram: int = GRAM) -> DataFrame:
    """(gram, whole, s, e): ranges of repeated starts in the texts of ``items`` (gram, whole, n, k, text),
    where n counts a text's occurrences and k the texts of its gram."""
    whole_strings = gram == LENGTH

    def sort(batches):
        rows, size = [], 0

        def flush():
            out = [[], [], [], []]
            flags = repeated_starts([r[3] for r in rows], np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows]), LENGTH, gram) if rows else []
            for (g, w, _, _), flag in zip(rows, flags):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    for column, value in zip(out, (g, w, s, e - 1)):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["gram", "whole", "s", "e"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size > 400_000 and row[0] != rows[-1][0]:
                    yield flush()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        yield flush()

    parts = int(held.spark.conf.get("spark.sql.shuffle.partitions"))
    cool = items if whole_strings else items.where(F.col("k") <= hot)
    out = cool.select("gram", "whole", "n", "text").repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(lean(sort), "gram long, whole long, s long, e long")
    rest = items.where(F.col("k") > hot)
    if whole_strings or rest.isEmpty():
        return out
    longer = min(LENGTH, gram + STEP)

    def split(batches):
        for batch in batches:
            up, out = [[], [], []], [[], [], [], []]
            for g, w, n, x in zip(*[c.to_pylist() for c in batch.columns]):
                grams, wholes, a, b = runs(x, LENGTH, longer)
                for column, value in zip(up, (g, w, n)):
                    column += [value] * a.size
                for column, values in zip(out, (grams.tolist(), wholes.tolist(), a.tolist(), [x[p : q + LENGTH] for p, q in zip(a.tolist(), b.tolist())])):
                    column += values
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (*up, *out[:3])], pa.array(out[3], pa.binary())], ["up_gram", "up_whole", "n", "gram", "whole", "a", "text"])

    cuts = held.write(rest.select("gram", "whole", "n", "text").mapInArrow(lean(split), "up_gram long, up_whole long, n long, gram long, whole long, a long, text binary"), f"cuts-{longer}")
    classes = cuts.groupBy("gram", "whole").agg(F.sum("n").alias("n"), _checked(F.min("text"), F.max("text")).alias("text"))
    classes = held.write(classes, f"parts-{longer}")
    inner = _sorted(classes.join(classes.groupBy("gram").agg(F.count("*").alias("k")), "gram"), held, hot, longer)
    back = cuts.drop("text", "n").join(inner, ["gram", "whole"])
    return out.unionByName(back.select(F.col("up_gram").alias("gram"), F.col("up_whole").alias("whole"), (F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e")).alias("e")))


def _ranges(docs: DataFrame, held: Scratch, hot: int) -> DataFrame:
    """(row_key, a, b): ranges of repeated starts in each text; ``docs`` has row_key and text."""
    spark = docs.sparkSession

    def listed(batches):
        for batch in slices(batches, "text", SLICE):
            key, parts = batch.column(0).to_numpy(), [runs(x) for x in encoded(batch.column(1))]
            gram, whole, first = (np.concatenate([p[k] for p in parts]) for k in range(3))
            place = _pair(first, np.repeat(key, [p[0].size for p in parts]))
            for s in range(0, gram.size, 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 50_000]) for c in (gram, whole, place)], ["gram", "whole", "place"])

    # A run's text is known by two hashes of different kinds, its gram's and its own, 128 bits in all; the
    # texts at the least and the greatest place (a hash of row and start) are fetched and must agree.
    all_runs = docs.mapInArrow(lean(listed), "gram long, whole long, place long")
    classes = held.write(all_runs.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")), "classes")
    met = classes.groupBy("gram").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where("total > 1").select("gram", "k")
    known = held.write(classes.join(met, "gram"), "known")
    held.drop("classes")
    bits = bits_for(known.count())
    ends = known.select(F.col("low").alias("place")).unionByName(known.where("low <> high").select(F.col("high").alias("place")))
    shared = spark.sparkContext.broadcast((bitmap(known, "whole", bits), bitmap(ends, "place", bits)))

    def found(batches):
        of_texts, of_places = shared.value
        for batch in slices(batches, "text", SLICE):
            columns, texts = [], []
            for key, x in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                gram, whole, a, b = runs(x)
                some = np.flatnonzero(has_bits(of_texts, whole, bits))
                gram, whole, a, b = gram[some], whole[some], a[some], b[some]
                place = _pair(a, np.full(a.size, key))
                columns.append((gram, whole, place, np.full(a.size, key), a))
                fetch = has_bits(of_places, place, bits).tolist()
                texts += [x[p : q + LENGTH] if f else None for p, q, f in zip(a.tolist(), b.tolist(), fetch)]
            names = ["gram", "whole", "place", "row_key", "a"]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate([c[k] for c in columns])) for k in range(5)], pa.array(texts, pa.binary())], [*names, "text"])

    marked = held.write(docs.mapInArrow(lean(found), "gram long, whole long, place long, row_key long, a long, text binary"), "marked")
    fetched = marked.where("text is not null").select("gram", "whole", "place", "text").join(known, ["gram", "whole"]).where("place = low or place = high")
    items = fetched.groupBy("gram", "whole").agg(F.first("n").alias("n"), F.first("k").alias("k"), _checked(F.min("text"), F.max("text")).alias("text"))
    flags = _sorted(held.write(items, "items"), held, hot)
    return marked.select("gram", "whole", "row_key", "a").join(flags, ["gram", "whole"]).select("row_key", (F.col("a") + F.col("s")).alias("a"), (F.col("a") + F.col("e")).alias("b"))


def _lists(column: pa.Array) -> list[list[tuple[int, int]]]:
    """The (a, b) of each row of an array of structs; none for null."""
    a, b = (c.to_pylist() for c in column.flatten().flatten())
    ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()).tolist()
    return [list(zip(a[s:e], b[s:e])) for s, e in zip([0, *ends], ends)]


def cut(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes without those covered from the ranges of starts; removed bytes and maximal removed runs."""
    if not ranges:
        return data, 0, 0
    kept, at, gone, spans = [], 0, 0, 0
    end = -1
    for a, b in sorted((a, b + LENGTH) for a, b in ranges):
        if a > end:
            kept.append(data[max(at, 0) : a])
            spans += 1
            gone += b - a
        elif b > end:
            gone += b - end
        end = max(end, b)
        at = end
    kept.append(data[at:])
    return b"".join(kept), gone, spans


def _joined(docs: DataFrame, hot: int) -> tuple[DataFrame, str]:
    """``docs`` with one more column of the ranges of starts to remove in each text, or null, and its name."""
    held = Scratch(docs.sparkSession, "suffixes")
    key, other, name = unused(docs, "row_key", "range_key", "ranges")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = _ranges(keyed.select(F.col(key).alias("row_key"), "text"), held, hot)
    ranges = held.write(found.groupBy(F.col("row_key").alias(other)).agg(F.collect_set(F.struct("a", "b")).alias(name)), "ranges")
    held.drop("known", "marked", "items", *[f"{x}-{n}" for n in range(GRAM + STEP, LENGTH + 1, STEP) for x in ("cuts", "parts")])
    return keyed.join(ranges, F.col(key) == F.col(other), "left").drop(key, other), name


def deduplicate(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut: every byte goes that a 200-byte string covers which also starts elsewhere.

    Texts are UTF-8 bytes; overlaps count and all occurrences go, judged on the input. What is
    left of a character cut through goes as well. A null text stays null and holds nothing, an
    empty one or one under 200 bytes stays whole; rows that repeat (with their doc_id or without,
    null ids among them) hold each other's text, so their texts go. Very long texts are cut like
    others, and there are no ties to break, as every occurrence goes. An empty table gives no
    rows. Other columns pass through, whatever their names.
    """
    joined, name = _joined(docs, hot)

    @F.arrow_udf("string")
    def rest(text: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for part in slices(iter([pa.RecordBatch.from_arrays([text, ranges], ["text", "ranges"])]), "text", SLICE):
            for t, r in zip(part.column(0).to_pylist(), _lists(part.column(1))):
                out.append(t if t is None or not r else cut(t.encode(), r)[0].decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    return joined.select(*[F.when(F.col(name).isNull(), F.col("text")).otherwise(rest("text", name)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def digests(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row: bytes, removed bytes, maximal removed runs and the digest of the rest.

    A null text is empty; a null doc_id stays null and repeated rows stay repeated. Only
    ``doc_id`` and ``text`` are read, so other columns cannot clash; an empty table gives no rows.
    """

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            rows = []
            for x, ranges in zip(encoded(batch.column(1)), _lists(batch.column(2))):
                rest, gone, spans = cut(x, ranges)
                rows.append((len(x), gone, spans, hashlib.sha256(rest).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined, name = _joined(docs.select(F.col("doc_id").cast("long"), "text"), hot)
    return joined.select("doc_id", "text", name).mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
