"""Line deduplication by a segment-partition edit join.

A line within k edits of another holds one of the other's k + 1 even segments unchanged, at
most a few places away. Segments are indexed under the line's length and the segment's number;
each line probes the indexes of its own and the k next smaller lengths with the substrings
that the multi-match-aware rule leaves. What meets there is verified with a banded
bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from .common import Scratch, bitmap, bits_for, has_bits, lean, slices, unused
from .graph import components

EDITS, PER_EDIT = 2, 20
#: Pairs of a bucket that are held against each other at once; members of larger buckets are
#: first held against one of them, and then across the components that are left.
AT_ONCE = 64
#: Distinct rows of a bucket that are held; one with more is dealt with row by row.
HELD = 200_000
#: Bytes of text taken at once in a Python worker.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_INDEX, _ID = np.int64(-(1 << 63)), np.int64((1 << 63) - 1)


def allowed(a: int, b: int, edits: int = EDITS, per_edit: int = PER_EDIT) -> int:
    """Edits that two lines of these lengths may be apart: one for each ``per_edit`` characters of the shorter."""
    return min(edits, min(a, b) // per_edit)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of two strings is at most k: ends in common are cut off, then
    a band of 2k + 1 diagonals is kept in the bits of one number and stepped by characters."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]:
            low = mid
        else:
            high = mid - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return max(len(a), len(b)) <= k
    return _banded(a, b, k)


def _banded(a: str, b: str, k: int) -> bool:
    """Levenshtein's automaton with k errors over the diagonals of a band: bit d of row e says
    that diagonal d (a's place less b's, plus k) is reached with e edits so far."""
    width = 2 * k + 1
    full = (1 << width) - 1
    rows = [0] * (k + 1)
    rows[0] = 1 << k
    for e in range(1, k + 1):  # characters of a left out before the first of b
        rows[e] = rows[e - 1] | (rows[e - 1] << 1) & full
    n = len(a)
    for j, c in enumerate(b):
        match = 0
        for d in range(width):
            i = j + d - k
            if 0 <= i < n and a[i] == c:
                match |= 1 << d
        new = []
        for e in range(k + 1):
            now = rows[e] & match
            if e:
                # A substitution stays on its diagonal, a character of b more goes one down,
                # a character of a more goes one up and costs an edit within this step.
                now |= rows[e - 1] | rows[e - 1] >> 1 | (new[e - 1] << 1) & full
            new.append(now)
        if not new[k]:
            return False
        rows = new
    end = n - len(b) + k
    return bool(rows[k] >> end & 1)


def ids(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each line, of 63 and 64 bits."""
    h = [xxh3_128_intdigest(x.encode("utf-8", "replace")) for x in lines]
    high = np.fromiter((x >> 65 for x in h), _U, len(h))
    return high.view(np.int64), np.fromiter((x & (2**64 - 1) for x in h), _U, len(h)).view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def segments(length: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of each of the k + 1 even segments of lines of these lengths."""
    base, longer = length // (k + 1), length % (k + 1)
    out, start = [], np.zeros_like(length)
    for i in range(k + 1):
        size = base + (i >= k + 1 - longer)
        out.append((start, size))
        start = start + size
    return out


class _Hashes:
    """Polynomial prefix hashes over lines laid end to end; any substring's hash is one difference."""

    power = np.ones(1, _U)

    def __init__(self, lines: list[str]):
        raw = "".join(lines).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, "<u4").astype(_U)
        self.length = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.length) - self.length
        if _Hashes.power.size < codes.size + 1:
            _Hashes.power = np.cumprod(np.concatenate([np.ones(1, _U), np.full(codes.size, _U(_BASE))]))
            _Hashes.back = np.cumprod(np.concatenate([np.ones(1, _U), np.full(codes.size, _U(_BACK))]))
        terms = _mix(codes + _U(1)) * _Hashes.power[: codes.size]
        self.prefix = np.concatenate([np.zeros(1, _U), np.cumsum(terms)])

    def of(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = self.start[rows] + start
        return (self.prefix[at + size] - self.prefix[at]) * _Hashes.back[at]


def keys(lines: list[str], h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) rows of distinct lines: of the index with the id's sign bit set, so that they sort first, and of the probes."""
    own = _Hashes(lines)
    out_key, out_id = [], []

    def put(rows, start, size, length, i, side):
        tag = _mix((length.astype(_U) << _U(8)) + _U(i + 1))
        out_key.append(_mix(own.of(rows, start, size) ^ tag).view(np.int64))
        out_id.append(h[rows] | np.int64(side))

    rows = np.arange(len(lines))
    for i, (start, size) in enumerate(segments(own.length, k)):
        put(rows, start, size, own.length, i, _INDEX)
    for shift in range(k + 1):
        rows = np.flatnonzero(own.length - shift >= k + 1)
        length = own.length[rows] - shift
        for i, (start, size) in enumerate(segments(length, k)):
            low = np.maximum(np.maximum(start - i, start + shift - (k - i)), 0)
            high = np.minimum(np.minimum(start + i, start + shift + (k - i)), own.length[rows] - size)
            for step in range(int((high - low).max()) + 1 if rows.size else 0):
                some = low + step <= high
                put(rows[some], (low + step)[some], size[some], length[some], i, 0)
    return np.concatenate(out_key), np.concatenate(out_id)


def _lines(text: str | None) -> list[str]:
    return [x for x in text.split("\n") if x and not x.isspace()] if text else []


def _met(sorted_rows: DataFrame, most: int = HELD) -> DataFrame:
    """Buckets of rows sorted by key and id: pairs (key null) of small ones, members of large ones.

    A bucket is held up to ``most`` distinct rows. Of a larger one, whatever its size, each row is
    given out as it comes: as a member, and as a pair with the first of the index, which sorts first.
    """

    def large(key: int, pivot: int, own: np.ndarray):
        members, probe = own & _ID, own[own >= 0]
        probe = probe[probe != pivot]
        a = np.concatenate([members, np.minimum(pivot, probe)])
        b = np.concatenate([(own < 0).astype(np.int64), np.maximum(pivot, probe)])
        bucket = np.full(a.size, key)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64(), mask=np.arange(a.size) >= own.size), pa.array(a), pa.array(b)], ["key", "a", "b"])

    def flush(key: np.ndarray, who: np.ndarray):
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [key.size]])
        # There is nothing to meet without an index (first) and a probe (last) of another line, or with one row of either.
        some = np.flatnonzero((who[starts] < 0) & (who[ends - 1] >= 0))
        a, b, bucket, role = [], [], [], []
        for s, e in zip(starts[some].tolist(), ends[some].tolist()):
            own = who[s:e]
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            n = int(np.searchsorted(own, 0))
            index, probe = own[:n] & _ID, own[n:]
            if index.size == 1 and probe.size == 1 and index[0] == probe[0]:
                continue
            if index.size * probe.size <= AT_ONCE:
                x, y = np.repeat(index, probe.size), np.tile(probe, index.size)
            else:
                x, y = np.full(probe.size, index[0]), probe
                everyone = np.unique(np.concatenate([index, probe]))
                a.append(everyone)
                b.append(np.isin(everyone, index).astype(np.int64))
                bucket.append(np.full(everyone.size, key[s]))
                role.append(np.ones(everyone.size, bool))
            keep = x != y
            a.append(np.minimum(x, y)[keep])
            b.append(np.maximum(x, y)[keep])
            bucket.append(np.zeros(int(keep.sum()), np.int64))
            role.append(np.zeros(int(keep.sum()), bool))
        if not a:
            return None
        big = np.concatenate(role)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket), pa.int64(), mask=~big), pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["key", "a", "b"])

    def run(batches):
        held_k, held_w, held, open_ = [], [], 0, None  # open_: key and pivot of the bucket that is given out as it comes
        for batch in batches:
            if not batch.num_rows:
                continue
            k, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if open_ is not None:
                end = int(np.searchsorted(k, open_[0], "right")) if k[0] == open_[0] else 0
                if end and open_[1] is not None:
                    yield large(*open_, np.unique(w[:end]))
                k, w = k[end:], w[end:]
                if not k.size:
                    continue
                open_ = None
            cut = int(np.searchsorted(k, k[-1], "left"))  # the last bucket may go on
            if cut:
                out = flush(np.concatenate([*held_k, k[:cut]]), np.concatenate([*held_w, w[:cut]]))
                held_k, held_w, held = [], [], 0
                if out is not None:
                    yield out
            elif held_k and held_k[-1][0] != k[-1]:
                out = flush(np.concatenate(held_k), np.concatenate(held_w))
                held_k, held_w, held = [], [], 0
                if out is not None:
                    yield out
            held_k.append(k[cut:])
            held_w.append(w[cut:])
            held += k.size - cut
            if held > most:
                own = np.unique(np.concatenate(held_w))
                held_k, held_w, held = [np.full(own.size, k[-1])], [own], own.size
                if held > most // 2:
                    open_ = (int(k[-1]), int(own[0] & _ID) if own[0] < 0 else None)
                    if open_[1] is not None:
                        yield large(*open_, own)
                    held_k, held_w, held = [], [], 0
        if held_k:
            out = flush(np.concatenate(held_k), np.concatenate(held_w))
            if out is not None:
                yield out

    return sorted_rows.mapInArrow(lean(run), "key long, a long, b long")


def _confirm(pairs: DataFrame, docs: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """The pairs (a, b) of line ids whose texts are within the edits they may be apart."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    bits = bits_for(2 * pairs.count())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "id", bits))

    def texts(batches):
        for batch in slices(batches, "text", SLICE):
            own = list({x for t in batch.column(0).to_pylist() for x in _lines(t)})
            h, _ = ids(own)
            some = np.flatnonzero(has_bits(shared.value, h, bits))
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array([own[i] for i in some], pa.string())], ["id", "line"])

    # Two texts of one id (a collision) both stay, and either may confirm a pair.
    held = docs.select("text").mapInArrow(lean(texts), "id long, line string").distinct()
    both = pairs.join(held.select(F.col("id").alias("a"), F.col("line").alias("s")), "a").join(held.select(F.col("id").alias("b"), F.col("line").alias("t")), "b")

    def run(batches):
        for batch in batches:
            keep = [i for i, (s, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if (k := allowed(len(s), len(t), edits, per_edit)) and within(s, t, k)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "s", "t").mapInArrow(lean(run), "a long, b long").distinct()


def links(docs: DataFrame, held: Scratch, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """(u, v) between ids of distinct lines that are near each other, enough of them to join what is connected."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            own = sorted({x for t in batch.column(0).to_pylist() for x in _lines(t) if len(x) >= per_edit})
            if own:
                key, who = keys(own, ids(own)[0], edits)
                for s in range(0, key.size, 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[s : s + 50_000]), pa.array(who[s : s + 50_000])], ["key", "id"])

    rows = docs.select("text").mapInArrow(lean(run), "key long, id long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = held.write(_met(rows.repartition(parts, "key").sortWithinPartitions("key", "id")), "met")
    first = held.write(met.where("key is null").select("a", "b").distinct(), "pairs-1")
    near = held.write(_confirm(first, docs, edits, per_edit), "near-1")
    known = components(near.toDF("u", "v"), held).withColumnRenamed("id", "a")
    placed = held.write(met.where("key is not null").join(known, "a", "left").select("key", "a", F.col("b").alias("index"), F.coalesce("component_id", "a").alias("c")), "placed")
    per = placed.groupBy("key", "c").agg(F.count("*").alias("k"))
    open_ = per.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("n")).where("n > 1").select("key", "main")
    left = placed.join(open_, "key").where("c <> main").select("key", F.col("a").alias("p"), F.col("c").alias("cp"), F.col("index").alias("ip"), "main")
    right = placed.select("key", F.col("a").alias("q"), F.col("c").alias("cq"), F.col("index").alias("iq"))
    across = left.join(right, "key").where("cp <> cq and ip + iq > 0 and (cq = main or p < q)").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    second = held.write(across.join(first, ["a", "b"], "left_anti"), "pairs-2")
    more = held.write(_confirm(second, docs, edits, per_edit), "near-2")
    held.drop("met", "pairs-1", "placed", "pairs-2")
    return near.unionByName(more).toDF("u", "v")


def _decisions(docs: DataFrame, held: Scratch, edits: int, per_edit: int) -> DataFrame:
    """(doc_id, found array<(id, other, component, own)>) of documents with a line that is met again.

    ``own`` is true where the document is the first, by id, to hold a line of the component.
    """

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            doc, own = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _lines(t)
                own += found
                doc += [d] * len(found)
            h, g = ids(own)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(h), pa.array(g)], ["doc_id", "id", "other"])

    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, id long, other long")
    per_doc = held.write(lines.groupBy("id", "other", "doc_id").agg(F.count("*").alias("n")), "lines")
    classes = per_doc.groupBy("id", "other").agg(F.min("doc_id").alias("first"), F.sum("n").alias("n"))
    # Documents without id take no part, not even as a link between two others.
    known = components(links(docs.where("doc_id is not null"), held, edits, per_edit), held)
    placed = classes.join(known, "id", "left").where("n > 1 or component_id is not null")
    # A class without links is a component of its own, told apart from others by both hashes.
    placed = held.write(placed.select("id", "other", "first", F.coalesce("component_id", F.xxhash64("id", "other")).alias("component"), F.col("component_id").isNotNull().alias("joined")), "placed-lines")
    head = placed.groupBy("component", "joined").agg(F.min("first").alias("head"))
    marked = placed.join(head, ["component", "joined"]).select("id", "other", "component", "head")
    hits = per_doc.join(marked, ["id", "other"]).select("doc_id", "id", "other", "component", (F.col("doc_id") == F.col("head")).alias("own"))
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct("id", "other", "component", "own")).alias("found"))


def dedup_text(text: str, known: dict[tuple[int, int], tuple[int, bool]]) -> tuple[str, int]:
    """The text without its repeated lines, and how many those are; ``known`` has component and own by a line's ids."""
    own = text.split("\n")
    at = [i for i, x in enumerate(own) if x and not x.isspace()]
    h, g = ids([own[i] for i in at])
    seen, gone = set(), set()
    for i, key in zip(at, zip(h.tolist(), g.tolist())):
        hit = known.get(key)
        if hit is None:
            continue
        if not hit[1] or hit[0] in seen:
            gone.add(i)
        seen.add(hit[0])
    return "\n".join([x for i, x in enumerate(own) if i not in gone]), len(gone)


def deduplicate(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """All columns of ``docs``, ``text`` without lines met before, and ``n_removed long``.

    Lines are parted by line feeds. Two lines are near if they are equal, or within one edit
    for each ``per_edit`` characters of the shorter, ``edits`` at most; nearness is carried on
    through chains. Of each set of near lines the first stays: that of the smallest doc_id,
    there the uppermost; all others go, whatever document they are in. Blank lines stay. Null
    texts stay null, empty ones empty; no document is dropped, though one may lose all its
    lines. A document with a null doc_id is left as it is and does not count, nor do its lines
    link others; rows that repeat an id each keep their uppermost line. Very long texts and lines
    are read whole. An empty table gives no rows. Columns other than doc_id and text pass
    through, whatever their names; a column n_removed of the input is replaced.
    """
    held = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("n_removed")
    found = held.write(_decisions(docs, held, edits, per_edit), "found")
    held.drop("lines", "placed-lines", "near-1", "near-2")

    @F.arrow_udf("text string, n_removed long")
    def clean(text: pa.Array, found: pa.Array) -> pa.Array:
        rest, gone = [], []
        for part in slices(iter([pa.RecordBatch.from_arrays([text, found], ["text", "found"])]), "text", SLICE):
            h, g, component, own = (c.to_pylist() for c in part.column(1).flatten().flatten())
            at = 0
            for t, k in zip(part.column(0).to_pylist(), pa.compute.list_value_length(part.column(1)).to_pylist()):
                t, n = (t, 0) if t is None or not k else dedup_text(t, dict(zip(zip(h[at : at + k], g[at : at + k]), zip(component[at : at + k], own[at : at + k]))))
                at += k or 0
                rest.append(t)
                gone.append(n)
        return pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(gone, pa.int64())], names=["text", "n_removed"])

    doc, name, new = unused(docs, "found_in", "found_lines", "new_text")
    joined = docs.join(found.select(F.col("doc_id").alias(doc), F.col("found").alias(name)), F.col("doc_id") == F.col(doc), "left")
    cleaned = joined.withColumn(new, F.when(F.col(name).isNull(), F.struct("text", F.lit(0).cast("long").alias("n_removed"))).otherwise(clean("text", name)))
    return cleaned.select(*[F.col(f"{new}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col(f"{new}.n_removed").alias("n_removed"))


def digests(docs: DataFrame) -> DataFrame:
    """Per row: lines, removed lines and the digest of the text that is left (null text: of an empty one).

    Nulls, repeated rows and empty tables are as in ``deduplicate``; other columns are not read.
    """
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda x: F.length(x) > 0))
    out = deduplicate(docs.select("doc_id", "text").withColumn("n_lines", count(F.col("text")).cast("long")))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
