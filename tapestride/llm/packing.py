"""Best-fit packing of token pieces by exact complements.

Pieces are packed by their lengths alone, so the plan is made on the histogram of lengths,
which has at most ``capacity`` entries however many documents there are. A length's gap to
the capacity is looked up among single lengths, sums of two and sums of three; a combination
that fills it exactly is taken as often as the counts allow. What is left is packed best fit,
longest first. The plan, a table of runs of ranks within a length, is then applied to the
pieces, whose rank within their length comes from counts per input partition.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoded_batches
from .common import Scratch, lean

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first have the whole capacity."""
    head = n % capacity or capacity
    return [(0, min(n, head)), *[(s, capacity) for s in range(head, n, capacity)]]


class _Lengths:
    """Counts of the lengths still unpacked."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, k in counts.items():
            self.n[length] = k

    def times(self, lengths: list[int]) -> int:
        return min(int(self.n[x]) // k for x, k in Counter(lengths).items())

    def take(self, lengths: list[int]) -> int:
        m = self.times(lengths)
        for x in lengths:
            self.n[x] -= m
        return m

    def exact(self, gap: int, used: list[int]) -> list[int] | None:
        """One, two or three lengths that sum to the gap, the longest first; None if there are none."""
        if gap <= 0:
            return None
        left = self.n.copy()
        for x in used:
            left[x] -= 1
        if left[gap] > 0:
            return [gap]
        pair = self._pair(left, gap)
        if pair:
            return pair
        for a in np.flatnonzero(left[1:gap] > 0)[::-1] + 1:
            left[a] -= 1
            pair = self._pair(left, gap - int(a), int(a))
            left[a] += 1
            if pair:
                return [int(a), *pair]
        return None

    @staticmethod
    def _pair(left: np.ndarray, total: int, most: int | None = None) -> list[int] | None:
        small = np.arange(1, total // 2 + 1)
        if not small.size:
            return None
        large = total - small
        ok = (left[small] > 0) & (left[large] > 0) & ((small != large) | (left[small] > 1))
        if most is not None:
            ok &= large <= most
        at = np.flatnonzero(ok)
        return [int(large[at[0]]), int(small[at[0]])] if at.size else None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths side by side) and how many sequences have each; all pieces are used.

    Where exact combinations use up the short lengths that others lack in the end, plain best fit
    needs fewer sequences; the smaller of both plans is taken. Each pattern uses up at least one
    length or all but one of it, so there are a few thousand patterns at most for a capacity of
    1024, whatever the counts.
    """
    return min((_plan(counts, capacity, exact) for exact in (True, False)), key=lambda p: sum(m for _, m in p))


def _plan(counts: dict[int, int], capacity: int, exact: bool) -> list[tuple[list[int], int]]:
    left, out = _Lengths(counts, capacity), []
    for length in range(capacity, 0, -1) if exact else ():
        while left.n[length]:
            rest = left.exact(capacity - length, [length]) if length < capacity else []
            if rest is None:
                break
            out.append(([length, *rest], left.take([length, *rest])))
    for length in range(capacity, 0, -1):
        while left.n[length]:
            own = [length]
            while (gap := capacity - sum(own)) > 0:
                end = left.exact(gap, own) if exact else None
                if end:
                    own += end
                    break
                free = left.n.copy()
                for x in own:
                    free[x] -= 1
                fits = np.flatnonzero(free[1 : gap + 1] > 0)
                if not fits.size:
                    break
                own.append(int(fits[-1]) + 1)
            out.append((own, left.take(own)))
    return out


def runs(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the plan by length and rank."""
    rows, rank, base = [], Counter(), 0
    for lengths, m in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, rank[x], base, offset))
            rank[x] += m
            offset += x
        base += m
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(df: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of whole texts with their partition and rank within partition and length."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), Counter()
        tail = int(end_id).to_bytes(4, "little")
        for batch, _, ids in encoded_batches(batches, path, "text"):
            rows = []
            for doc, x in zip(batch.column(0).to_pylist(), ids):
                x += tail
                for k, (start, n) in enumerate(cut(len(x) // 4, capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(x[4 * start : 4 * (start + n)]), part, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list(names))

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), f"{PIECE}, part int, rank long")


def pack(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Packs all documents; one row per piece with its sequence and place there.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they
    come. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    spark = df.sparkSession
    held = Scratch(spark, "pack")
    cut_up = held.write(pieces(df, path, capacity, end_id), "pieces")
    by_part = held.write(cut_up.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = runs(plan(counts, capacity))
    key = table[:, 0] << 40 | table[:, 1]
    spread = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.withColumn("before", F.coalesce(F.sum("n").over(spread), F.lit(0))).drop("n")
    # The counts grow with the partitions, so they are merged, not broadcast.
    ranked = cut_up.join(first.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    shared = spark.sparkContext.broadcast((table, key))

    def place(batches):
        own, keys = shared.value
        for b in batches:
            length, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            at = own[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), f"{PIECE}, sequence_id long, offset long")
