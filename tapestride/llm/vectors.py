"""Embedding near-duplicates by an exact metric range join.

Unit vectors with a cosine of at least c lie within sqrt(2 - 2c) of one another. Each vector
is at home in the cell of its nearest pivot. It visits an earlier cell unless the triangle
inequality (with the cell's largest and smallest distance from its pivot) or the distance to
the plane between the two pivots shows that nothing there is in reach. Cells are cut into
blocks of bounded size that are joined independently, each pair of blocks in a task of its
own; single precision screens, double precision decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean
from .graph import components, forest

#: Vectors of a block, about.
BLOCK = 4096
#: Pivots at most, and distinct vectors sampled for each.
PIVOTS, SAMPLED = 512, 8


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, raw, dim): doubles of vectors that can be compared; others have raw null."""

    def run(batches):
        for b in batches:
            out, dims = [], []
            for x in b.column(1):
                v = None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                good = v is not None and v.size and np.isfinite(v).all() and v.any()
                with np.errstate(over="ignore", under="ignore"):
                    if good and not 1e-200 < (v * v).sum() < 1e200:  # a power of two brings squares back in range
                        v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
                out.append(v.tobytes() if good else None)
                dims.append(v.size if good else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], ["id", "raw", "dim"])

    return df.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(lean(run), "id long, raw binary, dim int")


def choose(sample: np.ndarray, k: int) -> np.ndarray:
    """Pivots spread over the sample: each next one is the vector farthest from those before."""
    picked, far = [0], 2 - 2 * sample @ sample[0]
    while len(picked) < min(k, len(sample)) and far.max() > 1e-12:
        picked.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * sample @ sample[picked[-1]])
    return sample[picked]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))


def _task(left: np.ndarray, right: np.ndarray, lw: np.ndarray, rw: np.ndarray, li: np.ndarray, ri: np.ndarray, cosine: float, own: bool):
    """Weighted link counts of either side of two blocks and edges that join what is linked."""
    margin = 1e-5 + 1e-6 * left.shape[1]
    near = left.astype(np.float32) @ right.astype(np.float32).T >= np.float32(cosine - margin)
    if own:
        np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    keep = np.empty(a.size, bool)
    for at in range(0, a.size, 200_000):
        s = slice(at, at + 200_000)
        keep[s] = np.einsum("ij,ij->i", left[a[s]], right[b[s]]) >= cosine
    a, b = a[keep], b[keep]
    n_left = np.bincount(a, rw[b], len(li)).astype(np.int64)
    n_right = np.zeros(len(ri), np.int64) if own else np.bincount(b, lw[a], len(ri)).astype(np.int64)
    ids, root = forest(li[a], ri[b]) if a.size else (np.zeros(0, np.int64),) * 2
    return n_left, n_right, ids, root


def near_duplicates(df: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Two rows are linked if the cosine of their vectors, in doubles, is at least ``cosine``
    (above 0). Null, empty and zero vectors and those with null or non-finite parts link with
    nothing, nor do vectors of different lengths; very large and very small ones are scaled. Equal vectors are compared once and count
    as often as they come. A null id has a null component and is not kept; rows that repeat
    an id share the links of all of them. Other columns are not read. An empty table gives
    no rows.
    """
    spark = df.sparkSession
    held = Scratch(spark, "vectors")
    rows = held.write(_valid(df, id_col, vector_col), "rows")
    named = rows.where("raw is not null and id is not null")
    classes = held.write(named.groupBy("dim", "raw").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    edges = spark.createDataFrame([], "u long, v long")
    counts = spark.createDataFrame([], "id long, links long")
    for dim, n in sorted((r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        own = _range_join(classes.where(F.col("dim") == dim), held, dim, n, cosine, block, max(1, min(pivots, -(-n // block))))
        counts = counts.unionByName(own.where("v is null").select(F.col("u").alias("id"), "links"))
        edges = edges.unionByName(own.where("v is not null").select("u", "v"))
    links = counts.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(edges, held)
    known = classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("dim", "raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    found = rows.where("raw is not null").join(known, ["dim", "raw"], "left").select("id", "n_links", "component_id").unionByName(rows.where("raw is null").select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    out = found.select(F.col("id").alias(id_col), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _range_join(classes: DataFrame, held: Scratch, dim: int, n: int, cosine: float, block: int, k: int) -> DataFrame:
    """Rows (u, links) with v null, and edges (u, v), over the distinct vectors of one length."""
    spark, reach = held.spark, float(np.sqrt(2 - 2 * cosine)) + 1e-7
    sample = classes.select("raw").sample(min(1.0, 1.2 * SAMPLED * k / n), 11).limit(SAMPLED * k).collect() or classes.select("raw").limit(1).collect()
    pivot = choose(_units([bytes(r.raw) for r in sample], dim), k)
    between = _distances(pivot, pivot)
    shared = spark.sparkContext.broadcast(pivot)  # PIVOTS vectors at most

    def home(batches):
        p = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(_units(b.column(1).to_pylist(), dim), p)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["rep", "raw", "n", "cell", "r"])

    homes = held.write(classes.select("rep", "raw", "n").mapInArrow(lean(home), "rep long, raw binary, n long, cell int, r double"), f"homes-{dim}")
    stats = {r.cell: r for r in homes.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).collect()}  # a row a pivot
    low, high = (np.array([getattr(stats[c], x) if c in stats else np.nan for c in range(len(pivot))]) for x in ("low", "high"))

    def visits(d: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Which earlier cells each vector must visit."""
        own = d[np.arange(len(d)), cell][:, None]
        gap = between[cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (d * d - own * own) / (2 * gap), 0.0)
        ok = (plane <= reach) & (d - high <= reach) & (low - d <= reach)
        return ok & (np.arange(d.shape[1])[None, :] < cell[:, None])

    def count(batches):
        total = np.zeros(len(pivot), np.int64)
        for b in batches:
            if b.num_rows:
                total += visits(_distances(_units(b.column(1).to_pylist(), dim), shared.value), b.column(0).to_numpy()).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivot)), pa.int32()), pa.array(total)], ["cell", "n"])

    guests = {r.cell: r.n for r in homes.select("cell", "raw").mapInArrow(lean(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    own_blocks = np.array([-(-stats[c].n // block) if c in stats else 0 for c in range(len(pivot))])
    guest_blocks = np.array([-(-guests.get(c, 0) // block) for c in range(len(pivot))])

    def deal(batches):
        """Sends every row to the pairs of blocks it takes part in: side 0 left, 1 right, 2 both."""
        for b in batches:
            if not b.num_rows:
                continue
            cell, rep = b.column(3).to_numpy(), b.column(0).to_numpy()
            mixed = rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            who, where, left, right, side = [], [], [], [], []
            see = visits(_distances(_units(b.column(1).to_pylist(), dim), shared.value), cell)
            for i, c in enumerate(cell.tolist()):
                nb, ng = int(own_blocks[c]), int(guest_blocks[c])
                mine = int(mixed[i]) % nb
                todo = [(c, mine, mine, 2)] + [(c, mine, j, 0) for j in range(mine + 1, nb)] + [(c, j, mine, 1) for j in range(mine)] + [(c, mine, nb + g, 0) for g in range(ng)]
                for v in np.flatnonzero(see[i]).tolist():
                    g = int(own_blocks[v]) + int(mixed[i]) % int(guest_blocks[v])
                    todo += [(v, j, g, 1) for j in range(int(own_blocks[v]))]
                who += [i] * len(todo)
                for x in todo:
                    where.append(x[0]), left.append(x[1]), right.append(x[2]), side.append(x[3])
            at = pa.array(who, pa.int64())
            for s in range(0, len(who), 20_000):
                e = min(len(who), s + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(where[s:e], pa.int32()), pa.array(left[s:e], pa.int32()), pa.array(right[s:e], pa.int32()), pa.array(side[s:e], pa.int32()), *[b.column(c).take(at[s:e]) for c in (0, 1, 2)]], ["cell", "left", "right", "side", "rep", "raw", "n"])

    dealt = homes.mapInArrow(lean(deal), "cell int, left int, right int, side int, rep long, raw binary, n long")

    def join(table: pa.Table) -> pa.Table:
        side, rep, n = table["side"].to_numpy(), table["rep"].to_numpy(), table["n"].to_numpy().astype(np.float64)
        x = _units(table["raw"].to_pylist(), dim)
        own = bool((side == 2).any())
        a, b = (np.flatnonzero(side == 2),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        nl, nr, ids, root = _task(x[a], x[b], n[a], n[b], rep[a], rep[b], cosine, own)
        some, other = np.flatnonzero(nl), np.flatnonzero(nr)
        u = np.concatenate([rep[a][some], rep[b][other], ids])
        links = np.concatenate([nl[some], nr[other], np.zeros(ids.size, np.int64)])
        v = pa.concat_arrays([pa.nulls(some.size + other.size, pa.int64()), pa.array(root, pa.int64())])
        return pa.table({"u": pa.array(u, pa.int64()), "v": v, "links": pa.array(links, pa.int64())})

    out = held.write(dealt.groupBy("cell", "left", "right").applyInArrow(join, "u long, v long, links long"), f"links-{dim}")
    held.drop(f"homes-{dim}")
    return out
