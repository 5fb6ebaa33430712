"""Neighbourhoods of the page graph and random walks with restart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL = "\0null"
LOOP, DAMPING, EPSILON, ROUNDS = 0.01, 0.85, 1e-8, 6


def outgoing(edges: DataFrame) -> DataFrame:
    """(entity, out): targets with their probabilities, in the order of their names."""
    return edges.groupBy(F.col("from").alias("entity")).agg(F.sort_array(F.collect_list(F.struct(F.col("to").alias("entity"), "prob"))).alias("out"))


def incoming(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("to").alias("entity")).agg(F.sort_array(F.collect_list(F.struct(F.col("from").alias("entity"), "prob"))).alias("in"))


def full_neighbours(edges: DataFrame) -> DataFrame:
    """(entity, in, out) of entities that have both."""
    return incoming(edges).join(outgoing(edges), "entity")


def reciprocal(edges: DataFrame) -> DataFrame:
    """Edges whose reverse exists, and from each of their ends what is missing to 1, to and from a null node.

    Rows (from, to, prob, side): "out" as seen from ``from``, "in" as seen from ``to``.
    """
    back = edges.select(F.col("from").alias("to"), F.col("to").alias("from"))
    kept = edges.join(back, ["from", "to"], "left_semi").select("from", "to", "prob")
    out = kept.withColumn("side", F.lit("out"))
    in_ = kept.withColumn("side", F.lit("in"))
    rest_out = kept.groupBy("from").agg((1 - F.sum("prob")).alias("prob")).select("from", F.lit("null").alias("to"), "prob", F.lit("out").alias("side"))
    rest_in = kept.groupBy("to").agg((1 - F.sum("prob")).alias("prob")).select(F.lit("null").alias("from"), "to", "prob", F.lit("in").alias("side"))
    return out.unionByName(in_).unionByName(rest_out).unionByName(rest_in)


def reachable(edges: DataFrame, seeds: DataFrame, cut) -> DataFrame:
    """Nodes that seeds (column ``node``) reach over edges, themselves included.

    Each round extends the frontier by an equi-join; ``cut`` materialises a frontier and cuts its lineage.
    """
    seen = cut(seeds.select("node").distinct())
    frontier = seen
    while True:
        nxt = frontier.join(edges, frontier.node == edges["from"]).select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(nxt)
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def walk(edges: DataFrame, seeds: DataFrame, rounds: int, cut, damping: float = DAMPING) -> DataFrame:
    """(node, p) after so many rounds of p = damping * p * M + (1 - damping) * s over edges (from, to, w).

    Start and restart are uniform over ``seeds`` (column ``node``). Rows of M need not sum to 1.
    """
    n = seeds.count()
    start = seeds.select("node", F.lit(1.0 / n).alias("s"))
    p = start.select("node", F.col("s").alias("p"))
    for _ in range(rounds):
        moved = p.join(edges, p.node == edges["from"]).groupBy(F.col("to").alias("node")).agg(F.sum(F.col("p") * F.col("w")).alias("m"))
        p = cut(moved.join(start, "node", "full").select("node", (damping * F.coalesce("m", F.lit(0.0)) + (1 - damping) * F.coalesce("s", F.lit(0.0))).alias("p")))
    return p


def random_walk(matrix: np.ndarray, restart: np.ndarray, most: int, start: np.ndarray | None = None) -> np.ndarray:
    """Rounds of the walk over a matrix until ``most`` or until a round moves less than EPSILON in all."""
    p = restart if start is None else start
    for _ in range(most):
        new = DAMPING * (p @ matrix) + (1 - DAMPING) * restart
        if np.abs(new - p).sum() <= EPSILON:
            return new
        p = new
    return p


def prune(rows: list[dict]) -> list[dict]:
    """Rows whose entity a seed reaches, without neighbours that none reaches."""
    edges: dict[str, set[str]] = {}
    for r in rows:
        edges.setdefault(r["entity"], set()).update(e for e, _ in r["out"])
        for e, _ in r["in"]:
            edges.setdefault(e, set()).add(r["entity"])
    seen, todo = set(), [r["entity"] for r in rows if r["type"] == "SEED"]
    while todo:
        e = todo.pop()
        if e not in seen:
            seen.add(e)
            todo += edges.get(e, ())
    return [r | {k: [x for x in r[k] if x[0] in seen] for k in ("in", "out")} for r in rows if r["entity"] in seen]


def build_graph(rows: list[dict]) -> tuple[dict[str, str], dict[tuple[str, str], float]]:
    """Node types and edge weights of one document's graph, with null node and self-loops.

    ``rows`` has one row per entity. What no seed reaches goes; neighbours without way out are
    merged into the null node, the others send it what is missing to 1.
    """
    kind = {r["entity"]: r["type"] for r in rows}
    weight: dict[tuple[str, str], float] = {}
    for r in rows:
        weight.update({(r["entity"], e): p for e, p in r["out"]})
        weight.update({(e, r["entity"]): p for e, p in r["in"]})
    out: dict[str, set[str]] = {}
    for a, b in weight:
        out.setdefault(a, set()).add(b)
        kind.setdefault(a, "NEIGHBOUR"), kind.setdefault(b, "NEIGHBOUR")
    seen, todo = set(), [e for e, k in kind.items() if k == "SEED"]
    while todo:
        e = todo.pop()
        if e not in seen:
            seen.add(e)
            todo += out.get(e, ())
    kind = {e: k for e, k in kind.items() if e in seen}
    weight = {(a, b): w for (a, b), w in weight.items() if a in seen and b in seen}
    sinks = {e for e in kind if not out.get(e)}
    kind[NULL] = "NULL"
    for (a, b), w in list(weight.items()):
        if b in sinks and kind[b] == "NEIGHBOUR":
            weight[(a, NULL)] = weight.get((a, NULL), 0.0) + w
            del weight[(a, b)]
    for e in [e for e in sinks if kind[e] == "NEIGHBOUR"]:
        del kind[e]
    total: dict[str, float] = {}
    for (a, _), w in weight.items():
        total[a] = total.get(a, 0.0) + w
    for e, k in kind.items():
        if k == "NEIGHBOUR":
            weight[(e, NULL)] = weight.get((e, NULL), 0.0) + 1 - total.get(e, 0.0)
    for e in kind:
        weight[(e, e)] = weight.get((e, e), 0.0) + LOOP + (1.0 if e == NULL or e in sinks else 0.0) * ((e, e) not in weight)
    return kind, weight


def resolve(rows: list[dict]) -> list[tuple[str, str]]:
    """(hit, entity) of one document: seeds, then the likeliest candidates one by one.

    Rows have entity, type, hit, in and out. In each round the walk from all seeds is run; the
    candidate with the largest probability (of equals the first by name) becomes a seed, and
    other candidates of its hits go. It ends when no candidate is left or reached.
    """
    rows = prune(rows)
    done = [(r["hit"], r["entity"]) for r in rows if r["type"] == "SEED"]
    taken = {h for h, _ in done}
    rows = [r for r in rows if r["type"] == "SEED" or r["hit"] not in taken]
    last: dict[str, float] = {}
    while any(r["type"] == "CANDIDATE" for r in rows):
        one: dict[str, dict] = {}
        for r in sorted(rows, key=lambda r: r["type"] != "SEED"):
            one.setdefault(r["entity"], r)
        kind, weight = build_graph(list(one.values()))
        names = sorted(kind)
        at = {e: i for i, e in enumerate(names)}
        matrix = np.zeros((len(names), len(names)))
        for (a, b), w in weight.items():
            matrix[at[a], at[b]] = w / (1 + LOOP)
        restart = np.array([float(kind[e] == "SEED") for e in names])
        if not restart.any():
            break
        restart /= restart.sum()
        start = np.array([last.get(e, 0.0) for e in names])
        p = random_walk(matrix, restart, ROUNDS, start / start.sum() if start.sum() > 0 else restart)
        last = dict(zip(names, p))
        open_ = [e for e in names if kind[e] == "CANDIDATE"]
        if not open_:
            break
        best = max(open_, key=lambda e: (last[e], [-ord(c) for c in e]))
        won = [r for r in rows if r["entity"] == best]
        done += [(r["hit"], best) for r in won if r["type"] == "CANDIDATE"]
        taken |= {r["hit"] for r in won}
        rows = [r | {"type": "SEED"} if r["entity"] == best else r for r in rows]
        rows = [r for r in rows if r["type"] == "SEED" or r["hit"] not in taken]
    return list(dict.fromkeys(done))


def resolve_documents(rows: DataFrame) -> DataFrame:
    """(doc_id, hit, entity) for rows (doc_id, entity, type, hit, in, out); a document's rows are one group."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(own: pd.DataFrame) -> pd.DataFrame:
        flat = [{"entity": r.entity, "type": r.type, "hit": r.hit, "in": [(x["entity"], x["prob"]) for x in (r.inn if r.inn is not None else [])], "out": [(x["entity"], x["prob"]) for x in (r.out if r.out is not None else [])]} for r in own.sort_values(["entity", "hit"]).itertuples()]
        return pd.DataFrame([(own.doc_id.iloc[0], h, e) for h, e in resolve(flat)], columns=["doc_id", "hit", "entity"])

    return rows.select("doc_id", "entity", "type", "hit", F.col("in").alias("inn"), "out").groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, hit string, entity string")
