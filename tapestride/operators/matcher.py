"""Dictionary matching: which runs of a text's tokens are entries of a dictionary.

A dictionary that was measured to be small becomes a trie of word numbers that every executor
holds; Arrow batches of tokens walk it a token at a time for all starts at once, so that only
matches become rows. A larger one meets the runs up to the longest entry in an equi-join; starts
whose token begins no entry are dropped before runs are formed. Empty tokens inside a run count
for its length and leave its surface; tokens hold no blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .links import first_rank, is_small, small

#: Tokens that are walked at a time, or those of one text.
CHUNK = 1 << 20


class Trie:
    """Entries as sorted edges (node, word) of numbered words; the root is node 0."""

    def __init__(self, entries: pa.Table, longest_entry: int):
        self.surface, self.prob = (entries.column(c).combine_chunks() for c in ("surface", "prob"))
        self.longest = longest_entry
        words: dict[str, int] = {}
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, surface in enumerate(self.surface.to_pylist()):
            run = (surface or "").split(" ")
            if len(run) <= longest_entry and "" not in run:
                node = 0
                for w in run:
                    node = edges.setdefault((node, words.setdefault(w, len(words))), len(edges) + 1)
                ends[node] = i
        self.words, self.n = pa.array(list(words), pa.string()), len(words)
        keys = np.array([a * max(self.n, 1) + w for a, w in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.entry = np.full(len(edges) + 1, -1, np.int64)
        self.entry[list(ends)] = list(ends.values())
        # Children of the root by word; the two places beyond are those of empty and of unknown tokens.
        self.head = np.zeros(self.n + 2, np.int64)
        top = self.keys < self.n
        self.head[self.keys[top]] = self.child[top]

    def step(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The child by each word, or 0."""
        key = node * self.n + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((word >= 0) & (word < self.n) & (self.keys[at] == key), self.child[at], 0)

    def walk(self, tokens: pa.Array, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, entry) of all matches; ``end`` is where each token's text ends."""
        word = pc.fill_null(pc.index_in(tokens, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word[pc.fill_null(pc.equal(tokens, ""), True).to_numpy(zero_copy_only=False)] = self.n
        at = np.flatnonzero(self.head[word])
        node, found = self.head[word[at]], []
        for length in range(1, self.longest + 1):
            here = np.ones(len(at), bool)
            if length > 1:
                inside = at + (length - 1) < end[at]
                at, node = at[inside], node[inside]
                w = word[at + (length - 1)]
                here = w != self.n
                node = np.where(here, self.step(node, w), node)
                at, node, here = at[node > 0], node[node > 0], here[node > 0]
            hit = here & (self.entry[node] >= 0)
            found.append((at[hit], np.full(int(hit.sum()), length), self.entry[node[hit]]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > CHUNK:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _matched(texts: DataFrame, entries: DataFrame, longest_entry: int, every: bool, longest: bool, spread: int | None = None) -> DataFrame:
    """Matches by the trie, reduced within each row of ``texts``; with ``spread`` also their contexts (``text.context``)."""
    trie = Trie(entries.select("surface", "prob").toArrow(), longest_entry)
    size = 2 * spread + 1 if spread is not None else 0

    def run(batches):
        for batch in _chunks(batches):
            tokens = batch.column(1).flatten()
            n = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            at, length, entry = trie.walk(tokens, np.repeat(ends, n))
            row = np.searchsorted(ends, at, side="right")
            if longest:
                best = np.zeros(len(tokens), np.int64)
                np.maximum.at(best, at, length)
                keep = np.flatnonzero(best[at] == length)
                at, length, entry, row = at[keep], length[keep], entry[keep], row[keep]
            if not (every or longest):  # texts that share a doc_id may still change what is longest
                key = row * len(trie.surface) + entry
                order = np.lexsort((length, at, key))
                key = key[order]
                keep = order[np.append(True, key[1:] != key[:-1])[: len(key)]]
                at, length, entry, row = at[keep], length[keep], entry[keep], row[keep]
            begin = ends[row] - n[row]
            out = [batch.column(0).take(pa.array(row)), trie.surface.take(pa.array(entry)), trie.prob.take(pa.array(entry)), pa.array(at - begin), pa.array(length, pa.int64())]
            names = ["doc_id", "surface", "prob", "start", "length"]
            if size:
                full = n[row] >= size
                first = begin + np.minimum(np.maximum(at - begin - spread, 0), n[row] - size)
                places = (first[full][:, None] + np.arange(size)).ravel()
                offsets = np.append(0, np.cumsum(np.where(full, size, 0))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), tokens.take(pa.array(places)), mask=pa.array(~full)))
                names.append("context")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((texts, "doc_id"), (entries, "prob"))}
    schema = f"doc_id {kind['doc_id']}, surface string, prob {kind['prob']}, start long, length long"
    return texts.select("doc_id", "tokens").mapInArrow(run, schema + ", context array<string>" * bool(size))


def dictionary(entries: DataFrame) -> DataFrame:
    """Unique (surface, prob); of entries given twice the largest prob stays. Surfaces that start blank match nothing."""
    return entries.where("surface <> '' and surface not like ' %'").groupBy("surface").agg(F.max("prob").alias("prob"))


def hits(texts: DataFrame, entries: DataFrame, longest_entry: int, every: bool = False, longest: bool = False) -> DataFrame:
    """(doc_id, surface, prob, start, length) of matches in ``tokens`` (array<string>).

    All overlapping matches from every start; ``every`` keeps each occurrence, else a document
    has a surface once, where it first occurs; ``longest`` keeps the longest from a start. The
    dictionary is measured, so it should be a written table of distinct surfaces; up to
    ``links.SMALL`` bytes of it are sent to all executors, and tokens are shuffled only beyond
    that. Rows of ``texts`` that share a doc_id are one document.
    """
    found = _matched(texts, entries, longest_entry, every, longest) if is_small(entries, "surface") else _joined(texts, entries, longest_entry)
    if longest:
        found = first_rank(found, ["doc_id", "start"], [F.desc("length")])
    if every:
        return found
    # Start and length as one number, so that the first occurrence is a partially aggregated minimum.
    place = F.min(F.col("start") * (1 << 16) + F.col("length"))
    first = found.groupBy("doc_id", "surface").agg(F.first("prob").alias("prob"), place.alias("place"))
    return first.select("doc_id", "surface", "prob", F.shiftright("place", 16).alias("start"), F.col("place").bitwiseAND(F.lit((1 << 16) - 1)).alias("length"))


def windows(texts: DataFrame, entries: DataFrame, longest_entry: int, spread: int = 25, distinct: bool = False) -> DataFrame:
    """First hits with their ``context`` (``text.context``), without documents whose doc_id is null.

    ``distinct`` says that no doc_id is given twice: contexts are then cut where a text is matched,
    and nothing is shuffled. Else each text of a doc_id gives a context to each of its hits.
    """
    if distinct and is_small(entries, "surface"):
        return _matched(texts.where("doc_id is not null"), entries, longest_entry, False, False, spread)
    # A document's hits come to its tokens as one row, so that tokens are not copied for each hit.
    per_doc = hits(texts, entries, longest_entry).groupBy("doc_id").agg(F.collect_list(F.struct("surface", "prob", "start", "length")).alias("found"))
    at = F.transform("found", lambda h: F.struct(h.surface.alias("surface"), h.prob.alias("prob"), h.start.alias("start"), h.length.alias("length"), tx.context(F.col("tokens"), h.start, spread).alias("context")))
    return per_doc.join(texts, "doc_id").select("doc_id", F.inline(at))


def _joined(texts: DataFrame, entries: DataFrame, longest_entry: int) -> DataFrame:
    """All matches by joins, for dictionaries of any size."""
    heads = small(entries.select(F.split("surface", " ")[0].alias("head")).distinct(), "head")
    # A start carries the few tokens an entry may have, never the whole text.
    runs = F.transform("tokens", lambda w, i: F.struct(i.cast("long").alias("start"), w.alias("head"), F.slice("tokens", i + 1, F.lit(longest_entry)).alias("run")))
    starts = texts.select("doc_id", F.inline(runs)).where("head <> ''").join(heads, "head", "left_semi")
    spans = starts.select("doc_id", "start", "run", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("length"))
    run = F.slice("run", F.lit(1), F.col("length"))
    spans = spans.where(F.element_at("run", F.col("length")) != "").select("doc_id", "start", F.col("length").cast("long").alias("length"), F.array_join(F.filter(run, lambda w: w != ""), " ").alias("surface"))
    return spans.join(entries, "surface").select("doc_id", "surface", "prob", "start", "length")


def contains(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Per probe surface: whether it is an entry, whether it starts a longer one, and its prob."""
    words = F.split("surface", " ")
    prefixes = entries.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("n"), "w").select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("surface")).distinct().withColumn("is_prefix", F.lit(True))
    return probes.join(entries, "surface", "left").join(prefixes, "surface", "left").select("surface", F.col("prob").isNotNull().alias("is_entry"), F.coalesce("is_prefix", F.lit(False)).alias("is_prefix"), "prob")


def prefix_statistics(entries: DataFrame) -> DataFrame:
    """Distinct prefixes of entries by their number of tokens: the edges of a trie by level."""
    words = entries.select(F.split("surface", " ").alias("w"))
    return words.select(F.explode(F.sequence(F.lit(1), F.size("w"))).alias("level"), "w").select(F.col("level").cast("long").alias("level"), F.array_join(F.slice("w", F.lit(1), F.col("level")), " ").alias("p")).distinct().groupBy("level").agg(F.count("*").alias("n_edges"))
