"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens of labelled documents are tagged from the documents' labels (a word, or the start of
a word, that toxic documents have and clean ones lack), the field is trained on those tags by
gradient ascent on its likelihood, and forward-backward marginals over whole texts give the
offending spans and, through a logistic curve, a score for the document.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import lean, slices

#: Labelled documents, clean and toxic, from which the model is fitted, at most.
SAMPLE = (2500, 1000)
BUCKETS = 1 << 18
#: Words kept with their potentials within a task.
CACHE = 200_000
_EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’¿¡…-–—*_/\\"


def features(token: str) -> list[int]:
    """Hashed features of a token: the bare word, its first 3 to 6 characters, its last 3 and its shape."""
    w = token.strip(_EDGE).lower()
    named = [f"w{w}", *[f"p{n}{w[:n]}" for n in (3, 4, 5, 6) if len(w) >= n], f"s{w[-3:]}", "d" if any(c.isdigit() for c in w) else "b"]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in named]


class Field:
    """Weights of the field: those of features for state 1 against 0, and the four transitions."""

    def __init__(self):
        self.weights, self.transitions = np.zeros(BUCKETS), np.zeros((2, 2))
        self.curve = np.array([0.0, 0.0, 0.0])
        self.known: dict[str, float] = {}

    def __getstate__(self):
        used = np.flatnonzero(self.weights)
        return used.astype(np.int32), self.weights[used].astype(np.float32), self.transitions, self.curve

    def __setstate__(self, state):
        self.__init__()
        self.weights[state[0]], self.transitions, self.curve = state[1], state[2], state[3]

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Log potentials of state 1, one per token; those of words met before are remembered."""
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        got = list(map(known.get, tokens))
        if None in got:
            weights = self.weights
            for i, x in enumerate(got):
                if x is None:
                    t = tokens[i]
                    if t not in known:
                        known[t] = float(weights[features(t)].sum())
                    got[i] = known[t]
        return np.array(got, np.float64)

    def marginals(self, emissions: list[np.ndarray], expected: np.ndarray | None = None) -> list[np.ndarray]:
        """Probability of state 1 at each token of every sequence, by forward-backward over odds.

        Sequences are stepped side by side, longest first, so that a step is a few NumPy calls.
        The expected number of each of the four transitions is added to ``expected``, if given.
        """
        out = [np.zeros(0)] * len(emissions)
        order = sorted((i for i, e in enumerate(emissions) if e.size), key=lambda i: -emissions[i].size)
        if not order:
            return out
        lengths = np.array([emissions[i].size for i in order])
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences that reach step t
        starts = np.concatenate([[0], np.cumsum(alive)])
        ranks = np.repeat(np.arange(len(order)), lengths)
        steps = np.arange(ranks.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = starts[steps] + ranks  # time-major place of each token
        e = np.empty(ranks.size)
        e[place] = np.exp(np.clip(np.concatenate([emissions[i] for i in order]), -30, 30))
        (c00, c01), (c10, c11) = np.exp(self.transitions)
        forward, backward = np.empty_like(e), np.ones_like(e)
        r = forward[: alive[0]]
        r[:] = e[: alive[0]]
        for t in range(1, lengths[0]):
            k, a = alive[t], starts[t]
            r = r[:k]
            now = forward[a : a + k]
            np.divide(c01 + c11 * r, c00 + c10 * r, out=now)
            now *= e[a : a + k]
            r = now
        for t in range(lengths[0] - 2, -1, -1):
            k, a = alive[t + 1], starts[t]
            b = e[starts[t + 1] : starts[t + 1] + k] * backward[starts[t + 1] : starts[t + 1] + k]
            np.divide(c10 + c11 * b, c00 + c01 * b, out=backward[a : a + k])
        if expected is not None:
            before = np.repeat(alive[:-1], alive[1:])  # how far back the token before a token lies
            for at in range(0, before.size, 1 << 18):
                back = before[at : at + (1 << 18)]
                now = np.arange(at, at + back.size) + alive[0]
                f, b = forward[now - back], e[now] * backward[now]
                part = np.stack([np.full(now.size, c00), c01 * b, c10 * f, c11 * f * b])
                expected += (part / part.sum(0)).sum(1).reshape(2, 2)
        odds = forward * backward
        p = (odds / (1 + odds))[place]
        ends = np.cumsum(lengths)
        for i, a, b in zip(order, ends - lengths, ends):
            out[i] = p[a:b]
        return out

    def signals(self, marginals: list[np.ndarray]) -> np.ndarray:
        """Per document: the largest marginal and the logarithm of their sum over a half; zeros for an empty one."""
        top = np.array([m.max() if m.size else 0.0 for m in marginals])
        mass = np.array([m[m >= 0.5].sum() if m.size else 0.0 for m in marginals])
        return np.stack([np.ones(len(marginals)), top, np.log1p(mass)], 1) if marginals else np.zeros((0, 3))

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.signals(marginals) @ self.curve, -30, 30)))


def copies(docs: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """A group number for each document (of word numbers): near copies with one label share it."""
    group = np.arange(len(docs))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    met: dict[tuple, int] = {}
    odd = np.random.default_rng(3).integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
    for i, (d, y) in enumerate(zip(docs, labels)):
        h = d.astype(np.uint64) + np.uint64(1)
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xD6E8FEB86659FD93) if h.size > 1 else h
        h = np.unique((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9))
        if not h.size:
            continue
        least = [int((h * o >> np.uint64(32)).min()) for o in odd]
        for k in range(0, 16, 4):  # four minhashes of word pairs together, so that only near copies meet
            a, b = root(met.setdefault((k, y, *least[k : k + 4]), i)), root(i)
            group[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(docs))])


def tag_words(vocab: list[str], docs: list[np.ndarray], labels: list[int], ratio: float = 25.0, chance: float = 1.0) -> np.ndarray:
    """Which words are toxic by the documents' labels (near copies taken as one).

    A cue is a word or a start of 4 to 6 characters of one. It is toxic if its share of toxic
    documents is ``ratio`` times that of clean ones (half a document is added to the latter)
    and if so uneven a split is expected, by Chernoff's bound, of at most ``chance`` of all cues.
    """
    hashed, owner = array("Q"), array("i")  # a cue is its 64-bit hash; a dictionary of strings would be the driver's peak
    for i, t in enumerate(vocab):
        w = t.strip(_EDGE).lower()
        for c in (w, *[f"{w[:n]}\0" for n in (4, 5, 6) if len(w) > n]) if w else ():
            hashed.append(xxh3_64_intdigest(c.encode("utf-8", "replace")))
            owner.append(i)
    cues, flat = np.unique(np.frombuffer(hashed, np.uint64), return_inverse=True)
    flat, owner, n_cues = flat.astype(np.int32), np.frombuffer(owner, np.int32), cues.size
    del cues, hashed
    starts = np.searchsorted(owner, np.arange(len(vocab) + 1))
    seen = np.zeros((2, n_cues), np.int64)
    group, label = copies(docs, labels), np.array(labels)
    order = np.argsort(group, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
    for part in parts:  # near copies count once
        words, y = np.unique(np.concatenate([docs[i] for i in part])), label[part[0]]
        own = np.concatenate([flat[starts[w] : starts[w + 1]] for w in words]) if words.size else flat[:0]
        seen[y, np.unique(own)] += 1
    n = [max(1, sum(label[part[0]] == y for part in parts)) for y in (0, 1)]
    both = np.maximum(1, seen.sum(0))
    share, usual = seen[1] / both, n[1] / (n[0] + n[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        odd = both * (np.where(share > 0, share * np.log(share / usual), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - usual)), 0))
    toxic = (odd >= np.log(max(1, n_cues) / chance)) & (seen[1] / n[1] >= ratio * (seen[0] + 0.5) / n[0])
    return np.bincount(owner, toxic[flat], len(vocab)) > 0


def fit(texts: list[str], labels: list[int], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """Trains the field on tags derived from labelled texts, then the curve from marginals to score.

    Without both labels, or without texts, every score is the share of label 1.
    """
    field = Field()
    if len(set(labels)) < 2:
        share = min(max(float(np.mean(labels)) if labels else 0.0, 1e-6), 1 - 1e-6)
        field.curve = np.array([np.log(share / (1 - share)), 0.0, 0.0])
        return field
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(t, len(index)) for t in text.split()], np.int32) for text in texts]
    vocab = list(index)
    del index
    words = tag_words(vocab, ids, labels)
    listed, count = array("i"), array("i")
    for t in vocab:
        own = features(t)
        listed.extend(own)
        count.append(len(own))
    flat, owner = np.array(listed, np.int32), np.repeat(np.arange(len(count), dtype=np.int32), count)
    del listed, count
    where = np.concatenate(ids)
    y = np.concatenate([words[i] & bool(label) for i, label in zip(ids, labels)]).astype(np.float64)
    ends = np.cumsum([len(i) for i in ids])
    inner = np.ones(where.size, bool)
    inner[[0, *[e for e in ends[:-1] if e < where.size]]] = False  # tokens that follow another
    pair = np.flatnonzero(inner)
    seen_t = np.bincount((2 * y[pair - 1] + y[pair]).astype(np.int64), minlength=4).reshape(2, 2)
    square, square_t = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        e = np.bincount(owner, field.weights[flat], len(vocab))
        expected = np.zeros((2, 2))
        p = np.concatenate(field.marginals([e[i] for i in ids], expected))
        push = np.bincount(where, y - p, len(vocab)) / max(1.0, y.sum())
        grad = np.bincount(flat, push[owner], BUCKETS) - ridge * field.weights
        grad_t = (seen_t - expected) / max(1.0, y.sum()) - ridge * field.transitions
        square, square_t = square + grad**2, square_t + grad_t**2
        field.weights += rate * grad / np.sqrt(square)
        field.transitions += 0.2 * rate * grad_t / np.sqrt(square_t)
    e = np.bincount(owner, field.weights[flat], len(vocab))
    x, target = field.signals(field.marginals([e[i] for i in ids])), np.array(labels, np.float64)
    for _ in range(200):  # Newton steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ field.curve, -30, 30)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + np.eye(3) * 0.05
        step = np.linalg.solve(hessian, x.T @ (target - q) - 0.05 * field.curve)
        field.curve = field.curve + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return field


def remainder(doc_id) -> F.Column:
    """crc32 of a document id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(documents: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Field:
    """Fits the field on labelled rows outside the held-out third, at most ``sample`` clean and toxic ones.

    Rows are taken in the order of a hash of their id, so the sample is the same at every run.
    Their texts are read whole, as those that are scored.
    Null labels, null ids and null texts are left out; of a repeated id each row counts, but
    there are never more rows than the sample has in all.
    """
    use = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 1)).select("doc_id", F.col("toxic").alias("y"))
    picked = [use.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y]) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    # A few thousand ids of 16 bytes each, as the sample is bounded.
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.col("text").alias("t")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("t"), "y").limit(sum(sample)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.t))
    return fit([r.t for r in rows], [int(r.y) for r in rows])


def score(df: DataFrame, field: Field, threshold: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, spans``.

    ``spans`` holds (start, end, p) in characters of every token that is toxic with a marginal
    of a half or more. Null and empty texts have no tokens, no spans and the score of a text
    without toxic tokens. A null doc_id is not held out. Only ``doc_id`` and ``text`` are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        own = shared.value
        for big in slices(batches, "text", 32 << 20):
            emissions = []
            for part in slices(iter([big]), "text"):
                emissions += [own.emissions((t or "").split()) for t in part.column(1).to_pylist()]
            p = own.marginals(emissions)
            spans, column = [], big.column(1)
            for i, m in enumerate(p):
                hits = np.flatnonzero(m >= 0.5)
                found = []
                if hits.size:
                    text, at, wanted = column[i].as_py(), 0, set(hits.tolist())
                    for k, token in enumerate(text.split()):
                        at = text.index(token, at)
                        if k in wanted:
                            found.append({"start": at, "end": at + len(token), "p": float(m[k])})
                        at += len(token)
                spans.append(found)
            yield pa.RecordBatch.from_arrays([big.column(0), pa.array(own.score(p), pa.float64()), pa.array(spans, span)], ["doc_id", "score", "spans"])
        own.known.clear()

    scored = df.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def reject(df: DataFrame, field: Field, threshold: float = 0.7) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text scores below ``threshold``.

    Null and empty texts score as texts without toxic tokens; very long ones are scored whole.
    Rows that repeat go or stay together, ids are not looked at, and an empty table gives no
    rows. No row is moved or shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            out = [np.zeros(0)]
            for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", 4 << 20):
                out.append(own.score(own.marginals([own.emissions((t.as_py() or "").split()) for t in part.column(0)])))
            yield pa.array(np.concatenate(out))
        own.known.clear()

    return df.where(scored("text") < threshold)
