"""Corpus operators against brute force, round trips, SQL and held-out labels; odd inputs for each."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tapestride.llm import bpe, entry, graph, lines, media, minhash, packing, suffixes, toxicity, urlfilter, vectors, warc
from tapestride.llm.common import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_removed long, component_id string, key string, part string, score string"
WORDS = [a + b for a in "ka lo mi ne ru ta vo su".split() for b in "n r s t lm nd".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple]:
    """Nulls, empty and blank texts, one very long text, exact and near copies, shared passages, repeated rows."""
    rng = random.Random(7)
    base = [prose(rng, 90) for _ in range(12)]
    near = [" ".join(w if i % 40 else "zz" for i, w in enumerate(b.split())) for b in base[:4]]
    passage = prose(rng, 60)
    spliced = [b[:200] + " " + passage + " " + b[200:] for b in (prose(rng, 50) for _ in range(4))]
    lined = ["\n".join([base[5], prose(rng, 12), "shared line of some length, quite often seen"]), "\n".join(["shared line of some length, quite often sean", base[5][:-1], "", "  ", "short", prose(rng, 9)]), "short\nshort\n" + prose(rng, 5)]
    period = "abcdefghij" * 60
    texts = [None, "", "   \n\t ", "one", "ONE", "é ü\u00a0x", base[0], *base, *near, *spliced, *lined, period, prose(rng, 4000), "x" * 30_000, "<|endoftext|> and  two\n\n blanks "]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, base[1]), (None, None), (7, texts[7])]
    return [(i, t, "en", None, len(t) if t else 0, 5, "clash", "clash", "clash", "clash") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def duck(sf: str):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


# --- 1 ---------------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def near_components(rows: list[tuple]) -> dict:
    ids = sorted({i for i, _ in rows})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_minhash(docs, none, spark, sf):
    rows = [(r[0], r[1]) for r in corpus() if r[0] is not None]
    out = minhash.near_duplicates(docs).collect()
    want = near_components(rows)
    assert len(out) == len(corpus())
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert all(r.component_id is None and not r.kept for r in out if r.doc_id is None)
    assert sorted(r.n_shingles for r in out) == sorted(len(shingle_set(r[1])) for r in corpus())
    assert minhash.near_duplicates(none).count() == 0
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = near_components(real)
    assert {r.doc_id: r.component_id for r in entry.op1_minhash(spark, sf).collect()} == want


def test_minhash_within_a_bucket(spark):
    """Chains, where members of a bucket are linked with each other but not with its smallest id."""
    rng = random.Random(3)
    rows = []
    for g in range(6):
        words = [rng.choice(WORDS) + str(i) for i in range(120)]
        for i in range(8):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for k in range(4):
                words[(i * 13 + k * 29) % 120] = f"new{g}-{i}-{k}"
    want = near_components(rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


@pytest.mark.parametrize("in_driver", [0, 10**6])
def test_components(spark, in_driver):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 60)]
    ids, root = graph.forest(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    loops = {int(a) for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    want = {int(i): int(r) for i, r in zip(ids, root) if i not in loops}
    got = graph.components(spark.createDataFrame(pairs + [(None, 1)], "u long, v long"), Scratch(spark, "t"), in_driver)
    assert {r.id: r.component_id for r in got.collect()} == want


# --- 2 ---------------------------------------------------------------------------------------


def test_vectors(spark, sf):
    rng = np.random.default_rng(1)
    center = rng.normal(size=(5, 16))
    rows = [(i, (center[i % 5] + rng.normal(size=16) * 0.25 * (i % 3)).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(300, None), (301, []), (302, [0.0] * 16), (303, [None] * 16), (304, [float("nan")] * 16), (305, [float("inf")] * 16), (306, [1.0] * 8), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash"))
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    ids = np.array([i for i, _ in good])
    known = dict(zip(*graph.forest(ids[a], ids[b])))
    for block in (8, 4096):
        out = vectors.near_duplicates(df, 0.9, block=block).collect()
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None}
        assert len(out) == len(rows)
        assert got == {i: (0, i, True) for i, _ in rows if i is not None} | {int(i): (int(n), int(known.get(i, i)), known.get(i, i) == i) for i, n in zip(ids, near.sum(1))}
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_any_size(spark):
    rows = [(1, [1e-170, 2e-170]), (2, [1e-170, 2e-170]), (3, [1e160, 2e160]), (4, [1.0, 2.0]), (5, [5e-324, 1e-323]), (6, [-1e300, 1e300]), (7, [0.0, -0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (4, 1) for i in range(1, 6)} | {6: (0, 6), 7: (0, 7)}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_vectors_whole_table(spark, size):
    """The query over whole tables, and over one with planted links, against all pairs."""
    at = f"/root/testdata/{size}"
    table = spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    rng = np.random.default_rng(3)
    near = [(10**6 + i, (np.array(v, float) + rng.normal(size=len(v)) * np.linalg.norm(v) * rng.uniform(0.2, 0.8) / np.sqrt(len(v))).tolist()) for i, v in enumerate(table.embedding[:150]) if v is not None]
    for rows in (list(zip(table.vec_id.tolist(), table.embedding)), [*zip(table.vec_id.tolist(), table.embedding), *near]):
        df = entry.op2_embeddings(spark, at) if len(rows) == len(table) else vectors.near_duplicates(spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>"), 0.9, block=64)
        good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
        x = np.stack([v / np.linalg.norm(v) for _, v in good])
        link = x @ x.T >= 0.9
        np.fill_diagonal(link, False)
        a, b = np.nonzero(link)
        assert len(rows) == len(table) or a.size > 50
        ids = np.array([i for i, _ in good])
        known = dict(zip(*graph.forest(ids[a], ids[b])))
        want = {int(i): (0, int(i)) for i, _ in rows} | {int(i): (int(n), int(known.get(i, i))) for i, n in zip(ids, link.sum(1))}
        assert {r.vec_id: (r.n_links, r.component_id) for r in df.collect()} == want


# --- 3 ---------------------------------------------------------------------------------------


def removed(texts: list[bytes], n: int = 200) -> list[np.ndarray]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for s in range(len(t) - n + 1):
            seen[t[s : s + n]] = seen.get(t[s : s + n], 0) + 1
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for s in range(len(t) - n + 1):
            if seen[t[s : s + n]] > 1:
                m[s : s + n] = True
        out.append(m)
    return out


def suffix_rows(texts):
    rows = []
    for t, m in zip(texts, removed(texts)):
        rest = np.frombuffer(t, np.uint8)[~m].tobytes()
        rows.append((len(t), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return rows


@pytest.mark.parametrize("hot", [suffixes.HOT, 1, 0])
def test_suffixes(docs, hot):
    rows = corpus()
    want = suffix_rows([(r[1] or "").encode() for r in rows])
    got = suffixes.digests(docs, hot).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((key(r[0]), *w) for r, w in zip(rows, want))


def test_suffixes_whole_tables(spark, sf, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), suffix_rows([(r.text or "").encode() for r in docs])))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entry.op3_suffixes(spark, sf).collect()} == want
    assert suffixes.digests(none).count() == 0


def test_suffixes_hang_on_the_sort(spark, docs, monkeypatch):
    """Nothing is removed that the sort does not find, and a gram in a third of all rows is split."""
    rng = random.Random(4)
    shared = prose(rng, 20)[:130]
    rows = [(i, f"{prose(rng, 20)} {shared} {prose(rng, 20)}" if i % 3 == 0 else prose(rng, 40)) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[3][1][40:] + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = suffix_rows([t.encode() for _, t in rows])
    for hot in (suffixes.HOT, 5):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(df, hot).collect()}
        assert got == dict(zip((i for i, _ in rows), want))
    real = suffixes._sorted
    monkeypatch.setattr(suffixes, "_sorted", lambda *a: real(*a).where("false"))
    assert suffixes.digests(docs).agg(F.sum("n_removed")).first()[0] == 0


def test_suffixes_odd_names(spark):
    text = "ab" * 150
    df = spark.createDataFrame([(1, text, 1, 2, 3, 4, 5), (2, "short", 1, 2, 3, 4, 5)], "doc_id long, text string, row_key int, Ranges int, range_key int, gram int, `a.b` int")
    out = suffixes.deduplicate(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == {(1, "", 1, 2, 3, 4, 5), (2, "short", 1, 2, 3, 4, 5)}


def test_suffix_sort():
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab") for _ in range(600)) + b"ab" * 50
    own = suffixes.Prefix(data)
    starts = np.arange(0, len(data) - 40)
    group = np.sort(starts % 3)
    at = np.concatenate([starts[starts % 3 == g] for g in range(3)])
    got = suffixes.mergesort(own, at, group, 40)
    for g in range(3):
        part = got[group == g]
        texts = [data[s : s + 40] for s in part]
        assert texts == sorted(texts) and sorted(part) == sorted(at[group == g])


# --- 4 ---------------------------------------------------------------------------------------


def test_marginals():
    field = toxicity.Field()
    field.transitions = np.array([[0.3, -0.2], [-0.1, 0.6]])
    rng = np.random.default_rng(4)
    seqs = [rng.normal(size=n) for n in (0, 1, 2, 5, 7)]
    for e, p in zip(seqs, field.marginals(seqs)):
        total, on = 0.0, np.zeros(e.size)
        for y in itertools.product((0, 1), repeat=e.size):
            w = np.exp(sum(e[i] for i in range(e.size) if y[i]) + sum(field.transitions[a, b] for a, b in zip(y, y[1:])))
            total, on = total + w, on + w * np.array(y)
        assert np.allclose(p, on / total)


def test_expected_transitions():
    field = toxicity.Field()
    field.transitions = np.array([[0.3, -0.9], [-0.7, 0.6]])
    rng = np.random.default_rng(5)
    seqs = [rng.normal(size=n) for n in (0, 3, 1, 2, 7, 5)]
    want, got = np.zeros((2, 2)), np.zeros((2, 2))
    for e in seqs:
        total, part = 0.0, np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=e.size):
            w = np.exp(sum(e[i] for i in range(e.size) if y[i]) + sum(field.transitions[a, b] for a, b in zip(y, y[1:])))
            total += w
            for a, b in zip(y, y[1:]):
                part[a, b] += w
        want += part / total
    field.marginals(seqs, got)
    assert np.allclose(got, want)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = entry.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").toPandas()
    assert ((out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3)) == 1).all()
    hit = out[out.toxic == 1].predicted.mean()
    wrong = out[out.toxic == 0].predicted.mean()
    assert hit > 0.8 and wrong < 0.02


def test_toxicity_odd_inputs(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(2, 20)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    field = toxicity.train(docs, labels)
    out = toxicity.score(docs, field).collect()
    assert len(out) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert toxicity.score(none, field).count() == 0 and toxicity.reject(docs, field).columns == docs.columns
    blank = toxicity.train(none, labels)
    assert toxicity.reject(docs, blank).count() == len(corpus())
    rng = random.Random(6)
    field = toxicity.fit([f"{prose(rng, 20)} {'idiot' if i % 2 else 'calm'} {prose(rng, 20)}" for i in range(80)], [i % 2 for i in range(80)])
    spans = toxicity.score(spark.createDataFrame([(1, "so, an idiot!"), (2, "calm")], "doc_id long, text string"), field).orderBy("doc_id").collect()
    assert spans[0].predicted == 1 and [(x.start, x.end) for x in spans[0].spans] == [(7, 13)]
    assert spans[1].predicted == 0 and spans[1].spans == []


def test_toxicity_far_passage(spark):
    rng = random.Random(8)
    rows = [(i, f"{prose(rng, 1800)} {'idiot' if i % 2 else 'calm'} {prose(rng, 20)}") for i in range(120)]
    assert all(min(t.find("idiot") % (1 << 30), t.find("calm") % (1 << 30)) > 10_000 for _, t in rows)
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    field = toxicity.train(texts, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int"))
    out = toxicity.score(texts, field).collect()
    assert all(r.predicted == r.doc_id % 2 and len(r.spans) == r.doc_id % 2 for r in out)


# --- 5 ---------------------------------------------------------------------------------------

PAGES = [(1, "http://a/\nb", "x" * 1000), (2, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (None, "u", "x" * 1000), (7, "u", "é" * 500_000), (2, "again", "x" * 1000)]


def test_warc(spark, sf):
    held = Scratch(spark, "t")
    warc.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"key": F.lit("clash"), "n": F.lit("clash")}), held)
    out = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archive(held).collect()}
    assert out == {(1, 1000, "revisit", 2), (2, 1000, "response", None), (3, 999, "response", None), (4, 999, "response", None), (5, 0, "response", None), (6, 0, "response", None), (None, 1000, "revisit", 2), (7, 1_000_000, "response", None)}
    records = {(r.page_id, bytes(r.record)) for r in warc.records(held).collect()}
    for i, record in records:
        head, _, body = record.partition(b"\r\n\r\n")
        n = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert body == body[:n] + b"\r\n\r\n" and (b"revisit" in head) == (n == 0 and i in (1, None))
    empty = Scratch(spark, "t")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archive(empty).count() == 0


@pytest.mark.parametrize("name", ["op5_warc", "op8_url_filter"])
def test_against_sql(spark, sf, name):
    want, got = duck(sf).execute(entry.ORACLE_SQL[name]).fetchdf(), entry.QUERIES[name](spark, sf).toPandas()
    rows = lambda df: sorted(tuple(None if pd.isna(x) else str(x) for x in r) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    assert sorted(map(repr, rows(want))) == sorted(map(repr, rows(got)))


# --- 6, 7 ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(entry.tokenizer_path())


def test_bpe(spark, docs, none, tokenizer, sf):
    rows = corpus()
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    for own, out in ((rows, bpe.digests(docs, entry.tokenizer_path())), (table, entry.op6_bpe(spark, sf))):
        got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
        want = []
        for r in own:
            ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
            want.append((r[0] if r[0] is not None else -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.digests(none, entry.tokenizer_path()).count() == 0
    back = bpe.decode(bpe.encode(docs.where("doc_id = 7"), entry.tokenizer_path()), entry.tokenizer_path())
    assert {r.text for r in back.collect()} == {rows[7][1]}


def test_bpe_fuzz(tokenizer):
    codec, rng = bpe.Codec(entry.tokenizer_path()), random.Random(1)
    pool = list("ab 1'\n\t.é\u00a0\u3000\x0b\x1c日²<|") + ["  ", "'ll", "<|endoftext|>", "the ", "qqqq" * 20]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t, ids in zip(texts, codec.encode(texts)):
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == tokenizer.decode(want, skip_special_tokens=False)


def check_pieces(rows, docs, tokenizer):
    """Pieces are those of the tokenizers library, and lie in sequences without gap or overlap."""
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    want = []
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, head, *range(head + 1024, len(ids) + 1, 1024)] if len(ids) > head else [0, len(ids)]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins: list[int] = []
    for n in sorted((n for own in places.values() for _, n in own), reverse=True):
        k = next((k for k, free in enumerate(bins) if free >= n), len(bins))
        bins[k:] = [bins[k] - n, *bins[k + 1 :]] if k < len(bins) else [1024 - n]
    assert len(places) <= len(bins)  # no more than first fit, longest first


def test_packing(spark, docs, none, tokenizer, sf):
    check_pieces(packing.pack(docs, entry.tokenizer_path(), 1024, 2).collect(), [r[:2] for r in corpus()], tokenizer)
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(entry.op7_packing(spark, sf).collect(), table, tokenizer)
    assert packing.pack(none, entry.tokenizer_path()).count() == 0


def test_plan():
    assert packing.plan({}, 8) == []
    assert packing.plan({5: 2, 3: 2}, 8) == [([5, 3], 2)]
    assert packing.plan({4: 5}, 8) == [([4, 4], 2), ([4], 1)]
    assert packing.plan({5: 1, 2: 1, 1: 1}, 8) == [([5, 2, 1], 1)]
    assert packing.plan({5: 1, 1: 3}, 8) == [([5, 1, 1, 1], 1)]
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(rng.randint(1, 15))}
        got: dict[int, int] = {}
        for own, m in packing.plan(counts, 40):
            assert sum(own) <= 40 and m > 0
            for x in own:
                got[x] = got.get(x, 0) + m
        assert got == counts


# --- 8 ---------------------------------------------------------------------------------------


def test_urls(spark):
    rng = random.Random(9)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "A.Com", "c.b.a.com", ""]
    rules = [("com", "/", "allow"), ("a.com", "/x", "block"), ("b.a.com", "/x/", "allow"), ("a.com", "/x", "allow"), ("net", "", "block"), (None, "/", "block"), ("com", None, "block"), ("", "/", "block"), ("COM", "/x/y/z", "block")]
    urls = [None, "", "no scheme/x", "://", "http://", "http://com", "http://a.com?q#x", "http://a.com#/x"] + [f"h://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/', '/x/y/z?a', '/y#b'])}" for _ in range(120)] + ["http://a.com/x"] * 80
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://a.com/x"), (3, "://")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)), spark.createDataFrame(rules, "host string, path string, verdict string"))

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h) + len(p), len(h), v == "block", h.lower() + p, v) for h, p, v in rules if h and p is not None and v and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fit) if fit else None
        return host, path, best and best[3], best[4] if best else "allow"

    assert sorted(((-1 if r.page_id is None else r.page_id), r.host, r.path, r.rule or "", r.verdict) for r in got.collect()) == sorted(((-1 if i is None else i), h, p, r or "", v) for i, u in rows for h, p, r, v in [want(u)])
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


# --- 9 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 48])
def test_tiff(compression, predictor, tile):
    rng = random.Random(1)
    pages = [bytes(64), bytes(rng.randrange(256) for _ in range(64 * 37)), (b"ab" * 3 + b"c" * 200) * 64, bytes(rng.choice(b"ab") for _ in range(64 * 300))]
    got = media.read(media.write(pages, compression=compression, predictor=predictor, rows_per_strip=10, tile=tile))
    assert [p["pixels"] for p in got] == pages


def test_media(spark, docs, none):
    rows = corpus()
    out = {r.doc_id: r for r in media.digests(docs).collect() if r.doc_id is not None}
    for r in rows:
        if r[0] is not None:
            raw = (r[1] or "").encode()
            pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            o = out[r[0]]
            assert (o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert media.digests(none).count() == 0
    files = [(1, media.write([bytes(64), b"x" * 128])), (2, None), (3, b""), (4, b"II*\0\x08\0\0\0"), (5, media.write([bytes(64)])[:-20])]
    got = media.decode_pages(spark.createDataFrame(files, "id long, media binary"), "id", "media").collect()
    assert sorted((r.id, -1 if r.page is None else r.page, r.error is None) for r in got) == [(1, 0, True), (1, 1, True), (2, -1, False), (3, -1, False), (4, -1, False), (5, -1, False)]
    assert {bytes(r.media)[:2] for r in media.store(docs).collect()} == {b"II"}


def test_media_damaged_page(spark):
    pages = [b"a" * 64, b"b" * 128, b"c" * 192]
    data = bytearray(media.write(pages, compression=media.DEFLATE))
    at = data.index(media._PACK[media.DEFLATE](b"b" + bytes(63) + b"b" + bytes(63)))
    data[at : at + 4] = b"\0\0\0\0"
    got = sorted(media.decode_pages(spark.createDataFrame([(1, bytes(data))], "id long, media binary"), "id", "media").collect(), key=lambda r: r.page)
    assert [(r.page, r.pixels and bytes(r.pixels), r.error is None) for r in got] == [(0, pages[0], True), (1, None, False), (2, pages[2], True)]
    with pytest.raises(media.TiffError):
        media.read(bytes(data))


# --- 10 --------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_within():
    rng = random.Random(3)
    for _ in range(4000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert all(lines.within(a, b, k) == (distance(a, b) <= k) for k in range(4))


def kept_lines(rows):
    occ: dict[str, list] = {}
    for i, t in rows:
        if i is not None:
            for n, x in enumerate((t or "").split("\n")):
                if x and not x.isspace():
                    occ.setdefault(x, []).append((i, n))
    root = {x: x for x in occ}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(occ, 2):
        k = lines.allowed(len(a), len(b))
        if k and abs(len(a) - len(b)) <= k and lines.within(a, b, k):
            root[find(a)] = find(b)
    sets: dict[str, list] = {}
    for x in occ:
        sets.setdefault(find(x), []).extend(occ[x])
    first = {min(v) for v in sets.values()}
    return [(i, t if t is None or i is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not x or x.isspace() or (i, n) in first)) for i, t in rows]


def test_lines(spark, docs, none):
    rows = [(r[0], r[1]) for r in corpus()]
    out = lines.deduplicate(docs)
    assert out.columns == [c for c in docs.columns if c != "n_removed"] + ["n_removed"]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, kept_lines(rows)))
    assert lines.deduplicate(none).count() == 0


def test_lines_large_buckets(spark):
    """More near lines in a bucket than are held against each other at once, in chains."""
    rng = random.Random(8)
    line = list("the quick brown fox jumps over the lazy dog and runs away far")
    rows = []
    for i in range(60):
        rows.append((i, "".join(line)))
        line[rng.randrange(20, len(line))] = rng.choice("xyzw")
    rows += [(100 + i, "the quick brown fox jumps " + "".join(rng.choice("abcdef") for _ in range(35))) for i in range(60)]
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(kept_lines(rows))


def test_lines_null_id_links_nothing(spark):
    a = "the quick brown fox jumps over the lazy dog and runs far"
    b = a.replace("quick", "quack").replace("jumps", "jumbs")
    c = b.replace("lazy", "lady").replace("runs", "runs!"[:4]).replace("far", "fir")
    rows = [(1, a), (None, b), (2, c)]
    assert not lines.within(a, c, 2) and lines.within(a, b, 2) and lines.within(b, c, 2)
    assert {(r.doc_id, r.text) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(rows)


def test_lines_odd_names(spark):
    names = ["found_in", "Found_Lines", "new_text", "key", "a", "b", "id", "found", "component", "x.y"]
    df = spark.createDataFrame([(1, "some line of text", *range(10)), (2, "some line of text", *range(10))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = lines.deduplicate(df)
    assert out.columns == [*df.columns, "n_removed"] and {tuple(r) for r in out.collect()} == {(1, "some line of text", *range(10), 0), (2, "", *range(10), 1)}


def test_lines_bucket_of_any_size(spark):
    """A bucket that holds a third of all rows is given out as it comes: all members, and pairs with one of them."""
    rng = random.Random(2)
    sign = -(1 << 63)
    rows = [(7, i + sign) for i in range(500)] + [(7, i) for i in range(400, 1200)] * 3 + [(k, rng.randrange(9) + rng.choice([0, sign])) for k in range(8, 400) for _ in range(8)] + [(3, i) for i in range(300)] + [(4, 5 + sign), (4, 5)]
    df = spark.createDataFrame(rows, "key long, id long").repartition(2, "key").sortWithinPartitions("key", "id")
    got = {most: {(r.key, r.a, r.b) for r in lines._met(df, most).collect()} for most in (20, 10**6)}
    plain = lambda x: {r for r in x if r[0] != 7 and (r[0] is not None or max(r[1:]) < 9)}
    assert plain(got[20]) == plain(got[10**6])
    for x in got.values():
        assert {a for k, a, _ in x if k == 7} == set(range(1200)) and {a for k, a, b in x if k == 7 and b} == set(range(500))
        assert {b for k, a, b in x if k is None and a == 0 and b >= 400} == set(range(400, 1200))
        assert not any(k in (3, 4) for k, _, _ in x)


def test_lines_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.kept_sha256 for r in entry.op10_lines(spark, sf).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in kept_lines(rows)}


# --- pipeline --------------------------------------------------------------------------------


def test_stages(spark, docs, none, sf, tmp_path):
    """Every stage over odd rows: all columns stay, decisions are those of brute force."""
    spark.createDataFrame([(i, i % 2) for i in range(2, 30)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in at.collect()]
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        after = [(r.doc_id, r.text) for r in at.collect()]
        if name == "line dedup":
            assert sorted(map(repr, after)) == sorted(map(repr, kept_lines(before)))
        elif name == "MinHash near-dedup":
            part = near_components([r for r in before if r[0] is not None])
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if r[0] is None or part[r[0]] == r[0])
        elif name == "suffix-array dedup":
            raw = [(t or "").encode() for _, t in before]
            rest = [None if t is None else np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore") for (_, t), b, m in zip(before, raw, removed(raw))]
            assert sorted(map(repr, after)) == sorted(repr((i, t)) for (i, _), t in zip(before, rest))
        assert all(r.n_chars == len(r.text or "") for r in at.where("n_chars is not null").collect()) or name == "toxicity"
    assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_stages_odd_names(spark, tmp_path):
    """Columns with any name, the stages' own helpers' among them, and repeated ids."""
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["gone", "__gone", "__found", "__doc", "__ranges", "row_key", "range_key", "found_in", "kept", "component_id", "score", "x.y"]
    rng = random.Random(1)
    texts = [prose(rng, 60) for _ in range(4)]
    rows = [(i, t, *range(len(names))) for i, t in [(1, texts[0]), (2, texts[0] + " end"), (3, texts[1]), (3, texts[2]), (None, texts[0]), (5, ""), (6, None)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
    left = corpus_pipeline.STAGES[2][1](spark, df, str(tmp_path)).select("doc_id").collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 3, 3, 5, 6]


def test_run(spark, sf, tokenizer):
    """The whole run against brute force for every stage but the first, whose field is fitted anew."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = [(r.doc_id, r.text) for r in toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()]
    at = kept_lines(at)
    part = near_components(at)
    at = [(i, t) for i, t in at if part[i] == i]
    raw = [(t or "").encode() for _, t in at]
    at = [(i, np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore")) for (i, _), b, m in zip(at, raw, removed(raw))]
    got = corpus_pipeline.run(spark, sf).collect()
    check_pieces(got, at, tokenizer)
