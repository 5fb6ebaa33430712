"""Readers and sinks."""

from pyspark.sql import functions as F

from tapestride.plans import catalogue
from tapestride.sources import dump, tables

XML = """<mediawiki><page><title>A</title><ns>0</ns><revision><text xml:space="preserve">x [[B|bee]] &amp; [[C]]</text></revision></page>
<page><title>R</title><redirect title="A" /><revision><text xml:space="preserve">#REDIRECT [[A]]</text></revision></page>
<page><title>T</title><ns>1</ns><revision><text xml:space="preserve">talk</text></revision></page><page><title>E</title><revision><text /></revision></page></mediawiki>"""


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    pages = dump.read_dump(spark, str(tmp_path / "d.xml"))
    assert {r.title: (r.ns, r.redirect) for r in pages.collect()} == {"A": (0, None), "R": (0, "A"), "T": (1, None), "E": (0, None)}
    parsed = dump.parse(dump.articles(pages))
    assert sorted((r.source, r.surface, r.destination, r.surface_repr) for r in dump.links(parsed).collect()) == [("A", "C", "C", "C"), ("A", "bee", "B", "bee"), ("R", "A", "A", "A")]
    assert sorted((r.title, r.surface, r.token) for r in dump.link_tokens(parsed).where("title = 'A'").collect()) == [("A", "C", 3), ("A", "bee", 1)]


def test_links_of_every_page(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.title for r in dump.links(dump.parse(catalogue.xml_pages(spark, sf))).select(F.col("source").alias("title")).distinct().collect()}
    fifth = {r.url for r in spark.read.parquet(f"{sf}/pages.parquet").where("page_id % 5 = 0").collect()}
    assert want & fifth
    assert {r.source for r in catalogue.wikitext_links(spark, sf).collect()} == want
    assert {r.title for r in catalogue.wikitext_link_tokens(spark, sf).collect()} == want


def test_tsv(spark, tmp_path):
    at = str(tmp_path / "t")
    tables.write_tsv(spark.createDataFrame([("a", "A", "1"), ("b", "B", "x")], "s string, t string, n string"), at)
    assert [tuple(r) for r in tables.read_counts(spark, at).collect()] == [("a", "A", 1)]
    assert tables.read_tsv(spark, at, "s string, t string, n long").where(F.col("n").isNotNull()).count() == 1


def test_cached(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert [tables.cached(spark, str(tmp_path / "c"), make).count() for _ in range(2)] == [3, 3] and made == [1]


def test_evaluations(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "e" / name).mkdir(parents=True)
        (tmp_path / "e" / name / "part").write_text("0.1\t1\t2\t3\t4\t5\t6\t7\n")
    assert tables.read_evaluations(spark, str(tmp_path / "e")).count() == 2
