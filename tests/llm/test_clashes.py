"""Every operator takes input columns named like its working columns, in any case, and passes them through."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, langid, license_scan, line_dedup, quality, queries, sharding, simhash, toxicity, url_filter

NAMES = """
__text __matches __k1 __k2 __g __s __q __b __r __a __p __row __key __n __dropped __id __y k1 k2 i1 i2 id pos line n m t p g g1 g2 w l b
row matches key cell fp rep component node a c d ix pr odd first near copies dropped number whole y0 y1 m0 c00 l00 host entry category at
month valid_from valid_to url_ k u slot_ offset local Text_ DOC
""".split()


def table(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(f"own {x}").alias(x) for x in NAMES if x.lower() not in {c.lower() for c in df.columns}])


def kept(before, after):
    """All own columns came through unchanged."""
    rows, n = after.collect(), 0
    for c in before.columns:
        if c in NAMES and c in after.columns:
            assert all(r[c] == f"own {c}" for r in rows), c
            n += 1
    assert n == sum(c in NAMES for c in before.columns)
    return rows


TEXT = "the green river runs by a small house and a wide garden under the tall trees of an old town " * 4
DOCS = [(1, TEXT, "en", "s"), (2, TEXT + "\nthis is the tail of another text", "en", "s"), (3, None, None, None), (4, "", "de", "s"), (None, "x 1d10t y", None, "s"), (1, TEXT, "en", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DOCS, "doc_id long, text string, lang string, source string")


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, usable=F.lit(True))
    assert len(kept(docs, toxicity.score(docs, model))) == len(DOCS)


def test_license_scan(docs):
    assert len(kept(docs, license_scan.scan(docs))) == len(DOCS)


def test_decontamination(spark, docs):
    bench = table(spark, [(1, TEXT), (2, None)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.contaminated_pairs(docs, bench).collect()) == [1, 1, 2]
    assert len(kept(docs, decontam.clean(docs, bench))) == 3


def test_bpe(docs):
    path, pattern = queries.tokenizer_path(queries.BPE_RANKS), queries.bpe_pattern()
    assert len(kept(docs, bpe.round_trip(docs, path, pattern))) == len(DOCS)
    assert len(kept(docs, bpe.decode(bpe.encode(docs, path, pattern), path, pattern))) == len(DOCS)


def test_quality(docs):
    rows = kept(docs, quality.judge(docs))
    assert len(rows) == len(DOCS) and all((r["distance"] is None) == r["base_failed"] for r in rows)


def test_sharding(docs):
    rows = kept(docs, sharding.assign(docs.drop("text"), 4))
    assert len(rows) == len(DOCS)


@pytest.mark.parametrize("overlapping", [False, True])
def test_simhash(docs, overlapping):
    rows = kept(docs, simhash.deduplicate(docs, overlapping=overlapping))
    assert {r["doc_id"] for r in rows} >= {1, 3} and len(rows) <= 4
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fp", "component_id"]


def test_line_dedup(docs):
    rows = kept(docs, line_dedup.deduplicate(docs))
    assert sorted(str(r["text"]) for r in rows) == sorted([TEXT, "", "", "None", "this is the tail of another text", "x 1d10t y"])
    assert line_dedup.decide(docs).count() == len(DOCS)


def test_url_filter(spark):
    pages = table(spark, [(1, "http://a.com/x", dt.date(2024, 1, 2)), (1, None, None)], "page_id long, url string, fetched date")
    events = table(spark, [("a.com", "x", True, dt.date(2024, 1, 1))], "entry string, category string, listed boolean, at date")
    rows = kept(pages, url_filter.filter_captures(pages, events))
    assert sorted(r["blocked"] for r in rows) == [False, True]


def test_language_id(docs):
    model = langid.fit(docs, langid.vocabulary_pieces(queries.tokenizer_path(queries.PIECES)), usable=F.lit(True))
    assert len(kept(docs, langid.predict(docs, model))) == len(DOCS)
