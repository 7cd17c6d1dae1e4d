"""WARC, search, URL templates, the pipeline and the registered queries."""

import gzip
import hashlib
import random

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import plain
from cohortlake.llm import decontaminate, lines, mixing, quality, queries, search, simhash, store, urls, warc
from oracle import connect, mismatch

SMALL = "/root/testdata/sf0.001"


# WARC

def page_rows():
    page = "<p>" + "same " * 40 + "</p>"
    return [
        (5, "http://a/x", page), (3, "http://b/y\r\nz", page), (9, None, page), (4, "", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""),
        (3, "http://again", page), (None, "http://no.id", page), (None, None, "ü" * 80), (11, "u", "ü" * 80), (12, "u", "WARC/1.1\r\n\r\n" * 50),
        (13, "long", "".join(random.Random(1).choices("abcdefgh<>é", k=200_000))),
    ]


@pytest.mark.parametrize("split", [100, 5000, 1 << 23])
def test_archives_round_trip(spark, split):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("x")).repartition(4)
    manifest = warc.write(pages, store.folder(spark, "warc"), file_bytes=3000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = sorted((r["page_id"] or -1, r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read(manifest, split_bytes=split).collect())
    expected = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        ids = [i for i, _, h in rows if h is not None and h.encode() == body and i is not None]
        again = len(body) >= 100 and ids and page_id != min(ids)
        expected.append((page_id or -1, "revisit" if again else "response", len(body), hashlib.sha256(body).hexdigest(), min(ids) if again else None))
    assert got == sorted(expected, key=lambda r: tuple(map(str, r))) or sorted(got, key=str) == sorted(expected, key=str)


def test_payloads_and_urls(spark):
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    folder = store.folder(spark, "warc")
    manifest = warc.write(pages, folder)
    back = {r["page_id"]: r for r in warc.read(manifest).where("record_type = 'response'").collect()}
    assert bytes(back[13]["payload"]).decode() == page_rows()[-1][2] and back[9 if 9 in back else 13] is not None
    assert bytes(back[7]["payload"]) == b"" and back[4]["url"] == ""
    assert warc.read_folder(spark, folder).count() == len(page_rows())
    path = manifest.first()["path"]
    store_, name = pafs.FileSystem.from_uri(path)
    with store_.open_input_file(name) as source:
        assert gzip.decompress(source.readall()).startswith(b"WARC/1.1\r\n")


def test_a_header_longer_than_a_mebibyte(spark):
    url = "http://h/" + "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=3 << 20))
    pages = spark.createDataFrame([(1, "u", "x"), (2, url, "y" * 200), (3, "v", "z")], "page_id bigint, url string, html string").coalesce(1)
    manifest = warc.write(pages, store.folder(spark, "warc"))
    for split in (1 << 16, 1 << 23):
        assert {r["page_id"]: r["url"] for r in warc.read(manifest, split_bytes=split).collect()} == {1: "u", 2: url, 3: "v"}


def test_a_damaged_record_is_an_error(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 90) for i in range(5)], "page_id bigint, url string, html string").coalesce(1)
    manifest = warc.write(pages, store.folder(spark, "warc"))
    row = manifest.first()
    filesystem, name = pafs.FileSystem.from_uri(row["path"])
    with filesystem.open_input_file(name) as source:
        data = bytearray(source.readall())
    data[row["starts"][2] + 40] ^= 1
    with filesystem.open_output_stream(name) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="were written"):
        warc.read(manifest).collect()


def test_noise_between_records(spark, tmp_path):
    good = warc.record(1, "u", b"payload", "response", hashlib.sha256(b"payload").hexdigest(), None)
    other = gzip.compress(b"not a record")
    inner = warc.record(2, "v", good * 3, "response", hashlib.sha256(good * 3).hexdigest(), None)
    (tmp_path / "a.warc.gz").write_bytes(b"\x1f\x8b\x08junk" + good + other + b"\x1f\x8b\x08" + inner + good[:-9])
    for split in (7, 60, 10_000):
        rows = warc.read_folder(spark, str(tmp_path), split_bytes=split).collect()
        assert sorted(r["page_id"] for r in rows) == [1, 2]


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read(warc.write(none, store.folder(spark, "warc"))).count() == 0


# search

def test_top_k(spark):
    draw = np.random.default_rng(6)
    vectors = [draw.normal(size=24).round(2).tolist() for _ in range(150)]
    rows = [(i, vectors[i % 150] if i % 4 else vectors[0], 1) for i in range(400)]
    rows += [(1000, None, 1), (1001, [None] + vectors[1][1:], 1), (1002, [float("nan")] * 24, 1), (1003, [float("inf")] * 24, 1), (None, vectors[2], 1), (1004, [], 1), (1005, [3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").repartition(3)
    whole = {i: [int(np.floor(float(np.float32(x)) * 64)) for x in v] for i, v, _ in rows if i is not None and (i < 1000 or i >= 1004)}
    for options in ({}, {"queries": 7, "candidates": 50}):
        got = {}
        for r in search.top_k(df, F.col("vec_id") % 20 == 0, **options).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert set(got) == {i for i in whole if i % 20 == 0}
        for q, found in got.items():
            all_ = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
            assert [found[k] for k in range(1, 21)] == [(i, -s) for s, i in all_[:20]]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, -2.0])], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, search.top_k(df, F.col("vec_id") % 20 == 0).collect())) == [(0, 1, 20, -12288), (20, 1, 0, -12288)]
    assert search.top_k(df.where("false"), F.lit(True)).count() == 0


def test_bounds_hold():
    draw = np.random.default_rng(7)
    q, x = draw.integers(-90, 90, (20, 30)), draw.integers(-90, 90, (300, 30))
    exact = q @ x.T
    for segments in (1, 4, 7, 30):
        bound = search.statistics(q.astype(float), segments) @ search.statistics(x.astype(float), segments).T
        assert (bound >= exact - 1e-6).all()


# URLs

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG", "http://example.org/es/1", "http://sub.example.org/es/", "http://example.org/en/12",
    "http://example.org/en/2", "https://xexample.org/es/1", "ftp://a.com/fr/9?q=/de/", "http://a.com/de/9#x", "http://a.com/it/9", "x://y://z/w",
    "http://org/", "http://org", "http://a.com?x", "http://Ä.com/fr/", "http://a.net/fr/7\nq", "http://a.com:80/fr/1", "http://comx/fr/1",
]


def test_hosts_and_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, "http://a.com/fr/1", "x"), (3, URLS[3], "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host, path = "", ""
        if rest is not None:
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = plain.lower(rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        rule = max(
            (r for _, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])),
            key=len, default=None,
        )
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule), u
        assert rule is None or by[i]["verdict"] == {r: w for w, r in urls.RULES}[rule]
        assert by[i]["verdict"] in ("allow", "block")
    assert urls.judge(df.where("false")).count() == 0


def test_templates_separate_what_differs(spark):
    rows = []
    for i in range(600):
        good = i % 2
        rows.append((i, f"http://h{i % 3}/{'news' if good else 'spam'}/{'abcdefghij'[i % 10]}{i}/", good))
    rows.append((700, "http://h1/spam/unseen", None))
    rows.append((701, "http://h1/news/unseen", None))
    df = spark.createDataFrame(rows, "page_id bigint, url string, good int")
    labels = df.where("good is not null").select("page_id", "good")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in urls.judge(df.drop("good"), labels=labels, rules=()).collect()}
    assert got[700] == ("block", "/spam") and got[701] == ("allow", "/news")
    assert all(v[0] == ("allow" if i % 2 else "block") for i, v in got.items() if i < 600)
    flat = urls.judge(df.drop("good"), labels=labels.where("false"), rules=()).select("verdict").distinct().collect()
    assert [r[0] for r in flat] == ["allow"]


# queries

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_statement(spark, name):
    if queries.ORACLES[name]:
        assert mismatch(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) is None


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES


def test_pipeline_against_plain_code(spark):
    """All stages after the classifier, whose model is taken as fitted, by plain code."""
    folder = SMALL
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(documents, labels)
    rows = {r["doc_id"]: r.asDict() for r in documents.collect()}
    scores = quality.Trees(**vars(model)).score(quality.matrix([(r["text"] or "").encode() for r in rows.values()]))
    texts = {i: r["text"] for (i, r), s in zip(rows.items(), scores) if s >= 0.3}
    texts = plain.lines(texts)
    groups = plain.components({i: plain.fingerprint(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not plain.contamination(t, items)[3]}
    got = corpus_pipeline.run(spark, folder)
    out = got.collect()
    assert all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in out)
    left = spark.createDataFrame([(i, t, rows[i]["source"]) for i, t in texts.items()], "doc_id bigint, text string, source string")
    again = mixing.mix(left, corpus_pipeline.WEIGHTS, corpus_pipeline.REST)
    key = ["doc_id", "copy", "place"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, got.select(*key).collect()))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    docs = docs.union(spark.sql("select null, null, null, null, null"))
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, SMALL).columns == docs.columns, name
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(m for m in (decontaminate, lines, simhash))
