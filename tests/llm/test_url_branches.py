"""Branches of a large node."""

import duckdb
import pytest

from cohortlake.llm import urls
from cohortlake.llm.store import stage


def test_a_small_branch_of_a_large_host_keeps_its_verdict(spark):
    """Forty bad urls among ten thousand: under one in a hundred, and clearly different."""
    rows = [(i, f"http://h/{'spam' if i < 40 else 'news'}/{i}", int(i >= 40)) for i in range(10_000)]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id bigint, good int")
    got = stage(urls.judge(stage(df, "pages"), labels=stage(labels, "labels"), rules=()), "judged")
    assert {(r[0], r[1]) for r in got.selectExpr("page_id < 40", "verdict").distinct().collect()} == {(True, "block"), (False, "allow")}


RULES = (("allow", "net/ok/"), ("block", "h.net/bad/"), ("block", "h.net/a/b/c/d/e/spam/1"), ("allow", "h.net/a/b/c/d/e/news/1"), ("block", "h.net/s/bad"))


def pages_of(kind):
    if kind == "a branch under one in a hundred":
        found = [f"http://h.net/x/{i}" for i in range(10_000)] + [f"http://h.net/ok/{i}" for i in range(200)] + [f"http://h.net/bad/{i}" for i in range(60)]
        return found + ["http://h.net/bad?x"] * 5
    if kind == "segment six":
        return [f"http://h.net/a/b/c/d/e/{w}/{1 if i < 60 else 2}/{i}" for w in ("spam", "news") for i in range(200)] + [None, "", "http://h.net", "http://h.net//"]
    return ["http://o.net/ok/" + "/".join(["s"] * 40), "http://h.net/bad/" + "x/" * 30] * 6 + ["http://h.net/ok//", "x"]


@pytest.mark.parametrize("kind", ["a branch under one in a hundred", "segment six", "deep paths"])
def test_statement_on_uneven_hosts(spark, kind):
    rows = list(enumerate(pages_of(kind)))
    got = urls.judge(stage(spark.createDataFrame(rows, "page_id bigint, url string"), "pages"), rules=RULES).drop("template")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = con.execute(urls.sql(RULES)).fetchall()
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(want) and len(found) == len(rows)
    by = {r[0]: r[4] for r in found}
    if kind == "segment six":
        assert by[199] == "block" and by[399] == "allow"
    if kind.startswith("a branch"):
        assert by[0] == "allow" and by[10_250] == "block"
