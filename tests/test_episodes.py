"""Interval merging against a plain Python walk over sorted rows."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import episodes
from cohortlake.operators.acute import acute_hierarchy, hierarchy

DAY = datetime.date(2018, 1, 1)
SCHEMA = "member int, start date, end date, row int, flag int"


def day(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


def walk(stays, mode, gap=1):
    """Number the stays of one member by visiting them in order."""
    ordered = sorted(stays, key=lambda r: (r[1], r[2] is not None, r[2] or DAY))
    out, current, latest, previous = [], 0, None, None
    for i, row in enumerate(ordered):
        start, end = row[1], row[2]
        prior = (previous[2] if previous else None) if mode == "lag" else latest
        opens = prior is None or start > prior + datetime.timedelta(days=gap)
        current += opens
        if i == 0:
            label = "1.First"
        elif opens:
            label = "2.New Episode"
        elif end is not None and end > prior:
            label = "3.Regular Overlap"
        elif start == previous[1] and end is not None and end < prior:
            label = "5.Same Start Date (SRO)"
        elif start > previous[1] and end is not None and end < prior:
            label = "6.Embedded"
        elif start == previous[1] and end == prior:
            label = "7.Perfect Overlap"
        else:
            label = None
        out.append((row, current, label))
        previous = row
        if end is not None:
            latest = end if latest is None else max(latest, end)
    return out


def random_stays(seed, members=6, per=14):
    rng = random.Random(seed)
    stays = []
    for m in range(members):
        for i in range(per):
            start = rng.randrange(30)
            length = rng.choice([0, 0, 1, 2, 3, 9, -3, None])
            end = None if length is None else start + length
            stays.append((m, day(start), day(end), m * 100 + i, rng.randrange(2)))
            if rng.random() < 0.3:
                stays.append((m, day(start), day(end), m * 100 + 50 + i, rng.randrange(2)))
    return stays


@pytest.mark.parametrize("mode", ["lag", "running_max"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_match_walk(spark, mode, seed):
    stays = random_stays(seed)
    got = episodes.episodes(spark.createDataFrame(stays, SCHEMA), ["member"], "start", "end", mode=mode, salts=3)
    assert got.count() == len(stays)
    found = Counter((r.member, r.start, r.end, r.episode, r.overlap) for r in got.collect())
    expected = Counter()
    for m in {s[0] for s in stays}:
        for row, number, label in walk([s for s in stays if s[0] == m], mode):
            expected[(m, row[1], row[2], number, label)] += 1
    # the class of a running-max row refers to the previous row in both; compare numbers there
    if mode == "running_max":
        strip = lambda c: sum((Counter({k[:4]: n}) for k, n in c.items()), Counter())
        found, expected = strip(found), strip(expected)
    assert found == expected


@pytest.mark.parametrize("mode", ["lag", "running_max"])
def test_rollup_matches_walk(spark, mode):
    stays = random_stays(7)
    got = episodes.episode_rollup(spark.createDataFrame(stays, SCHEMA), ["member"], "start", "end", ["flag"], mode=mode)
    found = Counter((r.member, r.start, r.end) for r in got.collect())
    expected = Counter()
    for m in {s[0] for s in stays}:
        spans = {}
        for row, number, _ in walk([s for s in stays if s[0] == m], mode):
            spans.setdefault(number, []).append(row)
        for members in spans.values():
            ends = [r[2] for r in members if r[2] is not None]
            expected[(m, min(r[1] for r in members), max(ends) if ends else None)] += 1
    assert found == expected
    # every flag is kept somewhere
    flagged = got.groupBy("member").agg(F.max("flag").alias("f")).collect()
    assert {(r.member, r.f) for r in flagged} == {(m, max(s[4] for s in stays if s[0] == m)) for m in {s[0] for s in stays}}


def test_touching_and_gap(spark):
    stays = [(1, day(0), day(2), 1, 0), (1, day(3), day(4), 2, 0), (1, day(6), day(7), 3, 0)]
    got = episodes.episodes(spark.createDataFrame(stays, SCHEMA), ["member"], "start", "end")
    assert {r.row: (r.episode, r.overlap) for r in got.collect()} == {
        1: (1, "1.First"), 2: (1, "3.Regular Overlap"), 3: (2, "2.New Episode")}


def test_lag_and_running_max_differ(spark):
    stays = [(1, day(0), day(29), 1, 0), (1, day(1), day(2), 2, 0), (1, day(9), day(11), 3, 0)]
    df = spark.createDataFrame(stays, SCHEMA)
    assert episodes.episode_rollup(df, ["member"], "start", "end").count() == 2
    assert episodes.episode_rollup(df, ["member"], "start", "end", mode="running_max").count() == 1
    assert episodes.stay_totals(df, ["member"], "start", "end", mode="running_max").first().stay_days == 29


def test_hot_interval_is_salted_and_whole(spark):
    stays = [(1, day(0), day(1), i, 0) for i in range(500)] + [(1, day(5), day(6), 1000, 0)]
    got = episodes.episodes(spark.createDataFrame(stays, SCHEMA), ["member"], "start", "end")
    assert Counter((r.episode, r.overlap) for r in got.collect()) == {
        (1, "1.First"): 1, (1, "7.Perfect Overlap"): 499, (2, "2.New Episode"): 1}
    report = {r.overlap: r.n for r in episodes.overlap_report(spark.createDataFrame(stays, SCHEMA), ["member"], "start", "end").collect()}
    assert report == {"1.First": 1, "7.Perfect Overlap": 499, "2.New Episode": 1}


def test_hierarchy_priorities(spark):
    cases = [
        (1, 0, 1, 0, 0), (2, 1, 0, 0, 0), (3, 1, 1, 1, 0), (4, 0, 0, 1, 1), (5, 0, 0, 1, 0), (6, 0, 0, 0, 0),
    ]
    df = spark.createDataFrame(cases, "id int, ip_avoid int, ip_other int, ed_avoid int, ed_other int")
    got = {r.id: r for r in hierarchy(df).collect()}
    assert (got[1].non_avoid_ip, got[1].avoid_ip, got[1].all_cause_ip) == (1, 0, 1)
    assert (got[2].avoid_ip, got[2].avoid_acute) == (1, 1)
    assert (got[3].non_avoid_ip, got[3].avoid_ip, got[3].avoid_ed, got[3].avoid_acute) == (1, 0, 0, 0)
    assert (got[4].non_avoid_ed, got[4].avoid_ed, got[4].all_cause_ed) == (1, 0, 1)
    assert (got[5].avoid_ed, got[5].all_cause_acute) == (1, 1)
    assert got[6].all_cause_acute == 0


def test_hierarchy_merges_ed_into_stay(spark):
    rows = [(1, day(0), day(3), 0, 1, 0, 0), (1, day(3), day(3), 1, 0, 1, 0)]
    schema = "member int, start date, end date, ed_visit int, inpatient_visit int, avoidable_ed int, avoidable_ip int"
    got = acute_hierarchy(spark.createDataFrame(rows, schema), ["member"], "start", "end").collect()
    assert len(got) == 1 and got[0].non_avoid_ip == 1 and got[0].all_cause_ed == 0
