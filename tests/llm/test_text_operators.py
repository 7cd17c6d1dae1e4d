"""Operators on documents against plain code, on edge rows and on the smallest tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from cohortlake.llm import decontaminate, lines, mixing, quality, simhash, substrings, toxicity
from cohortlake.llm.components import connected
from cohortlake.llm.words import winnowed

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, body string, fp int, starts string, score string, key int"
SMALL = "/root/testdata/sf0.001"


def words(seed, n, vocabulary=40):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def edge_texts():
    base, other = words(1, 120), words(2, 90)
    near = base[:60] + ["Changed"] + base[61:]
    texts = [
        None, "", "   \n\t ", "one", "Two words", " ".join(base), " ".join(base), "  ".join(base), " ".join(base).upper(),
        " ".join(near), " ".join(other), " ".join(other[:20] + base[10:80] + other[20:]), "same " * 200, "same " * 300, "a b " * 150,
        "a b " * 90, "a\x0bb c\u00a0d \u2003e", "x\n\n\n\n\ny", "l1\nl2\nl3\nl4", "l0\nl1\nl2\nl3\nl4\nl5", "l1\nl2\nl3", "\n\n\n", "l3\nl4\nl5\r",
        " ".join(words(3, 30_000, 3000)), "é ü ñ " * 40, " ".join(other[:13]), " ".join(other[:12]),
    ]
    return {i * 3: t for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def docs(spark):
    """Every edge text, with columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"src{i % 4}" if i % 5 else None, len(t or ""), "b", 1, "s", "x", 2) for i, t in edge_texts().items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def messy(docs):
    """The same, with repeated rows, a row without id, and another text under an id that exists."""
    return docs.union(docs.where("doc_id % 2 = 0")).union(
        docs.where("doc_id = 15").withColumn("doc_id", F.lit(None).cast("bigint"))
    ).union(docs.where("doc_id = 30").withColumn("doc_id", F.lit(12).cast("bigint")))


def as_map(df, *columns):
    return {r[0]: tuple(r[1:]) if len(columns) > 2 else r[1] for r in df.select(*columns).collect()}


# fingerprints

def test_fingerprints_and_components(docs):
    texts = edge_texts()
    got = as_map(simhash.near_duplicates(docs, leaf=4), "doc_id", "fp", "component_id")
    prints = {i: plain.fingerprint(t) for i, t in texts.items()}
    assert {i: v[0] % 2**64 for i, v in got.items()} == prints
    assert {i: v[1] for i, v in got.items()} == plain.components(prints)


def test_links_of_many_close_fingerprints(spark):
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(30)]
    prints = {i: centres[i % 30] ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) for i in range(1500)}
    prints = {v: k for k, v in prints.items()}
    prints = {k: v for v, k in prints.items()}
    signed = [(k, v - 2**64 if v >= 2**63 else v) for k, v in prints.items()]
    nodes = spark.createDataFrame(signed, "node bigint, fp bigint")
    for options in ({"leaf": 40}, {"leaf": 40, "sample": 300}, {"leaf": 5, "leaves": 16}):
        got = as_map(connected(simhash.links(nodes, **options)), "node", "component")
        assert {k: got.get(k, k) for k in prints} == plain.components(prints)


def test_a_chain_is_one_component(spark):
    links = spark.range(1, 400).selectExpr("id as a", "id - 1 as b").repartition(5)
    more = spark.sql("select explode(array(struct(900L, 901L), struct(901L, 900L), struct(7L, 7L), struct(null, 3L))) x").select("x.*").toDF("a", "b")
    got = as_map(connected(links.union(more)), "node", "component")
    assert got == {**{i: 0 for i in range(400)}, 900: 900, 901: 900}


def test_near_duplicates_keep_one(docs, messy, empty):
    kept = simhash.deduplicate(messy)
    assert kept.columns == messy.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    groups = plain.components({i: plain.fingerprint(t) for i, t in edge_texts().items()})
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert ids.count(None) == 1
    assert {r[0] for r in simhash.deduplicate(docs).select("doc_id").collect()} == set(groups.values())
    assert simhash.deduplicate(empty).count() == 0


# substrings

def test_substrings(docs):
    got = as_map(substrings.deduplicate(docs), "doc_id", "kept", "n_words", "n_removed")
    for i, (n, left) in plain.substrings(edge_texts(), 50).items():
        assert got[i] == (" ".join(left), n, n - len(left)), i


def test_substrings_of_messy_rows(messy, empty):
    rows = substrings.deduplicate(messy).collect()
    assert len(rows) == messy.count()
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0]
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] == 15)
    assert substrings.deduplicate(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.deduplicate(empty, window=10)


@pytest.mark.parametrize("seed", range(6))
def test_repeats_share_an_anchor(seed):
    """Whatever stands around it, each repeat of a window has an anchor of equal words at one of its places."""
    draw = random.Random(seed)
    vocabulary = draw.choice([1, 2, 3, 5, 1000])
    shared = [b"w%d" % draw.randrange(vocabulary) for _ in range(50)]
    around = lambda n: [b"w%d" % draw.randrange(vocabulary) for _ in range(n)]
    texts = [around(draw.randrange(60)) for _ in range(8)]
    starts = [len(t) for t in texts]
    chunk = substrings.Chunk([t + shared + around(draw.randrange(60)) for t in texts])
    at, keys = substrings.anchors(chunk)
    margin, longest = substrings.margin_and_cap()
    sets = []
    for i, start in enumerate(starts):
        low = chunk.offsets[i] + start
        inside = (at - margin >= low) & (at + margin + longest <= low + 50)
        sets.append({(int(a - low), int(k)) for a, k in zip(at[inside], keys[inside])})
    assert set.intersection(*sets)


# contamination

ITEMS = [(1, " ".join(words(2, 90))), (2, None), (3, ""), (4, "Two, WORDS!"), (5, " ".join(words(1, 120)[30:50])), (5, "one"), (None, "same same"), (6, "é ü")]


@pytest.mark.parametrize("bits", [decontaminate.SIEVE_BITS, 0])
def test_contamination(spark, docs, bits):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("extra", F.lit(1))
    found = decontaminate.contamination(docs, items, sieve_bits=bits)
    got = as_map(found, "doc_id", "n_words", "n_hit", "items", "contaminated")
    known = [(n, t) for n, t in ITEMS if n is not None]
    for i, text in edge_texts().items():
        n, hit, names, bad = plain.contamination(text, known)
        assert got[i] == (n, hit, names, bad), i
    clean = decontaminate.clean(docs, items, sieve_bits=bits)
    assert clean.columns == docs.columns
    assert {r[0] for r in clean.select("doc_id").collect()} == {i for i, v in got.items() if not v[3]}


def test_contamination_of_nothing(spark, docs, empty, messy):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(empty, none).count() == 0
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for bits in (decontaminate.SIEVE_BITS, 0):
        assert decontaminate.contamination(messy, items, sieve_bits=bits).count() == messy.count()


def test_contamination_with_a_full_sieve_and_a_hot_window(spark):
    """A bitmap far too small for the benchmark, and a passage that most documents and a third of the items hold."""
    shared, draw = words(5, 13, 4000), random.Random(6)
    items = [(i, " ".join((shared if i % 3 == 0 else []) + words(100 + i, 30, 4000))) for i in range(600)]
    texts = {
        j: " ".join(words(1000 + j, 20, 4000) + (shared if j % 4 else []) + words(100 + draw.randrange(600), 30, 4000)[j % 20 :] + words(j, 5, 9))
        for j in range(60)
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    got = as_map(decontaminate.contamination(frame, bench, sieve_bits=15), "doc_id", "n_words", "n_hit", "items", "contaminated")
    assert got == {j: plain.contamination(t, items) for j, t in texts.items()}
    assert any(len(v[2]) >= 200 for v in got.values())


def test_contamination_by_other_settings(spark, docs):
    """Spans as long as the k-gram, and stretches that touch without overlapping."""
    items = spark.createDataFrame([(1, "l1 l2"), (2, "l3 l4"), (3, "two words")], "item_id bigint, text string")
    found = as_map(decontaminate.contamination(docs, items, span=2, gram=2), "doc_id", "starts", "ends", "items")
    for i, text in edge_texts().items():
        starts, ends, names = found[i]
        assert sum(ends) - sum(starts) == plain.contamination(text, [(1, "l1 l2"), (2, "l3 l4"), (3, "two words")], 2)[1]
        assert all(e < s for e, s in zip(ends, starts[1:]))
    four = next(i for i, t in edge_texts().items() if t == "l1\nl2\nl3\nl4")
    assert found[four] == ([0], [4], ["1", "2"])
    with pytest.raises(ValueError):
        decontaminate.contamination(docs, items, span=2, gram=3)


def test_winnowing_keeps_one_in_every_stretch():
    draw = np.random.default_rng(3)
    for top in (2, 5, 10**9):
        values = draw.integers(0, top, 500).astype(np.uint64)
        kept = winnowed(values, 9)
        for i in range(492):
            stretch = slice(i, i + 9)
            assert kept[stretch][values[stretch] == values[stretch].min()].all()


# lines

def test_lines(docs, messy, empty):
    got = as_map(lines.deduplicate(docs, counts=True), "doc_id", "text", "n_lines", "n_removed")
    texts = edge_texts()
    for i, text in plain.lines(texts).items():
        whole = len(texts[i].split("\n")) if texts[i] is not None else 0
        gone = 0 if text == texts[i] else whole - (len(text.split("\n")) if text else 0)
        assert got[i] == (text, whole, gone), i
    out = lines.with_length(lines.deduplicate(messy))
    assert out.columns == messy.columns and out.count() == messy.count()
    assert out.where("text is not null and n_chars != length(text)").count() == 0
    assert lines.deduplicate(empty).count() == 0


def test_many_overlapping_windows(spark):
    block = [f"line {i}" for i in range(12)]
    texts = {1: "\n".join(block), 2: "\n".join(["new"] + block[:5] + ["mid"] + block[3:] + ["end"]), 3: "\n".join(block * 3), 4: "\n".join(["r"] * 9)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert as_map(lines.deduplicate(df), "doc_id", "text") == plain.lines(texts)


# mixing

def test_mix_follows_weights(spark):
    rows = [(i, "x" * (20 + i % 7), "big" if i % 3 else f"s{i % 2}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix(df, {"big": 0.25, "s0": 0.5, "gone": 0.3}, 0.25)
    sizes = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.length("text"))).collect()}
    whole = sum(len(r[1]) for r in rows)
    for name, share in (("big", 0.25), ("s0", 0.5), ("s1", 0.25)):
        assert abs(sizes[name] / whole - share) < 0.03
    again = mixing.mix(df.repartition(7), {"big": 0.25, "s0": 0.5, "gone": 0.3}, 0.25)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    places = [r["place"] for r in mixed.where("spark_partition_id() = 0").collect()]
    assert places == sorted(places)


def test_mix_of_edge_rows(docs, messy, empty):
    out = mixing.mix(messy, {"src1": 0.5}, 0.5)
    assert out.columns == [*messy.columns, "copy", "place"]
    assert mixing.mix(empty, {"src1": 0.5}, 0.5).count() == 0
    assert mixing.mix(docs.where("text is null or text = ''"), {"src1": 0.5}, 0.5).count() == 0
    clash = mixing.mix(docs.withColumn("Copy", F.lit("own")).withColumn("place", F.lit(1)).withColumn("place_", F.lit(2)), {}, 1.0)
    assert clash.columns[-5:] == ["Copy", "place", "place_", "copy_", "place__"]
    plainly = mixing.mix(docs, {}, 1.0).select("doc_id", "copy", "place").collect()
    assert sorted(map(tuple, clash.select("doc_id", "copy_", "place__").collect()), key=str) == sorted(map(tuple, plainly), key=str)


@pytest.mark.parametrize("mean", [0.0, 0.01, 1.3, 40.0, 900.0])
def test_poisson_levels(mean):
    levels = mixing.poisson_levels(mean)
    assert levels == sorted(levels)
    draws = np.random.default_rng(1).integers(0, 2**mixing.BITS, 40_000)
    counts = np.searchsorted(np.array(levels), draws, side="right")
    assert abs(counts.mean() - mean) < 0.03 + 0.03 * mean ** 0.5
    assert abs(counts.var() - mean) < 0.05 + 0.05 * mean


# classifiers

def junk(i):
    return " ".join(f"{w.upper()}!!" for w in words(i, 60, 30)) if i % 2 else " ".join([f"k{i}"] * 50)


@pytest.fixture(scope="module")
def graded(spark):
    rows = [(i, junk(i) if i % 4 == 0 or i % 7 == 1 else " ".join(words(i, 30 + i % 50, 300)) + ".\nNew line.", int(not (i % 4 == 0 or i % 7 == 1))) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, quality int")


def test_quality_held_out(spark, graded, docs, empty):
    labels = graded.select("doc_id", "quality").union(spark.sql("select 3L, null union all select null, 1 union all select 5L, 7"))
    got = quality.classify(graded.withColumn("score", F.lit("no")), labels).join(graded, "doc_id")
    assert got.count() == 400
    assert got.where("held_out and predicted != quality").count() <= 2
    assert got.where("score < 0 or score > 1 or (score >= 0.3) != (predicted = 1)").count() == 0
    model = quality.fit(graded, labels)
    assert quality.scores(docs, model).count() == docs.count()
    assert quality.scores(empty, model).count() == 0
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in quality.scores(docs, model).where("score >= 0.3").collect()}


def test_trees_descend_like_plain_code():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(500, len(quality.NAMES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < 0)).astype(float)
    trees = quality.Trees.fit(x, y, trees=20)
    for row, score in zip(x[:50], trees.score(x[:50])):
        raw = trees.base
        for feature, limit, value in zip(trees.feature, trees.limit, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            raw += value[node - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-12
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


def test_classifiers_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.classify(docs, none).collect()} == {0}
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.classify(docs, ones).where("score < 0.99").count() == 0


def test_trie_matches_by_edit_distance():
    terms = {"idiot": 5.0, "scum": 4.0, "worthless": 6.0, "pathetic": 7.0, "weakling": 3.0, "lowe*": 2.0, "despi*": 4.5, "idiom*": 1.0}
    lexicon = toxicity.Lexicon(terms, frozenset(["weaklings"]))
    draw = random.Random(4)
    stems = {t.removesuffix("*"): t for t in terms}
    for round_ in range(4000):
        word = list(draw.choice(list(stems)))
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word) + 1)
            word[at : at + draw.randrange(2)] = draw.choice(["", "x", "i", "s"])
        word = "".join(word) + draw.choice(["", "", "ung"])
        if not word:
            continue
        exact = max([terms.get(word, 0.0)] if word in terms else [w for t, w in terms.items() if t[-1] == "*" and word.startswith(t[:-1]) and len(word) >= 4] or [0.0])
        near = [
            w for t, w in terms.items() if toxicity.allowed(len(t.removesuffix("*"))) and min(
                plain.edits(part, t.removesuffix("*")) for part in ([word] if t[-1] != "*" else [word[:n] for n in range(len(word) + 1)])
            ) <= toxicity.allowed(len(t.removesuffix("*")))
        ]
        weight, wrong = lexicon.match(word)
        expected = exact or (0.0 if word == "weaklings" else max(near, default=0.0))
        assert weight == expected, word
        assert wrong == (not exact and word != "weaklings")
        if round_ % 1000 == 999:
            lexicon.automaton.clear()
    assert lexicon.match("loweiung") == (2.0, False)
    assert lexicon.match("weaklings") == (0.0, False) and lexicon.match("weaklinqs")[0] == 0.0
    assert lexicon.match("dspised") == (4.5, True)


def test_automaton_starts_anew_without_other_results(monkeypatch):
    terms = {"worthless": 6.0, "pathetic": 7.0, "despi*": 4.5}
    draw = random.Random(5)
    some = ["".join(draw.choice("aehiopstwrl") for _ in range(draw.randrange(3, 12))) for _ in range(500)] + ["worthles", "patetic", "despyce"]
    wide = toxicity.Automaton(terms)
    expected = [wide.best(w) for w in some]
    monkeypatch.setattr(toxicity, "STATES", 3)
    tight = toxicity.Automaton(terms)
    assert [tight.best(w) for w in some] == expected and expected[-3:] == [6.0, 7.0, 4.5]


def test_toxicity_held_out(spark, empty):
    bad = ["idiot", "moron", "scumbag", "worthless"]
    rows = []
    for i in range(600):
        body, toxic = words(i, 40, 400), int(i % 3 == 0)
        if toxic:
            for k in range(3):
                body.insert(7 * k + 3, bad[(i + k) % 4] if i % 6 else bad[(i + k) % 4].replace("o", "0", 1))
        elif i % 3 == 1 and i % 2:
            body.insert(5, f'"{bad[i % 4]}"')
        rows.append((i, " ".join(body), toxic))
    rows += [(1000, None, 0), (1001, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = toxicity.classify(df, df.select("doc_id", "toxic")).join(df.select("doc_id", "toxic"), "doc_id")
    assert got.count() == 602
    assert got.where("held_out").count() > 100
    assert got.where("held_out and predicted != toxic").count() <= 4
    assert toxicity.classify(empty, df.select("doc_id", "toxic")).count() == 0


def test_large_shards_are_split_by_a_tree_of_their_own(spark):
    """As many links as all pairs give, where the sample's tree has too few leaves; and far fewer comparisons."""
    draw = np.random.default_rng(11)
    centres = draw.integers(0, 2**64, 3000, np.uint64)
    flips = [np.uint64(1) << draw.integers(0, 64, 3000, np.uint64) for _ in range(3)]
    fps = np.unique(np.concatenate((centres, centres[:1500] ^ flips[0][:1500], centres[1500:] ^ flips[1][1500:] ^ flips[2][1500:])))
    parts = simhash.pieces(fps, 2, 64)
    assert len(np.unique(np.concatenate(parts))) == len(fps) and sum(len(p) ** 2 for p in parts) < len(fps) ** 2 / 4
    def components(pairs):
        parent = list(range(len(fps)))
        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        return [root(i) for i in range(len(fps))]
    wanted = components([(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2) if i < j])
    nodes = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.view(np.int64))], "node bigint, fp bigint").repartition(3)
    found = simhash.links(nodes, sample=256, leaf=32, leaves=4).collect()
    assert components([(r["a"], r["b"]) for r in found]) == wanted
