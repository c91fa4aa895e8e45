"""The plan with both trained models, retrieval in tiles, shards that resume, tables and paths."""

import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators import blocking as B
from linkweave.operators import evaluation as E
from linkweave.operators import features as FE
from linkweave.operators import models as M
from linkweave.operators import retrieval
from linkweave.operators.sampling import stratified_split
from linkweave.plans import measures, shards
from linkweave.plans.link import LinkConfig, link
from linkweave.plans.queries import Plan
from linkweave.sources import paths, sinks
from linkweave.sources import records as RE

SF = "/root/testdata/sf0.001"


def by_score(pairs):
    """Rows of each record from the best on, ties to the smaller id."""
    out = {}
    for s, t, score in sorted(pairs, key=lambda x: (-x[2], x[1])):
        out.setdefault(s, []).append((t, score))
    return out


def test_link_with_models_equals_brute_force(spark):
    p = Plan(spark, SF)
    ranker = M.ranker(list(FE.ranker_features()), rounds=3).fit(measures._ranker_data(p))
    matcher = M.matcher(list(FE.matcher_features()), rounds=3).fit(measures._matcher_data(p))
    got = {(r.s1_id, r.tid): r.score for r in link(p.rec, LinkConfig(budget=7), ranker, matcher).collect()}
    ranked = by_score((r.s1_id, r.tid, r.score) for r in ranker.score(FE.vectors(p.pair, FE.ranker_features())).collect())
    first = [(s, t, score, n + 1) for s, own in ranked.items() for n, (t, score) in enumerate(own[:7])]
    chosen = spark.createDataFrame(first, "s1_id string, tid string, ranker_score double, ranker_rank int")
    scored = matcher.score(FE.vectors(p.pair.join(chosen, ["s1_id", "tid"]), FE.matcher_features()))
    claims = []
    for s, own in by_score((r.s1_id, r.tid, r.score) for r in scored.collect()).items():
        top = own[0][1]
        claims += [(s, t, x) for t, x in own if top >= 0.7 and x >= max(0.7, top - 0.1)]
    best = {}
    for s, t, x in claims:
        if t not in best or (-x, s) < (-best[t][1], best[t][0]):
            best[t] = (s, x)
    want = {(s, t): x for t, (s, x) in best.items()}
    assert got.keys() == want.keys() and got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("top", [None, 4])
def test_retrieval_in_tiles_equals_brute_force(spark, top, monkeypatch):
    for name, value in (("TARGET_TILE", 13), ("QUERY_TILE", 7), ("TASKS", 5)):
        monkeypatch.setattr(retrieval, name, value)
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(0, 9)))
    queries, targets = [(f"S1-{i:03d}", word()) for i in range(40)], [(f"S2-{i:03d}", word()) for i in range(60)]
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= 3 else {t} - {""}
    import math

    held = {i: grams(t) for i, t in targets if grams(t)}
    df = {}
    for g in held.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    want = set()
    for q, text in queries:
        found = []
        for t, g in held.items():
            both = [x for x in grams(text) & g if df[x] <= 9]
            if both:
                found.append((-round(sum(math.log1p(len(held) / df[x]) for x in both), 9), t, len(both), len(grams(text)), len(g)))
        want |= {(q, t, -s, n, a, b) for s, t, n, a, b in sorted(found)[:top]}
    asked = B.ngram_overlaps(spark.createDataFrame(queries, "s1_id string, text string"), spark.createDataFrame(targets, "tid string, text string"), 9, top=top)
    got = {(x.s1_id, x.tid, round(x.score, 9), x.overlap, x.q_grams, x.t_grams) for x in asked.collect()}
    assert {(q, t, round(s, 8), n, a, b) for q, t, s, n, a, b in got} == {(q, t, round(s, 8), n, a, b) for q, t, s, n, a, b in want}


def test_no_targets_and_no_queries(spark):
    some, none = spark.createDataFrame([("S1-1", "abcd")], "s1_id string, text string"), spark.createDataFrame([], "tid string, text string")
    assert B.ngram_overlaps(some, none, 9, top=3).count() == 0
    assert B.ngram_overlaps(some.limit(0), some.toDF("tid", "text"), 9).count() == 0


def test_shards_resume(spark):
    records = Plan(spark, SF).rec
    root = paths.new_path(spark, "resumed")
    assert shards.run_shards(records, root, 3) == [0, 1, 2]
    assert shards.run_shards(records, root, 3) == []
    path, system = paths._file_system(spark, f"{root}/shard=1/manifest")
    system.delete(path, True)
    assert shards.run_shards(records, root, 3) == [1]
    assert shards.run_shards(records, root, 3, LinkConfig(budget=9)) == [0, 1, 2]
    whole = link(records, LinkConfig(budget=9)).select("s1_id", "tid")
    got = shards.linked(spark, root, 3).select("s1_id", "tid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_split_has_the_quota_of_each_country(spark):
    rows = [(f"S1-{i:05d}", "en" if i % 3 else ("de" if i % 2 else None)) for i in range(3000)] + [("S1-x", "one")]
    df = spark.createDataFrame(rows, "entity_id string, country string")
    got = stratified_split(df, 100).collect()
    n = {}
    for r in got:
        n.setdefault(r.country, []).append(r.part)
    assert len(got) == 3001 and {c: p.count("val") for c, p in n.items()} == {"en": 67, "de": 17, None: 17, "one": 0}
    import hashlib

    first = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, c in rows if c == "en")[:67]
    assert {r.entity_id for r in got if r.country == "en" and r.part == "val"} == {i for _, i in first}


def test_curves_in_parts_equal_one_pass(spark):
    r = random.Random(2)
    rows = [(round(r.random(), 3), int(r.random() < 0.3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "score double, label int")
    a, b = (tuple(E.curves(df, parts).first()) for parts in (64, 2))
    assert all(abs(x - y) < 1e-6 for x, y in zip(a, b, strict=True)) and 0.4 < a[2] < 0.6


def test_quotes_come_back(spark):
    names = ['"quoted', 'a "b" c', '"', '""', '"whole"', "tab-free", "", "it's", 'ends"']
    df = spark.createDataFrame([(f"S1-{i}", n, "x", "en") for i, n in enumerate(names)], "entity_id string, business_name string, business_address string, country string")
    path = paths.new_path(spark, "quotes")
    sinks.write_table(df, path)
    for quoted_lines in (False, True):
        got = {r.entity_id: r.business_name for r in RE.read_table(spark, path, RE.RECORD_COLUMNS, quoted_lines=quoted_lines).collect()}
        assert got == {f"S1-{i}": n for i, n in enumerate(names)}


def test_a_quote_that_goes_on_is_an_error(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t\"two\nlines\"\tx\ten\n")
    with pytest.raises(Exception, match="not closed"):
        RE.read_table(spark, str(tmp_path / "t.tsv"), RE.RECORD_COLUMNS).collect()
    assert RE.read_table(spark, str(tmp_path / "t.tsv"), RE.RECORD_COLUMNS, quoted_lines=True).first().business_name == "two\nlines"


def test_scratch_tables_go(spark):
    with paths.scratch(spark):
        gone = paths.written(spark.range(3), "a")
        stays = paths.written(gone, "b", last=True)
    assert stays.count() == 3
    path, system = paths._file_system(spark, gone.inputFiles()[0])
    assert not system.exists(path)


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        paths.shared_folder(Session())
