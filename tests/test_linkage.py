"""Blocking, ranking, decisions and measures on literal values."""

import pytest
from pyspark.sql import functions as F

from linkweave.functions.keys import with_profiles
from linkweave.operators import blocking as B
from linkweave.operators import decisions as D
from linkweave.operators import evaluation as E
from linkweave.operators import ranking as R
from linkweave.sources import records as RE

RECORDS = "entity_id string, business_name string, business_address string, country string"
SCORED = "s1_id string, tid string, score double"


def scored(spark, values, s1="S1-1"):
    return spark.createDataFrame([(s1, f"T{i + 1}", v) for i, v in enumerate(values)], SCORED)


def tids(df):
    return {r.tid for r in df.collect()}


def corpus(spark):
    rows = [("S2-1", "Starbucks Coffee", "100 Main St, Seattle", "US"), ("S3-2", "Starbucks Coffee Company", "100 Main Street, Seattle", "US"), ("S2-3", "Target Corporation", "7 Oak Ave, Dallas", "US"), ("S3-4", "Target Corp", "7 Oak Avenue, Dallas", "US"), ("S2-5", "Tata Consultancy Services", "12 MG Road, Mumbai", "India"), ("S2-6", "McDonalds", "9 Elm St, Austin", "US")]
    return with_profiles(spark.createDataFrame(rows, RECORDS))


def test_candidates_of_a_small_corpus(spark):
    q = with_profiles(spark.createDataFrame([("S1-1", "Starbucks Coffee Inc", "100 Main St, Seattle", "US"), ("S1-2", "Zzzz Qqqq", "", "US")], RECORDS))
    found = B.candidates(q, corpus(spark))
    assert {"S2-1", "S3-2"} <= tids(found) and found.count() == found.dropDuplicates(["s1_id", "tid"]).count()
    assert found.filter("s1_id = 'S1-2'").count() == 0
    assert found.filter("tid = 'S2-1'").first().channel_mask == 0b1111111


def test_bucket_cap(spark):
    index = spark.createDataFrame([(1, "k", f"S2-{i:02d}") for i in range(10)], "channel int, key string, tid string")
    assert tids(B.capped(index, 5)) == {f"S2-{i:02d}" for i in range(5)}
    assert B.size_statistics(index, 5).first().oversized == 1


def test_ngrams_over_the_cap_are_left_out(spark):
    t = spark.createDataFrame([("a", "abc xyz"), ("b", "abc klm"), ("c", "abc pqr"), ("d", "xyz unique")], "tid string, text string")
    q = lambda x: spark.createDataFrame([("q", x)], "s1_id string, text string")
    assert tids(B.ngram_overlaps(q("abc"), t, 2)) == set()
    assert tids(B.ngram_overlaps(q("xyz"), t, 2)) == {"a", "d"}


def test_rankings(spark):
    r = R.ranked(scored(spark, [0.95, 0.88, 0.40]))
    assert tids(R.above(r, 0.50)) == {"T1", "T2"} and tids(R.above(r, 0.20)) == {"T1", "T2", "T3"} and tids(R.above(r, 0.99)) == {"T1"}
    assert tids(R.near_top(r, 0.5)) == {"T1", "T2"} and tids(R.near_top(r, 0.3)) == {"T1", "T2", "T3"}
    assert [x.tid for x in R.ranked(spark.createDataFrame([("s", "b", 1.0), ("s", "a", 1.0)], SCORED)).orderBy("rank").collect()] == ["a", "b"]


def test_evidence_adds_a_first_with_one_channel(spark):
    r = R.ranked(spark.createDataFrame([("s", "T1", 0.9, 1), ("s", "T2", 0.8, 2), ("s", "T3", 0.7, 3), ("s", "T4", 0.6, 1)], SCORED + ", hits int"))
    assert tids(R.by_evidence(r, 2)) == {"T1", "T2", "T3"}
    assert tids(R.by_evidence(r, 4)) == {"T1", "T2", "T3", "T4"}
    assert tids(R.by_evidence(r, 2, most=1)) == {"T1", "T2"}


@pytest.mark.parametrize(("values", "want"), [([0.95, 0.88, 0.82, 0.72], {"T1", "T2"}), ([0.68, 0.65], set()), ([0.85, 0.71], {"T1"}), ([0.98, 0.96, 0.94, 0.91, 0.85], {"T1", "T2", "T3", "T4"})])
def test_margin_rule(spark, values, want):
    assert tids(D.decide(scored(spark, values))) == want


def test_other_rules(spark):
    s = scored(spark, [0.95, 0.90, 0.88])
    assert D.decide(s, margin=0.20, cap=2).count() == 2
    assert tids(D.decide(s, "top_1_or_none")) == {"T1"}
    assert tids(D.decide(scored(spark, [0.95, 0.80, 0.79]), "score_drop_elbow")) == {"T1"}
    assert tids(D.decide(scored(spark, [0.45, 0.44]), threshold=0.1)) == set()  # below the gate of singletons
    with pytest.raises(ValueError, match="unknown"):
        D.decide(s, "none")


def test_production_rule_looks_at_the_rankers_first(spark):
    s = scored(spark, [0.60, 0.99]).withColumn("ranker_rank", F.when(F.col("tid") == "T1", 1).otherwise(2))
    assert tids(D.decide_by_first_ranked(s)) == set()
    assert tids(D.decide_by_first_ranked(s.withColumn("ranker_rank", 3 - F.col("ranker_rank")))) == {"T2"}


def test_one_to_one(spark):
    c = spark.createDataFrame([("A", "T", 0.92), ("B", "T", 0.78)], SCORED)
    assert D.one_to_one(c).first().s1_id == "A" and D.conflicts(c).first().claims == 2


def measure(spark, true, pred):
    s1 = spark.createDataFrame([("s",)], "s1_id string")
    pairs = lambda x: spark.createDataFrame([("s", t) for t in x], "s1_id string, tid string")
    return E.scores(E.counts(s1, pairs(true), pairs(pred))).first()


def test_entity_scores(spark):
    r = measure(spark, ["S2-47", "S3-812"], ["S2-47", "S2-193", "S3-812"])
    assert (round(r.precision, 3), r.recall, round(r.f05, 3)) == (0.667, 1.0, 0.714)
    assert [measure(spark, *x).f05 for x in ([[], []], [[], ["a"]], [["a"], []])] == [1.0, 0.0, 0.0]
    assert round(measure(spark, ["a", "b"], ["a"]).f05, 6) == round(5 / 6, 6)


def test_truth_rules(spark):
    t = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-2", "S1-2"), ("X", ""), ("S1-3", "S2-1"), ("S1-3", "")], "source1_entity_id string, matched_entity_ids string")
    assert {(r[0], r[1]) for r in RE.truth_faults(t).collect()} == {("S1-1", "repeated_target"), ("S1-2", "source_as_target"), ("X", "bad_source_prefix"), ("S1-3", "repeated_source")}


def test_tables_are_checked(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tAcme\t1 Main St\tUS\nS1-2\tShort\n")
    assert [tuple(r) for r in RE.read_records(spark, str(p)).collect()] == [("S1-1", "Acme", "1 Main St", "US"), ("S1-2", "Short", "", "")]
    for text in ("id\tname\taddr\tcntry\n", "entity_id,business_name,business_address,country\n"):
        p.write_text(text)
        with pytest.raises(RE.InvalidTable):
            RE.read_records(spark, str(p))


def test_calibration_is_monotone(spark):
    from linkweave.operators.models import Calibrator

    df = spark.createDataFrame([(i / 50, int(i > 25)) for i in range(50)], "score double, label int")
    for kind in ("sigmoid", "isotonic"):
        out = [r.calibrated for r in Calibrator(kind).fit(df).apply(df).orderBy("score").collect()]
        assert all(a <= b + 1e-9 for a, b in zip(out, out[1:], strict=False))
