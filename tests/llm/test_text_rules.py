"""Language ID and quality rules."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.llm import langid, quality
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_quality_equals_sql(spark):
    compare(spark, connect("/root/testdata/sf0.01"), quality.query, quality.ORACLE, "/root/testdata/sf0.01")


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_of_all_cases(spark, documents, nothing):
    extra = spark.createDataFrame([(50, "a b c a b c\n\n#x\n#x\n x\x0b\x0cy z"), (51, "a a a a"), (52, "p q r s p q r t q r s")], "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    docs = documents.select(*extra.columns).unionByName(extra)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        c = brute_counts(r.text)
        want.append((r.doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want, key=repr)
    assert quality.quality(nothing).count() == 0
    assert quality.quality(documents).count() == documents.count()


def test_no_python_in_the_plan(spark, documents):
    for df in (quality.counted(documents), quality.limits(quality.sketch(quality.counted(documents))), quality.quality(documents), quality.good(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_columns_of_any_name_pass(spark, documents):
    named = documents.withColumns({c: F.lit(c) for c in ("row", "t", "words", "lines", "hashes", "sorted", "counts", "trimmed", "of_lang", "failed", "__lw_text", "__lw_counts")})
    out = quality.good(named, least_words=1)
    assert out.columns == named.columns
    assert out.exceptAll(named).count() == 0 and out.count() > 0


def brute_bucket(v):
    spare = max(0, v.bit_length() - 10)
    return v >> spare << spare


def brute_limits(ratios):
    """(least, most) by (group, ratio) of ``{(group, ratio): [bucket]}``, written apart from the operator."""
    def body(values, beyond):
        v, n = sorted(values), len(values)
        return [v[-(-n * p // 1000) - 1] for p in (beyond, 500, 1000 - beyond)]

    out = {}
    for (group, name), own in ratios.items():
        beyond = quality.BEYOND[name]
        every = [x for (_, r), v in ratios.items() if r == name for x in v]
        prior = 10_000 // beyond
        low, mid, high = ((len(own) * a + prior * b) // (len(own) + prior) for a, b in zip(body(own, beyond), body(every, beyond), strict=True))
        out[group, name] = (low - 3 * max(mid - low, 1), high + 3 * max(high - mid, 1))
    return out


def group_texts():
    """Three groups: plain prose, one where symbols are common and words long, and a small one."""
    rng = np.random.default_rng(0)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    prose = lambda: " ".join(word(5) for _ in range(80))
    code = lambda k: " ".join(word(12 + k % 5) + ("$" if i < k else "") for i in range(60))
    rows = [(i, prose(), "en", "s", 0) for i in range(300)] + [(1000 + i, code(i % 30), "en", "code", 0) for i in range(300)] + [(2000 + i, prose(), "de", "s", 0) for i in range(7)]
    rows += [(3000, prose().replace(" ", " # "), "en", "s", 0), (3001, code(25), "en", "s", 0), (3002, code(25), "en", "code", 0), (3003, " ".join(word(3) for _ in range(80)), "en", "code", 0), (3004, prose().replace(" ", " # "), "de", "s", 0)]
    rows += [(3005, "\n".join([prose()] + ["same line"] * 30), "en", "s", 0), (3006, " ".join(word(40) for _ in range(90)), "en", "code", 0)]
    return rows


def test_limits_equal_brute_force_and_follow_their_group(spark):
    docs = spark.createDataFrame(group_texts(), "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for r in docs.collect():
        n, chars, symbols, dup, rep = brute_counts(r.text)
        lines = len([x for x in r.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")])
        if n >= 50 and 100 * rep <= 50 * n:
            for name, v in (("mean_length", 100 * (chars + 40) // (n + 8)), ("symbols", 1000 * symbols // (chars + 200)), ("dup_lines", 1000 * dup // (lines + 2)), ("repeats", 1000 * rep // (n + 20))):
                seen.setdefault(((r.lang, r.source), name), []).append((r.doc_id, brute_bucket(v)))
    limits = brute_limits({k: [b for _, b in v] for k, v in seen.items()})
    got = {((r.lang, r.source), r.ratio): (r.least, r.most) for r in quality.limits(quality.sketch(quality.counted(docs))).collect()}
    assert got == limits
    plain, code = (("en", "s"), ("en", "code"))
    assert limits[plain, "symbols"][1] < limits[code, "symbols"][1] and limits[plain, "mean_length"][1] < limits[code, "mean_length"][1]
    kept = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    fails = {i for (group, name), v in seen.items() for i, b in v if b > limits[group, name][1] or (name == "mean_length" and b < limits[group, name][0])}
    assert {i for i, k in kept.items() if not k} == fails | {i for i in kept if i not in {j for v in seen.values() for j, _ in v}}
    # The same text is fit for one group and not for another; every ratio rejects by its own group's sketch.
    assert not kept[3000] and not kept[3001] and kept[3002] and not kept[3003] and not kept[3004] and not kept[3005] and not kept[3006]
    assert all(kept[i] for i in kept if i < 3000)


def test_buckets_have_no_ceiling(spark):
    values = [0, 1, 1023, 1024, 1025, 2047, 2048, 2051, 123_456_789, 1 << 50]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket(F.col("v"))).collect()]
    assert got == [0, 1, 1023, 1024, 1024, 2046, 2048, 2048, brute_bucket(123_456_789), 1 << 50]


@pytest.fixture(scope="module")
def predicted(spark):
    return langid.languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()


def test_held_out_accuracy(spark, predicted):
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = predicted.merge(truth, on="doc_id")
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.98
    assert both.score.between(0, 1).all()


def test_shares_of_a_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = {lang: docs.filter(f"lang = '{lang}' and n_chars between 3000 and 9000").orderBy("doc_id").first().text[:3000] for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, long["en"] + " " + long["de"], None), (2, long["de"], None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["__lw_shares"] for r in langid.predicted(mixed, langid.fit(docs), ["doc_id"]).collect()}
    assert set(got[2]) == {"de"} and set(got[1]) == {"en", "de"} and min(got[1].values()) > 0.25


def test_languages_of_all_cases(spark, documents, nothing):
    got = langid.languages(documents).collect()
    assert len(got) == documents.count()
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.languages(nothing).count() == 0
    unlabelled = langid.languages(documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_long_texts_are_cut_at_blanks():
    text = "ab cde " * 50
    parts = list(langid.pieces(text, 17))
    assert "".join(parts) == text and max(map(len, parts)) <= 17
    table = np.random.default_rng(0).normal(size=(langid.BUCKETS, 2)).astype(np.float32)
    whole, cut = langid.word_likelihoods(text, table), np.concatenate([langid.word_likelihoods(p, table) for p in parts])
    assert np.allclose(whole, cut, atol=1e-4)
