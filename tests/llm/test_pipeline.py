"""The whole pipeline against brute force: plain-Python language mixtures, counts, limits, similarities and packing."""

import corpus_pipeline

from linkweave.llm import packing

from .test_jaccard import brute_kept
from .test_langid import brute, model_of
from .test_layout import brute_pack
from .test_text_rules import brute_bucket, brute_counts, brute_limits

SF = "/root/testdata/sf0.001"


def fit_for_language(rows):
    model = model_of([(r.doc_id, r.text, r.lang) for r in rows])
    return [r for r in rows if (found := brute(r.text, model))[0] != "und" and found[1] >= corpus_pipeline.LEAST_SHARE]


def fit_by_rules(rows):
    values, ok = {}, {}
    for r in rows:
        n, chars, symbols, dup, rep = brute_counts(r.text)
        lines = len([x for x in (r.text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")])
        if n >= 1 and 100 * rep <= 50 * n:
            ok[r.doc_id] = {"mean_length": brute_bucket(100 * (chars + 40) // (n + 8)), "symbols": brute_bucket(1000 * symbols // (chars + 200)), "dup_lines": brute_bucket(1000 * dup // (lines + 2)), "repeats": brute_bucket(1000 * rep // (n + 20))}
            for k, v in ok[r.doc_id].items():
                values.setdefault(((r.lang, r.source), k), []).append(v)
    limits = brute_limits(values)
    inside = lambda group, k, v: v <= limits[group, k][1] and (k != "mean_length" or v >= limits[group, k][0])
    return [r for r in rows if r.doc_id in ok and all(inside((r.lang, r.source), k, v) for k, v in ok[r.doc_id].items())]


def packed(rows, capacity):
    """(doc_id, piece, start, length, bin, place) of one part."""
    docs = sorted(((-len((r.text or "").encode()) - 1, r.doc_id, r.source) for r in rows), key=lambda x: x[:2])
    whole, loose = [], []
    for size, doc_id, source in docs:
        full, rest = divmod(-size, capacity)
        whole += [(doc_id, i, i * capacity, capacity) for i in range(full)]
        if rest or not full:
            loose.append((doc_id, full, full * capacity, rest, source))
    loose.sort(key=lambda x: -x[3])
    codes = {}
    bins = list(brute_pack([(x[3], -1 if x[4] is None else codes.setdefault(x[4], len(codes)), -1) for x in loose], capacity))
    out, at = [], {}
    for x, b in zip(loose, bins, strict=True):
        out.append((*x[:4], b, at.get(b, 0)))
        at[b] = at.get(b, 0) + x[3]
    used = max(bins, default=-1) + 1
    return out + [(*x, used + i, 0) for i, x in enumerate(whole)]


def test_pipeline_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    some = fit_by_rules(fit_for_language(rows))
    stay = brute_kept([(r.doc_id, r.text) for r in sorted(some, key=lambda r: r.doc_id)], corpus_pipeline.WORDS)
    assert 0 < len(stay) < len(some) < len(rows)
    want = packed([r for r in some if r.doc_id in stay], packing.CAPACITY)
    got = [(r.doc_id, r.piece, r.start, r.length, r.bin, r.place) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_all_cases(spark, documents, nothing):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names; and no rows."""
    named = documents.withColumns({c: documents["doc_id"] for c in ("row", "file", "c0", "t", "counts", "kept_", "h", "place")})
    docs = named
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == named.columns
        assert after.exceptAll(docs).count() == 0  # whole rows of its input
        docs = after
    assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
    empty = nothing
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0
