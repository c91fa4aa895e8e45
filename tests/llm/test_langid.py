"""Language mixtures against a version in plain Python and double precision."""

import math
import zlib

import pytest

from linkweave.llm import langid

SF = "/root/testdata/sf0.001"


def words_of(text):
    """Buckets of the letters of each word: a letter with its neighbours, mixed in 32 bits."""
    chars, out = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()], []
    for i, c in enumerate(chars):
        if not c:
            continue
        before, after = (chars[i - 1] if i else 0), (chars[i + 1] if i + 1 < len(chars) else 0)
        m = (before * 0x9E3779B1 & 0xFFFFFFFF) ^ (c * 0x85EBCA77 & 0xFFFFFFFF) ^ (after * 0xC2B2AE3D & 0xFFFFFFFF)
        m = (m ^ m >> 15) * 0x27D4EB2F & 0xFFFFFFFF
        if not before:
            out.append([])
        out[-1].append(m >> 17)
    return out


def model_of(rows):
    """Language to the log-likelihood of each bucket, of ``(doc_id, text, lang)``; few enough that all are fitted."""
    counts = {}
    for doc_id, text, lang in rows:
        if doc_id is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 5:
            own = counts.setdefault(lang, {})
            for w in words_of(text):
                for b in w:
                    own[b] = own.get(b, 0) + 1
    whole = {x: sum(c.values()) + 0.2 * (1 << 15) for x, c in counts.items()}
    return {x: (lambda b, c=counts[x], n=whole[x]: math.log((0.2 + c.get(b, 0)) / n)) for x in sorted(counts)}


def mixture(ll, names, shares, rounds):
    total = 0.0
    for _ in range(rounds):
        sums, total = dict.fromkeys(names, 0.0), 0.0
        for w in ll:
            top = max(w.values())
            each = {x: shares[x] * math.exp(w[x] - top) for x in names}
            of_word = max(sum(each.values()), 1e-30)
            total += math.log(of_word) + top
            for x in names:
                sums[x] += each[x] / of_word
        shares = {x: v / len(ll) for x, v in sums.items()}
    return shares, total


def brute(text, model):
    """(language, score) of one text."""
    names = list(model)
    ll = [{x: sum(map(model[x], w)) for x in names} for w in words_of(text)]
    if not ll or not names:
        return "und", 0.0
    alone = {x: sum(w[x] for w in ll) for x in names}
    best = max(names, key=lambda x: alone[x])
    found, shares = alone[best], {best: 1.0}
    certainty = 1 / sum(math.exp(alone[x] - found) for x in names)
    cost = 6.0 * math.log(len(ll) + 1.0)
    if len(names) > 1 and sum(max(w.values()) for w in ll) - found > cost:
        full, _ = mixture(ll, names, dict.fromkeys(names, 1 / len(names)), 6)
        order = sorted(names, key=lambda x: -full[x])
        for size in range(2, min(4, len(names)) + 1):
            picked = order[:size]
            start = {x: max(full[x], 1e-3) for x in picked}
            got, total = mixture([{x: w[x] for x in picked} for w in ll], picked, {x: v / sum(start.values()) for x, v in start.items()}, 4)
            if total - (size - 1) * cost > found:
                found, shares, certainty = total - (size - 1) * cost, got, 1.0
    top = max(names, key=lambda x: shares.get(x, 0.0))
    return top, min(1.0, shares[top] * certainty)


def test_predictions_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    model = model_of(rows)
    mixed = [(i, a[1][:400] + " " + b[1][:300], None) for i, (a, b) in enumerate(zip(rows[:60], rows[60:120], strict=True), 100_000) if a[1] and b[1]]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in langid.languages(both).collect()}
    assert len(got) == len(rows) + len(mixed)
    for doc_id, text, _ in rows + mixed:
        lang, score = brute(text, model)
        assert got[doc_id][0] == lang and got[doc_id][1] == pytest.approx(score, abs=2e-3)
        assert got[doc_id][2] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "text", f"l{i % 7}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs)
