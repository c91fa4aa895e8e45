"""SimHash fingerprints, links, components, and the pipeline's stage."""

import re

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from linkweave.llm import components, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius):
    """Smallest index reachable of each value."""
    to = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= radius:
                    to[i] = min(to[i], to[j])
    return to


@given(st.text(alphabet="aBÉ \t\n\x0b \x1c", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == brute_fingerprint(text, 4)


def test_bit_counts_of_many():
    h = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert simhash.bit_counts(h).tolist() == [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(1)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        base = int(rng.integers(0, 1 << 63)) * 2
        for flips in (0, 1, 2, 3, 4, 5, 8):
            values.add(base ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = {r.fp: r["class"] for r in simhash.classes(df, 4).collect()}
    want = brute_components(values, 4)
    groups = {}
    for v, c in zip(values, want, strict=True):
        groups.setdefault(c, set()).add(simhash._signed(v))
    for members in groups.values():
        if len(members) == 1:
            assert not members & set(got)
        else:
            assert {got[m] for m in members} == {min(members)}


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(300)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, documents, nothing):
    rows = documents.collect()
    prints = [brute_fingerprint(r.text, 4) for r in rows]
    reach = brute_components(prints, 4)
    least = {}
    for r, c in zip(rows, reach, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, reach, strict=True)), key=repr)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents).collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_of_each_group_stays(spark, documents, nothing):
    kept = simhash.without_near_duplicates(documents, 4, 4)
    assert kept.columns == documents.columns
    rows = documents.collect()
    reach = brute_components([brute_fingerprint(r.text, 4) for r in rows], 4)
    assert kept.count() == len(set(reach))
    assert kept.filter("doc_id = 0").count() == 1 and kept.filter("doc_id in (20)").count() == 0
    assert simhash.without_near_duplicates(nothing, 4, 4).count() == 0
