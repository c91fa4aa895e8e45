"""Near-duplicates of the pipeline's stage against brute force."""

import random

import corpus_pipeline
import pytest

from linkweave.llm import jaccard


def brute_kept(rows, words):
    """Ids of the rows that stay: the smallest of each component of pairs at 4/5 or more."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    to = list(range(len(rows)))
    def top(i):
        while to[i] != i:
            i = to[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * len(a | sets[j]) > 0:
                x, y = top(i), top(j)
                to[max(x, y)] = min(x, y)
    return {rows[i][0] for i in range(len(rows)) if to[i] == i}


@pytest.mark.parametrize("small", [512, 2])
def test_similar_texts_go_whatever_their_distance(spark, small, monkeypatch):
    """With families compared in one task, and with hubs and tiles."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "TILE_LEFT", 300)
    monkeypatch.setattr(jaccard, "TILE_RIGHT", 700)
    r = random.Random(5)
    rows = []
    for _ in range(30):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([5, 8, 60, 150]))]
        rows.append(" ".join(words))
        for changes in (0, 1, 2, 3, 4):
            other = list(words)
            for at in r.sample(range(len(other)), changes):
                other[at] = f"x{r.randrange(5000)}"
            rows.append(" ".join(other))
    rows += ["", None, "one", "one two", " ONE\ttwo "]
    # A chain: each is similar to the next, its ends are not.
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        chain[8 * i] = f"d{i}"
        rows.append(" ".join(chain))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows, 5)
    assert {x.doc_id for x in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == want


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies with up to 12 of 90 words changed: some are similar to the hub, some to others alone, many to none."""
    monkeypatch.setattr(jaccard, "SMALL", 20)
    r = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(260):
        other = list(base)
        for at in r.sample(range(90), r.randrange(1, 8)):
            other[at] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows, 5)
    assert 5 < len(want) < 255
    assert {x.doc_id for x in jaccard.without_near_duplicates(docs, 5).collect()} == want


def test_repeated_and_null_ids(spark, documents, nothing):
    kept = jaccard.without_near_duplicates(documents, 5)
    assert kept.columns == documents.columns
    texts = [r.text for r in documents.collect()]
    rows = list(enumerate(texts))
    assert kept.count() == len(brute_kept(rows, 5))
    assert jaccard.without_near_duplicates(nothing, 5).count() == 0


def test_balls_of_fingerprints_propose(spark, monkeypatch):
    """Without any MinHash band the texts that the balls tie are still compared, on their whole sets."""
    monkeypatch.setattr(jaccard, "band_keys", lambda found: jaccard.np.zeros(0, jaccard.np.uint64))
    base = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, " ".join(f"v{i}" for i in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == {1, 3}
