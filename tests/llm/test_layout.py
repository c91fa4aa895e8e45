"""WARC archives, shards, packing, and the pipeline."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkweave.llm import packing, storage, warc


def pages(spark):
    big = "<html>" + "é" * 600 + "</html>"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "u\r\nX: y", None), (6, "z", ""), (None, "n", big), (7, "z", big + "x"), (7, "z", big + "x"), (8, "gz", "\x1f\x8b\x08 WARC/1.1 " * 200), (9, "l", "long " * 400_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as record_type", "'q' as digest")


@pytest.mark.parametrize("split", [997, 1 << 20])
def test_archives_give_back_all_pages(spark, split):
    df = pages(spark)
    manifest = warc.write_archives(df, storage.new_path(spark, "test-warc"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest, split).collect()]
    rows = df.collect()
    best = {}
    for r in rows:
        if r.page_id is not None and len((r.html or "").encode()) >= 1000:
            best[r.html] = max(best.get(r.html, r.page_id), r.page_id)
    want = []
    for r in rows:
        data = (r.html or "").encode()
        to = best.get(r.html)
        refers = to if to is not None and to != r.page_id else None
        want.append((r.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_pages(spark):
    manifest = warc.write_archives(pages(spark).limit(0), storage.new_path(spark, "test-warc"))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_a_lost_record_is_an_error(spark, tmp_path):
    """A damaged member, and a cut file."""
    for spoil in (lambda b: b[:700] + bytes(40) + b[740:], lambda b: b[: len(b) // 2]):
        manifest = warc.write_archives(pages(spark).repartition(1), storage.new_path(spark, "test-warc"))
        path = manifest.first().path.removeprefix("file://")
        with open(path, "rb") as f:
            data = f.read()
        with open(path, "wb") as f:
            f.write(spoil(data))
        with pytest.raises(ValueError, match="records they should"):
            warc.read_archives(manifest)


def test_reader_skips_what_is_no_record(tmp_path):
    one = warc.record(1, "u", b"x" * 3000, hashlib.sha1(b"x" * 3000).hexdigest(), None)
    junk = b"\x1f\x8b\x08junk" + zlib.compress(b"no")
    p = tmp_path / "a.warc.gz"
    p.write_bytes(junk + one + junk + one)
    found = [o for a in range(0, p.stat().st_size, 50) for o, _ in warc.RangeReader(p.as_uri(), a, a + 50).records()]
    assert found == [len(junk), 2 * len(junk) + len(one)]


def brute_pack(pieces, capacity):
    bins, clock = [], 0
    for length, source, cluster in pieces:
        fit = [b for b in bins if b["room"] >= max(length, 1) and not (source >= 0 and source in b["s"]) and not (cluster >= 0 and cluster in b["c"])]
        b = min(fit, key=lambda b: (b["room"], b["t"]), default=None)
        if b is None:
            b = {"room": capacity, "s": set(), "c": set(), "t": 0, "n": len(bins)}
            bins.append(b)
        clock += 1
        b["room"] -= length
        b["t"] = clock
        b["s"].add(source)
        b["c"].add(cluster)
        yield b["n"]


@settings(deadline=None, max_examples=200)
@given(st.sampled_from([1, 7, 50, 9000]), st.lists(st.tuples(st.integers(0, 9000), st.integers(-1, 5), st.integers(-1, 3)), max_size=80))
def test_bins_are_the_tightest(capacity, pieces):
    pieces = sorted(((n % capacity, s, c) for n, s, c in pieces), reverse=True)
    assert packing.pack(pieces, capacity) == list(brute_pack(pieces, capacity))


def test_packing_of_all_cases(spark, documents, nothing):
    out = packing.packed(packing.by_text(documents), capacity=100)
    rows = out.collect()
    bins = {}
    for r in rows:
        bins.setdefault((r.part, r.bin), []).append(r)
        assert 0 <= r.length <= 100
    for own in bins.values():
        assert sum(r.length for r in own) <= 100
        at = 0
        for r in sorted(own, key=lambda r: (r.place, r.length)):
            assert r.place == at
            at += r.length
    assert sum(r.length for r in rows) == sum(len((r.text or "").encode()) + 1 for r in documents.collect())
    assert packing.packed(packing.by_text(nothing)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None), (None, 5, "a", 1), (2, 0, "a", 1), (3, 5, "a", 2)], "doc_id long, length long, source string, cluster long")
    got = {r.doc_id: r.bin for r in packing.packed(odd, 10).collect()}
    assert len(got) == 4 and len({got[None], got[3], got[2]}) == 3


@pytest.mark.parametrize("part", [3, 20_000])
def test_near_copies_and_sources_never_share_a_bin(spark, part):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words + (["x"] if i % 2 else [])), f"s{i % 40}", 0) for i in range(40)] + [(100 + i, f"other text {i}", f"s{i % 5}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    near = packing.by_near_text(docs)
    cluster = {r.doc_id: r.cluster for r in near.collect()}
    assert len({cluster[i] for i in range(40)}) == 1
    bins = {}
    for r in packing.packed(near, 2000, part=part).collect():
        bins.setdefault((r.part, r.bin), []).append(r.doc_id)
    source = {r[0]: r[2] for r in rows}
    for own in bins.values():
        assert len({source[i] for i in own}) == len(own) and len({cluster[i] for i in own}) == len(own)
    assert sum(map(len, bins.values())) == len(rows)


def test_pipeline(spark, documents, nothing):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_dedup", "best_fit_packing"]
    for start in (documents, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs.count(), storage.written(stage(spark, docs, ""), name)
            assert docs.columns == start.columns and docs.count() <= before
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.select("doc_id").distinct().count() <= 200
