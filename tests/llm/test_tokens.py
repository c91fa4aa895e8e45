"""Token shards, token counts, byte-pair encoding."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkweave.llm import bpe, chunks, storage, token_counts, token_output
from linkweave.llm.elias_fano import EliasFano


@pytest.fixture(scope="module")
def library(bpe_file):
    return Tokenizer.from_file(bpe_file)


@pytest.fixture(scope="module")
def encoder(bpe_file):
    with open(bpe_file) as f:
        return bpe.Encoder(f.read())


@given(st.lists(st.integers(0, 1 << 40)))
def test_elias_fano_gives_back_its_values(values):
    values.sort()
    ef = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert ef.values().tolist() == values and [ef.select(i) for i in range(len(ef))] == values
    for i in range(0, len(values) + 1, 7):
        for j in range(i, len(values) + 1, 5):
            assert ef.values(i, j).tolist() == values[i:j]
    for v in (0, *values[::9], 1 << 41):
        assert ef.above(v) == sum(x <= v for x in values)


def test_elias_fano_of_many_and_uneven_values():
    rng = np.random.default_rng(0)
    for values in (np.sort(rng.integers(0, 1 << 40, 200_000)), np.sort(np.concatenate([rng.integers(0, 9, 3000), [1 << 50]])), np.zeros(1000, np.int64), np.arange(70_001)):
        data = EliasFano.of(values).to_bytes()
        ef = EliasFano.from_bytes(data)
        assert (ef.values() == values).all()
        for i in rng.integers(0, len(values), 200).tolist():
            assert ef.select(i) == values[i] and ef.above(int(values[i])) == np.searchsorted(values, values[i], side="right")


def test_elias_fano_is_small_and_ordered():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert len(EliasFano.of(ends).to_bytes()) < 10_000 * 13 / 8
    with pytest.raises(ValueError, match="decrease"):
        EliasFano.of(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.of(ends).select(10_000)


@settings(deadline=None, max_examples=300)
@given(st.text())
def test_encoder_equals_the_library(library, encoder, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert encoder.ids(text).tolist() == ids
    assert bpe.Decoder(encoder.vocabulary).text(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_encoder_on_hard_texts(library, encoder):
    random.seed(0)
    texts = ["a" * 3000, "ab" * 999, "<|endoftext|>", " <|endoftext|>  x<|endoftext|>", "a  b", "a\n b  c ", "\x1c a", " ' s 's don't"]
    texts += ["".join(random.choice("abetns '\n\t1é ") for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert encoder.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_round_trip_digests(spark, documents, nothing, library, bpe_file):
    want = []
    for r in documents.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip_digests(documents, bpe_file).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.round_trip_digests(nothing, bpe_file).count() == 0
    e = {r.doc_id: r.ids for r in bpe.encoded(documents.filter("doc_id in (2, 4)"), bpe_file).collect()}
    assert e == {2: [], 4: library.encode("one").ids}


def test_gather():
    blob, offsets = bpe.table_of([b"a", b"", b"bcd"])
    assert bpe.gather(blob, offsets, np.array([2, 1, 0, 2]))[0] == b"bcdabcd"


def test_other_rules_are_refused(bpe_file):
    with open(bpe_file) as f:
        meant = json.loads(f.read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": meant["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": meant["model"] | {"byte_fallback": True}}, {"added_tokens": [meant["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="the tokenizer has"):
            chunks.require_byte_level(json.dumps(meant | change))
    chunks.require_byte_level(json.dumps(meant))


@pytest.mark.parametrize("shard_docs", [1 << 18, 2])
def test_token_shards(spark, documents, nothing, library, bpe_file, shard_docs, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(token_output, "ShardWriter", type("Writer", (token_output.ShardWriter,), {"full": lambda self: len(self.ends) >= shard_docs}))
    docs = documents.orderBy("doc_id", F.xxhash64("text"), "text").collect()
    start, want = 0, []
    for r in docs:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder = storage.new_path(spark, "test-ids")
    manifest = token_output.write_shards(documents, bpe_file, folder)
    got = token_output.read_shards(manifest).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    one = token_output.Shard(manifest.orderBy("part", "piece").first().path)
    assert one.doc_id(0) is None and one.document(0).tolist()[-1] == 0 and one.doc_ids(0, 2) == [None, 0]
    one.close()
    assert token_output.token_output(nothing, bpe_file).count() == 0


def test_token_counts(spark, documents, nothing, bpe_file):
    with open(bpe_file) as f:
        vocabulary = bpe.Vocabulary(f.read())
    known = set(vocabulary.bytes) - {b"<|endoftext|>"}

    def greedy(word):
        n = 0
        while word:
            word = word[next(k for k in range(len(word), 0, -1) if word[:k] in known) :]
            n += 1
        return n

    want = []
    for r in documents.collect():
        words = (r.text or "").encode().split()
        sizes = {w: greedy(b" " + w) for w in set(words)}
        want.append((r.doc_id, len(words), sum(sizes[w] for w in words)))
    assert sorted(map(tuple, token_counts.token_counts(documents, bpe_file).collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(nothing, bpe_file).count() == 0


@given(st.lists(st.binary(min_size=1, max_size=4), max_size=20), st.binary(max_size=30))
def test_longest_match_of_any_vocabulary(tokens, data):
    tokens = {t for t in tokens}
    n, rest, ok = 0, data, True
    while rest and ok:
        k = next((k for k in range(len(rest), 0, -1) if rest[:k] in tokens), 0)
        ok, rest, n = bool(k), rest[k:], n + 1
    assert token_counts.LongestMatch(tokens).count(data) == (n if ok else 1)
