"""Language shares of documents: a mixture fitted to each by expectation-maximisation.

Model: for each language, the likelihood of a letter with its neighbours (hashed to a
fixed number of buckets; what is no letter is a blank), learned from labelled texts.  A
word's likelihood in a language is the product over its letters.

Inference: a document's words come from a mixture of languages, whose shares
expectation-maximisation estimates.  Nested sets of the languages with the largest
shares are then fitted alone, and the set with the largest log-likelihood less
``PENALTY * ln(words)`` for each language after the first is selected.  The prediction
is the language with the largest share in it.

Fitting takes at most about ``FIT_ROWS`` texts of each language, chosen by a hash of
their ids (all texts, if there are fewer); whole texts are counted where they lie, and
only counts are shuffled.  What is collected is ``BUCKETS`` numbers a language, however
many documents there are.  Every whole text is predicted.

Defined results: `und` with score 0 for a null text, one without a letter, and for all
if nothing is labelled; ties go to the language first in alphabetical order; a null
doc_id is not held out and not learned from; every row gives one row; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

#: Texts of a language that fitting takes, about.
FIT_ROWS = 4000
BUCKETS = 1 << 15
SMOOTHING = 0.2
PENALTY = 6.0
#: Rounds of expectation-maximisation over all languages, and over a nested set.
ROUNDS, NESTED_ROUNDS = 6, 4
#: Languages of a set at most.
SET = 4
#: Code points handled at once, and words fitted at once.
SLICE, WORDS = 1_000_000, 300_000
#: Languages at most: their table (BUCKETS numbers each) is held by the driver and by every worker.
MOST_LANGUAGES = 1000
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once for each process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letter_buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each letter with its neighbours, and the places where words begin."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    padded = np.zeros(len(points) + 2, np.uint32)
    padded[1:-1] = np.where(is_letter, points, 0)
    at = np.flatnonzero(is_letter)
    mixed = padded[at] * np.uint32(0x9E3779B1) ^ padded[at + 1] * np.uint32(0x85EBCA77) ^ padded[at + 2] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x27D4EB2F)
    return mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), np.flatnonzero(padded[at] == 0)


def pieces(text: str, most: int = SLICE) -> Iterator[str]:
    """The text in pieces of at most ``most`` code points, cut at blanks where there are any."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(" ", at + 1, at + most)
        cut = at + most if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-likelihood of each bucket (BUCKETS x languages)."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    if not counts:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, FIT_ROWS / n))])
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in pieces(text.as_py() or ""):
                    own += np.bincount(letter_buckets(piece)[0], minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(own[at], pa.int64())})

    summed = drawn.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts)
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    table[summed["bucket"].to_numpy(np.int64), summed["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] += summed["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def word_likelihoods(text: str, table: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word of ``text`` in each language."""
    buckets, starts = letter_buckets(text)
    if not len(starts):
        return np.zeros((0, table.shape[1]), np.float32)
    return np.add.reduceat(table[buckets], starts, axis=0)


def _mixture(ll: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds, and each document's log-likelihood before the last.

    ll: words x languages; doc: each word's document; first: each document's first word.
    """
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(ll - top)
    total = np.zeros(0)
    for _ in range(rounds):
        r = p * shares[doc]
        each = r.sum(axis=1, keepdims=True)
        np.maximum(each, 1e-30, out=each)
        total = np.add.reduceat((np.log(each) + top)[:, 0].astype(np.float64), first)
        r /= each
        shares = np.add.reduceat(r, first, axis=0) / n[:, None]
    return shares, total


def infer(ll: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, certainty) of documents with ``n`` words each (none 0), from all their words' ``ll``.

    Shares of languages outside the selected set are 0.  Certainty: the posterior of the
    first language, if it is alone.
    """
    docs, languages = len(n), ll.shape[1]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    alone = np.add.reduceat(ll.astype(np.float64), first, axis=0)
    best = alone.argmax(axis=1)
    value = alone[np.arange(docs), best]
    shares = np.eye(languages, dtype=np.float32)[best]
    certainty = 1 / np.exp(alone - value[:, None]).sum(axis=1)
    cost = PENALTY * np.log(n + 1.0)
    most = np.add.reduceat(ll.max(axis=1).astype(np.float64), first)
    open_ = np.flatnonzero(most - value > cost)  # for the others no mixture can be worth it
    if languages < 2 or not len(open_):
        return shares, certainty
    m = n[open_]
    words = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in open_])
    ll, doc = ll[words], np.repeat(np.arange(len(open_)), m)
    start = np.concatenate([[0], np.cumsum(m)[:-1]])
    full, _ = _mixture(ll, doc, start, m, np.full((len(open_), languages), 1 / languages, np.float32), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    found = value[open_].copy()
    for size in range(2, min(SET, languages) + 1):
        rows = np.arange(len(open_))[:, None]
        picked = order[:, :size]
        own = np.maximum(full[rows, picked], 1e-3)
        got, total = _mixture(ll[np.arange(len(ll))[:, None], picked[doc]], doc, start, m, (own / own.sum(axis=1, keepdims=True)).astype(np.float32), NESTED_ROUNDS)
        total -= (size - 1) * cost[open_]
        better = np.flatnonzero(total > found)
        found[better] = total[better]
        chosen = np.zeros((len(better), languages), np.float32)
        chosen[np.arange(len(better))[:, None], picked[better]] = got[better]
        shares[open_[better]] = chosen
        certainty[open_[better]] = 1
    return shares, certainty


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns of docs and __lw_lang, __lw_score and __lw_shares (map of the selected languages) of every whole text."""
    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            texts, size = batch.column(at), batch.num_rows
            lang, score, shares = [UNKNOWN] * size, np.zeros(size), [[] for _ in range(size)]
            held, rows = [], []

            def settle(held, rows, lang=lang, score=score, shares=shares) -> None:
                got, certainty = infer(np.concatenate(held), np.array([len(x) for x in held]))
                for row, s, c in zip(rows, got, certainty.tolist(), strict=True):
                    top = int(s.argmax())
                    lang[row], score[row] = langs[top], min(1.0, float(s[top]) * c)
                    shares[row] = [(langs[i], float(s[i])) for i in np.flatnonzero(s)]

            n = 0
            for row, text in enumerate(texts):
                text = text.as_py()
                if not text or not langs:
                    continue
                ll = [word_likelihoods(x, table) for x in pieces(text)]
                ll = ll[0] if len(ll) == 1 else np.concatenate(ll)
                if len(ll):
                    held.append(ll)
                    rows.append(row)
                    n += len(ll)
                if n > WORDS:
                    settle(held, rows)
                    held, rows, n = [], [], 0
            if held:
                settle(held, rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=[*names, "__lw_lang", "__lw_score", "__lw_shares"])

    return storage.mapped(docs, keep, lambda at, names: lambda batches: run(batches, at, names), "__lw_lang string, __lw_score double, __lw_shares map<string,double>")


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, shares) of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    found = predicted(slim, fit(slim), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lw_lang").alias("lang_pred"), F.col("__lw_score").alias("score"), F.col("__lw_shares").alias("shares"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import table

    return languages(table(spark, sf_dir, "documents"))
