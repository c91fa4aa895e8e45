"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gets counts (words, symbols, repeated lines, words in repeated three-word
windows).  Two base rules reject; of the rest, four ratios are judged against limits
learned from the documents themselves, for each language and source.

The sketch of a ratio is a table of integer buckets with counts: exact below ``EXACT``,
then ``EXACT / 2`` buckets for each doubling, so values have no ceiling and an error of
2 in ``EXACT`` at most.  Sketches merge by adding counts, so tasks pre-aggregate before
the shuffle, a hot source is only a few thousand rows after it, and the result does not
depend on how rows were dealt out.

A group's limit lies beyond its body: with the median m and the quantile b at the body's
end, it is b and ``REACH`` times the distance from m to b (at least one bucket) further.
The body ends where junk may begin (``BEYOND``): base rules already take repetition, so
the body of the repetition ratios has 99 % of a group; that of symbols has 80 %, and that
of word lengths the 80 % in the middle.  Both m and b of a group are blended with those of
all groups merged, which count as much as the documents that put ten of them beyond the
quantile: a group of a few documents follows the corpus, a large one itself, and nothing
switches between.

Defined results: a null or empty text has zero counts and fails the base rules; null
languages and sources are groups of their own; a ratio's whole is never zero, as
a little is added to it (to words, eight of five letters); every row gives one row, repeated ones too; an empty table
gives no rows; columns of any name are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

#: The bytes that end words.
BLANKS = " \t\n\x0b\x0c\r"
_BLANK = r"[\x20\x09-\x0D]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Base rules: words that a text must have, and words in repeated windows, in hundredths of all, that it may have.
LEAST_WORDS, MOST_REPEATS = 50, 50
#: Ratios: part, whole, times, and what is added to part and whole so that one event, or one word, in a short text is no extreme.
RATIOS = {
    "mean_length": ("word_chars", "n_words", 100, 40, 8),
    "symbols": ("n_symbols", "word_chars", 1000, 0, 200),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 0, 2),
    "repeats": ("n_repeat_words", "n_words", 1000, 0, 20),
}
#: Documents in a thousand that the body of a ratio leaves at its upper end; mean_length has a lower end, too.
BEYOND = {"mean_length": 100, "symbols": 200, "dup_lines": 10, "repeats": 10}
#: Documents beyond a quantile that it takes to trust a group's own.
TRUST = 10
#: Distances from the median to the body's end that a limit lies beyond that end.
REACH = 3
#: Values below this have buckets of their own; a power of two.
EXACT = 1024


def counted(docs: DataFrame) -> DataFrame:
    """(row, lang, source, counts): the whole row as a struct, and COUNTS and n_lines of its whole text."""
    row = F.struct(*[docs[f"`{n.replace('`', '``')}`"] for n in docs.columns])
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # A select for each step: columns that later ones use more than once are computed once.
    df = docs.select(row.alias("row"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), text.alias("t"), F.trim(text, F.lit(BLANKS)).alias("trimmed"))
    df = df.withColumns({"words": F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", f"{_BLANK}+")), "lines": F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")})
    df = df.withColumn("hashes", F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2]))).otherwise(F.array().cast("array<bigint>")))
    # Windows with their places, equal ones side by side; only where some window is there twice.
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.withColumn("sorted", F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("sorted")
    repeated = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    counts = F.struct(
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("t") - F.regexp_count("t", F.lit(_BLANK))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(s.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    # A generator of one row: else the optimizer copies the counts into each use of a field.
    return df.select("row", "lang", "source", F.explode(F.array(counts)).alias("counts"))


def base_failed(c: Column, least_words: int = LEAST_WORDS) -> Column:
    return (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > MOST_REPEATS * c["n_words"])


def bucket(value: Column) -> Column:
    """The least value of the bucket of a whole number: itself below EXACT, then its leading bits."""
    spare = F.greatest(F.length(F.bin(value)) - (EXACT.bit_length() - 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def ratios() -> dict[str, Column]:
    """The bucket of each ratio."""
    return {k: bucket(F.expr(f"({times} * (counts.{part} + {some})) div (counts.{whole} + {more})")) for k, (part, whole, times, some, more) in RATIOS.items()}


def sketch(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(lang, source, ratio, bucket, n) over the rows of ``counted`` that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("bucket")) for k, v in ratios().items()]))
    passed = docs.filter(~base_failed(F.col("counts"), least_words)).select("lang", "source", each.alias("r"))
    return passed.groupBy("lang", "source", "r.ratio", "r.bucket").agg(F.count("*").alias("n"))


def _by_ratio(values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("ratio"))


def quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, ratio, docs, low, mid, high): the body's ends and the median of sketches merged by ``by``."""
    merged = sketches.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "ratio")
    summed = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group)})
    at = lambda thousandths: F.min(F.when(F.col("upto") * 1000 >= F.col("docs") * thousandths, F.col("bucket")))
    beyond = _by_ratio(BEYOND)
    return summed.groupBy(*by, "ratio", "docs").agg(at(beyond).alias("low"), at(F.lit(500)).alias("mid"), at(1000 - beyond).alias("high"))


def limits(sketches: DataFrame) -> DataFrame:
    """(lang, source, ratio, docs, least, most) of each group; ``sketches`` is read twice."""
    own = quantiles(sketches, ["lang", "source"])
    of_all = quantiles(sketches, []).select("ratio", *[F.col(c).alias(f"all_{c}") for c in ("low", "mid", "high")])  # a row a ratio
    prior = F.expr(f"({1000 * TRUST}) div {'element_at(map(' + ', '.join(f'{k!r}, {v}' for k, v in BEYOND.items()) + '), ratio)'}")
    blended = own.join(F.broadcast(of_all), "ratio").withColumn("prior", prior)
    for c in ("low", "mid", "high"):
        blended = blended.withColumn(f"b_{c}", F.expr(f"(docs * {c} + prior * all_{c}) div (docs + prior)"))
    reach = lambda a, b: REACH * F.greatest(F.col(b) - F.col(a), F.lit(1))
    return blended.select("lang", "source", "ratio", "docs", (F.col("b_low") - reach("b_low", "b_mid")).alias("least"), (F.col("b_high") + reach("b_mid", "b_high")).alias("most"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(of_lang, of_source, and least and most of each ratio) for each group."""
    found = limits(sketches)
    return found.groupBy(F.col("lang").alias("of_lang"), F.col("source").alias("of_source")).agg(*[F.max(F.when(F.col("ratio") == r, F.col(k))).alias(f"{r}_{k}") for r in RATIOS for k in ("least", "most")])


def judged(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, counts, failed, kept) of ``counted`` rows, which are read twice, for the sketch and for the verdict."""
    # Written first, so that its size is known before texts would be shuffled to it: Spark broadcasts it only if it is small.
    with storage.scratch(rows.sparkSession):
        t = storage.written(thresholds(storage.written(sketch(rows, least_words), "sketch")), "thresholds", last=True)
    within = F.lit(True)
    for name, value in ratios().items():
        high = value <= F.col(f"{name}_most")
        within = within & ((value >= F.col(f"{name}_least")) & high if name == "mean_length" else high)
    joined = rows.join(t, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    failed = base_failed(F.col("counts"), least_words)
    return joined.select("row", "counts", failed.alias("failed"), (~failed & F.coalesce(within, F.lit(False))).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of every document."""
    rows = counted(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", "lang", "source"))
    slim = rows.withColumn("row", F.struct(F.col("row.doc_id").alias("doc_id")))
    return judged(storage.written(slim, "counts")).select("row.doc_id", *[F.col("counts")[c].alias(c) for c in COUNTS], F.col("failed").alias("base_failed"), "kept")


def good(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The whole rows of ``docs`` that the rules keep."""
    return judged(counted(docs), least_words).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import table

    return quality(table(spark, sf_dir, "documents"))


def _sql_bucket(value: str) -> str:
    spare = f"greatest(length(bin({value})) - {EXACT.bit_length() - 1}, 0)"
    return f"(({value} >> {spare}) << {spare})"


_SQL_RATIOS = {k: _sql_bucket(f"({times} * ({part} + {some}) // ({whole} + {more}))") for k, (part, whole, times, some, more) in RATIOS.items()}
_SQL_BEYOND = "CASE ratio " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BEYOND.items()) + " END"
_SQL_QUANTILES = "max(docs) AS docs, " + ", ".join(f"min(CASE WHEN upto * 1000 >= docs * ({at}) THEN v END) AS {name}" for name, at in (("low", _SQL_BEYOND), ("mid", "500"), ("high", f"1000 - {_SQL_BEYOND}")))

ORACLE = rf"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
lines AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM texts),
line_counts AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
places AS (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3),
windows AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM places),
repeated AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY k),
counts AS (
  SELECT t.doc_id, t.lang, t.source, len(w.w) AS n_words,
         coalesce(length(array_to_string(w.w, '')), 0) AS word_chars,
         length(t.t) - length(regexp_replace(t.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines
  FROM texts t JOIN words w USING (k) LEFT JOIN line_counts l USING (k) LEFT JOIN covered c USING (k)),
based AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATS} * n_words) AS base_failed,
         {", ".join(f"{v} AS r_{k}" for k, v in _SQL_RATIOS.items())} FROM counts),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, r_{k} AS v FROM based WHERE NOT base_failed" for k in RATIOS)}),
own AS (SELECT lang, source, ratio, {_SQL_QUANTILES} FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, ratio ORDER BY v) AS upto, count(*) OVER (PARTITION BY lang, source, ratio) AS docs FROM long) GROUP BY lang, source, ratio),
alls AS (SELECT ratio, {_SQL_QUANTILES} FROM (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY v) AS upto, count(*) OVER (PARTITION BY ratio) AS docs FROM long) GROUP BY ratio),
blended AS (SELECT lang, source, ratio, {", ".join(f"(docs * {c} + prior * all_{c}) // (docs + prior) AS {c}" for c in ("low", "mid", "high"))}
  FROM (SELECT o.*, a.low AS all_low, a.mid AS all_mid, a.high AS all_high, {1000 * TRUST} // ({_SQL_BEYOND.replace("ratio", "o.ratio")}) AS prior FROM own o JOIN alls a USING (ratio))),
fences AS (SELECT lang, source, ratio, low - {REACH} * greatest(mid - low, 1) AS least, high + {REACH} * greatest(high - mid, 1) AS most FROM blended),
wide AS (SELECT lang, source, {", ".join(f"max(CASE WHEN ratio = '{k}' THEN least END) AS least_{k}, max(CASE WHEN ratio = '{k}' THEN most END) AS most_{k}" for k in RATIOS)} FROM fences GROUP BY lang, source)
SELECT b.doc_id, CAST(b.n_words AS BIGINT) AS n_words, CAST(b.word_chars AS BIGINT) AS word_chars, CAST(b.n_symbols AS BIGINT) AS n_symbols,
       CAST(b.n_dup_lines AS BIGINT) AS n_dup_lines, CAST(b.n_repeat_words AS BIGINT) AS n_repeat_words, b.base_failed,
       (NOT b.base_failed AND coalesce({" AND ".join(f"r_{k} <= most_{k}" for k in RATIOS)} AND r_mean_length >= least_mean_length, false)) AS kept
FROM based b LEFT JOIN wide w ON b.lang IS NOT DISTINCT FROM w.lang AND b.source IS NOT DISTINCT FROM w.source
"""
