"""Candidate generation: capped inverted indexes, n-gram postings, union with provenance.

All exact channels go through one long table of (channel, key, tid) and one join.  The
cap is a window limit, which Spark applies before the exchange too, so a hot key sends
no more than the cap from each task.  Pair rows stay narrow: ids, a mask of channels,
the rarest token's frequency and the n-gram score.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.keys import ngrams
from linkweave.sources.paths import written

from . import retrieval
from .lookup import Slices

CHANNELS = {1: "ch1_core_name", 2: "ch2_top2_tokens", 3: "ch3_street_num_token", 4: "ch4_address_location", 5: "ch5_char3_k50", 6: "ch6_distinctive_token", 7: "ch7_relaxed_street_num"}


@dataclass(frozen=True)
class BlockerConfig:
    bucket: int = 500
    ngram_top_k: int = 50
    ngram_max_df: int = 3000
    tokens_to_query: int = 2
    token_max_df: int = 3000
    channels: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7)
    by_country: bool = False


def exact_keys(profiles: DataFrame, id_name: str, channels: tuple[int, ...] = (1, 2, 3, 4, 6, 7)) -> DataFrame:
    """(channel, key, id, country): all keys of all exact channels, none empty."""
    def keys(c: int) -> Column:
        each = F.col(f"ch{c}") if c > 4 else F.array(f"ch{c}")  # 6 and 7 are lists
        return F.transform(each, lambda k: F.struct(F.lit(c).alias("channel"), k.alias("key")))

    parts = [keys(c) for c in channels if c != 5]
    every = F.concat(*parts) if parts else F.array().cast("array<struct<channel:int,key:string>>")
    each = profiles.select(F.col("entity_id").alias(id_name), "country", F.explode(every).alias("x")).select("x.channel", "x.key", id_name, "country")
    return each.filter(F.trim("key") != "")


def _country(by_country: bool) -> list[str]:
    return ["country"] if by_country else []


def capped(index: DataFrame, bucket: int, by_country: bool = False) -> DataFrame:
    """The first ``bucket`` postings of each key, or of each key of a country, in order of id."""
    return index.withColumn("_n", F.row_number().over(Window.partitionBy("channel", "key", *_country(by_country)).orderBy("tid"))).filter(F.col("_n") <= bucket).drop("_n")


def token_frequencies(index: DataFrame, by_country: bool = False) -> DataFrame:
    """(key, df) of the distinctive tokens, or (key, country, df)."""
    return index.filter("channel = 6").groupBy("key", *_country(by_country)).agg(F.count("*").alias("df"))


def queried_tokens(queries: DataFrame, frequencies: DataFrame, n: int, max_df: int, by_country: bool = False) -> DataFrame:
    """(key, s1_id, df): the ``n`` rarest indexed tokens of each record, of those with ``max_df`` records at most."""
    tokens = queries.select(F.col("entity_id").alias("s1_id"), *_country(by_country), F.posexplode("ch6").alias("pos", "key"))
    known = tokens.join(frequencies.filter(F.col("df") <= max_df), ["key", *_country(by_country)])
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy("df", "pos"))
    return known.withColumn("_n", rank).filter(F.col("_n") <= n).select("key", "s1_id", "df")


def exact_candidates(queries: DataFrame, targets: DataFrame, config: BlockerConfig) -> DataFrame:
    """(s1_id, tid, channel, df): the exact channels, in one join."""
    wanted = tuple(c for c in config.channels if c != 5)
    index = exact_keys(targets, "tid", wanted)
    asked = exact_keys(queries, "s1_id", tuple(c for c in wanted if c != 6)).select("channel", "key", "s1_id", F.lit(0).cast("long").alias("df"), "country")
    if 6 in wanted:
        rare = queried_tokens(queries, token_frequencies(index, config.by_country), config.tokens_to_query, config.token_max_df, config.by_country)
        asked = asked.unionByName(rare.join(queries.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id").select(F.lit(6).alias("channel"), "key", "s1_id", "df", "country"))
    on = ["channel", "key", *_country(config.by_country)]
    found = capped(index, config.bucket, True) if config.by_country else capped(index, config.bucket).drop("country")
    return asked.join(found, on).select("s1_id", "tid", "channel", "df")


def postings(texts: DataFrame, id_name: str, mode: str = "char_3") -> DataFrame:
    """(ng, id, grams) of ``texts(id, text)``: each different n-gram, and how many the text has."""
    grams = texts.select(id_name, ngrams(F.col("text"), mode).alias("g"))
    return grams.select(id_name, F.size("g").alias("grams"), F.explode("g").alias("ng"))


def weights(index: DataFrame, records: DataFrame) -> DataFrame:
    """(ng, df, idf) with idf = ln(1 + N / df); ``records``: one row (n)."""
    return index.groupBy("ng").agg(F.count("*").alias("df")).join(F.broadcast(records)).withColumn("idf", F.log1p(F.col("n") / F.col("df"))).drop("n")  # one row


def df_cap(n: Column, ratio: float, most: int) -> Column:
    """The largest document frequency of an n-gram that is kept."""
    by_ratio = F.floor(n * ratio) if ratio > 0 else F.lit(most)
    return F.least(F.lit(most), F.greatest(F.lit(20), by_ratio))


def numbered(df: DataFrame, column: str, number: str) -> DataFrame:
    """``df`` with a number that orders rows as ``column`` does, written: long joins and groups then go by integers."""
    return written(df.orderBy(column).withColumn(number, F.monotonically_increasing_id()), "numbered")


def ngram_overlaps(queries: DataFrame, targets: DataFrame, max_df: int | None, mode: str = "char_3", ratio: float = 0.0, most: int = 3000, top: int | None = None) -> DataFrame:
    """(s1_id, tid, score, overlap, q_grams, t_grams) of ``(id, text)`` tables that share n-grams.

    n-grams with more than ``max_df`` records, or beyond the cap by ratio if that is
    None, are left out, which bounds every posting list.  ``top``: only the best so many
    of each record, with their ``rank``.
    """
    q, t = (df.select("*", ngrams(F.col("text"), mode).alias("g")).filter(F.size("g") > 0) for df in (queries, targets))
    q, t = written(q.select("s1_id", "g", F.monotonically_increasing_id().alias("_q")), "queries"), numbered(t.select("tid", "g"), "tid", "_t")
    n_asked, n_held = q.count(), t.count()
    n = t.agg(F.count("*").alias("n"))
    w = weights(t.select("_t", F.explode("g").alias("ng")), n)
    if max_df is not None:
        w = w.filter(F.col("df") <= max_df)
    else:
        w = w.join(F.broadcast(n)).filter(F.col("df") <= df_cap(F.col("n"), ratio, most)).drop("n")  # one row
    each = q.select("_q", "s1_id", F.size("g").alias("q_grams"), F.explode("g").alias("ng")).join(w.select("ng", "idf"), "ng")
    lists = each.groupBy("_q", "s1_id", "q_grams").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("ng").alias("h"), "idf"))).alias("x"))
    asked = lists.select("_q", "s1_id", "q_grams", F.col("x.h").alias("grams"), F.col("x.idf").alias("weights"))
    held = t.select("_t", "tid", F.transform("g", lambda x: F.xxhash64(x)).alias("grams"))
    found = retrieval.overlaps(asked, held, n_asked, n_held, top)
    return found if top is not None else found.drop("rank")


def best(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` targets of each record."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(*order))).filter(F.col("rank") <= k)


def ngram_candidates(queries: DataFrame, targets: DataFrame, config: BlockerConfig) -> DataFrame:
    """(s1_id, tid, score, rank): the records with the largest summed weight of shared n-grams of the core name."""
    def text(df: DataFrame, name: str) -> DataFrame:
        return df.filter("ch1 <> ''").select(F.col("entity_id").alias(name), F.col("ch1").alias("text"))

    return ngram_overlaps(text(queries, "s1_id"), text(targets, "tid"), config.ngram_max_df, top=config.ngram_top_k).select("s1_id", "tid", "score", "rank")


def two_stage(queries: DataFrame, targets: DataFrame, pool: int = 100, k: int = 25, max_df: int | None = 3000, metric: str = "jaccard", mode: str = "char_3") -> DataFrame:
    """(s1_id, tid, sim, score, rank): a pool by weight, then the best of it by n-gram similarity."""
    pooled = ngram_overlaps(queries, targets, max_df, mode, top=pool).drop("rank")
    whole = F.col("q_grams") + F.col("t_grams") - F.col("overlap") if metric == "jaccard" else F.least("q_grams", "t_grams")
    ranked = pooled.withColumn("sim", F.col("overlap") / whole)
    return best(ranked, k, F.desc("sim"), F.desc("score"), F.asc("tid")).select("s1_id", "tid", "sim", "score", "rank")


def candidates(queries: DataFrame, targets: DataFrame, config: BlockerConfig = BlockerConfig(), slices: Slices | None = None) -> DataFrame:
    """(s1_id, tid, channel_mask, hits, rarest_token_df, ch5_score): the union of all channels, a row a pair.

    With ``slices`` the pairs come in the order in which their profiles are looked up, with ``_row`` and ``_tile``.
    """
    parts = exact_candidates(queries, targets, config).select("s1_id", "tid", "channel", "df", F.lit(0.0).alias("score"))
    if 5 in config.channels:
        parts = parts.unionByName(ngram_candidates(queries, targets, config).select("s1_id", "tid", F.lit(5).alias("channel"), F.lit(0).cast("long").alias("df"), "score"))
    parts = parts.filter(~F.col("tid").startswith("S1-"))
    mask = F.bit_or(F.expr("shiftleft(1, channel - 1)"))
    grouped = slices.by_row(parts).groupBy("_row", "s1_id", "tid") if slices else parts.groupBy("s1_id", "tid")
    found = grouped.agg(mask.alias("channel_mask"), F.coalesce(F.min(F.when(F.col("df") > 0, F.col("df"))), F.lit(0)).alias("rarest_token_df"), F.max("score").alias("ch5_score"))
    found = found.withColumn("hits", F.bit_count("channel_mask"))
    return slices.dealt(found) if slices else found


@dataclass(frozen=True)
class BlockingChannel:
    """One exact channel as an object: an index of targets, pairs from it, and its statistics."""

    number: int
    config: BlockerConfig = BlockerConfig()

    def index(self, targets: DataFrame) -> DataFrame:
        """(channel, key, tid, country) of all targets."""
        return exact_keys(targets, "tid", (self.number,))

    def generate(self, queries: DataFrame, targets: DataFrame) -> DataFrame:
        """(s1_id, tid) of records that share a key, within the cap."""
        return exact_candidates(queries, targets, replace(self.config, channels=(self.number,))).select("s1_id", "tid").distinct()

    def stats(self, targets: DataFrame) -> DataFrame:
        return size_statistics(self.index(targets), self.config.bucket)


def size_statistics(index: DataFrame, bucket: int) -> DataFrame:
    """Sizes of the buckets of each channel."""
    sizes = index.groupBy("channel", "key").agg(F.count("*").alias("size"))
    q = lambda p: F.expr(f"percentile(size, {p})")
    return sizes.groupBy("channel").agg(F.count("*").alias("unique_keys"), F.sum("size").alias("total_postings"), F.round(F.avg("size"), 6).alias("mean_size"), q(0.5).alias("median_size"), F.round(q(0.95), 6).alias("p95_size"), F.round(q(0.99), 6).alias("p99_size"), F.max("size").alias("max_size"), F.count_if(F.col("size") > bucket).alias("oversized"))
