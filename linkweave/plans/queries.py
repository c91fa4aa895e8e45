"""One query for each operator, over records made of the driver's tables, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import ship
from linkweave.functions import keys as K
from linkweave.functions import similarity as S
from linkweave.functions import text as T
from linkweave.functions.words import ADDRESS_STOPWORDS
from linkweave.operators import audit as AU
from linkweave.operators import blocking as B
from linkweave.operators import decisions as D
from linkweave.operators import evaluation as E
from linkweave.operators import features as FE
from linkweave.operators import lookup
from linkweave.operators import missed as MI
from linkweave.operators import ranking as R
from linkweave.operators import sampling as SA
from linkweave.operators import taxonomy as TX
from linkweave.sources import records as RE
from linkweave.sources import sinks
from linkweave.sources.paths import new_path, written

from .sql import _list, grams
from .sql import query as sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Plan:
    """The relations of the plan over one folder of tables; each is built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = getattr(self, f"make_{name}")()
        return self._made[name]

    def make_rec(self):
        return RE.er_records(self.spark, self.sf_dir)

    def make_truth(self):
        return RE.er_truth(self.rec)

    def make_fresh(self):
        return K.with_profiles(self.rec)

    def make_prof(self):
        return written(self.fresh, "profiles")

    def make_s(self):
        return RE.of_source(self.prof, "S1")

    def make_t(self):
        return RE.of_source(self.prof, "S2", "S3")

    def make_s1(self):
        return RE.of_source(self.rec, "S1").select(F.col("entity_id").alias("s1_id"))

    def make_idx(self):
        return B.exact_keys(self.t, "tid")

    def make_slices(self):
        return lookup.Slices.of(self.s, self.t)

    def make_dealt(self):
        return written(B.candidates(self.s, self.t, slices=self.slices), "candidates")

    def make_cand(self):
        return self.dealt.drop("_row", "_tile")

    def make_pair(self):
        return FE.with_profiles_of(self.cand, self.s, self.t, [*TX.COLUMNS, "ch1", "ch2", "ch3", "ch4"])

    def make_wide(self):
        """All that the ranker's features read, of all candidates."""
        return FE.looked_up(self.dealt, self.s, self.t, FE.RANKER_PROFILE, self.slices)

    def make_quick(self):
        """Candidates with their quick scores."""
        return FE.heuristic_scores(FE.looked_up(self.dealt, self.s, self.t, FE.QUICK, self.slices), ("rarest_token_df", "ch5_score"))

    def make_scored(self):
        return R.ranked(self.quick)

    def _narrow(self, columns: list[str], features: dict | None = None):
        wide = FE.looked_up(self.dealt, self.s, self.t, columns, self.slices)
        made = {"hard_ranker": SA.ranker_hard(), "hard_matcher": SA.matcher_hard()} | {n: c.cast("float") for n, c in (features or {}).items()}
        return FE.heuristic_scores(wide.withColumns(made), ("rarest_token_df", "ch5_score", *made))

    def make_vectors(self):
        """``narrow`` and the ranker's features of all candidates, in one look-up."""
        return written(self._narrow([*FE.RANKER_PROFILE, "f_numbers"], FE.ranker_features()), "vectors")

    def make_narrow(self):
        """Candidates with their quick scores, and whether they are hard for either sample: no profiles, which only the samples need."""
        if "vectors" in self._made:
            return self.vectors.drop(*FE.ranker_features())
        return written(self._narrow([*FE.QUICK, "f_street"]), "narrow")

    def make_narrow_ranked(self):
        return written(R.ranked(self.narrow), "ranked")

    def make_claims(self):
        return self.scored.select("s1_id", "tid", F.col("score01").alias("score"))

    def make_decided(self):
        return D.decide(self.claims)

    def make_won(self):
        return D.one_to_one(self.decided)

    def make_counted(self):
        return E.counts(self.s1, self.truth, self.won)

    def make_per(self):
        return E.scores(self.counted)

    def make_true_pair(self):
        return FE.with_profiles_of(self.truth, self.s, self.t, MI.COLUMNS)

    def make_labelled(self):
        t = self.truth.withColumn("label", F.lit(1))
        return self.claims.join(t, ["s1_id", "tid"], "left").select("s1_id", "tid", "score", F.coalesce("label", F.lit(0)).alias("label"))


def define(name: str, oracle: str | None = None):
    def put(f: Callable[[Plan], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Plan(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def text(column: str):
    """An array as text."""
    return F.array_join(column, "|")


def lines(column: str) -> str:
    return f"array_to_string({column}, '|')"


# ---- sources and sinks -----------------------------------------------------------------

_REC = "entity_id, business_name, business_address, country"


def _stored(p: Plan, df: DataFrame, by: list[str] | None = None) -> str:
    path = new_path(p.spark, "tsv")
    sinks.write_table(df, path, by)
    return path


@define("scan_tsv", sql(["rec"], f"SELECT {_REC} FROM rec"))
def _(p):
    return RE.read_records(p.spark, _stored(p, p.rec.select(*RE.RECORD_COLUMNS)))


@define("scan_unique", sql(["rec"], "SELECT business_name, CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY business_name HAVING count(*) > 1"))
def _(p):
    return RE.repeated(p.rec, "business_name")


@define("scan_ids", sql(["rec"], "SELECT entity_id FROM rec WHERE entity_id LIKE 'S1-%'"))
def _(p):
    return RE.read_ids(p.spark, _stored(p, RE.of_source(p.rec, "S1").select(*RE.RECORD_COLUMNS)))


_TRUTH_ROWS = "SELECT s.entity_id AS source1_entity_id, coalesce((SELECT string_agg(tid, ',' ORDER BY tid) FROM truth z WHERE z.s1_id = s.entity_id), '') AS matched_entity_ids FROM rec s WHERE s.entity_id LIKE 'S1-%'"


def truth_table(p: Plan) -> DataFrame:
    return sinks.id_lists(RE.of_source(p.rec, "S1"), p.truth, "matched_entity_ids", "tid")


@define("scan_gt", sql(["truth"], "SELECT s.entity_id AS s1_id, z.tid FROM rec s LEFT JOIN truth z ON z.s1_id = s.entity_id WHERE s.entity_id LIKE 'S1-%'"))
def _(p):
    return RE.truth_pairs(RE.read_truth(p.spark, _stored(p, truth_table(p))))


@define("scan_gt_faults", sql(["truth"], "SELECT s1_id AS source1_entity_id, 'repeated_target' AS fault FROM truth GROUP BY s1_id UNION ALL SELECT s1_id, 'source_as_target' FROM truth GROUP BY s1_id"))
def _(p):
    rows = truth_table(p).withColumn("matched_entity_ids", F.when(F.col("matched_entity_ids") != "", F.concat_ws(",", "matched_entity_ids", "matched_entity_ids", "source1_entity_id")).otherwise(""))
    return RE.truth_faults(rows)


@define("scan_by_country", sql(["rec"], f"SELECT {_REC} FROM rec WHERE country = 'fr' AND entity_id NOT LIKE 'S1-%'"))
def _(p):
    path = new_path(p.spark, "by-country")
    RE.of_source(p.rec, "S2", "S3").select(*RE.RECORD_COLUMNS).write.partitionBy("country").parquet(path)
    return p.spark.read.parquet(path).filter("country = 'fr'").select(*RE.RECORD_COLUMNS)


@define("scan_subset", sql(["truth"], f"SELECT {_REC} FROM rec WHERE entity_id IN (SELECT s1_id FROM truth)"))
def _(p):
    return p.rec.join(p.truth.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi").select(*RE.RECORD_COLUMNS)


@define("scan_split", sql(["rec"], "SELECT entity_id FROM rec WHERE entity_id LIKE 'S1-%' AND country = 'en'"))
def _(p):
    path = new_path(p.spark, "ids")
    sinks.write_ids(RE.of_source(p.rec, "S1").filter("country = 'en'"), "entity_id", path)
    return RE.read_id_lines(p.spark, path)


@define("scan_validator_ids", sql(["rec"], "SELECT DISTINCT entity_id FROM rec"))
def _(p):
    return RE.first_fields(p.spark, _stored(p, p.rec.select(*RE.RECORD_COLUMNS)))


@define("sink_results", sql(["won", "rec"], "SELECT s.entity_id AS source1_entity_id, coalesce((SELECT string_agg(tid, ',' ORDER BY rank) FROM won w WHERE w.s1_id = s.entity_id), '') AS matched_entity_ids FROM rec s WHERE s.entity_id LIKE 'S1-%'"))
def _(p):
    return RE.read_table(p.spark, _stored(p, sinks.id_lists(RE.of_source(p.rec, "S1"), p.won, "matched_entity_ids")), RE.MATCH_COLUMNS)


@define("sink_candidates", sql(["cand", "rec"], "SELECT s.entity_id AS source1_entity_id, coalesce((SELECT string_agg(tid, ',' ORDER BY tid) FROM cand w WHERE w.s1_id = s.entity_id), '') AS candidate_entity_ids FROM rec s WHERE s.entity_id LIKE 'S1-%'"))
def _(p):
    return RE.read_table(p.spark, _stored(p, sinks.id_lists(RE.of_source(p.rec, "S1"), p.cand, "candidate_entity_ids", "tid")), RE.CANDIDATE_COLUMNS)


@define("sink_country", sql(["won", "rec"], "SELECT s.country, CAST(count(*) AS BIGINT) AS n FROM won w JOIN rec s ON s.entity_id = w.s1_id GROUP BY s.country"))
def _(p):
    named = p.won.join(p.rec.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id").select("s1_id", "tid", "country")
    return p.spark.read.csv(_stored(p, named, ["country"]), sep="\t", header=True).groupBy("country").agg(F.count("*").alias("n"))


@define("sink_checksum", sql(["won"], "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(coalesce(sum(CAST(('0x' || substr(sha256(s1_id || chr(9) || tid), 1, 12)) AS BIGINT)), 0) AS VARCHAR) AS digest FROM won"))
def _(p):
    return sinks.digest(p.won, ["s1_id", "tid"])


#: Channels that miss true pairs of these records, which have no names that differ.
_BY_ADDRESS = {"ch3_street_num_token": "ch3", "ch4_address_location": "ch4"}


def missed_category_sql() -> str:
    ov = "len(list_intersect(s.f_tokens, t.f_tokens))"
    return f"CASE WHEN NOT t.f_has_address THEN 'missing_target_address' WHEN t.f_non_latin AND NOT s.f_non_latin THEN 'transliteration' WHEN len(s.n_sig) > 0 AND s.n_sig = t.n_sig THEN 'legal_suffix' WHEN len(s.n_sig) > 0 AND list_sort(s.n_sig) = list_sort(t.n_sig) THEN 'word_order' WHEN len(s.f_numbers) > 0 AND len(t.f_numbers) = 0 THEN 'missing_street_number' WHEN {ov} = 0 AND jac(s.f_atokens, t.f_atokens) >= 0.25 THEN 'trade_name_or_dba' WHEN {ov} > 0 THEN 'name_typo_or_abbreviation' ELSE 'unknown' END"


IS_MISSED_SQL = "NOT (s.ch3 <> '' AND s.ch3 = t.ch3) AND NOT (s.ch4 <> '' AND s.ch4 = t.ch4)"
_MISSED_SQL = f"""SELECT category AS failure_category, s1_id, s.country AS s1_country, s.business_name AS s1_name, s.business_address AS s1_address, tid AS target_id, substr(tid, 1, 2) AS target_source, t.business_name AS target_name, t.business_address AS target_address,
 CASE WHEN len(s.n_sig) > 0 THEN array_to_string(s.n_sig, ' ') ELSE s.n_alnum END AS norm_s1_name, CASE WHEN len(t.n_sig) > 0 THEN array_to_string(t.n_sig, ' ') ELSE t.n_alnum END AS norm_target_name, s.a_clean AS norm_s1_address, t.a_clean AS norm_target_address,
 'ch3_street_num_token; ch4_address_location' AS failed_blocking_channels, CASE WHEN s.f_has_address THEN 'true' ELSE 'false' END AS s1_has_address, CASE WHEN t.f_has_address THEN 'true' ELSE 'false' END AS target_has_address,
 array_to_string(s.a_numbers, '; ') AS s1_numeric_tokens, array_to_string(t.a_numbers, '; ') AS target_numeric_tokens, CAST(len(s.n_tokens) AS VARCHAR) AS s1_name_token_count, CAST(len(t.n_tokens) AS VARCHAR) AS target_name_token_count, CAST(length(s.business_name) AS VARCHAR) AS s1_name_char_len, CAST(length(t.business_name) AS VARCHAR) AS target_name_char_len
 FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY s1_id, tid) AS n FROM (SELECT z.s1_id, z.tid, s, t, {missed_category_sql()} AS category FROM truth z JOIN s ON s.entity_id = z.s1_id JOIN t ON t.entity_id = z.tid WHERE {IS_MISSED_SQL})) WHERE n <= 120"""


@define("sink_missed_csv", sql(["truth", "s", "t"], _MISSED_SQL))
def _(p):
    path = new_path(p.spark, "missed-csv")
    sinks.write_csv(MI.examples(p.true_pair, _BY_ADDRESS), path)
    rows = p.spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in MI.MISSED_COLUMNS), quote='"', escape='"')
    return rows.na.fill("")


@define("scan_json", sql(["rec"], f"SELECT {_REC} FROM rec"))
def _(p):
    path = new_path(p.spark, "json")
    sinks.write_json(p.rec.select(*RE.RECORD_COLUMNS), path)
    return RE.read_json(p.spark, path, ", ".join(f"{c} string" for c in RE.RECORD_COLUMNS))


def _measures_sql(section: str, name: str, of: str, measures: dict[str, str]) -> str:
    names = ", ".join(f"'{m}'" for m in measures)
    values = ", ".join(f"CAST({v} AS DOUBLE)" for v in measures.values())
    return f"SELECT '{section}' AS section, name, unnest([{names}]) AS measure, unnest(v) AS value FROM (SELECT {name} AS name, [{values}] AS v FROM {of} GROUP BY 1)"


_LENGTHS = {f"{what}_length_{n}": f.format(f"length(business_{what})") for what in ("name", "address") for n, f in (("min", "min({})"), ("median", "round(quantile_cont({}, 0.5), 6)"), ("mean", "round(avg({}), 6)"), ("p95", "round(quantile_cont({}, 0.95), 6)"), ("max", "max({})"))}
_S1_MEASURES = {"total_s1": "count(*)", "singletons": "count(*) FILTER (WHERE n = 0)", "total_matches": "sum(n)", "mean_matches": "round(avg(n), 6)"}
_ALL_MEASURES = _S1_MEASURES | {"s2_only": "count(*) FILTER (WHERE n2 > 0 AND n3 = 0)", "s3_only": "count(*) FILTER (WHERE n3 > 0 AND n2 = 0)", "both_s2_and_s3": "count(*) FILTER (WHERE n2 > 0 AND n3 > 0)"} | {f"p{q}_matches": f"round(quantile_cont(n, {q / 100}), 6)" for q in (25, 50, 75, 95, 99)} | {"max_matches": "max(n)"}
_SOURCE_MEASURES = {"total_rows": "count(*)", "unique_ids": "count(DISTINCT entity_id)", "empty_names": "count(*) FILTER (WHERE business_name = '')", "empty_addresses": "count(*) FILTER (WHERE business_address = '')"} | _LENGTHS | {"duplicate_ids": "count(*) - count(DISTINCT entity_id)"}
_PER_S1 = "per_s1 AS (SELECT r.entity_id, r.country, count(z.tid) AS n, count(z.tid) FILTER (WHERE z.tid LIKE 'S2-%') AS n2, count(z.tid) FILTER (WHERE z.tid LIKE 'S3-%') AS n3 FROM rec r LEFT JOIN truth z ON z.s1_id = r.entity_id WHERE r.entity_id LIKE 'S1-%' GROUP BY ALL)"


@define("sink_report", sql(["truth"], " UNION ALL ".join([_measures_sql("sources", "substr(entity_id, 1, 2)", "rec", _SOURCE_MEASURES), _measures_sql("ground_truth", "'all'", "per_s1", _ALL_MEASURES), _measures_sql("countries", "country", "per_s1", _S1_MEASURES)]), _PER_S1))
def _(p):
    path = new_path(p.spark, "report")
    sinks.write_json(AU.audit(p.rec, p.truth), path)
    return RE.read_json(p.spark, path, "section string, name string, measure string, value double")


# ---- normalization ---------------------------------------------------------------------


def _norm(name: str, columns: Callable[[], dict], select: str) -> None:
    define(name, sql(["prof"], f"SELECT entity_id, {select} FROM prof"))(lambda p: p.fresh.select("entity_id", *[c.alias(n) for n, c in columns().items()]))


_norm("norm_accents", lambda: {"plain": F.lower("n_ascii")}, "lower(strip_accents(business_name)) AS plain")
_norm("norm_numeric", lambda: {"numbers": text("a_numbers")}, f"{lines('a_numbers')} AS numbers")
_norm("norm_clean", lambda: {"name": F.col("n_clean"), "address": F.col("a_clean")}, "n_clean AS name, a_clean AS address")
_norm("norm_alnum", lambda: {"name": F.col("n_alnum"), "address": F.col("a_alnum")}, "n_alnum AS name, a_alnum AS address")
_norm("norm_tokens", lambda: {"name": text("n_tokens"), "address": text("a_tokens")}, f"{lines('n_tokens')} AS name, {lines('a_tokens')} AS address")
_norm("norm_sig", lambda: {"sig": text("n_sig"), "legal": text("n_legal")}, f"{lines('n_sig')} AS sig, {lines('n_legal')} AS legal")
_W = "list_filter(n_sig, lambda t: NOT regexp_full_match(t, '\\d+') AND length(t) >= 2)"
_norm("norm_top2", lambda: {"top2": text("n_top2")}, f"array_to_string(list_sort((CASE WHEN len({_W}) > 0 THEN {_W} ELSE n_tokens END)[1:2]), '|') AS top2")
_norm("norm_name", lambda: {"alnum": F.col("n_alnum"), "n_sig": F.size("n_sig").cast("long")}, "n_alnum AS alnum, len(n_sig) AS n_sig")
_norm("norm_addr", lambda: {"alnum": F.col("a_alnum"), "n_sig": F.size("a_sig").cast("long")}, "a_alnum AS alnum, len(a_sig) AS n_sig")
_norm("norm_text", lambda: {"n": F.concat_ws("~", "n_clean", "n_alnum", text("n_tokens"), text("n_sig"), text("n_legal"), text("n_numbers"))}, f"concat_ws('~', n_clean, n_alnum, {lines('n_tokens')}, {lines('n_sig')}, {lines('n_legal')}, {lines('n_numbers')}) AS n")
_norm("norm_script", lambda: {"non_latin": F.col("f_non_latin")}, "f_non_latin AS non_latin")
_norm("norm_hasaddr", lambda: {"has_address": F.col("f_has_address")}, "f_has_address AS has_address")
_norm("norm_street", lambda: {"street": text(F.transform("a_tokens", lambda t: T.without_ordinal(t)))}, r"array_to_string(list_transform(a_tokens, lambda t: regexp_replace(t, '([0-9]+)(st|nd|rd|th)$', '\1')), '|') AS street")
_norm("norm_intstr", lambda: {"number": F.coalesce(T.plain_number(F.get("a_numbers", F.lit(0))), F.lit(""))}, "number")

# ---- keys and n-grams ------------------------------------------------------------------

for _c in ("ch1", "ch2", "ch3", "ch4"):
    _norm(f"key_{_c}", lambda c=_c: {"key": F.col(c)}, f"{_c} AS key")
_norm("key_all", lambda: {c: F.col(c) for c in ("ch1", "ch2_top1", "ch2", "ch2_top3", "ch3", "ch4")}, "ch1, ch2_top1, ch2, ch2_top3, ch3, ch4")
_norm("key_ch6", lambda: {"keys": text(F.array_sort("ch6"))}, f"{lines('list_sort(ch6)')} AS keys")
_norm("key_ch7", lambda: {"keys": text(F.array_sort("ch7"))}, f"{lines('list_sort(ch7)')} AS keys")
_norm("key_ch7_single", lambda: {"key": F.coalesce(F.get("ch7", F.lit(0)), F.lit(""))}, r"CASE WHEN number <> '' AND len(a_words) > 0 THEN number || '_' || regexp_replace(a_words[1], '([0-9]+)(st|nd|rd|th)$', '\1') ELSE '' END AS key")
_norm("key_stop", lambda: {"stops": F.size(F.filter("a_tokens", lambda t: F.array_contains(T.words_in(ADDRESS_STOPWORDS), t))).cast("long")}, f"len(list_filter(a_tokens, lambda t: list_contains({_list(ADDRESS_STOPWORDS)}, t))) AS stops")


def _grams(name: str, mode: str, select: str) -> None:
    _norm(name, lambda: {"grams": text(F.array_sort(K.ngrams(F.col("n_alnum"), mode)))}, f"{lines(f'list_sort({select})')} AS grams")


_grams("ng_char", "char_3", grams("n_alnum", 3, True))
_grams("ng_char2", "char_2", grams("n_alnum", 2, True))
_grams("ng_comb", "char_2_3", f"list_concat(list_transform({grams('n_alnum', 2, True)}, lambda g: '2g_' || g), list_transform({grams('n_alnum', 3, True)}, lambda g: '3g_' || g))")
_TK = r"regexp_extract_all(n_alnum, '[\p{L}\p{N}_]+')"
_grams("ng_token", "token_2", f"CASE WHEN len({_TK}) >= 2 THEN list_distinct(list_transform(range(1, len({_TK})), lambda i: {_TK}[i] || '_' || {_TK}[i + 1])) WHEN len({_TK}) > 0 THEN [{_TK}[1]] ELSE [] END")
_grams("ng_tokset", "token_1", f"list_distinct(list_filter({_TK}, lambda t: length(t) >= 2))")
_CL = r"trim(regexp_replace(n_alnum, '[^\p{L}\p{N}_\s]', '', 'g'))"
_grams("ng_prefix", "prefix_4", f"list_distinct(list_concat(CASE WHEN {_CL} = '' THEN [] ELSE ['pref_' || substr({_CL}, 1, 4)] END, list_transform(list_filter(regexp_split_to_array({_CL}, '\\s+'), lambda t: length(t) >= 4), lambda t: 'tokpref_' || substr(t, 1, 4))))")
_norm("ng_feat", lambda: {"grams": text(F.array_sort("f_char3"))}, f"{lines('list_sort(f_char3)')} AS grams")
_norm("ng_dispatch", lambda: {"n": sum((F.size(K.ngrams(F.col("n_alnum"), m)) for m in ("char_2", "char_3", "char_4")), F.lit(0)).cast("long")}, f"len({grams('n_alnum', 2, True)}) + len({grams('n_alnum', 3, True)}) + len({grams('n_alnum', 4, True)}) AS n")

# ---- filters ---------------------------------------------------------------------------


@define("flt_empty_key", sql(["keys"], "SELECT channel, CAST(count(*) AS BIGINT) AS n FROM keys WHERE trim(key) <> '' GROUP BY channel"))
def _(p):
    return B.exact_keys(p.prof, "id").groupBy("channel").agg(F.count("*").alias("n"))


def _core(df: DataFrame, name: str) -> DataFrame:
    return df.filter("ch1 <> ''").select(F.col("entity_id").alias(name), F.col("ch1").alias("text"))


@define("flt_df", sql(["idf"], "SELECT ng, CAST(df AS BIGINT) AS df FROM idf WHERE df <= least(3000, greatest(20, CAST(floor((SELECT count(*) FROM t WHERE ch1 <> '') * 0.02) AS BIGINT)))"))
def _(p):
    n = _core(p.t, "tid").agg(F.count("*").alias("n"))
    w = B.weights(B.postings(_core(p.t, "tid"), "tid"), n).join(F.broadcast(n))  # one row
    return w.filter(F.col("df") <= B.df_cap(F.col("n"), 0.02, 3000)).select("ng", "df")


@define("flt_df_query", sql(["idf"], "SELECT ng, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf WHERE df <= 30"))
def _(p):
    n = _core(p.t, "tid").agg(F.count("*").alias("n"))
    return B.weights(B.postings(_core(p.t, "tid"), "tid"), n).filter("df <= 30").select("ng", "df", F.round("idf", 6).alias("idf"))


@define("flt_bucket", sql(["idx"], "SELECT channel, key, tid FROM (SELECT *, row_number() OVER (PARTITION BY channel, key ORDER BY tid) AS n FROM idx) WHERE n <= 3"))
def _(p):
    return B.capped(p.idx, 3).select("channel", "key", "tid")


@define("flt_self", sql(["rec"], "SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS tid FROM rec a JOIN rec b ON a.business_name = b.business_name WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'"))
def _(p):
    return RE.of_source(p.rec, "S1").select(F.col("entity_id").alias("s1_id"), "business_name").join(p.rec.select(F.col("entity_id").alias("tid"), "business_name"), "business_name").filter(~F.col("tid").startswith("S1-")).select("s1_id", "tid").distinct()


@define("flt_channel", sql(["exact"], "SELECT DISTINCT s1_id, tid FROM exact WHERE channel IN (1, 3)"))
def _(p):
    return B.candidates(p.s, p.t, B.BlockerConfig(channels=(1, 3))).select("s1_id", "tid")


_BY_COUNTRY = "by_c AS (SELECT * FROM (SELECT k.channel, k.key, r.country, k.entity_id AS tid, row_number() OVER (PARTITION BY channel, key, country ORDER BY k.entity_id) AS n FROM keys k JOIN rec r USING (entity_id) WHERE trim(key) <> '' AND entity_id NOT LIKE 'S1-%') WHERE n <= 500)"


@define("flt_country", sql(["keys"], "SELECT DISTINCT k.entity_id AS s1_id, c.tid FROM keys k JOIN rec a USING (entity_id) JOIN by_c c ON c.channel = k.channel AND c.key = k.key AND c.country = a.country WHERE k.entity_id LIKE 'S1-%' AND k.channel IN (1, 2, 3, 4, 7)", _BY_COUNTRY))
def _(p):
    return B.candidates(p.s, p.t, B.BlockerConfig(channels=(1, 2, 3, 4, 7), by_country=True)).select("s1_id", "tid")


@define("flt_score", sql(["scored"], "SELECT s1_id, tid, round(score01, 6) AS score FROM scored WHERE score01 >= 0.25"))
def _(p):
    return p.claims.filter("score >= 0.25").select("s1_id", "tid", F.round("score", 6).alias("score"))


_EQ = {c: f"(s.{c} <> '' AND s.{c} = t.{c})" for c in ("ch1", "ch2", "ch3", "ch4")}
_BASE = " OR ".join(_EQ.values())
_THEORY = {"config_a": _BASE, "config_b": f"{_BASE} OR jac(s.f_char3, t.f_char3) >= 0.35", "config_c": f"{_BASE} OR len(list_intersect(s.f_sig, t.f_sig)) > 0", "config_d": f"{_BASE} OR (s.f_street <> '' AND s.f_street = t.f_street AND len(list_intersect(s.f_awords, t.f_awords)) > 0)"}
_THEORY["config_e"] = f"{_THEORY['config_b']} OR {_THEORY['config_c']} OR {_THEORY['config_d']}"
_TRUE_PAIR = "FROM truth z JOIN s ON s.entity_id = z.s1_id JOIN t ON t.entity_id = z.tid"


@define("prd_theory", sql(["truth", "s", "t"], f"SELECT z.s1_id, z.tid, {', '.join(f'({v}) AS {k}' for k, v in _THEORY.items())} {_TRUE_PAIR}"))
def _(p):
    return p.true_pair.select("s1_id", "tid", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in TX.theory().items()])


@define("prd_prefix", sql(["rec"], "SELECT entity_id FROM rec WHERE entity_id NOT LIKE 'S1-%'"))
def _(p):
    return p.rec.filter(~F.col("entity_id").startswith("S1-")).select("entity_id")


# ---- joins -----------------------------------------------------------------------------


def _channel(name: str, c: int) -> None:
    define(name, sql(["exact"], f"SELECT DISTINCT s1_id, tid FROM exact WHERE channel = {c}"))(lambda p: B.exact_candidates(p.s, p.t, B.BlockerConfig(channels=(c,))).select("s1_id", "tid").distinct())


for _c in (1, 2, 3, 4, 7):
    _channel(f"join_ch{_c}", _c)


@define("join_exact", sql(["exact"], "SELECT s1_id, tid, CAST(count(*) AS BIGINT) AS n FROM exact GROUP BY s1_id, tid"))
def _(p):
    return B.exact_candidates(p.s, p.t, B.BlockerConfig()).groupBy("s1_id", "tid").agg(F.count("*").alias("n"))


@define("join_ch6", sql(["exact"], "SELECT s1_id, tid, CAST(min(df) AS BIGINT) AS df FROM exact WHERE channel = 6 GROUP BY s1_id, tid"))
def _(p):
    return B.exact_candidates(p.s, p.t, B.BlockerConfig(channels=(6,))).groupBy("s1_id", "tid").agg(F.min("df").alias("df"))


@define("join_ch6_single", sql(["q6", "cap"], "SELECT DISTINCT q.s1_id, c.tid FROM q6 q JOIN cap c ON c.channel = 6 AND c.key = q.key WHERE q.n <= 1"))
def _(p):
    return B.exact_candidates(p.s, p.t, B.BlockerConfig(channels=(6,), tokens_to_query=1)).select("s1_id", "tid").distinct()


@define("join_ch5", sql(["ch5"], "SELECT s1_id, tid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ch5"))
def _(p):
    return B.ngram_candidates(p.s, p.t, B.BlockerConfig()).select("s1_id", "tid", F.round("score", 6).alias("score"), "rank")


_STAGES = """pool AS (SELECT *, shared / (q_grams + t_grams - shared) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, tid) AS n FROM overlap) WHERE n <= 100)"""


@define("join_two_stage", sql(["overlap"], "SELECT s1_id, tid, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY sim DESC, score DESC, tid) AS rank FROM pool) WHERE rank <= 25", _STAGES))
def _(p):
    return B.two_stage(_core(p.s, "s1_id"), _core(p.t, "tid")).select("s1_id", "tid", F.round("sim", 6).alias("sim"), "rank")


@define("join_lookup", sql(["pair"], "SELECT s1_id, tid, s.n_alnum AS s_name, t.n_alnum AS t_name FROM pair"))
def _(p):
    return p.pair.select("s1_id", "tid", F.col("s_n_alnum").alias("s_name"), F.col("t_n_alnum").alias("t_name"))


@define("join_gt", sql(["cand", "truth"], "SELECT c.s1_id, c.tid, z.tid IS NOT NULL AS is_true FROM cand c LEFT JOIN truth z ON z.s1_id = c.s1_id AND z.tid = c.tid"))
def _(p):
    return p.labelled.select("s1_id", "tid", (F.col("label") == 1).alias("is_true"))


@define("join_left_s1", sql(["won", "s"], "SELECT s.entity_id AS s1_id, w.tid FROM s LEFT JOIN won w ON w.s1_id = s.entity_id"))
def _(p):
    return D.with_all_records(RE.of_source(p.rec, "S1"), p.won)


@define("join_semi_ids", sql(["truth"], "SELECT entity_id FROM rec WHERE entity_id IN (SELECT tid FROM truth)"))
def _(p):
    return p.rec.join(p.truth.select(F.col("tid").alias("entity_id")), "entity_id", "left_semi").select("entity_id")


@define("join_anti", sql(["truth"], "SELECT entity_id FROM rec WHERE entity_id NOT LIKE 'S1-%' AND entity_id NOT IN (SELECT tid FROM truth)"))
def _(p):
    return RE.of_source(p.rec, "S2", "S3").join(p.truth.select(F.col("tid").alias("entity_id")), "entity_id", "left_anti").select("entity_id")


@define("join_theta", sql(["pair"], "SELECT s1_id, tid FROM pair WHERE jac(s.f_sig, t.f_sig) >= 0.4 AND jac(s.f_atokens, t.f_atokens) < 0.2"))
def _(p):
    return p.pair.filter((S.jaccard(F.col("s_f_sig"), F.col("t_f_sig")) >= 0.4) & (S.jaccard(F.col("s_f_atokens"), F.col("t_f_atokens")) < 0.2)).select("s1_id", "tid")


# ---- blocking objects and sets ---------------------------------------------------------


@define("blk_exact", sql(["exact"], "SELECT DISTINCT s1_id, tid FROM exact WHERE channel = 2"))
def _(p):
    return B.exact_candidates(p.s, p.t, B.BlockerConfig(channels=(2,))).select("s1_id", "tid").distinct()


@define("blk_iface", sql(["exact", "idx"], "SELECT (SELECT count(*) FROM (SELECT DISTINCT s1_id, tid FROM exact WHERE channel = 3)) AS pairs, CAST(count(*) AS BIGINT) AS unique_keys, CAST(sum(n) AS BIGINT) AS total_postings, CAST(max(n) AS BIGINT) AS max_size FROM (SELECT key, count(*) AS n FROM idx WHERE channel = 3 GROUP BY key)"))
def _(p):
    channel = B.BlockingChannel(3)
    pairs = channel.generate(p.s, p.t).agg(F.count("*").alias("pairs"))
    return pairs.join(F.broadcast(channel.stats(p.t).select("unique_keys", "total_postings", "max_size")))  # a row each


@define("blk_posting", sql(["overlap"], "SELECT s1_id, tid, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, tid) AS n FROM ov) WHERE n <= 25", """ov AS (SELECT a.entity_id AS s1_id, b.entity_id AS tid, round(sum(idf), 9) AS score FROM post a JOIN idf USING (ng) JOIN post b USING (ng)
 WHERE df <= least(3000, greatest(20, CAST(floor((SELECT count(*) FROM t WHERE ch1 <> '') * 0.02) AS BIGINT))) AND a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%' GROUP BY a.entity_id, b.entity_id)"""))
def _(p):
    o = B.ngram_overlaps(_core(p.s, "s1_id"), _core(p.t, "tid"), None, ratio=0.02)
    return B.best(o, 25, F.desc("score"), F.asc("tid")).select("s1_id", "tid", F.round("score", 6).alias("score"))


@define("blk_index", sql(["idx"], "SELECT channel, CAST(count(*) AS BIGINT) AS postings, CAST(count(DISTINCT key) AS BIGINT) AS keys FROM idx GROUP BY channel"))
def _(p):
    return p.idx.groupBy("channel").agg(F.count("*").alias("postings"), F.count_distinct("key").alias("keys"))


@define("blk_generate", sql(["cand"], "SELECT s1_id, tid, channel_mask, CAST(rarest_token_df AS BIGINT) AS rarest_token_df, round(ch5_score, 6) AS ch5_score FROM cand"))
def _(p):
    return p.cand.select("s1_id", "tid", "channel_mask", "rarest_token_df", F.round("ch5_score", 6).alias("ch5_score"))


_SETS = "ch_a AS (SELECT DISTINCT s1_id, tid FROM exact WHERE channel = 1), ch_b AS (SELECT DISTINCT s1_id, tid FROM exact WHERE channel = 4)"


def _two(p: Plan) -> tuple[DataFrame, DataFrame]:
    return tuple(B.exact_candidates(p.s, p.t, B.BlockerConfig(channels=(c,))).select("s1_id", "tid").distinct() for c in (1, 4))


@define("set_union", sql(["exact"], "SELECT * FROM ch_a UNION SELECT * FROM ch_b", _SETS))
def _(p):
    a, b = _two(p)
    return a.union(b).distinct()


@define("set_intersect", sql(["exact"], "SELECT * FROM ch_a INTERSECT SELECT * FROM ch_b", _SETS))
def _(p):
    a, b = _two(p)
    return a.intersect(b)


@define("set_except", sql(["exact"], "SELECT * FROM ch_a EXCEPT SELECT * FROM ch_b", _SETS))
def _(p):
    a, b = _two(p)
    return a.exceptAll(b)


@define("set_disjoint", sql(["rec"], "SELECT CAST(count(*) AS BIGINT) AS shared FROM rec a JOIN rec b ON a.entity_id = b.entity_id WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%'"))
def _(p):
    return RE.of_source(p.rec, "S1").join(RE.of_source(p.rec, "S2", "S3"), "entity_id").agg(F.count("*").alias("shared"))


@define("set_subset", sql(["won", "cand"], "SELECT CAST(count(*) AS BIGINT) AS outside FROM won w WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.s1_id = w.s1_id AND c.tid = w.tid)"))
def _(p):
    return p.won.join(p.cand, ["s1_id", "tid"], "left_anti").agg(F.count("*").alias("outside"))
