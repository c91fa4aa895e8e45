"""With by_country, each country has its own cap and frequencies."""

from linkweave.operators import blocking as B

KEYS = "entity_id string, country string, ch1 string, ch6 array<string>"


def test_each_country_has_its_own_postings(spark):
    targets = spark.createDataFrame([(f"S2-{i}", "en" if i < 5 else "fr", "k", ["t"]) for i in range(8)], KEYS)
    queries = spark.createDataFrame([("S1-1", "fr", "k", ["t"]), ("S1-2", "en", "k", ["t"])], KEYS)
    def got(**more):
        return sorted((r.s1_id, r.tid, r.channel, r.df) for r in B.exact_candidates(queries, targets, B.BlockerConfig(bucket=2, token_max_df=4, channels=(1, 6), **more)).collect())
    # 8 records have the token t over all countries, 3 of them in fr and 5 in en.
    assert got(by_country=True) == [("S1-1", "S2-5", 1, 0), ("S1-1", "S2-5", 6, 3), ("S1-1", "S2-6", 1, 0), ("S1-1", "S2-6", 6, 3), ("S1-2", "S2-0", 1, 0), ("S1-2", "S2-1", 1, 0)]
    assert got() == [(s, t, 1, 0) for s in ("S1-1", "S1-2") for t in ("S2-0", "S2-1")]
