"""Normalization, keys and n-grams on literal values."""

from pyspark.sql import functions as F

from linkweave.functions import keys as K
from linkweave.functions.text import with_normalized


def profile(spark, name="", address="", entity="S2-1", country="US"):
    df = spark.createDataFrame([(entity, name, address, country)], "entity_id string, business_name string, business_address string, country string")
    return K.with_profiles(df).first()


def test_dotted_suffix_is_found(spark):
    p = profile(spark, "Fractales Amis Groupe S.A.S")
    assert p.n_legal == ["sas"] and p.n_sig == ["fractales", "amis", "groupe"]


def test_indic_words_stay_whole(spark):
    assert len(profile(spark, "श्री गणेश ट्रेडिंग कंपनी").n_tokens) == 4
    assert len(profile(spark, "ஸ்ரீ முருகன் ஸ்டோர்ஸ்").n_tokens) == 3
    assert profile(spark, "श्री गणेश").f_non_latin


def test_accents_and_ampersand(spark):
    p = profile(spark, "Café & Crème")
    assert p.n_tokens == ["cafe", "and", "creme"] and p.n_sig == ["cafe", "creme"]


def test_nbsp_is_a_blank(spark):
    assert profile(spark, "Acme Corp").n_tokens == ["acme", "corp"]


def test_ordinals_have_no_number(spark):
    assert profile(spark, address="45th Street 12").a_numbers == ["12"]
    assert profile(spark, address="AF-0684, Nandgram").a_numbers == ["0684"]


def test_street_keys(spark):
    p = profile(spark, address="85 Wayne Avenue, Ticonderoga, NY")
    assert (p.ch3, p.ch4) == ("85_wayne", "85_ticonderoga") and p.ch7 == ["85_wayne", "85_ticonderoga"]
    assert profile(spark, address="AF-0684, Nandgram, Ghaziabad").ch3 == "684_nandgram"
    assert profile(spark, address="Mack Rd, Haltom City, Texas").ch3 == ""


def test_repeated_tokens_count_once_for_ch6(spark):
    assert profile(spark, "Sncx Sncx").ch6 == ["sncx"]


def test_short_texts(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("",)], "t string").select("t", K.char_ngrams(F.col("t"), 3, True).alias("block"), K.char_ngrams(F.col("t"), 3, False).alias("feature"))
    assert {r.t: (r.block, r.feature) for r in df.collect()} == {"ab": (["ab"], []), "abc": (["abc"], ["abc"]), "": ([], [])}


def test_top2_differs_from_ch2(spark):
    p = profile(spark, "zeta beta alpha")
    assert p.n_top2 == ["beta", "zeta"] and p.ch2 == "alpha_beta"


def test_nulls_are_empty(spark):
    df = spark.createDataFrame([(None, "x")], "business_name string, k string")
    assert with_normalized(df, "business_name", "n_", True).first().n_tokens == []


def test_accents_go_in_place_as_by_decomposition(spark):
    import random
    import unicodedata

    from pyspark.sql import functions as F

    from linkweave.functions import text as T

    r = random.Random(0)
    chars = [chr(i) for i in [*range(0x20, 0x250), *range(0x300, 0x310), *range(0x370, 0x400), *range(0x900, 0x980), *range(0x1E00, 0x1E80), *range(0xFB00, 0xFB07), 0xBD, 0x212B, 0xAC00, 0x4E2D, 0x1F600]]
    rows = ["".join(r.choice(chars) for _ in range(r.randrange(1, 9))) for _ in range(3000)] + [*chars, "", "plain", None, "é", "é", "Ünïcödé ß"]
    got = {x.i: x.v for x in spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", T.without_accents(F.col("t")).alias("v")).collect()}
    want = {i: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c) or "ऀ" <= c <= "ൿ") for i, t in enumerate(rows)}
    assert got == want
