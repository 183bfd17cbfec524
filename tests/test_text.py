import pytest
from pyspark.sql import functions as F

from kinweave.functions import text as X


def value(spark, column, **inputs):
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in inputs.items()]).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "name, core, forms",
    [("Acme Pvt. Ltd.", "acme", "limited|private"), ("The Smith & Sons Co", "smith sons", "company"), ("Front Desk Inc", "front desk", "inc"), ("", "", ""), (None, "", ""), ("Café Müller GmbH", "cafe muller gmbh", ""), ("grill_2 O'Brien", "grill_2 o brien", "")],
)
def test_names(spark, name, core, forms):
    tokens = X.tokenize(F.col("x"))
    assert value(spark, X.name_core(tokens), x=name) == core
    assert value(spark, X.legal_forms(tokens), x=name) == forms


def test_address(spark):
    raw = "12-A Near SBI ATM, MG Rd 560004"
    tokens = X.tokenize(F.col("x"))
    assert value(spark, X.address_core(tokens), x=raw) == "12 sbi atm mg road 560004"
    assert value(spark, X.numbers(F.col("x")), x=raw) == "12|560004"
    assert value(spark, X.landmarks(tokens), x=raw) == "near"
    assert value(spark, X.address_core(tokens), x="Opp. Opposite St") == "street"
    assert value(spark, X.landmarks(tokens), x="Opp. Opposite St") == "opp|opposite"


def test_numbers_of_other_scripts(spark):
    assert value(spark, X.numbers(F.col("x")), x="मार्ग ४२ No 7 7") == "४२|7|7"


@pytest.mark.parametrize("raw, code", [("ashcraft", "a226"), ("tymczak", "t522"), ("lee", "l000"), ("123", ""), ("boards", "b632"), ("moon", "m500"), ("", "")])
def test_soundex(spark, raw, code):
    assert value(spark, X.soundex(F.col("x")), x=raw) == code


@pytest.mark.parametrize("raw, grams", [("ab", ["ab"]), ("", []), (None, []), ("abcd", ["abc", "bcd"]), ("aaaa", ["aaa"])])
def test_char_ngrams(spark, raw, grams):
    assert value(spark, X.char_ngrams(F.col("x")), x=raw) == grams


def test_word_ngrams(spark):
    assert value(spark, X.word_ngrams(F.col("x")), x="ab c") == [" ab", "ab ", " ab ", " c "]


def test_folding(spark):
    assert value(spark, X.transliterate(F.col("x")), x="Straße Œuvre łódź") == "Strasse OEuvre lodz"
    assert value(spark, X.strip_accents(F.col("x")), x="déjà ñ ﬁ") == "deja n fi"
    assert value(spark, X.transliterate(F.col("x")), x="खान") == "khan"
    assert value(spark, X.strip_accents_exact(F.col("x")), x="déjà ﬁ ½") == "deja fi 1⁄2"


def test_non_latin(spark):
    assert value(spark, X.has_non_latin(F.col("x")), x="café") is False
    assert value(spark, X.has_non_latin(F.col("x")), x="cafe मार्ग") is True
    assert value(spark, X.has_non_latin(F.col("x")), x=None) is False


def test_normalize_adds_columns(spark):
    rows = spark.createDataFrame([("S1-1", "Moon Boards", "12 Main St Kanpur 208001", " IN ")], "entity_id string, business_name string, business_address string, country string")
    got = X.normalize(rows).first()
    assert got.name_norm == "moon boards" and got.address_norm == "12 main street kanpur 208001"
    assert got.combined_norm == "moon boards 12 main street kanpur 208001  IN"
    assert got.country_norm == "in" and got.address_numbers == "12|208001"


def test_gram_codes_are_the_grams(spark):
    rows = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("é日x𝒳yz",)], "t string")
    for r in rows.select(X.char_ngrams(F.col("t")).alias("g"), X.char3gram_codes(F.col("t")).alias("c")).collect():
        want = [sum(ord(ch) << s for ch, s in zip(g, (42, 21, 0))) for g in r.g]
        assert r.c == want


def test_greek_and_cyrillic(spark):
    rows = spark.createDataFrame([("Αθήνα Ψυχή λόγος",), ("Москва, улица Щукина 5",), ("Київ йод єдність",)], "t string")
    assert [r[0] for r in rows.select(X.transliterate(F.col("t"))).collect()] == ["Athina Psychi logos", "Moskva, ulitsa Shchukina 5", "Kiiv yod yednist"]
    assert rows.select(X.strip_accents(F.col("t"))).first()[0] == "Αθηνα Ψυχη λογος"
