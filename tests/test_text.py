import pyarrow as pa
from pyspark.sql import functions as F

from termsieve.functions import clean, clean as C
from termsieve.plans import catalog


def one(spark, fn, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("t"))).collect()]


def test_emoticons_apply_in_order(spark):
    # Dots are blanked first, so `...` never matches; `:(` and `:)` shadow the longer forms.
    assert one(spark, C.clean_short_text, "hi :) >:( O:) ... 8) <3 !") == ["hi xb xe o xb xh xd xo"]


def test_empty_and_null_text(spark):
    for fn in (C.clean_short_text, C.clean_plain_text, C.clean_news_text, C.basic_text):
        assert one(spark, fn, "", None) == ["", ""]


def test_digits_include_super_and_subscripts(spark):
    assert one(spark, C.drop_digits, "a1²₃٣b") == ["ab"]


def test_whitespace_is_unicode(spark):
    assert one(spark, C.squash_whitespace, " a  \tb\x1cc ") == ["a b c"]


def test_contractions_split(spark):
    assert one(spark, C.tokenize_words, "Cannot cannot x_cannot gonna") == [["can", "not", "can", "not", "x_cannot", "gon", "na"]]


def test_tokens_start_with_ascii_letter(spark):
    assert one(spark, lambda c: C.filter_tokens(F.split(c, " ")), "a ab 1ab éa bé") == [["ab", "bé"]]


def test_message_noise(spark):
    text = "From: a\nSubject: b\n\nhello\n> quoted\nx writes:\nbody\n\n--\nsignature"
    assert one(spark, C.strip_message_noise, text, "no blank line") == ["hello\nbody\n", ""]


def test_stems(spark):
    pairs = {"caresses": "caress", "ponies": "poni", "dies": "die", "agreed": "agre", "hopping": "hop", "falling": "fall",
             "filing": "file", "happy": "happi", "enjoy": "enjoy", "relational": "relat", "rational": "ration",
             "generalization": "gener", "geology": "geolog", "controll": "control", "skies": "sky", "news": "news",
             "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate", "is": "is"}
    assert one(spark, C.porter_stem, *pairs) == list(pairs.values())


def test_stems_of_whole_texts_are_those_of_words(spark, monkeypatch):
    """Texts are stemmed word by word in Python by the same rules; a word that occurs again is not stemmed again."""
    ends = "s sses ies ied eed ed ing at y ational tional enci izer alli entli ization ation fulli logi icate ness ance ement ment ion ll e bbing".split()
    words = [f"{a}{e}" for a in ("", "t", "gr", "Y", "yel", "relat", "élan", "conform", "adj") for e in ends]
    texts = spark.createDataFrame([(words,), (words[:3] + [None],), ([],), (None,)], "w array<string>").coalesce(1)
    got = [r[0] for r in texts.select(C.stem_tokens(F.col("w"))).collect()]
    want = one(spark, C.porter_stem, *words)
    assert got == [want, want[:3] + [None], [], None]
    clean.stem_word.cache_clear()
    clean._stemmed(pa.array([["falling", "falling"], ["falling"]]))
    assert clean.stem_word.cache_info().misses == 1


def test_words_are_counted_before_they_are_stemmed(spark, tmp_path, monkeypatch):
    rows = [(i, "falling falls cannot, tea", "en") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = [], catalog.vectorize.conflate_tokens
    monkeypatch.setattr(catalog.vectorize, "conflate_tokens", lambda terms, *a: seen.append(terms.count()) or real(terms, *a))
    got = catalog.QUERIES["conflate_tokens"](spark, str(tmp_path)).collect()
    assert seen == [5] and {(r["term"], r["n"]) for r in got} == {("fall", 18), ("can", 9), ("not", 9), ("tea", 9)}
