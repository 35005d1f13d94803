"""Randomised checks of the text operators against small pure-Python models."""

import random
import re


from credence.functions import text as T

PIECES = ["The", "le", "Être", "après", "fake", "news", "café", "x", "ab", "abc", "don't", "l'état",
          "123", "4th", "ÉCOLE", "naïve", "!!", "—", "😀", "\t", "\n", " ", "  ", "it's", "über",
          "Straße", "ﬁle", "KELVIN", "données", "vérité", "où", "very", "long", "words", "_x_"]


def _texts(n, seed=7):
    rng = random.Random(seed)
    return [" ".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def _model_terms(s):
    # words: maximal runs of a-z after lower-casing; keep len >= 3, not stop words
    words = [w for w in re.findall("[a-z]+", s.lower())
             if len(w) >= T.MIN_WORD_LEN and w not in T.STOP_WORDS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _model_tokens(s):
    return re.findall(r"[^\W]{2,}", s.lower())


def test_clean_terms_match_model(spark):
    texts = _texts(400)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", T.ngrams_1_2(T.clean_words("t")).alias("x")).collect()}
    for i, s in enumerate(texts):
        assert got[i] == _model_terms(s), s


def test_unicode_tokens_match_model(spark):
    texts = _texts(400, seed=11)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", T.unicode_tokens("t").alias("x")).collect()}
    mismatches = [s for i, s in enumerate(texts) if got[i] != _model_tokens(s)]
    assert not mismatches, mismatches[:3]


def test_strip_is_words_joined(spark):
    texts = _texts(200, seed=3)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", T.strip_non_letters("t").alias("s"), T.letter_words("t").alias("w")).collect()
    for r in rows:
        assert r["s"] == " ".join(r["w"])
        assert r["w"] == re.findall("[a-z]+", texts[r["i"]].lower())
