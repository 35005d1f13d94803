"""Quality rules by distribution divergence (operator 1), DataFrame functions only.

A document's character classes and common words are compared, as
distributions, with those of its language by the Jensen-Shannon distance.  The
references are the means over all documents of a language that pass the base
rules.  Short texts are guarded: a histogram of few items says little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.blocks import materialize

# Frequent function words.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with", "on", "be", "at", "by"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["que", "el", "y", "los", "del", "se", "las", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
}
WORD_LIST = list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "symbol": "[^#*$%&|<>]+", "mark": "[^.,;:!?'\"()-]+"}   # what does not belong
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
CLASS_LIMIT, WORD_LIMIT, WORD_GUARD = 0.28, 0.25, 200     # distances; words a text must have for the word histogram to count
FEW = 10_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice: sort the windows, mark equal neighbours, add up the spans."""
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))

    def marked(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, j: (F.get(pairs, j - 1)["h"] == p["h"]) | (F.get(pairs, j + 1)["h"] == p["h"]))
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    def spanned(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0))
                .otherwise(_let(_let(pairs, marked), spanned)))
    return _let(windows, count).cast("long")


def _kept_length(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts and the two histograms (arrays of counts) of every row."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = base.select("*", words.alias("words"), lines.alias("lines"))
    word_chars = _kept_length(F.col("text"), r"[\x20\x09-\x0D]+")
    counts = split.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), word_chars.alias("word_chars"), F.length("text").cast("long").alias("chars"),
        *[_kept_length(F.col("text"), p).alias(f"class_{c}") for c, p in CLASSES.items()],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        _let(F.filter(F.transform("words", F.lower), lambda w: w.isin(WORD_LIST)),
             lambda hits: F.transform(F.array(*map(F.lit, WORD_LIST)), lambda c: F.size(F.filter(hits, lambda h: h == c)).cast("long"))).alias("common"))
    named = [F.col(f"class_{c}") for c in CLASSES]
    total = named[0] + named[1] + named[2] + named[3]
    common = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.select(
        "doc_id", "lang", "n_words", "word_chars", F.col("class_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.array(*named, F.col("chars") - F.col("word_chars"), F.col("word_chars") - total).alias("classes"),
        F.concat(F.col("common"), F.array(F.col("n_words") - common)).alias("common"))


def _shares(counts: str) -> Column:
    return _let(F.greatest(F.aggregate(F.col(counts), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1).cast("long")), lambda n: F.transform(F.col(counts), lambda x: x / n))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))))


def references(measured: DataFrame) -> DataFrame:
    """lang, class_ref, common_ref: mean shares of the documents that pass the base rules; a null lang is a group too."""
    good = measured.where(~F.col("base_failed")).select("lang", _shares("classes").alias("c"), _shares("common").alias("w"))
    sizes = {"c": len(CLASSES) + 2, "w": len(WORD_LIST) + 1}
    means = good.groupBy("lang").agg(*[F.avg(F.col(k)[i]).alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)])
    return means.select("lang", *[F.array(*[F.col(f"{k}{i}") for i in range(n)]).alias(name) for (k, n), name in zip(sizes.items(), ("class_ref", "common_ref"))])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", class_limit: float = CLASS_LIMIT,
                  word_limit: float = WORD_LIMIT, word_guard: int = WORD_GUARD, refs: DataFrame | None = None) -> DataFrame:
    """Base counts, the two distances and the verdict of every row.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept.  ``kept`` is false where
    the base rules fail, where the character classes are farther than
    ``class_limit`` from those of the language, or, for texts of at least
    ``word_guard`` words, the common words farther than ``word_limit``.

    ``refs``: references as from ``references(measures(..))`` of texts that are
    known to be good.  By default they are the means of the judged table
    itself, so a language whose rows are mostly bad defines its own reference.

    A null or empty text has no words and fails the base rules.  Rows with a
    null or unknown lang (or without such a column) are a group with a
    reference of its own; a group in which no row passes has null distances.
    Repeated rows get equal results.  An empty table gives an empty result.
    Columns other than the three are not read.
    """
    measured = materialize(measures(docs, id_col, text_col, lang_col))
    refs = materialize(references(measured) if refs is None else refs.select("lang", "class_ref", "common_ref"))
    refs = F.broadcast(refs) if refs.count() <= FEW else refs
    both = measured.alias("m").join(refs.alias("r"), F.col("m.lang").eqNullSafe(F.col("r.lang")), "left").select("m.*", "class_ref", "common_ref")
    judged = both.select("*", js_distance(_shares("classes"), F.col("class_ref")).alias("class_distance"), js_distance(_shares("common"), F.col("common_ref")).alias("word_distance"))
    far = (F.col("class_distance") > class_limit) | ((F.col("n_words") >= word_guard) & (F.col("word_distance") > word_limit))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance",
                         (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))
