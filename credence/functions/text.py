"""Column expressions for article text: titles, cleaning, tokens, n-grams.

Every function here maps Columns to a Column and stays inside the JVM
(built-in string, regex and higher-order array functions); nothing calls
back into Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The bilingual stop-word list (English then French) that the
# cleaning step removes.  Kept verbatim, in its natural order, because the
# cleaned text must equal the reference's.  Entries with apostrophes or
# accents can never match after the a-z strip; they are kept for parity.
STOP_WORDS_LIST = (
    # English
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "she's", "her", "hers", "herself",
    "it", "it's", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "that'll", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and",
    "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in",
    "out", "on", "off", "over", "under", "again", "further", "then", "once",
    # French
    "je", "tu", "il", "elle", "nous", "vous", "ils", "elles", "le", "la",
    "les", "un", "une", "des", "ce", "cette", "ces", "mon", "ton", "son",
    "ma", "ta", "sa", "mes", "tes", "ses", "notre", "votre", "leur", "nos",
    "vos", "leurs", "qui", "que", "quoi", "dont", "où", "quand", "comment",
    "pourquoi", "quel", "quelle", "quels", "quelles", "et", "ou", "mais",
    "donc", "car", "si", "dans", "sur", "sous", "avec", "sans", "pour",
    "par", "de", "à", "vers", "chez", "entre", "pendant", "après", "avant",
    "depuis", "dès", "durant", "être", "avoir", "faire", "dire", "aller",
    "voir", "venir", "devoir", "vouloir", "pouvoir", "falloir", "très",
    "plus", "moins", "peu", "beaucoup", "trop", "assez", "tout", "tous",
    "toute", "toutes", "aucun", "aucune", "même", "aussi", "alors", "donc",
)
# Minimum word length kept by the cleaner (words of <= 2 letters are dropped).
MIN_WORD_LEN = 3
# Title synthesised from the first 100 characters of the text plus an ellipsis.
TITLE_PREFIX_CHARS = 100
TITLE_SUFFIX = "..."
# Literal that a missing title/text becomes when stringified (parity mode).
NULL_TEXT = "nan"
# End of fixed values.
# ---------------------------------------------------------------------------

STOP_WORDS = frozenset(STOP_WORDS_LIST)


def effective_stop_words(min_len: int = MIN_WORD_LEN) -> list[str]:
    """Stop words that can still match after the a-z strip and length filter.

    Words with accents/apostrophes or shorter than ``min_len`` are already
    removed by the other rules, so testing them would be wasted work.
    """
    return sorted(w for w in STOP_WORDS
                  if len(w) >= min_len and w.isascii() and w.isalpha())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- projections (P4 - P8) --------------------------------------------------

def synth_title(text: Column | str, n: int = TITLE_PREFIX_CHARS) -> Column:
    """First ``n`` characters (code points) of the text followed by '...'.

    NULL text gives a NULL title.
    """
    return F.concat(F.substring(_col(text), 1, n), F.lit(TITLE_SUFFIX))


def stringify(c: Column | str, null_as: str = NULL_TEXT) -> Column:
    """Missing value -> literal text (``'nan'`` reproduces Python's str(NaN))."""
    return F.coalesce(_col(c), F.lit(null_as))


def weighted_text(title: Column | str, text: Column | str, title_weight: int = 2,
                  null_as: str = NULL_TEXT) -> Column:
    """Document with the title repeated ``title_weight`` times before the text."""
    t = stringify(title, null_as)
    return F.concat_ws(" ", *([t] * title_weight), stringify(text, null_as))


def optional_title_text(title: Column | str, text: Column | str) -> Column:
    """``title text`` when the title is non-empty, otherwise the text alone."""
    t = _col(title)
    return F.when(t.isNotNull() & (F.length(t) > 0),
                  F.concat_ws(" ", t, _col(text))).otherwise(_col(text))


# --- cleaning and tokens (T1 - T6) -----------------------------------------

def strip_non_letters(c: Column | str) -> Column:
    """Lower-case; every run of characters outside a-z becomes one space."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z]+", " "))


def letter_words(c: Column | str) -> Column:
    """Words of the a-z-only text: maximal runs of a-z after lower-casing."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z]+)"), 1)


def remove_stop_words(words: Column, min_len: int = MIN_WORD_LEN) -> Column:
    """Drop stop words and words shorter than ``min_len`` (order kept).

    The membership test is an ``IN`` list, which the optimizer turns into a
    hash-set lookup (``InSet``) instead of a linear scan per word.
    """
    stops = effective_stop_words(min_len)
    return F.filter(words, lambda w: (F.length(w) >= min_len) & ~w.isin(*stops))


def clean_words(c: Column | str) -> Column:
    """T1 + T2 + T3: the cleaned word sequence of a text."""
    return remove_stop_words(letter_words(c))


def join_words(words: Column) -> Column:
    return F.array_join(words, " ")


def unicode_tokens(c: Column | str) -> Column:
    """Lower-cased runs of at least two Unicode letters/digits/underscores."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("([\\p{L}\\p{N}_]{2,})"), 1)


def bigrams(words: Column) -> Column:
    """Adjacent word pairs joined by a space, in sequence order."""
    m = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, m), F.slice(words, 2, m),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def ngrams_1_2(words: Column) -> Column:
    """Unigrams followed by bigrams of the (already cleaned) sequence."""
    return F.concat(words, bigrams(words))
