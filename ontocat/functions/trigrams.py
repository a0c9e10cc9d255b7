"""Trigram sets with the usual trigram-similarity rules, as built-in column expressions.

Text is lower-cased and split into words (maximal runs of letters and digits);
each word is padded with two leading blanks and one trailing blank, and every
3-character window of the padded word is a trigram. The result is the *set*
of trigrams. Similarity of two texts is ``|A n B| / |A u B|``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SPLIT = r"[^\p{L}\p{N}]+"

# Default match threshold 0.3, kept as an exact fraction so ``shared/union >=
# 0.3`` is tested in integers: ``10 * shared >= 3 * union``.
THRESHOLD_NUM, THRESHOLD_DEN = 3, 10


def trigrams(text: Column | str) -> Column:
    """``array<string>`` of distinct trigrams of ``text``.

    Words are rewritten into one string of padded words separated by ``|``
    (``"  w1 |  w2 "``); every overlapping 3-character window that contains no
    separator is a trigram. One ``regexp_extract_all`` with a look-ahead
    capture yields all windows, so no per-element lambda is evaluated, and
    one regex replacement prepares the text.
    """
    t = F.col(text) if isinstance(text, str) else text
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(t), WORD_SPLIT, " |  "), F.lit(" "))
    windows = F.regexp_extract_all(padded, F.lit(r"(?=([^|]{3}))"), F.lit(1))
    # Separators at the ends (or an empty text) only add windows that hold a
    # '|' or are all blank; no window of a real word is all blank.
    return F.array_remove(F.array_distinct(windows), F.lit("   "))


def similar_enough(shared: Column, n_left: Column, n_right: Column,
                   num: int = THRESHOLD_NUM, den: int = THRESHOLD_DEN) -> Column:
    """``shared / (n_left + n_right - shared) >= num/den`` without floating point."""
    union = n_left + n_right - shared
    return (union > 0) & (F.lit(den) * shared >= F.lit(num) * union)
