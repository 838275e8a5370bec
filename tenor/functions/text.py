"""String column expressions (JVM-side, no Python UDFs).

The reference's regular expressions are Python ``re`` with Unicode classes.
Java's ``\\s`` and ``\\w`` are ASCII, so the classes are spelled out:

* space  = Python ``\\s`` / ``str.isspace``: ASCII space chars, U+000B,
  U+001C..U+001F, U+0085 and every ``\\p{Z}`` code point;
* word   = Python ``\\w``: letters, numbers, underscore;
* letter = Python ``[^\\W\\d_]``: letters plus letter-like and other numbers.

The same class text runs unchanged in DuckDB (RE2), which the oracle uses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NON_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
# Lexicon tokens: runs of word characters and apostrophes (both forms), emoticons, single emoji.
EMOTICON = r"[:;=][-o]?[()DPp/|*]"
EMOJI = r"[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]"
TOKEN = rf"[\p{{L}}\p{{N}}_'’]+|{EMOTICON}|{EMOJI}"

URL = rf"https?://{NON_SPACE}+|www\.{NON_SPACE}+"
HANDLE = rf"@{WORD}+"

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for the same results.
# Keyword lists of the trust/distrust flags, in their original order; both
# apostrophe forms are listed on purpose.
DISTRUST_TERMS = [
    "lying", "lies", "don’t trust", "don't trust", "corrupt",
    "propaganda", "misleading", "brainwash", "cover-up", "fake",
    "hoax", "scam", "deceive",
]
TRUST_TERMS = [
    "i trust", "honest", "truthful", "reliable", "credible",
    "transparent", "always tell the truth", "i believe them",
    "believe it", "trust", "genuine",
]
# Music-video exclusion: keywords in title or description, marker in channel.
MUSIC_KEYWORDS = ["official music video", "lyrics", "remix"]
MUSIC_CHANNEL_MARKERS = ["vevo"]
# Title prefix of the classifier input.
TITLE_PREFIX_OPEN = "[Video title: "
TITLE_PREFIX_CLOSE = "] "
# ---------------------------------------------------------------------------


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_letter(text) -> Column:
    """P5: true if the text has a letter; null text counts as no letter."""
    return F.coalesce(col(text).rlike(LETTER), F.lit(False))


def is_blank(text) -> Column:
    """True for null or whitespace-only text (Python ``not s.strip()``)."""
    return ~F.coalesce(col(text).rlike(NON_SPACE), F.lit(False))


def clean_text(text, collapse: bool = True) -> Column:
    """Lowercase; URLs and @handles -> space; whitespace runs -> one space; strip.

    Null text becomes '' (decision D8, instead of the string 'nan'). Without ``collapse`` the whitespace stays as it
    is, for who takes the words next and so drops it anyway."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    # A search for letters that every match has costs far less than a trial of the pattern at every letter.
    t = F.when(t.contains("://") | t.contains("www."), F.regexp_replace(t, URL, " ")).otherwise(t)
    t = F.when(t.contains("@"), F.regexp_replace(t, HANDLE, " ")).otherwise(t)
    # After the collapse the only whitespace left at either end is one ' '.
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " ")) if collapse else t


def with_title_prefix(text, title) -> Column:
    """``[Video title: T] `` + text when T is a non-blank string; T is kept as is."""
    return F.when(~is_blank(title),
                  F.concat(F.lit(TITLE_PREFIX_OPEN), col(title), F.lit(TITLE_PREFIX_CLOSE), col(text))
                  ).otherwise(col(text))


def preprocess(text, title, use_title_prefix: bool = True, clean_like_old: bool = True, collapse: bool = True) -> Column:
    """P7 then P8, each switched by its flag."""
    t = clean_text(text, collapse) if clean_like_old else F.coalesce(col(text), F.lit(""))
    return with_title_prefix(t, title) if use_title_prefix else t


def contains_any(text_lower, terms) -> Column:
    """Substring (not word) match of any term; terms are data."""
    c = col(text_lower)
    return reduce(lambda a, b: a | b, [c.contains(F.lit(t)) for t in terms], F.lit(False))


def occurrences(text_lower, term: str) -> Column:
    """Non-overlapping literal occurrences of ``term`` (Python ``str.count``)."""
    c = F.coalesce(col(text_lower), F.lit(""))
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("bigint")


def occurrences_of(text_lower, term: Column) -> Column:
    """Like :func:`occurrences`, with the term in a column: sizes in bytes, which are known without a look at the text."""
    c = F.coalesce(col(text_lower), F.lit(""))
    return ((F.octet_length(c) - F.octet_length(F.replace(c, term, F.lit("")))) / F.octet_length(term)).cast("bigint")


def is_music_video(title, description, channel,
                   keywords=MUSIC_KEYWORDS, channel_markers=MUSIC_CHANNEL_MARKERS) -> Column:
    """A keyword in the lowercased title or description, or a marker in the channel."""
    t = F.lower(F.coalesce(col(title), F.lit("")))
    d = F.lower(F.coalesce(col(description), F.lit("")))
    ch = F.lower(F.coalesce(col(channel), F.lit("")))
    return contains_any(t, keywords) | contains_any(d, keywords) | contains_any(ch, channel_markers)


def tokens(text) -> Column:
    """Lexicon tokens in text order (case kept)."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(TOKEN), 0)


def words(text) -> Column:
    """Whitespace-separated words (the word-window unit, W8)."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(f"{NON_SPACE}+"), 0)
