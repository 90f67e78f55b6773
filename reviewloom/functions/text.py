"""Column functions over review text: standardizing, tokenizing, filtering."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contractions and what they become, in the order in which they apply. Each is written with an ASCII,
# a curly and an acute apostrophe.
CONTRACTIONS = (("'m", " am"), ("'ve", " have"), ("'d", " would"), ("n't", " not"), ("'ll", " will"), ("'s", " is"))
APOSTROPHES = ("'", "’", "´")
# Fixed value: code-point ranges of pictographs.
EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]"
# Fixed value: digits and symbols that standardizing drops.
SYMBOLS = "[0-9$&~\\\\()\\[\\]{}<>%'\"“”‘’，;…+\\-_=*]+"
# Rules that follow the contractions in the first form, in this order.
RULES = (
    ("\\b\\w+\\.\\s*com\\b", "QQCOM"),
    ("/", " "),
    ("\\.+", ". "),
    ("!+", "! "),
    ("\\?+", "? "),
    ("€+", ""),
    (SYMBOLS, ""),
    ("http\\S+", ""),
    ("http", ""),
    ("@\\S+", ""),
    ("@", "at"),
)
# The same for the second form, where a curly apostrophe alone is " is" before its s is reached.
PLAIN_RULES = (
    ("/", " "),
    ("\\.{2,}", "."),
    ("!{2,}", "!"),
    ("\\?{2,}", "?"),
    *RULES[5:],
)

_WS = "[ \\t\\n\\r\\f\\x0B]"


def strip(x: Column) -> Column:
    """x without white space at its ends; Spark's trim takes blanks only."""
    return F.regexp_replace(F.regexp_replace(x, f"^{_WS}+", ""), f"{_WS}+$", "")


def _chain(x: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The rules one after the other; a pattern without special characters is replaced as it stands, which is faster."""
    plain = lambda p: not set(p) & set("\\.[]{}()*+?^$|")
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])) if plain(r[0]) else F.regexp_replace(c, *r), rules, x)


def contraction_rules(curly_s: str = "’s") -> list[tuple[str, str]]:
    rules = [(short.replace("'", a), long) for short, long in CONTRACTIONS for a in APOSTROPHES]
    return [(curly_s if short == "’s" else short, long) for short, long in rules]


def standardize(x: Column) -> Column:
    """Review text in the first standard form: no emoji, lower case, contractions written out, web names as QQCOM,
    slashes as blanks, runs of . ! ? as one with a blank, no euro signs, digits or symbols, no links or mentions."""
    return _chain(F.lower(F.regexp_replace(x, EMOJI, "")), [*contraction_rules(), *RULES])


def standardize_plain(x: Column) -> Column:
    """The second standard form: emoji and web names stay, repeated . ! ? are one, lower case comes last."""
    return F.lower(_chain(x, [*contraction_rules("’"), *PLAIN_RULES]))


def gap_tokens(x: Column) -> Column:
    """Words between runs of white space, comma, full stop, question mark, hyphen and everything from ! to the colon."""
    return F.filter(F.split(x, "[ \\t\\n\\r\\f\\x0B,.?!-:\\-]+"), lambda t: t != "")


def vector_tokens(x: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(x), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))


def letter_tokens(x: Column) -> Column:
    """Runs of two or more ASCII letters."""
    return F.regexp_extract_all(x, F.lit("[a-zA-Z]{2,}"), F.lit(0))


def sentences(x: Column) -> Column:
    """Pieces up to a . ! or ? before white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(x, "(?<=[.!?])[ \\n\\t]+"), strip), lambda s: s != "")


def long_enough(x: Column, least: int, most: int | None = None) -> Column:
    n = F.length(strip(x))
    return (n >= least) if most is None else n.between(least, most)


def kept_tokens(tokens: Column, stopwords: Iterable[str], least: int = 3) -> Column:
    words = list(stopwords)
    return F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.isin(words))


def slug(x: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(x, "[.,']", ""), F.lit(" "), F.lit("_")))


def han_bigrams(x: Column) -> Column:
    """Neighbouring pairs of Han characters."""
    runs = F.regexp_extract_all(x, F.lit("[\\p{IsHan}]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) > 1), pairs))


def snippet(x: Column, at: Column, most: int = 80, reach: int = 10) -> Column:
    """The words of x around its character number `at`, from 0: x itself where it has at most `most` characters, else the
    word there or after it with up to reach words on both sides, as many as fit; empty where none does.

    Words end at single blanks. The place where word j begins follows from the length of the first j words.
    """
    begin = lambda j: F.when(j <= 0, 0).otherwise(F.length(F.call_function("substring_index", x, F.lit(" "), j)) + 1)
    word = F.when(at > 0, 1 + F.length(F.left(x, at - 1)) - F.length(F.replace(F.left(x, at - 1), F.lit(" "), F.lit("")))).otherwise(0)

    def around(r: Column) -> Column:
        start = begin(word - r)
        return F.substring(x, start + 1, F.greatest(begin(word + r + 1) - start, F.lit(0)))

    fits = F.filter(F.transform(F.sequence(F.lit(reach), F.lit(0)), around), lambda s: F.length(s) <= most)
    return F.when(F.length(x) <= most, strip(x)).otherwise(strip(F.coalesce(F.get(fits, 0), F.lit(""))))
