"""Text expressions, as SQL that Spark and an ANSI engine both read, or as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode ranges of the script's letters, by what they do in a syllable.
VOWELS = "\u0904-\u0914\u0960\u0961"
CONSONANTS = "\u0915-\u0939\u0958-\u095F\u0978-\u097A"
MARKS = "\u093A\u093B\u093E-\u094C\u094E\u094F\u0962\u0963\u0901-\u0903\u093C\u0951-\u0957"
JOINER = "\u094D"
BARE = "\u0915-\u0939\u0958-\u095F\u0978-\u097B\u097D\u094D"
#: One orthographic syllable, or one other character.
SYLLABLE = f"(?:[{VOWELS}{CONSONANTS}]|{JOINER}+[{CONSONANTS}]?)(?:{JOINER}+[{CONSONANTS}]?|[{MARKS}])*|[\\s\\S]"
#: Words that the alignment trainer takes.
CLEAN = "\\A[a-z]{1,24}\\z"


def syllables(dev: Column) -> Column:
    return F.regexp_extract_all(dev, F.lit(SYLLABLE), F.lit(0))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collapse_vowels(s: Column) -> Column:
    """Runs of one vowel become one of it; case counts."""
    return F.regexp_replace(s, "([aeiouAEIOU])\\1+", "$1")


def trim_all(s: Column) -> Column:
    return F.regexp_replace(s, "(?U)\\A\\s+|\\s+\\z", "")


def deletes(word: Column) -> Column:
    """The word and what is left after deleting one or two of its characters, each once."""

    def less(w: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, cut).otherwise(F.array().cast("array<string>"))

    one = F.array_distinct(less(word))
    two = F.flatten(F.transform(one, less))
    return F.array_distinct(F.concat(F.array(word), one, two))


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, null beyond ``most``."""
    d = F.levenshtein(a, b, most)
    return F.when(d >= 0, d)


# The romanisation that derives native words from roman ones.
_DIGRAPHS = [("kh", "K"), ("gh", "G"), ("ch", "C"), ("th", "T"), ("dh", "D"), ("ph", "P"), ("bh", "B"), ("sh", "S"), ("aa", "A"), ("ee", "I"), ("oo", "U"), ("ai", "E"), ("au", "O")]
_ROMAN_CONSONANTS = "KGCTDPBSkgcjtdnpbmyrlvshfzqxw"
_NATIVE_CONSONANTS = "खघछथधफभशकगचजतदनपबमयरलवसहफजककव"
_ROMAN_VOWELS = "AIUEOaiueo"
_INDEPENDENT = [("A", "आ"), ("I", "ई"), ("U", "ऊ"), ("E", "ऐ"), ("O", "औ"), ("a", "अ"), ("i", "इ"), ("u", "उ"), ("e", "ए"), ("o", "ओ")]
_SIGNS = ("AIUEOiueo", "ाीूैौिुेो")


def derived(column: str, *, group: str = "$", flag: str = "") -> str:
    """SQL for the native form of a lower-case roman word. ``group`` and ``flag``: how the engine writes replacements."""

    def swap(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}'{flag})"

    x = column
    for a, b in _DIGRAPHS:
        x = f"replace({x}, '{a}', '{b}')"
    c, v = f"([{_ROMAN_CONSONANTS}])", f"([{_ROMAN_VOWELS}])"
    for _ in range(2):
        x = swap(x, c + c, f"{group}1{JOINER}{group}2")
    for _ in range(2):
        x = swap(x, v + v, f"{group}1@{group}2")
    x = swap(x, f"^{v}", f"@{group}1")
    for a, b in _INDEPENDENT:
        x = f"replace({x}, '@{a}', '{b}')"
    return f"translate({x}, '{_ROMAN_CONSONANTS}{_SIGNS[0]}a', '{_NATIVE_CONSONANTS}{_SIGNS[1]}')"
