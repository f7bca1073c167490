"""Column expressions that normalise, count and cut texts. Patterns hold in Java's and in RE2's syntax."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that the normal form drops, folds or turns into spaces.
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{08D3}-\x{08FF}]"
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
WESTERN = "01234567890123456789"
TATWEEL = r"\x{0640}"
FOLDED, FOLDS = "أإآٱةى", "ااااهي"
PUNCTUATION = r"[،؛؟,.;:!?\"'«»()\[\]{}–—…/\\|*+~^%$#@&_=<>-]"
WHITE = r"[\t\n\x0B\x0C\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
CONTROLS = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
LETTERS = r"[ء-يٱ]"
LOAD_MARKS = r"[\x{064B}-\x{065F}\x{0670}]"
NUMBER_RUN = r"[0-9٠-٩۰-۹]+(?:[,.٫٬][0-9٠-٩۰-۹]+)*"
OPENING, OPENING_WORDS = "بسم الله", 4
LONGEST_MESSAGE = 500
LONGEST_EXCERPT, SHORTEST_CUT = 220, 180


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def western_digits(text: Column) -> Column:
    return F.translate(text, DIGITS, WESTERN)


#: Spaces and punctuation of the normal form, without the plain space, and those up to U+00FF.
_GAPS = WHITE[1:-2].replace(" ", "") + PUNCTUATION[1:-1]
_LATIN_GAPS = r"\t\n\x0B\x0C\r\x{00A0}.,;:!?\"'«»()\[\]{}/\\|*+~^%$#@&_=<>-"


def _spaced(text: Column, gaps: str) -> Column:
    """Each stretch of gaps and spaces as one space; a lone space is no match."""
    return F.regexp_replace(text, f" [ {gaps}]+|[{gaps}][ {gaps}]*", " ")


def normalize(text: Column) -> Column:
    """The form in which texts are compared: no marks, folded letters, lower case, no punctuation, single spaces. Null stays null.

    One pattern takes marks and tatweel away, one table folds digits and letters, and one pattern
    makes each stretch of punctuation and white space a space. Texts without a character beyond
    U+00FF have nothing to take away or fold, and a pattern of such characters only is a table of bits.
    """
    bare = F.regexp_replace(text, MARKS[:-1] + TATWEEL + "]+", "")
    folded = F.translate(bare, DIGITS + FOLDED, WESTERN + FOLDS)
    full = _spaced(F.lower(folded), _GAPS)
    return F.trim(F.when(text.rlike(r"[^\x{0000}-\x{00FF}]"), full).otherwise(_spaced(F.lower(text), _LATIN_GAPS)))


def normalize_for_load(text: Column) -> Column:
    """The form that the loading step writes: fewer marks go, and all but Arabic characters and spaces."""
    folded = F.translate(F.regexp_replace(text, LOAD_MARKS, ""), "إأآٱىة", "اااايه")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[^\\x{0600}-\\x{06FF}" + WHITE[1:-2] + "]", ""), WHITE, " "))


def loose_key(norm: Column) -> Column:
    """The normal form without any alif that doesn't begin a word."""
    return F.regexp_replace(norm, "([^ ])ا+", "$1")


def loose(phrase: str) -> str:
    """The same of a phrase that is a part of the plan."""
    return re.sub("([^ ])ا+", r"\1", phrase)


def has_phrase(norm: Column, phrase: str) -> Column:
    """Whether the normal form has the phrase, or the loose form the phrase's."""
    return norm.contains(phrase) | loose_key(norm).contains(loose(phrase))


def phrase_count(norm: Column, phrase: str) -> Column:
    """Occurrences in the normal form, or in the loose one where these are more."""
    return F.greatest(count_of(norm, phrase), count_of(loose_key(norm), loose(phrase)))


def sanitize(text: Column) -> Column:
    """Without control and invisible characters, single spaces, at most LONGEST_MESSAGE characters."""
    clean = F.regexp_replace(F.regexp_replace(text, CONTROLS, ""), INVISIBLE, "")
    return F.substring(F.trim(F.regexp_replace(clean, WHITE, " ")), 1, LONGEST_MESSAGE)


def count_of(text: Column, needle: str) -> Column:
    """Occurrences from left to right that don't overlap; 0 for an empty needle."""
    if not needle:
        return F.lit(0).cast("long")
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("long")


def count_unless_after(text: Column, needle: str, before: str) -> Column:
    """Occurrences, overlapping ones too, that don't stand right after one of the characters ``before``."""
    if not needle:
        return F.lit(0).cast("long")
    quoted = lambda s: "".join(f"\\x{{{ord(c):x}}}" for c in s)
    behind = f"(?<![{quoted(before)}])" if before else ""
    return F.regexp_count(text, F.lit(f"{behind}(?={quoted(needle)})")).cast("long")


def count_standalone(text: Column, word: str) -> Column:
    """Occurrences of a word between spaces; neighbours share a space, so of three in a row two count."""
    return count_of(F.concat(F.lit(" "), text, F.lit(" ")), f" {word} ")


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def word_count(norm: Column) -> Column:
    return F.when(norm == "", F.lit(0)).otherwise(F.size(F.split(norm, " "))).cast("long")


def letter_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LETTERS)).cast("long")


def elided(target: str) -> str | None:
    """How a word with the article looks after the preposition that takes the article's first letter; None for others."""
    if not target.startswith("ال") or len(target) <= 3:
        return None
    return target[1:] if target.startswith("الل") else "ل" + target[1:]


def count_target(norm: Column, target: str) -> Column:
    """Occurrences of a word, and of its elided form where no alif comes before."""
    form = elided(target)
    return count_of(norm, target) + (count_unless_after(norm, form, "ا") if form else F.lit(0))


def excerpt(text: Column) -> Column:
    """Whole up to LONGEST_EXCERPT characters, else the first so many and an ellipsis."""
    return F.when(
        F.length(text) <= LONGEST_EXCERPT, text
    ).otherwise(F.concat(F.rtrim(F.substring(text, 1, LONGEST_EXCERPT)), F.lit("…")))


def word_excerpt(text: Column) -> Column:
    """The same with single spaces, cut at the last space if that comes after SHORTEST_CUT characters."""
    flat = F.trim(F.regexp_replace(text, WHITE, " "))
    head = F.substring(flat, 1, LONGEST_EXCERPT)
    cut = F.greatest(F.length(head) - F.instr(F.reverse(head), " "), F.lit(SHORTEST_CUT))
    return F.when(F.length(flat) <= LONGEST_EXCERPT, flat).otherwise(F.concat(F.left(head, cut), F.lit("…")))


def contains_arabic(text: Column) -> Column:
    return text.rlike(r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]")


def eastern_digits(text: Column) -> Column:
    return F.translate(text, WESTERN[:10], DIGITS[:10])


def playback_time(seconds: Column) -> Column:
    """Minutes and seconds in Arabic digits; never below zero."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return eastern_digits(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")))


def percent(fraction: Column) -> Column:
    whole = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)) * 100 + 0.5).cast("string")
    return F.concat(eastern_digits(whole), F.lit("٪"))


def first_number(text: Column) -> Column:
    """The first stretch of digits as a number; null if there is none, or if it is too large."""
    return F.regexp_extract(western_digits(text), r"(\d+)", 1).try_cast("int")


def range_label(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("–", start.cast("string"), end.cast("string")))


def highlighted(text: Column, term: str) -> Column:
    """Struct of the words before, at and after the first word whose normal form has the term; hit is null if none has."""
    words = F.split(text, " ")
    at = F.array_position(F.transform(words, lambda w: normalize(w).contains(term)), True)
    part = lambda lo, n: F.array_join(F.slice(words, lo, n), " ")
    found = at > 0
    return F.struct(
        F.when(
            found, part(F.lit(1), at.cast("int") - 1)
        ).otherwise(text).alias("before"), F.when(found, F.get(words, at.cast("int") - 1)).alias("hit"),
        F.when(found, part(at.cast("int") + 1, F.size(words))).otherwise(F.lit("")).alias("after"),
    )


def name_variants(name: Column, other: Column) -> Column:
    """Forms under which a name is found: with and without article, from another script in one word, without its final h. Null names have none."""
    own, there = normalize(name), normalize(other)
    one = F.replace(there, F.lit(" "), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(one, r"^a([lstdrzn])\1?", ""), "^al", "")
    forms = [own, F.when(own.startswith("ال") & (F.length(own) > 4), F.substring(own, 3, 1 << 20)), there, one]
    forms += [
        F.when(F.length(bare) > 3, bare), F.when((F.length(bare) > 3) & bare.endswith("h"), F.regexp_replace(bare, "h$", ""))
    ]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != "")))


def is_message(text: Column) -> Column:
    """Whether anything is left of a message once it is sanitized; false for null."""
    return F.coalesce(F.length(sanitize(text)) > 0, F.lit(False))


def shown_number(value: Column, arabic: Column | bool) -> Column:
    """A number or text with the digits of its language."""
    plain = value.cast("string")
    return F.when(F.lit(arabic) if isinstance(arabic, bool) else arabic, eastern_digits(plain)).otherwise(plain)


def bare_name(name: Column) -> Column:
    """A chapter's name without the word for a chapter before it, vocalised or not."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, "^\\s*سُورَةُ?\\s+", ""), "^\\s*سورة\\s+", ""))


def without_opening(text: Column) -> Column:
    """A verse without the opening formula's words, unless nothing else is in it."""
    rest = F.array_join(F.slice(F.split(F.trim(text), r"\s+"), OPENING_WORDS + 1, 1 << 20), " ")
    return F.when(F.startswith(normalize(text), F.lit(OPENING)) & (rest != ""), rest).otherwise(text)


def highlight_term(query: Column) -> Column:
    """The last word of more than two characters of a query's normal form, or the query."""
    words = F.filter(F.split(normalize(query), " "), lambda w: F.length(w) > 2)
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.trim(query))


def number_runs(text: Column) -> Column:
    """The stretches of digits of a text, grouping marks included."""
    return F.regexp_extract_all(text, F.lit(f"({NUMBER_RUN})"), 1)


def sentences(text: Column) -> Column:
    """Pieces that end with a sentence mark before white space, or with the line."""
    return F.filter(F.split(text, r"(?<=[.؟!])\s+|\n+"), lambda x: x != "")


def extract(text: Column, at_most: int) -> Column:
    """The first sentences, as many as fit in at_most characters; the first one in any case."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def add(a: Column, x: Column) -> Column:
        full = (F.length(a["out"]) + F.length(x) > at_most) & (a["out"] != "")
        longer = F.when(a["done"] | full, a["out"]).when(a["out"] == "", x).otherwise(F.concat(a["out"], F.lit(" "), x))
        return F.struct(longer.alias("out"), (a["done"] | full | (F.length(longer) >= at_most)).alias("done"))

    out = F.aggregate(sentences(text), start, add, lambda a: a["out"])
    return F.when(out == "", F.substring(text, 1, at_most)).otherwise(out)
