"""Text functions as columns: folding, tokens, trimming, keywords. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of Unicode white space beyond ASCII's, as Python's strip() and split() see them.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
TOKEN = r"[\p{L}\p{N}_']+"
WORD = r"[\p{L}\p{N}_]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


#: What full case folding makes of a lower-case character, where that is something else; from Python's tables of Unicode.
FOLDS = {c: c.casefold() for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if c == c.lower() and c != c.casefold()}
_ONE = {c: to for c, to in FOLDS.items() if len(to) == 1}
_MORE = {c: to for c, to in FOLDS.items() if len(to) > 1}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is worked out once: an expression that a lambda names would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ranges(characters: str) -> str:
    """A class of a regular expression that holds the characters, in ranges."""
    out: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in out) + "]"


_ODD = _ranges("".join(c for c in FOLDS if c != "ß"))
#: Holds all of `_ODD`; two tests for each character, where that takes one for each range.
_HIGH = "[µŉ-\\x{10FFFF}]"


def fold(text: Column) -> Column:
    """Full case folding: lower case, then the characters that fold to others or to several. Texts without such characters, which are
    nearly all, are only lower-cased.

    The replacements are a loop over a table: one expression for each would make a plan's code too large to be compiled."""
    low = F.lower(text)
    several = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(to).alias("to")) for c, to in _MORE.items()))
    out = F.aggregate(several, F.translate(low, "".join(_ONE), "".join(_ONE.values())), lambda t, x: F.replace(t, x["c"], x["to"]))
    plain = F.replace(low, F.lit("ß"), F.lit("ss"))
    return F.when(F.octet_length(low) == F.char_length(low), low).when(low.rlike(_HIGH) & low.rlike(_ODD), out).otherwise(plain)


def tokens(text: Column) -> Column:
    """Ranking tokens: runs of letters, digits, _ and ' of the folded text; null has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Index tokens: runs of letters, digits and _ of the lower-cased text; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def word_count(text: Column) -> Column:
    """Tokens between white space: the estimate of a completion's size."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda x: x != "")).cast("long")


def first_line(text: Column) -> Column:
    """The text up to its first line break; empty for null or empty texts."""
    return F.coalesce(F.get(F.split(text, LINE_BREAK, 2), F.lit(0)), F.lit(""))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normal_keyword(text: Column) -> Column:
    """Lower case; separators and other signs become blanks; blanks are squeezed; blanks and - at the ends go."""
    out = F.regexp_replace(F.lower(text), r"[_/\-]+", " ")
    out = F.regexp_replace(out, r"[^a-z0-9\s\-]", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[ \-]+|[ \-]+$", "")


def plain_keywords(items: Column, most: int = 5) -> Column:
    """Normalised, without empties and repeats, in order, at most `most`."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, normal_keyword), lambda x: x != "")), 1, most)


def list_items(text: Column) -> Column:
    """Items of a list in text: one in a line or between commas, without bullets, numbers and quotes."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), r"^[\-\*•]\s*", ""), r"^\d+[.)]\s*", "")))
    bare = lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), '^"+|"+$', ""), "^'+|'+$", ""))
    parts = F.flatten(F.transform(F.transform(lines, bare), lambda x: F.when(F.contains(x, F.lit(",")), F.transform(F.split(x, ","), bare)).otherwise(F.array(x))))
    return F.filter(parts, lambda x: x != "")


def first_sentence(text: Column) -> Column:
    """The first sentence that ends before white space on the first line, or else the first 200 characters."""
    found = F.regexp_extract(text, r"^([^\n]+?[.!?])[\s\p{Z}\x1c-\x1f\x85]", 1)
    return strip(F.when(found != "", found).otherwise(F.substring(text, 1, 200)))


def without_fences(text: Column) -> Column:
    """Markdown code fences at the ends of lines and the white space around go."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"(?m)^```(?:json)?\s*\n?", ""), r"(?m)\n?\s*```$", ""))


def path_key(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(":"), F.lit("__")), F.lit("/"), F.lit("_"))


def flip(seed: int, key: Column) -> Column:
    """Whether the first byte of the SHA-256 of "seed:key" is odd."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 2), 16, 10).cast("int") % 2 == 1


def capitalised_keywords(text: Column, stop: list[str], most: int = 5) -> Column:
    """Words of three ASCII letters and more that aren't filtered; capitalised ones first, each group in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b[a-zA-Z]{3,}\b"), F.lit(0))
    usable = F.filter(F.transform(found, lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("i"), w.rlike("^[A-Z]").alias("cap"))), lambda x: ~x["w"].isin(stop) & ~F.endswith(x["w"], F.lit("says")))
    # In the order of words and places a word's first place is the one that follows another word.
    first = lambda s: F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1)["w"] != x["w"]))
    # Plain ones after capitalised ones, each by place.
    ordered = F.array_sort(F.transform(let(F.array_sort(usable), first), lambda x: F.struct((~x["cap"]).alias("plain"), x["i"].alias("i"), x["w"].alias("w"))))
    return F.slice(F.transform(ordered, lambda x: x["w"]), 1, most)
