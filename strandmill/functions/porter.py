"""The Porter stemmer with the usual extensions (short words kept, -ies/-ied of four letters, alli, fulli, logi, irregular forms).

After the published algorithm; no reference implementation is at hand here, so it is tested against published examples only.
"""

from __future__ import annotations

from functools import lru_cache

#: Forms that the rules would get wrong.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}

#: Endings and what they become, tried in order.
SECOND = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out.endswith("c") else "c"
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short(word: str) -> bool:
    form = shape(word)
    return len(word) >= 3 and form.endswith("cvc") and word[-1] not in "wxy" or form == "vc"


def _replace(word: str, rules, fits) -> str:
    """The first ending that the word has decides: it is replaced if the rest fits, else nothing is."""
    for ending, new in rules:
        if word.endswith(ending):
            rest = word[: len(word) - len(ending)]
            return rest + new if fits(rest) else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    return _replace(word, (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")), lambda _: True)


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        rest = word[: len(word) - len(ending)]
        if word.endswith(ending) and "v" in shape(rest):
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if double(rest):
                return rest if rest[-1] in "lsz" else rest[:-1]
            return rest + "e" if measure(rest) == 1 and short(rest) else rest
    return word


def _second(word: str) -> str:
    while word.endswith("alli") and measure(word[:-4]) > 0:
        word = word[:-2]
    if word.endswith("logi") and not word.endswith(tuple(e for e, _ in SECOND)):
        return word[:-1] if measure(word[:-3]) > 0 else word
    return _replace(word, SECOND, lambda rest: measure(rest) > 0)


def _fourth(word: str) -> str:
    for ending in FOURTH:
        if word.endswith(ending):
            rest = word[: len(word) - len(ending)]
            return rest if measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))) else word
    return word


def _last(word: str) -> str:
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or measure(rest) == 1 and not short(rest):
            word = rest
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@lru_cache(100_000)
def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and shape(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _replace(_second(word), THIRD, lambda rest: measure(rest) > 0)
    return _last(_fourth(word))
