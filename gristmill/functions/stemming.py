"""English stems by the published suffix-stripping algorithm of 1980, in five steps."""

from __future__ import annotations

from functools import lru_cache

# The algorithm's suffixes and what replaces them if the measure of what stands before is above 0.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
# Suffixes that go if the measure of what stands before is above 1; "ion" only after s or t.
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How many times a consonant follows a vowel."""
    return _shape(word).count("vc")


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str]) -> str:
    """By the longest suffix that the word has, if enough stands before it."""
    found = max((s for s in rules if word.endswith(s)), key=len, default=None)
    if found is None or _measure(word[: -len(found)]) == 0:
        return word
    return word[: -len(found)] + rules[found]


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if "v" not in _shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return word


def _without_last(word: str) -> str:
    found = max((s for s in FOURTH if word.endswith(s)), key=len, default=None)
    if found is None:
        return word
    stem = word[: -len(found)]
    return stem if _measure(stem) > 1 and (found != "ion" or stem.endswith(("s", "t"))) else word


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word of a to z; any other word, or one of two letters or fewer, stays as it is."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _without_last(_replaced(_replaced(word, SECOND), THIRD))
    if word.endswith("e"):
        before = word[:-1]
        if _measure(before) > 1 or (_measure(before) == 1 and not _ends_cvc(before)):
            word = before
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
