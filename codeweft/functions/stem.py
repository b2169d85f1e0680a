"""The stems of English words, by the algorithm of Porter (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

_C, _V = "[^aeiou](?:[^aeiouy]*)", "[aeiouy][aeiou]*"
_MORE_0, _MORE_1 = re.compile(f"^(?:{_C})?{_V}{_C}"), re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")
_ONE = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_VOWEL = re.compile(f"^(?:{_C})?[aeiouy]")
_SHORT = re.compile("[^aeiou][aeiouy][^aeiouwxy]$")
# fixed values: endings and what takes their place, of steps 2 and 3, and those that step 4 drops
_STEP_2 = dict(p.split(">") for p in "ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log".split())
_STEP_3 = dict(p.split(">") for p in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split())
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _replaced(word: str, endings: dict[str, str]) -> str:
    for n in range(min(7, len(word)), 1, -1):
        if (new := endings.get(word[-n:])) is not None:
            return word[:-n] + new if _MORE_0.match(word[:-n]) else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters and words with other signs are their own."""
    if len(word) < 3 or not word.isalpha() or not word.isascii():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _MORE_0.match(word[:-3]):
            word = word[:-1]
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e)), None)
        if cut is not None and _VOWEL.match(cut):
            word = cut
            if word.endswith(("at", "bl", "iz")) or _ONE.match(word) and _SHORT.search(word):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                word = word[:-1]
    if word.endswith("y") and _VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP_2), _STEP_3)
    for e in sorted([*_STEP_4, "ion"], key=len, reverse=True):
        if word.endswith(e):
            rest = word[: -len(e)]
            if _MORE_1.match(rest) and (e != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _MORE_1.match(rest) or _ONE.match(rest) and not _SHORT.search(rest):
            word = rest
    return word[:-1] if word.endswith("ll") and _MORE_1.match(word) else word
