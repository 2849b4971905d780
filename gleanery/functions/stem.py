"""Porter's suffix stripping (M. F. Porter, "An algorithm for suffix stripping", 1980) for one English word.

Used through :func:`gleanery.operators.lexicon.lex_map` on distinct terms only.
"""

from __future__ import annotations

import re

# Fixed values from the paper: (suffix, replacement) of steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)



def _shape(word: str) -> str:
    """The word as c and v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, pairs: tuple) -> tuple[str, str] | None:
    hits = [p for p in pairs if word.endswith(p[0])]
    return max(hits, key=lambda p: len(p[0])) if hits else None


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and _has_vowel(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for pairs in (STEP2, STEP3):
        hit = _longest(word, pairs)
        if hit and _measure(word[: -len(hit[0])]) > 0:
            word = word[: -len(hit[0])] + hit[1]
    hit = _longest(word, tuple((s, "") for s in STEP4))
    if hit:
        base = word[: -len(hit[0])]
        if _measure(base) > 1 and (hit[0] != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
