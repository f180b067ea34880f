"""Terms of an index that folds diacritics and stems: Porter's algorithm (1980, with its author's two later changes).

``analyse`` gives words of letters, digits and ``_``, lower-cased, without diacritics, stemmed, and pairs of CJK characters;
texts and questions take the same path, so ``dependencies`` meets ``depend``.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .text import segmented

#: The algorithm's suffixes with what takes their place, step by step, and those that step 4 drops.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words of fewer or more characters are left as they are.
SHORTEST, LONGEST = 3, 64
#: Blocks of letters with diacritics: Latin, Greek, Cyrillic, and Latin again.
ACCENTED = ((0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000))


def folding() -> dict[int, str | None]:
    """Accented letters to their base letters; combining marks to nothing."""
    out: dict[int, str | None] = dict.fromkeys(range(0x0300, 0x0370))
    for first, end in ACCENTED:
        for code in range(first, end):
            parts = unicodedata.normalize("NFD", chr(code))
            if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
                out[code] = parts[0]
    return out


FOLDING = folding()
WORDS = re.compile(r"\w+")


def sounds(word: str) -> str:
    """``v`` for vowels, ``c`` for consonants; ``y`` is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def measure(part: str) -> int:
    """How often a consonant follows a vowel."""
    return sounds(part).count("vc")


def short_end(part: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x, y."""
    return sounds(part)[-3:] == "cvc" and part[-1] not in "wxy"


def double_end(part: str) -> bool:
    return len(part) > 1 and part[-1] == part[-2] and sounds(part)[-1] == "c"


def replaced(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The longest suffix among the rules, replaced if what is before it has a measure above 0."""
    fits = [(old, new) for old, new in rules if word.endswith(old)]
    if not fits:
        return word
    old, new = max(fits, key=lambda f: len(f[0]))
    part = word[: len(word) - len(old)]
    return part + new if measure(part) > 0 else word


def without_ed(word: str) -> str:
    """Past and present participles, and what their ends become without it."""
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        part = word.removesuffix(suffix)
        if part != word:
            if "v" not in sounds(part):
                return word
            if part.endswith(("at", "bl", "iz")):
                return part + "e"
            if double_end(part) and part[-1] not in "lsz":
                return part[:-1]
            return part + "e" if measure(part) == 1 and short_end(part) else part
    return word


def dropped(word: str) -> str:
    fits = [s for s in STEP_4 if word.endswith(s)]
    if not fits:
        return word
    suffix = max(fits, key=len)
    part = word[: len(word) - len(suffix)]
    if measure(part) < 2 or (suffix == "ion" and part[-1:] not in ("s", "t")):
        return word
    return part


@lru_cache(maxsize=1 << 15)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if not SHORTEST <= len(word) <= LONGEST:
        return word
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    word = without_ed(word)
    if word.endswith("y") and "v" in sounds(word[:-1]):
        word = word[:-1] + "i"
    word = dropped(replaced(replaced(word, STEP_2), STEP_3))
    if word.endswith("e"):
        part = word[:-1]
        if measure(part) > 1 or (measure(part) == 1 and not short_end(part)):
            word = part
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def analyse(text: str | None) -> list[str]:
    """The terms of a text in their order."""
    return [stem(w) for w in WORDS.findall(segmented(text or "").lower().translate(FOLDING))]
