"""The public Snowball English stemmer, as a small helper for tasks."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published algorithm: words with a stem of their own, words that stay, and the suffixes of its steps.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAYS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

ENDS_2, ENDS_3 = tuple(STEP_2), tuple(STEP_3)

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_VOWEL}{_OTHER}")
_SHORT = re.compile(f"(?:^|.*{_OTHER}){_VOWEL}[^aeiouywxY]$|^{_VOWEL}{_OTHER}$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_FIRST = ("gener", "commun", "arsen")
#: A word of letters and digits that doesn't end like this is its own stem.
ENDS = f"(?:s|ed|edly|ing|ingly|y|e|ll|{'|'.join((*STEP_2, *STEP_3, *STEP_4))})$"


def _after(word: str, start: int) -> int:
    """Where the part after the first vowel and non-vowel from ``start`` on begins."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _suffix(word: str, suffixes: tuple[str, ...]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(suffixes) else None


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of two letters and words with other than a-z and ' stay."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    if "y" in word:
        word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    first = next(len(p) for p in _FIRST if word.startswith(p)) if word.startswith(_FIRST) else None
    r1 = _after(word, 0) if first is None else first
    r2 = _after(word, r1)
    if "'" in word:
        word = re.sub(r"'(?:s'?)?$", "", word)

    end = _suffix(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and re.search(_VOWEL, word[:-2]):
        word = word[:-1]
    if word in STAYS:
        return word

    end = _suffix(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search(_VOWEL, word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.match(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    end = _suffix(word, ENDS_2)
    if end and len(word) - len(end) >= r1:
        body = word[: -len(end)]
        if end == "ogi":
            word = body + "og" if body.endswith("l") else word
        elif end == "li":
            word = body if body[-1:] in tuple("cdeghkmnrt") else word
        else:
            word = body + STEP_2[end]

    end = _suffix(word, ENDS_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]

    end = _suffix(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]

    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT.match(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
