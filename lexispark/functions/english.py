"""English word stems (the published Porter2 rules) and stop words."""

from __future__ import annotations

import re
from functools import lru_cache

#: The usual English stop list of full-text engines.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very s t can will just don should now""".split()
)

#: Words with stems of their own, and words that stay as step 1a leaves them.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAYING = frozenset("inning outing canning herring earring proceed exceed succeed".split())

_VOWEL = "[aeiouy]"
_REGION = re.compile(r".*?[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
#: Endings of steps 2 and 3, the longest first, with what takes their place.
_STEP2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less",
    "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous",
    "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first vowel and consonant, and after the next."""
    lead = re.match("gener|commun|arsen", word)
    first = _REGION.match(word)
    r1 = lead.end() if lead else first.end() if first else len(word)
    second = _REGION.match(word, r1)
    return r1, second.end() if second else len(word)


def _is_short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(_SHORT_END.match(word))


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_VOWEL, word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    if word.endswith(("eed", "eedly")):
        cut = 5 if word.endswith("ly") else 3
        return word[:-cut] + "ee" if len(word) - cut >= r1 else word
    for end in ("ingly", "edly", "ing", "ed"):
        if word.endswith(end):
            stem = word[: -len(end)]
            if not re.search(_VOWEL, stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                return stem[:-1]
            return stem + "e" if _is_short(stem, r1) else stem
    return word


def _derived(word: str, r1: int, r2: int) -> str:
    for end, new in sorted(_STEP2.items(), key=lambda x: -len(x[0])):
        if word.endswith(end):
            word = word[: -len(end)] + new if len(word) - len(end) >= r1 else word
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[:-3].endswith("l"):
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in tuple("cdeghkmnrt"):
            word = word[:-2]
    if word.endswith("ative"):
        word = word[:-5] if len(word) - 5 >= r2 else word
    else:
        for end, new in sorted(_STEP3.items(), key=lambda x: -len(x[0])):
            if word.endswith(end):
                word = word[: -len(end)] + new if len(word) - len(end) >= r1 else word
                break
    for end in _STEP4:
        if word.endswith(end):
            return word[: -len(end)] if len(word) - len(end) >= r2 else word
    if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
        return word[:-3]
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in STAYING:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _SHORT_END.match(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
