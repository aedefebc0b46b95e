"""English word stems (the published Porter2 rules) and stop words.

One word at a time, with a bounded memo per Python worker; Spark calls it on Arrow
batches of word lists.
"""

from __future__ import annotations

import re
from functools import lru_cache

# English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are was
    were be been being have has had having do does did doing a an the and but if or because as until while of at by
    for with about against between into through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both each few more most other some such no
    nor not only own same so than too very s t can will just don should now""".split()
)

# Whole words with their own stem, and words that end after the plural step.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_FINAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

# Suffix -> replacement for the two derivation steps.
_STEP2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble",
    "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful",
    "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence",
    "izer": "ize", "bli": "ble",
}
_STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
_STEP4 = (
    "ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic",
)

_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_SPECIAL_REGION = re.compile(r"gener|commun|arsen")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, table) -> str | None:
    return next((s for s in sorted(table, key=len, reverse=True) if word.endswith(s)), None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    # A y that acts as a consonant is written Y.
    word = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    special = _SPECIAL_REGION.match(word)
    first = special or _REGION.match(word)
    r1 = first.end() if first else len(word)
    second = _REGION.match(word, r1)
    r2 = second.end() if second else len(word)

    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _FINAL:
        return word

    # Past and continuous forms.
    ending = _longest(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and _VOWEL.search(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    # Derivations.
    suffix = _longest(word, (*_STEP2, "ogi", "li"))
    if suffix and len(word) - len(suffix) >= r1:
        base = word[: -len(suffix)]
        if suffix == "ogi":
            word = base + "og" if base.endswith("l") else word
        elif suffix == "li":
            word = base if base and base[-1] in "cdeghkmnrt" else word
        else:
            word = base + _STEP2[suffix]
    suffix = _longest(word, (*_STEP3, "ative"))
    if suffix and len(word) - len(suffix) >= r1:
        if suffix == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(suffix)] + _STEP3[suffix]
    suffix = _longest(word, (*_STEP4, "ion"))
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(suffix)]

    # Final letters.
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
