"""English stems: the published Snowball rules for English, as tables of endings, over columns of words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words without weight in English, and the stemmer's exceptions and endings.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_VOWEL, _DOUBLE = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_PLAIN = re.compile(r"[a-z']+")


def _after(word: str, start: int) -> int:
    """Where the region behind the first consonant after a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWEL and word[i - 1] in _VOWEL:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWEL and word[1] not in _VOWEL
    return len(word) > 2 and word[-1] not in _VOWEL + "wxY" and word[-2] in _VOWEL and word[-3] not in _VOWEL


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of two letters, and with other signs than letters, stay."""
    if word in _WHOLE:
        return _WHOLE[word]
    if len(word) < 3 or not _PLAIN.fullmatch(word):
        return word
    w = word.lstrip("'")
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _after(w, 0) if first is None else first
    r2 = _after(w, r1)
    for ending in ("'s'", "'s", "'"):
        if w.endswith(ending):
            w = w[: -len(ending)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: -len(ending)] + "ee"
    elif ending and any(c in _VOWEL for c in w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    ending = _longest(w, _SECOND)
    if ending and len(w) - len(ending) >= r1:
        rest = w[: -len(ending)]
        if not (ending == "ogi" and rest[-1:] != "l") and not (ending == "li" and rest[-1:] not in tuple("cdeghkmnrt")):
            w = rest + _SECOND[ending]
    ending = _longest(w, _THIRD)
    if ending and len(w) - len(ending) >= (r2 if ending == "ative" else r1):
        w = w[: -len(ending)] + _THIRD[ending]
    ending = _longest(w, _FOURTH)
    if ending and len(w) - len(ending) >= r2 and not (ending == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(ending)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def stems(words: Column) -> Column:
    """The stems of an array of words in lower case."""
    return _stems(words)
