"""The Porter stemmer (F4), run over distinct words only.

Porter's published algorithm of 1980 in the variant that has no exception for short words, maps abli to able and has no rule for
logi. Words are treated by letters; others than a-z count as consonants.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: the suffix rules of steps 2, 3 and 4
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
DOUBLED = {"bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"}


def _shape(word: str) -> str:
    """v for vowels, c for the rest; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _cvc(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix that matches is replaced if what stays is long enough."""
    for n in range(min(len(word), 7), 0, -1):
        end = word[-n:]
        if end in rules:
            stem = word[:-n]
            return stem + rules[end] if _measure(stem) >= least else word
    return word


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    """The stem of a lower-case word; "s" becomes empty."""
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                stem = w[: -len(end)]
                if "v" in _shape(stem):
                    if stem.endswith(("at", "bl", "iz")):
                        w = stem + "e"
                    elif stem[-2:] in DOUBLED:
                        w = stem[:-1]
                    elif _measure(stem) == 1 and _cvc(stem):
                        w = stem + "e"
                    else:
                        w = stem
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2, 1), STEP3, 1)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if (m := _measure(stem)) > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stems(words: DataFrame, word: str = "term") -> DataFrame:
    """(word, stem) of distinct words; stems that are empty are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(w, s) for w in b.column(0).to_pylist() if w is not None and (s := porter(w))]
            w, s = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(s, pa.string())], names=[word, "stem"])

    return words.select(word).distinct().mapInArrow(run, f"{word} string, stem string")
