"""The English Snowball (Porter2) stemmer, from its published description."""

from __future__ import annotations

import re

VOWEL, NOT_VOWEL = "[aeiouy]", "[^aeiouy]"
# Fixed values of the published algorithm.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split(), key=len, reverse=True)


def regions(word: str) -> tuple[int, int]:
    first = re.match("gener|commun|arsen", word)
    r1 = first.end() if first else _after(word, 0)
    return r1, _after(word, r1)


def _after(word: str, at: int) -> int:
    found = re.compile(VOWEL + NOT_VOWEL).search(word, at)
    return found.end() if found else len(word)


def short_syllable(word: str) -> bool:
    return bool(re.search(rf"{NOT_VOWEL}[aeiouy][^aeiouywxY]$|^[aeiouy]{NOT_VOWEL}$", word))


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if word is None or len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub(rf"(^|{VOWEL})y", r"\1Y", word.lstrip("'"))
    r1, r2 = regions(word)
    word = re.sub("('s'|'s|')$", "", word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(VOWEL, word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b
    if found := re.search("(eed|eedly)$", word):
        if found.start() >= r1:
            word = word[: found.start()] + "ee"
    elif (found := re.search("(ed|edly|ing|ingly)$", word)) and re.search(VOWEL, word[: found.start()]):
        word = word[: found.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and short_syllable(word):
            word += "e"
    # 1c
    if re.search(f"[^aeiouy][yY]$", word) and len(word) > 2:
        word = word[:-1] + "i"
    # 2
    for suffix in sorted([*STEP2, "ogi", "li"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    word = word[:-1] if word[at - 1 : at] == "l" else word
                elif suffix == "li":
                    word = word[:-2] if word[at - 1 : at] in set("cdeghkmnrt") else word
                else:
                    word = word[:at] + STEP2[suffix]
            break
    # 3
    for suffix in sorted([*STEP3, "ative"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1 and suffix != "ative":
                word = word[:at] + STEP3[suffix]
            elif suffix == "ative" and at >= r2:
                word = word[:at]
            break
    # 4
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    # 5
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not short_syllable(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
