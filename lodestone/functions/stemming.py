"""Stop words and stemmers of English and Russian, from their published descriptions, for columns of terms."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that the analyzers leave out.
ENGLISH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
RUSSIAN_STOP = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему
теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам сказал ведь там потом себя ничего ей может
они тут где есть надо ней для мы тебя их чем была сам чтоб без будто человек чего раз тоже себе под жизнь будет ж тогда кто этот
говорил того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее кажется сейчас были куда зачем сказать всех
никогда сегодня можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве сказала
три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между
""".split()

#: Endings of the English stemmer's steps 2 to 4 with what takes their place.
STEP_2 = dict(x.split(">") for x in "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble".split())
STEP_3 = dict(x.split(">") for x in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

#: The Russian stemmer's endings. Those of a first group count only behind а or я.
GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
REFLEXIVE = ([], "ся сь".split())
ADJECTIVE = ([], "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split())
PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
NOUN = ([], "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split())
DERIVED = ([], "ост ость".split())
SUPERLATIVE = ([], "ейш ейше".split())
VOWELS = "аеиоуыэюя"


def _kinds(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, of which the last isn't w, x or y."""
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    """The stem by the algorithm of 1980 for suffix stripping; words of one or two letters and others than a-z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for e in ("ed", "ing"):
            if w.endswith(e) and "v" in _kinds(w[: -len(e)]):
                w = w[: -len(e)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        e = _longest(w, table)
        if e and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    e = _longest(w, [*STEP_4, "ion"])
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or (m == 1 and not _short(w[:-1])) else w
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _cut(word: str, start: int, groups) -> str | None:
    """The word without the longest ending of the groups that lies behind `start`, or None; see the fixed values."""
    e = _longest(word[start:], [*groups[0], *groups[1]])
    if e is None or (e in groups[0] and e not in groups[1] and word[start : len(word) - len(e)][-1:] not in ("а", "я")):
        return None
    return word[: len(word) - len(e)]


@lru_cache(maxsize=200_000)
def russian(word: str) -> str:
    """The stem by the published Russian stemmer; ё counts as е, and words without a Russian vowel stay."""
    w = word.replace("ё", "е")
    vowel = re.search(f"[{VOWELS}]", w)
    if not vowel:
        return w
    rv = vowel.end()
    second = re.match(f".*?[{VOWELS}][^{VOWELS}].*?[{VOWELS}][^{VOWELS}]", w)
    r2 = second.end() if second else len(w)
    bare = _cut(w, rv, GERUND)
    if bare is None:
        w = _cut(w, rv, REFLEXIVE) or w
        bare = _cut(w, rv, ADJECTIVE)
        if bare is not None:
            bare = _cut(bare, rv, PARTICIPLE) or bare
        else:
            bare = _cut(w, rv, VERB)
            bare = _cut(w, rv, NOUN) if bare is None else bare
    w = w if bare is None else bare
    if w.endswith("и") and len(w) > rv:
        w = w[:-1]
    if len(w) >= r2:
        w = _cut(w, r2, DERIVED) or w
    best = _cut(w, rv, SUPERLATIVE)
    if best is not None:
        w = best
    if w.endswith("нн") and len(w) - 2 >= rv:
        return w[:-1]
    return w[:-1] if best is None and w.endswith("ь") and len(w) > rv else w


STEMMERS = {"en": english, "ru": russian}
STOPS = {"en": ENGLISH_STOP, "ru": RUSSIAN_STOP}


def stems(terms: Column, language: str) -> Column:
    """An array of terms with each one's stem in its place. A batch's terms are stemmed once each."""
    stem = STEMMERS[language]

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        own = [np.empty(0, object) if x is None else x for x in lists]
        if not sum(map(len, own)):
            return lists
        codes, words = pd.factorize(np.concatenate(own))
        made = np.array([stem(w) for w in words], dtype=object)[codes]
        cuts = np.split(made, np.cumsum([len(x) for x in own])[:-1])
        return pd.Series([None if x is None else c for x, c in zip(lists, cuts, strict=True)])

    return run(terms)


def stemmed(terms: Column, languages: tuple[str, ...]) -> Column:
    """Terms without stop words, as stems; of several languages, one after the other."""
    for language in languages:
        stop = STOPS[language]
        terms = stems(F.filter(terms, lambda x: ~x.isin(stop)), language)
    return terms
