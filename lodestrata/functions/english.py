"""The English analyzer: tokens with positions, no stop words, stems by the published Porter2 algorithm.

A text in lower case is read by one scanner of ordered kinds of token: marks and character references (dropped), e-mail
addresses, web addresses, hosts, paths, versions, numbers with points, exponents and signs, hyphenated
compounds, words.  A web address yields itself without the protocol, its host and its path; a compound
itself and its parts.  Every token yielded takes a position, stop words too.  A sign belongs to the digits
behind it, so ``2024-01`` is 2024 and -01.

Scanning and stop words are column expressions; only the stems of the words that are left come from a small
Python helper, in Arrow batches, with the stems of words met before at hand.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of the usual English text search configuration.
STOP = frozenset(
    (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
        "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with "
        "about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each "
        "few more most other some such no nor not only own same so than too very s t can will just don should now"
    ).split()
)
#: Fixed values of the algorithm: words with stems of their own, words that stay, and words that stay after the plural is gone.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
ENDED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Fixed values of the algorithm: endings and what stands for them, longest first.
SECOND = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"),
    ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
THIRD = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
FOURTH = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
_VOWELS = frozenset("aeiouy")
_KNOWN = 200_000


def _region(w: str, start: int) -> int:
    """Behind the first other letter that follows a vowel."""
    for i in range(start + 1, len(w)):
        if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS and w[-1] not in "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def _has_vowel(w: str) -> bool:
    return any(c in _VOWELS for c in w)


def stem(word: str) -> str:
    """The Porter2 stem of a word in lower case."""
    if len(word) <= 2 or word in KEPT:
        return word
    if word in OWN:
        return OWN[word]
    w = word
    for i, c in enumerate(word):  # a y that sounds like a consonant
        if c == "y" and (i == 0 or w[i - 1] in _VOWELS):
            w = w[:i] + "Y" + w[i + 1 :]
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in ENDED:
        return w
    # past tenses and participles
    for ending in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(ending):
            base = w[: -len(ending)]
            if ending.startswith("eed"):
                w = base + "ee" if len(base) >= r1 else w
            elif _has_vowel(base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # longer endings
    for ending, other in SECOND:
        if w.endswith(ending):
            base = w[: -len(ending)]
            if len(base) >= r1 and (ending != "ogi" or base.endswith("l")) and (ending != "li" or base[-1:] in tuple("cdeghkmnrt")):
                w = base + other
            break
    for ending, other in THIRD:
        if w.endswith(ending):
            base = w[: -len(ending)]
            if len(base) >= (r2 if ending == "ative" else r1):
                w = base + other
            break
    for ending in FOURTH:
        if w.endswith(ending):
            base = w[: -len(ending)]
            if len(base) >= r2 and (ending != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if len(base) >= r2 or len(base) >= r1 and not _short_end(base):
            w = base
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_HOST = r"(?:[\p{L}\p{N}][\p{L}\p{N}_-]*\.)+\p{L}{2,}(?::\d+)?"
_PART = r"(?:\p{L}[\p{L}\p{N}]*|\p{N}+\p{L}[\p{L}\p{N}]*)"
_ENDED = r"(?![\p{L}\p{N}])"
#: The kinds of token, first that fits first.
KINDS = {
    "mark": r"</?\p{L}[^<>]*>|&(?:\p{L}+|#\d+|#x[0-9a-f]+);",
    "email": rf"[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}._+-]*[\p{{L}}\p{{N}}_])?@{_HOST}",
    "url": rf"(?:[a-z]+://)?{_HOST}/[^\s<>\"']*[^\s<>\"'.,;:!?)]|[a-z]+://{_HOST}/?",
    "host": rf"{_HOST}{_ENDED}",
    "path": r"(?:~?/)?[\p{L}_][\p{L}\p{N}_.-]*(?:/[\p{L}\p{N}_][\p{L}\p{N}_.-]*)+|~?/[\p{L}\p{N}_][\p{L}\p{N}_.-]*",
    "version": rf"\d+(?:\.\d+){{2,}}{_ENDED}",
    "number": rf"[+-]?\d+(?:\.\d+)?(?:e[+-]?\d+)?{_ENDED}",
    "compound": rf"\p{{L}}[\p{{L}}\p{{N}}]*(?:-{_PART})+",
    "word": r"[\p{L}\p{N}]+",
}
_SCANNER = "|".join(KINDS.values())
_stems: dict[str, str] = {}


def _stemmed(words: pd.Series) -> pd.Series:
    """Stems of words and compounds; what has other characters stays."""
    if len(_stems) > _KNOWN:
        _stems.clear()

    def of(w: str) -> str:
        found = _stems.get(w)
        if found is None:
            found = _stems[w] = stem(w) if w.replace("-", "").isalpha() else w
        return found

    return words.map(lambda row: None if row is None else [of(w) for w in row])


def _whole(kind: str) -> str:
    return f"^(?:{KINDS[kind]})$"


def _yield(token: Column) -> Column:
    """What a token stands for: nothing, itself, or itself and its parts."""
    bare = F.regexp_replace(token, r"^[a-z]+://|(?<=://[^/]{1,255})/$", "")
    host = F.regexp_extract(bare, f"^{_HOST}", 0)
    path = F.substring(bare, F.length(host) + 1, F.length(bare))
    address = F.filter(F.array(bare, F.when(path != "", host).otherwise(""), F.when(F.length(path) > 1, path).otherwise("")), lambda x: x != "")
    end = F.regexp_replace(token, r"[.]+$", "")  # a full stop behind a path is none of it
    return (
        F.when(token.rlike(r"^[\p{L}\p{N}]+$"), F.array(token))
        .when(token.rlike(r"^[<&]"), F.array().cast("array<string>"))
        .when(token.contains("@"), F.array(token))
        .when(token.contains("/") & token.rlike(_whole("url")), address)
        .when(token.contains("/"), F.array(end))
        .when(token.rlike(_whole("host")) | token.rlike(_whole("version")) | token.rlike(_whole("number")), F.array(token))
        .otherwise(F.concat(F.array(token), F.split(token, "-")))
    )


def _placed(c: Column) -> Column:
    """(position, token) of the tokens that a text yields, but stop words."""
    tokens = F.flatten(F.transform(F.regexp_extract_all(F.lower(c), F.lit(_SCANNER), 0), _yield))
    placed = F.transform(tokens, lambda t, i: F.struct((i + 1).alias("position"), t.alias("token")))
    return F.filter(placed, lambda t: ~t["token"].isin(*sorted(STOP)))


def english_lexemes(c: Column) -> Column:
    """The lexemes of a text in order, with repetitions."""
    return F.pandas_udf(_stemmed, "array<string>")(F.transform(_placed(c), lambda t: t["token"]))


def english_positions(c: Column) -> Column:
    """(position, lexeme) of a text's lexemes, in order of position."""
    stems = english_lexemes(c)
    return F.zip_with(F.transform(_placed(c), lambda t: t["position"]), stems, lambda p, w: F.struct(p.alias("position"), w.alias("lexeme")))
