"""English stems by the Porter2 rules, and stop words: lexemes as full-text search has them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: English words that queries leave out. Fixed values.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words with stems of their own, and words that the first step leaves as they are. Fixed values.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_VOWEL, _DOUBLE, _LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
_STEP2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"),
    ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, in the word and in R1."""

    def after(at: int) -> int:
        found = re.compile("[aeiouy][^aeiouy]").search(w, at)
        return found.end() if found else len(w)

    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch("[aeiouy][^aeiouy]", w))


def stemmed(word: str) -> str:
    """The stem of a lower-case English word; words of other letters keep their ends."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.removeprefix("'")
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in FINISHED:
        return w
    # 1b: -eed, -ed, -ing
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(end):
            continue
        stem = w[: -len(end)]
        if end in ("eed", "eedly"):
            w = stem + "ee" if len(stem) >= r1 else w
        elif re.search("[aeiouy]", stem):
            if stem.endswith(("at", "bl", "iz")):
                w = stem + "e"
            elif stem.endswith(_DOUBLE):
                w = stem[:-1]
            else:
                w = stem + "e" if r1 >= len(stem) and _short_end(stem) else stem
        break
    # 1c: a final y after a consonant that isn't the first letter
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for end, to in _STEP2:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r1 and (end != "ogi" or stem.endswith("l")) and (end != "li" or stem[-1:] in tuple(_LI)):
                w = stem + to
            break
    for end, to in _STEP3:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= (r2 if end == "ative" else r1):
                w = stem + to
            break
    for end in _STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r2 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


#: Stems that a task keeps from batch to batch, and words that it takes at once, but for a longer array.
KEPT, AT_ONCE = 200_000, 250_000


def _parts(batch: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Slices of arrays of words of up to ``AT_ONCE`` words, or one array, with the places where each array ends in its slice."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False), dtype="int64")
    start = before = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield batch.slice(start, stop - start), ends[start:stop] - before
        start, before = stop, int(ends[stop - 1])


def _stemmed(words: Iterator[pa.Array], first: dict[str, str]) -> Iterator[pa.Array]:
    """Arrays of words to arrays of stems. Words stay in Arrow's buffers: only a slice's distinct ones become Python's, and stems of up to ``KEPT`` are kept."""
    known = dict(first)
    for batch in words:
        for part, ends in _parts(batch):
            if len(known) > KEPT:
                known = dict(first)
            coded = part.flatten().dictionary_encode()
            found = []
            for w in coded.dictionary.to_pylist():
                stem = known.get(w)
                if stem is None:
                    stem = known[w] = stemmed(w)
                found.append(stem)
            offsets = pa.array(np.concatenate([np.zeros(1, "int64"), ends])).cast(part.offsets.type)
            values = pa.array(found, coded.dictionary.type).take(coded.indices)
            yield type(part).from_arrays(offsets, values, mask=part.is_null() if part.null_count else None)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The stems of arrays of lower-case tokens in order."""
    yield from _stemmed(words, {})


@F.arrow_udf(T.ArrayType(T.StringType()))
def lexemes(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Like ``stems``, with an empty string for a stop word."""
    yield from _stemmed(words, dict.fromkeys(STOP_WORDS, ""))
