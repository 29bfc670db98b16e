"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps letters of other scripts that look Latin to the letters they imitate
and digits or signs within words to the letters they stand for; ``i``, ``l`` and ``1`` become
one letter, as ``1`` stands for either.  The folded text is its words, each between single spaces.

An entry is a whole word (`` word ``) or a word's beginning (`` wor``).  Where several
entries match at one word the heaviest counts; a match inside an exception phrase counts
nothing.  The weights' sum over a text's matches, divided by ``(1 + words / 50) ** power``,
goes through a logistic curve.  Power, cut and slope are fitted to the sample.

The lexicon is learned from labelled rows: words and beginnings whose share among toxic texts is far
above that among others, enough different texts supporting each.  Near copies count
once: support is the number of different least hashes of the texts' word sets.  Entries are
chosen in turn for the toxic texts that too few chosen entries cover as yet; less telling ones
only for texts that one other entry covers at most.  Exceptions are the word
pairs around a match that clean texts hold repeatedly and toxic ones never.

Defined results: null and blank texts hold no match and get the curve's lowest score; texts
are read whole at any length; repeated rows score alike; without any usable label the lexicon is empty
and all scores are 0; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import samples
from tracewell.llm.common import fold as id_fold
from tracewell.llm.common import filter_rows, slices, small_batches

#: Letters of other scripts, by the Latin letter they look like.
LOOKALIKES = {
    "a": "аαɑ", "b": "Ьв", "c": "сϲ", "d": "ԁ", "e": "еεё", "g": "ɡ", "h": "һн", "i": "іιıї", "j": "ј", "k": "кκ",
    "m": "м", "n": "ո", "o": "оοσ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
#: Digits and signs, by the letter they stand for within a word.
SUBSTITUTES = {"o": "0", "i": "1!|", "e": "3", "a": "4@", "s": "5$", "g": "69", "t": "7", "b": "8"}

_TO_LATIN = {ord(x): letter for letter, others in LOOKALIKES.items() for x in others}
_TO_LATIN |= {0x0130: "i", 0x200B: None, 0x200C: None, 0x200D: None, 0x00AD: None, 0xFEFF: None}
_TO_LATIN |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FROM_DIGIT = {ord(x): letter for letter, others in SUBSTITUTES.items() for x in others}
_ONE = {ord("l"): "i"}
_WORD = re.compile(r"[^\W_](?:[\w@$!|]*[^\W_])?|[@$][\w@$!|]*[^\W_]")
_MARKED = re.compile(r"[0-9@$!|]")

MAX_ROWS = 2500
MIN_WEIGHT = 1.8
COVER = 3
#: Entries this heavy come first, and are taken without need if so large a share of toxic texts supports them.
SURE_WEIGHT, SURE_SHARE = 3.5, 0.05
#: Powers of the length that the fit may choose from.
POWERS = (0.25, 0.5, 0.75, 1.0)


def fold_word(word: str) -> str:
    if _MARKED.search(word) and not word.isdigit():
        word = word.translate(_FROM_DIGIT)
    return word.translate(_ONE)


def fold(text: str | None) -> list[str]:
    """The folded words of ``text``."""
    if not text:
        return []
    lowered = text.lower()
    if not lowered.isascii():
        lowered = lowered.translate(_TO_LATIN)
    words = _WORD.findall(lowered)
    if _MARKED.search(lowered):
        return [fold_word(w) for w in words]
    return " ".join(words).translate(_ONE).split(" ") if words else []


@dataclass
class Lexicon:
    """Entries with weights, exception phrases (folded words), and the curve over the normalised sum."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    middle: float = 1.0
    power: float = 0.5

    def matcher(self) -> ahocorasick.Automaton | None:
        if not self.entries:
            return None
        machine = ahocorasick.Automaton()
        for e, w in self.entries.items():
            machine.add_word(e, (len(e), w))
        for phrase in self.exceptions:
            text = f" {phrase} "
            machine.add_word(text, (len(text), -1.0))
        machine.make_automaton()
        return machine

    def matches(self, words: list[str], machine: ahocorasick.Automaton | None) -> dict[int, float]:
        """Weight by the place of the space before the matched word."""
        if machine is None or not words:
            return {}
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in machine.iter(f" {' '.join(words)} "):
            start = end + 1 - size
            if weight < 0:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if spared and found:
            places = sorted(found)
            past = 0  # what lies before this place is done, however many phrases overlap
            for a, b in sorted(spared):
                for at in places[bisect_left(places, max(a, past)) : bisect_left(places, b)]:
                    del found[at]
                past = max(past, b)
        return found

    def strength(self, words: list[str], machine: ahocorasick.Automaton | None) -> float:
        return self.normalised(sum(self.matches(words, machine).values()), len(words))

    def normalised(self, total: float, n_words: int) -> float:
        return total / (1 + n_words / 50) ** self.power

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * (strength - self.middle))))) if self.entries else 0.0


def _terms(words: list[str]) -> set[str]:
    """Candidate entries of a text: its words, and their beginnings of three to seven letters."""
    out: set[str] = set()
    for w in set(words):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(3, min(8, len(w))))
    return out


def _sketch(words: list[str]) -> int:
    """A least hash of the word set: near copies mostly share it."""
    return min((xxhash.xxh64_intdigest(w) for w in set(words)), default=0)


def learn(sample: Iterator[tuple[str | None, int]], min_weight: float = MIN_WEIGHT, cover: int = COVER, sure_weight: float = SURE_WEIGHT) -> Lexicon:
    """A lexicon from (text, label) rows, which must be few enough for one machine."""
    texts: dict[tuple[int, int], list[list[str]]] = {}
    pool: dict[str, str] = {}  # one string per word
    for text, label in sample:
        words = [pool.setdefault(w, w) for w in fold(text)]
        if words:
            texts.setdefault((int(label), _sketch(words)), []).append(words)
    toxic = [group[0] for (label, _), group in texts.items() if label == 1]
    clean = [words for (label, _), group in texts.items() if label == 0 for words in group]
    if not toxic or not clean:
        return Lexicon()
    least = max(3, math.ceil(0.01 * len(toxic)))
    # Most terms are rare: a table of hashed counts rules them out, so that only the rest are held and counted.
    hashed = np.zeros(1 << 22, np.uint16)
    for words in toxic:
        hashed[np.unique([hash(t) & (len(hashed) - 1) for t in _terms(words)])] += 1
    support: Counter[str] = Counter()
    for words in toxic:
        support.update([t for t in _terms(words) if hashed[hash(t) & (len(hashed) - 1)] >= least])
    candidates = {t for t, n in support.items() if n >= least}
    against: Counter[str] = Counter()
    for words in clean:
        against.update(_terms(words) & candidates)
    weight = {t: math.log((support[t] + 0.5) / (len(toxic) + 1)) - math.log((against[t] + 0.5) / (len(clean) + 1)) for t in candidates}
    strong = {t for t in candidates if weight[t] >= min_weight}
    # Of a beginning and a longer entry that holds nearly all its support, the longer one says more.
    longer = Counter({t: 0 for t in strong})
    for t in strong:
        for k in range(4, len(t)):
            if t[:k] in strong:
                longer[t[:k]] = max(longer[t[:k]], support[t])
    strong = {t for t in strong if longer[t] < 0.97 * support[t]}
    # Else a beginning stands for all entries it starts, unless it is less sure than they are.
    strong = {t for t in strong if not any(t[:k] in strong and weight[t[:k]] >= weight[t] - 0.5 for k in range(4, len(t)))}
    held = [_terms(words) & strong for words in toxic]
    where: dict[str, list[int]] = {}
    for n, terms in enumerate(held):
        for t in terms:
            where.setdefault(t, []).append(n)
    times = [0] * len(held)
    entries: dict[str, float] = {}
    for floor, times_needed, worth in ((sure_weight, cover, least), (min_weight, 2, max(least, math.ceil(0.03 * len(toxic))))):
        left = {t: ns for t, ns in where.items() if weight[t] >= floor and t not in entries}
        while left:
            gain = {t: sum(times[n] < times_needed for n in ns) for t, ns in left.items()}
            best = max(gain, key=lambda t: (gain[t] * weight[t], t))
            if gain[best] < worth:
                break
            entries[best] = round(weight[best], 6)
            for n in left.pop(best):
                times[n] += 1
    sure = max(least, math.ceil(SURE_SHARE * len(toxic)))
    entries |= {t: round(weight[t], 6) for t in where if t not in entries and weight[t] >= sure_weight and support[t] >= sure}
    lexicon = Lexicon(entries)
    lexicon.exceptions = _exceptions(lexicon, toxic, clean)
    machine = lexicon.matcher()
    sums = [(sum(lexicon.matches(w, machine).values()), len(w), y) for y, group in ((1, toxic), (0, clean)) for w in group]
    best = None
    for power in POWERS:
        lexicon.power = power
        curve = _curve([(lexicon.normalised(total, n), y) for total, n, y in sums])
        if best is None or curve[2] > best[0]:
            best = curve[2], power, curve
    _, lexicon.power, (lexicon.slope, lexicon.middle, _) = best
    return lexicon


def _exceptions(lexicon: Lexicon, toxic: list[list[str]], clean: list[list[str]], least: int = 5) -> tuple[str, ...]:
    machine = lexicon.matcher()

    def phrases(words: list[str]) -> set[str]:
        found = lexicon.matches(words, machine)
        if not found:
            return set()
        places, at = {}, 0
        for n, w in enumerate(words):
            places[at] = n
            at += len(w) + 1
        near = set()
        for p in found:
            n = places[p]
            near.update(" ".join(words[a : a + 2]) for a in (n - 1, n) if a >= 0 and a + 2 <= len(words))
        return near

    seen: Counter[str] = Counter()
    for words in clean:
        seen.update(phrases(words))
    often = {p for p, n in seen.items() if n >= least}
    for words in toxic if often else ():
        often -= phrases(words)
    return tuple(sorted(often))


def _curve(rows: list[tuple[float, int]]) -> tuple[float, float, float]:
    """(slope, middle, quality): the cut that errs least, classes weighted by the square roots of
    their sizes, halfway between the strengths at its sides; the score there is 0.7, and moves by
    odds of 20 over a tenth of the cut."""
    values = np.array(sorted({s for s, _ in rows}))
    pos = np.sort([s for s, y in rows if y])
    neg = np.sort([s for s, y in rows if not y])
    if len(values) < 2:
        return 1.0, float(values[0]) + 1.0, 0.0
    cuts = (values[:-1] + values[1:]) / 2
    missed = np.searchsorted(pos, cuts) / math.sqrt(len(pos))
    wrong = (len(neg) - np.searchsorted(neg, cuts)) / math.sqrt(len(neg))
    best = int(np.argmin(missed + wrong))
    slope = math.log(20) / (0.1 * cuts[best])
    return slope, float(cuts[best] - math.log(0.7 / 0.3) / slope), -float(missed[best] + wrong[best])


def fit(documents: DataFrame, labels: DataFrame, train: Column | None = None, max_rows: int = MAX_ROWS) -> Lexicon:
    """The lexicon of at most ``max_rows`` labelled rows per class, by default of ids whose crc32 modulo 3 is not 1."""
    train = id_fold("doc_id", 3) != 1 if train is None else train
    sample = samples.labelled_texts(documents, labels, "toxic", max_rows, train)
    return learn((r["text"], r["label"]) for r in samples.stream(sample))


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, matches) per row; ``matches`` lists the heaviest entry's folded word at each match."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.matcher()
        for whole in batches:
            for batch in slices(whole):
                scores, matches = [], []
                for text in batch.column(1).to_pylist():
                    words = fold(text)
                    found = lexicon.matches(words, machine)
                    scores.append(lexicon.score(lexicon.normalised(sum(found.values()), len(words))))
                    joined = " ".join(words) if found else ""
                    matches.append([joined[p : e if (e := joined.find(" ", p)) >= 0 else None] for p in sorted(found)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(matches, pa.list_(pa.string()))], names=["doc_id", "score", "matches"])

    return small_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, matches array<string>")


def predicted(cut: float = 0.7) -> Column:
    return (F.col("score") >= cut).cast("int")


def keep(documents: DataFrame, lexicon: Lexicon, cut: float = 0.7) -> DataFrame:
    """``documents`` with all columns, less the toxic rows."""

    def start():
        machine = lexicon.matcher()
        return lambda texts: [lexicon.score(lexicon.strength(fold(t), machine)) < cut for t in texts]

    return filter_rows(documents, start)
