"""Language identification with bit-sliced Bloom filters of character n-grams.

One array of bit masks serves all languages: bit l of a slot is set if an n-gram of language l hashes
there, and the masks of an n-gram's slots, and-ed, name all languages that contain it. The bits
of a text's n-grams are counted for each language, corrected for the share of false
positives that the filling of its slice makes likely, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, bounded_batches, collected, filtered, fold_number, pick, stretch

#: Texts of each language that are fitted to, at most, and characters of each at most (of a longer one, a stretch); slots and hashes of the filter.
SAMPLE, LONGEST, SLOTS, HASHES, SIZES = 600, 1 << 16, 1 << 20, 3, (2, 3, 4)
#: A language holds an n-gram that it has at least so often, and at least at this share of the highest rate.
LEAST, SHARE = 3, 0.1
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_PART = 1 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def has_letter(text: str | None) -> bool:
    return text is not None and (any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text)))


def _points(text: str, after_letter: bool) -> tuple[np.ndarray, bool]:
    """Letters in lower case, of a run of other characters one space; whether the last character is a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = letters()[np.minimum(points, 0x10FFFF)]
    keep = word.copy()
    keep[1:] |= word[:-1]  # of other characters, only the first after a letter
    keep[:1] |= after_letter
    return np.where(word, points, 32)[keep].astype(np.uint64), bool(word[-1]) if len(word) else after_letter


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(points) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ points[k : len(points) - n + 1 + k]) * _MIX[k]
        h ^= h >> np.uint64(29)
    return h * _MIX[0]


def parts(text: str) -> Iterator[np.ndarray]:
    """ngrams() of a text of any length, by parts: what a part lacks of an n-gram is carried over to it."""
    last, after = np.full(1, 32, dtype=np.uint64), False
    for k in range(0, max(1, len(text)), _PART):
        own, after = _points(text[k : k + _PART] + " " * (k + _PART >= len(text)), after)
        own = np.concatenate([last, own])
        for n in SIZES:
            since = own[max(0, len(last) - n + 1) :] if k else own
            if len(since) >= n:
                yield _hashes(since, n)
        last = own[-max(SIZES) :]


def ngrams(text: str) -> list[np.ndarray]:
    """Hashes of the n-grams of the lower-cased words, a space before and after each; others are one space."""
    points = np.concatenate([[np.uint64(32)], _points(f"{text} ", False)[0]])
    return [_hashes(points, n) for n in SIZES if len(points) >= n]


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    a, b = (hashes >> np.uint64(40)).astype(np.int64), ((hashes >> np.uint64(16)) & np.uint64(0xFFFFFF) | np.uint64(1)).astype(np.int64)
    return [(a + k * b) % SLOTS for k in range(HASHES)]


@dataclass
class LanguageModel:
    """Languages in order, a mask array for each 64 of them, and each language's false-positive share."""

    languages: list[str]
    masks: list[np.ndarray]
    wrong: np.ndarray

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """The n-grams of a text, and for each language how many are in it after the correction."""
        total, hits = 0, np.zeros(len(self.languages))
        for h in parts(text):
            total += len(h)
            at = slots(h)
            for w, mask in enumerate(self.masks):
                found = mask[at[0]] & mask[at[1]] & mask[at[2]]
                for bit in range(min(64, len(self.languages) - 64 * w)):
                    hits[64 * w + bit] += np.count_nonzero(found & np.uint64(1 << bit))
        return total, np.maximum(0, hits - total * self.wrong) / (1 - self.wrong)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its share of all languages' counts, and the share of the n-grams that it has."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, 0.0
        total, counts = self.counts(text)
        best = int(np.argmax(counts))  # a tie: the first in order
        return self.languages[best], float(counts[best] / max(counts.sum(), 1e-9)), float(min(1.0, counts[best] / max(total, 1)))


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """From (text, language) rows; without rows, every text is und."""
    languages = sorted({x for _, x in rows})
    sets = {}
    for language in languages:
        found = [h for t, x in rows if x == language for h in ngrams(t)] or [np.zeros(0, np.uint64)]
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        sets[language] = keys[n >= LEAST], n[n >= LEAST] / max(1, n.sum())
    keys = np.unique(np.concatenate([k for k, _ in sets.values()])) if sets else np.zeros(0, np.uint64)
    top = np.zeros(len(keys))
    for k, rate in sets.values():
        np.maximum.at(top, np.searchsorted(keys, k), rate)
    masks = [np.zeros(SLOTS, dtype=np.uint64) for _ in range(0, len(languages), 64)]
    wrong = np.zeros(len(languages))
    for i, language in enumerate(languages):
        k, rate = sets[language]
        k = k[rate >= SHARE * top[np.searchsorted(keys, k)]]
        for at in slots(k):
            masks[i // 64][at] |= np.uint64(1 << (i % 64))
        wrong[i] = (np.count_nonzero(masks[i // 64] & np.uint64(1 << (i % 64))) / SLOTS) ** HASHES
    return LanguageModel(languages, masks, wrong)


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, most: int = SAMPLE) -> LanguageModel:
    """Fit to a bounded sample of the rows with a language whose fold is not held out; repeated rows count once."""
    rows = pick(docs, doc_id="bigint", text="string", lang="string").where("lang is not null and text <> ''").where(fold_number("doc_id", folds) != held_out)
    rows = rows.select("doc_id", "lang", stretch("text", LONGEST, "language").alias("text"))
    texts = collected(rows, "lang", most, "language", ["doc_id", "text"])  # bounded: SAMPLE of each language, LONGEST
    return fit([(r["text"], r["lang"]) for r in sorted(texts, key=lambda r: (str(r["doc_id"]), r["text"], r["lang"]))])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs, all columns, with lang_pred, lang_score and lang_cover (the share of n-grams known to it).

    Null texts and texts without a letter are `und`, 0 and 0; ties go to the first language in
    order; repeated rows have equal results; an empty table gives none; columns of these
    names, in any case, are replaced; other columns may have any name.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(texts: list[str | None]) -> dict:
        found = [shared.value.predict(t) for t in texts]
        return {c: [x[k] for x in found] for k, c in enumerate(("lang_pred", "lang_score", "lang_cover"))}

    return append(docs, ["text"], each, "lang_pred string, lang_score double, lang_cover double")


def keep(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of docs, all columns, in a language of the model that covers at least this share of their n-grams (`und` goes)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: list[str | None]) -> list[bool]:
        return [language != "und" and cover >= least for language, _, cover in map(shared.value.predict, texts)]

    return filtered(docs, "text", good)
