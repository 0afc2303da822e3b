"""Quality by compression: zstandard dictionaries of good and bad text, and a calibrated difference.

A text is compressed with either dictionary in three views: as it is, as its shape (letters become a or
A, digits 0), and as its echo (of each word, how long ago it last occurred, and its length). The difference of
the two sizes, normalised by their sum and by the length, enters a logistic calibration; nothing else does. There are two
such classifiers, each with dictionaries of one half of the labelled rows and a calibration to the other; a score is between theirs.
Views are cut into blocks, which makes the difference independent of the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, bounded_batches, collected, filtered, fold_number, materialise, pick, sampled, stretch

#: Labelled rows of each class that are fitted to, at most, and characters of each (of a longer one, a stretch); each half makes dictionaries, to which the other half calibrates.
SAMPLE, LONGEST = 2000, 1 << 16
BLOCK, DICTIONARY, LEVEL = 2048, 112_640, 3
VIEWS, RIDGE, _HELD = 3, 0.3, 200_000
_SHAPE = bytes(97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))


def blocks(data: bytes) -> list[bytes]:
    """All of the data; what is left over is a block of its own only if it is a quarter of one."""
    cuts = list(range(0, len(data), BLOCK)) or [0]
    if len(cuts) > 1 and len(data) - cuts[-1] < BLOCK // 4:
        cuts.pop()
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def _views(text: str | None) -> tuple[bytes, ...]:
    data = (text or "").encode()
    return data, data.translate(_SHAPE), echo(data)


def echo(data: bytes) -> bytes:
    """Two bytes for each word: N for a new one or the bits of the distance to its last occurrence, and its length up to 9."""
    last: dict[bytes, int] = {}
    out = bytearray()
    for k, word in enumerate(data.lower().split()):
        if len(last) >= _HELD:  # of very long texts, what was seen long ago is new again
            last.clear()
        back = k - last.get(word, k)
        last[word] = k
        out += bytes((96 + back.bit_length() if back else 78, 48 + min(9, len(word))))
    return bytes(out)


def _dictionary(texts: list[bytes]) -> bytes:
    parts = [x for t in texts for x in blocks(t) if x]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"\n".join(parts)[-DICTIONARY:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    made = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Half:
    """Dictionaries (good, bad) of each view, and the calibration: weights, means, deviations."""

    dictionaries: list[tuple[bytes, bytes]]
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pairs"}

    def features(self, views: tuple[bytes, ...]) -> list[float]:
        if "_pairs" not in self.__dict__:
            self._pairs = [(_compressor(g), _compressor(b)) for g, b in self.dictionaries]
        out = []
        for (good, bad), view in zip(self._pairs, views, strict=True):
            cut = blocks(view)
            a, b = (sum(len(c.compress(x)) for x in cut) for c in (good, bad))
            out += [(b - a) / (a + b), (b - a) / (len(view) + 8)]
        return out

    def logits(self, views: list[tuple[bytes, ...]]) -> np.ndarray:
        x = np.array([self.features(v) for v in views]).reshape(len(views), 2 * VIEWS)
        return np.c_[(x - self.mean) / self.spread, np.ones(len(x))] @ self.weights

    def calibrate(self, rows: list[tuple[str, int]], share: float) -> Half:
        """Fit the weights to (text, label) rows of both labels, of which `share` is 1 where the rows come from."""
        x, y = np.array([self.features(_views(t)) for t, _ in rows]), np.array([q for _, q in rows])
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z, w = np.c_[(x - self.mean) / self.spread, np.ones(len(x))], np.zeros(2 * VIEWS + 1)
        for _ in range(60):  # Newton's steps, with a small ridge
            p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            w += np.linalg.solve((z.T * (p * (1 - p))) @ z + RIDGE * np.eye(2 * VIEWS + 1), z.T @ (y - p) - RIDGE * w)
        w[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
        self.weights = w
        return self


@dataclass
class QualityModel:
    """Two halves; or none, and the score of every text."""

    halves: list[Half]
    constant: float = 1.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.halves:
            return np.full(len(texts), self.constant)
        views = [_views(t) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.mean([h.logits(views) for h in self.halves], axis=0), -500, 500)))


def fit(rows: list[tuple[str, int]], share: float | None = None) -> QualityModel:
    """From (text, label) rows; with fewer than two of a label, every score is the share of label 1 (or 1 without rows).

    `share` is that of label 1 among all labelled rows, which the rows are a sample of by label: scores are calibrated to it.
    """
    by = {q: [(t, q) for t, label in rows if label == q] for q in (1, 0)}
    own = len(by[1]) / len(rows) if rows else 1.0
    if min(map(len, by.values())) < 2:
        return QualityModel([], own)
    share = own if share is None else min(max(share, 1e-6), 1 - 1e-6)
    made = []
    for k in range(2):
        texts = {q: [_views(t) for t, _ in of[k::2]] for q, of in by.items()}
        half = Half([tuple(_dictionary([v[i] for v in texts[q]]) for q in (1, 0)) for i in range(VIEWS)])
        made.append(half.calibrate(by[1][1 - k :: 2] + by[0][1 - k :: 2], share))
    return QualityModel(made)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most: int = SAMPLE) -> QualityModel:
    """Fit to a bounded sample of rows whose fold is not held out.

    Rows without text or label don't count, nor do ids whose labels contradict each other; repeated rows count once.
    """
    marks = pick(labels, doc_id="bigint", quality="int").where("doc_id is not null and quality in (0, 1)").where(fold_number("doc_id", folds) != held_out)
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    chosen = F.broadcast(sampled(marks, "quality", most, "quality", ["doc_id"]).drop("h"))  # bounded: about SAMPLE
    texts = pick(docs, doc_id="bigint", text="string").where("text <> ''").join(chosen, "doc_id")
    found = materialise(texts.select("doc_id", "quality", stretch("text", LONGEST, "quality").alias("text")))  # one id may have any number of rows
    rows = collected(found, "quality", most, "quality", ["doc_id", "text"])  # bounded: SAMPLE and LONGEST
    n = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}  # two rows at most
    share = n.get(1, 0) / max(1, sum(n.values()))
    return fit([(r["text"], r["quality"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))], share)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs, all columns, with `quality_score` (0 to 1): the likelihood of label 1.

    Null and empty texts have the score of an empty text; repeated rows have equal scores; an
    empty table gives none; a column called quality_score, in any case, is replaced; others may have any name.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append(docs, ["text"], lambda texts: {"quality_score": shared.value.scores(texts)}, "quality_score double")


def keep(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that have at least this score."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, "text", lambda texts: (shared.value.scores(texts) >= least).tolist())
