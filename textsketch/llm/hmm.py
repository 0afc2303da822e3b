"""Hidden Markov language model: latent states trained by Baum-Welch, exact likelihoods by the forward recursion.

A state emits a class, and a class emits a token. The most frequent tokens are classes of their
own; all others share the class of their last bytes, within which they have their smoothed share
of all counts. Texts are tokenised once to count and once to be written as classes, which all passes read. The likelihood of a text is then the forward recursion over its classes times
the shares of its tokens, exactly. Counts of all training tokens stay in a distributed table: only
the head of it, of a bounded size, goes to every task, and the shares of rarer tokens are joined.
Expected counts of states are summed over all training texts in each pass over the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, collected, materialise, one_row, pick, stretch

#: States; tokens with a class of their own; classes of the others; tokens whose counts every task holds.
STATES, OWN, SHARED, HEAD = 8, 3000, 1024, 1 << 17
#: Texts that the first states are found on, at most, and characters of each at most (of a longer one, a stretch); rounds over them.
SAMPLE, LONGEST, WARM = 800, 1 << 16, 3
#: Passes over the whole corpus at most, and the gain of a pass (log10 a token) below which no other follows.
PASSES, GAIN = 4, 0.002
#: Tokens of a text that are counted at once, and those before and after that only give them their context.
SEGMENT, CONTEXT = 512, 24
END, HALF, BATCH, SCORED = b"\n", 0.5, 300_000, 1_500_000
_FLUSH = 300_000


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, and the end, which no word can equal."""
    return [*(text or "").encode().lower().split(), END]


def shared_class(token: bytes) -> int:
    return zlib.crc32(token.rstrip(b".,;:!?|&%$#*")[-4:]) % SHARED


class Head:
    """What each task holds: classes and counts of frequent tokens, and the size of every class."""

    def __init__(self, rows: list[tuple[bytes, int]], n: int, v: int, totals: dict[int, tuple[int, int]]):
        """rows: tokens by falling count; totals: tokens' counts and distinct tokens of each shared class."""
        self.n, self.v = n, v
        own = [t for t, _ in rows[:OWN]]
        if END not in own:
            own.append(END)
        size, kinds = np.zeros(SHARED), np.zeros(SHARED)
        for c, (a, b) in totals.items():
            size[c], kinds[c] = a, b
        counts = dict(rows)
        for t in own:
            if counts.get(t):
                size[shared_class(t)] -= counts[t]
                kinds[shared_class(t)] -= 1
        self.classes = SHARED + len(own)
        self.size = np.log10(size + HALF * (kinds + 1))  # of a share's denominator
        self.scale = np.log10(n + HALF * (v + 1))
        mine = {t: SHARED + i for i, t in enumerate(own)}
        held = [*(t for t, _ in rows), *(t for t in own if t not in counts)]
        #: token -> place in what follows: class, log10 of its share of the class and of the base's numerator, whether it was counted
        self.known = {t: i for i, t in enumerate(held)}
        self.kind = np.array([mine.get(t, -1) if t in mine else shared_class(t) for t in held] + [0], dtype=np.int32)
        self.base = np.array([np.log10(counts.get(t, 0) + HALF) for t in held] + [0.0])
        self.share = np.where(self.kind < SHARED, self.base - self.size[np.minimum(self.kind, SHARED - 1)], 0.0)
        self.counted = np.array([bool(counts.get(t)) for t in held] + [False])

    def places(self, of: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The place of each token (-1: not here), and where those that aren't here stand."""
        at = np.array(list(map(self.known.get, of, repeat(-1))), dtype=np.int64)
        return at, np.nonzero(at < 0)[0].tolist()

    def encode(self, of: list[bytes]) -> np.ndarray:
        at, rare = self.places(of)
        classes = self.kind[at]
        if rare:
            classes[rare] = [shared_class(of[k]) for k in rare]
        return classes


class Part(NamedTuple):
    """Classes of a stretch of a text; its own tokens are those from `own` to `stop`, the others are context."""

    classes: np.ndarray
    own: int
    stop: int


class States:
    """Probabilities of the first state, of transitions and of classes (a row for each class)."""

    def __init__(self, first: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.first, self.moves, self.emits = first, moves, emits

    @classmethod
    def begin(cls, classes: int, rng: np.random.Generator) -> States:
        emits = rng.dirichlet(np.full(classes, 1.0), STATES).T + 1.0 / classes
        moves = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), moves, emits / emits.sum(axis=0))

    @classmethod
    def of(cls, first: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> States:
        """From expected counts, smoothed: each state leans on the mean of all states."""
        mean = (emits.sum(axis=1) + 0.5) / (emits.sum() + 0.5 * len(emits))
        emits = emits + 20 * mean[:, None]
        first, moves = first + 0.1, moves + 0.1
        return cls(first / first.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))

    def loglik(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each sequence of classes, by the scaled forward recursion."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        lengths = np.array([len(texts[k]) for k in order])
        flat = np.concatenate([texts[k] for k in order]) if order else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        out, alpha = np.zeros(len(order)), None
        active, emits, moves = len(order), self.emits, self.moves
        product = np.ones(len(order))
        for t in range(lengths[0] if len(lengths) else 0):
            while lengths[active - 1] <= t:
                active -= 1
            seen = emits[flat[at[:active] + t]]
            alpha = seen * self.first if t == 0 else (alpha[:active] @ moves) * seen
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            product[:active] *= scale
            if t % 16 == 15:  # far from underflow: a class has at least about 1e-12
                out += np.log10(product)
                product[:] = 1
        out += np.log10(product)
        back = np.empty(len(order))
        back[order] = out
        return back

    def expected(self, parts: list[Part]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of first states, transitions and emissions, and (log10 likelihood, tokens), over these parts of texts.

        Only what falls on a part's own tokens is counted; a first state only where a text begins.
        """
        parts = sorted(parts, key=lambda x: len(x.classes), reverse=True)
        lengths, own, stop = (np.array([f(x) for x in parts]) for f in (lambda x: len(x.classes), lambda x: x.own, lambda x: x.stop))
        flat, at = np.concatenate([x.classes for x in parts]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        steps, active, logs = [], len(parts), 0.0
        start, emit, move = (x.astype(np.float32) for x in (self.first, self.emits, self.moves))
        for t in range(lengths[0]):
            while lengths[active - 1] <= t:
                active -= 1
            seen = emit[flat[at[:active] + t]]
            alpha = seen * start if t == 0 else (alpha[:active] @ move) * seen
            scale = alpha.sum(axis=1, keepdims=True)
            alpha /= scale
            mine = ((own[:active] <= t) & (t < stop[:active]))[:, None]
            logs += np.log10(scale, where=mine, out=np.zeros_like(scale)).sum(dtype=np.float64)
            steps.append((alpha, seen / scale, mine))
        moves = np.zeros((STATES, STATES))
        gamma = np.empty((len(flat), STATES), dtype=np.float32)
        for t in range(len(steps) - 1, -1, -1):
            alpha, _, mine = steps[t]
            if t + 1 < len(steps):
                nxt = steps[t + 1][1] * beta
                moves += alpha[: len(nxt)].T @ (nxt * steps[t + 1][2])
                beta = np.concatenate([nxt @ move.T, np.ones((len(alpha) - len(nxt), STATES), dtype=np.float32)])
            else:
                beta = np.ones((len(alpha), STATES), dtype=np.float32)
            gamma[at[: len(alpha)] + t] = alpha * beta * mine
        emits = np.stack([np.bincount(flat, weights=gamma[:, k], minlength=len(self.emits)) for k in range(STATES)], axis=1)
        return gamma[at[own == 0]].sum(axis=0, dtype=np.float64), moves * self.moves, emits, np.array([logs, (stop - own).sum()])


def segments(classes: np.ndarray) -> list[Part]:
    """All of a text for training, in parts of a bounded length, with their context."""
    return [Part(classes[max(0, k - CONTEXT) : k + SEGMENT + CONTEXT], min(k, CONTEXT), min(k, CONTEXT) + min(SEGMENT, len(classes) - k)) for k in range(0, len(classes), SEGMENT)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_pydict({"token": pa.array(keys, pa.binary()), "kind": pa.array(map(shared_class, keys), pa.int32()), "n": pa.array(found.values(), pa.int64())})

    for (text,) in one_row(batches):
        found.update(tokens(text))
        if len(found) >= _FLUSH:
            yield out()
            found.clear()
    if found:
        yield out()


def _head(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most HEAD tokens by falling count: all from some count on, which a histogram of its logarithms tells."""
    step = F.floor(F.log2("n") * 16).cast("int")
    found, cut = 0, None
    for level, n in sorted(counts.groupBy(step.alias("level")).count().collect(), reverse=True):  # at most 1024 levels
        found += n
        if found > HEAD:
            break
        cut = level
    rows = [] if cut is None else counts.where(step >= cut).select("token", "n").collect()  # bounded: HEAD
    return sorted(((bytes(r["token"]), r["n"]) for r in rows), key=lambda r: (-r[1], r[0]))


_ENCODED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, share double, rare array<binary>, times array<int>"


def _encoded(head):
    """Of each text its classes, the sums over tokens that the head has, and the others, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, types = head.value, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int16())]
        names = [*(x.split()[0] for x in _ENCODED.split(", ")), "classes"]
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns), strict=True):
                    of = tokens(text)
                    places, missing = own.places(of)
                    classes = own.kind[places]
                    if missing:
                        classes[missing] = [shared_class(of[k]) for k in missing]
                    known, rare = places[places >= 0], Counter(of[k] for k in missing)
                    share = own.share[known].sum() - own.size[classes[missing]].sum()
                    rows.append((doc_id, held_out, len(of), int(own.counted[known].sum()), float(own.base[known].sum() - len(of) * own.scale), float(share), list(rare), list(rare.values()), classes.astype(np.int16)))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=t) for c, t in enumerate(types)], names=names)

    return run


def _lists(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The column `classes` without a copy."""
    of = batch.column(batch.schema.get_field_index("classes"))
    values, ends = of.values.to_numpy(), of.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _expected(states):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total, held, n = states.value, None, [], 0
        for batch in batches:
            for classes in _lists(batch):
                for part in segments(classes):
                    held.append(part)
                    n += len(part.classes)
                    if n >= BATCH:
                        got = model.expected(held)
                        total, held, n = got if total is None else [a + b for a, b in zip(total, got, strict=True)], [], 0
        if held:
            got = model.expected(held)
            total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:  # classes from 0, then the first states at -1, transitions from state k at -2 - k, and likelihood and tokens
            rows = np.concatenate([total[2], total[0][None], total[1], np.pad(total[3], (0, STATES - 2))[None]])
            key = [*range(len(total[2])), -1, *(-2 - k for k in range(STATES + 1))]
            some = np.nonzero(rows.any(axis=1))[0]
            yield pa.RecordBatch.from_pydict({"key": pa.array([key[k] for k in some], pa.int32()), **{f"s{k}": pa.array(rows[some, k]) for k in range(STATES)}})

    return run


def _scored(states):
    """The rows but for their classes, with a number and the likelihood of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            held = _lists(batch)
            ends = np.cumsum([0, *map(len, held)])
            at = 0
            while at < len(held):  # as many whole texts as SCORED tokens take
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SCORED, "right")) - 1)
                forward = states.value.loglik(held[at:stop])
                own = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + stop - at)), *own.columns[:-1], pa.array(forward)], names=["row", *own.schema.names[:-1], "forward"])
                row, at = row + stop - at, stop

    return run


def train(docs: DataFrame) -> tuple[Broadcast, States, DataFrame, DataFrame, list[float]]:
    """From texts (doc_id, held_out, text): the head, the states, the counts (token, kind, n) of all training tokens, all texts as classes, and each pass's log10 likelihood a token.

    The first states are found on a bounded sample; then each pass adds up the expected counts of all training texts, until
    the likelihood has grown by less than GAIN a token, or PASSES.
    """
    spark = docs.sparkSession
    training = docs.where("not held_out").select("text")
    counts = training.mapInArrow(_counts, "token binary, kind int, n bigint").groupBy("token").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))
    counts = materialise(counts)
    classes = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # bounded: SHARED
    n, v = sum(a for a, _ in classes.values()), sum(b for _, b in classes.values())
    model = Head(_head(counts), n, v, classes)
    head = spark.sparkContext.broadcast(model)
    encoded = materialise(docs.select("doc_id", "held_out", "text").mapInArrow(_encoded(head), f"{_ENCODED}, classes array<smallint>"))
    states = States.begin(model.classes, np.random.default_rng(1))
    some = training.where("text is not null").select(stretch("text", LONGEST, "states").alias("text"))
    picked = collected(some, None, SAMPLE, "states", ["text"])  # bounded: SAMPLE and LONGEST
    first = [s for text in sorted(r["text"] for r in picked) for s in segments(model.encode(tokens(text)))]
    for _ in range(WARM if first else 0):
        states = States.of(*states.expected(first)[:3])
    sums = [F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)]
    history: list[float] = []
    while len(history) < PASSES and (len(history) < 2 or history[-1] - history[-2] >= GAIN):
        sent = spark.sparkContext.broadcast(states)
        own = encoded.where("not held_out").select("classes")
        got = own.mapInArrow(_expected(sent), "key int, " + ", ".join(f"s{k} double" for k in range(STATES))).groupBy("key").agg(*sums).collect()  # bounded: classes
        total = np.zeros((model.classes + 2 + STATES, STATES))
        for r in got:
            total[r["key"] if r["key"] >= 0 else model.classes - r["key"] - 1] = r[1:]
        states = States.of(total[model.classes], total[model.classes + 1 : -1], total[: model.classes])
        history.append(float(total[-1, 0] / max(1.0, total[-1, 1])))
    return head, states, counts, encoded, history


def score(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of (doc_id, text).

    Learns from the rows that are not `held_out` (an expression over doc_id and text). base_score is the unigram log10
    probability of the text, smoothed by a half; score is the model's. A null or empty text is its end alone. Repeated
    rows count as often as they occur; without training rows all tokens are unknown; an
    empty table gives no rows; other columns are ignored, whatever they are called. Texts are read whole: for
    training in segments with their context, for scoring as one sequence.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    head, states, counts, encoded, _ = train(pick(docs, doc_id="bigint", text="string").select("doc_id", held_out.alias("held_out"), "text"))
    sent = spark.sparkContext.broadcast(states)
    scored = materialise(encoded.mapInArrow(_scored(sent), f"row bigint, {_ENCODED}, forward double"))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    joined = rare.join(counts.select("token", "n"), "token", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + HALF)
    more = joined.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"), F.sum(F.col("times") * log).alias("logs"))
    out = scored.drop("rare", "times").join(more, "row", "left").na.fill(0, ["known", "logs"])
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("known")).cast("bigint").alias("n_known"),
        F.lit(head.value.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("logs")).alias("base_score"),
        (F.col("forward") + F.col("share") + F.col("logs")).alias("score"),
    )
