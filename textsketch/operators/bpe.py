"""Exact byte-pair encoding over any vocabulary of bytes whose ids are their merge ranks.

Plain functions work on one text; the DataFrame operators at the end run them over Arrow batches with a
vocabulary that is built once in each worker. Vocabularies are read, never trained.
"""

from __future__ import annotations

import base64
import functools
import heapq
import random
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import spread, stretches


#: Bytes of a text whose parts are searched rather than kept in a heap; pieces that a tokenizer remembers.
_SHORT, _PIECES = 32, 1 << 18


def read_tiktoken(data: str) -> list[bytes]:
    """Tokens in order of lines `base64 rank`; empty lines are skipped."""
    return [base64.b64decode(line.split(" ")[0]) for line in data.splitlines() if line]


class Vocabulary:
    """Tokens by id, their ids, and of each longer token the two tokens that merge last."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = list(tokens)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        if len(self.ids) != len(self.tokens):
            raise ValueError("a token occurs twice")
        self.longest = max(map(len, self.tokens), default=0)

    @functools.cached_property
    def splits(self) -> list[tuple[int, int]]:
        """The two tokens that merge last into each; a token that can't be split is its own."""
        return [self._halves(t, i) for i, t in enumerate(self.tokens)]

    @functools.cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        return {halves: i for i, halves in enumerate(self.splits) if halves != (i, i)}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        parts = _merged(token, self.ids, rank)
        if len(token) > 1 and len(parts) == 2:
            return self.ids[parts[0]], self.ids[parts[1]]
        return rank, rank

    @classmethod
    def from_tiktoken(cls, data: str) -> Vocabulary:
        return cls(read_tiktoken(data))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path) as lines:
            return cls.from_tiktoken(lines.read())

    def num_tokens(self) -> int:
        return len(self.tokens)

    def token_bytes(self, token: int) -> bytes:
        return self.tokens[token]

    def token_len(self, token: int) -> int:
        return len(self.tokens[token])

    # pairs

    def is_valid_pair(self, a: int, b: int) -> bool:
        """Whether the encoding keeps a boundary between two tokens that follow each other."""
        limit = 1 << 32
        while True:
            whole = self.pairs.get((a, b))
            if whole is not None and whole < limit:
                return False
            # undo the later merge of the two; a token that can't be split is done
            first = a > b
            for left in (first, not first):
                if left:
                    limit, a = a, self.splits[a][1]
                    if a != limit:
                        break
                else:
                    limit, b = b + 1, self.splits[b][0]
                    if b + 1 != limit:
                        break
                    if first:
                        return True
            else:
                return True

    def matches(self, text: bytes, at: int) -> Iterator[int]:
        """Tokens that begin at a place, longest first."""
        for n in range(min(self.longest, len(text) - at), 0, -1):
            token = self.ids.get(text[at : at + n])
            if token is not None:
                yield token

    # encodings

    def encode(self, text: bytes) -> list[int]:
        """By the definition: merge the pair of least rank, leftmost first."""
        return [self.ids[x] for x in _merged(text, self.ids, len(self.tokens))]

    encode_via_bitfield = encode

    def encode_via_backtracking(self, text: bytes) -> list[int]:
        """Longest match first, going back where a boundary isn't kept; equal to encode()."""
        out: list[int] = []
        ways: list[Iterator[int]] = [self.matches(text, 0)]
        at, dead = 0, set()
        while at < len(text):
            for token in ways[-1]:
                end = at + len(self.tokens[token])
                if end not in dead and (not out or self.is_valid_pair(out[-1], token)):
                    out.append(token)
                    at = end
                    ways.append(self.matches(text, at))
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at)
                ways.pop()
                at -= len(self.tokens[out.pop()])
        return out

    def prefix_tokens(self, text: bytes) -> list[int]:
        """For each prefix, the last token of its encoding."""
        encoder = Appendable(self)
        encoder.extend(text)
        return encoder.last

    def encode_via_table(self, text: bytes) -> list[int]:
        last, out, at = self.prefix_tokens(text), [], len(text)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode_greedy(self, text: bytes) -> list[int]:
        """Longest match from the left; not the same encoding."""
        out, at = [], 0
        while at < len(text):
            out.append(next(self.matches(text, at)))
            at += len(self.tokens[out[-1]])
        return out

    def encode_minimal(self, text: bytes, dropout: float = 0.0, seed: int | None = None) -> list[int]:
        """Fewest tokens; with dropout, longer tokens are left out of account at that rate."""
        if not 0 <= dropout <= 1:
            raise ValueError("dropout must be 0 to 1")
        rng = random.Random(seed)
        best: list[tuple[int, int]] = [(0, 0)] * (len(text) + 1)
        for at in range(len(text) - 1, -1, -1):
            found = (1 << 30, 0)
            for token in self.matches(text, at):
                n = len(self.tokens[token])
                if n > 1 and dropout and rng.random() < dropout:
                    continue
                if best[at + n][0] + 1 < found[0]:
                    found = (best[at + n][0] + 1, token)
            best[at] = found
        out, at = [], 0
        while at < len(text):
            out.append(best[at][1])
            at += len(self.tokens[out[-1]])
        return out

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(self.tokens[t] for t in tokens)

    def count(self, text: bytes) -> int:
        return len(self.encode(text))

    def count_till_limit(self, text: bytes, limit: int) -> int | None:
        """None if there are more tokens than the limit."""
        if len(text) > (limit + 1) * self.longest:
            return None
        n = self.count(text)
        return n if n <= limit else None


def _merged(text: bytes, ids: dict[bytes, int], below: int) -> list[bytes]:
    """Merge adjacent parts by rising rank, as long as one below the limit is left."""
    n = len(text)
    if n < 2:
        return [text] if text else []
    if n <= _SHORT:
        return _merged_short(text, ids, below)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ids.get(text[i : i + 2], below)) < below]
    heapq.heapify(heap)
    while heap:
        _, start, end = heapq.heappop(heap)
        mid = after[start]
        if mid < 0 or mid >= n or after[mid] != end:
            continue  # one of the two has changed
        after[start], after[mid] = end, -1
        if end < n:
            before[end] = start
            far = after[end]
            if (r := ids.get(text[start:far], below)) < below:
                heapq.heappush(heap, (r, start, far))
        left = before[start]
        if left >= 0 and (r := ids.get(text[left:end], below)) < below:
            heapq.heappush(heap, (r, left, end))
    out, at = [], 0
    while at < n:
        out.append(text[at : after[at]])
        at = after[at]
    return out


def _merged_short(text: bytes, ids: dict[bytes, int], below: int) -> list[bytes]:
    """The same without a heap: few parts are searched faster than kept in order."""
    parts = [text[k : k + 1] for k in range(len(text))]
    ranks = [ids.get(text[k : k + 2], below) for k in range(len(text) - 1)]
    while ranks and (least := min(ranks)) < below:
        k = ranks.index(least)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del ranks[k]
        if k:
            ranks[k - 1] = ids.get(parts[k - 1] + parts[k], below)
        if k < len(ranks):
            ranks[k] = ids.get(parts[k] + parts[k + 1], below)
    return parts


class Appendable:
    """Encodes a growing text: the last token, and the number of tokens, of each prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.text, self.last, self.counts = vocabulary, bytearray(), [], []

    def extend(self, data: bytes) -> None:
        for byte in data:
            self.push(byte)

    def truncate(self, n: int) -> None:
        del self.text[n:], self.last[n:], self.counts[n:]

    def push(self, byte: int) -> None:
        self.text.append(byte)
        n = len(self.text)
        for size in range(1, min(self.v.longest, n) + 1):
            token = self.v.ids.get(bytes(self.text[n - size :]))
            if token is None:
                continue
            if size == n or self.v.is_valid_pair(self.last[n - size - 1], token):
                self.last.append(token)
                self.counts.append(1 if size == n else self.counts[n - size - 1] + 1)
                return
        raise ValueError("the vocabulary lacks a byte")

    def token_count(self) -> int:
        return self.counts[-1] if self.counts else 0

    def __len__(self) -> int:
        return len(self.text)

    def is_empty(self) -> bool:
        return not self.text


class Prependable:
    """Encodes a text that grows to the left: the number of tokens of each suffix."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.text, self.first, self.counts = vocabulary, bytearray(), [], []

    def extend(self, data: bytes) -> None:
        """Put data in front, its last byte first."""
        for byte in reversed(data):
            self.push(byte)

    def truncate(self, n: int) -> None:
        del self.text[n:], self.first[n:], self.counts[n:]

    def push(self, byte: int) -> None:
        self.text.append(byte)
        n = len(self.text)
        for size in range(1, min(self.v.longest, n) + 1):
            token = self.v.ids.get(bytes(reversed(self.text[n - size :])))
            if token is None:
                continue
            if size == n or self.v.is_valid_pair(token, self.first[n - size - 1]):
                self.first.append(token)
                self.counts.append(1 if size == n else self.counts[n - size - 1] + 1)
                return
        raise ValueError("the vocabulary lacks a byte")

    def token_count(self) -> int:
        return self.counts[-1] if self.counts else 0

    def __len__(self) -> int:
        return len(self.text)

    def is_empty(self) -> bool:
        return not self.text


class Intervals:
    """Token counts of any range of a text: where its encoding joins the text's, prefix counts tell the rest."""

    def __init__(self, vocabulary: Vocabulary, text: bytes):
        self.v, self.text = vocabulary, text
        whole = Appendable(vocabulary)
        whole.extend(text)
        self.last, self.counts = whole.last, whole.counts

    def count(self, start: int, end: int) -> int:
        if start >= end:
            return 0
        chain, at = {}, end  # boundaries of the encoding of the prefix that ends here
        while at > 0:
            chain[at] = self.counts[at - 1]
            at -= self.v.token_len(self.last[at - 1])
        chain[0] = 0
        encoder, n = Appendable(self.v), 0
        for k in range(start, end):
            encoder.push(self.text[k])
            n = k + 1
            # the boundary is shared, and the same token follows in both: so does all the rest
            if n in chain and n < end and encoder.last[-1] == self.last[k]:
                return encoder.token_count() + self.counts[end - 1] - chain[n]
        return encoder.token_count()


# pre-tokenising

_END = "(?i:" + "|".join("'" + x for x in "s t re ve m ll d".split()) + ")"
_SPACE = [r"\s*[\r\n]+", r"\s+(?!\S)", r"\s+"]
_SIGNS = r" ?[^\s\p{L}\p{N}]+[\r\n"
_UPPER, _LOWER = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
_LEAD = r"[^\r\n\p{L}\p{N}]?"
PATTERNS = {
    "cl100k": "|".join([_END, _LEAD + r"\p{L}+", r"\p{N}{1,3}", _SIGNS + "]*", *_SPACE]),
    "o200k": "|".join([f"{_LEAD}{_UPPER}*{_LOWER}+{_END}?", f"{_LEAD}{_UPPER}+{_LOWER}*{_END}?", r"\p{N}{1,3}", _SIGNS + "/]*", *_SPACE]),
    "voyage3": "|".join([_END, _LEAD + r"\p{L}+", r"\p{N}", _SIGNS + "]*", *_SPACE]),
}


class Tokenizer:
    """A vocabulary behind an optional pattern, whose matches are encoded alone, and optional normalisation to NFC."""

    def __init__(self, vocabulary: Vocabulary, pattern: str | None = None, nfc: bool = False):
        import regex

        self.v, self.nfc = vocabulary, nfc
        self.pattern = regex.compile(pattern) if pattern else None
        self._piece = functools.lru_cache(maxsize=_PIECES)(lambda piece: tuple(self.v.encode(piece.encode())))

    def __reduce__(self):
        return Tokenizer, (self.v, self.pattern.pattern if self.pattern else None, self.nfc)

    def normalize(self, text: str) -> str:
        return unicodedata.normalize("NFC", text) if self.nfc else text

    def split(self, text: str) -> Iterator[str]:
        """Matches from the start on, until there is none."""
        if self.pattern is None:
            yield text
            return
        at = 0
        for m in self.pattern.finditer(text):
            if m.start() != at or m.end() == at:
                return
            yield m[0]
            at = m.end()

    def pieces(self, text: str) -> Iterable[str]:
        """split(), found all at once where the matches leave nothing out."""
        if self.pattern is not None and not self.pattern.groups:
            found = self.pattern.findall(text)
            if sum(map(len, found)) == len(text) and all(found):
                return found
        return self.split(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._piece, self.pieces(self.normalize(text)))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self._piece, self.pieces(self.normalize(text)))))

    def count_till_limit(self, text: str, limit: int) -> int | None:
        """Of a normalised text; None as soon as there are more tokens."""
        n = 0
        for piece in self.split(text):
            n += len(self._piece(piece))
            if n > limit:
                return None
        return n

    def decode(self, tokens: list[int]) -> str | None:
        """None if the bytes are no UTF-8."""
        try:
            return self.v.decode(tokens).decode()
        except UnicodeDecodeError:
            return None

    def chunks(self, text: str, limit: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, tokens) in characters: pieces in stretches of at most `limit` tokens; one too long is cut between characters."""
        start = end = n = 0
        for piece in self.pieces(text):
            k = len(self._piece(piece))
            if n and n + k > limit:
                yield start, end, n
                start, n = end, 0
            if k > limit:
                own = ""
                for char in piece:
                    if own and self.v.count((own + char).encode()) > limit:
                        yield start, end, self.v.count(own.encode())
                        start, own = end, ""
                    own, end = own + char, end + 1
                n = self.v.count(own.encode())
            else:
                n, end = n + k, end + len(piece)
        if end > start:
            yield start, end, n


# DataFrame operators


def tokenizer(path: str, pattern: str | None, nfc: bool = False) -> Callable[[], Tokenizer]:
    """A recipe that builds a tokenizer once in each worker, from a file that all of them have."""
    return functools.partial(_built, path, pattern, nfc)


@functools.lru_cache(maxsize=4)
def _built(path: str, pattern: str | None, nfc: bool) -> Tokenizer:
    return Tokenizer(Vocabulary.load(path), pattern, nfc)


def _per_text(df: DataFrame, key: str, text: str, each: Callable, columns: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """(key, columns) from each(text), a list of rows for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in stretches(whole)):
            rows = [(k, *r) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t is not None for r in each(t)]
            arrays = [pa.array([r[0] for r in rows], batch.schema.field(0).type)]
            arrays += [pa.array([r[i + 1] for r in rows], t) for i, (_, _, t) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", *(c[0] for c in columns)])

    kind = dict(df.dtypes)[key]
    return spread(df.select(key, text)).mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} {s}" for n, s, _ in columns))


def encode(df: DataFrame, key: str, text: str, make: Callable[[], Tokenizer]) -> DataFrame:
    """(key, tokens)."""
    return _per_text(df, key, text, lambda t: [(make().encode(t),)], [("tokens", "array<int>", pa.list_(pa.int32()))])


def count(df: DataFrame, key: str, text: str, make: Callable[[], Tokenizer], limit: int | None = None) -> DataFrame:
    """(key, n_tokens): null above the limit."""
    each = lambda t: [(make().count(t) if limit is None else make().count_till_limit(make().normalize(t), limit),)]
    return _per_text(df, key, text, each, [("n_tokens", "int", pa.int32())])


def chunk(df: DataFrame, key: str, text: str, make: Callable[[], Tokenizer], limit: int) -> DataFrame:
    """(key, chunk, start, end, n_tokens): the whole text, in stretches of at most `limit` tokens."""
    each = lambda t: [(k, *x) for k, x in enumerate(make().chunks(t, limit))]
    return _per_text(df, key, text, each, [(n, "int", pa.int32()) for n in ("chunk", "start", "end", "n_tokens")])


def variants(df: DataFrame, key: str, text: str, make: Callable[[], Tokenizer]) -> DataFrame:
    """(key, n_exact, n_backtracking, n_table, n_greedy, n_minimal, same): the encodings of the whole text without a pattern."""

    def each(t: str) -> list[tuple]:
        v, data = make().v, t.encode()
        exact, back, table = v.encode(data), v.encode_via_backtracking(data), v.encode_via_table(data)
        return [(len(exact), len(back), len(table), len(v.encode_greedy(data)), len(v.encode_minimal(data)), exact == back == table)]

    names = ["n_exact", "n_backtracking", "n_table", "n_greedy", "n_minimal"]
    return _per_text(df, key, text, each, [*((n, "int", pa.int32()) for n in names), ("same", "boolean", pa.bool_())])


def prefix_counts(df: DataFrame, key: str, text: str, make: Callable[[], Tokenizer]) -> DataFrame:
    """(key, prefixes, suffixes): token counts of every prefix and of every suffix of the bytes."""

    def each(t: str) -> list[tuple]:
        a, b = Appendable(make().v), Prependable(make().v)
        a.extend(t.encode())
        b.extend(t.encode())
        return [(a.counts, b.counts)]

    return _per_text(df, key, text, each, [("prefixes", "array<int>", pa.list_(pa.int32())), ("suffixes", "array<int>", pa.list_(pa.int32()))])


def interval_counts(df: DataFrame, key: str, text: str, make: Callable[[], Tokenizer], every: int, width: int) -> DataFrame:
    """(key, start, end, n_tokens) of sliding byte ranges."""

    def each(t: str) -> list[tuple]:
        data = t.encode()
        of = Intervals(make().v, data)
        return [(s, min(s + width, len(data)), of.count(s, min(s + width, len(data)))) for s in range(0, len(data), every)]

    return _per_text(df, key, text, each, [(n, "int", pa.int32()) for n in ("start", "end", "n_tokens")])


def decode(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(key, text) from (key, tokens): joined with the vocabulary relation, in order. Ids that it lacks are left out."""
    flat = tokens.select("key", F.posexplode_outer("tokens").alias("at", "token_id"))
    parts = flat.join(F.broadcast(vocabulary.select("token_id", "bytes")), "token_id", "left")  # of a vocabulary's size
    ordered = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("bytes").isNotNull(), F.struct("at", "bytes")))).alias("all"))
    joined = F.aggregate("all", F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"]))
    return ordered.select("key", F.try_validate_utf8(joined.cast("string")).alias("text"))


def create_test_string(vocabulary: Vocabulary, least: int, seed: int, allowed: Callable[[str], bool] = lambda _: True) -> str:
    """Random tokens that are UTF-8 together, of at least so many bytes, each text so far being allowed."""
    rng, out, tries = random.Random(seed), "", 0
    while len(out.encode()) < least:
        token = rng.choice(vocabulary.tokens)
        tries += 1
        if tries > 1000 + 100 * least:
            raise ValueError("too few tokens are allowed")
        try:
            text = out + token.decode()
        except UnicodeDecodeError:
            continue
        if allowed(text):
            out = text
    return out


def select_test_bytes(data: bytes, least: int, seed: int) -> bytes:
    """A stretch of so many bytes of a text, moved on to whole characters; all of a shorter one."""
    if len(data) <= least:
        return data
    start = random.Random(seed).randrange(len(data) - least + 1)
    stop = start + least
    while start and data[start] & 0xC0 == 0x80:
        start -= 1
    while stop < len(data) and data[stop] & 0xC0 == 0x80:
        stop += 1
    return data[start:stop]


def create_test_bytes(vocabulary: Vocabulary, least: int, seed: int) -> bytes:
    rng, out = random.Random(seed), b""
    while len(out) < least:
        out += rng.choice(vocabulary.tokens)
    return out


def vocabulary_table(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, bytes) of a tiktoken file, with Spark's text reader."""
    from ..sources.tiktoken import read

    return read(spark, path)
