"""Byte-pair encoding by a lazily determinised transducer, and streaming decoding.

The merges of a vocabulary are compiled into a machine that reads the UTF-8 bytes of a
pre-token. Its state is the longest suffix of the input that begins some token; the
transition of a state under a byte is built when it is first taken and kept (lazy
determinisation of the suffix automaton of the vocabulary). In each state the machine
knows the last token of the encoding of all it has read: the longest token that ends
here and that may follow the last token of the encoding before it. Two tokens may follow
each other when merging their joined bytes gives the two back, which is found by
replaying the merges once per pair and kept. A token is emitted as soon as the last
tokens of all positions that later tokens can still reach back to, at most the length of
the longest token, agree on it: the lookahead is bounded.

Texts are cut into pre-tokens for whole batches at once: character classes come from a
table, boundaries from array operations, and equal pre-tokens share one run through the
machine by way of their 128-bit hashes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Letters that follow an apostrophe as one pre-token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters taken in one step of the batch pre-tokeniser.
STEP_CHARS = 1_000_000
#: Pre-tokens kept with their ids; when full the store starts anew.
KEPT_PRETOKENS = 1_000_000


def default_vocabulary() -> str:
    """Where the installed vocabulary of byte_bpe_50k lies."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Transducer:
    """Ids of a pre-token's bytes; compiled from a file of ranks."""

    def __init__(self, path: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                word, number = line.split()
                self.rank[base64.b64decode(word)] = int(number)
        self.word = {i: w for w, i in self.rank.items()}
        self.reach = max(map(len, self.rank))
        self.heads: set[bytes] = {w[:k] for w in self.rank for k in range(1, len(w) + 1)}
        self.moves: dict[tuple[bytes, int], bytes] = {}
        self.ends: dict[bytes, list[tuple[int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.kept: dict[bytes, list[int]] = {}

    def replay(self, word: bytes) -> list[int]:
        """Ids by replaying the merges in order of rank; used to compile, on a token or a pair of them."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.rank.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def move(self, state: bytes, byte: int) -> bytes:
        """The next state, built on first use."""
        got = self.moves.get((state, byte))
        if got is None:
            got = state + bytes((byte,))
            while got not in self.heads:
                got = got[1:]
            self.moves[state, byte] = got
        return got

    def tokens_at(self, state: bytes) -> list[tuple[int, int]]:
        """Tokens that end in this state with their lengths, longest first; only those that encode to themselves."""
        got = self.ends.get(state)
        if got is None:
            tails = (state[k:] for k in range(len(state)))
            got = [(self.rank[t], len(t)) for t in tails if t in self.rank and self.replay(t) == [self.rank[t]]]
            self.ends[state] = got
        return got

    def follows(self, left: int, right: int) -> bool:
        got = self.pairs.get((left, right))
        if got is None:
            got = self.pairs[left, right] = self.replay(self.word[left] + self.word[right]) == [left, right]
        return got

    def stream(self, data: bytes, flush: int = 512) -> Iterator[int]:
        """Ids of one pre-token, emitted while reading."""
        state, last = b"", {0: -1}  # last: token that ends at a position
        base = 0
        for i, byte in enumerate(data, 1):
            state = self.move(state, byte)
            for token, size in self.tokens_at(state):
                before = last.get(i - size)
                if before is not None and (before < 0 or self.follows(before, token)):
                    last[i] = token
                    break
            if i % flush == 0:
                live = {p for p in range(max(base, i - self.reach), i + 1) if p in last}
                while len(live) > 1:
                    p = max(live)
                    live.discard(p)
                    live.add(p - len(self.word[last[p]]))
                settled = live.pop()
                yield from self._back(last, settled, base)
                base = settled
                last = {p: t for p, t in last.items() if p >= base}
        yield from self._back(last, len(data), base)

    def _back(self, last: dict[int, int], at: int, base: int) -> list[int]:
        out = []
        while at > base:
            out.append(last[at])
            at -= len(self.word[last[at]])
        return out[::-1]

    def pretoken(self, data: bytes) -> list[int]:
        """Ids of one pre-token; whole pre-tokens met before are single transitions of the machine."""
        got = self.kept.get(data)
        if got is None:
            if len(self.kept) >= KEPT_PRETOKENS:
                self.kept.clear()
            got = list(self.stream(data))
            if len(data) <= 256:
                self.kept[data] = got
        return got

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins and ends among them."""
        ids, offsets, step, size = [], [np.zeros(1, np.int64)], [], 0
        total = 0
        for i, text in enumerate(texts):
            step.append(text or "")
            size += len(step[-1])
            if size >= STEP_CHARS or i == len(texts) - 1:
                flat, ends = self._encode_step(step)
                ids.append(flat)
                offsets.append(ends + total)
                total += len(flat)
                step, size = [], 0
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate(offsets)

    def _encode_step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        doc_ends = np.cumsum(sizes)
        if not joined:
            return np.zeros(0, np.int32), doc_ends
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = pretoken_starts(codes, doc_ends)
        ends = np.append(starts[1:], len(codes))
        first, kind = distinct(_hashes(codes, starts, ends))
        found = [self.pretoken(joined[starts[k] : ends[k]].encode("utf-8", "replace")) for k in first]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int32, int(lengths.sum()))
        begin = np.cumsum(lengths) - lengths
        each = lengths[kind]
        out_end = np.cumsum(each)
        where = np.arange(out_end[-1]) - np.repeat(out_end - each, each) + np.repeat(begin[kind], each)
        upto = np.append(0, out_end)
        return flat[where], upto[np.searchsorted(starts, doc_ends)]


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.zeros(0x110000, np.uint8)
    for number, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = number
    return table


def pretoken_starts(codes: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts that lie end to end begin."""
    n = len(codes)
    kind = _classes()[codes]
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    limits = np.unique(doc_ends[(doc_ends > 0) & (doc_ends < n)])
    edge[limits] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    closing = np.zeros(n + 1, bool)
    closing[limits] = closing[n] = True
    # the last character of white space before other text stands alone, or with that text when it is a space
    split = (kind[starts] == 3) & ~closing[ends]
    last = ends[split] - 1
    edge[last] = True
    blank = last[codes[last] == 32]
    edge[blank + 1] = False
    # an apostrophe alone that nothing led into takes a contraction along
    mark = np.flatnonzero((codes == 39) & edge)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == 1) & edge[mark + 1] & ~closing[mark + 1]]
    if len(mark):
        letter_ends = np.append(starts[1:], n)[np.searchsorted(starts, mark + 1)]
        taken = np.zeros(len(mark), np.int64)
        for tail in CONTRACTIONS:
            fits = (taken == 0) & (mark + len(tail) < n) & (mark + len(tail) < letter_ends)
            for k, c in enumerate(tail, 1):
                fits &= codes[np.minimum(mark + k, n - 1)] == ord(c)
            taken[fits] = len(tail)
        hit = mark[taken > 0]
        edge[hit + 1] = False
        after = hit + taken[taken > 0] + 1
        edge[after[after < n]] = True
    return np.flatnonzero(edge)


_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 128-bit hash per pre-token as two numbers, from sums over the mixed code points."""
    out = np.empty((2, len(starts)), np.uint64)
    spot = np.arange(len(codes), dtype=np.int64) - np.repeat(starts, ends - starts)
    for k, odd in enumerate(_ODD):
        with np.errstate(over="ignore"):
            x = (codes.astype(np.uint64) + np.uint64(1)) * odd + spot.astype(np.uint64) * _ODD[1 - k]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            out[k] = np.add.reduceat(x, starts)
    return out


def distinct(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair of numbers, one row each of the pair, is met first, and the number of the pair at each place."""
    left, right = hashed
    order = np.argsort(left, kind="stable")
    low, high = left[order], right[order]
    fresh = low[1:] != low[:-1]
    if (high[1:][~fresh] != high[:-1][~fresh]).any():
        order = np.lexsort((right, left))
        low, high = left[order], right[order]
        fresh = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    fresh = np.append(np.ones(min(1, len(order)), bool), fresh)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    return order[fresh], kind


@functools.lru_cache(2)
def transducer(path: str) -> Transducer:
    """The machine of a vocabulary, one for each worker process."""
    return Transducer(path)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids``: the ids of each text, one row per row.

    A null and an empty text both give an empty list; a text that spells a special token
    is ordinary text.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            flat, offsets = machine.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens``: only the number of ids of each text."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            _, offsets = machine.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens bigint")


class Utf8Machine:
    """Incremental UTF-8: bytes in, characters out as soon as they are complete.

    A state is the number of bytes still due, the value so far and the allowed range of
    the next byte. A byte that does not fit gives U+FFFD for the broken sequence and is
    then read as a first byte.
    """

    def __init__(self) -> None:
        self.due, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.value = self.value << 6 | b & 0x3F
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.due = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.value = b & (0x3F >> self.due)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.due = self.due, 0
        return "�" if left else ""


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key, text``: the text of each list of ids; null and empty lists give an empty text."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = transducer(path).word
        for batch in batches:
            texts = []
            for tokens in batch.column(1).to_pylist():
                machine = Utf8Machine()
                texts.append("".join([machine.feed(word[t]) for t in tokens or ()]) + machine.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")
