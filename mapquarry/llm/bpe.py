"""Byte-level BPE by replaying merges over a corpus of words, and decoding.

The matches of the pre-splitting pattern are the words. A scan task gathers its documents into blocks; the
words of a block that it doesn't know yet are one corpus, laid end to end as tokens of one byte. An
inverted index lists for each merge the positions of its token pair. Merges are applied to the whole corpus in rank order;
only the neighbours of a merged pair get new entries in the index. A document's ids are its words' ids in turn,
so nothing is shuffled, and a task holds one block, however many documents there are.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import sized

#: Characters of text that a task gathers into one block; a block ends at a document.
BLOCK_CHARS = 1 << 23
#: Words a Python worker remembers the ids of; then it starts anew.
CACHE_WORDS = 600_000

_STATE: dict[tuple[str, str], Encoder] = {}


def load(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 of the bytes, then the rank) by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class Replay:
    """Merges of a vocabulary: a pair of tokens merges into the token that its bytes are, the least rank first."""

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.size = len(tokens)  # no rank
        keys, merged = [], []
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(r)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, dtype=np.int32)[order], np.int32(self.size))
        self.bytes = np.array([self.rank.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary must hold all 256 bytes")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into, ``size`` where it merges into none."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], np.int32(self.size))

    def one(self, word: bytes) -> list[int]:
        """The same for a single word, pair by pair: the least rank, of equal ones the leftmost."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [(self.rank.get(parts[i] + parts[i + 1], self.size), i) for i in range(len(parts) - 1)]
            r, i = min(found)
            if r == self.size:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers; a word that is a token is that token."""
        out: list[bytes] = [b""] * len(words)
        left = []
        for k, w in enumerate(words):
            if (r := self.rank.get(w)) is not None:
                out[k] = r.to_bytes(4, "little")
            elif w:
                left.append(k)
        if left:
            for k, ids in zip(left, self._replay([words[k] for k in left]), strict=True):
                out[k] = ids
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        token = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n, none = len(token), np.int32(self.size)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[np.cumsum(lengths) - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[np.cumsum(lengths) - lengths] = -1
        rank = np.full(n, none, dtype=np.int32)  # of the pair that begins at a position
        open_ = np.flatnonzero(after >= 0)
        rank[open_] = self.ranks(token[open_], token[open_ + 1])
        gone = np.zeros(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Index entries for the pairs that begin at ``at``, ascending within a rank."""
            at = at[rank[at] < none]
            if not len(at):
                return
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            r = rank[at]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            lo = 0
            for hi in [*cut.tolist(), len(at)]:
                key = int(r[lo])
                if key in index:
                    index[key].append(at[lo:hi])
                else:
                    index[key] = [at[lo:hi]]
                    heapq.heappush(heap, key)
                lo = hi

        enter(open_)
        odd: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of pairs that share a token the leftmost merges, so every second one of a chain
            chained = np.append(False, after[at[:-1]] == at[1:])
            if chained.any():
                place = np.arange(len(at))
                first = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - first) % 2 == 0]
            right = after[at]
            behind = after[right]
            has = behind >= 0
            # from left to right a merged token first stands before a neighbour that isn't merged yet
            passing = at[has][self.ranks(np.full(int(has.sum()), r), token[behind[has]]) < r]
            token[at] = r
            after[at] = behind
            gone[right] = True
            rank[right] = none
            before[behind[has]] = at[has]
            rank[at] = none
            rank[at[has]] = self.ranks(token[at[has]], token[behind[has]])
            front = before[at]
            front = front[front >= 0]
            rank[front] = self.ranks(token[front], token[after[front]])
            touched = np.union1d(at, front)
            early = np.concatenate([passing, touched[rank[touched] < r]])
            if len(early):
                # a merge opened a pair of lower rank; in a word merged in two places that pair came too late
                w, c = np.unique(word[at], return_counts=True)
                odd.update(np.intersect1d(word[early], w[c > 1]).tolist())
            enter(touched)
        alive = ~gone
        ids = token[alive].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4
        out, lo = [], 0
        for hi in ends.tolist():
            out.append(ids[lo:hi])
            lo = hi
        for k in odd:
            out[k] = np.array(self.one(words[k]), dtype="<u4").tobytes()
        return out


class Encoder:
    """Texts to ids and back, as the tiktoken library does for this pattern and these ranks."""

    def __init__(self, path: str, pattern: str):
        self.tokens = load(path)
        self.replay = Replay(self.tokens)
        self.pattern, self.odd, self.exact = patterns(pattern)
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if self.odd is not None and not text.isascii() and self.odd.search(text):
            return self.exact.findall(text)
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = sorted(set().union(*split).difference(self.known))
        if new:
            self.known.update(zip(new, self.replay.encode([w.encode() for w in new]), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def patterns(pattern: str) -> tuple:
    """The pattern, one for characters on whose class the engines' Unicode tables differ, and the pattern for texts with those.

    Tables age: letters and digits that are newer than the tokenizer's table are other characters to it. Its
    table is read off the tokenizer's own pattern engine.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, (c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)))
    single = {bytes([i]): i for i in range(256)}
    exact, differing = pattern, set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        table = tiktoken.Encoding("table", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs, ours = set(bytes(table.encode_ordinary(every)).decode()), set(regex.findall(kind, every))
        differing |= ours ^ theirs
        less, more = _ranges(ours - theirs), _ranges(theirs - ours)
        if less or more:
            exact = exact.replace(kind, f"[{f'[{kind}--[{less}]]' if less else kind}{more}]")
    odd = regex.compile(f"[{_ranges(differing)}]") if differing else None
    return regex.compile(pattern), odd, regex.compile(exact, regex.V1)


def _ranges(chars: set[str]) -> str:
    """The inside of a character class."""
    codes, out, k = sorted(map(ord, chars)), [], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[k]:08x}" + (f"-\\U{codes[j]:08x}" if j > k else ""))
        k = j + 1
    return "".join(out)


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _STATE:
        _STATE.clear()
        _STATE[path, pattern] = Encoder(path, pattern)
    return _STATE[path, pattern]


def coder(path: str, pattern: str, chars: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for rows, texts in _blocks(batches, chars):
            ids = encoder.encode(texts)
            back = [encoder.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], NAMES
            )

    return code


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of consecutive documents with at least ``chars`` characters together, the last block with fewer."""
    rows, texts, held = [], [], 0
    for batch in batches:
        lo = 0
        for k, raw in enumerate(batch.column(1).to_pylist()):
            texts.append((raw or b"").decode("utf-8", "replace"))
            held += len(texts[-1])
            if held >= chars:
                yield pa.concat_arrays([*rows, batch.column(0).slice(lo, k + 1 - lo)]), texts
                rows, texts, held, lo = [], [], 0, k + 1
        rows.append(batch.column(0).slice(lo))
    if texts:
        yield pa.concat_arrays(rows), texts


NAMES = ["doc_id", "n_tokens", "ids", "decoded"]


def encode(docs: DataFrame, tokenizer: str, pattern: str, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (the bytes that the ids stand for).

    ``tokenizer`` is a path of a rank file that each executor can read. A null or empty text has no ids; bytes that
    aren't UTF-8 count as U+FFFD; null doc_ids and repeated rows are encoded each; other columns are ignored;
    an empty table gives none.
    """
    sized(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(coder(tokenizer, pattern, chars), "doc_id long, n_tokens long, ids binary, decoded binary")
