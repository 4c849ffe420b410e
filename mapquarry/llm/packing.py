"""Packing token streams into sequences with an order-preserving dynamic program.

Each scan task tokenizes its documents in the order read and cuts the stream of ids into windows
of at most ``LENGTH`` ids. Windows end at documents or sentences, and inside stretches that have
neither; the program minimises padding plus a penalty for each cut inside a document. The
least ``cost[i] + position[i]`` of the cuts in reach is kept in a monotone queue; some windows whose length is
a power of two, which aren't padded, are a few more transitions. Nothing is shuffled. A task holds
the ids of BLOCK_IDS tokens and one document, however long.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import sized

LENGTH, END = 4096, 2
#: Cost in padding tokens of a cut at a sentence, and of one inside a sentence.
SENTENCE_CUT, HARD_CUT = 8, 32
#: Lengths of unpadded windows that the program tries; it costs time to try all powers of two, and
#: ``halve_tail`` cuts what stays padded at any of them.
FREE = (512, 1024, 2048)
#: A stretch without a sentence end gets a hard cut place each so many ids.
STRIDE = 16
#: Ids of documents that a task packs at once; a block ends at a document.
BLOCK_IDS = 1 << 20
#: Words a Python worker remembers the ids of; then it starts anew.
CACHE_WORDS = 600_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MARKS = b".,;:!?%*&$#|"

_STATE: dict[str, tuple] = {}


class Words:
    """Ids by words between ASCII white space; equal to the tokenizer's own ids for whole texts.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are its
    words' ids in turn; marks behind a word are a token run of their own if its last character, as the tokenizer
    normalises it, is a letter to it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.closes[i] = token.endswith("</w>")
        self.ends = np.zeros(len(self.closes), dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?", "…")
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[str, bool] = {}

    def _letter(self, char: str) -> bool:
        """Whether marks behind this character are a run of their own; asked once a character."""
        if char not in self.letters:
            plain = self.tokenizer.normalizer.normalize_str(char)
            runs = self.tokenizer.pre_tokenizer.pre_tokenize_str(plain + ",") if plain else []
            self.letters[char] = len(runs) > 1 and len(plain) == 1 and runs[-1][1] == (len(plain), len(plain) + 1)
        return self.letters[char]

    def _encode(self, text: str) -> list[int]:
        """The tokenizer's ids, without the offsets that it also finds for single texts."""
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[bytes]) -> None:
        """Plain words go to the tokenizer many to a text and are told apart by their closing ids."""
        odd, plain = [], []
        for w in words:
            s = w.decode("utf-8", "surrogatepass")
            (plain if s.isalpha() and s.lower() == s and len(s) < 200 else odd).append(s)
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = np.array(self._encode(" ".join(part)), dtype="<u4")
            cut = np.flatnonzero(self.closes[ids]) + 1
            if len(cut) != len(part):
                odd += part
                continue
            data = ids.tobytes()
            lo = 0
            for s, hi in zip(part, (4 * cut).tolist(), strict=True):
                self.known[s.encode("utf-8", "surrogatepass")] = data[lo:hi]
                lo = hi
        for s in odd:
            ids = self._encode(s.encode("utf-8", "replace").decode())
            self.known[s.encode("utf-8", "surrogatepass")] = np.array(ids, dtype="<u4").tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.encode("utf-8", "surrogatepass").translate(LOWER).split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        if new:
            stems = {}
            for w in new:
                stem = w.rstrip(MARKS)
                if len(stem) < len(w) and (word := stem.decode("utf-8", "surrogatepass")).isalpha() and self._letter(word[-1]):
                    stems[w] = (stem, w[len(stem) :])
            parts = (new - stems.keys()).union(*stems.values()).difference(self.known)
            self._learn(sorted(parts))
            for w, (stem, mark) in stems.items():
                self.known[w] = self.known[stem] + self.known[mark]
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), dtype="<u4") for s in split]


def _words(path: str) -> Words:
    if path not in _STATE:
        _STATE.clear()
        _STATE[path] = Words(path)
    return _STATE[path]


def padding(length: int, most: int = LENGTH) -> int:
    return 0 if length & (length - 1) == 0 else most - length


def cut_places(lengths: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Document lengths and sentence flags of the stream -> cut positions and their penalties."""
    total = int(lengths.sum())
    kind = np.zeros(total + 1, dtype=np.int8)  # 0 none, 1 hard, 2 sentence, 3 document
    kind[1:][ends] = 2
    kind[np.concatenate([[0], np.cumsum(lengths)])] = 3
    at = np.flatnonzero(kind)
    for i in np.flatnonzero(np.diff(at) > stride):
        kind[np.arange(at[i] + stride, at[i + 1], stride)] = 1
    at = np.flatnonzero(kind)
    return at, np.array([0, HARD_CUT, SENTENCE_CUT, 0])[kind[at]]


def choose_cuts(at: np.ndarray, penalty: np.ndarray, most: int = LENGTH, free: tuple[int, ...] = FREE) -> list[int]:
    """Cut positions, first and last included, of least padding plus penalties.

    A window is charged ``most - length``, those of the lengths ``free`` nothing. The monotone queue holds
    the places in reach in order of ``cost + position``; places a free length before are tried by themselves.
    """
    pos, pen = at.tolist(), penalty.tolist()
    ends, begins = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for width in free:
        i = np.searchsorted(at, at - width)
        j = np.flatnonzero(at[i] == at - width)
        ends.append(j)
        begins.append(i[j])
    order = np.argsort(np.concatenate(ends), kind="stable")
    ends, begins = np.concatenate(ends)[order].tolist(), np.concatenate(begins)[order].tolist()
    ends.append(len(pos))
    cost, back, k = [0] * len(pos), [0] * len(pos), 0
    queue: deque[int] = deque([0])
    for j in range(1, len(pos)):
        while pos[queue[0]] < pos[j] - most:
            queue.popleft()
        i = queue[0]
        best = cost[i] + pos[i] + most - pos[j]
        while ends[k] == j:
            if cost[begins[k]] < best:
                i = begins[k]
                best = cost[i]
            k += 1
        cost[j], back[j] = best + pen[j], i
        key = cost[j] + pos[j]
        while queue and cost[queue[-1]] + pos[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return [0, *reversed(cuts)]


def halve_tail(length: int, most: int = LENGTH) -> list[int]:
    """Parts of a short window: it is cut at powers of two while that saves more than the cuts cost."""
    if padding(length, most) <= HARD_CUT:
        return [length]
    head = 1 << (length.bit_length() - 1)
    rest = halve_tail(length - head, most)
    saved = padding(length, most) - sum(padding(x, most) for x in rest) - HARD_CUT * len(rest)
    return [head, *rest] if saved > 0 else [length]


def packer(path: str, most: int, end: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        seq = TaskContext.get().partitionId() << 33
        docs: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            cols: list[list] = [[] for _ in range(7)]
            if docs:
                lengths = np.array([len(x) for _, x in docs], dtype=np.int64)
                stream = np.concatenate([x for _, x in docs])
                begin = np.concatenate([[0], np.cumsum(lengths)])
                places = cut_places(lengths, words.ends[stream])
                cuts = choose_cuts(*places, most)
                wide = [y for a, b in zip(cuts[:-1], cuts[1:], strict=True) for y in halve_tail(b - a, most)]
                edges = np.union1d(np.concatenate([[0], np.cumsum(wide)]), begin)
                window = np.cumsum(wide)
                which = np.searchsorted(window, edges[:-1], "right")
                doc = np.searchsorted(begin, edges[:-1], "right") - 1
                starts = np.concatenate([[0], window])[which]
                data = stream.astype("<u4").tobytes()
                ids = [docs[d][0] for d in doc.tolist()]
                lo, hi = edges[:-1].tolist(), edges[1:].tolist()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(lo, hi, strict=True)]
                cols = [ids, edges[:-1] - begin[doc], np.diff(edges), crc, lengths[doc], which + seq, edges[:-1] - starts]
                seq += len(wide)
                docs.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for k in range(0, len(texts), 200):
                for doc_id, x in zip(ids[k : k + 200], words.ids(texts[k : k + 200]), strict=True):
                    docs.append((doc_id, np.append(x, np.uint32(end))))
                    held += len(x) + 1
                if held >= BLOCK_IDS:
                    yield flush()
                    held = 0
        yield flush()

    return pack


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of the documents' ids in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is a path that each executor can read. A null or empty text is the end id
    alone. Documents keep the order in which a task reads them; a null doc_id is packed like any
    other; repeated rows are packed each; other columns are ignored; an empty table gives none.
    """
    sized(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(packer(tokenizer, length, end), ", ".join(f"{n} long" for n in NAMES))
