"""Phrase collocations from word-id suffix arrays.

A scan task splits its texts into words and gathers them into shards. A shard has its own word ids, sorts its suffixes by
their first words with prefix doubling and reads the counts of all phrases off the intervals of the LCP array; a shard
so emits each of its phrases once, however often it stands there, and Spark adds the shards up by phrase.

Three passes keep rare phrases out of the shuffle without losing a frequent one: a phrase as frequent as asked
for has only words, and only word pairs, that are as frequent. Words, then pairs of frequent words by their hash, then all
phrases of frequent pairs are counted. Which words and pairs are frequent travels as a bitmap of fixed size; where two
hashes share a bit, phrases are counted that needn't be, and the exact sums of the last pass drop them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, sized

#: Occurrences that a candidate needs, words of the longest one, rows of a language's report.
LEAST, MOST, TOP = 100, 5, 2000
#: Words and breaks of a shard; a shard ends at a document.
SHARD_WORDS = 1 << 21
#: Bits of a hash that address a bitmap of frequent words or pairs (8 MB).
BITMAP = 26
#: Language of documents without one.
UNKNOWN = "und"

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A-Z in lower case, ends of pieces as line feeds, tabs as spaces.
PLAIN = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else LOWER[c] for c in range(256))
#: Ids of the empty word between two spaces, which goes, and of a piece's end.
NOTHING, BREAK = 0, 1


class _Words(dict):
    """Word ids of one language; ids are shared out by the shard's counter."""

    def __init__(self, ids: Iterator[int]):
        super().__init__({b"": NOTHING, b"\n": BREAK})
        self.ids = ids

    def __missing__(self, word: bytes) -> int:
        self[word] = i = next(self.ids)
        return i


class Shard:
    """Texts of some documents as word ids; a word of two languages has two ids."""

    def __init__(self) -> None:
        self.ids = count(2)
        self.words: dict[str, _Words] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        words = self.words.get(lang)
        if words is None:
            words = self.words[lang] = _Words(self.ids)
        split = text.translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
        split.append(b"\n")
        ids = np.fromiter(map(words.__getitem__, split), np.int64, len(split))
        self.parts.append(ids[ids != NOTHING])
        self.size += len(self.parts[-1])

    def close(self) -> None:
        """The sequence with one break between pieces, and its vocabulary by id."""
        ids = np.concatenate([[BREAK], *self.parts])
        self.seq = ids[np.append(True, (ids[1:] != BREAK) | (ids[:-1] != BREAK))]
        n = next(self.ids)
        self.lang, self.word = [""] * n, [b""] * n
        for lang, words in self.words.items():
            for w, i in words.items():
                self.lang[i], self.word[i] = lang, w

    def hashes(self) -> np.ndarray:
        """XXH64 of language, space and word, seed 42, as ``hashed`` has it."""
        h = [xxhash.xxh64_intdigest(g.encode() + b" " + w, 42) for g, w in zip(self.lang, self.word, strict=True)]
        return np.array(h, dtype=np.uint64)


def suffixes(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``ids`` by the first ``most`` ids, and the LCP of each suffix with the one before, ``most`` at most.

    Prefix doubling: ranks by the first k ids give ranks by the first 2k. Ids are at least 0.
    """
    n = len(ids)
    rank, k = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < most:
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        k *= 2
    padded = np.append(ids, np.arange(-1, -1 - most, -1))
    lcp, same = np.zeros(n, dtype=np.int64), np.ones(max(n - 1, 0), dtype=bool)
    for k in range(most):
        at = padded[np.minimum(order + k, n + most - 1)]
        same &= at[1:] == at[:-1]
        lcp[1:] += same
    return order, lcp


def intervals(seq: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, place of one occurrence, occurrences) of the distinct phrases of ``least`` to ``most`` ids in ``seq``.

    Negative ids are breaks that no phrase spans.
    """
    ids = seq.copy()
    breaks = seq < 0
    ids[breaks] = seq.max(initial=0) + 1 + np.arange(int(breaks.sum()))
    order, lcp = suffixes(ids, most)
    # ids without a break from each place on
    stop = np.flatnonzero(np.append(breaks, True))
    room = (stop[np.searchsorted(stop, np.arange(len(seq)))] - np.arange(len(seq)))[order]
    for n in range(least, most + 1):
        first = np.flatnonzero(lcp < n)
        times = np.diff(np.append(first, len(seq)))
        whole = room[first] >= n
        yield n, order[first[whole]], times[whole]


def frequent_words(shard: Shard, words: np.ndarray) -> np.ndarray:
    """The shard's sequence with -1 for breaks and for words that the bitmap doesn't have."""
    known = _has(words, shard.hashes())
    known[:2] = False
    return np.where(known[shard.seq], shard.seq, -1)


def frequent_pairs(shard: Shard, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Runs of at least two words whose neighbours all are frequent pairs, -1 between runs."""
    seq = frequent_words(shard, words)
    h = shard.hashes()[np.maximum(seq, 0)]
    linked = (seq[:-1] >= 0) & (seq[1:] >= 0)
    linked[linked] = _has(pairs, _pair(h[:-1][linked], h[1:][linked]))
    goes_on = np.append(linked, False)
    at = np.flatnonzero(goes_on | np.append(False, linked))
    out = np.full(2 * len(at), -1, dtype=np.int64)
    out[::2] = seq[at]
    keep = np.ones(len(out), dtype=bool)
    keep[1::2] = ~goes_on[at]
    return out[keep]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return ((a << one) | (a >> np.uint64(63))) ^ b


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = (h >> np.uint64(64 - BITMAP)).astype(np.int64)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard.add(lang, (text or b"").decode("utf-8", "replace").encode())
            if shard.size >= most:
                shard.close()
                yield shard
                shard = Shard()
    if shard.size:
        shard.close()
        yield shard


def counting(phrases: Callable[[Shard], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]], most: int):
    """Task that emits (lang, phrase, f) of each shard; ``phrases`` gives (n, sequence, places, occurrences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, most):
            for n, seq, places, times in phrases(shard):
                for lo in range(0, len(places), 100_000):
                    at = places[lo : lo + 100_000]
                    words = [list(map(shard.word.__getitem__, seq[at + k].tolist())) for k in range(n)]
                    text = words[0] if n == 1 else list(map(b" ".join, zip(*words, strict=True)))
                    langs = list(map(shard.lang.__getitem__, seq[at].tolist()))
                    found = [pa.array(langs, pa.string()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(times[lo : lo + 100_000], pa.int64())]
                    yield pa.RecordBatch.from_arrays(found, ["lang", "phrase", "f"])

    return run


def counting_pairs(words, most: int):
    """Task that emits (h, f) of each shard's pairs of frequent words, h being the pair's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, most):
            seq, h = frequent_words(shard, words.value), shard.hashes()
            for _, places, times in intervals(seq, 2, 2):
                pair = _pair(h[seq[places]], h[seq[places + 1]]).view(np.int64)
                for lo in range(0, len(pair), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pair[lo : lo + 100_000]), pa.array(times[lo : lo + 100_000], pa.int64())], ["h", "f"])

    return run


def _singles(shard: Shard) -> Iterator[tuple]:
    times = np.bincount(shard.seq, minlength=len(shard.word))
    times[BREAK] = 0
    ids = np.flatnonzero(times)
    yield 1, np.arange(len(shard.word)), ids, times[ids]


def hashed(lang: Column, word: Column) -> Column:
    return F.xxhash64(F.concat(lang, F.lit(" "), word))


def bitmap(h: DataFrame) -> np.ndarray:
    """Bits of the hashes ``h``; at most ``2**BITMAP`` bits reach the driver."""
    bit = F.shiftrightunsigned("h", 64 - BITMAP) + 1
    parts = h.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << (BITMAP - 3), np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        out[(r["at"] - 1) * len(part) : r["at"] * len(part)] = part
    return out


def frequent(docs: DataFrame, scratch: Scratch, least: int, most: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``most`` words with at least ``least`` occurrences (lang, phrase, words, f), and words in all (lang, n)."""
    spark = docs.sparkSession
    sized(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)), F.col("text").cast("string").cast("binary"))

    def counted(phrases: Callable) -> DataFrame:
        shards = rows.mapInArrow(counting(phrases, shard_words), "lang string, phrase string, f long")
        return shards.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))

    every = scratch.write(counted(_singles))
    n = every.groupBy("lang").agg(F.sum("f").alias("n"))
    single = every.where(F.col("f") >= least).withColumn("words", F.lit(1))
    words = spark.sparkContext.broadcast(bitmap(single.select(hashed(F.col("lang"), F.col("phrase")).alias("h"))))
    pair = rows.mapInArrow(counting_pairs(words, shard_words), "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))
    pairs = spark.sparkContext.broadcast(bitmap(pair.where(F.col("f") >= least).select("h")))

    def several(shard: Shard) -> Iterator[tuple]:
        seq = frequent_pairs(shard, words.value, pairs.value)
        yield from ((k, seq, at, times) for k, at, times in intervals(seq, 2, most))

    longer = counted(several).where(F.col("f") >= least).withColumn("words", F.size(F.split("phrase", " ")))
    return single.unionByName(scratch.write(longer)), n


def scored(phrases: DataFrame, n: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, a, l, r, n, score) by their lowest-scoring cut, ties to the shortest first part.

    ``score = floor(1000 * a * n / (l * r))`` in decimals of 38 digits.
    """
    token = F.split("phrase", " ")
    cuts = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), token.alias("t"))
    part = lambda a, n: F.concat_ws(" ", F.slice("t", a, n))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    known = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(n, "lang")
    a, n, l, r = ("cast(%s as decimal(38,0))" % c for c in ("a", "n", "l", "r"))  # noqa: E741
    score = F.expr(f"(cast(1000 as decimal(38,0)) * {a} * {n}) div ({l} * {r})")
    best = known.select("lang", "phrase", "words", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "words", "a", "n").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def outside(candidates: DataFrame, share: int = 100) -> DataFrame:
    """Candidates without those that lie in a longer one at least ``share`` hundredths as frequent, itself dropped or not."""
    token = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda w: F.transform(F.sequence(F.lit(1), F.col("words") - w + 1), lambda i: F.concat_ws(" ", F.slice(token, i, w)))))
    inner = candidates.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return candidates.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")


def mine(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP, share: int = 100, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs(lang, text)``: a null text is empty, a null language is ``und``. Words are runs without space and tab within
    pieces between ``[.,;:!?]`` and line ends, A-Z lower-cased; bytes that aren't UTF-8 count as U+FFFD. Repeated
    rows count each; other columns are ignored; an empty table gives none. ``top`` bounds the report, nothing before it.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    phrases, n = frequent(docs, scratch, least, most, shard_words)
    candidates = scratch.write(scored(phrases, n))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = outside(candidates, share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
