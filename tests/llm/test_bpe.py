"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from mapquarry.llm import bpe, queries

PATH = public_tokenizers.path(queries.RANKS)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    ranks = {t: i for i, t in enumerate(encoder.tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(coded: list[bytes]) -> list[list[int]]:
    return [np.frombuffer(x, "<u4").tolist() for x in coded]


def strange(seed: int, tokens: list[bytes]) -> list[str]:
    rnd = random.Random(seed)
    letters = [chr(c) for c in [*range(0x250), *range(0x900, 0x980), *range(0x3040, 0x3100), *range(0x4E00, 0x4E80), 0x558, 0x11DE1, 0x1F600, 0x3000]]
    out = ["", "a" * 300, "aaaa" * 50 + "b" * 77, " \n\n  x  ", "don't we'll I'm 'S", "ha" * 999, "<|endoftext|>"]
    out += ["".join(rnd.choices(letters[:128] if rnd.random() < 0.4 else letters, k=rnd.randint(0, 60))) for _ in range(1500)]
    out += ["".join(rnd.choices(rnd.sample("abcdehnt i", 3), k=rnd.randint(0, 80))) for _ in range(1000)]
    return out + [b"".join(rnd.choices(tokens, k=20)).decode("utf-8", "replace") for _ in range(500)]


def test_equals_the_library(encoder, library):
    texts = strange(1, encoder.tokens)
    coded = encoder.encode(texts)
    assert ids(coded) == [library.encode_ordinary(t) for t in texts]
    assert [encoder.decode(x) for x in coded] == [t.encode() for t in texts]


def test_every_character(encoder, library):
    texts = ["".join(f"a{chr(c)}b1{chr(c)} {chr(c)}" for c in range(lo, lo + 256)) for lo in range(0, 0x110000, 256) if not 0xD800 <= lo < 0xE000]
    assert ids(encoder.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_ranks_that_fall_on_the_way():
    """A merge may open a pair of lower rank, which then comes first even if the word has more places of the greater one."""
    rnd = random.Random(4)
    for _ in range(60):
        known = {b"a", b"b", b"c"}
        while len(known) < 25:
            known.add(rnd.choice(sorted(known)) + rnd.choice(sorted(known)))
        longer = sorted(x for x in known if len(x) > 1)
        rnd.shuffle(longer)
        single = [bytes([i]) for i in range(256)]
        tokens = single + longer
        library = tiktoken.Encoding("own", pat_str="(?s:.+)", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        words = ["".join(rnd.choices("abc", k=rnd.randint(1, 40))) for _ in range(50)]
        replay = bpe.Replay(tokens)
        assert ids(replay.encode([w.encode() for w in words])) == [library.encode_ordinary(w) for w in words]
        assert [replay.one(w.encode()) for w in words if w.encode() not in replay.rank] == [library.encode_ordinary(w) for w in words if w.encode() not in replay.rank]


def test_missing_bytes_are_refused():
    with pytest.raises(ValueError):
        bpe.Replay([b"a", b"b"])


def test_small_cache_and_blocks(spark, library, monkeypatch):
    texts = [*strange(2, library.token_byte_values())[:400], None]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    small = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    assert [ids(small.encode([t]))[0] for t in texts[:50]] == [library.encode_ordinary(t) for t in texts[:50]]
    rows = [(None if k % 7 == 0 else k // 2, t, b"x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary").repartition(3)
    want = sorted((str(d), len(i), i, (t or "").encode()) for d, t, _ in rows for i in [library.encode_ordinary(t or "")])
    for chars in (1, 500, bpe.BLOCK_CHARS):
        got = bpe.encode(docs, PATH, public_tokenizers.PATTERN, chars).collect()
        assert sorted((str(r[0]), r[1], np.frombuffer(r[2], "<u4").tolist(), bytes(r[3])) for r in got) == want
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_on_the_whole_table(spark, sf, library):
    want = {}
    for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        i = library.encode_ordinary(t or "")
        want[d] = (len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = queries.op13_merge_replay(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
