"""Ids of packing against the tokenizer's for every character before a mark, and its rows with null ids and repeats."""

from __future__ import annotations

import unicodedata

import public_tokenizers
import pytest

from mapquarry.llm import packing
from mapquarry.llm.queries import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def words():
    return packing.Words(PATH)


@pytest.mark.parametrize("form", ["{}{}", "a{}{}", "{}a{}"])
def test_every_character_before_a_mark(words, form):
    chars = [chr(c) for c in range(0x21, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LMNPS"]
    texts = [form.format(c, ".,;:!?%*&$#|"[ord(c) % 12]) for c in chars]
    want = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, g, w in zip(texts, words.ids(texts), want, strict=True) if g.tolist() != w.ids] == []


def test_letters_that_change_with_every_mark(words):
    texts = [f"x {c}{m} y" for c in "İñक़ਖ਼য়ǅﬁΣ" for m in ".,;:!?%*&$#|"]
    want = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in words.ids(texts)] == [w.ids for w in want]


def test_null_ids_and_repeated_rows_are_packed_each(spark):
    rows = [(None, "one two."), (None, "three"), (5, "same row"), (5, "same row"), (6, None), (7, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    total = {}
    for r in got:
        total[str(r["doc_id"])] = total.get(str(r["doc_id"]), 0) + r["length"]
    want = {}
    for d, t in rows:
        want[str(d)] = want.get(str(d), 0) + len(packing.Words(PATH).ids([t or ""])[0]) + 1
    assert total == want and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert sum(r["start"] == 0 for r in got) == len(rows)
