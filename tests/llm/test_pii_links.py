"""One value, however it is spelled, has one pseudonym."""

from __future__ import annotations

import datetime
import re

import pytest

from mapquarry.llm import pii

PHONES = ["(212) 555-0100", "212-555-0100", "212.555.0100", "+1 212-555-0100", "+1 (212) 555-0100", "+12125550100", "+1 2125550100", "+1-212-555-0100", "+1 212 555 0100"]
CARDS = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"]
IBANS = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"]
DATES = ["2020-01-02", "1/2/2020", "01/02/2020", "01-02-2020", "2020/1/2"]


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


@pytest.fixture(scope="module")
def made(spark):
    values = PHONES + CARDS + IBANS + DATES
    rows = [(k, f"see {v} now") for k, v in enumerate(values)]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r["n_replaced"] == 1 for r in got.values()), {values[k]: r["text"] for k, r in got.items() if r["n_replaced"] != 1}
    return {v: got[k]["text"][4:-4] for k, v in enumerate(values)}


def test_numbers(made):
    assert len({digits(made[v])[-10:] for v in PHONES}) == 1 and digits(made[PHONES[0]]) != "2125550100"
    for group in (CARDS, IBANS):
        assert len({re.sub("[ -]", "", made[v]) for v in group}) == 1
    for v in PHONES + CARDS + IBANS:
        assert re.sub("[0-9]", "0", made[v]) == re.sub("[0-9]", "0", v)


def test_dates(made):
    def day(text: str) -> datetime.date:
        a, b, c = map(int, re.split("[-/]", text))
        return datetime.date(a, b, c) if a > 31 else datetime.date(c, a, b)

    assert len({day(made[v]) for v in DATES}) == 1
