from __future__ import annotations

import pytest

from mapquarry.plans import discover as D
from mapquarry.plans.catalog import Catalog


@pytest.fixture(scope="module")
def catalog(spark, sf):
    return Catalog(spark, sf)


def test_text_in_a_dimension_without_entities_is_refused(catalog):
    for dim in ("Keyword", "Source", "Space"):
        with pytest.raises(ValueError, match="no text search"):
            D.discover(catalog, D.Intent({dim: "x"}))


def test_unknown_text_drops_nothing_and_selected_entities_without_datasets_drop_all(spark, sf, catalog):
    box, span = D.FLAGSHIP.box, D.FLAGSHIP.span
    hard = D.discover(catalog, D.Intent(box=box, span=span)).collect()
    assert len(hard) >= 20 and D.discover(catalog, D.Intent({"Topic": "no such text"}, box, span)).collect() == hard

    class Lone(Catalog):
        """A topic that no dataset has."""

        @property
        def topic(self):
            return spark.createDataFrame([("lone", "lone topic")], "id string, name string")

    assert D.discover(Lone(spark, sf), D.Intent({"Topic": "lone topic"}, box, span)).count() == 0


def test_nothing_asked_gives_nothing(catalog):
    assert D.discover(catalog, D.Intent()).count() == 0 == D.discover(catalog, D.Intent({"Topic": "no such text"})).count()
