"""Queries that need the measurement view several times make it once; rows without an activity are counted."""

import pytest

from measureaudit import catalog
from measureaudit.plans import network


@pytest.mark.parametrize("name", ["retrieval_coverage", "retrieval_answers", "oof_encoding", "suffix_match"])
def test_the_answer_is_made_from_written_rows(spark, sf_dir, name):
    assert not [f for f in catalog.QUERIES[name](spark, sf_dir).inputFiles() if "lineitem" in f]


def test_rows_without_an_activity_are_rows_without_a_neighbour(spark):
    rows = [("m", act, "s", 4.0, 25.0, p, v) for act in ("a", None) for p, v in (("p1", 1.0), ("p1", 2.0), ("p2", 8.0), ("p3", 4.0))]
    got = {x.act: x for x in network.coverage(spark.createDataFrame(rows, "mat string, act string, sub string, ph double, t double, paper string, km_mm double")).collect()}
    assert (got["a"].n_rows, got["a"].n_hit, got["a"].fold_median) == (4, 4, 3.0) and (got[None].n_rows, got[None].n_hit, got[None].share) == (4, 0, 0.0)
