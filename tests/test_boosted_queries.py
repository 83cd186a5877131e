"""Queries of boosted trees speak of both populations."""

from stopwise.plans import catalogue

SF = "/root/testdata/sf0.001"
catalogue.load_all()


def test_early_stopping_of_both_populations(spark):
    rows = catalogue.QUERIES["early_stopping"](spark, SF).collect()
    assert sorted(r.is_depot_segment for r in rows) == [0, 1]
    assert all(1 <= r.trees <= 20 for r in rows)


def test_trees_of_both_populations_are_explained(spark):
    rows = catalogue.QUERIES["tree_importance"](spark, SF).collect()
    assert {r.is_depot_segment for r in rows} == {0, 1}
