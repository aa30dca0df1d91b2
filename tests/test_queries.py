"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import same

from vantage.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), sf_dir, catalog.ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "column"), [("observer_marks", "bearing_e3"), ("viewgraph_observers", "distance_mm"), ("null_sights", "v"), ("reach_ladder", "bottom"), ("permutation_null", "v"), ("wide_sights", "visible"), ("wide_hits", "hit_mm"), ("door_envelopes", "seen"), ("wall_thickness", "thickness_mm"), ("drawn_curves", "length_mm"), ("plan_thickness", "thickness_mm"), ("stored_tiles", "total"), ("variant_shares", "n_seen")])
def test_results_say_something(spark, name, column):
    """Queries whose scene could leave nothing to tell: rows, and several values of the main column."""
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().count() > 1
