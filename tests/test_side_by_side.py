"""Orders found side by side are those found one by one."""

import numpy as np
import pytest

from stopwise.operators import planning


@pytest.mark.parametrize("n", [1, 3, 6, 7, 8, 12, 32])
@pytest.mark.parametrize("ties", [False, True])
def test_routes_of_one_size(n, ties):
    rng = np.random.default_rng(n)
    p = rng.integers(0, 4, (60, n + 1, 2)).astype(float) if ties else rng.random((60, n + 1, 2))
    d = np.linalg.norm(p[:, :, None] - p[:, None], axis=3)
    start, between = 2 * d[:, n, :n], np.maximum(0.0, d[:, :n, :n] - 0.1)
    got = planning.improve_orders(start, between)
    assert got.shape == (60, n)
    for i in range(60):
        assert got[i].tolist() == planning.improve_order(start[i], between[i]).tolist()


def test_routes_of_seven_stops_are_not_ordered_one_by_one(spark, monkeypatch):
    from test_stop_order import LINES, planned

    rng = np.random.default_rng(1)
    routes = {f"R{i}": (np.array([40, -73]) + rng.random((7, 2)) / 5).tolist() for i in range(40)}
    lines = spark.createDataFrame([(k, *v) for k, v in LINES.items()], "is_depot_segment int, slope double, intercept double")
    df = planned(spark, routes)
    both = []
    for most in (0, planning.SIDE_BY_SIDE):
        monkeypatch.setattr(planning, "SIDE_BY_SIDE", most)
        rows = planning.propose_stop_order(df, lines).select("route_id", "position", "proposed_position").collect()
        both.append(sorted(map(tuple, rows)))
    assert both[0] == both[1] and len(both[0]) == 280
