"""Routes of a few stops are ordered side by side and once."""

import numpy as np
import pytest
from test_stop_order import LINES, planned

from stopwise.operators import planning


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_side_by_side_as_one_by_one(n):
    rng = np.random.default_rng(n)
    start, between = rng.random((200, n)), rng.random((200, n, n))
    between += between.transpose(0, 2, 1)
    start[::7], between[::7] = 1.0, 1.0  # ties leave the given order
    got = planning.best_orders(start, between)
    for k in range(200):
        assert got[k].tolist() == planning.improve_order(start[k], between[k]).tolist()


def test_few_stops_take_one_round(spark, monkeypatch):
    rounds = []

    def counted(df, name):
        rounds.append(name)
        return staged(df, name)

    staged = planning.staged
    monkeypatch.setattr(planning, "staged", counted)
    rng = np.random.default_rng(3)
    routes = {f"R{i}": (40 + rng.random((n, 2)) * [0.2, 0.2] - [0, 113]).tolist() for i, n in enumerate((1, 2, 3, 4, 5, 6, 6))}
    lines = spark.createDataFrame([(k, *v) for k, v in LINES.items()], "is_depot_segment int, slope double, intercept double")
    got = planning.propose_stop_order(planned(spark, routes), lines).collect()
    assert rounds.count("stop-order") == 2  # the first order and one round
    for route, points in routes.items():
        lat, lng = np.array(points).T
        between = LINES[0][0] * planning._km(lat[:, None], lng[:, None], lat, lng) + LINES[0][1]
        start = LINES[1][0] * planning._km(40.1, -73.1, lat, lng) + LINES[1][1]
        order = [r.position - 1 for r in sorted((r for r in got if r.route_id == route), key=lambda r: r.proposed_position)]
        best = planning.improve_order(start, between)

        def total(o):
            return start[o[0]] + sum(between[a, b] for a, b in zip(o, o[1:]))

        assert sorted(order) == list(range(len(points))) and abs(total(order) - total(best)) < 1e-6
