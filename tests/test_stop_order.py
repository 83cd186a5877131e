"""Stop orders of long routes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators import planning

LINES = {0: (60.0, 10.0), 1: (30.0, 100.0)}


def whole_route(start, between):
    """Nearest next stop, then reversals of runs, over the whole route at once."""
    n = len(start)
    order, free, cost = [], np.ones(n, bool), start
    for _ in range(n):
        order.append(int(np.argmin(np.where(free, cost, np.inf))))
        free[order[-1]], cost = False, between[order[-1]]
    better = True
    while better:
        better = False
        for i in range(n - 1):
            into = start if i == 0 else between[order[i - 1]]
            for j in range(i + 1, n):
                gain = into[order[i]] - into[order[j]]
                if j + 1 < n:
                    gain += between[order[j], order[j + 1]] - between[order[i], order[j + 1]]
                if gain > 1e-9:
                    order[i : j + 1] = order[i : j + 1][::-1]
                    better = True
    return order


def planned(spark, routes):
    rows = [(r, i, f"S{i}", *p) for r, points in routes.items() for i, p in enumerate(points, 1)]
    df = spark.createDataFrame(rows, "route_id string, position int, stop_id string, lat double, lng double")
    loads = [F.lit(1.0).alias(c) for c in schemas.LOAD_COLUMNS]
    return df.select(
        "*", *loads, F.lit("Z").alias("to_zone_id"), F.array().cast("array<string>").alias("estimated_fields"), F.lit("D").alias("station_code"),
        F.lit(9).alias("departure_hour"), F.lit(0).alias("weekday"), F.lit(1).alias("route_total_stops"), F.lit(1).alias("route_package_count"),
        F.lit(40.1).alias("depot_lat"), F.lit(-73.1).alias("depot_lng"),
    )


def test_long_routes_are_near_a_whole_search(spark):
    rng = np.random.default_rng(5)
    routes = {f"R{n}": np.stack([40 + rng.random(n) * 0.2, -73 + rng.random(n) * 0.2], 1).tolist() for n in (1, 2, 30, 300, 600)}
    lines = spark.createDataFrame([(k, *v) for k, v in LINES.items()], "is_depot_segment int, slope double, intercept double")
    got = planning.propose_stop_order(planned(spark, routes).repartition(5), lines).collect()
    for route, points in routes.items():
        lat, lng = np.array(points).T
        between = LINES[0][0] * planning._km(lat[:, None], lng[:, None], lat, lng) + LINES[0][1]
        start = LINES[1][0] * planning._km(40.1, -73.1, lat, lng) + LINES[1][1]

        def total(order):
            return start[order[0]] + sum(between[a, b] for a, b in zip(order, order[1:]))

        rows = sorted((r.proposed_position, r.position) for r in got if r.route_id == route)
        assert [r[0] for r in rows] == list(range(1, len(points) + 1))
        order = [r[1] - 1 for r in rows]
        assert sorted(order) == list(range(len(points)))
        assert total(order) <= 1.02 * total(whole_route(start, between))


def test_stops_without_coordinates_come_last(spark):
    routes = {"A": [(40.0, -73.0), (None, None), (40.2, -73.0), (None, -73.0), (40.1, -73.0)], "B": [(None, None)] * 3}
    lines = spark.createDataFrame([], "is_depot_segment int, slope double, intercept double")
    got = planning.propose_stop_order(planned(spark, routes), lines, window=4).collect()
    order = {r: [x.position for x in sorted((x for x in got if x.route_id == r), key=lambda x: x.proposed_position)] for r in "AB"}
    assert sorted(order["A"][:3]) == [1, 3, 5] and order["A"][3:] == [2, 4] and order["B"] == [1, 2, 3]
    assert planning.propose_stop_order(planned(spark, routes).limit(0), lines).count() == 0


@pytest.mark.parametrize("n", [2, 6, 7])
def test_window_search_is_near_the_best(n):
    import itertools

    rng = np.random.default_rng(n)
    for _ in range(20):
        p = rng.random((n + 2, 2))
        d = np.linalg.norm(p[:, None] - p[None], axis=2)
        order = planning.improve_order(d[n, :n], d[:n, :n], d[:n, n + 1])
        assert sorted(order) == list(range(n))

        def total(o):
            path = [n, *o, n + 1]
            return sum(d[a, b] for a, b in zip(path, path[1:]))

        assert total(order) <= 1.15 * min(total(o) for o in itertools.permutations(range(n)))
