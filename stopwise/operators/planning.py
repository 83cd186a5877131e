"""Planned routes: filling in what a planner does not know, and proposing a stop order."""

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.functions.geo import EARTH_RADIUS_KM, haversine_km
from stopwise.functions.scalars import same_zone
from stopwise.operators.joins import by_route
from stopwise.operators.ordered import along, fits_one_block, numbered
from stopwise.operators.scoring import score_lines, with_arrival_seconds
from stopwise.workspace import staged

SAMPLED = [c for c in schemas.LOAD_COLUMNS if c != "packages_at_destination"]


def _pick(values: Column, seed: int, field: str) -> Column:
    """An element of an array chosen by a hash of seed, route, stop and field."""
    text = F.concat_ws(":", F.lit(str(seed)), "route_id", "stop_id", F.lit(field))
    number = F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")
    return F.when(F.size(values) > 0, F.get(values, number % F.size(values)))


REBUILT = [
    "from_stop_id", "from_lat", "from_lng", "is_depot_segment", "segment_distance_km", "same_zone",
    "cumulative_distance_km",
]


def legs_in_order(stops: DataFrame, order: str, extent: DataFrame | None = None) -> DataFrame:
    """Legs of a visiting order: origin, distance, zone change and km so far are rebuilt from the
    position; the first leg leaves the depot (``depot_lat``, ``depot_lng``)."""
    extent = stops if extent is None else extent
    linked = along(
        stops.drop(*REBUILT),
        ["route_id"],
        order,
        previous={"_stop": "stop_id", "_lat": "lat", "_lng": "lng", "from_zone_id": "to_zone_id"},
        extent=extent,
    )
    legs = linked.select(
        *[c for c in linked.columns if c not in ("_stop", "_lat", "_lng")],
        F.coalesce("_stop", F.lit("DEPOT")).alias("from_stop_id"),
        F.coalesce("_lat", "depot_lat").alias("from_lat"),
        F.coalesce("_lng", "depot_lng").alias("from_lng"),
        F.col("_stop").isNull().cast("int").alias("is_depot_segment"),
    )
    km = haversine_km(F.col("from_lat"), F.col("from_lng"), F.col("lat"), F.col("lng"))
    legs = legs.withColumns(
        {
            "segment_distance_km": F.round(km, 6),
            "same_zone": same_zone(F.col("from_zone_id"), F.col("to_zone_id")),
        }
    ).drop("from_zone_id")
    out = along(
        legs,
        ["route_id"],
        order,
        running={"cumulative_distance_km": ("segment_distance_km", "before")},
        extent=extent,
    )
    return out.withColumn("cumulative_distance_km", F.round("cumulative_distance_km", 6))


def complete_planned_routes(
    stops: DataFrame, profile: DataFrame, depots: DataFrame, seed: int
) -> DataFrame:
    """Segments of planned stops. A load or zone that is not given is drawn from the history of
    the station, and every drawn field is listed in ``estimated_fields``. Where the depot of the
    station is unknown, the route starts at its first stop."""
    history = profile.select(
        "station_code",
        *[F.col(c).alias(f"_{c}") for c in SAMPLED],
        F.col("zones_seen").alias("_zones"),
    )
    joined = stops.join(history, "station_code", "left").join(depots, "station_code", "left")
    defaults = {"packages_with_window_at_destination": F.lit(0.0)}
    no_depot = (F.col("position") == 1) & F.col("depot_lat").isNull()
    filled = joined.withColumns(
        {
            "estimated_fields": F.array_compact(
                F.array(
                    *[F.when(F.col(c).isNull(), F.lit(c)) for c in SAMPLED],
                    F.when(F.col("to_zone_id").isNull(), F.lit("to_zone_id")),
                    F.when(no_depot, F.lit("origin")),
                )
            ),
            **{
                c: F.coalesce(
                    F.col(c), _pick(F.col(f"_{c}"), seed, c), defaults.get(c, F.lit(None))
                )
                for c in SAMPLED
            },
            "to_zone_id": F.coalesce(
                "to_zone_id", _pick(F.col("_zones"), seed, "to_zone_id"), F.lit(schemas.NO_ZONE)
            ),
            "packages_at_destination": F.coalesce("packages_at_destination", F.lit(1)),
            "depot_lat": F.coalesce("depot_lat", F.when(F.col("position") == 1, F.col("lat"))),
            "depot_lng": F.coalesce("depot_lng", F.when(F.col("position") == 1, F.col("lng"))),
        }
    ).drop("_zones", *[f"_{c}" for c in SAMPLED])
    totals = filled.groupBy("route_id").agg(
        (F.count("*") + 1).alias("route_total_stops"),
        F.sum("packages_at_destination").alias("route_package_count"),
        F.max("depot_lat").alias("depot_lat"),
        F.max("depot_lng").alias("depot_lng"),
    )
    whole = filled.drop("depot_lat", "depot_lng").join(by_route(totals), "route_id")
    return legs_in_order(whole, "position", extent=stops)


def _km(lat1, lng1, lat2, lng2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * (
        np.sin(np.radians(lng2 - lng1) / 2) ** 2
    )
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def improve_order(start: np.ndarray, between: np.ndarray, leave: np.ndarray | None = None) -> np.ndarray:
    """The stops in an order that no reversal of a run and no move of up to three stops betters.

    ``start[j]`` is the cost of opening with stop j, ``leave[j]`` that of what follows it at the end;
    ``between`` is symmetric, so reversing a run changes only its two outer edges and every move is
    judged exactly. The search starts from the given order and from the nearest next stop; of a few
    stops, all orders are compared.
    """
    n = len(start)
    if n < 2:
        return np.arange(n)
    # stop n stands for what comes before, stop n + 1 for what comes after
    costs = np.zeros((n + 2, n + 2))
    costs[:n, :n] = between
    costs[n, :n] = costs[:n, n] = start
    costs[:n, n + 1] = costs[n + 1, :n] = 0.0 if leave is None else leave
    if n <= FEW:
        orders = _all_orders(n)
        total = costs[n, orders[:, 0]] + costs[orders[:, -1], n + 1] + costs[orders[:, :-1], orders[:, 1:]].sum(1)
        least = int(np.argmin(total))
        return orders[least if total[least] < total[0] - 1e-9 else 0].copy()
    best = None
    for order in (np.arange(n), _nearest_next(costs, n)):
        path = np.concatenate([[n], order, [n + 1]])
        while _reversals(path, costs) or _moves(path, costs):
            pass  # each lowers the cost, so this ends
        total = costs[path[:-1], path[1:]].sum()
        if best is None or total < best[0] - 1e-9:
            best = (total, path[1:-1].copy())
    return best[1]


FEW = 6
SIDE_BY_SIDE = 32  # stops up to which whole routes are ordered in one go


@functools.cache
def _all_orders(n: int) -> np.ndarray:
    """The given order first."""
    return np.array(list(itertools.permutations(range(n))))


def best_orders(start: np.ndarray, between: np.ndarray) -> np.ndarray:
    """``improve_order`` of several routes of the same few stops, none of which is followed by another:
    ``start`` is (routes, stops), ``between`` (routes, stops, stops)."""
    n = start.shape[1]
    if n < 2:
        return np.zeros((len(start), n), int)
    orders = _all_orders(n)
    legs = between[:, orders[:, :-1], orders[:, 1:]]
    total = start[:, orders[:, 0]] + 0.0 + legs.sum(2)
    least = total.argmin(1)
    gain = total[np.arange(len(total)), least] < total[:, 0] - 1e-9
    return orders[np.where(gain, least, 0)]


def improve_orders(start: np.ndarray, between: np.ndarray) -> np.ndarray:
    """``improve_order`` of several routes of the same number of stops, none of which is followed by another:
    every step is taken for all of them side by side, and those that are done stay as they are."""
    count, n = start.shape
    if n <= FEW:
        return best_orders(start, between)
    costs = np.zeros((count, n + 2, n + 2))
    costs[:, :n, :n] = between
    costs[:, n, :n] = costs[:, :n, n] = start
    rows = np.arange(count)[:, None]
    near, free, at = np.empty((count, n), int), np.ones((count, n), bool), np.full(count, n)
    for i in range(n):
        at = np.where(free, costs[rows[:, 0], at, :n], np.inf).argmin(1)
        near[:, i], free[rows[:, 0], at] = at, False
    best = total = None
    for order in (np.tile(np.arange(n), (count, 1)), near):
        paths = np.concatenate([np.full((count, 1), n), order, np.full((count, 1), n + 1)], axis=1)
        live = rows[:, 0]
        while len(live):
            found = _reversals_of(paths, costs, live)
            found[~found] = _moves_of(paths, costs, live[~found])
            live = live[found]
        sums = costs[rows, paths[:, :-1], paths[:, 1:]].sum(1)
        if best is None:
            best, total = paths, sums
        else:
            best = np.where((sums < total - 1e-9)[:, None], paths, best)
    return best[:, 1:-1]


def _reversals_of(paths: np.ndarray, costs: np.ndarray, live: np.ndarray) -> np.ndarray:
    """``_reversals`` of the paths numbered in ``live``."""
    found, turn = np.zeros(len(live), bool), np.arange(len(live))
    places = np.arange(paths.shape[1])
    while len(turn):
        p, c, r = paths[live[turn]], costs[live[turn]], np.arange(len(turn))[:, None]
        better = np.zeros(len(turn), bool)
        for i in range(1, p.shape[1] - 2):
            before, first = p[:, i - 1 : i], p[:, i : i + 1]
            ends, onward = p[:, i + 1 : -1], p[:, i + 2 :]
            gain = c[r, before, first] + c[r, ends, onward] - c[r, before, ends] - c[r, first, onward]
            k = gain.argmax(1)
            at = np.flatnonzero(gain[r[:, 0], k] > 1e-9)
            if len(at):
                last = (i + 1 + k[at])[:, None]
                p[at] = np.take_along_axis(p[at], np.where((places >= i) & (places <= last), i + last - places, places), 1)
                better[at] = True
        paths[live[turn]] = p
        found[turn] |= better
        turn = turn[better]
    return found


def _moves_of(paths: np.ndarray, costs: np.ndarray, live: np.ndarray) -> np.ndarray:
    """``_moves`` of the paths numbered in ``live``."""
    found = np.zeros(len(live), bool)
    p, c, r = paths[live], costs[live], np.arange(len(live))[:, None]
    places = np.arange(p.shape[1])
    for length in (1, 2, 3):
        for i in range(1, p.shape[1] - length):
            before, first, last, after = (p[:, j : j + 1] for j in (i - 1, i, i + length - 1, i + length))
            rest = np.delete(p, np.s_[i : i + length], axis=1)
            out = c[r, before, first] + c[r, last, after] - c[r, before, after]
            a, b = rest[:, :-1], rest[:, 1:]
            ahead = c[r, a, first] + c[r, last, b]
            back = c[r, a, last] + c[r, first, b]
            into = np.minimum(ahead, back) - c[r, a, b]
            k = into.argmin(1)
            at = np.flatnonzero(out[:, 0] - into[r[:, 0], k] > 1e-9)
            if len(at):
                into_at = k[at][:, None]
                run = p[at, i : i + length]
                run = np.where((ahead[at, k[at]] <= back[at, k[at]])[:, None], run, run[:, ::-1])
                parted = np.concatenate([rest[at], run], axis=1)
                of_rest = np.where(places <= into_at, places, places - length)
                of_run = rest.shape[1] + places - into_at - 1
                inside = (places > into_at) & (places <= into_at + length)
                p[at] = np.take_along_axis(parted, np.where(inside, of_run, of_rest), 1)
                found[at] = True
    paths[live] = p
    return found


def _nearest_next(costs: np.ndarray, n: int) -> np.ndarray:
    order = np.empty(n, dtype=int)
    free = np.ones(n, dtype=bool)
    at = n
    for i in range(n):
        at = int(np.argmin(np.where(free, costs[at, :n], np.inf)))
        order[i], free[at] = at, False
    return order


def _reversals(path: np.ndarray, costs: np.ndarray) -> bool:
    """Reverses runs of the path, in place, until none helps; whether any did."""
    found, better = False, True
    while better:
        better = False
        for i in range(1, len(path) - 2):
            before, first = path[i - 1], path[i]
            ends, onward = path[i + 1 : -1], path[i + 2 :]
            gain = costs[before, first] + costs[ends, onward] - costs[before, ends] - costs[first, onward]
            k = int(np.argmax(gain))
            if gain[k] > 1e-9:
                j = i + 1 + k
                path[i : j + 1] = path[i : j + 1][::-1].copy()
                found = better = True
    return found


def _moves(path: np.ndarray, costs: np.ndarray) -> bool:
    """Moves runs of one to three stops to where they cost least, either way round; whether any did."""
    found = False
    for length in (1, 2, 3):
        i = 1
        while i + length < len(path):
            first, last = path[i], path[i + length - 1]
            rest = np.concatenate([path[:i], path[i + length :]])
            out = costs[path[i - 1], first] + costs[last, path[i + length]] - costs[path[i - 1], path[i + length]]
            a, b = rest[:-1], rest[1:]
            ahead = costs[a, first] + costs[last, b]
            back = costs[a, last] + costs[first, b]
            into = np.minimum(ahead, back) - costs[a, b]
            k = int(np.argmin(into))
            if out - into[k] > 1e-9:
                run = path[i : i + length] if ahead[k] <= back[k] else path[i : i + length][::-1]
                path[:] = np.concatenate([rest[: k + 1], run, rest[k + 1 :]])
                found = True
            i += 1
    return found


def curve_place(lat: np.ndarray, lng: np.ndarray, bits: int = 26) -> np.ndarray:
    """Place of a point along a Hilbert curve over the globe; its cells are about half a metre wide."""
    cells = float(1 << bits) / 360.0
    x = np.clip((lng + 180.0) * cells, 0, (1 << bits) - 1).astype(np.int64)
    y = np.clip((lat + 90.0) * cells, 0, (1 << bits) - 1).astype(np.int64)
    place = np.zeros(len(x), np.int64)
    for k in range(bits - 1, -1, -1):
        side = np.int64(1) << k
        rx, ry = (x & side) > 0, (y & side) > 0
        place += side * side * ((3 * rx) ^ ry)
        x, y = x & (side - 1), y & (side - 1)
        flip = ~ry & rx
        x, y = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
        x, y = np.where(ry, x, y), np.where(ry, y, x)
    return place


WINDOW = 256  # stops that are ordered together


def propose_stop_order(planned: DataFrame, lines: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stops of every route in a proposed order (``proposed_position``), whatever the route's length.

    The order starts along a space-filling curve. Rounds then cut the current order into windows of
    ``window`` stops, shifted by half a window from round to round, and order each between the stops
    that stand before and after it, which stay. A round only looks at windows in which one of the
    last two rounds changed something; when none is left, the order stands. Every round is one
    shuffle by route and window, and its result is written, so that no task holds more than a window.
    The first leg costs what the depot's line says, all others what the deliveries' line says. Stops
    without coordinates come last, in their given order.
    """
    coef = {r["is_depot_segment"]: (r["slope"], r["intercept"]) for r in lines.collect()}
    delivery = coef.get(0, (1.0, 0.0))
    depot = coef.get(1, delivery)

    def cost(km, line):
        return np.maximum(0.0, line[0] * km + line[1])

    @F.pandas_udf("long")
    def place_of(lat: pd.Series, lng: pd.Series) -> pd.Series:
        return pd.Series(curve_place(lat.to_numpy(float), lng.to_numpy(float)))

    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    points = planned.select(
        "route_id", "position", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("lat", "lng")],
        *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("depot_lat", "depot_lng")], located.alias("located"),
    )
    place = F.when(F.col("located"), place_of("lat", "lng")).otherwise(F.lit(1 << 62))
    points = staged(
        points.withColumn("place", place).withColumn("cell", F.shiftright("place", 20)).withColumn("inner", F.shiftright("place", 8)),
        "stops-on-curve",
    )
    levels = ["cell", "inner", "place", "position"]
    if fits_one_block(points, "position"):
        # no route is long: one window orders each
        now = numbered(points.withColumn("_o", F.struct(*levels)), ["route_id"], ["_o"], "rank")
    else:
        now = numbered(points, ["route_id"], levels, "rank")
    now = now.withColumn("rank", F.col("rank") - 1)
    now = now.select("route_id", "position", "lat", "lng", "depot_lat", "depot_lng", "located", "rank", F.lit(0).alias("changed"))
    now = staged(now, "stop-order")

    def whole_routes(lat, lng, role, located, age, first, second) -> dict[int, np.ndarray]:
        """Orders of the rows that are a route of located stops, found side by side."""
        sizes = lat.map(len).to_numpy()
        found = {}
        for n in np.unique(sizes[sizes <= min(SIDE_BY_SIDE, window)]).tolist():
            at = np.flatnonzero(sizes == n)
            plain = (np.stack(role.iloc[at].to_list()) == 0).all(1) & np.stack(located.iloc[at].to_list()).all(1)
            at = at[plain & (np.stack(age.iloc[at].to_list()).min(1) <= 1)]
            for rows in np.array_split(at, -(-len(at) // max(1, (1 << 15) // (n * n)))) if len(at) else ():
                x, y = (np.stack(c.iloc[rows].to_list()).astype(float) for c in (lat, lng))
                origin = (c.iloc[rows].to_numpy(float)[:, None] for c in (first, second))
                start = cost(_km(*origin, x, y), depot)
                between = cost(_km(x[:, :, None], y[:, :, None], x[:, None, :], y[:, None, :]), delivery)
                found.update(zip(rows.tolist(), improve_orders(start, between).astype(np.int32)))
        return found

    @F.pandas_udf("array<int>")
    def search(lat: pd.Series, lng: pd.Series, role: pd.Series, located: pd.Series, age: pd.Series, *depot_at: pd.Series) -> pd.Series:
        found = []
        whole = whole_routes(lat, lng, role, located, age, *depot_at)
        for i, row in enumerate(zip(lat, lng, role, located, age, *depot_at)):
            if i in whole:
                found.append(whole[i])
                continue
            la, ln, r, here, old = (np.asarray(x) for x in row[:5])
            mine = np.flatnonzero((r == 0) & here)
            others = np.flatnonzero((r == 0) & ~here)
            if len(mine) and old.min() <= 1:
                x, y = la[mine].astype(float), ln[mine].astype(float)
                entry, exit_ = np.flatnonzero(r == -1), np.flatnonzero((r == 1) & here)
                if len(entry):
                    start = cost(_km(la[entry[0]], ln[entry[0]], x, y), delivery)
                else:
                    start = cost(_km(row[5], row[6], x, y), depot)
                between = cost(_km(x[:, None], y[:, None], x, y), delivery)
                leave = cost(_km(la[exit_[0]], ln[exit_[0]], x, y), delivery) if len(exit_) else None
                mine = mine[improve_order(start, between, leave)]
            found.append(np.concatenate([mine, others]).astype(np.int32))
        return pd.Series(found)

    settled = None
    for offset in itertools.cycle((0, window // 2)):
        at = F.col("rank") + offset
        first, last = at % window == 0, at % window == window - 1
        block = F.floor(at / window).cast("int")
        seats = F.array_compact(
            F.array(
                F.struct(block.alias("block"), F.lit(0).alias("role")),
                F.when(last, F.struct((block + 1).alias("block"), F.lit(-1).alias("role"))),
                F.when(first & (F.col("rank") > 0), F.struct((block - 1).alias("block"), F.lit(1).alias("role"))),
            )
        )
        # rounds since this stop's window last changed
        rows = now.withColumn("age", F.col("changed") + 1).withColumn("seat", F.explode(seats)).select("*", "seat.*")
        stop = F.struct("rank", "position", "lat", "lng", "located", "age", "role")
        packed = rows.groupBy("route_id", "block").agg(
            F.sort_array(F.collect_list(stop)).alias("s"), F.max("depot_lat").alias("depot_lat"), F.max("depot_lng").alias("depot_lng"),
            F.min(F.when(F.col("role") == 0, F.col("rank"))).alias("low"),
        ).where("low IS NOT NULL")
        order = search(*[F.col(f"s.{c}") for c in ("lat", "lng", "role", "located", "age")], "depot_lat", "depot_lng")
        packed = packed.withColumn("order", order)
        # a route of a few stops has the best of all its orders: later rounds cannot better it
        alone = (F.size("s") == F.size("order")) & (F.size("s") <= min(FEW, window // 2)) & (F.col("low") == 0)
        moved = packed.withColumn("stays", F.col("order") == F.array_sort("order")).withColumn("alone", alone)
        placed = moved.select("*", F.posexplode("order").alias("pos", "i")).withColumn("x", F.get("s", F.col("i")))
        now = staged(
            placed.select(
                "route_id", "x.position", "x.lat", "x.lng", "depot_lat", "depot_lng", "x.located", (F.col("low") + F.col("pos")).alias("rank"),
                F.when(F.col("stays"), F.col("x.age")).otherwise(0).alias("changed"), "alone",
            ),
            "stop-order",
        )
        if settled is None:
            settled, now = now.where("alone"), now.where("NOT alone")
        now = now.drop("alone")
        if now.where("changed < 2").isEmpty():
            break

    now = now.unionByName(settled.drop("alone"))
    order = now.select(F.col("route_id").alias("_route"), F.col("position").alias("_at"), (F.col("rank") + 1).alias("proposed_position"))
    placed = planned.join(by_route(order), (F.col("route_id") == F.col("_route")) & (F.col("position") == F.col("_at")))
    moved = ["position", "stop_id", "lat", "lng", "to_zone_id", *schemas.LOAD_COLUMNS]
    fixed = [
        "station_code", "departure_hour", "weekday", "route_total_stops", "route_package_count",
        "depot_lat", "depot_lng",
    ]
    return placed.select("route_id", *fixed, "proposed_position", *moved, "estimated_fields")


def order_seconds(stops: DataFrame, order: str, lines: DataFrame) -> DataFrame:
    scored = score_lines(legs_in_order(stops, order), lines)
    return scored.groupBy("route_id").agg(F.sum("prediction").alias("seconds"))


def order_savings(proposal: DataFrame, lines: DataFrame) -> DataFrame:
    """Predicted driving time of the given and the proposed order. A proposal that is worse shows
    as a negative saving. ``proposal`` is read twice, so pass a written table."""
    given = order_seconds(proposal, "position", lines).withColumnRenamed(
        "seconds", "original_seconds"
    )
    proposed = order_seconds(proposal, "proposed_position", lines).withColumnRenamed(
        "seconds", "proposed_seconds"
    )
    saving = F.col("original_seconds") - F.col("proposed_seconds")
    share = F.when(F.col("original_seconds") > 0, saving / F.col("original_seconds") * 100)
    return given.join(by_route(proposed), "route_id").withColumns(
        {"saving_seconds": saving, "saving_percent": F.coalesce(share, F.lit(0.0))}
    )


def reordered_eta(proposal: DataFrame, lines: DataFrame) -> DataFrame:
    """The table a driver would see: stops in proposed order with time per leg and arrival."""
    legs = legs_in_order(proposal, "proposed_position").withColumn(
        "segment_position", F.col("proposed_position")
    )
    extent = proposal.select(F.col("proposed_position").alias("segment_position"))
    timed = with_arrival_seconds(score_lines(legs, lines), extent=extent)
    return timed.select(
        "route_id",
        "proposed_position",
        "position",
        "stop_id",
        "packages_at_destination",
        "estimated_fields",
        "is_depot_segment",
        "segment_distance_km",
        "cumulative_distance_km",
        "same_zone",
        (F.col("prediction") / 60).alias("minutes"),
        (F.col("arrival_seconds") / 60).alias("arrival_minutes"),
    )
