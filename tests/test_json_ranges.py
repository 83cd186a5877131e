"""One JSON object in ranges against the json module."""

import collections
import json
import random

import pytest

from stopwise.sources import documents, json_ranges


@pytest.fixture
def ranges(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, size)
    spark.conf.set(name, before)


TEXTS = ["a}b", 'q"}\\', "{x", "", "}}", "é}", "\\", "[", "], {", "x" * 40, "12,5", "\n}"]


def value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([*TEXTS, 1.5, -20000.25, None, True, [1, 2, "}"], ["]"]])
    if kind < 0.4:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}" + rng.choice(["", "}", '"', "\\", "{"]): value(rng, depth - 1) for i in range(rng.randint(0, 4))}


def leaves(x, path=()):
    """Leaves by the keys above them. Empty containers may come from parting."""
    if isinstance(x, dict):
        for k, v in x.items():
            yield from leaves(v, (*path, k))
    elif isinstance(x, list):
        for v in x:
            yield from leaves(v, (*path, 0))
    else:
        yield path, repr(x)


@pytest.mark.parametrize("size", [83, 500, 10**6])
def test_same_leaves(spark, ranges, tmp_path, size):
    rng = random.Random(size)
    ranges(size)
    files = {}
    for n in range(3):
        files[f"object{n}.json"] = json.dumps({f"r{i}": value(rng, 4) for i in range(5)}, ensure_ascii=n % 2 == 0, indent=n or None)
    files["lines.json"] = "\n".join(json.dumps({f"r{i}": value(rng, 3)}) for i in range(9)) + "\n"
    files["list.json"] = json.dumps([{f"r{i}": value(rng, 2)} for i in range(5)]) + "\n"
    files["empty.json"], files["blank.json"], files["none.json"] = "", " \n", "{ }\n"
    want = collections.Counter()
    for name, text in files.items():
        (tmp_path / name).write_text(text)
        roots = text.splitlines() if name == "lines.json" else [text] if text.strip() else []
        for t in roots:
            want.update(leaves(json.loads(t)))
    for line_bytes in (1, 60) if size > 100 else (30,):
        got = collections.Counter()
        for r in json_ranges.small_objects(spark, str(tmp_path), line_bytes).collect():
            got.update(leaves(json.loads(r.value)))
        assert got == want


def test_range_within_one_string(spark, ranges, tmp_path):
    ranges(11)
    doc = {"a": {"b": "}" * 100, "c": '"}' * 50}, "d": {"e}": 1}}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    got = [json.loads(r.value) for r in json_ranges.small_objects(spark, str(tmp_path), 1).collect()]
    assert collections.Counter(x for g in got for x in leaves(g)) == collections.Counter(leaves(doc))


def test_routes_in_parts(spark, ranges, tmp_path):
    routes = {
        f"R{i}": {
            "station_code": f"D{i}", "date_YYYY_MM_DD": "2018-07-2" + str(i), "departure_time_utc": "10:00:00",
            "executor_capacity_cm3": 10.5, "route_score": "High",
            "stops": {f"S{j}": {"lat": 1.0 + j, "lng": 2.0, "type": "Dropoff" if j else "Station", "zone_id": f"z}}{j}"} for j in range(30)},
        }
        for i in range(1, 4)
    }
    one, many = tmp_path / "one", tmp_path / "many"
    for folder in (one, many):
        folder.mkdir()
    (one / "routes.json").write_text(json.dumps(routes))
    (many / "routes.json").write_text("\n".join(json.dumps({k: v}) for k, v in routes.items()))
    key = lambda r: tuple(map(str, r))
    for read in (documents.read_routes, documents.read_stops):
        ranges(10**6)
        want = sorted(map(key, read(spark, str(many)).collect()))
        assert len(want) == (3 if read is documents.read_routes else 90)
        for size in (10**6, 200):
            ranges(size)
            assert sorted(map(key, read(spark, str(one)).collect())) == want
            assert sorted(map(key, read(spark, str(many)).collect())) == want


def test_records_across_ranges_stay_whole(spark, ranges, tmp_path):
    package = lambda i: {
        "scan_status": "DELIVERED", "time_window": {"start_time_utc": "2018-07-27 10:00:00", "end_time_utc": "2018-07-27 12:00:00"},
        "planned_service_time_seconds": 10.0 + i, "dimensions": {"depth_cm": 1.0, "height_cm": 2.0, "width_cm": float(i)},
    }
    doc = {f"R{r}": {f"S{s}": {f"P{r}{s}{p}": package(r + s + p) for p in range(3)} for s in range(4)} for r in range(3)}
    (tmp_path / "packages.json").write_text(json.dumps(doc))
    for size in (333, 90):
        ranges(size)
        got = documents.read_packages(spark, str(tmp_path)).collect()
        assert len(got) == len({r.package_id for r in got}) == 36
        assert all(r.has_time_window == 1 and r.volume_cm3 is not None and r.planned_service_time_seconds is not None for r in got)
