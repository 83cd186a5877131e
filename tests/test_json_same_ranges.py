"""A file has the same ranges in every pass, whatever other files are read with it."""

import json

from stopwise.sources import documents

NAMES = {"spark.sql.files.minPartitionNum": "4", "spark.sql.files.openCostInBytes": "1k"}


def routes(first, last):
    package = {
        "scan_status": "DELIVERED",
        "planned_service_time_seconds": 1.0,
        "dimensions": {"depth_cm": 1.0, "height_cm": 2.0, "width_cm": 3.0},
        "time_window": {"start_time_utc": "2024-01-01 09:00:00", "end_time_utc": "2024-01-01 13:00:00"},
    }
    return json.dumps({f"R{r}": {f"S{s}": {f"P{r}_{s}": package} for s in range(5)} for r in range(first, last)})


def test_files_that_are_cut_beside_files_that_are_not(spark, tmp_path):
    (tmp_path / "big.json").write_text(routes(0, 1500))
    for i in range(20):
        (tmp_path / f"small{i}.json").write_text(routes(10_000 + 80 * i, 10_080 + 80 * i))
    was = {k: spark.conf.get(k, None) for k in NAMES}
    try:
        for k, v in NAMES.items():
            spark.conf.set(k, v)
        got = documents.read_packages(spark, [str(tmp_path)]).select("route_id", "stop_id").collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == len(set(got)) == 5 * (1500 + 1600)
