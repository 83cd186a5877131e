"""Queries of the descriptive statistics."""

from pyspark.sql import functions as F

from stopwise import schemas
from stopwise.operators import correlation, explore as e, lines, rank_tests
from stopwise.plans.catalogue import query
from stopwise.plans.q_quality import FREQ, pair_sql

DELIVERY = "(SELECT * FROM g_seg WHERE is_depot_segment = 0)"


@query("overview", "g_seg g_routes", f"""
SELECT count(*) AS segments, {len(schemas.GOLD_SEGMENTS)} AS segment_columns,
  min(route_date) AS first_day, max(route_date) AS last_day,
  count(DISTINCT station_code) AS stations,
  (SELECT count(DISTINCT route_id) FROM g_routes) AS routes,
  {len(schemas.GOLD_ROUTES)} AS route_columns FROM g_seg""")
def _(k):
    return e.overview(k.get("gold_segments"), k.get("gold_routes"))


@query("target_summary", "g_seg", """
SELECT is_depot_segment, count(m) AS n, round(avg(m), 3) AS mean_min,
  round(stddev_samp(m), 3) AS sd_min, round(max(m), 2) AS max_min,
  round(skewness(m), 3) AS skewness, round(kurtosis(m), 3) AS kurtosis,
  round(quantile_cont(m, 0.5), 3) AS median_min, round(quantile_cont(m, 0.05), 3) AS p05_min,
  round(quantile_cont(m, 0.95), 3) AS p95_min, round(quantile_cont(m, 0.99), 3) AS p99_min
FROM (SELECT is_depot_segment, travel_time_seconds / 60 AS m FROM g_seg) t GROUP BY 1""")
def _(k):
    return e.target_summary(k.get("gold_segments"))


@query("population_ratio", "g_seg", """
SELECT round(avg(travel_time_seconds) FILTER (is_depot_segment = 1)
  / avg(travel_time_seconds) FILTER (is_depot_segment = 0), 3) AS times_longer FROM g_seg""")
def _(k):
    return e.population_ratio(k.get("gold_segments"))


@query("jarque_bera", "g_seg", f"""
SELECT scale, n, round(s, 4) AS skewness, round(kk, 4) AS excess_kurtosis,
  round(n / 6.0::DOUBLE * (s * s + kk * kk / 4), 0) AS jarque_bera,
  round(exp(-(n / 6.0::DOUBLE * (s * s + kk * kk / 4)) / 2), 6) AS p_value
FROM (SELECT scale, count(*) AS n, avg(pow(x - m, 3)) / pow(var_pop(x), 1.5) AS s,
    avg(pow(x - m, 4)) / pow(var_pop(x), 2) - 3 AS kk
  FROM (SELECT scale, x, avg(x) OVER (PARTITION BY scale) AS m FROM (
    SELECT 'raw' AS scale, travel_time_seconds AS x FROM {DELIVERY} a
    UNION ALL SELECT 'log1p', ln(1 + travel_time_seconds) FROM {DELIVERY} b) c) d
  GROUP BY 1) f""")
def _(k):
    out = e.normality(k.get("gold_segments").filter("is_depot_segment = 0"))
    return out.select(
        "scale",
        "n",
        F.round("skewness", 4).alias("skewness"),
        F.round("excess_kurtosis", 4).alias("excess_kurtosis"),
        F.round("jarque_bera", 0).alias("jarque_bera"),
        F.round("p_value", 6).alias("p_value"),
    )


def describe_sql(table, columns, digits, shape=True):
    extra = (
        f", round(CASE WHEN isnan(skewness(value)) THEN NULL ELSE skewness(value) END, {digits})"
        " AS skewness, CASE WHEN abs(round(skewness(value), 3)) > 2 AND NOT isnan(skewness(value))"
        " THEN 1 ELSE 0 END AS strongly_skewed" if shape else ""
    )
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM t" for c in columns
    )
    return f"""SELECT * FROM (WITH t AS MATERIALIZED (SELECT * FROM {table}), l AS ({long})
SELECT "column", round(avg(value), {digits}) AS mean, round(stddev_samp(value), {digits}) AS sd,
  round(min(value), {digits}) AS min, round(quantile_cont(value, 0.5), {digits}) AS median,
  round(max(value), {digits}) AS max{extra} FROM l GROUP BY 1) x"""


@query("describe_numeric", "g_seg", describe_sql("g_seg", schemas.SEGMENT_NUMERIC, 3))
def _(k):
    return e.describe_numeric(k.get("gold_segments"), schemas.SEGMENT_NUMERIC)


CATEGORICAL = ["station_code", "from_zone_id", "to_zone_id", "route_date"]


@query("categorical_profile", "g_seg", f"""
SELECT * FROM ({FREQ}, r AS (SELECT *, row_number() OVER (PARTITION BY "column"
    ORDER BY n DESC, value) AS k FROM f WHERE value IS NOT NULL)
SELECT "column", count(*) AS distinct_values, max(value) FILTER (k = 1) AS top_value,
  max(n) AS top_rows, round(CAST(sum(n) FILTER (k <= 3) AS DOUBLE)
    / (SELECT count(*) FROM t) * 100, 2) AS top3_percent,
  count(*) FILTER (n = 1) AS seen_once
FROM r WHERE "column" IN ({", ".join(f"'{c}'" for c in CATEGORICAL)}) GROUP BY 1) x""")
def _(k):
    return e.categorical_profile(k.get("gold_segments"), CATEGORICAL)


OUTLIER = [
    "travel_time_seconds", "segment_distance_km", "packages_at_destination",
    "service_time_at_destination_seconds",
]


@query("iqr_outliers", "g_seg", f"""
SELECT * FROM (WITH t AS MATERIALIZED {DELIVERY}, l AS ("""
       + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM t"
                            for c in OUTLIER) + """),
  q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
    FROM l GROUP BY 1)
SELECT "column", count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
    AS outliers, round(max(q3 + 1.5 * (q3 - q1)), 3) AS upper_limit,
  round(max(value), 3) AS maximum,
  round(count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
    / CAST(count(*) AS DOUBLE) * 100, 2) AS percent
FROM l JOIN q USING ("column") GROUP BY 1) x""")
def _(k):
    return e.iqr_outliers(k.get("gold_segments").filter("is_depot_segment = 0"), OUTLIER)


@query("zero_second_segments", "g_seg", f"""
SELECT count(*) FILTER (travel_time_seconds = 0) AS zero_segments,
  round(count(*) FILTER (travel_time_seconds = 0) / CAST(count(*) AS DOUBLE) * 100, 3) AS percent
FROM {DELIVERY} t""")
def _(k):
    return e.zero_second_segments(k.get("gold_segments"))


@query("histogram", "g_seg", """
SELECT bin, count(*) AS n, round(0.0::DOUBLE + (bin - 1) * 0.5::DOUBLE, 6) AS bin_start
FROM (SELECT CASE WHEN m < 0 THEN 0 WHEN m >= 20 THEN 41
    ELSE CAST(floor(m * 40 / 20) AS BIGINT) + 1 END AS bin
  FROM (SELECT travel_time_seconds / 60 AS m FROM g_seg) a) b GROUP BY 1""")
def _(k):
    minutes = k.get("gold_segments").select((F.col("travel_time_seconds") / 60).alias("m"))
    return e.histogram(minutes, "m", 0, 20, 40)


@query("correlation_pairs", "g_seg", pair_sql("g_seg", schemas.SEGMENT_NUMERIC, 4))
def _(k):
    found = correlation.correlations(k.get("gold_segments"), schemas.SEGMENT_NUMERIC)
    return found.filter("r IS NOT NULL").select("a", "b", F.round("r", 4).alias("r"))


@query("top_correlations", "g_seg",
       f"SELECT * FROM ({pair_sql('g_seg', schemas.SEGMENT_NUMERIC, 4)}) p "
       "ORDER BY abs(r) DESC, a, b LIMIT 12")
def _(k):
    found = correlation.correlations(k.get("gold_segments"), schemas.SEGMENT_NUMERIC)
    best = found.filter("r IS NOT NULL").select("a", "b", F.round("r", 4).alias("r"))
    return best.orderBy(F.abs("r").desc(), "a", "b").limit(12)


SPEARMAN = [c for c in schemas.SEGMENT_NUMERIC if c != "travel_time_seconds"]


@query("spearman", "g_seg", "SELECT * FROM (WITH t AS MATERIALIZED (SELECT * FROM g_seg), l AS ("
       + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x, "
                            f"travel_time_seconds AS y FROM t WHERE {c} IS NOT NULL"
                            for c in SPEARMAN) + """),
  r AS (SELECT "column", rank() OVER (PARTITION BY "column" ORDER BY x)
      + (count(*) OVER (PARTITION BY "column", x) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY "column" ORDER BY y)
      + (count(*) OVER (PARTITION BY "column", y) - 1) / 2.0::DOUBLE AS ry FROM l)
SELECT "column", count(*) AS n,
  CASE WHEN isnan(corr(rx, ry)) THEN NULL ELSE round(corr(rx, ry), 4) + 0.0::DOUBLE END AS rho
FROM r GROUP BY 1) x""")
def _(k):
    out = rank_tests.spearman(k.get("gold_segments"), SPEARMAN, "travel_time_seconds")
    return out.withColumn("rho", F.round("rho", 4))


VIF = [
    "segment_distance_km", "packages_at_destination", "service_time_at_destination_seconds",
    "volume_at_destination_cm3", "packages_with_window_at_destination", "segment_position",
    "segment_ratio", "cumulative_distance_km", "departure_hour", "route_total_stops",
]


@query("vif")
def _(k):
    return correlation.vif(k.get("gold_segments"), VIF)


@query("vif_pair", "g_seg", """
SELECT unnest(['segment_distance_km', 'cumulative_distance_km']) AS "column",
  round(1 / (1 - r * r), 4) AS vif, CAST(1 / (1 - r * r) > 5 AS INT) AS above_threshold
FROM (SELECT corr(segment_distance_km, cumulative_distance_km) AS r FROM g_seg) c""")
def _(k):
    return correlation.vif(k.get("gold_segments"), ["segment_distance_km", "cumulative_distance_km"])


@query("distance_time_fit", "g_seg", """
SELECT f.is_depot_segment, round(slope, 5) AS slope, round(intercept, 5) AS intercept,
  round(r, 4) AS r, round(r2, 4) AS r2, round(kmh, 3) AS implied_kmh, n, round(mae, 4) AS mae_min
FROM (SELECT is_depot_segment, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
    corr(y, x) AS r, regr_r2(y, x) AS r2, sum(x) / sum(y) * 3600 AS kmh, count(*) AS n
  FROM (SELECT is_depot_segment, travel_time_seconds AS y, segment_distance_km AS x FROM g_seg
    UNION ALL SELECT NULL, travel_time_seconds, segment_distance_km FROM g_seg) a GROUP BY 1) f
JOIN (SELECT g.p, avg(abs(y - slope * x - intercept)) / 60 AS mae
  FROM (SELECT is_depot_segment AS p, travel_time_seconds AS y, segment_distance_km AS x FROM g_seg
    UNION ALL SELECT NULL, travel_time_seconds, segment_distance_km FROM g_seg) g
  JOIN (SELECT is_depot_segment AS p, regr_slope(travel_time_seconds, segment_distance_km) AS slope,
      regr_intercept(travel_time_seconds, segment_distance_km) AS intercept FROM g_seg
      GROUP BY ROLLUP (is_depot_segment)) c ON g.p IS NOT DISTINCT FROM c.p
  GROUP BY 1) m ON f.is_depot_segment IS NOT DISTINCT FROM m.p""")
def _(k):
    out = lines.distance_time_fit(k.get("gold_segments"))
    digits = {"slope": 5, "intercept": 5, "r": 4, "r2": 4, "implied_kmh": 3, "mae_min": 4}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


DRIVERS = [c for c in schemas.SEGMENT_NUMERIC if c not in ("travel_time_seconds", "is_depot_segment")]


@query("residual_drivers", "g_seg", f"""
SELECT * FROM (SELECT "column", round(r, 4) + 0.0::DOUBLE AS r FROM (UNPIVOT (
  SELECT {", ".join(f'corr({c}, residual) AS {c}' for c in DRIVERS)}
  FROM (SELECT *, travel_time_seconds - slope * segment_distance_km - intercept AS residual
    FROM {DELIVERY} t, (SELECT regr_slope(travel_time_seconds, segment_distance_km) AS slope,
      regr_intercept(travel_time_seconds, segment_distance_km) AS intercept FROM {DELIVERY} u) l) d
  ) ON COLUMNS(*) INTO NAME "column" VALUE r) p WHERE NOT isnan(r)) z
ORDER BY abs(r) DESC, "column" LIMIT 10""")
def _(k):
    d = lines.distance_residual(k.get("gold_segments"))
    found = correlation.correlated_with(d, DRIVERS, "residual").filter("r IS NOT NULL")
    best = found.withColumn("r", F.round("r", 4))
    return best.orderBy(F.abs("r").desc(), "column").limit(10)


@query("same_zone_effect", "g_seg", f"""
SELECT same_zone, count(*) AS n, round(avg(travel_time_seconds) / 60, 3) AS minutes,
  round(avg(segment_distance_km), 3) AS km,
  (SELECT round(avg(same_zone) * 100, 2) FROM {DELIVERY} u) AS same_zone_percent
FROM {DELIVERY} t WHERE same_zone IS NOT NULL GROUP BY 1""")
def _(k):
    return e.same_zone_effect(k.get("gold_segments"))


@query("means_by_context", "g_seg", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({x} AS VARCHAR) AS value, count(*) AS n, "
    f"round(avg(travel_time_seconds) / 60, 3) AS minutes FROM {DELIVERY} t GROUP BY 2"
    for d, x in {"city": "substr(station_code, 2, 2)", "departure_hour": "departure_hour",
                 "weekday": "weekday", "route_date": "route_date"}.items()))
def _(k):
    return e.means_by(k.get("gold_segments"))


@query("simpson_check", "g_seg", f"""
SELECT (SELECT round(corr(has_rain, travel_time_seconds), 4) + 0.0::DOUBLE FROM {DELIVERY} t) AS overall,
  round(avg(r), 4) + 0.0::DOUBLE AS mean_within, count(*) AS groups
FROM (SELECT station_code, corr(has_rain, travel_time_seconds) AS r FROM {DELIVERY} u
  GROUP BY 1 HAVING count(DISTINCT has_rain) > 1) s""")
def _(k):
    out = e.simpson_check(k.get("gold_segments"))
    return out.withColumns({c: F.round(c, 4) for c in ("overall", "mean_within")})


@query("rain_effect", "g_seg", f"""
SELECT coalesce(city, 'all') AS city,
  round(avg(travel_time_seconds) FILTER (has_rain = 1) / 60, 3) AS minutes_with_rain,
  round(avg(travel_time_seconds) FILTER (has_rain = 0) / 60, 3) AS minutes_without_rain,
  round(avg(has_rain) * 100, 3) AS rainy_percent
FROM (SELECT *, substr(station_code, 2, 2) AS city FROM {DELIVERY} t) u GROUP BY ROLLUP (city)""")
def _(k):
    return e.rain_effect(k.get("gold_segments"))


@query("route_time_split", "g_routes", """
SELECT round(avg(route_duration_hours), 2) AS mean_hours,
  round(min(route_duration_hours), 2) AS min_hours, round(max(route_duration_hours), 2) AS max_hours,
  round(sum(total_travel_time_seconds) / (sum(total_travel_time_seconds)
    + sum(total_planned_service_time_seconds)) * 100, 1) AS driving_percent,
  round(sum(total_planned_service_time_seconds) / (sum(total_travel_time_seconds)
    + sum(total_planned_service_time_seconds)) * 100, 1) AS service_percent FROM g_routes""")
def _(k):
    return e.route_time_split(k.get("gold_routes"))


@query("route_composition", "g_routes", describe_sql("g_routes", e.COMPOSITION, 2, shape=False))
def _(k):
    return e.route_composition(k.get("gold_routes"))


DURATION = [
    c for c in schemas.ROUTE_NUMERIC
    if c not in ("route_duration_seconds", "route_duration_hours", "total_travel_time_seconds")
]


@query("duration_drivers", "g_routes", f"""
SELECT "column", round(r, 4) + 0.0::DOUBLE AS r FROM (UNPIVOT (
  SELECT {", ".join(f'corr({c}, route_duration_seconds) AS {c}' for c in DURATION)} FROM g_routes
  ) ON COLUMNS(*) INTO NAME "column" VALUE r) p WHERE NOT isnan(r)""")
def _(k):
    found = correlation.correlated_with(
        k.get("gold_routes"), DURATION, "route_duration_seconds"
    ).filter("r IS NOT NULL")
    return found.withColumn("r", F.round("r", 4))


@query("route_score_profile", "g_routes", """
SELECT route_score, count(*) AS n, round(avg(route_duration_hours), 2) AS mean_hours,
  (SELECT round(min(n) / CAST(sum(n) AS DOUBLE) * 100, 2) FROM (SELECT count(*) AS n FROM g_routes
    WHERE route_score IS NOT NULL GROUP BY route_score) c) AS minority_percent
FROM g_routes WHERE route_score IS NOT NULL GROUP BY 1""")
def _(k):
    return e.route_score_profile(k.get("gold_routes"))


# by the series of the incomplete gamma function, whose terms are all positive
NORMAL_P = """CASE WHEN abs(z) > 12 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 300),
  lambda n: exp((n + 0.5) * ln(greatest(z * z / 2, 1e-300)) - z * z / 2 - lgamma(n + 1.5)))) END"""
CHI2_P = """CASE WHEN h > 1400 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 2000),
  lambda n: exp(((groups - 1) / 2.0::DOUBLE + n) * ln(greatest(h / 2, 1e-300)) - h / 2
    - lgamma((groups - 1) / 2.0::DOUBLE + n + 1)))) END"""


def mw_sql(table, flag):
    return f"""
SELECT n1, n0, round(u, 1) AS u, round(z, 4) AS z, round(d, 4) + 0.0::DOUBLE AS cohen_d,
  round({NORMAL_P}, 6) + 0.0::DOUBLE AS p_value
FROM (SELECT *, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12
    * (n1 + n0 + 1 - tie / ((n1 + n0) * (n1 + n0 - 1)))) AS z
FROM (SELECT n1, n0, tie, d, r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS u FROM (
  SELECT CAST(coalesce(count(*) FILTER (g = 1), 0) AS DOUBLE) AS n1,
    CAST(count(*) FILTER (g = 0) AS DOUBLE) AS n0,
    sum(rk) FILTER (g = 1) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS tie,
    (avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0)) / sqrt((var_samp(v) FILTER (g = 1)
      + var_samp(v) FILTER (g = 0)) / 2) AS d
  FROM (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE
      AS rk, count(*) OVER (PARTITION BY v) AS t
    FROM (SELECT travel_time_seconds AS v, {flag} AS g FROM {table} s
      WHERE {flag} IS NOT NULL) a) b) c) e) f"""


def mann_whitney(k, df, flag):
    out = rank_tests.mann_whitney(df, "travel_time_seconds", flag)
    return out.select(
        F.col("n1").cast("double").alias("n1"),
        F.col("n0").cast("double").alias("n0"),
        F.round("u", 1).alias("u"),
        F.round("z", 4).alias("z"),
        F.round("cohen_d", 4).alias("cohen_d"),
        (F.round("p_value", 6) + 0.0).alias("p_value"),
    )


@query("mann_whitney", "g_seg", mw_sql(DELIVERY, "same_zone"))
def _(k):
    return mann_whitney(k, k.get("gold_segments").filter("is_depot_segment = 0"), "same_zone")


@query("mann_whitney_rain", "g_seg", mw_sql(DELIVERY, "has_rain"))
def _(k):
    return mann_whitney(k, k.get("gold_segments").filter("is_depot_segment = 0"), "has_rain")


@query("mann_whitney_depot", "g_seg", mw_sql("g_seg", "is_depot_segment"))
def _(k):
    return mann_whitney(k, k.get("gold_segments"), "is_depot_segment")


@query("kruskal_wallis", "g_seg", f"""
SELECT groups, round(h, 4) AS h, round({CHI2_P}, 6) + 0.0::DOUBLE AS p_value
FROM (SELECT groups, h / (1 - tie / (n * n * n - n)) AS h FROM (
  SELECT count(*) AS groups, sum(c) AS n, sum(tie) AS tie,
    12 / (sum(c) * (sum(c) + 1)) * sum(r * r / c) - 3 * (sum(c) + 1) AS h
  FROM (SELECT g, CAST(count(*) AS DOUBLE) AS c, sum(rk) AS r, sum(CAST(t AS DOUBLE) * t - 1) AS tie
    FROM (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE
        AS rk, count(*) OVER (PARTITION BY v) AS t
      FROM (SELECT travel_time_seconds AS v, station_code AS g FROM {DELIVERY} s) a
      ) b GROUP BY 1) c) d) e""")
def _(k):
    out = rank_tests.kruskal_wallis(
        k.get("gold_segments").filter("is_depot_segment = 0"),
        "travel_time_seconds",
        "station_code",
    )
    return out.select("groups", F.round("h", 4).alias("h"), (F.round("p_value", 6) + 0.0).alias("p_value"))
