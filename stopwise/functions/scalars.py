"""Column helpers. All are built-in expressions, so they stay inside code generation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ordinal of each route score; label of a missing zone.
SCORE_ORDINAL = {"Low": 1, "Medium": 2, "High": 3}


def score_to_numeric(score: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SCORE_ORDINAL.items() for x in pair])
    return F.try_element_at(table, score)


def station_flag(stop_type: Column) -> Column:
    return F.when(stop_type == "Station", 1).otherwise(0)


def time_window_flag(start: Column, end: Column) -> Column:
    """1 when either bound is a real value. Pass columns already freed of NaN."""
    return F.when(start.isNotNull() | end.isNotNull(), 1).otherwise(0)


def text_or_null(value: Column) -> Column:
    """Free a JSON text of the ways a missing number can show up in it."""
    bare = F.trim(F.regexp_replace(value, '^"|"$', ""))
    return F.when(~bare.isin("NaN", "null", ""), bare)


def number_or_null(value: Column) -> Column:
    number = value.try_cast("double") if hasattr(value, "try_cast") else value.cast("double")
    return F.when(~F.isnan(number), number)


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, arrays become pipe-joined text."""

    def clean(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c).alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return join_list(c).alias(field.name)
        return c

    return df.select([clean(f) for f in df.schema])


def join_list(values: Column) -> Column:
    return F.concat_ws("|", values)


def package_volume(depth: Column, height: Column, width: Column) -> Column:
    return depth * height * width


def departure_timestamp(day: Column, time: Column) -> Column:
    """The given time of day in UTC, whatever the session's time zone."""
    text = F.concat(day.cast("string"), F.lit(" "), time, F.lit(" +00:00"))
    return F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss XXX")


def departure_hour(ts: Column) -> Column:
    """Hour in UTC."""
    return F.floor(F.pmod(F.unix_seconds(ts), F.lit(86400)) / 3600).cast("int")


def time_text(ts: Column) -> Column:
    """Time of day in UTC."""
    second = F.pmod(F.unix_seconds(ts), F.lit(86400))
    parts = [F.floor(second / 3600), F.floor(second / 60) % 60, second % 60]
    return F.when(ts.isNotNull(), F.format_string("%02d:%02d:%02d", *parts))


def safe_ratio(num: Column, den: Column, digits: int = 6) -> Column:
    """Null unless the denominator is positive."""
    return F.when(den > 0, F.round(num.cast("double") / den.cast("double"), digits))


def rain_flag(amount: Column) -> Column:
    return F.when(F.coalesce(amount, F.lit(0.0)) > 0, 1).otherwise(0)


def same_zone(origin: Column, destination: Column) -> Column:
    """1, 0 or null: a missing zone on either side gives null."""
    return (origin == destination).cast("int")


def depot_flag(from_type: Column) -> Column:
    return station_flag(from_type)


def city_code(station: Column) -> Column:
    return F.substring(station, 2, 2)


def route_third(position: Column, total: Column) -> Column:
    """Progress cut at one and two thirds, right-closed, with 0 in the first part."""
    progress = position / F.when(total < 1, 1).otherwise(total)
    return (
        F.when((progress >= 0) & (progress <= F.lit(1) / 3), "start")
        .when((progress > F.lit(1) / 3) & (progress <= F.lit(2) / 3), "middle")
        .when((progress > F.lit(2) / 3) & (progress <= 1), "end")
    )


def implied_speed_kmh(km: Column, minutes: Column) -> Column:
    """For reports only: it contains the target and must never feed a model."""
    return F.when(minutes > 0, km / (minutes / 60))


def clip_non_negative(c: Column) -> Column:
    """Floor at zero. An unknown prediction stays unknown."""
    return F.when(c < 0, 0.0).otherwise(c)


def segment_ratio(position: Column, total_stops: Column) -> Column:
    return F.when(total_stops != 1, F.round(position.cast("double") / (total_stops - 1), 6))


def impute_features(df: DataFrame, no_zone: str = "SIN_ZONA") -> DataFrame:
    """Model-side defaults: unknown ``same_zone`` counts as 0, an unknown zone is its own class."""
    fills = {
        "same_zone": F.coalesce("same_zone", F.lit(0)),
        "to_zone_id": F.coalesce("to_zone_id", F.lit(no_zone)),
        "station_code": F.col("station_code").cast("string"),
    }
    return df.withColumns({k: v for k, v in fills.items() if k in df.columns})


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the contract's columns, in order and type."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
