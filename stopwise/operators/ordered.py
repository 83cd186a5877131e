"""Windows along a route that stay parallel when one route is huge.

A window partitioned by the route alone puts the whole route in one task. Here the positions of a
route are cut into blocks; each block is one window partition, and a table with one row per block
carries the totals from block to block. When no position reaches the block size, every route is a
single block, the carry is provably empty, and the plan is the plain one-exchange window.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def fits_one_block(extent: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> bool:
    """True when all positions lie in the first block. The filter reaches the Parquet scan, where
    row-group statistics answer it on ordinary data."""
    return extent.filter((F.col(order) >= block_rows) | (F.col(order) < 0)).isEmpty()


DEALT_ROWS = 1 << 18  # rows that one task is to sort in memory
MOST_ROWS = 1 << 20  # the same where there would be more than MOST_FILES tasks
MOST_FILES = 200  # up to here a writing task streams to a file for each reading task and holds no rows


def dealt_tasks(rows: int) -> int:
    wanted = -(-rows // DEALT_ROWS)
    return wanted if wanted <= MOST_FILES else max(MOST_FILES, -(-rows // MOST_ROWS))


def dealt(df: DataFrame, key: str, read: Sequence[DataFrame] = ()) -> DataFrame:
    """Rows dealt by a key to as many tasks as their number asks for, so that a task sorts about as much
    however large the input is, and does not write it aside. ``read`` are the tables in files the rows come
    from, whose footers know their number. A number that asks for no more tasks than there are cores leaves
    the dealing to Spark; any other is held, since Spark would join the tasks to one for each core."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = dealt_tasks(sum(t.count() for t in read))
    if wanted <= min(width, df.sparkSession.sparkContext.defaultParallelism):
        return df.repartition(key)
    return df.repartition(max(wanted, width), key)


def in_waves(plan: Callable[..., DataFrame], key: str, *tables: DataFrame) -> DataFrame:
    """``plan(*tables)`` for a plan that treats every key by itself, its keys dealt over as many waves as its
    rows ask for. A wave has no more rows than MOST_FILES tasks are to sort; above that a task that writes a
    shuffle would have to hold its rows or write them aside. Every row is in one wave, null being a key."""
    waves = -(-sum(t.count() for t in tables) // (MOST_FILES * MOST_ROWS))
    if waves <= 1:
        return plan(*tables)
    wave = F.pmod(F.xxhash64(key), F.lit(waves))
    out = None
    for i in range(waves):
        part = plan(*[t.where(wave == i) for t in tables])
        out = part if out is None else out.unionByName(part)
    return out


def block_of(order: Column, block_rows: int = BLOCK_ROWS) -> Column:
    return F.floor(order / F.lit(block_rows)).cast("int")


def along(
    df: DataFrame,
    keys: list[str],
    order: str,
    previous: dict[str, str] | None = None,
    running: dict[str, tuple[str, str]] | None = None,
    number: str | None = None,
    extent: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add columns computed along ``order`` within ``keys``.

    ``previous``  maps a new column to the column whose preceding value it holds.
    ``running``   maps a new column to ``(column, "before" | "through")``: the sum over earlier
                  rows, without or with the current one; an empty sum is 0.
    ``number``    names a 1-based row number.
    ``extent``    a cheaper table with the same range of ``order``, used to see whether blocks
                  are needed at all.
    Positions are unique within a key, as the route contract says.
    """
    previous, running = previous or {}, running or {}
    frames = {"before": -1, "through": 0}
    single = fits_one_block(df if extent is None else extent, order, block_rows)
    part = keys if single else [*keys, "_block"]
    if not single:
        df = df.withColumn("_block", block_of(F.col(order), block_rows))
    w = Window.partitionBy(*part).orderBy(order)
    new = {out: F.lag(c).over(w) for out, c in previous.items()}
    for out, (c, frame) in running.items():
        span = w.rowsBetween(Window.unboundedPreceding, frames[frame])
        new[out] = F.coalesce(F.sum(c).over(span), F.lit(0.0))
    if number:
        new[number] = F.row_number().over(w)
    if single:
        return df.withColumns(new)

    inner = df.withColumns({**new, "_first": F.row_number().over(w) == 1})
    blocks = df.groupBy(*part).agg(
        F.count("*").alias("_n"),
        *[F.max_by(c, order).alias(f"_last_{out}") for out, c in previous.items()],
        *[F.sum(c).alias(f"_sum_{out}") for out, (c, _) in running.items()],
    )
    bw = Window.partitionBy(*keys).orderBy("_block")
    past = bw.rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(
        *part,
        F.sum("_n").over(past).alias("_carry_n"),
        *[F.lag(f"_last_{out}").over(bw).alias(f"_carry_{out}") for out in previous],
        *[F.sum(f"_sum_{out}").over(past).alias(f"_carry_{out}") for out in running],
    ).filter(F.col("_carry_n").isNotNull())
    joined = inner.join(carry, part, "left")
    fixed = {
        out: F.when(F.col("_first"), F.col(f"_carry_{out}")).otherwise(F.col(out))
        for out in previous
    }
    for out in running:
        fixed[out] = F.col(out) + F.coalesce(F.col(f"_carry_{out}"), F.lit(0.0))
    if number:
        fixed[number] = (F.col(number) + F.coalesce("_carry_n", F.lit(0))).cast("int")
    drop = ["_block", "_first", "_carry_n", *[f"_carry_{o}" for o in [*previous, *running]]]
    return joined.withColumns(fixed).drop(*drop)


def numbered(df: DataFrame, keys: list[str], levels: list[str], out: str) -> DataFrame:
    """1-based row number within ``keys`` ordered by ``levels``, the last of which is unique given
    the others. Each level but the last is first reduced to one row per value, so no window ever
    sees more rows than the distinct values of one level below one value of the level above."""
    head, rest = levels[0], levels[1:]
    if not rest:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(head)))
    counts = df.groupBy(*keys, head).agg(F.count("*").alias("_n"))
    past = Window.partitionBy(*keys).orderBy(head).rowsBetween(Window.unboundedPreceding, -1)
    offset = f"_offset_{head}"
    offsets = counts.select(
        *keys, head, F.coalesce(F.sum("_n").over(past), F.lit(0)).alias(offset)
    )
    inner = numbered(df, [*keys, head], rest, out)
    return (
        inner.join(offsets, [*keys, head])
        .withColumn(out, (F.col(out) + F.col(offset)).cast("int"))
        .drop(offset)
    )


def hash_numbered(df: DataFrame, text: Column, out: str, first: list[Column] | None = None):
    """1-based row number of distinct keys in the order of ``first`` and then ``md5(text)``.

    md5 spreads distinct keys evenly, so its first three hex digits cut any set of keys into 4,096
    near-equal pieces; each is numbered in its own task and shifted by the count before it.
    """
    first = first or []
    names = [f"_k{i}" for i in range(len(first))]
    spread = df.withColumns(
        {**dict(zip(names, first)), "_h": F.md5(text)}
    ).withColumn("_piece", F.substring("_h", 1, 3))
    sizes = spread.groupBy(*names, "_piece").agg(F.count("*").alias("_n"))
    piece_w = Window.partitionBy(*names).orderBy("_piece")
    before = sizes.select(
        *names,
        "_piece",
        F.coalesce(
            F.sum("_n").over(piece_w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    if names:
        groups = spread.groupBy(*names).agg(F.count("*").alias("_g"))
        gw = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.select(*names, F.coalesce(F.sum("_g").over(gw), F.lit(0)).alias("_base"))
        before = before.join(groups, names).withColumn("_before", F.col("_before") + F.col("_base"))
    inner = Window.partitionBy(*names, "_piece").orderBy("_h")
    return (
        spread.withColumn(out, F.row_number().over(inner))
        .join(before.select(*names, "_piece", "_before"), [*names, "_piece"])
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop(*names, "_h", "_piece", "_before")
    )
