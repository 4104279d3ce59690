"""Positions, chunks, slices and reshaping of panels.

Row identity inside a series is its position ``pos`` (0-based, ordered by time). Two ways lead to it:
daily bars have at most one row per day, so a series is bounded by the calendar and a window per series is safe;
irregular ticks have no such bound, so they are numbered by one global sort. From there on every ordered operator
groups by ``(series, chunk)`` with ``chunk = pos div CHUNK_ROWS``, and one long series spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import CHUNK_ROWS, COLUMNS
from tidemark.session import materialize


def number_daily(bars: DataFrame) -> DataFrame:
    """Add ``pos`` to daily bars (one row per series and day, hence at most 366 rows per series and year)."""
    w = Window.partitionBy("series_id").orderBy("dt")
    return bars.withColumn("pos", F.row_number().over(w) - 1)


def number_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``pos`` per ``keys`` for series of any length.

    One range-partitioned sort by (keys, order) balances the rows even when a single series holds most of them.
    The sorted rows are written once with a running row id, so the row ids cannot change between uses or retries.
    A series then starts at a known row id in each sorted part; rows before that part are a sum over its parts.
    """
    sorted_rows = materialize(
        df.sort(*keys, *order).withColumn("_rid", F.monotonically_increasing_id()), "numbered"
    ).withColumn("_part", F.shiftright("_rid", 33).cast("int"))
    parts = sorted_rows.groupBy(*keys, "_part").agg(F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # One row per series and part it touches: written too, so that its size is known to every join that reads it.
    starts = materialize(starts, "starts")
    return (
        sorted_rows.join(starts, [*keys, "_part"])
        .withColumn("pos", F.col("_before") + F.col("_rid") - F.col("_first"))
        .drop("_rid", "_part", "_first", "_before")
    )


def chunk_of(pos, size: int = CHUNK_ROWS) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size)).cast("bigint")


def with_halo(df: DataFrame, before: int, after: int = 0, size: int = CHUNK_ROWS, pos: str = "pos") -> DataFrame:
    """Add ``chunk`` and ``core``; rows near a chunk border also go to the neighbour chunk with ``core = false``."""
    if max(before, after) > size:
        raise ValueError(f"a halo of {max(before, after)} rows needs chunks of at least that size, got {size}")
    own = chunk_of(pos, size)
    offset = F.col(pos) - own * F.lit(size)
    nothing = F.lit(None).cast("bigint")
    targets = [F.struct(own.alias("chunk"), F.lit(True).alias("core"))]
    if before:
        target = F.when(offset >= size - before, own + 1).otherwise(nothing)
        targets.append(F.struct(target.alias("chunk"), F.lit(False).alias("core")))
    if after:
        target = F.when((offset < after) & (own > 0), own - 1).otherwise(nothing)
        targets.append(F.struct(target.alias("chunk"), F.lit(False).alias("core")))
    return df.select("*", F.inline(F.array(*targets))).filter(F.col("chunk").isNotNull())


def chunk_arrays(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per (keys, chunk) with the rows of the chunk as position-ordered array ``a`` of structs."""
    return df.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("a"))


def running_before(totals: DataFrame, keys: list[str], value: str, out: str, fan: int = CHUNK_ROWS) -> DataFrame:
    """Sum of ``value`` over all earlier chunks, from one row per (keys, chunk).

    Two levels: earlier blocks of ``fan`` chunks first, then earlier chunks inside the block, so the longest
    ordered group is ``fan`` rows for any series shorter than ``fan**3`` rows.
    """
    block = F.floor(F.col("chunk") / F.lit(fan)).cast("bigint")
    blocked = totals.withColumn("_block", block)
    by_block = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_block.select(*keys, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_offset"))
        .drop("_block", "_offset")
    )


def renumber(df: DataFrame, keys: list[str], size: int = CHUNK_ROWS) -> DataFrame:
    """Close the gaps in ``pos`` left by filtered rows: count inside a chunk, lift by the rows of earlier chunks."""
    chunked = df.withColumn("chunk", chunk_of("pos", size))
    totals = chunked.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("_n"))
    lifted = running_before(totals, keys, "_n", "_before").drop("_n")
    inside = Window.partitionBy(*keys, "chunk").orderBy("pos")
    counted = chunked.withColumn("_in", F.row_number().over(inside)).join(lifted, [*keys, "chunk"])
    return counted.withColumn("pos", F.col("_before") + F.col("_in") - 1).drop("_before", "_in", "chunk")


def attach(df: DataFrame, stats: DataFrame, keys: list[str], size: int = CHUNK_ROWS) -> DataFrame:
    """Join one row of ``stats`` per series to its rows, spread over the chunks of the series.

    ``df`` carries ``chunk`` and ``stats`` carries ``rows`` (rows of the series). The join key includes the chunk,
    so a long series does not end up in one task, and the same partitioning serves the windows that follow.
    """
    last = F.greatest(chunk_of(F.col("rows") - 1, size), F.lit(0).cast("bigint"))
    spread = stats.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return df.join(spread, [*keys, "chunk"], "left")


# Days of one date bin: a bin of daily bars holds a few dozen rows of a series.
BIN_DAYS = 64


def _bin(day) -> Column:
    return F.floor(F.unix_date(day) / F.lit(BIN_DAYS)).cast("bigint")


def _rows_from(bars: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` positions from each start date on, with ``pos`` and ``found``.

    A row answers for the dates since the row before it, so each start meets one row: both are bucketed by date bin and joined on
    series and bin. A window is then one or two bins of ``n`` positions, joined on series and bin as well. No join is on the series alone.
    """
    keys = [c for c in starts.columns if c != "start_dt"]
    earliest = starts.agg(F.min("start_dt")).first()[0]
    by_date = Window.partitionBy("series_id").orderBy("dt")
    numbered = bars.withColumns({"_at": (F.row_number().over(by_date) - 1).cast("bigint"), "_prev": F.lag("dt").over(by_date)})
    since = F.coalesce(_bin(F.date_add("_prev", 1)), F.least(_bin(F.lit(earliest).cast("date")), _bin(F.col("dt"))))
    covers = numbered.select("series_id", F.col("dt").alias("_dt"), "_prev", "_at", F.explode(F.sequence(since, _bin(F.col("dt")))).alias("_bin"))
    met = starts.withColumn("_bin", _bin(F.col("start_dt"))).join(covers, ["series_id", "_bin"]).filter(
        (F.col("start_dt") <= F.col("_dt")) & (F.col("_prev").isNull() | (F.col("_prev") < F.col("start_dt"))))
    first, last = F.col("_first"), F.col("_first") + (n - 1)
    windows = met.select(*keys, F.col("_at").alias("_first"), (F.col("_dt") == F.col("start_dt")).alias("found")).withColumn(
        "_bin", F.explode(F.sequence(chunk_of(first, n), chunk_of(last, n))))
    binned = numbered.drop("_prev", *[c for c in ("pos",) if c in bars.columns]).withColumn("_bin", chunk_of("_at", n))
    inside = binned.join(windows, ["series_id", "_bin"]).filter((F.col("_at") >= first) & (F.col("_at") <= last))
    return inside.withColumn("pos", (F.col("_at") - first).cast("int")).drop("_at", "_first", "_bin")


def slice_window(bars: DataFrame, start, n: int) -> DataFrame:
    """Cut ``n`` rows per series from its start date on; ``pos`` restarts at 0.

    ``start`` is one date for all series, which is then filtered in the scan, or a DataFrame
    ``series_id, start_dt [, shift]`` of any dates. ``found`` tells whether a series has a row on its start date, ``complete``
    whether it had all ``n`` rows. A series with no row from the start date on is kept as one empty row.
    """
    if isinstance(start, DataFrame):
        starts, keys = start, [c for c in start.columns if c != "start_dt"]
        cut = _rows_from(bars, starts, n)
    else:
        starts, keys = bars.select("series_id").distinct().withColumn("start_dt", F.lit(start).cast("date")), ["series_id"]
        # The limit stands on the rank itself, so that it holds before the shuffle too.
        ordered = Window.partitionBy(*keys).orderBy("dt")
        later = bars.filter(F.col("dt") >= F.lit(start).cast("date")).withColumn("_rank", F.row_number().over(ordered)).filter(F.col("_rank") <= n)
        cut = later.withColumn("pos", F.col("_rank") - 1).drop("_rank").withColumn(
            "found", F.min("dt").over(Window.partitionBy(*keys)) == F.lit(start).cast("date"))
    cut = cut.withColumn("complete", F.count(F.lit(1)).over(Window.partitionBy(*keys)) == n)
    no = F.lit(False)
    joined = starts.drop("start_dt").join(cut, keys, "left")
    return joined.withColumn("complete", F.coalesce("complete", no)).withColumn("found", F.coalesce("found", no))


def start_positions(bars: DataFrame, positions: list[int]) -> DataFrame:
    """Start dates at fixed positions of each series, one row per (series, shift); bars must carry ``pos``."""
    return bars.filter(F.col("pos").isin(positions)).select(
        "series_id", F.col("pos").alias("shift"), F.col("dt").alias("start_dt")
    )


def rolling_windows(bars: DataFrame, shifts: int, n: int) -> DataFrame:
    """Every window of ``n`` rows that starts at position 0 .. ``shifts``.

    Position ``p`` belongs to window ``s`` when ``s <= p < s + n``: each row lists its windows itself, so there is
    no join, and a row is repeated at most ``shifts + 1`` times.
    """
    first = F.greatest(F.lit(0).cast("bigint"), F.col("pos").cast("bigint") - (n - 1))
    last = F.least(F.lit(shifts).cast("bigint"), F.col("pos").cast("bigint"))
    inside = bars.filter(F.col("pos") < shifts + n)
    return inside.withColumn("shift", F.explode(F.sequence(first, last))).withColumn("pos", F.col("pos") - F.col("shift"))


def unpivot(bars: DataFrame, columns=None) -> DataFrame:
    """Wide bars -> long panel ``series_id, pos, dt, col, real``."""
    columns = columns or COLUMNS
    ids = [c for c in bars.columns if c not in COLUMNS]
    return bars.unpivot(ids, columns, "col", "real")


def pivot(panel: DataFrame, columns=None, value: str = "real") -> DataFrame:
    """Long panel -> one row per position with a column per attribute.

    The attributes of one position meet in one small group, reduced before the shuffle.
    """
    columns = columns or COLUMNS
    picked = [F.max(F.when(F.col("col") == c, F.col(value))).alias(c) for c in columns]
    return panel.groupBy("series_id", "pos", "dt").agg(*picked)


def series_tail(panel: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Last ``k`` positions per series (all of them for -1); the limit is applied before the shuffle."""
    if k == -1:
        return panel
    w = Window.partitionBy(*keys).orderBy(F.col("pos").desc())
    return panel.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")
