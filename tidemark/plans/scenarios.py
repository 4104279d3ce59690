"""The scenario grid and the tables built over it: damaged panels, training and validation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import CHUNK_ROWS, SCALES, SOURCES, strengths
from tidemark.functions.scoring import scale_label, source_label
from tidemark.operators.deviate import deviate
from tidemark.operators.mitigate import MITIGATIONS
from tidemark.operators.panel import attach, chunk_of


def scenarios(sources=None, scales=None, mitigated: bool = True) -> list[tuple]:
    """``(num, source, scale, improve)`` in report order: real first, then each damage with its repair.

    Staleness cannot be repaired.
    """
    rows = [("none", "-", "N")]
    for source in sources or SOURCES:
        for scale in scales or SCALES:
            rows.append((source, scale, "N"))
            if mitigated and source != "timeliness":
                rows.append((source, scale, "Y"))
    return [(i + 1, *r) for i, r in enumerate(rows)]


def scenario_grid(series: DataFrame, **choice) -> DataFrame:
    """Every row of ``series`` under every scenario, with short labels; a generator, no join."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("num"), F.lit(s).alias("source"), F.lit(c).alias("scale"), F.lit(i).alias("improve"))
        for n, s, c, i in scenarios(**choice)
    ])
    grid = series.select("*", F.inline(rows))
    return grid.withColumn("dev_short", source_label(F.col("source"))).withColumn(
        "scale_short", scale_label(F.col("scale"))
    )


def column_split(panel: DataFrame, columns=None) -> DataFrame:
    """Which columns of a series each source damages when damage is partial: ``role`` real or deviated."""
    found = panel.groupBy("series_id", "col").agg(F.count("real").alias("rows"))
    if columns:
        found = found.filter(F.col("col").isin(list(columns)))
    roles = []
    for source in SOURCES:
        grid = strengths(source, "partially")
        hit = [c for c in grid[SCALES[0]] if any(grid[s][c] != 0 for s in SCALES)]
        role = F.when(F.col("col").isin(hit), F.lit("deviated")).otherwise(F.lit("real"))
        roles.append(F.struct(F.lit(source).alias("source"), role.alias("role")))
    return found.select("*", F.inline(F.array(*roles)))


def scenario_panel(panel: DataFrame, range_: str = "all", sources=None, scales=None, mitigated: bool = True,
                   columns=None, shift: int = 0, size: int = CHUNK_ROWS) -> DataFrame:
    """Real, damaged and repaired rows of a long panel in one table.

    ``series_id, col, pos, [dt, border,] real, source, scale, improve, delay, value``. Repairs belong to the fully
    damaged set. Restrict columns, sources and scales here: what is not asked for is never built. A repair hands
    its damaged input on, so each damaged set is drawn once and the panel is never joined back.
    """
    sources, scales = sources or SOURCES, scales or SCALES
    ids = [c for c in ("series_id", "col", "pos", "dt", "border", "real") if c in panel.columns]
    carry = [c for c in ids if c not in ("series_id", "col", "pos")]
    zero = F.lit(0).cast("int")

    def damage(source, kind):
        df = deviate(panel, source, kind, strengths(source, kind, columns), shift)
        return df if set(scales) == set(SCALES) else df.filter(F.col("scale").isin(list(scales)))

    def shape(df, source, improve="N", delay=zero):
        df = df.withColumns({"source": F.lit(source), "delay": delay})
        df = df if improve is None else df.withColumn("improve", F.lit(improve))
        return df.select(*ids, "source", "scale", "improve", "delay", "value")

    out = shape(panel.withColumns({"scale": F.lit("-"), "value": F.col("real")}), "none")
    for source in sources:
        repair = MITIGATIONS.get(source) if mitigated else None
        if repair:
            fixed = repair(damage(source, "all"), ["series_id", "col", "scale"], size, carry)
            if range_ == "all":
                both = F.array(F.struct(F.lit("N").alias("improve"), F.col("damaged").alias("value")),
                               F.struct(F.lit("Y").alias("improve"), F.col("value").alias("value")))
                out = out.unionByName(shape(fixed.select(*ids, "scale", F.inline(both)), source, None))
                continue
            out = out.unionByName(shape(fixed, source, "Y"))
        delay = F.col("strength").cast("int") if source == "timeliness" else zero
        out = out.unionByName(shape(damage(source, range_), source, "N", delay))
    return out


GROUP = ["series_id", "col", "source", "scale", "improve", "delay"]


def with_border(panel: DataFrame, n_valid: int) -> DataFrame:
    """Add ``border``, the position where the last ``n_valid`` rows of a series begin."""
    sizes = panel.groupBy("series_id").agg((F.max("pos") + 1).alias("rows"))
    sizes = sizes.withColumn("border", F.col("rows") - n_valid)
    return attach(panel.withColumn("chunk", chunk_of("pos")), sizes, ["series_id"]).drop("chunk", "rows")


def training(scen: DataFrame, border="border") -> DataFrame:
    """Rows to learn from: present values before the border, minus the delay of a stale copy."""
    border = F.col(border) if isinstance(border, str) else F.lit(border)
    return scen.filter((F.col("pos") < border - F.col("delay")) & F.col("value").isNotNull())


def validation(panel: DataFrame, border="border") -> DataFrame:
    """Real rows from the border on, numbered as forecast steps 1, 2, ..."""
    edge = F.col(border) if isinstance(border, str) else F.lit(border)
    return panel.filter(F.col("pos") >= edge).withColumn("step", (F.col("pos") - edge + 1).cast("int"))


def train_split(scen: DataFrame, border="border") -> DataFrame:
    """Training rows of every scenario and real validation rows, told apart by ``role``."""
    keep = [*GROUP, "pos", "value"]
    learn = training(scen, border).select(*keep, F.lit("train").alias("role"))
    check = validation(scen, border).select(*keep[:-1], F.col("real").alias("value"), F.lit("validate").alias("role"))
    return learn.unionByName(check)


def max_delay(range_: str = "all", columns=None, scale: str | None = None) -> int:
    """Longest delay over the columns of a stale set: forecasts have to reach that much further."""
    grid = strengths("timeliness", range_, columns)
    return max(d for s, per in grid.items() for d in per.values() if scale in (None, s))
