"""The same queries as plain SQL for an independent check, built from shared table expressions."""

from __future__ import annotations

from tidemark.config import (
    ALL_STRENGTHS, ALPHA, COLUMNS, DECLINES, MEASUREMENT_DAYS, N_VALID, PARTIAL_STRENGTHS, SCALES, SCALE_SHORT,
    SEED, PARTIAL_SEED, SOURCE_LABELS, SOURCE_SHORT, SOURCES, WEIGHTS, strengths,
)
from tidemark.plans.catalog import COMPARED, OUTAGE, ROLLING, ROLLING_STEPS, TICK_HORIZON, TICK_VALID, TYPE_PARTIAL

BARS = """r AS (
  SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS dt, l_extendedprice AS px, l_discount AS dc,
         l_quantity AS q,
         row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE)
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount) AS rn,
         count(*) OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE)) AS n
  FROM lineitem),
bars AS (
  SELECT series_id, dt, max(CASE WHEN rn = 1 THEN px END) AS open, max(CASE WHEN rn = n THEN px END) AS close,
         max(CASE WHEN rn = n THEN px * (1 - dc) END) AS adj_close, max(px) AS high, min(px) AS low,
         sum(q) AS volume
  FROM r GROUP BY series_id, dt),
b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dt) - 1 AS pos FROM bars),
sizes AS (SELECT series_id, count(*) AS n_rows, max(dt) AS last_dt FROM b GROUP BY series_id)"""

PANEL = BARS + ",\npanel AS (" + " UNION ALL ".join(
    f"SELECT series_id, dt, pos, '{c}' AS col, {c} AS real FROM b" for c in COLUMNS) + ")"

TICKS = """t AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id, event_id, ts, value AS real,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""

TYPED = """t AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id, event_type AS col, value AS real,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS pos FROM events)"""


def values(rows, names) -> str:
    """Inline table from Python rows."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else (f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v))
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"


def grid_rows(grid: dict) -> list:
    return [(s, c, float(v)) for s, per in grid.items() for c, v in per.items()]


def key(seed, source, scale, col, pos="pos") -> str:
    return f"md5(concat_ws('|', '{seed}', '{source}', {scale}, {col}, series_id, {pos}))"


def uniform(k: str) -> str:
    return f"((('0x' || substr({k}, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def normal(k: str) -> str:
    angle = f"(('0x' || substr({k}, 9, 8))::BIGINT / 4294967296.0::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({uniform(k)})) * cos(2.0::DOUBLE * pi() * {angle}))"


def seed_of(range_: str) -> str:
    return PARTIAL_SEED if range_ == "partially" else SEED


def damaged(source: str, range_: str, name: str = "dev", panel: str = "panel", grid: dict | None = None) -> str:
    """Long damaged rows of one source: ``series_id, col, pos, scale, strength, real, value``."""
    grid = grid or strengths(source, range_)
    k = key(seed_of(range_), source, "scale", "col")
    base = f"""{name}_g AS (SELECT * FROM {values(grid_rows(grid), ['g_scale', 'g_col', 'strength'])}),
{name}_r AS (SELECT series_id, col, min(real) AS lo, max(real) AS hi FROM {panel} GROUP BY series_id, col),
{name}_s AS (SELECT p.*, s.scale, coalesce(g.strength, 0.0) AS strength, lo, hi FROM {panel} p
  CROSS JOIN (VALUES {', '.join(f"('{s}')" for s in SCALES)}) AS s(scale)
  JOIN {name}_r USING (series_id, col)
  LEFT JOIN {name}_g g ON g.g_scale = s.scale AND g.g_col = p.col),
"""
    if source == "noise":
        value = f"CASE WHEN strength = 0 THEN real ELSE real + 0.01::DOUBLE * strength * (hi - lo) * {normal(k)} END"
    elif source == "incompleteness":
        value = f"CASE WHEN strength = 0 OR {uniform(k)} >= strength THEN real END"
    else:
        value = "real"
    return base + f"{name} AS (SELECT *, {value} AS value FROM {name}_s)"


def wide(source: str, range_: str, name: str = "w") -> str:
    """Damaged rows back in wide form with the real values beside them."""
    cols = ", ".join(
        f"max(CASE WHEN col = '{c}' THEN value END) AS {c}, max(CASE WHEN col = '{c}' THEN real END) AS real_{c}"
        for c in COLUMNS)
    return damaged(source, range_, f"{name}_dev") + (
        f",\n{name} AS (SELECT series_id, pos, scale, {cols} FROM {name}_dev GROUP BY series_id, pos, scale)")


def wide_query(source: str, range_: str) -> str:
    cols = ", ".join(f"round({c}, 4) AS {c}" for c in COLUMNS)
    return f"WITH {PANEL},\n{wide(source, range_)}\nSELECT series_id, pos, scale, {cols} FROM w"


def score(c: str) -> str:
    return (f"(CASE WHEN {c} = real_{c} THEN 1.0 ELSE 1.0 - pow(abs({c} - real_{c}) / "
            f"greatest(abs({c}), abs(real_{c})), {ALPHA[c]}::DOUBLE) END)")


def score_long() -> str:
    """Value score on long rows ``col, value, real``."""
    alpha = "CASE col " + " ".join(f"WHEN '{c}' THEN {a}::DOUBLE" for c, a in ALPHA.items()) + " END"
    return (f"(CASE WHEN value = real THEN 1.0 ELSE 1.0 - pow(abs(value - real) / "
            f"greatest(abs(value), abs(real)), {alpha}) END)")


TOTAL = sum(WEIGHTS.values())
TUPLE = "(" + " + ".join(f"{WEIGHTS[c] / TOTAL!r}::DOUBLE * {score(c)}" for c in COLUMNS) + ")"
DECAY = "(" + " + ".join(f"{WEIGHTS[c] / TOTAL!r}::DOUBLE * exp(-{DECLINES[c]}::DOUBLE * age)" for c in COLUMNS) + ")"
WHOLE = "(" + " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS) + ")"


def ages(days: dict = MEASUREMENT_DAYS) -> str:
    return f"""ages AS (
  SELECT b.series_id, pos, scale, days, (date_diff('day', dt, last_dt) + days) / 365.0::DOUBLE AS age,
         days + n_rows - pos AS time_diff
  FROM b JOIN sizes USING (series_id)
  CROSS JOIN {values(list(days.items()), ['scale', 'days'])})"""


def noise_relation(range_: str, name: str) -> str:
    return wide("noise", range_, name) + (
        f",\n{name}_rel AS (SELECT series_id, scale, avg({TUPLE}) AS score FROM {name} GROUP BY series_id, scale)")


def partial_timeliness(stale: float | None = None) -> str:
    if stale is None:
        stale = sum(WEIGHTS[c] for c in PARTIAL_STRENGTHS["timeliness"]) / TOTAL
    return f"""ages0 AS (SELECT series_id, avg(CASE WHEN scale = 'now' THEN {DECAY} END) AS fresh FROM ages GROUP BY series_id),
stale AS (SELECT series_id, scale, {1 - stale!r}::DOUBLE * fresh + {stale!r}::DOUBLE * avg({DECAY}) AS score
  FROM ages JOIN ages0 USING (series_id) WHERE scale <> 'now' GROUP BY series_id, scale, fresh)"""


def scen_rows(n_valid: int = N_VALID) -> str:
    """Real, damaged and repaired rows of all scenarios, split at the border of their series."""
    by = ["series_id", "col", "scale"]
    parts = [damaged(s, "all", s) for s in SOURCES]
    parts.append(kalman("SELECT series_id, col, scale, pos, value AS y FROM noise", by))
    parts.append(spline("SELECT series_id, col, scale, pos, value FROM incompleteness", by))
    pick = " UNION ALL ".join(
        f"SELECT series_id, col, pos, dt, real, '{s}' AS source, scale, 'N' AS improve, "
        f"CAST({'strength' if s == 'timeliness' else '0'} AS INTEGER) AS delay, value FROM {s}" for s in SOURCES)
    for source, rows, value in (("noise", "back", "ms"), ("incompleteness", "filled", "k.value")):
        pick += (f" UNION ALL SELECT k.series_id, k.col, k.pos, dt, real, '{source}', scale, 'Y', 0, {value} "
                 f"FROM {rows} k JOIN panel USING (series_id, col, pos)")
    return PANEL + ",\n" + ",\n".join(parts) + f""",
scen AS (SELECT series_id, col, pos, dt, real, 'none' AS source, '-' AS scale, 'N' AS improve, 0 AS delay,
  real AS value FROM panel UNION ALL {pick}),
train AS (SELECT s.*, n_rows - {n_valid} AS border FROM scen s JOIN sizes USING (series_id)
  WHERE pos < n_rows - {n_valid} - delay AND value IS NOT NULL),
actual AS (SELECT series_id, col, CAST(pos - (n_rows - {n_valid}) + 1 AS INTEGER) AS step, pos, real
  FROM panel JOIN sizes USING (series_id) WHERE pos >= n_rows - {n_valid})"""


# Report order of the scenarios, spelled out.
SCENARIO_ROWS = [
    (1, "none", "-", "N"), (2, "noise", "slightly", "N"), (3, "noise", "slightly", "Y"), (4, "noise", "moderately", "N"),
    (5, "noise", "moderately", "Y"), (6, "noise", "highly", "N"), (7, "noise", "highly", "Y"), (8, "incompleteness", "slightly", "N"),
    (9, "incompleteness", "slightly", "Y"), (10, "incompleteness", "moderately", "N"), (11, "incompleteness", "moderately", "Y"),
    (12, "incompleteness", "highly", "N"), (13, "incompleteness", "highly", "Y"), (14, "timeliness", "slightly", "N"),
    (15, "timeliness", "moderately", "N"), (16, "timeliness", "highly", "N"),
]


GROUP = "series_id, col, source, scale, improve, delay"


def replay() -> str:
    return scen_rows() + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY pos DESC) AS rk FROM train),
replay AS (SELECT {GROUP}, CAST(delay + {N_VALID} - rk + 1 AS INTEGER) AS step, value AS yhat FROM ranked
  WHERE rk <= delay + {N_VALID}),
aligned AS (SELECT {GROUP}, CAST(step - delay AS INTEGER) AS step, yhat FROM replay
  WHERE step > delay AND step <= delay + {N_VALID}),
evals AS (SELECT {GROUP}, sqrt(avg((yhat - real) * (yhat - real))) AS rmse, avg(abs(yhat - real)) AS mae,
  100.0 * avg(abs(yhat - real) / nullif(abs(real), 0)) AS mape, count(*) AS n, count(nullif(abs(real), 0)) AS mape_n
  FROM aligned JOIN actual USING (series_id, col, step) GROUP BY {GROUP})"""


def kalman(rows: str, by: list[str]) -> str:
    """Filter and backward pass of the local level as two recursions over positions; ``rows`` has ``by, pos, y``."""
    keys = ", ".join(by)
    same = lambda a, c: " AND ".join(f"{a}.{k} = {c}.{k}" for k in by)
    of = lambda a: ", ".join(f"{a}.{k}" for k in by)
    return f"""o AS MATERIALIZED ({rows}),
f AS (
  SELECT {keys}, pos, y AS mp, 0.25::DOUBLE AS pp, y AS mf, 0.125::DOUBLE AS pf FROM o WHERE pos = 0
  UNION ALL
  SELECT {of('o')}, o.pos, f.mf, f.pf + 0.04::DOUBLE,
         f.mf + (f.pf + 0.04::DOUBLE) / (f.pf + 0.29::DOUBLE) * (o.y - f.mf),
         (f.pf + 0.04::DOUBLE) * (1 - (f.pf + 0.04::DOUBLE) / (f.pf + 0.29::DOUBLE))
  FROM f JOIN o ON {same('o', 'f')} AND o.pos = f.pos + 1),
fm AS MATERIALIZED (SELECT *, max(pos) OVER (PARTITION BY {keys}) AS mx FROM f),
back AS (
  SELECT {keys}, pos, mf AS ms, mp, pp FROM fm WHERE pos = mx
  UNION ALL
  SELECT {of('fm')}, fm.pos, fm.mf + fm.pf / back.pp * (back.ms - back.mp), fm.mp, fm.pp
  FROM back JOIN fm ON {same('fm', 'back')} AND fm.pos = back.pos - 1)"""


def spline(rows: str, by: list[str]) -> str:
    """``filled(by, pos, value)``: not-a-knot cubic splines through the present values of ``rows(by, pos, value)``, their tridiagonal systems
    solved by two recursions over the knots."""
    keys = ", ".join(by)
    same = lambda a, c: " AND ".join(f"{a}.{k} = {c}.{k}" for k in by)
    of = lambda a: ", ".join(f"{a}.{k}" for k in by)
    w = f"OVER (PARTITION BY {keys} ORDER BY i)"
    return f"""sp AS MATERIALIZED ({rows}),
kn AS (SELECT {keys}, pos AS x, value AS y, row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS i,
  count(*) OVER (PARTITION BY {keys}) AS n FROM sp WHERE value IS NOT NULL),
hs AS (SELECT *, (lead(x) {w} - x)::DOUBLE AS h, (lead(y) {w} - y) / (lead(x) {w} - x) AS s FROM kn WHERE n >= 4),
hp AS (SELECT *, lag(h) {w} AS g, lag(s) {w} AS r FROM hs),
eq AS MATERIALIZED (SELECT {keys}, i, n,
  CASE WHEN i = n - 2 THEN g - h * h / g ELSE g END AS low, CASE WHEN i = 1 THEN h - g * g / h ELSE h END AS up,
  2.0::DOUBLE * (g + h) + CASE WHEN i = 1 THEN g * (g + h) / h ELSE 0 END + CASE WHEN i = n - 2 THEN h * (g + h) / g ELSE 0 END AS dia,
  6.0::DOUBLE * (s - r) AS rhs FROM hp WHERE i BETWEEN 1 AND n - 2),
fw AS (SELECT {keys}, i, n, up / dia AS cp, rhs / dia AS dp FROM eq WHERE i = 1
  UNION ALL SELECT {of('eq')}, eq.i, eq.n, eq.up / (eq.dia - eq.low * fw.cp), (eq.rhs - eq.low * fw.dp) / (eq.dia - eq.low * fw.cp)
  FROM fw JOIN eq ON {same('eq', 'fw')} AND eq.i = fw.i + 1),
fs AS MATERIALIZED (SELECT * FROM fw),
bw AS (SELECT {keys}, i, n, dp AS m FROM fs WHERE i = n - 2
  UNION ALL SELECT {of('fs')}, fs.i, fs.n, fs.dp - fs.cp * bw.m FROM bw JOIN fs ON {same('fs', 'bw')} AND fs.i = bw.i - 1),
inner_m AS MATERIALIZED (SELECT * FROM bw),
ends AS (SELECT {keys}, max(n) AS n, max(CASE WHEN i = 1 THEN m END) AS m1, max(CASE WHEN i = 2 THEN m END) AS m2,
  max(CASE WHEN i = n - 2 THEN m END) AS me, max(CASE WHEN i = n - 3 THEN m END) AS md FROM inner_m GROUP BY {keys}),
gaps_h AS (SELECT {keys}, max(CASE WHEN i = 0 THEN h END) AS h0, max(CASE WHEN i = 1 THEN h END) AS h1,
  max(CASE WHEN i = n - 3 THEN h END) AS ha, max(CASE WHEN i = n - 2 THEN h END) AS hb FROM hs GROUP BY {keys}),
ms AS (SELECT {keys}, i, m FROM inner_m
  UNION ALL SELECT {keys}, 0, ((h0 + h1) * m1 - h0 * m2) / h1 FROM ends JOIN gaps_h USING ({keys})
  UNION ALL SELECT {keys}, n - 1, ((ha + hb) * me - hb * md) / ha FROM ends JOIN gaps_h USING ({keys})),
cf AS (SELECT {keys}, i, n, x, y, s - h * (2.0::DOUBLE * m + m_next) / 6.0::DOUBLE AS b, m / 2.0::DOUBLE AS c, (m_next - m) / (6.0::DOUBLE * h) AS d
  FROM (SELECT hs.*, m, lead(m) OVER (PARTITION BY {of('hs')} ORDER BY hs.i) AS m_next FROM hs JOIN ms ON {same('hs', 'ms')} AND hs.i = ms.i) WHERE i <= n - 2),
ask AS (SELECT *, greatest(0, least(count(value) OVER (PARTITION BY {keys} ORDER BY pos) - 1, count(value) OVER (PARTITION BY {keys}) - 2)) AS i FROM sp),
filled AS (SELECT {of('ask')}, ask.pos, CASE WHEN value IS NOT NULL THEN value ELSE y + (pos - x) * (b + (pos - x) * (c + (pos - x) * d)) END AS value
  FROM ask LEFT JOIN cf ON {same('ask', 'cf')} AND ask.i = cf.i)"""


def rolling() -> str:
    """All scenarios of all windows row by row, first-order regressions on the row before, errors of fifteen steps."""
    shifts, n = ROLLING["shifts"], ROLLING["n"]
    border = n - N_VALID
    by = ["series_id", "col", "scale", "shift"]
    g = "series_id, col, shift, source, scale, improve"
    scales = ", ".join(f"('{s}', {ALL_STRENGTHS['noise'][s]}::DOUBLE, {ALL_STRENGTHS['incompleteness'][s]}::DOUBLE, {ALL_STRENGTHS['timeliness'][s]})" for s in SCALES)
    return f"""WITH RECURSIVE {PANEL},
sh AS (SELECT unnest({list(shifts)})::BIGINT AS shift),
asked AS (SELECT DISTINCT series_id, col, shift, n_rows FROM panel JOIN sizes USING (series_id), sh),
win AS (SELECT p.series_id, p.col, shift, pos, pos - shift AS p, real FROM panel p JOIN asked a USING (series_id, col)
  WHERE pos >= shift AND pos < shift + {n} AND n_rows >= shift + {n}),
lim AS (SELECT series_id, col, shift, min(real) AS lo, max(real) AS hi FROM win GROUP BY series_id, col, shift),
sc AS (SELECT * FROM (VALUES {scales}) AS v(scale, noise, gaps, delay)),
noisy AS (SELECT w.*, scale, real + 0.01::DOUBLE * noise * (hi - lo) * {normal(key(SEED, 'noise', 'scale', 'w.col').replace('series_id', 'w.series_id'))} AS value
  FROM win w JOIN lim USING (series_id, col, shift), sc),
holed AS (SELECT w.*, scale, CASE WHEN {uniform(key(SEED, 'incompleteness', 'scale', 'w.col').replace('series_id', 'w.series_id'))} >= gaps THEN real END AS value
  FROM win w, sc),
{kalman('SELECT series_id, col, scale, shift, p AS pos, value AS y FROM noisy', by)},
{spline('SELECT series_id, col, scale, shift, p AS pos, value FROM holed', by)},
scen AS (
  SELECT series_id, col, shift, 'none' AS source, '-' AS scale, 'N' AS improve, 0 AS delay, p, real AS value FROM win
  UNION ALL SELECT series_id, col, shift, 'noise', scale, 'N', 0, p, value FROM noisy
  UNION ALL SELECT series_id, col, shift, 'noise', scale, 'Y', 0, pos, ms FROM back
  UNION ALL SELECT series_id, col, shift, 'incompleteness', scale, 'N', 0, p, value FROM holed
  UNION ALL SELECT series_id, col, shift, 'incompleteness', scale, 'Y', 0, pos, value FROM filled
  UNION ALL SELECT series_id, col, shift, 'timeliness', scale, 'N', delay, p, real FROM win, sc),
tr AS (SELECT *, lag(value) OVER (PARTITION BY {g} ORDER BY p) AS prev FROM scen WHERE p < {border} - delay AND value IS NOT NULL),
fit AS (SELECT {g}, max(delay) AS delay, regr_slope(value, prev) AS phi, regr_intercept(value, prev) AS c, max_by(value, p) AS y FROM tr GROUP BY {g}),
ahead AS (SELECT {g}, k, CASE WHEN phi = 1 THEN c * h + y ELSE c * (1 - pow(phi, h)) / nullif(1 - phi, 0) + pow(phi, h) * y END AS yhat
  FROM (SELECT fit.*, k, k + delay AS h FROM fit, range(1, {N_VALID + 1}) AS t(k))),
e AS (SELECT {g}, yhat - real AS gap, real FROM ahead JOIN win USING (series_id, col, shift) WHERE p = {border} + k - 1)
SELECT {g}, count(*) AS n, round(sqrt(avg(gap * gap)), 3) AS rmse, round(avg(abs(gap)), 3) AS mae, round(100.0 * avg(abs(gap) / nullif(abs(real), 0)), 3) AS mape,
  count(nullif(abs(real), 0)) AS mape_n, CAST(NULL AS VARCHAR) AS reason FROM e GROUP BY {g}
UNION ALL SELECT series_id, col, shift, NULL, NULL, NULL, 0, NULL, NULL, NULL, 0,
  'window of {n} rows, series has ' || greatest(n_rows - shift, 0) || ' from there on' FROM asked WHERE n_rows < shift + {n}"""


TRAIN = PANEL + f""",
train AS (SELECT series_id, col, pos, real AS y FROM panel JOIN sizes USING (series_id) WHERE pos < n_rows - {N_VALID} AND real IS NOT NULL)"""


def smoothing() -> str:
    """Exponential smoothing by a reduction of each training list for every pair of the grid, then of three finer grids."""
    state = "{{'y': {y}, 'l': {l}, 'c': {c}, 'e': {e}}}"
    zero = state.format(y="y", l="0.0::DOUBLE", c="0.0::DOUBLE", e="0.0::DOUBLE")
    step = state.format(y="b.y", l="a.l - (1.0::DOUBLE - a1) * a.c + (a0 - a1) * (b.y - a.l)",
                        c="a.l + (1.0::DOUBLE - a0) * a.c + (a0 + a1) * (b.y - a.l)", e="a.e + (b.y - a.l) * (b.y - a.l)")
    start = state.format(y="0.0::DOUBLE", l="l0", c="l0 / 1.1::DOUBLE", e="0.0::DOUBLE")
    reduced = f"list_reduce(x, lambda a, b: {step}, {start})"
    ctes = [TRAIN, f"""o AS (SELECT *, row_number() OVER (PARTITION BY series_id, col ORDER BY pos) - 1 AS nth FROM train),
ys AS (SELECT series_id, col, list({zero} ORDER BY nth) AS x, avg(y) FILTER (nth < 10) AS l0, count(*) AS n FROM o GROUP BY series_id, col),
g1 AS (SELECT series_id, col, 0.05::DOUBLE + 0.15::DOUBLE * i AS a0, 0.05::DOUBLE + 0.15::DOUBLE * j AS a1
  FROM ys, range(12) AS t(i), range(13) AS u(j) WHERE n >= 4)"""]
    for r in range(1, 5):
        ctes.append(f"r{r} AS (SELECT series_id, col, a0, a1, {reduced} AS z FROM g{r} JOIN ys USING (series_id, col))")
        rows = f"SELECT series_id, col, a0, a1, z FROM r{r} WHERE isfinite(z.e)" + (f" UNION ALL SELECT * FROM b{r - 1}" if r > 1 else "")
        ctes.append(f"b{r} AS (SELECT series_id, col, w.a0 AS a0, w.a1 AS a1, w.z AS z FROM (SELECT series_id, col, "
                    f"arg_min({{'a0': a0, 'a1': a1, 'z': z}}, z.e) AS w FROM ({rows}) GROUP BY series_id, col))")
        if r < 4:
            width = 0.15 / 3**r
            ctes.append(f"g{r + 1} AS (SELECT series_id, col, least(1.8::DOUBLE, greatest(0.01::DOUBLE, a0 + i * {width!r}::DOUBLE)) AS a0, "
                        f"least(1.9::DOUBLE, greatest(0.01::DOUBLE, a1 + j * {width!r}::DOUBLE)) AS a1 FROM b{r}, range(-2, 3) AS t(i), range(-2, 3) AS u(j))")
    return "WITH RECURSIVE " + ",\n".join(ctes) + f""",
go AS (SELECT series_id, col, 1 AS step, z.l AS l, z.c AS c, a0, a1 FROM b4
  UNION ALL SELECT series_id, col, step + 1, l - (1.0::DOUBLE - a1) * c, l + (1.0::DOUBLE - a0) * c, a0, a1 FROM go WHERE step < {N_VALID})
SELECT series_id, col, CAST(step AS INTEGER) AS step, round(l, 4) AS yhat FROM go"""


def garch(p: int, q: int, simulate: bool = True) -> str:
    """Variance recursions of all candidates as reductions of each list of squared returns; forecasts with the same drawn shocks."""
    names = [f"a{i}" for i in range(1, p + 1)] + [f"b{j}" for j in range(1, q + 1)]
    total = " + ".join(names)
    past, var = [f"x{i}" for i in range(1, p + 1)], [f"v{j}" for j in range(1, q + 1)]

    def state(**at):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in at.items()) + "}"
    none = "0.0::DOUBLE"
    zero = state(r="r2", s=none, e=none, **{k: none for k in past + var})
    start = state(r=none, s=none, e=none, **{k: "target" for k in past + var})
    s = f"(target * (1.0::DOUBLE - ({total})) + " + " + ".join(f"{c} * a.{k}" for c, k in zip(names, past + var)) + ")"
    moved = {"x1": "b.r", "v1": s} | {f"x{i}": f"a.x{i - 1}" for i in range(2, p + 1)} | {f"v{j}": f"a.v{j - 1}" for j in range(2, q + 1)}
    step = state(r="b.r", s=s, e=f"a.e + ln({s}) + b.r / {s}", **{k: moved[k] for k in past + var})
    reduced = f"list_reduce(x, lambda a, b: {step}, {start})"

    def weights(mass, k, tilt, name):
        parts = [mass] if k == 1 else [f"{mass} * {tilt}"] + [f"{mass} * (1.0::DOUBLE - {tilt}) / {k - 1}"] * (k - 1)
        return [f"{v} AS {name}{i}" for i, v in enumerate(parts, 1)]
    numbers = lambda vs: "(VALUES " + ", ".join(f"({v}::DOUBLE)" for v in vs) + ")"
    coefficients = weights("m * h", p, "ta", "a") + weights("m * (1.0::DOUBLE - h)", q, "tb", "b")
    tilts = [numbers([0.25, 0.5, 0.75, 1.0] if k > 1 else [1.0]) for k in (p, q)]
    key_of = ", ".join(["series_id", "col"])
    ctes = [TRAIN, f"""o AS (SELECT *, ln(y / lag(y) OVER w) AS r, row_number() OVER w AS nth, count(*) OVER (PARTITION BY {key_of}) AS n
  FROM train WINDOW w AS (PARTITION BY {key_of} ORDER BY pos)),
sq AS (SELECT *, r * r AS r2 FROM o WHERE r IS NOT NULL),
ys AS (SELECT {key_of}, list({zero} ORDER BY nth) AS x, avg(r2) AS target FROM sq GROUP BY {key_of} HAVING count(*) >= 4 AND avg(r2) > 0),
g1 AS (SELECT {key_of}, {', '.join(coefficients)} FROM ys, {numbers([0.3, 0.6, 0.8, 0.9, 0.96, 0.99])} AS c1(m),
  {numbers([0.03, 0.08, 0.2, 0.4, 0.7])} AS c2(h), {tilts[0]} AS c3(ta), {tilts[1]} AS c4(tb))"""]
    for r, width in enumerate((0.3, 0.1, None), 1):
        ctes.append(f"r{r} AS (SELECT {key_of}, {', '.join(names)}, {reduced} AS z FROM g{r} JOIN ys USING ({key_of}))")
        packed = "{" + ", ".join(f"'{c}': {c}" for c in [*names, "z"]) + "}"
        ctes.append(f"b{r} AS (SELECT {key_of}, {', '.join(f'w.{c} AS {c}' for c in [*names, 'z'])} FROM (SELECT {key_of}, arg_min({packed}, z.e) AS w "
                    f"FROM r{r} WHERE isfinite(z.e) GROUP BY {key_of}))")
        if width:
            tables = ", ".join(f"(VALUES ({1 - width!r}::DOUBLE), (1.0::DOUBLE), ({1 + width!r}::DOUBLE)) AS f{i}(f{i})" for i in range(len(names)))
            new = ", ".join(f"{c} * f{i} AS {c}" for i, c in enumerate(names))
            ctes.append(f"g{r + 1} AS (SELECT * FROM (SELECT {key_of}, {new} FROM b{r}, {tables}) WHERE {total} < 0.999)")
    normal_of = normal(f"md5(concat_ws('|', '{SEED}', 'garch', '-', '-', concat_ws('/', series_id, col), step))") if simulate else "0.0::DOUBLE"
    z = {"x": [f"x{i}" for i in range(1, p + 1)], "v": [f"v{j}" for j in range(1, q + 1)]}
    s = f"target * (1.0::DOUBLE - ({total})) + " + " + ".join(f"{c} * {k}" for c, k in zip(names, z["x"] + z["v"]))
    shifted = ["r * r"] + z["x"][:-1] + ["s"] + z["v"][:-1]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f""",
e AS (SELECT {key_of}, {', '.join(names)}, target, {', '.join(f'z.{k} AS {k}0' for k in z['x'] + z['v'])} FROM b3 JOIN ys USING ({key_of})),
steps AS (SELECT {key_of}, step, {normal_of} AS shock FROM e, range(1, {N_VALID + 1}) AS t(step)),
go AS (SELECT {key_of}, 0::BIGINT AS step, 0.0::DOUBLE AS r, 0.0::DOUBLE AS s, {', '.join(f'{k}0 AS {k}' for k in z['x'] + z['v'])} FROM e
  UNION ALL SELECT {key_of}, step, r, s, {', '.join(shifted)} FROM (
    SELECT {key_of}, step, shock * sqrt(s) AS r, s, {', '.join(z['x'] + z['v'])} FROM (
      SELECT {key_of}, steps.step AS step, shock, {s} AS s, {', '.join(z['x'] + z['v'])}
      FROM go JOIN e USING ({key_of}) JOIN steps USING ({key_of}) WHERE steps.step = go.step + 1))),
tail AS (SELECT {key_of}, nth - (n - {N_VALID}) AS step, y FROM o WHERE nth > n - {N_VALID})
SELECT {key_of}, CAST(step AS INTEGER) AS step, round(exp(r) * y, 4) AS yhat FROM go JOIN tail USING ({key_of}, step)"""


def short(expr: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def lag_reports() -> str:
    lags = ", ".join(f"lag(real, {n}) OVER (PARTITION BY series_id, col ORDER BY pos) AS lag_{n}" for n, *_ in SCENARIO_ROWS)
    each = " UNION ALL ".join(
        f"""SELECT series_id || '_' || col || '_TailReplay_{N_VALID}' AS file_name, {n} AS num, '{SOURCE_SHORT[s]}' AS dev,
  '{SCALE_SHORT[c]}' AS scale, '{i}' AS improve,
  printf('%.2f + %.2f + %.2f', min(real), max(real), max(real) - min(real)) AS time_text,
  stddev_samp(real) AS time_sd, {'max(real)' if i == 'Y' else '0.0::DOUBLE'} AS mitigation_ms,
  min(real) AS prepare_ms, max(real) AS fit_ms, round(max(real) - min(real), 2) AS predict_ms,
  sqrt(avg((real - lag_{n}) * (real - lag_{n}))) AS rmse, avg(abs(real - lag_{n})) AS mae,
  100.0 * avg(abs(real - lag_{n}) / nullif(abs(real), 0)) AS mape FROM lg GROUP BY series_id, col"""
        for n, s, c, i in SCENARIO_ROWS)
    return f"{TYPED},\nlg AS (SELECT *, {lags} FROM t),\nreports AS ({each})"


MONTHLY = BARS + ",\nm0 AS (SELECT series_id, date_trunc('month', dt) AS month, " + ", ".join(
    f"avg({c}) AS {c}" for c in COLUMNS) + """ FROM b GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) - 1 AS row FROM m0),
chg AS (SELECT series_id, row, """ + ", ".join(
    f"({c} - open) / nullif(open, 0) AS {c}" for c in COMPARED) + " FROM m)"


def quality_sql(columns) -> str:
    """Damaged and repaired relation scores; the smoother runs as recursion over every column and scale."""
    chosen = columns or COLUMNS
    listed = ", ".join(f"'{c}'" for c in chosen)
    total = sum(WEIGHTS[c] for c in chosen)
    weight = "CASE col " + " ".join(f"WHEN '{c}' THEN {WEIGHTS[c] / total!r}::DOUBLE" for c in chosen) + " END"
    stale = sum(WEIGHTS[c] for c in chosen if c in PARTIAL_STRENGTHS["timeliness"]) / total
    hit = ", ".join(f"'{c}'" for c in PARTIAL_STRENGTHS["noise"])

    def noise(rows: str) -> str:
        return f"""(SELECT series_id, scale, sum({weight} * q) AS score FROM (
  SELECT series_id, scale, col, avg({score_long()}) AS q FROM ({rows}) WHERE col IN ({listed})
  GROUP BY series_id, scale, col) GROUP BY series_id, scale)"""

    def gaps(rows: str) -> str:
        return f"""(SELECT series_id, scale, avg(CASE WHEN whole THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM (
  SELECT series_id, scale, pos, bool_and(value IS NOT NULL) AS whole FROM {rows} WHERE col IN ({listed})
  GROUP BY series_id, scale, pos) GROUP BY series_id, scale)"""

    def part(source: str, range_: str, improve: str, rows: str) -> str:
        return (f"SELECT series_id, '{source}' AS source, '{SOURCE_LABELS[source]}' AS metric, '{range_}' AS range, "
                f"scale, '{improve}' AS improve, round(score, 6) AS score FROM {rows}")

    full = "SELECT series_id, col, scale, value, real FROM fixed"
    some = f"SELECT series_id, col, scale, CASE WHEN col IN ({hit}) THEN value ELSE real END AS value, real FROM fixed"
    whole = "(SELECT DISTINCT series_id, scale, 1.0::DOUBLE AS score FROM ia)"
    rows = [
        part("noise", "all", "N", noise("SELECT * FROM na")), part("noise", "partially", "N", noise("SELECT * FROM np")),
        part("noise", "all", "Y", noise(full)), part("noise", "partially", "Y", noise(some)),
        part("incompleteness", "all", "N", gaps("ia")), part("incompleteness", "partially", "N", gaps("ip")),
        part("incompleteness", "all", "Y", whole), part("incompleteness", "partially", "Y", whole),
        part("timeliness", "partially", "N", "stale"),
    ]
    if columns is None:
        rows.append(part("timeliness", "all", "N", "fresh"))
    return f"""WITH RECURSIVE {PANEL},
{damaged('noise', 'all', 'na')}, {damaged('noise', 'partially', 'np')},
{damaged('incompleteness', 'all', 'ia')}, {damaged('incompleteness', 'partially', 'ip')},
{ages({'now': 0, **MEASUREMENT_DAYS})}, {partial_timeliness(stale)},
fresh AS (SELECT series_id, scale, avg({DECAY}) AS score FROM ages WHERE scale <> 'now' GROUP BY series_id, scale),
{kalman('SELECT series_id, col, scale, pos, value AS y FROM na', ['series_id', 'col', 'scale'])},
fixed AS (SELECT k.series_id, k.col, k.scale, k.ms AS value, p.real FROM back k JOIN panel p USING (series_id, col, pos))
""" + " UNION ALL ".join(rows)


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["scan_bars"] = f"WITH {BARS} SELECT series_id, dt, open, close, adj_close, high, low, volume FROM b"
    sql["slice_window"] = f"""WITH {BARS},
st AS (SELECT series_id, pos AS shift FROM b WHERE pos IN (0, 100, 250, 1200))
SELECT series_id, shift, pos - shift AS pos, dt, close,
       count(*) OVER (PARTITION BY series_id, shift) = 1515 AS complete, true AS found
FROM st JOIN b USING (series_id) WHERE pos >= shift AND pos < shift + 1515"""
    sql["panel_unpivot"] = f"WITH {PANEL} SELECT series_id, dt, pos, col, real FROM panel"
    sql["panel_pivot"] = f"WITH {BARS} SELECT series_id, pos, dt, {', '.join(COLUMNS)} FROM b"
    sql["series_tail"] = f"""WITH {TICKS},
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos DESC) AS rk FROM t)
SELECT series_id, pos, event_id, real FROM k WHERE rk <= 10"""
    sql["train_split"] = f"""WITH RECURSIVE {scen_rows()}
SELECT series_id, col, source, scale, improve, delay, pos, 'train' AS role, round(value, 4) AS value FROM train
UNION ALL
SELECT s.series_id, col, source, scale, improve, delay, pos, 'validate', round(real, 4)
FROM scen s JOIN sizes USING (series_id) WHERE pos >= n_rows - {N_VALID}"""
    rows = values(SCENARIO_ROWS, ["num", "source", "scale", "improve"])
    sql["scenario_grid"] = f"""WITH {BARS}
SELECT series_id, n_rows AS rows, num, source, scale, improve, {short('source', SOURCE_SHORT)} AS dev_short,
  {short('scale', SCALE_SHORT)} AS scale_short FROM sizes CROSS JOIN {rows}"""
    split = [(s, c, "deviated" if any(PARTIAL_STRENGTHS[s].get(c, {}).values()) else "real")
             for s in SOURCES for c in COLUMNS]
    sql["column_split"] = f"""WITH {PANEL}, roles AS (SELECT * FROM {values(split, ['source', 'r_col', 'role'])})
SELECT series_id, col, rows, source, role FROM
  (SELECT series_id, col, count(real) AS rows FROM panel GROUP BY series_id, col) JOIN roles ON r_col = col"""
    for name, source, range_ in (("deviate_noise", "noise", "all"), ("deviate_noise_partial", "noise", "partially"),
                                 ("deviate_missing", "incompleteness", "all"),
                                 ("deviate_missing_partial", "incompleteness", "partially")):
        sql[name] = wide_query(source, range_)
    delay = [(r, s, c, int(v)) for r in ("all", "partially") for s, per in strengths("timeliness", r).items()
             for c, v in per.items()]
    sql["deviate_obsolete"] = f"""WITH {PANEL}, g AS (SELECT * FROM {values(delay, ['range', 'scale', 'g_col', 'delay'])})
SELECT series_id, col, scale, CAST(delay AS INTEGER) AS delay, range, count(*) AS rows, max(dt) AS last_dt
FROM panel JOIN sizes USING (series_id) JOIN g ON g_col = col WHERE pos < n_rows - delay
GROUP BY series_id, col, scale, delay, range"""
    sql["scenario_panel"] = f"""WITH RECURSIVE {scen_rows()}
SELECT series_id, col, pos, dt, source, scale, improve, delay, round(real, 4) AS real, round(value, 4) AS value FROM scen"""

    sql["row_ages"] = f"WITH {BARS}, {ages()} SELECT series_id, pos, scale, time_diff, round(age, 9) AS age_years FROM ages"
    sql["timeliness_values"] = f"""WITH {BARS}, {ages()}
SELECT series_id, pos, scale, time_diff, round(exp(-{DECLINES['close']}::DOUBLE * age), 9) AS score FROM ages"""
    sql["timeliness_tuples"] = f"""WITH {BARS}, {ages()},
fd AS (SELECT series_id, scale, max(time_diff) AS first_diff FROM ages GROUP BY series_id, scale),
sh AS (SELECT series_id, scale, max(first_diff) OVER (PARTITION BY series_id) - first_diff AS "offset" FROM fd)
SELECT series_id, pos, scale, "offset", round({DECAY}, 9) AS score FROM ages JOIN sh USING (series_id, scale)"""
    sql["timeliness_relation"] = f"""WITH {BARS}, {ages()}
SELECT series_id, scale, round(avg({DECAY}), 9) AS score FROM ages GROUP BY series_id, scale"""
    now = {"now": 0, **MEASUREMENT_DAYS}
    sql["timeliness_relation_partial"] = f"""WITH {BARS}, {ages(now)}, {partial_timeliness()}
SELECT series_id, scale, round(score, 9) AS score FROM stale"""
    sql["correctness_values"] = f"WITH {PANEL}, {wide('noise', 'all')} SELECT series_id, pos, scale, round({score('close')}, 6) AS score FROM w"
    sql["correctness_tuples"] = f"WITH {PANEL}, {wide('noise', 'partially')} SELECT series_id, pos, scale, round({TUPLE}, 6) AS score FROM w"
    sql["correctness_relation"] = f"WITH {PANEL}, {noise_relation('all', 'w')} SELECT series_id, scale, round(score, 6) AS score FROM w_rel"
    sql["completeness_values"] = f"""WITH {PANEL}, {wide('incompleteness', 'all')}
SELECT series_id, pos, scale, CASE WHEN close IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM w"""
    sql["completeness_tuples"] = f"WITH {PANEL}, {wide('incompleteness', 'partially')} SELECT series_id, pos, scale, {WHOLE} AS complete FROM w"
    sql["completeness_relation"] = f"""WITH {PANEL}, {wide('incompleteness', 'all')}
SELECT series_id, scale, round(1 - sum(CASE WHEN {WHOLE} THEN 0 ELSE 1 END) / count(*)::DOUBLE, 9) AS score
FROM w GROUP BY series_id, scale"""
    sql["weights_normalized"] = f"""WITH {PANEL}, g AS (SELECT * FROM {values(list(WEIGHTS.items()), ['g_col', 'weight'])}),
c AS (SELECT series_id, col, count(real) AS rows FROM panel GROUP BY series_id, col)
SELECT series_id, col, rows, round(weight / sum(weight) OVER (PARTITION BY series_id), 9) AS weight
FROM c JOIN g ON g_col = col WHERE rows > 0"""
    part = lambda s, r, t: f"SELECT series_id, '{s}' AS source, '{r}' AS range, scale, 'N' AS improve, round(score, 6) AS score FROM {t}"
    gaps = lambda t: f"(SELECT series_id, scale, avg(CASE WHEN {WHOLE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM {t} GROUP BY series_id, scale)"
    sql["deviated_quality"] = f"""WITH {PANEL}, {noise_relation('all', 'na')}, {noise_relation('partially', 'np')},
{wide('incompleteness', 'all', 'ia')}, {wide('incompleteness', 'partially', 'ip')}, {ages(now)}, {partial_timeliness()},
fresh AS (SELECT series_id, scale, avg({DECAY}) AS score FROM ages WHERE scale <> 'now' GROUP BY series_id, scale)
""" + " UNION ALL ".join([
        part("noise", "all", "na_rel"), part("noise", "partially", "np_rel"),
        part("incompleteness", "all", gaps("ia")), part("incompleteness", "partially", gaps("ip")),
        part("timeliness", "all", "fresh"), part("timeliness", "partially", "stale")])

    sql["quality_report"] = quality_sql(None)
    sql["quality_report_close"] = quality_sql(["close"])

    tick_panel = TICKS + ",\ntp AS (SELECT series_id, 'value' AS col, pos, real FROM t)"
    grid = {s: {"value": v} for s, v in ALL_STRENGTHS["noise"].items()}
    sql["mitigate_kalman"] = f"""WITH RECURSIVE {tick_panel},
{damaged('noise', 'all', 'dev', 'tp', grid)},
{kalman('SELECT series_id, scale, pos, value AS y FROM dev', ['series_id', 'scale'])}
SELECT series_id, scale, pos, round(ms, 6) AS value FROM back"""
    lost = " ".join(f"WHEN '{s}' THEN {v}" for s, v in ALL_STRENGTHS["incompleteness"].items())
    sql["mitigate_noise_gaps"] = f"""WITH RECURSIVE {PANEL},
{damaged('noise', 'all')},
cut AS (SELECT series_id, col, scale, pos, CASE WHEN pos NOT BETWEEN {OUTAGE[0]} AND {OUTAGE[1]}
  AND {uniform(key(SEED, 'incompleteness', 'scale', 'col'))} >= CASE scale {lost} END THEN value END AS value FROM dev),
seen AS (SELECT series_id, col, scale, pos AS at, value AS y,
  row_number() OVER (PARTITION BY series_id, col, scale ORDER BY pos) - 1 AS pos FROM cut WHERE value IS NOT NULL),
{kalman('SELECT * FROM seen', ['series_id', 'col', 'scale'])},
done AS (SELECT series_id, col, scale, o.at AS pos, ms FROM back JOIN o USING (series_id, col, scale, pos))
SELECT series_id, col, scale, pos, round(ms, 4) AS value FROM cut LEFT JOIN done USING (series_id, col, scale, pos)"""
    types = ("click", "error", "purchase", "signup", "view")
    full = {s: {c: v for c in types} for s, v in ALL_STRENGTHS["noise"].items()}
    some = [(s, c, float(v)) for s, per in TYPE_PARTIAL["noise"].items() for c, v in per.items()]
    sql["mitigated_partial"] = f"""WITH RECURSIVE {TYPED},
{damaged('noise', 'all', 'dev', 't', full)},
{kalman('SELECT series_id, col, scale, pos, value AS y FROM dev', ['series_id', 'col', 'scale'])},
g AS (SELECT * FROM {values(some, ['g_scale', 'g_col', 'g_strength'])})
SELECT back.series_id, back.col, back.scale, back.pos,
  round(CASE WHEN coalesce(g_strength, 0) <> 0 THEN ms ELSE real END, 6) AS value
FROM back JOIN t USING (series_id, col, pos) LEFT JOIN g ON g_scale = back.scale AND g_col = back.col"""
    sql["mitigate_spline"] = f"""WITH RECURSIVE {PANEL},
{damaged('incompleteness', 'all')},
{spline('SELECT series_id, col, scale, pos, value FROM dev', ['series_id', 'col', 'scale'])}
SELECT series_id, col, scale, pos, round(value, 4) AS value, CAST(NULL AS VARCHAR) AS error FROM filled"""

    w = "OVER (PARTITION BY series_id, col ORDER BY pos)"
    sql["log_returns"] = f"""WITH {PANEL}, g AS (SELECT *, real / nullif(lag(real) {w}, 0) AS ratio FROM panel)
SELECT series_id, col, pos, round(CASE WHEN ratio > 0 THEN ln(ratio) END, 9) AS log_return FROM g"""
    sql["pct_change"] = f"""WITH {TICKS},
g AS (SELECT *, real / nullif(lag(real) OVER (PARTITION BY series_id ORDER BY pos), 0) - 1 AS c FROM t)
SELECT series_id, pos, round(c, 6) AS pct_change FROM g WHERE c IS NOT NULL"""
    span = "OVER (PARTITION BY series_id, col ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    sql["lag_features"] = f"""WITH {PANEL}
SELECT series_id, col, pos, real, lag(real, 1) {w} AS lag_1, lag(real, 7) {w} AS lag_7, lag(real, 14) {w} AS lag_14,
  CASE WHEN pos >= 7 THEN max(real) {span} END AS rolling_max,
  CASE WHEN pos >= 7 THEN min(real) {span} END AS rolling_min,
  round(CASE WHEN pos >= 7 THEN avg(real) {span} END, 6) AS rolling_mean,
  CAST(isodow(dt) - 1 AS INTEGER) AS weekday, CAST(month(dt) AS INTEGER) AS month FROM panel"""
    acf = lambda k: f"""{TICKS}, mu AS (SELECT series_id, avg(real) AS m FROM t GROUP BY series_id),
c AS (SELECT t.series_id, pos, real - m AS c FROM t JOIN mu USING (series_id)),
a AS (SELECT x.series_id, k.lag, coalesce(sum(x.c * y.c), 0.0) AS s
  FROM c x CROSS JOIN (SELECT unnest(range(0, {k + 1})) AS lag) k
  LEFT JOIN c y ON y.series_id = x.series_id AND y.pos = x.pos - k.lag GROUP BY x.series_id, k.lag),
rho AS (SELECT series_id, CAST(lag AS INTEGER) AS lag, s / nullif(max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY series_id), 0) AS acf FROM a)"""  # noqa: E731
    sql["acf"] = f"WITH {acf(10)} SELECT series_id, lag, round(acf, 6) AS acf FROM rho"
    sql["pacf"] = f"""WITH {acf(3)},
p AS (SELECT series_id, max(CASE WHEN lag = 1 THEN acf END) AS r1, max(CASE WHEN lag = 2 THEN acf END) AS r2,
  max(CASE WHEN lag = 3 THEN acf END) AS r3 FROM rho GROUP BY series_id),
p2 AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p22 FROM p),
p3 AS (SELECT *, r1 - p22 * r1 AS p21 FROM p2),
p4 AS (SELECT *, (r3 - p21 * r2 - p22 * r1) / (1 - p21 * r1 - p22 * r2) AS p33 FROM p3)
SELECT series_id, 1 AS lag, round(r1, 6) AS pacf FROM p4 UNION ALL SELECT series_id, 2, round(p22, 6) FROM p4
UNION ALL SELECT series_id, 3, round(p33, 6) FROM p4"""

    sql["forecast_ar1"] = f"""WITH {TICKS}, n AS (SELECT series_id, count(*) AS n FROM t GROUP BY series_id),
tr AS (SELECT t.*, lag(real) OVER (PARTITION BY series_id ORDER BY pos) AS prev FROM t JOIN n USING (series_id)
  WHERE pos < n - {TICK_VALID}),
fit AS (SELECT series_id, regr_slope(real, prev) AS phi, regr_intercept(real, prev) AS c, max_by(real, pos) AS y
  FROM tr GROUP BY series_id)
SELECT series_id, CAST(h AS INTEGER) AS step, round(CASE WHEN phi = 1 THEN c * h + y
  ELSE c * (1 - pow(phi, h)) / nullif(1 - phi, 0) + pow(phi, h) * y END, 6) AS yhat
FROM fit CROSS JOIN (SELECT unnest(range(1, {TICK_HORIZON + 1})) AS h)"""
    sql["forecast_rolling_ar1"] = f"""WITH RECURSIVE {BARS},
g AS (SELECT series_id, pos - 1 AS pos, close / nullif(lag(close) OVER (PARTITION BY series_id ORDER BY pos), 0) - 1 AS y FROM b),
n AS (SELECT series_id, max(pos) + 1 AS n FROM b GROUP BY series_id),
tr AS (SELECT g.series_id, pos, y, lag(y) OVER (PARTITION BY g.series_id ORDER BY pos) AS prev FROM g
  WHERE y IS NOT NULL),
cut AS (SELECT tr.* FROM tr JOIN n USING (series_id) WHERE pos + 1 < n - {ROLLING_STEPS}),
fit AS (SELECT series_id, regr_slope(y, prev) AS phi, regr_intercept(y, prev) AS c, max_by(y, pos) AS y FROM cut GROUP BY series_id),
go AS (SELECT series_id, 1 AS step, c + phi * y AS v, phi, c FROM fit
  UNION ALL SELECT series_id, step + 1, c + phi * v, phi, c FROM go WHERE step < {ROLLING_STEPS})
SELECT series_id, CAST(step AS INTEGER) AS step, round(v, 6) AS yhat FROM go"""
    sql["rolling_scenarios"] = rolling()
    sql["forecast_ces"] = smoothing()
    sql["forecast_garch"] = garch(2, 2)
    sql["forecast_garch11"] = garch(1, 1)
    sql["forecast_garch_mean"] = garch(2, 2, simulate=False)
    sql["tail_replay"] = f"WITH RECURSIVE {replay()} SELECT {GROUP}, step, round(yhat, 4) AS yhat FROM replay"
    sql["forecast_align"] = f"WITH RECURSIVE {replay()} SELECT {GROUP}, step, round(yhat, 4) AS yhat FROM aligned"
    sql["forecast_eval"] = f"""WITH RECURSIVE {replay()}
SELECT {GROUP}, n, CAST({N_VALID} AS BIGINT) AS n_expected, mape_n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 4) AS mape FROM evals"""
    sql["scenario_forecast_replay"] = f"""WITH RECURSIVE {replay()}
SELECT {GROUP}, n, CAST({N_VALID} AS BIGINT) AS n_expected, mape_n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 4) AS mape FROM evals"""
    weights = values([(c, WEIGHTS[c] / TOTAL) for c in COLUMNS], ["g_col", "weight"])
    sql["forecast_eval_weighted"] = f"""WITH RECURSIVE {replay()}, g AS (SELECT * FROM {weights})
SELECT series_id, source, scale, improve, round(sum(weight * rmse), 4) AS rmse, round(sum(weight * mae), 4) AS mae,
  round(sum(weight * mape), 4) AS mape FROM evals JOIN g ON g_col = col GROUP BY series_id, source, scale, improve"""
    stale = "source = 'timeliness' AND scale = 'moderately'"
    sql["forecast_overlay"] = f"""WITH RECURSIVE {replay()},
e AS (SELECT series_id, min(last) AS train_end FROM (SELECT series_id, col, max(pos) AS last FROM train WHERE {stale}
  GROUP BY series_id, col) GROUP BY series_id)
SELECT series_id, col, role, pos - 1300 AS x, train_end, round(value, 4) AS value FROM (
  SELECT series_id, col, pos, real AS value, 'actual' AS role FROM panel WHERE pos >= 1300
  UNION ALL SELECT series_id, col, pos, value, 'training' FROM train WHERE {stale} AND pos >= 1300
  UNION ALL SELECT a.series_id, col, n_rows - {N_VALID} + step - 1, yhat, 'forecast' FROM aligned a JOIN sizes USING (series_id) WHERE {stale}
) JOIN e USING (series_id)"""
    sql["avg_predictions"] = f"""WITH RECURSIVE {replay()}
SELECT series_id, col, source, scale, improve, CAST(step AS BIGINT) AS step, round(yhat, 4) AS yhat, round(real, 4) AS real
FROM aligned JOIN actual USING (series_id, col, step)"""
    sql["rolling_origin"] = f"""WITH {BARS},
s AS (SELECT series_id, shift FROM sizes CROSS JOIN (SELECT unnest(range(0, 51)) AS shift) WHERE n_rows >= shift + 1515),
a AS (SELECT s.series_id, shift, b.pos AS p, b.close AS real FROM s JOIN b ON b.series_id = s.series_id
  AND b.pos >= shift + 1500 AND b.pos < shift + 1515)
SELECT a.series_id, shift, count(*) AS n, round(sqrt(avg((h.close - real) * (h.close - real))), 4) AS rmse,
  round(avg(abs(h.close - real)), 4) AS mae, round(100.0 * avg(abs(h.close - real) / nullif(abs(real), 0)), 4) AS mape
  , CAST(NULL AS VARCHAR) AS reason
FROM a JOIN b h ON h.series_id = a.series_id AND h.pos = a.p - 15 GROUP BY a.series_id, shift
UNION ALL SELECT series_id, shift, 0, NULL, NULL, NULL, 'window of 1515 rows, series has ' || greatest(n_rows - shift, 0) || ' from there on'
FROM sizes CROSS JOIN (SELECT unnest(range(0, 51)) AS shift) WHERE n_rows < shift + 1515"""

    sql["first_dates"] = f"WITH {BARS} SELECT series_id, min(dt) AS first_date FROM b GROUP BY series_id"
    sql["series_stats"] = f"""WITH {BARS} SELECT series_id AS name, min(close) AS min, max(close) AS max,
  round(avg(close), 4) AS avg, round(stddev_pop(close), 4) AS std_dev,
  round(stddev_pop(close) / nullif(avg(close), 0) * 100, 6) AS cv FROM b GROUP BY series_id"""
    sql["relative_change"] = f"WITH {MONTHLY} SELECT series_id, row, {', '.join(f'round({c}, 6) AS {c}' for c in COMPARED)} FROM chg"
    each = " UNION ALL ".join(f"SELECT series_id, row, '{c}' AS compared, {c} AS change FROM chg" for c in COMPARED)
    sql["relative_change_summary"] = f"""WITH {MONTHLY}, l AS ({each}),
z AS (SELECT *, row_number() OVER (PARTITION BY series_id, compared ORDER BY change, row) AS lo,
  row_number() OVER (PARTITION BY series_id, compared ORDER BY change DESC, row) AS hi FROM l WHERE change IS NOT NULL)
SELECT series_id, compared,
  max(CASE WHEN lo = 1 THEN row || ': ' || printf('%.1f%%', round(change * 100, 1)) END) AS min,
  max(CASE WHEN hi = 1 THEN row || ': ' || printf('%.1f%%', round(change * 100, 1)) END) AS max,
  printf('%.1f%%', round(avg(change) * 100, 1)) AS avg FROM z GROUP BY series_id, compared"""
    sql["report_scan"] = f"""WITH {lag_reports()} SELECT file_name, num, dev, scale, improve, time_text, mitigation_ms,
  round(time_sd, 6) AS time_sd, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(mape, 6) AS mape FROM reports"""
    sql["split_times"] = f"WITH {lag_reports()} SELECT file_name, num, prepare_ms, fit_ms, predict_ms FROM reports"
    sql["avg_prediction_report"] = f"""WITH {lag_reports()},
ok AS (SELECT file_name FROM reports GROUP BY file_name HAVING count(time_text) = 16 AND count(time_sd) = 16
  AND count(mitigation_ms) = 16 AND count(rmse) = 16 AND count(mae) = 16 AND count(mape) = 16)
SELECT num, dev, scale, improve, count(*) AS files,
  printf('%.2f + %.2f + %.2f', round(avg(prepare_ms), 2), round(avg(fit_ms), 2), round(avg(predict_ms), 2)) AS time_text,
  round(avg(time_sd), 4) AS time_sd, round(avg(mitigation_ms), 4) AS mitigation_ms, round(avg(rmse), 4) AS rmse,
  round(avg(mae), 4) AS mae, round(avg(mape), 4) AS mape
FROM reports JOIN ok USING (file_name) GROUP BY num, dev, scale, improve"""
    sql["avg_quality_report"] = f"""WITH {PANEL}, {noise_relation('all', 'na')}, {noise_relation('partially', 'np')},
u AS (SELECT series_id, 'all' AS range, scale, score FROM na_rel UNION ALL SELECT series_id, 'partially', scale, score FROM np_rel)
SELECT range, scale, 'N' AS improve, count(DISTINCT series_id) AS files, round(avg(score), 6) AS score FROM u GROUP BY range, scale"""
    same = lambda i, name: f"CASE WHEN count(DISTINCT split_part(file_name, '_', {i})) = 1 THEN min(split_part(file_name, '_', {i})) END AS {name}"
    names = ["company", "column", "method", "size"]
    sql["common_labels"] = f"""WITH {lag_reports()}, p AS (SELECT count(*) AS files,
  {', '.join(same(i + 1, n) for i, n in enumerate(names))} FROM reports)
SELECT files, {', '.join(f'p.{n}' for n in names)}, concat_ws('_', 'average', {', '.join(f'p.{n}' for n in names)}) AS name FROM p"""
    return sql


ORACLE = build()
