"""Column names, labels and default strengths shared by all operators."""

# Attribute names of a price bar, in report order.
COLUMNS = ["open", "close", "adj_close", "high", "low", "volume"]

# Deviation sources, scales and ranges with their report labels.
SOURCES = ["noise", "incompleteness", "timeliness"]
SOURCE_LABELS = {"none": "no deviations", "noise": "noised", "incompleteness": "incomplete", "timeliness": "obsolete"}
SOURCE_SHORT = {"none": "-", "noise": "N", "incompleteness": "I", "timeliness": "T"}
SCALES = ["slightly", "moderately", "highly"]
SCALE_SHORT = {"-": "-", "slightly": "S", "moderately": "M", "highly": "H"}
RANGES = ["all", "partially"]

# Column weights, sensitivities and declines.
WEIGHTS = {"open": 0.2, "close": 0.2, "adj_close": 0.25, "high": 0.15, "low": 0.15, "volume": 0.05}
ALPHA = {"open": 0.5, "close": 0.5, "adj_close": 0.5, "high": 0.5, "low": 0.5, "volume": 1.0}
DECLINES = {"open": 0.4, "close": 0.4, "adj_close": 0.5, "high": 1.0, "low": 1.0, "volume": 2.0}
MEASUREMENT_DAYS = {"slightly": 5, "moderately": 100, "highly": 400}
DAYS_IN_YEAR = 365.0

# Strength of each deviation when every column is damaged.
ALL_STRENGTHS = {
    "noise": {"slightly": 0.7, "moderately": 1.7, "highly": 4.0},
    "incompleteness": {"slightly": 0.05, "moderately": 0.12, "highly": 0.3},
    "timeliness": {"slightly": 5, "moderately": 15, "highly": 50},
}

# Strength of each deviation when only the listed columns are damaged.
PARTIAL_STRENGTHS = {
    "noise": {
        "close": {"slightly": 0.6, "moderately": 2.0, "highly": 6.0},
        "open": {"slightly": 0.4, "moderately": 1.7, "highly": 5.2},
    },
    "incompleteness": {
        "close": {"slightly": 0.05, "moderately": 0.12, "highly": 0.3},
        "open": {"slightly": 0.03, "moderately": 0.08, "highly": 0.18},
    },
    "timeliness": {
        "close": {"slightly": 5, "moderately": 20, "highly": 50},
        "open": {"slightly": 3, "moderately": 12, "highly": 30},
    },
}

# Local-level smoother variances.
OBSERVATION_VARIANCE = 0.25
LEVEL_VARIANCE = 0.04

# Seed of the counter-based draws. Partial damage is drawn independently of full damage, so it carries its own seed.
SEED = "42"
PARTIAL_SEED = "42p"

# Rows per chunk of a series. Every ordered operator works on (series, chunk) groups, so no task ever has to hold
# a whole series; neighbouring chunks share a halo of rows where an operator looks back or ahead.
CHUNK_ROWS = 4096

# Knots shared between chunks of the spline: it forgets at about 0.27 per knot, so beyond this distance the remaining
# influence is below double precision.
SPLINE_HALO = 40

N_VALID = 15


def strengths(source: str, range_: str = "all", columns=None) -> dict:
    """``{scale: {column: strength}}`` for a source; columns without a partial strength stay undamaged (0)."""
    columns = columns or COLUMNS
    if range_ == "all":
        return {s: {c: ALL_STRENGTHS[source][s] for c in columns} for s in SCALES}
    partial = PARTIAL_STRENGTHS[source]
    return {s: {c: partial.get(c, {}).get(s, 0) for c in columns} for s in SCALES}


def seed_for(range_: str = "all", shift: int = 0) -> str:
    """Seed of one independently drawn damage set."""
    base = PARTIAL_SEED if range_ == "partially" else SEED
    return f"{base}s{shift}" if shift else base
