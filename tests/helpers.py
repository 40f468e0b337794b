import numpy as np
import pandas as pd

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(n, seed=1, symbol="a", gap=None):
    """Seeded price walk as a fixture."""
    r = np.random.default_rng(seed)
    close = np.round(100 * np.exp(np.cumsum(r.normal(0, 0.02, n))), 2)
    op = np.round(close * (1 + r.normal(0, 0.01, n)), 2)
    hi, lo = np.maximum(op, close) + np.round(r.random(n), 2), np.minimum(op, close) - np.round(r.random(n), 2)
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    if gap:
        ts = ts + pd.to_timedelta(np.arange(n) // gap * 50, unit="h")
    return pd.DataFrame({"symbol": symbol, "ts": ts, "open": op, "high": hi, "low": lo, "close": close, "volume": r.integers(1, 50, n).astype(float)})


def frame(spark, *parts):
    return spark.createDataFrame(pd.concat(parts).reset_index(drop=True), SCHEMA)


def fetch(df, *cols):
    return df.select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def same(a, b, tol=1e-9):
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=tol, atol=tol, equal_nan=True, err_msg=c)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
