import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.functions.clock import TF_MS  # noqa: E402
from tidemark.session import get_spark  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def walk(n, tf="15m", seed=1, symbol="S", sigma=0.01, drop=(), t0=1_600_000_000_000, flat=False):
    """Seeded random-walk bars; ``drop`` leaves gaps."""
    rng = np.random.default_rng(seed)
    ms = TF_MS[tf]
    start = t0 - t0 % TF_MS["1d"]
    close = 30_000 * np.exp(np.cumsum(rng.normal(0, sigma, n)))
    if flat:
        close[:] = 30_000.0
    op = np.concatenate([[30_000.0], close[:-1]])
    wig = np.zeros(n) if flat else np.abs(rng.normal(0, 1, n)) * close * 0.3 * sigma
    wig2 = np.zeros(n) if flat else np.abs(rng.normal(0, 1, n)) * close * 0.3 * sigma
    pdf = pd.DataFrame({
        "symbol": symbol, "tf": tf, "open_time_ms": start + np.arange(n, dtype="int64") * ms,
        "open": op, "high": np.maximum(op, close) + wig, "low": np.minimum(op, close) - wig2, "close": close,
        "volume": np.full(n, 50.0) if flat else np.abs(rng.normal(0, 1, n)) * 100 + 10,
        "n_source_bars": np.full(n, ms // 60_000, dtype="int32"), "is_gap": False})
    return pdf.drop(index=list(drop)).reset_index(drop=True)


@pytest.fixture(scope="session")
def make_walk():
    return walk
