"""Windows of 180 days from one pass over the dates, against counting for each start."""

from __future__ import annotations

import numpy as np
import pytest
from tidewell.operators import windows


def plain(days, min_block, min_total, width, blocks):
    """(start_day, num_dates) of a user's first window and of the first behind it."""
    fits = []
    for start in sorted(days):
        counts = [sum(start + width * b <= d < start + width * (b + 1) for d in days) for b in range(blocks)]
        if min(counts) >= min_block and sum(counts) >= min_total:
            fits.append((start, sum(counts)))
    return fits[:1] + [f for f in fits if f[0] >= fits[0][0] + width * blocks][:1]


@pytest.mark.parametrize(("min_block", "min_total", "width", "blocks"), ((1, 10, 7, 3), (3, 24, 30, 6), (0, 1, 5, 2), (2, 2, 10, 1)))
def test_windows_against_counting(spark, min_block, min_total, width, blocks):
    rng = np.random.default_rng(3)
    own = {u: {int(d) for d in rng.choice(700, rng.integers(1, 300), replace=False) - 100} for u in range(25)}
    rows = [(u, d) for u, days in own.items() for d in days] * 2 + [(0, None), (77, None), (None, 5), (None, None)]
    df = spark.createDataFrame(rows, "user_id long, day long")
    got = sorted((r.user_id, r.window_index, r.start_day, r.num_dates, r.end_day) for r in windows.window_180(df, min_block, min_total, width, blocks).collect())
    assert got == sorted((u, i, s, n, s + width * blocks - 1) for u, days in own.items() for i, (s, n) in enumerate(plain(days, min_block, min_total, width, blocks), 1))


def test_dates_are_gone_through_once(spark):
    plan = windows.window_180(spark.range(100).selectExpr("id % 3 AS user_id", "id AS day"), 3, 24)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Range (") == 1 and "currentrow$(), 29" not in plan
