"""Latency of a call: repeated, with the first runs left out."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable


def measure(call: Callable[[], object], runs: int = 10, warm_up: int = 5) -> dict[str, float]:
    """Seconds of the runs after the first ``warm_up`` of ``runs``: ``mean, median, min, max, n``."""
    if not 0 <= warm_up < runs:
        raise ValueError("warm_up must be smaller than runs")
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        call()
        took.append(time.perf_counter() - began)
    kept = took[warm_up:]
    return {"mean": statistics.fmean(kept), "median": statistics.median(kept), "min": min(kept), "max": max(kept), "n": len(kept)}
