"""Helpers that look at physical plans."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_of(df: DataFrame, mode: str = "simple") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def unpartitioned_windows(plan: str) -> int:
    """Window nodes whose input was pulled to a single partition."""
    return plan.count("Exchange SinglePartition") if "Window" in plan else 0
