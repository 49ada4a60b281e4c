"""Helpers for writing the DuckDB oracle text."""

from __future__ import annotations


def R(num: str, den: str, scale: int) -> str:
    """ROUND(num / NULLIF(den, 0), scale) with NUMERIC semantics, exactly.

    DuckDB evaluates DECIMAL division in DOUBLE; PostgreSQL NUMERIC does not.
    Both operands are scaled to integers (x 10^6, enough for every money and
    ratio column here) and the half-away-from-zero rounding is done with
    HUGEINT integer division.
    """
    n = f"CAST(round(CAST({num} AS DECIMAL(38,8)) * 1000000) AS HUGEINT)"
    d = f"CAST(round(CAST({den} AS DECIMAL(38,8)) * 1000000) AS HUGEINT)"
    scale_up = 10 ** scale
    step = "1" if scale == 0 else "0." + "0" * (scale - 1) + "1"
    mag = f"((2 * abs({n}) * {scale_up} + abs({d})) // (2 * abs({d})))"
    return (f"(CASE WHEN ({den}) = 0 THEN NULL "
            f"WHEN ({n} >= 0) = ({d} > 0) THEN CAST({mag} AS DECIMAL(38,0)) * {step} "
            f"ELSE -CAST({mag} AS DECIMAL(38,0)) * {step} END)")


def RAVG(x: str, scale: int) -> str:
    """ROUND(AVG(x), scale) exactly (NUMERIC average)."""
    return R(f"sum({x})", f"count({x})", scale)
