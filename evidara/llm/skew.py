"""Joins of many rows to one row for each key, where a few keys may hold most of the rows: those of the library."""

from __future__ import annotations

from evidara.operators.skew import attach, fresh

__all__ = ["attach", "fresh"]
