"""Registered queries and their SQL counterparts, one key per operator."""

from __future__ import annotations

from vicinity.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
