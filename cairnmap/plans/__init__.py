"""Registered plans: name -> (callable, DuckDB text or None)."""

from __future__ import annotations

from . import between, cells, curvature, extents, files, fusion, ground, matching, motion, spatial, streams, updates, volumes  # noqa: F401
from .registry import PLANS as ALL

__all__ = ["ALL"]
