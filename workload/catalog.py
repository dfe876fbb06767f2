"""Imports every module that registers queries."""

from __future__ import annotations

from . import ingest, records, reflection, retrieval, scalars, streams, transcripts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
