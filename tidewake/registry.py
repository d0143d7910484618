"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from tidewake.operators import asof, attribution, calibrate, clip, dedup, drift, grid, inputs, models, patches, raster, serving, shore, simulate, store, tracks
from tidewake.streaming import ingest

_ALL = [q for m in (attribution, tracks, store, serving, grid, drift, raster, inputs, shore, asof, calibrate, clip) for q in m.QUERIES]
BY_NAME = {q.name: q for q in _ALL}
QUERIES = {q.name: q.run for q in _ALL} | simulate.QUERIES | patches.QUERIES | models.QUERIES | dedup.QUERIES | ingest.QUERIES
ORACLE = {q.name: q.oracle() for q in _ALL} | ingest.ORACLE
