"""Names of the registered queries and their oracle SQL."""

from __future__ import annotations

from tidewave.plans import blocks, catalog, formulas, kernels, layout, linear, quality_control, relations, review, signals, spectral, workflow

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (spectral, relations, quality_control, catalog, kernels, layout, linear, formulas, review, workflow, signals, blocks):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
