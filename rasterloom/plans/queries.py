"""All queries over the reference's own operators, by name, and their SQL."""

from __future__ import annotations

from rasterloom.plans import captions, evaluation, manifests, mapfeatures, retrieval, sources, spectral, tiling

QUERIES: dict = {}
ORACLES: dict = {}
for family in (evaluation, tiling, spectral, mapfeatures, captions, retrieval, manifests, sources):
    QUERIES |= family.QUERIES
    ORACLES |= family.ORACLES
