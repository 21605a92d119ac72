"""All registered queries and oracles."""

from __future__ import annotations

from boxlake.plans.boxes import boxes
from boxlake.plans.curation import curation
from boxlake.plans.dataset import dataset
from boxlake.plans.review import flagship, reviews
from boxlake.plans.streams import streams
from boxlake.plans.video import video

__all__ = ["ORACLES", "QUERIES", "flagship"]

REGISTRIES = (boxes, dataset, reviews, curation, video, streams)

QUERIES = {name: fn for r in REGISTRIES for name, fn in r.queries.items()}
ORACLES = {name: sql for r in REGISTRIES for name, sql in r.oracles.items()}
