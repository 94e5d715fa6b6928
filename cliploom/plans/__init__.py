"""Queries bound to tables. Importing this package fills the registry."""

from cliploom.plans import (  # noqa: F401
    dedup, events, health, ingest, learning, planning, reporting, similarity, streams, timeline,
)
