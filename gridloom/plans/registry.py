"""All queries of the core, by name, with their SQL twins."""

from __future__ import annotations

from gridloom.plans import codec_queries, data_care, file_queries, map_queries, stream_queries

FLAGSHIP = "tile_diff"
QUERIES = {**map_queries.QUERIES, **codec_queries.QUERIES, **file_queries.QUERIES, **data_care.QUERIES, **stream_queries.QUERIES}
ORACLES = {**map_queries.ORACLES, **codec_queries.ORACLES, **file_queries.ORACLES, **data_care.ORACLES, **stream_queries.ORACLES}
