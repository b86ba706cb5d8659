"""All queries of the training-data operators, by name, with their SQL twins where there is one."""

from __future__ import annotations

from gridloom.llm import map_tags, texts

QUERIES = {**map_tags.QUERIES, **texts.QUERIES}
ORACLES = {**map_tags.ORACLES, **texts.ORACLES}
