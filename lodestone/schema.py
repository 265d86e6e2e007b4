"""Formats that must be read as they are: columns as DDL strings, nested JSON, allowed values.

Fixed values throughout.
"""

from __future__ import annotations

GEO_INDEX = "cell_size_deg DOUBLE, cells MAP<STRING, ARRAY<ARRAY<BIGINT>>>"
OBSERVATION_JSON = "STRUCT<uuid STRING, location STRING, created_at STRING, taxon STRUCT<id INT, name STRING, rank STRING>, photos ARRAY<STRUCT<id BIGINT, url STRING>>>"
OCCURRENCE_JSON = "STRUCT<results ARRAY<STRUCT<media ARRAY<STRUCT<identifier STRING, type STRING, format STRING, license STRING>>>>, endOfRecords BOOLEAN>"
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
