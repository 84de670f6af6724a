"""Canonical schemas and the field-name maps of the three metadata sources."""

from __future__ import annotations

from pyspark.sql import types as T

PAPERS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("venue", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("bibtex", T.StringType()),
        T.StructField("bibtex_url", T.StringType()),
        T.StructField("detail_url", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("snapshot_ts", T.TimestampType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

DETAIL = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("abstract", T.StringType()),
        T.StructField("bibtex", T.StringType()),
        T.StructField("bibtex_url", T.StringType()),
        T.StructField("detail_url", T.StringType()),
        T.StructField("conference", T.StringType()),
        T.StructField("year", T.IntegerType()),
    ]
)

# One hashed term of a text vector.
TERM = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("weight", T.DoubleType())])

# A stored vector: dense models fill ``embedding``, the hashed-term model ``terms``.
VECTORS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("terms", T.ArrayType(TERM)),
        T.StructField("version", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("cell", T.LongType()),
        T.StructField("batch", T.StringType()),
    ]
)

# Output field names of the sources, old name -> new name.
RENAMES_API = {"pdf": "link"}
RENAMES_CRAWL = {"bibtex": "_bibtex", "detail_url": "link"}

# What stands in for an absent field.
DISPLAY_DEFAULTS = {"title": "Untitled", "keywords": "", "pdf": "", "bibtex": ""}
PRINT_DEFAULTS = {"title": "N/A", "keywords": "N/A", "venue": "N/A", "pdf": "N/A"}

# Fixed value: address prefix of relative PDF links.
PDF_BASE = "https://openreview.net/"
