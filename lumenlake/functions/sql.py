"""The library's functions for SQL text: temporary SQL functions, whose bodies Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, type, body)
FUNCTIONS = {
    "hamming64": (
        "a STRING, b STRING",
        "INT",
        "bit_count(CAST(conv(substring(lpad(a, 16, '0'), 1, 8), 16, 10) AS BIGINT) ^ CAST(conv(substring(lpad(b, 16, '0'), 1, 8), 16, 10) AS BIGINT))"
        " + bit_count(CAST(conv(substring(lpad(a, 16, '0'), 9, 8), 16, 10) AS BIGINT) ^ CAST(conv(substring(lpad(b, 16, '0'), 9, 8), 16, 10) AS BIGINT))",
    ),
    "cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"
        " / sqrt(aggregate(a, 0D, (s, v) -> s + v * v) * aggregate(b, 0D, (s, v) -> s + v * v))",
    ),
    "safe_name": ("s STRING", "STRING", r"coalesce(nullif(regexp_replace(trim(s), r'[^\p{L}\p{N}\-_.]', '_'), ''), '_unknown')"),
}


def register(spark: SparkSession) -> None:
    """Make FUNCTIONS callable in this session's SQL."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
