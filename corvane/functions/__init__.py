"""SQL functions of the engine: register(spark) makes tokenize, cosine and token_estimate callable by name."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Temporary SQL functions with SQL bodies, so that Catalyst sees through them."""
    from ..operators.text import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '$1 $2')), '[^a-z0-9]+'), w -> length(w) >= 2 AND w NOT IN ({stop}))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x))) * sqrt(aggregate(b, 0D, (s, x) -> s + double(x) * double(x))), 0D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION token_estimate(t STRING) RETURNS BIGINT RETURN greatest(1, size(filter(split(t, '\\\\s+'), w -> w <> '')) * 13 div 10, length(t) div 4)")
