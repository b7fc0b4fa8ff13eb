"""Collects (key, Spark query, SQL counterpart) triples."""

QUERIES = {}
ORACLES = {}


def rounded(expr, digits):
    """DuckDB text for rounding on the shortest decimal form of a double, ties away from zero."""
    return f"cast(round(cast(cast({expr} AS varchar) AS decimal(38, 18)), {digits}) AS double)"


def check(key, sql=None):
    """Register a Spark query ``fn(spark, sf_dir)`` and, where one exists, its SQL counterpart."""

    def register(fn):
        if key in QUERIES:
            raise KeyError(f"{key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
