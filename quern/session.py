"""Sessions with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the engine offers; there is one provider, so every declaration that is portable fits it.
CAPABILITIES = (
    "query", "query-across-scopes", "aggregate", "keyset", "total-count", "latest-per-key", "insert", "update", "upsert", "conditional-upsert", "delete",
    "compare-and-delete", "unit-of-work", "exact-outcomes", "append-idempotency", "exact-append", "sequence", "retention", "exact-retention", "schema-apply",
)


def session(name: str = "quern", **options: str) -> SparkSession:
    """Times are UTC, arithmetic overflows are errors, plans adapt at run time."""
    builder = SparkSession.builder.appName(name)
    for key, value in ({"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A folder for tables in between: the one the cluster names for checkpoints, or where none is named a temporary one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="quern-"))
        base = _local[0]
    return f"{base.rstrip('/')}/quern/{uuid.uuid4().hex}"
