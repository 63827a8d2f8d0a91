"""Session settings that the conversion functions need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Legacy charsets in encode/decode, and replacement instead of an error for what they can't hold.
CHARSET_CONFS = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}


def with_charsets(spark: SparkSession) -> SparkSession:
    """Turn on legacy charsets; plans are run lazily, so the settings stay on."""
    for key, value in CHARSET_CONFS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **confs: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("hanweave")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **CHARSET_CONFS,
        **confs,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
