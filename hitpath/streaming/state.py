"""The state store that operators with keyed state need."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Choose the state store this operator needs, for all later streams of the session."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def require_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        raise ValueError(f"keyed state needs {_PROVIDER}={_ROCKSDB}; call use_rocksdb(spark) first")
