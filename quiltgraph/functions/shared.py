"""Objects that every task reads, sent once to each executor."""

from __future__ import annotations

from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shared:
    """A broadcast object whose classes travel with it, so executors need no copy of the package.

    Spark pickles what it broadcasts by reference to its module; here it gets bytes that hold the classes themselves.
    A task builds the object from them once.
    """

    def __init__(self, spark: SparkSession, value: Any):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self) -> dict:
        return {"_bytes": self._bytes}

    @property
    def value(self) -> Any:
        if "_made" not in self.__dict__:
            self._made = cloudpickle.loads(self._bytes.value)
        return self._made

    def destroy(self) -> None:
        """Give the copies up on the driver and the executors, once no job needs them."""
        self._bytes.destroy()
