"""Namespaced user functions, as SQL functions Catalyst can see into."""

from __future__ import annotations

from pyspark.sql import SparkSession


class FunctionRegistry:
    """Functions are named ``ns::name`` and called as ``ns__name`` in SQL."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._bodies: dict[str, str] = {}

    @staticmethod
    def sql_name(name: str) -> str:
        return name.replace("::", "__")

    def register(self, name: str, params: str, returns: str, body: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {self.sql_name(name)}({params}) "
                       f"RETURNS {returns} RETURN {body}")
        self._bodies[name] = body

    def list(self) -> dict[str, str]:
        return dict(self._bodies)

    def delete(self, name: str, group: bool = False) -> int:
        """Drop one function or, with ``group``, a whole namespace."""
        gone = [n for n in self._bodies if n == name or (group and n.startswith(name + "::"))]
        for n in gone:
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {self.sql_name(n)}")
            del self._bodies[n]
        return len(gone)
