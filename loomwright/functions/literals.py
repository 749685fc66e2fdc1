"""Small fixed tables, the same in Spark and as SQL VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Literal:
    """Rows of plain values with a column list such as ``"id long, text string"``."""

    SQL = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.schema, self.rows = schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        """As a local relation, so that plans hold the rows themselves."""
        columns = [c.strip().split(" ") for c in self.schema.split(",")]
        kind = {"long": "bigint"}
        select = ", ".join(f"CAST({n} AS {kind.get(t, t)}) AS {n}" for n, t in columns)
        return spark.sql(f"SELECT {select} FROM VALUES {self._values(True)} AS t({', '.join(n for n, _ in columns)})")

    def sql(self) -> str:
        columns = [c.strip().split(" ") for c in self.schema.split(",")]
        select = ", ".join(f"CAST({n} AS {self.SQL[t]}) AS {n}" for n, t in columns)
        return f"(SELECT {select} FROM (VALUES {self._values(False)}) AS t({', '.join(n for n, _ in columns)}))"

    def _values(self, spark: bool) -> str:
        def one(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, str):
                if spark:
                    v = v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
                    return f"'{v}'"
                parts = [f"'{p}'" for p in v.replace("'", "''").split("\n")]
                return "(" + " || chr(10) || ".join(parts) + ")"
            if isinstance(v, float):
                return f"CAST({v!r} AS DOUBLE)"
            return repr(v)

        return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in self.rows)
