"""Portable trace files as a Spark data source: ``spark.read.format("causeway").option("table", "steps").load(folder)``.

A file is a partition, read by one task. Filters on trace_id are pushed to the reader, which passes over files of other traces before any row is
made; they need spark.sql.python.filterPushdown.enabled. Rows are those of the file; ``artifacts.from_text`` also checks them against the model.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import ArrayType, DataType, StructType

from causeway import schema
from causeway.session import ship

TABLES = {"traces": schema.TRACES, "steps": schema.STEPS, "edges": schema.EDGES}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class TraceFile(InputPartition):
    def __init__(self, uri: str) -> None:
        super().__init__(uri)
        self.uri = uri


class TraceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "causeway"

    def schema(self) -> str:
        table = self.options.get("table", "steps")
        if table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return TraceReader(self.options, schema)


class TraceReader(DataSourceReader):
    def __init__(self, options: dict, rows: StructType) -> None:
        self.path, self.table, self.rows, self.wanted = options["path"], options.get("table", "steps"), rows, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("trace_id",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = ids if self.wanted is None else self.wanted & ids
            else:
                yield f

    def partitions(self) -> list[TraceFile]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        head = self.path.split("://", 1)[0] if "://" in self.path else "file"
        return [TraceFile(f"{head}://{f.path}") for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".json")]

    def read(self, partition: TraceFile) -> Iterator[tuple]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.uri)
        with system.open_input_stream(path, compression=None) as f:
            doc = json.loads(f.read())
        body = doc["trace"]
        trace = body["trace"]["trace_id"]
        if self.wanted is not None and trace not in self.wanted:
            return
        records = {"traces": lambda: [body["trace"]], "steps": lambda: body["steps"], "edges": lambda: [e for e in body["edges"] if e["type"] == "CAUSED_BY"]}[self.table]()
        for r in records:
            yield _shaped({"trace_id": trace} | r, self.rows)


def _shaped(value, kind: DataType):
    """A JSON value with all fields of its type, in order; what is missing is null."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(_shaped(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return [_shaped(v, kind.elementType) for v in value]
    return float(value) if kind.typeName() == "double" else value


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship(spark)
    spark.dataSource.register(TraceFiles)
    spark.conf.set(PUSHDOWN, "true")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """trace_id: the traces of a folder."""
    register(spark)
    return spark.read.format("causeway").option("table", "traces").load(path).select("trace_id").distinct()
