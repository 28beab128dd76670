"""Arrow IPC shards as a Spark data source.

A shard in the file format is a partition for each record batch, and only the wanted columns of it are read; one in the stream
format is a partition of its own, read a batch at a time. The schema comes from the first shard's footer (or head), so no
shard is ever whole in memory or on the driver, and shards may be larger than 2 GB. Filters on plain columns are tried on
Arrow columns before rows leave the reader.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Rows that leave a reader at once.
ROWS = 10_000
_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def _open(path: str):
    """A file that can be read in places: mapped if it is local, else through Arrow's file systems."""
    if path.startswith("/") or path.startswith("file:"):
        return pa.memory_map("/" + path.removeprefix("file:").lstrip("/"))
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def _shards(folder: str, suffix: str) -> list[str]:
    """Shards of a folder in the order of their names; names that begin with . or _ aren't shards."""
    if folder.startswith("/") or folder.startswith("file:"):
        store, inside, head = fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/"), ""
    else:
        store, inside = fs.FileSystem.from_uri(folder)
        head = folder[: len(folder) - len(inside)]
    found = [f.path for f in store.get_file_info(fs.FileSelector(inside)) if f.type == fs.FileType.File and f.path.endswith(suffix) and f.base_name[0] not in "._"]
    return [head + p for p in sorted(found)]


def _is_file_format(source) -> bool:
    source.seek(0)
    return source.read(6) == b"ARROW1"


@dataclass
class Part(InputPartition):
    """A record batch of a shard, or a whole shard in the stream format (batch None)."""

    shard: str
    batch: int | None


class ArrowShards(DataSource):
    """format("arrow_shards"). Options: path (a folder), columns (a comma-separated list, all by default), suffix (.arrow)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def _paths(self) -> list[str]:
        found = _shards(self.options["path"], self.options.get("suffix", ".arrow"))
        if not found:
            raise ValueError(f"no shards in {self.options['path']}")
        return found

    def schema(self) -> T.StructType:
        with _open(self._paths()[0]) as source:
            known = pa.ipc.open_file(source).schema if _is_file_format(source) else pa.ipc.open_stream(_rewound(source)).schema
        fields = {f.name: f for f in from_arrow_schema(known).fields}
        wanted = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else list(fields)
        missing = [c for c in wanted if c not in fields]
        if missing:
            raise ValueError(f"shards have no column {', '.join(missing)}")
        return T.StructType([T.StructField("shard", T.StringType()), T.StructField("batch", T.IntegerType()), T.StructField("row", T.LongType()), *[fields[c] for c in wanted]])

    def reader(self, schema: T.StructType) -> ArrowReader:
        return ArrowReader(self._paths(), schema)


def _rewound(source):
    source.seek(0)
    return source


class ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: T.StructType):
        self.paths, self.schema, self.filters = paths, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of a column with a value; the others go back to Spark."""
        for f in filters:
            plain = getattr(f, "attribute", ()) and len(f.attribute) == 1
            if plain and isinstance(f, (*_COMPARE, In, IsNotNull, StringStartsWith)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            with _open(path) as source:
                out += [Part(path, i) for i in range(pa.ipc.open_file(source).num_record_batches)] if _is_file_format(source) else [Part(path, None)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields[3:]]
        kind = to_arrow_schema(self.schema)
        with _open(partition.shard) as source:
            if partition.batch is None:
                stream = pa.ipc.open_stream(_rewound(source))
                batches = enumerate(stream)
            else:
                known = pa.ipc.open_file(source).schema
                options = pa.ipc.IpcReadOptions(included_fields=[known.get_field_index(n) for n in names] or [0])
                batches = [(partition.batch, pa.ipc.open_file(_rewound(source), options=options).get_batch(partition.batch))]
            for number, batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    n = part.num_rows
                    place = [pa.array([partition.shard] * n, pa.string()), pa.array([number] * n, pa.int32()), pa.array(range(lo, lo + n), pa.int64())]
                    table = pa.table([*place, *[part.column(c) for c in names]], names=kind.names)
                    yield from self._kept(table).cast(kind).to_batches()

    def _kept(self, table: pa.Table) -> pa.Table:
        for f in self.filters:
            column = table[f.attribute[0]]
            if isinstance(f, IsNotNull):
                keep = pc.is_valid(column)
            elif isinstance(f, In):
                keep = pc.is_in(column, pa.array(list(f.value), column.type))
            elif isinstance(f, StringStartsWith):
                keep = pc.starts_with(column, f.value)
            else:
                keep = _COMPARE[type(f)](column, pa.scalar(f.value, column.type))
            table = table.filter(keep)
        return table


def arrow_shards(spark: SparkSession, folder: str, columns: list[str] | None = None, suffix: str = ".arrow") -> DataFrame:
    """(shard, batch, row, columns): rows of a folder's Arrow shards with their place.

    Executors must be able to open the folder: a path that they mount, or one that Arrow's file systems know. Defined cases: no shards, or a column that the
    first shard lacks, is an error; shards without rows give none; null cells stay null; a hidden file isn't a shard.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowShards)
    reader = spark.read.format("arrow_shards").option("suffix", suffix)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(folder)


def write_arrow(df: DataFrame, folder: str, batch_rows: int = ROWS) -> DataFrame:
    """Write df as Arrow file shards, one a task and non-empty partition, and return (shard, rows) of what was written.

    A shard is written under a hidden name and then renamed, so a task that runs again, or ends early, leaves no half shard under a shard's name.
    Executors must be able to write to the folder.
    """
    kind = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        if folder.startswith("/") or folder.startswith("file:"):
            store, inside = fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
        else:
            store, inside = fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():05d}.arrow"
        hidden, rows, out = f"{inside}/.{name}-{uuid.uuid4().hex}", 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store.create_dir(inside, recursive=True)
                sink = store.open_output_stream(hidden)
                out = pa.ipc.new_file(sink, kind)
            for part in pa.Table.from_batches([b]).cast(kind).to_batches(max_chunksize=batch_rows):
                out.write_batch(part)
            rows += b.num_rows
        if out is not None:
            out.close()
            sink.close()
            store.move(hidden, f"{inside}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], names=["shard", "rows"])

    written = df.mapInArrow(run, "shard string, rows long")
    return df.sparkSession.createDataFrame(written.collect(), "shard string, rows long")  # a row a task
