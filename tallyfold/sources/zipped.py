"""CSV files inside zip archives, read without unpacking them first.

Each member is a task. It is inflated and parsed in pieces of bounded size, so a member may be larger than memory.
Archives are opened through Arrow's file systems (local, HDFS, S3, GCS): the listing and each
member need only the parts of the archive that hold them.
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes parsed at a time.
PIECE_BYTES = 1 << 20


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


def _opened(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, place


def _archives(path: str) -> list[str]:
    """The path itself, or the archives of a folder."""
    from pyarrow import fs

    system, place = _opened(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(place))
    names = sorted(i.base_name for i in found if i.is_file and i.base_name.lower().endswith(".zip"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


class ZipCsvReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)
        self.path, self.members = options["path"], options.get("members", "*")
        self.sep, self.newlines = options.get("sep", ","), options.get("quotednewlines", "false").lower() == "true"
        self.piece = int(options.get("piecebytes", PIECE_BYTES))

    def partitions(self) -> list[Member]:
        out = []
        for path in _archives(self.path):
            system, place = _opened(path)
            with system.open_input_file(place) as file, zipfile.ZipFile(file) as archive:
                out += [Member(path, i.filename) for i in archive.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename, self.members)]
        return out

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv

        if partition is None:  # no member matched
            return
        system, place = _opened(partition.path)
        with system.open_input_file(place) as file, zipfile.ZipFile(file) as archive, archive.open(partition.name) as member:
            if not archive.getinfo(partition.name).file_size:
                return
            pieces = csv.open_csv(
                pa.PythonFile(member, mode="r"),
                read_options=csv.ReadOptions(block_size=self.piece, use_threads=False),
                parse_options=csv.ParseOptions(delimiter=self.sep, double_quote=True, newlines_in_values=self.newlines),
                convert_options=csv.ConvertOptions(
                    column_types={f.name: f.type for f in self.schema}, include_columns=self.schema.names,
                    strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""]))
            for batch in pieces:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, self.schema)], schema=self.schema)


class ZipCsv(DataSource):
    """``spark.read.format("zipcsv")`` with ``path`` (an archive or a folder of them), ``members`` (a pattern of names),
    ``sep``, ``quotedNewlines`` and ``pieceBytes``. Columns are found by the header's names."""

    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def schema(self) -> str:
        raise ValueError("state the schema")

    def reader(self, schema: StructType) -> ZipCsvReader:
        return ZipCsvReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_zip_csv(
    spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", members: str = "*", quoted_newlines: bool = False,
) -> DataFrame:
    """The rows of all members that match, whose first line is a header; a value that does not fit its type fails."""
    spark.dataSource.register(ZipCsv)
    return (
        spark.read.format("zipcsv").schema(schema).option("sep", sep).option("members", members)
        .option("quotedNewlines", str(quoted_newlines).lower()).load(path)
    )
