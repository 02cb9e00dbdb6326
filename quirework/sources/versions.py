"""Sets of files that are written together: all of a write's files become the current version at once, or none.

Tasks write their files and a list of them into a folder of the write's own. The commit records the lists of the tasks and only
then, as its last step, names the write as the current one in a single small file. Whoever reads sees the version that file
names; a write that fails leaves it as it was and takes its folder away.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "versioned_files"
#: Files whose names a task holds before it adds them to its list.
HELD_FILES = 4096
CURRENT = "CURRENT"
LISTED = "name string, path string, size long, sha256 string"
_LISTED = pa.schema([("name", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("sha256", pa.string())])


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: the path of its list, and how many files that names."""

    listing: str
    files: int


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _put(path: str, data: bytes) -> None:
    filesystem, place = _at(path)
    filesystem.create_dir(place.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(place) as out:
        out.write(data)


class Writer(DataSourceWriter):
    """One write. Attempts of a task write to folders of their own, so a repeated one leaves nothing in another's."""

    def __init__(self, root: str):
        self.root, self.run = root.rstrip("/"), uuid.uuid4().hex
        self.top = f"{self.root}/versions/{self.run}"

    def write(self, iterator: Iterator) -> Written:
        folder, files = f"{self.top}/{uuid.uuid4().hex}", 0
        listing = f"{folder}.parquet"
        filesystem, place = _at(listing)
        lists = self._written(folder, iterator)
        first = next(lists)
        filesystem.create_dir(place.rpartition("/")[0], recursive=True)
        with filesystem.open_output_stream(place) as out, pq.ParquetWriter(out, _LISTED) as named:
            for some in itertools.chain([first], lists):
                named.write_table(some)
                files += some.num_rows
        return Written(listing, files)

    def _written(self, folder: str, iterator: Iterator) -> Iterator[pa.Table]:
        """The names of files that were written, HELD_FILES at a time; at least one table, which may be empty."""
        listed = []
        for row in iterator:
            name, content = row["name"], row["content"]
            if not name or ".." in name.split("/") or name.startswith("/"):
                raise ValueError(f"not the name of a file in a set: {name!r}")
            data = content.encode("utf-8") if isinstance(content, str) else bytes(content or b"")
            _put(f"{folder}/{name}", data)
            listed.append({"name": name, "path": f"{folder}/{name}", "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            if len(listed) >= HELD_FILES:
                yield pa.Table.from_pylist(listed, _LISTED)
                listed = []
        yield pa.Table.from_pylist(listed, _LISTED)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The lists first, the name of the version last."""
        done = [m for m in messages if m is not None]
        _put(f"{self.top}/LISTINGS", "\n".join(m.listing for m in done).encode())
        _put(f"{self.root}/{CURRENT}", json.dumps({"run": self.run, "files": sum(m.files for m in done)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        filesystem, place = _at(self.top)
        if filesystem.get_file_info(place).type != pafs.FileType.NotFound:
            filesystem.delete_dir(place)


class VersionedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_version(files: DataFrame, root: str) -> None:
    """Writes (name, content) as the current version of the set of files at root, a folder that all machines share.

    Names are paths within the set; of a repeated name the version has several files, so give each once. Content is text or
    bytes, null being an empty file. Rows are written where they are: no shuffle, and only a path a task comes to the driver.
    """
    files.sparkSession.dataSource.register(VersionedFiles)
    files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode("append").option("path", root).save()


def current_version(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, size, sha256) of the files of the current version at root; no rows before the first write."""
    filesystem, place = _at(root)
    pointer = f"{place.rstrip('/')}/{CURRENT}"
    if filesystem.get_file_info(pointer).type == pafs.FileType.NotFound:
        return spark.createDataFrame([], LISTED)
    with filesystem.open_input_stream(pointer) as f:
        run = json.loads(f.read())["run"]
    with filesystem.open_input_stream(f"{place.rstrip('/')}/versions/{run}/LISTINGS") as f:
        listings = f.read().decode().split()
    return spark.read.schema(LISTED).parquet(*listings) if listings else spark.createDataFrame([], LISTED)
