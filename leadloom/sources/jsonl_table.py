"""A table of JSON lines that is replaced, or added to, as a whole.

The table is a folder. Tasks write their parts aside, below ``parts/``; the commit on the driver writes a list of the
parts that count, ``lists/<version>.json``, and then moves a new pointer ``CURRENT`` over the old one. A reader follows the
pointer, so it sees the old table or the new one and nothing between. Parts of failed tasks, of attempts that ran twice and
of writes that were given up are in no list; an abort deletes them. The last ``KEPT`` versions stay for readers that began
before a replacement.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = "jsonl_table"
#: Versions whose parts stay: the current one, and one for readers that began before it.
KEPT = 2


def _file_system(path: str):  # noqa: ANN202
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _read_json(files, path: str):  # noqa: ANN001, ANN202
    from pyarrow import fs

    if files.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(path) as stream:
        return json.loads(stream.read())


def _write_json(files, path: str, value: object) -> None:  # noqa: ANN001
    with files.open_output_stream(path) as stream:
        stream.write(json.dumps(value).encode())


def current(path: str) -> dict | None:
    """What the pointer names: ``{"version": n, "parts": [names], "rows": n}``; None where no write was committed."""
    files, root = _file_system(path)
    pointer = _read_json(files, posixpath.join(root, "CURRENT"))
    return pointer and _read_json(files, posixpath.join(root, "lists", f"{pointer['version']}.json"))


def publish(path: str, parts: list[str], rows: int, append: bool) -> int:
    """Make parts the table, or add them to it, and forget versions that are no longer kept. Returns the version."""
    files, root = _file_system(path)
    before = current(path)
    have = before or {"version": 0, "parts": [], "rows": 0}
    listed = {"version": have["version"] + 1, "parts": [*(have["parts"] if append else []), *parts], "rows": rows + (have["rows"] if append else 0)}
    files.create_dir(posixpath.join(root, "lists"), recursive=True)
    _write_json(files, posixpath.join(root, "lists", f"{listed['version']}.json"), listed)
    aside = posixpath.join(root, f"CURRENT-{uuid.uuid4().hex}")
    _write_json(files, aside, {"version": listed["version"]})
    files.move(aside, posixpath.join(root, "CURRENT"))
    _forget(files, root, listed)
    return listed["version"]


def _forget(files, root: str, listed: dict) -> None:  # noqa: ANN001
    from pyarrow import fs

    kept, gone = set(listed["parts"]), set()
    for info in files.get_file_info(fs.FileSelector(posixpath.join(root, "lists"))):
        version = int(info.base_name.removesuffix(".json"))
        names = set(_read_json(files, info.path)["parts"])
        if version <= listed["version"] - KEPT:
            gone |= names
            files.delete_file(info.path)
        else:
            kept |= names
    for name in gone - kept:
        files.delete_file(posixpath.join(root, "parts", name))


def register(spark: SparkSession) -> None:
    """Make ``write.format("jsonl_table")`` known: rows of one column of text, a line each; modes overwrite and append."""
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    class Written(WriterCommitMessage):
        def __init__(self, name: str, rows: int):
            self.name, self.rows = name, rows

    class Writer(DataSourceArrowWriter):
        def __init__(self, path: str, overwrite: bool):
            self.path, self.overwrite, self.id = path, overwrite, uuid.uuid4().hex[:12]

        def write(self, iterator: Iterator) -> WriterCommitMessage:
            """One part of one task; a name is never used by another attempt."""
            from pyspark import TaskContext

            task = TaskContext.get()
            name = f"{self.id}-{task.partitionId():05d}-{task.taskAttemptId()}.jsonl"
            files, root = _file_system(self.path)
            files.create_dir(posixpath.join(root, "parts"), recursive=True)
            rows = 0
            with files.open_output_stream(posixpath.join(root, "parts", name)) as stream:
                for batch in iterator:
                    lines = batch.column(0).drop_null().to_pylist()
                    rows += len(lines)
                    if lines:
                        stream.write(("\n".join(lines) + "\n").encode())
            return Written(name, rows)

        def commit(self, messages: list) -> None:
            """Runs on the driver once every task has ended well. Parts without rows are left out and deleted."""
            files, root = _file_system(self.path)
            written = [m for m in messages if m]
            publish(self.path, sorted(m.name for m in written if m.rows), sum(m.rows for m in written), not self.overwrite)
            self._drop({m.name for m in written if m.rows})

        def abort(self, messages: list) -> None:
            """Runs on the driver when a task has failed for good: what this write put aside goes, the table stays."""
            self._drop(set())

        def _drop(self, kept: set[str]) -> None:
            from pyarrow import fs

            files, root = _file_system(self.path)
            for info in files.get_file_info(fs.FileSelector(posixpath.join(root, "parts"), allow_not_found=True)):
                if info.base_name.startswith(f"{self.id}-") and info.base_name not in kept:
                    files.delete_file(info.path)

    class Lines(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return "value string"

        def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
            return Writer(self.options["path"], overwrite)

    spark.dataSource.register(Lines)


def write_table(rows: DataFrame, path: str, append: bool = False) -> None:
    """Replace the table at ``path`` by rows, or add them to it. Lines are made where the rows are, null fields left out.

    A write that fails leaves the table as it was. Of two writes at once the last commit counts; appends must take turns.
    """
    register(rows.sparkSession)
    lines = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))
    lines.write.format(FORMAT).mode("append" if append else "overwrite").option("path", path).save()


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of the table as of now; later replacements do not change what this frame reads. No table: no rows."""
    listed = current(path)
    if not listed or not listed["parts"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/parts/{name}" for name in listed["parts"]])
