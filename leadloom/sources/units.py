"""User sources as a Spark data source: a unit is a partition, and reading it parses what has landed for it.

A user's adapter names its KIND, lists its units and parses one landed unit; ``register`` makes it readable as
``spark.read.format(name)`` and ``spark.readStream.format(name)``.

Filters: an adapter may say in UNIT_COLUMNS which columns are the same in all rows of a unit, and under which key of the
unit their value stands. Filters on such columns are decided on the list of units, so units that cannot match are not
asked for; Spark applies every filter again to the rows.

Streams: units are numbered in a log in a shared folder (option ``log``) as they are found: entry n lists the units of
step n, is written once and never changed. An offset is the number of an entry, so whatever a restart asks for again is
what it asked for before: no unit is lost and none is read twice. A unit that the adapter marks anew (``unit_mark``) is a
new one, as for feeds that are collected daily.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith

from leadloom.sources.jsonl_table import _file_system, _read_json, _write_json

KINDS = ("businesses", "demand")
REQUIRED = ("NAME", "KIND", "SCHEMA", "units", "unit_key", "collect_unit")
#: Units of one entry of a stream's log where the option ``maxUnitsPerTrigger`` is not given.
MOST_UNITS = 10_000


class Adapter(Protocol):
    NAME: str
    KIND: str
    SCHEMA: str

    def units(self, options: dict[str, str]) -> list[dict[str, Any]]: ...

    def unit_key(self, unit: dict[str, Any]) -> str: ...

    def collect_unit(self, unit: dict[str, Any]) -> Iterator[tuple]: ...


class UnitPartition(InputPartition):
    def __init__(self, key: str, unit: dict[str, Any]):
        super().__init__(key)
        self.unit = unit


def check_adapter(adapter: Any) -> None:
    """Raise for an adapter that lacks an attribute or names an unknown kind."""
    missing = [a for a in REQUIRED if not hasattr(adapter, a)]
    if missing:
        raise ValueError(f"adapter lacks {', '.join(missing)}")
    if adapter.KIND not in KINDS:
        raise ValueError(f"adapter kind {adapter.KIND!r} is none of {', '.join(KINDS)}")


def may_match(f: Filter, columns: dict[str, str], unit: dict[str, Any]) -> bool | None:
    """Whether rows of a unit can pass a filter; None where the unit's values do not decide it, or the filter gives null."""
    if isinstance(f, Not):
        inner = may_match(f.child, columns, unit)
        return None if inner is None else not inner
    name = f.attribute[0] if len(f.attribute) == 1 else None
    if name not in columns or columns[name] not in unit:
        return None
    have = unit[columns[name]]
    if isinstance(f, IsNull):
        return have is None
    if isinstance(f, IsNotNull):
        return have is not None
    if isinstance(f, EqualNullSafe):
        return have == f.value
    if have is None:
        return None
    if isinstance(f, In):
        return True if have in f.value else None if None in f.value else False
    if f.value is None:
        return None
    compared = {
        EqualTo: lambda a, b: a == b,
        GreaterThan: lambda a, b: a > b,
        GreaterThanOrEqual: lambda a, b: a >= b,
        LessThan: lambda a, b: a < b,
        LessThanOrEqual: lambda a, b: a <= b,
        StringStartsWith: lambda a, b: a.startswith(b),
    }.get(type(f))
    return compared(have, f.value) if compared else None


class UnitLog:
    """Numbered entries of units in a folder. An entry is moved into place whole and is never written again."""

    def __init__(self, path: str):
        self.path, self.seen, self.last = path, set(), 0

    def _entry(self, n: int) -> str:
        return posixpath.join(_file_system(self.path)[1], f"{n:012d}.json")

    def read(self, n: int) -> list[dict]:
        """Units of an entry, each with the key that it was told by."""
        return _read_json(_file_system(self.path)[0], self._entry(n)) or []

    def catch_up(self) -> None:
        """Learn what entries hold that were written before, by this reader or by another one."""
        while entry := self.read(self.last + 1):
            self.seen.update(e["key"] for e in entry)
            self.last += 1

    def add(self, found: list[tuple[str, dict]], most: int) -> int:
        """Enter units that no entry holds, ``most`` to an entry; returns the number of the last entry."""
        self.catch_up()
        new = [{"key": k, "unit": u} for k, u in {k: u for k, u in found if k not in self.seen}.items()]
        files, root = _file_system(self.path)
        files.create_dir(root, recursive=True)
        for at in range(0, len(new), most):
            aside = posixpath.join(root, f"aside-{uuid.uuid4().hex}")
            _write_json(files, aside, new[at : at + most])
            files.move(aside, self._entry(self.last + 1))
            self.catch_up()
        return self.last


def register(spark: SparkSession, adapter: Any) -> None:
    """Make an adapter's units readable, at once and as a stream; one task parses one unit."""
    check_adapter(adapter)
    # Without this setting Spark does not offer filters to sources in Python.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    class UnitReader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options, self.filters = options, []

        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
            self.filters = list(filters)
            return iter(filters)

        def partitions(self) -> list[UnitPartition]:
            columns = getattr(adapter, "UNIT_COLUMNS", {})
            wanted = [u for u in adapter.units(self.options) if all(may_match(f, columns, u) is not False for f in self.filters)]
            return [UnitPartition(adapter.unit_key(u), u) for u in wanted]

        def read(self, partition: UnitPartition) -> Iterator[tuple]:
            # Spark asks for a partition even where there is no unit.
            if partition is not None:
                yield from adapter.collect_unit(partition.unit)

    class UnitStream(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            if "log" not in options:
                raise ValueError("a stream of units needs the option log, a folder of its own that outlives it")
            self.options, self.log = options, UnitLog(options["log"])
            self.most = int(options.get("maxUnitsPerTrigger", MOST_UNITS))

        def initialOffset(self) -> dict:  # noqa: N802
            return {"entry": 0}

        def latestOffset(self) -> dict:  # noqa: N802
            mark = getattr(adapter, "unit_mark", lambda unit: "")
            return {"entry": self.log.add([(json.dumps([adapter.unit_key(u), mark(u)]), u) for u in adapter.units(self.options)], self.most)}

        def partitions(self, start: dict, end: dict) -> list[UnitPartition]:
            return [UnitPartition(e["key"], e["unit"]) for n in range(start["entry"] + 1, end["entry"] + 1) for e in self.log.read(n)]

        def read(self, partition: UnitPartition) -> Iterator[tuple]:
            yield from adapter.collect_unit(partition.unit)

    class UnitSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return adapter.NAME

        def schema(self) -> str:
            return adapter.SCHEMA

        def reader(self, schema) -> UnitReader:  # noqa: ANN001
            return UnitReader(self.options)

        def streamReader(self, schema) -> UnitStream:  # noqa: ANN001, N802
            return UnitStream(self.options)

    spark.dataSource.register(UnitSource)


class LandedUnits:
    """Adapter over landed files of JSON lines below the option ``path``: a file is a unit, a line a row.

    Files lie as ``<source>/<day>/<unit>.jsonl`` or, as Spark writes them, ``source=…/day=…/<unit>.json``.
    """

    NAME, KIND, SCHEMA = "landed_units", "demand", "source string, day string, unit string, pos long, line string"
    UNIT_COLUMNS = {"source": "source", "day": "day", "unit": "unit"}

    def units(self, options: dict[str, str]) -> list[dict[str, Any]]:
        from pyarrow import fs

        files, root = _file_system(options["path"])
        found = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = info.path.split("/")
            if info.is_file and info.base_name.endswith((".jsonl", ".json")):
                source, day, unit = parts[-3].removeprefix("source="), parts[-2].removeprefix("day="), parts[-1].rpartition(".")[0]
                found.append({"source": source, "day": day, "unit": unit, "path": info.path, "root": options["path"], "bytes": info.size})
        return sorted(found, key=lambda u: (u["day"], u["source"], u["unit"]))

    def unit_key(self, unit: dict[str, Any]) -> str:
        return "/".join((unit["source"], unit["day"], unit["unit"]))

    def collect_unit(self, unit: dict[str, Any]) -> Iterator[tuple]:
        import io

        files, _ = _file_system(unit["root"])
        with files.open_input_stream(unit["path"]) as stream:
            for pos, line in enumerate(io.TextIOWrapper(stream, "utf-8", newline="\n")):
                if line.strip():
                    yield unit["source"], unit["day"], unit["unit"], pos, line.rstrip("\n")
