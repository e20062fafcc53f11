"""``spark.read.format("xdw")``: document files by table, and a writer of one file a row.

For folders that Python on the executors can open; scan_files and decode work on any file system.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class DocumentSource(DataSource):
    """Options: path, table, mode, includeHidden, the limits by name, filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "xdw"

    def schema(self) -> str:
        from pagelake.sources.files import ERROR, SCHEMAS

        return f"{SCHEMAS[self.options.get('table', 'objects')]}, {ERROR}"

    def reader(self, schema):
        return DocumentReader(dict(self.options))

    def writer(self, schema, overwrite):
        return DocumentWriter(dict(self.options), schema.fieldNames())


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Files]:
        top, found = self.options["path"].removeprefix("file://"), []
        for folder, _, names in os.walk(top):
            found += [os.path.join(folder, x) for x in names if x.lower().endswith((".xdw", ".xbd"))]
        n = max(1, int(self.options.get("filespertask", 64)))
        found.sort()
        return [Files(found[i : i + n]) for i in range(0, len(found), n)]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pagelake.functions import limits as lim
        from pagelake.sources.files import SCHEMAS, _rows
        from pagelake.sources.model import Document

        table, mode = self.options.get("table", "objects"), self.options.get("mode", "PERMISSIVE")
        limits, width = lim.Limits.from_options(self.options), SCHEMAS[table].count(",")  # columns after the path
        for path in partition.paths:
            try:
                with open(path, "rb") as f, lim.scope(limits):
                    rows = [(path, *r, None, None) for r in _rows(table, Document.open(f.read()), self.options.get("includehidden") == "true")]
            except Exception as e:  # noqa: BLE001
                if mode == "FAILFAST":
                    raise
                rows = [(path, *[None] * width, getattr(e, "kind", "Corrupt"), str(e)[:500])] if mode == "PERMISSIVE" else []
            yield from rows


class DocumentWriter(DataSourceWriter):
    """Rows of (name, content); on failure what this job has written is removed."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.names = options["path"].removeprefix("file://"), names

    def write(self, rows) -> Written:
        os.makedirs(self.path, exist_ok=True)
        done = []
        for r in rows:
            out = os.path.join(self.path, f"{r[0]}.xdw")
            with open(out + ".part", "wb") as f:
                f.write(bytes(r[1]))
            os.replace(out + ".part", out)
            done.append(out)
        return Written(done)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        for m in messages:
            for p in m.paths if m else []:
                if os.path.exists(p):
                    os.remove(p)


def register(spark: SparkSession) -> None:
    from pagelake.session import ship

    ship(spark)
    spark.dataSource.register(DocumentSource)
