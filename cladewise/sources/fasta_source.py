"""The format ``fasta`` for spark.read and df.write: records of byte ranges of files, so one large file is read by many tasks.

    register(spark)
    spark.read.format("fasta").option("split", 64 << 20).load(path)      # file, title, sequence
    df.write.format("fasta").option("width", 100).mode("append").save(path)

Paths are those that pyarrow's file systems open (local ones, file:, hdfs:,
s3:); ``files.fasta`` reads whatever Spark's own readers do. A record belongs to
the range in which its mark stands. Filters for titles (=, in) are applied while
reading. What tasks write counts once all of them have ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "file string, title string, sequence string"
BLOCK = 1 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _records(f, start: int, end: int) -> Iterator[bytes]:
    """Records whose mark stands in a range of bytes, without the mark."""
    base = max(0, start - 1)
    f.seek(base)
    held = bytearray(f.read(BLOCK))
    if start == 0 and held[:1] == b">":
        at = 0
    else:
        while (k := held.find(b"\n>")) < 0:
            more = f.read(BLOCK)
            if not more or base + len(held) > end:
                return
            base += len(held) - 1
            held = held[-1:] + more
        at = k + 1
    base, held = base + at, held[at:]
    while base < end:
        seen = 1
        while (k := held.find(b"\n>", seen - 1)) < 0:
            seen = len(held)
            more = f.read(BLOCK)
            if not more:
                yield bytes(held[1:])
                return
            held += more
        yield bytes(held[1:k])
        base, held = base + k + 1, held[k + 1 :]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split, self.titles = options["path"], int(options.get("split", 64 << 20)), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("title",):
                own = set(f.value) if isinstance(f, In) else {f.value}
                self.titles = own if self.titles is None else self.titles & own
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = _open(self.path)
        found = system.get_file_info(path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for x in sorted((x for x in files if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path):
            out += [Range(x.path, i, min(i + self.split, x.size)) for i in range(0, x.size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, str, str]]:
        system, _ = _open(self.path)
        name = partition.path.rsplit("/", 1)[-1]
        with system.open_input_file(partition.path) as f:
            for raw in _records(f, partition.start, partition.end):
                title, _, rest = raw.decode("utf-8", "replace").replace("\r", "").partition("\n")
                title, sequence = title.strip(" "), "".join(rest.split())
                if (title or sequence) and (self.titles is None or title in self.titles):
                    yield name, title, sequence


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class FastaWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.width, self.overwrite, self.run = options["path"], int(options.get("width", 100)), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        system, path = _open(self.path)
        system.create_dir(f"{path}/_temporary-{self.run}", recursive=True)
        to, n = f"{path}/_temporary-{self.run}/{uuid.uuid4().hex}", 0
        with system.open_output_stream(to) as f:
            for row in iterator:
                title, seq = row["title"] or "", row["sequence"] or ""
                lines = [f">{title}", *(seq[i : i + self.width] for i in range(0, len(seq), self.width))]
                f.write(("\n".join(lines) + "\n").encode())
                n += 1
        return Written(to if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = _open(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path)):
                if x.is_file:
                    system.delete_file(x.path)
        for i, m in enumerate(messages):
            if m is not None and m.path:
                system.move(m.path, f"{path}/part-{i:05d}-{self.run}.fasta")
        self._clear(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, system, path: str) -> None:
        if system.get_file_info(f"{path}/_temporary-{self.run}").type.name == "Directory":
            system.delete_dir(f"{path}/_temporary-{self.run}")


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FastaWriter:
        return FastaWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; Spark has to be told that its reader takes filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)
