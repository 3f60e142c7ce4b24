"""A data source of keyed records (S05 to S08): alignments, parameter tables.

``spark.read.format("keyed_records")`` and ``df.write.format("keyed_records")``
after ``register(spark)``. Records are JSON lines in parts; a manifest lists the
parts of a version with the range of their keys.

* Writing: each task writes parts of its own into a folder of the job, of about
  ``part_bytes``. A job is committed by one rename of its manifest; until then
  nobody reads its parts. A job that fails removes its folder. Overwriting
  removes the parts of earlier versions after the commit. One job at a time may
  write to a path.
* Reading: parts whose key range can't meet the filters are left out; the others
  are split by bytes, every split is a partition. Spark applies all filters again.

Options: ``path`` (all executors reach it), ``key`` (column of the key ranges,
``index`` unless given), ``split_bytes``, ``part_bytes``. Without a schema of the
user's, reading takes that of the manifest. Null keys count for no range and are
never left out.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "keyed_records"


def _files(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; paths without a scheme are local to the machine."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path).rstrip("/"))


@dataclass
class Part(WriterCommitMessage):
    """A part: name below the path, sizes, least and greatest key, null keys."""

    name: str
    size: int
    rows: int
    least: int | float | str | None
    greatest: int | float | str | None
    nulls: int


@dataclass
class Parts(WriterCommitMessage):
    parts: list[Part]


@dataclass
class Split(InputPartition):
    name: str
    begin: int
    end: int


def _manifest(path: str) -> tuple[int, dict]:
    """Version and content of the last committed manifest; 0 without one."""
    at, root = _files(path)
    found = at.get_file_info(fs.FileSelector(f"{root}/_manifests", allow_not_found=True))
    versions = [int(m[1]) for f in found if (m := re.fullmatch(r"v(\d+)\.json", f.base_name))]
    if not versions:
        return 0, {"schema": None, "parts": []}
    with at.open_input_stream(f"{root}/_manifests/v{max(versions)}.json") as f:
        return max(versions), json.loads(f.read())


class KeyedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        kept = _manifest(self.options["path"])[1]["schema"]
        if kept is None:
            raise ValueError(f"no committed records at {self.options['path']}; give a schema")
        return StructType.fromJson(kept)

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.types, self.path, self.key = to_arrow_schema(schema), options["path"], options.get("key", "index")
        self.split_bytes = int(options.get("split_bytes", 32 << 20))
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)
        self.wanted = [f for f in filters if isinstance(f, kinds) and f.attribute == (self.key,)]
        return filters

    def _may_hold(self, part: dict) -> bool:
        """Whether a key in the part's range can pass every filter. The filters
        taken here pass no null, so a part of null keys alone isn't read."""
        least, greatest = part["least"], part["greatest"]
        for f in self.wanted:
            if least is None:
                return False
            values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
            if isinstance(f, (EqualTo, In)) and not any(least <= v <= greatest for v in values):
                return False
            if isinstance(f, GreaterThan) and not greatest > f.value or isinstance(f, GreaterThanOrEqual) and not greatest >= f.value:
                return False
            if isinstance(f, LessThan) and not least < f.value or isinstance(f, LessThanOrEqual) and not least <= f.value:
                return False
        return True

    def partitions(self) -> list[Split]:
        parts = [p for p in _manifest(self.path)[1]["parts"] if self._may_hold(p)]
        return [Split(p["name"], lo, min(lo + self.split_bytes, p["size"])) for p in parts for lo in range(0, p["size"], self.split_bytes)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        """The lines that begin inside the split."""
        if partition.end <= partition.begin:
            return
        at, root = _files(self.path)
        with at.open_input_file(f"{root}/{partition.name}") as f:
            # from the byte before, so that a line that begins with the split counts
            begin = max(0, partition.begin - 1)
            f.seek(begin)
            text = f.read(partition.end - begin)
            start = text.find(b"\n") + 1 if partition.begin else 0
            if partition.begin and not start:
                return  # the split lies inside one line
            more = b"" if text.endswith(b"\n") else f.read(1 << 16)
            tail = [more]
            while more and b"\n" not in more:
                tail.append(more := f.read(1 << 16))
        end = b"".join(tail)
        text = text[start:] + end[: end.find(b"\n") + 1]
        if not text:
            return
        options = pa.json.ParseOptions(explicit_schema=self.types, unexpected_field_behavior="ignore")
        table = pa.json.read_json(pa.BufferReader(text), pa.json.ReadOptions(block_size=len(text) + 1, use_threads=False), options)
        yield from table.select(self.types.names).to_batches()


class Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool) -> None:
        self.shape, self.path, self.key, self.overwrite = schema.jsonValue(), options["path"], options.get("key", "index"), overwrite
        self.part_bytes = int(options.get("part_bytes", 128 << 20))
        self.job = f"job-{uuid.uuid4().hex}"
        if self.key not in schema.names:
            raise ValueError(f"no column {self.key!r} to take key ranges from")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        at, root = _files(self.path)
        at.create_dir(f"{root}/{self.job}", recursive=True)
        parts: list[Part] = []
        out, part = None, None
        for batch in iterator:
            for lo in range(0, batch.num_rows, 4096):
                rows = batch.slice(lo, 4096)
                if out is None:
                    part = Part(f"{self.job}/{uuid.uuid4().hex}.jsonl", 0, 0, None, None, 0)
                    out = at.open_output_stream(f"{root}/{part.name}")
                text = "".join(json.dumps(r, ensure_ascii=False, allow_nan=False) + "\n" for r in rows.to_pylist()).encode()
                out.write(text)
                keys = rows.column(self.key)
                ends = pc.min_max(keys).as_py()
                part.size, part.rows, part.nulls = part.size + len(text), part.rows + rows.num_rows, part.nulls + keys.null_count
                if ends["min"] is not None:
                    part.least = ends["min"] if part.least is None else min(part.least, ends["min"])
                    part.greatest = ends["max"] if part.greatest is None else max(part.greatest, ends["max"])
                if part.size >= self.part_bytes:
                    out.close()
                    parts.append(part)
                    out = None
        if out is not None:
            out.close()
            parts.append(part)
        return Parts(parts)

    def commit(self, messages: list[Parts | None]) -> None:
        at, root = _files(self.path)
        version, last = _manifest(self.path)
        new = [asdict(p) for m in messages if m is not None for p in m.parts]
        old = [] if self.overwrite else last["parts"]
        at.create_dir(f"{root}/_manifests", recursive=True)
        draft = f"{root}/_manifests/{self.job}.draft"
        with at.open_output_stream(draft) as f:
            f.write(json.dumps({"schema": self.shape, "parts": old + new}).encode())
        at.move(draft, f"{root}/_manifests/v{version + 1}.json")
        if self.overwrite:
            for job in {p["name"].split("/")[0] for p in last["parts"]}:
                at.delete_dir(f"{root}/{job}")

    def abort(self, messages: list[Parts | None]) -> None:
        at, root = _files(self.path)
        if at.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            at.delete_dir(f"{root}/{self.job}")


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.dataSource.register(KeyedRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
