"""A store of vectors as half-precision shards with a manifest, as a Spark data source.

Each task writes its rows as shards of one file, ids first, then the matrix, and tells the driver what it wrote; only the driver's commit makes the manifest, so a
write that fails leaves none and takes its shards away. Readers take the shards of the manifest whose ids can meet the filter, and check each shard's hash
before they trust it. Values are rounded to 16-bit floats; a value beyond their range is an error, as rounding it would lose it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Vectors of a shard: some tens of MB.
SHARD_ROWS = 65_536
SCHEMA = "id bigint, vector array<float>"
_MANIFEST = "manifest.json"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Shard(InputPartition):
    file: str
    rows: int
    width: int
    least: int
    most: int
    sha256: str

    def __init__(self, file: str, rows: int, width: int, least: int, most: int, sha256: str) -> None:
        self.file, self.rows, self.width, self.least, self.most, self.sha256 = file, rows, width, least, most, sha256
        super().__init__(file)


@dataclass
class Written(WriterCommitMessage):
    shards: list


class VectorStore(DataSource):
    """Options: path (a folder), and `overwrite` for a folder that has a manifest already."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        files, root = _opened(self.path)
        if not overwrite and files.get_file_info(f"{root}/{_MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} holds vectors already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _opened(self.path)
        files.create_dir(root, recursive=True)
        out, held, n = [], [], 0
        for batch in iterator:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                held.append(batch.slice(at, SHARD_ROWS))
                n += held[-1].num_rows
                if n >= SHARD_ROWS:
                    out.append(self._shard(files, root, held))
                    held, n = [], 0
        if n:
            out.append(self._shard(files, root, held))
        return Written(out)

    @staticmethod
    def _shard(files: fs.FileSystem, root: str, batches: list[pa.RecordBatch]) -> dict:
        ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches])
        lists = [b.column(1) for b in batches]
        if any(b.column(0).null_count or c.null_count or c.values.null_count for b, c in zip(batches, lists)):
            raise ValueError("ids, vectors and their values must not be null")
        widths = {int(w) for c in lists for w in np.unique(np.diff(c.offsets.to_numpy()))}
        if len(widths) != 1:
            raise ValueError(f"vectors of a store have one width, not {sorted(widths)}")
        width = widths.pop()
        wide = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in lists]).astype(np.float32)
        with np.errstate(over="ignore"):
            half = wide.astype(np.float16)
        if (np.isinf(half) & np.isfinite(wide)).any():
            raise ValueError("a value is beyond the range of 16-bit floats")
        data = ids.astype("<i8").tobytes() + half.astype("<f2").tobytes()
        name = f"shard-{uuid.uuid4().hex}.bin"
        with files.open_output_stream(f"{root}/{name}") as f:
            f.write(data)
        return {"file": name, "rows": len(ids), "width": width, "least": int(ids.min()), "most": int(ids.max()), "sha256": hashlib.sha256(data).hexdigest()}

    def commit(self, messages: list[Written | None]) -> None:
        shards = sorted((s for m in messages if m is not None for s in m.shards), key=lambda s: (s["least"], s["file"]))
        widths = {s["width"] for s in shards}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError(f"vectors of a store have one width, not {sorted(widths)}")
        files, root = _opened(self.path)
        files.create_dir(root, recursive=True)
        old = json.loads(files.open_input_stream(f"{root}/{_MANIFEST}").read())["shards"] if files.get_file_info(f"{root}/{_MANIFEST}").type != fs.FileType.NotFound else []
        with files.open_output_stream(f"{root}/{_MANIFEST}.new") as f:
            f.write(json.dumps({"rows": sum(s["rows"] for s in shards), "width": next(iter(widths), 0), "shards": shards}).encode())
        files.move(f"{root}/{_MANIFEST}.new", f"{root}/{_MANIFEST}")
        for s in old:
            files.delete_file(f"{root}/{s['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        for s in (s for m in messages if m is not None for s in m.shards):
            files.delete_file(f"{root}/{s['file']}")


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.bounds = path.rstrip("/"), (-(1 << 63), (1 << 63) - 1)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the id choose shards; Spark still applies every filter to the rows."""
        low, high = self.bounds
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("id",):
                low = max(low, f.value) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else low
                high = min(high, f.value) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else high
            yield f
        self.bounds = low, high

    def partitions(self) -> list[Shard]:
        files, root = _opened(self.path)
        found = json.loads(files.open_input_stream(f"{root}/{_MANIFEST}").read())["shards"]
        return [Shard(**s) for s in found if s["least"] <= self.bounds[1] and s["most"] >= self.bounds[0]]

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a store without shards
            return
        files, root = _opened(self.path)
        data = files.open_input_stream(f"{root}/{partition.file}").read()
        if hashlib.sha256(data).hexdigest() != partition.sha256:
            raise ValueError(f"{partition.file} is not what was written")
        ids = np.frombuffer(data, "<i8", partition.rows)
        values = np.frombuffer(data, "<f2", offset=8 * partition.rows).astype(np.float32)
        step = 8192
        for at in range(0, partition.rows, step):
            n = min(step, partition.rows - at)
            own = pa.array(values[at * partition.width : (at + n) * partition.width])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + n]), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * partition.width), own)], names=["id", "vector"])


def register(spark) -> None:
    """Make the source known to a session, and let filters reach sources in Python, which Spark does not do by itself."""
    spark.dataSource.register(VectorStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
