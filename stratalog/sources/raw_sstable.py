"""The raw run file as a Spark data source: format("sstable").

One file is one run; reading yields (key, value, is_tombstone) in key order,
writing expects each partition's rows in ascending unique key order and writes
one file per partition. Paths are folders that all executors reach as files.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from stratalog.functions.layout import decode_value, encode_pointer, encode_value

SCHEMA = "key binary, value binary, is_tombstone boolean"
SUFFIX = ".data"


def encode_run(entries: Iterable[tuple[bytes, bytes | None]]) -> bytes:
    """A file from (key, value or None for a tombstone), in key order."""
    keys, values = [], []
    for key, value in entries:
        if keys and key <= keys[-1]:
            raise ValueError("keys must ascend")
        keys.append(key)
        values.append(encode_value(value))
    out, position = bytearray(b"".join(values)), 0
    at_value = []
    for v in values:
        at_value.append(encode_pointer(position, len(v)))
        position += len(v)
    at_key = []
    for k in keys:
        at_key.append(encode_pointer(position, len(k)))
        position += len(k)
    out += b"".join(keys)
    out += struct.pack("<Q", len(keys)) + b"".join(k + v for k, v in zip(at_key, at_value))
    return bytes(out + struct.pack("<Q", position))


def decode_run(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    (footer,) = struct.unpack_from("<Q", data, len(data) - 8)
    (n,) = struct.unpack_from("<Q", data, footer)
    for i in range(n):
        kp, kl, vp, vl = struct.unpack_from("<QQQQ", data, footer + 8 + 32 * i)
        yield data[kp : kp + kl], decode_value(data[vp : vp + vl])


def number_of_keys(path: str) -> int:
    """From the file's end alone."""
    with open(path, "rb") as f:
        f.seek(-8, os.SEEK_END)
        f.seek(struct.unpack("<Q", f.read(8))[0])
        return struct.unpack("<Q", f.read(8))[0]


def lookup(path: str, key: bytes) -> tuple[bool, bytes | None]:
    """(found, value) by binary search over the file's index."""
    with open(path, "rb") as f:
        f.seek(-8, os.SEEK_END)
        footer = struct.unpack("<Q", f.read(8))[0]
        f.seek(footer)
        low, high = 0, struct.unpack("<Q", f.read(8))[0]
        while low < high:
            mid = (low + high) // 2
            f.seek(footer + 8 + 32 * mid)
            kp, kl, vp, vl = struct.unpack("<QQQQ", f.read(32))
            f.seek(kp)
            there = f.read(kl)
            if there == key:
                f.seek(vp)
                return True, decode_value(f.read(vl))
            low, high = (mid + 1, high) if there < key else (low, mid)
    return False, None


def encode_files(entries: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, file): each run's entries (binary keys and values) as a raw file. A
    file is one value, so a run has to fit in a task; the store's runs do."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        pairs = ((bytes(k), None if gone else bytes(v or b"")) for k, v, gone in zip(rows["key"], rows["value"], rows["is_tombstone"]))
        return pd.DataFrame({by: [rows[by].iloc[0]], "file": [encode_run(pairs)]})

    return entries.select(by, "key", "value", "is_tombstone").groupBy(by).applyInPandas(run, f"`{by}` long, file binary")


def decode_files(files: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, key, value, is_tombstone, file_bytes) of raw files, in key order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run_id, data in zip(batch[by], batch["file"]):
                pairs = list(decode_run(bytes(data)))
                yield pd.DataFrame({by: run_id, "key": [k for k, _ in pairs], "value": [v for _, v in pairs], "is_tombstone": [v is None for _, v in pairs], "file_bytes": len(data)})

    return files.mapInPandas(run, f"`{by}` long, {SCHEMA}, file_bytes long")


def read_pointers(files: DataFrame, pointers: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, key, value, is_tombstone) of what ``pointers`` (by, key, val_pos, val_len)
    point at. Each file is opened once, in the task that has its pointers."""

    def run(pointed: pd.DataFrame, file: pd.DataFrame) -> pd.DataFrame:
        data = bytes(file["file"].iloc[0])
        values = [decode_value(data[p : p + n]) for p, n in zip(pointed["val_pos"], pointed["val_len"])]
        return pd.DataFrame({by: pointed[by], "key": pointed["key"], "value": values, "is_tombstone": [v is None for v in values]})

    sides = pointers.groupBy(by).cogroup(files.groupBy(by))
    return sides.applyInPandas(run, f"`{by}` long, {SCHEMA}")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class SSTableReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(f"{self.path}/*{SUFFIX}")) if os.path.isdir(self.path) else [self.path]
        return [_File(f) for f in files]

    def read(self, partition: _File):
        with open(partition.path, "rb") as f:
            data = f.read()
        for key, value in decode_run(data):
            yield key, value, value is None


class SSTableWriter(DataSourceWriter):
    """Files appear under their names only when all tasks have succeeded."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = f"sstable_{uuid.uuid4().hex}"
        temporary = f"{self.path}/.{name}.part"
        data = encode_run((bytes(r[0]), None if r[2] else bytes(r[1] or b"")) for r in iterator)
        with open(temporary, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        return _Written(temporary, f"{self.path}/{name}{SUFFIX}")

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.rename(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class SSTableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sstable"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SSTableReader:
        return SSTableReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SSTableWriter:
        return SSTableWriter(self.options["path"])
