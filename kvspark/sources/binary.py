"""Binary run and write-ahead files as Spark data sources (``kv_run``, ``kv_log``), and runs' siblings (``kv_index``, ``kv_bloom``).

A run file is a 13-byte header and fixed-width records in key order; a
write-ahead file is five bytes and fixed-width records in write order. Files are read
in ranges of whole records, a task each, and decoded a block at a time by a numpy record
type. Writing makes one file per task and, for a run in key order, its siblings:
``.index``, every ``PAGE``-th key with its offset, and ``.bloom``, a filter of its keys with
its size. Paths may be on any file system that ``pyarrow.fs`` knows.

Options: ``path`` (file or folder), ``key_type``, ``value_type``; for reading runs,
``verify`` (default true) raises on damaged records, ``key`` reads the page that may hold a key of
each file whose filter may hold it, and ``record`` the n-th record in key order (from 0;
negative from the end). With ``pushdown`` (default false) an equality on ``key`` does the same as the
option; it needs ``spark.sql.python.filterPushdown.enabled``. Integer keys and values of up
to 64 bits, floats, booleans and fixed-width strings are supported.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from kvspark.functions.codec import DELETE, END, LOG_BASE, LOG_END, LOG_START, PUT, RECORD_BASE, START
from kvspark.functions.hashes import CHECKSUM_SEED, hash_keys, xxh32_rows
from kvspark.functions.types import kind, token_of
from kvspark.operators.bloom import modulus, seeds, sizing

MAGIC, VERSION = b"SSTT", 1
LOG_MAGIC = b"WALF\n"
BLOCK = 50_000
#: Records in a page of the index, and in a range that one task reads.
PAGE, RANGE = 1_000, 2_000_000
#: False-positive rate of a run's filter.
ERROR_RATE = 0.2
#: Bytes of a filter that are spelled out at once, and of its text that are read at once.
SPELLED, TEXT_READ = 4_096, 16_384


class FormatError(ValueError):
    """A file is not what its options say."""


def _dtype(token: str) -> str:
    k = kind(token)
    if token.startswith("str:"):
        return f"S{k.width}"
    if token == "bool":
        return "u1"
    return ("<f" if token[0] == "f" else f">{token[0]}") + str(k.width)


def record_type(key_type: str, value_type: str) -> np.dtype:
    return np.dtype(
        [("start", "S4"), ("kw", "<u4"), ("vw", "<u4"), ("cw", "<u4"), ("key", _dtype(key_type)), ("value", _dtype(value_type)),
         ("sum", "<u4"), ("ts", "<f8"), ("deleted", "u1"), ("end", "S4")]
    )


def log_type(key_type: str, value_type: str) -> np.dtype:
    return np.dtype(
        [("start", "S4"), ("kt", "u1"), ("vt", "u1"), ("kw", "<u4"), ("vw", "<u4"), ("key", _dtype(key_type)),
         ("value", _dtype(value_type)), ("ts", "<f8"), ("method", "u1"), ("end", "S4")]
    )


def header(key_type: str, value_type: str) -> bytes:
    size = RECORD_BASE + kind(key_type).width + kind(value_type).width
    if size > 255:
        raise FormatError(f"records of {size} bytes don't fit the header's one byte")
    return bytes([7]) + MAGIC + bytes([VERSION, 0, 0, 3, kind(value_type).type_id, kind(key_type).type_id, size]) + b"\n"


def check_header(data: bytes, key_type: str, value_type: str) -> None:
    """Raise unless the header is that of a run of these types."""
    if len(data) < 13 or data[1:5] != MAGIC:
        raise FormatError("not a run file")
    if data[5] != VERSION:
        raise FormatError(f"version {data[5]} is not supported")
    if data[6] or data[7]:
        raise FormatError("compressed or encoded runs are not supported")
    for at, token, what in ((9, value_type, "value"), (10, key_type, "key")):
        if data[at] != kind(token).type_id:
            raise FormatError(f"{what} type is {token_of(data[at], kind(token).width)}, not {token}")
    if data != header(key_type, value_type):
        raise FormatError("record length differs")


def _column(values: np.ndarray, token: str, null: np.ndarray | None = None) -> pa.Array:
    if token.startswith("str:"):
        return pa.array([None if null is not None and null[i] else v.decode() for i, v in enumerate(values)], pa.string())
    if token == "u64":
        return pa.array([None if null is not None and null[i] else int(v) for i, v in enumerate(values)], pa.decimal128(20, 0))
    wide = {"u8": "i2", "u16": "i4", "u32": "i8"}.get(token, values.dtype.newbyteorder("=").str)
    out = values.astype("?" if token == "bool" else wide)
    return pa.array(out, mask=null)


def _raw(column: pa.Array, token: str) -> np.ndarray:
    """Values as the file's type; integers wrap, null is zero."""
    if token.startswith("str:"):
        width = kind(token).width
        encoded = [v or b"" for v in column.cast(pa.binary()).to_pylist()]
        if any(len(v) > width for v in encoded):
            raise FormatError(f"text longer than {width} bytes")
        return np.array(encoded, dtype=f"S{width}")
    if token == "u64":
        return np.array([int(v or 0) & (2**64 - 1) for v in column.to_pylist()], dtype=">u8")
    values = column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False)
    if token[0] == "f" or token == "bool":
        return values.astype(_dtype(token))
    return values.astype(np.int64).astype(_dtype(token))


def checksums(records: np.ndarray) -> np.ndarray:
    raw = records.view(np.uint8).reshape(len(records), -1)
    return xxh32_rows(raw[:, 16:-17], CHECKSUM_SEED).astype("<u4")


def damaged(records: np.ndarray) -> np.ndarray:
    """Records whose markers, widths or checksum are wrong."""
    key, value = records.dtype["key"].itemsize, records.dtype["value"].itemsize
    bad = (records["start"] != START) | (records["end"] != END) | (records["kw"] != key) | (records["vw"] != value)
    return bad | (records["sum"] != checksums(records))


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///", 1) if path.startswith("file:") else path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a path with a suffix, by name."""
    files, root = place(path)
    info = files.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.path.endswith(suffix) and not os.path.basename(x.path).startswith("_"))


def _text(files: pafs.FileSystem, path: str) -> str | None:
    if files.get_file_info(path).type != pafs.FileType.File:
        return None
    with files.open_input_stream(path) as f:
        return f.read().decode()


# --- siblings of a run ---


def index_text(first_keys: np.ndarray, token: str, size: int, header_bytes: int = 13) -> str:
    """``key,offset`` of the pages' first keys; texts are quoted, so that a comma in a key is none of the list."""
    spell = (lambda k: quote(k.decode(), safe="")) if token.startswith("str:") else (lambda k: str(int(k)))
    return ",".join(f"{spell(k)},{header_bytes + i * PAGE * size}" for i, k in enumerate(first_keys.tolist()))


def parse_index(text: str, token: str) -> tuple[list, list[int]]:
    """Keys (bytes or integers) and offsets."""
    parts = text.split(",") if text else []
    read = (lambda k: unquote(k).encode()) if token.startswith("str:") else int
    return [read(k) for k in parts[::2]], [int(x) for x in parts[1::2]]


def _native(keys: np.ndarray, token: str) -> np.ndarray:
    return keys if token.startswith("str:") else keys.astype(keys.dtype.newbyteorder("="))


def bit_places(keys: np.ndarray, token: str, bits: int, hashes: int) -> np.ndarray:
    """Bit numbers of keys, a column for each hash."""
    own = _native(keys, token)
    return np.column_stack([hash_keys(own, token, s) % modulus(bits) for s in seeds(hashes)])


def filter_text(n: int, keys: Iterable[np.ndarray], token: str) -> Iterator[str]:
    """``bits,hashes`` and, on a line of its own, the bytes of a filter of ``n`` keys as numbers; in pieces, from blocks of keys."""
    bits, hashes = sizing(max(1, n), ERROR_RATE)
    hashes = max(1, hashes)
    held = np.zeros(modulus(bits) // 8, np.uint8)
    for own in keys:
        at = bit_places(own, token, bits, hashes).ravel()
        np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    yield f"{bits},{hashes}\n"
    for i in range(0, len(held), SPELLED):
        yield ("," if i else "") + ",".join(map(str, held[i : i + SPELLED].tolist()))


def filter_head(files: pafs.FileSystem, path: str) -> tuple[int, int] | None:
    """(bits, hashes) of a filter file, None if there is none."""
    if files.get_file_info(path).type != pafs.FileType.File:
        return None
    with files.open_input_stream(path) as f:
        head = f.read(64)
    return tuple(map(int, head.partition(b"\n")[0].split(b","))) if head else None


def filter_bytes(files: pafs.FileSystem, path: str) -> Iterator[np.ndarray]:
    """The bytes of a filter file, some at a time, bit 0 the lowest of the first."""
    with files.open_input_stream(path) as f:
        rest = f.read(64).partition(b"\n")[2]
        while more := f.read(TEXT_READ):
            whole, comma, rest = (rest + more).rpartition(b",")
            if comma:
                yield np.array(whole.decode().split(","), dtype=np.uint8)
        if rest:
            yield np.array(rest.decode().split(","), dtype=np.uint8)


def file_stats(path: str, key_type: str, value_type: str) -> list[dict]:
    """Records, bytes, pages of the index and bits of the filter of every run file."""
    size, out = record_type(key_type, value_type).itemsize, []
    for name, n_bytes in listed(path, ".sst"):
        files, _ = place(path)
        index, head = _text(files, name.removesuffix(".sst") + ".index"), filter_head(files, name.removesuffix(".sst") + ".bloom")
        out.append({
            "file": name, "records": (n_bytes - 13) // size, "bytes": n_bytes, "pages": len(parse_index(index or "", key_type)[0]),
            "filter_bits": head[0] if head else 0,
        })
    return out


def truncate_log(path: str) -> None:
    """Cut write-ahead files to their magic."""
    for name, _ in listed(path, ".wal"):
        with place(path)[0].open_output_stream(name) as f:
            f.write(LOG_MAGIC)


# --- readers ---


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    suffix, head = "", 0

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.key_type, self.value_type = options["key_type"], options["value_type"]
        self.verify = str(options.get("verify", "true")).lower() == "true"
        self.key = options.get("key")
        self.record = options.get("record")

    def record_kind(self) -> np.dtype:
        raise NotImplementedError

    def files(self) -> list[tuple[str, int]]:
        """(path, records) of every file."""
        size, out = self.record_kind().itemsize, []
        for path, n_bytes in listed(self.path, self.suffix):
            if n_bytes < self.head or (n_bytes - self.head) % size:
                raise FormatError(f"{path} ends inside a record")
            out.append((path, (n_bytes - self.head) // size))
        return out

    def partitions(self) -> list[InputPartition]:
        return [_Range(path, a, min(RANGE, n - a)) for path, n in self.files() for a in range(0, n, RANGE)]

    def blocks(self, part: _Range | None) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first record, records) of a range, block by block; Spark asks for None where there are no ranges."""
        if part is None:
            return
        files, _ = place(self.path)
        kind_ = self.record_kind()
        with files.open_input_file(part.path) as f:
            self.check(f.read(self.head))
            f.seek(self.head + part.first * kind_.itemsize)
            for at in range(0, part.count, BLOCK):
                data = f.read(kind_.itemsize * min(BLOCK, part.count - at))
                yield part.first + at, np.frombuffer(data, kind_)

    def check(self, head: bytes) -> None:
        raise NotImplementedError


class RunReader(_Reader):
    suffix, head = ".sst", 13

    def record_kind(self) -> np.dtype:
        return record_type(self.key_type, self.value_type)

    def check(self, head: bytes) -> None:
        check_header(head, self.key_type, self.value_type)

    def _wanted(self) -> np.ndarray:
        text = self.key_type.startswith("str:")
        return np.array([str(self.key).encode() if text else int(self.key)], dtype=_dtype(self.key_type))

    def partitions(self) -> list[InputPartition]:
        if self.record is not None:
            return self._nth(int(self.record))
        if self.key is None:
            return super().partitions()
        out: list[InputPartition] = []
        files, _ = place(self.path)
        wanted = self._wanted()
        for path, n in self.files():
            base = path.removesuffix(".sst")
            head, index = filter_head(files, base + ".bloom"), _text(files, base + ".index")
            if head:
                at = bit_places(wanted, self.key_type, *head).ravel()
                if not (np.concatenate(list(filter_bytes(files, base + ".bloom")))[at >> 3] >> (at & 7) & 1).all():
                    continue
            if index is None:
                out += [_Range(path, a, min(RANGE, n - a)) for a in range(0, n, RANGE)]
                continue
            keys, offsets = parse_index(index, self.key_type)
            # A key that is written twice may begin in the page before the one that it begins.
            value = wanted[0] if self.key_type.startswith("str:") else int(wanted[0])
            first = max(0, sum(k < value for k in keys) - 1)
            last = sum(k <= value for k in keys)
            if last:
                a = (offsets[first] - 13) // self.record_kind().itemsize
                b = (offsets[last] - 13) // self.record_kind().itemsize if last < len(offsets) else n
                out.append(_Range(path, a, b - a))
        return out

    def _nth(self, n: int) -> list[InputPartition]:
        """The range of one record, where files follow each other by their first keys."""
        files, _ = place(self.path)
        first = lambda path: parse_index(_text(files, path.removesuffix(".sst") + ".index") or "", self.key_type)[0][:1]
        ordered = sorted((x for x in self.files() if x[1]), key=lambda x: (first(x[0]), x[0]))
        n = n if n >= 0 else n + sum(k for _, k in ordered)
        for path, k in ordered:
            if 0 <= n < k:
                return [_Range(path, n, 1)]
            n -= k
        return []

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for _, block in self.blocks(partition):
            if self.verify and damaged(block).any():
                raise FormatError(f"damaged record in {partition.path}")
            if self.key is not None:
                block = block[block["key"] == self._wanted()[0]]
            gone = block["deleted"] == 1
            yield pa.RecordBatch.from_arrays(
                [_column(block["key"], self.key_type), _column(block["value"], self.value_type, gone), pa.array(block["ts"].astype("f8")), pa.array(gone)],
                names=["key", "value", "ts_ms", "deleted"],
            )


class PushedRunReader(RunReader):
    """Takes a key from a filter; only for sessions that push filters to Python sources, others refuse such a reader."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",) and f.value is not None and self.key is None:
                self.key = f.value
            yield f  # a page holds other keys too, so Spark filters again


class LogReader(_Reader):
    suffix, head = ".wal", 5

    def record_kind(self) -> np.dtype:
        return log_type(self.key_type, self.value_type)

    def check(self, head: bytes) -> None:
        if head != LOG_MAGIC:
            raise FormatError("not a write-ahead file")

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for seq, block in self.blocks(partition):
            if (block["start"] != LOG_START).any() or (block["end"] != LOG_END).any():
                raise FormatError(f"damaged record in {partition.path}")
            gone = block["method"] == DELETE
            yield pa.RecordBatch.from_arrays(
                [_column(block["key"], self.key_type), _column(block["value"], self.value_type, gone), pa.array(block["ts"].astype("f8")),
                 pa.array(gone), pa.array(np.arange(seq, seq + len(block)))],
                names=["key", "value", "ts_ms", "deleted", "seq"],
            )


class _SiblingReader(DataSourceReader):
    def __init__(self, options: dict, suffix: str) -> None:
        self.path, self.key_type, self.suffix = options["path"], options["key_type"], suffix

    def partitions(self) -> list[InputPartition]:
        return [_Range(path, 0, 1) for path, _ in listed(self.path, self.suffix)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, _ = place(self.path)
        if self.suffix == ".index":
            keys, offsets = parse_index(_text(files, partition.path) or "", self.key_type)
            column = pa.array([k.decode() for k in keys], pa.string()) if self.key_type.startswith("str:") else _column(np.array(keys, _dtype(self.key_type)), self.key_type)
            columns = [pa.array(range(len(keys)), pa.int64()), column, pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.repeat(partition.path, len(keys)), *columns], names=["file", "page", "first_key", "offset"])
            return
        head = filter_head(files, partition.path)
        if head is None:
            raise FormatError(f"{partition.path} is not a filter")
        first = 0
        for held in filter_bytes(files, partition.path):
            at = np.flatnonzero(np.unpackbits(held, bitorder="little")) + first
            first += 8 * len(held)
            columns = [pa.repeat(partition.path, len(at)), pa.array(np.full(len(at), head[0])), pa.array(np.full(len(at), head[1], np.int32)), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "bits", "hashes", "bit"])


# --- writers ---


class _Writer(DataSourceArrowWriter):
    suffix = ""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.key_type, self.value_type = options["key_type"], options["value_type"]

    def head(self) -> bytes:
        raise NotImplementedError

    def records(self, batch: pa.RecordBatch) -> np.ndarray:
        raise NotImplementedError

    def look(self, records: np.ndarray) -> None:
        """Called with the records of every batch, for ``siblings``."""

    def siblings(self, files: pafs.FileSystem, path: str) -> dict[str, Iterable[str]]:
        """What stands beside the file that has been written to ``path``, by suffix, in pieces."""
        return {}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = place(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        with files.open_output_stream(f"{root}/_{name}{self.suffix}") as f:
            f.write(self.head())
            for batch in iterator:
                records = self.records(batch)
                self.look(records)
                f.write(records.tobytes())
        message = WriterCommitMessage()
        message.names = [name + self.suffix]
        for suffix, pieces in self.siblings(files, f"{root}/_{name}{self.suffix}").items():
            with files.open_output_stream(f"{root}/_{name}{suffix}") as f:
                for text in pieces:
                    f.write(text.encode())
            message.names.append(name + suffix)
        return message

    def commit(self, messages: list) -> None:
        files, root = place(self.path)
        if self.overwrite:
            for suffix in (self.suffix, ".index", ".bloom"):
                for path, _ in listed(self.path, suffix):
                    files.delete_file(path)
        # Siblings first: a run that can be seen has its index and filter.
        for m in messages:
            for name in reversed(m.names if m is not None else []):
                files.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list) -> None:
        files, root = place(self.path)
        for m in messages:
            for name in m.names if m is not None else []:
                if files.get_file_info(f"{root}/_{name}").type == pafs.FileType.File:
                    files.delete_file(f"{root}/_{name}")


class RunWriter(_Writer):
    suffix = ".sst"

    def head(self) -> bytes:
        return header(self.key_type, self.value_type)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        none = np.zeros(0, _dtype(self.key_type))
        self.count, self.ordered, self.last, self.first_keys = 0, True, none, [none]
        return super().write(iterator)

    def look(self, records: np.ndarray) -> None:
        own = np.concatenate([self.last, records["key"]])
        self.ordered = self.ordered and bool((own[1:] >= own[:-1]).all())
        self.first_keys.append(records["key"][-self.count % PAGE :: PAGE].copy())
        self.last, self.count = own[-1:], self.count + len(records)

    def siblings(self, files: pafs.FileSystem, path: str) -> dict[str, Iterable[str]]:
        out: dict[str, Iterable[str]] = {".bloom": filter_text(self.count, self._keys(files, path), self.key_type)}
        if self.ordered:
            out[".index"] = [index_text(np.concatenate(self.first_keys), self.key_type, record_type(self.key_type, self.value_type).itemsize)]
        return out

    def _keys(self, files: pafs.FileSystem, path: str) -> Iterator[np.ndarray]:
        """The keys of a file, a block at a time: the filter's size follows from their number, so they are read again."""
        kind_ = record_type(self.key_type, self.value_type)
        with files.open_input_stream(path) as f:
            f.read(len(self.head()))
            while data := f.read(kind_.itemsize * BLOCK):
                yield np.frombuffer(data, kind_)["key"]

    def records(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, record_type(self.key_type, self.value_type))
        out["start"], out["end"], out["cw"] = START, END, 4
        out["kw"], out["vw"] = kind(self.key_type).width, kind(self.value_type).width
        for name, token in (("key", self.key_type), ("value", self.value_type)):
            out[name] = _raw(batch.column(batch.schema.get_field_index(name)), token)
        out["ts"] = batch.column(batch.schema.get_field_index("ts_ms")).to_numpy(zero_copy_only=False)
        out["deleted"] = batch.column(batch.schema.get_field_index("deleted")).to_numpy(zero_copy_only=False)
        out["sum"] = checksums(out)
        return out


class LogWriter(_Writer):
    suffix = ".wal"

    def head(self) -> bytes:
        return LOG_MAGIC

    def records(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, log_type(self.key_type, self.value_type))
        out["start"], out["end"] = LOG_START, LOG_END
        out["kt"], out["vt"] = kind(self.key_type).type_id, kind(self.value_type).type_id
        out["kw"], out["vw"] = kind(self.key_type).width, kind(self.value_type).width
        for name, token in (("key", self.key_type), ("value", self.value_type)):
            out[name] = _raw(batch.column(batch.schema.get_field_index(name)), token)
        out["ts"] = batch.column(batch.schema.get_field_index("ts_ms")).to_numpy(zero_copy_only=False)
        gone = batch.column(batch.schema.get_field_index("deleted")).to_numpy(zero_copy_only=False).astype(bool)
        out["method"] = np.where(gone, DELETE, PUT)
        return out


class _Source(DataSource):
    def _schema(self, *more: str) -> str:
        types = [kind(self.options[f"{n}_type"]).spark.simpleString() for n in ("key", "value")]
        return ", ".join([f"key {types[0]}", f"value {types[1]}", "ts_ms double", "deleted boolean", *more])


class RunSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "kv_run"

    def schema(self) -> str:
        return self._schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        push = str(self.options.get("pushdown", "false")).lower() == "true"
        return (PushedRunReader if push else RunReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RunWriter(self.options, overwrite)


class LogSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "kv_log"

    def schema(self) -> str:
        return self._schema("seq long")

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return LogWriter(self.options, overwrite)


class IndexSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "kv_index"

    def schema(self) -> str:
        return f"file string, page long, first_key {kind(self.options['key_type']).spark.simpleString()}, offset long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SiblingReader(self.options, ".index")


class FilterSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "kv_bloom"

    def schema(self) -> str:
        return "file string, bits long, hashes int, bit long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SiblingReader(self.options, ".bloom")


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    for source in (RunSource, LogSource, IndexSource, FilterSource):
        spark.dataSource.register(source)


assert LOG_BASE == log_type("u8", "u8").itemsize - 2 and RECORD_BASE == record_type("u8", "u8").itemsize - 2
