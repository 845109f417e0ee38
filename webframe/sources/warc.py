"""WARC 1.0 as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

**Reading** deals archives to tasks as ranges of bytes, so that one large file is read by many tasks. A record belongs to the
range in which its gzip member (in a plain file the record itself) begins. Bytes are inflated in small pieces and records
are cut off one by one: time is linear in bytes, and a task holds one record. Archives of our own tell in their manifest
where ranges may begin and which URLs, dates and types each one holds, and filters on these open only the ranges that can
have such records. In archives of others a range looks for the next member whose content begins as a record; an archive
that holds other archives uncompressed inside its members should be read with ``split_bytes`` 0 (a file a task). Records
that can't be read become a row of type ``damaged``, after which reading goes on at the next member.

:func:`fetch` reads single records by file and offset, as a CDX has them: rows of an index are sorted by place and
each one costs its own bytes.

**Writing** gives one file or, where files rotate, several for each task, with a gzip member for each record. Files have
names that no other attempt uses, and count once the job's manifest names them, which is one file, written last: of a job
that is lost at any time either all archives are visible or none. :func:`recover` deletes what lost jobs have left.

Tasks open files through pyarrow's file systems, so the folder is a URI of a store that all executors and the driver reach,
or a path that they share.
"""

from __future__ import annotations

import base64
import contextlib
import datetime
import gzip
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

RECORD = "file string, offset long, length long, type string, id string, url string, date string, fields array<struct<name:string,value:string>>, block binary"
_ARROW = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("url", pa.string()), ("date", pa.string())]
    + [("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())]
)
#: columns whose filters are pushed, and the field that has each
PUSHED = {"type": "WARC-Type", "url": "WARC-Target-URI", "date": "WARC-Date"}
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r?\n")
_OWN_FILE = re.compile(r"-[0-9a-f]{32}-[0-9a-f]{32}\.warc(\.gz)?$")
MANIFESTS = "_manifests"
SPLIT_BYTES = 64 << 20
#: bytes that are read from a file at once, inflated at once, given on at once, and the most that a record's head may have
_READ, _FEED, _GIVE, _HEAD = 1 << 20, 1 << 13, 4 << 20, 1 << 16
_GZIP, _PLAIN = b"\x1f\x8b\x08", b"WARC/1."


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def serialize(fields: list[tuple[str, str]], block: bytes, payload_offset: int | None = None) -> bytes:
    """A record with its digests and length."""
    own = [*fields, ("WARC-Block-Digest", sha1_base32(block))]
    if payload_offset is not None:
        own.append(("WARC-Payload-Digest", sha1_base32(block[payload_offset:])))
    own.append(("Content-Length", str(len(block))))
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own).encode() + b"\r\n" + block + b"\r\n\r\n"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri.removeprefix("file:")))


# reading


@dataclass
class Found:
    """A record, or what is damaged (``fields`` is None then). ``length``: its bytes in the file, if they hold nothing else."""

    offset: int
    length: int | None
    fields: list[tuple[str, str]] | None = None
    block: bytes = b""

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.fields or () if k.lower() == name.lower()), None)


class _Damaged(ValueError):
    pass


def _cut(held: bytearray) -> tuple[int, list[tuple[str, str]], bytes] | None:
    """(size, fields, block) of the record at the begin of ``held``; None if there is more to come."""
    stop = held.find(b"\r\n\r\n", 0, _HEAD)
    if not held.startswith(_PLAIN[: len(held)]) or stop < 0 and len(held) >= _HEAD:
        raise _Damaged("no record")
    if stop < 0:
        return None
    begin = held.index(b"\n") + 1
    fields = [(k.decode("utf-8", "replace"), v.decode("utf-8", "replace")) for k, v in _FIELD.findall(bytes(held[begin : stop + 2]))]
    size = next((v for k, v in fields if k.lower() == "content-length"), "")
    if not size.isdigit():
        raise _Damaged("no length")
    end = stop + 4 + int(size)
    if len(held) < end + 4:
        return None
    if held[end : end + 4] != b"\r\n\r\n":
        raise _Damaged("no end")
    return end + 4, fields, bytes(held[stop + 4 : end])


class _Input:
    """A file's bytes by position, read in pieces of _READ."""

    def __init__(self, file, size: int):
        self.file, self.size, self.begin, self.piece = file, size, 0, memoryview(b"")

    def at(self, place: int, most: int) -> memoryview:
        """Up to ``most`` bytes from ``place`` on, none at the end of the file."""
        if not self.begin <= place < self.begin + len(self.piece):
            self.file.seek(place)
            self.begin, self.piece = place, memoryview(self.file.read(_READ))
        return self.piece[place - self.begin : place - self.begin + most]

    def whole(self, place: int, most: int) -> bytes:
        """``most`` bytes from ``place`` on, fewer only at the end of the file."""
        out = b""
        while len(out) < most and len(piece := self.at(place + len(out), most - len(out))):
            out += piece
        return out

    def find(self, mark: bytes, place: int, end: int) -> int:
        """Where ``mark`` begins first in [place, end), or -1."""
        while place < min(end, self.size):
            piece = self.at(place, _READ)
            held = bytes(piece) + self.whole(place + len(piece), len(mark) - 1)
            k = held.find(mark)
            if k >= 0:
                return place + k if place + k < end else -1
            place += len(piece)
        return -1


def _members(source: _Input, place: int, end: int) -> Iterator[Found]:
    """The records of the gzip members that begin in [place, end). What is damaged is left for the next member."""
    while 0 <= place < min(end, source.size):
        d, held, begin = zlib.decompressobj(31), bytearray(), place
        last: Found | None = None
        many = False
        try:
            while not d.eof:
                piece = source.at(place, _FEED)
                if not len(piece):
                    raise _Damaged("a member that is cut")
                held += d.decompress(piece)
                place += len(piece) - len(d.unused_data)
                while held and (made := _cut(held)):
                    if last:
                        many = True
                        yield last
                    last = Found(begin, None, made[1], made[2])
                    del held[: made[0]]
            if held:
                raise _Damaged("a member that ends inside a record")
            if last:
                last.length = None if many else place - begin
                yield last
        except (_Damaged, zlib.error):
            if last:
                yield last
            yield Found(begin, None)
            place = _next_member(source, begin + 1, end)
    if end <= place < source.size and _next_member(source, place, place + 1) < 0:
        yield Found(place, None)  # the next range looks for a member and passes over this


def _next_member(source: _Input, place: int, end: int) -> int:
    """Where the first gzip member in [place, end) begins whose content begins as a record, or -1."""
    while (place := source.find(_GZIP, place, end)) >= 0:
        with contextlib.suppress(zlib.error):
            if zlib.decompressobj(31).decompress(source.whole(place, _FEED), len(_PLAIN)) == _PLAIN:
                return place
        place += 1
    return -1


def _plain(source: _Input, place: int, end: int) -> Iterator[Found]:
    """The records of a plain file that begin in [place, end)."""
    while 0 <= place < min(end, source.size):
        held, begin = bytearray(), place
        try:
            while not (made := _cut(held)):
                piece = source.at(begin + len(held), _READ)
                if not len(piece):
                    raise _Damaged("a record that is cut")
                held += piece
            place = begin + made[0]
            yield Found(begin, made[0], made[1], made[2])
        except _Damaged:
            yield Found(begin, None)
            place = _next_plain(source, begin + 1, end)
    if end <= place < source.size and _next_plain(source, place, place + 1) < 0:
        yield Found(place, None)


def _next_plain(source: _Input, place: int, end: int) -> int:
    """Where the first record in [place, end) begins, which is a version behind an empty line and a head with type and length."""
    place = max(0, place - 4)
    while (place := source.find(b"\r\n\r\n" + _PLAIN, place, max(place, end - 4))) >= 0:
        head = source.whole(place + 4, _HEAD).split(b"\r\n\r\n", 1)[0].lower()
        if b"\r\nwarc-type:" in head and b"\r\ncontent-length:" in head:
            return place + 4
        place += 1
    return -1


def records(file, size: int, begin: int = 0, end: int | None = None, exact: bool = False) -> Iterator[Found]:
    """The records of a file that begin in [begin, end). ``exact``: one begins at ``begin``."""
    source, end = _Input(file, size), size if end is None else end
    zipped = bytes(source.at(0, 2)) == _GZIP[:2]
    if begin and not exact:
        begin = (_next_member if zipped else _next_plain)(source, begin, end)
    return (_members if zipped else _plain)(source, begin, end)


def _batches(found: Iterable[tuple[str, Found]]) -> Iterator[pa.RecordBatch]:
    """Rows of RECORD, given on whenever they hold some MB."""
    rows, held = [], 0
    for file, r in found:
        kind = "damaged" if r.fields is None else r.get("WARC-Type")
        fields = None if r.fields is None else [{"name": k, "value": v} for k, v in r.fields]
        rows.append({"file": file, "offset": r.offset, "length": r.length, "type": kind, "id": r.get("WARC-Record-ID"), "url": r.get("WARC-Target-URI"), "date": r.get("WARC-Date"), "fields": fields, "block": None if r.fields is None else r.block})
        held += len(r.block) + 500
        if held > _GIVE:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _holds(test: Filter, value: str | None) -> bool:
    """Whether a row with this value of the filter's column passes."""
    if value is None:
        return False
    of = {EqualTo: lambda: value == test.value, In: lambda: value in test.value, GreaterThan: lambda: value > test.value, GreaterThanOrEqual: lambda: value >= test.value, LessThan: lambda: value < test.value, LessThanOrEqual: lambda: value <= test.value}
    return of[type(test)]()


def _may_hold(test: Filter, low: str, high: str) -> bool:
    """Whether a value from ``low`` to ``high`` can pass."""
    if isinstance(test, (EqualTo, In)):
        return any(low <= v <= high for v in (test.value if isinstance(test, In) else [test.value]) if v is not None)
    return high > test.value if isinstance(test, GreaterThan) else high >= test.value if isinstance(test, GreaterThanOrEqual) else low < test.value if isinstance(test, LessThan) else low <= test.value


@dataclass
class _Range(InputPartition):
    file: str  # path inside its store
    size: int
    begin: int
    end: int
    exact: bool

    def __post_init__(self):
        super().__init__(None)


class WarcReader(DataSourceReader):
    """Options: path (a folder or a file), and split_bytes, of which a range has about so many (0: files aren't split)."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[Filter] = []

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        named, out = _visible(store, path), []
        for file, size in _files(store, path):
            told = named.get(file.rsplit("/", 1)[-1])
            if _OWN_FILE.search(file) and told is None:
                continue  # of a job that isn't there (yet)
            out += self._own_ranges(file, size, told) if told else self._ranges(file, size)
        return out or [_Range("", 0, 0, 0, True)]

    def _ranges(self, file: str, size: int) -> list[_Range]:
        step = self.split or size
        return [_Range(file, size, at, min(size, at + step), at == 0) for at in range(0, size, step)]

    def _own_ranges(self, file: str, size: int, blocks: list[dict]) -> list[_Range]:
        """Neighbouring blocks that the filters may need, up to split_bytes together."""
        out: list[_Range] = []
        ends = [b["at"] for b in blocks[1:]] + [size]
        for b, end in zip(blocks, ends, strict=True):
            if all(f.attribute[0] in b and _may_hold(f, *b[f.attribute[0]]) for f in self.tests):
                if out and out[-1].end == b["at"] and (not self.split or end - out[-1].begin <= self.split):
                    out[-1].end = end
                else:
                    out.append(_Range(file, size, b["at"], end, True))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return iter(())
        store, _ = _store(self.path)
        name = self.path.rsplit("://", 1)[0] + "://" + partition.file if "://" in self.path else partition.file

        def found() -> Iterator[tuple[str, Found]]:
            with store.open_input_file(partition.file) as file:
                for r in records(file, partition.size, partition.begin, partition.end, partition.exact):
                    if all(_holds(f, "damaged" if r.fields is None and f.attribute[0] == "type" else r.get(PUSHED[f.attribute[0]])) for f in self.tests):
                        yield name, r

        return _batches(found())


class FilteringWarcReader(WarcReader):
    """With filters of its own; Spark takes such a reader only where ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            plain = type(f) in (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
            values = (f.value if type(f) is In else [f.value]) if plain else []
            if plain and len(f.attribute) == 1 and f.attribute[0] in PUSHED and all(isinstance(v, str) for v in values):
                self.tests.append(f)
            else:
                yield f


def _files(store: pafs.FileSystem, path: str) -> list[tuple[str, int]]:
    """(path, size) of the archives of a folder, or of a file; what begins with _ or a dot is none."""
    info = store.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    found = store.get_file_info(pafs.FileSelector(path, recursive=True))
    inside = lambda x: x.path.removeprefix(path).split("/")
    return sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in inside(x)))


def _visible(store: pafs.FileSystem, path: str) -> dict[str, list[dict]]:
    """The blocks of each file that a manifest names, by the file's name."""
    folder = path if store.get_file_info(path).type == pafs.FileType.Directory else path.rsplit("/", 1)[0]
    out: dict[str, list[dict]] = {}
    for x in store.get_file_info(pafs.FileSelector(f"{folder}/{MANIFESTS}", allow_not_found=True)):
        if x.path.endswith(".json"):
            with store.open_input_stream(x.path) as f:
                out |= json.loads(f.read())["files"]
    return out


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """RECORD: one row for each record of the files (gzip or plain) under ``path``. ``offset`` is where its gzip member (in a
    plain file the record) begins, and ``length`` the bytes from there, null where a member holds several records. Filters on
    type, url and date are the reader's own if ``spark.sql.python.filterPushdown.enabled`` is set, else Spark's."""
    spark.dataSource.register(WarcSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("warc").option("split_bytes", str(split_bytes)).option("push_filters", push).load(path)


def fetch(index: DataFrame, folder: str, file_col: str = "file", offset_col: str = "offset") -> DataFrame:
    """RECORD of the rows of an index (file names below ``folder``, offsets): each record is read from its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        opened: dict[str, tuple] = {}

        def found(batch: pa.RecordBatch) -> Iterator[tuple[str, Found]]:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in opened:
                    for file, _ in opened.values():
                        file.close()
                    opened.clear()  # rows come by file
                    full = f"{path}/{name}"
                    opened[name] = (store.open_input_file(full), store.get_file_info(full).size)
                file, size = opened[name]
                yield name, next(records(file, size, offset, offset + 1, True))

        for batch in batches:
            yield from _batches(found(batch))

    rows = index.select(F.col(file_col).alias("file"), F.col(offset_col).cast("long").alias("offset"))
    return rows.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


# writing


@dataclass
class _Written(WriterCommitMessage):
    files: dict[str, list[dict]] = field(default_factory=dict)  # blocks by file name


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class WarcWriter(DataSourceWriter):
    """Options: path, prefix, compress, max_size, the bytes after which a file ends (0: never), and block_bytes, after which
    another block of the manifest begins."""

    def __init__(self, options: dict):
        self.folder, self.prefix, self.compress, self.max_size = options["path"].rstrip("/"), options.get("prefix", "archive"), options.get("compress", "true") == "true", int(options.get("max_size", "0"))
        self.block_bytes = int(options.get("block_bytes", SPLIT_BYTES))
        self.software = options.get("software", "webframe")
        self.job, self.date = uuid.uuid4().hex, _now()

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        store, folder = _store(self.folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store.create_dir(folder, recursive=True)
        done, out, size, info_id = _Written(), None, 0, ""
        pack = lambda data: gzip.compress(data) if self.compress else data  # noqa: E731  a member for each record

        def put(fields: list[tuple[str, str]], block: bytes, payload_offset: int | None) -> int:
            have = dict(fields)
            blocks = done.files[name]
            if not blocks or size - blocks[-1]["at"] >= self.block_bytes:
                blocks.append({"at": size})
            for column, key in PUSHED.items():
                if (v := have.get(key)) is not None:
                    low, high = blocks[-1].get(column, (v, v))
                    blocks[-1][column] = (min(low, v), max(high, v))
            return out.write(pack(serialize(fields, block, payload_offset)))

        try:
            for row in rows:
                if out is None or self.max_size and size > self.max_size:
                    if out:
                        out.close()
                    name = f"{self.prefix}-{part:05d}-{len(done.files):05d}-{self.job}-{attempt}.warc{'.gz' if self.compress else ''}"
                    done.files[name] = []
                    out, size = store.open_output_stream(f"{folder}/{name}", compression=None), 0
                    info_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
                    info = [("WARC-Type", "warcinfo"), ("Content-Type", "application/warc-fields"), ("WARC-Date", self.date), ("WARC-Record-ID", info_id), ("WARC-Filename", name)]
                    size += put(info, f"software: {self.software}\r\nformat: WARC File Format 1.0\r\n".encode(), None)
                fields = [(x["name"], x["value"]) for x in row["fields"]]
                names = {k for k, _ in fields}
                fields += [(k, v) for k, v in (("WARC-Date", self.date), ("WARC-Warcinfo-ID", info_id)) if k not in names]
                size += put(fields, bytes(row["block"]), row["payload_offset"] if "payload_offset" in row else None)
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages) -> None:
        store, folder = _store(self.folder)
        files = {name: blocks for m in messages if m for name, blocks in m.files.items()}
        store.create_dir(f"{folder}/{MANIFESTS}", recursive=True)
        # a manifest is complete when it has its name: stores put whole objects, and a move in one folder is one step
        with store.open_output_stream(f"{folder}/{MANIFESTS}/{self.job}.new", compression=None) as f:
            f.write(json.dumps({"job": self.job, "date": self.date, "files": files}).encode())
        store.move(f"{folder}/{MANIFESTS}/{self.job}.new", f"{folder}/{MANIFESTS}/{self.job}.json")

    def abort(self, messages) -> None:
        store, folder = _store(self.folder)
        if store.get_file_info(f"{folder}/{MANIFESTS}/{self.job}.json").type == pafs.FileType.NotFound:
            _delete(store, folder, lambda name: f"-{self.job}-" in name)


def _delete(store: pafs.FileSystem, folder: str, which) -> list[str]:
    gone = [p for p, _ in _files(store, folder) if which(p.rsplit("/", 1)[-1])]
    for p in gone:
        store.delete_file(p)
    return sorted(p.rsplit("/", 1)[-1] for p in gone)


def recover(folder: str) -> list[str]:
    """Deletes the archives of jobs that were lost before their manifest was written, and returns their names. To be called
    when no job writes to the folder."""
    store, path = _store(folder)
    named = _visible(store, path)
    return _delete(store, path, lambda name: bool(_OWN_FILE.search(name)) and name not in named)


class WarcSource(DataSource):
    """Rows read are RECORD; the option push_filters is for sessions that allow it. Writing needs ``fields`` and ``block``; ``payload_offset`` adds a payload digest."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return (FilteringWarcReader if self.options.get("push_filters") == "true" else WarcReader)(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def write_warc(records: DataFrame, folder: str, prefix: str = "archive", compress: bool = True, max_size: int = 0, block_bytes: int = SPLIT_BYTES) -> None:
    """``records``: fields, block and, for a payload digest, payload_offset. Each gets the id of its file's warcinfo record, and
    the time of the job where it has no date."""
    records.sparkSession.dataSource.register(WarcSource)
    out = records.write.format("warc").mode("append").option("prefix", prefix).option("compress", str(compress).lower()).option("max_size", str(max_size))
    out.option("block_bytes", str(block_bytes)).save(folder)
