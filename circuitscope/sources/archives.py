"""Zip archives as a data source: one archive is read by many tasks, a range of its directory each.

Only the directory at an archive's end is read to plan. A task seeks to its own members, reads their bytes and no others, unpacks each up to a limit and
checks its size and checksum. Nothing is extracted to a disk.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .copies import _opened, listed

#: Packed bytes of a task's members, about; a larger member is a task of its own.
RANGE_BYTES = 32 << 20
#: Members beyond so many unpacked bytes are an error: each is one value of a row.
MEMBER_BYTES = 256 << 20
SMALL_BYTES = 1 << 16
# Fixed values of the formats: a member's local header (its first bytes, its length, where it gives the lengths of name and extra field), and the
# first line of a large-file pointer.
_LOCAL, _LOCAL_BYTES, _LOCAL_LENGTHS = b"PK\x03\x04", 30, 26
POINTER_LINE = "version https://git-lfs.github.com/spec/v1"
MEMBERS = "archive string, member string, text string, n_bytes long"


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int


@dataclass
class MemberRange(InputPartition):
    archive: str
    members: tuple[Member, ...]


def directory(archive: str, suffix: str = "", member_bytes: int = MEMBER_BYTES) -> list[Member]:
    """The members whose names end in ``suffix``, in the order of their bytes. Names that leave a folder, encrypted members, unknown packing and
    members beyond the limit are errors, and so is a pointer file where an archive should be."""
    system, at = _opened(archive)
    with system.open_input_file(at) as file:
        if file.read(len(POINTER_LINE)) == POINTER_LINE.encode():
            raise ValueError(f"{archive} is a large-file pointer; fetch the archive itself")
        file.seek(0)
        # a small archive as a whole: seeks before the first byte, which end marks are looked for by, aren't an OSError in Arrow's files
        with zipfile.ZipFile(io.BytesIO(file.read()) if file.size() < SMALL_BYTES else file) as z:
            found = [i for i in z.infolist() if not i.is_dir() and i.filename.endswith(suffix)]
    for i in found:
        parts = i.filename.split("/")
        if ".." in parts or not parts[0]:
            raise ValueError(f"unsafe member {i.filename!r} in {archive}")
        if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"member {i.filename!r} of {archive} is encrypted or packed by a method that isn't read")
        if i.file_size > member_bytes:
            raise ValueError(f"member {i.filename!r} of {archive} has {i.file_size} bytes, the limit is {member_bytes}")
    return sorted((Member(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type) for i in found), key=lambda m: m.offset)


def unpacked(file: pa.NativeFile, member: Member) -> bytes:
    """The bytes of one member. The directory's sizes hold: a member that unpacks to more is not unpacked further."""
    file.seek(member.offset)
    header = file.read(_LOCAL_BYTES)
    if header[:4] != _LOCAL:
        raise ValueError(f"member {member.name!r} isn't where the directory says")
    file.seek(member.offset + _LOCAL_BYTES + sum(struct.unpack_from("<HH", header, _LOCAL_LENGTHS)))
    data = file.read(member.packed)
    if member.method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-zlib.MAX_WBITS).decompress(data, member.size + 1)
    if len(data) != member.size or zlib.crc32(data) != member.crc:
        raise ValueError(f"member {member.name!r} is damaged")
    return data


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.archives = json.loads(options["archives"])
        self.suffix, self.limit = options.get("suffix", ""), int(options.get("memberbytes", MEMBER_BYTES))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[MemberRange]:
        out = []
        for archive in self.archives:
            some, size = [], 0
            for m in directory(archive, self.suffix, self.limit):
                if some and size + m.packed > self.range_bytes:
                    out.append(MemberRange(archive, tuple(some)))
                    some, size = [], 0
                some.append(m)
                size += m.packed
            if some:
                out.append(MemberRange(archive, tuple(some)))
        return out or [MemberRange("", ())]

    def read(self, partition: MemberRange) -> Iterator[tuple]:
        if not partition.members:
            return
        system, at = _opened(partition.archive)
        with system.open_input_file(at) as file:
            for m in partition.members:
                yield partition.archive, m.name, unpacked(file, m).decode(), m.size


class ZipMembers(DataSource):
    """Format ``zip_members``: text members of zip archives. Options: ``archives`` (paths as JSON), ``suffix``, ``memberBytes``, ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ZipReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


def read_members(spark: SparkSession, archive: str, suffix: str = "", range_bytes: int = RANGE_BYTES, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """(archive, member, text, n_bytes) of a zip archive, or of all that a pattern matches; a path that matches nothing gives no row."""
    folder, _, pattern = archive.rpartition("/")
    paths = [r.source for r in listed(spark, folder or ".", pattern).collect()]  # names of archives
    spark.dataSource.register(ZipMembers)
    reader = spark.read.format("zip_members").option("archives", json.dumps(paths)).option("suffix", suffix)
    return reader.option("rangeBytes", range_bytes).option("memberBytes", member_bytes).load()


def pointer(text: str | Column) -> Column:
    """(oid, size) of a text that is a large-file pointer, null for any other: what stands where the content wasn't fetched."""
    text = F.col(text) if isinstance(text, str) else text
    line = lambda pattern: F.regexp_extract(text, pattern, 1)
    return F.when(text.startswith(POINTER_LINE + "\n"), F.struct(line(r"\noid sha256:([0-9a-f]{64})").alias("oid"), line(r"\nsize (\d{1,18})").try_cast("long").alias("size")))
