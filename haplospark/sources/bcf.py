"""Binary VCF as the lines of the text format, so that one reader serves both."""

from __future__ import annotations

import gzip
import io
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: struct codes, missing values and ends of vectors by type number.
INTEGERS = {1: ("b", -128, -127), 2: ("h", -32768, -32767), 3: ("i", -(2**31), -(2**31) + 1)}
FLOAT, CHAR = 5, 7
FLOAT_MISSING, FLOAT_END = 0x7F800001, 0x7F800002


class _Cursor:
    """Typed values of one part of a record, in order."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def plain(self, code: str) -> tuple:
        out = struct.unpack_from("<" + code, self.data, self.at)
        self.at += struct.calcsize("<" + code)
        return out

    def kind(self) -> tuple[int, int]:
        """Type number and length of the value that follows."""
        (head,) = self.plain("B")
        size = head >> 4
        if size == 15:
            size = self.value(*self.kind())[0]
        return head & 15, size

    def value(self, kind: int, size: int) -> list | str:
        """Numbers without the end marks, None where missing; or text."""
        if kind == CHAR:
            text = self.data[self.at : self.at + size].split(b"\0")[0].decode()
            self.at += size
            return text
        if kind == FLOAT:
            bits = self.plain(f"{size}I")
            return [None if b == FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", b))[0] for b in bits if b != FLOAT_END]
        if kind in INTEGERS:
            code, missing, end = INTEGERS[kind]
            return [None if x == missing else x for x in self.plain(f"{size}{code}") if x != end]
        return []

    def typed(self) -> list | str:
        return self.value(*self.kind())


def _dictionaries(header: str) -> tuple[dict[int, str], dict[int, str]]:
    """Names of filters and tags, and of contigs, by their numbers."""
    names, contigs = {0: "PASS"}, {}
    for kind, body in re.findall(r"^##(FILTER|INFO|FORMAT|contig)=<(.*)>$", header, re.M):
        name, number = re.search(r"ID=([^,]+)", body)[1], re.search(r"IDX=(\d+)", body)
        of = contigs if kind == "contig" else names
        if number or name not in of.values():
            of[int(number[1]) if number else len(of)] = name
    return names, contigs


def _number(x: float | int | None) -> str:
    return "." if x is None else f"{x:g}" if isinstance(x, float) else str(x)


def _genotype(codes: list) -> str:
    """Alleles as text; a code holds the allele's number plus one, and whether it is phased, in its last bit."""
    out = ""
    for i, c in enumerate(codes):
        out += ("|" if c & 1 else "/") * (i > 0) + ("." if c is None or c >> 1 == 0 else str((c >> 1) - 1))
    return out or "."


def lines_of(stream: BinaryIO) -> Iterator[str]:
    """Header and records of a decompressed file, one sample."""
    if stream.read(5) != b"BCF\2\2":
        raise ValueError("not a BCF file of version 2.2")
    header = stream.read(struct.unpack("<I", stream.read(4))[0]).rstrip(b"\0").decode()
    yield from header.splitlines()
    names, contigs = _dictionaries(header)
    while head := stream.read(8):
        shared, own = (_Cursor(stream.read(n)) for n in struct.unpack("<II", head))
        contig, pos, _, qual, alleles, formats = shared.plain("iiiIII")
        id_ = shared.typed()
        texts = [shared.typed() for _ in range(alleles >> 16)]
        filters = [names[i] for i in shared.typed()]
        keys, values = [], []
        for _ in range(formats >> 24):
            key = names[own.typed()[0]]
            kind, size = own.kind()
            value = own.value(kind, size)
            for _ in range((formats & 0xFFFFFF) - 1):
                own.value(kind, size)
            keys.append(key)
            values.append(_genotype(value) if key == "GT" else value if isinstance(value, str) else ",".join(map(_number, value)) or ".")
        quality = "." if qual == FLOAT_MISSING else _number(struct.unpack("<f", struct.pack("<I", qual))[0])
        yield "\t".join([contigs[contig], str(pos + 1), id_ or ".", texts[0], ",".join(texts[1:]) or ".", quality, ";".join(filters) or ".", ".", ":".join(keys), ":".join(values)])


def bcf_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a binary file, compressed by blocks or not.  One task reads a file, of 2 GB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data, part = content.as_py(), []
                for line in lines_of(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)):
                    part.append(line)
                    if len(part) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["value"])
                        part = []
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")
