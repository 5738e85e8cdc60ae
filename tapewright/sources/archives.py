"""Archives and bundles cut into records where they are read, so that every record is parsed in a task of its own."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import BUNDLE_COMPANY, BUNDLE_SHARE, STATEMENTS


class Inflated(io.RawIOBase):
    """What a packed member of an archive holds, unpacked as it is read."""

    def __init__(self, packed: bytes, method: int):
        import bz2
        import zlib

        if method not in (0, 8, 12):
            raise ValueError(f"members packed by method {method} can't be read")
        self.packed, self.at, self.left = packed, 0, b""
        self.unpack = {0: None, 8: zlib.decompressobj(-15), 12: bz2.BZ2Decompressor()}[method]

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left and self.at < len(self.packed):
            part = self.packed[self.at : self.at + (1 << 18)]
            self.at += len(part)
            self.left = self.unpack.decompress(part) if self.unpack else part
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, content of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def zip_members(files: DataFrame) -> DataFrame:
    """file, member, method, packed: the members of zip archives (path, content) as they are stored. Where they lie is read off an archive's central directory; nothing is unpacked."""

    def run(batches: Iterator) -> Iterator:
        import zipfile

        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                whole = memoryview(content.as_buffer())
                with zipfile.ZipFile(io.BytesIO(whole)) as z:
                    for m in z.infolist():
                        if m.is_dir():
                            continue
                        # the member's own header: 30 bytes, then its name and extra field, whose sizes stand at 26 and 28
                        sizes = whole[m.header_offset + 26 : m.header_offset + 30]
                        start = m.header_offset + 30 + int.from_bytes(sizes[:2], "little") + int.from_bytes(sizes[2:], "little")
                        packed = bytes(whole[start : start + m.compress_size])
                        yield pa.RecordBatch.from_pydict({"file": [name], "member": [m.filename], "method": pa.array([m.compress_type], pa.int32()), "packed": pa.array([packed], pa.binary())})

    return files.select("path", "content").mapInArrow(run, "file string, member string, method int, packed binary")


def zipped_csv(files: DataFrame, columns: list[str], tasks: int | None = None) -> DataFrame:
    """CSV files inside zip archives (path, content): file, member and the named columns as text; a column that a file lacks is null.

    Archives are cut into their members where they are read; members are dealt out to ``tasks`` tasks (as many as the
    session shuffles into), unpacked there as they are parsed, and given in batches of rows.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        import csv
        from itertools import islice

        for b in batches:
            for i in range(b.num_rows):
                one = {c: b.column(c)[i].as_py() for c in b.schema.names}
                lines = csv.DictReader(io.TextIOWrapper(io.BufferedReader(Inflated(one["packed"], one["method"])), "utf-8", errors="replace", newline=""))
                while rows := [{k.strip(): v for k, v in r.items() if k} for r in islice(lines, 10_000)]:
                    yield pa.RecordBatch.from_pydict({"file": [one["file"]] * len(rows), "member": [one["member"]] * len(rows)} | {c: pa.array([r.get(c) for r in rows], pa.string()) for c in columns})

    n = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return zip_members(files).repartition(n, "file", "member").mapInArrow(run, ", ".join(["file string", "member string", *(f"`{c}` string" for c in columns)]))


class Records:
    """Walks a JSON document of sections as it is read: (section, key, text) of each member or element of a section, or of a section that has none."""

    def __init__(self, source, chunk: int = 1 << 16):
        import codecs
        import json

        self.source, self.chunk, self.text, self.at, self.ended = source, chunk, "", 0, False
        self.decode, self.raw = codecs.getincrementaldecoder("utf-8")("replace").decode, json.JSONDecoder().raw_decode

    def more(self) -> bool:
        """Reads as much as is held, and a chunk more; so a value of any size is tried a few times only."""
        if self.ended:
            return False
        data = self.source.read(self.chunk + len(self.text) - self.at)
        self.ended = not data
        self.text, self.at = self.text[self.at :] + self.decode(data, self.ended), 0
        return True

    def peek(self) -> str:
        """The next character that is no blank, commas and colons being blanks."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n,:":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def value(self) -> str:
        """The text of the next value."""
        self.peek()
        while True:
            try:
                _, end = self.raw(self.text, self.at)
            except ValueError:
                if not self.more():
                    raise
                continue
            # a number that ends with what is held, or before a part of one, may go on
            if self.text[end : end + 1] in set(" \t\r\n,:]}") or not self.more():
                out, self.at = self.text[self.at : end], end
                return out

    def name(self) -> str:
        import json

        return json.loads(self.value())

    def inside(self, close: str) -> Iterator[None]:
        self.at += 1
        while self.peek() not in (close, ""):
            yield
        self.at += 1

    def __iter__(self) -> Iterator[tuple[str, str | None, str]]:
        if self.peek() != "{":
            return
        for _ in self.inside("}"):
            section = self.name()
            kind = self.peek()
            if kind == "{":
                for _ in self.inside("}"):
                    key = self.name()
                    yield section, key, self.value()
            elif kind == "[":
                for _ in self.inside("]"):
                    yield section, None, self.value()
            else:
                yield section, None, self.value()


def bundle_records(files: DataFrame) -> DataFrame:
    """section, key, record: the parts of (gzipped) JSON bundles (content), cut as they are read; a record is JSON text."""

    def run(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa

        for b in batches:
            for content in b.column("content"):
                raw = content.as_py()
                source = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                held, size = [], 0
                for r in Records(source):
                    held.append(r)
                    size += len(r[2])
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], ["section", "key", "record"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], ["section", "key", "record"])

    return files.select("content").mapInArrow(run, "section string, key string, record string")


def dealt(records: DataFrame) -> DataFrame:
    return records.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bundle_universe(records: DataFrame) -> DataFrame:
    """symbol, name, mcap, price, shares of the universe section."""
    return records.where("section = 'universe'").select(F.from_json("record", BUNDLE_SHARE).alias("u")).select("u.*")


def bundle_lines(records: DataFrame) -> DataFrame:
    """symbol, stmt, item, period_end, value of all companies' statements: companies are dealt out before they are parsed."""
    company = dealt(records.where("section = 'fundamentals'")).select(F.col("key").alias("symbol"), F.from_json("record", BUNDLE_COMPANY).alias("c"))
    each = F.array(*[F.struct(F.lit(s).alias("stmt"), F.col(f"c.{s}").alias("items")) for s in STATEMENTS])
    items = company.select("symbol", F.explode(each).alias("s")).select("symbol", "s.stmt", F.explode("s.items").alias("item", "values"))
    return items.select("symbol", "stmt", "item", F.explode("values").alias("d", "value")).select("symbol", "stmt", "item", F.try_to_date("d").alias("period_end"), "value")
