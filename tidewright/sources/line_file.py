"""A source of text lines with byte offsets, as a Python DataSource for batch reads and streams."""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "offset long, body binary"
READ_LINES = 500


class Span(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def lines(path: str, start: int, stop: int | None, torn: bool = True):
    """(offset of the next line, line) of lines that begin in [start, stop). An offset inside a line begins at the next one.

    ``torn``: whether a last line without its newline counts. In a stream it does not: its writer may not be done with it.
    """
    with open(path, "rb") as f:
        if start:
            f.seek(start - 1)
            start += len(f.readline()) - 1
            f.seek(start)
        at = start
        while stop is None or at < stop:
            line = f.readline()
            if not line or not (torn or line.endswith(b"\n")):
                return
            at += len(line)
            yield at, line.rstrip(b"\n").removesuffix(b"\r")


class LineFileReader(DataSourceReader):
    def __init__(self, path: str, span: int):
        self.path, self.span = path, span

    def partitions(self):
        size = os.path.getsize(self.path)
        return [Span(self.path, at, min(size, at + self.span)) for at in range(0, size, self.span)] or [Span(self.path, 0, 0)]

    def read(self, partition):
        yield from lines(partition.path, partition.start, partition.stop)


class LineFileStream(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {"offset": 0}

    def read(self, start):
        rows = []
        for row in lines(self.path, start["offset"], None, torn=False):
            rows.append(row)
            if len(rows) == READ_LINES:
                break
        return iter(rows), {"offset": rows[-1][0] if rows else start["offset"]}

    def readBetweenOffsets(self, start, end):
        return lines(self.path, start["offset"], end["offset"], torn=False)


class LineFile(DataSource):
    @classmethod
    def name(cls):
        return "line_file"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LineFileReader(self.options["path"], int(self.options.get("span", 32 << 20)))

    def simpleStreamReader(self, schema):
        return LineFileStream(self.options["path"])
