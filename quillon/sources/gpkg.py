"""GeoPackage layers as a Spark data source (S4, S5, S18), with the standard library alone."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INTEGER": "bigint", "INT": "bigint", "MEDIUMINT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "BLOB": "binary"}


def wkb_of(blob: bytes | None) -> bytes | None:
    """The WKB body of a GeoPackage geometry: its header is 8 bytes and an envelope."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return bytes(blob[8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] :])


def srid_of(blob: bytes) -> int:
    return struct.unpack("<i" if blob[3] & 1 else ">i", blob[4:8])[0]


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class GpkgSource(DataSource):
    """``spark.dataSource.register(GpkgSource)``; options path, layer, rows (a partition's rows)."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _layer(self, con: sqlite3.Connection) -> tuple[str, str | None, list[tuple[str, str]]]:
        layer = self.options.get("layer") or con.execute("select table_name from gpkg_contents where data_type in ('features', 'attributes') order by table_name").fetchone()[0]
        geometry = con.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
        columns = [(r[1], r[2].upper().split("(")[0]) for r in con.execute(f'pragma table_info("{layer}")')]
        return layer, geometry[0] if geometry else None, columns

    def schema(self) -> str:
        with sqlite3.connect(self.options["path"]) as con:
            _, geometry, columns = self._layer(con)
        return ", ".join(f"`{c}` {'binary' if c == geometry else _KINDS.get(k, 'string')}" for c, k in columns)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self, schema.names)


class _Reader(DataSourceReader):
    def __init__(self, source: GpkgSource, names: list[str]):
        self.source, self.names = source, names

    def partitions(self) -> list[InputPartition]:
        step = int(self.source.options.get("rows", "100000"))
        with sqlite3.connect(self.source.options["path"]) as con:
            layer, _, _ = self.source._layer(con)
            low, high = con.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{layer}"').fetchone()
        return [_Rows(a, a + step) for a in range(low, high + 1, step)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        with sqlite3.connect(self.source.options["path"]) as con:
            layer, geometry, columns = self.source._layer(con)
            kinds = dict(columns)
            wanted = ", ".join(f'"{n}"' for n in self.names)
            for row in con.execute(f'select {wanted} from "{layer}" where rowid >= ? and rowid < ?', (partition.low, partition.high)):
                yield tuple(wkb_of(v) if n == geometry else bool(v) if kinds[n] == "BOOLEAN" and v is not None else v for n, v in zip(self.names, row, strict=True))
