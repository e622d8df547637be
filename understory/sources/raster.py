"""Rasters as pixel tables: one row (mapcode, value) per valid pixel.

``mapcode`` is the 1-based linear place of a pixel, column by column. GeoTIFFs of one band, classic or BigTIFF, in
stripes or tiles, plain or compressed (deflate, LZW, PackBits, either predictor), are read in groups of segments, one
partition each. They are written in tiles that executors compress; the driver only strings the tiles together. Geometry
tags are carried over as they are. Files must be reachable by every executor.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Fixed values of the TIFF format: bytes and letter of a field type; tags in use.
_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8, 17: 8}
_FORMAT = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _BANDS, _ROWS, _COUNTS, _PREDICTOR, _KIND, _NODATA = 256, 257, 258, 259, 273, 277, 278, 279, 317, 339, 42113
_TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS = 322, 323, 324, 325
_PLAIN, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS = 1, 5, 8, 32946, 32773
#: Pixel scale, tie point, transformation and the three key tables.
GEOMETRY = (33550, 33922, 34264, 34735, 34736, 34737)
_KINDS = {1: "u", 2: "i", 3: "f"}
#: Side of the tiles that are written, and pixels that are read by one task.
TILE, TASK_PIXELS = 256, 1 << 22


@dataclass(frozen=True)
class Segment:
    """A stripe or tile: where it lies in the file and in the raster; ``rows`` x ``columns`` with padding."""

    offset: int
    count: int
    row: int
    column: int
    rows: int
    columns: int


@dataclass
class Meta:
    width: int
    height: int
    dtype: str
    nodata: float | None = None
    tags: dict[int, tuple[int, tuple | bytes]] = field(default_factory=dict)  # geometry, as found
    segments: list[Segment] = field(default_factory=list)
    compression: int = _PLAIN
    predictor: int = 1


def _tags(f, path: str) -> tuple[str, dict[int, tuple[int, tuple | bytes]]]:
    head = f.read(16)
    e = "<" if head[:2] == b"II" else ">"
    magic = struct.unpack(e + "H", head[2:4])[0]
    if head[:2] not in (b"II", b"MM") or magic not in (42, 43):
        raise ValueError(f"{path} is no TIFF")
    big = magic == 43
    at, inline = (struct.unpack(e + "Q", head[8:16])[0], 8) if big else (struct.unpack(e + "I", head[4:8])[0], 4)
    f.seek(at)
    entries = struct.unpack(e + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    layout = e + ("HHQ8s" if big else "HHI4s")
    tags: dict[int, tuple[int, tuple | bytes]] = {}
    for _ in range(entries):
        tag, kind, n, value = struct.unpack(layout, f.read(struct.calcsize(layout)))
        size, back = _BYTES.get(kind, 0) * n, f.tell()
        if size > inline:
            f.seek(struct.unpack(e + ("Q" if big else "I"), value)[0])
            value = f.read(size)
            f.seek(back)
        if kind in _FORMAT:
            tags[tag] = (kind, value[:size] if kind == 2 else struct.unpack(f"{e}{n}{_FORMAT[kind]}", value[:size]))
    return e, tags


def read_meta(path: str) -> Meta:
    with open(path, "rb") as f:
        e, tags = _tags(f, path)
    one = lambda t, d=None: tags[t][1][0] if t in tags else d
    compression = one(_COMPRESSION, _PLAIN)
    if compression not in (_PLAIN, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS) or one(_BANDS, 1) != 1 or one(_BITS, 8) % 8:
        raise ValueError(f"{path}: one band of whole bytes is read, plain or compressed by deflate, LZW or PackBits")
    w, h = one(_WIDTH), one(_HEIGHT)
    if _TILE_OFFSETS in tags:
        tw, th = one(_TILE_WIDTH), one(_TILE_HEIGHT)
        across = -(-w // tw)
        places = zip(tags[_TILE_OFFSETS][1], tags[_TILE_COUNTS][1], strict=True)
        segments = [Segment(o, n, i // across * th, i % across * tw, th, tw) for i, (o, n) in enumerate(places)]
    else:
        rows = min(one(_ROWS, h), h)
        places = zip(tags[_OFFSETS][1], tags[_COUNTS][1], strict=True)
        segments = [Segment(o, n, i * rows, 0, min(rows, h - i * rows), w) for i, (o, n) in enumerate(places)]
    nodata = float(tags[_NODATA][1].rstrip(b"\0 ").decode()) if _NODATA in tags else None
    return Meta(w, h, f"{e}{_KINDS[one(_KIND, 1)]}{one(_BITS, 8) // 8}", nodata, {t: tags[t] for t in GEOMETRY if t in tags}, segments, compression, one(_PREDICTOR, 1))


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends."""
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
    return b"".join(out)


def decode_segment(raw: bytes, s: Segment, m: Meta) -> np.ndarray:
    """The values of a stripe or tile, rows x columns."""
    dtype, n = np.dtype(m.dtype), s.rows * s.columns
    if m.compression in (_DEFLATE, _OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif m.compression == _LZW:
        raw = _lzw(raw)
    elif m.compression == _PACKBITS:
        raw = _packbits(raw)
    raw = raw[: n * dtype.itemsize]
    if m.predictor == 3:  # bytes of a row, most significant ones first, each as the difference to the one before
        b = np.cumsum(np.frombuffer(raw, np.uint8).reshape(s.rows, -1), axis=1, dtype=np.uint8)
        planes = b.reshape(s.rows, dtype.itemsize, s.columns).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(dtype.newbyteorder(">"))[:, :, 0]
    x = np.frombuffer(raw, dtype).reshape(s.rows, s.columns)
    return np.cumsum(x, axis=1, dtype=dtype.newbyteorder("=")) if m.predictor == 2 else x


def write_tiff(path: str, data: np.ndarray, like: Meta | None = None, nodata: float | None = None) -> None:
    """A small two-dimensional array (rows x columns) as a GeoTIFF with the geometry of ``like``."""
    data = np.ascontiguousarray(data)
    with TileWriter(path, Meta(data.shape[1], data.shape[0], data.dtype.str, tags=like.tags if like else {}), data.dtype.str, nodata) as w:
        for i in range(w.tiles):
            r, c = i // w.across * TILE, i % w.across * TILE
            part = data[r : r + TILE, c : c + TILE]
            w.put(i, pack_tile(np.pad(part, ((0, TILE - part.shape[0]), (0, TILE - part.shape[1])))))


def pack_tile(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes(), 6)


class TileWriter:
    """A GeoTIFF of compressed tiles that come in any order; tiles that never come hold nodata (0 without any)."""

    def __init__(self, path: str, like: Meta, dtype: str, nodata: float | None) -> None:
        self.path, self.like, self.dtype, self.nodata = path, like, np.dtype(dtype), nodata
        self.across = -(-like.width // TILE)
        self.tiles = self.across * -(-like.height // TILE)
        self.places: dict[int, tuple[int, int]] = {}

    def __enter__(self) -> TileWriter:
        Path(self.path).parent.mkdir(parents=True, exist_ok=True)
        self.f = open(self.path, "wb")  # noqa: SIM115
        self.f.write(b"\0" * 16)
        return self

    def _append(self, raw: bytes) -> tuple[int, int]:
        at = self.f.tell()
        self.f.write(raw + b"\0" * (len(raw) % 2))
        return at, len(raw)

    def put(self, tile: int, raw: bytes) -> None:
        self.places[tile] = self._append(raw)

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._finish()
        self.f.close()

    def _finish(self) -> None:
        if len(self.places) < self.tiles:
            empty = self._append(pack_tile(np.full((TILE, TILE), 0 if self.nodata is None else self.nodata, self.dtype)))
        places = [self.places[i] if i in self.places else empty for i in range(self.tiles)]
        entries: dict[int, tuple[int, tuple | bytes]] = {
            _WIDTH: (4, (self.like.width,)), _HEIGHT: (4, (self.like.height,)), _BITS: (3, (self.dtype.itemsize * 8,)), _COMPRESSION: (3, (_DEFLATE,)), 262: (3, (1,)), _BANDS: (3, (1,)),
            _TILE_WIDTH: (4, (TILE,)), _TILE_HEIGHT: (4, (TILE,)), _TILE_OFFSETS: (16, tuple(p[0] for p in places)), _TILE_COUNTS: (16, tuple(p[1] for p in places)), _KIND: (3, ({"u": 1, "i": 2, "f": 3}[self.dtype.kind],)),
        } | self.like.tags
        if self.nodata is not None:
            entries[_NODATA] = (2, f"{self.nodata:g}".encode() + b"\0")
        big = self.f.tell() > 3 << 30
        word, inline = ("Q", 8) if big else ("I", 4)
        table = []
        for tag, (k, v) in sorted(entries.items()):
            k = 4 if k == 16 and not big else k
            raw = v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_FORMAT[k]}", *v)
            value = raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack("<" + word, self._append(raw)[0])
            table.append(struct.pack("<HH" + word, tag, k, len(raw) // _BYTES[k]) + value)
        at = self.f.tell()
        self.f.write(struct.pack("<Q" if big else "<H", len(table)) + b"".join(table) + struct.pack("<" + word, 0))
        self.f.seek(0)
        self.f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at))


class _Group(InputPartition):
    def __init__(self, segments: list[Segment]) -> None:
        self.segments = segments


class RasterSource(DataSource):
    """``spark.read.format("raster").option("path", tif).load()`` -> (mapcode, value) without nodata pixels."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "mapcode long, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RasterReader(self.options)


class _RasterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.meta = options["path"], read_meta(options["path"])
        self.mask = options.get("mask", "true").lower() == "true"
        self.split = int(options.get("pixelspertask", options.get("pixelsPerTask", str(TASK_PIXELS))))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        held: list[Segment] = []
        for s in self._pieces():
            held.append(s)
            if sum(x.rows * x.columns for x in held) >= self.split:
                out.append(_Group(held))
                held = []
        return [*out, _Group(held)] if held else out

    def _pieces(self) -> Iterator[Segment]:
        """Segments; a plain one that is larger than a task is cut by rows."""
        width = np.dtype(self.meta.dtype).itemsize
        for s in self.meta.segments:
            step = max(1, self.split // s.columns)
            if self.meta.compression != _PLAIN or s.rows <= step:
                yield s
            else:
                for r in range(0, s.rows, step):
                    n = min(step, s.rows - r)
                    yield Segment(s.offset + r * s.columns * width, n * s.columns * width, s.row + r, s.column, n, s.columns)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        m = self.meta
        with open(self.path, "rb") as f:
            for s in partition.segments:
                f.seek(s.offset)
                x = decode_segment(f.read(s.count), s, m)[: m.height - s.row, : m.width - s.column].astype(float)
                row, column = np.indices(x.shape)
                code = (column.ravel() + s.column).astype(np.int64) * m.height + row.ravel() + s.row + 1
                value = x.ravel()
                keep = np.ones(len(value), bool)
                if self.mask and m.nodata is not None:
                    keep = ~np.isnan(value) if np.isnan(m.nodata) else value != m.nodata
                yield pa.RecordBatch.from_arrays([pa.array(code[keep]), pa.array(value[keep])], ["mapcode", "value"])


def read_pixels(spark: SparkSession, path: str, mask_nodata: bool = True) -> DataFrame:
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster").option("path", path).option("mask", str(mask_nodata).lower()).load()


def plot_pixels(pixels: DataFrame, attributes: DataFrame, plot_column: str = "PLT_CN") -> DataFrame:
    """Pixels of a categorical raster with the plot of their attribute row; null where there is none, or none is known.

    The attribute table has a row per category of the raster; it is broadcast by the optimiser if it is small.
    """
    rat = attributes.select(F.col("Value").cast("double").alias("value"), F.col(plot_column).cast("long").alias("plt_cn"))
    return pixels.join(rat, "value", "left").select("mapcode", "plt_cn")


def with_ecocodes(plots: DataFrame, eco_pixels: DataFrame) -> DataFrame:
    """(mapcode, plt_cn, ecocode): both rasters, pixel by pixel; they must have the same size."""
    return plots.join(eco_pixels.select("mapcode", F.col("value").cast("long").alias("ecocode")), "mapcode", "left")


def _dbf(path: str) -> tuple[list[str], list[tuple]]:
    """The columns and rows of a dBase table; deleted rows are left out."""
    raw = Path(path).read_bytes()
    n, start, size = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while raw[at] != 0x0D:
        name, kind, length, decimals = struct.unpack("<11sc4xBB", raw[at : at + 18])
        fields.append((name.split(b"\0")[0].decode(), kind, length, decimals))
        at += 32

    def value(text: str, kind: bytes, decimals: int):
        if kind not in (b"N", b"F"):
            return text
        return None if not text.strip("*") else float(text) if decimals or kind == b"F" else int(text)

    rows = []
    for i in range(n):
        r = raw[start + i * size : start + (i + 1) * size]
        if r[:1] != b"*":
            cells, at = [], 1
            for _, kind, length, decimals in fields:
                cells.append(value(r[at : at + length].decode("utf-8", "replace").strip(), kind, decimals))
                at += length
            rows.append(tuple(cells))
    return [f[0] for f in fields], rows


def _aux(path: str) -> tuple[list[str], list[tuple]]:
    """The attribute table in a sidecar of XML: whole, real and text fields are types 0, 1 and 2."""
    rat = ET.parse(path).getroot().find(".//GDALRasterAttributeTable")
    if rat is None:
        raise ValueError(f"{path} has no attribute table")
    defs = sorted(rat.findall("FieldDefn"), key=lambda d: int(d.get("index", "0")))
    read = [{"0": lambda x: int(float(x)), "1": float}.get(d.findtext("Type", "2").strip(), str) for d in defs]
    rows = [tuple(f(x.text) if x.text not in (None, "") else None for f, x in zip(read, r.findall("F"), strict=True)) for r in rat.findall("Row")]
    return [d.findtext("Name", "") for d in defs], rows


def read_attributes(spark: SparkSession, raster: str, path: str | None = None) -> DataFrame:
    """The attribute table of a categorical raster, one row per category: ``path``, or the .vat.dbf or .aux.xml beside it."""
    stem = str(Path(raster).with_suffix(""))
    found = [p for p in ([path] if path else [f"{raster}.vat.dbf", f"{stem}.vat.dbf", f"{raster}.aux.xml", f"{stem}.aux.xml"]) if Path(p).exists()]
    if not found:
        raise ValueError(f"no attribute table of {raster}")
    names, rows = (_dbf if found[0].endswith(".dbf") else _aux)(found[0])
    kinds = ["double" if any(isinstance(r[i], float) for r in rows) else "long" if all(isinstance(r[i], int | None) for r in rows) and any(r[i] is not None for r in rows) else "string" for i in range(len(names))]
    cast = {"double": float, "long": int, "string": str}
    return spark.createDataFrame([tuple(None if x is None else cast[k](x) for x, k in zip(r, kinds, strict=True)) for r in rows], ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def tiles(values: DataFrame, like: Meta, dtype: str, nodata: float, value: str, by: str) -> DataFrame:
    """(by, tile, data): the pixels of every raster as compressed tiles, in order. A tile is made by one task from its
    TILE x TILE pixels; of a pixel that comes twice one value holds."""
    across, place = -(-like.width // TILE), F.col("mapcode") - 1
    row, column = place % like.height, F.floor(place / F.lit(like.height))
    tile = (F.floor(row / TILE) * across + F.floor(column / TILE)).cast("int")
    at = ((row % TILE) * TILE + column % TILE).cast("int")
    x = values.filter(F.col(value).isNotNull() & F.col("mapcode").between(1, like.width * like.height)).select(F.col(by).cast("int").alias("by"), tile.alias("tile"), at.alias("at"), F.col(value).cast("double").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, grid = None, np.empty(0)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([pack_tile(grid.reshape(TILE, TILE))], pa.binary())], ["by", "tile", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            k, t, where, v = (b.column(i).to_numpy() for i in range(4))
            new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
            for lo, hi in zip(new, np.append(new[1:], len(k)), strict=True):
                if key != (k[lo], t[lo]):
                    if key is not None:
                        yield done()
                    key, grid = (k[lo], t[lo]), np.full(TILE * TILE, nodata, dtype)
                grid[where[lo:hi]] = v[lo:hi]
        if key is not None:
            yield done()

    return x.repartitionByRange("by", "tile").sortWithinPartitions("by", "tile").mapInArrow(run, "by int, tile int, data binary")


def write_pixels(values: DataFrame, path: str, like: Meta, dtype: str = "float32", nodata: float = -9999.0, value: str = "value") -> None:
    """One raster of (mapcode, value), with the geometry of ``like``."""
    with TileWriter(path, like, dtype, nodata) as w:
        for r in tiles(values.withColumn("_one", F.lit(0)), like, dtype, nodata, value, "_one").toLocalIterator(prefetchPartitions=True):
            w.put(r["tile"], bytes(r["data"]))


def write_yearly(agb: DataFrame, folder: str, like: Meta, nodata: float = 0.0) -> list[str]:
    """agb_<year>.tif for every year of (year, mapcode, agb), in one job; years come one after the other."""
    out: list[str] = []
    w, year = None, None
    for r in tiles(agb, like, "float32", nodata, "agb", "year").toLocalIterator(prefetchPartitions=True):
        if r["by"] != year:
            if w:
                w.__exit__(None, None, None)
            year = r["by"]
            out.append(str(Path(folder) / f"agb_{year}.tif"))
            w = TileWriter(out[-1], like, "float32", nodata).__enter__()
        w.put(r["tile"], bytes(r["data"]))
    if w:
        w.__exit__(None, None, None)
    return out
