"""Rasters of any supported layout, attribute tables, and tiles written by executors."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from understory.sources import raster

FIELD = {"H": 3, "I": 4, "Q": 16, "s": 2}


def lzw(data):
    """A plain encoder: clear, codes of growing width, end."""
    out, held, bits = bytearray(), 0, 0

    def emit(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    table, word = {bytes([i]): i for i in range(256)}, b""
    emit(256, 9)
    n = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        emit(table[word], max(9, n.bit_length()))
        table[word + bytes([b])] = n
        n += 1
        word = bytes([b])
        if n == 4094:
            emit(table[word], 12)
            emit(256, 12)
            table, word, n = {bytes([i]): i for i in range(256)}, b"", 258
    if word:
        emit(table[word], max(9, n.bit_length()))
        n += 1
    emit(257, max(9, n.bit_length()))
    emit(0, 7)
    return bytes(out)


def packbits(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100))


def build(path, data, compression=1, predictor=1, tile=None, big=False, rows=3, nodata=None, order="<"):
    """A TIFF of the given layout."""
    h, w = data.shape
    parts = []
    for r in range(0, h, tile or rows):
        for c in range(0, w, tile or w):
            x = data[r : r + (tile or rows), c : c + (tile or w)]
            if tile:
                x = np.pad(x, ((0, tile - x.shape[0]), (0, tile - x.shape[1])))
            x = x.astype(x.dtype.newbyteorder(order))
            if predictor == 2:
                d = x.copy()
                d[:, 1:] = x[:, 1:] - x[:, :-1]
                x = d
            raw = x.tobytes()
            if predictor == 3:
                b = np.frombuffer(x.astype(x.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(x.shape[0], x.shape[1], -1).transpose(0, 2, 1).reshape(x.shape[0], -1)
                d = b.copy()
                d[:, 1:] = b[:, 1:] - b[:, :-1]
                raw = d.tobytes()
            parts.append({1: lambda v: v, 8: zlib.compress, 5: lzw, 32773: packbits}[compression](raw))
    word, inline = ("Q", 8) if big else ("I", 4)
    body, places = b"", []
    for p in parts:
        places.append((16 + len(body), len(p)))
        body += p
    tags = {256: ("I", (w,)), 257: ("I", (h,)), 258: ("H", (data.dtype.itemsize * 8,)), 259: ("H", (compression,)), 277: ("H", (1,)), 317: ("H", (predictor,)), 339: ("H", ({"u": 1, "i": 2, "f": 3}[data.dtype.kind],))}
    tags |= {322: ("I", (tile,)), 323: ("I", (tile,)), 324: (word, tuple(p[0] for p in places)), 325: (word, tuple(p[1] for p in places))} if tile else {278: ("I", (rows,)), 273: (word, tuple(p[0] for p in places)), 279: (word, tuple(p[1] for p in places))}
    if nodata is not None:
        tags[42113] = ("s", f"{nodata}".encode() + b"\0")
    table = []
    for t, (k, v) in sorted(tags.items()):
        raw = v if k == "s" else struct.pack(f"{order}{len(v)}{k}", *v)
        n = len(v)
        if len(raw) > inline:
            at = 16 + len(body)
            body += raw
            raw = struct.pack(order + word, at)
        table.append(struct.pack(order + "HH" + word, t, FIELD[k], n) + raw.ljust(inline, b"\0"))
    at = 16 + len(body)
    head = struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at) + b"\0" * 8
    mark = b"II" if order == "<" else b"MM"
    path.write_bytes(mark + head + body + struct.pack(order + ("Q" if big else "H"), len(table)) + b"".join(table) + b"\0" * 8)
    return str(path)


def pixels(df):
    return {r.mapcode: r.value for r in df.collect()}


def want(data, nodata=None):
    h, w = data.shape
    return {c * h + r + 1: float(data[r, c]) for r in range(h) for c in range(w) if nodata is None or not (data[r, c] == nodata or (nodata != nodata and data[r, c] != data[r, c]))}


LAYOUTS = [
    dict(), dict(order=">"), dict(big=True), dict(tile=16), dict(compression=8), dict(compression=8, tile=16, predictor=2), dict(compression=5), dict(compression=5, tile=16, predictor=2, big=True),
    dict(compression=32773), dict(compression=8, predictor=2, order=">"), dict(rows=1), dict(rows=1000),
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(spark, tmp_path, layout):
    data = np.random.default_rng(1).integers(0, 500, (41, 37)).astype("int32")
    data[3:20, 5:30] = 7
    path = build(tmp_path / "a.tif", data, **layout, nodata=7)
    assert pixels(raster.read_pixels(spark, path)) == want(data, 7) and pixels(raster.read_pixels(spark, path, False)) == want(data)


def test_float_predictor_and_nan_nodata(spark, tmp_path):
    data = np.random.default_rng(2).normal(size=(20, 33)).astype("float32")
    data[2, 3:9] = np.nan
    for layout in (dict(), dict(compression=8, predictor=3), dict(compression=8, predictor=3, tile=16)):
        path = build(tmp_path / "f.tif", data, **layout, nodata="nan")
        assert pixels(raster.read_pixels(spark, path)) == want(data, float("nan"))


def test_long_lzw_streams(spark, tmp_path):
    data = np.random.default_rng(3).integers(0, 2**16, (90, 91)).astype("uint16")  # fills the table more than once
    assert pixels(raster.read_pixels(spark, build(tmp_path / "l.tif", data, compression=5, rows=90))) == want(data)


def test_what_cannot_be_read_says_so(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"GIF89a" + b"\0" * 20)
    with pytest.raises(ValueError, match="no TIFF"):
        raster.read_meta(str(tmp_path / "x.tif"))
    path = build(tmp_path / "a.tif", np.zeros((4, 4), "uint8"))
    raw = (tmp_path / "a.tif").read_bytes().replace(struct.pack("<HHI", 259, 3, 1) + struct.pack("<H", 1), struct.pack("<HHI", 259, 3, 1) + struct.pack("<H", 7))
    (tmp_path / "a.tif").write_bytes(raw)
    with pytest.raises(ValueError, match="compressed by"):
        raster.read_meta(path)


def test_segments_are_grouped(tmp_path):
    path = build(tmp_path / "a.tif", np.zeros((400, 10), "uint8"), rows=1)
    parts = lambda n: raster._RasterReader({"path": path, "pixelsPerTask": str(n)}).partitions()
    assert len(parts(1 << 20)) == 1 and len(parts(1000)) == 4
    one = build(tmp_path / "b.tif", np.zeros((400, 10), "uint8"), rows=400)
    assert len(raster._RasterReader({"path": one, "pixelsPerTask": "1000"}).partitions()) == 4


def test_tiles_over_many_tasks(spark, tmp_path):
    w, h = 600, 300
    like = raster.Meta(w, h, "<f4", tags={33550: (12, (30.0, 30.0, 0.0))})
    px = spark.range(1, w * h + 1, 1, 9).filter("id % 5 != 0 and id < 100000").select(F.col("id").alias("mapcode"), (F.col("id") % 1000).cast("double").alias("value"))
    path = str(tmp_path / "deep" / "out.tif")
    raster.write_pixels(px, path, like, "int32", -1)
    m = raster.read_meta(path)
    assert (m.width, m.height, m.nodata, m.tags) == (w, h, -1.0, like.tags) and len(m.segments) == 6
    back = raster.read_pixels(spark, path)
    assert back.count() == px.count() and back.join(px, ["mapcode", "value"]).count() == px.count()
    agb = px.crossJoin(spark.createDataFrame([(3,), (11,)], "year int")).select("year", "mapcode", (F.col("value") + F.col("year")).alias("agb"))
    files = raster.write_yearly(agb, str(tmp_path), like)
    assert [f.rsplit("_", 1)[1] for f in files] == ["3.tif", "11.tif"]
    assert raster.read_pixels(spark, files[1]).agg(F.sum("value")).first()[0] == agb.filter("year = 11").agg(F.sum("agb")).first()[0]


def dbf(path, fields, rows):
    """fields: (name, type, length, decimals)."""
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(fields), size)
    head += b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), length, d) for n, k, length, d in fields) + b"\r"
    path.write_bytes(head + b"".join(b" " + b"".join(str("" if v is None else v).rjust(f[2]).encode() for v, f in zip(r, fields, strict=True)) for r in rows))


def test_attribute_tables(spark, tmp_path):
    dbf(tmp_path / "a.tif.vat.dbf", [("Value", "N", 9, 0), ("PLT_CN", "N", 15, 0), ("BA", "F", 9, 2), ("NAME", "C", 8, 0)], [(1, 400000000101, 2.5, "oak"), (2, None, 3.0, "")])
    t = raster.read_attributes(spark, str(tmp_path / "a.tif"))
    assert t.dtypes == [("Value", "bigint"), ("PLT_CN", "bigint"), ("BA", "double"), ("NAME", "string")] and [tuple(r) for r in t.collect()] == [(1, 400000000101, 2.5, "oak"), (2, None, 3.0, "")]
    fields = "".join(f"<FieldDefn index='{i}'><Name>{n}</Name><Type>{k}</Type></FieldDefn>" for i, (n, k) in enumerate((("Value", 0), ("CN", 1), ("NAME", 2))))
    rows = "<Row index='0'><F>1</F><F>101</F><F>oak</F></Row><Row index='1'><F>2</F><F></F><F>elm</F></Row>"
    (tmp_path / "b.tif.aux.xml").write_text(f"<PAMDataset><PAMRasterBand band='1'><GDALRasterAttributeTable>{fields}{rows}</GDALRasterAttributeTable></PAMRasterBand></PAMDataset>")
    t = raster.read_attributes(spark, str(tmp_path / "b.tif"))
    assert [tuple(r) for r in t.collect()] == [(1, 101.0, "oak"), (2, None, "elm")]
    assert {tuple(r) for r in raster.plot_pixels(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 9.0)], "mapcode long, value double"), t, "CN").collect()} == {(1, 101), (2, None), (3, None)}
    with pytest.raises(ValueError, match="no attribute table"):
        raster.read_attributes(spark, str(tmp_path / "c.tif"))
