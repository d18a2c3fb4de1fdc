"""LAS files, chunk tables, text formats and writers, through real files."""

import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geolode.sources import las, sinks, text
from geolode.sources.arithmetic import BitModel, Corrector, Decoder, Encoder, SymbolModel, decode_sizes, encode_sizes


def points(n, seed=1, wide=True):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"point_idx": np.arange(n), **{f"{a}i": rng.integers(-(10**6), 10**6, n) for a in "xyz"}, **{f"{c}16": rng.integers(0, 65536 if wide else 256, n) for c in "rgb"}})


def test_coder_returns_what_went_in():
    rng = random.Random(1)
    symbols, model, bit, coder = [rng.choice([0, 0, 0, 1, 2, 5, 30]) for _ in range(5000)], SymbolModel(33), BitModel(), Encoder()
    for s in symbols:
        coder.put(model, s)
        coder.put(bit, s & 1)
        coder.put_bits(27, s * 3_000_001 % (1 << 27))
    read, model, bit = Decoder(coder.done()), SymbolModel(33), BitModel()
    for s in symbols:
        assert (read.next(model), read.next(bit), read.bits(27)) == (s, s & 1, s * 3_000_001 % (1 << 27))


def test_integers_of_all_sizes():
    rng = random.Random(2)
    values = [0, 1, -1, 2**31 - 1, -(2**31), 255, 256, 257] + [rng.randint(-(2 ** rng.randint(1, 31)), 2 ** rng.randint(1, 31) - 1) for _ in range(3000)]
    coder, corrector = Encoder(), Corrector()
    for a, b in zip([0, *values], values):
        corrector.encode(coder, a, b, 1)
    read, corrector, before = Decoder(coder.done()), Corrector(), 0
    for v in values:
        before = corrector.decode(read, before, 1)
        assert before == v
    sizes = [rng.randint(100, 900_000) for _ in range(500)]
    assert decode_sizes(encode_sizes(sizes), 500) == sizes and decode_sizes(encode_sizes([]), 0) == []


@pytest.mark.parametrize("version", [2, 3, 4])
@pytest.mark.parametrize("kind", [0, 2, 3, 7])
def test_points_come_back(version, kind):
    p = points(137)
    b = las.write_las(p, version=version, point_format=kind)
    fetch = lambda at, n: b[at : at + n]
    h = las.read_header(fetch, len(b))
    assert (h.version, h.point_format, h.n_points, h.compressed) == (version, kind, 137, False)
    got = las.read_points(fetch, h, 10, 50)
    assert (got["xi"] == p["xi"][10:60]).all() and np.allclose(got["z"], p["zi"][10:60] * 0.01)
    want = p["r16"][10:60].where(p["r16"][10:60] <= 255, p["r16"][10:60] // 256) if kind else 255
    assert (got["r"] == want).all() and (got["a"] == 255).all()
    assert len(las.read_points(fetch, h, 130, 50)["x"]) == 7
    assert h.low[0] == pytest.approx(p["xi"].min() * 0.01) and h.high[2] == pytest.approx(p["zi"].max() * 0.01)


def test_compressed_files_give_their_chunk_points():
    p = points(1003)
    b = las.write_las(p, version=4, point_format=7, chunk=50, compressed=True, sizes=[4090 + k for k in range(21)])
    fetch = lambda at, n: b[at : at + n]
    h = las.read_header(fetch, len(b))
    assert (h.compressed, h.chunk_size, h.n_chunks) == (True, 50, 21)
    assert las.read_chunk_sizes(fetch, len(b), h) == [4090 + k for k in range(21)]
    got = las.read_chunk_points(fetch, len(b), h)
    assert (got["xi"] == p["xi"][::50]).all() and (got["point_idx"] == np.arange(21) * 50).all()
    with pytest.raises(NotImplementedError):
        las.read_points(fetch, h, 0, 10)
    with pytest.raises(ValueError, match="not a LAS file"):
        las.read_header(lambda at, n: b"nothing"[at : at + n], 7)


def test_las_source_reads_a_folder(spark, tmp_path):
    las.register(spark)
    files = {"a.las": points(1000, 3), "sub/B.LAS": points(55, 4), "c.txt": points(5)}
    rows = [(n, bytearray(las.write_las(p))) for n, p in files.items()] + [("sub/d.laz", bytearray(las.write_las(points(200, 5), chunk=30, compressed=True)))]
    spark.createDataFrame(rows, "path string, content binary").write.format("files").option("path", str(tmp_path)).mode("append").save()
    load = lambda **o: spark.read.format("las").options(**o).load(str(tmp_path))
    heads = {r.path.rsplit("/", 1)[1]: r for r in load(what="headers").collect()}
    assert {k: r.n_points for k, r in heads.items()} == {"a.las": 1000, "B.LAS": 55, "d.laz": 200}
    assert load(what="headers", recursive="false").count() == 1
    got = spark.read.format("las").option("bytes_per_task", "7000").load(str(tmp_path / "a.las"))
    assert got.rdd.getNumPartitions() == 4 and got.count() == 1000
    assert got.agg(F.sum("xi")).first()[0] == files["a.las"]["xi"].sum()
    chunks = las.read_chunk_point_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r["count"] for r in chunks.groupBy("path").count().collect()} == {"a.las": 1, "B.LAS": 1, "d.laz": 7}
    assert load(what="chunks").filter(F.col("path").endswith("d.laz")).count() == 7
    assert las.with_bounds(chunks).filter("x >= min_x AND x <= max_x").count() == 9


def test_text_formats(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# m\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvt 0 0\nvt 1 1\nf 1/1 2/2 3/2 4/1\nf 1 2 3\n")
    rows = text.obj(text.lines(spark, str(tmp_path / "m.obj"))).orderBy("triangle", "corner").collect()
    assert [(r.x, r.y) for r in rows] == [(0, 0), (1, 0), (1, 1), (0, 0), (1, 1), (0, 1), (0, 0), (1, 0), (1, 1)]
    assert rows[1].u == 1 and rows[7].u is None
    (tmp_path / "p.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nend_header\n1 2 3 4 5 6 255\n-1.5 2e1 3 7 8 9 255\n")
    assert [(r.n, r.x, r.y, r.b) for r in text.ply(text.lines(spark, str(tmp_path / "p.ply"))).orderBy("n").collect()] == [(0, 1.0, 2.0, 6), (1, -1.5, 20.0, 9)]
    (tmp_path / "c.txt").write_text("time yaw\n 0 1 2 3 4 5 6\nshort line\n1\t2 3 4 5 6 7 \n")
    assert [r.target_z for r in text.cameras(text.lines(spark, str(tmp_path / "c.txt"))).orderBy("n").collect()] == [6.0, 7.0]
    (tmp_path / "b.node").write_text("# box\n3 2 0 1\n1 0 0\n2 1.5 0 # two\n3 0 1\n9 9 9\n")
    assert [(r.id, r.x) for r in text.poly_points(text.lines(spark, str(tmp_path / "b.node"))).orderBy("id").collect()] == [(1, 0.0), (2, 1.5), (3, 0.0)]


def test_written_forms():
    v, f = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0.0]]), np.array([[0, 1, 2]])
    b = sinks.stl(v, f)
    assert len(b) == 84 + 50 and struct.unpack_from("<I", b, 80)[0] == 1 and struct.unpack_from("<3f", b, 84) == (0, 0, 1)
    assert sinks.off(v, f).splitlines() == ["OFF", "3 1 0", "0 0 0", "1 0 0", "0 1 0", "3 0 1 2"]
    assert sinks.png(np.zeros((2, 3, 3))).startswith(b"\x89PNG")


def test_small_files_share_a_task_and_large_ones_are_cut():
    small = [(f"{k:04d}.las", 20_000) for k in range(1000)]
    for what in ("points", "chunk_points", "headers", "chunks"):
        parts = las.LasReader({"path": "/", "what": what}).parts(small)
        assert len(parts) < 20 and [p for part in parts for p in part.paths] == [p for p, _ in small]
    parts = las.LasReader({"path": "/", "bytes_per_task": str(4 << 20)}).parts([("a.las", 9 << 20), ("b.las", 10), ("c.las", 10)])
    assert [(p.paths, p.share, p.of) for p in parts] == [*[(["a.las"], k, 3) for k in range(3)], (["b.las", "c.las"], 0, 1)]


def test_rows_of_small_files_leave_together():
    some = [las.as_batch(f"{k}", {"chunk_idx": np.arange(k), "byte_size": np.arange(k)}, las.arrow_schema(las.TABLE)) for k in range(20)]
    got = list(las.together(iter(some), 50))
    assert len(got) == 4 and sum(b.num_rows for b in got) == 190 and [p.as_py() for p in got[0].column(0)][:3] == ["1", "2", "2"]


def test_small_chunk_tables_make_few_models():
    coder, corrector = Encoder(), Corrector()
    for before, size in ((0, 26), (26, 33), (33, 40)):
        corrector.encode(coder, before, size, 1)
    assert len(corrector.values) == 2 and decode_sizes(coder.done(), 3) == [26, 33, 40]
