"""The binned rasteriser against a loop over triangles and pixels."""

import numpy as np
import pytest

from geolode.functions.camera import Camera
from geolode.operators import aggregate, mesh_raster

SIDE = 4
CAMERA = Camera(yaw=0.4, pitch=-0.6, radius=150.0, target=(60.0, 50.0, 0.0), width=150, height=110, near=0.1, far=10000.0)


def maps(seed=3, missing=((1, 1),)):
    rng = np.random.default_rng(seed)
    return {(px, py): (rng.uniform(0, 25, (SIDE, SIDE)), rng.integers(0, 256, (SIDE, SIDE, 3))) for px in range(3) for py in range(3) if (px, py) not in missing}


def brute(patches):
    def look(gx, gy):
        found = patches.get((gx // SIDE, gy // SIDE))
        return (0.0, np.zeros(3)) if found is None else (found[0][gy % SIDE, gx % SIDE], found[1][gy % SIDE, gx % SIDE])

    m, picture = CAMERA.matrix, {}

    def screen(gx, gy):
        v = m @ np.array([gx * 10.0, gy * 10.0, look(gx, gy)[0], 1.0])
        return (v[0] / v[3] * 0.5 + 0.5) * CAMERA.width, (v[1] / v[3] * 0.5 + 0.5) * CAMERA.height, v[3]

    for px, py in patches:
        for gx in range(px * SIDE, px * SIDE + SIDE):
            for gy in range(py * SIDE, py * SIDE + SIDE):
                for half in mesh_raster.HALVES:
                    (x0, y0, w0), (x1, y1, w1), (x2, y2, w2) = (screen(gx + dx, gy + dy) for dx, dy in half)
                    whole = (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)
                    if min(w0, w1, w2) <= 0 or whole <= 0:
                        continue
                    for ix in range(max(0, int(np.floor(min(x0, x1, x2)))), min(CAMERA.width, int(np.ceil(max(x0, x1, x2))))):
                        for iy in range(max(0, int(np.floor(min(y0, y1, y2)))), min(CAMERA.height, int(np.ceil(max(y0, y1, y2))))):
                            s = ((ix - x0) * (y2 - y0) - (iy - y0) * (x2 - x0)) / whole
                            t = ((x1 - x0) * (iy - y0) - (y1 - y0) * (ix - x0)) / whole
                            v = 1 - (s + t)
                            if min(s, t, v) < 0:
                                continue
                            depth = round((v * w0 + s * w1 + t * w2) * 1.2 + 10, 3)
                            u, w = (v * half[0][k] + s * half[1][k] + t * half[2][k] for k in range(2))
                            colour = sum(look(gx + dx, gy + dy)[1] * (u if dx else 1 - u) * (w if dy else 1 - w) for dx in (0, 1) for dy in (0, 1))
                            if (ix, iy) not in picture or depth < picture[ix, iy][0]:
                                picture[ix, iy] = (depth, colour)
    return picture


def drawn(spark, patches, parts=1):
    rows = [(px, py, h.ravel().tolist(), (c[..., 0] + 256 * c[..., 1] + 65536 * c[..., 2]).ravel().tolist()) for (px, py), (h, c) in patches.items()]
    df = spark.createDataFrame(rows, "px int, py int, height array<double>, colour array<bigint>").repartition(parts)
    return {(r.ix, r.iy): (r.depth, np.array([r.colour % 256, r.colour // 256 % 256, r.colour // 65536])) for r in aggregate.depth_buffer(mesh_raster.fragments(df, CAMERA, SIDE)).collect()}


@pytest.mark.parametrize("pixels,bins", [(1 << 18, 4096), (37, 1)])
def test_picture_equals_a_loop_over_pixels(spark, monkeypatch, pixels, bins):
    monkeypatch.setattr(mesh_raster, "PIXELS", pixels)
    monkeypatch.setattr(mesh_raster, "BINS", bins)
    patches = maps()
    want, got = brute(patches), drawn(spark, patches, 3)
    assert len(want) > 3000 and got.keys() == want.keys()
    for k, (depth, colour) in want.items():
        assert got[k][0] == pytest.approx(depth, abs=0.0011) and (abs(got[k][1] - colour) <= 1.001).all()


def test_one_triangle_over_the_whole_picture_and_maps_without_rows(spark):
    near = Camera(yaw=0.0, pitch=-1.5, radius=8.0, target=(20.0, 20.0, 0.0), width=300, height=200, near=0.1)
    flat = spark.createDataFrame([(0, 0, [0.0] * 16, [255] * 16), (7, 7, None, None)], "px int, py int, height array<double>, colour array<bigint>")
    rows = aggregate.depth_buffer(mesh_raster.fragments(flat, near, SIDE)).collect()
    assert len(rows) == 300 * 200 and {r.colour for r in rows} == {255}
    assert mesh_raster.fragments(flat.limit(0), near, SIDE).collect() == []


def test_texels_become_maps(spark):
    cells = spark.createDataFrame([(0, 0, 1, 0, 5), (0, 0, 3, 2, 7)], "px int, py int, tx int, ty int, v int")
    row = mesh_raster.as_maps(cells, "v", "bigint", SIDE).first()
    assert len(row.v) == 16 and row.v[1] == 5 and row.v[11] == 7 and sum(x is not None for x in row.v) == 2


def test_patches_out_of_view_are_left_out_before_any_map(spark, sf_dir):
    from geolode.plans import views
    from geolode.plans.tables import Tables

    t = Tables(spark, sf_dir)
    every = spark.range(-5, 1000).crossJoin(spark.range(-3, 17).withColumnRenamed("id", "px")).selectExpr("cast(px as int) px", "cast(id as int) py")
    kept = {(r.px, r.py) for r in views.in_view(t, every).collect()}
    top = t.world.first()
    heights = np.linspace(0, max(top.size_z, top.origin_z + top.size_z), 5)
    m, camera = views.CAMERA.matrix, views.CAMERA
    for px in range(-3, 17):
        for py in range(-5, 200):
            v = np.array([m @ [x, y, z, 1.0] for x in np.linspace(px * 640, px * 640 + 640, 9) for y in np.linspace(py * 640, py * 640 + 640, 9) for z in heights])
            v = v[v[:, 3] > 0]
            shown = ((abs(v[:, :2]) <= v[:, 3:]).all(1)).any() if len(v) else False
            if shown:  # and what its far edges need
                assert {(px + dx, py + dy) for dx in (0, 1) for dy in (0, 1)} & {(x, y) for x in range(-3, 17) for y in range(-5, 1000)} <= kept
    assert 10 < len(kept) < 2000 and camera.width == 640


def test_rows_in_view_may_have_columns_of_the_world(spark, sf_dir):
    from geolode.plans import views
    from geolode.plans.joins import contexts
    from geolode.plans.tables import Tables

    t = Tables(spark, sf_dir)
    rows = contexts(t)
    assert "origin_z" in rows.columns and views.in_view(t, rows).columns == rows.columns
