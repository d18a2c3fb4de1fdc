"""Invariants of triangulation and interpolation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.operators import heightmap
from geolode.operators import heightmap as H


def cloud(n=150, seed=1):
    return np.random.default_rng(seed).uniform(-0.5, 0.5, (n, 2))


def test_circles_are_empty_and_the_square_is_covered():
    p = np.vstack([cloud(), H.CORNERS])
    faces = H.triangulate(p)
    assert len(faces) == 2 * len(p) - 2 - 4
    circles = np.array([H._circle(*map(tuple, t.tolist())) for t in p[faces]])
    d = ((p[None] - circles[:, None, :2]) ** 2).sum(2)
    assert (d >= circles[:, 2:] * (1 - 1e-9)).all()
    a, b, c = (p[faces[:, k]] for k in range(3))
    area = ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
    assert (area > 0).all() and area.sum() == pytest.approx(4.0)


def test_order_of_points_does_not_matter():
    p, shuffle = cloud(), np.random.default_rng(2).permutation(150)
    first = {tuple(sorted(map(tuple, p[f]))) for f in H.triangulate(p)}
    assert first == {tuple(sorted(map(tuple, p[shuffle][f]))) for f in H.triangulate(p[shuffle])}


def test_toy_square_has_two_faces():
    p = np.array([(-0.5, -0.5), (-0.5, 0.4), (0.5, -0.5), (0.3, 0.5)])
    assert len(H.triangulate(p)) == 2 and len(H.triangulate(np.vstack([p, p[:2]]))) == 2


def test_linear_fields_come_back_and_weights_sum_to_one():
    p = cloud()
    values = np.column_stack([2 * p[:, 0] - 3 * p[:, 1] + 1, p[:, 0]])
    out = H.interpolate(p, values, 48)
    at, known = H.grid_points(1.0, 48), out["mask"] == 0
    assert known.mean() > 0.7 and np.allclose(out["linear"][known][:, 0], 2 * at[known][:, 0] - 3 * at[known][:, 1] + 1)
    assert np.allclose(out["linear"][~known], out["nearest"][~known])
    faces = H.triangulate(np.vstack([p, H.CORNERS]))
    found, weights = H.locate(np.vstack([p, H.CORNERS]), faces, 1.0, 48)
    assert np.allclose(weights[found >= 0].sum(1), 1) and (weights[found >= 0] >= -1e-8).all()
    touching = (faces[found] >= len(p)).any(1)
    assert ((out["mask"] == H.OUTSIDE) == (touching | (found == H.OUTSIDE))).all()


def test_nearest_at_a_sample_is_that_sample():
    p = cloud()
    at = H.grid_points(1.0, 20)
    assert (H.nearest(p, 1.0, 20) == ((at[:, None] - p[None]) ** 2).sum(-1).argmin(1)).all()


def frame(spark, n, dx=0.0):
    rng = np.random.default_rng(4)
    rows = [(0, 0, float(x), float(y), float(x / 10), 100, 50, 25) for x, y in rng.uniform(0, 640, (n, 2))]
    return spark.createDataFrame(rows, "px int, py int, lx double, ly double, lz double, r int, g int, b int").withColumns({"px": F.lit(int(dx)), "lx": F.col("lx") + 640.0 * dx})


def test_patches_of_few_samples_are_blank_and_moves_change_nothing(spark):
    assert H.heightmaps(frame(spark, 24), 16, 16).first().blank
    here, there = (H.heightmaps(frame(spark, 90, dx), 16, 16).first() for dx in (0, 3))
    assert np.allclose(here.height, there.height) and here.mask == there.mask and np.allclose(here.red, 100 / 256) and np.allclose(here.blue, 25 / 256)


def test_models_see_both_maps(spark):
    def flat(maps):
        assert {k: v.shape for k, v in maps.items()} == {"patch_hm_nearest": (1, 96, 96), "patch_hm_linear": (1, 96, 96), "patch_rgb_nearest": (3, 96, 96), "patch_rgb_linear": (3, 96, 96)}
        return np.zeros((1, 64, 64))

    row = H.heightmaps(frame(spark, 90), model=flat).first()
    assert len(row.height) == 64 * 64 and len(set(row.height)) == 1


def test_sets_in_step_have_the_faces_of_each_alone():
    sets = [np.vstack([cloud(n, n), H.CORNERS]) for n in (30, 1, 90, 0, 54)] + [np.random.default_rng(3).integers(-5, 6, (60, 2)) / 10]
    owners, faces = H.triangulate_all(np.concatenate(sets), [len(s) for s in sets])
    for k, s in enumerate(sets):
        assert faces[owners == k].tolist() == H.triangulate(s).tolist() and len(faces[owners == k])


def test_windows_and_blocks_are_parts_of_the_whole():
    p = cloud(60)
    values = np.column_stack([p[:, 0], p[:, 1]])
    whole = H.interpolate(p, values, 96)
    some = H.interpolate(p, values, 96, 1.0, 16, 64, near=False)
    assert all((H.crop(whole[k].reshape(96 * 96, -1), 96, 64) == some[k].reshape(64 * 64, -1)).all() for k in ("linear", "mask"))
    at = H.grid_points(1.0, 96)
    assert (H.nearest(p, 1.0, 96) == H.nearest_at(p, at[:, 0], at[:, 1])).all() and "nearest" not in some


def test_only_asked_maps_leave_the_tasks(spark):
    rows = frame(spark, 90)
    whole, height = H.heightmaps(rows, 32, 32).first(), H.heightmaps(rows, 32, 32, fields=("height",))
    assert height.columns == ["px", "py", "n", "blank", "height"] and height.first().height == whole.height
    made = H.infer(rows.unionByName(frame(spark, 90, 2)), lambda maps: maps["patch_hm_linear"][:, :, 16:80, 16:80], 2)
    assert made.columns == ["px", "py", "height"] and made.count() == 2


def test_patches_over_many_batches_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(H, "TOGETHER", 2)
    rows = frame(spark, 90)
    for k in range(1, 7):
        rows = rows.unionByName(frame(spark, 30 + k, k))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "7")
    try:
        assert sorted((r.px, r.n) for r in H.heightmaps(rows, 16, 16).collect()) == [(0, 90), *[(k, 30 + k) for k in range(1, 7)]]
    finally:
        spark.conf.unset(size)


def test_geo_crop_is_the_middle_of_whole_rasters(spark, sf_dir):
    from geolode.plans import registry

    found = registry.queries()["geo_crop"](spark, sf_dir).groupBy("px", "py").count().collect()
    assert found and {r["count"] for r in found} == {64 * 64}
    maps = spark.createDataFrame([(0, 0, False, [float(v) for v in range(36)])], "px int, py int, blank boolean, height array<double>")
    assert heightmap.cropped(maps, 6, 2).first().height == [14.0, 15.0, 20.0, 21.0]


def test_geo_interp_linear_has_all_texels_and_their_colours(spark, sf_dir):
    from geolode.plans import joins, registry
    from geolode.plans.tables import Tables

    found = registry.queries()["geo_interp_linear"](spark, sf_dir)
    some = found.first()
    mine = {(r.i, r.j): r for r in found.filter((F.col("px") == some.px) & (F.col("py") == some.py)).collect()}
    assert len(mine) == 96 * 96
    rows = joins.contexts(Tables(spark, sf_dir)).filter((F.col("px") == some.px) & (F.col("py") == some.py)).toPandas()
    s = heightmap.Samples({n: rows[n].to_numpy() for n in ("px", "py", "lx", "ly", "lz", *"rgb")}, np.array([0, len(rows)]))
    want = heightmap.interpolate(s.xy, s.values, 96)["linear"]
    for (i, j), r in mine.items():
        got = (r.height - s.base[0]) / C.RADIUS * 10, r.red, r.green, r.blue
        assert np.allclose(got, want[j * 96 + i], atol=2e-6)


def test_geo_gen_rgb_asks_the_model_and_masks_colours(spark, sf_dir):
    from geolode.plans import geometry, joins
    from geolode.plans.tables import Tables

    mask = np.zeros((5, 5), int)
    mask[0, 4] = heightmap.OUTSIDE
    made = heightmap.masked_colours(np.full((25, 3), 0.5), mask.ravel(), 5)[:, 0].reshape(5, 5)
    assert (made[:2, 3:] == 0).all() and made.sum() == 127.0 * 21
    t = Tables(spark, sf_dir)
    found = {(r.px, r.py): r for r in geometry.geo_gen_rgb(t).filter("NOT blank").collect()}
    px, py = min(found)
    rows = joins.contexts(t).filter((F.col("px") == px) & (F.col("py") == py)).toPandas()
    s = heightmap.Samples({n: rows[n].to_numpy() for n in ("px", "py", "lx", "ly", "lz", *"rgb")}, np.array([0, len(rows)]))
    rasters = heightmap.interpolate(s.xy, s.values, 96)
    picture = geometry.mean_filter_rgb(heightmap.model_input(rasters, 96)).reshape(4, -1).T
    colours = heightmap.masked_colours(picture[:, 1:], heightmap.crop(rasters["mask"][:, None], 96, 64)[:, 0], 64).mean(0)
    got, want = found[px, py], (picture[:, 0].mean() / 10 * C.RADIUS_OUT + s.base[0], *colours)
    assert np.allclose((got.height, got.red, got.green, got.blue), want, atol=1e-4) and colours.max() > 1
