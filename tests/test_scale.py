"""Tables from files, orders over many tasks, streams over several batches and restarts, bounds."""

import numpy as np
import pandas as pd
import pytest
from oracle import spark_rows, sql_rows
from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.operators import aggregate, grid, heightmap, raster
from geolode.plans import projections, registry, storage
from geolode.plans.scans import files
from geolode.plans.tables import LasTables, Tables
from geolode.sources import catalogue, las
from geolode.streaming import ingest


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("las"))
    las.register(spark)
    files(Tables(spark, sf_dir)).write.format("files").mode("append").option("path", path).save()
    return path


@pytest.mark.parametrize("name", ["agg_world_bounds", "agg_total_points", "patches", "jn_context", "agg_texture", "flt_frustum3", "smp_chunk"])
def test_queries_over_a_folder_equal_those_over_tables(spark, sf_dir, folder, name):
    assert spark_rows(registry.on_files(name, spark, folder, chunk="10")) == spark_rows(registry.queries()[name](spark, sf_dir))


def test_world_of_a_folder_reads_headers_alone(spark, folder):
    plan = LasTables(spark, folder).world._jdf.queryExecution().optimizedPlan().toString()
    assert "n_points" in plan and "point_idx" not in plan
    assert "point_idx" not in LasTables(spark, folder).tiles._jdf.queryExecution().analyzed().toString()


def test_box_leaves_out_files_and_points(spark, folder):
    every = LasTables(spark, folder).points
    tile = LasTables(spark, folder).tiles.orderBy("tile_id").first()
    box = f"{tile.min_x},{tile.min_y},{(tile.min_x + tile.max_x) / 2},{tile.max_y}"
    x0, y0, x1, y1 = map(float, box.split(","))
    some = LasTables(spark, folder, box=box)
    inside = every.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    assert spark_rows(some.points) == spark_rows(inside)
    assert 0 < some.catalogue.count() < LasTables(spark, folder).catalogue.count()
    plan = some.points._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(min_x" in plan
    # the source by itself gives the same rows
    las.register(spark)
    source = spark.read.format("las").option("box", box).load(folder)
    assert source.count() == inside.count()


def test_a_catalogue_reads_new_files_only(spark, tmp_path):
    las.register(spark)
    put = lambda name, n: spark.createDataFrame([(name, bytearray(las.write_las(pts(n))))], "path string, content binary").write.format("files").option("path", str(tmp_path / "f")).mode("append").save()
    put("a.las", 10)
    put("deep/b.LAS", 2500)
    to = str(tmp_path / "catalogue")
    first = catalogue.written(spark, str(tmp_path / "f"), to)
    assert {r.path.rsplit("/", 1)[1]: r.n_points for r in first.collect()} == {"a.las": 10, "b.LAS": 2500}
    put("c.las", 7)
    assert catalogue.written(spark, str(tmp_path / "f"), to).count() == 3  # a.las and b.LAS once
    whole = catalogue.rows(spark.read.parquet(to), points_per_range=999)
    assert whole.count() == 2517 and whole.filter("path LIKE '%b.LAS'").agg(F.count_distinct("point_idx")).first()[0] == 2500
    (tmp_path / "f/a.las").unlink()
    assert catalogue.present(spark.read.parquet(to), str(tmp_path / "f")).count() == 2
    boxes = spark.createDataFrame([(-1e9, -1e9, 1e9, 1e9), (5e8, 5e8, 6e8, 6e8)], "x0 double, y0 double, x1 double, y1 double")
    assert catalogue.near(spark.read.parquet(to), boxes.filter("x0 > 0"), 1e8).count() == 0
    assert catalogue.near(spark.read.parquet(to), boxes, 1e8).count() == 3
    (tmp_path / "f/bad.las").write_bytes(b"nothing")
    with pytest.raises(Exception, match="bad.las"):
        catalogue.written(spark, str(tmp_path / "f"), to)


def pts(n, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"point_idx": np.arange(n), **{f"{a}i": rng.integers(-(10**6), 10**6, n) for a in "xyz"}, **{f"{c}16": rng.integers(0, 65536, n) for c in "rgb"}})


def test_a_stream_over_a_growing_folder_gives_every_file_once(spark, tmp_path):
    las.register(spark)
    top, log, out = (str(tmp_path / n) for n in ("f", "log", "out"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/.half.las").write_bytes(b"not whole yet")

    def put(name, n):
        (tmp_path / f"f/{name}.part").write_bytes(las.write_las(pts(n, n)))
        (tmp_path / f"f/{name}.part").rename(tmp_path / f"f/{name}")

    def play():
        rows = spark.readStream.format("las").options(what="points", log=log, files_per_batch="2").load(top)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).start()
        return query

    for k in range(5):
        put(f"{k}.las", 100 + k)
    query = play()
    query.processAllAvailable()
    put("late.las", 50)
    query.processAllAvailable()
    batches = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    assert len(batches) == 4  # two files a batch, then the late one
    put("0a.las", 60)  # sorts before files that have come
    query = play()
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    streamed, batch = spark.read.parquet(out), spark.read.format("las").load(top)
    assert spark_rows(streamed) == spark_rows(batch) and streamed.count() == sum(100 + k for k in range(5)) + 110
    with pytest.raises(Exception, match="option log"):
        spark.readStream.format("las").load(top).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "s2")).start().processAllAvailable()


def test_byte_ranges_of_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)))
    (tmp_path / "b.bin").write_bytes(b"xyz")
    want = spark.createDataFrame([(str(tmp_path / "a.bin"), 10, 3), (str(tmp_path / "b.bin"), 1, 9), (f"file://{tmp_path / 'a.bin'}", 250, 20)], "path string, start long, n long")
    got = sorted(bytes(r.bytes) for r in las.byte_ranges(want).collect())
    assert got == sorted([bytes([10, 11, 12]), b"yz", bytes(range(250, 256))])


def test_places_are_numbered_over_many_tasks(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    rows = storage.placed_in_order(df, F.desc("k"), "id").collect()
    order = sorted(rows, key=lambda r: (-r.k, r.id))
    assert [r.place for r in order] == list(range(1, 1001))
    assert storage.placed_in_order(df.limit(0), "k").collect() == []


def test_upper_median_of_any_values(spark):
    rng = np.random.default_rng(1)
    for values in ([3.0], [1.0, 2.0], [5.0] * 9 + [1.0], rng.normal(size=501).tolist(), [0.0, 1e-300, 1e300, 2.0], (rng.random(300) ** 40).tolist()):
        assert aggregate.upper_median(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()[0] == sorted(values)[len(values) // 2]
    assert aggregate.upper_median(spark.createDataFrame([], "v double"), "v").first()[0] is None


def test_depths_beyond_the_bound_raise(spark):
    far = spark.createDataFrame([(0, 0, 3e6, 1)], "ix int, iy int, depth double, colour long")
    with pytest.raises(Exception, match="beyond"):
        aggregate.depth_buffer(far).collect()


def test_a_dense_patch_keeps_all_its_samples(spark):
    rng = np.random.default_rng(2)
    places = rng.uniform(-160, 800, (3000, 2)).round(2)
    rows = [(0, 0, float(x), float(y), float(x), 1, 2, 3) for x, y in places]
    maps = heightmap.heightmaps(spark.createDataFrame(rows, "px int, py int, lx double, ly double, lz double, r int, g int, b int"), 96, 64)
    row = maps.first()
    height = np.array(row.height).reshape(64, 64)
    # z = x over the whole window, so a column's height is its place, to the right edge
    step = C.RADIUS / C.STRETCH / 96
    want = 320 + (np.arange(16, 80) - 48) * step
    assert row.n == 3000 and np.allclose(height.mean(0), want, atol=1.0) and 600 < height[:, -1].mean() < 680
    # nearest of all samples, against brute force
    near = np.array(heightmap.heightmaps(spark.createDataFrame(rows, "px int, py int, lx double, ly double, lz double, r int, g int, b int"), 96, 64, "nearest").first().height).reshape(64, 64)
    xy = (places - 320) / C.RADIUS * C.STRETCH
    at = -0.5 + np.arange(16, 80) / 96
    for j, i in rng.integers(0, 64, (60, 2)):
        k = ((xy - [at[i], at[j]]) ** 2).sum(1).argmin()
        assert near[j, i] == pytest.approx(places[k, 0])


def test_nearest_in_blocks_is_nearest(monkeypatch):
    points = np.random.default_rng(5).uniform(-0.5, 0.5, (700, 2)).round(2)
    whole = heightmap.nearest(points, 1.0, 40)
    monkeypatch.setattr(heightmap, "DISTANCES", 2000)
    assert (heightmap.nearest(points, 1.0, 40) == whole).all()


def test_weighted_median_counts_values_several_times(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 3)], "v double, n long")
    assert aggregate.upper_median(df, "v", F.col("n")).first()[0] == 1.0
    assert aggregate.upper_median(spark.createDataFrame([(-1.7e308,), (1.7e308,), (0.0,)], "v double"), "v").first()[0] == 0.0


def test_tiles_touching_a_patch_overlap_it(spark):
    box = spark.createDataFrame([(640.0, 0.0, 700.0, 640.0)], "ax double, ay double, bx double, b_y double")
    cells = grid.covered_cells(box, *[F.col(n) for n in ("ax", "ay", "bx", "b_y")], closed=True)
    assert {(r.px, r.py) for r in cells.collect()} == {(x, y) for x in (0, 1) for y in (-1, 0, 1)}


def test_splat_of_one_sample_is_its_height(spark):
    out = raster.splat(spark.createDataFrame([(0, 50, 40, 7.0)], "k int, ix int, iy int, h double"), ["k"], 96).collect()
    assert len(out) == 305 and {r.h for r in out} == {7.0} and all((r.ix - 50) ** 2 + (r.iy - 40) ** 2 < 100 for r in out)
    two = raster.splat(spark.createDataFrame([(0, 0, 0, 0.0), (0, 4, 0, 8.0)], "k int, ix int, iy int, h double"), ["k"], 96)
    w = lambda d: 1 - np.exp(-(1 - d / 10) / 10.1)
    assert two.filter("ix = 1 AND iy = 0").first().h == pytest.approx(8 * w(3) / (w(1) + w(3)), abs=1e-6)


@pytest.fixture(scope="module")
def split_events(spark, sf_dir, tmp_path_factory):
    """events in several files, so that a stream has several batches."""
    path = str(tmp_path_factory.mktemp("events") / "events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4, "event_id").write.parquet(path)
    return events, path


def stream(spark, split_events):
    return ingest.read_stream(spark, split_events[1], split_events[0].schema)


def test_running_list_over_batches_and_a_restart(spark, split_events, tmp_path):
    events = split_events[0]
    want = [r.event_id for r in events.orderBy(F.desc("value"), "event_id").limit(100).collect()]
    for _ in range(2):  # the second time there is nothing new
        top = ingest.running_top(stream(spark, split_events).select("event_id", "value"), str(tmp_path / "top"), "value", ["event_id"])
        assert [r.event_id for r in top.orderBy(F.desc("value"), "event_id").collect()] == want


def test_state_crosses_batches(spark, split_events, tmp_path):
    events = split_events[0]
    rows = stream(spark, split_events)
    known = events.groupBy("user_id").agg(F.count("*").alias("expected"))
    sums = ingest.finish(ingest.accumulate(rows.select((F.col("user_id") % 50).alias("patch"), "event_id"), ["patch"], "event_id"), str(tmp_path / "sums"), "complete").drop("batch")
    want = ingest.accumulate(events.select((F.col("user_id") % 50).alias("patch"), "event_id"), ["patch"], "event_id")
    assert spark_rows(sums) == spark_rows(want)
    done = ingest.finish(ingest.complete(rows, known, "user_id"), str(tmp_path / "done"), "complete").drop("batch")
    assert done.count() == known.count()
    joined = ingest.finish(ingest.with_files(rows, known, "user_id").select("event_id", "expected"), str(tmp_path / "joined")).drop("batch")
    assert joined.count() == events.count() and joined.select("event_id").distinct().count() == events.count()
    held = ingest.finish(ingest.held_back(rows.select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("kind")), "user_id", "click", "user_id bigint, id bigint"), str(tmp_path / "held")).drop("batch")
    opened = events.filter("event_type = 'click'").select("user_id").distinct()
    assert spark_rows(held) == spark_rows(events.join(opened, "user_id", "left_semi").select("user_id", F.col("event_id").alias("id")))


def test_numbers_of_keys_do_not_hang_on_partitions(spark):
    df = spark.range(200)
    a, b = (sorted(d.select("id", grid.uniform(F.col("id"), 3).alias("u")).collect()) for d in (df, df.repartition(9)))
    assert a == b and all(0 <= r.u < 1 for r in a) and 0.4 < np.mean([r.u for r in a]) < 0.6


def test_a_patch_is_complete_once_in_the_batch_of_its_last_neighbour(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(x), int(y), k) for k, (x, y) in enumerate(rng.integers(0, 5, (60, 2)))] + [(9, 9, 60)]
    spark.createDataFrame(rows, "px int, py int, id long").repartition(6, "id").write.parquet(str(tmp_path / "points"))
    table = spark.read.parquet(str(tmp_path / "points"))
    points = ingest.read_stream(spark, str(tmp_path / "points"), table.schema)
    came = {r.id: (r.batch, r.px, r.py) for r in ingest.finish(points, str(tmp_path / "came")).collect()}
    expected = table.groupBy("px", "py").agg(F.count("*").alias("expected"))
    for _ in range(2):  # the second run finds nothing new
        done = ingest.finish(ingest.completed(points, expected), str(tmp_path / "done")).collect()
        want = {}
        for px, py in {(x, y) for x, y, _ in rows}:
            near = [b for b, x, y in came.values() if abs(x - px) <= 1 and abs(y - py) <= 1]
            want[px, py] = (max(near), len(near))
        assert {(r.px, r.py): (r.batch, r.n) for r in done} == want and len(done) == len(want)
    assert len({b for b, _ in want.values()}) > 1


def test_chunk_states_over_frames_batches_and_a_restart(spark, tmp_path):
    from geolode.functions.camera import Camera
    from geolode.streaming import frames

    rng = np.random.default_rng(8)
    tiles = [(k, 1000.0 * (k % 5), 1000.0 * (k // 5), 0.0, 1000.0 * (k % 5) + 900, 1000.0 * (k // 5) + 900, 50.0, int(rng.integers(1, 5))) for k in range(20)]
    table = spark.createDataFrame(tiles, "tile_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, n_chunks int")
    views = [(f, float(rng.uniform(0, 6)), float(rng.uniform(-1.4, -0.3)), float(rng.uniform(300, 2500)), float(rng.uniform(0, 5000)), float(rng.uniform(0, 4000)), 0.0) for f in range(24)]
    schema = "frame long, yaw double, pitch double, radius double, target_x double, target_y double, target_z double"
    camera = Camera(width=640, height=360)
    first = F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda k: ((F.col("tile_id") + k) % 4).cast("int"))
    want, states = set(), {t[0]: np.array([(t[0] + k) % 4 for k in range(t[7])], np.int32) for t in tiles}
    for f, yaw, pitch, radius, *target in views:
        planes = Camera(yaw, pitch, radius, tuple(target), 640, 360).planes
        for t in tiles:
            low, high = np.array(t[1:4]), np.array(t[4:7])
            seen = all((p[:3] * np.where(p[:3] > 0, high, low)).sum() + p[3] >= 0 for p in planes)
            before, after = states[t[0]], states[t[0]].copy()
            for c, s in enumerate(before):
                after[c] = {0: 1 if seen else 0, 1: 2, 2: 2 if seen else 3, 3: 0}[s]
                want |= {(t[0], f, c, a) for a, k in (("READ", 1), ("UNLOAD", 3)) if s != k and after[c] == k}
            states[t[0]] = after
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", frames.STORE)
    try:
        got = []
        for some in (views[:10], views[10:15], views[8:]):  # the last one repeats frames
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
            stream = ingest.read_stream(spark, str(tmp_path / "frames"), spark.read.parquet(str(tmp_path / "frames")).schema)
            out = ingest.finish(frames.actions(stream, table, camera, first), str(tmp_path / "out"))
            got = [(r.tile_id, r.frame, r.chunk_idx, r.action) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(got) == len(set(got)) and set(got) == want and len({a for *_, a in want}) == 2


def test_textures_over_any_split_of_the_points(spark, tmp_path, monkeypatch):
    from geolode.streaming import textures

    monkeypatch.setattr(textures, "EVERY", 3)
    rng = np.random.default_rng(11)
    rows = [tuple(int(v) for v in (*rng.integers(0, 2, 2), *rng.integers(0, 3, 2), *rng.integers(0, 256, 4))) for _ in range(300)]
    table = spark.createDataFrame(rows, "px int, py int, tx int, ty int, r int, g int, b int, a int")
    want = {}
    for *key, r, g, b, a in rows:
        s = want.setdefault(tuple(key), [0] * 5)
        want[tuple(key)] = [x + y for x, y in zip(s, (r, g, b, a, 1))]
    want = {(*k, *[v // s[4] for v in s[:4]], s[4]) for k, s in want.items() if s[4] > 2}
    assert textures.textures(spark, str(tmp_path / "none")).collect() == []
    for low, high, parts in ((0, 90, 1), (90, 100, 2), (100, 300, 5)):
        spark.createDataFrame(rows[low:high], table.schema).repartition(parts).write.mode("append").parquet(str(tmp_path / "points"))
        n = textures.load(ingest.read_stream(spark, str(tmp_path / "points"), table.schema), str(tmp_path / "t"))
    assert n == 7  # eight batches, two bases
    assert {tuple(r) for r in textures.textures(spark, str(tmp_path / "t")).collect()} == want


def test_splat_shuffles_samples_and_not_their_offsets(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(k), int(x), int(y), float(h)) for k, x, y, h in zip(rng.integers(0, 4, 200), rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.uniform(0, 9, 200))]
    df = spark.createDataFrame(rows, "k int, ix int, iy int, h double").repartition(5)
    plan = raster.splat(df, ["k"], 30)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    monkeypatch.setattr(raster, "PAIRS", 1000)
    want = {}
    for k, x, y, h in rows:
        for dx in range(-10, 11):
            for dy in range(-10, 11):
                d = 1 - (dx * dx + dy * dy) ** 0.5 / 10
                if d > 0 and 0 <= x + dx < 30 and 0 <= y + dy < 30:
                    w = 1 - np.exp(-d / 10.1)
                    s = want.setdefault((k, x + dx, y + dy), [0.0, 0.0, 0])
                    want[k, x + dx, y + dy] = [s[0] + h * w, s[1] + w, s[2] + 1]
    got = {(r.k, r.ix, r.iy): (r.h, r.n) for r in raster.splat(df, ["k"], 30).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == s[2] and got[k][0] == pytest.approx(s[0] / s[1], abs=1e-6) for k, s in want.items())


def shuffled_rows(df):
    """Rows that the shuffles of a frame wrote."""
    df.collect()

    def rows(node):
        stage, children = node.nodeName(), node.children()
        inner = [node.executedPlan()] if stage == "AdaptiveSparkPlan" else [node.plan()] if stage.endswith("QueryStage") else [children.apply(k) for k in range(children.size())]
        own = node.metrics().get("shuffleRecordsWritten").get().value() if stage == "Exchange" else 0
        return own + sum(map(rows, inner))

    return rows(df._jdf.queryExecution().executedPlan())


def test_normals_shuffle_a_cell_once_and_not_to_each_side(spark, monkeypatch):
    rng = np.random.default_rng(3)
    h = {(x, y): float(v) for (x, y), v in zip(((x, y) for x in range(-70, 130) for y in range(-70, 130)), rng.integers(0, 50, 40000), strict=True) if rng.random() < 0.97}
    cells = spark.createDataFrame([(*k, v) for k, v in h.items()], "ix int, iy int, h double").repartition(32, "ix", "iy")
    monkeypatch.setattr(projections, "raster20", lambda t: cells)
    found = projections.prj_normal(None)
    want = {}
    for x, y in h:
        if all(k in h for k in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))):
            n = np.array([h[x - 1, y] - h[x + 1, y], h[x, y - 1] - h[x, y + 1], 40.0])
            want[x, y] = n / np.sqrt(n @ n)
    rows = found.collect()
    got = {(r.ix, r.iy): (r.nx, r.ny, r.nz) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(np.allclose(got[k], n, atol=6e-7) for k, n in want.items())
    assert shuffled_rows(found) < 2.2 * len(h)  # the one shuffle here, and the one of the cells before


def test_normals_beside_cells_without_a_height_are_those_of_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 30000
    at = pd.DataFrame({"l_orderkey": rng.integers(0, 10**6, n), "l_partkey": rng.integers(0, 10**6, n), "l_suppkey": rng.choice([1, 2, 11], n), "l_linenumber": rng.integers(1, 8, n).astype("int32"), "l_quantity": rng.integers(1, 51, n).astype(float), "l_extendedprice": 1.0})
    at["l_shipdate"] = pd.Timestamp("2020-01-01")
    spark.createDataFrame(at).withColumn("l_quantity", F.when(F.rand(5) < 0.3, F.col("l_quantity"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    names, rows = spark_rows(registry.queries()["prj_normal"](spark, str(tmp_path)))
    assert any("None" in r for r in rows) and any("None" not in r for r in rows)
    assert (names, rows) == sql_rows(registry.oracle_sql()["prj_normal"], str(tmp_path))


@pytest.mark.parametrize("name", ["st_tables", "st_complete", "st_actions", "agg_splat", "snk_off", "snk_stl", "jn_nn", "jn_knn"])
def test_tiles_whose_coordinates_pass_32_bits(spark, sf_dir, tmp_path, name):
    far = 300_000  # tiles; yi is some 3 thousand millions there
    for table in ("lineitem", "nation"):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        (df.withColumn("l_suppkey", F.col("l_suppkey") + far) if table == "lineitem" else df).write.parquet(str(tmp_path / f"{table}.parquet"))
    t = Tables(spark, str(tmp_path))
    assert t.points.agg(F.min("yi")).first()[0] > 2**31 and t.world.first()["origin_y"] > 2**31 * 0.01
    # moved to the world's origin the tiles are the same ones, but for the last bits of their places
    rows = registry.queries()[name](spark, str(tmp_path)).count()
    if name != "st_actions":  # its views are of the world as it is
        assert rows == registry.queries()[name](spark, sf_dir).count()


def test_files_of_far_tiles_have_an_offset_and_give_their_places(spark, tmp_path):
    p = pts(50).assign(yi=lambda d: d["yi"] + 3 * 10**9, xi=lambda d: d["xi"] - 3 * 10**9)
    made = spark.createDataFrame([("tile_1.las", bytearray(las.write_las(p)))], "path string, content binary")
    las.register(spark)
    made.write.format("files").option("path", f"file://{tmp_path}/out").mode("append").save()  # a URI, as spark.checkpoint.dir often is
    got = spark.read.format("las").load(f"{tmp_path}/out").orderBy("point_idx").toPandas()
    assert len(got) == 50 and all(np.allclose(got[a], p[f"{a}i"] * 0.01, atol=1e-6) for a in "xyz")
    head = spark.read.format("las").option("what", "headers").load(f"{tmp_path}/out").first()
    assert head.offset_z == 0 and head.offset_y == pytest.approx(p["yi"].min() * 0.01) == head.min_y
    with pytest.raises(ValueError, match="32 bits"):
        las.write_las(p.assign(yi=np.arange(50) * 10**8))


def test_meshes_of_a_task_are_made_together_and_are_those_of_each_patch(spark):
    from geolode.sources import sinks

    rng = np.random.default_rng(5)
    rows = [(int(k % 5), 3, float(x), float(y), float(z)) for k, (x, y, z) in enumerate(rng.integers(0, 20, (300, 3)))] + [(7, 3, 1.0, 1.0, 5.0)]
    at = spark.createDataFrame(rows, "px int, py int, lx double, ly double, lz double")
    made = {"stl": sinks.mesh_files(at), "off": sinks.off_files(at)}
    assert not any("InPandas" in m._jdf.queryExecution().executedPlan().toString() for m in made.values())  # a call for each patch
    got = {k: {tuple(r)[:-1]: tuple(r)[-1] for r in m.collect()} for k, m in made.items()}
    for px in (0, 1, 2, 3, 4, 7):
        lowest = {(x, y): z for p, _, x, y, z in sorted(rows, reverse=True) if p == px}
        p = np.array(sorted((x, y, z) for (x, y), z in lowest.items()))
        centred = p[:, :2] - p[:, :2].mean(0)
        faces = heightmap.triangulate(centred / max(np.abs(centred).max(), 1e-9))
        assert got["off"][px, 3] == sinks.off(p, faces) and got["stl"][f"{px}_3.stl",] == sinks.stl(p, faces)


def test_tiles_of_a_block_share_a_call(spark):
    from geolode.streaming import frames

    class Handle:
        kept = None

        def getValueState(self, name, schema):
            return self

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    states, handle = frames.ChunkStates(), Handle()
    states.init(handle)
    rows = lambda frame: pd.DataFrame({"tile_id": [9, 4], "frame": frame, "first": [[0, 2], [2]], "visible": [True, False]})
    given = [list(states.handleInputRows((0,), iter([rows(f)]), None)) for f in (0, 1, 1)]
    assert [sorted(map(tuple, pd.concat(g).to_numpy().tolist())) for g in given] == [[(4, 0, 0, "UNLOAD"), (9, 0, 0, "READ")], [], []]


def test_patches_are_completed_a_block_at_a_time(spark, tmp_path):
    table = spark.createDataFrame([(x, -x, 0) for x in range(-40, 40)], "px int, py int, id long")
    table.write.parquet(str(tmp_path / "points"))
    found = ingest.completed(ingest.read_stream(spark, str(tmp_path / "points"), table.schema, 100), table.groupBy("px", "py").agg(F.count("*").alias("expected")))
    assert "FlatMapGroupsInPandasWithState" in found._jdf.queryExecution().analyzed().toString() and "bx#" in found._jdf.queryExecution().analyzed().toString()
    done = ingest.finish(found, str(tmp_path / "done")).collect()
    assert {(r.px, r.py): r.n for r in done} == {(x, -x): 2 if x in (-40, 39) else 3 for x in range(-40, 40)} and len(done) == 80


def test_splatted_heights_are_rounded_in_the_task(spark):
    samples = spark.createDataFrame([(1, 3, 4, 2.5), (1, 4, 4, 1.1234567)], "k int, ix int, iy int, h double")
    found = raster.splat(samples, ["k"], 16)
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.h == round(r.h, 6) for r in found.collect())
    values = np.array([-1.0000005, 2.4999999, 0.1234564999, 1e9 + 0.25, 0.0])
    assert raster.rounded(values).tolist() == [-1.000001, 2.5, 0.123456, 1e9 + 0.25, 0.0]
