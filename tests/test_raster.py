"""Raster operators against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from normatile.functions import pixels as px
from normatile.functions import seeded
from normatile.operators import raster


def cube_table(spark, cube, value="v"):
    """(image, y, x, c) array to rows."""
    axes = np.meshgrid(*[np.arange(n) for n in cube.shape], indexing="ij")
    data = {n: a.ravel() for n, a in zip(("image_id", "y", "x", "c"), axes)}
    return spark.createDataFrame(pd.DataFrame({**data, value: cube.ravel()}))


def to_cube(df, shape, value="v"):
    keys = ["image_id", "y", "x", "c"][: len(shape)]
    return df.toPandas().sort_values(keys)[value].to_numpy().reshape(shape)


def mask_table(spark, cube):
    return cube_table(spark, cube[..., None], "m").drop("c")


def correlate(image, kernel):
    ky, kx = kernel.shape
    padded = np.pad(image, ((ky // 2,) * 2, (kx // 2,) * 2), mode="reflect")
    out = np.zeros_like(image, dtype=float)
    for dy in range(ky):
        for dx in range(kx):
            out += kernel[dy, dx] * padded[dy : dy + image.shape[0], dx : dx + image.shape[1]]
    return out


def extreme(image, reach, pick):
    h, w = image.shape
    return np.array(
        [[pick(image[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]) for x in range(w)] for y in range(h)]
    )


def test_morphology(spark, rng):
    cube = (rng.random((2, 9, 13)) < 0.3).astype(int)
    df = mask_table(spark, cube)
    cases = [
        (raster.dilate(df, 5, 2), lambda m: extreme(m, 4, np.max)),
        (raster.erode(df, 3, 1), lambda m: extreme(m, 1, np.min)),
        (raster.close(df, 3), lambda m: extreme(extreme(m, 1, np.max), 1, np.min)),
    ]
    for out, want in cases:
        got = to_cube(out, cube.shape, "m")
        assert all((got[i] == want(cube[i])).all() for i in range(2))
    ring = {tuple(r) for r in raster.boundary(df, 3, 1).collect()}
    want = {
        (i, y, x) for i in range(2) for y in range(9) for x in range(13)
        if extreme(cube[i], 1, np.max)[y, x] and not extreme(cube[i], 1, np.min)[y, x]
    }
    assert ring == want


def holes(cube, rng, share=0.2):
    """Places to leave out, corners and a whole line and column among them."""
    gone = rng.random(cube.shape[:3]) < share
    gone[0, 2, :] = gone[0, :, 3] = True
    gone[0, 0, 0] = gone[0, -1, -1] = True
    return gone


def without(df, gone):
    spots = [(int(i), int(y), int(x)) for i, y, x in zip(*np.nonzero(gone))]
    return df.join(df.sparkSession.createDataFrame(spots, "image_id long, y long, x long"), ["image_id", "y", "x"], "left_anti")


def by_place(df, *names):
    return {(r.image_id, r.y, r.x): tuple(r[n] for n in names) for r in df.collect()}


def test_missing_pixels_keep_their_place_in_neighbourhoods(spark, rng):
    cube = (rng.random((2, 9, 13)) < 0.3).astype(float)
    gone = holes(cube, rng)
    gone[1, -1, -1] = False  # the second image keeps its size
    df = without(mask_table(spark, cube), gone)
    for out, reach, pick in ((raster.dilate(df, 3), 1, np.nanmax), (raster.erode(df, 5), 2, np.nanmin)):
        got = by_place(out, "m")
        for i in range(2):
            image = np.where(gone[i], np.nan, cube[i])
            for y in range(9):
                for x in range(13):
                    if gone[i, y, x]:
                        assert (i, y, x) not in got
                        continue
                    window = image[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]
                    assert got[i, y, x] == (pick(window),)
    assert raster.dilate(mask_table(spark, np.zeros((1, 1, 8))).where("x <> 2"), 3).count() == 7


def test_a_convolution_over_a_missing_pixel_is_unknown(spark, rng):
    cube = rng.integers(0, 256, (1, 7, 9, 1)).astype(float)
    df = cube_table(spark, cube).where("not (y = 3 and x = 4)")
    got = by_place(raster.gaussian_blur(df, 3, 1.0), "v")
    want = correlate(cube[0, :, :, 0], np.outer(raster.gaussian_kernel(3, 1.0), raster.gaussian_kernel(3, 1.0)))
    assert len(got) == 62
    for (_, y, x), (v,) in got.items():
        assert v is None if abs(y - 3) <= 1 and abs(x - 4) <= 1 else v == pytest.approx(want[y, x])
    small = by_place(raster.resize(df, 6), "v")
    assert len(small) == 36 and sum(v is None for (v,) in small.values()) == 4
    full = by_place(raster.resize(cube_table(spark, cube), 6), "v")
    assert all(v is None or v == full[k][0] for k, (v,) in small.items())


def test_blends_and_overlays_with_missing_pixels(spark, rng):
    patch, dest = (rng.integers(0, 256, (1, 8, 8, 3)).astype(float) for _ in range(2))
    mask = (rng.random((1, 8, 8)) < 0.5).astype(float)
    gone = np.zeros((1, 8, 8), bool)
    gone[0, 3, 5] = True
    for blend in (raster.blend_images, raster.seamless_blend):
        out = blend(cube_table(spark, patch), without(cube_table(spark, dest), gone), mask_table(spark, mask))
        assert out.count() == 63 * 3 and out.where("y = 3 and x = 5").count() == 0
        assert out.where("v is null").count() == 0
    heat = without(mask_table(spark, np.full((1, 8, 8), 0.5)).withColumnRenamed("m", "value"), gone)
    out = raster.overlay_heatmap(cube_table(spark, patch), heat, 0.5, "gray")
    assert out.count() == 192
    assert sorted(r.v for r in out.where("y = 3 and x = 5").collect()) == sorted(patch[0, 3, 5].astype(int).tolist())


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")


def test_one_shuffle_by_image(spark, rng):
    cube = cube_table(spark, rng.integers(0, 256, (1, 4, 4, 3)).astype(float))
    mask = mask_table(spark, np.ones((1, 4, 4)))
    offsets = spark.createDataFrame([(0, 0, 0)], "image_id long, dy int, dx int")
    assert exchanges(raster.seamless_blend(cube, cube, mask)) == 1
    assert exchanges(raster.blend_images(cube, cube, mask)) == 1
    assert exchanges(raster.gaussian_blur(cube, 3, 1.0)) == 1
    assert exchanges(raster.boundary(mask)) == 1
    assert exchanges(raster.overlay_heatmap(cube, mask.withColumnRenamed("m", "value"))) == 1
    assert exchanges(raster.overlay_region(cube, cube.withColumn("m", F.lit(1)), offsets)) <= 3


def test_moments_of_any_box(spark, rng):
    cube = rng.integers(0, 256, (2, 12, 10, 3)).astype(float)
    gone = holes(cube, rng)
    df = without(cube_table(spark, cube), gone)
    boxes = [(i, k, int(x), int(y), int(x + rng.integers(0, 9)), int(y + rng.integers(0, 9))) for i in range(3) for k, (x, y) in enumerate(rng.integers(-4, 14, (25, 2)))]
    table = spark.createDataFrame(boxes, "image_id long, box int, bx0 int, by0 int, bx1 int, by1 int")
    got = {(r.image_id, r.box): (r.mean, r.std) for r in raster.region_moments(df, table, ["box"]).collect()}
    assert len(got) == len(boxes)
    for i, k, x0, y0, x1, y1 in boxes:
        window = np.empty(0)
        if i < 2:
            window = np.where(gone[i][:, :, None], np.nan, cube[i])[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)].ravel()
            window = window[~np.isnan(window)]
        assert got[i, k] == ((None, None) if not len(window) else (pytest.approx(window.mean()), pytest.approx(window.std(), abs=1e-9)))


def test_every_target_keeps_a_row(spark, rng):
    cube = rng.integers(0, 256, (1, 20, 20, 1)).astype(float)
    targets = spark.createDataFrame([(0, 0, 1, 1, 4, 4), (0, 1, 90, 90, 4, 4), (0, 2, 2, 2, 4, 4), (5, 0, 0, 0, 4, 4), (None, 0, 0, 0, 4, 4)], "image_id long, target_id int, x int, y int, w int, h int")
    drawn = [(0, 0, 0, 200, 200), (0, 0, 1, 10, 10), (0, 1, 0, 5, 5), (0, 1, 1, 9, 9), (5, 0, 3, 10, 10)]
    candidates = spark.createDataFrame(drawn, "image_id long, target_id int, candidate_id int, x int, y int")
    out = {(r.image_id, r.target_id): (r.candidate_id, r.x, r.cost is None) for r in raster.match_region(cube_table(spark, cube), targets, candidates).collect()}
    assert out == {(0, 0): (1, 10, False), (0, 1): (0, 5, True), (0, 2): (None, None, True), (5, 0): (3, 10, True), (None, 0): (None, None, True)}


def test_convolutions(spark, rng):
    cube = rng.integers(0, 256, (2, 8, 11, 3)).astype(float)
    df = cube_table(spark, cube)
    g = np.outer(raster.gaussian_kernel(5, 1.2), raster.gaussian_kernel(5, 1.2))
    sx = np.outer([1, 2, 1], [-1, 0, 1])
    blur, gx = to_cube(raster.gaussian_blur(df, 5, 1.2), cube.shape), to_cube(raster.sobel(df, "x"), cube.shape)
    gy, both = to_cube(raster.sobel(df, "y"), cube.shape), to_cube(raster.gradient_sum(df), cube.shape)
    for i in range(2):
        for c in range(3):
            image = cube[i, :, :, c]
            assert np.allclose(blur[i, :, :, c], correlate(image, g))
            assert np.allclose(gx[i, :, :, c], correlate(image, sx))
            assert np.allclose(gy[i, :, :, c], correlate(image, sx.T))
            assert np.allclose(both[i, :, :, c], correlate(image, sx + sx.T))


def test_resize_uses_its_own_scale_per_axis(spark, rng):
    cube = rng.random((1, 6, 10, 1))
    got = to_cube(raster.resize(cube_table(spark, cube), 8), (1, 8, 8, 1))[0, :, :, 0]

    def weights(n):
        m = np.zeros((8, n))
        for d in range(8):
            f = (d + 0.5) * n / 8 - 0.5
            i = int(np.clip(np.floor(f), 0, n - 1))
            w = 0.0 if f < 0 or f >= n - 1 else f - i
            m[d, i] += 1 - w
            m[d, min(i + 1, n - 1)] += w
        return m

    assert np.allclose(got, weights(6) @ cube[0, :, :, 0] @ weights(10).T)


def test_seamless_blend(spark, rng):
    patch, dest = (rng.uniform(0, 255, (1, 16, 16, 3)) for _ in range(2))
    soft = np.clip(rng.random((1, 16, 16)) * 0.2, 0, 1)
    soft[0, 5:10, 5:10] = 0.9
    out = raster.seamless_blend(cube_table(spark, patch), cube_table(spark, dest), mask_table(spark, soft), 0.7)
    binary = (soft[0] > 0.5).astype(int)
    ring = (extreme(binary, 4, np.max) - extreme(binary, 4, np.min))[:, :, None]
    mask = soft[0][:, :, None]
    want = patch[0] * mask * 0.7 + dest[0] * (1 - mask * 0.7)
    sx = np.outer([1, 2, 1], [-1, 0, 1])
    pg, dg = (
        np.stack([sum(correlate(np.floor(im[0, :, :, c]), k) for k in (sx, sx.T)) for c in range(3)], axis=-1)
        for im in (patch, dest)
    )
    assert np.allclose(to_cube(out, patch.shape)[0], want + ring * (dg - pg) * 0.3)


def test_flip_overlay_and_grid(spark, rng):
    cube = rng.integers(0, 256, (2, 6, 6, 3))
    df = cube_table(spark, cube)
    got = to_cube(raster.flip(df, F.col("image_id") == 1, 6), cube.shape)
    assert (got[0] == cube[0]).all() and (got[1] == cube[1][:, ::-1]).all()
    region = cube_table(spark, np.full((2, 2, 2, 3), 7)).withColumn("m", (F.col("x") == 0).cast("int"))
    offsets = spark.createDataFrame([(0, 3, 1), (1, 0, 4)], "image_id long, dy int, dx int")
    placed = to_cube(raster.overlay_region(df, region, offsets), cube.shape)
    want = cube.copy()
    want[0, 3:5, 1] = 7
    want[1, 0:2, 4] = 7
    assert (placed == want).all()
    grid = to_cube(raster.draw_grid(df, 2, 6, 6), cube.shape)
    lines = np.zeros((6, 6), bool)
    lines[[2, 4]] = True
    lines[:, [2, 4]] = True
    assert (grid[0][lines] == [0, 255, 0]).all() and (grid[0][~lines] == cube[0][~lines]).all()


def test_highlight_and_heatmap_overlay(spark, rng):
    cube = rng.integers(0, 256, (1, 6, 6, 3))
    labels = spark.createDataFrame([(0, k, int(k == 4)) for k in range(9)], "image_id long, patch_idx long, y_true int")
    got = to_cube(raster.highlight_patches(cube_table(spark, cube), labels, 2, 3), cube.shape)
    want = cube.copy()
    want[0, 2:4, 2:4] = np.rint(cube[0, 2:4, 2:4] * 0.6 + np.array([255, 0, 0]) * 0.4)
    assert (got == want).all()
    heat = mask_table(spark, np.linspace(0, 1, 36).reshape(1, 6, 6)).withColumnRenamed("m", "value")
    grey = to_cube(raster.overlay_heatmap(cube_table(spark, cube), heat, 0.5, "gray"), cube.shape)
    tone = np.floor(np.minimum(np.floor(np.linspace(0, 1, 36) * 256), 255) / 255 * 255).reshape(6, 6, 1)
    assert np.abs(grey[0] - (cube[0] + tone) / 2).max() <= 1


def test_colour_map_ends(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "v double").select("v", px.colorize(F.col("v")).alias("c"))
    colours = {r.v: tuple(r.c) for r in df.collect()}
    assert colours[0.0] == (10, 0, 0) and colours[1.0] == (255, 255, 255) and colours[0.5][0] == 255


def distance(p, a, b):
    p, a, b = (np.array(v, float) for v in (p, a, b))
    d = b - a
    t = 0.0 if not d.any() else np.clip((p - a) @ d / (d @ d), 0, 1)
    return np.linalg.norm(p - a - t * d)


def test_segment_buffer_finds_exactly_the_near_pixels(spark):
    segs = [(0, 0, 3, 4, 20, 9, 2), (0, 1, 10, 10, 10, 10, 3), (1, 0, 0, 23, 23, 0, 1)]
    segments = spark.createDataFrame(segs, "image_id long, seg_id int, x1 int, y1 int, x2 int, y2 int, width int")
    pixels = mask_table(spark, np.zeros((2, 24, 24))).drop("m")
    got = {(r.image_id, r.seg_id, r.y, r.x): (round(r.distance, 9), r.zone) for r in raster.segment_buffer(pixels, segments, 8).collect()}
    want = {}
    for i, s, x1, y1, x2, y2, w in segs:
        for y in range(24):
            for x in range(24):
                d = distance((x, y), (x1, y1), (x2, y2))
                if d <= 2 * w:
                    want[(i, s, y, x)] = (round(d, 9), "core" if d <= w else "shadow")
    assert got == want


def test_segment_shade_multiplies(spark):
    cube = np.full((1, 24, 24, 1), 200.0)
    segs = [(0, 0, 3, 4, 20, 9, 3), (0, 1, 3, 4, 3, 20, 3)]
    segments = spark.createDataFrame(segs, "image_id long, seg_id int, x1 int, y1 int, x2 int, y2 int, width int")
    got = to_cube(raster.segment_shade(cube_table(spark, cube), segments, 0.3, 8), cube.shape)[0, :, :, 0]
    want = np.full((24, 24), 200.0)
    for _, _, x1, y1, x2, y2, w in segs:
        for y in range(24):
            for x in range(24):
                d = distance((x, y), (x1, y1), (x2, y2))
                if d <= w:
                    want[y, x] *= 1 - 0.45 * (1 - (d / w) ** 0.5) * 0.9
                elif d <= 2 * w:
                    want[y, x] *= 1 - 0.45 * (1 - (d - w) / w) * 0.4
                if np.hypot(x - x1, y - y1) <= w - 1:
                    want[y, x] *= 0.5
    assert np.allclose(got, want)


def test_match_region(spark, rng):
    cube = rng.integers(0, 256, (1, 30, 30, 1)).astype(float)
    targets = spark.createDataFrame([(0, 0, 2, 3, 6, 5), (0, 1, 20, 20, 6, 5)], "image_id long, target_id int, x int, y int, w int, h int")
    drawn = [(0, 0, k, int(rng.integers(0, 25)), int(rng.integers(0, 26))) for k in range(10)] + [(0, 1, k, 20 + k, 20) for k in range(3)]
    candidates = spark.createDataFrame(drawn, "image_id long, target_id int, candidate_id int, x int, y int")
    out = {r.target_id: r for r in raster.match_region(cube_table(spark, cube), targets, candidates).collect()}
    win = lambda x, y: cube[0, y : y + 5, x : x + 6]
    cost = {
        k: abs(win(x, y).mean() - win(2, 3).mean()) + 0.5 * abs(win(x, y).std() - win(2, 3).std())
        for _, t, k, x, y in drawn if t == 0 and not (abs(x - 2) < 6 * 0.7 and abs(y - 3) < 5 * 0.7)
    }
    best = min(cost, key=cost.get)
    assert out[0].candidate_id == best and out[0].cost == pytest.approx(cost[best])
    assert out[1].candidate_id == 0 and out[1].cost is None


def test_pixel_maths(spark):
    df = spark.createDataFrame([(100.0, 1, 1.0)], "v double, c int, m double")
    v, c, m = F.col("v"), F.col("c"), F.col("m")
    row = df.select(
        px.normalize_pixel(v, c), px.shift_channel(v, c, 1, 5.0, m), px.shift_channel(v, c, 0, 5.0, m),
        px.scale_brightness(v, 1.4, m), px.stain(v, F.lit(10.0), F.lit(0.5), 0.7), px.mix(v, F.lit(0.0), 0.25),
        px.blob(F.lit(3), F.lit(4), F.lit(0), F.lit(0), 5.0), px.to_byte(F.lit(2.5)), px.to_byte(F.lit(300.0)),
    ).first()
    assert list(row) == pytest.approx(
        [(100 / 255 - 0.4578275) / 0.26130258, 105, 100, 140, 100 * 0.65 + 10 * 0.35, 75, np.exp(-0.5), 2, 255]
    )


def test_jitter(spark, rng):
    cube = rng.integers(0, 256, (1, 4, 4, 3)).astype(float)
    got = to_cube(raster.jitter(cube_table(spark, cube), F.lit(1.05), F.lit(0.95)), cube.shape)
    lit = np.clip(cube * 1.05, 0, 255)
    grey = (lit @ [0.2989, 0.587, 0.114]).mean()
    assert np.allclose(got, np.clip(0.95 * lit + 0.05 * grey, 0, 255))


def test_seeded_columns(spark):
    df = spark.range(20000)
    keys = (F.col("id"),)
    out = df.select(
        seeded.uniform(1, *keys).alias("u"), seeded.gaussian(1, *keys).alias("g"),
        seeded.seeded_flag(0.2, 1, *keys).cast("int").alias("f"),
        seeded.seeded_choice(F.array(F.lit("a"), F.lit("b")), 1, *keys).alias("c"),
    ).toPandas()
    assert out["u"].between(0, 1, inclusive="left").all() and abs(out["u"].mean() - 0.5) < 0.01
    assert abs(out["g"].mean()) < 0.03 and abs(out["g"].std() - 1) < 0.03
    assert abs(out["f"].mean() - 0.2) < 0.02 and abs((out["c"] == "a").mean() - 0.5) < 0.02
    with pytest.raises(ValueError):
        seeded.seeded_flag(1.2, 1, *keys)
    rough = df.select(px.blob(F.lit(0), F.lit(0), F.lit(0), F.lit(0), 5.0, 3, F.col("id")).alias("b")).toPandas()["b"]
    assert rough.between(0.8, 1.0).all() and rough.nunique() > 100
