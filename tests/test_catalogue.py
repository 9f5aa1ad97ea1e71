"""Manifest, masks and pixels from a real folder tree; augmentation choices."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from normatile.functions import paths
from normatile.operators import augment, catalogue, vectors
from normatile.sources import image_scan, images, png, reports


def write_png(path, cube):
    """A minimal PNG: 8-bit grey or RGB, one filter-free block."""
    cube = np.asarray(cube, np.uint8)
    h, w = cube.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in cube)

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    header = struct.pack(">IIBBBBB", w, h, 8, 2 if cube.ndim == 3 else 0, 0, 0, 0)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    rng = np.random.default_rng(0)
    cubes = {}
    for category, split, defect, name in [
        ("screw", "train", "good", "000"), ("screw", "train", "good", "001"), ("screw", "test", "good", "000"),
        ("screw", "test", "bent", "000"), ("screw", "test", "bent", "001"), ("tile", "test", "crack", "000"),
    ]:
        cubes[(category, split, defect, name)] = rng.integers(0, 256, (4, 5, 3))
        write_png(f"{root}/{category}/{split}/{defect}/{name}.png", cubes[(category, split, defect, name)])
    write_png(f"{root}/screw/ground_truth/bent/000_mask.png", np.array([[0, 127, 128, 255, 0]] * 4))
    with open(f"{root}/screw/test/good/notes.txt", "w") as f:
        f.write("not an image")
    return root, cubes


def test_manifest_of_a_tree(spark, tree):
    root, cubes = tree
    found = images.image_manifest(spark, root)
    rows = {(r.category, r.split, r.defect_type, r.image_name): r for r in found.collect()}
    assert set(rows) == set(cubes)
    assert all(r.label == (key[2] != "good") for key, r in rows.items())
    assert rows[("screw", "test", "bent", "000")].mask_path.endswith("screw/ground_truth/bent/000_mask.png")
    assert sum(r.mask_path is not None for r in rows.values()) == 1
    ordinals = {(r.category, r.split, r.defect_type, r.image_name): r.ordinal for r in catalogue.with_ordinal(found).collect()}
    assert [ordinals[("screw", "test", d, n)] for d, n in [("bent", "000"), ("bent", "001"), ("good", "000")]] == [0, 1, 2]


def test_file_contents_are_not_read(spark, tree, capsys):
    images.list_files(spark, tree[0]).explain()
    assert "content" not in capsys.readouterr().out.split("ReadSchema")[-1]


def test_pixels_are_rgb(spark, tree):
    root, cubes = tree
    folder = f"{root}/screw/test/bent"
    out = images.image_pixels(spark, folder).where(F.col("path").endswith("000.png")).toPandas()
    got = out.sort_values(["y", "x", "c"])["v"].to_numpy().reshape(4, 5, 3)
    assert (got == cubes[("screw", "test", "bent", "000")]).all()
    mask = images.mask_pixels(spark, f"{root}/screw/ground_truth").toPandas().sort_values(["y", "x"])["m"]
    assert mask.tolist() == [0, 0, 1, 1, 0] * 4


def _encoder():
    """Two tokens per image: the mean of all numbers, twice; then the first pixel."""
    return lambda batch: np.stack([np.r_[b.mean(), b.mean(), b[0], b[1]] for b in batch])


def test_images_to_patches_by_an_encoder(spark, tree):
    root, cubes = tree
    arrays = images.image_arrays(spark, f"{root}/screw/train")
    tokens = vectors.explode_tokens(vectors.embed_images(arrays, "pixels", _encoder, 2, [60], "flat"), "flat", 2, ["path"])
    patches = vectors.drop_cls(tokens).collect()
    assert len(patches) == 2 and {p.patch_idx for p in patches} == {0}
    for p in patches:
        cube = cubes[("screw", "train", "good", p.path[-7:-4])]
        assert list(p.embedding) == [float(v) for v in cube[0, 0, :2]]


def test_audit_reports_missing_folders(spark, tree):
    audit = catalogue.dataset_audit(images.image_manifest(spark, tree[0])).collect()
    assert {(r.category, r.split) for r in audit if r.missing} == {("tile", "train"), ("tile", "test")}
    assert sum(r.n_images for r in audit) == 6


def test_subset_and_first(spark, tree):
    found = catalogue.with_ordinal(images.image_manifest(spark, tree[0])).where("category = 'screw' and split = 'test'")
    some = catalogue.subset(found, spark.createDataFrame([(2,), (7,)], "ordinal long"))
    assert [r.defect_type for r in some.collect()] == ["good"]
    assert [r.image_name for r in catalogue.first_anomalous(found, 1).collect()] == ["000"]


def test_methods(spark):
    df = spark.createDataFrame([("Screw",), ("LEATHER",), ("moon",)], "c string")
    assert [r[0] for r in df.select(catalogue.methods_for(F.col("c"))).collect()] == [["cutpaste", "crack"], ["cutpaste"], ["cutpaste"]]
    assert catalogue.check_method("wood", "crack") == "crack"
    with pytest.raises(ValueError):
        catalogue.check_method("zipper", "crack")
    assert {r.c for r in catalogue.method_errors(df, "c", "crack").collect()} == {"LEATHER", "moon"}


def test_plan_is_repeatable_whatever_the_partitioning(spark):
    df = spark.range(3000).withColumn("category", F.lit("screw"))
    plan = lambda d, seed: {r.id: r.method for r in catalogue.augmentation_plan(d, "id", "category", 0.3, seed).collect()}
    first = plan(df, 1)
    assert first == plan(df.repartition(11), 1) != plan(df, 2)
    share = sum(m is not None for m in first.values()) / 3000
    assert abs(share - 0.3) < 0.04 and {m for m in first.values() if m} == {"cutpaste", "crack"}
    fixed = catalogue.augmentation_plan(df, "id", "category", 1.0, method="crack")
    assert fixed.where("method = 'crack'").count() == 3000


def test_augmenters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, method string")
    both = lambda rows: rows.loc[rows.index.repeat(2), ["id"]].assign(k=[0, 1] * len(rows))
    none = lambda rows: rows[["id"]].assign(k=0).iloc[:0]
    out = augment.augment(df, {"a": both, "b": none}, "id long, k int")
    assert sorted(map(tuple, out.collect())) == [(1, 0), (1, 1)]
    with pytest.raises(Exception, match="unknown augmentation method"):
        augment.augment(df, {}, "id long").collect()


def test_names_and_prompt(spark):
    df = spark.createDataFrame([("/d/screw/test/bent/007.final.png",)], "p string")
    p = F.col("p")
    row = df.select(
        paths.base_name(p), paths.parent_dir(p), paths.stem(p), paths.artifact_name(paths.parent_dir(p), paths.stem(p), "heatmap"),
        paths.sample_name(F.lit(7), F.lit("x")), paths.compose_prompt(F.lit("s"), F.lit("p"), F.lit("q")),
    ).first()
    assert list(row) == ["007.final.png", "bent", "007.final", "bent_007.final_heatmap.png", "sample_007_x.png", "s\npq"]


def test_report_is_sorted_within_each_category(spark, tmp_path):
    rows = [("a" if i % 3 else "b", "good", f"{i:03d}", f"/p/{i}", float((i * 37) % 101), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "category string, defect_type string, image_name string, path string, score double, label int")
    out = str(tmp_path / "report")
    reports.write_score_report(df, out)
    for category in "ab":
        folder = f"{out}/category={category}"
        scores = []
        for name in sorted(n for n in os.listdir(folder) if n.endswith(".csv")):
            lines = open(f"{folder}/{name}").read().splitlines()
            assert lines[0] == "defect_type,image_name,image_path,anomaly_score,label,is_anomaly"
            scores += [float(line.split(",")[3]) for line in lines[1:]]
        want = sorted((r[4] for r in rows if r[0] == category), reverse=True)
        assert scores == want
    assert [r.score for r in reports.rank_images(df, tie=("path",)).collect()] == sorted((r[4] for r in rows), reverse=True)


def test_png_of_every_filter_type_and_depth():
    rng = np.random.default_rng(3)
    for shape in ((1, 1, 1), (5, 7, 3), (23, 9, 3), (3, 40, 1)):
        cube = rng.integers(0, 256, shape).astype(np.uint8)
        for kinds in ([k] * shape[0] for k in range(5)):
            assert (png.decode(png.encode(cube, np.array(kinds)), 10**6) == cube).all()
        assert (png.decode(png.encode(cube, rng.integers(0, 5, shape[0])), 10**6) == cube).all()


def packed_png(width, height, depth, colour, lines, interlaced=0, palette=b""):
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    extra = chunk(b"PLTE", palette) if palette else b""
    return png.SIGNATURE + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_of_other_kinds():
    grey = png.decode(packed_png(4, 1, 2, 0, b"\0" + bytes([0b00011011])), 100)
    assert grey.ravel().tolist() == [0, 85, 170, 255]
    colours = png.decode(packed_png(3, 1, 8, 3, b"\0" + bytes([1, 0, 1]), palette=bytes([9, 8, 7, 1, 2, 3])), 100)
    assert colours.tolist() == [[[1, 2, 3], [9, 8, 7], [1, 2, 3]]]
    deep = png.decode(packed_png(1, 1, 16, 2, b"\0" + bytes([10, 99, 20, 99, 30, 99])), 100)
    assert deep.tolist() == [[[10, 20, 30]]]
    clear = png.decode(packed_png(2, 1, 8, 6, b"\0" + bytes([1, 2, 3, 255, 4, 5, 6, 0])), 100)
    assert clear.tolist() == [[[1, 2, 3], [4, 5, 6]]]
    image = np.arange(9 * 10, dtype=np.uint8).reshape(9, 10)
    passes = b"".join(b"".join(b"\0" + row.tobytes() for row in image[y::dy, x::dx]) for x, y, dx, dy in png.PASSES if image[y::dy, x::dx].size)
    assert (png.decode(packed_png(10, 9, 8, 0, passes, interlaced=1), 100)[:, :, 0] == image).all()


def test_bad_files_are_rows(spark, tmp_path):
    """A broken, an empty, a huge and a missing file: one error row each, all other pixels."""
    rng = np.random.default_rng(5)
    cubes = {k: rng.integers(0, 256, (6, 5, 3)).astype(np.uint8) for k in range(12)}
    for k, cube in cubes.items():
        (tmp_path / f"{k}.png").write_bytes(png.encode(cube, rng.integers(0, 5, 6)))
    whole = png.encode(cubes[0])
    (tmp_path / "cut.png").write_bytes(whole[:60])
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "text.png").write_bytes(b"this is no image at all, though it has the name of one")
    (tmp_path / "flipped.png").write_bytes(whole[:50] + bytes([whole[50] ^ 1]) + whole[51:])
    huge = packed_png(10_000, 10_000, 8, 2, b"")  # 100 megapixels
    (tmp_path / "huge.png").write_bytes(huge)
    folder = str(tmp_path)
    pixels = images.image_pixels(spark, folder, partition_bytes=200).toPandas()
    assert len(pixels) == 12 * 90
    for path, part in pixels.groupby("path"):
        got = part.sort_values(["y", "x", "c"])["v"].to_numpy().reshape(6, 5, 3)
        assert (got == cubes[int(path.rsplit("/", 1)[1][:-4])]).all()
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in images.image_errors(spark, folder).collect()}
    assert set(errors) == {"cut.png", "empty.png", "text.png", "flipped.png", "huge.png"} and "10000 x 10000" in errors["huge.png"]
    assert images.image_arrays(spark, folder).count() == 12
    # Only listed files are opened, in partitions of about the wanted size; one that is gone is a row too.
    files = image_scan.list_images(spark, folder).where(F.col("path").rlike("/[0-9]+.png$") & ~F.col("path").endswith("/3.png"))
    listed = files.unionByName(spark.createDataFrame([(f"{folder}/gone.png", 10)], "path string, length long"))
    out = image_scan.scan_images(listed, partition_bytes=400)
    assert out.rdd.getNumPartitions() > 3
    rows = out.toPandas()
    assert rows["error"].notna().sum() == 1 and not rows["path"].str.endswith("/3.png").any() and len(rows) == 11 * 90 + 1
    assert image_scan.scan_images(files.where("false")).count() == 0
    with pytest.raises(ValueError):
        image_scan.scan_images(files, "cubes")


def test_images_are_written_and_read_again(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, y, x, c, int(rng.integers(0, 256))) for i in (1, 2) for y in range(5) for x in range(4) for c in range(3)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, c int, v int").repartition(7)
    files = image_scan.write_images(df, str(tmp_path / "out"))
    assert {r.path.rsplit("/", 1)[1] for r in files.collect()} == {"1.png", "2.png"}
    back = image_scan.scan_images(files).select(F.regexp_extract("path", r"(\d).png$", 1).cast("long").alias("i"), "y", "x", "c", "v")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
