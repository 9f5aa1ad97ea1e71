"""Queries against their SQL where the last image lacks patches, as on tables that are no multiple of 25 vectors."""

import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from normatile.operators import raster
from tests.oracle import TABLES, compare, connect

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"

pytestmark = pytest.mark.skipif(not os.path.isdir(LARGE), reason="test tables are not there")


def cut(spark, folder, source, vectors):
    """The tables with the first ``vectors`` vectors of ``source`` alone."""
    for name in TABLES:
        if name != "embeddings" and os.path.exists(f"{SMALL}/{name}.parquet"):
            os.symlink(f"{SMALL}/{name}.parquet", f"{folder}/{name}.parquet")
    frame = spark.read.parquet(f"{source}/embeddings.parquet").where(f"vec_id < {vectors}").toPandas()
    frame.to_parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def check(spark, sf, name):
    assert compare(spark, connect(sf), name, queries()[name], oracle_sql()[name], sf) == ""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """By number of patches in the last image: tables of few images."""
    return {k: cut(spark, tmp_path_factory.mktemp("cut"), SMALL, 25 * 7 + k) for k in (3, 6, 13)}


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    """Enough images for profiles of 64 dimensions."""
    return {k: cut(spark, tmp_path_factory.mktemp("scored"), LARGE, 25 * 79 + k) for k in (6, 7)}


@pytest.mark.parametrize("held", [6])
@pytest.mark.parametrize("name", ["prune_patches", "prune_patches_as_shipped"])
def test_pruning(spark, scored, held, name):
    check(spark, scored[held], name)


@pytest.mark.parametrize("held", [6])
@pytest.mark.parametrize("name", ["fused_patch_score", "fused_image_score_full"])
def test_fused(spark, scored, held, name):
    check(spark, scored[held], name)


@pytest.mark.parametrize("held", [6, 7])
@pytest.mark.parametrize("name", ["heatmap_display", "colorize_heatmap", "overlay_heatmap", "heatmap_percentile"])
def test_heat(spark, scored, held, name):
    check(spark, scored[held], name)


@pytest.mark.parametrize("held", [6, 7])
@pytest.mark.parametrize("name", ["pixel_auroc", "evaluation_report", "pixel_auroc_joined"])
def test_pixel_auroc(spark, scored, held, name):
    check(spark, scored[held], name)


@pytest.mark.parametrize("held", [3, 6, 13])
@pytest.mark.parametrize("name", ["blend_images", "gaussian_blur", "sobel_x", "sobel_y", "overlay_region", "segment_shade", "region_match", "region_moments", "resize_images"])
def test_rasters(spark, tables, held, name):
    check(spark, tables[held], name)


def test_tasks_of_a_blend_hold_so_many_rows(spark, monkeypatch):
    """However small the rows are when packed."""
    monkeypatch.setattr(raster, "ROWS_AT_ONCE", 64)
    pixels = spark.sql("SELECT i AS image_id, y, x, 0 AS c, 1 AS v FROM range(40) a(i), range(4) b(y), range(4) c(x)")
    both = raster.stacked("image_id", {"patch": pixels, "dest": pixels}, {"m": (pixels, "v")})
    held = both.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in held) == 640 and len(held) > 8 and max(r["count"] for r in held) <= 160
