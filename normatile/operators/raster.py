"""Raster operators on pixel tables ``(image_id, y, x, c, v)``.

Pixels are dealt by image once. Neighbourhood operators then pack them into lines inside the tasks: a
line is one row of an image with a place for every pixel, NULL where one is missing, so a gap moves
nothing. Both axes, and what comes beside the pixels (masks, second images, heat), use that one
shuffle; pixels are never multiplied. Coordinates count from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from normatile.functions import pixels as px
from normatile.operators.ordering import join_null_safe
from normatile.operators.rollups import axis_weight, patch_of
from normatile.session import materialize

SOBEL_SMOOTH = [1.0, 2.0, 1.0]
SOBEL_DIFF = [-1.0, 0.0, 1.0]
# Rows that a task works on, or one image's if it has more.
ROWS_AT_ONCE = 1 << 19
HERE = "_here"  # of a line: which places hold a pixel

Line = dict[str, Column]
Tap = Callable[[Line, Column], Line]


def pixel_table(df: DataFrame) -> DataFrame:
    """Mark a side of a join as pixel-sized: its rows were generated, so Spark's size estimate (which
    knows only the small input) must not make it a broadcast."""
    return df.hint("merge")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by ``by`` over so many tasks that each has ``ROWS_AT_ONCE`` of them.

    Rows are counted first: pixels compress so well that partitions joined up by their bytes hold ever more of them.
    """
    tasks = max(-(-df.count() // ROWS_AT_ONCE), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *by)


def beside(base: DataFrame, extra: DataFrame, values: Sequence[str], place: Sequence[str], by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Adds ``values`` of ``extra`` to the rows of ``base`` with the same ``place``; NULL where there are none.

    A left join without a join: both tables are dealt by ``by`` together, once, and a window over each
    place hands its values on. ``extra`` has one row per place (of several, the largest value counts).
    """
    values, place = list(values), list(place)
    kinds = {f.name: f.dataType for f in [*base.schema.fields, *extra.select(*values).schema.fields]}
    left = base.select(*base.columns, *[F.lit(None).cast(kinds[v]).alias(v) for v in values], F.lit(True).alias("_base"))
    given = {*place, *values}
    right = extra.select(
        *[F.col(c) if c in given else F.lit(None).cast(kinds[c]).alias(c) for c in [*base.columns, *values]], F.lit(False).alias("_base")
    )
    both = left.unionByName(right).repartition(*by)
    w = W.partitionBy(*place)
    return both.withColumns({v: F.max(v).over(w) for v in values}).where("_base").drop("_base")


def packed_lines(df: DataFrame, axis: str, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Image lines along ``axis``: ``keys``, the other coordinate, an array per name, and HERE.

    All lines of an image (``keys``) have the same length, up to its last pixel. If ``df`` is dealt
    by ``keys`` or fewer columns, nothing is shuffled.
    """
    keys, other = list(keys), "y" if axis == "x" else "x"
    cells = F.array_sort(F.collect_list(F.struct(F.col(axis).cast("int").alias("_at"), *names)))
    rows = df.groupBy(*keys, other).agg(cells.alias("_rows"))
    rows = rows.withColumn("_size", F.max(F.element_at("_rows", -1)["_at"] + 1).over(W.partitionBy(*keys)))
    at, places = F.col("_rows._at"), F.sequence(F.lit(0), F.col("_size") - 1)
    full = at == places

    def line(values: Column) -> Column:
        return F.when(full, values).otherwise(F.transform(places, lambda i: F.get(values, (F.array_position(at, i) - 1).cast("int"))))

    here = F.when(full, F.array_repeat(F.lit(True), F.col("_size"))).otherwise(F.transform(places, lambda i: F.array_contains(at, i)))
    return rows.select(*keys, other, *[line(F.col(f"_rows.{n}")).alias(f"_{n}") for n in names], here.alias(HERE))


def over_lines(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], across: Tap, along: Tap, size: int | None = None, by: Sequence[str] | None = None
) -> DataFrame:
    """Two passes over an image: ``across`` every row of pixels, then ``along`` every column of what that gave.

    A pass gets the line's arrays by name and a place, and gives the new values there. Pixels that are
    missing stay missing. With ``size`` lines are read at that many places instead, missing ones too.
    ``by=()`` says that ``df`` is dealt by image already; by default it is dealt by ``keys``.
    """
    keys = list(keys)
    df = df.repartition(*(keys if by is None else by)) if by is None or by else df

    def passed(lines: DataFrame, axis: str, names: Sequence[str], tap: Tap) -> tuple[DataFrame, list[str]]:
        other = "y" if axis == "x" else "x"
        line = {n: F.col(f"_{n}") for n in names}
        fields: list[str] = []

        def at(i: Column) -> Column:
            found = tap(line, i)
            fields[:] = found
            here = F.lit(True) if size else F.coalesce(F.get(HERE, i), F.lit(False))
            return F.struct(*[v.alias(n) for n, v in found.items()], here.alias(HERE))

        places = F.sequence(F.lit(0), F.lit(size - 1) if size else F.size(HERE) - 1)
        out = lines.select(*keys, other, F.posexplode(F.transform(places, at)).alias(axis, "_b"))
        return out.select(*keys, "y", "x", "_b.*"), fields

    first, names = passed(packed_lines(df, "x", keys, values), "x", values, across)
    lines = packed_lines(first.withColumnRenamed(HERE, "h"), "y", keys, [*names, "h"])
    lines = lines.withColumn(HERE, F.transform("_h", lambda h: F.coalesce(h, F.lit(False)))).drop("_h")
    second, names = passed(lines, "y", names, along)
    return second.where(HERE).select(*keys, "y", "x", *names)


def _reach(line: Column, i: Column, reach: int) -> Column:
    """The part of a line within ``reach`` of place ``i``; places outside it do not take part."""
    first = F.greatest(i - reach, F.lit(0))
    return F.slice(line, first + 1, F.least(i + reach, F.size(line) - 1) - first + 1)


def window_extreme(df: DataFrame, size: int, iterations: int, largest: bool, keys: Sequence[str], value: str) -> DataFrame:
    """Largest or smallest value in a square window, ``iterations`` times over; missing pixels don't count.

    A square window is a row window followed by a column window, and n passes of a k-window equal
    one pass of an (n (k - 1) + 1)-window.
    """
    reach = (size // 2) * iterations
    pick = F.array_max if largest else F.array_min

    def tap(line: Line, i: Column) -> Line:
        return {value: pick(_reach(line[value], i, reach))}

    return over_lines(df.withColumn(value, F.col(value).cast("double")), keys, [value], tap, tap)


def dilate(df: DataFrame, size: int = 3, iterations: int = 1, keys: Sequence[str] = ("image_id",), value: str = "m") -> DataFrame:
    return window_extreme(df, size, iterations, True, list(keys), value)


def erode(df: DataFrame, size: int = 3, iterations: int = 1, keys: Sequence[str] = ("image_id",), value: str = "m") -> DataFrame:
    return window_extreme(df, size, iterations, False, list(keys), value)


def close(df: DataFrame, size: int = 3, keys: Sequence[str] = ("image_id",), value: str = "m") -> DataFrame:
    """Dilate, then erode: fills holes smaller than the window."""
    return erode(dilate(df, size, 1, keys, value), size, 1, keys, value)


def mask_difference(larger: DataFrame, smaller: DataFrame, keys: Sequence[str] = ("image_id",), value: str = "m") -> DataFrame:
    """Pixels set in the first mask only."""
    place = [*keys, "y", "x"]
    return larger.where(F.col(value) > 0).select(*place).join(
        pixel_table(smaller.where(F.col(value) > 0).select(*place)), place, "left_anti"
    )


def _spread(high: Column, low: Column, i: Column, reach: int) -> Line:
    return {"high": F.array_max(_reach(high, i, reach)), "low": F.array_min(_reach(low, i, reach))}


def boundary(mask: DataFrame, size: int = 5, iterations: int = 2, keys: Sequence[str] = ("image_id",), value: str = "m") -> DataFrame:
    """Ring around the edge of a mask: dilated minus eroded, both found in one pass per axis."""
    keys, reach = list(keys), (size // 2) * iterations
    both = over_lines(
        mask, keys, [value],
        lambda line, i: _spread(line[value], line[value], i, reach), lambda line, i: _spread(line["high"], line["low"], i, reach),
    )
    return both.where((F.col("high") > 0) & ~(F.col("low") > 0)).select(*keys, "y", "x")


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    at = np.arange(size) - (size - 1) / 2.0
    weights = np.exp(-(at**2) / (2.0 * sigma**2))
    return (weights / weights.sum()).tolist()


def _tap(line: Column, i: Column, kernel: Sequence[float]) -> Column:
    """Weighted sum around place ``i``; beyond the ends the line is mirrored, edge not repeated. NULL if a pixel is missing."""
    last, half = F.size(line) - 1, len(kernel) // 2
    total = F.lit(0.0)
    for k, weight in enumerate(kernel):
        if weight:
            total = total + float(weight) * F.get(line, last - F.abs(last - F.abs(i + (k - half))))
    return total


def convolve(
    df: DataFrame, kernel_x: Sequence[float], kernel_y: Sequence[float],
    keys: Sequence[str] = ("image_id", "c"), value: str = "v",
) -> DataFrame:
    """Correlate with a separable kernel; borders mirror without repeating the edge pixel.

    A pixel whose window lacks a pixel has no result: NULL.
    """
    wide = df.withColumn(value, F.col(value).cast("double"))
    return over_lines(
        wide, keys, [value], lambda line, i: {value: _tap(line[value], i, kernel_x)}, lambda line, i: {value: _tap(line[value], i, kernel_y)}
    )


def _gradient_across(line: Column, i: Column) -> Line:
    return {"d": _tap(line, i, SOBEL_DIFF), "s": _tap(line, i, SOBEL_SMOOTH)}


def _gradient_along(line: Line, i: Column) -> Column:
    return _tap(line["d"], i, SOBEL_SMOOTH) + _tap(line["s"], i, SOBEL_DIFF)


def gradient_sum(df: DataFrame, keys: Sequence[str] = ("image_id", "c"), value: str = "v") -> DataFrame:
    """Sum of the 3 x 3 gradients along x and y, both in one pass per axis."""
    wide = df.withColumn(value, F.col(value).cast("double"))
    return over_lines(
        wide, keys, [value], lambda line, i: _gradient_across(line[value], i), lambda line, i: {value: _gradient_along(line, i)}
    )


def gaussian_blur(df: DataFrame, size: int, sigma: float, keys: Sequence[str] = ("image_id", "c"), value: str = "v") -> DataFrame:
    kernel = gaussian_kernel(size, sigma)
    return convolve(df, kernel, kernel, keys, value)


def sobel(df: DataFrame, axis: str, keys: Sequence[str] = ("image_id", "c"), value: str = "v") -> DataFrame:
    """3 x 3 gradient along one axis."""
    if axis == "x":
        return convolve(df, SOBEL_DIFF, SOBEL_SMOOTH, keys, value)
    return convolve(df, SOBEL_SMOOTH, SOBEL_DIFF, keys, value)


def stacked(image: str, pixels: dict[str, DataFrame], masks: dict[str, tuple[DataFrame, str]], gaps: bool = False) -> DataFrame:
    """Several images and masks of the same place side by side: ``image, y, x, c`` and a column per name.

    ``pixels`` are tables with ``c, v``, ``masks`` tables without channels and their value's name. All
    tables are counted, then dealt by image together, once; pixels that one of them lacks are left out, or with
    ``gaps`` kept, NULL in what is lacking.
    """
    names = [*pixels, *masks]

    def part(df: DataFrame, name: str, value: str, channel: Column) -> DataFrame:
        values = [(F.col(value) if n == name else F.lit(None)).cast("double").alias(n) for n in names]
        return df.select(image, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), channel.cast("int").alias("c"), *values)

    parts = [part(df, n, "v", F.col("c")) for n, df in pixels.items()] + [part(df, n, v, F.lit(None)) for n, (df, v) in masks.items()]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    both = dealt(both, image)
    merged = both.groupBy(image, "y", "x", "c").agg(*[F.max(n).alias(n) for n in names])
    w = W.partitionBy(image, "y", "x")
    spread = merged.withColumns({n: F.max(n).over(w) for n in masks})
    there = F.col("c").isNotNull()
    for n in [] if gaps else names:
        there = there & F.col(n).isNotNull()
    return spread.where(there)


def blend_images(
    patch: DataFrame, dest: DataFrame, mask: DataFrame, alpha: float = 0.7, image: str = "image_id", gaps: bool = False
) -> DataFrame:
    """``patch`` over ``dest`` by a soft mask: ``(image, y, x, c, v)``; pixels that one of the three lacks are left out, or NULL with ``gaps``."""
    both = stacked(image, {"patch": patch, "dest": dest}, {"m": (mask, "m")}, gaps)
    return both.select(image, "y", "x", "c", px.blend(F.col("patch"), F.col("dest"), F.col("m"), alpha).alias("v"))


def seamless_blend(
    patch: DataFrame, dest: DataFrame, mask: DataFrame, alpha: float = 0.7, strength: float = 0.3,
    image: str = "image_id",
) -> DataFrame:
    """Blend ``patch`` into ``dest`` by a soft mask and pull gradients together at its edge.

    In the ring around the mask's edge, ``strength`` times the gradient difference between the two
    images (x plus y) is added; where a missing pixel leaves it unknown, nothing is added. Inputs are
    ``(image, y, x, c, v)`` and ``(image, y, x, m)``; all of it takes one shuffle by image.
    """
    # A 5 x 5 window twice over makes the ring.
    reach = (5 // 2) * 2
    both = stacked(image, {"patch": patch, "dest": dest}, {"m": (mask, "m")})

    def as_byte(value: Column) -> Column:
        return F.floor(px.clip255(value)).cast("double")

    # Gradients are linear, so the difference of gradients is the gradient of the difference.
    both = both.withColumns({"gap": as_byte(F.col("dest")) - as_byte(F.col("patch")), "hard": (F.col("m") > 0.5).cast("int")})
    kept = ["patch", "dest", "m"]

    def across(line: Line, i: Column) -> Line:
        return {n: F.get(line[n], i) for n in kept} | _gradient_across(line["gap"], i) | _spread(line["hard"], line["hard"], i, reach)

    def along(line: Line, i: Column) -> Line:
        return {n: F.get(line[n], i) for n in kept} | {"pull": _gradient_along(line, i)} | _spread(line["high"], line["low"], i, reach)

    done = over_lines(both, [image, "c"], [*kept, "gap", "hard"], across, along, by=())
    ring = (F.col("high") > 0) & ~(F.col("low") > 0)
    mixed = px.blend(F.col("patch"), F.col("dest"), F.col("m"), alpha)
    correction = F.when(ring, F.coalesce("pull", F.lit(0.0)) * strength).otherwise(0.0)
    return done.select(image, "y", "x", "c", (mixed + correction).alias("v"))


def resize(df: DataFrame, size: int, keys: Sequence[str] = ("image_id", "c"), value: str = "v", unweighted: bool = True) -> DataFrame:
    """Bilinear resize to size x size, each axis with its own scale, without smoothing; NULL where a pixel it needs is missing.

    A pixel of weight 0 is not needed; with ``unweighted=False`` it is.
    """

    def tap(line: Line, d: Column) -> Line:
        values = line[value]
        low, high, weight = axis_weight(d, F.size(values), size)
        mixed = F.get(values, low) * (1.0 - weight) + F.get(values, high) * weight
        return {value: F.when(weight == 0, F.get(values, low)).otherwise(mixed) if unweighted else mixed}

    wide = df.withColumn(value, F.col(value).cast("double"))
    return over_lines(wide, list(keys), [value], tap, tap, size=size)


def flip(df: DataFrame, flag: Column, width: int) -> DataFrame:
    """Mirror left to right where ``flag`` is true."""
    return df.withColumn("x", F.when(flag, F.lit(width - 1) - F.col("x")).otherwise(F.col("x")))


def jitter(df: DataFrame, brightness: Column, contrast: Column, keys: Sequence[str] = ("image_id",), value: str = "v") -> DataFrame:
    """Scale brightness, then contrast around the image's mean grey level.

    Grey uses the fixed luma weights .2989, .587, .114 of channels 0, 1, 2.
    """
    keys = list(keys)
    lit = df.withColumn(value, px.clip255(F.col(value) * brightness))
    luma = F.get(F.array(F.lit(0.2989), F.lit(0.587), F.lit(0.114)), F.col("c"))
    grey = lit.groupBy(*keys).agg((F.sum(F.col(value) * luma) * 3.0 / F.count("*")).alias("_grey"))
    mixed = contrast * F.col(value) + (1.0 - contrast) * F.col("_grey")
    return join_null_safe(lit, grey, keys).withColumn(value, px.clip255(mixed)).select(*df.columns)


def overlay_region(
    base: DataFrame, region: DataFrame, offsets: DataFrame, keys: Sequence[str] = ("image_id",), value: str = "v"
) -> DataFrame:
    """Write masked window pixels into images at an offset; all other pixels keep their value.

    ``region`` has window coordinates and ``m``; ``offsets`` gives ``dx, dy`` per image.
    """
    keys = list(keys)
    channel = ["c"] if "c" in base.columns else []
    place = [*keys, "y", "x", *channel]
    placed = join_null_safe(region.where(F.col("m") > 0), offsets, keys).select(
        *keys, (F.col("y") + F.col("dy")).cast(base.schema["y"].dataType).alias("y"),
        (F.col("x") + F.col("dx")).cast(base.schema["x"].dataType).alias("x"), *channel, F.col(value).alias("_new"),
    )
    return beside(base, placed, ["_new"], place, keys).withColumn(value, F.coalesce("_new", value)).drop("_new")


# --- windows and regions ------------------------------------------------------------------------


def tiles_of(low: Column, high: Column, tile: int) -> Column:
    """Tile numbers that the half-open range [low, high) touches."""
    return F.sequence(F.floor(low / tile), F.floor((high - 1) / tile))


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, tile: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Join pixels to the boxes that hold them: ``bx0 <= x < bx1`` and ``by0 <= y < by1``.

    Boxes are listed under each tile they touch; pixels and boxes then meet by tile.
    """
    keys = list(keys)
    spread = boxes.withColumn("_ty", F.explode(tiles_of(F.col("by0"), F.col("by1"), tile)))
    spread = spread.withColumn("_tx", F.explode(tiles_of(F.col("bx0"), F.col("bx1"), tile)))
    tiled = pixels.withColumns({"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile)})
    inside = (
        (F.col("x") >= F.col("bx0")) & (F.col("x") < F.col("bx1"))
        & (F.col("y") >= F.col("by0")) & (F.col("y") < F.col("by1"))
    )
    return tiled.join(spread, [*keys, "_ty", "_tx"]).where(inside).drop("_ty", "_tx")


def area_tables(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Summed-area tables as lines: ``image, y, n, s, q``, sums over all pixels up to line y and each x.

    ``n`` counts pixels, ``s`` and ``q`` sum values and their squares, over all channels. Pixels are
    dealt by image; lines go by in order of y and only the last line's sums are held. Missing pixels
    add nothing. A table ends at the image's last line, a line at the longest one so far.
    """
    cells = pixels.repartition(image).groupBy(image, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    v = F.col("v").cast("double")
    cells = cells.agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    rows = cells.groupBy(image, "y").agg(F.collect_list(F.struct("x", "n", "s", "q")).alias("cells"))
    rows = rows.sortWithinPartitions(image, "y")
    schema = T.StructType([rows.schema[image], *T.StructType.fromDDL("y int, n array<double>, s array<double>, q array<double>").fields])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last, sums = object(), -1, np.zeros((3, 0))
        for batch in batches:
            for k in range(batch.num_rows):
                key, y, line = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values
                x = line.field("x").to_numpy()
                if key != name:
                    name, last, sums = key, y - 1, np.zeros((3, 0))
                wide = max(sums.shape[1], int(x.max()) + 1)
                sums = np.concatenate([sums, np.repeat(sums[:, -1:] if sums.shape[1] else np.zeros((3, 1)), wide - sums.shape[1], axis=1)], axis=1)
                gap, new = range(last + 1, y), np.zeros((3, wide))
                for i, f in enumerate("nsq"):
                    new[i, x] = line.field(f).fill_null(0).to_numpy(zero_copy_only=False)
                tables = [sums] * len(gap)  # lines without a pixel repeat the sums so far
                sums = sums + np.cumsum(new, axis=1)
                tables.append(sums)
                lists = [pa.array([list(t[i]) for t in tables], pa.list_(pa.float64())) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(tables), batch.column(0).type), pa.array([*gap, y], pa.int32()), *lists], names=schema.names
                )
                last = y

    return rows.mapInArrow(summed, schema)


def region_moments(
    pixels: DataFrame, boxes: DataFrame, box_keys: Sequence[str], keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Mean and population standard deviation of the pixels in each box; NULL for a box without pixels.

    Boxes are half-open, ``bx0 <= x < bx1`` and ``by0 <= y < by1``. Each box reads four numbers of the
    image's summed-area table, two on each of two lines, however large it is.
    """
    (image,) = keys
    tables = materialize(area_tables(pixels, image), "area-tables")
    ends = tables.groupBy(image).agg(F.min("y").alias("_top"), F.max("y").alias("_end"))
    sized = join_null_safe(boxes, ends, [image], "left")
    edges = F.array(F.struct((F.col("by0") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("by1") - 1).alias("at"), F.lit(1).alias("sign")))
    lines = sized.select(image, *box_keys, "bx0", "bx1", "_top", "_end", F.inline(edges))
    # Above the table there is nothing, below it its last line holds.
    lines = lines.withColumn("y", F.when(F.col("at") >= F.col("_top"), F.least("at", "_end")).cast("int"))
    met = join_null_safe(lines, tables, [image, "y"], "left")

    def between(table: str) -> Column:
        def upto(x: Column) -> Column:
            return F.when(x >= 0, F.get(table, F.least(x, F.size(table) - 1).cast("int"))).otherwise(0.0)

        return F.sum(F.col("sign") * F.coalesce(upto(F.col("bx1") - 1) - upto(F.col("bx0") - 1), F.lit(0.0)))

    sums = met.groupBy(image, *box_keys).agg(*[between(t).alias(f"_{t}") for t in "nsq"])
    n, s, q = (F.col(f"_{t}") for t in "nsq")
    spread = F.sqrt(F.greatest(q * n - s * s, F.lit(0.0))) / n
    return sums.select(image, *box_keys, F.when(n > 0, s / n).alias("mean"), F.when(n > 0, spread).alias("std"))


def match_region(
    pixels: DataFrame, targets: DataFrame, candidates: DataFrame, separation: float = 0.7, empty: bool = True
) -> DataFrame:
    """For each target window the most similar candidate window that stays clear of it.

    ``targets``: ``image_id, target_id, x, y, w, h``. ``candidates``: ``image_id, target_id,
    candidate_id, x, y`` (a few per target, as drawn by the caller). The cost is the difference of
    means plus half that of deviations. A target without a clear candidate that has pixels gets its first
    one; every target has a row, with NULL where it has no candidate at all. With ``empty=False`` windows
    without pixels take no part, as targets or as candidates. Pixels are read once.
    """
    target_keys = ["image_id", "target_id"]
    sized = join_null_safe(candidates, targets.select(*target_keys, "w", "h"), target_keys)

    def boxed(df: DataFrame, number: Column) -> DataFrame:
        x, y = F.col("x"), F.col("y")
        return df.select(
            *target_keys, number.cast(candidates.schema["candidate_id"].dataType).alias("candidate_id"),
            x.alias("bx0"), y.alias("by0"), (x + F.col("w")).alias("bx1"), (y + F.col("h")).alias("by1"),
        )

    boxes = boxed(targets, F.lit(None)).unionByName(boxed(sized, F.col("candidate_id")))
    found = materialize(region_moments(pixels, boxes, ["target_id", "candidate_id"]), "region-moments")
    found, side = (found, "left") if empty else (found.where("mean is not null"), "inner")
    goal = found.where("candidate_id is null").select(*target_keys, F.col("mean").alias("goal_mean"), F.col("std").alias("goal_std"))
    aimed = join_null_safe(targets.select(*target_keys, F.col("x").alias("tx"), F.col("y").alias("ty"), "w", "h"), goal, target_keys, side)
    drawn = join_null_safe(candidates, found, [*target_keys, "candidate_id"], side)
    far = ~(
        (F.abs(F.col("x") - F.col("tx")) < F.col("w") * separation)
        & (F.abs(F.col("y") - F.col("ty")) < F.col("h") * separation)
    )
    cost = F.abs(F.col("mean") - F.col("goal_mean")) + 0.5 * F.abs(F.col("std") - F.col("goal_std"))
    compared = join_null_safe(aimed, drawn, target_keys, side).withColumns({"_far": far, "_cost": cost})
    clear = F.min(F.when(F.col("_far") & F.col("_cost").isNotNull(), F.struct("_cost", "candidate_id", "x", "y")))
    fallback = F.min(F.when(F.col("candidate_id").isNotNull(), F.struct("candidate_id", "x", "y")))
    best = compared.groupBy(*target_keys).agg(clear.alias("_clear"), fallback.alias("_first"))
    return best.select(
        *target_keys,
        F.coalesce("_clear.candidate_id", "_first.candidate_id").alias("candidate_id"),
        F.coalesce("_clear.x", "_first.x").alias("x"),
        F.coalesce("_clear.y", "_first.y").alias("y"),
        F.col("_clear._cost").alias("cost"),
    )


def segment_buffer(pixels: DataFrame, segments: DataFrame, tile: int = 16) -> DataFrame:
    """Pixels near a segment: ``zone`` is 'core' within ``width`` and 'shadow' within twice that.

    ``segments``: ``image_id, seg_id, x1, y1, x2, y2, width``. Adds the distance, and keeps pixels
    of the padded box (three widths) only, so distances are computed for near pixels alone.
    """
    return _zoned(pixels_in_boxes(pixels, _padded(segments), tile)).drop("bx0", "by0", "bx1", "by1")


def _zoned(hits: DataFrame) -> DataFrame:
    distance = px.segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    zone = F.when(F.col("distance") <= F.col("width"), "core").when(F.col("distance") <= F.col("width") * 2, "shadow")
    return hits.withColumn("distance", distance).withColumn("zone", zone).where(F.col("zone").isNotNull())


def _padded(segments: DataFrame) -> DataFrame:
    pad = F.col("width") * 3
    return segments.withColumns(
        {
            "bx0": F.greatest(F.lit(0), F.least("x1", "x2") - pad), "bx1": F.greatest("x1", "x2") + pad,
            "by0": F.greatest(F.lit(0), F.least("y1", "y2") - pad), "by1": F.greatest("y1", "y2") + pad,
        }
    )


def segment_shade(pixels: DataFrame, segments: DataFrame, darkness: float = 0.3, tile: int = 16) -> DataFrame:
    """Darken pixels near segments; factors of several segments multiply.

    Bright surroundings (mean of the padded box above 100) darken by 1.5 times ``darkness``, dark
    ones by .8 times. The core's end point is halved once more. Surroundings are measured before
    any darkening, so the result does not depend on segment order.
    """
    # The factors 1.5 and .8, 100, .9, .4 and .5 of the shade.
    channel = ["c"] if "c" in pixels.columns else []
    place = ["image_id", "y", "x", *channel]
    hits = pixels_in_boxes(pixels, _padded(segments), tile)
    hits = hits.withColumn("_around", F.avg("v").over(W.partitionBy("image_id", "seg_id")))
    near = _zoned(hits)
    dark = F.when(F.col("_around") > 100, darkness * 1.5).otherwise(darkness * 0.8)
    width = F.col("width").cast("double")
    core = 1.0 - dark * (1.0 - F.sqrt(F.col("distance") / width)) * 0.9
    shadow = 1.0 - dark * (1.0 - (F.col("distance") - width) / width) * 0.4
    start = F.pow(F.col("x") - F.col("x1"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y1"), F.lit(2.0))
    inner = F.greatest(F.lit(1), F.col("width") - 1)
    factor = F.when(F.col("zone") == "core", core).otherwise(shadow) * F.when(F.sqrt(start) <= inner, 0.5).otherwise(1.0)
    # A pixel and its factors meet in one aggregate: the pixel's own row brings its value and the factor 1.
    rest = [c for c in pixels.columns if c not in place]
    own = pixels.withColumn("_f", F.lit(1.0)).withColumn("_own", F.lit(True))
    shades = near.select(*place, *[F.lit(None).cast(pixels.schema[c].dataType).alias(c) for c in rest], factor.alias("_f"), F.lit(False).alias("_own"))
    met = own.unionByName(shades).groupBy(*place).agg(*[F.max(c).alias(c) for c in rest], F.product("_f").alias("_f"), F.max("_own").alias("_own"))
    return met.where("_own").withColumn("v", F.col("v") * F.col("_f")).select(*pixels.columns)


# --- overlays -----------------------------------------------------------------------------------


def highlight_patches(
    pixels: DataFrame, labels: DataFrame, patch_size: int, grid_w: int, alpha: float = 0.4,
    color: Sequence[int] = (255, 0, 0), label: str = "y_true",
) -> DataFrame:
    """Tint positive patches with a colour."""
    positive = labels.where(F.col(label) > 0.5).select("image_id", "patch_idx", F.lit(True).alias("_hit"))
    placed = pixels.withColumn("patch_idx", patch_of(F.col("x"), F.col("y"), patch_size, grid_w))
    tint = F.get(F.array(*[F.lit(float(v)) for v in color]), F.col("c"))
    mixed = px.to_byte(px.mix(F.col("v").cast("double"), tint, alpha))
    return (
        placed.join(positive, ["image_id", "patch_idx"], "left")
        .withColumn("v", F.when(F.col("_hit"), mixed).otherwise(F.col("v").cast("int")))
        .drop("_hit", "patch_idx")
    )


def draw_grid(pixels: DataFrame, patch_size: int, width: int, height: int, color: Sequence[int] = (0, 255, 0)) -> DataFrame:
    """Colour the lines between patches."""
    line = px.on_grid_line(F.col("x"), F.col("y"), patch_size, width, height)
    paint = F.get(F.array(*[F.lit(int(v)) for v in color]), F.col("c"))
    return pixels.withColumn("v", F.when(line, paint).otherwise(F.col("v").cast("int")))


def overlay_heatmap(pixels: DataFrame, heat: DataFrame, alpha: float = 0.5, color_map: str = "hot") -> DataFrame:
    """Blend a colour-mapped heatmap (values in [0, 1]) over an RGB image; pixels without heat stay as they are."""
    warm = heat.select("image_id", *[F.col(c).cast(pixels.schema[c].dataType).alias(c) for c in ("y", "x")], "value")
    rgb = px.colorize(F.col("value"), color_map)
    joined = beside(pixels, warm, ["value"], ["image_id", "y", "x"]).withColumn("_rgb", rgb)
    tone = F.get(F.array("_rgb.r", "_rgb.g", "_rgb.b"), F.col("c"))
    mixed = px.to_byte(px.mix(F.col("v").cast("double"), tone.cast("double"), alpha))
    return joined.withColumn("v", F.when(F.col("value").isNotNull(), mixed).otherwise(F.col("v").cast("int"))).drop("_rgb", "value")
