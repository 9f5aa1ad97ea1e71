"""Column expressions on pixel and mask values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from normatile.functions.seeded import gaussian, uniform

# Per-channel mean and standard deviation that the encoder was trained with (RGB).
CHANNEL_MEAN = [0.48145466, 0.4578275, 0.40821073]
CHANNEL_STD = [0.26862954, 0.26130258, 0.27577711]

# The "hot" colour map as (position, value) points of each channel.
HOT = {
    "r": [(0.0, 0.0416), (0.365079, 1.0), (1.0, 1.0)],
    "g": [(0.0, 0.0), (0.365079, 0.0), (0.746032, 1.0), (1.0, 1.0)],
    "b": [(0.0, 0.0), (0.746032, 0.0), (1.0, 1.0)],
}
# The "jet" colour map as (position, value) points of each channel.
JET = {
    "r": [(0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5)],
    "g": [(0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0)],
    "b": [(0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0)],
}
GRAY = {channel: [(0.0, 0.0), (1.0, 1.0)] for channel in "rgb"}
COLOR_MAPS = {"hot": HOT, "jet": JET, "gray": GRAY}


def binarize_mask(value: Column, threshold: int = 127) -> Column:
    return (value > threshold).cast("int")


def normalize_pixel(value: Column, channel: Column) -> Column:
    """Scale a byte to [0, 1] and standardise it with its channel's constants."""
    mean = F.get(F.array(*[F.lit(m) for m in CHANNEL_MEAN]), channel)
    std = F.get(F.array(*[F.lit(s) for s in CHANNEL_STD]), channel)
    return (value / F.lit(255.0) - mean) / std


def to_byte(value: Column) -> Column:
    """Round half to even and saturate to 0..255."""
    return F.least(F.greatest(F.rint(value), F.lit(0.0)), F.lit(255.0)).cast("int")


def blend(top: Column, bottom: Column, mask: Column, alpha: float) -> Column:
    """``top`` where the mask is set, weighted by ``alpha``; ``bottom`` elsewhere."""
    weight = mask * float(alpha)
    return top * weight + bottom * (1.0 - weight)


def mix(first: Column, second: Column, alpha: float) -> Column:
    """Weighted sum of two images."""
    return first * (1.0 - float(alpha)) + second * float(alpha)


def _piecewise(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return out


def colorize(value: Column, color_map: str = "hot") -> Column:
    """RGB bytes of a value in [0, 1] from a 256-step colour map: struct<r,g,b>."""
    step = F.least(F.floor(value * 256.0), F.lit(255)).cast("double") / 255.0
    channels = COLOR_MAPS[color_map]
    return F.struct(
        *[F.floor(_piecewise(step, channels[c]) * 255.0).cast("int").alias(c) for c in ("r", "g", "b")]
    )


def on_grid_line(x: Column, y: Column, patch_size: int, width: int, height: int) -> Column:
    """True on the first row or column of every patch but those at the image's edge."""
    vertical = (x % patch_size == 0) & (x > 0) & (x < (width // patch_size) * patch_size)
    horizontal = (y % patch_size == 0) & (y > 0) & (y < (height // patch_size) * patch_size)
    return vertical | horizontal


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment; a segment of length zero is a point."""
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    along = F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy)
    t = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(px - (x1 + t * dx), F.lit(2.0)) + F.pow(py - (y1 + t * dy), F.lit(2.0)))


def shift_channel(value: Column, channel: Column, target: Column | int, shift: Column | float, mask: Column) -> Column:
    """Add ``shift`` to one channel inside the mask."""
    return value + F.when(channel == target, mask * shift).otherwise(0.0)


def scale_brightness(value: Column, factor: Column | float, mask: Column) -> Column:
    """Multiply by ``factor`` inside the mask."""
    return value * (1.0 - mask) + value * factor * mask


def add_noise(value: Column, sigma: float, mask: Column, seed: int, *keys: Column) -> Column:
    """Add seeded normal noise inside the mask."""
    return value + gaussian(seed, *keys) * float(sigma) * mask


def blob(x: Column, y: Column, cx: Column, cy: Column, size: Column | float, seed: int | None = None, *keys: Column) -> Column:
    """Gaussian spot in [0, 1] around a centre; with a seed it gets a rough edge (factor .8 to 1.2)."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    d2 = F.pow((x - cx).cast("double"), F.lit(2.0)) + F.pow((y - cy).cast("double"), F.lit(2.0))
    spot = F.exp(-d2 / (2.0 * size * size))
    if seed is not None:
        spot = spot * (0.8 + 0.4 * uniform(seed, *keys))
    return F.least(F.greatest(spot, F.lit(0.0)), F.lit(1.0))


def stain(value: Column, color: Column, spot: Column, strength: float = 0.7) -> Column:
    """Blend a stain colour in by the spot's strength."""
    return value * (1.0 - spot * strength) + color * spot * strength


def clip255(value: Column) -> Column:
    return F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(255.0))
