"""User-supplied augmentation and transform chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def transform_chain(df: DataFrame, steps: list[Transform], inserts: list[Transform] | None = None) -> DataFrame:
    """Apply steps in order. Optional steps go in right after the first one, the latest given first."""
    chain = list(steps)
    for extra in inserts or []:
        chain.insert(1, extra)
    for step in chain:
        df = df.transform(step)
    return df


def augment(
    images: DataFrame, augmenters: dict[str, Callable[[pd.DataFrame], pd.DataFrame]], schema: str, method: str = "method"
) -> DataFrame:
    """Hand the planned images to the user's function for their method, a frame at a time; one row may give many.

    ``augmenters[name](frame)`` returns a frame of ``schema``. Rows without a method are left out, and a
    method nobody registered is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, rows in frame.groupby(method, sort=False):
                if name not in augmenters:
                    raise ValueError(f"unknown augmentation method: {name!r}")
                yield augmenters[name](rows.reset_index(drop=True))

    return images.where(F.col(method).isNotNull()).mapInPandas(run, schema)
