"""Column expressions on file paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_part(path: Column, from_end: int) -> Column:
    """A path component counted from the end: 1 is the file, 2 its folder."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def base_name(path: Column) -> Column:
    return path_part(path, 1)


def parent_dir(path: Column) -> Column:
    return path_part(path, 2)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def artifact_name(defect_type: Column, image_name: Column, suffix: str) -> Column:
    """``<defect>_<image>_<suffix>.png``"""
    return F.concat(F.concat_ws("_", defect_type, image_name, F.lit(suffix)), F.lit(".png"))


def sample_name(index: Column, image_name: Column) -> Column:
    """``sample_007_<image>.png``"""
    return F.format_string("sample_%03d_%s.png", index, image_name)


def compose_prompt(system: Column, prefix: Column, suffix: Column) -> Column:
    return F.concat(system, F.lit("\n"), prefix, suffix)
