"""Path expressions. A path is a plain string without scheme, e.g. ``/data/imgs/tb/tb0001.png``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions.text import let


def plain_path(path: Column) -> Column:
    """Drop the scheme that Spark's file sources put in front (``file:/a``, ``file:///a``)."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", ""), r"//+", "/")


def clean_path(path: Column) -> Column:
    """Resolve ``.``, ``..`` and empty segments."""
    start = F.array().cast("array<string>")
    walked = F.aggregate(
        F.split(path, "/"),
        start,
        lambda kept, part: F.when((part == "") | (part == "."), kept)
        .when(part == "..", F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept))
        .otherwise(F.array_append(kept, part)),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    return extension(path).isin(*extensions)


def is_image(path: Column) -> Column:
    return has_extension(path, defaults.IMAGE_EXTENSIONS)


def is_annotation(path: Column) -> Column:
    ignored = F.lower(stem(path)).isin(*defaults.IGNORED_ANNOTATION_STEMS)
    return has_extension(path, defaults.ANNOTATION_EXTENSIONS) & ~ignored


def relative_path(path: Column, root: str | None) -> Column:
    """The part below ``root``; a path outside keeps all its parts."""
    if not root:
        return path
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def directories_nearest_first(path: Column) -> Column:
    return let(
        F.split(path, "/"),
        lambda parts: F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))),
    )


def file_uri(path: Column) -> Column:
    """``file://`` URI of an absolute path with every reserved byte percent-encoded."""
    encoded = F.url_encode(path)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return F.concat(F.lit("file://"), encoded)
