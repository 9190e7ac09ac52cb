"""Paths, ids and media types as Columns."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import IMAGE_EXTENSIONS, MEDIA_EXTENSIONS, VIDEO_EXTENSIONS


def resolve(path: str) -> str:
    """An input path on the driver: home and working directory filled in, dots removed."""
    return os.path.normpath(os.path.abspath(os.path.expanduser(path)))


def canonical(path: Column) -> Column:
    """Normal form of an absolute path: no empty, ``.`` or ``..`` parts."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def key(path: Column, fold_case: bool = False) -> Column:
    """What paths are compared by: the path itself, or its lower case with one kind of slash."""
    return F.lower(F.replace(path, F.lit("/"), F.lit("\\"))) if fold_case else path


def stable_id(text: Column) -> Column:
    return F.sha2(text, 256)


def _prefix(folder: Column) -> Column:
    return F.when(folder == "/", folder).otherwise(F.concat(folder, F.lit("/")))


def is_under(path: Column, folder: Column) -> Column:
    """Whether the path is the folder or lies in it, part by part."""
    return (path == folder) | F.startswith(path, _prefix(folder))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_caption(path: Column, folder: Column) -> Column:
    """The folder's name and the path inside it; the whole path if it lies elsewhere."""
    name = F.when(folder == "/", folder).otherwise(base_name(folder))
    inside = F.when(path == folder, F.lit(".")).otherwise(F.substring(path, F.length(_prefix(folder)) + 1, F.length(path)))
    joined = F.when(name == "/", F.concat(name, inside)).otherwise(F.concat(name, F.lit("/"), inside))
    return F.when(is_under(path, folder), joined).otherwise(path)


def extension(path: Column) -> Column:
    """Lower-cased extension without its dot; dots in front of a name don't begin one."""
    return F.lower(F.regexp_extract(base_name(path), r"^[.]*[^.].*?[.]([^.]*)$", 1))


def is_media(path: Column) -> Column:
    return extension(path).isin(MEDIA_EXTENSIONS)


def is_image_name(path: Column) -> Column:
    """The looser test of the duplicate scan: the name ends in an image extension, a bare one included."""
    return F.lower(path).rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + ")$")


def media_type(path: Column) -> Column:
    return F.when(extension(path).isin(VIDEO_EXTENSIONS), F.lit("video")).otherwise(F.lit("image"))


def path_and_caption(metadata: str, document: Column) -> tuple[Column, Column]:
    """Result path and caption from a metadata struct, with the document as second choice."""
    m = lambda f: F.col(f"{metadata}.{f}")
    path = F.coalesce(F.nullif(m("path"), F.lit("")), document, F.lit(""))
    caption = F.when(F.length(m("folder_path")) > 0, relative_caption(path, m("folder_path"))).otherwise(F.coalesce(F.nullif(m("relative_path"), F.lit("")), base_name(path)))
    return path, caption


def short_model_name(name: Column) -> Column:
    """The Column form of ``schemas.short_model_name``."""
    last = F.lower(F.element_at(F.split(name, "/"), -1))
    parts = F.split(last, "-")
    return (
        F.when(F.contains(last, F.lit("siglip2")), F.array_join(F.slice(parts, 1, 2), "-"))
        .when(F.contains(last, F.lit("clip")), F.array_join(F.slice(parts, 1, 3), "-"))
        .otherwise(F.translate(last, "-.", "__"))
    )


def model_kind(name: Column) -> Column:
    return F.when(F.contains(F.lower(name), F.lit("siglip")), F.lit("siglip")).otherwise(F.lit("clip"))


def listed_folders(text: Column) -> Column:
    """Folder paths of a text with one a line: trimmed, not blank, with a separator in them."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & F.contains(x, F.lit("/")))
