"""Path functions against the operating system's own."""

import os
import posixpath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vistaq.functions import paths
from vistaq.schemas import model_space, short_model_name, thresholds

NAMES = ["a.JPG", "b.png", ".hidden.jpg", "_under.jpg", ".jpg", "t.txt", "v.mp4", "c d.webp", "..x.png", "archive.tar.gz", "noext", "pct%20é.jpg", "a.", "...jpg", "a..jpg"]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_extension_is_splitext(spark):
    found = spark.createDataFrame([(f"/d.ir/{n}",) for n in NAMES], "p string").select("p", paths.extension(F.col("p")).alias("e")).collect()
    assert {r.p: r.e for r in found} == {f"/d.ir/{n}": os.path.splitext(n)[1].lower().lstrip(".") for n in NAMES}


def test_two_scans_differ(spark):
    rows = spark.createDataFrame([(f"/d/{n}",) for n in NAMES], "p string")
    media = {r.p[3:] for r in rows.where(paths.is_media(F.col("p"))).collect()}
    images = {r.p[3:] for r in rows.where(paths.is_image_name(F.col("p"))).collect()}
    assert ".jpg" in images and ".jpg" not in media
    assert "v.mp4" in media and "v.mp4" not in images
    assert {"a.JPG", ".hidden.jpg", "_under.jpg", "c d.webp"} <= media & images


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "..", ".", "", "c.d"]), max_size=6), min_size=40, max_size=40))
def test_canonical_is_normpath(spark, parts):
    raw = ["/" + "/".join(p) for p in parts]
    found = spark.createDataFrame([(i, p) for i, p in enumerate(raw)], "i int, p string").select("i", paths.canonical(F.col("p")).alias("c")).collect()
    assert {r.i: r.c for r in found} == {i: posixpath.normpath("/" + p.lstrip("/")) for i, p in enumerate(raw)}


@pytest.mark.parametrize(
    ("path", "folder", "inside", "caption"),
    [
        ("/a/b/c.jpg", "/a/b", True, "b/c.jpg"),
        ("/ab/c.jpg", "/a", False, "/ab/c.jpg"),
        ("/a/x.png", "/a", True, "a/x.png"),
        ("/a/x.png", "/", True, "/a/x.png"),
        ("/a", "/a", True, "a/."),
    ],
)
def test_folder_containment(spark, path, folder, inside, caption):
    p, f = F.col("p"), F.col("f")
    assert one(spark, paths.is_under(p, f), p=path, f=folder) is inside
    assert one(spark, paths.relative_caption(p, f), p=path, f=folder) == caption


def test_folder_list(spark):
    assert one(spark, paths.listed_folders(F.col("t")), t=" /a \n\nplain\n/b/c\n") == ["/a", "/b/c"]


def test_model_names():
    assert short_model_name("google/siglip2-so400m-patch16-512") == "siglip2-so400m"
    assert short_model_name("openai/clip-vit-large-patch14") == "clip-vit-large"
    assert short_model_name("x/clip-b") == "clip-b" and short_model_name("x/CLIP.b") == "clip.b"
    assert short_model_name("hub/ViT-B.32") == "vit_b_32"
    assert model_space("a/siglip2-so400m-x") != model_space("a/siglip2-so400m-y")
    assert thresholds("x/clip-vit-large-patch14").text == 22.0
    assert thresholds("x/other").text == 20.0 and thresholds("siglip-y").text == -8.0
