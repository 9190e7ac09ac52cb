"""Where the operators write, and how they size a table."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from vistaq.llm import common


def without_folder(master):
    """A session without spark.checkpoint.dir, as far as shared_folder looks at it."""
    inner = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: inner)))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(without_folder(master))


def test_written_tables_are_read_back_and_sized(spark):
    rows = common.stored(spark.range(10).select("id", F.concat(F.lit("t"), "id").alias("text")))
    assert rows.count() == 10 and rows.inputFiles()[0].startswith(common.own_folder(spark).replace("file://", "file:///").replace("////", "///"))
    assert 0 < common.text_bytes(rows) < 1 << 20
    unknown = rows.rdd.map(lambda r: (r.id, "abcd")).toDF("id long, text string")
    assert common.text_bytes(unknown) == 40
    assert common.stored(rows.limit(0)).count() == 0
