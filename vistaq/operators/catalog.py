"""Joins and rules between scanned files, stored records and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..schemas import RECORD, SCHEMA_VERSION
from ..sources.shared import written

#: Folders up to which a list of them is sent along with the plan.
FEW_FOLDERS = 4096


def present(items: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Items whose key is held."""
    return items.join(held.select(key).distinct(), key, "left_semi").select(*items.columns)


def missing(items: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Items whose key is not held."""
    return items.join(held.select(key).distinct(), key, "left_anti").select(*items.columns)


def added(after: DataFrame, before: DataFrame) -> DataFrame:
    """Distinct rows that were not there before."""
    return after.subtract(before)


def counts_by(items: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """Rows of each key as ``n``, and those that meet each condition."""
    return items.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def page(items: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordered listing."""
    return items.orderBy(*order).offset(offset).limit(limit)


def registered(rows: DataFrame, key: str, since: str, order: list[Column]) -> DataFrame:
    """One row for each key: the last in the order, with the first time of all in ``since``."""
    others = [c for c in rows.columns if c not in (key, since)]
    best = rows.groupBy(key).agg(F.min(since).alias(since), F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return best.select(key, since, "__row.*").select(*rows.columns)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row for each key, the first in an order that must be total.

    An aggregate of structs rather than a window: tasks reduce their own rows
    before the shuffle, so one key with a third of all rows is no burden.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*others)
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row")) if order else df.groupBy(*keys).agg(F.first(row).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row for each key, the last in the order."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def records_needing_embedding(scanned: DataFrame, stored: DataFrame, id_: str = "media_id") -> DataFrame:
    """Scanned rows that are new or whose mtime or size changed."""
    old = stored.select(F.col(id_), F.col("mtime").alias("__mtime"), F.col("size").alias("__size"), F.lit(True).alias("__old"))
    joined = scanned.join(old, id_, "left")
    return joined.where(F.col("__old").isNull() | (F.col("mtime") != F.col("__mtime")) | (F.col("size") != F.col("__size"))).select(*scanned.columns)


def records_moved(scanned: DataFrame, stored: DataFrame, id_: str = "media_id", owner: str = "folder_id") -> DataFrame:
    """Scanned rows that are as stored but for their owner."""
    old = stored.select(F.col(id_), F.col("mtime").alias("__mtime"), F.col("size").alias("__size"), F.col(owner).alias("__owner"))
    joined = scanned.join(old, id_)
    return joined.where((F.col("mtime") == F.col("__mtime")) & (F.col("size") == F.col("__size")) & (F.col(owner) != F.col("__owner"))).select(*scanned.columns)


def stale(stored: DataFrame, scanned: DataFrame, id_: str = "media_id") -> DataFrame:
    """Stored rows that the scan no longer finds."""
    return stored.join(scanned.select(id_).distinct(), id_, "left_anti")


def classify(stored: DataFrame, scanned: DataFrame, id_: str = "media_id", version: tuple[str, ...] = ("mtime", "size")) -> DataFrame:
    """id and status (new, changed, stale, same) of every row of either side, in one pass."""
    old = stored.select(F.col(id_), F.struct(*version).alias("__old"))
    new = scanned.select(F.col(id_), F.struct(*version).alias("__new"))
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "stale").when(F.col("__old") != F.col("__new"), "changed").otherwise("same")
    return old.join(new, id_, "full").select(id_, status.alias("status"))


def owners(items: DataFrame, folders: DataFrame, path: str = "path_key", folder: str = "folder_key") -> DataFrame:
    """All columns of ``items`` with ``folder``: the deepest folder that holds the path, null if none does.

    Up to FEW_FOLDERS folders travel as a set in the plan, and each path looks
    up its own prefixes there without a shuffle.  With more, each path is spread
    to its prefixes, which then meet the folders by equality: rows grow by the
    depth of a path, never by the number of folders.
    """
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    known = folders.select(F.col(folder).alias("__folder")).distinct()
    few = [r[0] for r in known.where("__folder is not null").limit(FEW_FOLDERS + 1).collect()]
    if len(few) <= FEW_FOLDERS:
        held = F.filter(prefixes, lambda x: x.isin(*few))  # in order of depth
        return items.drop(folder).withColumn(folder, F.try_element_at(held, F.lit(-1)) if few else F.lit(None).cast("string"))
    spread = items.select(path).distinct().withColumn("__folder", F.explode(F.array_distinct(prefixes)))
    deepest = spread.join(known, "__folder").groupBy(path).agg(F.max_by("__folder", F.length("__folder")).alias(folder))
    return items.drop(folder).join(deepest, path, "left")


def captions(items: DataFrame, folders: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """All columns of ``items`` with ``caption``: relative to the deepest folder, or the path itself."""
    owned = owners(items, folders, path, folder)
    return owned.withColumn("caption", F.when(F.col(folder).isNull(), F.col(path)).otherwise(paths.relative_caption(F.col(path), F.col(folder))))


def records(scanned: DataFrame, folder: str, fold_case: bool = False) -> DataFrame:
    """Media records of the files of one folder (a resolved path)."""
    where = F.lit(folder)
    key = paths.key(F.col("path"), fold_case)
    return scanned.select(
        paths.stable_id(key).alias("media_id"), F.col("path"), key.alias("path_key"), paths.stable_id(paths.key(where, fold_case)).alias("folder_id"), where.alias("folder_path"), paths.key(where, fold_case).alias("folder_key"),
        paths.relative_caption(F.col("path"), where).alias("relative_path"), paths.media_type(F.col("path")).alias("media_type"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"), F.coalesce("size", F.lit(0)).cast("long").alias("size"),
    )


def metadata(df: DataFrame) -> DataFrame:
    """Records with the struct that travels beside the vector."""
    return df.withColumn("metadata", F.struct(*RECORD.names, F.lit(SCHEMA_VERSION).alias("schema_version")))


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """A batch number for each row: fixed-size slices in order.

    Ranks come from a range sort, written once, and the counts of its partitions:
    no task ever holds all rows.
    """
    ordered = written(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__in", F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33))
    before = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = ordered.join(F.broadcast(before.select("__part", "__before")), "__part")  # one row a partition
    return joined.withColumn("batch", F.floor((F.col("__before") + F.col("__in")) / size).cast("long")).drop("__part", "__at", "__in", "__before")


def sample(df: DataFrame, k: int, seed: int | None = None, id_: str = "media_id") -> DataFrame:
    """k rows drawn evenly without replacement, in random order; a seed makes it repeatable whatever the partitions and the engine."""
    if k <= 0:
        return df.limit(0)
    draw = F.rand() if seed is None else F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")), 256)
    return df.orderBy(draw, id_).limit(k)
