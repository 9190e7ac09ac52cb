"""The registered queries over the driver's tables, each beside its SQL.

``embeddings`` plays the vector store (label: the folder), ``documents`` the
catalog with virtual paths, ``labels`` what is stored already (a toxic mark
counts as a changed size), ``events`` the change feed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import encoders, paths, vectors
from .operators import catalog, duplicates, search
from .plans import ingest
from .schemas import MEDIA, MEDIA_EXTENSIONS, METADATA, SCHEMA_VERSION, THRESHOLDS, model_space, thresholds
from .sources.shared import shared_folder
from .sources.store import Change, Store
from .streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K = 50
PAIR_THRESHOLD = 0.45


def _query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_schemas: dict[str, T.StructType] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; its schema is looked up in the file once, not by a job for each query."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _vectors(spark: SparkSession, sf: str, *ids: int) -> list[list[float]]:
    """The query vectors, by one small job."""
    found = {r.vec_id: r.embedding for r in _t(spark, sf, "embeddings").where(F.col("vec_id").isin(*ids)).select("vec_id", "embedding").collect()}
    return [found[i] for i in ids]


def _vector(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    return _vectors(spark, sf, vec_id)[0]


# Extensions of the virtual paths, by doc_id % 8.
EXTENSIONS = ["jpg", "PNG", "mp4", "txt", "webp", "mkv", "gif", "md"]


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as scanned files."""
    docs = _t(spark, sf, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return docs.select("doc_id", "source", "lang", path.alias("path"), F.lit(0.0).alias("mtime"), F.col("n_chars").alias("size"))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """``labels`` as stored records: the document's size, one more if it is marked."""
    return _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.lit(0.0).alias("mtime"), (F.col("n_chars") + F.col("toxic")).alias("size"))


FILES_SQL = f"""SELECT doc_id, source, lang, '/corpus/' || source || '/' || lang || '/' || doc_id || '.' || ([{", ".join(f"'{x}'" for x in EXTENSIONS)}])[doc_id % 8 + 1] AS path, n_chars AS size FROM documents"""
DOT_SQL = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
COS_SQL = f"{DOT_SQL} / (greatest(sqrt({DOT_SQL.format(a='{a}', b='{a}')}), 1e-8) * greatest(sqrt({DOT_SQL.format(a='{b}', b='{b}')}), 1e-8))"


def _cos_sql(a: str, b: str) -> str:
    return COS_SQL.format(a=a, b=b)


def _topk_sql(where: str = "TRUE", vec: int = 0) -> str:
    return f"""SELECT vec_id, label, {_cos_sql("e.embedding", "q.embedding")} AS c
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec}) q WHERE {where} ORDER BY c DESC, vec_id LIMIT {K}"""


# search


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("score", 6).alias("score"))


@_query(f"SELECT vec_id, round(c, 6) AS score FROM ({_topk_sql()}) WHERE c * 100.0 > 10.0")
def text_topk_logit(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: top-k by cosine, then a logit threshold."""
    return _ranked(search.search_text(_t(spark, sf, "embeddings"), _vector(spark, sf, 0), K, "clip", 10.0, 100.0, None, "vec_id"))


@_query(f"SELECT vec_id, round(c, 6) AS score FROM ({_topk_sql('label = 1')}) WHERE c * 112.0 - 16.5 > -8.0")
def folder_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    held = _t(spark, sf, "embeddings").where(search.in_folder(1, "label"))
    return _ranked(search.search_text(held, _vector(spark, sf, 0), K, "siglip", -8.0, 112.0, -16.5, "vec_id"))


@_query(f"SELECT vec_id, round(c, 6) AS score FROM ({_topk_sql()}) WHERE c >= 0.2")
def item_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.search_item(_t(spark, sf, "embeddings"), _vector(spark, sf, 0), K, 0.2, "vec_id"))


LEGS_SQL = f"""legs AS (SELECT vec_id FROM ({_topk_sql()}) UNION SELECT vec_id FROM ({_topk_sql(vec=1)})),
  scored AS (SELECT vec_id, {_cos_sql("embedding", "(SELECT embedding FROM embeddings WHERE vec_id = 0)")} AS text_score, {_cos_sql("embedding", "(SELECT embedding FROM embeddings WHERE vec_id = 1)")} AS item_score FROM embeddings JOIN legs USING (vec_id))"""


@_query(f"WITH {LEGS_SQL} SELECT vec_id, round((text_score + item_score) / 2, 6) AS score FROM scored WHERE (text_score + item_score) / 2 >= 0.1 ORDER BY (text_score + item_score) / 2 DESC, vec_id LIMIT {K}")
def combined_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.search_combined(_t(spark, sf, "embeddings"), *_vectors(spark, sf, 0, 1), K, 0.1, "vec_id"))


@_query(f"WITH {LEGS_SQL} SELECT vec_id, round(text_score, 6) AS text_score, round(item_score, 6) AS item_score FROM scored")
def leg_union(spark: SparkSession, sf: str) -> DataFrame:
    both = search.legs(_t(spark, sf, "embeddings"), *_vectors(spark, sf, 0, 1), K, "vec_id")
    return both.select("vec_id", F.round("text_score", 6).alias("text_score"), F.round("item_score", 6).alias("item_score"))


@_query(f"SELECT vec_id, round(c, 6) AS score, round(c * 112.0 - 16.5, 6) AS logit, round(1 / (1 + exp(-(c * 112.0 - 16.5))), 6) AS sigmoid, c * 112.0 - 16.5 > -8.0 AS passes FROM ({_topk_sql()})")
def score_trace_siglip(spark: SparkSession, sf: str) -> DataFrame:
    found = search.top_k(_t(spark, sf, "embeddings"), _vector(spark, sf, 0), K, "vec_id")
    trace = search.score_trace(found, "siglip", -8.0, 112.0, -16.5)
    return trace.select("vec_id", *[F.round(c, 6).alias(c) for c in ("score", "logit", "sigmoid")], "passes")


@_query(f"WITH t AS ({_topk_sql()}) SELECT vec_id, round(c, 6) AS score, printf('%.4f', c) AS shown, c >= 0.2 AS passes FROM t WHERE c >= 0.2 OR NOT EXISTS (SELECT 1 FROM t WHERE c >= 0.2)")
def trace_item(spark: SparkSession, sf: str) -> DataFrame:
    """An item search's scores: the rows that pass."""
    found = search.item_trace(search.top_k(_t(spark, sf, "embeddings"), _vector(spark, sf, 0), K, "vec_id"), 0.2)
    return found.select("vec_id", F.round("score", 6).alias("score"), search.shown(F.col("score")).alias("shown"), "passes")


@_query(f"WITH {LEGS_SQL}, t AS (SELECT *, (text_score + item_score) / 2 AS c FROM scored) SELECT vec_id, round(c, 6) AS score, round(text_score, 6) AS text_score, round(item_score, 6) AS item_score, c >= 0.9 AS passes FROM t WHERE c >= 0.9 OR NOT EXISTS (SELECT 1 FROM t WHERE c >= 0.9)")
def trace_combined(spark: SparkSession, sf: str) -> DataFrame:
    """A combined search's scores: none passes, so all are given."""
    found = search.combined_trace(search.legs(_t(spark, sf, "embeddings"), *_vectors(spark, sf, 0, 1), K, "vec_id"), 0.9)
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in ("score", "text_score", "item_score")], "passes")


def _on_disk() -> Column:
    """Paths of which those with an even vec_id are on disk, wherever there is one."""
    return F.when(F.col("vec_id") % 2 == 0, F.lit("/")).otherwise(F.concat(F.lit("/no/such/folder/"), F.col("vec_id").cast("string")))


@_query(f"SELECT vec_id, round(c, 6) AS score FROM ({_topk_sql()}) WHERE c >= 0.1 AND vec_id % 2 = 0")
def search_existing(spark: SparkSession, sf: str) -> DataFrame:
    """Existence is looked up for the candidates alone, after the top-k."""
    found = search.search_item(_t(spark, sf, "embeddings"), _vector(spark, sf, 0), K, 0.1, "vec_id").withColumn("path", _on_disk())
    return _ranked(search.existing(found.select("vec_id", "score", "path")))


@_query(f"SELECT vec_id, round({DOT_SQL.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 9) AS dot FROM embeddings")
def dot_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), search.literal(_vector(spark, sf, 0))), 9).alias("dot"))


@_query(f"SELECT vec_id, round(embedding[1]::DOUBLE / greatest(sqrt({DOT_SQL.format(a='embedding', b='embedding')}), 1e-12), 6) AS first_component, len(embedding) AS width FROM embeddings")
def l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    unit = vectors.normalise(F.col("embedding"))
    return _t(spark, sf, "embeddings").select("vec_id", F.round(F.element_at(unit, 1), 6).alias("first_component"), F.size("embedding").cast("long").alias("width"))


# duplicates


def _distinct_sql(where: str = "TRUE") -> str:
    return f"(SELECT min(vec_id) AS vec_id, embedding FROM embeddings WHERE {where} GROUP BY embedding)"


def _pairs_sql(threshold: float, where: str = "TRUE") -> str:
    return f"""SELECT a.vec_id AS l, b.vec_id AS r, {DOT_SQL.format(a="a.embedding", b="b.embedding")} AS sim
      FROM {_distinct_sql(where)} a JOIN {_distinct_sql(where)} b ON a.vec_id < b.vec_id WHERE {DOT_SQL.format(a="a.embedding", b="b.embedding")} >= {threshold}"""


def _found_pairs(df: DataFrame, threshold: float) -> DataFrame:
    return duplicates.pairs(duplicates.representatives(df, "vec_id", "embedding"), threshold, "vec_id", "embedding")


@_query(f"SELECT l, r, round(sim, 6) AS sim FROM ({_pairs_sql(PAIR_THRESHOLD)})")
def duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _found_pairs(_t(spark, sf, "embeddings"), PAIR_THRESHOLD).select("l", "r", F.round("sim", 6).alias("sim"))


@_query("SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS rep FROM embeddings")
def duplicate_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Membership of the classes that duplicate_pairs compares."""
    return duplicates.classes(_t(spark, sf, "embeddings"), "vec_id", "embedding")


@_query(f"SELECT l, r, round(sim, 6) AS sim FROM ({_pairs_sql(0.35, 'label IN (3, 4)')})")
def duplicates_in_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs inside two folders."""
    return _found_pairs(_t(spark, sf, "embeddings").where(F.col("label").isin(3, 4)), 0.35).select("l", "r", F.round("sim", 6).alias("sim"))


@_query(f"""WITH best AS (SELECT *, row_number() OVER (ORDER BY sim DESC, l, r) AS n FROM ({_pairs_sql(0.4)}) ORDER BY n LIMIT 9),
  flat AS (SELECT n, l, r, sim, 0 AS side, l AS item FROM best UNION ALL SELECT n, l, r, sim, 1 AS side, r AS item FROM best)
  SELECT item, side, round(sim, 6) AS sim FROM flat ORDER BY n, side LIMIT 9""")
def duplicates_gallery(spark: SparkSession, sf: str) -> DataFrame:
    """Best pairs as rows; nine rows split the fifth pair."""
    return duplicates.gallery(_found_pairs(_t(spark, sf, "embeddings"), 0.4), 9).select("item", "side", F.round("sim", 6).alias("sim"))


@_query(f"""WITH flat AS (SELECT l, r, sim, unnest([0, 1]) AS side, unnest([l, r]) AS item FROM ({_pairs_sql(0.4)}))
  SELECT item, side::INT AS side, round(sim, 6) AS sim FROM flat WHERE item % 2 = 0 ORDER BY flat.sim DESC, l, r, side LIMIT 9""")
def gallery_existing(spark: SparkSession, sf: str) -> DataFrame:
    """Items that are gone leave the gallery before it is cut."""

    def still(flat: DataFrame, item: str) -> DataFrame:
        found = flat.withColumn("vec_id", F.col(item)).withColumn("path", _on_disk())
        return search.existing(found).select(*flat.columns)

    return duplicates.gallery(_found_pairs(_t(spark, sf, "embeddings"), 0.4), 9, still).select("item", "side", F.round("sim", 6).alias("sim"))


@_query("SELECT sum(n * (n - 1) // 2)::BIGINT AS pairs, count(*) AS classes FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def exact_duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of equal texts, counted by class and never listed."""
    sizes = _t(spark, sf, "documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.count("*").alias("classes"))


# paths, ids and records


@_query("SELECT page_id, sha256(url) AS stable_id FROM pages")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", paths.stable_id(F.col("url")).alias("stable_id"))


_EXT_SQL = "lower(regexp_extract(string_split(path, '/')[-1], '^[.]*[^.].*[.]([^.]*)$', 1))"
_IMAGES = ", ".join(f"'{x}'" for x in MEDIA_EXTENSIONS[:6])
_VIDEOS = ", ".join(f"'{x}'" for x in MEDIA_EXTENSIONS[6:])


@_query(f"""SELECT doc_id, sha256(path) AS media_id, sha256('/corpus/' || source) AS folder_id, source || '/' || lang || '/' || string_split(path, '/')[-1] AS relative_path,
  CASE WHEN {_EXT_SQL} IN ({_VIDEOS}) THEN 'video' ELSE 'image' END AS media_type, size FROM ({FILES_SQL}) WHERE {_EXT_SQL} IN ({_IMAGES}, {_VIDEOS})""")
def media_records(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf).where(paths.is_media(F.col("path")))
    folder = F.concat(F.lit("/corpus/"), F.col("source"))
    return files.select(
        "doc_id", paths.stable_id(F.col("path")).alias("media_id"), paths.stable_id(folder).alias("folder_id"),
        paths.relative_caption(F.col("path"), folder).alias("relative_path"), paths.media_type(F.col("path")).alias("media_type"), "size",
    )


@_query(f"SELECT doc_id, path FROM ({FILES_SQL}) WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|gif|bmp|webp)$')")
def image_scan_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).where(paths.is_image_name(F.col("path"))).select("doc_id", "path")


@_query("SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^[a-z]+:/*', ''), '/+$', '') AS path FROM pages")
def canonical_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Urls as absolute paths, in normal form."""
    raw = F.concat(F.lit("/./x/../"), F.regexp_replace("url", "^[a-z]+:", ""))
    return _t(spark, sf, "pages").select("page_id", paths.canonical(raw).alias("path"))


FOLDERS_SQL = "folders AS (SELECT DISTINCT '/corpus/' || source AS folder FROM documents UNION SELECT DISTINCT '/corpus/' || source || '/' || lang FROM documents WHERE lang = 'de' UNION SELECT '/corpus')"


def _folders(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    top = docs.select(F.concat(F.lit("/corpus/"), F.col("source")).alias("folder"))
    below = docs.where("lang = 'de'").select(F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/de")).alias("folder"))
    return top.union(below).union(spark.createDataFrame([("/corpus",)], "folder string")).distinct()


@_query(f"WITH {FOLDERS_SQL}, files AS ({FILES_SQL}) SELECT doc_id, arg_max(folder, length(folder)) AS folder FROM files JOIN folders ON starts_with(path, folder || '/') GROUP BY doc_id")
def longest_prefix_owner(spark: SparkSession, sf: str) -> DataFrame:
    """The deepest of nested folders owns a file."""
    return catalog.owners(_files(spark, sf), _folders(spark, sf), "path", "folder").select("doc_id", "folder")


@_query(f"""WITH {FOLDERS_SQL}, files AS ({FILES_SQL}), owned AS (SELECT doc_id, path, arg_max(folder, length(folder)) AS folder FROM files JOIN folders ON starts_with(path, folder || '/') GROUP BY doc_id, path)
  SELECT doc_id, string_split(folder, '/')[-1] || substr(path, length(folder) + 1) AS caption FROM owned""")
def relative_captions(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.captions(_files(spark, sf), _folders(spark, sf)).select("doc_id", "caption")


@_query(f"SELECT doc_id, path FROM ({FILES_SQL}) WHERE starts_with(path, '/corpus/src1/')")
def folder_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    """Containment, part by part: src10 is not in src1."""
    return _files(spark, sf).where(paths.is_under(F.col("path"), F.lit("/corpus/src1"))).select("doc_id", "path")


@_query("SELECT page_id, lower(replace(url, '/', '\\')) AS path_key FROM pages")
def folded_path_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys where paths differ in case and slashes alone."""
    raw = F.replace(F.col("url"), F.lit("/en/"), F.lit("\\EN\\"))
    return _t(spark, sf, "pages").select("page_id", paths.key(raw, fold_case=True).alias("path_key"))


@_query(f"""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'document' ELSE path END AS path,
  CASE WHEN lang = 'fr' THEN 'document' WHEN lang = 'de' THEN CASE WHEN doc_id % 2 = 0 THEN 'kept caption' ELSE string_split(path, '/')[-1] END ELSE substr(path, length('/corpus/') + 1) END AS caption
  FROM ({FILES_SQL})""")
def result_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Path and caption of a result: from metadata with a folder, with a caption alone, with neither, and from the document."""
    files = _files(spark, sf)
    folder = F.when(F.col("lang") != "de", F.concat(F.lit("/corpus/"), F.col("source")))
    own = F.when(F.col("lang") != "fr", F.col("path")).otherwise(F.lit(""))
    caption = F.when((F.col("lang") == "de") & (F.col("doc_id") % 2 == 0), F.lit("kept caption"))
    with_metadata = files.select("doc_id", F.struct(own.alias("path"), folder.alias("folder_path"), caption.alias("relative_path")).alias("metadata"))
    path, shown = paths.path_and_caption("metadata", F.lit("document"))
    return with_metadata.select("doc_id", path.alias("path"), shown.alias("caption"))


@_query("SELECT page_id, line FROM (SELECT page_id, trim(unnest(string_split(url, chr(10)))) AS line FROM pages) WHERE line <> '' AND contains(line, '/')")
def parse_folder_list(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", F.explode(paths.listed_folders(F.col("url"))).alias("line"))


_NAMES = ["google/siglip2-so400m-patch16-512", "apple/DFN5B-CLIP-ViT-H-14-378", "openai/clip-vit-large-patch14", "hub/ViT-B.32", "x/clip-b", *THRESHOLDS]


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in dict.fromkeys(_NAMES)], "name string")


@_query(f"""SELECT name, CASE WHEN last LIKE '%siglip2%' THEN array_to_string(string_split(last, '-')[1:2], '-') WHEN last LIKE '%clip%' THEN CASE WHEN len(string_split(last, '-')) >= 3 THEN array_to_string(string_split(last, '-')[1:3], '-') ELSE last END
  ELSE replace(replace(last, '-', '_'), '.', '_') END AS short_name, CASE WHEN lower(name) LIKE '%siglip%' THEN 'siglip' ELSE 'clip' END AS kind
  FROM (SELECT name, lower(string_split(name, '/')[-1]) AS last FROM (VALUES {", ".join(f"('{n}')" for n in dict.fromkeys(_NAMES))}) v(name))""")
def model_identifier(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark).select("name", paths.short_model_name(F.col("name")).alias("short_name"), paths.model_kind(F.col("name")).alias("kind"))


# The published limits, written out a second time.
@_query("""SELECT name, kind, text::DOUBLE AS text, combined::DOUBLE AS combined, image::DOUBLE AS image FROM (VALUES
  ('google/siglip2-so400m-patch16-512', 'siglip', -8.0, 0.50, 0.85),
  ('apple/DFN5B-CLIP-ViT-H-14-378', 'clip', 3.5, 0.45, 0.70),
  ('google/siglip2-giant-opt-patch16-384', 'siglip', -8.0, 0.50, 0.85),
  ('facebook/metaclip-h14-fullcc2.5b', 'clip', 31.0, 0.45, 0.70),
  ('laion/CLIP-ViT-H-14-laion2B-s32B-b79K', 'clip', 24.0, 0.45, 0.70),
  ('openai/clip-vit-large-patch14', 'clip', 22.0, 0.45, 0.70),
  ('x/siglip-of-my-own', 'siglip', -8.0, 0.45, 0.70),
  ('x/clip-b', 'clip', 20.0, 0.45, 0.70)) v(name, kind, text, combined, image)""")
def threshold_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Limits by full model name, two fallbacks among them."""
    names = ["google/siglip2-so400m-patch16-512", "apple/DFN5B-CLIP-ViT-H-14-378", "google/siglip2-giant-opt-patch16-384", "facebook/metaclip-h14-fullcc2.5b", "laion/CLIP-ViT-H-14-laion2B-s32B-b79K", "openai/clip-vit-large-patch14", "x/siglip-of-my-own", "x/clip-b"]
    rows = [(n, t.kind, t.text, t.combined, t.image) for n in names for t in [thresholds(n)]]
    return spark.createDataFrame(rows, "name string, kind string, text double, combined double, image double")


@_query("SELECT name, short_name || '-' || substr(sha256(name), 1, 8) AS space FROM (VALUES ('google/siglip2-so400m-patch16-512', 'siglip2-so400m'), ('openai/clip-vit-large-patch14', 'clip-vit-large'), ('x/clip-b', 'clip-b'), ('hub/ViT-B.32', 'vit_b_32')) v(name, short_name)")
def model_spaces(spark: SparkSession, sf: str) -> DataFrame:
    names = ["google/siglip2-so400m-patch16-512", "openai/clip-vit-large-patch14", "x/clip-b", "hub/ViT-B.32"]
    return spark.createDataFrame([(n, model_space(n)) for n in names], "name string, space string")


@_query("SELECT conv_id, turn, 26 AS width, length(text) - length(replace(text, 'e', '')) > 0 AS has_e, sum_of > 0 AS has_letters FROM (SELECT *, length(regexp_replace(text, '[^a-z]', '', 'g')) AS sum_of FROM conversations)")
def encode_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as the engine encodes queries: vectors of one width, of length one where there is a letter."""
    made = encoders.encode_texts(_t(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", encoders.LetterEncoder())
    norm = F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding")))
    return made.select("conv_id", "turn", F.size("embedding").alias("width"), (F.element_at("embedding", 5) > 0).alias("has_e"), (F.abs(norm - 1) < 1e-5).alias("has_letters"))


@_query("SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS letter_e, round(sqrt(" + " + ".join(f"(length(text) - length(replace(text, '{chr(97 + i)}', ''))) ** 2" for i in range(26)) + "), 6) AS norm FROM documents")
def encode_text(spark: SparkSession, sf: str) -> DataFrame:
    counted = encoders.count_letters(_t(spark, sf, "documents").select("doc_id", "text"), "text")
    counts = F.col("counts")
    return counted.select("doc_id", F.element_at(counts, 5).alias("letter_e"), F.round(F.sqrt(vectors.dot(counts, counts)), 6).alias("norm"))


# catalog against scan

_STORED_SQL = "SELECT l.doc_id, d.n_chars + l.toxic AS size FROM labels l JOIN documents d USING (doc_id)"


@_query(f"SELECT d.doc_id, d.n_chars AS size FROM documents d LEFT JOIN ({_STORED_SQL}) s USING (doc_id) WHERE s.doc_id IS NULL OR s.size <> d.n_chars")
def records_needing_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.records_needing_embedding(_files(spark, sf), _stored(spark, sf), "doc_id").select("doc_id", "size")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_ids(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.stale(_files(spark, sf), _stored(spark, sf), "doc_id").select("doc_id")


@_query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def present_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.present(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.missing(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@_query(f"SELECT coalesce(d.doc_id, s.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'stale' WHEN s.size <> d.n_chars THEN 'changed' ELSE 'same' END AS status FROM (SELECT * FROM documents WHERE lang <> 'es') d FULL JOIN ({_STORED_SQL}) s USING (doc_id)")
def sync_classification(spark: SparkSession, sf: str) -> DataFrame:
    """A scan without one language's files against what is stored."""
    return catalog.classify(_stored(spark, sf), _files(spark, sf).where("lang <> 'es'"), "doc_id")


@_query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.latest_by(_t(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@_query("SELECT user_id, epoch(min(ts))::DOUBLE AS added_at, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def folder_upsert_keep_added(spark: SparkSession, sf: str) -> DataFrame:
    """A repeated registration keeps the first time and takes the last value."""
    events = _t(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = events.select("user_id", seconds.alias("added_at"), "value", "ts", "event_id")
    return catalog.registered(rows, "user_id", "added_at", [F.col("ts"), F.col("event_id")]).select("user_id", "added_at", "value")


def _store(spark: SparkSession, sf: str) -> Store:
    """A store of its own in the shared folder, with the vectors of the table; the label is the folder."""
    store = Store(spark, f"{shared_folder(spark)}/query-store-{uuid.uuid4().hex}", buckets=4)
    held = _t(spark, sf, "embeddings")
    folder = F.sha2(F.concat(F.lit("/f"), F.col("label")), 256)
    record = {"media_id": F.col("vec_id").cast("string"), "folder_id": folder, "mtime": F.lit(0.0), "size": F.col("label").cast("long")}
    fields = [record.get(f.name, F.lit("x")).cast(f.dataType).alias(f.name) for f in METADATA.fields]
    vectors = held.select(F.col("vec_id").cast("string").alias("id"), F.lit("x").alias("document"), "embedding", F.struct(*fields).alias("metadata"))
    media = vectors.select("metadata.*", F.lit(0.0).alias("updated_at")).select(*MEDIA.names)
    folders = held.select("label").distinct().select(folder.alias("folder_id"), F.concat(F.lit("/f"), F.col("label")).alias("path"), F.concat(F.lit("/f"), F.col("label")).alias("path_key"), F.lit(0.0).alias("added_at"))
    store.snapshot().commit(folders=folders, vectors=Change(vectors), media=Change(media))
    return store


_KEPT_SQL = "SELECT vec_id::VARCHAR AS id, label FROM embeddings WHERE label <> 3"


@_query(f"SELECT id, label::BIGINT AS size, 'media' AS side FROM ({_KEPT_SQL}) UNION ALL SELECT id, label::BIGINT, 'vectors' FROM ({_KEPT_SQL}) UNION ALL SELECT DISTINCT '/f' || label, 0::BIGINT, 'folders' FROM ({_KEPT_SQL})")
def delete_folder_effect(spark: SparkSession, sf: str) -> DataFrame:
    """A folder leaves the store with its records and vectors."""
    store = _store(spark, sf)
    store.snapshot().delete_folder(hashlib.sha256(b"/f3").hexdigest())
    at = store.snapshot()
    rows = at.read("media").select(F.col("media_id").alias("id"), "size", F.lit("media").alias("side"))
    rows = rows.union(at.read("vectors").select("id", "metadata.size", F.lit("vectors")))
    return rows.union(at.read("folders").select("path", F.lit(0).cast("long"), F.lit("folders")))


@_query("SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 7 = 0 THEN 100 ELSE label END::BIGINT AS size FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 7 = 0")
def store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """One commit that deletes every fifth vector and then puts every seventh, changed."""
    at = _store(spark, sf).snapshot()
    held = at.read("vectors")
    put = held.where("cast(id as long) % 7 = 0").withColumn("metadata", F.col("metadata").withField("size", F.lit(100).cast("long")))
    at.commit(vectors=Change(put, held.where("cast(id as long) % 5 = 0").select("id")))
    return at.store.snapshot().read("vectors").select("id", "metadata.size")


@_query("SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 7 = 0 THEN 100 ELSE label END::BIGINT AS size FROM embeddings")
def store_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table with rows replaced."""
    at = _store(spark, sf).snapshot()
    put = at.read("vectors").where("cast(id as long) % 7 = 0").withColumn("metadata", F.col("metadata").withField("size", F.lit(100).cast("long")))
    return at.upserted("vectors", put).select("id", "metadata.size")


@_query("""SELECT 'media' AS what, vec_id::VARCHAR AS key, label::VARCHAR AS value FROM embeddings WHERE label = 4
  UNION ALL SELECT 'media_by', vec_id::VARCHAR, label::VARCHAR FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'vectors', vec_id::VARCHAR, len(embedding)::VARCHAR FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT DISTINCT 'folders', '/f' || label, sha256('/f' || label) FROM embeddings
  UNION ALL SELECT 'folder_id', '/f2', sha256('/f2')
  UNION ALL SELECT 'count_media', '/f4', count(*)::VARCHAR FROM embeddings WHERE label = 4
  UNION ALL SELECT 'count_media', 'all', count(*)::VARCHAR FROM embeddings
  UNION ALL SELECT 'count_vectors', 'all', count(*)::VARCHAR FROM embeddings
  UNION ALL SELECT 'schema_version', 'now', '1'""")
def store_reads(spark: SparkSession, sf: str) -> DataFrame:
    """What a snapshot can be asked."""
    store = _store(spark, sf)
    store.snapshot().commit(meta=store.snapshot().marked_current())
    at = store.snapshot()
    fourth = hashlib.sha256(b"/f4").hexdigest()
    wanted = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("media_id"))
    rows = at.media(fourth).select(F.lit("media").alias("what"), F.col("media_id").alias("key"), F.col("size").cast("string").alias("value"))
    rows = rows.union(at.media_by("media_id", wanted).select(F.lit("media_by"), "media_id", F.col("size").cast("string")))
    rows = rows.union(at.vectors(wanted).select(F.lit("vectors"), "id", F.size("embedding").cast("string")))
    rows = rows.union(at.folders().select(F.lit("folders"), "path", "folder_id"))
    single = [("folder_id", "/f2", at.folder_id("/f2")), ("count_media", "/f4", str(at.count_media(fourth))), ("count_media", "all", str(at.count_media())), ("count_vectors", "all", str(at.count_vectors())), ("schema_version", "now", at.schema_version())]
    return rows.union(spark.createDataFrame(single, "what string, key string, value string"))


@_query("""SELECT '/f' || label AS path, min(CASE WHEN label % 2 = 0 THEN 0.0 ELSE 9.0 END)::DOUBLE AS added_at FROM embeddings GROUP BY label
  UNION ALL SELECT '/new', 9.0""")
def folders_registered(spark: SparkSession, sf: str) -> DataFrame:
    """A folder that is registered again keeps its time; one that was deleted before is new."""
    store = _store(spark, sf)
    at = store.snapshot()
    odd = at.read("folders").where("cast(substr(path, 3) as int) % 2 = 1")
    at.commit(folders=at.read("folders").join(odd.select("path"), "path", "left_anti").select(*at.read("folders").columns))
    again = at.read("folders").select("folder_id", "path", "path_key").union(spark.createDataFrame([("n", "/new", "/new")], "folder_id string, path string, path_key string"))
    return store.snapshot().folders_with(again, 9.0).select("path", "added_at")


@_query("SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id % 5 <> 0")
def store_without(spark: SparkSession, sf: str) -> DataFrame:
    at = _store(spark, sf).snapshot()
    return at.without("vectors", at.read("vectors").where("cast(id as long) % 5 = 0").select("id")).select("id")


@_query(f"WITH {FOLDERS_SQL}, files AS ({FILES_SQL}), old AS (SELECT doc_id, path, CASE WHEN lang = 'en' THEN sha256(path) ELSE doc_id::VARCHAR END AS id FROM files) SELECT doc_id, sha256(path) AS new_id FROM old WHERE id <> sha256(path) AND EXISTS (SELECT 1 FROM folders WHERE starts_with(path, folder || '/'))")
def legacy_rekey(spark: SparkSession, sf: str) -> DataFrame:
    """Old rows, some keyed right already: those that get a new id."""
    right = paths.stable_id(F.col("path"))
    old = _files(spark, sf).withColumn("id", F.when(F.col("lang") == "en", right).otherwise(F.col("doc_id").cast("string")))
    owned = catalog.owners(old, _folders(spark, sf), "path", "folder").where("folder is not null")
    return ingest.misnamed(owned).select("doc_id", right.alias("new_id"))


@_query("SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS n_en FROM documents GROUP BY source")
def folder_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.counts_by(_t(spark, sf, "documents"), "source", n_en=F.col("lang") == "en")


@_query(f"SELECT path FROM ({FILES_SQL}) ORDER BY path LIMIT 10 OFFSET 100")
def ordered_offset(spark: SparkSession, sf: str) -> DataFrame:
    """A page of an ordered listing."""
    return catalog.page(_files(spark, sf).select("path"), ["path"], 10, 100)


BATCH_SQL = f"SELECT doc_id, ((row_number() OVER (ORDER BY path) - 1) // 64)::BIGINT AS batch, size FROM ({FILES_SQL})"


@_query(f"SELECT doc_id, batch FROM ({BATCH_SQL})")
def batch_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.batches(_files(spark, sf).select("doc_id", "path"), [F.col("path")], 64).select("doc_id", "batch")


@_query(f"SELECT batch, count(*) AS n, sum(size)::BIGINT AS size, (sum(count(*)) OVER (ORDER BY batch))::BIGINT AS done FROM ({BATCH_SQL}) GROUP BY batch")
def progress_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Batches are full but the last, so what is done after each follows from its number."""
    files = _files(spark, sf).select("doc_id", "path", "size")
    sums = catalog.batches(files, [F.col("path")], 64).groupBy("batch").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return sums.select("batch", "n", "size", (F.col("batch") * 64 + F.col("n")).alias("done"))


@_query("SELECT DISTINCT source, lang FROM documents WHERE (source, lang) NOT IN (SELECT (source, lang) FROM documents JOIN labels USING (doc_id))")
def folder_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Folders after less folders before."""
    docs = _t(spark, sf, "documents")
    return catalog.added(docs.select("source", "lang"), catalog.present(docs, _t(spark, sf, "labels"), "doc_id").select("source", "lang"))


@_query(f"SELECT doc_id, path FROM ({FILES_SQL}) WHERE source IN ('src1', 'src2') OR lang = 'fr'")
def scan_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping scans put together, each file once."""
    files = _files(spark, sf).select("doc_id", "path", "source", "lang")
    every = files.where("source in ('src1', 'src2')").unionByName(files.where("lang = 'fr'"))
    return catalog.first_by(every, ["path"], [F.col("doc_id")]).select("doc_id", "path")


@_query(f"SELECT doc_id, sha256(path) AS media_id, '{SCHEMA_VERSION}' AS schema_version FROM ({FILES_SQL})")
def metadata_structs(spark: SparkSession, sf: str) -> DataFrame:
    owned = _files(spark, sf)
    records = catalog.metadata(catalog.records(owned.select("path", "mtime", "size", "doc_id"), "/corpus").join(owned.select("doc_id", "path"), "path"))
    return records.select("doc_id", "metadata.media_id", "metadata.schema_version")


@_query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS began, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's windowed totals, over the table as one batch."""
    out = changes.progress(_t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.unix_seconds("span.start").alias("began"), "event_type", "n", F.round("total", 4).alias("total"))


@_query(f"SELECT doc_id, path FROM ({FILES_SQL}) ORDER BY sha256('7:' || doc_id), doc_id LIMIT {K}")
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    """An even draw without replacement."""
    return catalog.sample(_files(spark, sf), K, seed=7, id_="doc_id").select("doc_id", "path")

