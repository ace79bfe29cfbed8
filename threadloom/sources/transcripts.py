"""Reading transcripts, manifests, caches and checkpoints; writing what is rendered.

All paths go through Spark's readers and writers, so they may lie in any store
that Spark reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import incremental


def stem(path: Column) -> Column:
    """The file name without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def json_text(value: Column) -> Column:
    """The first non-empty of conversation, body and full_text of a JSON object; other JSON as it stands."""
    picked = [F.nullif(F.get_json_object(value, f"$.{k}"), F.lit("")) for k in ("conversation", "body", "full_text")]
    is_object = T.lstrip(value).startswith("{")
    return F.when(is_object, F.coalesce(*picked, F.lit(""))).otherwise(value)


def read_transcripts(spark: SparkSession, path: str, glob: str = "*.{txt,json}", limit: int = 0) -> DataFrame:
    """(path, label, suffix, text, sha256, char_count) of every transcript file below ``path``.

    Text files before JSON files, each by name, which is the order that ``limit``
    cuts in (0: all). Empty transcripts are left out.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return _read(files.withColumn("path", F.input_file_name()), limit)


def _read(files: DataFrame, limit: int) -> DataFrame:
    """``read_transcripts`` of rows (path, value)."""
    named = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    text = F.when(F.col("suffix") == "json", json_text(F.col("value"))).otherwise(F.col("value"))
    rows = named.select("path", stem(F.col("path")).alias("label"), "suffix", T.strip(text).alias("text")).where("text <> ''")
    rows = rows.withColumn("sha256", F.sha2("text", 256)).withColumn("char_count", F.length("text"))
    return rows.orderBy(F.col("suffix") != "txt", "path").limit(limit) if limit else rows


#: How many files hold what is packed, however many members that are.
BUCKETS = 64


def write_packed(members: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Files as members (path, value) of at most ``buckets`` Parquet files, dealt by a hash of their paths: a store of
    objects takes and lists some files quickly, a file for each of a million conversations takes it hours."""
    members.where("path IS NOT NULL").select("path", "value").repartition(buckets, "path").write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The members (path, value) below a path."""
    return spark.read.schema("path string, value string").parquet(path)


def read_packed_transcripts(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """``read_transcripts`` of packed files, told apart by the suffixes of the members' paths."""
    return _read(read_packed(spark, path).where(F.lower("path").rlike(r"\.(txt|json)$")), limit)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(session, path, category, priority, cache_id) of a JSON manifest; an entry may be a bare path."""
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.sessions"), "map<string,string>")).alias("session", "entry"))
    field = lambda n: F.get_json_object("entry", f"$.{n}")
    is_object = F.col("entry").startswith("{")
    return entries.select(
        "session", F.when(is_object, field("path")).otherwise(F.col("entry")).alias("path"), F.when(is_object, field("category")).alias("category"),
        F.when(is_object, field("priority").cast("int")).alias("priority"), F.when(is_object, field("cache_id")).alias("cache_id"),
    )


CACHE = "id string, transcript string, full_text string, conversation string, text string, chunk_count int, rows array<struct<chunk_index:int,output:string>>"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of cached sessions, with the first non-empty of their text fields as ``transcript``."""
    rows = spark.read.schema(CACHE).json(path)
    return rows.withColumn("transcript", F.coalesce(*[F.nullif(c, F.lit("")) for c in ("transcript", "full_text", "conversation", "text")])).drop("full_text", "conversation", "text")


def wanted_sessions(cache: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached sessions whose id (any case) is wanted, and the wanted ids that are missing."""
    key = F.lower("id")
    ids = wanted.select(F.lower("id").alias("_k")).distinct()
    found = cache.withColumn("_k", key).join(ids, "_k", "left_semi").drop("_k")
    missing = ids.join(cache.select(key.alias("_k")), "_k", "left_anti").select(F.col("_k").alias("id"))
    return found, missing


def jobs(*lists: DataFrame) -> DataFrame:
    """The union of job lists; an earlier list wins a path."""
    return incremental.first_per_path(list(lists))


def write_exports(df: DataFrame, path: str) -> None:
    """Rendered texts (label, target, text) as JSON by target; Spark's commit protocol makes each write whole or absent."""
    df.select("label", "target", F.concat("label", F.lit("_"), "target", F.lit(".md")).alias("file"), "text").write.mode("overwrite").partitionBy("target").json(path)


def write_checkpoints(df: DataFrame, path: str) -> None:
    """Records by project, each partition replaced as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def copy_blocks(rows: DataFrame, key: str = "conv") -> DataFrame:
    """(key, text): the non-empty texts of (key, chunk_index, text, input_chars) as numbered blocks."""
    item = F.struct("chunk_index", "input_chars", "text")
    grouped = rows.where(~T.blank(F.col("text"))).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("b"), F.count("*").alias("n"))
    block = lambda b: F.concat(F.lit("=== CHUNK "), b["chunk_index"] + 1, F.lit("/"), F.col("n"), F.lit(" ("), b["input_chars"], F.lit(" chars) ===\n"), T.strip(b["text"]))
    return grouped.select(key, F.array_join(F.transform("b", block), "\n\n").alias("text"))
