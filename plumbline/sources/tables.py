"""Where tables come from and go to."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException as SparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import prepare
from plumbline.sources.arrays import records

#: Every field of a raw record is read as text; nested values keep their JSON.
RAW = "parent_asin string, asin string, title string, features string, description string, price string, categories string, details string, average_rating string, rating_number string, store string"
SAMPLES = "sample_id string, scenario_type string, user_profile string, ground_truth struct<parent_asin:string>, intent_card struct<target_category:string,hard_constraints:array<string>,soft_preferences:array<string>>, behavior struct<scenario_type:string,`override`:struct<turn:int,old_value:string,new_value:string,message:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df's rows over all tasks of a shuffle, by keys: a file of few bytes may hold very many rows, and is read by one task, which
    would do all that is made from them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, and applications after this one too; a temporary one in local mode alone, where none
    may be configured (tests)."""
    sc, at = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not at:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(at)
    return at or sc.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Likewise, for wide rows that are much alike: Parquet holds them in a small part of a checkpoint's bytes."""
    at = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def strict_catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; a bad line fails the query."""
    return spark.read.schema(RAW).option("mode", "FAILFAST").json(path)


def lenient_catalog(spark: SparkSession, path: str, array: bool | None = None) -> DataFrame:
    """JSON lines or one JSON array (told by the first character that is no space, unless `array` says), plain or gzip; bad
    records are left out."""
    if array is None:
        first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
        array = first is not None and first["c"] == "["
    schema = f"{RAW}, _corrupt_record string"
    if array:
        rows = records(spark, path).select(F.from_json("record", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    else:
        rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sessions."""
    return spark.read.schema(SAMPLES).json(path)


def from_records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records in memory, for tests and small inputs."""
    names = [f.split()[0] for f in RAW.split(", ")]
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], RAW)


def write_results(df: DataFrame, path: str, run_id: str) -> None:
    """JSON results, one folder for each run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def index_path(root: str, version: str, content: DataFrame) -> str:
    """A folder named by what an index is made from: the version and an order-free digest of the records, in which each
    record counts as often as it occurs."""
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), *content.columns).cast("decimal(38,0)"))
    digest = content.agg(wide(1).alias("a"), wide(2).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return f"{root}/{version}-{digest['n']}-{int(digest['a'] or 0) % (1 << 64):016x}{int(digest['b'] or 0) % (1 << 64):016x}"


def file_path(root: str, version: str, content: DataFrame) -> str:
    """Likewise by the files that the records are read from: their names, sizes and times of change. No record is read."""
    files = content.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return index_path(root, version, files)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at `path`, made once; the commit marker of Spark's writer tells whether it is whole, and what can't be read
    is made anew."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        try:
            return spark.read.parquet(path)  # reads the footers
        except (AnalysisException, Py4JJavaError, SparkException):
            pass
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def catalog_views(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an evaluation needs of the catalog: the ids, and each id's categories."""
    return products.select("parent_asin").distinct(), products.select("parent_asin", "category_path", "leaf_category")


def write_vectors(vectors: DataFrame, root: str, version: str, content: DataFrame) -> str:
    """(id, vector) under a folder named by the records and the encoder's version."""
    path = index_path(root, version, content)
    vectors.select("id", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)
    return path


def write_summary(df: DataFrame, path: str) -> None:
    """One JSON file of a table that is a summary (a row for each variant or scenario)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def product_cards(products: DataFrame) -> DataFrame:
    """What a user interface shows of a product."""
    return products.select("parent_asin", "title", F.round("price", 2).alias("price"), F.round("avg_rating", 1).alias("rating"), F.col("rating_count").try_cast("bigint").alias("rating_count"), "store", "leaf_category")
