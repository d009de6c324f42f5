"""Model registry: saved versions, the pointers to the latest and best, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.plans.small import broadcast_if_small
from netweave.schemas import REGISTRY


def next_version(registry: DataFrame) -> DataFrame:
    """Number and name of the version after the newest one."""
    number = F.coalesce(F.max("seq"), F.lit(0)) + 1
    return registry.agg(number.alias("seq")).select(
        "seq", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("version")
    )


def append_version(
    registry: DataFrame, checkpoint_path: str, validation_loss: float, created_at: str, is_best: bool = True
) -> DataFrame:
    """The registry plus one row for a model just saved."""
    saved = next_version(registry).select(
        "version",
        F.col("seq").cast("long").alias("seq"),
        F.lit(checkpoint_path).alias("checkpoint_path"),
        F.lit(float(validation_loss)).alias("validation_loss"),
        F.lit(created_at).cast("timestamp").alias("creation_date"),
        F.lit(is_best).alias("is_best"),
    )
    return registry.unionByName(saved, allowMissingColumns=True)


def pointers(registry: DataFrame) -> DataFrame:
    """One row: the newest version and the newest one saved as best (null if none)."""
    return registry.agg(
        F.max_by("version", "seq").alias("latest"),
        F.max_by("version", F.when(F.col("is_best"), F.col("seq"))).alias("best"),
    )


def resolve(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Checkpoint of each requested version.

    ``latest`` and ``best`` follow the pointers, ``best`` falls back to the latest;
    an unknown version gives no checkpoint, which means an untrained model.
    """
    entry = F.struct("version", "checkpoint_path", "validation_loss")
    latest, best = F.max_by(entry, "seq"), F.max_by(entry, F.when(F.col("is_best"), F.col("seq")))
    marks = registry.agg(latest.alias("latest"), F.coalesce(best, latest).alias("best"))
    # the pointers, which most requests use, are two values; only named versions are a join key
    asked = requests.withColumn(
        "_entry", F.when(F.col("requested") == "latest", marks.select("latest").scalar()).when(F.col("requested") == "best", marks.select("best").scalar())
    )
    pointed = F.coalesce(F.col("requested").isin("latest", "best"), F.lit(False))
    followed = asked.filter(pointed).select(*requests.columns, "_entry.*")
    known = broadcast_if_small(registry.select("version", "checkpoint_path", "validation_loss"))
    named = requests.filter(~pointed).withColumn("version", F.col("requested")).join(known, "version", "left")
    return followed.unionByName(named).withColumn("untrained", F.col("checkpoint_path").isNull())


def list_checkpoints(spark: SparkSession, folder: str, suffix: str = ".pth") -> DataFrame:
    """Path and modification time of the saved files; their content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .load(folder)
        .select("path", "modificationTime")
    )


def newest_checkpoint(files: DataFrame) -> DataFrame:
    """One row with the newest path, null when there is none."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)
