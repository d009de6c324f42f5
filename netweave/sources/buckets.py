"""Tables in buckets of a key, of which a commit replaces only those it touches.

``data/commit=N/bucket_of_table=K`` holds bucket K as commit N left it, and ``commits/N.json`` names, for each bucket,
the commit whose folder is the current one. A commit exists once its file does, so readers never see half of one and a
repeated commit replaces itself. Folders that neither the last commit nor the one before refers to are removed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave.sources import files

BUCKETS = 256
BUCKET = "bucket_of_table"


@dataclass(frozen=True)
class BucketedTable:
    """A null key has its bucket like any other. ``buckets`` must stay the same for a folder.

    A bucket is what a commit rewrites, and it is dealt over ``spread`` tasks: take so many buckets that one is about a
    gigabyte, and a spread where they grow beyond that.
    """

    path: str
    key: str
    schema: T.StructType
    buckets: int = BUCKETS
    spread: int = 1

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def share(self) -> Column:
        """Which of the bucket's tasks a key goes to."""
        return F.pmod(F.xxhash64(F.lit(1), F.col(self.key)), F.lit(self.spread)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows belong to, at most ``buckets`` numbers."""
        return sorted(r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def _commits(self, spark: SparkSession) -> list[int]:
        found = files.names(spark, f"{self.path}/commits")
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and not n.startswith("."))

    def _versions(self, spark: SparkSession, commit: int) -> dict[int, int]:
        text = files.read_text(spark, f"{self.path}/commits/{commit}.json")
        return {int(bucket): version for bucket, version in json.loads(text).items()}

    def versions(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """For each bucket that has rows the commit that wrote it, as of the last commit (below ``before``)."""
        commits = [c for c in self._commits(spark) if before is None or c < before]
        return self._versions(spark, commits[-1]) if commits else {}

    def read(self, spark: SparkSession, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """All rows, or those of some buckets; files of other buckets are not opened."""
        current = self.versions(spark, before)
        wanted = current if buckets is None else {b: current[b] for b in buckets if b in current}
        paths = [f"{self.path}/data/commit={version}/{BUCKET}={bucket}" for bucket, version in sorted(wanted.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def expect(self, spark: SparkSession, commit: int) -> list[int]:
        """The commits that are there; an error if the table is ahead of ``commit``, as with a fresh checkpoint on an old folder."""
        commits = self._commits(spark)
        if commits and commits[-1] > commit:
            raise RuntimeError(f"{self.path} has commit {commits[-1]} already: commit {commit} needs a new folder")
        return commits

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with their bucket, each bucket in one task; rows that have it are taken as dealt."""
        if BUCKET in rows.columns:
            return rows
        return rows.select(*self.schema.fieldNames(), self.bucket().alias(BUCKET)).repartition(BUCKET, self.share())

    def replace(self, rows: DataFrame, commit: int, buckets: list[int]) -> None:
        """Commit ``rows`` as the whole content of ``buckets``; the other buckets stay as they are."""
        spark = rows.sparkSession
        commits = self.expect(spark, commit)
        earlier = [self._versions(spark, c) for c in commits if c < commit][-2:]
        before = earlier[-1] if earlier else {}
        target = f"{self.path}/data/commit={commit}"
        self.dealt(rows).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        written = {int(n.removeprefix(f"{BUCKET}=")) for n in files.names(spark, target) if n.startswith(f"{BUCKET}=")}
        after = {b: v for b, v in before.items() if b not in buckets} | {b: commit for b in written}
        files.write_text(spark, f"{self.path}/commits/{commit}.json", json.dumps(after))
        self._remove_unused(spark, [c for c in commits if c < commit], earlier)

    def _remove_unused(self, spark: SparkSession, commits: list[int], earlier: list[dict[int, int]]) -> None:
        """What only the commit before the previous one referred to; the previous one stays for a repeat."""
        if len(earlier) == 2:
            for bucket, version in earlier[0].items():
                if earlier[1].get(bucket) != version:
                    files.delete(spark, f"{self.path}/data/commit={version}/{BUCKET}={bucket}")
            for commit in commits[:-1]:
                files.delete(spark, f"{self.path}/commits/{commit}.json")
