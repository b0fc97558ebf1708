"""Stage tables of a run: written once, read back, resumed by what is missing."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "ts timestamp, stage string, provider string, input_tokens bigint, output_tokens bigint, cost double, cached boolean, error string"


class RunStore:
    """A folder of parquet tables, one a stage; a stage without its success mark counts as absent."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, stage: str) -> bool:
        p, fs = self._fs(stage, "_SUCCESS")
        return fs.exists(p)

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{stage}")

    def write(self, stage: str, df: DataFrame, *partition_by: str) -> DataFrame:
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.path}/{stage}")
        return self.read(stage)

    def stage(self, name: str, make, resume: bool = True) -> DataFrame:
        """The stage's table: as written before if resuming, else made and written now."""
        return self.read(name) if resume and self.has(name) else self.write(name, make())

    def missing(self, stage: str, wanted: DataFrame, key: str) -> DataFrame:
        """Keys of ``wanted`` that the stage does not hold yet."""
        return wanted.join(self.read(stage).select(key).distinct(), key, "left_anti") if self.has(stage) else wanted

    def spec(self, doc: DataFrame, draft: bool) -> str:
        """Writes the specification as JSON; a final one takes its draft's place."""
        name = "spec.draft" if draft else "spec"
        doc.write.mode("overwrite").json(f"{self.path}/{name}")
        if not draft:
            p, fs = self._fs("spec.draft")
            fs.delete(p, True)
        return name

    def manifest(self, **facts) -> None:
        self.spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")

    def facts(self) -> dict:
        """What the manifest says; nothing where there is none."""
        p, fs = self._fs("manifest", "_SUCCESS")
        return json.loads(self.spark.read.text(f"{self.path}/manifest").first()[0]) if fs.exists(p) else {}

    def log(self, calls: DataFrame) -> None:
        """Further calls, appended to the run's ledger as JSON lines."""
        calls.write.mode("append").json(f"{self.path}/ledger")

    def ledger(self) -> DataFrame:
        """The run's ledger; lines that cannot be read are left out, a run without one has no calls."""
        p, fs = self._fs("ledger")
        if not fs.exists(p):
            return self.spark.createDataFrame([], LEDGER)
        lines = self.spark.read.text(f"{self.path}/ledger").where(F.try_parse_json("value").isNotNull())
        return lines.select(F.from_json("value", LEDGER).alias("r")).where("r is not null").select("r.*")


def fingerprint(settings: dict, papers: DataFrame | None = None) -> str:
    """A hash of all that can change a run's results: settings, whatever their order, and the papers' own
    hashes, added up on the executors whatever their order."""
    said = json.dumps(settings, sort_keys=True, default=str)
    if papers is not None:
        own = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "paper_id", F.coalesce("sha256", F.lit(""))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        said += str(tuple(papers.select("paper_id", "sha256").distinct().agg(F.count(F.lit(1)), F.sum(own)).first()))
    return hashlib.sha256(said.encode()).hexdigest()[:16]
