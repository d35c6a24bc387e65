"""Published snapshots: Parquet tables under one folder for each build, with a manifest; gated, then made current.

Paths are Hadoop paths, so any store that Spark writes to will do. A build becomes visible by one small file that names it."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.functions import keys
from jobquarry.operators import aggregates, changes
from jobquarry.schemas import SCHEMA_VERSION

#: Deltas that a manifest keeps.
DELTA_WINDOW = 10


class GateFailed(RuntimeError):
    """A build did not pass its gates; the current one stays."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read_text(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect())

    def write_text(self, name: str, body: str) -> None:
        """Written beside and put in place by an overwriting rename, so a reader sees the old text or the new one, also after
        a crash in between."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        name_ = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        beside = jvm.org.apache.hadoop.fs.Path(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        fs, _ = self._fs(self.root)
        out = fs.create(beside, True)
        out.write(bytearray(body.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(name_.toUri(), conf).rename(beside, name_, options)

    def manifest(self) -> dict:
        return json.loads(self.read_text("manifest.json") or "{}")

    def table(self, name: str, build: str | None = None) -> DataFrame:
        """A table of a build (the current one): jobs, companies, slim, sectors, details, vectors. A build of a newer
        schema than this code's is refused."""
        manifest = self.manifest()
        build = build or manifest["build_id"]
        if manifest.get("schema_version", SCHEMA_VERSION) > SCHEMA_VERSION:
            raise ValueError(f"build {build} has schema {manifest['schema_version']}, this reads up to {SCHEMA_VERSION}")
        return self.spark.read.parquet(f"{self.root}/{manifest.get('folders', {}).get(build, build)}/{name}")

    def sector(self, slug: str) -> DataFrame:
        """The rows of one sector; the others' files are not read."""
        return self.table("sectors").where(F.col("sector_slug") == slug)

    def verify(self) -> bool:
        """Whether the current build's rows are those that were published."""
        return fingerprint(self.table("jobs")) == self.manifest()["fingerprint"]

    def publish(self, rows: DataFrame, build: str, order: str = "id", more: dict[str, DataFrame] | None = None) -> dict:
        """Write a build (jobs, companies, slim jobs, jobs by sector, and the tables ``more``), check its gates and make it
        current. It is written to a folder of this attempt's own, so neither a failed attempt nor a second build of one name
        touches what readers see. A delta from the previous build is kept for the last ``DELTA_WINDOW`` builds."""
        before = self.manifest()
        folder = f"{build}-{uuid.uuid4().hex[:8]}"
        base = f"{self.root}/{folder}"
        rows.write.mode("overwrite").parquet(f"{base}/jobs")
        jobs = self.spark.read.parquet(f"{base}/jobs")
        aggregates.company_rollup(jobs, order).write.mode("overwrite").parquet(f"{base}/companies")
        gates = aggregates.evaluate_gates(jobs, self.spark.read.parquet(f"{base}/companies"), SCHEMA_VERSION, previous=before.get("rows"))
        if failed := [g for g in gates if not g.passed]:
            raise GateFailed("; ".join(f"{g.name}: {g.detail}" for g in failed))
        changes.slim(jobs).write.mode("overwrite").parquet(f"{base}/slim")
        # Rows are spread by sector before the write, so a sector is a few files and not one for each task.
        by_sector = jobs.withColumn("sector_slug", keys.sector_slug(F.col("sector")))
        by_sector.hint("rebalance", "sector_slug").write.mode("overwrite").partitionBy("sector_slug").parquet(f"{base}/sectors")
        for name, table in (more or {}).items():
            table.write.mode("overwrite").parquet(f"{base}/{name}")
        deltas = before.get("deltas", [])
        if before.get("build_id"):
            upserts, deletes = changes.delta(self.table("jobs", before["build_id"]), jobs)
            upserts.write.mode("overwrite").parquet(f"{base}/delta_upserts")
            deletes.write.mode("overwrite").parquet(f"{base}/delta_deletes")
            deltas = [*deltas, [before["build_id"], build]][-DELTA_WINDOW:]
        shards = {r["sector_slug"]: r["n"] for r in by_sector.groupBy("sector_slug").agg(F.count(F.lit(1)).alias("n")).collect()}
        folders = {k: v for k, v in before.get("folders", {}).items() if k in {x for d in deltas for x in d}} | {build: folder}
        manifest = {"build_id": build, "schema_version": SCHEMA_VERSION, "rows": jobs.count(), "deltas": deltas, "shards": shards, "folders": folders, "fingerprint": fingerprint(jobs)}
        self.write_text("manifest.json", json.dumps(manifest, sort_keys=True))
        return manifest


def fingerprint(rows: DataFrame) -> str:
    """A digest of a table's rows, whatever their order and files: the SHA-256 sums of rows, added up in four parts."""
    digest = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[part(k).alias(f"s{k}") for k in range(4)]).first()
    return hashlib.sha256(":".join(str(x) for x in found).encode()).hexdigest()


def wire(rows: DataFrame) -> DataFrame:
    """Rows as JSON text for callers; scores rounded to four digits, nulls left out."""
    cols = [F.round(c, 4).alias(c) if c == "score" else F.col(c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*cols)).alias("json"))
