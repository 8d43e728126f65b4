"""The lake: Parquet tables whose committed files are those that a manifest lists.

Writing: rows are partitioned by (p_dt, p_tenant, p_task_type), payloads over a size go to
the blobs_data table by their hash, and the manifest is written last, by rename: until then
no reader sees the batch. Partition columns have names of their own, as their values are
made safe for paths and the file keeps the true ones. Reading: files of all manifests,
rows deduplicated, patches marked. All file work goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import schemas
from skein.functions.values import sanitised, truncated

INLINE = 8192
MOST_RECORDS = 2_000_000
PARTITIONS = ("p_dt", "p_tenant", "p_task_type")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Files below a path, by name."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        name = it.next().getPath().toString()
        if name.endswith(suffix):
            found.append(name)
    return sorted(found)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    temporary = p.suffix(".tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(temporary, p)


@dataclass
class Lake:
    spark: SparkSession
    root: str

    def manifests(self) -> DataFrame:
        """A row a listed file: batch_id, written_at, table, path, rows."""
        files = listed(self.spark, f"{self.root}/manifests", ".json")
        kind = "batch_id string, schema_version string, written_at string, files array<struct<path:string,rows:bigint,bytes:bigint,table:string>>"
        if not files:
            return self.spark.createDataFrame([], "batch_id string, schema_version string, written_at string, table string, path string, rows bigint")
        read = self.spark.read.schema(kind).json(files, multiLine=True)
        return read.select("batch_id", "schema_version", "written_at", F.explode("files").alias("f")).select("batch_id", "schema_version", "written_at", "f.table", "f.path", "f.rows")

    def committed(self, table: str) -> list[str]:
        """Paths of a table's committed files; a file listed twice counts once."""
        return sorted({f"{self.root}/{r['path']}" for r in self.manifests().where(F.col("table") == table).select("path").collect()})

    def _table(self, table: str) -> DataFrame:
        paths = self.committed(table)
        if not paths:
            return self.spark.createDataFrame([], schemas.schema(table)).withColumns({"_path": F.lit(""), "_row": F.lit(0).cast("bigint")})
        read = self.spark.read.schema(schemas.schema(table)).option("basePath", f"{self.root}/{table}").parquet(*paths)
        return read.select(*schemas.schema(table).names, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))

    def _first(self, rows: DataFrame, keys: list[str], order: list) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_path", "_row"))
        return rows.withColumn("_n", number).where("_n = 1").drop("_n", "_path", "_row")

    def episodes(self) -> DataFrame:
        """Episodes once each; status `patched` where late steps have come, which are in `steps`."""
        rows = self._table("episodes")
        own = self._first(rows.where("status <> 'patched'"), ["episode_id"], [])
        patched = rows.where("status = 'patched'").select("episode_id", F.lit(True).alias("_p")).distinct()
        joined = own.join(patched, "episode_id", "left")
        return joined.withColumn("status", F.when(F.col("_p"), "patched").otherwise(F.col("status"))).select(*schemas.schema("episodes").names)

    def ordered_episodes(self) -> DataFrame:
        """Episodes by start, then id."""
        return self.episodes().orderBy("started_at", "episode_id")

    def steps(self) -> DataFrame:
        """Steps of known episodes, once per step_idx, the earliest."""
        rows = self._first(self._table("steps"), ["episode_id", "step_idx"], ["started_at"])
        return rows.join(self.episodes().select("episode_id"), "episode_id", "left_semi")

    def outcomes(self) -> DataFrame:
        return self._table("outcomes").drop("_path", "_row")

    def rewards(self) -> DataFrame:
        return self._table("rewards").drop("_path", "_row")

    def labels(self) -> DataFrame:
        return self._table("labels").drop("_path", "_row")

    def blobs(self) -> DataFrame:
        """sha256 and content of stored payloads."""
        at = f"{self.root}/blobs_data"
        return self.spark.read.parquet(at).select("sha256", "content").dropDuplicates(["sha256"]) if exists(self.spark, at) else self.spark.createDataFrame([], "sha256 string, content string")

    def resolved(self, steps: DataFrame) -> DataFrame:
        """Steps with content_inline filled from the blobs; an inline payload wins."""
        stored = self.blobs().select(F.col("sha256").alias("content_ref"), "content")
        joined = steps.join(stored, "content_ref", "left")
        return joined.withColumn("content_inline", F.coalesce("content_inline", "content")).select(*steps.columns)

    def unmanifested(self) -> int:
        """Files of the tables that no manifest names, by an anti join of paths below the root."""
        known = self.manifests().select("path").distinct()
        total = 0
        for table in ("episodes", "steps", "outcomes", "rewards", "labels"):
            at = f"{self.root}/{table}"
            if exists(self.spark, at):
                # listed by the executors; the content is not read
                here = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(at).select("path")
                below = F.concat(F.lit(f"{table}/"), F.substring_index("path", f"{self.root.split(':', 1)[-1].lstrip('/')}/{table}/", -1))
                total += here.select(below.alias("path")).join(known, "path", "left_anti").count()
        return total

    def write(self, inline: int = INLINE, collector: str = "skein", most_bytes: int | None = None, compression: str = "zstd", most_records: int = MOST_RECORDS, **tables: DataFrame) -> str:
        """Writes tables as one batch and commits it; the batch's id. compression: zstd, snappy or none; a file rolls at most_records rows."""
        if compression not in ("zstd", "snappy", "none"):
            raise ValueError(f"compression is zstd, snappy or none, not {compression!r}")
        batch, now = uuid.uuid4().hex, datetime.now(UTC)
        stats = {"blobs_new": 0, "blobs_deduped": 0}
        if "steps" in tables:
            tables = dict(tables)
            tables["steps"] = self._externalised(tables["steps"], inline, most_bytes, stats)
        for name, rows in tables.items():
            rows = schemas.fitted(rows, name)
            if name in ("episodes", "steps"):
                rows = self._partitioned(name, rows, tables.get("episodes"))
            else:
                rows = rows.withColumn("p_dt", F.lit(now.date().isoformat()))
            keys = [c for c in rows.columns if c.startswith("p_")]
            # the batch's own folder: its files are known without looking through the table
            rows.withColumn("p_batch", F.lit(batch)).write.mode("append").option("compression", compression).option("maxRecordsPerFile", most_records).partitionBy(*keys, "p_batch").parquet(f"{self.root}/{name}")
        self._commit(batch, now, list(tables), collector, stats)
        return batch

    def _partitioned(self, name: str, rows: DataFrame, episodes: DataFrame | None) -> DataFrame:
        if name == "episodes":
            return rows.withColumns({"p_dt": F.date_format("started_at", "yyyy-MM-dd"), "p_tenant": sanitised(F.col("tenant")), "p_task_type": sanitised(F.col("task_type"))})
        if episodes is None:
            return rows.withColumns({"p_dt": F.date_format("started_at", "yyyy-MM-dd"), "p_tenant": F.lit("unknown"), "p_task_type": F.lit("unknown")})
        own = episodes.select("episode_id", F.date_format("started_at", "yyyy-MM-dd").alias("p_dt"), sanitised(F.col("tenant")).alias("p_tenant"), sanitised(F.col("task_type")).alias("p_task_type"))
        return rows.join(own.dropDuplicates(["episode_id"]), "episode_id", "left")

    def _externalised(self, steps: DataFrame, inline: int, most_bytes: int | None, stats: dict) -> DataFrame:
        rows = schemas.fitted(steps, "steps")
        if most_bytes:
            cut = F.octet_length("content_inline") > most_bytes
            rows = rows.withColumn("truncated", F.coalesce("truncated", F.lit(False)) | F.coalesce(cut, F.lit(False))).withColumn("content_inline", truncated(F.col("content_inline"), most_bytes))
        rows = externalise(rows, inline)
        big = rows.where("_content is not null").select(F.col("content_ref").alias("sha256"), F.col("_content").alias("content"))
        found = big.groupBy("sha256").agg(F.first("content").alias("content"), F.count("*").alias("n"))
        fresh = found.join(self.blobs().select("sha256"), "sha256", "left_anti")
        batch = uuid.uuid4().hex
        out = f"{self.root}/blobs_data/batch={batch}"
        fresh.select("sha256", "content", F.octet_length("content").cast("bigint").alias("bytes"), F.lit("application/json").alias("content_type"), F.lit("utf8").alias("encoding"), F.current_timestamp().alias("first_seen_at")).write.option("compression", "zstd").parquet(out)
        stats["blobs_new"] = self.spark.read.parquet(out).count()
        stats["blobs_deduped"] = big.count() - stats["blobs_new"]
        return rows.drop("_content")

    def _commit(self, batch: str, now: datetime, tables: list[str], collector: str, stats: dict) -> None:
        files, counts, low, high = [], {}, None, None
        for name in tables:
            own = [f for f in listed(self.spark, f"{self.root}/{name}", ".parquet") if f"p_batch={batch}" in f]
            counts[name] = 0
            if own:
                read = self.spark.read.schema(schemas.schema(name)).parquet(*own)
                per = read.groupBy(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).count().collect()  # a row a file
                for r in per:
                    at = r["f"].index(f"/{name}/p_")
                    files.append({"path": r["f"][at + 1 :], "rows": r["count"], "bytes": r["b"], "table": name})
                    counts[name] += r["count"]
                if name == "episodes":
                    low, high = read.agg(F.min("started_at").cast("string"), F.max("started_at").cast("string")).first()
        body = {
            "batch_id": batch, "schema_version": schemas.VERSION, "written_at": now.isoformat(), "collector": {"version": schemas.VERSION, "instance": collector},
            "time_range": {"min": low, "max": high}, "files": sorted(files, key=lambda f: f["path"]), "counts": counts | stats,
        }
        for name in tables:
            at = f"{self.root}/_schema/v{schemas.VERSION}/{name}.json"
            if not exists(self.spark, at):
                _write_text(self.spark, at, schemas.schema(name).json())
        _write_text(self.spark, f"{self.root}/manifests/dt={now.date().isoformat()}/{batch}.json", json.dumps(body, indent=1))


def externalise(steps: DataFrame, inline: int = INLINE) -> DataFrame:
    """Payloads over `inline` bytes move to `_content` and are named by content_ref; a step has one of inline and ref."""
    big = F.coalesce(F.octet_length("content_inline") > inline, F.lit(False))
    sha = F.sha2(F.col("content_inline").cast("binary"), 256)
    return steps.withColumns({"_content": F.when(big, F.col("content_inline")), "content_ref": F.when(big, sha).otherwise(F.when(F.col("content_inline").isNull(), F.col("content_ref"))), "content_inline": F.when(~big, F.col("content_inline"))})
