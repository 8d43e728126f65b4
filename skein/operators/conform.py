"""Conformance: eighteen checks of any lake, as one table (check, ref, passed, skipped, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import schemas
from skein.sources.lake import Lake, listed

#: Plausible times in microseconds: the years 2001 to 2099.
TIMES = (1_000_000_000_000_000, 4_102_444_800_000_000)


def _bad(rows: DataFrame, detail) -> tuple[int, str]:
    found = rows.agg(F.count("*").alias("n"), F.min(detail.cast("string")).alias("one")).first()
    return found["n"], found["one"] or ""


def unreadable(lake: Lake, table: str, paths: list[str]) -> list[str]:
    """The files that cannot be read to the end, every column: one job a table if all can, else halves of halves."""
    if not paths:
        return []
    try:
        lake.spark.read.schema(schemas.schema(table)).parquet(*paths).write.format("noop").mode("overwrite").save()
        return []
    except Exception as e:  # any unreadable file is a finding
        if len(paths) == 1:
            return [f"{paths[0]}: {type(e).__name__}"]
    half = len(paths) // 2
    return unreadable(lake, table, paths[:half]) + unreadable(lake, table, paths[half:])


def checks(lake: Lake) -> list[tuple[str, str, bool | None, str]]:
    """(name, reference, passed or None if skipped, detail); unmanifested files are looked at too."""
    spark = lake.spark
    files = {t: listed(spark, f"{lake.root}/{t}", ".parquet") for t in ("episodes", "steps", "outcomes", "rewards", "labels")}

    def table(name: str) -> DataFrame:
        return spark.read.schema(schemas.schema(name)).parquet(*files[name]) if files[name] else spark.createDataFrame([], schemas.schema(name))

    episodes, steps, outcomes, rewards = (table(t) for t in ("episodes", "steps", "outcomes", "rewards"))
    own = episodes.where("status <> 'patched'").dropDuplicates(["episode_id"])
    distinct = steps.dropDuplicates(["episode_id", "step_idx"])
    out: list[tuple[str, str, bool | None, str]] = []

    def add(name: str, ref: str, bad: tuple[int, str] | None, why: str = "") -> None:
        out.append((name, ref, None if bad is None else bad[0] == 0, why if bad is None else f"{bad[0]}: {bad[1]}" if bad[0] else ""))

    unread = [x for t, paths in files.items() for x in unreadable(lake, t, paths)]
    add("files readable", "layout", (len(unread), (unread or [""])[0]))
    if unread:
        return out
    add("schema_version stamped", "versioning", _bad(own.where("schema_version is null or schema_version = ''"), F.col("episode_id")))
    major = F.split("schema_version", r"\.")[0]
    add("versions compatible", "versioning", _bad(own.where(major != schemas.VERSION.split(".")[0]), F.col("schema_version")))
    lacking = " or ".join(f"{c} is null" + (f" or {c} = ''" if c in ("episode_id", "source") else "") for c in schemas.REQUIRED["episodes"])
    add("episode required fields", "episodes", _bad(own.where(lacking), F.col("episode_id")))
    add("status vocabulary", "episodes", _bad(episodes.where(~F.col("status").isin(*schemas.STATUSES)), F.col("status")))
    add("kind vocabulary", "steps", _bad(steps.where(~F.col("kind").isin(*schemas.KINDS)), F.col("kind")))
    add("trainable three-valued", "steps", _bad(steps.where(~F.coalesce("trainable", F.lit("")).isin(*schemas.TRAINABLE)), F.col("episode_id")))
    add("steps reference an episode", "steps", _bad(steps.join(episodes, "episode_id", "left_anti"), F.col("episode_id")))
    counted = distinct.where(F.col("step_idx") < schemas.PATCH_BASE).groupBy("episode_id").agg(F.count("*").alias("n"))
    add("step_count matches", "episodes", _bad(own.join(counted, "episode_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("step_count")), F.col("episode_id")))
    add("payload in one place", "payloads", _bad(steps.where("content_ref is not null and content_inline is not null"), F.col("episode_id")))
    stored = lake.blobs()
    add("payload reference resolves", "payloads", _bad(steps.where("content_ref is not null").join(stored, F.col("content_ref") == F.col("sha256"), "left_anti"), F.col("content_ref")))
    add("blob hash verifies", "payloads", _bad(stored.where(F.sha2(F.col("content").cast("binary"), 256) != F.col("sha256")), F.col("sha256")))
    parents = distinct.select("episode_id", F.col("step_idx").alias("parent_idx"))
    pointing = distinct.where("parent_idx is not null")
    add("parent_idx valid", "steps", _bad(pointing.where("parent_idx = step_idx").unionByName(pointing.join(parents, ["episode_id", "parent_idx"], "left_anti").select(*pointing.columns)), F.col("episode_id")))
    micros = F.unix_micros("started_at")
    add("timestamps plausible", "times", _bad(own.where((micros < TIMES[0]) | (micros > TIMES[1]) | (F.col("ended_at") < F.col("started_at"))), F.col("episode_id")))
    known = lake.manifests()
    add("manifests cover the data", "manifests", (n := lake.unmanifested(), f"{n} files in no manifest") if not known.isEmpty() else None, "no manifests")
    add("outcomes joinable", "outcomes", _bad(outcomes.where("coalesce(entity_key, '') = '' or coalesce(entity_name, '') = '' or kind is null or occurred_at is null or observed_at is null"), F.col("outcome_id")) if files["outcomes"] else None, "no outcomes")
    nameless = rewards.where("coalesce(verifier_id, '') = '' or coalesce(verifier_version, '') = ''").select("episode_id")
    add("rewards identified", "rewards", _bad(nameless.unionByName(rewards.join(own, "episode_id", "left_anti").select("episode_id")), F.col("episode_id")) if files["rewards"] else None, "no rewards")
    add("labels empty", "labels", _bad(table("labels"), F.col("episode_id")))
    return out


def report(lake: Lake) -> DataFrame:
    rows = [(name, ref, passed is True, passed is None, detail) for name, ref, passed, detail in checks(lake)]
    return lake.spark.createDataFrame(rows, "check string, ref string, passed boolean, skipped boolean, detail string")
