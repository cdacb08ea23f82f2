"""Writes against Parquet tables: append-new, upsert, patch, retain, alerts.

A table is a folder of Parquet files and of versions. Rows lie in ``data/_set=<id>/_bucket=<k>``: each write
makes a set under a name of its own, so two writers never share a folder, and the bucket is the hash of the
key. A version ``_versions/<n>`` holds one small file that lists the folders in force. Appends, upserts and
replacements all publish a version: the file is written beside and put in place by one rename, which fails
for the second of two writers; that one starts again from the new version. An upsert rewrites only the
buckets its keys fall into. A job that dies leaves the version before it in force. A folder of plain Parquet
files is read as it is, and its rows are taken over by the first write.

Publishing needs a file system whose rename is atomic (HDFS, local disks); object stores need a committer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.windows import first_per_key
from ..runtime import checkpoint

BUCKETS = 16
TRIES = 8
SET, BUCKET = "_set", "_bucket"


class LostRace(RuntimeError):
    """Another writer published the version first."""


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, jpath = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(jpath)] if fs.exists(jpath) else []


def table_version(spark: SparkSession, path: str) -> int | None:
    """Number of the version in force; None for a table without versions."""
    return max((int(n) for n in _names(spark, path.rstrip("/") + "/_versions") if n.isdigit()), default=None)


def _version(spark: SparkSession, path: str, n: int | None) -> dict:
    """What a version says: schema, keys, number of buckets and the sets of each bucket."""
    if n is None:
        return {"schema": None, "keys": [], "buckets": BUCKETS, "sets": {}, "parts": []}
    folder = f"{path.rstrip('/')}/_versions/{n}"
    name = next(x for x in _names(spark, folder) if x.endswith(".json"))
    fs, jpath = _fs(spark, f"{folder}/{name}")
    stream = fs.open(jpath)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, n: int, content: dict) -> None:
    """Put version ``n`` in place; raises LostRace if it is there already."""
    root, token = f"{path.rstrip('/')}/_versions", uuid.uuid4().hex
    fs, made = _fs(spark, f"{root}/.{token}/{token}.json")
    out = fs.create(made, False)
    try:
        out.write(bytearray(json.dumps(content).encode("utf-8")))
    finally:
        out.close()
    goal = f"{root}/{n}"
    if not path_exists(spark, goal):
        fs.rename(_fs(spark, f"{root}/.{token}")[1], _fs(spark, goal)[1])
    if not path_exists(spark, f"{goal}/{token}.json"):  # a folder moved onto another ends up inside it or stays
        for left in (f"{goal}/.{token}", f"{root}/.{token}"):
            delete_path(spark, left)
        raise LostRace(f"{goal} was published by another writer")


def _plain(spark: SparkSession, path: str) -> bool:
    return any(not n.startswith(("_", ".")) and n != "data" for n in _names(spark, path.rstrip("/")))


def table_exists(spark: SparkSession, path: str) -> bool:
    """True for a table with a published version or with plain Parquet files."""
    return table_version(spark, path) is not None or _plain(spark, path)


def _rows(spark: SparkSession, path: str, content: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version, of the given buckets only."""
    schema = StructType.fromJson(content["schema"])
    root = f"{path.rstrip('/')}/data"
    folders = [f"{root}/{SET}={name}/{BUCKET}={b}" for b, names in content["sets"].items() for name in names
               if buckets is None or int(b) in buckets]
    if not folders:
        return spark.createDataFrame([], schema)
    stored = StructType(list(schema.fields)).add(SET, "string").add(BUCKET, "integer")
    return spark.read.schema(stored).option("basePath", root).parquet(*folders).select(*schema.names)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version in force, or the plain files of a table without versions."""
    n = table_version(spark, path)
    return spark.read.parquet(path) if n is None else _rows(spark, path, _version(spark, path, n))


def _bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)


def _write_set(df: DataFrame, path: str, keys: list[str], buckets: int, partition_by: list[str]) -> tuple[str, list[int]]:
    """Write rows as a new set; its name and the buckets it has."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/data/{SET}={name}"
    df.withColumn(BUCKET, _bucket_of(keys, buckets)).write.partitionBy(BUCKET, *partition_by).parquet(folder)
    return name, sorted(int(n.split("=")[1]) for n in _names(spark, folder) if n.startswith(BUCKET))


def _next(old: dict, df: DataFrame, keys: list[str], sets: dict, partition_by: list[str]) -> dict:
    return {"schema": json.loads(df.schema.json()), "keys": keys, "buckets": old["buckets"], "sets": sets, "parts": partition_by}


def _expire(spark: SparkSession, path: str, n: int, keep: int) -> None:
    """Drop versions before the last ``keep`` and the sets that only they list; sets of running writers stay."""
    root = path.rstrip("/")
    versions = sorted(int(v) for v in _names(spark, f"{root}/_versions") if v.isdigit())
    old = [v for v in versions if v <= n - keep]
    if not old:
        return
    listed = lambda vs: {name for v in vs for names in _version(spark, path, v)["sets"].values() for name in names}
    for name in listed(old) - listed([v for v in versions if v > n - keep]):
        delete_path(spark, f"{root}/data/{SET}={name}")
    for v in old:
        delete_path(spark, f"{root}/_versions/{v}")


def _retried(step):
    """Run a write from the newest version until it is published."""
    for k in range(TRIES):
        try:
            return step()
        except LostRace:
            if k == TRIES - 1:
                raise


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2, keys: list[str] | None = None) -> int:
    """Publish a version that holds exactly these rows; versions older than the last ``keep`` are deleted."""
    spark, parts, keys = df.sparkSession, partition_by or [], keys or []

    def step() -> int:
        n = table_version(spark, path)
        old = _version(spark, path, n)
        name, buckets = _write_set(df, path, keys, old["buckets"], parts)
        _publish(spark, path, (n or 0) + 1, _next(old, df, keys, {str(b): [name] for b in buckets}, parts))
        return (n or 0) + 1

    n = _retried(step)
    _expire(spark, path, n, keep)
    return n


def _start(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None) -> tuple[int | None, dict, list[str]]:
    """The version in force with buckets by ``keys``; rows stored otherwise are dealt anew first."""
    spark = df.sparkSession
    n = table_version(spark, path)
    old = _version(spark, path, n)
    parts = partition_by if partition_by is not None else old["parts"]
    if n is None and not _plain(spark, path) or n is not None and (old["keys"] == keys or not keys):
        return n, old, parts
    replace_table(read_table(spark, path), path, parts, keys=keys)
    n = table_version(spark, path)
    return n, _version(spark, path, n), parts


def _appended(old: dict, name: str, buckets: list[int]) -> dict:
    return {**old["sets"], **{str(b): [*old["sets"].get(str(b), []), name] for b in buckets}}


def append_new(df: DataFrame, path: str, key: str = "url", order: list[str] | None = None,
               partition_by: list[str] | None = None, keep: int = 2) -> DataFrame:
    """Insert rows whose key is not stored in the version in force; returns exactly the inserted rows.

    Rows without a key cannot be compared and are inserted as they are.
    """
    spark = df.sparkSession
    candidates = first_per_key(df.filter(F.col(key).isNotNull()), [key], order or [key])

    def step() -> DataFrame:
        n, old, parts = _start(df, path, [key], partition_by)
        fresh = candidates
        if n is not None:
            fresh = fresh.join(_rows(spark, path, old).select(key), key, "left_anti").select(*df.columns)
        inserted = checkpoint(fresh.unionByName(df.filter(F.col(key).isNull())))
        name, buckets = _write_set(inserted, path, [key], old["buckets"], parts)
        _publish(spark, path, (n or 0) + 1, _next(old, df, [key], _appended(old, name, buckets), parts))
        _expire(spark, path, (n or 0) + 1, keep)
        return inserted

    return _retried(step)


def latest_rows(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Union with the newest row per key; rows of ``new`` win over stored ones."""
    tagged = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    by = [F.desc("_v")] + ([F.desc(order)] if order else [])
    return first_per_key(tagged, keys, by).drop("_v")


def upsert_latest(df: DataFrame, path: str, keys: list[str], order: str | None = None,
                  upper: str | None = None, keep: int = 2) -> None:
    """Insert or replace on the key; ``upper`` names a column to store in upper case.

    Only buckets that the new rows fall into are read and written again.
    """
    spark = df.sparkSession
    new = df.withColumn(upper, F.upper(upper)) if upper else df

    def step() -> None:
        n, old, parts = _start(new, path, keys, None)
        touched = [r[0] for r in new.select(_bucket_of(keys, old["buckets"])).distinct().collect()]  # at most one row a bucket
        stored = _rows(spark, path, old, touched) if n is not None else new.limit(0)
        merged = latest_rows(stored, new, keys, order)
        name, buckets = _write_set(merged, path, keys, old["buckets"], parts)
        sets = {b: names for b, names in old["sets"].items() if int(b) not in touched} | {str(b): [name] for b in buckets}
        _publish(spark, path, (n or 0) + 1, _next(old, merged, keys, sets, parts))
        _expire(spark, path, (n or 0) + 1, keep)

    _retried(step)


def append_log(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> None:
    """Append all rows; a table with a key keeps its buckets."""
    spark = df.sparkSession
    n, old, parts = _start(df, path, [], partition_by)
    name, buckets = _write_set(df, path, old["keys"], old["buckets"], parts)

    def step() -> None:  # the set does not depend on what is stored, so only the listing is done again
        n, old, _ = _start(df, path, [], partition_by)
        _publish(spark, path, (n or 0) + 1, _next(old, df, old["keys"], _appended(old, name, buckets), parts))
        _expire(spark, path, (n or 0) + 1, keep)

    _retried(step)


def update_fields(base: DataFrame, patch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Base rows with the non-null columns of the matching patch row.

    Of several patch rows for one key the one with the largest ``order`` counts, whole (without ``order``: the
    largest row by its columns), never a mixture.
    """
    cols = [c for c in patch.columns if c not in (key, order)]
    p = first_per_key(patch, [key], [F.desc(c) for c in ([order] if order else []) + cols])
    p = p.select(F.col(key), *[F.col(c).alias(f"_p_{c}") for c in cols])
    joined = base.join(p, key, "left")
    return joined.select(*[F.coalesce(f"_p_{c}", F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def retain(df: DataFrame, days: int, as_of: Column, ts: str = "captured_at") -> DataFrame:
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def drop_orphans(child: DataFrame, parent: DataFrame, key: str = "news_id") -> DataFrame:
    return child.join(parent.select(key), key, "left_semi")


CHANNELS = {"telegram": ["critical", "important", "notable"], "pushover": ["critical", "important"]}


def alert_rows(decisions: DataFrame, level: str = "alert_level", channels=CHANNELS) -> DataFrame:
    """One row per alert and channel; notable alerts are silent, normal ones are not sent."""
    none = F.lit(None).cast("string")
    names = F.array_compact(F.array(*[F.when(F.col(level).isin(levels), F.lit(name)).otherwise(none)
                                      for name, levels in channels.items()]))
    return (decisions.withColumn("channel", F.explode(names))
            .withColumn("silent", F.col(level) == "notable"))


def write_alerts(decisions: DataFrame, path: str, level: str = "alert_level") -> None:
    alert_rows(decisions, level).write.mode("append").partitionBy("channel").parquet(path)
