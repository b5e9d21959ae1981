"""The pattern library as one JSON file: written from its tables, validated and read back into them. No content is stored."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lifecycle import Library
from graphloom.schemas import LIBRARY_FILE

VERSIONS = ("1.1", "1.0")


#: Bytes of a library file at most; it is written by the driver.
MOST_BYTES = 512_000_000


def local_path(path: str) -> str:
    """A path without a scheme may begin with the home folder's '~'."""
    return path if "://" in path else os.path.expanduser(path)


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, fs = _place(spark, path)
    return fs.exists(where)


def library_row(library: Library, saved_at: str | None = None) -> DataFrame:
    """The library as one row of the file's schema. A library is of one installation's patterns, small by construction."""
    gather = lambda frame, name: frame.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name))
    by_obs = library.distributions.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("session_no", "degrees"))).alias("d"))
    spread = by_obs.agg(F.map_from_entries(F.collect_list(F.struct("obs_id", F.col("d.degrees")))).alias("session_distributions"))
    observations = library.observations.withColumn("entity_firing_counts", F.to_json("entity_firing_counts"))  # maps have no order to sort by
    row = gather(library.structural, "nodes").crossJoin(gather(observations, "observations")).crossJoin(spread)
    row = row.withColumn("observations", F.transform("observations", lambda o: o.withField("entity_firing_counts", F.from_json(o["entity_firing_counts"], "map<string,int>"))))
    when = saved_at or datetime.now(timezone.utc).isoformat()
    return row.select(F.lit(VERSIONS[0]).alias("format_version"), F.lit(when).alias("saved_at"), F.size("nodes").alias("node_count"), F.size("observations").alias("observation_count"), "nodes", "observations", "session_distributions", F.lit(True).alias("_content_free"))


def save_library(library: Library, path: str, saved_at: str | None = None) -> dict:
    """Writes the library as one indented JSON file at `path` ('~' is the home folder); says how many nodes and observations it holds.

    The file is written next to its place and moved there, so a save that fails leaves the old one. A library larger than MOST_BYTES is no single
    file's matter: ValueError.
    """
    spark = library.structural.sparkSession
    size = lambda frame, c: frame.agg(F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0]
    numbers = size(library.structural, "pattern_embedding") + size(library.observations, "pattern_embedding") + size(library.distributions, "degrees")
    if numbers * 24 > MOST_BYTES:
        raise ValueError(f"a library of {numbers} numbers is larger than one file should be")
    row = json.loads(library_row(library, saved_at).toJSON(use_unicode=True).first())  # one row of bounded size
    path = local_path(path)
    where, fs = _place(spark, path)
    part, _ = _place(spark, f"{path}.part")
    fs.setWriteChecksum(False)
    if where.getParent() is not None:
        fs.mkdirs(where.getParent())
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(row, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(where), options)
    return {"path": path, "nodes_saved": row["node_count"], "observations_saved": row["observation_count"], "saved_at": row["saved_at"]}


def _checked(spark: SparkSession, path: str) -> None:
    """Raises ValueError unless the file is a JSON object with a list of nodes and a known version."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()  # bounded by what is saved
    try:
        found = json.loads(rows[0][0]) if len(rows) == 1 else None
    except ValueError as e:
        raise ValueError(f"{path}: no JSON") from e
    if not isinstance(found, dict) or not isinstance(found.get("nodes"), list):
        raise ValueError(f"{path}: no pattern library")
    version = next((v for k, v in found.items() if k.endswith("version")), None)
    if version not in VERSIONS:
        raise ValueError(f"{path}: version {version or 'missing'} is not one of {', '.join(VERSIONS)}")


def load_library(spark: SparkSession, path: str) -> Library:
    """The library's tables. FileNotFoundError if there is none, ValueError if the file is no library; missing fields take their defaults."""
    path = local_path(path)
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    _checked(spark, path)
    row = spark.read.schema(LIBRARY_FILE).json(path, multiLine=True)
    s = row.select(F.explode("nodes").alias("n")).select("n.*").fillna({"session_count": 0, "diversity_score": 0.0, "is_generalised": True, "attention_mode": "infrastructure", "reactivation_count": 0})
    o = row.select(F.explode("observations").alias("n")).select("n.*").fillna({"confirmation_count": 0, "diversity_score": 0.0, "stabilisation_score": 0.0, "sessions_active": 0})
    o = o.withColumn("example_labels", F.coalesce("example_labels", F.array().cast("array<string>"))).withColumn("entity_firing_counts", F.coalesce("entity_firing_counts", F.expr("CAST(map() AS MAP<STRING, INT>)")))
    d = row.select(F.explode("session_distributions").alias("obs_id", "d")).select("obs_id", F.posexplode("d").alias("i", "degrees")).select("obs_id", (F.col("i") + 1).cast("int").alias("session_no"), "degrees")
    return Library(s, o, d)


def library_info(spark: SparkSession, path: str) -> dict | None:
    """What a library file says of itself, reading its counts alone; None if there is no such file."""
    path = local_path(path)
    if not _exists(spark, path):
        return None
    _checked(spark, path)
    row = spark.read.schema("saved_at string, node_count int, observation_count int").json(path, multiLine=True).select("*", "_metadata.file_size").first()
    return {"path": path, "saved_at": row[0], "node_count": row[1], "observation_count": row[2], "size_bytes": row[3]}
