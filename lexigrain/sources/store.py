"""Saved indexes: Parquet sorted by token, or JSON lines, each with a sidecar that names the normaliser.

An index is written in the partitions it comes in, without a shuffle. Pages of a token-sorted file have
narrow ranges of tokens, so that a look-up skips nearly all of them.
"""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lexigrain.functions.normalise import from_spec
from lexigrain.operators.index import LOCATIONS, Index

FORMAT = 1

#: Locations in a JSON document of a token.
MOST = 50_000

#: The fields of a location.
PLACE = ("field_idx", "token_idx", "src_idx", "src_len", "contrib")

#: Locations in a JSON document of a token.
MOST = 50_000

#: The fields of a location.
PLACE = ("field_idx", "token_idx", "src_idx", "src_len", "contrib")


def workspace(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_lexigrain_workspace", None)
    if found is None:
        found = spark.sparkContext._lexigrain_workspace = Path(tempfile.mkdtemp(prefix="lexigrain-index-")).as_uri()
    return found


class IndexFormatError(ValueError):
    """What was read isn't a saved index."""


def _sidecar(index: Index, kind: str, **more: str) -> str:
    entries = index.entries.select("token", "key", "weight", "locations")
    return json.dumps({"format": FORMAT, "kind": kind, "normaliser": index.normaliser.spec(), "schema": json.loads(entries.schema.json())} | more)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_entries(entries: DataFrame, path: str, mode: str) -> None:
    rows = entries.select("token", "key", "weight", "locations")
    rows.sortWithinPartitions("token", "key").write.mode(mode).option("compression", "zstd").parquet(f"{path}/entries")


def write_parquet(index: Index, path: str, mode: str = "errorifexists") -> None:
    write_entries(index.entries, path, mode)
    write_sidecar(index, path)


def write_sidecar(index: Index, path: str) -> None:
    _write_text(index.entries.sparkSession, f"{path}/index.json", _sidecar(index, "parquet"))


def write_json(index: Index, path: str, mode: str = "errorifexists") -> None:
    """Gzipped lines, an entry each, its locations as parallel arrays; nulls are kept."""
    rows = index.entries.select("token", "key", "weight", *[F.col(f"locations.{name}").alias(name) for name in PLACE])
    rows.write.mode(mode).option("ignoreNullFields", "false").options(compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).json(f"{path}/entries")
    _write_text(rows.sparkSession, f"{path}/index.json", _sidecar(index, "json", layout="arrays"))


def _from_arrays(rows: DataFrame) -> DataFrame:
    """Entries of locations as parallel arrays; arrays of different sizes are an error."""
    first = F.size(PLACE[0])
    same = F.forall(F.array(*[F.size(name) for name in PLACE]), lambda n: n == first)
    zipped = F.when(~same, F.raise_error(F.lit("locations of different sizes")).cast(LOCATIONS)).when(F.col(PLACE[0]).isNotNull(), F.arrays_zip(*PLACE).cast(LOCATIONS))
    return rows.select("token", "key", "weight", zipped.alias("locations"))


def read(spark: SparkSession, path: str) -> Index:
    """A saved index; the sidecar and the columns are checked, and malformed rows are errors when they are read."""
    try:
        found = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/index.json").collect()))
        schema, kind = StructType.fromJson(found["schema"]), found["kind"]
        normaliser = from_spec(found["normaliser"])
        if found["format"] != FORMAT or kind not in ("parquet", "json"):
            raise IndexFormatError(f"{path}: unknown format")
    except IndexFormatError:
        raise
    except Exception as e:
        raise IndexFormatError(f"{path}: no readable index.json") from e
    if kind == "parquet":
        rows = spark.read.parquet(f"{path}/entries")
        if {f.name: f.dataType.simpleString() for f in rows.schema} != {f.name: f.dataType.simpleString() for f in schema}:
            raise IndexFormatError(f"{path}: columns differ from the sidecar's")
    else:
        flat = found.get("layout") == "arrays"  # before, lines held the locations as they are
        lines = StructType([f for f in schema if f.name != "locations"] + [StructField(f.name, ArrayType(f.dataType)) for f in schema["locations"].dataType.elementType]) if flat else schema
        rows = spark.read.schema(lines).option("mode", "FAILFAST").json(f"{path}/entries")
        rows = _from_arrays(rows) if flat else rows
    return Index(rows.select("token", "key", "weight", "locations"), normaliser)


def as_json(index: Index, most: int = MOST) -> DataFrame:
    """One JSON document per token, its postings as parallel arrays; a token of more than most locations has several,
    each with other keys and about so many locations."""
    # only the tokens of several documents are sent to all tasks: at most one for so many locations of the index
    sizes = index.entries.groupBy("token").agg(F.sum(F.greatest(F.size("locations.field_idx"), F.lit(1))).alias("_n"))
    several = F.broadcast(sizes.where(F.col("_n") > most))
    part = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("key"), F.ceil(F.col("_n") / most))).otherwise(F.lit(0)).alias("_part")
    rows = index.entries.join(several, "token", "left").select("token", part, "key", "weight", "locations")
    grouped = rows.groupBy("token", "_part").agg(F.sort_array(F.collect_list(F.struct("key", "weight", "locations"))).alias("p"))
    columns = F.struct("token", F.transform("p", lambda x: x["key"]).alias("keys"), F.transform("p", lambda x: x["weight"]).alias("weights"), F.transform("p", lambda x: x["locations"]).alias("locations"))
    return grouped.select("token", F.to_json(columns, {"ignoreNullFields": "false"}).alias("json"))


def from_json(documents: DataFrame, key_type: str = "long") -> DataFrame:
    """The entries of as_json()."""
    kind = f"token string, keys array<{key_type}>, weights array<double>, locations array<{LOCATIONS}>"
    rows = documents.select(F.from_json("json", kind, {"mode": "FAILFAST"}).alias("d"))
    zipped = F.explode(F.arrays_zip(F.col("d.keys").alias("key"), F.col("d.weights").alias("weight"), F.col("d.locations").alias("locations")))
    return rows.select("d.token", zipped.alias("x")).select("token", "x.key", "x.weight", "x.locations")
