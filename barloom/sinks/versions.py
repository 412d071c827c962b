"""Bar tables in versions: hash-bucketed files, and a manifest that readers resolve.

A table is a folder with ``data/`` and ``manifests/``. Symbols are dealt by hash over a
fixed number of buckets, so the number of files follows from the buckets and the data and
not from the number of symbols. Files are sorted by symbol, timeframe and time and carry
Bloom filters on the symbol, so a filter on symbols reads their buckets only and skips
row groups there.

A writer puts whole buckets under a fresh folder and only then writes one small manifest
that names the folder of every bucket. Readers follow the newest manifest: they see all
of a version or nothing of it, whatever fails half way. Two writers of one version cannot both
win, as a manifest is never overwritten: the second one fails and may run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.select import select_symbols
from barloom.sources.schemas import BAR_COLUMNS, BAR_SCHEMA

BUCKETS = 64
_FILE_SCHEMA = BAR_SCHEMA  # the bucket is in the path only


def write_version(bars: DataFrame, root: str, replace: str = "table", buckets: int = BUCKETS) -> int:
    """Write the next version of the table under ``root``; its number is returned.

    ``replace="table"`` makes a version of these bars alone. ``replace="symbols"`` keeps all
    symbols that ``bars`` does not have: buckets that hold a written symbol are written
    anew with their other symbols, all other buckets stay where they are. The number of
    buckets is fixed by the first version (a whole replacement may change it).
    """
    if replace not in ("table", "symbols"):
        raise ValueError(f"replace must be 'table' or 'symbols', not {replace!r}")
    spark = bars.sparkSession
    before = _manifest(spark, root)
    number = before["version"] + 1 if before else 1
    rows = bars.select(*BAR_COLUMNS)
    kept: dict[str, str] = {}
    if replace == "symbols" and before:
        buckets = before["buckets"]
        written = rows.select("symbol").distinct()
        touched = {str(r.bucket) for r in written.select(_bucket(buckets).alias("bucket")).distinct().collect()}
        kept = {b: folder for b, folder in before["folders"].items() if b not in touched}
        others = [folder for b, folder in before["folders"].items() if b in touched]
        if others:
            old = _read(spark, root, others)
            rows = rows.unionByName(old.join(written, old.symbol.eqNullSafe(written.symbol), "left_anti"))
    folder = f"data/{number}-{uuid.uuid4().hex}"
    (
        rows.withColumn("bucket", _bucket(buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "symbol", "timeframe", "timestamp")
        .write.partitionBy("bucket")
        .option("parquet.bloom.filter.enabled#symbol", "true")
        .parquet(f"{root}/{folder}")
    )
    new = {b: f"{folder}/bucket={b}" for b in _buckets_in(spark, f"{root}/{folder}")}
    _publish(spark, root, {"version": number, "buckets": buckets, "folders": kept | new})
    return number


def read_version(
    spark: SparkSession, root: str, version: int | None = None, symbols: Sequence[str] | None = None
) -> DataFrame:
    """The bars of one version, by default the newest; of some symbols from their buckets alone."""
    manifest = _manifest(spark, root, version)
    if manifest is None:
        raise FileNotFoundError(f"no version {version or ''} under {root}")
    folders = manifest["folders"]
    if symbols is not None:
        values = [F.pmod(F.xxhash64(F.lit(s)), F.lit(manifest["buckets"])) for s in symbols]
        wanted = {str(b) for b in spark.range(1).select(F.array(*values).alias("b")).first().b} if values else set()
        folders = {b: folder for b, folder in folders.items() if b in wanted}
    rows = _read(spark, root, list(folders.values()))
    return rows if symbols is None else select_symbols(rows, symbols)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all published versions, rising."""
    fs, folder = _at(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def drop_versions(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Remove all but the newest ``keep`` versions, and folders that no kept manifest names.

    Folders of writers that are still at work are unnamed too: run it while none is.
    """
    if keep < 1:
        raise ValueError("at least one version must be kept")
    numbers = versions(spark, root)
    for number in numbers[:-keep]:
        fs, path = _at(spark, f"{root}/manifests/{number}.json")
        fs.delete(path, False)
    named = {f.split("/")[1] for n in numbers[-keep:] for f in _manifest(spark, root, n)["folders"].values()}
    fs, data = _at(spark, f"{root}/data")
    for status in fs.listStatus(data) if fs.exists(data) else []:
        if status.getPath().getName() not in named:
            fs.delete(status.getPath(), True)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _read(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], BAR_SCHEMA)
    return spark.read.schema(_FILE_SCHEMA).parquet(*[f"{root}/{folder}" for folder in folders]).select(*BAR_COLUMNS)


def _buckets_in(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _at(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return [n.removeprefix("bucket=") for n in names if n.startswith("bucket=")]


def _publish(spark: SparkSession, root: str, manifest: dict) -> None:
    fs, path = _at(spark, f"{root}/manifests/{manifest['version']}.json")
    try:
        out = fs.create(path, False)
    except Exception as clash:
        raise RuntimeError(f"version {manifest['version']} of {root} was written by another run") from clash
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()


def _manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """A version's manifest; the newest whole one if none is named."""
    for number in reversed(versions(spark, root) if version is None else [version]):
        fs, path = _at(spark, f"{root}/manifests/{number}.json")
        if fs.exists(path):
            stream = fs.open(path)
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            try:
                return json.loads(text)
            except ValueError:  # its writer has not finished
                continue
    return None
