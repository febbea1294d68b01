"""Sets of tables that appear at once: new folders first, then one manifest that names them."""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.tables import write

# A row per live part (the values of its partition columns as JSON) of a version's tables; ``parts`` is how many its folder has.
ENTRY = (
    "writer string, name string, columns array<string>, schema string, folder string, part string, parts long, "
    "rows long, version long"
)


def _root(path: str) -> str:
    return path.rstrip("/")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all versions, none where nothing is published yet."""
    try:
        return spark.read.schema(ENTRY).parquet(f"{_root(path)}/sets")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def last_version(spark: SparkSession, path: str) -> int:
    """The number of the last published version, 0 where there is none."""
    return manifest(spark, path).agg(F.max("version")).head()[0] or 0


def _entries(spark: SparkSession, path: str, version: int) -> list[Row]:
    """One row per table and live partition value of a version: as many as it has partition folders."""
    found = manifest(spark, path).filter(F.col("version") == version).collect()
    if len({r["writer"] for r in found}) > 1:
        raise ValueError(f"version {version} of {path} was published twice")
    return found


def _schema(entry: Row) -> T.StructType:
    return T.StructType.fromJson(json.loads(entry["schema"]))


def _folder(spark: SparkSession, path: str, schema: T.StructType, known: dict[str, DataFrame] | None) -> DataFrame:
    """The rows of a folder, which never changes once written, so ``known`` ones are not listed again."""
    known = {} if known is None else known
    if path not in known:
        known[path] = spark.read.schema(schema).parquet(path).select(*schema.names)
    return known[path]


def _part(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns)) if columns else F.lit("{}")


def publish(
    tables: Mapping[str, DataFrame],
    path: str,
    by: Mapping[str, Sequence[str]] | None = None,
    edit: bool = False,
    rows_per_file: int = 2_000_000,
    known: dict[str, DataFrame] | None = None,
) -> int:
    """Writes ``tables`` as the next version of the set at ``path`` and returns its number.

    Nothing published is touched: data go to fresh folders, and the version exists from the moment
    its manifest, one file, does. A run that is killed before leaves the last version as it was, and folders that nobody
    reads. With ``edit`` the tables that are not named stay, and of a partitioned table the partitions
    without new rows stay; without it the set consists of ``tables`` alone. A table keeps its columns and
    partition columns as long as parts of it stay. Two writers of one version are found when it is read. An
    empty text in a partition column is read as null, as always in Spark. ``known`` is filled for ``read_set``.
    """
    if not tables:
        raise ValueError("a set holds one table at least")
    spark = next(iter(tables.values())).sparkSession
    root, writer = _root(path), uuid.uuid4().hex
    last = last_version(spark, path)
    before = _entries(spark, path, last) if edit and last else []
    by = {name: list((by or {}).get(name, ())) for name in tables}
    old = {r["name"]: (_schema(r).simpleString(), list(r["columns"])) for r in before}
    for name, df in tables.items():
        if by[name] and name in old and old[name] != (df.schema.simpleString(), by[name]):
            raise ValueError(f"{name} has other columns or partitions than the parts that stay")
    folders = write(tables, f"{root}/data/{writer}", "parquet", by, rows_per_file=rows_per_file)
    rows = []
    for name, folder in folders.items():
        columns, schema = by[name], tables[name].schema
        written = _folder(spark, folder, schema, known)
        counted = written.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).select(_part(columns).alias("part"), "n")
        parts = [tuple(r) for r in counted.collect()] or [(None, 0)]
        place = folder[len(root) + 1 :]
        rows += [(writer, name, columns, schema.json(), place, part, len(parts), n, last + 1) for part, n in parts]
    new = {(r[1], r[5]) for r in rows}
    for r in before:
        if r["name"] not in tables or (by[r["name"]] and (r["name"], r["part"]) not in new):
            rows.append((writer, *[r[c] for c in r.__fields__[1:-1]], last + 1))
    if last_version(spark, path) != last:
        raise ValueError(f"another writer has published version {last + 1} of {path}")
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{root}/sets")
    return last + 1


def read_set(
    spark: SparkSession, path: str, version: int | None = None, known: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """The tables of a version, or of the last one, by name.

    Each folder is scanned as a partitioned table, so filters and joins on partition columns prune it; partitions
    that a later version has replaced are left out by a filter on partition columns alone. Folders are listed once for
    all calls that share the dict ``known``, whatever the number of versions that name them.
    """
    wanted = last_version(spark, path) if version is None else version
    live: dict[str, dict[str, list[Row]]] = defaultdict(lambda: defaultdict(list))
    for r in _entries(spark, path, wanted):
        live[r["name"]][r["folder"]].append(r)
    if not live:
        raise ValueError(f"no version {wanted} at {path}")
    tables = {}
    for name, folders in live.items():
        whole = None
        for folder, own in sorted(folders.items()):
            schema = _schema(own[0])
            df = _folder(spark, f"{_root(path)}/{folder}", schema, known)
            if len(own) < own[0]["parts"]:
                df = df.filter(_part(own[0]["columns"]).isin([r["part"] for r in own]))
            whole = df if whole is None else whole.unionByName(df)
        tables[name] = whole
    return tables
