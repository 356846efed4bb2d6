"""Sinks: whole tables are written as new versions; updates, upserts and deletes are functions from table to table.

Plain Parquet has no MERGE. A change is therefore a DataFrame of the table's next state; `store` commits such changes to
several tables at once, so that a reader sees all of them or none.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where that is unset, a temporary one, but only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="censa-")
    return f"{root.rstrip('/')}/censa-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, so that the steps that follow do not compute them again."""
    path = f"{scratch_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._censa_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by `written` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._censa_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def one_per_key(df: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Of each key the row of the last version; of equal or no versions the one whose content, as JSON, comes first."""
    order = [F.col(version).desc()] if version else []
    order.append(F.to_json(F.struct("*")))
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def create_or_replace(df: DataFrame, path: str, *partitions: str) -> None:
    """Writes the table anew. The source must not be the target itself; see `store` for that."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(table: DataFrame, changes: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Rows of `changes` replace those of equal key; of several changes to a key `one_per_key` counts."""
    changes = one_per_key(changes, key, version)
    kept = table.join(changes.select(*key), key, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def insert_missing(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Adds rows whose key is not there yet; of several `one_per_key` counts."""
    return table.unionByName(one_per_key(changes, key).join(table.select(*key), key, "left_anti"), allowMissingColumns=True)


def add_counts(table: DataFrame, changes: DataFrame, key: list[str], count: str) -> DataFrame:
    """Adds the counts of equal keys."""
    return table.select(*key, count).unionByName(changes.select(*key, count)).groupBy(*key).agg(F.sum(count).alias(count))


def replace_key(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of each key in `rows` go, and its rows come."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, where, **values) -> DataFrame:
    """New values (columns, or literals) where the condition holds; null as a value keeps the old one, as coalesce(?, col) does."""
    for name, value in values.items():
        value = value if isinstance(value, type(F.lit(1))) else F.lit(value)
        table = table.withColumn(name, F.when(where, F.coalesce(value, F.col(name))).otherwise(F.col(name)))
    return table


def merge_databases(databases: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The union of several databases. The one with most tables, then most columns, gives the schema.

    Columns that a database lacks are null; columns that the donor lacks are an error; images get is_synthetic from their id.
    """
    donor = max(databases, key=lambda d: (len(d), sum(len(t.columns) for t in d.values())))
    out = {}
    for name, like in donor.items():
        parts = [d[name] for d in databases if name in d]
        for part in parts:
            if unknown := set(part.columns) - set(like.columns):
                raise ValueError(f"{name}: unknown columns {sorted(unknown)}")
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        whole = whole.select(*(F.col(c).cast(like.schema[c].dataType).alias(c) for c in like.columns))
        if name == "images" and "is_synthetic" in like.columns:
            whole = whole.withColumn("is_synthetic", F.coalesce("is_synthetic", F.col("image_id").cast("string").rlike("_g[0-9]+$")))
        out[name] = whole
    return out


def delta_merge(tables: dict[str, DataFrame], new: dict[str, DataFrame], key: dict[str, str], default: str) -> dict[str, DataFrame]:
    """Tables with the rows of `new` whose key is unseen; a table that is not there is taken as it is."""
    out = dict(tables)
    for name, rows in new.items():
        k = key.get(name, default)
        out[name] = rows if name not in tables else tables[name].unionByName(rows.join(tables[name].select(k).distinct(), k, "left_anti"), allowMissingColumns=True)
    return out


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables without the rows of these ids, in tables that have the key."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") if key in df.columns else df for name, df in tables.items()}


def snapshot(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    """A copy of the named tables of a database."""
    for name in names:
        spark.read.parquet(f"{source}/{name}.parquet").write.mode("overwrite").parquet(f"{target}/{name}.parquet")


def roster_csv(roster: DataFrame, path: str, order: str) -> None:
    """A roster as one CSV file with a header; a report, so it is brought into one file."""
    roster.orderBy(order).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
