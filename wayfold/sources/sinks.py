"""Writers: keyed merges, partitioned tables, feed tables.

Plain Parquet has no MERGE. A merge reads the partitions that receive updates, merges
them and replaces just their files. New files are written aside; a journal then names the files
that come and those that go, and is the commit: whatever stops behind it is finished by the next
reader or writer, and whatever stops before it leaves the table as it was. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.scans import insert_new, last_snapshots, upsert
from wayfold.operators.windows import cut

JOURNAL = "_journal.json"
STAGED = "_staged-"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Folder:
    """Files of a table's folder through the file system that holds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path, spark._jvm
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def files(self, under: str = "") -> list[str]:
        """Data files below a folder of the table, relative to it."""
        root = self.fs.makeQualified(self.at(under)).toString().rstrip("/") + "/"
        out, it = [], self.fs.listFiles(self.at(under), True)
        while it.hasNext():
            name = it.next().getPath().toString()[len(root):]
            if not any(x.startswith(("_", ".")) for x in name.split("/")):
                out.append(name)
        return out

    def folders(self) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.at("")) if x.isDirectory()]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A file that is there as a whole or not at all."""
        aside = self.at(f"_{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.move(aside, self.at(name))

    def move(self, source, target) -> None:
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(source, target):
            raise OSError(f"could not rename {source} to {target}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that was stopped behind its journal, and drop what was staged without one. Can be repeated."""
    folder = Folder(spark, path)
    if not folder.exists():
        return
    if folder.exists(JOURNAL):
        plan = json.loads(folder.read(JOURNAL))
        for name in plan["come"]:           # a file that is not staged any more has arrived
            if folder.exists(f"{plan['staged']}/{name}"):
                folder.move(folder.at(f"{plan['staged']}/{name}"), folder.at(name))
        for name in plan["go"]:
            folder.remove(name)
        left = {x.rsplit("/", 1)[0] for x in folder.files()}
        for place in {x.rsplit("/", 1)[0] for x in plan["go"] if "/" in x} - left:      # a partition that holds nothing now
            folder.remove(place)
        folder.remove(JOURNAL)
    for name in folder.folders():
        if name.startswith(STAGED):
            folder.remove(name)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table as its last commit left it."""
    recover(spark, path)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def replace_files(df: DataFrame, path: str, by: list[str], go: list[str]) -> None:
    """Put the rows of ``df`` in the place of the named files, both or neither."""
    spark = df.sparkSession
    staged = f"{STAGED}{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(f"{path}/{staged}")
    folder = Folder(spark, path)
    folder.write(JOURNAL, json.dumps({"staged": staged, "come": folder.files(staged), "go": go}))
    recover(spark, path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def write_months(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Table partitioned by year_month; rows of one month are spread over tasks by AQE's rebalance."""
    out = df.withColumn("year_month", F.substring(F.col(ts).cast("string"), 1, 7))
    overwrite_partitions(out.hint("rebalance", "year_month"), path, ["year_month"])


def write_tracks(df: DataFrame, path: str) -> None:
    """Track table: partitioned by day, sorted by (flight_id, ts) inside files so that statistics prune."""
    out = df.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / 86400).cast("int")))
    overwrite_partitions(out.hint("rebalance", "date").sortWithinPartitions("date", "flight_id", "ts"), path, ["date"])


def merge_table(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: list[str], by: str) -> None:
    """Keyed upsert into a partitioned table.

    Partitions of the updates, and those that hold an updated key now, are read and written again; of other partitions
    only the key columns are read. A partition that a move leaves empty goes. A driver lost at any point leaves the old table or,
    once ``read_table`` or the next merge has looked, the new one. Rows without a value of ``by``, or
    with an empty text, share the null partition.
    """
    if dict(updates.dtypes)[by] == "string":
        updates = updates.withColumn(by, F.nullif(by, F.lit("")))
    recover(spark, path)
    if not exists(spark, path):
        return replace_files(upsert(updates.limit(0), updates, keys, order), path, [by], [])
    stored = spark.read.schema(updates.schema).parquet(path)
    held = stored.select(*keys, by).join(updates.select(*keys).distinct(), keys, "left_semi").select(by)
    hit = cut(updates.select(by).unionByName(held).distinct())
    read = stored.join(hit.select(F.col(by).alias("_by")), F.col(by).eqNullSafe(F.col("_by")), "left_semi")
    new = upsert(read.select(updates.columns), updates, keys, order)
    replace_files(new, path, [by], files_of(read, path))


def files_of(rows: DataFrame, path: str) -> list[str]:
    """The table's files that hold these rows: their names alone reach the driver."""
    named = [unquote(r[0]).split("/") for r in rows.select("_metadata.file_path").distinct().collect()]
    files = Folder(rows.sparkSession, path).files()
    held = {n: {"/".join(x[-n:]) for x in named} for n in {x.count("/") + 1 for x in files}}
    return [x for x in files if x in held[x.count("/") + 1]]


def insert_table(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], by: str) -> None:
    """Insert rows whose key is not stored; duplicates are ignored."""
    recover(spark, path)
    if exists(spark, path):
        rows = insert_new(spark.read.schema(rows.schema).parquet(path).select(rows.columns), rows, keys)
    else:
        rows = rows.dropDuplicates(keys)
    cut(rows).write.mode("append").partitionBy(by).parquet(path)


def keep_snapshots(spark: SparkSession, path: str, keep: int = 3, ts: str = "ts") -> None:
    stored = read_table(spark, path)
    replace_files(last_snapshots(stored, keep, ts), path, [], Folder(spark, path).files())


def copy_tables(spark: SparkSession, tables: dict[str, str], target: str) -> None:
    """Copy Parquet tables to another store unchanged."""
    for name, path in tables.items():
        spark.read.parquet(path).write.mode("overwrite").parquet(f"{target}/{name}")
