"""Readers and writers of file snapshots, reports and scrubbed text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rows import exploded, materialised
from ..functions.scalars import type_name
from ..operators.text import MAX_LINE, not_blank


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content, size, mtime of whole files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def read_lines(spark: SparkSession, path: str, glob: str | None = None, max_line: int = MAX_LINE, keep_blank: bool = False) -> DataFrame:
    """path, line_number and line of text files of any size, read by parts: the rows of to_lines(read_files(...)).

    Spark deals a file's parts to tasks and cuts each at line ends. The rows of a part are numbered as they are read,
    which a part that is read again repeats; the counts of the parts before it raise them. The first line of max_line
    bytes or more of a file stops it. What is joined is a row for each part, and one for each file that is stopped.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    source = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"))
    rows = reader.text(path).select(source.alias("s"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r\\z", "").alias("line")).select("s.*", "at", "line")
    size = F.octet_length("line")
    parts = materialised(rows.groupBy("path", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.when(size >= max_line, F.col("at"))).alias("long")), "parts")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("part")) - F.col("n") - F.col("first") + 1
    placed = parts.select("path", "part", before.alias("raise"), "long")
    stops = placed.groupBy("path").agg(F.min(F.col("long") + F.col("raise")).alias("stop"))
    known = materialised(placed.join(stops, "path").select("path", "part", "raise", "stop"), "placed-parts")
    numbered = rows.join(known, ["path", "part"]).withColumn("line_number", F.col("at") + F.col("raise")).where(F.col("stop").isNull() | (F.col("line_number") < F.col("stop")))
    lines = numbered.select("path", F.col("line_number").cast("long").alias("line_number"), "line")
    return lines if keep_blank else lines.where(not_blank(F.col("line")))


def only_files(snapshot: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a stored snapshot (Parquet or ORC files) whose host_id and path are wanted.

    First only names are read, to learn which data files hold wanted rows; content is then read from these files alone.
    Their list is no longer than Spark's own of the snapshot.
    """
    spark, names = snapshot.sparkSession, ["host_id", "path"]
    held = snapshot.select(*names, F.col("_metadata.file_path").alias("__file")).join(wanted, names, "left_semi")
    data_files = [r[0] for r in held.select("__file").distinct().toLocalIterator()]
    if not data_files:
        return snapshot.limit(0)
    kind = "orc" if data_files[0].endswith(".orc") else "parquet"
    return spark.read.schema(snapshot.schema).format(kind).load(data_files).join(wanted, names, "left_semi")


def report_json(findings: DataFrame) -> DataFrame:
    """host_id and json of each finding; empty paths, locations and metadata are left out."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    fields = F.struct(
        F.col("finding_id").alias("id"), "type", type_name(F.col("type")).alias("type_name"), "fingerprint", "probe", "severity", "title", "message", F.nullif(F.col("path"), F.lit("")).alias("path"),
        (some("locations") if "locations" in findings.columns else F.lit(None).cast("array<string>")).alias("locations"), some("metadata").alias("metadata"),
    )
    return findings.select("host_id", F.to_json(fields, {"ignoreNullFields": "true"}).alias("json"))


def write_report_json(findings: DataFrame, path: str, buckets: int = 256) -> None:
    """One JSON line for each finding (host_id, json), in a folder for each of some buckets of hosts, so that a fleet of millions makes no file for each."""
    rows = report_json(findings).select(F.pmod(F.xxhash64("host_id"), F.lit(buckets)).cast("int").alias("bucket"), F.to_json(F.struct("host_id", F.col("json"))).alias("value"))
    rows.write.partitionBy("bucket").text(path)


#: Names below a folder that Spark's readers pass over.
_COMMITS, _STAGED, _RETIRED = "_commits", ".staged-", ".retired-"


def write_back(spark: SparkSession, folder: str, scrubbed: Callable[[DataFrame], DataFrame], text: str = "content") -> int:
    """Put scrubbed texts in their rows' places in a stored snapshot (a folder of Parquet files without partitions); how many data files were rewritten.

    scrubbed: takes the snapshot and gives the rows that may change, with their columns and one more, scrubbed, such as
    plans.workflows.scrub. Only data files that hold a row whose text differs are written anew, all their rows with all
    columns; the others aren't touched, and a rerun finds nothing to do. Rows are told apart by data file and place in
    it, so repeated rows do no harm.

    Every rewritten data file is replaced by files of its own. These are staged under hidden names, then a note of what
    replaces what is written, and only then are files renamed. recover() carries out a note that a lost driver left;
    each write_back begins with it.
    """
    recover(spark, folder)
    snapshot = spark.read.parquet(folder)
    known = snapshot.columns
    placed = snapshot.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    rows = scrubbed(placed)
    changed = exploded(rows, F.when(F.col("scrubbed") != F.col(text), F.array("scrubbed")), "__new")
    changes = materialised(changed.select("__file", "__row", F.col("__new").alias("scrubbed")), "changes")
    touched = [r[0] for r in changes.select("__file").distinct().toLocalIterator()]  # no more than the folder has files
    if not touched:
        return 0
    run = uuid.uuid4().hex
    number = {f: i for i, f in enumerate(sorted(touched))}
    numbers = spark.createDataFrame(list(number.items()), "__file string, __source int")
    old = spark.read.schema(snapshot.schema).parquet(*touched).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    # Rows and changes are dealt by data file, once, and meet in the order that the files are written in.
    both = old.unionByName(changes.withColumn("__change", F.lit(True)), allowMissingColumns=True).join(F.broadcast(numbers), "__file").drop("__file").repartition("__source")
    place = Window.partitionBy("__source", "__row")
    new = both.withColumn("scrubbed", F.max("scrubbed").over(place)).where(F.col("__change").isNull()).withColumn(text, F.coalesce("scrubbed", text))
    staged = f"{folder.rstrip('/')}/{_COMMITS}/{run}"
    new.sortWithinPartitions("__source", "__row").select("__source", *known).write.partitionBy("__source").parquet(f"{staged}/data")
    moves = []
    fs, path = _store(spark, folder)
    for file, i in number.items():
        parts = sorted(x.getPath().toString() for x in fs.listStatus(path(f"{staged}/data/__source={i}")) if x.getPath().getName().endswith(".parquet"))
        moves.append((file, [(p, f"part-{run}-{i:05d}-{k:05d}.parquet") for k, p in enumerate(parts)]))
    _note(fs, path, f"{staged}/note", moves)
    recover(spark, folder)
    return len(touched)


def recover(spark: SparkSession, folder: str) -> None:
    """Carry out what notes of write_back say and hasn't been done. Each step may be done again."""
    fs, path = _store(spark, folder)
    root = folder.rstrip("/")
    if not fs.exists(path(f"{root}/{_COMMITS}")):
        return
    for run in fs.listStatus(path(f"{root}/{_COMMITS}")):
        at = run.getPath().toString()
        if fs.exists(path(f"{at}/note")):
            for old, parts in _noted(spark, f"{at}/note"):
                for part, name in parts:  # first all new files, hidden
                    if fs.exists(path(part)):
                        fs.rename(path(part), path(f"{root}/{_STAGED}{name}"))
                if fs.exists(path(old)):  # then the old one is hidden, and the new ones shown
                    fs.rename(path(old), path(f"{at}/{_RETIRED}{path(old).getName()}"))
                for _, name in parts:
                    if fs.exists(path(f"{root}/{_STAGED}{name}")):
                        fs.rename(path(f"{root}/{_STAGED}{name}"), path(f"{root}/{name}"))
        fs.delete(path(at), True)


def _store(spark: SparkSession, folder: str):
    """The folder's file system and its path type."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _note(fs, path, name: str, moves: list) -> None:
    """Written under another name and renamed, so a note is whole or absent."""
    import json

    out = fs.create(path(f"{name}-new"), True)
    out.write(json.dumps(moves).encode())
    out.close()
    fs.rename(path(f"{name}-new"), path(name))


def _noted(spark: SparkSession, name: str) -> list:
    import json

    return json.loads("\n".join(r.value for r in spark.read.text(name, wholetext=True).collect()))
