"""Row identities, the shared folder, and decisions that return to the partition they concern.

A row is known by a number that holds its partition and its place there (``monotonically_increasing_id``). Over a
scan of files these are the same each time that the scan runs, so a decision about some rows can be written to the
shared folder, filed by partition, and read by the very task that scans these rows again: a filter of that kind
shuffles no text and broadcasts nothing, however many rows it concerns. Each decision carries a mark, the hash of the
text it was made on; should the scan be split otherwise the second time, the marks differ and the job fails, rather
than let wrong rows through.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_BITS = 33
#: Partitions of one folder of the shared tables.
PER_FOLDER_BITS = 3
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_STABLE = {"Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation", "Union", "SubqueryAlias"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="assaykit-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/assaykit-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return f"{path}/{name}"


def _remove(path: str) -> None:
    try:
        system, at = fs.FileSystem.from_uri(path)
        system.delete_dir(at)
    except (OSError, ValueError):
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read from there."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session was told to hand texts to Python in batches of BATCH_BYTES, unless it was told a size
    already: cut by rows alone, a batch of long texts would be as large as they are together, in the executor and in each
    of its workers. The setting holds for a session and not for a query; it changes no result."""
    if _BATCH not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores as make it unlike every column of df."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def stable(df: DataFrame, name: str = "input") -> DataFrame:
    """df if it scans files or rows at hand, in the same partitions each time; else its copy in the shared folder."""
    plan = df._jdf.queryExecution().optimizedPlan()

    def plain(node) -> bool:
        below = node.children()
        return node.nodeName().split(" ")[0] in _STABLE and all(plain(below.apply(i)) for i in range(below.size()))

    return df if plan.deterministic() and plain(plan) else materialise(df, name)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def mark(text_col: str):
    """What a decision carries of the text it was made on."""
    return F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("mark")


def partition_of(row: str):
    return F.shiftright(F.col(row), ROW_BITS)


def file_by_partition(df: DataFrame, name: str, row: str = "row", local: bool = False, shared: int = PER_FOLDER_BITS, scan: DataFrame | None = None) -> str:
    """Write df to the shared folder, filed by the partition that its column of row numbers tells. local: df's
    partitions are still those of the scan, so no shuffle is needed to have few files. shared: 2 ** shared partitions
    share a folder, 0 where much is filed for each; then scan, whose partitions these are, gives each folder a task."""
    path = shared_path(df.sparkSession, name)
    df = df.withColumn("folder", F.shiftright(F.col(row), ROW_BITS + shared))
    if scan is not None:
        n = (max(1, scan._jdf.queryExecution().toRdd().getNumPartitions()) - 1 >> shared) + 1
        df = df.repartitionById(n, F.pmod("folder", F.lit(n)).cast("int"))
    elif not local:
        df = df.repartition("folder")
    df.write.partitionBy("folder").parquet(path)
    return path


def read_own(path: str, partition: int, columns: list[str], row: str = "row", shared: int = PER_FOLDER_BITS) -> pa.Table:
    """On an executor: what was filed for one partition. Empty if nothing was."""
    system, at = fs.FileSystem.from_uri(f"{path}/folder={partition >> shared}")
    if system.get_file_info(at).type != fs.FileType.Directory:
        return pa.table({c: [] for c in columns})
    low, high = partition << ROW_BITS, (partition + 1) << ROW_BITS
    return ds.dataset(at, filesystem=system, format="parquet").to_table(columns, filter=(ds.field(row) >= low) & (ds.field(row) < high))


def filter_rows(docs: DataFrame, decided: DataFrame, keep: bool, text_col: str = "text") -> DataFrame:
    """The rows of docs, a stable scan, that decided names (keep), or all others. decided has the columns row and mark. The
    filter runs in the scan's own tasks; the text is not shuffled."""
    path = file_by_partition(decided.select("row", "mark"), "decided")
    row, seen = fresh(docs, "row"), fresh(docs, "mark")
    marked = small_batches(docs).select("*", F.monotonically_increasing_id().alias(row), mark(text_col).alias(seen))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = marks = None
        met = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            *columns, rows, now = batch.columns
            rows, now = rows.to_numpy(), now.to_numpy()
            if named is None:
                table = read_own(path, int(rows[0]) >> ROW_BITS, ["row", "mark"]).sort_by("row")
                named, marks = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "mark"))
            at = np.searchsorted(named, rows)
            found = (at < len(named)) & (np.take(named, at, mode="clip") == rows if len(named) else False)
            met += int(found.sum())
            if (marks[at[found]] != now[found]).any():
                raise RuntimeError("the scan changed between its passes: a decision meets another text")
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2]).filter(pa.array(found if keep else ~found))
        if named is not None and met != len(named):
            raise RuntimeError(f"the scan changed between its passes: {len(named)} rows were decided on, {met} are here")

    return marked.mapInArrow(own, docs.schema)
