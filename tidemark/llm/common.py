"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The contract's white space: blank and U+0009 to U+000D, as a Java/Python/RE2 character class.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of files up to this size (16 bytes a file) are broadcast; beyond it the planner chooses.
MOST_FILES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where it is unset, a local session takes a temporary folder;
    a cluster, whose executors would each write to their own disk, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that this process wrote and hasn't removed.
_written: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clear() removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def frozen(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def discard(*frames: DataFrame) -> None:
    """Remove what frozen() wrote for ``frames``, when all that was made from them is written too."""
    for df in frames:
        _remove(df.sparkSession, df._folder)


def clear(spark: SparkSession) -> None:
    """Remove all that the operators of this process wrote to the shared folder, once their results have been used."""
    for path in list(_written):
        _remove(spark, path)


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def words_of(text: Column) -> Column:
    """Array of the text's words; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a read of files with at most columns chosen and rows filtered, by expressions that give the same on each read."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View") and node.deterministic():
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def _file_key(path: Column) -> Column:
    """Tells files apart in a join, if all differ; else their paths do."""
    return F.xxhash64(path)


def _files(docs: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]] | None:
    """(key, first) of the files of ``docs``, written, and the key as a function of the path: files are sorted by part number and path, and a file's
    first row has the number of rows of all files before it.  None if rows can't be told by file and place.  Spark reads a row count
    per file; the running sum passes over a table of files."""
    try:
        own = docs.select(docs.metadataColumn("_metadata").alias("m")).select("m.file_path", "m.row_index")
    except AnalysisException:
        return None
    files = own.groupBy("file_path").agg((F.max("row_index") + 1).alias("rows"))
    part = F.try_to_number(F.regexp_extract("file_path", r"/part-(\d{1,18})[^/]*$", 1), F.lit("9" * 18))
    before = Window.orderBy(part, "file_path").rowsBetween(Window.unboundedPreceding, -1)
    files = frozen(files.select("file_path", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")), "files")
    count, keys = files.agg(F.count("*"), F.count_distinct(_file_key(F.col("file_path")))).first()
    key = _file_key if count == keys else lambda path: path
    files = files.select(key(F.col("file_path")).alias("_key"), F.col("first").alias("_first"))
    return F.broadcast(files) if count <= MOST_FILES else files, key


def numbered(docs: DataFrame) -> DataFrame:
    """(_row, doc): the rows of ``docs`` as structs, with a number each, which tells repeated rows apart.

    A row's number is its place in the table, whose files are taken in the order of their part numbers and paths.  It doesn't depend on how a read splits files, which
    changes with the number of executors.  Tables that aren't reads of Parquet files are written to the shared folder first."""
    found = _files(docs) if _is_scan(docs) else None
    if found is None:
        docs = frozen(docs, "table")
        found = _files(docs)
    files, key = found
    m = docs.metadataColumn("_metadata")
    own = docs.select(key(m["file_path"]).alias("_key"), m["row_index"].alias("_at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return own.join(files, "_key").select((F.col("_first") + F.col("_at")).alias("_row"), "doc")


def id_order(doc_id: Column, row: Column) -> Column:
    """Orders rows by doc_id, null last, and repeated ids by row number."""
    return F.struct(doc_id.isNull().alias("no"), doc_id.alias("id"), row.alias("row"))


def labelled(docs: DataFrame, labels: DataFrame, most: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, label), written: ``docs`` with ``labels`` (_id, label), at most ``most`` rows, those with the least hashes of (id, text).
    Labels are bounded first; equal rows count once, and an id on many documents doesn't make the sample larger."""
    picked = frozen(labels.orderBy(F.xxhash64("_id"), "_id", "label").limit(most), "picked")
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(picked, "_id")
    own = frozen(own.withColumn("_h", F.xxhash64("_id", "text")).dropDuplicates(["_h", "_id", "label"]), "labelled")
    order = ["_h", "_id", "label"]
    last = own.select(*order).orderBy(*order).limit(most).orderBy(*[F.desc(c) for c in order]).first()
    if last:  # the rows up to that one, where they are: no task gathers them
        h, i, v = (F.col(c) for c in order)
        own_rows = own.where((h < last[0]) | (h == last[0]) & ((i < F.lit(last[1])) | (i == F.lit(last[1])) & (v <= last[2])))
    else:
        own_rows = own
    out = frozen(own_rows.select(F.col("_id").alias("doc_id"), "text", "label"), "sample")
    discard(picked, own)
    return out
