"""N-gram Jaccard join: MinHash banding, shuffle on band hashes, verification on full n-gram sets.

Two documents are linked if the sets of their runs of five words have a Jaccard similarity of 0.8 or more.  A document of
fewer words has one shingle, all of them.

Edge cases: null, empty and blank texts have no shingles, link to nothing, and are classes of their own; equal
sets are one class, counted in n_copies and expanded into no pairs; repeated rows are copies; ids may be null (they sort last)
or repeated; texts of any length are read whole, and blocks of a comparison are cut by shingles as well as by members; other columns, whatever
their names, aren't read, and drop_near_copies returns them as they were; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frozen, id_order, numbered
from tidemark.llm.minhash import near_duplicates


def _joined(own: DataFrame, **how) -> DataFrame:
    found = near_duplicates(own.select("_row", F.coalesce("text", F.lit("")).alias("text")), **how)
    rows = own.select("_row", "doc_id").join(found, "_row", "left")
    rows = rows.select("_row", "doc_id", F.coalesce("root", "_row").alias("root"), *[F.coalesce(c, F.lit(v)).cast("long").alias(a) for c, v, a in (("copies", 1, "n_copies"), ("n_links", 0, "n_links"), ("n_linked", 0, "n_linked_docs"))])
    first = rows.groupBy("root").agg(F.min(id_order(F.col("doc_id"), F.col("_row"))).alias("first"), F.count("*").alias("class_size"))
    out = rows.join(frozen(first, "class-firsts"), "root")  # written, so that a partition with a large class can be split
    return out.select("_row", "doc_id", F.col("first.id").alias("class_id"), "class_size", (F.col("_row") == F.col("first.row")).alias("kept"), "n_copies", "n_links", "n_linked_docs")


def ngram_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One row per row of ``docs``: _row, doc_id, class_id (least doc_id of the component), class_size, kept (the class's first
    row), n_copies (documents with this set, itself included), n_links (other sets linked to), n_linked_docs (documents that
    have these sets)."""
    return _joined(numbered(docs).select("_row", F.col("doc")[doc_id].alias("doc_id"), F.col("doc")[text].alias("text")), **how)


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """One document of each class, the one with the least doc_id, with all columns."""
    rows = numbered(docs)
    gone = _joined(rows.select("_row", F.col("doc")[doc_id].alias("doc_id"), F.col("doc")[text].alias("text")), **how).where("not kept").select("_row")
    return rows.join(frozen(gone, "gone"), "_row", "left_anti").select("doc.*")
