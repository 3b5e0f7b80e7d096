"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each task sorts the distinct 64-bit fingerprints of its rows, deals them to owners by range, and sends one
   Golomb-Rice coded list to each owner. A fingerprint goes to an owner once a task, however many rows have it.
2. An owner decodes its lists and answers each with a bitmap: which of these fingerprints did another task send too?
3. The task's list and the bitmap give its suspects: fingerprints with two rows in the task, or marked by the owner.
4. Suspect rows are shuffled by their whole normalised text, so equality is decided on bytes. Which rows to shuffle
   is looked up in a bitmap over hashed fingerprints of fixed size, which is all that is broadcast; a row that it
   lets through by chance forms a group of one and does no harm.

A group of any size is one row a task after partial aggregation, and the last join is a plain equi-join with unique
keys on one side, whose hot keys adaptive execution splits. The lists are written to the shared folder first, so a
lost executor costs a task, not the exchange.

Defined results: a null text is empty; all empty texts are equal to each other; rows that repeat both doc_id and
text are copies of each other and all carry the same keep_id (each is kept = (doc_id = keep_id), so
:func:`drop_copies` drops the repeats); a null doc_id is kept only if all its copies have none; an empty table gives
no rows; further columns are ignored by :func:`copies` and kept by :func:`drop_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import golomb, prefilter
from tidelog.llm.common import SPACES, frugal, materialize, shuffle_partitions

#: Rows of a task that are coded together; bounds a task's memory.
RUN_ROWS = 1_000_000
#: Fingerprints that an owner gets at most, about; bounds an owner's memory.
OWNER_ROWS = 4_000_000

LISTS = "run string, owner int, count bigint, rice int, codes binary, repeated binary"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def fingerprint(text: Column) -> Column:
    return F.xxhash64(normalised(text))


def coded_lists(prints: DataFrame, owners: int) -> DataFrame:
    """Step 1: from rows (print) to one row per run and owner."""
    width = (1 << 64) // owners + 1

    def code(name: str, values: np.ndarray) -> pa.RecordBatch:
        found, counts = np.unique(values, return_counts=True)
        edges = np.searchsorted(found, np.array([k * width for k in range(owners)] , dtype=np.uint64)).tolist() + [len(found)]
        rows: list[tuple] = []
        for owner in range(owners):
            a, b = edges[owner], edges[owner + 1]
            if a < b:
                rice = golomb.rice_bits(b - a, width)
                codes = golomb.encode(found[a:b] - np.uint64(owner * width), rice)
                rows.append((name, owner, b - a, rice, codes, np.packbits(counts[a:b] > 1).tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["run", "owner", "count", "rice", "codes", "repeated"])

    @frugal
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size, k = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(held[-1])
            if size >= RUN_ROWS:
                yield code(f"{task}-{k}", np.concatenate(held))
                held, size, k = [], 0, k + 1
        if size:
            yield code(f"{task}-{k}", np.concatenate(held))

    return prints.mapInArrow(runs, LISTS)


def answers(lists: DataFrame) -> DataFrame:
    """Step 2: (run, owner, shared): a bit for each fingerprint of a list that another run sent as well."""

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        sent = [golomb.decode(r["codes"], r["count"], r["rice"]) for r in rows]
        found, counts = np.unique(np.concatenate(sent), return_counts=True)
        shared = found[counts > 1]
        bits = [np.packbits(np.isin(s, shared, assume_unique=True)).tobytes() for s in sent]
        return pa.table({"run": group["run"], "owner": group["owner"], "shared": pa.array(bits, pa.binary())})

    return lists.select("run", "owner", "count", "rice", "codes").groupBy("owner").applyInArrow(answer, "run string, owner int, shared binary")


def suspects(lists: DataFrame, owners: int) -> DataFrame:
    """Step 3: (print) of the rows whose fingerprint may occur twice."""
    width = (1 << 64) // owners + 1

    @frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["count"]
                marks = (np.frombuffer(r["repeated"], np.uint8) | np.frombuffer(r["shared"], np.uint8))
                sent = golomb.decode(r["codes"], n, r["rice"])[np.unpackbits(marks, count=n).astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array((sent + np.uint64(r["owner"] * width)).view(np.int64))], ["print"])

    return lists.join(answers(lists), ["run", "owner"]).select("owner", "count", "rice", "codes", "repeated", "shared").mapInArrow(read, "print bigint")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (lowercase hex) of every row of docs."""
    spark = docs.sparkSession
    owners = max(shuffle_partitions(spark), -(-docs.count() // OWNER_ROWS))
    lists = materialize(coded_lists(docs.select(fingerprint(F.col("text")).alias("print")), owners))
    cells = prefilter.cells(suspects(lists, owners), F.col("print"))
    rows = docs.select("doc_id", "text", fingerprint(F.col("text")).alias("print"))
    shuffled = prefilter.marked(rows, cells, F.col("print")).where("__hit").select("doc_id", normalised(F.col("text")).alias("normal"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("less"), "doc_id"))
    groups = (
        shuffled.groupBy("normal")
        .agg(F.count("*").alias("group_size"), best.alias("best"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2(F.col("normal").cast("binary"), 256)).alias("sha"), F.col("best.doc_id").alias("keep"), "group_size", F.lit(True).alias("grouped"))
    )
    every = docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("sha"))
    return every.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("grouped"), F.col("keep")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(F.col("grouped"), F.col("doc_id").eqNullSafe(F.col("keep"))).otherwise(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each different text, with their columns."""
    found = copies(docs)
    name = lambda sha: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), sha)
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    gone = found.where(~F.col("kept")).select(name(F.col("text_sha256")).alias("gone"))
    again = found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1")
    return prefilter.remove(docs, gone, name(sha), again.select(name(F.col("text_sha256")).alias("again")))
