"""Line dedup: a line that stands in several documents stays in one of them.

1. Each task takes the different keys of each document's lines and sends their 64-bit hashes, each once a run of
   documents and marked if two documents of the run have it, to the owner of the hash's cell.
2. An owner holds two Bloom filters for its cells: hashes seen once, and hashes seen twice. A hash that arrives marked,
   or that the first filter knows already, enters the second one. Filters grow with the number of lines: 16 bits a
   line, in cells of 4 KB that a hash stays within, dealt over the tasks.
3. A line whose hash the second filter doesn't know stands in one document only and is done. The others are suspects:
   they alone are shuffled, grouped by their bytes, and settled exactly. Of a key found with two doc_ids, the smallest
   keeps its lines.
4. Documents that lose lines meet their list of lost keys (by SHA-256) and are put together again; the others, picked
   by a bitmap over doc_ids, never leave their task.

The second filter is broadcast while it takes at most BROADCAST_BYTES, which is some 17 million lines; beyond that
lines meet their cell in a shuffle join. A key that a third of all documents hold is one hash a run in step 2, one
row a task in step 3 after partial aggregation, and in the join with its keeper the hot side of an equi-join with
unique keys on the other side, which adaptive execution splits. Tables are written to the shared folder between the
steps, so a lost executor costs its tasks only.

Defined results: a null or empty text is one empty line; keys shorter than least_chars never count; all rows with one
doc_id are one document, for each of which a row is returned; a null doc_id is a document of its own that comes after
all others; two equal lines of the keeper both stay; an empty table gives no rows; a very long text is read as a
whole by one task, and so is a very long line; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import prefilter
from tidelog.llm.common import discard, materialize

LEAST_CHARS = 10
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Bits of the filters for each line, and the places that a hash takes in its cell.
LINE_BITS = 16
PLACES = 3
CELL_BITS = 1 << 15
#: Cells at least, so that small inputs are dealt evenly too.
LEAST_CELLS = 1023
#: Hashes that a task holds before it sends them.
RUN_LINES = 500_000
#: Lines, and bytes of them, that a task returns at a time.
RUN_ROWS = 10_000
RUN_BYTES = 4 << 20
BROADCAST_BYTES = 32 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()  # of bytes, lower() changes A-Z alone


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def text_keys(text: str | None, least: int = LEAST_CHARS) -> set[bytes]:
    """The different keys of a text's lines that count."""
    return {key for key in map(line_key, (text or "").encode().split(b"\n")) if _long_enough(key, least)}


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def short_hash(sha: bytes) -> int:
    """The 64 bits that the filters see."""
    return int.from_bytes(sha[:8], "big", signed=True)


def places(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash in its cell, a row a hash."""
    return np.stack([(hashes >> (15 * k)) & (CELL_BITS - 1) for k in range(PLACES)], axis=1)


def sent_hashes(docs: DataFrame, cells: int, least: int) -> DataFrame:
    """Step 1: (cell, hash, many), each hash once a run."""

    def packed(held: list[int]) -> pa.RecordBatch:
        found, counts = np.unique(np.array(held, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.mod(found, cells)), pa.array(found), pa.array(counts > 1)], ["cell", "hash", "many"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for batch in batches:
            for text in batch.column(0):
                held += [short_hash(digest(key)) for key in text_keys(text.as_py(), least)]
                if len(held) >= RUN_LINES:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return docs.select("text").mapInArrow(runs, "cell bigint, hash bigint, many boolean")


def twice_seen(sent: DataFrame) -> DataFrame:
    """Step 2: (cell, bits): the second filter, 512 long integers a cell; cells without a bit are left out.

    A cell holds some 2,000 lines, so a task's cells take a byte a bit for as long as it runs, 32 bytes a line in all.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cells, hashes, many = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            found, first, back, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            marked = counts > 1
            marked[back[many.astype(bool)]] = True
            order = np.argsort(cells[first], kind="stable")
            ids, starts = np.unique(cells[first][order], return_index=True)
            bits, marked = places(found[order]), marked[order]
            for cell, start, stop in zip(ids.tolist(), starts, [*starts[1:], len(order)], strict=True):
                if cell not in filters:
                    filters[cell] = np.zeros(CELL_BITS, bool), np.zeros(CELL_BITS, bool)
                once, twice = filters[cell]
                at = bits[start:stop]
                twice[at[marked[start:stop] | once[at].all(axis=1)]] = True
                once[at] = True
        for cell, (_, twice) in filters.items():
            if twice.any():
                longs = np.packbits(twice, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([longs], pa.list_(pa.int64()))], ["cell", "bits"])

    return sent.repartition("cell").mapInArrow(own, "cell bigint, bits array<bigint>")


def document_keys(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, hash, key): the different keys of each document that count."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "hash", "key"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for key in text_keys(text.as_py(), least):
                    held.append((doc_id.as_py(), short_hash(digest(key)), key))
                    size += len(key)
                    if len(held) >= RUN_ROWS or size >= RUN_BYTES:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(keys, "doc_id bigint, hash bigint, key binary")


def suspects(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Steps 1 to 3: (doc_id, key) of the lines that may stand in several documents, as a table."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    cells = max(LEAST_CELLS, -(-lines * LINE_BITS // CELL_BITS)) | 1  # odd, so that the cell depends on all bits of a hash
    seen = materialize(twice_seen(sent_hashes(docs, cells, least)))
    side = seen.withColumnRenamed("cell", "at")
    if seen.count() * CELL_BITS // 8 <= BROADCAST_BYTES:
        side = F.broadcast(side)
    place = [F.call_function("shiftright", F.col("hash"), F.lit(15 * k)).bitwiseAND(F.lit(CELL_BITS - 1)) for k in range(PLACES)]
    known = [F.getbit(F.get("bits", F.call_function("shiftright", p, F.lit(6)).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in place]
    keys = document_keys(docs, least).join(side, F.pmod("hash", F.lit(cells)) == F.col("at"))
    found = materialize(keys.where(known[0] & known[1] & known[2]).select("doc_id", "key"))
    discard(seen)
    return found


def lost_keys(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, lost): the SHA-256 of each key whose lines a document loses; documents that lose none have no row. A table."""
    found = suspects(docs, least)
    ids = [F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"), F.max(F.isnull("doc_id")).alias("nameless")]
    sha = F.unhex(F.sha2("key", 256))
    repeated = found.groupBy("key").agg(*ids).where("keep <> last or (nameless and keep is not null)").select(sha.alias("sha"), "keep")
    gone = found.select("doc_id", sha.alias("sha")).join(repeated, "sha").where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    lost = materialize(gone.groupBy("doc_id").agg(F.collect_set("sha").alias("lost")))
    discard(found)
    return lost


def drop_repeated_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (the lines that stay, joined by \\n) of every row of docs."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, n, text, lost in zip(*(batch.column(k) for k in range(4)), strict=True):
                gone = set(lost.as_py() or ())
                lines = text.as_py().encode().split(b"\n")
                kept = [line for line in lines if digest(line_key(line)) not in gone] if gone else lines
                columns = [pa.array([doc_id.as_py()], pa.int64()), pa.array([n.as_py()], pa.int64()), pa.array([len(lines) - len(kept)], pa.int64()), pa.array([b"\n".join(kept).decode()])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "text"])

    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    lost = lost_keys(docs, least)
    count = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("bigint")
    seen = prefilter.marked(docs.select("doc_id", count.alias("n_lines"), "text"), prefilter.cells(lost, F.xxhash64("doc_id")), F.xxhash64("doc_id"))
    whole = seen.where(~F.col("__hit")).select("doc_id", "n_lines", F.lit(0).cast("bigint").alias("n_dropped"), "text")
    side = lost.withColumnRenamed("doc_id", "of")
    asked = seen.where("__hit").join(side, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "n_lines", "text", "lost")
    return whole.unionByName(asked.mapInArrow(rest, "doc_id bigint, n_lines bigint, n_dropped bigint, text string"))
