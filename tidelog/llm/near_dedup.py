"""MinHash near-dedup with sequential Bayesian verification.

Texts with equal shingle sets form a class first, so any number of copies is one representative from there on. The
representatives' signatures are cut into bands. In each bucket of a band the member with the smallest id is the hub,
and every other member is paired with it: a bucket of n gives n - 1 pairs. A pair's signatures are compared batch by
batch; after each batch it is dropped if the posterior probability that its similarity reaches the threshold, given
the matches so far, is below MISS. What survives is verified on the full shingle sets of the whole texts.

A hub may differ from members that are alike among themselves. So once the components of the verified links are
known, the buckets whose members fall into different components are taken up again. Such buckets are joined into
clusters where they share members. In a cluster, all members outside its main component are compared with all
members, in blocks of BLOCK by BLOCK: signatures batch by batch, then the full sets, and only for members that
aren't connected by then. A block answers with the links that connect something new, fewer than it has members,
never with its pairs. After that every two members of a bucket are in one component or have been compared; nothing
is capped, and a cluster of any size is spread over its blocks.

With ROWS rows in each of BANDS bands, a pair at the threshold of 0.8 shares no bucket with probability
(1 - 0.8**6)**40 = 5e-6, and a pair further above it less.

Defined results: a text without words has no shingles, is linked with nothing and is its own component; a null
doc_id is linked with nothing (its component is null, it is kept); rows that repeat a doc_id are one node, so they
share a component; an empty table gives no rows; further columns are ignored by :func:`near_groups` and kept by
:func:`drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import prefilter, textkit
from tidelog.llm.common import discard, frugal, materialize
from tidelog.llm.components import components

BANDS, ROWS = 40, 6
#: Words of a shingle, unless a contract says otherwise.
WORDS = 5
#: Signature places that are compared before each decision.
BATCH = 24
#: Members on each side of a comparison within a cluster.
BLOCK = 128
#: Bytes of texts that are verified together; one pair of texts may be more.
CONFIRM_BYTES = 1 << 22
#: The probability, given the matches so far, under which a pair is dropped.
MISS = 1e-6

SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary"


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20260101).integers(0, 1 << 32, (2, n), dtype=np.uint64).astype(np.uint32)
    return made[0] | np.uint32(1), made[1]


def signatures(docs: DataFrame, width: int, hashes: int = BANDS * ROWS) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set and the signature (16 bits a place) of every row."""

    @frugal
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _multipliers(hashes)
        for batch in batches:
            raw, offsets = textkit.text_bytes(batch.column(1))
            for a, b in textkit.chunks(offsets):
                words, word_at = textkit.word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                all_shingles, all_at = textkit.shingle_hashes(words, word_at, width)
                shingles, at = textkit.distinct_in_groups(all_shingles, all_at)
                counts = np.diff(at)
                some = np.flatnonzero(counts)
                least = np.zeros((hashes, b - a), dtype=np.uint32)
                sets = np.zeros((2, b - a), dtype=np.uint64)
                if len(some):
                    starts, small = at[:-1][some], (shingles >> np.uint64(32)).astype(np.uint32)
                    work = np.empty_like(small)
                    for k in range(hashes):
                        np.multiply(small, times[k], out=work)
                        np.add(work, plus[k], out=work)
                        least[k, some] = np.minimum.reduceat(work, starts)
                    sets[0, some] = np.add.reduceat(shingles, starts)
                    sets[1, some] = np.add.reduceat(textkit.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), starts)
                packed = np.ascontiguousarray(least.T.astype(np.uint16))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(counts),
                        pa.array(sets[0].view(np.int64)),
                        pa.array(sets[1].view(np.int64)),
                        pa.array([row.tobytes() for row in packed], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, SIGNED)


def buckets(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(bucket, rep) for every band of every class."""
    key = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * (2 * rows) + 1, F.lit(2 * rows))))
    return classes.select("rep", F.explode(key).alias("bucket"))


def least_matches(hashes: int, threshold: float, miss: float, batch: int = BATCH) -> list[tuple[int, int]]:
    """(places compared, fewest matches to go on) after each batch.

    With a uniform prior, P(similarity >= t | m of n places match) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def likely(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float = MISS, hashes: int = BANDS * ROWS) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures doesn't rule out."""
    steps = least_matches(hashes, threshold, miss)

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, hashes) for k in (2, 3))
            alive, matches, done = np.arange(len(one)), np.zeros(len(one), np.int64), 0
            for n, fewest in steps:
                matches[alive] += (one[alive, done:n] == two[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= fewest], n
            yield batch.select([0, 1]).take(pa.array(alive))

    sides = [classes.select(F.col("rep").alias(k), F.col("signature").alias(f"sig_{k}")) for k in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose full shingle sets meet 100 * shared >= percent * united."""
    ends = pairs.select(F.col("a").alias("end")).union(pairs.select(F.col("b").alias("end")))
    wanted = prefilter.cells(ends, F.xxhash64("end"))
    texts = prefilter.marked(docs.select("doc_id", "text").where("doc_id is not null"), wanted, F.xxhash64("doc_id")).where("__hit").select("doc_id", "text")

    @frugal
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.add(*(np.diff(textkit.text_bytes(batch.column(k))[1]) for k in (2, 3)))
            for first, last in textkit.chunks(np.concatenate(([0], np.cumsum(sizes))), CONFIRM_BYTES):
                part = batch.slice(first, last - first)
                both = pa.concat_arrays([part.column(2), part.column(3)]).dictionary_encode()
                found, at = textkit.distinct_in_groups(*textkit.exact_shingles(both.dictionary, width))
                sets = [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                keep = []
                for a, b in both.indices.to_numpy().reshape(2, -1).T.tolist():
                    shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a bigint, b bigint")


def linked_in_blocks(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between members (rep, cluster, comp) of a cluster that connect different components."""
    counted = members.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    blocks = sizes.select("cluster", "main", F.ceil(F.col("all") / block).alias("n_all"), F.ceil((F.col("all") - F.col("most")) / block).alias("n_ask")).where("n_ask > 0")
    wanted = prefilter.cells(members.select("rep"), F.xxhash64("rep"))
    texts = prefilter.marked(docs.select("doc_id", "text").where("doc_id is not null"), wanted, F.xxhash64("doc_id")).where("__hit").select(F.col("doc_id").alias("rep"), "text")
    full = members.join(blocks, "cluster").join(classes.select("rep", "signature"), "rep").join(texts, "rep")
    own = F.pmod(F.xxhash64("rep", "cluster"), F.col("n_all")).alias("all_block")
    asks = F.pmod(F.xxhash64("cluster", "rep"), F.col("n_ask")).alias("ask_block")
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    right = full.select("cluster", F.explode(every("n_ask")).alias("ask_block"), own, F.lit(False).alias("asks"), "rep", "comp", "signature", "text")
    left = full.where("comp <> main").select("cluster", asks, F.explode(every("n_all")).alias("all_block"), F.lit(True).alias("asks"), "rep", "comp", "signature", "text")
    steps, hashes = least_matches(BANDS * ROWS, percent / 100, MISS), BANDS * ROWS

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asking = np.flatnonzero(group["asks"].to_numpy(zero_copy_only=False))
        asked = np.flatnonzero(~group["asks"].to_numpy(zero_copy_only=False))
        reps, comps = group["rep"].to_numpy(), group["comp"].to_numpy()
        signed = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint16).reshape(-1, hashes)
        column = group["text"].chunk(0) if group["text"].num_chunks else pa.array([], pa.string())
        found, at = textkit.distinct_in_groups(*textkit.exact_shingles(column, width))
        values, ids = np.unique(found, return_inverse=True)
        counts, mark = np.diff(at), np.zeros(len(values), dtype=np.int64)
        names, root = np.unique(comps, return_inverse=True)
        out: list[tuple[int, int]] = []
        for u in asking:
            alive, matches, done = asked[root[asked] != root[u]], None, 0
            matches = np.zeros(len(alive), dtype=np.int64)
            for n, fewest in steps:
                matches += (signed[alive, done:n] == signed[u, done:n]).sum(axis=1)
                stay = matches >= fewest
                alive, matches, done = alive[stay], matches[stay], n
                if not len(alive):
                    break
            if not len(alive):
                continue
            own = ids[at[u] : at[u + 1]]
            mark[own] = 1
            size = counts[alive]
            spread = np.repeat(at[:-1][alive] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            shared = np.add.reduceat(mark[ids[spread]], np.cumsum(size) - size)
            mark[own] = 0
            for v in alive[100 * shared >= percent * (counts[u] + size - shared)]:
                if root[v] != root[u]:
                    out.append((min(reps[u], reps[v]), max(reps[u], reps[v])))
                    root[root == root[v]] = root[u]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return left.unionByName(right).groupBy("cluster", "ask_block", "all_block").applyInArrow(link, "a bigint, b bigint")


def near_groups(docs: DataFrame, width: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    signed = materialize(signatures(docs, width))
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))

    banded = buckets(classes)
    hubs = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = materialize(banded.join(hubs.select("bucket", "hub"), "bucket"))

    def links(pairs: DataFrame) -> DataFrame:
        survivors = materialize(likely(pairs.distinct(), classes, percent / 100))
        found = materialize(verified(survivors, docs, width, percent).distinct())
        discard(survivors)
        return found

    first = links(shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    labels = components(first)

    def labelled(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.join(labels.select(F.col("node").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    split = labelled(labelled(shared, "rep", "comp"), "hub", "hub_comp")
    open_buckets = split.groupBy("bucket").agg(F.count("*").alias("members"), F.max(F.col("comp") != F.col("hub_comp")).alias("open")).where("open and members > 2").select("bucket")
    stars = materialize(shared.where("rep <> hub").join(open_buckets, "bucket", "left_semi").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    clusters = components(stars).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    second = materialize(linked_in_blocks(labelled(clusters, "rep", "comp"), classes, docs, width, percent).distinct())
    discard(shared, stars)
    final = components(first.union(second)) if second.limit(1).count() else labels

    nodes = classes.select("set_a", "set_b", "rep").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    places = nodes.select("set_a", "set_b", F.coalesce("component", "rep").alias("component"), F.lit(True).alias("found"))
    rows = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(places, ["set_a", "set_b"], "left")
    own = F.when(F.col("found") & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one for each component, with their columns. Five words, 0.8."""
    gone = near_groups(docs).where(~F.col("kept")).select(F.col("doc_id").cast("string").alias("gone"))
    return prefilter.remove(docs, gone, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
