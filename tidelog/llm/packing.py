"""Mixture-controlled packing: deficit round-robin over source queues fills every sequence to target proportions.

Each source is a queue of its documents' tokens (ids and an end id). A sequence is one round: every queue's deficit
grows by its share of the sequence, the queue serves the whole tokens of its deficit, and the tokens that are still
free go to the largest deficits; what a queue is owed is carried to the next sequence. Documents are cut wherever a
sequence ends. The carried deficits have a closed form (what is due minus what is served, see
:meth:`Schedule.served`), so a task that starts at any sequence knows the deficits that it inherits and no task
waits for another. Without targets the shares are the sources' own shares of all tokens, so that all queues last to
the end and every sequence but the last is full of the same mixture. With targets, a queue that runs dry leaves its
share to the others in proportion.

A queue's order is by bucket of a hash and then doc_id; positions are sums per (queue, bucket) and a running sum in
each, so a hot source is spread over all its buckets. Sources whose share is under SMALL of the tokens and that have no
target share a queue; so there are at most 1 / SMALL + 1 queues besides those of the targets, and the schedule is small,
whatever the input. The shared queue is a second level of deficit round-robin, over any number of sources: its next
document is the one that is due first by its source's share (see :func:`take_turns`), so that each part of the queue
holds its sources in proportion, but for a document of each. Token ids are written to the shared folder once and
shuffled once, those of the shared queue twice.

Defined results: a null text is empty and packs as its end id alone; a null source is a source of its own; repeated
rows are packed each; a null doc_id passes through; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import textkit
from tidelog.llm.common import frugal, materialize

LENGTH = 2048
#: The least share of the tokens with which a source has a queue of its own; a queue gets 2 tokens a sequence or more.
SMALL = 1 / 512
#: How many numbers of the schedule are worked out at once.
CELLS = 1 << 22
BUCKET_ROWS, MAX_BUCKETS = 256, 1 << 16
CACHE_WORDS = 400_000
#: Bytes of text that are encoded together; a longer text is encoded by itself.
BATCH_BYTES = 1 << 22

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue int"
#: Words of texts with separators (U+001C to U+001F), which Arrow takes for white space and the tokenizer doesn't.
_WORDS = regex.compile(r"[^\s]+")
#: Letters that every rule for lower case and composition treats alike, and the signs that may follow them.
_SIGNS = ("", ".", ",", ";", ":", "!", "?")
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿŒœ]+[.,;:!?]?$"
_LETTERS = re.compile("[a-zß-öø-ÿœ]+")
_TOKENIZERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts with a tokenizer for which white space only separates, so that a text's ids are its words' ids.

    A batch's words are split and numbered by Arrow, and so are their stems: the letters of a word of plain letters and
    at most one sign, in lower case, or any other word as it is. Python sees each stem of a batch once; the texts' ids
    are gathered from theirs in numpy. Stems recur between batches, too, so each worker keeps the ids of those it has
    met, up to CACHE_WORDS. New ones are normalised and split by the tokenizer's own rules into pieces; new pieces go
    through the tokenizer's model in one call, and an id that ends a word tells where a piece's ids end.
    """

    def __init__(self, text: str):
        from tokenizers import Tokenizer, pre_tokenizers

        made = json.loads(text)
        self.normalizer = Tokenizer.from_str(text).normalizer
        # Pieces come normalised and split, so all that is left to do before the model is to map their bytes.
        self.tokenizer = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "added_tokens": []}))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pattern = Tokenizer.from_str(json.dumps(made | {"pre_tokenizer": made["pre_tokenizer"]["pretokenizers"][0]})).pre_tokenizer
        self.suffix = made["model"]["end_of_word_suffix"]
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(self.suffix)]] = True
        self.small = len(self.ends) <= 1 << 16
        self.kind = np.dtype("<u2" if self.small else "<u4")
        self.words: dict[str, bytes] = {"": b""}
        self._learn(list(_SIGNS[1:]))
        self.signs = dict(self.words)

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Keeps the ids of pieces, each of which the tokenizer takes as one; a piece is a word, too."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, self.kind)
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        if len(stops) != len(pieces):
            raise ValueError("the tokenizer doesn't take words apart as its pattern does")
        data = ids.tobytes()
        self.words.update((p, data[a:b]) for p, a, b in zip(pieces, [0, *stops], stops, strict=False))

    def _learn(self, words: list[str]) -> None:
        known = self.words
        # Plain letters are one piece; the tokenizer's own rules take the other words apart.
        plain, odd = [], []
        for w in words:
            (plain if _LETTERS.fullmatch(w) else odd).append(w)
        if plain:
            self._learn_pieces(plain)
        if odd:
            shown = self.normalizer.normalize_str(" ".join(odd)).split(" ")
            split = [[p for p, _ in self.pattern.pre_tokenize_str(w)] for w in shown]
            new = list({p for pieces in split for p in pieces if p not in known})
            if new:
                self._learn_pieces(new)
            known.update((w, b"".join([known[p] for p in pieces])) for w, pieces in zip(odd, split, strict=True))

    def _stems(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Words as numbered stems and the place in _SIGNS of the sign after each.

        A plain word's stem is its letters in lower case; any other word is its own stem, without a sign.
        """
        plain = pc.match_substring_regex(words, _PLAIN)
        stems = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, "".join(_SIGNS))), words).dictionary_encode()
        raw, at = textkit.text_bytes(words)
        last = np.zeros(len(words), np.uint8)
        last[at[1:] > at[:-1]] = raw[at[1:][at[1:] > at[:-1]] - 1]
        tails = np.zeros(256, np.int64)
        tails[[ord(sign) for sign in _SIGNS[1:]]] = np.arange(1, len(_SIGNS))
        return stems, np.where(plain.to_numpy(zero_copy_only=False), tails[last], 0)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each with the end id after it, and where each text's ids begin and end."""
        texts = texts.fill_null("")
        if pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():
            split = pa.array([_WORDS.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        if len(self.words) > CACHE_WORDS:
            self.words = {"": b""}
        stems, tails = self._stems(coded.dictionary)
        known = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, known))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k in range(0, len(new), 20_000):
            self._learn([known[i] for i in new[k : k + 20_000]])
        for k in new:
            found[k] = self.words[known[k]]
        # Parts: the stems, the signs after them, and the end id.
        found += [self.signs[sign] for sign in _SIGNS] + [self.kind.type(end_id).tobytes()]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        begin, ids = np.cumsum(size) - size, np.frombuffer(b"".join(found), self.kind)
        words = coded.indices.to_numpy()
        parts = np.stack((stems.indices.to_numpy()[words], tails[words] + len(known)), axis=1).reshape(-1)
        stops = 2 * np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        parts = np.insert(parts.astype(np.int64), stops, len(found) - 1)
        counts = size[parts]
        at = np.concatenate(([0], np.cumsum(counts)))
        out = ids[np.repeat(begin[parts] - at[:-1], counts) + np.arange(at[-1])]
        return out, np.concatenate(([0], at[stops + np.arange(1, len(stops) + 1)]))


def encoder(text: str) -> WordEncoder:
    """The encoder of a tokenizer's JSON, built once a process."""
    if text not in _TOKENIZERS:
        _TOKENIZERS[text] = WordEncoder(text)
    return _TOKENIZERS[text]


def tokenize(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """(doc_id, source, n, ids): ids are 16-bit little-endian numbers while they fit, else 32-bit."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(shared.value)
        for batch in batches:
            _, offsets = textkit.text_bytes(batch.column(2))
            for a, b in textkit.chunks(offsets, BATCH_BYTES):
                ids, at = words.encode(batch.column(2).slice(a, b - a), end_id)
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at * ids.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array(np.diff(at)), coded.cast(pa.binary())], ["doc_id", "source", "n", "ids"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n bigint, ids binary")


class Schedule:
    """How many tokens each queue has served before each sequence.

    totals: the tokens of each queue; weights: their target proportions.
    """

    def __init__(self, totals: list[int], weights: list[float], length: int = LENGTH):
        self.totals, self.length = np.array(totals, dtype=np.int64), length
        self.total = int(self.totals.sum())
        left, at = self.totals.astype(float), 0.0
        at_points, due_points = [0.0], [np.zeros(len(totals))]
        share = np.array(weights, dtype=float)
        while (left > 0).any():
            rate = np.where(left > 0, share, 0.0)
            if rate.sum() <= 0:
                rate = np.where(left > 0, left, 0.0)
            rate = rate / rate.sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                lasts = np.where(rate > 0, left / rate, np.inf)
            step = float(lasts.min())
            dry = lasts <= step * (1 + 1e-12)
            at += step
            left = np.where(dry, 0.0, left - rate * step)
            at_points.append(at)
            due_points.append(np.where(left <= 0, self.totals, self.totals - left))
        self.at, self.due = np.array(at_points), np.array(due_points)
        self.dry_at = np.array([self.at[np.argmax(self.due[:, q] >= self.totals[q])] for q in range(len(totals))])

    def served(self, sequences: np.ndarray) -> np.ndarray:
        """A row for each sequence: the tokens that each queue has served before it.

        A queue has served what is due to it, rounded down; the rest of what all have served goes to the queues with
        the largest deficits. The sum is sequence * length, until the end.
        """
        tokens = np.minimum(sequences * self.length, self.total)
        due = np.stack([np.interp(tokens, self.at, self.due[:, q]) for q in range(len(self.totals))], axis=1)
        done = (tokens[:, None] >= self.dry_at) | (tokens[:, None] >= self.total)
        whole = np.where(done, self.totals, np.minimum(np.floor(due), self.totals)).astype(np.int64)
        deficit = np.where(whole >= self.totals, -1.0, due - whole)
        owed = tokens - whole.sum(axis=1)
        place = np.empty_like(whole)
        np.put_along_axis(place, np.argsort(-deficit, axis=1, kind="stable"), np.arange(len(self.totals))[None, :], axis=1)
        return whole + (place < owed[:, None])

    def around(self, queue: int, first: int, last: int) -> np.ndarray:
        """Sequences that surely include those which hold the queue's tokens first to last."""
        begin, end = (np.interp(t, self.due[:, queue], self.at) for t in (max(0, first - 3), min(int(self.totals[queue]), last + 3)))
        return np.arange(max(0, int(begin // self.length) - 1), int(end // self.length) + 3)

    def cut(self, queue: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cuts documents that follow each other in a queue: (document, start in it, length, sequence, offset)."""
        first, last = int(starts[0]), int(starts[-1] + sizes[-1])
        sequences = self.around(queue, first, last)
        if len(sequences) * len(self.totals) > CELLS and len(starts) > 1:
            half = len(starts) // 2
            (doc, *left), (later, *right) = self.cut(queue, starts[:half], sizes[:half]), self.cut(queue, starts[half:], sizes[half:])
            return tuple(map(np.concatenate, zip((doc, *left), (later + half, *right), strict=True)))
        served = self.served(sequences)
        bounds = served[:, queue]
        cuts = np.unique(np.concatenate((starts, [last], bounds[(bounds > first) & (bounds < last)])))
        at, ends = cuts[:-1], cuts[1:]
        doc = np.searchsorted(starts, at, side="right") - 1
        k = np.searchsorted(bounds, at, side="right") - 1
        before = (served[k + 1, :queue] - served[k, :queue]).sum(axis=1)
        return doc, at - starts[doc], ends - at, sequences[k], before + at - bounds[k]


def queues(tokens: DataFrame, targets: dict[str, float] | None = None, length: int = LENGTH) -> tuple[list, Schedule | None]:
    """The sources with a queue of their own, largest first (the rest share the last queue), and the schedule."""
    sums = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0]
    if not total:
        return [], None
    named = F.lit(False)
    if targets:
        named = F.coalesce(F.col("source").isin([s for s in targets if s is not None]), F.lit(None in targets))
    large = sums.where((F.col("n") >= total * SMALL) | named).orderBy(F.desc("n"), "source").limit(int(1 / SMALL) + 1 + len(targets or {})).collect()
    names, counts = [r["source"] for r in large], [r["n"] for r in large]
    rest = total - sum(counts)
    weights = [float((targets or {}).get(s, 0)) if targets else float(n) for s, n in zip(names, counts, strict=True)]
    if rest:
        if counts and not targets and rest < total * SMALL / 2:
            names, counts[-1], weights[-1] = names[:-1], counts[-1] + rest, weights[-1] + rest
        else:
            counts, weights = [*counts, rest], [*weights, 0.0 if targets else float(rest)]
    return names, Schedule(counts, weights, length)


def take_turns(mixed: DataFrame, buckets: int) -> DataFrame:
    """The rows of the shared queue, each with the bucket of the share of its source that is due with it, and this share.

    A document is due when half of it is: the part of its source's tokens that come before its middle.
    """
    rows = mixed.withColumn("turn", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    sums = rows.groupBy("turn", "bucket").agg(F.sum("n").alias("sum"))
    source = Window.partitionBy("turn")
    before = sums.select("turn", "bucket", (F.sum("sum").over(source.orderBy("bucket")) - F.col("sum")).alias("before"), F.sum("sum").over(source).alias("total"))
    running = F.sum("n").over(Window.partitionBy("turn", "bucket").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.join(before, ["turn", "bucket"]).withColumn("due", (F.col("before") + running - F.col("n") / 2) / F.col("total"))
    return placed.withColumn("bucket", F.least(F.floor(F.col("due") * buckets), F.lit(buckets - 1)).cast("int"))


def pack(docs: DataFrame, path: str, end_id: int = 1, targets: dict[str, float] | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece of a document in a sequence; columns as in PIECES."""
    tokens = materialize(tokenize(docs, path, end_id))
    names, schedule = queues(tokens, targets, length)
    if schedule is None:
        return docs.sparkSession.createDataFrame([], PIECES)
    buckets = int(min(MAX_BUCKETS, max(1, tokens.count() // BUCKET_ROWS)))
    wide = 2 if tokens.where("n > 0").select(F.octet_length("ids") / F.col("n")).first()[0] == 2 else 4
    rest = len(names)
    queue = F.coalesce(*(F.when(F.col("source").eqNullSafe(F.lit(s)), i) for i, s in enumerate(names)), F.lit(rest)) if names else F.lit(0)
    rows = tokens.select("doc_id", "source", "n", "ids", queue.alias("queue"), F.pmod(F.xxhash64("doc_id", "n"), F.lit(buckets)).cast("int").alias("bucket"))
    placed, turns = rows.drop("source"), []
    if len(schedule.totals) > rest:
        turns = ["due", "turn"]
        mixed = take_turns(rows.where(F.col("queue") == rest), buckets)
        own = placed.where(F.col("queue") < rest).withColumns({"due": F.lit(0.0), "turn": F.lit("")})
        placed = own.unionByName(mixed.select(*own.columns))
    sums = placed.groupBy("queue", "bucket").agg(F.sum("n").alias("sum"))
    before = sums.select("queue", "bucket", (F.sum("sum").over(Window.partitionBy("queue").orderBy("bucket")) - F.col("sum")).alias("before"))
    order = Window.partitionBy("queue", "bucket").orderBy(*turns, "doc_id", "n")
    running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ready = placed.join(before, ["queue", "bucket"]).select("doc_id", "queue", (F.col("before") + running).alias("at"), "n", "ids")
    shared = docs.sparkSession.sparkContext.broadcast(schedule)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            queue, at, n = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
            fresh = np.ones(rows, bool)
            fresh[1:] = (queue[1:] != queue[:-1]) | (at[1:] != at[:-1] + n[:-1])
            edges = [*np.flatnonzero(fresh).tolist(), rows]
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                doc, *others = plan.cut(int(queue[a]), at[a:b], n[a:b])
                out.append((doc + a, *others))
            doc, start, size, sequence, offset = (np.concatenate(x) for x in zip(*out, strict=True))
            ids, codes, held = batch.column(4), [], (-1, None)
            for d, s, m in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True):
                if d != held[0]:
                    held = d, np.frombuffer(ids[d].as_py(), "<u2" if wide == 2 else "<u4").astype("<u4")
                codes.append(crc32(held[1][s : s + m]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(codes, pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(offset), pa.array(queue[doc].astype(np.int32))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

    return ready.mapInArrow(run, PIECES)
