"""Language-model scoring by a hierarchical Pitman-Yor model over words.

Every word is a context with a restaurant of its own: the customers are the words that follow it, and each table
sends one customer to the restaurant that all contexts share as their parent. The parent's base is uniform over the
training vocabulary and one unknown word.
Seatings are sampled by Gibbs: in a pass all customers of each word leave and are seated anew, by a draw of the number
of their tables given all other words (see :mod:`tidelog.llm.seating`). After BURN rounds, the predictive probabilities of SAMPLES rounds are averaged, and a text's score is the sum of their
logarithms.

Words are 64-bit hashes, and everything is spread by word. A context's totals are held by the owner of its word: owners
send it the sums of their own pairs and get back the sums of all, for the contexts they have pairs in (see
:func:`context_sums`). So no task and no broadcast holds all contexts.

1. Each task numbers the words of its run of documents (at most RUN_TOKENS tokens, or one document) and stores the
   run's tokens, and apart from them its words. It sends each word's training count to the word's owner (owners have
   ranges of hashes), once a run, however often the word occurs; the owner adds up and answers. A word's number is its
   place in the order of all. The words themselves aren't needed any more then.
2. The run sends its distinct (context, word) pairs with counts to the word's owner. A pair or word that makes up a
   third of the corpus is one number a run.
3. Owners note where each run's pairs are among their own, which takes the place of the question. They
   hold the seatings of their words in all contexts and in the parent. In a round each owner makes PASSES
   Gibbs passes, with the other owners' totals as they were after the last round.
4. Owners answer each run with the probabilities of its pairs, and the run adds them up by document.

Defined results: a null or empty text is one end token; a null doc_id is in training; repeated rows are scored (and
counted) each; without training text the score is that of the uniform base; an empty table gives no rows; further
columns are ignored. Seeds are fixed by owner and round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textkit
from tidelog.llm.common import discard, materialize, materialize_kinds, shuffle_partitions
from tidelog.llm.seating import draw_tables

RUN_TOKENS = 2_000_000
#: Tokens whose pairs an owner has on average at most, and at least where there are more shuffle partitions than that;
#: between the two, each partition has an owner.
OWNER_TOKENS, LEAST_TOKENS = 4_000_000, 500_000
BURN, SAMPLES, PASSES = 2, 3, 2
STRENGTH = 1.0
END = np.uint64(0x0123456789ABCDEF)

#: A run is a row of each kind. ending: the place of the end token in its vocabulary.
RUN_KINDS = {"tokens": ["run", "size", "docs", "doc_null", "held", "sizes", "tokens", "ending"], "words": ["run", "vocabulary", "counts"]}
RUNS = "kind string, run string, size bigint, docs binary, doc_null binary, held binary, sizes binary, tokens binary, ending bigint, vocabulary binary, counts binary"


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes: first the lowest byte of each, then the next one, as high bytes are mostly 0."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in text.split(","))])


def store_runs(docs: DataFrame) -> DataFrame:
    """Step 1: documents as runs of numbered tokens (kind tokens), and the runs' words and training counts (kind words)."""
    schema = _schema(RUNS)

    def number(name: str, ids: list, nulls: list, held: list, words: list, sizes: list) -> pa.RecordBatch:
        size = np.concatenate(sizes)
        hashes = np.full(int(size.sum()), END, dtype=np.uint64)
        inner = np.ones(len(hashes), dtype=bool)
        inner[np.cumsum(size) - 1] = False
        hashes[inner] = np.concatenate(words)
        vocabulary, tokens = np.unique(hashes, return_inverse=True)
        out = np.concatenate(held)
        counts = np.bincount(tokens[~np.repeat(out, size)], minlength=len(vocabulary))
        row = {
            "kind": "tokens", "run": name, "size": len(tokens), "docs": pack(np.concatenate(ids)), "doc_null": pack(np.concatenate(nulls)), "held": pack(out),
            "sizes": pack(size.astype(np.int64)), "tokens": pack(tokens.astype(np.int32)), "ending": int(np.searchsorted(vocabulary, END)),
        }
        return _batch([row, {"kind": "words", "run": name, "vocabulary": pack(vocabulary), "counts": pack(counts.astype(np.int64))}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, total, held_back = TaskContext.get().partitionId(), 0, 0, [[], [], [], [], []]
        for batch in batches:
            raw, offsets = textkit.text_bytes(batch.column(2))
            for a, b in textkit.chunks(offsets):
                words, at = textkit.word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = batch.column(0).slice(a, b - a)
                parts = (ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool), words, np.diff(at) + 1)
                for store, part in zip(held_back, parts, strict=True):
                    store.append(part)
                total += len(words) + b - a
                if total >= RUN_TOKENS:
                    yield number(f"{task}-{k}", *held_back)
                    k, total, held_back = k + 1, 0, [[], [], [], [], []]
        if total:
            yield number(f"{task}-{k}", *held_back)

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text").mapInArrow(run, RUNS)


def _edges(vocabulary: np.ndarray, owners: int) -> list[int]:
    """Where each owner's range begins in an ascending vocabulary, and its end."""
    width = (1 << 64) // owners + 1
    return [*np.searchsorted(vocabulary, np.array([k * width for k in range(owners)], dtype=np.uint64)).tolist(), len(vocabulary)]


def ask_counts(vocabularies: DataFrame, owners: int) -> DataFrame:
    """(owner, run, words, counts): each run's words and training counts, dealt to their owners."""
    spec = "owner int,run string,words binary,counts binary"
    schema = _schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = unpack(r["vocabulary"], "u8"), unpack(r["counts"], "i8")
                edges = _edges(words, owners)
                yield _batch([{"owner": k, "run": r["run"], "words": pack(words[a:b]), "counts": pack(counts[a:b])} for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b], schema)

    return vocabularies.select("run", "vocabulary", "counts").mapInArrow(run, spec)


def answer_counts(asked: DataFrame) -> DataFrame:
    """Rows with run null: an owner's sums. Other rows: where a run's words are among the owner's, and their counts."""
    spec = "owner int,run string,counts binary,places binary,n bigint,v bigint,size bigint"
    schema = _schema(spec)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        sent = [unpack(r["words"], "u8") for r in rows]
        words, places = np.unique(np.concatenate(sent), return_inverse=True)
        counts = np.zeros(len(words), dtype=np.int64)
        np.add.at(counts, places, np.concatenate([unpack(r["counts"], "i8") for r in rows]))
        owner = rows[0]["owner"]
        out = [{"owner": owner, "run": None, "counts": b"", "places": b"", "n": int(counts.sum()), "v": int((counts > 0).sum()), "size": len(words)}]
        ends = np.cumsum([len(s) for s in sent]).tolist()
        for r, a, b in zip(rows, [0, *ends], ends, strict=False):
            at = places[a:b]
            out.append({"owner": owner, "run": r["run"], "counts": pack(counts[at]), "places": pack(np.diff(at, prepend=0).astype(np.int32)), "n": 0, "v": 0, "size": 0})
        return pa.Table.from_pylist(out, schema=schema)

    return asked.groupBy("owner").applyInArrow(run, spec)


def numbering(answers: DataFrame, owners: int) -> np.ndarray:
    """The number of each owner's first word, and the number of all words."""
    sizes = np.zeros(owners, dtype=np.int64)
    for owner, size in answers.where("run is null").select("owner", "size").collect():
        sizes[owner] = size
    return np.concatenate(([0], np.cumsum(sizes)))


def _joined(answers: list[dict], name: str, kind: str) -> np.ndarray:
    """A run's answers from all owners, in the order of its vocabulary."""
    return np.concatenate([unpack(a[name], kind) for a in sorted(answers, key=lambda a: a["owner"])])


def _gathered(rows: DataFrame, *names: str) -> DataFrame:
    """(run, answers): a run's answers together; they are as many as its own words and pairs."""
    return rows.groupBy("run").agg(F.collect_list(F.struct("owner", *names)).alias("answers"))


def _pairs(tokens: np.ndarray, sizes: np.ndarray, ending: int, words: int) -> np.ndarray:
    """Each token's key: word * words + context, both as places in the run's vocabulary of so many words."""
    context = np.empty(len(tokens), dtype=np.int64)
    context[1:] = tokens[:-1]
    context[np.cumsum(sizes) - sizes] = ending
    return tokens.astype(np.int64) * words + context


def _gaps(context: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Ascending numbers of each word as the first one and the steps from one to the next."""
    gaps = np.diff(context, prepend=0)
    first = (np.cumsum(per) - per)[per > 0]
    gaps[first] = context[first]
    return gaps


def _from_gaps(gaps: np.ndarray, per: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(gaps)))
    return sums[1:] - np.repeat(sums[np.cumsum(per) - per], per)


def ask_pairs(runs: DataFrame, answers: DataFrame, starts) -> DataFrame:
    """Step 2: each run's pairs to the owners of their words. per: pairs a word; context, count: a pair's."""
    spec = "owner int,run string,places binary,per binary,context binary,count binary"
    schema = _schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tokens, sizes = unpack(r["tokens"], "i4"), unpack(r["sizes"], "i8")
                trained = ~np.repeat(unpack(r["held"], "?"), sizes)
                places = {a["owner"]: a["places"] for a in sorted(r["answers"], key=lambda a: a["owner"])}
                parts = [starts.value[k] + np.cumsum(unpack(blob, "i4"), dtype=np.int64) for k, blob in places.items()]
                numbers = np.concatenate(parts)
                pairs, which = np.unique(_pairs(tokens, sizes, r["ending"], len(numbers)), return_inverse=True)
                counts = np.bincount(which[trained], minlength=len(pairs))
                del which, tokens, trained
                word, context = np.divmod(pairs, len(numbers))
                per = np.bincount(word, minlength=len(numbers))
                edges = np.cumsum([0, *map(len, parts)]).tolist()
                pair_at = np.concatenate(([0], np.cumsum(per)))
                context = numbers[context]
                out = []
                for (k, blob), a, b in zip(places.items(), edges[:-1], edges[1:], strict=True):
                    own = slice(pair_at[a], pair_at[b])
                    out.append({"owner": k, "run": r["run"], "places": blob, "per": pack(per[a:b].astype(np.int32)), "context": pack(_gaps(context[own], per[a:b])), "count": pack(counts[own].astype(np.int32))})
                yield _batch(out, schema)

    found = _gathered(answers.where("run is not null"), "places")
    return runs.select("run", "held", "sizes", "ending", "tokens").join(found, "run").select("run", "held", "sizes", "ending", "tokens", "answers").mapInArrow(run, spec)


def _asked_keys(row: dict, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A run's word places at an owner and its pair keys there: place * words + context, words being their number."""
    place, per = np.cumsum(unpack(row["places"], "i4"), dtype=np.int64), unpack(row["per"], "i4")
    return place, np.repeat(place, per) * words + _from_gaps(unpack(row["context"], "i8"), per)


STATE = "owner int,places bigint,keys binary,counts binary,tables binary,root_tables binary,samples binary,context binary,context_tables binary,context_customers binary,root_customers bigint,root_seats bigint,ones bigint,twos bigint"


def _state(owner: int, keys: np.ndarray, counts: np.ndarray, places: int, numbers: np.ndarray, which: np.ndarray, tables: np.ndarray, root_tables: np.ndarray, samples: bytes) -> dict:
    """numbers: the contexts of the owner's pairs, ascending; which: each pair's place among them."""
    sums = [np.bincount(which, weights=w, minlength=len(numbers)).astype(np.int64) for w in (tables, counts)]
    return {
        "owner": owner, "places": places, "keys": pack(np.diff(keys, prepend=0)), "counts": pack(counts), "tables": pack(tables.astype(np.int32)),
        "root_tables": pack(root_tables.astype(np.int32)), "samples": samples, "context": pack(np.diff(numbers, prepend=0)), "context_tables": pack(sums[0]), "context_customers": pack(sums[1]),
        "root_customers": int(tables.sum()), "root_seats": int(root_tables.sum()), "ones": int((counts == 1).sum()), "twos": int((counts == 2).sum()),
    }


def _root_of(word: np.ndarray, tables: np.ndarray, places: int) -> np.ndarray:
    return np.bincount(word, weights=tables, minlength=places).astype(np.int64)


FIRST = f"kind string,{STATE},run string,found binary"
FIRST_KINDS = {"state": [c.split()[0] for c in STATE.split(",")], "found": ["owner", "run", "found"]}


def first_state(asks: DataFrame, words: int) -> DataFrame:
    """Step 3, before any round: an owner's pairs and a first seating, one table a dish (kind state).

    Rows of kind found: where a run's pairs are among the owner's, as the first place and the steps from one to the next.
    """
    schema = _schema(FIRST)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        found = [_asked_keys(r, words) for r in rows]
        places, ends = 1 + max(int(p.max()) for p, _ in found), np.cumsum([len(k) for _, k in found]).tolist()
        keys, which = np.unique(np.concatenate([k for _, k in found]), return_inverse=True)
        del found
        counts = np.bincount(which, weights=np.concatenate([unpack(r["count"], "i4") for r in rows]), minlength=len(keys)).astype(np.int64)
        owner = rows[0]["owner"]
        out = [{"kind": "found", "owner": owner, "run": r["run"], "found": pack(np.diff(which[a:b], prepend=0).astype(np.int32))} for r, a, b in zip(rows, [0, *ends], ends, strict=False)]
        tables = np.minimum(counts, 1)
        word, context = np.divmod(keys, words)
        root_tables = np.minimum(_root_of(word, tables, places), 1)
        numbers, which = np.unique(context, return_inverse=True)
        out.append({"kind": "state", **_state(owner, keys, counts, places, numbers, which, tables, root_tables, b"")})
        return pa.Table.from_pylist(out, schema=schema)

    return asks.groupBy("owner").applyInArrow(run, FIRST)


def context_sums(states: DataFrame, starts, name: str) -> DataFrame:
    """(owner, name_sums): for each owner's contexts in order, what all owners' `name` of them add up to.

    Each part of an owner's contexts goes to the owner that holds their words, which adds up and answers.
    """
    spec = "holder int,owner int,context binary,value binary"
    schema = _schema(spec)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                numbers, values = np.cumsum(unpack(r["context"], "i8")), unpack(r[name], "i8")
                edges = np.searchsorted(numbers, starts.value).tolist()
                yield _batch([{"holder": k, "owner": r["owner"], "context": pack(np.diff(numbers[a:b] - starts.value[k], prepend=0)), "value": pack(values[a:b])} for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b], schema)

    answer = "owner int,holder int,value binary"
    answered = _schema(answer)

    def add(group: pa.Table) -> pa.Table:
        holder = group.column("holder")[0].as_py()
        sums = np.zeros(int(starts.value[holder + 1] - starts.value[holder]), dtype=np.int64)
        rows = group.select(["owner", "context", "value"]).to_pylist()
        for r in rows:
            sums[np.cumsum(unpack(r["context"], "i8"))] += unpack(r["value"], "i8")
        return pa.Table.from_pylist([{"owner": r["owner"], "holder": holder, "value": pack(sums[np.cumsum(unpack(r["context"], "i8"))])} for r in rows], schema=answered)

    sums = states.select("owner", "context", name).mapInArrow(ask, spec).groupBy("holder").applyInArrow(add, answer)
    return sums.groupBy("owner").agg(F.collect_list(F.struct("holder", "value")).alias(f"{name}_sums"))


def _summed(parts: list[dict]) -> np.ndarray:
    return np.concatenate([unpack(p["value"], "i8") for p in sorted(parts, key=lambda p: p["holder"])])


class Totals:
    """What all owners' seatings add up to in the parent, and the discounts."""

    def __init__(self, states: DataFrame, words: int):
        one = states.agg(*(F.coalesce(F.sum(k), F.lit(0)) for k in ("root_customers", "root_seats", "ones", "twos"))).first()
        self.root_customers, self.root_tables, ones, twos = one
        self.discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        self.root_discount, self.words = 0.75, words

    def root_opening(self) -> float:
        return (STRENGTH + self.root_discount * self.root_tables) / (self.words + 1)

    def root_probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.root_discount * tables + self.root_opening()) / (STRENGTH + self.root_customers)

    def context_probability(self, customers: np.ndarray, tables: np.ndarray, all_customers: np.ndarray, all_tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables + (STRENGTH + self.discount * all_tables) * parent) / (STRENGTH + all_customers)


def gibbs_round(states: DataFrame, totals, starts, number: int, sampled: bool) -> DataFrame:
    """Step 3: PASSES Gibbs passes over every owner's seatings."""
    schema = _schema(STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = totals.value
        for batch in batches:
            for r in batch.to_pylist():
                rng = np.random.default_rng((20260101, r["owner"], number))
                keys, counts, places = np.cumsum(unpack(r["keys"], "i8")), unpack(r["counts"], "i8"), r["places"]
                tables, root_tables = unpack(r["tables"], "i4"), unpack(r["root_tables"], "i4")
                word, context = np.divmod(keys, int(starts.value[-1]))
                numbers, all_tables = np.cumsum(unpack(r["context"], "i8")), _summed(r["context_tables_sums"])
                which = np.searchsorted(numbers, context)
                weight = STRENGTH + t.discount * all_tables[which]
                customers, base = _root_of(word, tables, places), np.full(places, t.root_opening())
                for _ in range(PASSES):
                    parent = t.root_probability(customers, root_tables)
                    tables = draw_tables(counts, weight * parent[word], t.discount, rng)
                    customers = _root_of(word, tables, places)
                    root_tables = draw_tables(customers, base, t.root_discount, rng)
                samples = r["samples"]
                if samples:
                    samples += _sample(all_tables)
                if sampled:
                    samples += _sample(tables.astype(np.int32)) + _sample(root_tables.astype(np.int32))
                yield _batch([_state(r["owner"], keys, counts, places, numbers, which, tables, root_tables, samples)], schema)

    return states.join(context_sums(states, starts, "context_tables"), "owner").mapInArrow(run, STATE)


def _sample(values: np.ndarray) -> bytes:
    blob = pack(values)
    return len(blob).to_bytes(8, "little") + blob


def _samples(blob: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        yield blob[at + 8 : at + 8 + n]
        at += 8 + n


def answer_pairs(found: DataFrame, states: DataFrame, totals, starts) -> DataFrame:
    """Step 4: (run, owner, pairs): averaged predictive probabilities of a run's pairs."""
    spec = "run string,owner int,pairs binary"
    schema = _schema(spec)

    def run(asked: pa.Table, kept: pa.Table) -> pa.Table:
        out = []
        for r in kept.to_pylist():
            keys, counts = np.cumsum(unpack(r["keys"], "i8")), unpack(r["counts"], "i8")
            word, context = np.divmod(keys, int(starts.value[-1]))
            which = np.searchsorted(np.cumsum(unpack(r["context"], "i8")), context)
            del context
            customers = _summed(r["context_customers_sums"])[which]
            # A sample's context totals were known in the next round; the last one's are the present ones.
            blobs = [*_samples(r["samples"] + _sample(_summed(r["context_tables_sums"])))]
            pair_mean = np.zeros(len(keys))
            for s, t in enumerate(totals.value):
                tables, root_tables, all_tables = (unpack(b, k) for b, k in zip(blobs[3 * s : 3 * s + 3], ("i4", "i4", "i8"), strict=True))
                parent = t.root_probability(_root_of(word, tables, r["places"]), root_tables)
                pair_mean += t.context_probability(counts, tables, customers, all_tables[which], parent[word])
            pair_mean /= len(totals.value)
            for a in asked.to_pylist():
                out.append({"run": a["run"], "owner": a["owner"], "pairs": pack(pair_mean[np.cumsum(unpack(a["found"], "i4"), dtype=np.int64)].astype(np.float32))})
        return pa.Table.from_pylist(out, schema=schema)

    kept = states.select("owner", "places", "keys", "counts", "context", "samples")
    for name in ("context_tables", "context_customers"):
        kept = kept.join(context_sums(states, starts, name), "owner")
    return found.select("owner", "run", "found").groupBy("owner").cogroup(kept.groupBy("owner")).applyInArrow(run, spec)


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def add_up(runs: DataFrame, answers: DataFrame, predicted: DataFrame, n: int, v: int) -> DataFrame:
    """Step 4: each document's counts and scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tokens, sizes = unpack(r["tokens"], "i4"), unpack(r["sizes"], "i8")
                starts = np.cumsum(sizes) - sizes
                counts = _joined(r["answers"], "counts", "i8")
                by_owner = sorted(r["predicted"], key=lambda a: a["owner"])
                pairs = np.log10(np.concatenate([unpack(a["pairs"], "f4") for a in by_owner]).astype(np.float64))
                logs = pairs[np.unique(_pairs(tokens, sizes, r["ending"], len(counts)), return_inverse=True)[1]]
                base = np.log10((counts + 1) / (n + 1 * (v + 1)))
                total = lambda x: np.add.reduceat(x, starts)
                ids, null = unpack(r["docs"], "i8"), unpack(r["doc_null"], "?")
                columns = [
                    pa.array(ids, mask=null), pa.array(unpack(r["held"], "?")), pa.array(sizes), pa.array(total((counts > 0).astype(np.int64)[tokens])),
                    pa.array(np.full(len(ids), n, dtype=np.int64)), pa.array(total(base[tokens])), pa.array(total(logs)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = runs.select("run", "docs", "doc_null", "held", "sizes", "ending", "tokens").join(_gathered(answers.where("run is not null"), "counts"), "run")
    both = joined.join(_gathered(predicted, "pairs").withColumnRenamed("answers", "predicted"), "run")
    return both.select("run", "docs", "doc_null", "held", "sizes", "ending", "tokens", "answers", "predicted").mapInArrow(run, SCORED)


def owners_of(tokens: int, partitions: int) -> int:
    """How many owners there are. What they ask each other grows with their square, so small inputs have few."""
    return max(1, -(-tokens // OWNER_TOKENS), min(partitions, -(-tokens // LEAST_TOKENS)))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    runs, vocabularies = materialize_kinds(store_runs(docs), RUN_KINDS)
    owners = owners_of(runs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], shuffle_partitions(spark))
    answers = materialize(answer_counts(ask_counts(vocabularies, owners)))
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    starts = share(numbering(answers, owners))
    discard(vocabularies)
    asks = materialize(ask_pairs(runs, answers, starts))
    states, found = materialize_kinds(first_state(asks, int(starts.value[-1])), FIRST_KINDS)
    totals, kept = Totals(states, v), []
    discard(asks)
    for k in range(BURN + SAMPLES):
        before, states = states, materialize(gibbs_round(states, share(totals), starts, k, k >= BURN))
        totals = Totals(states, v)
        discard(before)
        if k >= BURN:
            kept.append(totals)
    # The runs' tokens are shuffled once more to be scored; places and seatings needn't be on disk beside them.
    predicted = materialize(answer_pairs(found, states, share(kept), starts))
    predicted.count()  # a query between, see discard
    discard(found, states)
    return add_up(runs, answers, predicted, n, v)
