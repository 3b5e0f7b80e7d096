"""Cases that need the whole job of an operator, among them those that a review found to be cut short."""

import random
import time
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelog.llm import common, html_extract, language_model, packing
from tidelog.sources.folders import shared_dir

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- 1

LONG = "A long paragraph, with signs, of the article. It goes on; and on, for a while."


@pytest.mark.parametrize("paragraphs", [20, 200])
def test_title_and_lead_stay_with_a_long_article(paragraphs):
    body = f"<p>{LONG}</p>" * paragraphs
    text = "\n".join([LONG] * paragraphs)
    page = f"<nav>menu</nav><article><h1>T</h1><div><p>The lead, of it.</p></div><div>{body}</div></article><footer>f</footer>"
    assert html_extract.main_text(page) == f"T\nThe lead, of it.\n{text}"
    assert html_extract.main_text(f"<article><h1>T</h1><section><h2>S</h2><div><p>Lead, here.</p></div><div>{body}</div></section></article>") == f"T\nS\nLead, here.\n{text}"


@pytest.mark.parametrize("opening", ["div id='content' class='with-sidebar'", "div class='no-sidebar'", "div class='post tag-social'", "div class='category-search'", "section id='discussion'", "section id='legal'", "section class='related'", "section id='notice'"])
def test_a_name_removes_no_dense_content(opening):
    tag = opening.split()[0]
    page = f"<div>A page of ours, since 1999.</div><{opening}>" + f"<p>{LONG}</p>" * 5 + f"<div class='sidebar'><p>Read more, of this.</p></div></{tag}><div class='ad'>Buy this, now.</div>"
    assert html_extract.main_text(page).removeprefix("A page of ours, since 1999.\n") == "\n".join([LONG] * 5)


def test_a_name_removes_what_is_minor():
    page = f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='comments'>" + f"<p>{LONG}</p>" * 3 + "</div>"
    assert html_extract.main_text(page) == "\n".join([LONG] * 2)
    assert html_extract.main_text(f"<div class='ad'>{LONG}</div><article><h1>T.</h1><p>A.</p></article>") == "T.\nA."


@pytest.mark.parametrize("tag", sorted(["noscript", "template", "svg", "math", "object", "select", "canvas", "audio", "video", "button", "datalist", "map"]))
def test_an_unclosed_element_swallows_no_article(tag):
    article = f"<article><p>{LONG}</p><p>{LONG}</p></article>"
    text = "\n".join([LONG] * 2)
    assert html_extract.main_text(f"<body><{tag}>Menu{article}</body>") == text
    assert html_extract.main_text(f"<body><div><{tag}>Menu</div>{article}</body>") == text
    assert html_extract.main_text(f"<body><{tag}><{tag}>a</{tag}><p>{LONG}</p>b</{tag}>{article}</body>") == text
    assert html_extract.main_text(f"<article><p>One, <{tag}>no</{tag}>two.</p><p>{LONG}</p></article>") == f"One, two.\n{LONG}"


# --- 4


def test_rare_words_are_contexts(spark):
    """`rare` is less than 1 / 16,384 of the tokens; what follows it must still be learned."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(400)) for _ in range(150)] + ["rare follower", "other end"] * 2
    trained = (i for i in range(1000) if crc32(str(i).encode()) % 7 != 2)
    held = [i for i in range(1000) if crc32(str(i).encode()) % 7 == 2]
    rows = [(next(trained), t, "en", "s", 0) for t in texts] + [(held[0], "rare follower", "en", "s", 0), (held[1], "other follower", "en", "s", 0)]
    got = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[held[0]]["train_tokens"] > 3 * 16_384
    assert got[held[0]]["score"] > got[held[1]]["score"] + 0.5


def test_questions_and_seatings_are_gone_before_the_runs_are_shuffled_again(spark, monkeypatch):
    stored, owners = [], []
    keep, ask = language_model.materialize, language_model.ask_counts

    def noted(df, *options):
        stored.append(keep(df, *options))
        return stored[-1]

    monkeypatch.setattr(language_model, "materialize", noted)
    monkeypatch.setattr(language_model, "ask_counts", lambda runs, n: owners.append(n) or ask(runs, n))
    scored = language_model.score(spark.createDataFrame([(i, f"a b c {i % 3}", "en", "s", 0) for i in range(40)], DOCS))
    on_disk = lambda df: any(Path(f.removeprefix("file:")).exists() for f in df.inputFiles())
    assert [t.columns for t in stored if on_disk(t)] == [t.columns for t in stored if {"tokens", "places", "pairs"} & set(t.columns) and not {"keys", "per"} & set(t.columns)]
    assert scored.count() == 40
    # A small input has few owners, however many the shuffle partitions: their lists to each other are their square.
    assert owners == [1] and language_model.owners_of(10_000_000, 211) == 20 and language_model.owners_of(400_000_000, 12) == 100


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(k).getName() for k in range(files.size()))
    return {name.split("_")[1] for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def test_words_questions_and_old_shuffles_are_gone_when_they_were_used(spark, monkeypatch):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    old, round_of = set(folder.rglob("*.parquet")), language_model.gibbs_round
    tables = lambda: (pq.ParquetFile(f).read() for f in set(folder.rglob("*.parquet")) - old)
    columns = lambda: {c for t in tables() for c in t.column_names if t[c].null_count < len(t)}
    at_rounds, dealt = [], set()

    def noted(states, *options):
        at_rounds.append(columns())
        dealt.update(shuffle_files(spark))
        return round_of(states, *options)

    monkeypatch.setattr(language_model, "gibbs_round", noted)
    rows = [(i, f"a b c {i % 3} {i}", "en", "s", 0) for i in range(40)] + [(40, None, "en", "s", 0), (41, "", "en", "s", 0)]
    before = shuffle_files(spark)
    scored = language_model.score(spark.createDataFrame(rows, DOCS))
    # Words go with their answers, and questions when the owners have noted the places of the pairs.
    assert len(at_rounds) == language_model.BURN + language_model.SAMPLES
    assert all({"tokens", "found", "keys"} <= names and not {"vocabulary", "per"} & names for names in at_rounds)
    assert {"tokens", "pairs"} <= columns() and not {"vocabulary", "per", "found", "keys"} & columns()
    # Spark removes files in the background; what the answers to the pairs were shuffled by is gone before scoring.
    end = time.monotonic() + 5
    while len(shuffle_files(spark) - before) > 1 and time.monotonic() < end:
        time.sleep(0.1)
    assert dealt - before and len(shuffle_files(spark) - before) <= 1  # that of the count
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == 42 and got[40]["n_tokens"] == got[41]["n_tokens"] == 1 and got[0]["n_tokens"] == 6


def all_ways(customers, opening, discount):
    """Mean and variance of the number of tables, by the recursion over customers."""
    p = np.zeros(customers + 2)
    p[1] = 1.0
    t = np.arange(customers + 2)
    for c in range(1, customers):
        p[1:] = np.maximum(c - t[1:] * discount, 0) * p[1:] + opening * p[:-1]
        p /= p.sum()
    mean = (p * t).sum()
    return mean, (p * t * t).sum() - mean**2


@pytest.mark.parametrize("customers", [2, 7, 128, 129, 400, 6000])
@pytest.mark.parametrize("opening", [0.05, 3.0, 90.0, 4000.0])
def test_a_pass_reseats_all_customers(customers, opening):
    """One pass from any start gives the right number of tables, however many customers a dish has."""
    from tidelog.llm.seating import draw_tables

    for discount in (0.1, 0.5, 0.8):
        mean, variance = all_ways(customers, opening, discount)
        got = draw_tables(np.full(4000, customers), np.full(4000, opening), discount, np.random.default_rng(1))
        assert got.min() >= 1 and got.max() <= customers
        assert abs(got.mean() - mean) < 5 * (variance / 4000) ** 0.5 + 0.01 * mean
        assert abs(got.var() - variance) < 0.2 * variance + 0.02


def test_draws_agree_with_moves_of_one_customer():
    from tidelog.llm.seating import Seating, draw_tables

    rng = np.random.default_rng(2)
    s = Seating.start(np.full(3000, 9), np.ones(3000, dtype=np.int64))
    for _ in range(120):
        s.resample(np.arange(3000), np.full(3000, 1.5), 0.5, rng)
    drawn = draw_tables(np.full(3000, 9), np.full(3000, 1.5), 0.5, rng)
    assert abs(s.tables.mean() - drawn.mean()) < 0.12


# --- 7


def served_by_source(pieces, source_of, sequences):
    out = {}
    for p in pieces:
        if p["sequence_id"] in sequences:
            out[source_of[p["doc_id"]]] = out.get(source_of[p["doc_id"]], 0) + p["length"]
    return out


def test_many_small_sources_keep_their_proportions(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = [(i, "the of and to in a is that", "en", f"s{i % 1000}", 0) for i in range(12_000)]
    source_of = {r[0]: r[3] for r in rows}
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), path, length=256).collect()
    size = pieces[0]["doc_tokens"]
    assert sum(p["length"] for p in pieces) == 12_000 * size
    count = 1 + max(p["sequence_id"] for p in pieces)
    for part in (count // 4, count // 2):
        served = served_by_source(pieces, source_of, range(part))
        due = part * 256 / 1000
        assert all(abs(served.get(f"s{k}", 0) - due) <= size + 1 for k in range(1000))


def test_a_small_source_gets_its_target(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = [(i, "the of and to in a is that", "en", "big" if i % 2000 else "small", 0) for i in range(10_000)]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), path, targets={"small": 1.0, "big": 1.0}, length=64).collect()
    first = served_by_source(pieces, {r[0]: r[3] for r in rows}, range(1))
    assert first["small"] == first["big"] == 32


# --- pipeline


def test_stored_tables_are_made_from_small_batches(spark):
    """Batches of whole texts stand in the memory of an executor and of its workers at once."""

    @common.frugal
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    found = [r["n"] for r in common.materialize(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n bigint")).collect()]
    assert sum(found) == 5000 and max(found) <= common.BATCH_ROWS
    assert spark.conf.get(name) == before
