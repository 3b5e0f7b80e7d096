"""The corpus operators against brute-force versions, with nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import math
import random
from math import log
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import byte_bpe, chat_format, exact_dedup, golomb, html_extract, language_id, language_model, near_dedup, packing, quality_rules, sharding, textkit

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def make_docs(seed=0, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 90))]
        if rows and rng.random() < 0.3:
            words = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words) if rng.random() < 0.7 else "  ".join(words) + "\n", "en", f"s{i % 3}", 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, " \n\t", "en", "s0", 0), (1003, "One", "en", None, 3), (1004, "x" * 50_000 + " end", "en", "s1", 0), (1005, rows[0][1], "en", "s1", 0), (1006, "123 !!", "", "s2", 0)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<script>var a='<p>no</p>'", ""),
        ("<p>a &amp; b<p>c&nbsp;d<br>e", "a & b\nc d e"),
        ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>Long text, with signs. More of it here.</p></article><footer>f</footer>", "T\nLong text, with signs. More of it here."),
        ("<div class='cookie-notice'><p>We use cookies, all day long, on every page. Accept.</p></div><main><p>Body text, here. It goes on.</p><form>Name: x.</form></main>", "Body text, here. It goes on."),
        ("<article><p>Main text, of the page. And so on.</p><section class=comments><p>Nice, very nice text. Thanks!</p></section></article>", "Main text, of the page. And so on."),
        ("<article><p>cut off, in a tag. Here</p><p clas", "cut off, in a tag. Here"),
        ("<p>1 < 2 and 3 > 2.</p>", "1 < 2 and 3 > 2."),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_path_scores_decide(monkeypatch):
    """Without the ratios the banner stays; and a wrapper named like boilerplate doesn't lose its article."""
    page = "<div class=promo>Buy now, here.</div><div class=x><h1>T</h1><p>One, two. Three four five, six.</p><p>Seven, eight. Nine ten, eleven.</p></div>"
    text = "T\nOne, two. Three four five, six.\nSeven, eight. Nine ten, eleven."
    assert html_extract.main_text(page) == text
    assert html_extract.main_text(page.replace("class=x", "class=with-sidebar")) == text
    monkeypatch.setattr(html_extract, "path_scores", lambda rows: {row[0]: 1.0 for row in rows})
    assert html_extract.main_text(page) != text


def test_path_scores_by_hand():
    rows = [(1, 10, 0, True), (2, 40, 2, False), (2, 20, 0, False), (3, 6, 1, False)]
    near = html_extract.SMOOTH
    mean = lambda values, k: sum(near[abs(i - k)] * v for i, v in enumerate(values)) / sum(near[abs(i - k)] for i in range(3))
    wanted = [mean([10, 30, 6], k) * (1 + mean([0, 1, 1], k)) * (html_extract.NAMED if k == 0 else 1) for k in range(3)]
    assert [html_extract.path_scores(rows)[p] for p in (1, 2, 3)] == pytest.approx(wanted)


def test_stray_quotes_and_depth():
    assert html_extract.main_text("<p title=it's>Hello, all. One.</p><p>More, text. Two.</p>") == "Hello, all. One.\nMore, text. Two."
    assert html_extract.main_text('<p class="x"">Hello, all. One.</p>') == "Hello, all. One."
    assert html_extract.main_text("<div>" * 100_000 + "<p>Deep, text.</p>") == "Deep, text."


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", 7), (None, None, None, None)], "page_id bigint, url string, html string, text bigint")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert got == {1: ("a", 1), None: ("", 0)}
    assert html_extract.extract(pages.limit(0)).count() == 0


# --- 2


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|", "<\\\\|x", "<<|", "a\nb", "", None, "<|im_sep|>é\\"]
    rows = [(k % 2, k // 2, "assistant" if k % 3 else "user", t, 5) for k, t in enumerate(odd)] + [(9, 0, None, "x", 5)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns int").withColumn("parts", chat_format.text_part(F.col("text")))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    for conv in (0, 1, 9):
        mine = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, role, t in mine if role == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_chat_attachments(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "a.png", 64), ("audio", None, "b.wav", None), ("weird", "w", None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id bigint, turn bigint, role string, parts {chat_format.PARTS_TYPE}")
    row = chat_format.format_chats(turns).first()
    assert row["formatted"] == "<|im_start|>user<|im_sep|>see <\\|image|><|image|><|audio|>w<|im_end|>\n"
    assert [(a["position"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(0, "image", "a.png", 64), (1, "audio", "b.wav", 0)]
    assert row["expanded_tokens"] == 64


# --- 3


@pytest.mark.parametrize("n", [0, 1, 7, 500])
@pytest.mark.parametrize("bits", [0, 3, 50])
def test_golomb(n, bits):
    rng = np.random.default_rng(n)
    top = 300 if bits < 50 else 1 << 63
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    assert (golomb.decode(golomb.encode(values, bits), n, bits) == values).all()


def test_exact_copies(spark, docs, rows, empty):  # a column of the input is called hit
    again = docs.unionByName(spark.createDataFrame([rows[5], (None, "nobody", None, None, None)], DOCS)).withColumnRenamed("source", "keep_id").withColumnRenamed("lang", "hit")
    plain = [*rows, rows[5], (None, "nobody", None, None, None)]
    groups = defaultdict(list)
    for r in plain:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    expected = []
    for text, group in groups.items():
        best = min(group, key=lambda r: (-len(r[1] or ""), math.inf if r[0] is None else r[0]))[0]
        expected += [(r[0], best, len(group), r[0] == best, hashlib.sha256(text.encode()).hexdigest()) for r in group]
    got = [tuple(r) for r in exact_dedup.copies(again).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = exact_dedup.drop_copies(again)
    assert kept.columns == again.columns and kept.count() == len(groups)
    assert exact_dedup.copies(empty).count() == 0


# --- 4


def test_language_model(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in language_model.score(docs).collect()}
    words = {r[0]: [*SPACE.findall(lower(r[1] or "")), None] for r in rows}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in words}
    counts = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in words.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (got[k]["held_out"], got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (held[k], len(ws), sum(w in counts for w in ws), n)
        assert got[k]["base_score"] == pytest.approx(base, rel=1e-12)
        assert got[k]["score"] < 0
    away = [k for k in words if held[k]]
    assert sum(got[k]["score"] for k in away) > sum(got[k]["base_score"] for k in away)
    assert language_model.score(empty).count() == 0


def test_seating_keeps_its_books():
    from tidelog.llm.seating import Seating

    rng = np.random.default_rng(1)
    customers = np.array([0, 1, 5, 400])
    s = Seating.start(customers, np.array([1, 1, 2, 9]))
    for _ in range(50):
        s.resample(np.flatnonzero(s.customers > 1), np.full(2, 3.0), 0.5, rng)
        assert (s.customers == customers).all() and s.sizes.min() > 0
        assert s.tables.sum() == len(s.sizes) and s.sizes.sum() == customers.sum()
    s.leave(np.array([3]), np.array([400]), rng)
    assert s.tables[3] == 0 and s.enter(np.array([3]), np.array([2]), np.array([1.0]), 0.5, rng)[0] == 2


# --- 5


def test_shards(spark, docs, rows, empty):
    got = sharding.shard_documents(docs, 3, 256).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    assert all(r["size"] == size[r["doc_id"]] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(empty).count() == 0


def test_rebalance_moves_little(spark, tmp_path):
    sums = spark.range(64).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % 5 + 10).alias("bytes"), F.lit(1).cast("bigint").alias("rows"))
    first = sharding.build_map(sums, 4)
    second = sharding.rebalance(first, sums, 5)
    sharding.store_map(first, str(tmp_path / "map"))
    sharding.store_map(second, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map")).first()["version"] == 2
    old = {r["vslot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()}
    new = {r["vslot"]: r["shard"] for r in second.collect()}
    load = Counter()
    for r in sums.collect():
        load[new[r["vslot"]]] += r["bytes"]
    assert max(load.values()) - min(load.values()) <= 30
    assert sum(old[k] != new[k] for k in old) <= 64 / 5 + 5


# --- words


def thue_morse(n, flip=0):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_word_hashes_of_regular_words_differ(n):
    raw, at = textkit.text_bytes(pa.array([thue_morse(n) + " " + thue_morse(n, 1) + " ABC abc cba"]))
    hashes = textkit.word_hashes(raw, at)[0].tolist()
    assert hashes[2] == hashes[3] and len(set(hashes)) == 4


def test_exact_shingles():
    texts = ["a b c d e f", "B c D e", " a\tb\nc ", "", None, "é é é é é", "a b c d"]
    codes, at = textkit.exact_shingles(pa.array(texts, pa.string()), 4)
    words = [SPACE.findall(lower(t or "")) for t in texts]
    runs = [[tuple(w[i : i + 4]) for i in range(len(w) - 3)] or ([tuple(w)] if w else []) for w in words]
    assert np.diff(at).tolist() == [len(r) for r in runs]
    flat = [x for r in runs for x in r]
    assert len(set(zip(codes.tolist(), flat))) == len(set(flat)) == len(set(codes.tolist()))


# --- 6


def test_quality_counts(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r[0], 1) for r in rows[:40]] + [(None, 1)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, quality_rules.fit(docs, labels, 64), buckets=64).collect()}
    for k, text, *_ in rows:
        words, lines = SPACE.findall(text or ""), [x for x in (text or "").split("\n") if SPACE.search(x)]
        places = defaultdict(list)
        for i in range(len(words) - 2):
            places[tuple(words[i : i + 3])].append(i)
        covered = {i + j for v in places.values() if len(v) > 1 for i in v for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""))
        assert (r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(lines) - len(set(lines)), len(covered), failed)
        assert not (failed and r["kept"])
    clash = docs.withColumnRenamed("n_chars", "words").withColumnRenamed("source", "kept")
    assert quality_rules.filter_kept(clash, labels).columns == clash.columns
    assert quality_rules.filter_kept(empty, labels).count() == 0


def test_quality_repeats(spark):
    text = "a b c d a b c e " * 3
    row = quality_rules.rule_counts(spark.createDataFrame([(1, text + "\nx\nx\n \n")], "doc_id bigint, text string")).first()
    assert (row["n_dup_lines"], row["n_repeat_words"]) == (1, 24)


def grams_of(text, buckets):
    """Buckets of tokens and of neighbours, by the definition of the hash."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashed = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed=seed)
    tokens = [hashed(w.encode()) for w in SPACE.findall(re.sub(r"[!-/:-@\[-`{-~]+", r" \g<0> ", text or ""))]
    pairs = [hashed(b.to_bytes(8, "little"), hashed(a.to_bytes(8, "little"))) for a, b in zip(tokens, tokens[1:])]
    return [signed(h) % buckets for h in tokens + pairs]


def test_quality_scores(spark, docs, rows):
    marks = [(r[0], int(k % 3 > 0)) for k, r in enumerate(rows[:60])]
    labels = spark.createDataFrame([*marks, marks[0], (None, 1)], "doc_id bigint, quality int")
    fitted = quality_rules.fit(docs, labels, 64)
    grams = {k: grams_of(text, 64) for k, text, *_ in rows}
    raw = Counter(b for g in grams.values() for b in g)
    good, poor = (Counter(b for k, q in marks if q == mark for b in grams[k]) for mark in (1, 0))
    prior = quality_rules.PRIOR
    weights = [log((good[b] + prior) / (raw[b] * good.total() / raw.total() + prior)) for b in range(64)]
    threshold = sum(sum(c[b] * weights[b] for b in range(64)) / c.total() for c in (good, poor)) / 2
    row = fitted.first()
    assert row["weights"] == pytest.approx(weights) and row["threshold"] == pytest.approx(threshold)
    for r in quality_rules.judge(docs, fitted, buckets=64).collect():
        g = grams[r["doc_id"]]
        if g:
            score = sum(weights[b] for b in g) / len(g)
            assert r["score"] == pytest.approx(score)
            assert r["kept"] == (not r["base_failed"] and score >= threshold) or score == pytest.approx(threshold)
        else:
            assert r["score"] is None and not r["kept"]


def test_quality_finds_lexical_junk(spark):
    """Spam of ordinary lower-case words goes, rare languages stay."""
    rng = random.Random(2)
    text = lambda stem, n: " ".join(f"{stem}{min(rng.randrange(n), rng.randrange(n))}" for _ in range(90))
    texts = [text("word", 400) for _ in range(60)] + [text("mot", 400) for _ in range(4)] + [text("buy", 40) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(60, 1), (61, 1)] + [(i, 0) for i in range(64, 70)], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in quality_rules.filter_kept(docs, labels).collect()}
    assert kept == set(range(64))


def test_quality_threshold_separates(spark):
    rng = random.Random(1)
    good = [" ".join(f"w{rng.randrange(99)}" for _ in range(80)) for _ in range(30)]
    bad = [" ".join(rng.choice(["$$", "##", "XX", "%%"]) + str(rng.randrange(99)) for _ in range(80)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in quality_rules.filter_kept(docs, labels).collect()}
    assert kept == set(range(30))


# --- 7


def check_pieces(pieces, ids, length=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
    assert by_doc.keys() == ids.keys()
    for key, by, at in (("start", by_doc, None), ("offset", by_sequence, length)):
        for k, group in by.items():
            end = 0
            for p in sorted(group, key=lambda p: p[key]):
                assert p[key] == end
                end += p["length"]
            assert end == len(ids[k]) if at is None else end <= at
    return by_sequence


@pytest.mark.parametrize("targets", [None, {"s0": 3.0, "s1": 1.0}])
def test_packing(spark, docs, rows, targets):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    ids = {r[0]: [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    by = check_pieces(packing.pack(docs, path, targets=targets, length=256).collect(), ids, 256)
    full = [sum(p["length"] for p in g) for _, g in sorted(by.items())]
    assert all(n == 256 for n in full[:-1])
    if targets is None:
        shares = Counter()
        for g in list(by.values())[:-1]:
            for p in g:
                shares[p["sequence_id"], p["queue"]] += p["length"]
        each = defaultdict(list)
        for (s, q), n in shares.items():
            each[q].append(n)
        assert all(max(v) - min(v) <= 2 for v in each.values())


def test_packing_of_nothing(empty):
    assert packing.pack(empty, tokenizers.path("word_bpe_49k.json")).count() == 0


def test_schedule_is_the_same_from_any_start():
    plan = packing.Schedule([5000, 700, 300, 40_000], [1.0, 2.0, 1.0, 4.0], 128)
    every = plan.served(np.arange(0, 46_000 // 128 + 2))
    assert (every[-1] == plan.totals).all() and (np.diff(every, axis=0) >= 0).all()
    assert (every.sum(axis=1) == np.minimum(np.arange(len(every)) * 128, plan.total)).all()
    assert (plan.served(np.arange(100, 120)) == every[100:120]).all()


# --- 8


def test_byte_bpe(spark, docs, rows, empty):
    import base64

    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, path, tokenizers.PATTERN).collect()}
    assert got == {r[0]: plain.encode_ordinary(r[1] or "") for r in rows}
    one = byte_bpe.round_trip(docs.where("doc_id = 1"), path, tokenizers.PATTERN).first()
    assert one["decoded_sha256"] == hashlib.sha256(rows[1][1].encode()).hexdigest()
    assert byte_bpe.round_trip(empty, path, tokenizers.PATTERN).count() == 0


# --- 9


def test_language_sample_has_every_label(spark, monkeypatch):
    rows = [(i, f"word{i % 260} text{i % 260} more", f"l{i % 260:03d}") for i in range(1300)]
    docs = spark.createDataFrame([*rows, *rows[:50], (None, "a b", "l000"), (7, None, "l007"), (8, "x", " ")], "doc_id long, text string, lang string")
    kept = {r["lang"] for r in docs.where("doc_id is not null and text is not null and trim(lang) <> ''").where(~language_id.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    got = language_id.sample(docs).collect()
    assert len(kept) > 250 and {r["lang"] for r in got} == kept
    assert len(got) == len({(r["lang"], r["part"]) for r in got})
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", len(kept))
    few = language_id.sample(docs).collect()
    assert {r["lang"] for r in few} == kept and len(few) == len(kept)
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 2000)
    assert 0 < sum(12 * len(r["text"]) for r in language_id.sample(docs).collect()) <= 2000


def test_language_id(spark, empty):
    rng = random.Random(2)
    sounds = {"xx": ["tha", "ing", "er", "on"], "yy": ["ción", "mente", "es", "ar"], "zz": ["schw", "keit", "ung", "ß"]}
    rows = []
    for i in range(600):
        lang = sorted(sounds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(2)) for _ in range(40)), lang, "s", 0))
    rows += [(900, None, "xx", "s", 0), (901, "12 34 !!", "xx", "s", 0), (902, "", None, "s", 0), (None, rows[0][1], "xx", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    away = [r for r in rows[:600] if got[r[0]]["held_out"]]
    assert away and sum(got[r[0]]["lang_pred"] == r[2] for r in away) >= 0.97 * len(away)
    assert all((got[k]["lang_pred"], got[k]["score"], got[k]["accepted"]) == ("und", 0.0, False) for k in (900, 901, 902))
    assert language_id.filter_accepted(docs).count() == sum(r["accepted"] for r in got.values())
    assert language_id.identify(empty).count() == 0
    unlabelled = docs.limit(3).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


# --- 10


def components_of(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def shingles(text, width=4):
    words = SPACE.findall(lower(text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def near_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    rows, base = [], [rng.choice(vocab) for _ in range(150)]
    for i in range(260):
        words = list(base) if i % 2 else [rng.choice(vocab) for _ in range(60)]
        for _ in range(rng.randint(0, 7) if i % 2 else 0):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words), "en", "s", 0))
    return [*rows, *make_docs(3, 40)[-7:], (2000, rows[1][1].upper(), "en", "s", 0)]


@pytest.mark.parametrize("block", [8, 128])
def test_near_groups(spark, empty, block, monkeypatch):
    rows = near_rows()
    inner = near_dedup.linked_in_blocks
    monkeypatch.setattr(near_dedup, "linked_in_blocks", lambda *a, **k: inner(*a, **k, block=block))
    sets = {r[0]: shingles(r[1]) for r in rows}
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: r for r in near_dedup.near_groups(docs, 4, 80).collect()}
    expected = components_of(sets)
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert {k: r["component_id"] for k, r in got.items()} == expected
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_near_edges(spark, empty):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 0), (1, "a b c d e f", "en", "s", 0), (None, "a b c d e f", "en", "s", 0), (2, "z", None, None, None)], DOCS)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(docs, 4).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 2, True)], key=str)
    assert near_dedup.near_groups(empty).count() == 0


def test_components(spark):
    from tidelog.llm.components import components

    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def reach(k):
        seen, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return min(seen)

    table = spark.createDataFrame(links, "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in components(table).collect()} == {k: reach(k) for k in list(near)}
    assert components(table.limit(0)).count() == 0


def test_least_matches_rises():
    steps = near_dedup.least_matches(240, 0.8, 1e-6)
    assert steps[0][0] == 24 and steps[-1][0] == 240
    assert all(a[1] < b[1] for a, b in zip(steps[:-1], steps[1:], strict=True))


def test_word_hashes_agree_with_words():
    texts = [None, "", " A b\x0bA", "é\x1cx", "a" * 1000, "b"]
    raw, at = textkit.text_bytes(pa.array(texts))
    hashes, words_at = textkit.word_hashes(raw, at)
    flat = [w for t in texts for w in SPACE.findall(lower(t or ""))]
    assert len(flat) == len(hashes) and len(set(flat)) == len(set(hashes.tolist()))
    assert len({(a, b) for a, b in zip(flat, hashes.tolist(), strict=True)}) == len(set(flat))
    assert np.diff(words_at).tolist() == [len(SPACE.findall(t or "")) for t in texts]


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocab = ["".join(rng.choice(["th", "in", "er", "on", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    good = [" ".join(rng.choice(vocab) for _ in range(100)) for _ in range(30)]
    near = good[0].split()
    near[50] = "changed"
    texts = [*good, good[1].replace(" ", "  "), " ".join(near), "short", None, " ".join(["$$#"] * 100)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == (set(range(30)) - {1}) | {30}
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).columns == none.columns


