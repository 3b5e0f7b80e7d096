"""Whitening, fill-in-the-middle and line dedup against brute force, with odd rows."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import fill_middle, line_dedup, queries, whitening

pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, output string, hash bigint, __hit int, units string, lost int"
SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def odd_rows():
    rng = random.Random(5)
    lines = [" ".join(rng.choice(("alpha", "Beta", "gämma", "δέλτα", "e1", "😀")) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice((str.upper, str, lambda x: f"  {x}\t"))(rng.choice(lines)) for _ in range(rng.randint(0, 12))), "x", 1, 2, "u", 3) for i in range(100, 300)]
    rows += [(1, None, None, None, None, None, None), (2, "", "", 0, 0, "", 0), (3, "\n", "", 0, 0, "", 0), (4, "a <P> b", "", 0, 0, "", 0), (5, "<S<P<M", "", 0, 0, "", 0), (6, "one", "", 0, 0, "", 0)]
    rows += [(7, "a very long line " * 20_000 + "\n" + "row after row\n" * 30_000, "", 0, 0, "", 0), (8, "A VERY long line " * 20_000, "", 0, 0, "", 0)]
    rows += [(9, "twice in this document\ntwice in this document", "", 0, 0, "", 0)] * 2
    rows += [(None, "held by a nameless row\nand some other line", "", 0, 0, "", 0), (None, "held by a nameless row", "", 0, 0, "", 0), (10, "Held by a nameless row ", "", 0, 0, "", 0)]
    return rows + [(11, "nine sign\nnine sign\nten signs!", "", 0, 0, "", 0), (12, "nine sign\nTEN signs!", "", 0, 0, "", 0)]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


# --- 12


def fim(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    one, two, three = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, None, text
    if h4 % 100 < 20:
        return n, "spm", one, two, three, f"<S>{three}<P>{one}<M>{two}"
    return n, "psm", one, two, three, f"<P>{one}<S>{three}<M>{two}"


def test_fill_middle(docs, rows):
    got = fill_middle.rearrange(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    expected = sorted(((i, *fim(i, text or ""), text or "") for i, text, *_ in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == expected
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_parameters(docs):
    assert {r.form for r in fill_middle.rearrange(docs, fim_percent=0).collect()} == {"plain"}
    assert {r.form for r in fill_middle.rearrange(docs, fim_percent=100, spm_percent=100).where("n > 0 and doc_id <> 4").collect()} == {"spm"}
    one, two = (fill_middle.rearrange(docs, seed=s).select("output").collect() for s in (1, 2))
    assert one != two


def test_fill_middle_is_native(docs):
    plan = fill_middle.rearrange(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemory")[0] and "Python" not in plan and plan.count("regexp_extract_all") == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert fill_middle.rearrange(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0


# --- 13


def dedup(rows, least=10):
    held = {}
    keys = lambda text: [lower(line.strip(SPACES)) for line in (text or "").split("\n")]
    for i, text, *_ in rows:
        for key in keys(text):
            if len(key) >= least:
                held.setdefault(key, set()).add(math.inf if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        at = math.inf if i is None else i
        kept = [line for line, key in zip(lines, keys(text), strict=True) if len(held.get(key, ())) < 2 or at == min(held[key])]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("broadcast", "cells"), [(32 << 20, 1023), (0, 1023), (32 << 20, 1)])
def test_line_dedup(docs, rows, monkeypatch, broadcast, cells):
    """Also with the join that shuffles, and with filters so full that they know every line."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(line_dedup, "LEAST_CELLS", cells)
    monkeypatch.setattr(line_dedup, "RUN_LINES", 300)
    got = line_dedup.drop_repeated_lines(docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in got.collect()), key=str) == dedup(rows)


def test_line_dedup_least(docs, rows):
    got = line_dedup.drop_repeated_lines(docs, least=1)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in got.collect()), key=str) == dedup(rows, 1)


def test_filters_let_few_lines_through(spark):
    """Of 40,000 lines that stand once, fewer than one in a thousand is a suspect; every repeated one is."""
    rows = [(i, "\n".join(f"line {i} {j} of its own" for j in range(20)) + ("\nthe line of many" if i % 7 == 0 else "")) for i in range(2_000)]
    found = line_dedup.suspects(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).groupBy("key").count().collect()
    assert {bytes(r.key): r["count"] for r in found}[b"the line of many"] == len(range(0, 2_000, 7))
    assert len(found) < 40


# --- 11


def grid(vector, width):
    return [math.floor(64 * c) + 1_000_000 for c in [*vector, *[0.0] * (width - len(vector))]]


def brute(rows, components=16):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in good)
    x = [(i, grid(v, width)) for i, v in good]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    order = order[values[order] > values.max() * 1e-12]
    deviation = lambda v: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
    total = sum(deviation(v) for v in fit) / n**3
    out = []
    for i, v in x:
        w = np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)]) @ axes[:, order] / np.sqrt(values[order])
        out += [(i, k + 1, n, deviation(v), w[k], values[order[k]] / total) for k in range(len(order))]
    return out


def vectors(width=24, n=300):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(n, width)) * np.linspace(0.1, 2, width)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    return [*rows, (0, rows[0][1]), (900, rows[1][1]), (901, None), (902, [None, *rows[0][1][1:]]), (903, [math.nan, *rows[0][1][1:]]), (904, [math.inf] * width), (905, [1.0, 2.0]), (None, rows[2][1]), (906, [])]


def by_row(rows):
    found = {}
    for r in rows:
        found.setdefault((str(r[0]), r[1]), []).append(tuple(r))
    return {k: sorted(v, key=lambda r: r[4]) for k, v in found.items()}


@pytest.mark.parametrize("width", [24, 6])
def test_whitening(spark, width):
    rows = vectors(width)
    table = spark.createDataFrame([(i, v, "w", 7) for i, v in rows], "vec_id bigint, embedding array<float>, w string, x int").repartition(4)
    got = by_row(whitening.whiten(table, whitening.fit(table)).collect())
    expected = by_row(brute(rows))
    assert got.keys() == expected.keys()
    signs = {}
    for key in expected:
        for a, b in zip(got[key], sorted(expected[key], key=lambda r: r[4] * signs.get(key[1], 1)), strict=True):
            signs.setdefault(key[1], 1 if a[4] * b[4] > 0 else -1)
            assert a[2] == b[2] and int(a[3]) == b[3]
            assert a[4] == pytest.approx(signs[key[1]] * b[4], abs=1e-8)
            assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 1e-9


def test_whitening_exact_beyond_64_bits(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [1e300, 2.0]), (4, [3.5, -1e10])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    model = whitening.fit(table)
    limit = lambda c: max(-(1 << 61), min(1 << 61, math.floor(64 * c))) + 1_000_000
    x = [[limit(c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((4 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert model.total_variance == pytest.approx(sum(deviations) / 64, rel=1e-12)
    got = {r.vec_id: r.deviation for r in whitening.whiten(table, model).collect()}
    assert got == {i: (d if d < 10**38 else None) for (i, _), d in zip(rows, deviations, strict=True)}


def test_whitening_without_variance(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        table = spark.createDataFrame(rows, kind)
        assert whitening.whiten(table, whitening.fit(table)).count() == 0


def test_whitening_leaves_out_flat_directions(spark):
    rows = [(i, [float(i), 5.0, 2.0 * i]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = whitening.whiten(table, whitening.fit(table)).collect()
    assert {r.component for r in found} == {1} and all(r.explained == pytest.approx(1) for r in found)


def test_queries_are_registered():
    assert {"op11_whitening", "op12_fill_middle", "op13_line_dedup"} <= queries.QUERIES.keys()


# --- 1: pages that lost or kept the wrong text, and pages that took the square of their length


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><article><!--><p>One, two.</p></article>", "One, two."),
        ("<article><!---><p>One, two.</p><!-- <p>no, no.</p> --></article>", "One, two."),
        ("<article><p>Kept, as text.</p><p style='color:red; Display : none'>hidden, secret.</p></article>", "Kept, as text."),
    ],
)
def test_comments_and_hidden_text(page, text):
    from tidelog.llm.html_extract import main_text

    assert main_text(page) == text


@pytest.mark.parametrize("page", ["<div class=sidebar>" * 100_000 + "x. y", "<div>" * 20_000 + "</section>" * 100_000 + "text, here.", "<header>" * 100_000 + "t.", "<nav>" * 100_000 + "t.", "<article>" + "<div>" * 20_000 + "</p>" * 100_000 + "t."])
def test_pages_take_time_in_proportion(page):
    import time

    from tidelog.llm.html_extract import main_text

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 10
