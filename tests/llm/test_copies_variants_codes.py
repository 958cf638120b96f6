"""Exact dedup, spelling variants and vector codes against brute force, with small limits so that every branch runs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from snapsift.llm import exact_dedup, skew, spelling, vector_codes

DOCS = "doc_id long, text string, id string, digest string, n long, keep_id long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) for _ in range(120)] + ["a" * 2_000_000] * 3 + ["a" * 1_999_999 + "b", None, "", " ", "A"] + ["hot"] * 200
    found = [(k, t, "x", "y", 1, 2) for k, t in enumerate(texts)]
    return found + [found[5], found[5], (None, "a b", "x", "y", 1, 2), (None, "alone", "x", "y", 1, 2), (None, "alone", "x", "y", 1, 2)]


@pytest.mark.parametrize("weak, hot", [(False, 1000), (False, 3), (True, 1000), (True, 3)])
def test_exact_dedup_like_grouping_by_text(spark, rows, weak, hot, monkeypatch):
    monkeypatch.setattr(skew, "HOT", hot)
    digest = (lambda t: F.length(t) % 3) if weak else exact_dedup.sha256
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    got = exact_dedup.groups_of_copies(docs, digest=digest)
    last, size = {}, Counter(t or "" for _, t, *_ in rows)
    for i, t, *_ in rows:
        last[t or ""] = max(x for x in (i, last.get(t or ""), -1) if x is not None)
    want = Counter((i, k := (None if last[t or ""] < 0 else last[t or ""]), size[t or ""], i == k) for i, t, *_ in rows)
    assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept").collect()) == want
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, _, k in want.elements() if k)


def test_exact_dedup_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.groups_of_copies(none).collect() == [] and exact_dedup.keep_last(none).collect() == []


def test_exact_dedup_merges_each_text_once_for_a_task_and_salt(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text")).repartition(16)
    got = exact_dedup.groups_of_copies(docs)
    plan = exact_dedup._combined(docs.select(F.col("doc_id").alias("id"), F.lit("d").alias("digest"), "text"))
    assert plan.collect()[0].n == 40_000 and got.where("kept").count() == 1
    assert plan._jdf.queryExecution().executedPlan().toString().count("partial_max") >= 2  # within a task before either exchange


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_pairs(n, ratio):
    found = {}
    for w in n:
        others = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        best = others[0] if others and n[others[0]] >= ratio * n[w] else None
        found[w] = (best, n[w], len(others), n[best] if best else None)
    root = lambda w: root(found[w][0]) if found[w][0] else w
    return {(w, f, root(w), *rest) for w, (f, *rest) in found.items()}


@pytest.mark.parametrize("limits", [{}, {"BOX_WORDS": 6, "CELL": 9, "FINE": 2, "ROWS": 20}, {"BOX_WORDS": 40, "SAMPLE": 60, "FINE": 3, "LONGEST": 8}])
def test_spelling_variants_like_all_pairs(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(7)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(150)} | {"".join(p) for p in {tuple(rng.sample("abcdeff", 7)) for _ in range(150)}}
    words |= {"a" * 300, "a" * 301, "a" * 150 + "ÿ" + "a" * 149, "×÷" * 4, "×÷" * 4 + "×"}
    for w in list(words):
        for _ in range(2):
            k = rng.randrange(len(w))
            words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abzàÿ") + w[k:], w[:k] + rng.choice("abzàÿ") + w[k + 1 :]]))
    n = {w: 10 ** rng.randint(0, 4) * rng.randint(1, 3) for w in words}
    vocab = spark.createDataFrame([(w.encode("latin-1"), k) for w, k in n.items()], "word binary, n long").repartition(3)
    got = [tuple(r) for r in spelling.variants(vocab, 10).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = variants_by_pairs(n, 10)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(root not in (w, form) for w, form, root, *_ in want)  # chains of forms are among them


def test_spelling_vocabulary_of_odd_texts(spark):
    texts = ["Nächste Nächste, NÄCHSTE", None, "", "abc×defg abc×defg", "short short", "x" * 200_000 + " " + "x" * 200_000, "Once onlyonce", "łabcdefgh łabcdefgh", "İabcdefgİabcdefg"]
    rows = [(k, t, "w", 1) for k, t in enumerate(texts)] + [(None, "nulltext nulltext", "w", 1), (2, "repeated", "w", 1), (2, "repeated", "w", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    n = Counter(w for _, t, *_ in rows for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate({k: k + 32 for k in range(65, 91)})))
    got = {(bytes(r.word).decode("latin-1"), r.n) for r in spelling.vocabulary(spelling.runs(docs, 7)).collect()}
    assert got == {(w, k) for w, k in n.items() if len(w) >= 7 and k >= 2} and ("nächste", 2) in got
    assert spelling.variants(spelling.vocabulary(spelling.runs(docs.limit(0), 7))).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spelling.vocabulary(spelling.runs(docs, 7)), 1)


def test_spelling_query_boxes_hold_every_near_word():
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abcd") for _ in range(7)) for _ in range(400)})
    v = spelling.vectors(spelling.letters([w.encode() for w in words]))
    weight, spelling_box = 1.0, spelling.BOX_WORDS
    spelling.BOX_WORDS = 10
    try:
        tree, boxes = spelling.plant(v, weight)
    finally:
        spelling.BOX_WORDS = spelling_box
    home = {int(r): b for b, rows in spelling.visits(tree, v, spelling.POINT) for r in rows}
    seen = defaultdict(list)
    for b, rows in spelling.visits(tree, v, spelling.SAME):
        for r in rows.tolist():
            seen[r].append(b)
    assert boxes > 10 and len(home) == len(words) and all(len(x) == len(set(x)) for x in seen.values())
    for a, x in enumerate(words):
        for b, y in enumerate(words):
            if near(x, y):
                fallen, risen = (Counter(x) - Counter(y)), (Counter(y) - Counter(x))
                assert (home[b] in seen[a]) or min(fallen) > min(risen)  # each pair is found in one direction
    assert sum(map(len, seen.values())) < len(words) * boxes / 2  # boxes are pruned


def codes_by_full_search(rows):
    whole = [(i, [max(-vector_codes.BOUND, min(vector_codes.BOUND, math.floor(4096 * x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(whole, key=lambda r: (r[0] is None, r[0], r[1]))
    size = next((len(v) for _, v, _ in order if v), 0)
    width = -(-size // 8)
    parts = lambda v: [[*v, *[0] * (8 * width - size)][p * width : (p + 1) * width] for p in range(8)]
    kept = [(i, parts(v), label) for i, v, label in order if len(v) == size and v]
    books = [[v[p] for _, v, _ in kept[:16]] for p in range(8)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    nearest = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(6):
        new = [list(b) for b in books]
        for p in range(8):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(v[p], books[p])[1]].append(v[p])
            for k, g in groups.items():
                new[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
        books = new
    coded = [(i, "".join(f"{nearest(v[p], books[p])[1]:02x}" for p in range(8)), sum(nearest(v[p], books[p])[0] for p in range(8)), label) for i, v, label in kept]
    coded += [(i, None, None, label) for i, v, label in whole if len(v) != size or not v]
    total = {label: sum(x for *_, x, other in coded if other == label and x is not None) if any(x is not None for *_, x, other in coded if other == label) else None for *_, label in coded}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, total[label], digest) for i, code, error, label in coded)


def vectors(seed, n, size):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    return [(int(k), [float(np.float32(x)) for x in centres[k % 5] * 0.2 + rng.normal(size=size) * 0.05], [None, 1, 2][k % 3]) for k in rng.permutation(n)]


ODD = [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1), (904, [3.0] * 15, None), (905, [], 7), (906, [1e30, -1e30] * 8, 2), (None, [0.25] * 16, 9), (3, [0.1] * 16, 9), (3, [0.1] * 16, 9)]


@pytest.mark.parametrize("rows, cell", [(vectors(1, 300, 16) + ODD, 512), (vectors(2, 200, 24), 37), (vectors(3, 7, 16) + ODD, 512), (vectors(4, 60, 12), 4096), (ODD[:6], 512), (ODD[4:5] * 3, 512)])
def test_vector_codes_like_a_full_search(spark, rows, cell, monkeypatch):
    monkeypatch.setattr(vector_codes, "CELL", cell)
    monkeypatch.setattr(vector_codes, "HELD_CELLS", 50)
    df = spark.createDataFrame([(*r, "x", 1, [2]) for r in rows], "vec_id long, embedding array<float>, label int, id string, n long, v array<int>").repartition(3)
    got = Counter(tuple(r) for r in vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == codes_by_full_search(rows)


def test_vector_codes_of_nothing(spark):
    assert vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_cells_leave_out_entries_and_never_the_nearest():
    rng = np.random.default_rng(5)
    cells = vector_codes.Cells(rng.integers(-2000, 2000, size=(16, 4)))
    x = rng.integers(-2000, 2000, size=(3000, 4))
    every = ((x[:, None] - cells.book) ** 2).sum(axis=2)
    entry, distance = cells.nearest(x)
    assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and cells.candidates(x).mean() < 0.5
