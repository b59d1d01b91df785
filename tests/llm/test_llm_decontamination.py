import random
import tracemalloc
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import documents, make_docs, rows_of

from tierloom.llm import decontamination as D


def distance_inside(pattern, text):
    """Fewest edits of a pattern against any stretch of a text."""
    row = [0] * (len(text) + 1)
    for p in pattern:
        new = [row[0] + 1]
        for k, t in enumerate(text):
            new.append(min(row[k] + (p != t), row[k + 1] + 1, new[k] + 1))
        row = new
    return min(row)


@lru_cache(None)
def leaked(item, text):
    """By the rule alone: some window of the item occurs within the budget."""
    text = " ".join(text.lower().split())
    item = " ".join(item.lower().split())
    if len(item) < D.Q:
        return bool(item) and item == text
    m = min(len(item), D.WINDOW)
    starts = {*range(0, len(item) - m + 1, max(1, m // 2)), len(item) - m}
    return any(distance_inside(item[s : s + m], text) <= min(int(m * D.ERROR), (m - D.Q) // D.Q) for s in starts)


def mutate(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcdefghij ")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("abcdefghij "))
    return "".join(out)


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    items = [(k, prose(rng, rng.choice((12, 30, 60)))) for k in range(12)] + [(90, "short one"), (91, None), (92, "")]
    items += [(93, "What is  it?"), (94, "a question of thirty letters x"), (95, "yes"), (96, items[2][1]), (97, "  ")]
    rows, n = [], 0
    for _, item in items[:12]:
        for edits in (0, 2, 5, 8, 15):
            rows.append((n, prose(rng, 40) + "\n" + mutate(rng, item.upper() if n % 2 else item, edits) + " " + prose(rng, 20)))
            n += 1
        rows.append((n, prose(rng, 20) + " " + item[len(item) // 2 :] + " " + prose(rng, 5)))
        rows.append((n + 1, item.replace(" ", " \n\t")))
        n += 2
    rows += [(600, "so WHAT is\nit? he said"), (601, "short ONE"), (602, "a short one"), (603, " Yes\n"), (604, "yes yes")]
    rows += [(605, "x a question of thirty letters x y"), (606, "x a qestion of thirty leters x y"), (607, "x a qestion of thirty letters x y")]
    return items, rows + [(500, None), (501, ""), (502, "x"), (None, "head " + items[0][1]), (503, prose(rng, 400))]


def test_against_the_rule_alone(spark):
    items, rows = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(make_docs(spark, rows), benchmark).collect()}
    want = {(d, i) for d, text in rows for i, item in items if text and item and leaked(item, text)}
    assert want == got
    assert len(want) > 40


def test_long_texts_blocks_and_repeats(spark, monkeypatch):
    items, rows = corpus()
    rng = random.Random(6)
    far = prose(rng, 3000)
    long_text = far + " " + items[3][1] + " " + far + items[4][1]
    monkeypatch.setattr(D, "PIECE_CHARS", 3000)
    monkeypatch.setattr(D, "BLOCK_CHARS", 500)
    index = D.BenchmarkIndex([(3, items[3][1]), (4, items[4][1])])
    found = D.search_texts([index], ["", long_text, None, "x", long_text])
    assert {k for k in found} == {(1, 3), (1, 4), (4, 3), (4, 4)}
    start, end, edits = found[1, 3]
    assert edits == 0 and long_text[start:end].strip() == items[3][1]
    got = D.find_leaks(make_docs(spark, [(1, long_text), (1, long_text), (2, "clean " * 50)]), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got, "doc_id", "item_id") == [(1, 3), (1, 3), (1, 4), (1, 4)]


def test_clean_documents_stay(spark):
    items, rows = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(spark, rows + rows[:2] + [(9000, "a clean text " * 9), (9000, rows[0][1])])
    kept = D.decontaminate(docs, benchmark)
    bad = {(r.doc_id, r.key) for r in D.find_leaks(docs, benchmark).collect()}
    assert kept.columns == docs.columns
    assert bad and kept.count() == docs.count() - sum(1 for i, t in [*rows, *rows[:2], (9000, rows[0][1])] if t and any(leaked(b, t) for _, b in items if b and len(b) >= D.EVIDENCE_CHARS))
    assert kept.where("doc_id = 9000").count() == 1
    assert D.decontaminate(docs, benchmark.limit(0)).count() == docs.count()
    assert D.decontaminate(docs.limit(0), benchmark).count() == 0


def test_repeated_characters(spark):
    """Rulers in items and in texts: the same answers, in bounded memory."""
    rng = random.Random(8)
    items = [(1, "-" * 130), (2, "ab" * 60), (3, prose(rng, 10) + "=" * 80), (4, "-" * 60 + prose(rng, 20)), (5, "abc" * 40)]
    rows = [(1, "x" + "-" * 95 + "y"), (2, "-" * 300), (3, "ab" * 47), (4, "ba" * 44), (5, items[2][1][:98]), (6, "-" * 55 + items[3][1][60:] + "!")]
    rows += [(7, "--" + "ab" * 30 + "-" * 60), (8, "abc" * 32 + "ab" * 2), (9, prose(rng, 30) + items[3][1][40:])]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(make_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, text in rows for i, item in items if leaked(item, text)}
    index = D.BenchmarkIndex([(k, "-" * 400) for k in range(5)])
    assert len(index.text) == 1 and len(index.grams) == 1
    for n in (80_000, 160_000):
        tracemalloc.start()
        assert {k for k in D.search_texts([index], ["-" * n])} == {(0, k) for k in range(5)}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400e6, (n, peak)


def test_no_match_over_two_documents():
    """An item cut in two is in neither half, however they are read."""
    item = prose(random.Random(3), 14)[:70]
    index = D.BenchmarkIndex([(1, item)])
    assert D.search_texts([index], ["x " + item[:35], item[35:] + " y", item[:35] + item[35:]]).keys() == {(2, 1)}


def test_counting_stretch_by_stretch_changes_nothing(monkeypatch):
    items, rows = corpus()
    indexes = [D.BenchmarkIndex([(k, x) for k, x in items if x])]
    texts = [t for _, t in rows] + [" ".join(t for _, t in rows if t)]
    want = D.search_texts(indexes, texts)
    monkeypatch.setattr(D, "MAX_PAIRS", 10)
    assert D.search_texts(indexes, texts) == want


def test_blocks_of_one_scan_and_of_several(spark, monkeypatch):
    items, rows = corpus()
    docs, benchmark = make_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = rows_of(D.find_leaks(docs, benchmark), "doc_id", "item_id", "start", "end", "edits")
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    for several in (2, 100):
        monkeypatch.setattr(D, "SCAN_BLOCKS", several)
        assert rows_of(D.find_leaks(docs, benchmark), "doc_id", "item_id", "start", "end", "edits") == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_banded_alignment_is_exact_within_the_budget(seed):
    rng = random.Random(seed)
    pattern = "".join(rng.choice("abc ") for _ in range(rng.randrange(40, 100)))
    k = int(len(pattern) * D.ERROR)
    lead = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30)))
    text = lead + mutate(rng, pattern, rng.randrange(0, k + 3)) + "".join(rng.choice("abcd") for _ in range(10))
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    true = distance_inside(pattern, text)
    found = D.banded_alignment(code(pattern)[None, :], code(text), np.array([len(lead) - 2 * max(k, 1)]), k)[1][0]
    assert found >= true
    if true <= k:
        assert found == true


def test_given_documents(spark):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(documents(spark), benchmark).collect()}
    items = benchmark.collect()
    exact = {(d.doc_id, i.item_id) for d in documents(spark).collect() for i in items if i.text in d.text}
    assert exact <= got
