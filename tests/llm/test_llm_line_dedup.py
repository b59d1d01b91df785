import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import lower, make_docs, rows_of

from tierloom.llm.line_dedup import dedup_lines, document_key
from tierloom.llm.perfect_hash import CountIndex

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_docs, min_chars, classes=None):
    """``classes``: what each id counts as, instead of as itself."""
    keys = [[lower(x.strip(BLANKS)) for x in (t or "").split("\n")] for _, t in rows]
    pairs = ((k, n if classes is None else classes[rows[n][0]]) for n, each in enumerate(keys) for k in set(each))
    docs = Counter(k for k, _ in set(pairs) if len(k) >= min_chars)
    out = []
    for (doc_id, text), each in zip(rows, keys):
        kept = [x for x, k in zip((text or "").split("\n"), each) if len(k) < min_chars or docs[k] < min_docs]
        out.append((doc_id, "\n".join(kept), len(each), len(each) - len(kept)))
    return sorted(out, key=repr)


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_index_gives_every_count_and_knows_strangers(keys, others):
    keys = np.array(sorted(keys), np.uint64)
    counts = (np.arange(len(keys)) % 200).astype(np.uint8) + 1
    index = CountIndex.from_bytes(CountIndex.build(keys, counts).to_bytes())
    assert sorted(index._places(keys)) == list(range(len(keys)))  # minimal and perfect
    assert index.lookup(keys).tolist() == counts.tolist()
    strangers = np.array(sorted(others - set(keys.tolist())), np.uint64)
    assert index.lookup(strangers).sum() == 0


def test_against_brute_force(spark):
    rows = [(n, f"Menu \nown line {n}\n\tMENU\n" + ("shared" if n < 4 else "") + "\nÉté\x0b") for n in range(12)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "menu"), (None, "menu\nnull id"), (5, "menu"), (5, "menu")]
    rows += [(200, "été\n" + "x" * 200_000 + "\nmenu\n" * 3), (201, "ÉTÉ"), (202, "own\x00line")]
    for min_docs, min_chars in ((10, 1), (4, 1), (2, 5), (1, 1)):
        got = dedup_lines(make_docs(spark, rows), min_docs, min_chars)
        assert rows_of(got, "doc.doc_id", "kept_text", "n_lines", "n_dropped") == brute(rows, min_docs, min_chars)
        assert got.select("doc.*").columns == make_docs(spark, rows[:1]).columns


def test_cold_lines_go_through_the_shards(spark, monkeypatch):
    """With no line hot, every dropped line is found by the probes."""
    from tierloom.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    rows = [(n, f"a\nb{n % 2}\nc{n % 3}\nd{n}") for n in range(30)]
    got = dedup_lines(make_docs(spark, rows), 10, 1)
    assert rows_of(got, "doc.doc_id", "kept_text", "n_lines", "n_dropped") == brute(rows, 10, 1)


def test_a_line_counts_once_per_class(spark):
    """Documents of one class are one; those of none are each their own."""
    rows = [(n, f"a\nb{n % 2}\nc\nown{n}") for n in range(30)] + [(99, None), (98, "c\nd")]
    docs = make_docs(spark, rows)
    keys = {r.doc_id: r.key for r in docs.select("doc_id", document_key(docs).alias("key")).collect()}
    of = {n: 1 if n < 12 else 2 if n < 22 else None for n in keys}
    classes = spark.createDataFrame([(keys[n], c) for n, c in of.items() if c is not None] * 2, "key long, class long")
    counted = {n: (n, 0) if c is None else c for n, c in of.items()}
    for min_docs in (2, 5, 10, 11):
        got = dedup_lines(docs, min_docs, 1, classes)
        assert rows_of(got, "doc.doc_id", "kept_text", "n_lines", "n_dropped") == brute(rows, min_docs, 1, counted)


def test_empty_table(spark):
    assert dedup_lines(make_docs(spark, [])).count() == 0


def test_query_columns(spark):
    from llm_helpers import SF001, documents

    from tierloom.llm.registry import QUERIES

    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(list(texts.items()), 10, 1)}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op1_line_dedup"](spark, SF001).collect()}
    assert got == want
