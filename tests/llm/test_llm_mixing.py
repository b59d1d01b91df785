import hashlib
from collections import Counter, defaultdict

import pytest
from llm_helpers import documents, make_docs, words
from pyspark.sql import functions as F

from tierloom.llm.mixing import WEIGHTS, document_sizes, fair_queue, mix_counts, mixed_documents, source_targets


def targets(sizes):
    """By the rule's own words: cut what is above, share it again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[n % 3] for n, s in enumerate(order)}
    target, open_, budget = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= above
    return target


def sized(spark, rows):
    return document_sizes(make_docs(spark, rows))


ROWS = [(n, "w " * (n % 17), f"s{n % 5}" if n % 3 else "s0") for n in range(300)]
ROWS += [(1000, None, "s1"), (1001, "a b", None), (1002, "c", None), (None, "d e f", "s2"), (7, "w " * 7, "s2"), (7, "w " * 7, "s2")]
ROWS += [(2000, "long " * 5000, "big"), (2001, "", "void")]


def test_targets(spark):
    for rows in (ROWS, ROWS[:1], [(1, "", "a"), (2, None, "b")], ROWS[:40]):
        sizes = Counter()
        for _, text, source in rows:
            sizes[source] += len(words(text))
        got = {r.source: (r.source_size, r.target) for r in source_targets(sized(spark, rows)).collect()}
        assert {s: v[0] for s, v in got.items()} == dict(sizes)
        assert {s: v[1] for s, v in got.items()} == pytest.approx(targets(sizes))


def brute(rows):
    """The queue by plain sorting."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    goal, queue, running = targets(sizes), [], defaultdict(int)
    place = lambda r: hashlib.md5(f"mix-1|{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()
    for epoch in (0, 1):
        for doc_id, text, source in sorted(rows, key=place):
            running[source] += len(words(text))
            if goal[source]:
                queue.append((running[source] / goal[source], place((doc_id, text)), epoch, doc_id, source, len(words(text))))
    left, taken = int(1.5 * sum(sizes.values())), Counter()
    for _, _, _, doc_id, source, size in sorted(queue, key=lambda q: q[:3]):
        left -= size
        if left >= 0:
            taken[doc_id, source] += size
    return +taken


def test_queue_against_plain_sorting(spark):
    rows = [r for r in ROWS if r[0] != 7] + [(7, "w " * 7, "s2")]
    counts = mix_counts(sized(spark, rows)).collect()
    got = Counter()
    for r in counts:
        got[r.doc_id, r.source] += r.copies * r.size
    assert +got == brute(rows)


def test_limits_and_repeats(spark):
    queue = fair_queue(sized(spark, ROWS))
    taken = defaultdict(int)
    for r in queue.where("taken").collect():
        taken[r.source] += r.size
    goals = {r.source: r.target for r in queue.select("source", "target").distinct().collect()}
    assert sum(taken.values()) <= 1.5 * sum(len(words(r[1])) for r in ROWS)
    for source, goal in goals.items():
        # Off by one document at most, and what documents too long for the
        # rest of the budget leave to the others in proportion.
        longest = max(len(words(r[1])) for r in ROWS if r[2] == source)
        assert abs(taken[source] - goal) <= longest + 0.05 * goal
    assert queue.count() == 2 * len(ROWS)


def test_mixed_documents_are_in_order_and_again_the_same(spark):
    docs = documents(spark)
    first, second = ([tuple(r) for r in mixed_documents(docs).select("doc_id", "epoch", "mix_position").collect()] for _ in range(2))
    assert first == second
    assert [r[2] for r in first] == sorted(r[2] for r in first)
    assert max(Counter(r[0] for r in first).values()) <= 2


def test_rows_without_ids_spread_over_the_order(spark):
    rows = [(None, f"text number {n}", "s0") for n in range(400)] + [(7, f"other {n}", "s1") for n in range(400)]
    places = [int(r.order[:8], 16) >> 28 for r in sized(spark, rows).collect()]
    assert len(Counter(places)) == 16 and max(Counter(places).values()) < 100
    got = mixed_documents(make_docs(spark, rows)).groupBy("source").count().collect()
    assert sum(r["count"] for r in got) > 800


def test_empty_table_and_clashing_columns(spark):
    assert mix_counts(sized(spark, [])).count() == 0
    docs = make_docs(spark, ROWS).withColumns({n: F.lit(1) for n in ("_queue_key", "place", "mix_position")})
    mixed = mixed_documents(docs)
    assert mixed.columns == [*[c for c in docs.columns if c not in ("epoch", "mix_position")], "epoch", "mix_position"]
    assert mixed.count() == fair_queue(sized(spark, ROWS)).where("taken").dropDuplicates(["doc_id", "source", "tie", "epoch"]).join(
        document_sizes(docs).groupBy("doc_id", "source", "tie").count(), ["doc_id", "source", "tie"], "left").selectExpr("sum(coalesce(count, 1))").first()[0]
    assert mixed_documents(docs.limit(0)).count() == 0
