import random

import numpy as np
from llm_helpers import documents, lower, make_docs, rows_of, words

from tierloom.llm import near_dedup
from tierloom.llm.graph import connected_components
from tierloom.llm.near_dedup import drop_near_duplicates, near_duplicates


def shingle_set(text, width):
    cut = words(lower(text or ""))
    return frozenset(tuple(cut[k : k + width]) for k in range(max(1, len(cut) - width + 1))) if cut else frozenset()


def brute(rows, width, percent=80):
    """``(doc_id, n_shingles, component_id, kept)`` from all pairs."""
    sets = [shingle_set(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                group[root(a)] = root(b)
    names = {}
    for n, (doc_id, _) in enumerate(rows):
        names.setdefault(root(n), []).append(doc_id)
    out = []
    for n, (doc_id, _) in enumerate(rows):
        known = [x for x in names[root(n)] if x is not None]
        component = doc_id if not sets[n] else min(known) if known else None
        out.append((doc_id, len(sets[n]), component, doc_id == component))
    return sorted(out, key=repr)


def edited(rng, base, changes):
    cut = list(base)
    for at in rng.sample(range(len(cut)), changes):
        cut[at] = f"e{rng.randrange(10**6)}"
    return " ".join(cut)


def crafted():
    rng = random.Random(1)
    vocabulary = [f"w{n}" for n in range(3000)]
    rows, n = [], 0
    for size, length, most in ((40, 200, 9), (12, 60, 4), (5, 30, 1), (30, 120, 12)):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            rows.append((n, edited(rng, base, rng.randrange(most))))
            n += 1
        rows += [(n + k, " ".join(base).upper()) for k in range(6)]  # copies
        n += 6
    base = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(12):  # too far from their base to link, but close to copies of their own
        variant = edited(rng, base, rng.randrange(5, 14)).split()
        for _ in range(4):
            rows.append((n, edited(rng, variant, rng.randrange(4))))
            n += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    rows += [(n + k, passage + " " + edited(rng, vocabulary[k * 20 : k * 20 + 40], 5)) for k in range(40)]
    n += 40
    rows += [(n, "one two"), (n + 1, "One\ttwo"), (n + 2, "two one"), (n + 3, ""), (n + 4, None), (n + 5, " \n ")]
    rows += [(None, "one two"), (None, "null alone here now and then"), (n, "one two"), (n + 3, "")]
    return rows


def test_against_all_pairs(spark):
    rows = crafted()
    got = near_duplicates(make_docs(spark, rows), words=4)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute(rows, 4)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = near_duplicates(documents(spark), words=4)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute(rows, 4)


def test_one_document_of_each_group_stays(spark):
    rows = crafted()
    docs = make_docs(spark, rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    first = {b[0] for b in brute(rows, 5) if b[3]}
    want = {(i, t) for i, t in rows if i is not None and i in first}
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert {x for x in got if x[0] is not None} == want
    assert (None, "null alone here now and then") in got and (None, "one two") not in got
    assert kept.where("text = 'one two'").count() == 1


def test_join_rows_grow_with_a_family_not_with_its_pairs(spark):
    """Classes of one component that share every shingle are never paired,
    with a stranger among them they are paired with it alone."""
    made = {}
    for n in (100, 200):
        heads = [(0, s, k, 50, 7, 40, 9) for k in range(n) for s in range(20)] + [(0, s, 10_000 + s % 2, 50, 8 + s % 2, 40, 9) for s in range(5)] + [(0, s, 20_000, 50, 10, 20, 9) for s in range(20)]
        rows = spark.createDataFrame(heads, "hub long, shingle long, node long, n long, component long, inside long, shared long")

        def side(frame, end, *keys):
            names = {"node": end, "n": f"n_{end}", "component": f"comp_{end}", "inside": f"in_{end}", "shared": f"out_{end}"}
            return frame.selectExpr(*keys, *[f"{a} AS {b}" for a, b in names.items()])

        def needed(a, b):
            return near_dedup.F.ceil(80 * (near_dedup.F.col(a) + near_dedup.F.col(b)) / 180)

        pairs = near_dedup._across(rows, rows, side, needed, "hub", "shingle")
        assert {tuple(sorted((r.comp_a, r.comp_b))) for r in pairs.collect()} == {(7, 8), (7, 9)}
        made[n] = pairs.count()
        assert near_dedup._across(rows.where("node < 10000"), rows.where("node < 10000"), side, needed, "hub").count() == 0
    assert made == {100: 500, 200: 1000}


def _side(frame, end, *keys):
    names = {"node": end, "n": f"n_{end}", "component": f"comp_{end}", "inside": f"in_{end}", "shared": f"out_{end}"}
    return frame.selectExpr(*keys, *[f"{a} AS {b}" for a, b in names.items()])


def test_classes_meet_only_components_that_they_can_link_with(spark):
    """One class of a component may link with a stranger; the hundred others
    of it have too little in common with the hub to meet it."""
    heads = [(0, 1, 1, 50, 7, 40, 9), (0, 1, 900, 50, 9, 40, 9)] + [(0, 1, 10 + k, 50, 7, 20, 1) for k in range(100)]
    rows = spark.createDataFrame(heads, "hub long, shingle long, node long, n long, component long, inside long, shared long")

    def needed(a, b):
        return near_dedup.F.ceil(80 * (near_dedup.F.col(a) + near_dedup.F.col(b)) / 180)

    pairs = near_dedup._across(rows, rows, _side, needed, "hub", "shingle").collect()
    assert [(r.a, r.b) for r in pairs] == [(1, 900)]


def test_shingles_of_one_component_are_not_spread(spark, monkeypatch):
    """A family far from its hub shares its edits with itself only: nothing
    is written for them but for a pair that a stranger makes with one of it."""
    members, family = {0: range(100), 500: [*range(30, 100), *range(2000, 2030)], 600: [*range(20, 100), *range(1000, 1020)]}, range(1, 61)
    members |= {k: [*range(20, 100), *range(1000, 1020), *range(5000 + 10 * k, 5003 + 10 * k)] for k in family}
    component = {k: 1 for k in family}
    sets = [(k, near_dedup.np.array(sorted(x), near_dedup.np.uint64).tobytes()) for k, x in members.items()]
    sets = spark.createDataFrame(sets, "node long, shingles binary")
    linked = spark.createDataFrame(list(component.items()), "node long, component long")
    written, rows = near_dedup.written, []

    def counted(df, name, **more):
        out = written(df, name, **more)
        rows.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)

    def met(*nodes):
        stars = [(1, k, len(members[k]), component.get(k, k), 0, 100) for k in nodes]
        stars = spark.createDataFrame(stars, "bucket long, node long, n long, component long, hub long, hub_n long")
        return {(r.a, r.b) for r in near_dedup._met(stars, linked, sets, 80).collect()}

    assert met(*family, 500) == set()
    assert max(rows) <= len(family) + 1
    assert met(*family, 500, 600) == {(k, 600) for k in family}


def test_classes_spread_only_their_first_shingles_outside_the_hub(spark, monkeypatch):
    """Of 37 shingles that a class shares outside its hub, 29 are needed: the
    rarest 9 tell its twin, a passage of all is never spread."""
    classes, shared = 60, [*range(60), *range(1000, 1025)]
    members = {0: [*range(100)]}
    for k in range(1, classes + 1):
        twins = 10_000 + 100 * ((k + 1) // 2)
        members[k] = [*shared, *range(twins, twins + 12), *range(50_000 + 10 * k, 50_003 + 10 * k)]
    sets = [(k, near_dedup.np.array(sorted(x), near_dedup.np.uint64).tobytes()) for k, x in members.items()]
    sets = spark.createDataFrame(sets, "node long, shingles binary")
    stars = [(1, k, len(members[k]), k, 0, 100) for k in range(1, classes + 1)]
    stars = spark.createDataFrame(stars, "bucket long, node long, n long, component long, hub long, hub_n long")
    linked = spark.createDataFrame([], "node long, component long")
    written, rows = near_dedup.written, []

    def counted(df, name, **more):
        out = written(df, name, **more)
        rows.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    met = {(r.a, r.b) for r in near_dedup._met(stars, linked, sets, 80).collect()}
    assert met == {(k, k + 1) for k in range(1, classes, 2)}
    assert max(rows) <= 9 * classes


def test_a_family_beside_a_bigger_one(spark):
    rng = random.Random(9)
    vocabulary = [f"w{n}" for n in range(900)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for size in (60, 30):
        base = passage + [rng.choice(vocabulary) for _ in range(60)]
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(6))) for k in range(size)]
    assert rows_of(near_duplicates(make_docs(spark, rows), words=4), "doc_id", "n_shingles", "component_id", "kept") == brute(rows, 4)


def test_no_name_of_the_input_clashes(spark):
    docs = make_docs(spark, crafted()[:20]).withColumns({n: near_dedup.F.lit(5) for n in ("_near_key", "doc", "key")})
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["_near_key"] for r in kept.collect()} == {5}


def test_empty_table(spark):
    assert near_duplicates(make_docs(spark, [])).count() == 0
    assert drop_near_duplicates(make_docs(spark, [(1, ""), (2, None)])).count() == 2


def test_signature_is_circulant_and_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2**63, 400).astype(np.uint64)])
    sign = near_dedup.signatures([a, b, a[:0]], 512)
    assert abs((sign[0] == sign[1]).mean() - 1600 / 2400) < 0.08
    assert (sign[2] == 0xFFFFFFFF).all()
    places = near_dedup._spread(a)
    assert sign[0, 5] == near_dedup._rank(places - np.uint32(5)).min()
    every = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65_537)
    assert len(np.unique(near_dedup._rank(every))) == 1 << 16


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3), (500, 400), (400, 500)]
    links += [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    group = {}
    for a, b in links:
        if a is not None and a != b:
            group.setdefault(a, a), group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a is not None and a != b and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    assert got == group
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
