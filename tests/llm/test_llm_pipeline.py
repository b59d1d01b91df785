"""Each stage of the pipeline on its own input, against brute force."""

import pytest
from llm_helpers import SF01, documents, lower, make_docs
from test_llm_decontamination import leaked
from test_llm_line_dedup import brute as brute_lines
from test_llm_near_dedup import brute as brute_near
from test_llm_quality import rule_verdicts

import corpus_pipeline as P


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_stage_by_stage(spark, tmp_path):
    docs, sf_dir = documents(spark, SF01), SF01
    columns = docs.columns
    benchmark = [r.text for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, rows = texts(docs), docs.collect()
        if name != "mixing":
            assert out.columns == columns
            assert all(r.n_chars == len(r.text) for r in out.collect())
            after = texts(out)
        if name == "quality_rules":
            verdicts = rule_verdicts([(r.doc_id, r.text, r.source) for r in rows], 10, 30)
            assert set(after) == {v[0] for v in verdicts if v[-1]}
            assert sum(before[i] == t for i, t in after.items()) > 0.5 * len(after)
        elif name == "line_dedup":
            classes = {i: c for i, _, c, _ in brute_near(list(before.items()), 5)}
            assert after == {i: t for i, t, _, _ in brute_lines(list(before.items()), 10, 1, classes)}
        elif name == "near_dedup":
            assert after == {i: before[i] for i, _, _, kept in brute_near(list(before.items()), 5) if kept}
        elif name == "decontamination":
            gone = set(before) - set(after)
            exact = {i for i, t in before.items() if any(" ".join(lower(b).split()) in " ".join(lower(t).split()) for b in benchmark)}
            assert exact <= gone
            assert all(any(leaked(b, before[i]) for b in benchmark) for i in gone)
        else:
            assert set(texts(out)) <= set(before)
            assert {*columns, "epoch", "mix_position"} == set(out.columns)
        docs = out


def test_odd_rows_pass_every_stage(spark, tmp_path):
    own = " ".join(f"word{n}" for n in range(80))
    rows = [(1, own, "a", "en"), (1, own, "a", "en"), (2, None, None, None), (None, own + " more", "a", None), (3, "", "a", "xx"), (4, own.replace("1", "q"), None, "en")]
    docs = make_docs(spark, rows)
    for empty in (False, True):
        df = docs.limit(0) if empty else docs
        for name, stage in P.STAGES:
            out = stage(spark, df, SF01)
            out.write.parquet(str(tmp_path / f"{name}{empty}"))
            df = spark.read.parquet(str(tmp_path / f"{name}{empty}"))
        assert (df.count() == 0) == empty


def test_copies_reach_near_dedup_whole(spark):
    """A group of copies keeps its lines, boilerplate of distinct documents goes."""
    copy = "\n".join(" ".join(f"copy{n}x{k}" for k in range(12)) for n in range(5))
    own = {n: " ".join(f"own{n}x{k}" for k in range(60)) for n in range(100, 112)}
    rows = [(n, copy if n % 2 else copy.upper() + "\n", f"s{n}", "en") for n in range(25)]
    rows += [(n, f"{text}\nmenu", f"s{n}", "en") for n, text in own.items()]
    cleaned = P.line_dedup(spark, make_docs(spark, rows), SF01)
    assert texts(cleaned) == {n: own.get(n, text) for n, text, *_ in rows}
    kept = texts(P.near_dedup(spark, cleaned, SF01))
    assert kept == {0: rows[0][1], **own}


@pytest.mark.parametrize("edit", ["line", "lines"])
def test_a_family_of_near_copies_reaches_the_end_whole(spark, edit):
    """20 copies with 30 lines in common and lines of their own are one text
    in the end; boilerplate of unlike documents still goes."""
    shared = [" ".join(f"fam{n}x{k}" for k in range(8)) for n in range(30)]
    rows = []
    for n in range(20):
        own = f"own line of copy {n} and nothing else"
        lines = [*shared, own] if edit == "line" else [own, *shared[: n % 3], *shared[n % 3 + 1 :], f"the end {n}"]
        rows.append((n, "\n".join(lines), f"s{n}", "en"))
    own = {n: "\n".join(" ".join(f"own{n}x{k}x{j}" for k in range(12)) for j in range(6)) for n in range(100, 115)}
    rows += [(n, f"{text}\nmenu of the site", f"s{n}", "en") for n, text in own.items()]
    docs, before = make_docs(spark, rows), {n: text for n, text, *_ in rows}
    for name, stage in P.STAGES[:4]:
        docs = stage(spark, docs, SF01)
        if name == "line_dedup":
            assert texts(docs) == {n: own.get(n, text) for n, text in before.items()}
    after = texts(docs)
    assert after == {0: before[0], **own}


def test_run_reads_the_tables(spark):
    assert {"doc_id", "text", "epoch"} <= set(P.run(spark, "/root/testdata/sf0.001").columns)
