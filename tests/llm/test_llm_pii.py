import hashlib
import math
import random
import re
import time
from collections import Counter

import regex
from llm_helpers import documents, make_docs
from pyspark.sql import functions as F

from tierloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "no data here", "a@b@c.d.e", "x.y_z@a-b.c..d", "a@b.c_d@e.f", ".@-.-", "é@b.c", "mail: Jöhn.Doe+x@mail.example.com, ok",
    "1.2.3.4.5.6.7.8", "0.00.000.0255 256.1.1.1 1.1.1", "01.002.3.4", "999.1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1111",
    "4111111111111111 4111111111111112", "1 2  3 4--5 6", "4111 1111 1111 1111 1111 1111", "5500 0000 0000 0004-", "00000000000000",
    "+1 (377) 555-0271.", "+1", "+12", "++123456789012", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "+49(30)1234567) x", "+1234567890+1234567890",
    "\U0001f600 a@b.co \U0001f600 +1 415 555 2671 \x01\x02\x03\x04 x@y.z 8.8.8.8", "1\x042 3", "a\x03b@c\x03d.e",
    "a" * 200_000, "a@" * 20_000, "1 " * 60_000, "1." * 60_000, "a." * 60_000 + "@" + "b." * 60_000 + "c", "+" * 50_000, "9" * 100_000,
    "- " * 1000 + "4111111111111111\n4111 1111\n1111 1111", "1.1.1.1" + " 2.2.2.2" * 300,
]


def spans_of(df):
    return {(r.doc_id, tuple((s.start, s.kind, s.end) for s in r.base)) for r in df.collect()}


def test_base_spans_against_the_plain_patterns(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "u@v.w")]
    got = pii.find_private(make_docs(spark, rows))
    assert spans_of(got) == {(i, tuple(base_spans(t))) for i, t in rows}
    assert got.count() == len(rows)


def test_query_columns(spark):
    from llm_helpers import SF01

    texts = {r.doc_id: r.text for r in documents(spark, SF01).collect()}
    kinds = list(PLAIN)
    for r in pii.op7_pii(spark, SF01).collect():
        spans = base_spans(texts[r.doc_id])
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


RANGES = "\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3041-\\u30FF\\u3400-\\u9FFF\\uF900-\\uFAFF\\U00020000-\\U0003FFFF"
UNBROKEN = regex.compile(rf"(?V1)[[{RANGES}]&&[\p{{L}}\p{{N}}]]+")
RUN = regex.compile(rf"(?V1)[[\p{{L}}\p{{N}}]--[{RANGES}]]+")


def term_places(text):
    out = [(m.start(), m.end()) for m in RUN.finditer(text) if regex.search(r"\p{L}", m[0])]
    for m in UNBROKEN.finditer(text):
        out += [(k, min(k + pii.PIECE, m.end())) for k in range(m.start(), m.end(), pii.PIECE)]
    return sorted(out)


def told(rows):
    """``{text: {(start, end, action)}}`` of all terms, by counting in Python."""
    texts = {t or "" for _, t in rows}
    n, n_t, n_e, n_et = len(texts), Counter(), Counter(), Counter()
    free, holds = {}, {}
    for text in texts:
        n_t.update({text[s:e].lower() for s, e in term_places(text)})
        spans = base_spans(text)
        free[text] = [(s, e) for s, e in term_places(text) if not any(s < y and x < e for x, _, y in spans)]
        holds[text] = {(kind, text[s:e].lower()) for s, kind, e in spans}
        n_e.update(holds[text])
        n_et.update((x, w) for x in holds[text] for w in {text[s:e].lower() for s, e in free[text]})
    classes = Counter(int(math.log2(k)) for k in n_t.values())
    score = {}
    for (entity, w), j in n_et.items():
        if n_e[entity] == n:
            continue
        k = int(math.log2(n_t[w]))
        most = min(2 ** (k + 1) - 1, n)
        tail = math.prod((most - i) * (n_e[entity] - i) / (n - i) / (i + 1) for i in range(j)) if j < 3 else math.exp(
            j * (1 + math.log(most) - math.log(j) + math.log(n_e[entity]) - math.log(n)))
        if classes[k] * tail <= pii.CHANCE:
            score[entity, w] = round(math.log(j * n / (n_e[entity] * n_t[w])) / math.log(n / n_e[entity]), 6)
    out = {}
    for text in texts:
        for s, e in free[text]:
            best = max((score.get((x, text[s:e].lower()), 0) for x in holds[text]), default=0)
            if best >= pii.GENERALISE:
                out.setdefault(text, set()).add((s, e, "remove" if best >= pii.REMOVE else "generalise"))
    return out


def found_terms(df):
    return {(r.doc_id, (s.start, s.end, s.value)) for r in df.collect() for s in r.spans if s.kind == len(pii.KINDS)}


def common_rows(n, first=10_000):
    rng = random.Random(first)
    return [(first + k, " ".join(f"c{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(3))}" for _ in range(20))) for k in range(n)]


STORY = [(n, f"Alice Wonder writes from a@b.org about common matters number {n}") for n in range(5)]
STORY += [(10 + n, f"common matters of somebody number {n}, who writes from home") for n in range(40)]
STORY += [(60, "Wonder about common things"), (61, None), (62, "reach x@y.zz or +1 415 555 2671 Zebra"), (3, STORY[3][1])]


def test_terms_against_brute_force(spark):
    """All words: rare and common entities, copies, secrets, scripts without
    word breaks, letters beside entities, names far from them."""
    rows = [*STORY, *common_rows(400)]
    rows += [(1000 + n, "Li " + "common words here " * 40 + f"mail q@r.st {n}") for n in range(2)]
    rows += [(1002, "Ng y@z.co common words"), (1003, "or common words"), (1004, "or here, xu5@b.org.Éa words")]
    rows += [(1010 + n, f"key AKIA77xyz9 for 10.1.2.{7} and 佐藤太郎様 x4111111111111111, {n} 123456 part{n}") for n in range(3)]
    rows += [(1015 + n, f"9912abc{n % 2}x 佐藤abc 007 ひらがなです {'1' * 5000} น้ำ a1b2 {n}") for n in range(3)]
    rows += [(1020, rows[-1][1]), (None, rows[-1][1])]
    rows += [(1030 + n, f"page {n} " + " ".join(f"m{k}@x.org" for k in range(5)) + " Zoe") for n in range(3)]
    want = told(rows)
    got = found_terms(pii.find_private(make_docs(spark, rows)))
    assert got == {(i, x) for i, t in rows for x in want.get(t or "", ())}
    texts = dict(rows)
    words = {(i, texts[i][s:e]) for i, (s, e, _) in got if i is not None}
    assert {(0, "Alice"), (1000, "Li"), (1001, "Li"), (1010, "AKIA77xyz9"), (1010, "佐藤太郎"), (1030, "Zoe")} <= words
    assert not {w for _, w in words} & {"xu5", "org", "123456"}


def test_terms_are_counted_without_a_row_for_text_and_term(spark):
    rows = [*STORY, *STORY[:4], (None, STORY[0][1]), *common_rows(20)]
    got = pii.term_documents(make_docs(spark, rows))
    want = Counter(w for t in {t or "" for _, t in rows} for w in {t[s:e].lower() for s, e in term_places(t)})
    assert sorted(r.n_t for r in got.collect()) == sorted(want.values())
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
    assert dealt and not [x for x in dealt if "key" in x and "term" in x]


def test_rare_words_meet_entities_by_chance(spark):
    """One-off words beside an email are no disclosure; a name that always
    comes with the address is one."""
    rng = random.Random(4)
    letters = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    rows = []
    for n in range(2500):
        text = " ".join([f"word{chr(97 + rng.randrange(20))}" for _ in range(15)] + [letters() for _ in range(3)])
        if n < 50:
            text += f" mail u{n // 2}@site.org" + (f" Mister{chr(65 + n // 2)}" if n < 20 else "")
        rows.append((n, text))
    got = found_terms(pii.find_private(make_docs(spark, rows)))
    words = {(i, rows[i][1][s:e]) for i, (s, e, _) in got}
    planted = {(n, f"Mister{chr(65 + n // 2)}") for n in range(20)}
    assert planted <= words
    assert len(words - planted) < 0.05 * 150


def test_many_matches_in_one_text(spark):
    """A hundred thousand matches, and a page of many addresses and words,
    in seconds: nothing grows with their square or their product."""
    mails = " ".join(f"a{n}@b.org" for n in range(100_000))
    page = " ".join(f"p{n}@q.org {chr(97 + n % 26)}w{n}" for n in range(20_000))
    docs = make_docs(spark, [(1, mails), (2, page), *common_rows(50)])
    start = time.time()
    sizes = {r.doc_id: r["size(base)"] for r in pii.find_private(docs).select("doc_id", F.size("base")).collect()}
    assert sizes[1] == 100_000 and sizes[2] == 20_000
    assert time.time() - start < 240  # minutes per 20,000, were it quadratic
    small = [(1, " ".join(f"a{n}@b.org" for n in range(3000)))]
    got = pii.find_private(make_docs(spark, small)).first()
    assert [(s.start, s.kind, s.end) for s in got.base] == base_spans(small[0][1])


def test_sanitise(spark):
    rows = [*STORY, STORY[0], *common_rows(300)]
    docs = make_docs(spark, rows)
    got = pii.sanitise(docs)
    clean = {r.doc.doc_id: r.clean_text for r in got.collect()}
    assert got.count() == len(rows)
    assert "Alice" not in clean[0] and "a@b.org" not in clean[0] and "<EMAIL>" in clean[0] and "common matters" in clean[0]
    assert clean[62] == "reach <EMAIL> or <PHONE> Zebra" and clean[61] == ""
    assert clean[60] == "Wonder about common things"
    assert pii.find_private(docs.limit(0)).count() == 0


def test_main_path_is_native(spark):
    plan = pii.find_private(make_docs(spark, STORY))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
