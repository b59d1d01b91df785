"""Personal data: fixed patterns, and terms that give an entity away.

Main path in DataFrame functions only.

The patterns find *entities*: email addresses, IP addresses, card numbers
and phone numbers. Other words can disclose an entity too: if a term stands
in documents with it and hardly anywhere else in the corpus, then naming the
term names the entity. How much it discloses is measured by information: the
pointwise mutual information of term and entity over the documents of the
corpus, as a share of what the entity itself carries::

    disclosure(t, e) = log(p(e, t) / (p(e) p(t))) / -log p(e)

It is 1 where the term never occurs without the entity, and about 0 where
they are independent. A term in a document with an entity is *generalised*
(to a placeholder) from ``GENERALISE`` on and *removed* from ``REMOVE`` on.

A rare term always meets something: a word of one document has a disclosure of
1 for whatever entity is there. What counts is how many words *could* have met
the entity so often by chance. Of the V words whose document frequency is of
the term's class (a power of two), at most ``V * P`` are expected in as many of
the entity's documents if words and entities are independent; P is the union
bound of the hypergeometric tail. A pair counts only if that is at most
``CHANCE`` words. This one test holds for all pairs: a name that always comes
with a number passes where few words are as rare, one of many one-off words
does not.

Terms are runs of letters and digits with a letter, anywhere in the document
(so keys and tokens are terms); scripts without word breaks are cut into
pieces of at most ``PIECE`` characters. Documents of equal text count once,
since copies meet again by being copies. All probabilities are taken over all
distinct texts. Near copies should go first (``near_dedup``).

Positions without a position function: matches are put between marker
characters, the text is split there, and lengths are added up. The patterns
are written so that each reads a text in linear time and without deep
recursion, also in very long runs of letters, digits or dots; they give the
same matches as the plain forms. Inner dots and separators are first
written as control characters (one for one, so positions stay), which turns
the repeated groups into plain character runs; a text's own control
characters of that kind become another one.

Defined cases: null text is empty and has no spans; repeated rows each get
the spans of their text; terms overlap no entity; null ids are kept; an
empty table gives no rows; other columns are ignored.

Scale: one pass finds entities, and terms where there are some; one pass
counts terms, after a shuffle of the texts that leaves one of each. Entities
and terms are shuffled as 64-bit hashes, counts of terms summed per task. Entities that
stand in the same texts are one class, told apart by no count, so a page of
many one-off entities is one class and meets its terms once each; pairs of
class and term are summed per task before the shuffle, so an entity or term
found in a third of all rows meets in no single task. But for the count,
texts are shuffled only if they have entities (and in ``sanitise``, which joins
spans to their texts).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.llm.storage import columns_of, table, text_key, written

# Fixed values of op7's base rules.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: Characters of a term in scripts without word breaks.
PIECE = 4
# Thai, Lao, Myanmar, Khmer, Kana, Han: as ranges, which are far quicker to
# test than scripts.
_UNBROKEN = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
_LETTER, _RUN = (rf"[{x}&&[^{_UNBROKEN}]]" for x in (r"\p{L}", r"\p{L}\p{N}"))
_PIECES = rf"[{_UNBROKEN}&&[\p{{L}}\p{{N}}]]{{1,{PIECE}}}"
#: Digits before the first letter are taken whole or not at all, so that a
#: long number is read once.
TERM_PATTERN = rf"{_PIECES}|(?:(?<!\p{{N}})\p{{N}}++)?+{_LETTER}{_RUN}*+"
#: Words that may meet an entity so often by chance, at most.
CHANCE = 0.05
GENERALISE = 0.8
REMOVE = 0.95

_MARK, _OTHER, _DOT, _SEP, _HIDDEN = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
_LOCAL = r"A-Za-z0-9._%+\-" + _DOT
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9\-]++{_DOT}[A-Za-z0-9\-{_DOT}]++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{_SEP}]++"
_PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
_SMALL = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_FREE_TERM = rf"{_PIECES}|(?<![{_RUN}{_HIDDEN}])(?:\p{{N}}++)?+{_LETTER}{_RUN}*+(?!{_HIDDEN})"
_IP_OK = rf"^{_SMALL}\.{_SMALL}\.{_SMALL}\.{_SMALL}$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit doubled, 9 less where above 9."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, n: F.when(n % 2 == 0, c.cast("int"))
        .when(c.cast("int") > 4, c.cast("int") * 2 - 9)
        .otherwise(c.cast("int") * 2),
    )
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_IP_OK)
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(14, 19) & F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


_SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(text: Column, pattern: str) -> Column:
    """The text split around the matches: every second piece is one."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)


#: Pieces that are added up at once (even, so that each block begins outside).
_BLOCK = 512


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Matches of a pattern in a text as ``(start, end, kind, value)``.

    Places are running totals of the pieces' lengths. An array that grows is
    copied at each step, so they are taken in two levels, over blocks of
    pieces and within a block: a text of a hundred thousand matches copies
    some hundred elements at a time.
    """

    def within(block: Column, start: Column) -> Column:
        empty = F.struct(start.cast("bigint").alias("at"), F.lit(False).alias("odd"), F.array().cast(_SPAN).alias("found"))

        def step(done: Column, piece: Column) -> Column:
            end = done["at"] + F.length(piece)
            span = F.struct(done["at"].alias("start"), end.alias("end"), F.lit(kind).alias("kind"), piece.alias("value"))
            wanted = done["odd"] if keep is None else done["odd"] & keep(piece)
            found = F.when(wanted, F.concat(done["found"], F.array(span))).otherwise(done["found"])
            return F.struct(end.alias("at"), (~done["odd"]).alias("odd"), found.alias("found"))

        return F.aggregate(block, empty, step, lambda done: done["found"])

    def starts(blocks: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        size = lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda n, piece: n + F.length(piece))
        step = lambda done, block: F.struct(
            (done["at"] + size(block)).alias("at"), F.concat(done["all"], F.array(done["at"])).alias("all")
        )
        return F.aggregate(blocks, first, step, lambda done: done["all"])

    def cut(pieces: Column) -> Column:
        count = F.ceil(F.size(pieces) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.slice(pieces, n * _BLOCK + 1, _BLOCK))

    blocks = lambda pieces: _let(cut(pieces), lambda x: F.flatten(F.zip_with(x, starts(x), within)))
    return _let(_pieces(text, pattern), blocks)


def _inner_dots(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[A-Za-z0-9\-])\.(?=[A-Za-z0-9\-])", _DOT)


def entities(text: Column) -> Column:
    """All base spans of a text without markers, by kind and then start."""
    inner_seps = F.regexp_replace(text, r"(?<=[0-9])[\x20\-](?=[0-9])", _SEP)
    forms = {
        "email": (text.contains("@"), _inner_dots(text), _EMAIL),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), text, _IP),
        "card": (text.rlike(r"[0-9][0-9\x20\-]{13}"), inner_seps, _CARD),
        "phone": (text.contains("+"), text, _PHONE),
    }
    each = [
        F.when(maybe, _spans(form, pattern, n, lambda m, kind=kind: _valid(kind, m))).otherwise(F.array().cast(_SPAN))
        for n, (kind, (maybe, form, pattern)) in enumerate(forms.items())
    ]
    return F.concat(*each)


def _unmarked(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for mark in (_MARK, _DOT, _SEP, _HIDDEN):
        text = F.replace(text, F.lit(mark), F.lit(_OTHER))
    return text


def _masked(text: Column) -> Column:
    """The text, with the letters and digits of entities as control
    characters, one for one."""
    seps = lambda text: F.regexp_replace(text, r"(?<=[0-9])[\x20\-](?=[0-9])", _SEP)
    forms = {"email": (_inner_dots, _EMAIL), "ip": (lambda x: x, _IP), "phone": (lambda x: x, _PHONE), "card": (seps, _CARD)}
    for kind, (form, pattern) in forms.items():
        text = F.array_join(F.transform(_pieces(form(text), pattern), _hiding(kind)), "")
    return text


def _hiding(kind: str) -> Callable[[Column, Column], Column]:
    def hide(piece: Column, n: Column) -> Column:
        hidden = F.regexp_replace(piece, r"[\p{L}\p{N}]", _HIDDEN)
        return F.when((n % 2 == 1) & _valid(kind, piece), hidden).otherwise(piece)

    return hide


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _terms(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _term))


def entity_spans(documents: DataFrame) -> DataFrame:
    """``doc_id, key, base, masked, entities, terms``: the base spans of every
    document; if it has some, its text without them, and its distinct entities
    and terms as hashes."""
    rows = documents.select("doc_id", text_key(F.col("text")).alias("key"), _unmarked(F.col("text")).alias("body"))
    found = rows.withColumn("base", entities(F.col("body")))
    found = found.withColumn("masked", F.when(F.size("base") > 0, _masked(F.col("body"))))
    entity = lambda s: F.xxhash64(F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"])))
    named = F.array_distinct(F.transform("base", entity))
    return found.select("doc_id", "key", "base", "masked", named.alias("entities"), _terms(F.col("masked"), _FREE_TERM).alias("terms"))


def term_documents(documents: DataFrame) -> DataFrame:
    """``term, n_t``: distinct texts that hold each term (by its hash).

    Copies meet as texts, before they are cut: a text is half the size of its
    pairs of key and term.
    """
    once = documents.select(text_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    terms = once.select(F.explode(_terms(_unmarked(F.col("text")), TERM_PATTERN)).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def entity_classes(found: DataFrame) -> DataFrame:
    """``key, class, n_e``: the classes of entities in each text, and in how
    many texts those entities stand. Entities of one class stand in the same
    texts, which is told by two hashes of all of them."""
    each = found.select("key", F.explode("entities").alias("entity")).distinct()
    texts = [F.bit_xor(F.xxhash64("key")).alias("one"), F.bit_xor(F.xxhash64("key", F.lit("two"))).alias("two")]
    of = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), *texts)
    of = of.select("entity", "n_e", F.xxhash64("n_e", "one", "two").alias("class"))
    return each.join(of, "entity").select("key", "class", "n_e").distinct()


def _class_of(n_t: Column) -> Column:
    """Document frequencies of one class differ by less than a factor of two."""
    return F.floor(F.log2(n_t.cast("double"))).cast("int")


def disclosing_pairs(found: DataFrame, classes: DataFrame, terms: DataFrame, texts: int, generalise: float = GENERALISE, chance: float = CHANCE) -> DataFrame:
    """``class, term, disclosure`` of the pairs that disclose and are not
    expected by chance.

    ``found`` is ``entity_spans`` of distinct texts, ``classes`` is
    ``entity_classes``, ``terms`` is ``term_documents``.
    """
    met = classes.join(found.select("key", "terms"), "key").select("class", "n_e", F.explode("terms").alias("term"))
    scored = met.groupBy("class", "term").agg(F.count(F.lit(1)).alias("n_et"), F.first("n_e").alias("n_e")).join(terms, "term")
    # Words by class of frequency: some thirty numbers.
    sizes = {r["c"]: r["n"] for r in terms.groupBy(_class_of(F.col("n_t")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    words = F.array(*[F.lit(float(sizes.get(c, 0))) for c in range(max(sizes, default=0) + 1)])
    of_class = _class_of(F.col("n_t"))
    n = float(max(texts, 2))
    most = F.least(F.pow(F.lit(2.0), of_class + 1) - 1, F.lit(n))
    n_e, joint = F.col("n_e").cast("double"), F.col("n_et").cast("double")
    # C(most, j) (n_e)_j / (n)_j: as it is for one and two, else bounded by
    # (e most / j)^j (n_e / n)^j.
    two = most * (most - 1) / 2 * n_e * (n_e - 1) / (n * (n - 1))
    more = F.exp(joint * (1 + F.log(most) - F.log(joint) + F.log(n_e) - F.log(F.lit(n))))
    tail = F.when(joint == 1, most * n_e / n).when(joint == 2, two).otherwise(more)
    scored = scored.where(F.element_at(words, of_class + 1) * tail <= chance)
    log = lambda c: F.log(F.col(c).cast("double"))
    information = F.log(F.lit(float(max(texts, 1)))) - log("n_e")
    mutual = information + log("n_et") - log("n_t")
    scored = scored.withColumn("disclosure", F.when(information > 0, F.round(mutual / information, 6)))
    return scored.where(F.col("disclosure") >= generalise).select("class", "term", "disclosure")


def find_private(documents: DataFrame, **limits) -> DataFrame:
    """``doc_id, key, base, spans``: base spans and all spans of every
    document, by start and then kind. In ``spans``, ``value`` is the match
    for entities and ``generalise`` or ``remove`` for terms."""
    found = written(entity_spans(documents), "private_spans")
    texts = found.select("key").distinct().count()
    once = written(found.where("masked IS NOT NULL").select("key", "masked", "entities", "terms").dropDuplicates(["key"]), "private_texts")
    classes = written(entity_classes(once), "private_classes")
    terms = written(term_documents(documents), "private_terms")
    pairs = written(disclosing_pairs(once, classes, terms, texts, **limits), "private_pairs")
    told = classes.join(pairs, "class").groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))
    here = once.select("key", F.explode("terms").alias("term")).join(told, ["key", "term"])
    # Term places of the texts in question, a row each: no lists are searched.
    places = once.join(here.select("key").distinct(), "key").select("key", F.explode(_spans(F.col("masked"), _FREE_TERM, len(KINDS))).alias("at"))
    places = places.withColumn("term", _term(F.col("at.value"))).join(here, ["key", "term"])
    action = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    span = F.struct("at.start", "at.kind", "at.end", action.alias("value"))
    places = places.select(F.col("key").alias("k"), span.alias("span")).groupBy("k").agg(F.collect_list("span").alias("terms"))
    ordered = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))
    base = ordered(F.col("base")).alias("base")
    joined = found.select("doc_id", "key", base).join(places, F.col("key") == F.col("k"), "left")
    every = F.concat("base", F.coalesce("terms", F.array().cast(joined.schema["base"].dataType)))
    return joined.select("doc_id", "key", F.array_sort("base").alias("base"), F.array_sort(every).alias("spans"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )


def sanitise(documents: DataFrame, **limits) -> DataFrame:
    """``doc, clean_text``: each row as a struct, and its text with entities
    and generalised terms as placeholders and removed terms left out. Spans
    that overlap one before them go with it."""
    private = find_private(documents, **limits).dropDuplicates(["doc_id", "key"])
    rows = documents.select(
        F.struct(*columns_of(documents)).alias("doc"), text_key(F.col("text")).alias("key")
    )
    spans = private.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "spans")
    joined = rows.join(spans, F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    holders = F.array(*[F.lit(f"<{k.upper()}>") for k in (*KINDS, TERM)])

    def step(done: Column, s: Column) -> Column:
        gap = F.substr(text, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        put = F.when((s["start"] < done["at"]) | (s["value"].eqNullSafe("remove") & (s["kind"] == len(KINDS))), "").otherwise(
            F.element_at(holders, s["kind"] + 1)
        )
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["parts"], F.array(gap, put)).alias("parts")
        )

    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(F.coalesce("spans", F.array().cast(private.schema["spans"].dataType)), none, step)
    rest = F.substr(text, (done["at"] + 1).cast("int"), F.length(text))
    return joined.select("doc", F.concat(F.array_join(done["parts"], ""), rest).alias("clean_text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_private(documents)
    kinds = F.col("base.kind")
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
