"""Personal data: base patterns, and terms whose corpus co-occurrence reveals a protected entity.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.plans.staging import BROADCAST_BYTES, broadcast_if_small, stage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: Each pattern finds what the plain one of its kind finds, in linear time: a
#: run of characters is tried from its start only (or from the end of the last
#: match), loops do not give back, and digit chains are matched only where a
#: whole chain has 16 to 19 digits.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What must be in a text for a pattern to match at all.
_HINT = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters on each side of an entity, within its line, that tell two contexts in one row apart.
CONTEXT = 100
#: A term is told on if its pointwise mutual information with a protected
#: concept, counted over whole rows, is at least DISCLOSURE of the concept's
#: information content (WIDE_DISCLOSURE for origins and kinds: a kind that 3 % of
#: rows hold is told on by a word half of whose rows hold it). For single values
#: the evidence is SUPPORT rows or
#: contexts that differ; for classes of values it is a likelihood ratio beyond
#: 2 ln(pairs tested) + MARGIN, so that no pair of the vocabulary is told by chance.
DISCLOSURE, WIDE_DISCLOSURE, SUPPORT, MARGIN = 0.9, 0.8, 2, 10.0
TERM_LETTERS = 3
#: Levels of a concept: a value, values of one origin, all values of a kind, all values.
VALUE, ORIGIN, KIND = 0, 1, 2
SPAN_TYPE = "array<struct<start:int,end:int,value:string>>"
CONCEPT_TYPE = "array<struct<level:int,concept:string,evidence:bigint>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return (acc + F.when(i % 2 == 0, twice).otherwise(d)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _located(text: Column, pattern: Column) -> Column:
    """All matches as ``array<struct<start, end, value>>`` in code points: what lies between matches gives the places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    none = F.array().cast(SPAN_TYPE)

    def add(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["g"])
        end = start + F.length(z["m"])
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), z["m"].alias("value")))).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind; failing matches are dropped and not tried again."""
    pattern = PATTERNS[kind]
    hit = text.rlike(pattern)
    if kind in _HINT:
        hit = F.contains(text, F.lit(_HINT[kind])) & hit
    none = F.array().cast(SPAN_TYPE)
    return F.when(hit, F.filter(_located(text, F.lit(pattern)), lambda s: _valid(kind, s["value"]))).otherwise(none)


def _told(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def _origin(kind: str, value: Column) -> Column:
    """What values of one origin share: a mail domain, a /16 network, a card issuer, a dialling prefix."""
    if kind == "email":
        return F.substring_index(value, "@", -1)
    if kind == "ip":
        return F.regexp_extract(value, r"^[0-9]+\.[0-9]+", 0)
    return F.substring(_digits(value), 1, 6 if kind == "card" else 4)


def _entities() -> Column:
    """All values of a row as ``kind:value``, with their places."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit(f"{kind}:"), F.lower(s["value"])).alias("concept")))

    return F.concat(*map(of, KINDS))


def _with_concepts(rows: DataFrame) -> DataFrame:
    """Adds ``concepts``, ``(level, concept, evidence)`` once each: a row's values, their origins, their kinds, and that there are any.

    ``evidence`` is the least value hash behind the concept: copies of one text have the same.
    """

    def of(kind: str) -> Column:
        def one(level: int, name: Column, value: Column) -> Column:
            return F.struct(F.lit(level).alias("level"), F.concat(F.lit(f"{kind}:"), name).alias("concept"), F.xxhash64(F.lit(kind), value).alias("evidence"))

        def all_of(s: Column) -> Column:
            low = F.lower(s["value"])
            whole = F.struct(F.lit(KIND).alias("level"), F.lit(kind).alias("concept"), F.xxhash64(F.lit(kind), low).alias("evidence"))
            some = F.struct(F.lit(KIND).alias("level"), F.lit("any").alias("concept"), F.xxhash64(F.lit(kind), low).alias("evidence"))
            return F.array(one(VALUE, low, low), one(ORIGIN, F.concat(F.lit("~"), _origin(kind, low)), low), whole, some).cast(CONCEPT_TYPE)

        return F.flatten(F.transform(kind, all_of))

    rows = rows.withColumn("every", F.when(F.col("has"), F.array_sort(F.concat(*map(of, KINDS)))))
    # sorted, so the first entry of a concept has its least evidence
    first = F.filter("every", lambda c, i: (i == 0) | (F.element_at("every", F.greatest(i, F.lit(1)))["concept"] != c["concept"]))
    return rows.withColumn("concepts", first).drop("every")


def _marks(kind: str) -> Column:
    """Spans of one kind with the text that takes their place."""

    def mark(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark"), s["value"].alias("value"))

    return F.transform(F.coalesce(kind, F.array().cast(SPAN_TYPE)), mark)


def _words(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits, of three characters or more and at least a letter."""
    return F.filter(_runs(text), lambda w: (F.length(w) >= TERM_LETTERS) & w.rlike(r"\p{L}"))


def _runs(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits, for joins with terms."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text, tkey)``: equal texts have equal keys, and equal spans."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("tkey", F.unhex(F.md5(F.col("text").cast("binary"))))


def find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans of every row, staged; ``text`` is kept only where there are any (``has``)."""
    rows = _rows(docs, id_col, text_col)
    for kind in KINDS:
        rows = rows.withColumn(kind, base_spans(F.col("text"), kind))
    some = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    rows = rows.withColumn("has", some)
    return stage(_with_concepts(rows).withColumn("text", F.when(F.col("has"), F.col("text"))), "pii-base")


def _free(text: Column) -> Column:
    """Text without entities, which are no terms."""
    for kind in KINDS:
        text = F.regexp_replace(text, PATTERNS[kind], " ")
    return text


def _contexts(base: DataFrame) -> DataFrame:
    """``(concept, ctx, term)``: the words near each value in its line."""
    each = base.where("has").select("text", F.explode(_entities()).alias("s")).select("text", "s.*")
    first = F.greatest(F.col("start") - CONTEXT, F.lit(0))
    before = F.substring("text", first + 1, F.col("start") - first)
    before = F.when(first > 0, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
    after = F.substring("text", F.col("end") + 1, F.lit(CONTEXT))
    after = F.when(F.length(after) == CONTEXT, F.regexp_replace(after, r"[\p{L}\p{N}]+$", "")).otherwise(after)
    near = F.concat(F.regexp_extract(before, r"[^\n]*$", 0), F.lit(" | "), F.regexp_extract(after, r"^[^\n]*", 0))
    near = each.select("concept", _free(near).alias("near"))
    return near.select("concept", F.xxhash64("near").alias("ctx"), F.explode(_words(F.col("near"))).alias("term"))


def _told_words(base: DataFrame, shared: DataFrame) -> DataFrame:
    """``(level, concept, evidence, row, term)``: every concept of ``shared`` with every word of its rows."""
    rows = base.where("has").select("concepts", _free(F.lower("text")).alias("free"))
    rows = rows.select("concepts", F.xxhash64("free").alias("row"), _words(F.col("free")).alias("words"))
    each = rows.select("words", "row", F.explode("concepts").alias("c")).select("words", "row", "c.*").join(shared, "concept", "left_semi")
    return each.select("level", "concept", "evidence", "row", F.explode("words").alias("term"))


def _surprise(both: Column, t: Column, e: Column, n: Column) -> Column:
    """Log-likelihood ratio of the 2 x 2 table of rows with and without the term and the concept."""

    def part(seen: Column, due: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)

    return 2 * (part(both, t * e / n) + part(t - both, t * (n - e) / n) + part(e - both, (n - t) * e / n) + part(n - t - e + both, (n - t) * (n - e) / n))


def disclosing_terms(docs: DataFrame, base: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(level, concept, term, action)`` of the terms above the disclosure threshold, staged.

    A concept is a value, values of one origin (a mail domain, a network), a
    kind or any personal data at all; values too rare to show anything
    themselves are seen through the wider ones. With n rows, df(e) of them
    with the concept, df(t) with the term and n(t, e) with both, near or far,
    PMI = ln(n n(t, e) / (df(t) df(e))) and IC = ln(n / df(e)); told on if
    PMI >= DISCLOSURE * IC, on wider concepts WIDE_DISCLOSURE * IC. The evidence on a value must differ: two rows with
    other texts, or two contexts. On wider concepts rows with the same least
    value count once, so that copies show nothing, and the likelihood ratio of
    what is left must pass 2 ln(pairs) + MARGIN. A term never seen without the
    concept is removed, others are generalised.
    """
    of_rows = base.where("has").select(F.explode("concepts").alias("c")).select("c.*")
    e_df = stage(of_rows.groupBy("concept").agg(F.count("*").alias("e_df")).where(F.col("e_df") >= SUPPORT), "pii-entities")
    e_df = broadcast_if_small(e_df, 128)
    shared = e_df.select("concept")
    in_rows = _told_words(base, shared)
    counted = in_rows.groupBy("level", "concept", "term").agg(F.count("*").alias("both"), (F.min("row") != F.max("row")).alias("differ"))
    seen = _contexts(base).join(shared, "concept", "left_semi")
    in_ctx = seen.groupBy("concept", "term").agg((F.min("ctx") != F.max("ctx")).alias("near"))
    pairs = counted.join(in_ctx, ["concept", "term"], "left").where(F.col("differ") | F.coalesce("near", F.lit(False)))
    pairs = stage(pairs.select("level", "concept", "term", "both").join(e_df, "concept"), "pii-pairs")
    n, tested = base.count(), pairs.where(F.col("level") > VALUE).count()
    bar, rows = 2 * math.log(max(tested, 1)) + MARGIN, F.lit(float(n))
    both, e, t = (F.col(c).cast("double") for c in ("both", "e_df", "t_df"))
    ic = F.log(rows / e)
    # the likelihood ratio is at most that of a term that never stands without the concept
    open_ = stage(pairs.where((ic > 0) & ((F.col("level") == VALUE) | (_surprise(both, both, e, rows) >= bar))), "pii-open")
    none = open_.select("level", "concept", "term", F.lit("").alias("action")).where("false")
    if open_.isEmpty():
        return none
    terms = stage(open_.select("term").distinct(), "pii-terms")
    words = docs.select(F.explode(_runs(F.col(text_col).cast("string"))).alias("term"))
    small = terms.count() * 64 <= BROADCAST_BYTES
    t_df = (words.join(F.broadcast(terms), "term", "left_semi") if small else words).groupBy("term").agg(F.count("*").alias("t_df"))
    t_df = broadcast_if_small(stage(t_df if small else t_df.join(terms, "term"), "pii-term-counts"), 72)
    told = open_.join(t_df, "term").where(F.log(rows * both / (t * e)) >= F.when(F.col("level") == VALUE, DISCLOSURE).otherwise(WIDE_DISCLOSURE) * ic)
    told = stage(told, "pii-candidates")
    wide = told.where(F.col("level") > VALUE)
    if not wide.isEmpty():
        keys = broadcast_if_small(wide.select("concept", "term"), 128)
        spread = in_rows.join(keys, ["concept", "term"], "left_semi").groupBy("concept", "term").agg(F.countDistinct("evidence").alias("spread"))
        fresh = F.col("spread").cast("double")
        wide = wide.join(spread, ["concept", "term"]).where(_surprise(fresh, t - both + fresh, e - both + fresh, rows - both + fresh) >= bar).drop("spread")
    told = told.where(F.col("level") == VALUE).unionByName(wide)
    return stage(told.select("level", "concept", "term", F.when(F.col("both") >= F.col("t_df"), "remove").otherwise("generalise").alias("action")), "pii-told")


def _term_spans(docs: DataFrame, base: DataFrame, told: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(tkey, term)``: by text, the spans of terms that tell on what the row holds; a kind is told on in any row."""
    narrow = told.where(F.col("level") < KIND)
    of_term = broadcast_if_small(narrow.select("concept", "term"), 128)
    holds = base.where("has").select("tkey", _words(F.col("text")).alias("words"), F.explode("concepts.concept").alias("concept"))
    holds = holds.join(broadcast_if_small(stage(narrow.select("concept").distinct(), "pii-narrow"), 64), "concept", "left_semi")
    mine = holds.select("tkey", "concept", F.explode("words").alias("term")).join(of_term, ["concept", "term"], "left_semi").select("tkey", "term")
    wide = stage(told.where(F.col("level") == KIND).select("term").distinct(), "pii-wide")
    rows = _rows(docs, id_col, text_col)
    if not wide.isEmpty():
        everywhere = rows.select("tkey", F.explode(_runs(F.col("text"))).alias("term")).join(broadcast_if_small(wide, 64), "term", "left_semi")
        mine = mine.unionByName(everywhere.select("tkey", "term"))
    # at most the words of one text
    listed = mine.groupBy("tkey").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms"))
    listed = broadcast_if_small(stage(listed, "pii-listed"), 256)
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.col("terms"), F.lit(r")(?![\p{L}\p{N}])"))
    found = rows.select("tkey", "text").join(listed, "tkey").select("tkey", _located(F.col("text"), pattern).alias("term"))
    return stage(found.groupBy("tkey").agg(F.first("term").alias("term")), "pii-term-spans")


def _apart(spans: Column) -> Column:
    """Term spans that touch no base span of the row."""
    taken = F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS))
    return F.filter(spans, lambda s: ~F.exists(taken, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_spans)`` for every row of ``docs``.

    Offsets are code points of the whole text, ends exclusive. Base spans are
    found by pattern. ``disclosing_terms`` adds ``term`` spans outside them: a
    word that tells on a value or its origin wherever it stands in a row that
    holds it, and a word that tells on a kind, or that there is personal data
    at all, in every row. Null texts count as empty; null ids and repeated
    rows are rows like others, very long texts are read whole. Other columns
    are not read. An empty table gives no rows.
    """
    base = find(docs, id_col, text_col)
    told = disclosing_terms(docs, base, id_col, text_col)
    light = base.drop("text", "has", "concepts")
    none = F.array().cast(SPAN_TYPE)
    if told.isEmpty():
        light = light.withColumn("term", none)
    else:
        light = light.join(broadcast_if_small(_term_spans(docs, base, told, id_col, text_col), 1024), "tkey", "left")
        light = light.withColumn("term", _apart(F.coalesce("term", none)))
    plain = F.concat(*(_told(k, F.col(k)) for k in KINDS))
    every = F.concat(plain, _told("term", F.col("term")))
    return light.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.array_join(plain, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"), F.size("term").cast("long").alias("n_term"), F.size(every).cast("long").alias("n_spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with values replaced by ``[KIND]``, removed terms cut out and others generalised.

    A generalised term becomes ``[ID]`` if it has a digit, ``[NAME]`` if it is
    capitalised wherever it is marked, and ``[TERM]`` otherwise. Nulls, empty
    and repeated rows as in ``personal_data``.
    """
    base = find(docs, id_col, text_col)
    told = disclosing_terms(docs, base, id_col, text_col)
    spans = base.select("tkey", *KINDS).dropDuplicates(["tkey"]).join(_term_spans(docs, base, told, id_col, text_col), "tkey", "left")
    spans = spans.withColumn("term", _apart(F.coalesce("term", F.array().cast(SPAN_TYPE))))
    each = stage(spans.select("tkey", F.explode(F.concat(*map(_marks, (*KINDS, "term")))).alias("m")).select("tkey", "m.*"), "pii-marks")
    action = told.groupBy("term").agg(F.max(F.col("action") == "remove").alias("gone"))
    first = F.substring("value", 1, 1)
    shapes = each.where("mark = '[TERM]'").groupBy(F.lower("value").alias("term")).agg(F.min(first != F.lower(first)).alias("capital")).join(action, "term")
    shapes = stage(shapes, "pii-shapes")
    general = F.when(F.col("gone"), "").when(F.col("term").rlike(r"\p{N}"), "[ID]").when(F.col("capital"), "[NAME]").otherwise("[TERM]")
    each = each.withColumn("term", F.when(F.col("mark") == "[TERM]", F.lower("value"))).join(broadcast_if_small(shapes.select("term", general.alias("general")), 96), "term", "left")
    each = each.withColumn("mark", F.coalesce("general", "mark"))
    lists = each.groupBy("tkey").agg(F.array_sort(F.collect_list(F.struct("start", "end", "mark"))).alias("marks"))

    def cut(acc: Column, m: Column) -> Column:
        inside = m["start"] < acc["at"]
        out = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, m["start"] - acc["at"]), m["mark"])
        return F.struct(F.greatest(acc["at"], m["end"]).cast("int").alias("at"), F.when(inside, acc["out"]).otherwise(out).alias("out"))

    done = F.aggregate("marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    rows = _rows(docs, id_col, text_col).join(lists, "tkey", "left")
    return rows.select("doc_id", F.when(F.col("marks").isNull(), F.col("text")).otherwise(done).alias("text"))
