"""Personal data: exact base patterns, and terms that disclose the people behind them, in DataFrame operations only.

Base spans (e-mail, IPv4, card, phone) are found by linear-time forms of the fixed patterns. The protected entities
are their values. Corpus co-occurrence then says how much a term gives away: over distinct texts, for an entity e
and a term t that stands among the ``WINDOW`` terms before or after it, disclosure(e, t) = PMI(e, t) / IC(e) =
1 + log2(p(e | t)) / log2(N / n(e)), 1 meaning that the term alone identifies the entity. p(e | t) is estimated as
n(e, t) / (n(t) + 1): one text more, without the entity, is granted to every term, so a term seen once is never
certain, and every entity and term counts however rare. Terms at or over ``GENERALISE`` are replaced by a class token
in the texts that hold the entity, terms at or over ``REMOVE`` are removed. Copies of one text count once; n(t) and
n(e) are over all documents.

Terms are lower-cased runs of three letters or more that do not touch a base span; n(t) counts the texts where the
run stands anywhere. A null text counts as empty: no spans. Offsets are code points, end exclusive. Rows may repeat
and ids may be null; extra columns are kept under any names. Work on a text grows in proportion to its length: long
lists of spans are taken in chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from geoquarry.llm.common import small, stash, table, unstash

#: Fixed base patterns, written with possessive runs and guarded starts so that no text makes them backtrack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WINDOW, GENERALISE, REMOVE = 10, 0.8, 0.95
TERM = r"\p{L}{3,}"
#: Spans of a text that are added up in one step.
CHUNK = 128

_SPAN = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _chunks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda j: F.slice(items, j * CHUNK + 1, F.lit(CHUNK)))


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """0, then the running results of ``step`` over values."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))


def _positions(found: Column, gaps: Column) -> Column:
    """Spans of the matches ``found`` between the pieces ``gaps`` of a text."""

    def pieces(found: Column, gaps: Column) -> Column:
        return F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(F.length(g).alias("gap"), F.length(v).alias("own"), v.alias("value")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["own"]
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    def one(x: Column) -> Column:
        return F.aggregate(x["chunk"], F.struct(x["start"].alias("at"), F.array().cast(_SPAN).alias("spans")), step)["spans"]

    def all_of(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["own"]))
        starts = _running(lengths, lambda at, n: at + n)
        return F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), F.slice(starts, F.lit(1), F.size(chunks)).alias("start")), one))

    both = F.struct(found.alias("found"), gaps.alias("gaps"))
    return _let(both, lambda x: F.when(F.size(x["found"]) > 0, _let(_let(pieces(x["found"], x["gaps"]), _chunks), all_of)).otherwise(F.array().cast(_SPAN)))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) <= 3, F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    if kind == "card":
        digit = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        luhn = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)))
        return F.when(F.length(digits).between(16, 19), luhn % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def _entity(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("term"), F.concat(F.lit(f"{kind}:"), F.lower(s["value"])).alias("entity"))


def _plain(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("remove"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _free(df: DataFrame) -> str:
    """A beginning for names of our own that no column of ``df`` has."""
    own = "__"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    return own


def with_base_spans(docs: DataFrame, own: str, text: str = "text") -> DataFrame:
    """``docs`` and one array of (start, end, value) for each kind, named by ``own`` and the kind; spans that fail are dropped."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({f"{own}f_{k}": F.when(body.rlike(HINTS[k]), F.regexp_extract_all(body, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, p in PATTERNS.items()})
    out = out.withColumns({f"{own}g_{k}": F.when(F.size(f"{own}f_{k}") > 0, F.split(body, p, -1)) for k, p in PATTERNS.items()})
    spans = {f"{own}{k}": F.filter(_positions(F.col(f"{own}f_{k}"), F.col(f"{own}g_{k}")), _checked(k)) for k in PATTERNS}
    return out.withColumns(spans).drop(*(f"{own}{x}_{k}" for x in "fg" for k in PATTERNS))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _runs(text: Column) -> Column:
    """Spans of the runs that may be terms."""
    return _positions(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1))


def _keys(k1: str, k2: str, text: str = "text") -> list[Column]:
    return [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(k1), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias(k2)]


def _marks(held: DataFrame) -> DataFrame:
    """k1, k2, start, end, term or entity, r: terms that touch no base span, numbered in their text, and entities with the number of terms before them."""
    term = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("term"), F.lit(None).cast("string").alias("entity"))
    marks = held.select("k1", "k2", F.explode(F.concat(F.transform(_runs(F.col("text")), term), "entities")).alias("m")).select("k1", "k2", "m.*")
    of_text = Window.partitionBy("k1", "k2")
    before = of_text.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = of_text.orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    is_entity = F.col("entity").isNotNull()
    touched = marks.withColumns({"left": F.max(F.when(is_entity, F.col("end"))).over(before), "right": F.min(F.when(is_entity, F.col("start"))).over(after)})
    clear = touched.where(is_entity | (F.coalesce("left", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("right") >= F.col("end"), F.lit(True)))
    return clear.withColumn("r", F.count("term").over(of_text.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))).select("k1", "k2", "start", "end", "term", "entity", "r")


def _near(marks: DataFrame) -> DataFrame:
    """entity, k1, k2, term: the terms among the WINDOW before and after each entity."""
    around = marks.where("entity is not null").select("k1", "k2", "entity", F.explode(F.sequence(F.col("r") - WINDOW + 1, F.col("r") + WINDOW)).alias("r"))
    return around.join(marks.where("term is not null").select("k1", "k2", "r", "term"), ["k1", "k2", "r"]).select("entity", "k1", "k2", "term").distinct()


def disclosures(docs: DataFrame) -> DataFrame:
    """k1, k2 (identity of a text), told: the spans (start, end, remove) of the terms to sanitise in each distinct text that has some."""
    texts = docs.where("text is not null").select(*_keys("k1", "k2"), "text")
    found = with_base_spans(texts, "__").withColumn("entities", F.concat(*(F.transform(f"__{k}", _entity(k)) for k in PATTERNS)))
    held = stash(found.where(F.size("entities") > 0).select("k1", "k2", "text", "entities").dropDuplicates(["k1", "k2"]), "held")
    marks = stash(_marks(held), "marks")
    near = _near(marks)
    entities = stash(held.select(F.explode("entities.entity").alias("entity"), "k1", "k2").distinct(), "entities")
    of_entity = entities.groupBy("entity").agg(F.count("*").alias("n_e"))
    joint = near.groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    # a text with c copies weighs 1 / c in each, so that every distinct text counts once
    copies = stash(texts.groupBy("k1", "k2").agg(F.count("*").alias("c")), "copies")
    repeated = stash(copies.where("c > 1"), "repeated")
    weighed = texts.join(small(repeated), ["k1", "k2"], "left").select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"), (1 / F.coalesce("c", F.lit(1))).alias("w"))
    of_term = weighed.groupBy("term").agg(F.round(F.sum("w")).alias("n_t"))
    total = copies.count()
    share = 1 + F.log2(F.col("n_et") / (F.col("n_t") + 1)) / F.greatest(F.log2(F.lit(float(max(total, 1))) / F.col("n_e")), F.lit(1e-9))
    telling = joint.join(of_entity, "entity").join(of_term, "term").withColumn("disclosure", share).where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")
    per_text = stash(telling.join(entities, "entity").groupBy("k1", "k2", "term").agg((F.max("disclosure") >= REMOVE).alias("remove")), "telling")
    told = marks.where("term is not null").join(small(per_text), ["k1", "k2", "term"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end", "remove"))).alias("told"))
    out = stash(told, "told")
    for x in (held, marks, entities, copies, repeated, per_text):
        unstash(x)
    return out


def with_spans(docs: DataFrame, own: str | None = None) -> DataFrame:
    """``docs`` and, named by ``own``, base and spans: (kind, start, end, remove) by kind as listed, then start; terms come last."""
    own = own or _free(docs)
    c = lambda name: f"{own}{name}"
    lists = stash(disclosures(docs).select(F.col("k1").alias(c("k1")), F.col("k2").alias(c("k2")), F.col("told").alias(c("told"))), "lists")
    both = with_base_spans(docs, own).select("*", *_keys(c("k1"), c("k2"))).join(small(lists), [c("k1"), c("k2")], "left")
    both = both.withColumn(c("base"), F.concat(*(F.transform(c(k), _plain(k)) for k in PATTERNS)))
    told = F.transform(c("told"), lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["remove"].alias("remove")))
    spans = F.coalesce(F.concat(c("base"), told), F.col(c("base")))
    return both.withColumn(c("spans"), spans).drop(c("k1"), c("k2"), c("told"), *map(c, PATTERNS))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "__")
    counts = [F.size(F.filter("__base", _is(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return out.select("doc_id", *counts, F.sha2(_joined("__base").cast("binary"), 256).alias("base_sha256"), _joined("__spans").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans replaced by their kind, telling terms by [TERM] or nothing; null texts stay null."""
    own = _free(docs)
    found = with_spans(docs, own)
    ordered = F.array_sort(F.transform(f"{own}spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["remove"], F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("tag"))))

    def step(body: Column, begin: Column) -> Callable[[Column, Column], Column]:
        def run(acc: Column, s: Column) -> Column:
            piece = F.concat(acc["text"], F.substring(body, acc["at"] - begin + 1, s["start"] - acc["at"]), s["tag"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["text"]).otherwise(piece).alias("text"))

        return run

    def all_of(chunks: Column) -> Column:
        # where each chunk begins: after the furthest end before it
        starts = _running(F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"]))), lambda at, end: F.greatest(at, end))

        def rebuilt(starts: Column) -> Column:
            parts = F.transform(chunks, lambda c, j: F.struct(c.alias("chunk"), F.get(starts, j).alias("begin"), F.substring(F.col("text"), F.get(starts, j) + 1, F.get(starts, j + 1) - F.get(starts, j)).alias("body")))
            done = F.transform(parts, lambda x: F.aggregate(x["chunk"], F.struct(x["begin"].alias("at"), F.lit("").alias("text")), step(x["body"], x["begin"]))["text"])
            return F.concat(F.array_join(done, ""), F.substring(F.col("text"), F.element_at(starts, -1) + 1, F.lit(2**30)))

        return _let(starts, rebuilt)

    clean = F.when(F.size(f"{own}spans") > 0, _let(_let(ordered, _chunks), all_of)).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*docs.columns)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts come out sanitised, n_chars (where the table has it) recounted; no row goes."""
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
