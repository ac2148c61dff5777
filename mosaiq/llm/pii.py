"""Personal data: patterns for protected entities, and terms that reveal them.

Base spans come from four patterns. An entity is a matched value; its contexts
are the lines that hold it, where long lines count as lines of about 64 words
each. From the corpus' counts of lines, a term's pointwise
mutual information with an entity, as a share of the entity's information, says
how much of the entity the term discloses (1: the term stands only beside it).
Terms that reach the threshold in several different documents, more of them than
chance explains, are removed (full disclosure) or generalised (less) wherever
they stand.

DataFrame functions only.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut

#: Patterns as the contract gives them. Possessive quantifiers and look-behinds keep matching linear; they don't change what matches.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A term discloses an entity from this share on, and is removed from the second; it must stand beside it in so many lines of different texts.
DISCLOSE, REMOVE, SUPPORT = 0.9, 0.98, 3
#: The expected number of pairs of entity and term, of all that are tested, that chance alone brings together so often.
CHANCE = 0.01
#: Bytes of a table of terms that is broadcast, at most; larger ones are joined by a shuffle.
SMALL = 8 << 20
#: Part of a line: up to 64 words, and then up to 20 that begin with a digit, so that no number is cut in two.
PIECE = r"\S++(?:\s++\S++){0,63}+(?:\s++[+(0-9]\S*+){0,20}+"
#: Matches that are placed in one go.
BLOCK = 64
TERM = "\\p{L}+"
SPAN = "array<struct<start:bigint,k:int,end:bigint,value:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):  # i-th digit from the right, from 0
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _likely(kind: str, text: Column) -> Column:
    """A quick test that all texts with a match pass."""
    digit = text.rlike("[0-9]")
    if kind == "email":
        return F.instr(text, "@") > 0
    return digit if kind == "card" else (F.instr(text, "." if kind == "ip" else "+") > 0) & digit


def _located(text: Column, pattern: Column) -> Column:
    """All matches of a pattern as (start, end, value), in code points."""
    def step(at, pair):
        a = at + F.length(pair["gap"])
        b = a + F.length(pair["m"])
        return b, F.struct(a.alias("start"), b.alias("end"), pair["m"].alias("value"))

    pair = lambda gap, m: F.struct(gap.alias("gap"), m.alias("m"))
    of = lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, pair)
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: scanned(of(found), step, "struct<start:bigint,end:bigint,value:string>"))


def let(value: Column, body) -> Column:
    """The body's value for a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(items: Column, step, kind: str) -> Column:
    """An array of what ``step`` gives for a running position and each item, as (new position, value).

    Arrays are copied whenever something is added to them, so values are gathered in blocks first.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc, item):
        at, value = step(acc["at"], item)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(value)).alias("out"))

    def block(acc, held):
        start = F.struct(acc["at"].alias("at"), none.alias("out"))
        return let(F.aggregate(held, start, one), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def blocks(held):
        numbers = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))
        return F.when(F.size(held) > 0, F.transform(numbers, lambda i: F.slice(held, i * BLOCK + 1, F.lit(BLOCK))))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.coalesce(F.flatten(F.aggregate(let(items, blocks), empty, block, lambda acc: acc["out"])), none)


def base_spans(text: Column) -> Column:
    """Valid spans of all kinds, by start, then kind: (start, k, end, value) with k the place of the kind in KINDS."""
    return F.array_sort(F.concat(*(_of_kind(text, k, kind) for k, kind in enumerate(KINDS))))


def _of_kind(text: Column, k: int, kind: str) -> Column:
    spans = F.filter(_located(text, F.lit(PATTERNS[kind])), lambda x: _valid(kind, x["value"]))
    shaped = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), x["value"].alias("value")))
    return F.when(F.coalesce(_likely(kind, text), F.lit(False)), shaped).otherwise(F.array().cast(SPAN))


def entity(span: Column) -> Column:
    """The protected value of a span: its kind, and its letters or digits without layout."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), span["k"] + 1)
    return F.concat(kind, F.lit(":"), F.when(span["k"] < 2, F.lower(span["value"])).otherwise(_digits(span["value"])))


def _terms(line: Column) -> Column:
    """Lower-cased words of letters, with those of base matches left out."""
    for kind in KINDS:
        line = F.regexp_replace(line, PATTERNS[kind], " ")
    return F.transform(F.regexp_extract_all(line, F.lit("\\p{L}+"), F.lit(0)), F.lower)


def _small(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if its measured size in bytes allows."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= SMALL else df


def disclosing(docs: DataFrame, text: str = "text", disclose: float = DISCLOSE, support: int = SUPPORT) -> DataFrame:
    """(term, share): terms that disclose some entity, with the largest share."""
    t = F.col(f"`{text}`").cast("string")
    lines = docs.select(t.alias("t")).where("t is not null").select(F.xxhash64("t").alias("h"), F.explode(F.flatten(F.transform(F.split("t", "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(PIECE), F.lit(0))))).alias("line"))
    spans = base_spans(F.col("line"))
    # equal lines once, with their number and that of different texts: copies of a text add to the counts, not to the support
    held = lines.where(F.col("line").rlike("[0-9@]")).groupBy("line", "h").agg(F.count("*").alias("n")).groupBy("line").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
    held = held.withColumn("spans", spans).where(F.size("spans") > 0)
    held = held.select("n", "d", F.array_distinct(F.transform("spans", entity)).alias("es"), _terms(F.col("line")).alias("w"))
    held = cut(held, "contexts")
    beside = held.select("n", "d", F.explode("es").alias("e"), F.array_distinct("w").alias("a"))
    strong = beside.select("d", "e", F.explode("a").alias("term")).groupBy("e", "term").agg(F.sum("d").alias("places"))
    tested = Observation()
    strong = strong.observe(tested, F.count("*").alias("n")).where(F.col("places") >= support)
    strong = cut(strong, "strong")
    pairs = max(1, tested.get["n"])
    if strong.isEmpty():
        return strong.select("term", F.lit(0.0).alias("share"))
    both = beside.select("n", "e", F.explode("a").alias("term")).join(_small(strong), ["e", "term"])
    both = both.groupBy("e", "term").agg(F.sum("n").alias("c_et"), F.first("places").alias("places"))
    entities = held.select("n", F.explode("es").alias("e")).groupBy("e").agg(F.sum("n").alias("c_e"))
    known = cut(strong.select("term").distinct(), "candidates")
    words = lines.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    c_t = words.join(_small(known), "term").groupBy("term").agg(F.count("*").alias("c_t"))
    total = max(2, lines.count())
    bits = log(total)
    share = (F.log(F.col("c_et")) + bits - F.log(F.col("c_e")) - F.log(F.greatest("c_t", "c_et"))) / (bits - F.log(F.col("c_e")))
    got = both.join(entities, "e").join(c_t, "term").where(F.col("c_e") < total).withColumn("share", share)
    # the Poisson tail at the number of different places is at most exp(-bound)
    by_chance = F.col("c_e") * F.greatest("c_t", "c_et") / total
    bound = F.col("places") * F.log(F.col("places") / by_chance) - F.col("places") + by_chance
    sure = (F.col("places") > by_chance) & (bound >= log(pairs / CHANCE))
    return got.where((F.col("share") >= disclose) & sure).groupBy("term").agg(F.max("share").alias("share"))


def find(docs: DataFrame, keep: list[str], text: str = "text", disclose: float = DISCLOSE, support: int = SUPPORT) -> DataFrame:
    """``row`` (a struct of the columns to keep), ``text`` (null as empty), ``base`` and ``terms``: spans (start, k, end, value), in code points, ends exclusive.

    k counts the kinds email, ip, card, phone, and 4 for a disclosing term, whose value is "removed" or "generalised". Terms inside base
    spans aren't reported again. Equal texts get equal spans; null and empty texts have none; texts are read whole; an empty table gives
    no rows. The corpus counts are over all lines of all documents.
    """
    bad = cut(disclosing(docs, text, disclose, support), "terms")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    if bad.isEmpty():
        return own.select("row", "text", base_spans(F.col("text")).alias("base"), F.array().cast(SPAN).alias("terms"))
    words = own.select(F.md5("text").alias("key"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    found = words.join(_small(bad), "term").groupBy("key").agg(F.collect_set(F.struct("term", "share")).alias("bad"))
    found = cut(found, "found")
    wide = own.withColumn("key", F.md5("text")).join(_small(found), "key", "left").drop("key")
    wide = wide.withColumn("base", base_spans(F.col("text")))
    names = F.array_join(F.array_sort(F.transform("bad", lambda x: x["term"])), "|")
    pattern = F.concat(F.lit("(?iu)(?<!\\p{L})(?:"), names, F.lit(")(?!\\p{L})"))
    full = F.transform(F.filter("bad", lambda x: x["share"] >= REMOVE), lambda x: x["term"])
    shaped = F.transform(
        _located(F.col("text"), pattern),
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(len(KINDS)).alias("k"), x["end"].alias("end"), F.when(F.array_contains(full, F.lower(x["value"])), "removed").otherwise("generalised").alias("value")
        ),
    )
    apart = F.filter(shaped, lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return wide.select("row", "text", "base", F.when(F.col("bad").isNotNull(), apart).otherwise(F.array().cast(SPAN)).alias("terms"))


def count_of(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced: base spans by their kind in brackets, terms by nothing or by [TERM]. Overlapping spans become one."""
    def name(x):
        kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]"))
        return F.when((x["k"] == len(KINDS)) & (x["value"] == "removed"), F.lit("")).otherwise(F.element_at(kinds, x["k"] + 1))

    def step(at, x):
        gap = F.substring(text, (at + 1).cast("int"), (x["start"] - at).cast("int"))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.concat(gap, name(x))).otherwise("")

    ordered = F.array_sort(spans)
    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    rest = F.substring(text, (last + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(scanned(ordered, step, "string"), ""), rest)).otherwise(text)
