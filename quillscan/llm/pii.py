"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what four regular expressions find (e-mail, IP address, payment card, phone).
A whole base span is an instance, and so is every other word with a digit or an @; words
that are numbers, one after the other, are one instance. Numbers, cards and phones are known
by their digits, however they are grouped. The two and the three words before an instance
are its lexical patterns, an instance among them counting as the word 0. The distinct (pattern, instance) edges of the whole corpus form
a graph. In each round a pattern's confidence for a kind is the score its instances have
for that kind, over their number; patterns of enough instances and confidence pass their
confidence on, and instances whose combined score is high enough become known for the
next round, until a round adds none. Known instances are added as spans of that kind wherever else they occur.

Defined results: a null text counts as empty; a document without matches has an empty
``spans`` and the digest of the empty string; rows equal in id and text get equal
results, one row each; an empty table gives an empty result; other columns are ignored.
``n_<kind>`` counts the base spans, ``n_found`` those added by the method.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .common import frozen, row_key

# Each is its published form with possessive loops and a check that a match can't have begun
# earlier: the same matches, in time linear in the text.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Base spans are masked, a first character and the others; no length changes.
FIRST, REST = "\ue000", "\ue001"
_EDGE = rf"[^\s\p{{L}}\p{{N}}@{FIRST}{REST}]*+"
_NUMBER = rf"[+(]*+[0-9](?:[().+/-]*+[0-9])*+\)?+(?={_EDGE}(?!\S))"
#: In a masked text: a base span, a run of numbers, or a word with a digit or an @ that touches no span.
UNIT = (rf"{FIRST}{REST}*+|(?<!\S){_EDGE}{_NUMBER}(?:[ \t]++{_NUMBER})*+{_EDGE}"
        rf"|(?<!\S)[^\s0-9@{FIRST}{REST}]*+[0-9@][^\s{FIRST}{REST}]*+(?!\S)")
#: Instances that a pattern needs, and the confidence; the score that an instance needs.
SUPPORT, CONFIDENCE, ACCEPT = 5, 0.8, 0.9
#: Digits that a learned instance needs unless it has an @.
DIGITS = 4

_FOUND = "array<struct<start:int,end:int,value:string,before:string>>"


def _last(text: Column) -> Column:
    """The last three words, as letters in lower case."""
    return F.regexp_extract(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}:=#\s]++", ""), r"(?<!\S)(?:\S++\s++){0,2}\S++(?=\s*+$)", 0)


def _matches(text: Column, pattern: str, context: bool = False) -> Column:
    """All matches with code-point offsets: the pieces between matches give the places.

    ``before`` is null, or with ``context`` the last three words before, a match counting as the word 0.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    zipped = F.transform(zipped, lambda x: F.struct(x["piece"].alias("piece"), x["hit"].alias("hit")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        before = F.when(x["hit"].isNotNull(), _last(F.concat_ws(" ", acc["tail"], x["piece"]))) if context else F.lit(None).cast("string")
        return tx.bind(before, lambda w: F.struct(
            end.alias("at"), F.concat(w, F.lit(" 0")).alias("tail"),
            F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), end.alias("end"), x["hit"].alias("value"), w.alias("before"))))).alias("out")))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("tail"), F.array().cast(_FOUND).alias("out")),
                       step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, value, before>> of one kind, in order; failing matches are dropped."""
    needs = {"email": "@", "phone": "+", "ip": "."}.get(kind, "")
    return F.when(F.contains(text, F.lit(needs)), F.filter(_matches(text, KINDS[kind]), lambda x: _valid(kind, x["value"]))
                  ).otherwise(F.array().cast(_FOUND))


def _kinded() -> list[Column]:
    """The base columns as arrays of struct<kind, start, end>."""
    def one(kind: Column, k: str) -> Column:
        return F.transform(F.col(k), lambda x: F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return [one(F.lit(i), k) for i, k in enumerate(KINDS)]


def _lexical(before: Column) -> Column:
    """The patterns of an instance: the two and the three words before it."""
    words = F.split(F.trim(before), r"\s+")
    return F.transform(F.array(F.lit(2), F.lit(3)), lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " ")))


def _seeds(place: int, kind: str) -> Column:
    """array<struct<start, end, kind, instance>> of a base column; cards and phones are known by their digits."""
    node = _digits if kind in ("card", "phone") else lambda value: value
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(place).alias("kind"),
                                                node(x["value"]).alias("instance")))


def _masked(text: Column, base: Column) -> Column:
    """``text`` with the characters of the sorted spans ``base`` masked."""
    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(FIRST), F.repeat(F.lit(REST), x["end"] - x["start"] - 1))
        more = F.concat(acc["out"], F.repeat(F.lit(REST), x["end"] - acc["at"]))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(more).alias("out"))

    return F.when(F.size(base) == 0, text).otherwise(F.aggregate(
        base, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, email, ip, card, phone, units): spans of every row, without the text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("row_key"),
                      *[base_spans(text, k).alias(k) for k in KINDS], F.translate(text, FIRST + REST, "\ufffd\ufffd").alias("clean"))
    out = out.withColumn("base", F.array_sort(F.concat(*[_seeds(i, k) for i, k in enumerate(KINDS)]))).withColumn("masked", _masked(F.col("clean"), F.col("base")))
    # spans that overlap are one unit with the seeds of each
    units = F.transform(_matches(F.col("masked"), UNIT, context=True), lambda u: F.struct(
        u["start"].alias("start"), u["value"].alias("value"), u["before"].alias("before"),
        F.when(F.startswith(u["value"], F.lit(FIRST)), F.transform(
            F.filter("base", lambda b: (b["start"] >= u["start"]) & (b["start"] < u["end"])),
            lambda b: F.struct(b["kind"].alias("kind"), b["instance"].alias("instance")))).alias("seeds")))
    bare = lambda k: F.transform(F.col(k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return out.select("doc_id", "row_key", *[bare(k).alias(k) for k in KINDS],
                      F.transform(units, lambda u: F.struct(u["start"].alias("start"), F.when(u["seeds"].isNull(), u["value"]).alias("value"),
                                                            u["before"].alias("before"), u["seeds"].alias("seeds"))).alias("units"))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """(row_key, instance, kind, start, end, patterns) of every seed (without its place) and every other instance."""
    units = scanned.select("row_key", F.explode("units").alias("u")).select("row_key", "u.*").withColumn("patterns", _lexical(F.col("before")))
    seeds = units.select("row_key", "patterns", F.explode("seeds").alias("s")).select(
        "row_key", "s.instance", "s.kind", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "patterns")
    # an area code's bracket belongs to the number
    lead = r"^(?:(?!\([0-9]++\).*[0-9])[^\p{L}\p{N}+])++"
    core = F.regexp_replace(F.col("value"), lead + r"|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    words = units.where("seeds is null").withColumn("core", core).withColumn("from", F.col("start") + F.length(F.regexp_extract("value", lead, 0)))
    number = ~F.col("core").rlike(r"[\p{L}@]|^[0-9]++(?:\.[0-9]++){3}$")
    return seeds.unionByName(words.where(F.length("core") > 0).select(
        "row_key", F.when(number & (_digits(F.col("core")) != ""), _digits(F.col("core"))).otherwise(F.col("core")).alias("instance"),
        F.lit(None).cast("int").alias("kind"), F.col("from").alias("start"), (F.col("from") + F.length("core")).alias("end"), "patterns"))


def learn(occurrences: DataFrame, rounds: int | None = None) -> DataFrame:
    """(instance, kind) of the seeds and of what confident patterns give a kind."""
    edges = frozen(occurrences.select(F.explode("patterns").alias("pattern"), "instance").where("pattern is not null").distinct(), "pii-edges")
    known = frozen(occurrences.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
                   .select("instance", "kind", F.lit(1.0).alias("score"), F.lit(0).alias("round")), "pii-known")
    for r in itertools.count(1) if rounds is None else range(1, rounds + 1):
        share = [(F.sum(F.when(F.col("kind") == i, F.col("score")).otherwise(0.0)) / F.count("*")) for i in range(len(KINDS))]
        best = F.array_max(F.array(*[F.struct(s.alias("confidence"), F.lit(-i).alias("minus_kind")) for i, s in enumerate(share)]))
        patterns = (edges.join(known, "instance", "left").groupBy("pattern").agg(F.count("*").alias("n"), best.alias("b"))
                    .where((F.col("n") >= SUPPORT) & (F.col("b.confidence") >= CONFIDENCE))
                    .select("pattern", (-F.col("b.minus_kind")).alias("kind"), F.col("b.confidence").alias("confidence")))
        score = 1 - F.exp(F.sum(F.log(F.lit(1.0 + 1e-9) - F.col("confidence"))))
        new = (edges.join(patterns, "pattern").join(known.select("instance"), "instance", "left_anti")
               .where((F.length(_digits(F.col("instance"))) >= DIGITS) | F.contains("instance", F.lit("@")))
               .groupBy("instance", "kind").agg(score.alias("score")).where(F.col("score") >= ACCEPT)
               .groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
               .withColumn("round", F.lit(r)))
        new = frozen(new.select("instance", "kind", "score", "round"), "pii-new")
        if new.isEmpty():
            break
        known = known.unionByName(new)
        if r % 8 == 0:
            known = frozen(known, "pii-known")
    return known.select("instance", "kind")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """(doc_id, row_key, email, ip, card, phone, found): spans of every row.

    The four base columns are array<struct<start, end>>, ``found`` is
    array<struct<kind, start, end>> with the place of the kind in KINDS.
    """
    scanned = frozen(scan(docs, id_col, text_col), "pii-scan")
    occurrences = _occurrences(scanned)
    learned = learn(occurrences, rounds)
    found = (occurrences.where("kind is null").drop("kind").join(learned, "instance").groupBy("row_key")
             .agg(F.collect_set(F.struct("kind", "start", "end")).alias("found")))
    return scanned.drop("units").join(found, "row_key", "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<kind:int,start:int,end:int>>")))


def _all_spans(with_found: bool) -> Column:
    return F.array_sort(F.concat(*_kinded(), *[F.col("found")] * with_found))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found of every row."""
    return find(docs, id_col, text_col).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(spans_text(_all_spans(False)).cast("binary"), 256).alias("base_sha256"),
        spans_text(_all_spans(True)).alias("spans"), F.size("found").cast("long").alias("n_found"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    ``length_col``, where ``docs`` has it, is set to the new length of a changed text.
    """
    spans = find(docs, id_col, text_col).select("row_key", F.array_sort(F.transform(
        _all_spans(True), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).alias("__spans"))
    spans = spans.where(F.size("__spans") > 0).groupBy(F.col("row_key").alias("__row_key")).agg(F.first("__spans").alias("__spans"))
    text, names = F.col(f"`{text_col}`"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.get(names, x["kind"]))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = docs.withColumn("__row_key", row_key(id_col, text_col)).join(spans, "__row_key", "left")
    out = out.withColumn("__clean", F.when(F.col("__spans").isNotNull(), clean).otherwise(text))
    keep = [F.col("__clean").alias(c) if c == text_col
            else F.when(F.col("__spans").isNotNull(), F.length("__clean")).otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c) if c == length_col
            else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*keep)
