"""Personal data: patterns first, then what gives the persons away by co-occurrence.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers: the
protected entities. Then information theory: over all documents, a term's disclosure
of an entity is their pointwise mutual information over the information content of
the entity,

    PMI(t, e) / IC(e) = 1 - log(df(t) / df(t, e)) / log(N / df(e)),

where df(t, e) counts the documents in which t stands within `context` characters of
e, df(t) and df(e) those that have t or e, N all. It is 1 where a term occurs only
beside the entity. Terms at or above `threshold`, with at least `support` such
documents, are sanitised wherever they occur: generalised to a placeholder, or
removed where the disclosure is `remove_from` or more.

All of it is DataFrame expressions. Contexts have a fixed width, so co-occurrence
rows are linear in the entities found, not in their products with the words of a
document. Frequencies are partly aggregated before their shuffle. What a document's
terms are is keyed by the hash of its text; for different texts with one hash, terms
that do not occur find nothing.

Defined results: a null text is empty and has no spans (sanitised, it stays null);
repeated rows count as documents and get the same spans; spans are code points, the
end exclusive; a term's span that overlaps an entity is dropped; an empty table gives
an empty result; other columns are ignored by `find`, kept by `sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.plans.storage import stage

# Possessive quantifiers and the look-behinds change no match of the plain patterns;
# they only keep runs that cannot match from being tried again from their middle.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[^\p{L}\p{N}]+"
_WORD = r"[\p{L}\p{N}]"
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _spans(text: Column, pattern: Column, may: Column, kind: Column, valid=None) -> Column:
    """Spans of a pattern's matches: each starts after the parts of the text between
    the matches so far and the matches themselves. `may` is a cheap test that a text
    without a match usually fails."""
    none = F.array().cast(_SPANS)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.arrays_zip(found.alias("value"), F.transform(F.split(text, pattern, -1), F.length).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(so_far: Column, piece: Column) -> Column:
        begin = so_far["at"] + piece["gap"]
        end = begin + F.length(piece["value"])
        one = F.array(F.struct(kind.alias("kind"), begin.alias("start"), end.alias("end"), piece["value"].alias("value"))).cast(_SPANS)
        fine = valid(piece["value"]) if valid else F.lit(True)
        return F.struct(F.coalesce(end, F.lit(0)).alias("at"), F.when(F.coalesce(fine, F.lit(False)), F.concat(so_far["out"], one)).otherwise(so_far["out"]).alias("out"))

    whole = F.filter(pieces, lambda x: x["value"].isNotNull())
    return F.when(may, F.aggregate(whole, start, step, lambda x: x["out"])).otherwise(none)


def entity_spans(text: Column) -> Column:
    """All protected entities of a text: kind, start, end and value, by kind, then start."""
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.rlike(r"\+[0-9]")}
    return F.concat(*[_spans(text, F.lit(p), may[k], F.lit(k), lambda v, k=k: _valid(k, v)) for k, p in PATTERNS.items()])


def _folded(text: Column) -> Column:
    """A-Z lower-cased; offsets stay."""
    return F.translate(text, _UPPER, _LOWER)


def _terms(text: Column, shortest: int) -> Column:
    return F.filter(F.array_distinct(F.split(_folded(text), _NOT_WORD)), lambda t: F.length(t) >= shortest)


def disclosing_terms(docs: DataFrame, context: int = 120, threshold: float = 0.9, support: int = 5, shortest: int = 3) -> DataFrame:
    """(term, disclosure): terms that reveal some entity of the corpus at or above the
    threshold, with the highest disclosure of any entity."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(text.alias("text")).select("text", entity_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)

    def around(span: Column) -> Column:
        left = F.greatest(span["start"] - context, F.lit(0))
        # a word that the window cuts in two is not one: it goes, but only where the text goes on beyond
        beyond = F.substring(F.col("text"), left, F.lit(1))
        before = F.substring(F.col("text"), left + 1, span["start"] - left)
        before = F.when((left > 0) & beyond.rlike(_WORD), F.regexp_replace(before, f"^{_WORD}+", "")).otherwise(before)
        after = F.substring(F.col("text"), span["end"] + 1, F.lit(context))
        beyond = F.substring(F.col("text"), span["end"] + F.lit(context + 1), F.lit(1))
        after = F.when(beyond.rlike(_WORD), F.regexp_replace(after, f"{_WORD}+$", "")).otherwise(after)
        return F.struct(F.concat_ws(":", span["kind"], span["value"]).alias("entity"), F.concat_ws(" ", before, after).alias("near"))

    seen = marked.select(F.monotonically_increasing_id().alias("row"), F.explode(F.transform("spans", around)).alias("x")).select("row", "x.*")
    for pattern in PATTERNS.values():
        seen = seen.withColumn("near", F.regexp_replace("near", pattern, " "))
    words = F.filter(F.split(_folded(F.col("near")), _NOT_WORD), lambda t: F.length(t) >= shortest)
    # per document each entity and each pair once, so that counts are documents
    rows = stage(seen.select("row", "entity", F.explode_outer(F.array_distinct(words)).alias("term")).distinct(), "contexts")
    entities = rows.select("row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("df_entity"))
    pairs = rows.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("df_both")).where(F.col("df_both") >= support)
    pairs = stage(pairs.join(entities, "entity"), "pairs")
    frequent = docs.select(F.explode(_terms(text, shortest)).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    frequent = frequent.where(F.col("df_term") >= support)
    total = docs.count()
    # df(t) counts whole documents, so it is at least df(t, e)
    content = F.log(F.lit(float(total)) / F.col("df_entity"))
    disclosure = 1 - F.log(F.greatest(F.col("df_term"), "df_both") / F.col("df_both")) / content
    judged = pairs.where(F.col("df_entity") < total).join(frequent, "term").select("term", disclosure.alias("disclosure"))
    return judged.where(F.col("disclosure") >= threshold).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def _with_terms(docs: DataFrame, revealing: DataFrame, shortest: int) -> DataFrame:
    """docs with a column of the revealing terms of each text (null: none) and one of its entities."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.xxhash64(text).alias("key"), F.explode(_terms(text, shortest)).alias("term"))
    own = words.join(revealing, "term").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("term", "disclosure"))).alias("revealing"))
    own = stage(own.withColumnRenamed("key", "pii_key"), "revealing")
    held = docs.withColumn("pii_key", F.xxhash64(text)).withColumn("pii_entities", entity_spans(text))
    return held.join(own.withColumnRenamed("revealing", "pii_terms"), "pii_key", "left")


def _all_spans(entities: Column, terms: Column) -> Column:
    """Entities and, where they do not overlap one, revealing terms."""
    text = _folded(F.coalesce(F.col("text"), F.lit("")))
    either = F.array_join(F.transform(terms, lambda t: t["term"]), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), either, F.lit(r")(?![\p{L}\p{N}])"))
    found = _spans(text, pattern, F.coalesce(F.size(terms) > 0, F.lit(False)), F.lit("term"))
    free = F.filter(found, lambda s: ~F.exists(entities, lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"])))
    return F.concat(entities, free)


def find(docs: DataFrame, shortest: int = 3, **options) -> DataFrame:
    """(doc_id, entities, spans) per document: entities by pattern, and these together
    with the spans of revealing terms; each span has kind, start, end and value."""
    own = docs.select("doc_id", "text")
    revealing = stage(disclosing_terms(own, shortest=shortest, **options), "terms")
    held = _with_terms(own, revealing, shortest)
    return held.select("doc_id", F.col("pii_entities").alias("entities"), _all_spans(F.col("pii_entities"), F.col("pii_terms")).alias("spans"))


def sanitise(docs: DataFrame, shortest: int = 3, remove_from: float = 0.999, **options) -> DataFrame:
    """docs with placeholders for entities and generalised terms, and without the terms
    that disclose at least remove_from. n_chars, where there is one, follows."""
    revealing = stage(disclosing_terms(docs.select("text"), shortest=shortest, **options), "terms")
    held = _with_terms(docs.select(F.struct(*docs.columns).alias("pii_row"), "text"), revealing, shortest)
    strong = F.transform(F.filter("pii_terms", lambda t: t["disclosure"] >= remove_from), lambda t: t["term"])
    held = held.withColumn("pii_spans", _all_spans(F.col("pii_entities"), F.col("pii_terms"))).withColumn("pii_strong", strong)

    def shown(span: Column) -> Column:
        label = F.lit(PLACEHOLDERS["term"])
        for kind in PATTERNS:
            label = F.when(span["kind"] == kind, F.lit(PLACEHOLDERS[kind])).otherwise(label)
        gone = (span["kind"] == "term") & F.coalesce(F.array_contains("pii_strong", span["value"]), F.lit(False))
        return F.when(gone, F.lit(PLACEHOLDERS["gone"])).otherwise(label)

    def step(so_far: Column, span: Column) -> Column:
        gap = F.substring(F.col("text"), so_far["at"] + 1, span["start"] - so_far["at"])
        later = F.struct(span["end"].alias("at"), F.concat(so_far["out"], gap, shown(span)).alias("out"))
        inside = F.struct(F.greatest(so_far["at"], span["end"]).alias("at"), so_far["out"].alias("out"))
        return F.when(span["start"] >= so_far["at"], later).otherwise(inside)

    ordered = F.array_sort("pii_spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))
    rest = F.substring(F.col("text"), F.col("pii_done.at") + 1, F.length("text"))
    held = held.withColumn("pii_done", F.when(F.size("pii_spans") > 0, F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)))
    clean = F.when(F.size("pii_spans") > 0, F.concat("pii_done.out", rest)).otherwise(F.col("text"))
    own = {c: F.col("pii_row")[c] for c in docs.columns} | {"text": clean}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.size("pii_spans") > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return held.select(*(value.alias(name) for name, value in own.items()))
