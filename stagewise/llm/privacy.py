r"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Protected entities are the personal data that patterns find: addresses of mail
and hosts, card and phone numbers, with their places in the text. What stands
around them may reveal them too. For every term of a document that holds an
entity, wherever it stands there, the corpus tells how many documents hold the
term (all documents, whole texts), the entity, and both. With these,
``PMI(entity; term) = log2(N * both / (with_entity * with_term))`` is what the
term tells about the entity, and ``IC(entity) = log2(N / with_entity)`` all
that can be told. A term that leaves less than ``generalise_bits`` of it open
is replaced by its class wherever it stands, and one that leaves less than
``remove_bits`` is removed. Both need ``support`` different contexts, so copies
of one document do not make its words telling.

A context is what surrounds the term (``CONTEXT_WORDS`` words on each side)
together with what surrounds the entity in that document (``CONTEXT_CHARS`` code
points on each side of each mention). Words inside an entity are terms of the
document's other entities only. Words of one or two characters are terms if one of
them near an entity is not all lower-case letters ("Li", "42"): "to" is none.

All counts are added up before they are shuffled, so common words and very
common entities make no hot task. ``open_bits`` is ``log2(with_term / both)``,
and ``both`` is at most the entity's documents, so terms in too many documents
for every entity they meet are left out before the two are paired; this drops
no term that the counts would keep.

Defined results: a null text is an empty one without spans; equal rows are
documents of their own; a null id is kept; an empty table gives an empty
result; further columns are not read. Matches that fail their check are
dropped and not tried again from within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import staged

CONTEXT_CHARS = 48
CONTEXT_WORDS = 8
SUPPORT = 3
REMOVE_BITS = 1.0
GENERALISE_BITS = 2.0
#: At most so many terms that cannot tell anything are sent to all executors, those in most documents first.
COMMON = 50_000
#: Up to so many keys are sent to all executors as 64-bit hashes, to leave out most rows before a shuffle; beyond it all are shuffled.
SENT = 2_000_000

#: Fixed kinds in their order, and patterns. \G and the lookbehind start a match where a run of its characters starts or
#: where the last match ended: the places that a search from the left tries first, without trying all others in the run.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
NO_WORD = r"[^\p{L}\p{N}]+"
LIKE_A_NAME = r"[^\p{Ll}]|..."
SPANS = "array<struct<start:int,stop:int,value:string>>"


def matches(text: Column, pattern: Column) -> Column:
    """Places and values of all matches from the left: matches, and what lies between them, in code points."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))
    begin = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {SPANS})").alias("spans"))
    return F.aggregate(
        F.filter(pieces, lambda x: x["value"].isNotNull()),
        begin,
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("at"),
            F.concat(
                s["spans"],
                F.array(
                    F.struct(
                        (s["at"] + F.char_length(x["gap"])).alias("start"),
                        (s["at"] + F.char_length(x["gap"]) + F.char_length(x["value"])).alias("stop"),
                        x["value"].alias("value"),
                    )
                ),
            ).alias("spans"),
        ),
    )["spans"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum: from the right, every second one doubled, its own digits added."""
    places = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""),
        lambda x, k: F.when(k % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(places, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.char_length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


#: Texts without these characters cannot hold the kind, and skip its pattern.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def base_spans(text: Column, kind: str) -> Column:
    """Checked matches of one kind."""
    found = F.filter(matches(text, F.lit(PATTERNS[kind])), lambda x: _valid(kind, x["value"]))
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(F.expr(f"CAST(array() AS {SPANS})")) if kind in _NEEDS else found


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT_CHARS) -> DataFrame:
    """One written row per document: ``id``, ``hash`` of the text, the spans of each kind, and ``seen``: entities with their surroundings."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("hash"), "text", *(base_spans(text, kind).alias(kind) for kind in KINDS))
    # One code point more on each side where the text goes on: a word that runs over the window's edge is left out, a whole one is not.
    before = lambda x: F.when(x["start"] <= context, F.substring(text, F.lit(1), x["start"])).otherwise(
        F.regexp_replace(F.substring(text, F.greatest(x["start"] - context, F.lit(1)), F.lit(context + 1)), r"^(?:[\p{L}\p{N}]+|[^\p{L}\p{N}])", "")
    )
    after = lambda x: F.when(F.char_length(text) <= x["stop"] + context, F.substring(text, x["stop"] + 1, F.lit(context))).otherwise(
        F.regexp_replace(F.substring(text, x["stop"] + 1, F.lit(context + 1)), r"(?:[\p{L}\p{N}]+|[^\p{L}\p{N}])\z", "")
    )
    around = lambda x: F.concat_ws("\n", before(x), after(x))

    def with_context(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.concat(F.lit(f"{kind}:"), F.lower(x["value"])).alias("entity"), around(x).alias("around")))

    seen = F.concat(*map(with_context, KINDS))
    words = F.when(F.greatest(*map(F.size, KINDS)) > 0, F.split(_outside(text), NO_WORD, -1))
    return staged(rows.select("id", "hash", *KINDS, seen.alias("seen"), words.alias("words")), "privacy-entities")


def _outside(text: Column) -> Column:
    """The text without its spans, a line break in the place of each."""
    places = F.concat(*(F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))) for kind in KINDS))
    rest = lambda s, stop: F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(stop - s["at"], F.lit(0))))
    return F.aggregate(
        F.array_sort(places),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.concat(rest(s, x["start"]), F.lit("\n")).alias("out")),
        lambda s: rest(s, F.char_length(text)),
    )


def _mentions() -> Column:
    """All words of a document that holds an entity: ``term``, ``name`` (whether it makes a term), ``window`` (a hash of what surrounds it), and ``inside``, the entity that it is a part of."""
    side = CONTEXT_WORDS
    word = lambda w, window, inside: F.struct(F.lower(w).alias("term"), w.rlike(LIKE_A_NAME).alias("name"), window.alias("window"), inside.alias("inside"))
    window = lambda k: F.xxhash64(F.slice("words", F.greatest(k - side + 1, F.lit(1)), F.least(k, F.lit(side)) + side + 1))
    free = F.transform("words", lambda w, k: word(w, window(k), F.lit(None).cast("string")))
    parts = F.transform("seen", lambda x: F.transform(F.split(F.regexp_replace(x["entity"], "^[a-z]+:", ""), NO_WORD, -1), lambda w: word(w, F.xxhash64(x["around"]), x["entity"])))
    return F.filter(F.concat(free, F.flatten(parts)), lambda x: x["term"] != "")


def _same_document() -> Column:
    return F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash"))


def telling_terms(found: DataFrame, texts: DataFrame, support: int = SUPPORT, bits: float = GENERALISE_BITS) -> DataFrame:
    """Terms that disclose an entity: ``term`` and ``open_bits``, the least that it leaves open of any entity; also the ``entity`` it is least for, ``pmi`` and ``ic``."""
    total = found.count()
    held = found.where(F.col("words").isNotNull())
    places = held.select("id", "hash", F.explode("seen").alias("x")).select(F.col("id").alias("of"), F.col("hash").alias("of_hash"), "x.entity", F.xxhash64("x.around").alias("around"))
    holds = staged(places.distinct().groupBy("entity", "of", "of_hash").agg(F.bit_xor("around").alias("around")), "privacy-holds")
    holds = staged(holds.join(holds.groupBy("entity").agg(F.count("*").alias("with_entity")), "entity"), "privacy-held-by")
    # Documents of one key would get the larger number, which leaves out less.
    most = holds.groupBy(F.xxhash64("of", "of_hash").alias("key")).agg(F.max("with_entity").alias("most"))
    most = F.broadcast(most) if most.count() <= SENT else most
    near = held.join(most, F.xxhash64("id", "hash") == F.col("key")).select("id", "hash", "most", _mentions().alias("mentions"))
    near = staged(near, "privacy-near")
    # No pair has more documents than its entity, than the term's mentions near any, and no more contexts than these.
    terms = near.select("most", F.explode("mentions").alias("x")).groupBy("x.term").agg(F.count("*").alias("near"), F.max("most").alias("most"), F.max("x.name").alias("name"))
    terms = _words(texts).groupBy("term").agg(F.count("*").alias("with_term")).join(terms, "term")
    low = lambda both: F.log2(F.col("with_term") / both) < bits + 1e-6
    terms = staged(terms.withColumn("open", F.col("name") & (F.col("near") >= support) & low(F.least("near", "most"))), "privacy-terms-near")
    common = terms.where(~F.col("open")).orderBy(F.desc("near"), "term").limit(COMMON).select("term")
    rows = near.select("id", "hash", F.explode("mentions").alias("x")).select("id", "hash", "x.term", "x.window", "x.inside")
    rows = _near(rows, terms.where("open").select(F.xxhash64("term").alias("key")), "term").join(F.broadcast(common), "term", "left_anti")
    rows = rows.join(terms.where("open").select("term", "with_term"), "term")
    rows = rows.join(holds, _same_document()).where(low(F.col("with_entity")) & (F.col("inside").isNull() | (F.col("inside") != F.col("entity"))))
    rows = rows.select("entity", "term", "id", "hash", "with_entity", "with_term", F.xxhash64("window", "around").alias("context"))
    rows = staged(rows.distinct(), "privacy-pairs")
    # Every context counts, also several of one document and one that stands in many.
    pair = ["entity", "term", "with_entity", "with_term"]
    contexts = rows.groupBy(*pair, "context").agg(F.lit(1).alias("one")).groupBy(*pair).agg(F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    both = rows.groupBy(*pair, "id", "hash").agg(F.lit(1).alias("one")).groupBy(*pair).agg(F.count("*").alias("both"))
    scored = both.join(contexts, pair)
    ic = F.log2(F.lit(float(max(total, 1))) / F.col("with_entity"))
    pmi = F.log2(F.lit(float(max(total, 1))) * F.col("both") / (F.col("with_entity") * F.col("with_term")))
    scored = scored.select("term", "entity", pmi.alias("pmi"), ic.alias("ic")).withColumn("open_bits", F.col("ic") - F.col("pmi"))
    best = F.min_by(F.struct("entity", "pmi", "ic"), F.struct("open_bits", "entity")).alias("best")
    telling = scored.where(F.col("open_bits") < bits).groupBy("term").agg(F.min("open_bits").alias("open_bits"), best)
    return staged(telling.select("term", "open_bits", "best.*"), "privacy-terms")


def _words(texts: DataFrame, *keep: str) -> DataFrame:
    return texts.select(*keep, F.explode(F.array_distinct(F.split(F.lower("text"), NO_WORD, -1))).alias("term"))


def _near(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``rows`` without most of those whose hash of ``columns`` is not the ``key`` of any of ``keys``."""
    keys = keys.select("key").distinct()
    return rows.join(F.broadcast(keys), F.xxhash64(*columns) == F.col("key"), "left_semi") if keys.count() <= SENT else rows


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise_bits: float = GENERALISE_BITS, remove_bits: float = REMOVE_BITS) -> DataFrame:
    """One row per document: ``id``, ``hash`` of the text, the spans of each kind, and ``term``: spans of telling terms, with ``label`` "" (removed) or "[TERM]" (generalised)."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    found = entities(docs, id_col, text_col)
    terms = telling_terms(found, texts, support, generalise_bits).select("term", "open_bits")
    words = _near(_words(texts, "id", "hash"), terms.select(F.xxhash64("term").alias("key")), "term")
    held = words.join(terms, "term").groupBy("id", "hash").agg(F.collect_set(F.struct("term", "open_bits")).alias("telling"))
    held = staged(held.select(F.col("id").alias("of"), F.col("hash").alias("of_hash"), "telling"), "privacy-held")
    texts = _near(texts, held.select(F.xxhash64("of", "of_hash").alias("key")), "id", "hash")
    names = F.array_join(F.array_sort(F.transform("telling", lambda x: x["term"])), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), names, F.lit(r")(?![\p{L}\p{N}])"))
    removed = F.transform(F.filter("telling", lambda x: x["open_bits"] < remove_bits), lambda x: x["term"])
    label = lambda x: F.when(F.array_contains("removed", F.lower(x["value"])), "").otherwise("[TERM]")
    places = texts.join(held, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash"))).withColumn("removed", removed)
    places = places.select("of", "of_hash", matches(F.col("text"), pattern).alias("term"), "removed")
    places = places.withColumn("term", F.transform("term", lambda x: F.struct(x["start"], x["stop"], label(x).alias("label")))).drop("removed")
    places = staged(places.dropDuplicates(["of", "of_hash"]), "privacy-places")
    rows = found.drop("seen", "words").join(places, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    none = F.expr("CAST(array() AS array<struct<start:int,stop:int,label:string>>)")
    return rows.select("id", "hash", *KINDS, F.coalesce("term", none).alias("term"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``text_col`` sanitised: personal data become their kind, telling terms their class or nothing; overlapping spans become one."""
    found = spans(docs, id_col, text_col, **options).dropDuplicates(["id", "hash"])

    def labelled(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"], x["stop"], F.lit(f"[{kind.upper()}]").alias("label")))

    every = F.concat(*map(labelled, KINDS), F.col("term"))
    merged = F.aggregate(
        F.array_sort(every),
        F.expr("CAST(array() AS array<struct<start:int,stop:int,label:string>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] > x["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"), F.element_at(done, -1)["label"].alias("label"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    found = found.select(F.col("id").alias("span_id"), F.col("hash").alias("span_hash"), F.when(F.size(every) > 0, merged).otherwise(every).alias("cut"))
    whole = docs.select(F.struct(*docs.columns).alias("whole"))
    text = F.coalesce(F.col(f"whole.{text_col}"), F.lit(""))
    met = whole.withColumn("hash", F.xxhash64(text)).join(found, F.col(f"whole.{id_col}").eqNullSafe(F.col("span_id")) & (F.col("hash") == F.col("span_hash")), "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    built = F.aggregate(
        "cut",
        begin,
        lambda s, x: F.struct(x["stop"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), x["label"]).alias("out")),
    )
    clean = F.when(F.size("cut") > 0, F.concat(built["out"], F.substring(text, built["at"] + 1, F.char_length(text)))).otherwise(F.col(f"whole.{text_col}"))
    return met.select(*(clean.alias(c) if c == text_col else F.col(f"whole.{c}") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    got = spans(docs)
    named = lambda kind: F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["stop"]))
    base = F.concat(*(named(kind) for kind in KINDS))
    return got.select(
        F.col("id").alias("doc_id"),
        *(F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, named("term")), ",").alias("spans"),
    )
