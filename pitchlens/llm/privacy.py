"""Personal data, and the terms that give it away, on built-in functions only.

Base spans (mail addresses, IP addresses, card and phone numbers) are found by pattern in every whole
text. Their values are the protected entities; the account name of a mail address is one, too, so
evidence of a person with several providers is pooled. Information theory then says which other words
disclose an entity: of the information IC(e) = -log2 P(e) that an entity carries, a term that occurs
with it tells PMI(e; t). What is left to guess is

    IC(e) - PMI(e; t)  =  -log2 P(e | t)    bits.

P(e | t) is the lower end of its confidence interval (Wilson), so the fewer texts speak for a
disclosure, the less it counts, without a least number of texts; copies of a text count for the share,
not for the confidence. A word that is itself part of the account name counts once more. In documents
that hold the entity, terms that leave ``generalise`` bits or less are generalised, those that leave
``remove`` bits or less are removed. The measure does not depend on the size of the corpus.

Domains and beginnings of numbers are no entities: with m holders they leave log2(m) bits at least.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlens.llm.common import among, let, table
from pitchlens.staging import stage

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone", "term")
# The patterns of the four kinds, written so that a long run of characters is scanned once: a match
# starts where a run starts or where the last match has ended (\G), and takes what it can
# without going back (++). Cards ask for their 12 digits at once; shorter runs fail in any case.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LETTERS = r"\p{L}+"
#: Terms of a text that one step pairs with its entities; long texts have several such parts.
PART_TERMS = 1024
SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"


def _found(text: Column, pattern: str, rank: int, hint: str | None, valid, keep_value) -> Column:
    """Spans of the matches that are ``valid``, in code points."""
    none = F.array().cast(SPAN)

    def places(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def add(acc: Column, i: Column) -> Column:
            match = F.element_at(matches, i)
            begin = acc["at"] + F.char_length(F.element_at(gaps, i))
            stop = begin + F.char_length(match)
            span = F.struct(
                begin.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), keep_value(match).alias("value")
            )
            out = F.when(valid(match), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct(stop.alias("at"), out.cast(SPAN).alias("out"))

        steps = F.sequence(F.lit(1), F.size(matches))
        return F.when(F.size(matches) > 0, F.aggregate(steps, start, add, lambda acc: acc["out"])).otherwise(none)

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)
    return spans if hint is None else F.when(F.contains(text, F.lit(hint)), spans).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    def good(d: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            x = F.substring(F.reverse(d), i, F.lit(1)).try_cast("int")
            double = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
            return total + F.when(i % 2 == 0, double).otherwise(x)

        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)
        return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)

    return let(_digits(match), good)


def _octets(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(match, r"\."), small)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind; ``value`` is the normalised entity."""
    every = [
        _found(text, EMAIL, 0, "@", lambda m: F.lit(True), F.lower),
        _found(text, IP, 1, ".", _octets, lambda m: m),
        _found(text, CARD, 2, None, _luhn, _digits),
        _found(text, PHONE, 3, "+", lambda m: F.length(_digits(m)).between(9, 15), _digits),
    ]
    return F.array_sort(F.concat(*every))


def _term_spans(text: Column, flagged: Column) -> Column:
    """Spans of the words whose lower-cased form is among the keys of the map ``flagged``."""
    return _found(
        text, LETTERS, 4, None,
        lambda m: F.map_contains_key(flagged, F.lower(m)),
        lambda m: F.element_at(flagged, F.lower(m)),
    )


def _terms(text: Column) -> Column:
    """The distinct words of a text outside its mail addresses."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(LETTERS), F.lit(0)), F.lower))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ","
    )


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with a mark in place of each span; overlapping spans get one mark."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:4]))

    def add(acc: Column, s: Column) -> Column:
        mark = F.when(s["rank"] < 4, F.element_at(names, F.least(s["rank"], F.lit(3)) + 1)).otherwise(s["value"])
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], kept, mark)).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        spans, start, add, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text)))
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _entities(spans: Column) -> Column:
    """The distinct entities of a text as hashes: values of spans, and account names of addresses."""
    values = F.transform(spans, lambda s: F.xxhash64(s["rank"], s["value"]))
    mails = F.filter(spans, lambda s: s["rank"] == 0)
    return F.array_distinct(F.concat(values, F.transform(mails, lambda s: _account(s["value"]))))


def _account(mail: Column) -> Column:
    return F.xxhash64(F.lit(-1), F.substring_index(mail, "@", 1))


def _own_words(spans: Column, terms: Column) -> Column:
    """(account, word) for the words of account names that are also terms of the text."""
    mails = F.filter(spans, lambda s: s["rank"] == 0)

    def words(s: Column) -> Column:
        found = F.regexp_extract_all(F.substring_index(s["value"], "@", 1), F.lit(LETTERS), F.lit(0))
        inside = F.array_intersect(found, terms)
        return F.transform(inside, lambda w: F.struct(_account(s["value"]).alias("e"), w.alias("t")))

    return F.array_distinct(F.flatten(F.transform(mails, words)))


def bits_left(both: Column, with_term: Column, texts: Column, z: float) -> Column:
    """-log2 of the least P(e | t) to expect, from ``both`` of ``with_term`` documents.

    ``texts`` is the number of different texts among ``both``, which the confidence comes from.
    """
    p = both / with_term
    n = texts / p
    middle = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return -F.log2((middle - spread) / (1 + z * z / n))


def disclosing_terms(docs: DataFrame, generalise: float = 1.0, remove: float = 0.5, z: float = 1.28) -> DataFrame:
    """The terms to treat in each text that holds personal data.

    ``docs``: ``text``, ``k1``, ``k2``. Returns ``k1``, ``k2`` and ``flagged``, a map from term to what it
    is replaced by. All counts are over all documents. Null texts hold nothing; an empty table gives no rows.

    Three exact bounds keep the pairs of entities and terms few. Even a term that never occurs without the
    entity leaves too much unless as many texts as ``z`` asks for hold both. A term whose documents
    mostly hold no such entity discloses none. And entities that occur in the same texts, such as
    the addresses of one long list, are one class. Long texts form their pairs in parts.
    """
    share = 2.0 ** -generalise
    least = z * z * share / (1 - share) if share < 1 else math.inf
    text = F.col("text")
    known = docs.filter("text is not null").withColumn("base", base_spans(text)).filter(F.size("base") > 0)
    known = known.groupBy("k1", "k2").agg(
        F.first(F.struct("text", "base")).alias("row"), F.count(F.lit(1)).alias("c")
    )
    known = known.select("k1", "k2", "c", _terms(F.col("row.text")).alias("ts"), F.col("row.base").alias("base"))
    known = known.select(
        "k1", "k2", "c", "ts", _entities(F.col("base")).alias("es"), _own_words(F.col("base"), F.col("ts")).alias("own")
    )
    known = stage(known, "privacy-texts")

    # Classes of entities that enough texts hold, by the set of these texts.
    held = known.select("k1", "k2", F.explode("es").alias("e"))
    places = [F.bit_xor(F.xxhash64(F.lit(seed), "k1", "k2")).alias(f"at{seed}") for seed in (1, 2)]
    classes = held.groupBy("e").agg(F.count(F.lit(1)).alias("texts"), *places).filter(F.col("texts") >= least)
    classes = classes.select("e", F.xxhash64("texts", "at1", "at2").alias("g"))
    lists = stage(held.join(classes, "e").select("k1", "k2", "g").distinct(), "privacy-classes")

    # Terms that can disclose one of them, and the words of account names; then how often these occur at all.
    of_class = known.join(lists.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    used = of_class.select("c", F.explode("ts").alias("t")).groupBy("t")
    used = used.agg(F.sum("c").alias("near"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= least)
    own = known.select("k1", "k2", "c", F.explode("own").alias("o")).select("k1", "k2", "c", "o.*")
    own_pairs = own.groupBy("e", "t").agg(F.sum("c").alias("both"), F.count(F.lit(1)).alias("texts"))
    wanted = used.select("t", "near").unionByName(own_pairs.select("t", F.lit(0).cast("long").alias("near")))
    wanted = wanted.groupBy("t").agg(F.max("near").alias("near"))
    usage = docs.select(F.explode(_terms(text)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    usage = stage(usage.join(wanted, "t"), "privacy-usage")
    telling = usage.filter(F.col("near") >= F.col("n_t") * share).select("t")

    terms = of_class.select("k1", "k2", "c", F.explode("ts").alias("t")).join(telling, "t")
    terms = terms.withColumn("part", F.pmod(F.xxhash64("t"), F.lit(1 << 20)))
    size = terms.groupBy("k1", "k2").agg(F.ceil(F.count(F.lit(1)) / PART_TERMS).alias("parts"))
    split = lists.join(size, ["k1", "k2"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    terms = terms.join(size, ["k1", "k2"]).withColumn("part", F.pmod("part", "parts"))
    both = terms.join(split.drop("parts"), ["k1", "k2", "part"]).select("k1", "k2", "c", "g", "t")
    pairs = both.groupBy("g", "t").agg(F.sum("c").alias("both"), F.count(F.lit(1)).alias("texts"))

    def sure(pairs: DataFrame, key: str, more: int) -> DataFrame:
        left = bits_left(F.col("both") + more, F.col("n_t") + more, F.col("texts") + more, z)
        told = pairs.join(usage, "t").withColumn("left", left).filter(F.col("left") <= generalise)
        return told.select(key, "t", F.when(F.col("left") <= remove, "[REMOVED]").otherwise("[TERM]").alias("mark"))

    sure_classes = stage(sure(pairs, "g", 0), "privacy-sure")
    met = both.join(sure_classes, ["g", "t"]).select("k1", "k2", "t", "mark")
    met = met.unionByName(own.join(sure(own_pairs, "e", 1), ["e", "t"]).select("k1", "k2", "t", "mark"))
    met = met.groupBy("k1", "k2", "t").agg(F.min("mark").alias("mark"))
    flagged = F.map_from_entries(F.collect_list(F.struct("t", "mark")))
    return stage(met.groupBy("k1", "k2").agg(flagged.alias("flagged")), "privacy-flagged")


def sanitise(
    docs: DataFrame,
    generalise: float = 1.0,
    remove: float = 0.5,
    z: float = 1.28,
    text_col: str = "text",
) -> DataFrame:
    """``doc`` (a row of ``docs`` with all its columns), ``base``, ``spans`` and ``clean``.

    ``base`` holds the base spans; ``spans`` also the terms that disclose an entity of the same text,
    where they do not overlap a base span; ``clean`` is the treated text. Positions are code points.
    A null text has no spans and stays null; copies of a text get equal results; an empty table gives
    no rows. Only texts with
    terms to treat, and few others whose hash meets theirs in a bitmap, are joined with their terms.
    """
    text = F.col("doc").getField(text_col)
    rows = docs.select(F.struct("*").alias("doc"))
    rows = rows.withColumns({"k1": F.xxhash64(text), "k2": F.char_length(text)})
    terms = disclosing_terms(rows.select(text.alias("text"), "k1", "k2"), generalise, remove, z)
    none = F.array().cast(SPAN)
    rows = among(rows, F.col("k1"), terms.select("k1"))
    spans = F.coalesce(base_spans(text), none)
    private = rows.filter("_maybe").join(terms, ["k1", "k2"], "left").withColumn("base", spans)
    more = F.when(F.col("flagged").isNotNull(), _term_spans(text, F.col("flagged")))
    private = private.withColumn("more", F.coalesce(more, none))
    apart = F.filter(
        "more",
        lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])),
    )
    private = private.withColumn("spans", F.array_sort(F.concat("base", apart)))
    plain = rows.filter("not _maybe").withColumn("base", spans).withColumn("spans", F.col("base"))
    clean = _sanitised(text, F.col("spans")).alias("clean")
    return private.select("doc", "base", "spans", clean).unionByName(plain.select("doc", "base", "spans", clean))


def privacy_query(spark, folder: str) -> DataFrame:
    """op6: the contract's columns."""
    done = sanitise(table(spark, folder, "documents").select("doc_id", "text"))

    def number(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    count = [number(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:4])]
    return done.select(
        "doc.doc_id", *count, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )
