"""Personal data: pattern spans and information-theoretic sanitisation of what reveals them.

Base spans are the emails, IP addresses, card and phone numbers of the text. Each
distinct value is a protected entity e with information content IC(e) = log(N / df(e)).
A term t near an entity reveals it by PMI(e, t) = log(N df(e, t) / (df(e) df(t))); document
frequencies are counted over the whole corpus. Where PMI reaches ``disclosure`` of IC(e)
(1: the term tells the entity for sure) all spans of the term in the texts that hold
the entity are sanitised too: digits and capitalised names are removed, other terms
generalised to a word class.

All terms of the texts that hold an entity are looked at, wherever they stand. PMI reaches
the disclosure only while df(t) <= df(e, t) (N / df(e)) ** (1 - disclosure), and df(e, t) is
at most df(e): terms above that leave before any pair is formed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import NO_ID, row_key, small, texts
from cartwise.session import stage

KINDS = ("email", "ip", "card", "phone")
#: A run begins where no character of its class stands before, or where the last match
#: ended; with possessive quantifiers the matches are the plain patterns' leftmost ones, but a
#: long run is read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of fewer than 13 digits fail anyway and, being maximal, hide no other match.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: ' _ - join a word, they never begin or end it: a name in quotes, underscores or dashes is the
#: name. Mentions' texts and frequencies are read by this one pattern.
TERM = r"[\p{L}\p{N}]++(?:['_-]++[\p{L}\p{N}]++)*+"
#: Matches that are walked through at a time, so that no long list is copied for each match.
BLOCK = 512
#: Rows that carry lists are broadcast below this count.
LIST_ROWS = 100_000
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def matches(text: Column, pattern: str, kind: str, when: Column) -> Column:
    """Spans (kind, start, end, value) of the leftmost non-overlapping matches, in code points.

    A split by the same pattern gives the texts between the matches, so a match starts after
    all the pieces and matches before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(when & (F.size(found) > 0), occurrences(text, pattern, kind, lambda s: F.lit(True))).otherwise(
        F.array().cast(SPAN))


def in_blocks(items: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """(at, out) after all items: ``step(state, item)`` gives the next state, ``out`` grown by at most
    one element of type ``kind``. Lists are joined block by block, so no long list is copied for
    each item and time grows with the items, not with their square."""
    none = F.array().cast(f"array<{kind}>")
    state = lambda at: F.struct(at.alias("at"), none.alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK)),
                         lambda b: F.slice(items, b + 1, BLOCK))
    return F.aggregate(
        blocks, F.struct(state(F.lit(0).cast("long")).alias("now"), F.array().cast(f"array<array<{kind}>>").alias("before")),
        lambda acc, block: F.struct(F.aggregate(block, state(acc["now"]["at"]), step).alias("now"),
                                    F.concat(acc["before"], F.array(acc["now"]["out"])).alias("before")),
        lambda acc: F.struct(acc["now"]["at"].alias("at"), F.concat(F.flatten(acc["before"]), acc["now"]["out"]).alias("out")))


def occurrences(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column]) -> Column:
    """The spans of all matches that ``keep`` holds for; what is not kept copies nothing."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)),
                       lambda v, p: F.struct(F.length(p).cast("long").alias("gap"), v.alias("value")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(keep(span), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return in_blocks(steps, "struct<kind:string,start:bigint,end:bigint,value:string>", add)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))),
        F.lit(0), lambda n, d: n + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The valid spans by kind; matches that fail their check are dropped, not retried."""
    size = lambda s: F.length(_digits(s["value"]))
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    value = lambda p: F.coalesce(F.try_to_number(F.ltrim(p, F.lit("0")), F.lit("999")), F.lit(0))
    return {
        "email": matches(text, EMAIL, "email", F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP, "ip", F.contains(text, F.lit("."))),
                       lambda s: F.forall(F.split(s["value"], r"\."), lambda p: part(p) & (value(p) <= 255))),
        "card": F.filter(matches(text, CARD, "card", F.lit(True)),
                         lambda s: (size(s) <= 19) & _luhn(s["value"])),
        "phone": F.filter(matches(text, PHONE, "phone", F.contains(text, F.lit("+"))),
                          lambda s: size(s).between(9, 15)),
    }


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def all_terms(text: Column) -> Column:
    """The distinct terms of a text, lower-cased one by one."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _signature(texts_of: str) -> list[Column]:
    """A set of texts in two aggregates: equal sets have equal ones."""
    return [F.bit_xor(F.xxhash64(F.lit(i), texts_of)).alias(f"x{i}") for i in (1, 2)]


def find_personal_data(docs: DataFrame, disclosure: float = 0.8, support: int = 2) -> DataFrame:
    """(doc_id, base, terms, n_email, n_ip, n_card, n_phone and the row key) for every row.

    ``base`` and ``terms`` are arrays of (kind, start, end, value); terms (kind ``term``) never
    overlap a base span or each other. ``support`` is the least number of distinct texts
    that hold entity and term together: a single text estimates nothing. Copies of a text
    count once in all frequencies. Null and empty texts have no spans; repeated rows get the
    same spans; an empty table gives no rows.
    """
    t = row_key(texts(docs))
    kinds = base_spans(F.col("text"))
    # Stored once: the patterns are read once and the rest works on the mentions alone.
    every = stage(
        t.select("doc_id", "_id", "_th", *[c.alias(k) for k, c in kinds.items()])
        .select("doc_id", "_id", "_th", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                F.concat(*KINDS).alias("base")), "op8-base")
    found = every.filter(F.size("base") > 0)

    # Frequencies over distinct texts; a text's copies are answered by the least of their ids.
    total = float(every.select("_th").distinct().count())
    mentions = (found.select("_th", F.explode("base").alias("m"))
                .select("_th", F.xxhash64("m.kind", F.lower("m.value")).alias("e")).distinct())
    # Entities of the same texts reveal and are revealed alike: one class, known by its texts.
    of_entity = stage(mentions.groupBy("e").agg(F.count("*").alias("of_e"), *_signature("_th"))
                      .filter((F.col("of_e") >= support) & (F.col("of_e") < total))
                      .select("e", "of_e", F.xxhash64("of_e", "x1", "x2").alias("ec")), "op8-entities")
    # The disclosure rule, solved for of_t with ``both`` texts that hold the pair.
    most = lambda both, of_e: both * F.pow(F.lit(total) / of_e, F.lit(1 - disclosure)) * 1.0001
    held = stage(mentions.join(small(of_entity), "e").select("_th", "ec", "of_e").distinct().groupBy("_th")
                 .agg(F.collect_list(F.struct("ec", "of_e")).alias("es")), "op8-held")
    first = stage(found.select("_id", "_th").join(small(held, LIST_ROWS), "_th").groupBy("_th")
                  .agg(F.min("_id").alias("_id"), F.first("es").alias("es")), "op8-first")
    words = stage(t.join(small(first, LIST_ROWS), ["_id", "_th"]).select("_th", "es", all_terms(F.col("text")).alias("ts"))
                  .dropDuplicates(["_th"]), "op8-words")

    # How many distinct texts hold a term, summed up before the exchange; of copies one is read.
    copies = stage(every.groupBy("_th").agg(F.min("_id").alias("_id"), F.count("*").alias("n"))
                   .filter(F.col("n") > 1).drop("n"), "op8-copies")
    once = (t.join(small(copies.select("_th")), "_th", "left_anti").select("text").unionByName(
        t.join(small(copies), ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("text")))
    limit = of_entity.agg(F.max(most(F.col("of_e"), F.col("of_e")))).first()[0] or 0.0
    beside = stage(words.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
                   .filter(F.col("n") >= support).select("t"), "op8-beside")
    of_term = once.select(F.explode(all_terms(F.col("text"))).alias("t"))
    if beside.count() <= LIST_ROWS:  # no other term is counted then
        of_term = of_term.join(F.broadcast(beside), "t", "left_semi")
    of_term = of_term.groupBy("t").agg(F.count("*").alias("of_t"))
    rare = stage(of_term.filter(F.col("of_t") <= limit).join(beside, "t"), "op8-rare")

    # Terms of the same texts, beside entities and in all, are one class too.
    posted = stage(words.select("_th", F.explode("ts").alias("t")).join(small(rare), "t"), "op8-posted")
    classes = stage(posted.groupBy("t", "of_t").agg(F.count("*").alias("n"), *_signature("_th"))
                    .select("t", F.xxhash64("of_t", "n", "x1", "x2").alias("tc")), "op8-terms")
    pairs = stage(
        posted.join(small(classes), "t").select("_th", "tc", "of_t").distinct().join(words.select("_th", "es"), "_th")
        .select("_th", "tc", "of_t", F.explode(F.filter(
            "es", lambda e: F.col("of_t") <= most(e["of_e"], e["of_e"]))).alias("x"))
        .select("_th", "tc", "of_t", "x.ec", "x.of_e"), "op8-pairs")
    revealing = stage(
        pairs.groupBy("ec", "tc", "of_e", "of_t").agg(F.count("*").alias("both"))
        .filter(F.col("both") >= support)
        .withColumn("ic", F.log2(F.lit(total) / F.col("of_e")))
        .withColumn("pmi", F.log2(F.lit(total) * F.col("both") / (F.col("of_e") * F.col("of_t"))))
        .filter((F.col("ic") > 0) & (F.col("pmi") >= F.lit(disclosure) * F.col("ic")))
        .select("ec", "tc"), "op8-revealing")

    # Every occurrence in every text that holds the entity.
    told = pairs.join(small(revealing), ["ec", "tc"]).select("_th", "tc").distinct()
    sets = stage(told.join(small(classes), "tc").groupBy("_th").agg(F.collect_set("t").alias("ts")), "op8-sets")
    wanted = stage(found.select("_id", "_th", "base").distinct().join(small(sets, LIST_ROWS), "_th"), "op8-wanted")
    keep = lambda s: F.array_contains("ts", F.lower(s["value"])) & ~F.exists(
        "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans = (t.join(small(wanted, LIST_ROWS), ["_id", "_th"])
             .select("_id", "_th", occurrences(F.col("text"), TERM, "term", keep).alias("terms"))
             .dropDuplicates(["_id", "_th"]))
    return (every.join(small(stage(spans, "op8-spans"), LIST_ROWS), ["_id", "_th"], "left")
            .withColumn("terms", F.coalesce("terms", F.array().cast(SPAN))))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from ``find_personal_data``."""
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "terms")).alias("spans"))


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """The documents with their personal data replaced, other columns as they were.

    A base span becomes its kind in brackets; of the revealing terms those with digits or a
    capital are removed (``[REMOVED]``), the others generalised (``[WORD]``). Where base spans
    of two kinds overlap the earlier start (then the longer) wins and the other's rest goes too.
    ``n_chars`` is counted anew where present; null texts stay null.
    """
    spans = find_personal_data(docs, **limits)
    s = F.array_sort(F.concat("base", "terms"), lambda a, b: F.when(
        a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1)).otherwise(0))
    mark = lambda x: F.when(x["kind"] != "term", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))) \
        .when(x["value"].rlike(r"[\p{Lu}\p{N}]"), F.lit("[REMOVED]")).otherwise(F.lit("[WORD]"))  # noqa: E731,E501
    whole = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
    walked = in_blocks(s, "string", lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.concat(
            whole.substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), mark(x)))))
        .alias("out")))
    some = stage(spans.filter(F.size("base") > 0).select("_id", "_th", "base", "terms").distinct(), "op8-found")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"), F.struct("*").alias("row"))
    # The spans go to the texts: whole texts are not dealt out.
    out = (keyed.join(small(some, LIST_ROWS), ["_id", "_th"], "left")
           .withColumn("w", F.when(F.col("base").isNotNull(), walked)))
    text = F.when(F.col("base").isNull(), F.col("row")["text"]).otherwise(F.concat(
        F.array_join("w.out", ""), whole.substr((F.col("w.at") + 1).cast("int"), F.length(whole))))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
