"""Personal data, and the terms that give it away.

DataFrame functions only.  Four kinds of personal data are found by patterns
(the protected entities).  The corpus then says how strongly a term reveals an
entity: for the texts that hold the term ``t``, the entity ``e`` within a few
words of it, and both, pointwise mutual information
``PMI(t, e) = log(p(t, e) / (p(t) p(e)))`` is compared with the information of
the entity itself, ``IC(e) = -log p(e)``.  At ``PMI = IC`` the term stands for
the entity.  Terms above the limits are personal data too: they are
generalised, or removed where nearly all their texts hold the entity.

Counts are of different texts, so copies of a document are no evidence.  What
meets across documents are (text, entity, term) rows of the texts with
personal data, and of all texts only those terms that may be revealing: they
are thinned out by slots of fixed number first, then joined exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import WS, WS_CHARS, row_key, thinned, written

#: Fixed by the contract: the kinds in their order, their patterns and limits.  The patterns are written so that no
#: place is read twice: whole runs are taken at once (``++``) from their first character on.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match that counts holds at least (a cheap test before texts are taken apart).
SIGNS = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
         "card": r"(?:[0-9][\x20-]?){11}[0-9]", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
CARD_DIGITS, PHONE_DIGITS, MAX_PART = (12, 19), (9, 15), 255

#: Words on each side of an entity that count as near it; texts that must hold both; least share of the entity's
#: information; least share of the term's texts that hold the entity, to be generalised and to be removed.
RADIUS, MIN_TEXTS, MIN_DEGREE, GENERALISE, REMOVE = 8, 3, 0.8, 0.5, 0.9
#: Signs around a word that are not part of the term.
EDGES = ".,;:!?\"'`()[]{}<>|*#&%$=~_/\\-"
#: Values to a block where positions are summed up.
STEP = 256


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x)


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once a row, however often ``f`` uses it (also inside its own lambdas)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def block_sums(lengths: Column) -> Column:
    """Sums of ``STEP`` values each of an array."""
    n = F.floor((F.size(lengths) + STEP - 1) / STEP).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: total(F.slice(lengths, b * STEP + 1, STEP)))).otherwise(
        F.array().cast("array<bigint>"))


def with_sums(lengths: Column, f) -> Column:
    """``f(before)``, where ``before(i)`` is the sum of the first ``i`` lengths: by whole blocks and the rest, so a long
    array costs little for each place."""
    def on(pair: Column) -> Column:
        def before(i: Column) -> Column:
            b = F.floor(i / STEP).cast("int")
            return total(F.slice(pair["blocks"], F.lit(1), b)) + total(F.slice(pair["lengths"], b * STEP + 1, i - b * STEP))
        return f(before)

    return let(lengths, lambda n: let(F.struct(n.alias("lengths"), block_sums(n).alias("blocks")), on))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    each = F.transform(F.split(F.reverse(number), "", -1), lambda c: c.try_cast("int"))
    return total(F.transform(F.filter(each, lambda d: d.isNotNull()), lambda d, i: value(d, i).cast("long"))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= MAX_PART))
    low, high = CARD_DIGITS if kind == "card" else PHONE_DIGITS
    if kind == "phone":
        return F.length(digits(m)).between(low, high)
    return let(digits(m), lambda d: F.when(F.length(d).between(low, high), luhn(d)).otherwise(False))


def terms_of(words: Column) -> Column:
    """The terms among (lower-cased) words: without the signs around them; what has no letter left is none, nor is an address."""
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(EDGES))),
                    lambda t: t.rlike("[a-z\\x{80}-\\x{10FFFF}]") & (F.instr(t, "@") == 0))


def _gap_words(gap: Column, first: Column, last: Column) -> Column:
    """Terms of the text between two matches; pieces that touch a match are parts of words and do not count."""
    before, after = F.when(first, 0).otherwise(1), F.when(last, 0).otherwise(1)
    return let(F.split(F.lower(gap), f"[{WS}]+", -1),
               lambda p: terms_of(F.slice(p, before + 1, F.greatest(F.size(p) - before - after, F.lit(0)))))


def entities(docs: DataFrame, text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with ``spans`` (array of ``start, kind_no, end``, in code points, by start, then kind) and ``near``
    (``entity`` hash and ``term``, for the terms within ``radius`` words of a span; a word between two matches of a
    kind counts for both of them).

    Matches of a kind are the leftmost ones that do not overlap; those that fail its limits are dropped.
    Null and empty texts have none.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("spans", "near")]
    d = docs.select(*keep, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    none = F.array().cast("array<string>")
    for k in KINDS:
        has = F.col("_t").rlike(SIGNS[k])
        d = d.withColumn(f"_g{k}", F.when(has, F.split("_t", PATTERNS[k], -1)).otherwise(none))
        d = d.withColumn(f"_m{k}", F.when(has, F.regexp_extract_all("_t", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none))
    d = d.drop("_t")
    for k in KINDS:
        d = d.withColumn(f"_l{k}", F.transform(f"_m{k}", lambda m, i: (F.char_length(F.get(f"_g{k}", i)) + F.char_length(m)).cast("long")))  # noqa: B023
        d = d.withColumn(f"_k{k}", F.filter(F.transform(f"_m{k}", lambda m, i: F.struct(m.alias("m"), i.alias("i"))),
                                            lambda x: valid(k, x["m"])))  # noqa: B023
    per = [_of_kind(no, k, radius) for no, k in enumerate(KINDS)]
    return d.select(*keep, F.array_sort(F.concat(*[p[0] for p in per])).alias("spans"),
                    F.array_distinct(F.concat(*[p[1] for p in per])).alias("near"), F.array_distinct(F.concat(*[p[2] for p in per])).alias("holds"))


def _of_kind(no: int, k: str, radius: int) -> tuple[Column, Column, Column]:
    """Spans, terms near them and the entities themselves, from the gaps and matches of one kind."""
    gaps = f"_g{k}"

    def entity(x: Column) -> Column:
        return F.xxhash64(F.lit(k), F.lower(x["m"]) if k in ("email", "ip") else digits(x["m"]))

    def spans(before) -> Column:
        return F.transform(f"_k{k}", lambda x: let(before(x["i"] + 1), lambda end: F.struct(
            (end - F.char_length(x["m"])).alias("start"), F.lit(no).alias("kind_no"), end.alias("end"))))

    def context(x: Column) -> Column:
        i = x["i"]
        left = _gap_words(F.get(gaps, i), i == 0, F.lit(False))
        right = _gap_words(F.get(gaps, i + 1), F.lit(False), i + 2 == F.size(gaps))
        left = let(left, lambda a: F.slice(a, F.greatest(F.size(a) - radius, F.lit(0)) + 1, F.lit(radius)))
        near = F.concat(left, F.slice(right, 1, radius))
        return let(entity(x), lambda e: F.transform(near, lambda t: F.struct(e.alias("entity"), t.alias("term"))))

    kept = f"_k{k}"
    return with_sums(F.col(f"_l{k}"), spans), F.flatten(F.transform(kept, context)), F.transform(kept, entity)


def words_of(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{WS}]+", -1))


def held_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``content, term`` for the ``terms`` that each row of ``texts`` holds, once a row, and a few others that share their slots."""
    own = F.array_distinct(terms_of(F.array_distinct(words_of(F.lower("text")))))
    every = texts.select("content", F.explode(own).alias("term"))
    return thinned(every, F.col("term"), terms)


def each_text_once(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """``content, text`` without copies.  Only texts that may be ``repeated`` (contents that come again) are moved."""
    again = thinned(texts, F.col("content"), repeated).groupBy("content").agg(F.first("text").alias("text"))
    return thinned(texts, F.col("content"), repeated, others=True).unionByName(again)


def revealing_terms(found: DataFrame, n_all: int, n_term: DataFrame, pairs: DataFrame, min_degree: float = MIN_DEGREE,
                    min_share: float = GENERALISE) -> DataFrame:
    """``term, share, degree`` of the terms above the limits, for the entity that each reveals most.

    ``share`` is the part of the term's texts that hold the entity near it, ``degree`` is PMI / IC.  An
    entity that all ``n_all`` texts hold has no information and is revealed by nothing.
    """
    holds = found.select("content", F.explode("holds").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    d = pairs.join(holds, "entity").join(n_term, "term").where(F.col("n_entity") < n_all)
    d = d.withColumn("share", F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0)))
    d = d.withColumn("degree", 1 + F.log("share") / F.log(F.lit(n_all) / F.col("n_entity")))
    return d.where((F.col("share") >= min_share) & (F.col("degree") >= min_degree)).groupBy("term").agg(
        F.max("share").alias("share"), F.max("degree").alias("degree"))


def _places(d: DataFrame) -> DataFrame:
    """``d`` with ``more``: where its ``text`` holds the terms of the map ``told``."""
    keep = list(d.columns)
    d = d.withColumn("_h", F.filter(F.transform(words_of(F.lower("text")), lambda w, i: F.struct(F.btrim(w, F.lit(EDGES)).alias("term"), i.alias("i"))),
                                    lambda x: F.map_contains_key("told", x["term"])))
    d = d.withColumn("_p", F.split(F.btrim("text", F.lit(WS_CHARS)), f"(?<=[{WS}])(?=[^{WS}])", -1))
    lead = F.char_length("text") - F.char_length(F.ltrim("text", F.lit(WS_CHARS)))
    parts = F.concat(F.array(lead.cast("long")), F.transform("_p", lambda p: F.char_length(p).cast("long")))

    def places(before) -> Column:
        def place(x: Column) -> Column:
            word = F.rtrim(F.get("_p", x["i"]), F.lit(WS_CHARS))
            start = before(x["i"] + 1) + F.char_length(word) - F.char_length(F.ltrim(word, F.lit(EDGES)))
            return let(start, lambda s: F.struct(
                s.alias("start"), F.lit(len(KINDS)).alias("kind_no"), (s + F.char_length(F.btrim(word, F.lit(EDGES)))).alias("end"),
                F.element_at("told", x["term"]).alias("share")))
        return F.transform("_h", place)

    return d.select(*keep, with_sums(parts, places).alias("more"))


def disclosures(docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS, **limits) -> DataFrame:
    """``doc_id, k1, k2, spans`` per row of ``docs``: array of ``start, kind_no, end, share`` by start, then kind.

    Kinds 0 to 3 are those of ``KINDS`` (share null); kind 4 is a term that reveals one of them, unless it overlaps
    a span of the first four.  ``k1, k2`` is the row's key (``row_key`` of id and text): repeated rows share it and their spans.
    An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("*", *row_key("doc_id", "text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"))
    base = written(entities(rows).withColumn("filled", F.coalesce(F.col("text") != "", F.lit(False))).drop("text"), "disclosure-entities")
    found = base.where(F.size("spans") > 0)
    pairs = found.select("content", F.explode("near").alias("x")).select("content", "x.entity", "x.term").distinct()
    pairs = written(pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_texts), "disclosure-pairs")
    texts = rows.select("content", "text")
    repeated = base.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    held = held_terms(each_text_once(texts, written(repeated, "disclosure-repeated")), pairs.select("term").distinct())
    n_term = held.groupBy("term").agg(F.count("*").alias("n_term"))
    n_all = base.where("filled").select("content").distinct().count()
    told = written(revealing_terms(found, n_all, n_term, pairs, **limits), "disclosure-terms")
    held = held_terms(texts, told.select("term")).distinct().join(told, "term")
    told = written(held.groupBy("content").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told")), "disclosure-told")
    # one row per text on the joined side, written before: where a text has very many copies the join may be split anywhere
    extra = _places(thinned(rows, F.col("content"), told.select("content")).join(told, "content").select("k1", "k2", "text", "told"))
    extra = written(extra.groupBy("k1", "k2").agg(F.first("more").alias("more")), "disclosure-places")
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"),
                                                    F.lit(None).cast("double").alias("share")))
    own = base.select("doc_id", "k1", "k2", "spans").join(extra, ["k1", "k2"], "left")
    more = F.filter(F.coalesce("more", F.array().cast(extra.schema["more"].dataType)),
                    lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return own.select("doc_id", "k1", "k2", F.array_sort(F.concat(plain, more)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])))


def disclosure_digests(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, spans found per kind, SHA-256 of the listed base spans, all spans listed, and ``n_terms``."""
    d = disclosures(docs, text_col, **limits)
    count = lambda no: F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")
    return d.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                    F.sha2(listed(F.filter("spans", lambda s: s["kind_no"] < len(KINDS))), 256).alias("base_sha256"),
                    listed(F.col("spans")).alias("spans"), count(len(KINDS)).alias("n_terms"))


def sanitise(docs: DataFrame, text_col: str = "text", remove: float = REMOVE, **limits) -> DataFrame:
    """``docs`` with personal data replaced by its kind (``[EMAIL]``), revealing terms by ``[CODE]`` (with a digit), ``[NAME]``
    (a capital first) or ``[TERM]``, or by nothing from a share of ``remove`` on.  Of overlapping spans the first one stands
    for all.  Rows without spans keep their text (null too); columns stay those of ``docs``.
    """
    spans = disclosures(docs, text_col, **limits).where(F.size("spans") > 0).groupBy("k1", "k2").agg(F.first("spans").alias("_s"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*cols, F.xxhash64("doc_id", F.col(f"`{text_col}`")).alias("_k1"), F.hash(F.col(f"`{text_col}`"), "doc_id").alias("_k2"))
    d = rows.join(spans, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left")
    text = F.col(f"`{text_col}`")
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,share:double>>")
    apart = F.aggregate("_s", empty, lambda acc, s: F.when(
        (F.size(acc) == 0) | (F.element_at(F.when(F.size(acc) > 0, acc), -1)["end"] <= s["start"]), F.concat(acc, F.array(s))).otherwise(
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.element_at(acc, -1)["kind_no"].alias("kind_no"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.element_at(acc, -1)["share"].alias("share"))))))
    d = d.withColumn("_s", F.when(F.col("_s").isNotNull(), apart))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def tag(s: Column) -> Column:
        word = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        first = F.substring(word, 1, 1)
        return (F.when(s["kind_no"] < len(KINDS), F.get(names, s["kind_no"])).when(s["share"] >= remove, "")
                .when(word.rlike("[0-9]"), "[CODE]").when(first != F.lower(first), "[NAME]").otherwise("[TERM]"))

    def piece(s: Column, i: Column) -> Column:
        at = F.when(i > 0, F.get("_s", i - 1)["end"]).otherwise(0)
        return F.concat(F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int")), tag(s))

    tail = F.substring(text, (F.element_at("_s", -1)["end"] + 1).cast("int"), F.char_length(text))
    clean = F.concat(F.array_join(F.transform("_s", piece), ""), tail)
    return d.withColumn(text_col, F.when(F.col("_s").isNotNull(), clean).otherwise(text)).select(*cols)
