"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, card numbers and phone numbers.  Corpus co-occurrence then
estimates how strongly a term reveals one: with n(t, e) the distinct contexts (windows of words) in
which term t stands near entity e, n(t) those in which it stands near any, df(t) the distinct contexts of t (one of each document), n(e) the
distinct contexts of e and N the distinct texts, t discloses log2(p(e | t) / p(e)) bits, p(e | t) = n(t, e) / max(df(t), n(t)) and p(e) = n(e) / N.
As p(e | t) is at most n(t, e) / n(t), terms that stand near many entities are settled before the corpus is counted.
Terms above the thresholds are generalised to their class, and removed where p(e | t) is high.

Distinct contexts rather than documents are counted, on both sides, so that copies of one document are no evidence for or against a term:
of a document's windows around a term the one of smallest hash stands for it, which its copies and most of its near copies share.
Only windows around entities, candidate terms and their counts are shuffled, never whole texts.

Defined results: a null text is the empty text and has no spans; repeated rows are each answered;
an empty table gives an empty result; spans of different kinds may overlap, the replacement then covers their union;
very long texts are searched whole; columns other than the key and the text, whatever their names, are not read (``sanitised`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed, let, whole_text

KINDS = ("email", "ip", "card", "phone", "term")
#: A start inside a run that failed at its first character fails as well, so runs are tried once: linear on long runs.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[ -]?[0-9]){13,}+"
PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
BROADCAST_ROWS = 20_000


def located(text: Column, pattern: Column) -> Column:
    """Array of struct(start, end, value) of the matches, in code points.

    The pieces between matches and the matches themselves, summed up from the left, give the places.
    """
    kind = "struct<pos: bigint, found: array<struct<start: bigint, end: bigint, value: string>>>"

    def walk(found: Column) -> Column:
        def summed(pieces: Column) -> Column:
            def step(acc: Column, k: Column) -> Column:
                start = acc["pos"] + F.length(F.get(pieces, k))
                end = start + F.length(F.get(found, k))
                item = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.get(found, k).alias("value"))
                return F.struct(end.cast("long").alias("pos"), F.concat(acc["found"], F.array(item)).alias("found")).cast(kind)

            zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().alias("found")).cast(kind)
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["found"])

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), summed))

    return F.coalesce(let(F.regexp_extract_all(text, pattern, F.lit(0)), walk), F.array().cast("array<struct<start: bigint, end: bigint, value: string>>"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def small_octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= F.lit("255")))


def luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, n * 2 - 9).otherwise(n * 2)

    figures = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), value)
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid_card(value: Column) -> Column:
    return let(digits_of(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def valid_phone(value: Column) -> Column:
    return F.length(digits_of(value)).between(10, 15)


def valid_ip(value: Column) -> Column:
    return F.forall(F.split(value, "\\."), small_octet)


def base_spans(text: Column) -> Column:
    """Array of struct(start, rank, end, kind, value), by start and then as the kinds are listed."""
    empty = F.array().cast("array<struct<start: bigint, end: bigint, value: string>>")
    found = (
        F.when(text.contains("@"), located(text, F.lit(EMAIL))).otherwise(empty),
        F.when(text.rlike("[0-9]\\.[0-9]++\\.[0-9]"), F.filter(located(text, F.lit(IP)), lambda m: valid_ip(m["value"]))).otherwise(empty),
        F.when(text.rlike(CARD), F.filter(located(text, F.lit(CARD)), lambda m: valid_card(m["value"]))).otherwise(empty),
        F.when(text.rlike("\\+[0-9]"), F.filter(located(text, F.lit(PHONE)), lambda m: valid_phone(m["value"]))).otherwise(empty),
    )
    return F.sort_array(F.concat(*(as_spans(a, rank) for rank, a in enumerate(found))))


def as_spans(matches: Column, rank: int) -> Column:
    return F.transform(
        matches,
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"), m["value"].alias("value")),
    )


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def window_terms(text: Column, span: Column, reach: int) -> Column:
    """The distinct terms among the ``reach`` words on either side of a span, lower case."""
    left = F.reverse(F.substring(text, F.lit(1), span["start"].cast("int")))
    right = F.substring(text, span["end"].cast("int") + 1, F.length(text))
    # each word once it is found is final, so a text that runs out of words is read once
    near = lambda s: F.regexp_extract(s, f"(?s)^(?>.*?[\\p{{L}}\\p{{N}}]{{3,}}+){{1,{reach}}}", 0)
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit("[\\p{L}\\p{N}]{3,}+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(words(F.reverse(near(left))), words(near(right)))))


def placed_terms(text: Column, reach: int) -> Column:
    """Array of struct(term, context): every term of a text, lower case, and a hash of it and the ``reach`` terms on either side."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]{3,}+"), F.lit(0))
    around = lambda found, i: F.slice(found, F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach)) + 1 + reach)
    return let(words, lambda found: F.transform(found, lambda w, i: F.struct(w.alias("term"), F.xxhash64(around(found, i)).alias("context"))))


def disclosing_terms(docs: DataFrame, reach: int = 5, min_contexts: int = 3, min_share: float = 0.5, remove_share: float = 0.8, min_bits: float = 5.0) -> DataFrame:
    """Terms that reveal an entity, from ``docs`` with columns text and spans: term, share, bits, removed."""
    contexts = (
        docs.where(F.size("spans") > 0)
        .select(F.explode(F.transform("spans", lambda s: F.struct(F.lower(s["value"]).alias("entity"), window_terms(F.col("text"), s, reach).alias("terms")))).alias("x"))
        .select("x.*")
        .distinct()
    )
    contexts = checkpointed(contexts)
    entities = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= min_contexts)
    near = contexts.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
    near = checkpointed(near)
    strongest = near.groupBy("term").agg(F.sum("n_te").alias("n_t"), F.max("n_te").alias("most")).where((F.col("most") >= min_contexts) & (F.col("most") >= F.col("n_t") * min_share))
    often = near.where(F.col("n_te") >= min_contexts).join(strongest, "term").where(F.col("n_te") >= F.col("n_t") * min_share)
    pairs = checkpointed(often.join(entities, "entity").select("term", "n_te", "n_t", "n_e"))
    candidates = checkpointed(pairs.select("term").distinct())
    n = candidates.count()
    empty = docs.sparkSession.createDataFrame([], "term string, share double, bits double, removed boolean")
    if n == 0:
        return empty
    occurring = docs.select(F.xxhash64("text").alias("tid"), F.explode(placed_terms(F.col("text"), reach)).alias("x")).select("tid", "x.*")
    occurring = occurring.join(F.broadcast(candidates) if n <= BROADCAST_ROWS else candidates, "term", "left_semi")
    of_text = occurring.groupBy("tid", "term").agg(F.min("context").alias("context"))
    frequency = of_text.select("term", "context").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.select(F.xxhash64("text").alias("tid")).distinct().count()
    share = F.col("n_te") / F.greatest("df", "n_t")
    scored = pairs.join(frequency, "term").select("term", share.alias("share"), F.log2(share / (F.col("n_e") / F.lit(float(total)))).alias("bits"))
    return scored.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits)).groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits")).withColumn("removed", F.col("share") >= remove_share)


def find(df: DataFrame, key: str = "doc_id", text: str = "text", passthrough: bool = False) -> DataFrame:
    """doc_id, text, base (spans of the four kinds), spans (with terms) and row (the input's row, if passed through)."""
    row = [F.struct(*(F.col(f"`{n}`") for n in df.columns)).alias("row")] if passthrough else []
    docs = df.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"), base_spans(whole_text(text)).alias("spans"), *row)
    terms = checkpointed(disclosing_terms(docs.select("text", "spans")))
    n = terms.count()
    if n == 0:
        return docs.withColumn("base", F.col("spans"))
    if n <= BROADCAST_ROWS:
        # one row, of a checked size
        known = F.broadcast(terms.agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("known")))
        docs = docs.crossJoin(known)
        own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]{3,}+"), F.lit(0)), lambda w: F.map_contains_key("known", w)))
        docs = docs.withColumn("own", own).withColumn("gone", F.filter("own", lambda w: F.try_element_at("known", w)))
    else:
        words = docs.select("doc_id", F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]{3,}+"), F.lit(0)))).alias("term"))
        own = words.join(terms, "term").groupBy("doc_id", "h").agg(F.collect_set("term").alias("own"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone")).alias("o")
        d = docs.withColumn("h", F.xxhash64("text")).alias("d")
        docs = d.join(own, F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.h") == F.col("o.h")), "left").select("d.*", *(F.coalesce(f"o.{c}", F.array().cast("array<string>")).alias(c) for c in ("own", "gone"))).drop("h")
    pattern = F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}])(?:"), F.array_join(F.transform("own", lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|"), F.lit(")(?![\\p{L}\\p{N}])"))
    inside = lambda m: F.exists("spans", lambda s: (m["start"] < s["end"]) & (s["start"] < m["end"]))
    outside = F.filter(located(F.col("text"), pattern), lambda m: ~inside(m))
    # a term to be removed is marked by an empty value
    outside = F.transform(outside, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(F.array_contains("gone", F.lower(m["value"])), "").otherwise(m["value"]).alias("value")))
    extra = F.when(F.size("own") > 0, as_spans(outside, 4))
    return docs.withColumn("base", F.col("spans")).withColumn("spans", F.sort_array(F.concat("spans", F.coalesce(extra, F.filter("spans", lambda s: F.lit(False)))))).drop("own", "gone", "known")


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its class, spans that overlap as one."""
    kind = "struct<pos: bigint, parts: array<string>>"

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        gap = F.substring(text, acc["pos"].cast("int") + 1, (s["start"] - acc["pos"]).cast("int"))
        parts = F.when(fresh, F.concat(acc["parts"], F.array(gap, F.when(s["value"] == "", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), parts.alias("parts")).cast(kind)

    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().alias("parts")).cast(kind)
    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["pos"].cast("int") + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, rest))


def sanitised(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with personal data and disclosing terms replaced; all columns of the input stay."""
    found = find(df, key, text, passthrough=True)
    clean = found.select("row", replaced(F.col("text"), F.col("spans")).alias("clean"))
    value = {text: F.col("clean")} | ({"n_chars": F.length("clean").cast("long")} if "n_chars" in df.columns else {})
    return clean.select(*(value[n].alias(n) if n in value else F.col("row")[n].alias(n) for n in df.columns))


def digest(df: DataFrame) -> DataFrame:
    """doc_id, the four counts, base_sha256 and spans, one row per document."""
    found = find(df)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(k) for k in KINDS[:4]), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
