"""Line-first cleaning with DataFrame functions only.

Every line is judged on its own (punctuation, navigation, boilerplate); failing lines are removed,
and a document is rejected when the lines that fail hold too much of its text.  One projection per
document, no shuffle: the cost is linear in the text.

Defined results: a null text counts as the empty text and has no words, so it fails the base rules;
lines without a word are neither judged nor counted and stay where they are; repeated rows are judged
independently; an empty table gives an empty result; columns of the input other than the key and the
text never reach the expressions, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE_CLASS, fresh_name, let, split_words, whole_text

#: Phrases that mark a line as boilerplate (matched in lower case), in English, German, French and Spanish.
BOILERPLATE = (
    "licensed under the",
    "all rights reserved",
    "copyright (c)",
    "spdx-license-identifier",
    "without warranty of any kind",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "subscribe to our newsletter",
    "alle rechte vorbehalten",
    "nutzungsbedingungen",
    "datenschutzerklärung",
    "verwendet cookies",
    "newsletter abonnieren",
    "tous droits réservés",
    "politique de confidentialité",
    "mentions légales",
    "utilise des cookies",
    "cliquez ici",
    "todos los derechos reservados",
    "política de privacidad",
    "aviso legal",
    "utiliza cookies",
    "haga clic aquí",
)
SYMBOLS = "[#*$%&|<>]"
#: A navigation line is made of short items between separators: more than one separator to four words.
SEPARATORS = "[|»›·•]"
WINDOW = 8


def symbol_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def line_reason(line: Column) -> Column:
    """Why a line fails: 'boilerplate', 'navigation', 'punctuation', or null if it passes."""
    low = F.lower(line)
    boiler = low.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        boiler = boiler | low.contains(phrase)
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    words = F.regexp_count(line, F.lit(f"[^{SPACE_CLASS}]+"))
    return (
        F.when(boiler, F.lit("boilerplate"))
        .when((separators > 2) & (separators * 4 > words), F.lit("navigation"))
        .when((symbols > 2) & (symbols * 4 > words), F.lit("punctuation"))
        .when(~line.rlike("[\\p{L}\\p{N}]"), F.lit("punctuation"))
    )


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that are found at least twice in the text.

    Windows are compared by a 64-bit hash within one document.  Most documents repeat none, so the
    positions are sorted only where the distinct hashes are fewer than the windows.
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twin = lambda k, h: F.coalesce(F.get(s, k)["h"] == h, F.lit(False))
            marked = F.transform(s, lambda x, k: F.when(twin(k - 1, x["h"]) | twin(k + 1, x["h"]), x["i"]))
            return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, lambda s: let(positions(s), spread))
        ).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))


def base_metrics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    duplicates = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return let(
        split_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbol_count(text).alias("n_symbols"),
            duplicates.alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def cleaned(text: Column) -> Column:
    """Struct of clean_text, n_lines, n_removed, text_chars, kept_chars (judged lines only)."""
    judged = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(
            x.alias("line"),
            F.when(x.rlike(f"[^{SPACE_CLASS}]"), F.length(x)).otherwise(0).cast("long").alias("chars"),
            F.when(x.rlike(f"[^{SPACE_CLASS}]"), line_reason(x)).alias("reason"),
        ),
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    return let(
        judged,
        lambda j: let(
            F.filter(j, lambda x: x["reason"].isNull()),
            lambda k: F.struct(
                F.array_join(F.transform(k, lambda x: x["line"]), "\n").alias("clean_text"),
                F.size(j).cast("long").alias("n_lines"),
                (F.size(j) - F.size(k)).cast("long").alias("n_removed_lines"),
                total(j).alias("text_chars"),
                total(k).alias("kept_chars"),
            ),
        ),
    )


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", max_loss: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """One row per document: key, base metrics, base_failed, clean_text, line counts and kept.

    kept is false when the base rules fail or more than ``max_loss`` of the characters of judged
    lines are in lines that fail.
    """
    t = whole_text(text)
    out = df.select(F.col(key).alias("doc_id"), base_metrics(t).alias("b"), cleaned(t).alias("c"))
    failed = (F.col("b.n_words") < min_words) | (F.col("b.n_repeat_words") * 100 > F.col("b.n_words") * max_repeat_percent)
    enough = F.col("c.kept_chars") >= F.col("c.text_chars") * (1 - max_loss)
    return out.select("doc_id", "b.*", "c.*", failed.alias("base_failed"), (~failed & enough).alias("kept"))


def clean_documents(df: DataFrame, text: str = "text", max_loss: float = 0.5) -> DataFrame:
    """The kept documents with their cleaned text; all columns of the input stay, n_chars follows the text."""
    names, mark = df.columns, fresh_name(df, "__judged")
    t = whole_text(text)

    def kept(j: Column) -> Column:
        failed = (j["b"]["n_words"] < 20) | (j["b"]["n_repeat_words"] * 100 > j["b"]["n_words"] * 30)
        return ~failed & (j["c"]["kept_chars"] >= j["c"]["text_chars"] * (1 - max_loss))

    # an array of no or one struct, taken apart: a filter on the verdict would be pushed below and judge every text twice
    judged = F.filter(F.array(F.struct(base_metrics(t).alias("b"), cleaned(t).alias("c"))), kept)
    clean = F.transform(judged, lambda j: F.struct(j["c"]["clean_text"].alias("text"), F.length(j["c"]["clean_text"]).cast("long").alias("chars")))
    out = df.select("*", F.inline_outer(clean).alias(mark, f"{mark}_chars")).where(F.col(mark).isNotNull())
    value = {text: F.col(mark)} | ({"n_chars": F.col(f"{mark}_chars")} if "n_chars" in names else {})
    return out.select(*(value[n].alias(n) if n in value else F.col(f"`{n}`") for n in names))


#: The same rules for DuckDB.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT r, i, hash(array_to_string(list_slice(ws, i, i + 7), ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS n_repeat_words FROM p GROUP BY r),
l AS (SELECT r, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS solid, lower(line) AS low FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
j AS (SELECT r, line, length(line) AS chars,
  ({" OR ".join(f"contains(low, '{x}')" for x in BOILERPLATE)})
  OR (len(regexp_extract_all(line, '{SEPARATORS}')) > 2 AND len(regexp_extract_all(line, '{SEPARATORS}')) * 4 > len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')))
  OR (len(regexp_extract_all(line, '{SYMBOLS}')) > 2 AND len(regexp_extract_all(line, '{SYMBOLS}')) * 4 > len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')))
  OR NOT regexp_matches(line, '[\\p{{L}}\\p{{N}}]') AS bad FROM l WHERE solid),
s AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(chars) AS text_chars, coalesce(sum(chars) FILTER (WHERE NOT bad), 0) AS kept_chars FROM j GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(text_chars, 0) AS tc, coalesce(kept_chars, 0) AS kc
  FROM w LEFT JOIN rep USING (r) LEFT JOIN s USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kc >= tc * 0.5 AS kept FROM f
"""
