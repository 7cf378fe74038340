"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Two fixed base rules (too few words, too much repetition) come first.  Every
other bound is learned: each language and source keeps a quantile sketch per
measure over the documents that pass the base rules, sketches of thin groups
fall back to the merged sketches of their language, then of all documents, and
a document fails that lies outside the fences ``[q1 - f*s, q3 + f*s]`` of its
group, with ``s`` the spread between the quartiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import BLANK, UPPER, cut, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Measure:
    """A rate with fences above (and below, if ``both``); the spread counts as
    at least ``least``, so that a group of equal values tolerates small ones."""

    name: str
    rate: str
    least: float
    both: bool = False


MEASURES = (
    Measure("word_length", "CAST(word_chars AS DOUBLE) / n_words", 0.6, both=True),
    Measure("symbol_rate", "CAST(n_symbols AS DOUBLE) / n_words", 0.05),
    Measure("upper_rate", "CAST(n_upper AS DOUBLE) / n_words", 0.15),
    Measure("dup_line_rate", "CAST(n_dup_lines AS DOUBLE) / n_lines", 0.15),
    Measure("repeat_rate", "CAST(n_repeat_words AS DOUBLE) / n_words", 0.075),
)


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, id_col: str, text_col: str, keys: list[str]) -> DataFrame:
    """id, the key columns and the counts of each text, in DataFrame functions only.

    Words covered by repeated windows are found by sorting the text's window
    hashes with their positions; only texts with a repeated window pay for it.
    """
    text = F.col("_text")
    df = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"key_{c}") for c in keys],
                     F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = df.select("*", words_of(text).alias("_w"), F.filter(
        F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    df = df.select("*", F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    df = df.select("*", F.when(F.col("_n") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("_n") - (WINDOW - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("_win"))
    df = df.select("*", F.when(F.size("_win") > F.size(F.array_distinct("_win")), F.sort_array(
        F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    same = lambda e, at: F.coalesce(F.get("_sorted", at)["h"] == e["h"], F.lit(False))
    df = df.select("*", F.sort_array(F.transform(F.filter(
        "_sorted", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"])).alias("_at"))
    covered = F.aggregate(F.transform("_at", lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        "id", *[f"key_{c}" for c in keys], F.col("_n").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        _count_chars(text, SYMBOLS).cast("long").alias("n_symbols"),
        _count_chars(text, UPPER).cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def adaptive_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", source_col: str = "source", min_words: int = 20,
                     max_repeat_pct: int = 30, fence: float = 4.0, min_group: int = 50,
                     sketch_k: int = 1024) -> DataFrame:
    """Counts and verdict per row: id, n_words, word_chars, n_symbols, n_upper,
    n_lines, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails the base rules.  Null languages and
    sources are groups of their own.  Groups with fewer than ``min_group``
    passing documents use their language's sketch, thin languages the sketch of
    all.  Sketches hold ``sketch_k`` items before they start to round.  Repeated
    rows stay repeated, an empty table gives no rows, other columns are ignored.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    rows = cut(measures(docs, id_col, text_col, [lang_col, source_col])
               .withColumnsRenamed({f"key_{lang_col}": "lang", f"key_{source_col}": "source"})
               .withColumn("base_failed", base))
    passing = rows.where(~F.col("base_failed")).select(
        "lang", "source", *[F.expr(m.rate).alias(m.name) for m in MEASURES])
    by_group = cut(passing.groupBy("lang", "source").agg(F.count("*").alias("n"), *[
        F.kll_sketch_agg_double(m.name, F.lit(sketch_k)).alias(m.name) for m in MEASURES]))
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m.name, F.lit(sketch_k)).alias(m.name)
                                       for m in MEASURES]]
    by_lang = by_group.groupBy("lang").agg(*merged)
    overall = by_group.agg(*merged).select(F.struct(*_fences("a")).alias("all")).scalar()
    tagged = by_group.select("lang", "source", *_fences("g")).join(
        by_lang.select(F.col("lang").alias("lang_of"), *_fences("l")),
        F.col("lang").eqNullSafe(F.col("lang_of")), "left").drop("lang_of").withColumn("_all", overall)
    bounds = tagged.select(F.col("lang").alias("lang_of"), F.col("source").alias("source_of"), *[
        F.when(F.col("g_n") >= min_group, F.col(f"g_{c}")).when(F.col("l_n") >= min_group, F.col(f"l_{c}"))
        .otherwise(F.col("_all")[f"a_{c}"]).alias(c) for m in MEASURES for c in (f"{m.name}_q1", f"{m.name}_q3")])
    judged = rows.join(bounds, F.col("lang").eqNullSafe(F.col("lang_of"))
                       & F.col("source").eqNullSafe(F.col("source_of")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        q1, q3, rate = F.col(f"{m.name}_q1"), F.col(f"{m.name}_q3"), F.expr(m.rate)
        slack = F.lit(fence) * F.greatest(q3 - q1, F.lit(m.least))
        inside = inside & (rate <= q3 + slack)
        if m.both:
            inside = inside & (rate >= q1 - slack)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))
    return judged.select("id", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines",
                         "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def _fences(prefix: str) -> list[Column]:
    out = [F.col("n").alias(f"{prefix}_n")]
    for m in MEASURES:
        for name, q in (("q1", 0.25), ("q3", 0.75)):
            out.append(F.kll_sketch_get_quantile_double(m.name, F.lit(q)).alias(f"{prefix}_{m.name}_{name}"))
    return out


def oracle(min_words: int = 20, max_repeat_pct: int = 30, fence: float = 4.0, min_group: int = 50) -> str:
    """DuckDB SQL of the query, with exact quantiles by rank."""
    ranks = ",\n".join(
        f"MIN({m.name}) FILTER (rn_{m.name} >= CEIL({q} * n)) AS {m.name}_{name}"
        for m in MEASURES for name, q in (("q1", 0.25), ("q3", 0.75)))

    def level(keys: str) -> str:
        part = f"PARTITION BY {keys}" if keys else ""
        rn = ", ".join(f"ROW_NUMBER() OVER ({part} ORDER BY {m.name}) AS rn_{m.name}" for m in MEASURES)
        cols = f"{keys}, " if keys else ""
        by = f"GROUP BY {keys}" if keys else ""
        return (f"SELECT {cols}ANY_VALUE(n) AS n, {ranks} FROM (SELECT *, COUNT(*) OVER ({part}) AS n, {rn} "
                f"FROM passing) {by}")

    pick = ", ".join(
        f"CASE WHEN g.n >= {min_group} THEN g.{c} WHEN l.n >= {min_group} THEN l.{c} ELSE a.{c} END AS {c}"
        for m in MEASURES for c in (f"{m.name}_q1", f"{m.name}_q3"))
    tests = " AND ".join(
        f"{m.rate} <= {m.name}_q3 + {fence} * GREATEST({m.name}_q3 - {m.name}_q1, {m.least})"
        + (f" AND {m.rate} >= {m.name}_q1 - {fence} * GREATEST({m.name}_q3 - {m.name}_q1, {m.least})" if m.both else "")
        for m in MEASURES)
    rates = ", ".join(f"{m.rate} AS {m.name}" for m in MEASURES)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, COALESCE(text, '') AS t,
    list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, s) AS c FROM (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS s
    FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}))),
cover AS (SELECT doc_id, SUM(LEAST({WINDOW}, COALESCE(nxt - i, {WINDOW}))) AS n FROM (
    SELECT doc_id, i, LEAD(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM win WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
    length(t) - length(translate(t, '{UPPER}', '')) AS n_upper,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    COALESCE(c.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cover c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_pct} * n_words AS base_failed FROM m),
passing AS (SELECT lang, source, {rates} FROM b WHERE NOT base_failed),
grp AS ({level("lang, source")}), lng AS ({level("lang")}), al AS ({level("")}),
bounds AS (SELECT g.lang, g.source, {pick} FROM grp g
  JOIN lng l ON l.lang IS NOT DISTINCT FROM g.lang CROSS JOIN al a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {tests} END AS kept
FROM b LEFT JOIN bounds q ON q.lang IS NOT DISTINCT FROM b.lang AND q.source IS NOT DISTINCT FROM b.source
"""
