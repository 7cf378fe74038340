"""Benchmark decontamination as a prefix-filtered set join.

Benchmark items are cut into windows of ``width`` consecutive words (a shorter
item is one window).  A window is the set of its shingles of ``shingle`` words.
A document span contains the window only if it holds all of its shingles, so by
the prefix filter one shingle of each window has to be joined: with all of n
shingles required, a prefix of n - n + 1 = 1 in the order of rarity, counted over
all documents.  Windows with a shingle that no document has are gone already.
A joined pair fixes where the span must begin (positional bound: not before the
text) and end (length bound: not after it), and the item-sized span is then
compared word by word, exactly.

Nothing of a document is shuffled but its matches and its key: the windows are
broadcast in blocks of at most about ``BLOCK_BYTES`` (their bytes are counted
first), and a text's words meet them where they are read.  Matches of equal texts
collapse before any shuffle, so large groups of copies cost one row a task.

Native: built-in functions only.  Defined results: null texts have no words;
items without a word have no window; equal items and repeated windows count once
for each item id (a null id is written as the empty text); documents with equal
texts get equal results, null and repeated ids each their own row; an empty table
on either side gives no hits.  Other columns of both tables are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import LOWER, UPPER, cut_small

#: Everything but ``0-9``, ``a-z`` and characters beyond ASCII parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lowered, in order (null: none)."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BETWEEN), "")


def _shingle_key(words: Column, place: Column, n: int) -> Column:
    """64-bit key of ``n`` words from a 0-based place; spans found by it are compared in full."""
    return F.xxhash64(*[F.get(words, place + k) for k in range(n)])


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid: the span's digest, span, n words, size: words of a
    shingle), and distinct (wid, item) pairs."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                        words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(width))
    spans = rows.select("item", "words", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("at")) \
        .select("item", "n", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("span")).distinct()
    spans = spans.withColumn("wid", F.sha2("span", 256))
    windows = spans.select("wid", "span", "n", F.least(F.col("n"), F.lit(shingle)).alias("size")).distinct()
    return windows, spans.select("wid", "item")


def _window_shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Shingles of the windows: (wid, off, key)."""
    parts = []
    for s in sizes:
        words = F.split("span", " ")
        at = windows.where(F.col("size") == s).select("wid", words.alias("words"), F.explode(
            F.sequence(F.lit(0), F.col("n") - s)).alias("off"))
        parts.append(at.select("wid", "off", _shingle_key(F.col("words"), F.col("off"), s).alias("key")))
    return reduce(DataFrame.unionAll, parts)


def _doc_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(text_key, words, pos, key) of every shingle of every text, where it is read."""
    # Outer: else the optimizer would split each text twice, once to see that it has words.
    at = docs.select("text_key", "words", F.posexplode_outer("words").alias("pos", "_w"))
    keys = [_shingle_key(F.col("words"), F.col("pos"), s) for s in sizes]
    return at.select("text_key", "words", "pos", keys[0].alias("key") if len(keys) == 1 else
                     F.explode(F.array(*keys)).alias("key"))


def _blocks(rows: DataFrame, key: str, size: Column) -> list[DataFrame]:
    """``rows`` in blocks of about ``BLOCK_BYTES`` at most, by a hash of ``key``."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n)) == b) for b in range(n)]


def matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Occurrences of the windows: distinct (text_key, wid, start, n), 0-based starts.
    ``docs`` has ``text_key`` and ``words``."""
    found = docs.where(F.lit(False)).select("text_key", F.lit("").alias("wid"), F.lit(0).alias("start"), F.lit(0).alias("n"))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())      # at most ``shingle`` values
    if not sizes:
        return found
    shingles = _window_shingles(windows, sizes)
    texts = _doc_shingles(docs, sizes)
    counted = [texts.join(F.broadcast(keys), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("freq"))
               for keys in _blocks(shingles.select("key").distinct(), "key", F.lit(40))]
    freq = reduce(DataFrame.unionAll, counted)
    # The prefix: of each window the shingle that is rarest over all documents; none if one does not occur.
    rare = shingles.join(freq, "key", "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "key", "off")).alias("r"))
    prefix = cut_small(rare.where("r.freq > 0").join(windows, "wid").select(
        "wid", "span", "n", F.col("r.key").alias("key"), F.col("r.off").alias("off")), windows.count())
    parts = []
    for block in _blocks(prefix, "wid", F.octet_length("span") + 64):
        t, w = texts.alias("t"), F.broadcast(block.alias("w"))
        start = F.col("pos") - F.col("off")
        same = F.array_join(F.slice("words", start + 1, F.col("n")), " ") == F.col("span")
        hit = (F.col("t.key") == F.col("w.key")) & (start >= 0) & (start + F.col("n") <= F.size("words")) & \
            F.when(start >= 0, same).otherwise(False)
        parts.append(t.join(w, hit).select("text_key", "wid", start.alias("start"), "n"))
    return reduce(DataFrame.unionAll, parts, found).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", width: int = 10, shingle: int = 3) -> DataFrame:
    """One row per document: ``id, n_words, n_hit`` (words inside occurrences of
    windows), ``n_items, items`` (ids of items with occurring windows, sorted as
    texts) and ``contaminated``."""
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_key"),
                       words_of(F.col(text_col)).alias("words"))
    windows, pairs = item_windows(items, item_col, item_text, width, shingle)
    found = matches(rows.select("text_key", "words"), windows)
    # Covered words: occurrences in order of start, each adding what lies beyond the
    # farthest end before it (a text's occurrences are at most as many as its windows).
    end = F.col("start") + F.col("n")
    far = F.max(end).over(Window.partitionBy("text_key").orderBy("start", "n")
                          .rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce("far", F.lit(0))))
    texts = found.withColumn("far", far).groupBy("text_key").agg(
        F.sum(fresh).cast("long").alias("n_hit"), F.collect_set("wid").alias("wids"))
    hits = texts.select("text_key", "n_hit", F.explode("wids").alias("wid")).join(pairs, "wid") \
        .groupBy("text_key").agg(F.first("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select("id", "text_key", F.size("words").cast("long").alias("n_words")).join(hits, "text_key", "left").select(
        "id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def oracle(width: int = 10) -> str:
    """DuckDB SQL of the registered query: every span of every document against every window."""
    words = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
             f"'{BETWEEN}'), lambda x: x <> '')")
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
iw AS (SELECT item, w, least({width}, len(w)) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS span
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM iw)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS span
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT rid, s, n, item FROM dw JOIN win USING (n, span)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""
