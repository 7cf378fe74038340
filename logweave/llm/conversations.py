"""Conversation structure repair by a square-root checkpointed dynamic program.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Its rows are kept,
given another role, or deleted, and rows are inserted, at least cost; of all
cheapest edits the ASCII-least string of their initials (D, I, K, R) is taken.

Going backward over a conversation, a vector holds for each of the four states of
the role pattern the cost of everything that follows.  Only the vectors at block
ends are stored, and the j-th block from the end has j entries, so n entries have
about sqrt(2n) stored vectors and no block is longer than that.  Going forward,
a block's vectors are recomputed from the one stored at its end, the least tight
edit is taken at each step, and the block is forgotten.

Both walks are streams over rows that Spark has dealt by conversation and sorted:
they hold one block, whatever the length of a conversation.  What can be split is
done before by grouped aggregates, so that hot keys do not meet in one task: equal
rows of a turn collapse into one counted entry, and the first turn of each role
and text of a conversation is a minimum that is joined back.  The backward walk
sees entries without texts.  The digest of a repaired conversation is one SHA-256
over its rows in order, so its texts pass one task, a batch at a time.

Defined results: rows of a conversation go by turn, nulls first, then role, then
the SHA-256 of the text; null roles and texts are one space; null conversation
ids are one conversation; turns are integers.  A role is judged by its first
character; an empty role has none and fits nowhere.  An empty table has no
conversations.  Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.stream import batches_of, rows_of

#: White space of ``[\x20\x09-\x0D]``, and the marks that end a sentence.
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
# Fixed values of the task: what an edit costs.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
# States: nothing yet, after s, after u, after a.  The role an edit may write from
# each, the state it leads to, and where a row's own initial leads.
WRITES = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DONE = (True, False, False, True)
LEGAL = ("su", "ua", "au")
MAX_LONG = 2 ** 63 - 1


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its
    text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets its role to user.  Nulls
    are written as one space."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                      text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
                      .alias("_copy")).drop("_copy")


def _key(c: Column) -> Column:
    """A conversation id as a text that is never null and sorts null first."""
    return F.coalesce(F.concat(F.lit("c"), c.cast("string")), F.lit("0"))


def _rows(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"),
                       text.alias("text"))


def entries(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one entry: (conv, turn, role, digest, initial, copies,
    blank, cut_off, live), live if its first copy is neither blank nor a repeat."""
    last = F.rtrim(F.col("text"), F.lit(SPACES))
    marked = rows.select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"),
                         (last == "").alias("blank"), (~F.right(last, F.lit(1)).isin(*ENDS)).alias("cut_off"))
    key = ["conv", "role", "digest"]
    counted = marked.groupBy(*marked.columns).agg(F.count(F.lit(1)).alias("copies"))
    first = counted.groupBy(*key).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    fresh = F.when(F.col("first.known"), F.col("turn").eqNullSafe(F.col("first.turn"))).otherwise(F.col("turn").isNull())
    return counted.join(first, key).withColumn("live", fresh & ~F.col("blank")).drop("first")


ENTRY = ("conv", "turn", "role", "digest", "initial", "copies", "blank", "cut_off", "live")
#: A block's vector (costs after it) and entries in order; the first block of a
#: conversation also brings its counts.
BLOCK = T.StructType().add("conv", T.StringType()).add("turn", T.LongType()).add("role", T.StringType()) \
    .add("digest", T.BinaryType()).add("after", T.ArrayType(T.LongType())).add("initials", T.ArrayType(T.StringType())) \
    .add("kinds", T.ArrayType(T.IntegerType())).add("copies", T.ArrayType(T.LongType())) \
    .add("counts", T.ArrayType(T.LongType()))
FORCED, LIVE, LIVE_CUT_OFF = 0, 1, 2
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _closed(costs: list[int]) -> list[int]:
    """Costs when rows may be inserted first."""
    one = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(4)]
    return [min(costs[q], INSERT + one[NEXT[q]]) for q in range(4)]


#: Costs at the end of a conversation: nothing in a final state, else insertions.
_FAR = 1 << 60
AT_END = _closed([0 if done else _FAR for done in DONE])


def before(after: list[int], initial: str, kind: int, copies: int) -> list[int]:
    """Costs before an entry, from those after it."""
    if kind == FORCED:
        return [DELETE * copies + c for c in after]
    extra, rest = CUT_OFF * (kind == LIVE_CUT_OFF), DELETE * (copies - 1)
    out = []
    for q in range(4):
        cost = min(DELETE + after[q], REROLE + extra + after[NEXT[q]])
        kept = KEEPS[q].get(initial)
        if kept is not None:
            cost = min(cost, extra + after[kept])
        out.append(rest + cost)
    return _closed(out)


def _blocks_backward(batches) -> Iterator[tuple]:
    """Blocks of conversations whose entries come last first."""
    conv, block, after, now, size = None, [], AT_END, AT_END, 1
    turns, low, high, last, blank, dup, cut_off, illegal, later = 0, None, None, None, 0, 0, 0, 0, None

    def made(counts):
        first, order = block[-1], block[::-1]
        return (conv, first[1], first[2], first[3], after, [e[4] for e in order], [e[9] for e in order],
                [e[5] for e in order], counts)

    def counts():
        gaps = 0 if low is None else min(high - low + 1 - turns, MAX_LONG)
        return [gaps, blank, dup, cut_off, illegal]

    for row in rows_of(batches):
        if row[0] != conv:
            if block:
                yield made(counts())
            conv, block, after, now, size = row[0], [], AT_END, AT_END, 1
            turns, low, high, last, blank, dup, cut_off, illegal, later = 0, None, None, None, 0, 0, 0, 0, None
        elif len(block) == size:
            yield made(None)
            block, after, size = [], now, size + 1
        _, turn, _, _, initial, copies, is_blank, is_cut, live = row
        kind = FORCED if not live else LIVE_CUT_OFF if is_cut else LIVE
        block.append((*row, kind))
        now = before(now, initial, kind, copies)
        if is_blank:
            blank += copies
        else:
            dup += copies - live
            cut_off += kind == LIVE_CUT_OFF
        # Copies stand beside each other; the last of them beside the entry after.
        illegal += copies - 1 + (later is not None and initial + later not in LEGAL)
        later = initial
        if turn is not None and turn != last:
            turns, low, high, last = turns + 1, turn, turn if high is None else high, turn
    if block:
        yield made(counts())


def _edits_forward(batches, opened, row_out, closed) -> Iterator[tuple]:
    """Walk conversations whose blocks and rows come in order.  ``opened(conv, cost,
    counts)`` starts one, ``row_out(edit, role, text)`` takes each edit, its results
    go out, and ``closed()`` gives the rows of the end."""
    conv, state, plan, at, used = None, 0, None, 0, 0

    def finish():
        q = state
        while not DONE[q]:
            yield from row_out("I", WRITES[q], "")
            q = NEXT[q]
        yield from closed()

    for row in rows_of(batches):
        if row[4] is not None:                       # a block
            name, after, initials, kinds, copies, counts = row[0], row[4], row[5], row[6], row[7], row[8]
            vectors = [after]
            for e in range(len(kinds) - 1, -1, -1):
                vectors.append(before(vectors[-1], initials[e], kinds[e], copies[e]))
            plan, at, used = (initials, kinds, copies, vectors[::-1]), 0, 0
            if name != conv:
                if conv is not None:
                    yield from finish()
                conv, state = name, 0
                opened(conv, plan[3][0][0], counts)
            continue
        initials, kinds, copies, vectors = plan
        if used:
            yield from row_out("D", None, None)
        else:
            kind, rest = kinds[at], DELETE * (copies[at] - 1)
            extra, after = CUT_OFF * (kind == LIVE_CUT_OFF), vectors[at + 1]
            while True:
                cost = vectors[at][state]
                if cost == rest + DELETE + after[state]:
                    yield from row_out("D", None, None)
                    break
                if cost == INSERT + vectors[at][NEXT[state]]:
                    yield from row_out("I", WRITES[state], "")
                    state = NEXT[state]
                    continue
                kept = KEEPS[state].get(initials[at])
                if kept is not None and cost == rest + extra + after[kept]:
                    yield from row_out("K", row[2], row[9])
                    state = kept
                else:
                    yield from row_out("R", WRITES[state], row[9])
                    state = NEXT[state]
                break
        used += 1
        if used == copies[at]:
            at, used = at + 1, 0
    if conv is not None:
        yield from finish()


def _walked(rows: DataFrame, walk, schema: T.StructType) -> DataFrame:
    """Apply ``walk`` to the blocks and rows of whole conversations, in order."""
    rows = _rows(rows)
    down = [F.col("conv").asc(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc()]
    blocks = entries(rows).select(*ENTRY).repartition("conv").sortWithinPartitions(*down) \
        .mapInArrow(lambda batches: batches_of(_blocks_backward(batches), BLOCK), BLOCK)
    stream = blocks.withColumn("text", F.lit(None).cast("string")).unionByName(rows, allowMissingColumns=True)
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc(),
             F.col("after").isNull().asc()]
    stream = stream.select(*BLOCK.names, "text").repartition("conv").sortWithinPartitions(*order)
    return stream.mapInArrow(lambda batches: batches_of(walk(batches), schema), schema)


AUDIT = T.StructType().add("conv", T.StringType())
for _c in (*COUNTS, "cost"):
    AUDIT = AUDIT.add(_c, T.LongType())
AUDIT = AUDIT.add("audit", T.StringType()).add("repaired_sha256", T.StringType())
REPAIRED = T.StructType().add("conv", T.StringType()).add("place", T.LongType()).add("edit", T.StringType()) \
    .add("role", T.StringType()).add("text", T.StringType())


def _audits(batches) -> Iterator[tuple]:
    head, audit, digest, rows = (), [], None, 0

    def opened(conv, cost, counts):
        nonlocal head, audit, digest, rows
        head, audit, digest, rows = (conv, *counts, cost), [], hashlib.sha256(), 0

    def edit(letter, role, text):
        nonlocal rows
        audit.append(letter)
        if role is not None:
            digest.update(("\n" * (rows > 0) + role + ":" + text).encode())
            rows += 1
        return ()

    def closed():
        yield (*head, "".join(audit), digest.hexdigest())

    return _edits_forward(batches, opened, edit, closed)


def _repaired(batches) -> Iterator[tuple]:
    conv, place = None, 0

    def opened(name, cost, counts):
        nonlocal conv, place
        conv, place = name, 0

    def edit(letter, role, text):
        nonlocal place
        if role is not None:
            yield conv, place, letter, role, text
            place += 1

    return _edits_forward(batches, opened, edit, lambda: ())


def audit_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``ids`` (by default of ``rows``): ``conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.  A
    conversation without rows has zeros and the empty text's digest."""
    names = (rows if ids is None else ids).select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    out = names.join(_walked(rows, _audits, AUDIT), "conv", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The repaired rows: ``conv_id, place, edit`` (K, R or I), ``role, text``."""
    kind = rows.schema["conv_id"].dataType
    out = _walked(rows, _repaired, REPAIRED)
    name = F.when(F.col("conv") != "0", F.substring("conv", 2, 2 ** 31 - 1)).cast(kind)
    return out.select(name.alias("conv_id"), "place", "edit", "role", "text")


def oracle() -> str:
    """DuckDB SQL of the registered query: the whole cost table, then the least tight edits."""
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), "
           "lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)")
    nxt = "[2, 2, 3, 2][q + 1]"
    kept = "CASE WHEN q = 0 AND ini = 's' THEN 1 WHEN q IN (0, 1, 3) AND ini = 'u' THEN 2 WHEN q = 2 AND ini = 'a' THEN 3 END"
    base = [f"CASE WHEN live THEN least(4 + v[{q + 1}], 3 + x + v[{NEXT[q] + 1}]"
            + "".join(f", CASE WHEN ini = '{c}' THEN x + v[{to + 1}] END" for c, to in KEEPS[q].items())
            + f") ELSE 4 + v[{q + 1}] END AS b{q}" for q in range(4)]
    return rf"""WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, {crc} % 20 AS k FROM src),
dmg AS (SELECT coalesce('c' || conv_id, '0') AS c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS cp FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), cp) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS told, substr(role, 1, 1) AS ini FROM dmg),
f AS (SELECT *, told = '' AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS seen,
    lead(ini) OVER (PARTITION BY c ORDER BY i) AS later FROM o),
r AS (SELECT *, NOT blank AND NOT seen AS live,
    CASE WHEN NOT blank AND NOT seen AND right(told, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS x FROM f),
n AS (SELECT c, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count_if(blank) AS blank, count_if(seen AND NOT blank) AS duplicate, count_if(x > 0) AS truncated,
    count_if(later IS NOT NULL AND ini || later NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c),
b AS (SELECT c, n + 1 AS i, [0, 6, 3, 0] AS v FROM n
  UNION ALL SELECT c, i, [least(b0, 3 + b2, 6 + b3), least(b1, 3 + b2, 6 + b3), least(b2, 3 + b3), least(b3, 3 + b2)]
  FROM (SELECT r.c, r.i, {", ".join(base)} FROM b JOIN r ON r.c = b.c AND r.i = b.i - 1)),
w AS (SELECT c, 1::BIGINT AS i, 0 AS q, '' AS audit, '' AS out FROM n
  UNION ALL SELECT c, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
    CASE e WHEN 'D' THEN q WHEN 'K' THEN kept ELSE nxt END, audit || e,
    CASE WHEN e = 'D' THEN out ELSE out || CASE WHEN regexp_matches(audit, '[IKR]') THEN chr(10) ELSE '' END ||
      CASE e WHEN 'K' THEN role || ':' || text WHEN 'R' THEN role_to || ':' || text ELSE role_to || ':' END END
  FROM (SELECT *, CASE WHEN live IS NULL THEN CASE WHEN q IN (1, 2) THEN 'I' END
      WHEN v[q + 1] = 4 + v2[q + 1] THEN 'D' WHEN v[q + 1] = 3 + v[nxt + 1] THEN 'I'
      WHEN kept IS NOT NULL AND v[q + 1] = x + v2[kept + 1] THEN 'K' ELSE 'R' END AS e
    FROM (SELECT w.*, b.v, b2.v AS v2, r.live, r.x, r.role, r.text, {nxt} AS nxt, {kept} AS kept,
        CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END AS role_to
      FROM w JOIN b ON b.c = w.c AND b.i = w.i LEFT JOIN b b2 ON b2.c = w.c AND b2.i = w.i + 1
        LEFT JOIN r ON r.c = w.c AND r.i = w.i)) WHERE e IS NOT NULL),
done AS (SELECT c, max_by(audit, length(audit)) AS audit, max_by(out, length(audit)) AS out FROM w GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.v[1], 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('c' || conv_id, '0') AS c FROM conversations) ids
  LEFT JOIN n ON n.c = ids.c LEFT JOIN b ON b.c = ids.c AND b.i = 1 LEFT JOIN done ON done.c = ids.c"""
