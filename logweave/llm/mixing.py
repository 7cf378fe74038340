"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  The cells' token weights
are raked to target marginals, one dimension after another, in a fixed
number of rounds: the last dimension then holds, the others closely.  A document
is then drawn with the calibrated rate of its cell.
Everything is grouped sums and joins on the cell table; the documents are read
once for their cells and once for the draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut, words_of

DIMS = ("source", "lang", "topic")
#: Topic rules of the registered query: the first pattern found names the topic.
TOPICS = (
    ("legal", r"(?i)licen[cs]e|copyright"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]+ \("),
    ("tabular", r" \| "),
    ("marked", r"[#$%&*]{3}"),
    ("numeric", r"[0-9]{3}"),
)
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.5}
SEED = "mix-42"


def topic_of(text: Column, topics=TOPICS, rest: str = "prose") -> Column:
    """Topic by the first rule whose pattern occurs; null text has the rest topic."""
    out = F.lit(rest)
    for name, pattern in reversed(topics):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def rake(cells: DataFrame, targets: dict[str, float | DataFrame], rounds: int = 6) -> DataFrame:
    """Adds ``weight`` to ``cells`` (the dimensions, ``tokens``): raked token weights.

    ``targets`` gives for each dimension either a power p (target share
    proportional to tokens**p: 1 keeps the mix, 0 levels it) or a frame
    (value, share); values without a share get weight 0, shares of values that
    do not occur are dealt to the rest in proportion.  Weights sum to the tokens.  Null values are values.
    """
    total = F.sum("tokens")
    goals = {}
    for dim, target in targets.items():
        have = cells.groupBy(F.col(dim).alias("value")).agg(total.alias("tokens"))
        if isinstance(target, DataFrame):
            given = target.select(F.col("value").alias("given"), F.col("share").cast("double").alias("raw"))
            goal = have.join(given, F.col("value").eqNullSafe(F.col("given")), "left") \
                .select("value", "tokens", F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            goal = have.withColumn("raw", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(float(target))))
                                   .otherwise(0.0))
        all_raw, all_tokens = goal.agg(F.sum("raw")).scalar(), goal.agg(F.sum("tokens")).scalar()
        goals[dim] = cut(goal.select(
            "value", (F.col("raw") / F.nullif(all_raw, F.lit(0.0)) * all_tokens).alias("goal")))
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for dim, goal in goals.items():
            now = out.groupBy(F.col(dim).alias("value")).agg(F.sum("weight").alias("now"))
            scale = now.join(goal.withColumnRenamed("value", "of"), F.col("value").eqNullSafe(F.col("of"))) \
                .select("value", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("scale"))
            # Cut each step: it reads the weights twice, which would double the plan.
            out = cut(out.join(scale, F.col(dim).eqNullSafe(F.col("value")))
                      .withColumn("weight", F.col("weight") * F.col("scale")).drop("value", "scale"))
    return out


def uniform(key: Column, seed: str = SEED) -> Column:
    """Keyed uniform number in [0, 1): 52 bits of the MD5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("long") / F.lit(2.0 ** 52)


def _celled(docs: DataFrame, id_col: str, text_col: str, topic: Column) -> DataFrame:
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.select(F.col(id_col).alias("id"), own.alias("draw_key"), "source", "lang", topic.alias("topic"),
                       F.size(words_of(F.col(text_col))).cast("long").alias("n_tokens"))


def mix(docs: DataFrame, targets: dict[str, float | DataFrame] | None = None, fraction: float = 0.5,
        rounds: int = 6, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None,
        seed: str = SEED) -> DataFrame:
    """Rows (id, source, lang, topic, n_tokens, rate, repeats), one per input row.

    ``rate`` is the expected number of times the document enters a sample of
    ``fraction`` of all tokens; ``repeats`` is drawn from it: the whole part, and
    one more with the probability of the rest.  Cells scaled up beyond their
    documents so repeat them, and every marginal holds in expectation.  The draw
    depends on seed and id alone (on the text where the id is null).

    Null sources and languages are values of their own; documents without words
    (null, empty or blank text) weigh nothing and have the rate of their cell,
    or 0 in a cell without tokens.  Repeated rows are drawn alike; an empty
    table gives no rows; other columns are ignored.
    """
    rows = cut(_celled(docs, id_col, text_col, topic_of(F.col(text_col)) if topic is None else topic))
    cells = cut(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    weights = rake(cells, targets or POWERS, rounds)
    rates = weights.select(*[F.col(d).alias(f"of_{d}") for d in DIMS], F.when(
        F.col("tokens") > 0, F.col("weight") / F.col("tokens") * F.lit(float(fraction))).otherwise(0.0).alias("rate"))
    same = F.lit(True)
    for d in DIMS:
        same = same & F.col(d).eqNullSafe(F.col(f"of_{d}"))
    drawn = F.floor("rate") + F.when(uniform(F.col("draw_key"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rows.join(rates, same).select("id", *DIMS, "n_tokens", "rate", drawn.cast("long").alias("repeats"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` drawn at least once, each once, columns unchanged.

    Rates above 1 count as 1 here, so the targets need not hold: see ``draw``.
    Rows with equal ids share their draw, so a repeated row stays or goes with its twin.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    drawn = mix(docs.withColumn("_mix_key", key).select(F.col("_mix_key"), "source", "lang", F.col(text_col)),
                id_col="_mix_key", text_col=text_col, **kw)
    ids = drawn.where("repeats > 0").select("id").distinct()
    return docs.join(ids, key == ids["id"], "left_semi")


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None,
         **kw) -> DataFrame:
    """The rows of ``docs``, each as often as its ``repeats`` tell, columns unchanged.

    Cells with a rate above 1 repeat their rows, so the sample holds the targets
    and the fraction of tokens in expectation.  Rows with equal ids in one cell
    share their draw.
    """
    topic = topic_of(F.col(text_col)) if topic is None else topic
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    # The document's own columns travel as one: none of their names can clash.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"),
                        topic.alias("topic"), "source", "lang", F.col(text_col).alias("text"))
    drawn = mix(keyed.drop("doc"), id_col="key", text_col="text", topic=F.col("topic"), **kw)
    # Grouped, not distinct: the id alone spreads the rows, the cell keeps equal ids apart.
    times = drawn.where("repeats > 0").groupBy(F.col("id").alias("of_id"), *[F.col(d).alias(f"of_{d}") for d in DIMS]) \
        .agg(F.max("repeats").alias("times"))
    same = F.col("key") == F.col("of_id")
    for d in DIMS:
        same = same & F.col(d).eqNullSafe(F.col(f"of_{d}"))
    return keyed.join(times, same).select(
        "doc", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("doc.*")


def oracle(fraction: float = 0.5, rounds: int = 6) -> str:
    """DuckDB SQL of the registered query: the same rounds as chained CTEs."""
    case = "CASE " + " ".join(
        f"WHEN regexp_matches(COALESCE(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    parts = [rf"""
r AS MATERIALIZED (SELECT doc_id, source, lang, {case} AS topic,
  len(list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM documents),
c AS MATERIALIZED (SELECT source, lang, topic, SUM(n_tokens)::BIGINT AS tokens FROM r GROUP BY ALL)"""]
    for dim, power in POWERS.items():
        parts.append(f"""
goal_{dim} AS MATERIALIZED (SELECT {dim} AS value, pow(tokens, {power}) / SUM(pow(tokens, {power})) OVER ()
  * SUM(tokens) OVER () AS goal FROM (SELECT {dim}, SUM(tokens)::BIGINT AS tokens FROM c GROUP BY {dim}))""")
    last = "(SELECT *, tokens::DOUBLE AS weight FROM c)"
    for k in range(rounds):
        for dim in POWERS:
            name = f"s{k}_{dim}"
            parts.append(f"""
{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * goal / now AS weight FROM (
  SELECT *, SUM(weight) OVER (PARTITION BY {dim}) AS now FROM {last} x) y
  JOIN goal_{dim} g ON g.value IS NOT DISTINCT FROM y.{dim})""")
            last = name
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, ROUND(rate, 6) AS rate,
  (FLOOR(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / pow(2.0, 52)
     < rate - FLOOR(rate) THEN 1 ELSE 0 END)::BIGINT AS repeats
FROM (SELECT r.*, CASE WHEN w.tokens > 0 THEN w.weight / w.tokens * {fraction} ELSE 0 END AS rate
  FROM r JOIN {last} w ON w.source IS NOT DISTINCT FROM r.source AND w.lang IS NOT DISTINCT FROM r.lang
    AND w.topic = r.topic)
"""
