"""Mixing sources to target weights by iterative proportional fitting, by DataFrame functions only.

Token weights of the cells (source, lang, topic) are raked in turn to the marginal shares of each dimension; a cell's
factor (raked over own tokens) times `budget` is the inclusion probability of its documents. A document is drawn if a
number in [0, 1) from the MD5 of its identifier and the seed lies below it.

No probability can exceed 1, so weights are raked under that bound until they stand still: cells at the bound stay there
and the others of a value make up for them. A value with too few tokens for its share at this budget is drawn whole; a
warning gives the largest miss. The registered query takes ROUNDS rounds, as its SQL does, however still the weights are.

Targets: a dimension's target is a dict of shares, or a power p: shares in proportion to tokens**p (p = 1 leaves a
dimension as it is, p = 0 makes its values equal). Values that a dict doesn't name keep their own share of what the
dict's shares leave of 1; shares are scaled to the values that occur.

Cases: null source, lang or topic are the value `unknown`; null and empty texts have no tokens and take their cell's
factor (1 where a cell has no tokens); a null doc_id is drawn by the hash of an empty identifier; repeated rows are drawn
alike, as the draw depends on doc_id only; an empty table gives no rows; columns that share a name with a result give
way to it.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, salted_join, stage, table

ROUNDS = 12
#: Raking under the bound goes on, BLOCK rounds at a time, until these rounds move less than STILL of all tokens.
MOST_ROUNDS, BLOCK, STILL = 400, 4, 1e-7
#: A miss of a share beyond this is warned of.
MISS = 1e-4
#: A table of so many cells at most is broadcast after it has been counted; beyond that the join is salted.
BROADCAST_CELLS = 20_000
DIMENSIONS = ("source", "lang", "topic")
LANG_TARGET = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
TARGETS: dict = {"source": 0.5, "lang": LANG_TARGET, "topic": 0.7}
BUDGET, SEED = 0.3, 42
RESULTS = ("n_tokens", "topic", "factor", "probability", "sampled")


def topic(text: Column) -> Column:
    """A coarse topic by form: tables, licences, contacts, short and long prose."""
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
        .when(text.contains(" | "), "tables")
        .when(F.lower(text).rlike("licen[cs]e"), "licences")
        .when(text.contains("@"), "contacts")
        .when(F.length(text) < 1000, "short prose")
        .otherwise("long prose")
    )


def _shares(sums: DataFrame, dim: str, target: dict[str, float] | float) -> DataFrame:
    """(dim, goal): the share of all tokens that each occurring value shall have. sums: (dim, tokens)."""
    if isinstance(target, dict):
        named = F.coalesce(*[F.when(F.col(dim) == k, F.lit(float(v))) for k, v in target.items()]) if target else F.lit(None).cast("double")
        rest = max(0.0, 1.0 - sum(target.values()))
        other = sums.where(named.isNull()).agg(F.sum("tokens").alias("_other"))
        raw = sums.join(F.broadcast(other)).select(dim, F.coalesce(named, F.try_divide(F.col("tokens") * rest, F.col("_other")), F.lit(0.0)).alias("goal"))
    else:
        raw = sums.select(dim, F.when(F.col("tokens") > 0, F.pow(F.col("tokens"), F.lit(float(target)))).otherwise(0.0).alias("goal"))
    total = raw.agg(F.sum("goal").alias("_goals"))
    return raw.join(F.broadcast(total)).select(dim, F.coalesce(F.try_divide("goal", F.col("_goals")), F.lit(0.0)).alias("goal"))


def _step(x: Column, most: Column, goal: Column, total) -> Column:
    """The ratio that brings a value's sum of least(x, most) towards its goal. total: the sum over the value's cells.

    A Newton step: cells at their bound stay what they are and the others meet the rest. Where the bounded cells alone
    exceed the goal, all shrink; where all are bounded and don't meet it, nothing more can be had.
    """
    bound = total(F.when(x >= most, most).otherwise(0.0))
    loose = total(F.when(x < most, x).otherwise(0.0))
    ratio = F.when(goal <= bound, F.try_divide(goal, bound + loose)).when(loose > 0, (goal - bound) / loose).otherwise(1.0)
    return F.coalesce(ratio, F.lit(0.0))


def rake(cells: DataFrame, targets: dict, rounds: int = ROUNDS, budget: float | None = None, still: float = STILL) -> DataFrame:
    """cells (dimensions, tokens) with weight: tokens raked to the targets, of the same total.

    With a budget no weight exceeds tokens / budget, and raking ends after `rounds` rounds, or sooner where BLOCK rounds
    have moved less than `still` of all tokens. Without one it ends after `rounds` rounds.

    A table of at most BROADCAST_CELLS cells, once counted, is one partition, and all steps are windows over it without a
    shuffle. Beyond that each step aggregates by one dimension and joins the ratios back, hot values dealt over slices.
    """
    dims = list(targets)
    total = cells.agg(F.sum("tokens").alias("_all"))
    goals = {d: stage(_shares(cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("tokens")), d, targets[d]).join(F.broadcast(total)).select(d, (F.col("goal") * F.col("_all")).alias("goal")), "mix-goals", narrow=True) for d in dims}
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    small = cells.count() <= BROADCAST_CELLS
    x, most = F.col("weight"), F.col("tokens") / budget if budget else None

    def one_round(now: DataFrame) -> DataFrame:
        for d in dims:
            if small:
                over = Window.partitionBy(d)
                goal = F.col(f"_goal_{d}")
                ratio = F.coalesce(F.try_divide(goal, F.sum("weight").over(over)), F.lit(0.0)) if most is None else _step(x, most, goal, lambda c: F.sum(c).over(over))  # noqa: B023
                now = now.withColumn("weight", x * ratio)
            else:
                sums = now.join(F.broadcast(goals[d]) if goals[d].count() <= BROADCAST_CELLS else goals[d], d).groupBy(d, "goal")
                ratio = sums.agg((F.coalesce(F.try_divide(F.col("goal"), F.sum("weight")), F.lit(0.0)) if most is None else _step(x, most, F.col("goal"), F.sum)).alias("_ratio")).select(d, "_ratio")
                met = salted_join(now, stage(ratio, "mix-ratios", narrow=True), d, dims)
                now = stage(met.withColumn("weight", F.col("weight") * F.col("_ratio")).drop("_ratio"), "mix-weights", narrow=True)
        return now

    if small:
        now = now.coalesce(1)
        for d in dims:
            now = now.join(F.broadcast(goals[d].select(d, F.col("goal").alias(f"_goal_{d}"))), d)
    if most is None:
        for _ in range(rounds):
            now = one_round(now)
        return now.select(*cells.columns, "weight")
    done, moved = 0, 1.0
    while done < rounds and moved > still:
        now = now.withColumn("_was", F.least(x, most))
        for _ in range(min(BLOCK, rounds - done)):
            now = one_round(now)
            done += 1
        now = stage(now, "mix-weights", narrow=True)
        now = now.coalesce(1) if small else now
        moved = now.agg(F.try_divide(F.sum(F.abs(F.least(x, most) - F.col("_was"))), F.sum("tokens"))).first()[0] or 0.0
    out = now.select(*cells.columns, F.least(x, most).alias("weight"))
    for d in dims:
        sums = out.groupBy(d).agg(F.sum("weight").alias("_sum"), F.sum("tokens").alias("_own")).join(goals[d], d).join(F.broadcast(total))
        worst, reach = sums.agg(F.max(F.abs(F.col("_sum") - F.col("goal")) / F.col("_all")), F.min(F.try_divide("_own", "goal"))).first()
        if (worst or 0.0) > MISS:
            warnings.warn(f"mixing: shares of {d} are missed by up to {worst:.4f} of all tokens at budget {budget}, after {done} rounds (the last moved {moved:.1e}); its values have the tokens for budgets up to {reach:.4f}", stacklevel=2)
    return out


def mix(docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, seed: int = SEED, rounds: int = MOST_ROUNDS, still: float = STILL) -> DataFrame:
    """docs with RESULTS, raked so that no probability exceeds 1; rounds and still as in rake()."""
    targets = targets or TARGETS
    rest = [c for c in docs.columns if c not in RESULTS]
    text = F.col("text")
    given = docs.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), topic(text).alias("topic"))
    dims = list(targets)
    keyed = given.withColumns({f"_d_{d}": F.coalesce(F.col(d).cast("string"), F.lit("unknown")) for d in dims})
    cells = stage(keyed.groupBy(*(F.col(f"_d_{d}").alias(d) for d in dims)).agg(F.sum("n_tokens").alias("tokens")), "mix-cells", narrow=True)
    key = F.md5(F.to_json(F.array(*dims)))
    raked = rake(cells, targets, rounds, budget, still)
    factors = stage(raked.select(key.alias("_cell"), F.coalesce(F.try_divide("weight", F.col("tokens")), F.lit(1.0)).alias("factor")), "mix-factors", narrow=True)
    with_key = keyed.withColumn("_cell", F.md5(F.to_json(F.array(*(F.col(f"_d_{d}") for d in dims)))))
    if factors.count() <= BROADCAST_CELLS:
        met = with_key.join(F.broadcast(factors), "_cell", "left")
    else:
        met = salted_join(with_key, factors, "_cell", ["doc_id"], "left")
    draw = F.conv(F.substr(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}"))), F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    p = F.least(F.lit(1.0), F.col("factor") * budget)
    return met.select(*(F.col(f"`{c}`") for c in rest), "n_tokens", "topic", "factor", p.alias("probability"), (draw < p).alias("sampled"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mix(docs, rounds=ROUNDS, still=-1.0).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("factor", 6).alias("factor"), F.round("probability", 6).alias("probability"), "sampled")


def _oracle() -> str:
    """DuckDB SQL of query(): the rounds of raking are common table expressions one after another."""
    langs = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in LANG_TARGET.items())
    topic_sql = """CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'tables' WHEN regexp_matches(lower(text), 'licen[cs]e') THEN 'licences'
      WHEN contains(text, '@') THEN 'contacts' WHEN length(text) < 1000 THEN 'short prose' ELSE 'long prose' END"""
    parts = [
        f"""given AS (SELECT doc_id, source, lang, {topic_sql} AS topic, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
        keyed AS (SELECT *, coalesce(source, 'unknown') AS d_source, coalesce(lang, 'unknown') AS d_lang FROM given),
        w0 AS MATERIALIZED (SELECT d_source, d_lang, topic AS d_topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight FROM keyed GROUP BY ALL)"""
    ]
    for d, t in TARGETS.items():
        if isinstance(t, dict):
            raw = f"SELECT d_{d}, t, CASE d_{d} {langs} ELSE {max(0.0, 1 - sum(t.values()))!r} * t / sum(CASE WHEN d_{d} IN ({', '.join(repr(k) for k in t)}) THEN 0 ELSE t END) OVER () END AS g"
        else:
            raw = f"SELECT d_{d}, t, CASE WHEN t > 0 THEN pow(t, {t!r}) ELSE 0 END AS g"
        parts.append(f"goal_{d} AS MATERIALIZED (SELECT d_{d}, g / sum(g) OVER () * sum(t) OVER () AS goal FROM ({raw} FROM (SELECT d_{d}, sum(tokens) AS t FROM w0 GROUP BY 1)))")
    at, most = 0, f"tokens / {BUDGET!r}"
    for _ in range(ROUNDS):
        for d in TARGETS:
            sums = f"*, sum(CASE WHEN weight >= {most} THEN {most} ELSE 0 END) OVER (PARTITION BY d_{d}) AS bound, sum(CASE WHEN weight < {most} THEN weight ELSE 0 END) OVER (PARTITION BY d_{d}) AS loose"
            ratio = "CASE WHEN goal <= bound THEN goal / nullif(bound + loose, 0) WHEN loose > 0 THEN (goal - bound) / loose ELSE 1 END"
            parts.append(f"w{at + 1} AS MATERIALIZED (SELECT w.d_source, w.d_lang, w.d_topic, tokens, weight * coalesce({ratio}, 0) AS weight FROM (SELECT {sums} FROM w{at}) w JOIN goal_{d} g ON w.d_{d} = g.d_{d})")
            at += 1
    return f"""WITH {', '.join(parts)}
    SELECT doc_id, source, lang, k.topic, n_tokens, round(f, 6) AS factor, round(least(1.0, f * {BUDGET}), 6) AS probability,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{SEED}'), 1, 8))::BIGINT / 4294967296.0 < least(1.0, f * {BUDGET}) AS sampled
    FROM keyed k JOIN (SELECT *, coalesce(least(weight, {most}) / nullif(tokens, 0), 1.0) AS f FROM w{at}) w ON k.d_source = w.d_source AND k.d_lang = w.d_lang AND k.topic = w.d_topic"""


ORACLE_SQL = _oracle()
