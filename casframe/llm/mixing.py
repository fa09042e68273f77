"""Temperature mixing of sources to target weights, realised as block permutations.

Source s with token share p_s gets the weight p_s**alpha / sum p**alpha.  The
exponent is found by bisection: the smallest alpha in [0, 1] (the flattest mix)
whose weights keep every source within ``repeat_limit`` passes over its tokens for
the token budget, or, with ``target_entropy`` (a fraction of the entropy of equal
weights), the alpha that meets that entropy.  Entropy and the largest repetition
fall and rise monotonously in alpha, so bisection over ``STEPS`` halvings ends at
double precision.

Weights become tokens to draw from each source, ``weight * budget``.  Within a
source documents lie in blocks; each pass over the source permutes the blocks by a
hash of seed and pass, and the documents inside a block by another.  A document's
*position* in a pass is the number of tokens before it in that order.  A pass ends
when its budget is met: whole passes hold all documents, the last one those whose
position lies before the rest of the budget.  Running totals are taken over blocks,
of which there is one for ``BLOCK_ROWS`` documents, and then inside one block, so no
source is ever in one task, however large.

Rows are drawn with their columns; a document drawn twice appears twice.  A null
source is a source of its own; a null text counts 0 tokens, and documents without
tokens are drawn in every started pass that they lie before the end of.  Tokens are
white-space words.  Equal hashes are ordered by id; rows that agree in source and id
share one place and are drawn together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casframe.llm import common

STEPS = 60
BLOCK_ROWS = 2048
REPEAT_LIMIT = 1.25
SEED = 7
WORDS = r"regexp_count(coalesce(text, ''), '[^ \\t-\\r]+')"


def weights(tokens: dict, alpha: float) -> dict:
    top = max(tokens.values(), default=0)
    raised = {s: (n / top) ** alpha if n > 0 else 0.0 for s, n in tokens.items()} if top > 0 else dict.fromkeys(tokens, 0.0)
    total = math.fsum(raised.values())
    return {s: v / total if total else 0.0 for s, v in raised.items()}


def entropy(w: dict) -> float:
    return -math.fsum(v * math.log(v) for v in w.values() if v > 0)


def repetition(tokens: dict, w: dict, budget: float) -> float:
    return max((w[s] * budget / n for s, n in tokens.items() if n > 0), default=0.0)


def solve(tokens: dict, budget: float, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None, steps: int = STEPS) -> tuple[float, dict]:
    """The exponent and the weights; both limits may be given, the larger exponent holds."""
    live = sum(n > 0 for n in tokens.values())

    def bisect(too_flat) -> float:
        lo, hi = 0.0, 1.0
        if not too_flat(weights(tokens, lo)):
            return lo
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if too_flat(weights(tokens, mid)) else (lo, mid)
        return hi

    alpha = 0.0
    if repeat_limit is not None:
        alpha = bisect(lambda w: repetition(tokens, w, budget) > repeat_limit)
    if target_entropy is not None and live > 1:
        alpha = max(alpha, bisect(lambda w: entropy(w) > target_entropy * math.log(live)))
    return alpha, weights(tokens, alpha)


def _order(seed: int, salt: int, *columns: str) -> F.Column:
    return F.xxhash64(*columns, F.lit(seed + salt))


def started(ids: DataFrame, quotas: DataFrame, seed: int, last_only: bool) -> tuple[DataFrame, DataFrame]:
    """Each place a document can have (src, id, block, pass, room, tokens), and the blocks (src, pass, block, turn, before, room) that a pass comes to."""
    passes = F.when(F.lit(last_only), F.array(F.col("full"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("full")))
    own = ids.join(quotas, F.col("src").eqNullSafe(F.col("q"))).groupBy("src", "id", "blocks", "full", "rest").agg(F.sum("tokens").alias("tokens"))
    own = own.withColumn("pass", F.explode(passes)).where("pass < full OR rest > 0")
    own = own.withColumn("block", F.pmod(_order(seed, 0, "id"), F.col("blocks"))).withColumn("room", F.when(F.col("pass") < F.col("full"), F.lit((1 << 63) - 1)).otherwise(F.col("rest")))
    blocks = own.groupBy("src", "pass", "block", "room").agg(F.sum("tokens").alias("size")).withColumn("turn", _order(seed, 1, "block", "pass"))
    before = F.sum("size").over(Window.partitionBy("src", "pass").orderBy("turn", "block")) - F.col("size")
    return own, blocks.withColumn("before", before).where("before < room")


def placed(own: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """(src, id, pass, block, hash, position) of the drawn documents of the blocks."""
    blocks = blocks.select(F.col("src").alias("s"), F.col("pass").alias("p"), F.col("block").alias("b"), "before")
    inside = own.join(blocks, F.col("src").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("block") == F.col("b"))).withColumn("hash", _order(seed, 2, "id", "pass"))
    order = Window.partitionBy("src", "pass", "block").orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return inside.withColumn("position", F.col("before") + F.sum("tokens").over(order) - F.col("tokens")).where("position < room").select("src", "id", "pass", "block", "hash", "position")


def ends(ids: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """A row for each source: its whole passes, and the last block and document that its partial pass comes to (null without one)."""
    own, blocks = started(ids, quotas, seed, last_only=True)
    last = blocks.groupBy("src").agg(F.max(F.struct("turn", "block", "pass", "before")).alias("end")).select("src", "end.*")
    cut = placed(own, last, seed).groupBy("src").agg(F.max(F.struct("hash", "id")).alias("cut"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    last = last.select(F.col("src").alias("s"), F.struct("turn", "block").alias("end"))
    return quotas.join(last, same("q", "s"), "left").drop("s").join(cut, same("q", "src"), "left").drop("src")


def draw(spark: SparkSession, documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", budget: int | None = None, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None, seed: int = SEED, report: bool = False) -> DataFrame:
    """The drawn rows; with ``report`` one row per drawn place (key, source, pass from 0, position, tokens) instead.

    ``budget`` defaults to the tokens of the input.  The driver gathers two numbers
    per source and nothing else; sources are a mixing plan's, thousands at most.
    """
    scratch = common.Scratch(spark, "mixing", documents)
    columns = documents.columns
    inner = documents.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)))
    key, source, text = (f"c{columns.index(c)}" for c in (key, source, text))
    name = lambda column: F.coalesce(F.col(column).cast("string"), F.lit("\u0000"))
    ids = inner.select(F.col(key).alias("key"), F.col(source).alias("src"), F.expr(WORDS.replace("text", text)).cast("long").alias("tokens"))
    ids = scratch.save(ids.withColumn("id", name("key")), "ids")
    totals = {r["src"]: (r["tokens"], r["n"]) for r in ids.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    tokens = {s: t for s, (t, _) in totals.items()}
    budget = sum(tokens.values()) if budget is None else budget
    _, weight = solve(tokens, budget, repeat_limit, target_entropy)
    plan = []
    for s, (n_tokens, n_rows) in totals.items():
        quota = math.floor(weight[s] * budget + 1e-9)
        full, rest = divmod(quota, n_tokens) if n_tokens else (1, 0)
        plan.append((s, max(1, -(-n_rows // BLOCK_ROWS)), int(full), int(rest)))
    quotas = spark.createDataFrame(plan, f"q {ids.schema['src'].dataType.simpleString()}, blocks long, full long, rest long")
    quotas = F.broadcast(quotas) if len(plan) <= 10_000 else quotas
    if report:
        drawn = placed(*started(ids, quotas, seed, last_only=False), seed).select(F.col("src").alias("s"), F.col("id").alias("i"), "pass", "position")
        return ids.join(drawn, F.col("src").eqNullSafe(F.col("s")) & (F.col("id") == F.col("i"))).select("key", "src", "pass", "position", "tokens").coalesce(scratch.parts)
    # A source's end is one row, so each document knows from its own id whether the partial pass comes to it: no text moves.
    limits = scratch.save(ends(ids, quotas, seed), "ends")
    limits = F.broadcast(limits) if len(plan) <= 10_000 else limits
    rows = inner.withColumn("id", name(key)).join(limits, F.col(source).eqNullSafe(F.col("q")))
    rows = rows.withColumn("block", F.pmod(_order(seed, 0, "id"), F.col("blocks")))
    at = F.struct(_order(seed, 1, "block", "full").alias("turn"), F.col("block"))
    extra = F.when(at < F.col("end"), 1).when((at == F.col("end")) & (F.struct(_order(seed, 2, "id", "full").alias("hash"), F.col("id")) <= F.col("cut")), 1).otherwise(0)
    rows = rows.withColumn("_pass", F.col("full") + extra).where("_pass > 0").withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_pass"))))
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns))).coalesce(scratch.parts)
