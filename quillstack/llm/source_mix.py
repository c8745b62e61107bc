"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its share of all tokens to the power of an exponent between 0 (all sources alike) and 1 (as they are),
normalised. The exponent is found by bisection: the largest whose entropy reaches ``target_entropy`` (a fraction of
the largest possible), or else the smallest that repeats no source more than ``max_epochs`` times. The budget is
``budget_tokens``, or else the least at which every source is read once in full, so that no document is lost.

Weights are realised as budgeted permutations: a source is read in epochs, each a permutation of its documents by a digest
of seed, source, epoch and document, dealt to blocks of about ``BLOCK_TOKENS``. Whole epochs are taken in full, of the last one the documents
whose running sum stays within the source's budget. The cut is found from the sums of ``CELLS`` equal parts of the permutation and the one
part that it falls in, so no source is ever sorted as a whole; documents meet their source's plan in a join of one row per source.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Defined cases: null text has none; a null source is a source; a null doc_id is known by its
text's digest; a source without tokens is read once; very long texts count whole, so one may end a budget early; repeated rows are taken or
left together in the last epoch; an empty table gives an empty result; clashing columns are replaced, names that begin with two
underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstack.llm._tables import by_name, fresh, written

BLOCK_TOKENS = 1 << 14
ROUNDS = 40
_ORDER_BITS, _CELL_BITS = 52, 16
CELLS = 1 << _CELL_BITS


def _order(seed: int, epoch: Column) -> Column:
    """Place of a document in an epoch's permutation, below 2 ** 52."""
    name = F.concat_ws("|", F.lit(str(seed)), "__source", epoch.cast("string"), F.col("__name"))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")


def _block(order: Column) -> Column:
    return F.shiftright(F.shiftright(order, 20) * F.col("__blocks"), _ORDER_BITS - 20).cast("int")  # below 2 ** 63 up to 2 ** 31 blocks


def _cell(order: Column) -> Column:
    return F.shiftright(order, _ORDER_BITS - _CELL_BITS).cast("int")


def _sum(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + of(x))


def plan(sizes: DataFrame, max_epochs: float, target_entropy: float | None, budget_tokens: int | None) -> DataFrame:
    """``sizes`` (__source, tokens) with exponent, weight, ``whole`` epochs, and the tokens ``left`` for the last one.

    Sources of equal size act alike, so the bisection runs over distinct sizes (at most the root of twice the
    number of tokens) in one row, as one expression."""
    alike = sizes.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("times"))
    one = alike.agg(F.array_sort(F.collect_list(F.struct(F.col("tokens").cast("double").alias("t"), "times"))).alias("s"))
    s = F.col("s")
    low, high = F.get(s, F.lit(0))["t"], F.element_at(s, -1)["t"]
    norm = lambda a: _sum(s, lambda x: x["times"] * F.pow(x["t"], a))

    if target_entropy is not None:
        entropy = lambda a: F.log(norm(a)) - a * _sum(s, lambda x: x["times"] * F.pow(x["t"], a) * F.log(x["t"])) / norm(a)
        goal = F.lit(target_entropy) * F.log(_sum(s, lambda x: x["times"].cast("double")))
        up = lambda a: entropy(a) >= goal
    elif budget_tokens is not None:
        up = lambda a: F.pow(low, a - 1) * F.lit(float(budget_tokens)) / norm(a) > max_epochs
    else:
        up = lambda a: F.pow(high / low, 1 - a) > max_epochs

    def halve(span: Column, _: Column) -> Column:
        mid = (span["lo"] + span["hi"]) / 2
        return F.struct(F.when(up(mid), mid).otherwise(span["lo"]).alias("lo"), F.when(up(mid), span["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve)
    exponent = F.round(found["lo" if target_entropy is not None else "hi"], 6)
    found = one.where(F.size("s") > 0).select(exponent.alias("exponent"), "s", high.alias("high"))
    budget = F.lit(float(budget_tokens)) if budget_tokens is not None else F.pow("high", 1 - F.col("exponent")) * norm(F.col("exponent"))
    # three numbers
    exponent, total, budget = found.select("exponent", norm(F.col("exponent")), budget).first() or (1.0, 1.0, 0.0)
    out = sizes.withColumn("exponent", F.lit(exponent)).withColumn("norm", F.lit(total)).withColumn("budget", F.lit(budget))
    weight = F.pow(F.col("tokens").cast("double"), "exponent") / F.col("norm")
    epochs = F.round(weight * F.col("budget") / F.col("tokens"), 6)
    micro = F.round(epochs * 1_000_000).cast("long")
    out = out.withColumn("weight", F.when(F.col("tokens") > 0, F.round(weight, 9)).otherwise(0.0))
    out = out.withColumn("micro", F.when(F.col("tokens") > 0, micro).otherwise(1_000_000))
    part = F.col("micro") % 1_000_000
    # whole tokens, without a product that could overflow
    left = F.floor(F.col("tokens") / 1_000_000).cast("long") * part + F.floor((F.col("tokens") % 1_000_000) * part / 1_000_000).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long")
    return out.select("__source", "exponent", "weight", F.floor(F.col("micro") / 1_000_000).cast("int").alias("whole"), left.alias("left"), blocks.alias("__blocks"))


def mixed(docs: DataFrame, max_epochs: float = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, seed: int = 17) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text) as often as it is read, with n_tokens, weight, epoch (from 1), block, place."""
    docs = fresh(docs, "n_tokens", "weight", "epoch", "block", "place", "__source", "__name", "__blocks", "__whole", "__left", "__cell", "__cut", "__times")
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))))
    base = docs.withColumn("__source", source).withColumn("__name", name)
    base = base.withColumn("n_tokens", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long"))
    slim = written(base.select("__source", "__name", "n_tokens"), "tokens")
    sizes = slim.groupBy("__source").agg(F.sum("n_tokens").alias("tokens"))
    plans = written(plan(sizes, max_epochs, target_entropy, budget_tokens), "plans")

    last = slim.join(plans.where("left > 0"), "__source").withColumn("order", _order(seed, F.col("whole") + 1))
    last = last.withColumn("cell", _cell(F.col("order")))
    sums = last.groupBy("__source", "cell").agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left"))
    # CELLS rows for a source at most
    run = Window.partitionBy("__source").orderBy("cell")
    sums = sums.withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    edge = sums.where("upto > left").groupBy("__source").agg(F.min_by(F.struct("cell", (F.col("left") - F.col("upto") + F.col("n")).alias("room")), "cell").alias("edge"))
    edge = written(edge.select("__source", "edge.cell", "edge.room"), "edges")
    within = last.join(edge, ["__source", "cell"]).groupBy("__source", "order").agg(F.sum("n_tokens").alias("n"), F.first("room").alias("room"))
    within = within.withColumn("upto", F.sum("n").over(Window.partitionBy("__source").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)))
    cut = within.where("upto <= room").groupBy("__source").agg(F.max("order").alias("order"))
    # the last place taken; without a cut in the cell, cells before it only
    cuts = plans.join(edge, "__source", "left").join(cut, "__source", "left")
    cuts = written(cuts.selectExpr("__source", "weight", "whole AS __whole", "left AS __left", "__blocks", "cell AS __cell", "order AS __cut"), "cuts")

    out = base.join(cuts, "__source")
    order = _order(seed, F.col("__whole") + 1)
    taken = (F.col("__left") > 0) & (F.col("__cell").isNull() | (_cell(order) < F.col("__cell")) | ((_cell(order) == F.col("__cell")) & (order <= F.col("__cut"))))
    times = F.col("__whole") + F.coalesce(taken, F.lit(False)).cast("int")
    out = out.withColumn("__times", times).where("__times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    out = out.withColumn("place", _order(seed, F.col("epoch"))).withColumn("block", _block(F.col("place")))
    return out.select(*by_name(*docs.columns), "n_tokens", "weight", "epoch", "block", "place")
