"""Usage, traces, ledgers and evaluation over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_cost(input_tokens: Column, output_tokens: Column, cached: Column, input_rate: Column, output_rate: Column, cached_rate: Column) -> Column:
    """Price of a call: rates are per million tokens, cached input at its own rate. Sums are rounded to 6, not their parts."""
    fresh = F.greatest(input_tokens - cached, F.lit(0))
    return (fresh * input_rate + cached * cached_rate + output_tokens * output_rate) / 1e6


def price_lookup(calls: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """Calls with their rate: the exact model id first, else the id without its provider prefix; null if unpriced."""
    exact, bare = prices.select(F.col("model").alias("m1"), F.col("rate").alias("r1")), prices.select(F.col("model").alias("m2"), F.col("rate").alias("r2"))
    name = F.regexp_replace(F.col(model), "^[^/]*/", "")
    out = calls.join(exact, F.col(model) == F.col("m1"), "left").join(bare, name == F.col("m2"), "left")
    return out.withColumn("rate", F.coalesce("r1", "r2")).drop("m1", "m2", "r1", "r2")


def usage_by_day(events: DataFrame, owner: str, ts: str, usd: str, coins: str) -> DataFrame:
    """Per owner and day: turns, usd, coins and credits (both together), rounded to 6."""
    usd_sum, coin_sum = F.round(F.sum(usd), 6), F.round(F.sum(coins), 6)
    return events.groupBy(owner, F.to_date(ts).alias("day")).agg(F.count("*").alias("turns"), usd_sum.alias("usd"), coin_sum.alias("coins"), F.round(F.sum(usd) + F.sum(coins), 6).alias("credits"))


def trace_summary(events: DataFrame, thread: str, kind: str, order: str, payload: str) -> DataFrame:
    """Per thread: events of each kind, the first route, the last answer that isn't blank."""
    answer = F.when((F.col(kind) == "view") & (F.trim(payload) != ""), F.col(order))
    return events.groupBy(thread).agg(
        *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in ("error", "click", "view", "purchase", "signup")],
        F.min_by(F.when(F.col(kind) == "click", F.col(payload)), F.when(F.col(kind) == "click", F.col(order))).alias("first_route"),
        F.max_by(payload, answer).alias("last_answer"),
    )


def pair_calls(calls: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row a call id: the call and its result, either of which may be missing."""
    return calls.join(results, key, "full_outer")


def repeats(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with how many equal ones came before."""
    return events.withColumn("before", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def memo_hit(events: DataFrame, world: str, keys: list[str], order: str, failed: Column, changes: Column) -> DataFrame:
    """Whether an equal earlier call answers: it didn't fail and nothing in its ``world`` changed in between.

    A world is a session or user, so its window is as long as one session, never a whole table.
    """
    by_world = Window.partitionBy(world).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    state = events.withColumn("world_no", F.coalesce(F.sum(changes.cast("long")).over(by_world), F.lit(0)))
    by_key = Window.partitionBy(world, *keys).orderBy(order)
    earlier = F.lag("world_no").over(by_key)
    ok = F.lag((~failed).cast("int")).over(by_key)
    return state.withColumn("memo", F.coalesce((earlier == F.col("world_no")) & (ok == 1), F.lit(False)))


def scorecard(rows: DataFrame, by: str, correct: Column, solvable: Column, refused: Column) -> DataFrame:
    """Tasks, correct among solvable ones, refused among the others, and both as a share of all."""
    strict = (solvable & correct) | (~solvable & refused)
    return rows.groupBy(by).agg(
        F.count("*").alias("tasks"), F.count_if(solvable).alias("solvable"), F.count_if(solvable & correct).alias("correct"),
        F.count_if(~solvable & refused).alias("refused"), F.round(F.avg(strict.cast("double")), 6).alias("strict"),
    )


def check_rates(rows: DataFrame, by: str, fired: Column, wrong: Column) -> DataFrame:
    """Per check: fires on right and wrong rows, precision, and recall over the wrong ones."""
    hit = F.count_if(fired & wrong)
    return rows.groupBy(by).agg(
        F.count_if(fired & ~wrong).alias("on_right"), hit.alias("on_wrong"), F.round(hit / F.nullif(F.count_if(fired), F.lit(0)), 6).alias("precision"), F.round(hit / F.nullif(F.count_if(wrong), F.lit(0)), 6).alias("recall"),
    )


def last_n(df: DataFrame, thread: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(thread).orderBy(F.desc(order))
    return df.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def newest_within_budget(df: DataFrame, thread: str, tool: str, order: str, size: str, per_tool: int, last: int, budget: int) -> DataFrame:
    """The newest rows of each tool, of these the last ones, of these the newest while their size fits; the newest always stays."""
    first = last_n(df, tool if thread is None else thread, order, 10**9).withColumn("of_tool", F.row_number().over(Window.partitionBy(thread, tool).orderBy(F.desc(order)))).where(F.col("of_tool") <= per_tool)
    w = Window.partitionBy(thread).orderBy(F.desc(order))
    kept = first.drop("age").withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    run = kept.withColumn("upto", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("upto") <= budget) | (F.col("n") == 1))


def disagreements(facts: DataFrame, name: str, run: str, value: str, inputs: str, tolerance: float) -> DataFrame:
    """Pairs of runs that share an input and a named figure but differ by more than ``tolerance`` of the larger."""
    a = facts.select(F.col(name).alias("name"), F.col(inputs).alias("input"), F.col(run).alias("run_a"), F.col(value).alias("value_a"))
    b = facts.select(F.col(name).alias("name"), F.col(inputs).alias("input"), F.col(run).alias("run_b"), F.col(value).alias("value_b"))
    apart = F.abs(F.col("value_a") - F.col("value_b")) > tolerance * F.greatest(F.abs("value_a"), F.abs("value_b"))
    return a.join(b, ["name", "input"]).where((F.col("run_a") < F.col("run_b")) & apart)


def resolve_numbers(stated: DataFrame, facts: DataFrame, sid: str, sval: str, fid: str, fval: str, tolerance: float) -> DataFrame:
    """(stated, fact) pairs whose values agree within an absolute tolerance, by a join on buckets of that width."""
    s = stated.withColumn("bucket", F.explode(F.array(*[F.floor(F.col(sval) / tolerance) + k for k in (-1, 0, 1)])))
    f = facts.withColumn("bucket", F.floor(F.col(fval) / tolerance))
    return s.join(f, "bucket").where(F.abs(F.col(sval) - F.col(fval)) <= tolerance).select(sid, fid)
