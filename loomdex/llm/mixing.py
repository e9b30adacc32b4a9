"""Mixing of sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order. A document's virtual finish
time is the number of tokens of its source up to and with it, divided by the source's
target share; a repetition of the queue goes on where the last ended. All queues are
merged by finish time and cut where the tokens reach the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.slices import running_total
from ..runtime import cut, shuffle_width, spread
from .encoding import BYTE_BPE, count_tokens

#: Slices for each partition.
SLICES_EACH = 2
#: Most rows of targets that are broadcast; more are joined by a shuffle.
BROADCAST_TARGETS = 10_000
SEED = 20_190_107


def _targets(targets: DataFrame) -> DataFrame:
    """Targets with the normalised source as ``_source``; rows with a null are no targets."""
    names = ["mix_name", "source", "target_share", "max_repeats"]
    kept = targets.select(*names).dropna().distinct()
    return kept.withColumn("_source", normal_source(F.col("source")))


def normal_source(source):
    """A source without white space around it and in lower case."""
    return F.lower(F.regexp_replace(source, r"(?U)\A\s+|\s+\z", ""))


def source_queues(documents: DataFrame, targets: DataFrame, file: str = BYTE_BPE, seed: int = SEED) -> DataFrame:
    """Documents of the wanted sources in shuffled order: (_source, doc_id, copy, tokens, upto).

    ``upto`` is the number of tokens of the source up to and with the document. Documents
    with a null source or text belong to none; repeated rows each count and are told
    apart by ``copy``. The order depends on ``seed``, doc_id and text alone. A source of
    any size is spread over all partitions.
    """
    spark = documents.sparkSession
    width = shuffle_width(spark)
    wanted = targets.select("_source").distinct()
    if targets.count() <= BROADCAST_TARGETS:
        wanted = F.broadcast(wanted)
    rows = (
        spread(documents.select("doc_id", "text", normal_source(F.col("source")).alias("_source")))
        .where(F.col("text").isNotNull() & F.col("_source").isNotNull())
        .join(wanted, "_source", "left_semi")
        .select("_source", "doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("mixed"), "text")
    )
    # Tokens are counted once and kept; all later steps read these few narrow columns.
    sized = cut(count_tokens(rows, file).withColumn("copy", F.monotonically_increasing_id()))
    slices = width * SLICES_EACH
    # Hashes are even over their whole range, so even slices are as long.
    part = F.floor((F.col("mixed").cast("double") / F.lit(2.0**64) + 0.5) * slices)
    sliced = sized.withColumn("_slice", F.least(part, F.lit(slices - 1)).cast("int"))
    return running_total(sliced, ["_source"], ["mixed", "doc_id", "copy"], "tokens", "upto", width).drop("_slice")


def budgets(queues: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with the ``size`` of each source, and of its mix the ``budget`` and the virtual time ``until``.

    The budget is the sum of the sizes of the mix's sources with a share above 0. No
    document that finishes after ``until`` is within it: until is the virtual time at
    which the queues together have given the budget and the longest document of each
    source, as each may have one that is unfinished and counts nothing yet. It is the
    end of the last queue if there aren't enough tokens. One row for each target.
    """
    sizes = queues.groupBy("_source").agg(F.max("upto").alias("size"), F.max("tokens").alias("_longest"))
    known = targets.join(sizes, "_source", "left").withColumns(
        {"size": F.coalesce("size", F.lit(0)), "_longest": F.coalesce("_longest", F.lit(0))}
    )
    live = F.col("target_share") > 0
    total = F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0))
    most = total + F.coalesce(F.sum(F.when(live, F.col("_longest"))), F.lit(0))
    ends = F.when(live, F.col("max_repeats") * F.col("size") / F.col("target_share"))
    per_mix = known.groupBy("mix_name").agg(
        total.alias("budget"),
        most.alias("_most"),
        F.array_sort(F.collect_list(F.when(live, F.struct(ends.alias("end"), F.col("target_share").alias("share"))))).alias("ends"),
    )
    # Tokens given at time t: the full content of queues that ended by t and share * t of the others.
    given = lambda t: F.aggregate(
        "ends", F.lit(0.0), lambda s, x: s + x["share"] * F.least(x["end"], t)
    )
    # Between two ends the amount grows linearly: find the first end at which it is enough.
    enough = F.filter("ends", lambda x: given(x["end"]) >= F.col("_most"))
    at = F.get(enough, F.lit(0))["end"]
    open_share = F.aggregate(
        "ends", F.lit(0.0), lambda s, x: s + F.when(x["end"] >= at, x["share"]).otherwise(F.lit(0.0))
    )
    over = given(at) - F.col("_most")
    last = F.coalesce(F.array_max(F.transform("ends", lambda x: x["end"])), F.lit(0.0))
    until = F.when(at.isNull(), last).otherwise(at - over / open_share)
    return known.drop("_longest").join(per_mix.select("mix_name", "budget", until.alias("until")), "mix_name")


def mix(queues: DataFrame, budget: DataFrame) -> DataFrame:
    """The mixes: (mix_name, source, doc_id, repeat, tokens, finish, upto), ``upto`` running within the mix.

    Rows are those whose running total in the order of (finish, source, doc_id) stays
    within the mix's budget. A document is used at most max_repeats times, each use
    being one repetition of its source's queue. Documents without a token come with the
    ones before them. Mixes with no document are absent.
    """
    spark = queues.sparkSession
    width = shuffle_width(spark)
    side = F.broadcast(budget) if budget.count() <= BROADCAST_TARGETS else budget
    live = side.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    joined = queues.join(live, "_source")
    # No repetition that only begins after the last time a document can fit is ever made.
    turns = F.ceil(F.col("target_share") * F.col("until") / F.greatest("size", F.lit(1))) + 1
    rounds = F.greatest(F.least(turns, F.col("max_repeats").cast("bigint")), F.lit(1))
    each = joined.withColumn("repeat", F.explode(F.sequence(F.lit(0), (rounds - 1).cast("int"))))
    finish = (F.col("repeat") * F.col("size") + F.col("upto")) / F.col("target_share")
    # This only spares work: what it drops is beyond the budget anyway. The running total alone cuts.
    timed = each.withColumn("finish", finish).where(F.col("finish") <= F.col("until") * (1 + 1e-9) + 1)
    slices = width * SLICES_EACH
    # Virtual time passes evenly with tokens, so even bounds make even slices.
    part = F.least(F.floor(F.col("finish") / F.greatest(F.col("until"), F.lit(1.0)) * slices), F.lit(slices)).cast("int")
    rows = timed.select(
        "mix_name", "source", "doc_id", "copy", "repeat", "tokens", "finish", "budget", part.alias("_slice")
    )
    order = ["finish", "source", "repeat", "doc_id", "copy"]
    merged = running_total(rows, ["mix_name"], order, "tokens", "upto", width)
    return merged.where(F.col("upto") <= F.col("budget")).select(
        "mix_name", "source", "doc_id", "repeat", "tokens", "finish", "upto"
    )


def mix_report(documents: DataFrame, targets: DataFrame, file: str = BYTE_BPE) -> DataFrame:
    """Targets held against what the mixes reached, one row for each distinct target.

    (mix_name, source, target_share, max_repeats, size, budget, tokens, share, most_uses,
    short): the tokens and share of the source in its mix, how often its documents were
    used at most, and whether it fell short. A source is short if the mix has used up its
    queue, all repetitions of it, and got less than its share of the budget. Its queue
    then ends before the virtual time at which every source would have given its share,
    so all of it is in the mix.
    """
    goals = _targets(targets)
    queues = cut(source_queues(documents, goals, file))
    known = cut(budgets(queues, goals))
    used = mix(queues, known).groupBy("mix_name", "source").agg(
        F.sum("tokens").alias("tokens"), (F.max("repeat") + 1).alias("most_uses")
    )
    whole = used.groupBy("mix_name").agg(F.sum("tokens").alias("_whole"))
    got = F.coalesce("tokens", F.lit(0))
    used_up = got == F.col("max_repeats") * F.col("size")
    short = used_up & (F.col("target_share") * F.col("budget") > got)
    return (
        known.join(used, ["mix_name", "source"], "left")
        .join(whole, "mix_name", "left")
        .select(
            "mix_name", "source", "target_share", "max_repeats", "size", "budget",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.when(F.col("_whole") > 0, F.coalesce("tokens", F.lit(0)) / F.col("_whole")).alias("share"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            short.alias("short"),
        )
    )


def mixed_documents(documents: DataFrame, targets: DataFrame, file: str = BYTE_BPE) -> DataFrame:
    """The documents of every mix; see ``mix``."""
    goals = _targets(targets)
    queues = cut(source_queues(documents, goals, file))
    return mix(queues, cut(budgets(queues, goals)))


def short_sources(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source) of the targets that can't be reached within max_repeats."""
    return mix_report(documents, targets).where("short").select("mix_name", "source")
