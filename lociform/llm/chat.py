"""Operator 3: chat formatting in budgeted windows, in DataFrame functions only.

A conversation's turns are put in order; a fold over their tokens, in stretches
of ``STRETCH`` turns, chooses turn-aligned spans, one for each window.  A window holds the conversation's
system turn, a limited number of turns of history, and its own span; a span is
closed before the turn that would take all of these over the budget.  History is
limited by that budget too: where a window's first own turn and the system turn
leave no room for all of it, the oldest turns are not repeated.  Only
assistant turns of the own span are under the loss mask, so a target that is
repeated as history is masked out.

Template of a turn: ``<s>`` role ``[INST]`` text ``[/INST]</s>``.  Control
strings inside roles and texts are escaped by one backslash after their first
character, and so are escaped ones, so unescaping restores the input exactly.

Defined results: null text and null role count as empty; rows of a conversation
are ordered by turn (null first), then role, then text, and equal rows all stay;
a null ``conv_id`` is a conversation of its own; an empty table gives an empty
result; other columns are not read; very long texts are formatted whole.  Only a
window whose one own turn and system turn exceed the budget together does so, as
turns are never cut; it repeats no history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, HEAD, TAIL, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_ESCAPE = r"([<\[])(\\*(?:/?s>|/?INST\]))"
_UNESCAPE = r"([<\[])\\(\\*(?:/?s>|/?INST\]))"

BUDGET, HISTORY, HISTORY_BUDGET = 512, 2, 256
#: Turns of a conversation that lie in one array while spans are chosen; a longer one begins a window at each multiple.
STRETCH = 4096


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2"))


def _tokens(text: Column) -> Column:
    """Tokens as the budget counts them: four bytes each, rounded up, and four for the template."""
    return F.ceil(F.octet_length(text) / 4) + 4


def turns(conversations: DataFrame, budget: int, history: int, history_budget: int) -> DataFrame:
    """Ordered turns, the window that their own span belongs to, and how many turns a window that begins with one repeats."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("tokens", _tokens(F.col("text")))
    ahead = F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    # What a window that begins with this turn repeats: the system turn, and history within reach.
    by_rank = W.partitionBy("conv_id").orderBy("rank")
    first_system = F.min(F.when(F.col("role") == "system", F.col("rank"))).over(by_rank.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("is_system", (F.col("role") == "system") & first_system.isNull())
    repeated = F.coalesce(F.max(F.when(F.col("is_system"), F.col("tokens"))).over(by_rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fits, kept = F.lit(True), F.lit(0)
    for k in range(1, history + 1):
        before = F.when(F.lag("is_system", k).over(by_rank), 0).otherwise(F.lag("tokens", k).over(by_rank))
        near = F.col("ahead") - F.lag("ahead", k).over(by_rank) <= history_budget
        fits = fits & F.coalesce(near & (repeated + before + F.col("tokens") <= budget), F.lit(False))
        repeated, kept = repeated + F.when(fits, before).otherwise(0), kept + F.when(fits, 1).otherwise(0)
    turn = F.struct("rank", "role", "text", "tokens", "ahead", "is_system", repeated.alias("repeated"), kept.alias("history"))
    # A conversation is folded in stretches of ``STRETCH`` turns, each of which begins a window.
    stretch = F.floor((F.col("rank") - 1) / STRETCH).alias("stretch")
    packed = rows.select("conv_id", stretch, turn.alias("turn")).groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    # The first turns of windows after the first; a thousand at a time, so that growing the list stays cheap.
    def step(acc: Column, t: Column) -> Column:
        over = acc["used"] + t["tokens"] > budget
        opens = over & (t["rank"] > F.col("turns")[0]["rank"])
        full = F.size(acc["some"]) >= 1000
        some = F.concat(F.when(full, none).otherwise(acc["some"]), F.array(t["rank"]))
        return F.struct(
            F.when(opens, t["repeated"] + t["tokens"]).otherwise(acc["used"] + t["tokens"]).alias("used"),
            F.when(opens, some).otherwise(acc["some"]).alias("some"),
            F.when(opens & full, F.concat(acc["done"], F.array(acc["some"]))).otherwise(acc["done"]).alias("done"),
        )

    none = F.array().cast("array<bigint>")
    begin = F.struct(F.when(F.col("stretch") > 0, F.col("turns")[0]["repeated"]).otherwise(0).cast("bigint").alias("used"), none.alias("some"), F.array().cast("array<array<bigint>>").alias("done"))
    starts = F.aggregate("turns", begin, step, lambda acc: F.concat(F.array(F.col("turns")[0]["rank"]), F.flatten(F.concat(acc["done"], F.array(acc["some"])))))
    packed = packed.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.col("turns")[0]["rank"] + F.size("turns")))
    first = F.col("turns")[0]["rank"] - 1
    spans = F.zip_with("starts", ends, lambda a, b: F.slice("turns", (a - first).cast("int"), (b - a).cast("int")))
    before = F.coalesce(F.sum(F.size("starts")).over(W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Windows are counted over stretches, before these become rows for each window.
    counted = packed.select("conv_id", before.cast("int").alias("before"), spans.alias("spans"))
    spans = counted.select("conv_id", "before", F.posexplode("spans").alias("at", "span"))
    each = spans.select("conv_id", (F.col("before") + F.col("at") + 1).alias("window"), F.posexplode("span").alias("place", "turn"))
    return each.select("conv_id", "window", "turn.rank", "turn.role", "turn.text", "turn.is_system", F.when(F.col("place") == 0, F.col("turn.history")).otherwise(0).alias("history"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET) -> DataFrame:
    """A row for each window: ``conv_id``, ``window``, ``formatted``, ``own`` (whether each of its turns belongs to
    its own span) and ``loss`` (start and length, in code points, of the stretches under the loss mask)."""
    base = turns(conversations, budget, history, history_budget)
    order = W.partitionBy("conv_id").orderBy("rank")
    whole = W.partitionBy("conv_id")
    # A turn is history of the windows that begin within the next few turns and reach back to it.
    reach = [F.when(F.lead("history", k).over(order) >= k, F.lead("window", k).over(order)) for k in range(1, history + 1)]
    base = base.withColumn("later", F.array_compact(F.array_distinct(F.array(*reach)))).withColumn("last", F.max("window").over(whole))
    column = ["conv_id", "rank", "role", "text", F.col("window").alias("home")]
    own = base.filter(~F.col("is_system")).select(*column, F.explode(F.array_distinct(F.concat(F.array("window"), "later"))).alias("window"))
    kept = base.filter("is_system").select(*column, F.explode(F.sequence("window", "last")).alias("window"))
    rows = own.unionByName(kept)
    turn = F.struct(
        F.col("rank"),
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("home") == F.col("window")).alias("own"),
        ((F.col("home") == F.col("window")) & (F.col("role") == "assistant")).alias("target"),
    )
    packed = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL + CLOSE)))
    close = len(TAIL + CLOSE)

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        size = F.length(t["body"])
        grown = F.when(t["target"], F.concat(acc["loss"], F.array(F.struct(start.alias("start"), size.alias("length"))))).otherwise(acc["loss"])
        return F.struct((start + size + close).alias("at"), grown.alias("loss"))

    none = F.array().cast("array<struct<start:int,length:int>>")
    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("loss")), step, lambda acc: acc["loss"])
    return packed.select("conv_id", "window", F.array_join(written, "").alias("formatted"), F.transform("turns", lambda t: t["own"]).alias("own"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and targets of each conversation, parsed from the windows' texts, masks and flags."""
    pieces = F.split(F.col("formatted"), r"\[/INST\]</s>")
    parsed = F.transform(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(OPEN) + 1, F.length(p)), HEAD, 1)).alias("role"), unescape(F.substring(p, F.locate(HEAD, p) + len(HEAD), F.length(p))).alias("text")),
    )
    fresh = F.filter(F.zip_with(parsed, "own", lambda t, own: F.struct(own.alias("own"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["own"])
    target = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    window = formatted.select("conv_id", "window", F.length("formatted").cast("long").alias("chars"), fresh.alias("fresh"), F.array_join(target, "").alias("target"))
    whole = window.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "fresh", "target"))).alias("windows"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.transform("windows", lambda w: w["fresh"])).alias("turns"), F.array_join(F.transform("windows", lambda w: w["target"]), "").alias("target"), "formatted_chars")


def report(conversations: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per conversation, read back from its formatted windows."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(windows(conversations, budget)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("target").cast("long").alias("loss_chars"),
        F.sha2("target", 256).alias("loss_sha256"),
        "formatted_chars",
    )
