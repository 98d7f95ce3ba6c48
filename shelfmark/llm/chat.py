"""Chat formatting in budgeted windows.

Turns are laid out in order with prefix sums of their tokens; windows are spans of
whole turns, chosen greedily from the prefix sums so that new turns, the system
turn and the repeated history fit the budget.  Every window but the first repeats
the system turn (a first turn with that role) and a limited history; repeated
turns are masked, so each assistant text is a target exactly once.

A turn counts as many tokens as its written form has UTF-8 bytes.  No byte-level
tokenizer takes more, so no window of several turns exceeds the budget, whatever
the script.  Exact counts can be given as a column; then only marks, role and
escapes count by their bytes, and windows are fuller.

A turn is written ``<s>role[INST]text[/INST]</s>``.  Inside roles and texts a control
string gets a backslash before its last character, and one that has backslashes
there gets one more; taking one away is the exact inverse.

A conversation is one row at the end, as its digest covers it in order, and while
it is formatted; that bounds a conversation by a task's memory, whatever the number
of conversations.

Defined cases: a null role or text is empty; turns with equal numbers are ordered
by role and text, null numbers come first; a turn above the budget has a window of
its own; a missing or negative token count is taken by bytes; other columns of the
input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import let

OPEN, BODY, SHUT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"(</?s|\[/?INST)(\\*)([>\]])"
ESCAPED = r"(</?s|\[/?INST)\\(\\*)([>\]])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def turns_of(conversations: DataFrame, conv: str, turn: str, role: str, text: str, tokens: str | None) -> DataFrame:
    """``conv`` and its turns in order, each with its written form and prefix sums of tokens and characters."""
    given = F.col(tokens).cast("long") if tokens else F.lit(None).cast("long")
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
        F.when(given >= 0, given).alias("given"))
    written = rows.select(
        "conv", "turn", "role", "text", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY)).alias("head"), escape(F.col("text")).alias("body"), "given")
    piece = F.concat("head", "body", F.lit(SHUT + CLOSE))
    size = F.octet_length(piece).cast("long")
    written = written.withColumn("tokens", F.coalesce(F.col("given") + size - F.octet_length("text"), size))
    order = W.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = written.select(
        "conv", piece.alias("piece"), F.length("head").cast("long").alias("at"), F.length("body").cast("long").alias("length"),
        F.length(piece).cast("long").alias("chars"), "tokens", (F.col("role") == "assistant").alias("target"), (F.col("role") == "system").alias("system"),
        F.row_number().over(W.partitionBy("conv").orderBy("turn", "role", "text")).alias("i"),
        F.sum("tokens").over(order).alias("tokens_to"), F.sum(F.length(piece).cast("long")).over(order).alias("chars_to"))
    return sums.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(
        "i", "piece", "at", "length", "chars", "tokens", "target", "system", "tokens_to", "chars_to"))).alias("t"))


def window_starts(t: Column, budget: int, history: int) -> Column:
    """Numbers of the turns at which windows start, from the prefix sums."""
    fixed = F.when(F.element_at(t, 1)["system"], F.element_at(t, 1)["tokens"]).otherwise(F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        room = F.when(F.size(acc["starts"]) == 1, F.lit(budget)).otherwise(F.lit(budget - history) - acc["fixed"])
        before = x["tokens_to"] - x["tokens"]
        over = (x["tokens_to"] - acc["from"] > room) & (before > acc["from"])
        return F.when(over, F.struct(before.alias("from"), acc["fixed"].alias("fixed"), F.concat(acc["starts"], F.array(x["i"])).alias("starts"))).otherwise(acc)

    first = F.struct(F.lit(0).cast("long").alias("from"), fixed.cast("long").alias("fixed"), F.array(F.lit(1)).alias("starts"))
    return F.aggregate(t, first, step, lambda acc: acc["starts"])


def written_window(t: Column, start: Column, stop: Column, number: Column, history: int, history_turns: int) -> Column:
    """One window of the turns ``start`` to ``stop``: text, loss spans and number of repeated turns."""
    at = F.element_at(t, start)
    before = at["tokens_to"] - at["tokens"]
    lead = F.when(F.element_at(t, 1)["system"] & (start > 1), 1).otherwise(0)
    low = F.greatest(lead + 1, start - history_turns)
    near = F.when(low < start, F.filter(F.slice(t, low, start - low), lambda x: before - (x["tokens_to"] - x["tokens"]) <= history)).otherwise(F.slice(t, 1, 0))

    def write(x: Column) -> Column:
        shift = F.aggregate(x["old"], F.lit(0).cast("long"), lambda a, y: a + y["chars"]) - (at["chars_to"] - at["chars"])
        return F.struct(
            number.alias("window"),
            F.array_join(F.transform(F.concat(x["old"], x["new"]), lambda y: y["piece"]), "").alias("text"),
            F.transform(F.filter(x["new"], lambda y: y["target"]), lambda y: F.struct(
                (shift + y["chars_to"] - y["chars"] + y["at"]).alias("start"), y["length"].alias("length"))).alias("loss"),
            F.size(x["old"]).alias("n_repeated"),
            F.aggregate(F.concat(x["old"], x["new"]), F.lit(0).cast("long"), lambda a, y: a + y["tokens"]).alias("n_tokens"))

    return let(F.struct(F.concat(F.slice(t, 1, lead), near).alias("old"), F.slice(t, start, stop - start + 1).alias("new")), write)


def chat_windows(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = 2048, history: int = 512, history_turns: int = 4, tokens: str | None = None,
) -> DataFrame:
    """One row per window: ``conv``, ``window``, ``text``, ``loss`` (start, length in code points), ``n_repeated``, ``n_tokens``.

    ``tokens`` names a column with each text's exact number of tokens, if there is one.
    """
    turns = turns_of(conversations, conv, turn, role, text, tokens)
    windows = let(F.struct(F.col("t"), window_starts(F.col("t"), budget, history).alias("starts")), lambda x: F.transform(
        x["starts"], lambda s, k: written_window(
            x["t"], s, F.coalesce(F.get(x["starts"], k + 1) - 1, F.size(x["t"])), k, history, history_turns)))
    return turns.select("conv", F.explode(windows).alias("w")).select("conv", "w.*")


def read_back(windows: DataFrame) -> DataFrame:
    """Parse windows: ``conv``, ``window``, new ``turns`` (role, text), the ``targets`` under the mask, ``chars``."""
    segments = F.split("text", CLOSE, -1)

    def parsed(segment: Column) -> Column:
        role = F.substring_index(F.substr(segment, F.lit(len(OPEN) + 1)), BODY, 1)
        head = F.length(role) + len(OPEN) + len(BODY)
        return F.struct(
            unescape(role).alias("role"),
            unescape(F.substr(segment, head + 1, F.length(segment) - head - len(SHUT))).alias("text"))

    return windows.select(
        "conv", "window",
        let(F.struct(segments.alias("s"), F.col("n_repeated").alias("r")), lambda x: F.transform(
            F.slice(x["s"], x["r"] + 1, F.size(x["s"]) - x["r"] - 1), parsed)).alias("turns"),
        let(F.struct("text", "loss"), lambda x: F.transform(x["loss"], lambda m: unescape(
            F.substr(x["text"], (m["start"] + 1).cast("int"), m["length"].cast("int"))))).alias("targets"),
        F.length("text").cast("long").alias("chars"))
