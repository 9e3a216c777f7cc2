"""Chat formatting in budgeted windows, with DataFrame functions alone.

Turns are numbered and their token estimates summed along the conversation, in two steps, so that a conversation of
very many turns is spread over tasks. The prefix sums cut it into turn-aligned spans: a grid of span budgets, where a
turn belongs to the cell it ends in, and a turn that crosses into a full cell stands alone. A window is a span with the
conversation's system turn and up to ``history`` earlier turns (within the history budget) before it; those carry no
loss, so that each assistant turn is a target once. The system turn's tokens are taken out of its conversation's span.

A turn is written ``### role``, a line end, its text, ``</turn>`` and a line end. Within texts and roles a backslash is
doubled, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\t`` and, in roles, a line end becomes ``\\n``.

Defined cases: null texts and roles count as empty; rows of equal turn are ordered by role and text; rows without a
turn come first; a conversation with a null id is one conversation; a single turn that is over budget is kept whole in
a window of its own; where the system turn leaves no room for a span, every turn stands in a window of its own behind
it, over the budget; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

HEADER, END = "### ", "</turn>\n"
#: Estimated tokens: one for each so many characters, and so many for a turn's marks.
CHARS_PER_TOKEN, MARK_TOKENS = 4, 6
#: Turns of one conversation that are numbered in one group.
CHUNK = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\t"))


def unescape(text: Column) -> Column:
    """Doubled backslashes are found from the left; what stands between them holds whole escapes only."""
    parts = F.split(text, r"\\\\")
    plain = F.transform(parts, lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("###")), F.lit("\\t"), F.lit("</turn>")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text (both escaped), tokens, each turn's place and token prefix sum (place, upto), and the tokens of
    the conversation's system turn, its first (system)."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"role": F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), "text": escape(F.col("text"))})
    rows = rows.withColumns({"tokens": (F.ceil(F.length("text") / CHARS_PER_TOKEN) + MARK_TOKENS).cast("long"), "chunk": F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK)})
    chunks = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.min(F.when(F.col("role") == "system", F.struct("turn", "text", "tokens"))).alias("s"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x + "0") for x in ("n", "t")), F.coalesce(F.min("s").over(Window.partitionBy("conv_id"))["tokens"], F.lit(0)).alias("system"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    rows = rows.withColumns({"place": F.row_number().over(inside), "upto": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    met = rows.join(chunks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    return met.select("conv_id", "role", "text", "tokens", (F.col("place") + F.col("n0")).alias("place"), (F.col("upto") + F.col("t0")).alias("upto"), "system")


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 2, history_budget: int = 384, system_budget: int = 128) -> DataFrame:
    """One row a window: conv_id, window (its first turn's place), n_context (turns repeated before its own), formatted,
    n_turns (of its own), tokens (estimated), loss_spans (array of start, length: code points of ``formatted``).
    ``system_budget`` is what is set aside for the system turn at least."""
    span = F.greatest(F.lit(budget - history_budget) - F.greatest("system", F.lit(system_budget)), F.lit(1))
    rows = written(numbered(turns), "turns").withColumn("cell", F.floor((F.col("upto") - 1) / span))
    rows = rows.withColumn("crosses", F.col("upto") - F.col("tokens") < F.col("cell") * span)
    cells = rows.groupBy("conv_id", "cell").agg(F.sum("tokens").alias("all"), F.min("place").alias("first"), F.min(F.when(~F.col("crosses"), F.col("place"))).alias("second"))
    cells = cells.select(F.col("conv_id").alias("c"), F.col("cell").alias("k"), "all", "first", "second")
    rows = rows.join(cells, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("cell") == F.col("k")))
    start = F.when((F.col("all") <= span) | F.col("crosses"), F.col("first")).otherwise(F.col("second"))
    rows = written(rows.select("conv_id", "role", "text", "tokens", "place", "upto", start.alias("window")), "spans")
    starts = rows.filter("place = window").select(F.col("conv_id").alias("c"), "window", (F.col("upto") - F.col("tokens")).alias("at"))

    # an earlier turn offers itself to the windows that start within `history` turns after it
    offers = rows.select("conv_id", "role", "text", "tokens", "place", "upto", F.explode(F.sequence(F.col("place") + 1, F.col("place") + history)).alias("w")) if history else rows.limit(0).withColumn("w", F.col("place"))
    near = offers.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("w") == F.col("window")))
    near = near.filter(F.col("at") - (F.col("upto") - F.col("tokens")) <= history_budget).select("conv_id", "window", "place", "role", "text", "tokens")
    system = rows.filter("role = 'system'").groupBy("conv_id").agg(F.min("place").alias("place")).select(F.col("conv_id").alias("sc"), F.col("place").alias("sp"))
    system = rows.join(system, F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("place") == F.col("sp"))).select("sc", "place", "role", "text", "tokens")
    system = starts.join(system, F.col("c").eqNullSafe(F.col("sc")) & (F.col("place") < F.col("window"))).select(F.col("c").alias("conv_id"), "window", "place", "role", "text", "tokens")
    context = near.union(system).withColumn("own", F.lit(False))
    own = rows.select("conv_id", "window", "place", "role", "text", "tokens", F.lit(True).alias("own"))

    one = F.struct("place", "own", "role", "text", "tokens")
    sets = own.union(context).groupBy("conv_id", "window").agg(F.array_sort(F.array_distinct(F.collect_list(one))).alias("turns"))  # a window's worth: the budget, or one turn
    head = F.length(F.lit(HEADER)) + 1
    whole = lambda t: F.concat(F.lit(HEADER), t["role"], F.lit("\n"), t["text"], F.lit(END))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        size = F.length(whole(t))
        mark = F.struct((acc["at"] + head + F.length(t["role"])).cast("int").alias("start"), F.length(t["text"]).cast("int").alias("length"))
        spans = F.when(t["own"] & (t["role"] == "assistant"), F.concat(acc["spans"], F.array(mark))).otherwise(acc["spans"])
        return F.struct((acc["at"] + size).cast("int").alias("at"), spans.alias("spans"))

    return sets.select(
        "conv_id",
        "window",
        F.size(F.filter("turns", lambda t: ~t["own"])).alias("n_context"),
        F.size(F.filter("turns", lambda t: t["own"])).alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
        F.array_join(F.transform("turns", whole), "").alias("formatted"),
        F.aggregate("turns", first, add, lambda a: a["spans"]).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text: its own only, unescaped), targets (texts under the loss mask)."""
    parts = F.filter(F.split("formatted", END), lambda x: x != "")
    own = F.slice(parts, F.col("n_context") + 1, F.greatest(F.size(parts) - F.col("n_context"), F.lit(0)))

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        return F.struct(unescape(F.substring(x, F.lit(len(HEADER) + 1), cut - 1 - len(HEADER))).alias("role"), unescape(F.substring(x, cut + 1, F.length(x))).alias("text"))

    targets = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", F.length("formatted").alias("chars"), F.transform(own, turn).alias("turns"), targets.alias("targets"))


def window_digests(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its windows. A digest of a whole conversation needs it in one row."""
    read = read_windows(windows).select(
        "conv_id",
        "chars",
        F.size("turns").alias("n"),
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("targets", "").alias("targets"),
        ).alias("w"),
    )
    sets = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    turns, targets = F.array_join("ws.turns", ""), F.array_join("ws.targets", "")
    return sets.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
