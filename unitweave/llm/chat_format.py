"""Chat formatting with budgeted windows, in DataFrame operations only.

Prefix sums of turn tokens cut a conversation into spans that begin and end at turns. Each span becomes one training
window: the system turn, then as many whole turns before the span as the history budget holds, then the span. Only
assistant turns of the span are under the loss mask; repeated turns are marked as past and masked out.

    [TURN] role [SAYS] text </s>        a turn of the span
    [PAST] role [SAYS] text </s>        a repeated turn

Control strings inside roles and texts get a tilde after their first character (one more, where there are some), which
reading takes away again; all other text is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN_TOKENS = 512
HISTORY_TOKENS = 128
# The control strings of the template and of the chat markup it keeps texts from imitating.
TURN, PAST, SAYS, END = "[TURN]", "[PAST]", "[SAYS]", "</s>"
ESCAPED = r"(\[|<)(~*)(TURN\]|PAST\]|SAYS\]|INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)"
UNESCAPED = r"(\[|<)~(~*)(TURN\]|PAST\]|SAYS\]|INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPED, "$1$2$3")


def format_windows(turns: DataFrame, span_tokens: int = SPAN_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, window, formatted, loss_spans (start from 0 and length, in code points), n_tokens for turns (conv_id, turn, role, text).

    Turns are ordered by turn, null last; rows that share a turn number are all kept, ordered by role and text. Null roles
    and texts count as empty. A turn costs its words plus three markers. The first turn is the system turn if its role
    is system. A span holds the turns whose tokens begin inside it, so a turn longer than the budget makes a longer window
    and is never cut. history_tokens may not exceed span_tokens. Null conv_id is a conversation of its own.
    """
    if history_tokens > span_tokens:
        raise ValueError("history_tokens may not exceed span_tokens")
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = clean.select("*", F.row_number().over(ordered).alias("place"), (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + 3).cast("long").alias("tokens"))
    rows = rows.withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("starts", F.coalesce(F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).over(before), F.lit(0)))
    rows = rows.withColumn("span", F.floor(F.col("starts") / F.lit(span_tokens)).cast("long"))
    whole, later = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("span").rangeBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({"next_span": F.min("span").over(later), "next_starts": F.min("starts").over(later)})
    spans = F.array_distinct(F.array("span", F.when(F.col("next_starts") - F.col("starts") <= history_tokens, F.col("next_span"))))
    uses = F.filter(F.when(F.col("system"), F.col("all_spans")).otherwise(spans), lambda x: x.isNotNull())
    rows = rows.withColumn("all_spans", F.when(F.col("system"), F.collect_set("span").over(whole)))
    rows = rows.select("*", F.explode(uses).alias("window"))
    mark = F.when(F.col("window") == F.col("span"), F.lit(TURN)).otherwise(F.lit(PAST))
    head = F.concat(mark, escape(F.col("role")), F.lit(SAYS))
    turn = F.struct("place", head.alias("head"), escape(F.col("text")).alias("text"), ((F.col("role") == "assistant") & (F.col("window") == F.col("span"))).alias("target"), "tokens")
    windows = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END)))
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["text"]) + len(END)).alias("at"),
            F.when(t["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["text"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    n_tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    return windows.select("conv_id", "window", F.array_join(piece, "").alias("formatted"), ends["spans"].alias("loss_spans"), n_tokens.alias("n_tokens"))


def read_windows(windows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; in order, each once), loss_texts and formatted_chars, from formatted windows alone.

    windows are those of format_windows() (conv_id, window, formatted, loss_spans), each once. A null conv_id is a
    conversation of its own; empty texts come back empty; no windows give no rows. Other columns are ignored.
    """
    part = F.slice(F.split("formatted", F.lit(END)), 1, F.size(F.split("formatted", F.lit(END))) - 1)
    fresh = F.filter(part, lambda x: x.startswith(TURN))
    said = F.transform(
        fresh,
        lambda x: F.struct(
            unescape(F.substring_index(F.substring(x, len(TURN) + 1, 2**31 - 1), SAYS, 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, SAYS) + F.lit(len(SAYS)), F.lit(2**31 - 1))).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    one = windows.select("conv_id", F.struct("window", said.alias("turns"), loss.alias("loss")).alias("window"), F.length("formatted").alias("chars"))
    conv = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("window")).alias("windows"), F.sum("chars").alias("formatted_chars"))
    return conv.select("conv_id", F.flatten(F.transform("windows", lambda w: w["turns"])).alias("turns"), F.flatten(F.transform("windows", lambda w: w["loss"])).alias("loss_texts"), "formatted_chars")
