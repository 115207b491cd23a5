"""Chat formatting (operator 9) in budgeted windows, with DataFrame functions only.

Prefix sums of the turns' token estimates cut a conversation into spans of whole turns: turns that end in the same
stretch of SPAN tokens lie in one span, and a turn that crosses the end of a stretch is a span of its own. A window
repeats the system turn (the first turn, if its role is system; of a long one, as much of its start as is sure to fit)
and the last HISTORY turns before the span, each as far as they fit in their budget, then has the span's turns. So no
window exceeds SPAN + HISTORY_TOKENS + SYSTEM_TOKENS, but for a single turn of more than SPAN, as turns aren't split.
The loss mask has the span's assistant texts only, so that a repeated target is never learnt twice.

Tokens are estimated from the characters and bytes of a turn as it is written: one for four characters of one byte,
one for each character of three.

Template of a turn: <|turn|>role newline text <|end|>. In roles and texts, &, < and [ are written &amp; &lt; and
&lbr; so that no control string of this or of another template can arise from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
START = "<|turn|>"
END = "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbr;"))
#: Tokens of a window: the span's, the history's, the repeated system turn's.
SPAN = 1024
HISTORY_TOKENS = 512
SYSTEM_TOKENS = 512
HISTORY = 2
TARGET_ROLE = "assistant"
#: A conversation that tests the escapes.
CHECK_TEXT = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def estimate(written: Column) -> Column:
    """Tokens of a written turn."""
    return F.ceil((2 * F.length(written) + 3 * (F.octet_length(written) - F.length(written))) / 8).cast("long")


def shortened(text: Column, tokens: int) -> Column:
    """A system turn with the start of its text, of no more than so many tokens: no character, escaped or of four
    bytes, is estimated at more than 11 / 8."""
    chars = max(0, (8 * tokens - 2 * len(f"{START}system\n{END}")) // 11)
    return F.concat(F.lit(f"{START}system\n"), escape(F.left(text, F.lit(chars))), F.lit(END))


def with_check(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) and the conversation -7."""
    spark = conversations.sparkSession
    rows = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHECK_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


def windows(conversations: DataFrame, span: int = SPAN, history_tokens: int = HISTORY_TOKENS, history: int = HISTORY, system_tokens: int = SYSTEM_TOKENS) -> DataFrame:
    """conversations (conv_id, turn, role, text) as training windows: conv_id, window (its number), formatted,
    repeated (how many of its turns are repeats, at its start), loss (array of start and length, in code points).

    Turns of a conversation are ordered by turn, role and text, nulls first; a null role or text counts as empty. A
    null conv_id is a conversation of its own. Repeated rows are turns like any others. An empty table gives none. A
    turn of any length is written whole, in a window of its own if it exceeds the span.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit("\n"))
    written = F.concat(F.col("head"), F.col("body"), F.lit(END))
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body")).withColumn("written", written)
    rows = rows.withColumn("tokens", estimate(F.col("written"))).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("again", F.when(F.col("role") == "system", F.when(F.col("tokens") <= system_tokens, F.col("written")).otherwise(shortened(F.col("text"), system_tokens))))
    up_to = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("after", up_to).withColumn("before", F.col("after") - F.col("tokens"))
    first_turn = F.first("again").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("first", first_turn).withColumn("system", F.when(F.col("place") > 1, F.col("first"))).drop("first", "again")
    # history: the turns just before, the nearest first, while they fit; the system turn is there already
    least = F.when(F.col("system").isNotNull(), 1).otherwise(0)
    past = [F.struct(F.lag("written", k).over(order).alias("written"), (F.col("place") - k).alias("place"), F.lag("before", k).over(order).alias("start")) for k in range(history, 0, -1)]
    rows = rows.withColumn("past", F.array(*past) if past else F.array().cast("array<struct<written:string,place:int,start:long>>"))
    fits = F.filter("past", lambda p: p["written"].isNotNull() & (p["place"] > F.col("least")) & (F.col("before") - p["start"] <= history_tokens))
    rows = rows.withColumn("least", least).withColumn("past", F.transform(fits, lambda p: p["written"]))
    # a span: turns within one stretch, or a turn that crosses the end of one
    stretch = F.floor(F.col("before") / span)
    crosses = F.floor((F.col("after") - 1) / span) > stretch
    rows = rows.withColumn("span", 2 * stretch + crosses.cast("long"))
    turn = F.struct("place", "head", "body", "written", (F.col("role") == TARGET_ROLE).alias("target"), "system", "past")
    made = rows.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    lead = F.concat(F.when(F.col("turns")[0]["system"].isNotNull(), F.array(F.col("turns")[0]["system"])).otherwise(F.array().cast("array<string>")), F.col("turns")[0]["past"])
    made = made.withColumn("lead", lead).withColumn("lead_text", F.array_join("lead", ""))
    # where each turn of the window starts: sums over its lengths
    lengths = F.transform("turns", lambda t: F.length(t["written"]).cast("long"))
    made = made.withColumn("starts", F.aggregate(lengths, F.array(F.length("lead_text").cast("long")), lambda a, n: F.array_append(a, F.element_at(a, -1) + n)))
    loss = F.filter(F.transform("turns", lambda t, i: F.struct(t["target"].alias("target"), (F.get("starts", i) + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length"))), lambda s: s["target"])
    return made.select(
        "conv_id", F.col("turns")[0]["place"].alias("window"), F.concat(F.col("lead_text"), F.array_join(F.transform("turns", lambda t: t["written"]), "")).alias("formatted"),
        F.size("lead").alias("repeated"), F.transform(loss, lambda s: F.struct(s["start"], s["length"])).alias("loss"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    pieces = F.split("formatted", r"<\|turn\|>", -1)
    fresh = F.slice(pieces, F.col("repeated") + 2, F.size(pieces))
    turns = F.transform(fresh, lambda p: F.substring_index(p, END, 1))
    texts = F.transform(turns, lambda p: F.concat(unescape(F.substring_index(p, "\n", 1)), F.lit("\n"), unescape(F.substr(p, F.instr(p, "\n") + 1)), F.lit("\n")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = made.select("conv_id", "window", F.size(turns).cast("long").alias("n"), F.array_join(texts, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("chars"))
    by_conv = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("all", lambda w: w[name]), "")
    return by_conv.select("conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars")
