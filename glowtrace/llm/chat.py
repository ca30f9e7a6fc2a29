"""Chat formatting in budgeted windows: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glowtrace.llm.common import word_count

#: Tokens of a window, tokens of repeated history in it, and tokens that a turn costs besides its words.
BUDGET, HISTORY, TURN_COST = 512, 128, 4
SYSTEM, TARGET = "system", "assistant"

#: A turn is ``<|role|>text</s>``. Control strings of this and of common templates are escaped inside texts: one more ``&``
#: after the bracket, so that escaping and unescaping are inverse whatever a text holds.
_PLAIN = r"([<\[])(&*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])&(&*)(\||/?s>|/?INST\])"
END = "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, "$1&$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    for plain, escaped in (("&", "&a"), ("|", "&p"), ("<", "&l")):
        role = F.replace(role, F.lit(plain), F.lit(escaped))
    return role


def unescape_role(role: Column) -> Column:
    for plain, escaped in (("<", "&l"), ("|", "&p"), ("&", "&a")):
        role = F.replace(role, F.lit(escaped), F.lit(plain))
    return role


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_repeated, n_tokens, formatted, loss) for turns (conv_id, turn, role, text).

    Prefix sums of the turns' tokens choose the windows: a window takes whole turns while the system turn, the repeated
    history and the new turns fit the budget; a turn too long for it has a window of its own. Each later window starts with
    the system turn, if the conversation starts with one, and as many whole earlier turns as fit the history's limit and
    leave room for its first new turn; these are ``n_repeated``. ``loss`` holds the spans (start, length), in code points, of
    the assistants' new texts; repeated ones are masked.

    Null role or text counts as empty. Turns go by turn, then role and text; a null turn comes first. A null conv_id is a
    conversation. Empty table: empty result. A conversation is one row, and so is each window.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def rendered(t: Column) -> Column:
        head = F.concat(F.lit("<|"), escape_role(t["role"]), F.lit("|>"))
        body = escape(t["text"])
        cost = word_count(t["text"]) + TURN_COST
        return F.struct(F.concat(head, body, F.lit(END)).alias("s"), F.length(head).alias("at"), F.length(body).alias("n"), (t["role"] == TARGET).alias("target"), cost.alias("cost"))

    convs = convs.withColumn("n_head", F.when(F.col("turns")[0]["role"] == SYSTEM, 1).otherwise(0)).withColumn("turns", F.transform("turns", rendered))
    convs = convs.select("conv_id", F.expr("slice(turns, 1, n_head)").alias("head"), F.expr("slice(turns, n_head + 1, size(turns))").alias("body"))
    # sums[i] is the cost of the turns before i.
    sums = F.aggregate("body", F.array(F.lit(0).cast("long")), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t["cost"])))
    head_cost = F.aggregate("head", F.lit(0).cast("long"), lambda acc, t: acc + t["cost"])
    convs = convs.withColumn("sums", sums).withColumn("head_cost", head_cost)

    def window(first: Column, start: Column, end: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), start.cast("int").alias("start"), end.cast("int").alias("end"))

    def step(acc: Column, i: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = F.col("head_cost") + F.get("sums", i + 1) - F.get("sums", last["first"]) <= budget
        room = F.least(F.lit(history), budget - F.col("head_cost") - (F.get("sums", i + 1) - F.get("sums", i)))
        first = F.least(i, F.size(F.filter("sums", lambda s: F.get("sums", i) - s > room)))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(window(last["first"], last["start"], i + 1)))
        return F.when(fits, longer).otherwise(F.concat(acc, F.array(window(first, i, i + 1))))

    least = F.least(F.lit(1), F.size("body"))
    spans = F.aggregate(F.expr("slice(sequence(0, size(body)), 2, size(body) - 1)"), F.array(window(F.lit(0), F.lit(0), least)), step)
    spans = F.when(F.size("body") > 1, spans).otherwise(F.array(window(F.lit(0), F.lit(0), least)))
    rows = convs.select("conv_id", "head", "body", "sums", "head_cost", F.posexplode(spans).alias("window", "span"))
    rows = rows.withColumn("n_repeated", F.when(F.col("window") > 0, F.size("head")).otherwise(0) + F.col("span.start") - F.col("span.first"))
    rows = rows.withColumn("turns", F.concat("head", F.slice("body", F.col("span.first") + 1, F.col("span.end") - F.col("span.first"))))

    place = F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def locate(acc: Column, t: Column) -> Column:
        span = F.array(F.struct((acc["at"] + t["at"]).cast("int").alias("start"), t["n"].cast("int").alias("length")))
        new = F.when(t["target"] & (acc["k"] >= F.col("n_repeated")), F.concat(acc["loss"], span)).otherwise(acc["loss"])
        return F.struct((acc["k"] + 1).alias("k"), (acc["at"] + F.length(t["s"])).alias("at"), new.alias("loss"))

    tokens = F.col("head_cost") + F.get("sums", F.col("span.end")) - F.get("sums", F.col("span.first"))
    formatted = F.array_join(F.transform("turns", lambda t: t["s"]), "")
    return rows.select("conv_id", "window", "n_repeated", tokens.alias("n_tokens"), formatted.alias("formatted"), F.aggregate("turns", place, locate, lambda acc: acc["loss"]).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from the formatted windows."""
    marked = F.expr("slice(split(formatted, '</s>', -1), n_repeated + 1, size(split(formatted, '</s>', -1)) - 1 - n_repeated)")

    def turn(s: Column) -> Column:
        stop = F.locate("|>", s)
        return F.concat(unescape_role(F.substring(s, F.lit(3), stop - 3)), F.lit("\n"), unescape(F.substring(s, stop + 2, F.length(s))), F.lit("\n"))

    masked = F.transform("loss", lambda p: unescape(F.substring(F.col("formatted"), p["start"] + 1, p["length"])))
    part = F.struct("window", F.array_join(F.transform(marked, turn), "").alias("turns"), F.size(marked).alias("n"), F.array_join(masked, "").alias("loss"), F.length("formatted").alias("chars"))
    convs = formatted.select("conv_id", part.alias("part")).groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    joined = lambda name: F.array_join(F.col(f"parts.{name}"), "")
    total = lambda name: F.aggregate(F.col(f"parts.{name}"), F.lit(0).cast("long"), lambda a, n: a + n)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return convs.select(
        "conv_id", total("n").alias("n_turns"), sha(joined("turns")).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"), sha(joined("loss")).alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )


def with_control_strings(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose two texts are control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), said.alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)
