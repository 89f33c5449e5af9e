"""Chat formatting into windows of a token budget, with a loss mask. DataFrame operations only.

A conversation's turns get prefix sums of their tokens. What each window repeats is charged to the budget: the system
turn is taken off first, then a share is kept for history. Turns that lie within one interval of the sums, as wide as
what is left, form a span; a turn across a boundary is a span of its own. Each window is a span, with the conversation's
system turn and as many of the last earlier turns before it as the budget still has room for, up to a limit. So no
window is above the budget unless the system turn and a single new turn are, which then have no history. Only the assistant texts of the span
itself are under the loss mask, repeated ones are not.

Tokens are counted from above: a written turn has at most as many byte-level tokens as UTF-8 bytes.

A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`. In roles and texts `&` becomes `&amp;` and `<|` becomes
`&lt;|`, in roles a line feed becomes `&#10;`; so the marks appear nowhere else, and all of it is undone on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET = 4096
#: Earlier turns that a window repeats, at most.
HISTORY = 2
#: Share of the budget, after the system turn, that new turns may take.
NEW_SHARE = 0.75
#: Bytes that the marks of a turn take.
MARKS = len(START) + 1 + len(END)


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def rendered(t: Column) -> Column:
    """The written form of a turn, a struct (role, text)."""
    return F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"), escaped(t["text"]), F.lit(END))


def token_count(t: Column) -> Column:
    """Tokens of a written turn, at most: its bytes."""
    return F.octet_length(rendered(t)).cast("long")


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_repeated, n_new, formatted, loss): loss are structs (start, length), 1-based characters of formatted.

    rows: conv_id, turn, role, text. Null roles and texts count as empty; a null conv_id is a conversation of its own.
    Rows of a conversation are taken by turn, then role and text; repeated rows are repeated turns.
    """
    turn = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = rows.select("conv_id", "turn", turn.alias("t"))
    t = t.select("conv_id", "turn", F.struct("t.role", "t.text", token_count(F.col("t")).alias("tokens")).alias("t"))
    w = Window.partitionBy("conv_id").orderBy("turn", "t.role", "t.text")
    t = t.select(
        "conv_id", "t", F.row_number().over(w).alias("at"), F.sum("t.tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        (F.collect_list("t").over(w.rowsBetween(-history, -1)) if history else F.array().cast("array<struct<role:string,text:string,tokens:bigint>>")).alias("before"),
        F.first("t").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("opening"),
    )
    system = F.when(F.col("opening.role") == "system", F.col("opening.tokens")).otherwise(0)
    wide = F.greatest(F.lit(1), F.floor((budget - system) * NEW_SHARE))
    first, last = F.floor((F.col("upto") - F.col("t.tokens")) / wide), F.floor((F.col("upto") - 1) / wide)
    # two spans for each interval: the turns within it, and the turn that leaves it
    t = t.withColumn("span", 2 * first + (first != last).cast("int"))
    of = Window.partitionBy("conv_id", "span")
    t = t.select("*", (F.col("at") == F.min("at").over(of)).alias("begins"), (budget - F.sum("t.tokens").over(of)).alias("room"))
    # what comes again before a span: the system turn that opens the conversation, and the last turns before, while they fit
    opens = (system > 0) & (F.col("at") > 1)
    earlier = F.when(opens & (F.col("at") <= history + 1), F.slice("before", 2, max(history, 1))).otherwise(F.col("before"))
    start = F.struct((F.col("room") - F.when(opens, system).otherwise(0)).alias("room"), F.array().cast("array<struct<role:string,text:string,tokens:bigint>>").alias("held"))
    fits = lambda acc, x: F.when(
        x["tokens"] <= acc["room"], F.struct((acc["room"] - x["tokens"]).alias("room"), F.concat(F.array(x), acc["held"]).alias("held"))
    ).otherwise(F.struct(F.lit(-1).cast("long").alias("room"), acc["held"].alias("held")))
    held = F.aggregate(F.reverse(earlier), start, fits, lambda acc: acc["held"])
    begins = F.col("begins")
    again = F.when(opens, F.concat(F.array("opening"), held)).otherwise(held)
    t = t.select("conv_id", "span", "at", "t", F.when(begins, again).alias("again"))
    g = t.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("new"), F.first("again", ignorenulls=True).alias("again"))
    pieces = F.concat(F.transform("again", lambda x: F.struct(rendered(x).alias("s"), F.lit(0).alias("skip"), F.lit(0).alias("size"))), F.transform("new", lambda x: _piece(x["t"])))
    g = g.select("conv_id", F.col("span").alias("window"), F.size("again").alias("n_repeated"), F.size("new").alias("n_new"), pieces.alias("pieces"))
    start = F.struct(F.lit(1).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    mask = F.aggregate(
        "pieces", start,
        lambda acc, p: F.struct((acc["at"] + F.length(p["s"])).alias("at"), F.when(p["skip"] > 0, F.concat(acc["loss"], F.array(F.struct((acc["at"] + p["skip"]).alias("start"), p["size"].alias("length"))))).otherwise(acc["loss"]).alias("loss")),
        lambda acc: acc["loss"],
    )
    return g.select("conv_id", "window", "n_repeated", "n_new", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), mask.alias("loss"))


def _piece(t: Column) -> Column:
    """(s, skip, size): the written turn, and of an assistant's how many characters stand before its text and in it."""
    s = rendered(t)
    learned = t["role"] == "assistant"
    size = F.length(escaped(t["text"]))
    skip = F.length(s) - size - len(END)
    return F.struct(s.alias("s"), F.when(learned, skip).otherwise(0).alias("skip"), F.when(learned, size).otherwise(0).alias("size"))


def read_turns(formatted: Column) -> Column:
    """Structs (role, text) of a window, read back from its text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    role = lambda x: unescaped(F.replace(F.substring_index(x, "\n", 1), F.lit("&#10;"), F.lit("\n")))
    body = lambda x: unescaped(F.substr(x, F.locate("\n", x) + 1, F.length(x) - F.locate("\n", x) - len(END)))
    return F.transform(parts, lambda x: F.struct(role(x).alias("role"), body(x).alias("text")))


def report(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per conversation, all of it read back from the windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    w = windows(rows, budget, history)
    new = F.slice(read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_new"))
    turns = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"], s["length"]))), "")
    w = w.select("conv_id", "window", F.size(new).cast("long").alias("n"), turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    g = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    whole = lambda c: F.array_join(F.transform("all", lambda x: x[c]), "")
    return g.select(
        "conv_id", "n_turns", F.sha2(whole("turns"), 256).alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
