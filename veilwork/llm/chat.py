"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

Format (fixed values): a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.
Inside texts and roles a backslash goes before every backslash, before the bar of
``<|``, before ``/`` or ``s`` behind ``<``, and between ``[`` and ``INST]`` or
``/INST]``; dropping each backslash that stands before a character restores them.
Line breaks in roles are written ``\\n`` with a control picture, see ``_role``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.llm.common import words

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that the marks of one turn count for.
TURN_TOKENS = 4
_FAR = -(1 << 60)


def escape(text: Column) -> Column:
    """No control string is left in the result, whatever the text holds."""
    return F.regexp_replace(
        text, r"(\\|(?<=<)[|/s]|(?<=\[)(?=/?INST\]))", r"\\$1"
    )


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    """Roles end at the first line break, so their own become U+2424, and that is doubled."""
    return escape(F.replace(F.replace(role, F.lit("␤"), F.lit("␤.")), F.lit("\n"), F.lit("␤n")))


def _plain_role(role: Column) -> Column:
    plain = unescape(role)
    return F.replace(F.replace(plain, F.lit("␤n"), F.lit("\n")), F.lit("␤."), F.lit("␤"))


def plan_windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Deal the turns of each conversation into windows.

    ``turns``: conv_id, turn, role, text.  The prefix sum of tokens before a
    turn places it on a grid of cells of the room that a window has for new
    turns (``budget`` less ``history`` and the system turn).  The turns that lie
    whole in a cell make a window; one that crosses into the next cell goes with
    the turns of that cell if all fit, else alone.  So no window is over its
    budget but one that holds a single longer turn, and none needs the one
    before it to be known.  Each window also gets the system turn and the turns
    that begin in the ``history`` tokens before it.
    """
    conv = Window.partitionBy("c")
    ordered = conv.orderBy("turn", "role", "text")
    t = turns.select(
        F.col("conv_id").alias("c"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    t = t.withColumn("i", F.row_number().over(ordered))
    t = t.withColumn("sys", (F.col("i") == 1) & (F.col("role") == "system"))
    t = t.withColumn("tok", F.size(words(F.col("text"))).cast("long") + TURN_TOKENS)
    run = conv.orderBy("i")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("sys_tok", F.first(F.when(F.col("sys"), F.col("tok")).otherwise(0)).over(run))
    t = t.withColumn(
        "pre",
        F.when(F.col("sys"), F.lit(_FAR)).otherwise(
            F.coalesce(F.sum("tok").over(before), F.lit(0)) - F.col("sys_tok")
        ),
    )
    room = F.greatest(F.lit(budget - history) - F.col("sys_tok"), F.lit(max(1, budget // 4)).cast("long"))
    t = t.withColumn("room", room)
    cell = F.expr("pre div room")
    crosses = (F.col("pre") + F.col("tok") > (F.col("cell") + 1) * F.col("room")).cast("long")
    t = t.withColumn("cell", cell)
    t = t.withColumn("unit", F.when(F.col("sys"), F.lit(-1).cast("long")).otherwise(2 * F.col("cell") + crosses))
    t = t.withColumn("last_unit", F.lag("unit").over(run)).withColumn("last_tok", F.lag("tok").over(run))
    unit = Window.partitionBy("c", "unit")
    first = unit.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("total", F.sum("tok").over(unit))
        .withColumn("came", F.first("last_unit").over(first))
        .withColumn("came_tok", F.first("last_tok").over(first))
    )
    joins = (
        (F.col("unit") >= 0) & (F.col("unit") % 2 == 0) & (F.col("came") % 2 == 1)
        & (F.col("came") >= 0) & (F.col("came_tok") + F.col("total") <= F.col("room"))
    )
    t = t.withColumn("unit", F.when(F.coalesce(joins, F.lit(False)), F.col("came")).otherwise(F.col("unit")))
    has_sys = (F.col("sys_tok") > 0).cast("int")
    rank = F.dense_rank().over(conv.orderBy("unit")) - 1 - has_sys
    t = t.withColumn("window", F.greatest(rank, F.lit(0)))
    block = F.struct("i", "role", "text")
    opens = F.coalesce(F.col("window") != F.lag("window").over(run), F.lit(False))
    t = t.withColumn("opens", opens)
    near = conv.orderBy("pre").rangeBetween(-history, -1)
    system = F.first(F.when(F.col("sys"), block)).over(run)
    t = (
        t.withColumn("block", block)
        .withColumn("back", F.collect_list("block").over(near))
        .withColumn("head", F.when(F.col("opens"), system))
    )
    repeated = F.when(
        F.col("opens"),
        F.concat(
            F.when(F.col("head").isNull(), F.array().cast(t.select(F.array("block")).schema[0].dataType))
            .otherwise(F.array("head")),
            F.col("back"),
        ),
    )
    t = t.withColumn("repeated", repeated)
    return t.groupBy("c", "window").agg(
        F.array_sort(F.collect_list("block")).alias("new"),
        F.first("repeated", ignorenulls=True).alias("old"),
    )


def format_chat(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss (spans of code points), n_repeated.

    ``loss`` covers the texts of assistant turns that are new in the window;
    repeated ones are masked.  Null roles and texts count as empty.  Turns come
    in the order of turn, role, text (null turns first), repeated rows are turns
    of their own; rows of a null conv_id make one conversation.  An empty table
    gives no window.  Other columns are not read.
    """
    w = plan_windows(turns, budget, history)
    shown = lambda b: F.concat(
        F.lit(START), _role(b["role"]), F.lit("\n"), escape(b["text"]), F.lit(END)
    )
    old = F.coalesce(F.col("old"), F.slice("new", 1, 0))
    w = w.select("c", "window", F.size(old).alias("n_repeated"), F.concat(old, F.col("new")).alias("blocks"))
    w = w.select(
        "c", "window", "n_repeated",
        F.explode(F.array(F.transform(
            "blocks",
            lambda b: F.struct(
                shown(b).alias("s"), F.length(_role(b["role"])).alias("r"),
                (b["role"] == "assistant").alias("a"),
            ),
        ))).alias("shown"),
    )
    lead, tail = len(START) + 1, len(END)
    at = F.aggregate(
        "shown",
        F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"),
                 F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, b: F.struct(
            (acc["p"] + F.length(b["s"])).alias("p"),
            (acc["n"] + 1).alias("n"),
            F.when(
                b["a"] & (acc["n"] >= F.col("n_repeated")),
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["p"] + lead + b["r"]).alias("start"),
                    (acc["p"] + F.length(b["s"]) - tail).alias("end"),
                ))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    return w.select(
        F.col("c").alias("conv_id"), "window", "n_repeated",
        F.array_join(F.transform("shown", lambda b: b["s"]), "").alias("formatted"),
        at.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The turns and the text under the mask, per conversation, from formatted windows alone."""
    blocks = F.split("formatted", r"<\|im_end\|>\n", -1)
    w = windows.select("*", F.explode(F.array(blocks)).alias("b"))
    new = F.slice("b", F.col("n_repeated") + 1, F.size("b") - 1 - F.col("n_repeated"))

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(len(START) + 1), F.length(x))
        cut_at = F.locate("\n", body)
        role = F.substring(body, F.lit(1), cut_at - 1)
        text = F.substring(body, cut_at + 1, F.length(body))
        return F.concat(_plain_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    w = w.select(
        "conv_id", "window", F.size(new).cast("long").alias("n"),
        F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform(new, turn), "").alias("turns"),
        F.array_join(
            F.transform("loss", lambda s: unescape(
                F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))),
            "",
        ).alias("under"),
    )
    parts = F.array_sort(F.collect_list(F.struct("window", "turns", "under")))
    per = w.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), parts.alias("p")
    )
    joined = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    per = per.select("conv_id", "n_turns", "formatted_chars", joined("turns").alias("t"), joined("under").alias("u"))
    return per.select(
        "conv_id", "n_turns", F.sha2(F.col("t"), 256).alias("turns_sha256"),
        F.length("u").cast("long").alias("loss_chars"), F.sha2(F.col("u"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
