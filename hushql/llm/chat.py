"""Chat formatting in budgeted windows, in built-in expressions only.

Prefix sums of turn tokens choose spans of whole turns: a conversation's tokens are cut into cells of what the budget leaves
beside the system turn and the history. Turns inside a cell are one window, a turn across the end of a cell joins the
cell's window if it fits and is a window of its own if not. So a window holds its new turns, the system turn and
at most HISTORY tokens of the turns before it within the budget, unless one turn alone is larger than that leaves. Repeated
turns are context: only new assistant turns are under the loss mask, so each is a target once.

Template: ``### role``, a line end, the text, a line end, ``</turn>``, a line end. Backslash, ``#`` and ``<`` in texts and roles carry
a backslash (line ends in roles are written as backslash and n), so no text can make a control string and all reads back.

Null texts and roles count as empty. Turns go by turn, role and text, nulls first; repeated rows are turns of their own.
A null conv_id is one conversation. Roles are compared as they are; only the first turn can be the system turn.
Prefix sums are taken within blocks of turns and blocks within conversations, so a hot conversation is dealt out too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY = 256
#: Values of turn whose sums one task takes.
BLOCK = 1024
#: Code points of the template around a role and a text.
TEMPLATE = 14


def escaped(column: str) -> Column:
    return F.expr(rf"regexp_replace({column}, '([\\\\#<])', '\\\\$1')")


def escaped_role(column: str) -> Column:
    return F.replace(escaped(column), F.lit("\n"), F.lit("\\n"))


def unescaped(sql: str) -> str:
    return rf"regexp_replace({sql}, '\\\\([\\\\#<])', '$1')"


def unescaped_role(sql: str) -> str:
    # Line ends first need the doubled backslashes out of the way.
    return rf"array_join(transform(split({sql}, '\\\\\\\\', -1), p -> regexp_replace(replace(p, '\\n', '\n'), '\\\\([#<])', '$1')), '\\')"


def tokens() -> Column:
    """Estimated tokens of a turn: a quarter of the code points that it has when it is formatted."""
    return F.ceil((F.length(escaped("text")) + F.length(escaped_role("role")) + TEMPLATE) / 4).cast("long")


def placed(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, size: Column | None = None) -> DataFrame:
    """Turns with seq, their tokens, their window and their part: new, history or system."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *([] if size is None else [size.cast("long").alias("tokens")]))
    if size is None:
        rows = rows.withColumn("tokens", tokens())
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("own_seq", F.row_number().over(inside) - 1).withColumn("own_before", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    system_here = F.first(F.when((F.col("own_seq") == 0) & (F.col("role") == "system"), F.col("tokens")), ignorenulls=True)
    sums = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t_"), F.count("*").alias("n_"), system_here.alias("s_"))
    whole = Window.partitionBy("conv_id").orderBy("block")
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    # The first block's first turn alone can be the system turn.
    system = F.coalesce(F.first("s_").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("c_"), F.col("block").alias("b_"), F.coalesce(F.sum("t_").over(earlier), F.lit(0)).alias("t0_"), F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("n0_"), system.alias("system"))
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c_")) & F.col("block").eqNullSafe(F.col("b_")))
    # What is left for new turns, and for repeated ones: a window's share is at least as large as its history.
    left = F.greatest(F.lit(budget) - F.col("system"), F.lit(2))
    rows = rows.withColumn("past", F.least(F.lit(history), F.floor(left / 2))).withColumn("room", left - F.col("past"))
    rows = rows.select("conv_id", "role", "text", "tokens", "past", "room", (F.col("n0_") + F.col("own_seq")).alias("seq"), (F.col("t0_") + F.col("own_before")).alias("before"))
    rows = rows.withColumn("cell", F.floor(F.col("before") / F.col("room"))).withColumn("across", F.floor((F.col("before") + F.col("tokens") - 1) / F.col("room")) > F.col("cell"))
    # A turn across the end of a cell is its last; what stands in the cell before it is known from the cell's sums.
    cells = rows.groupBy("conv_id", "cell").agg(F.sum("tokens").alias("t_")).select(F.col("conv_id").alias("c_"), F.col("cell").alias("k_"), "t_")
    rows = rows.join(cells, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("cell") == F.col("k_")))
    rows = rows.withColumn("window", 2 * F.col("cell") + (F.col("across") & (F.col("t_") > F.col("room"))).cast("int"))
    # Where each window begins, and where the three after it do: a turn can be history in those alone.
    begins = rows.groupBy("conv_id", "window").agg(F.min("before").alias("begin"))
    order = Window.partitionBy("conv_id").orderBy("window")
    lead = lambda c, k: F.lead(c, k).over(order)
    begins = begins.select(F.col("conv_id").alias("c_"), F.col("window").alias("w_"), *[lead(c, k).alias(f"{c}{k}") for c in ("window", "begin") for k in (1, 2, 3)])
    rows = rows.drop("c_", "k_", "t_").join(begins, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("window") == F.col("w_")))
    later = [F.when((F.col(f"begin{k}") - F.col("before") <= F.col("past")) & ~((F.col("seq") == 0) & (F.col("role") == "system")), F.struct(F.col(f"window{k}").alias("window"), F.lit("history").alias("part"))) for k in (1, 2, 3)]
    places = F.filter(F.array(F.struct("window", F.lit("new").alias("part")), *later), lambda x: x.isNotNull())
    shown = ("conv_id", "seq", "role", "text", "tokens")
    own = rows.select(*shown, F.explode(places).alias("p_")).select(*shown, "p_.window", "p_.part")
    system = rows.where("seq = 0 and role = 'system'").select(F.col("conv_id").alias("s_"), *shown[1:])
    again = begins.where("window1 is not null").select("c_", F.col("window1").alias("window")).join(system, F.col("c_").eqNullSafe(F.col("s_")))
    return own.union(again.select(F.col("c_"), *shown[1:], "window", F.lit("system")))


def formatted(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, size: Column | None = None) -> DataFrame:
    """conv_id, window, text, loss (array of struct(start, size) in code points) and context (leading repeated turns).

    ``size`` gives a turn's tokens where a tokenizer has counted them; else they are estimated.
    """
    rows = placed(turns, budget, history, size)
    body = escaped("text")
    rows = rows.withColumn("head_", F.concat(F.lit("### "), escaped_role("role"), F.lit("\n"))).withColumn("body_", body)
    gathered = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("part"), "role", "head_", "body_"))).alias("turns_"))
    piece = "concat(t.head_, t.body_, '\n</turn>\n')"
    walk = """aggregate(turns_, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,size:int>>)),
        (a, t) -> named_struct('at', a.at + length(t.head_) + length(t.body_) + 9, 'out',
            if(t.part = 'new' and t.role = 'assistant', concat(a.out, array(named_struct('start', a.at + length(t.head_), 'size', length(t.body_)))), a.out)), a -> a.out)"""
    return gathered.select("conv_id", "window", F.expr(f"array_join(transform(turns_, t -> {piece}), '')").alias("text"), F.expr(walk).alias("loss"), F.expr("size(filter(turns_, t -> t.part <> 'new'))").alias("context"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from formatted windows alone.

    A digest is of a whole conversation, so here, and here alone, its windows are gathered in one row, once each.
    """
    pieces = "slice(split(text, '\n</turn>\n', -1), context + 1, size(split(text, '\n</turn>\n', -1)) - 1 - context)"
    head = "substring_index(p, '\n', 1)"
    role = unescaped_role(f"substring({head}, 5)")
    content = unescaped(f"substring(p, length({head}) + 2)")
    rows = windows.select(
        "conv_id", "window", F.length("text").alias("chars"), F.expr(f"transform({pieces}, p -> concat({role}, '\n', {content}, '\n'))").alias("turns_"),
        F.expr(f"array_join(transform(loss, l -> {unescaped('substring(text, l.start + 1, l.size)')}), '')").alias("loss_"),
    )
    rows = rows.select("conv_id", "window", "chars", F.size("turns_").alias("n"), F.array_join("turns_", "").alias("turns_"), "loss_")
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "turns_", "loss_"))).alias("w_"))
    text = lambda c: F.expr(f"array_join(transform(w_, w -> w.{c}), '')")
    return whole.select("conv_id", "n_turns", F.sha2(text("turns_").cast("binary"), 256).alias("turns_sha256"), F.length(text("loss_")).cast("long").alias("loss_chars"), F.sha2(text("loss_").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
