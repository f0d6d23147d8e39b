"""Chat formatting: budgeted windows of turns with a loss mask.

A turn is written ``<s>[role] text</s>`` and a line break; ``&``, ``<``, ``[``
and ``]`` inside roles and texts become entities, so that no control string
can stand in a text and every text can be read back.  Tokens of a turn are
its words and ``MARKS`` for the marks.  Prefix sums of the tokens place every
turn: a window's ``budget`` less the system turn (a first turn of that role)
and at most ``history`` tokens of whole earlier turns is its room.  A turn of
more than half the room is long: it alone is new in a window of its own, and
prefixes start anew behind it.  The room less the longest other turn is the
stride, and the other turns whose prefix falls into the same stride are new in
the same window.  A window holds the system turn, the history and its new
turns, and stays within the budget unless a single turn does not fit.  Loss spans (code points) cover the text of
new assistant turns only: each target once, repeats are masked.

Defined results: null role and text are empty; turns are ordered by turn,
role, text, null turns first, repeated rows stay; rows without conv_id are one
conversation; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET, HISTORY, MARKS = 768, 128, 4
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;")]


def escape(c: Column) -> Column:
    for plain, coded in ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ENTITIES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, win, text, repeated, loss) of ``turns`` (conv_id, turn, role,
    text): ``repeated`` leading turns of ``text`` were new in an earlier
    window, ``loss`` holds (start, len) of the targets."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = (rows.withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + MARKS)
            .withColumn("pos", F.row_number().over(by).cast("long"))
            .withColumn("head", F.expr("pos = 1 and role = 'system'"))
            .withColumn("own", F.expr("if(head, 0, tokens)").cast("long"))
            .withColumn("before", F.sum("own").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own"))
            .withColumn("front", F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("] ")))
            .withColumn("body", escape(F.col("text"))))
    whole, upto = Window.partitionBy("conv_id"), by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("room", F.lit(budget - history) - F.max(F.expr("if(head, tokens, 0)")).over(whole))
    rows = (rows.withColumn("long", F.expr("not head and 2 * own > room"))
            .withColumn("longest", F.max(F.expr("if(long, 0, own)")).over(whole))
            .withColumn("section", 2 * F.sum(F.expr("int(long)")).over(upto) - F.expr("int(long)"))
            .withColumn("base", F.max(F.expr("if(long, before + own, 0)")).over(upto))
            .withColumn("step", F.expr("if(long, 0, (before - base) div greatest(1, room - longest))")))
    first = F.coalesce((F.col("section") != F.lag("section").over(by)) | (F.col("step") != F.lag("step").over(by)), F.lit(False))
    rows = rows.withColumn("opens", first.cast("long")).withColumn("win", F.sum("opens").over(upto))
    # the last window that starts within ``history`` tokens of a turn's place
    ahead = Window.partitionBy("conv_id").orderBy("before").rangeBetween(0, history)
    rows = rows.withColumn("last", F.max("win").over(ahead)).withColumn("turns", F.count("*").over(whole))
    new = rows.where("not head").withColumn("new", F.lit(1))
    old = (new.where("last > win").withColumn("win", F.explode(F.expr("sequence(win + 1, last)")))
           .withColumn("new", F.lit(0)))
    # a first turn of role system alone still makes a window
    starts = new.select("conv_id", "win").union(rows.where("head and turns = 1").select("conv_id", "win")).distinct()
    heads = rows.where("head").drop("win").alias("h")
    heads = (heads.join(starts.alias("s"), F.expr("h.conv_id <=> s.conv_id")).select("h.*", "s.win")
             .withColumn("new", (F.col("win") == F.min("win").over(whole)).cast("int")))
    columns = ["conv_id", "win", "pos", "new", "role", "front", "body"]
    placed = new.select(*columns).union(old.select(*columns)).union(heads.select(*columns))
    inside = Window.partitionBy("conv_id", "win").orderBy("pos")
    size = F.length("front") + F.length("body") + 5
    placed = placed.withColumn("at", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - size)
    loss = F.expr("if(new = 1 and role = 'assistant', struct(int(at + length(front)) as start, length(body) as len), null)")
    piece = F.concat("front", "body", F.lit("</s>\n"))
    return (placed.groupBy("conv_id", "win")
            .agg(F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece"), loss.alias("loss")))).alias("all"),
                 F.sum(1 - F.col("new")).alias("repeated"))
            .select("conv_id", "win", F.array_join(F.col("all.piece"), "").alias("text"), "repeated",
                    F.expr("filter(all.loss, x -> x is not null)").alias("loss")))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, win, at, role, text): the turns, each once, from the windows."""
    parts = F.split("text", r"<s>\[")
    own = formatted.select("conv_id", "win", "repeated", F.posexplode(parts).alias("at", "part")).where("at > repeated")
    role = F.substring_index("part", "]", 1)
    body = F.expr("substring(part, length(substring_index(part, ']', 1)) + 3)")
    return own.select("conv_id", "win", "at", unescape(role).alias("role"),
                      unescape(F.regexp_replace(body, "</s>\n$", "")).alias("text"))


def digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation with sums of what its windows say.  A row
    holds a conversation's whole text: its hash is asked for."""
    turns = read_back(formatted).groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sha2(F.array_join(F.expr("transform(sort_array(collect_list(struct(win, at, role, text))),"
                                   " x -> concat(x.role, '\n', x.text, '\n'))"), ""), 256).alias("turns_sha256"))
    target = unescape(F.expr("substring(text, span.start + 1, span.len)"))
    spans = (formatted.select("conv_id", "win", "text", F.explode("loss").alias("span"))
             .select("conv_id", "win", F.col("span.start").alias("start"), target.alias("target")))
    loss = spans.groupBy("conv_id").agg(
        F.array_join(F.expr("sort_array(collect_list(struct(win, start, target))).target"), "").alias("said"))
    size = formatted.groupBy("conv_id").agg(F.sum(F.length("text")).alias("formatted_chars"))
    same = "l.conv_id <=> r.conv_id"
    out = turns.alias("l").join(size.alias("r"), F.expr(same)).select("l.*", "r.formatted_chars")
    out = out.alias("l").join(loss.alias("r"), F.expr(same), "left")
    said = F.coalesce("r.said", F.lit(""))
    return out.select("l.conv_id", "n_turns", "turns_sha256", F.length(said).cast("long").alias("loss_chars"),
                      F.sha2(said, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
