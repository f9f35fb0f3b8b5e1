"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered anew: that participant's turns are the
assistant's, all others' are a user's named after them, and system turns stay. The loss mask covers the contents and end marks of
the assistant's turns. A participant is a distinct role other than ``system``.

A rendered dialogue is a sequence of segments, one row each (conv_id, perspective, place): ``rendered`` holds header,
content and end mark; ``start`` is its place in the dialogue in code points; ``mask_start`` and ``mask_end`` the masked
stretch (both 0 where none). So a conversation of any length is never gathered: places and starts
are running sums taken in two steps, within buckets of turns and over buckets. ``dialogues`` joins the segments for those
who want one string.

Distinct roles have distinct names: letters of ASCII, digits, `_` and `-` stay, any other character becomes the percent codes of
its UTF-8 bytes, and a null role is named `?`. A text cannot forge a mark: a backslash is put between `<` and `|` of
each `<|` in it (and one more where backslashes stand there already, so it can be undone: see ``plain``).

Order: by turn, then name, then text; equal rows are segments each, in a row. Defined results: a null conversation
or turn is a value like others (first); a null text is empty; texts of any length are rendered whole; an empty table gives
an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafmill.llm.common import materialize

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
#: Turns in a bucket.
BUCKET = 1024


def _names(role: str = "role") -> Column:
    coded = F.url_encode(F.col(role))
    for mark, code in (("+", "%20"), ("*", "%2A"), (".", "%2E")):  # what the function leaves or shortens
        coded = F.replace(coded, F.lit(mark), F.lit(code))
    return F.coalesce(coded, F.lit("?"))


def safe(text: Column) -> Column:
    """Text in which no mark can begin."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def plain(text: Column) -> Column:
    """What ``safe`` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def rotate(conversations: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """conv_id, perspective, place, turn, speaker, rendered, start, mask_start, mask_end.

    Turns are put in order once, with their texts; places and starts of all perspectives come from lengths alone, and meet the texts last.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    at = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / bucket).cast("long").alias("bucket")
    turns = conversations.select(long("conv_id"), long("turn"), _names().alias("role"), safe(F.coalesce(F.col("text"), F.lit(""))).alias("text")).select("*", at)
    order = Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text")
    ordered = materialize(turns.withColumns({"k": F.row_number().over(order), "size": F.length("text")}), "turns")
    # combined before the shuffle: a row for each conversation and role
    cast = ordered.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    same = F.col("t.conv_id").eqNullSafe(F.col("c.conv_id"))
    each = ordered.alias("t").join(cast.alias("c"), same).select("t.conv_id", "c.perspective", "t.bucket", "t.k", "t.role", "t.size")
    each = each.withColumn("n", F.length(_opening()).cast("long") + F.col("size") + len(TAIL))
    sums = each.groupBy("conv_id", "perspective", "bucket").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "perspective", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k_before"))
    inner = Window.partitionBy("conv_id", "perspective", "bucket").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("in_bucket", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    on = F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("p.perspective") == F.col("s.perspective")) & (F.col("p.bucket") == F.col("s.bucket"))
    spots = placed.alias("p").join(sums.alias("s"), on).select("p.conv_id", "p.perspective", "p.bucket", "p.k", (F.col("k_before") + F.col("p.k") - 1).cast("long").alias("place"), (F.col("n_before") + F.col("in_bucket")).cast("long").alias("start"))
    here = F.col("x.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("x.bucket") == F.col("o.bucket")) & (F.col("x.k") == F.col("o.k"))
    out = spots.alias("x").join(ordered.alias("o"), here).select("x.conv_id", "x.perspective", "x.place", "o.turn", "o.role", "o.text", "x.start")
    own, opening = F.col("role") == F.col("perspective"), _opening()
    from_, to = F.col("start") + F.length(opening), F.col("start") + F.length(opening) + F.length("text") + len(TAIL) - 1
    return out.select(
        "conv_id",
        "perspective",
        "place",
        "turn",
        F.col("role").alias("speaker"),
        F.concat(opening, F.col("text"), F.lit(TAIL)).alias("rendered"),
        "start",
        F.when(own, from_).otherwise(F.lit(0)).cast("long").alias("mask_start"),
        F.when(own, to).otherwise(F.lit(0)).cast("long").alias("mask_end"),
    )


def _opening() -> Column:
    """What stands before a turn's text, of ``role`` and ``perspective``."""
    role = F.col("role")
    header = F.when(role == F.col("perspective"), F.lit("assistant")).when(role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(HEAD), header, F.lit(MIDDLE))


def dialogues(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, rendered, masks: whole dialogues, for conversations that fit into a row."""
    rows = F.array_sort(F.collect_list(F.struct("place", "rendered", "mask_start", "mask_end")))
    grouped = segments.groupBy("conv_id", "perspective").agg(rows.alias("rows"))
    masks = F.expr("transform(filter(rows, x -> x.mask_end > 0), x -> struct(x.mask_start as start, x.mask_end as end))")
    return grouped.select("conv_id", "perspective", F.array_join("rows.rendered", "").alias("rendered"), masks.alias("masks"))
