"""Conversations as training windows under a token budget, in DataFrame functions only.

Prefix sums of turn tokens choose spans that begin and end with a turn: turns
with equal ``floor(tokens before it / stride)`` share a window, and a turn that
might not fit beside them begins one of its own. The stride is half of the
room, which is what the budget leaves beside the repeated turns: ``reserve``
tokens, or the leading system turn where that is longer. A window repeats the
system turn, then the last ``history`` turns before it, newest first, each as
far as it fits in what the window's own turns leave of the budget.

So no window exceeds the budget, but for one whose only turn of its own is
longer than the budget: a turn is never cut, and beside such a one repeated
turns take ``reserve`` tokens at most. A system turn longer than the budget
less ``reserve`` is alone in its window and repeated only where it fits.
Repeated turns are outside the loss mask, so each assistant text is a target
exactly once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|``; in roles a line feed
becomes ``<\\n`` too. :func:`read_back` reverses this exactly.

The sort behind the prefix sums streams and spills; what is gathered in one
row is one window, bounded by the budget and its longest turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def token_estimate(text: Column) -> Column:
    """Four bytes a token, and four tokens for the template."""
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4) + 4


def format_windows(conversations: DataFrame, budget: int = 2048, history: int = 2, reserve: int = 512, tokens=token_estimate) -> DataFrame:
    """conv_id, window, text, loss_spans, n_turns, n_repeated.

    ``loss_spans`` are code-point ranges of ``text``, end exclusive: the texts
    of assistant turns that are not repeated. The first ``n_repeated`` turns of
    ``text`` occur in an earlier window as well. ``reserve`` tokens of the
    budget are for repeated turns. Windows count from 0. Sizes are those that
    ``tokens`` gives for a turn's text.

    Turns are ordered by turn, nulls first; equal turns by role, then text, and
    repeated rows stay repeated turns. A null role or text is empty. Null
    conv_ids form one conversation. No rows give no windows. Extra columns are
    dropped.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    led = F.coalesce(F.col("system.size"), F.lit(0).cast("long"))
    room = budget - F.when(led > budget - reserve, F.lit(reserve)).otherwise(F.greatest(F.lit(reserve), led))
    stride = F.greatest(F.lit(1), F.floor(room / 2))
    follows = F.lag("leads").over(order) & (led > budget - reserve)
    begins = (F.col("span") != F.lag("span").over(order)) | (F.col("size") > room - stride) | follows
    placed = (
        turns.withColumn("n", F.row_number().over(order))
        .withColumn("leads", (F.col("n") == 1) & (F.col("role") == "system"))
        .withColumn("size", tokens(F.col("text")).cast("long"))
        .withColumn("system", F.first(F.when(F.col("leads"), F.struct("role", "text", "size"))).over(so_far))
        .withColumn("span", F.floor(F.coalesce(F.sum(F.when(F.col("leads"), 0).otherwise(F.col("size"))).over(before), F.lit(0)) / stride).cast("long"))
        .withColumn("begins", F.when((F.col("n") > 1) & begins, 1).otherwise(0))
        .withColumn("window", F.sum("begins").over(so_far))
        .withColumn("later", F.array_distinct(F.array(*(F.coalesce(F.lead("window", k).over(order), F.col("window")) for k in range(1, history + 1)), F.col("window"))))
    )
    shown = F.when(F.col("leads"), F.array("window")).otherwise(F.col("later"))
    rows = placed.withColumn("own", F.col("window")).withColumn("window", F.explode(shown))
    item = F.struct("n", (F.col("own") == F.col("window")).alias("fresh"), "role", "text", "size")
    gathered = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(item)).alias("items"), F.first("system").alias("system"))
    again = F.array(F.struct(F.lit(0).alias("n"), F.lit(False).alias("fresh"), F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.col("system.size").alias("size")))
    gathered = gathered.withColumn("items", F.when(F.col("system").isNotNull() & (F.col("window") > 0), F.concat(again, F.col("items"))).otherwise(F.col("items")))
    own = F.aggregate(F.filter("items", lambda x: x["fresh"]), F.lit(0).cast("long"), lambda total, x: total + x["size"])
    left = F.when(own <= budget, budget - own).otherwise(F.lit(reserve)).cast("long")
    repeated = F.filter("items", lambda x: ~x["fresh"])
    newest_first = F.concat(F.filter(repeated, lambda x: x["n"] == 0), F.reverse(F.filter(repeated, lambda x: x["n"] > 0)))
    take = lambda at, x: F.struct(
        F.when(x["size"] <= at["left"], at["left"] - x["size"]).otherwise(at["left"]).alias("left"),
        F.when(x["size"] <= at["left"], F.concat(at["kept"], F.array(x["n"]))).otherwise(at["kept"]).alias("kept"),
    )
    gathered = gathered.withColumn("kept", F.aggregate(newest_first, F.struct(left.alias("left"), F.array().cast("array<int>").alias("kept")), take)["kept"])
    items = F.filter("items", lambda x: x["fresh"] | F.array_contains("kept", x["n"]))
    head = lambda x: F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"))
    pieces = F.transform(F.col("items"), lambda x: F.struct(x["fresh"].alias("fresh"), (x["role"] == "assistant").alias("target"), head(x).alias("head"), escape(x["text"]).alias("body")))
    tail = END + "\n"
    step = lambda at, x: F.struct(
        (at["at"] + F.length(x["head"]) + F.length(x["body"]) + len(tail)).alias("at"),
        F.when(x["fresh"] & x["target"], F.concat(at["spans"], F.array(F.struct((at["at"] + F.length(x["head"])).alias("start"), (at["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"))))).otherwise(at["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return (
        gathered.withColumn("items", items)
        .withColumn("pieces", pieces)
        .select(
            "conv_id",
            "window",
            F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "").alias("text"),
            F.aggregate("pieces", zero, step)["spans"].alias("loss_spans"),
            F.size("pieces").alias("n_turns"),
            F.size(F.filter("pieces", lambda x: ~x["fresh"])).alias("n_repeated"),
        )
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text; repeated ones left out), targets (texts under the loss mask), n_chars.

    Reads only what :func:`format_windows` wrote.
    """
    blocks = F.slice(F.split("text", r"<\|im_start\|>"), F.lit(2) + F.col("n_repeated"), F.greatest(F.col("n_turns") - F.col("n_repeated"), F.lit(0)))
    cut = len(END) + 1
    turn = lambda b: F.struct(
        unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substring(b, F.instr(b, F.lit("\n")) + 1, F.length(b) - F.instr(b, F.lit("\n")) - cut)).alias("text"),
    )
    return windows.select(
        "conv_id",
        "window",
        F.transform(blocks, turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))).alias("targets"),
        F.length("text").alias("n_chars"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """One row a conversation over rows of :func:`read_back`; a conversation's digest needs its whole text in one row."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        turns.select("conv_id", "window", F.size("turns").alias("n"), lines.alias("lines"), F.array_join("targets", "").alias("loss"), "n_chars")
        .groupBy("conv_id")
        .agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "lines", "loss"))).alias("all"), F.sum("n_chars").cast("long").alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            F.sha2(F.array_join("all.lines", ""), 256).alias("turns_sha256"),
            F.length(F.array_join("all.loss", "")).cast("long").alias("loss_chars"),
            F.sha2(F.array_join("all.loss", ""), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


DIGEST_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM turns
), sized AS (
  SELECT *, n = 1 AND role = 'system' AS leads,
    CASE WHEN n = 1 AND role = 'system' THEN 0 ELSE (strlen(text) + 3) // 4 + 4 END AS size,
    12 + length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) + 1 + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + 10 + 1 AS chars
  FROM numbered
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 768 AS w FROM sized
), ahead AS (
  SELECT *, lead(w, 1, w) OVER o AS w1, lead(w, 2, w) OVER o AS w2 FROM placed WINDOW o AS (PARTITION BY conv_id ORDER BY n)
), repeats AS (
  SELECT conv_id, sum(chars * (1 + CASE WHEN leads THEN 0 ELSE (w1 <> w)::INT + (w2 <> w AND w2 <> w1)::INT END)) AS chars,
    coalesce(max(CASE WHEN leads THEN chars END), 0) * (count(DISTINCT w) - 1) AS system_chars
  FROM ahead GROUP BY conv_id
)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (any_value(r.chars) + any_value(r.system_chars))::BIGINT AS formatted_chars
FROM numbered t JOIN repeats r ON t.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY t.conv_id
"""
