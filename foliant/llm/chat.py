"""Operator 10: relational chat formatting, with Spark expressions only.

Turns are collected as structs in two steps, first by (conversation, stretch of turn numbers), then by
conversation, so that a long conversation is pre-aggregated before it meets in one row. Collected structs are sorted;
each is marked as opening a run or going on with its neighbour's role, and the marked turns are joined into one text by array functions.

Template: <|im_start|>role NEWLINE text <|im_sep|> text ... <|im_end|> NEWLINE. Inside roles and texts "&" becomes "&amp;"
and "<|" becomes "&lt;|" (in roles also a line break "&nl;"), so no control string can occur there and
the escape is undone exactly. read_back() parses the formatted string alone.

Rows come in order of turn, then role, then text (nulls first); null roles and texts count as empty; repeated rows are
turns like others; a null conv_id is a conversation of its own. A conversation is one row of output, as any chat format
needs; its size is bounded by Spark's 2 GB a string. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Turns a stretch of the first step holds.
STRETCH = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&nl;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def conversations_as_text(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: one row for each conversation."""
    clean = turns.select(
        "conv_id", "turn", F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&nl;")).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("text"), F.floor(F.col("turn") / STRETCH).alias("stretch"),
    )
    stretches = clean.groupBy("conv_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = stretches.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "turns"))), lambda x: x["turns"])).alias("turns"))
    numbered = F.transform("turns", lambda x, i: F.struct(x["role"].alias("role"), x["text"].alias("text"), ((i == 0) | (F.get(F.col("turns"), i - 1)["role"] != x["role"])).alias("opens")))
    # A turn that opens a run writes the header, and the end of the run before it; others write the separator.
    run = F.transform(
        "marked",
        lambda x, i: F.concat(F.when(~x["opens"], F.lit(SEP)).otherwise(F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(STOP + "\n")), F.lit(START), x["role"], F.lit("\n"))), x["text"]),
    )
    return whole.withColumn("marked", numbered).select("conv_id", F.concat(F.array_join(run, ""), F.lit(STOP + "\n")).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and mask (array of [start, length) in code points of the formatted text, one for
    each assistant text), both parsed from `formatted`."""
    runs = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    parse = F.transform(
        runs,
        lambda r: F.struct(
            F.substring_index(F.substring(r, len(START) + 1, 2147483647), "\n", 1).alias("role"),
            F.split(F.substring(r, F.length(F.substring_index(r, "\n", 1)) + 2, F.length(r)), r"<\|im_sep\|>", -1).alias("texts"),
        ),
    )
    turns = F.flatten(F.transform("parsed", lambda r: F.transform(r["texts"], lambda t: F.struct(unescape(r["role"]).alias("role"), unescape(t).alias("text")))))
    # Code points before each text: headers, separators and ends have fixed lengths.
    sizes = F.flatten(
        F.transform("parsed", lambda r: F.transform(r["texts"], lambda t, i: F.struct((F.when(i == 0, F.length(r["role"]) + len(START) + 1).otherwise(F.lit(len(SEP)))).alias("before"), F.length(t).alias("size"), F.when(i == F.size(r["texts"]) - 1, len(STOP) + 1).otherwise(0).alias("after"), (r["role"] == "assistant").alias("learns"))))
    )
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["before"] + x["size"] + x["after"]).alias("at"),
        F.when(x["learns"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + x["before"]).cast("long").alias("start"), x["size"].cast("long").alias("length"))))).otherwise(acc["mask"]).alias("mask"),
    )
    # In stretches: an array grows by copies, so one of all turns would cost their square.
    long = F.lit(0).cast("long")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("sizes"), F.lit(1)) - 1) / STRETCH).cast("int")), lambda k: F.slice("sizes", k * STRETCH + 1, F.lit(STRETCH)))
    total = lambda s: F.aggregate(s, long, lambda n, x: n + x["before"] + x["size"] + x["after"])
    begins = F.aggregate("totals", F.struct(long.alias("at"), F.array().cast("array<bigint>").alias("all")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
    of_stretch = lambda s, at: F.aggregate(s, F.struct(at.alias("at"), empty.alias("mask")), step, lambda acc: acc["mask"])
    whole = formatted.withColumn("parsed", parse).withColumn("sizes", sizes).select("conv_id", "formatted", turns.alias("turns"), cut.alias("cut"))
    whole = whole.withColumn("totals", F.transform("cut", total))
    return whole.select("conv_id", "formatted", "turns", F.flatten(F.zip_with("cut", begins, of_stretch)).alias("mask"))


def digests(turns: DataFrame) -> DataFrame:
    back = read_back(conversations_as_text(turns))
    learned = unescape(F.array_join(F.transform("mask", lambda m: F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))), ""))
    return back.withColumn("learned", learned).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
