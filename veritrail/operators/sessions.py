"""Session logs, guard chains and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import text as T
from veritrail.operators.skew import skewed_lookup
from veritrail.session import materialize

#: Lines of a session that are put in order in one task.
BLOCK = 100_000
EDIT_TOOLS = ("write", "edit", "hashline_edit")


def lines(session_logs: DataFrame) -> DataFrame:
    """(session_file, line_no, raw): each line once, of several deliveries the last."""
    w = Window.partitionBy("session_file", "line_no").orderBy(F.desc_nulls_last("ingested_at"), F.desc_nulls_last("raw"))
    return session_logs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("session_file", "line_no", "raw")


def carried(lines: DataFrame, column: str, block: int = BLOCK) -> DataFrame:
    """lines (session_file, line_no, ...) with the column filled from the last line before that has it.

    A session is put in order in blocks of lines, so that a long one is many tasks; what a block leaves is carried on over the blocks.
    """
    b = lines.withColumn("_b", F.floor(F.col("line_no") / block))
    inside = Window.partitionBy("session_file", "_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    left = b.filter(F.col(column).isNotNull()).groupBy("session_file", "_b").agg(F.max_by(column, "line_no").alias("_left"))
    every = b.select("session_file", "_b").distinct().join(left, ["session_file", "_b"], "left")
    before = F.last("_left", ignorenulls=True).over(Window.partitionBy("session_file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    every = every.select("session_file", "_b", before.alias("_before")).filter("_before is not null")
    filled = b.withColumn(column, F.last(column, ignorenulls=True).over(inside)).join(every, ["session_file", "_b"], "left")
    return filled.withColumn(column, F.coalesce(column, "_before")).drop("_b", "_before")


def tool_calls(session_logs: DataFrame) -> DataFrame:
    """(session_file, line_no, pos, cwd, name, path): every tool call with the working folder in force, which a line sets for itself and those after it.

    Lines that aren't JSON objects give no call and change nothing. path is null without a string argument of that name.
    """
    v = lines(session_logs).withColumn("v", F.try_parse_json("raw"))
    v = v.filter(F.col("raw").rlike(r"^\s*\{"))
    v = carried(v.withColumn("cwd", F.try_variant_get("v", "$.cwd", "string")), "cwd")
    items = v.select("session_file", "line_no", "cwd", F.posexplode(F.try_variant_get("v", "$.message.content", "array<variant>")).alias("pos", "c"))
    get = lambda p: F.try_variant_get("c", p, "string")
    calls = items.filter(get("$.type") == "toolCall")
    return calls.select("session_file", F.col("line_no").cast("bigint").alias("line_no"), F.col("pos").cast("bigint").alias("pos"), "cwd", get("$.name").alias("name"), get("$.arguments.path").alias("path"))


def edits(calls: DataFrame) -> DataFrame:
    """(session_file, line_no, pos, cwd, path): edited paths, relative ones under the working folder."""
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat("cwd", F.lit("/"), "path"))
    return calls.filter(F.col("name").isin(*EDIT_TOOLS) & F.col("path").isNotNull()).select("session_file", "line_no", "pos", "cwd", full.alias("path"))


def usage(session_logs: DataFrame) -> DataFrame:
    """(day, calls): calls of the knowledge tools by day of ingestion; all occurrences of a line count."""
    n = F.regexp_count("raw", F.lit(r'"name": ?"kb_(search|insert|sync)"'))
    return session_logs.groupBy(F.date_format("ingested_at", "yyyy-MM-dd").alias("day")).agg(F.coalesce(F.sum(n.cast("bigint")), F.lit(0)).alias("calls"))


def guard(calls: DataFrame, block: Column | None = None) -> DataFrame:
    """calls (session, seq, class) with `chain` and `warn`: greps in a row since the last reset; other calls leave the chain as it is.

    A warning is due at the third grep of a chain and each one after it. block, which must not fall as seq grows, such as the day of a call, cuts a session into parts that
    are put in order each in a task of its own; the greps that a part leaves are carried on over the parts.
    """
    c = calls.withColumn("_b", F.lit(0) if block is None else block)
    upto = Window.partitionBy("session", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    g = c.withColumn("_g", F.sum((F.col("class") == "reset").cast("int")).over(upto))
    inside = Window.partitionBy("session", "_b", "_g").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("chain", F.sum((F.col("class") == "grep").cast("bigint")).over(inside))
    if block is not None:
        part = g.groupBy("session", "_b").agg(F.max("_g").alias("_resets"), F.max_by("chain", "seq").alias("_left"))
        order = Window.partitionBy("session").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        part = part.withColumn("_since", F.sum((F.col("_resets") > 0).cast("int")).over(order))
        total = F.sum("_left").over(Window.partitionBy("session", "_since").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        part = part.withColumn("_total", total)
        before = F.lag("_total", 1, 0).over(Window.partitionBy("session").orderBy("_b"))
        part = part.select("session", "_b", before.alias("_before"))
        g = g.join(part, ["session", "_b"]).withColumn("chain", F.col("chain") + F.when(F.col("_g") == 0, F.col("_before")).otherwise(0)).drop("_before")
    g = g.withColumn("warn", (F.col("class") == "grep") & (F.col("chain") >= 3))
    return g.drop("_g", "_b")


def first_prompt(inputs: DataFrame) -> DataFrame:
    """The first input (session, seq, text) of each session that isn't blank or a command."""
    ok = inputs.filter((F.trim("text") != "") & ~F.col("text").startswith("/"))
    w = Window.partitionBy("session").orderBy("seq")
    return ok.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def median_by(df: DataFrame, group: str, value: str, cells: int = 4096) -> DataFrame:
    """(group, median): the exact median of the values that aren't null; of an even number the mean of the two in the middle.

    No group is held in a task: counts by cell between a group's least and largest value tell in which cell the middle lies, and only the different
    values of that cell are put in order, with their counts. A group may hold any share of the rows.
    """
    v = df.select(group, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    own = v.groupBy(group).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    own = materialize(own, "ranges")
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells), F.lit(cells - 1))).otherwise(F.lit(0))
    celled = skewed_lookup(v, own, [group], "inner").select(group, "_v", "_n", cell.alias("_cell"))
    held = celled.groupBy(group, "_cell").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))  # at most `cells` rows for a group
    upto = F.sum("_c").over(Window.partitionBy(group).orderBy("_cell"))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))).alias("_rank")
    pick = held.withColumn("_upto", upto).select(group, "_cell", (F.col("_upto") - F.col("_c")).alias("_below"), "_upto", middle).filter("_rank >= _below and _rank < _upto")
    pick = pick.groupBy(group, "_cell").agg(F.first("_below").alias("_below"), F.collect_list("_rank").alias("_ranks"))  # one or two of each
    values = celled.groupBy(group, "_cell", "_v").agg(F.count("*").alias("_c")).join(pick, [group, "_cell"])
    end = F.col("_below") + F.sum("_c").over(Window.partitionBy(group, "_cell").orderBy("_v"))
    found = values.withColumn("_end", end).filter(F.exists("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_c"))))
    return found.groupBy(group).agg(F.avg("_v").alias("median"))


def snapshots(events: DataFrame) -> DataFrame:
    """(day, nodes, edges, hits, errors, p50): one telemetry row per day of events."""
    of = lambda t: F.count_if(F.col("event_type") == t)
    dated = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    g = dated.groupBy("day").agg(F.count("*").alias("nodes"), F.countDistinct("user_id").alias("edges"), of("click").alias("hits"), of("error").alias("errors"))
    return g.join(median_by(dated, "day", "value"), "day", "left").withColumn("p50", F.round("median", 6)).drop("median")


def trend(shots: DataFrame) -> DataFrame:
    """First and last count, the change, the days between (at least 1) and the change per day, rounded to whole nodes."""
    g = shots.agg(
        F.min_by("nodes", "day").alias("first_nodes"), F.max_by("nodes", "day").alias("last_nodes"), F.greatest(F.datediff(F.max("day").cast("date"), F.min("day").cast("date")), F.lit(1)).cast("bigint").alias("days")
    )
    change = F.col("last_nodes") - F.col("first_nodes")
    return g.withColumn("delta", change).withColumn("per_day", F.round(change / F.col("days")).cast("bigint"))


def hit_rates(events: DataFrame) -> DataFrame:
    """(day, rate): strong (purchase) against weak (view) and missed (error) answers."""
    of = lambda t: F.count_if(F.col("event_type") == t)
    g = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(of("purchase").alias("s"), of("view").alias("w"), of("error").alias("m"))
    return g.select("day", T.hit_rate(F.col("s"), F.col("w"), F.col("m")).alias("rate"))
