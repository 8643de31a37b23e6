"""Log lines, timer spans and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Layer tags of log lines.
LAYERS = {"L1 cmd": "L1", "L2 ser": "L2", "L3 chk": "L3", "L4 cmp": "L4", "L5 enc": "L5", "L6 pak": "L6", "L7 sto": "L7"}
_TAGS = "|".join(LAYERS)
LINE = rf"^\[[^ \]]+ ({_TAGS}) \] *([+-]?[0-9.eE+-]+)s (.+)$"


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """``layer, elapsed_secs, depth, text`` of well-formed log lines; others are dropped.

    A line is ``[<app> <layer tag> ] <seconds>s <indent><text>``, two spaces of indent a level.
    """
    group = lambda i: F.regexp_extract(column, LINE, i)
    rest = group(3)
    parsed = lines.withColumns({
        "layer": F.substring(group(1), 1, 2), "elapsed_secs": group(2).try_cast("double"),
        "depth": F.floor((F.length(rest) - F.length(F.ltrim(rest))) / 2).cast("int"), "text": F.ltrim(rest),
    })
    return parsed.where((F.col("layer") != "") & F.col("elapsed_secs").isNotNull() & (F.abs("elapsed_secs") < float("inf")) & (F.col("text") != ""))


def format_line(app: str, tag: Column, elapsed: Column, depth: Column, text: Column) -> Column:
    return F.concat(F.lit(f"[{app} "), tag, F.lit(" ] "), F.format_string("%+9.3f", elapsed), F.lit("s "), F.repeat(F.lit("  "), depth), text)


def layer_filter(layers: list[str]) -> Column:
    """Any of the layers, in any case; no layers mean all."""
    wanted = [x.strip().upper() for x in layers]
    return F.col("layer").isin(wanted) if wanted else F.lit(True)


def spans(lines: DataFrame) -> DataFrame:
    """``file, label, layer, depth, start_micros, end_micros``: each end paired with the latest open start.

    ``lines`` has ``file, line_no, label, layer, depth, kind, micros``.  The height of the stack
    of open starts is a running sum, reflected at zero for ends without a start; at each height
    a matched end belongs to the last start before it.  Unmatched lines give nothing.
    """
    key = ["file", "depth", "label", "layer"]
    upto = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "start", 1).otherwise(-1)
    run = lines.withColumn("s", F.sum(step).over(upto))
    run = run.withColumn("height", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    before = F.coalesce(F.lag("height").over(Window.partitionBy(*key).orderBy("line_no")), F.lit(0))
    run = run.withColumn("level", F.when(F.col("kind") == "start", F.col("height")).when(before >= 1, before))
    same = Window.partitionBy(*key, "level").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("kind") == "start", F.col("micros")), ignorenulls=True).over(same)
    paired = run.where("level is not null").withColumn("start_micros", opened)
    return paired.where("kind = 'end'").select("file", "label", "layer", "depth", "start_micros", F.col("micros").alias("end_micros"))


def label_stats(spans: DataFrame, sort: str = "total") -> DataFrame:
    """Count, total, mean and longest duration by label and layer; an unknown sort key means total, ties by label and layer."""
    took = F.col("end_micros") - F.col("start_micros")
    stats = spans.groupBy("label", "layer").agg(F.count("*").alias("count"), F.sum(took).alias("total_micros"), F.avg(took).alias("avg_micros"), F.max(took).alias("max_micros"))
    column = {"avg": "avg_micros", "count": "count", "max": "max_micros"}.get(sort, "total_micros")
    return stats.orderBy(F.desc(column), "label", "layer")


def layer_totals(spans: DataFrame) -> DataFrame:
    """Total by layer and its share: of L1 (root spans only) if positive, else of the largest layer; positive ones, largest first."""
    took = F.when((F.col("layer") != "L1") | (F.col("depth") == 0), F.col("end_micros") - F.col("start_micros")).otherwise(0)
    totals = spans.groupBy("layer").agg(F.sum(took).alias("total_micros"))
    every = Window.partitionBy()  # seven layers at most
    first = F.max(F.when(F.col("layer") == "L1", F.col("total_micros"))).over(every)
    whole = F.when(first > 0, first).otherwise(F.max("total_micros").over(every))
    return totals.withColumn("share_pct", F.try_divide(F.col("total_micros") * 100.0, whole)).where("total_micros > 0").orderBy(F.desc("total_micros"), "layer")
