"""URL rules by a sort-merge range join.

A host's key is its labels in reverse, each followed by a dot (``www.example.net`` gives ``net.example.www.``). A rule
for a host covers the keys that start with the rule's own key: one interval, whose end is that key with its last dot
replaced by the next character. Intervals of such prefixes are nested or apart, so a sweep over the sorted keys needs
a stack of the rules that are open. What the stack holds after each interval's start and end is known from the rules
alone; the sweep carries it on to the pages that follow.

Pages are dealt by range of (key, path, page_id), so that a busy host is cut into several ranges; every range starts
with the stack that is open at its first key. Among the open rules of a page those whose path starts the page's path
fit, and the longest (host with path) wins, ties by text.

Defined cases: a null url or one without ``://`` has empty host and path and gets the default; rules with a null part
are left out; repeated pages are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratesift.llm.columns import LOWER, UPPER
from ratesift.session import durable

#: The sweep over the rules alone is one task; a longer list is refused.
MAX_RULES = 200_000


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _marks(rules: DataFrame) -> DataFrame:
    """(mark, kind, stack): starts (1) and ends (0) of the rules' intervals, with the rules open from there on."""
    nodes = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(reversed_host(F.translate("host", UPPER, LOWER)).alias("node"))
        .agg(F.collect_set(F.struct("path", F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"), "verdict")).alias("own"))
    )
    labels = F.split(F.expr("left(node, length(node) - 1)"), r"\.", -1)
    over = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))).alias("outer"))
    outer = nodes.select(F.col("node").alias("outer"), F.col("own").alias("outer_own"))
    stacks = over.join(outer, "outer").groupBy("node").agg(
        F.flatten(F.collect_list("outer_own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("outer") != F.col("node"), F.col("outer_own")))).alias("after"),
    )
    end = F.concat(F.expr("left(node, length(node) - 1)"), F.lit("/"))
    return stacks.select(F.inline(F.array(
        F.struct(F.col("node").alias("mark"), F.lit(1).alias("kind"), F.col("inside").alias("stack")),
        F.struct(end.alias("mark"), F.lit(0).alias("kind"), F.col("after").alias("stack")),
    )))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``rules``: (host, path, verdict)."""
    if rules.count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    host, path = host_and_path("url")
    keyed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("mark", reversed_host(F.col("host")))
    ranges = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = durable(
        keyed.repartitionByRange(ranges, "mark", "path", "page_id").withColumn("range", F.spark_partition_id()), "urls"
    )
    marks = _marks(rules)
    starts = keyed.groupBy("range").agg(F.min("mark").alias("mark"))
    opened = (
        marks.select("mark", "kind", "stack", F.lit(None).cast("int").alias("range"))
        .unionByName(starts.select("mark", F.lit(2).alias("kind"), F.lit(None).cast(marks.schema["stack"].dataType).alias("stack"), "range"))
    )
    sweep = Window.orderBy("mark", "kind", "range").rowsBetween(Window.unboundedPreceding, 0)  # rules and ranges only
    opened = opened.select(
        "mark", "kind", F.last("stack", True).over(sweep).alias("stack"), F.last("range", True).over(sweep).alias("range")
    ).where("range IS NOT NULL")  # rules before the first page are in its range's opening stack
    rows = keyed.select("range", "mark", F.lit(2).alias("kind"), F.lit(True).alias("is_page"), "page_id", "host", "path").unionByName(
        opened.select(
            "range", "mark", F.when(F.col("kind") == 2, -1).otherwise(F.col("kind")).alias("kind"),
            F.lit(False).alias("is_page"), F.coalesce("stack", F.array().cast(marks.schema["stack"].dataType)).alias("stack"),
        ), allowMissingColumns=True,
    )
    within = Window.partitionBy("range").orderBy("mark", "kind").rowsBetween(Window.unboundedPreceding, 0)
    judged = rows.withColumn("open", F.last("stack", True).over(within)).where("is_page")
    fits = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return judged.select("page_id", "host", "path", best.alias("best")).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
