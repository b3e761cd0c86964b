"""Integrity checks as tables of violations (H1-H7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOWED = ("BRANCH", "GENERATOR", "HVDC_LINE", "LINE", "TWO_WINDINGS_TRANSFORMER", "TIE_LINE", "BUSBAR_SECTION", "SWITCH")
BRANCH_TYPES = ("LINE", "TWO_WINDINGS_TRANSFORMER", "TIE_LINE", "BRANCH")
# Forward ratings; a reverse one has the name with EndOr.
RATINGS = ("thresholdN", "analysisThresholdN", "thresholdN1", "analysisThresholdNk", "thresholdITAM", "thresholdITAMNk", "thresholdNk")


def check_contingencies(contingencies: DataFrame, equipment: DataFrame) -> DataFrame:
    """(id, valid, reason) of (id, elements array<struct<type, id>>): elements must exist, be of an allowed type and of the
    type that they are said to have; BRANCH stands for lines and transformers."""
    e = contingencies.select("id", F.explode_outer("elements").alias("e")).select("id", F.col("e.type").alias("said"), F.col("e.id").alias("element"))
    rows = e.join(equipment.select(F.col("id").alias("element"), F.col("type").alias("real")), "element", "left")
    fits = (F.col("said") == F.col("real")) | ((F.col("said") == "BRANCH") & F.col("real").isin(*BRANCH_TYPES))
    reason = F.when(F.col("element").isNull(), "no element").when(F.col("real").isNull(), "not found").when(~F.col("said").isin(*ALLOWED), "type not allowed").when(~fits, "type differs")
    return rows.withColumn("reason", reason).groupBy("id").agg((F.count("reason") == 0).alias("valid"), F.min("reason").alias("reason"))


def check_contingency_refs(refs: DataFrame, contingencies: DataFrame) -> DataFrame:
    """(kind, id, contingency) that name an unknown contingency, of (kind, id, contingencies array)."""
    rows = refs.select("kind", "id", F.explode("contingencies").alias("contingency"))
    return rows.join(contingencies.select(F.col("id").alias("contingency")), "contingency", "left_anti").select("kind", "id", "contingency")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, from 1. Lines are numbered in their split; how many the splits before hold is one
    number per split."""
    rows = spark.read.text(path).withColumn("m", F.monotonically_increasing_id())
    split = F.shiftright("m", 33)
    offsets, before = [], 0
    for r in rows.groupBy(split.alias("split")).count().orderBy("split").collect():
        offsets += [F.lit(r["split"]), F.lit(before)]
        before += r["count"]
    start = F.element_at(F.create_map(*offsets), split) if offsets else F.lit(0)
    return rows.select((start + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line_no"), "value")


def read_remedials(lines: DataFrame) -> DataFrame:
    """(line_no, contingency, constraints, n_actions, open, close) of lines ``contingency|constraint...;n;action;...``; '+' closes."""
    cells = F.transform(F.split(F.regexp_replace("value", r"[;\s]+$", ""), ";"), lambda x: F.rtrim(x))
    rows = lines.filter("line_no > 1").withColumn("c", cells).filter("size(c) >= 3")
    head = F.split(F.col("c")[0], r"\|")
    actions = F.filter(F.slice("c", F.lit(3), F.size("c")), lambda x: x != "")
    return rows.select("line_no", head[0].alias("contingency"), F.slice(head, F.lit(2), F.size(head)).alias("constraints"), F.expr("try_cast(c[1] AS int)").alias("n_actions"), F.filter(actions, lambda x: ~x.startswith("+")).alias("open"), F.transform(F.filter(actions, lambda x: x.startswith("+")), lambda x: F.substring(x, F.lit(2), F.length(x))).alias("close"))


def check_remedial_file(lines: DataFrame) -> DataFrame:
    """(line_no, problem): head ``NB;n;``, its number against the lines, comments, ends without ';', empty elements, counts
    that aren't numbers."""
    v = F.col("value")
    head = lines.filter("line_no = 1 AND NOT value RLIKE '^NB;\\\\d+;$'").select("line_no", F.lit("bad header").alias("problem"))
    counted = lines.agg(F.max(F.when(F.col("line_no") == 1, F.expr("try_cast(split(value, ';')[1] AS int)"))).alias("said"), F.count_if((F.col("line_no") > 1) & (F.trim("value") != "")).alias("is"))
    count = counted.filter("said <> is").select(F.lit(1).alias("line_no"), F.lit("count differs").alias("problem"))
    body = lines.filter("line_no > 1 AND trim(value) <> ''")
    problem = F.when(v.startswith("#") | v.startswith("/*"), "comment").when(~v.rlike(r";\s*$"), "no ; at the end").when(v.rlike(r"^\s*;|;;"), "empty element").when(F.expr("try_cast(get(split(value, ';'), 1) AS int) IS NULL"), "count is no number")
    return head.unionByName(count).unionByName(body.select("line_no", problem.alias("problem")).filter("problem IS NOT NULL"))


def check_remedial_refs(remedials: DataFrame, equipment: DataFrame, monitoring: DataFrame, contingencies: DataFrame) -> DataFrame:
    """(line_no, element, problem): actions on what is no branch or switch, constraints that aren't monitored on contingency,
    unknown contingencies."""
    actions = remedials.select("line_no", F.explode(F.concat("open", "close")).alias("element")).join(equipment.select(F.col("id").alias("element"), "type"), "element", "left")
    bad = actions.filter(F.col("type").isNull() | ~F.col("type").isin(*BRANCH_TYPES, "SWITCH")).select("line_no", "element", F.lit("action is no branch or switch").alias("problem"))
    watched = monitoring.filter("mode_nk = 'MONITORED'").select(F.col("branch").alias("element"))
    blind = remedials.select("line_no", F.explode("constraints").alias("element")).join(watched, "element", "left_anti").select("line_no", "element", F.lit("constraint is not monitored").alias("problem"))
    unknown = remedials.select("line_no", F.col("contingency").alias("element")).join(contingencies.select(F.col("id").alias("element")), "element", "left_anti").select("line_no", "element", F.lit("unknown contingency").alias("problem"))
    return bad.unionByName(blind).unionByName(unknown)


def drop_orphan_ratings(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ratings that stay, (branch, variable) that went): reverse ratings without their forward one."""
    pairs = [f"{r}EndOr" for r in RATINGS]
    forward = ratings.select("branch", F.concat("variable", F.lit("EndOr")).alias("variable"))
    orphans = ratings.filter(F.col("variable").isin(pairs)).join(forward, ["branch", "variable"], "left_anti").select("branch", "variable")
    return ratings.join(orphans, ["branch", "variable"], "left_anti"), orphans


def check_cost_pairs(costs: DataFrame) -> DataFrame:
    """(id, kind, eligible) of (id, kind, direction): both up and down must be set."""
    return costs.groupBy("id", "kind").agg((F.count_distinct("direction") == 2).alias("eligible"))
