"""Reporting lines by pointer doubling: in round k every node knows what lies 2^k steps above it.

Rows have a fixed size (no paths), a round is one join on the node reached so far, and rounds grow with the logarithm of the
longest line or cycle. Edges are (report_id, manager_id, ...) with one manager for each report; of several the smallest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.operators.stored import stored


def climbed(edges: DataFrame, value: Column | None = None) -> DataFrame:
    """(node, root, value, depth) of every node that a root stands above: the product of ``value`` on the way and the number of steps.

    Roots, which have no manager, are not among the rows; nor are nodes on a cycle or below one. Rounds end when
    no line is open, or when a round closes none: a finite line loses at least one open node in each round, so the open ones lead into cycles.
    """
    first = edges.groupBy(F.col("report_id").alias("node")).agg(F.min_by(F.struct(F.col("manager_id").alias("tip"), (F.lit(1.0) if value is None else value).alias("value")), "manager_id").alias("m"))
    lines = stored(first.select("node", "m.tip", "m.value", F.lit(1).cast("long").alias("depth")))
    has = lines.select(F.col("node").alias("tip"), F.lit(True).alias("open"))
    lines = stored(lines.join(has, "tip", "left").select("node", "tip", "value", "depth", F.coalesce("open", F.lit(False)).alias("open")))
    left = lines.filter("open").count()
    while left:
        up = lines.select(F.col("node").alias("tip"), F.col("tip").alias("_t"), F.col("value").alias("_v"), F.col("depth").alias("_d"), F.col("open").alias("_o"))
        moved = lines.filter("open").join(up, "tip").select("node", F.col("_t").alias("tip"), (F.col("value") * F.col("_v")).alias("value"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_o").alias("open"))
        lines = stored(lines.filter("NOT open").unionByName(moved))
        now = lines.filter("open").count()
        if now == left:
            break
        left = now
    return lines.filter("NOT open").select("node", F.col("tip").alias("root"), "value", "depth")


def cycle_members(edges: DataFrame) -> DataFrame:
    """(least, position, node) of every node on a cycle; position 0 is the cycle's smallest node, 1 its manager, and so on.

    A row keeps the smallest node among the next 2^k and how many steps away it is. The nodes that are reached
    become the cycles' nodes once their number stays the same, and all cycles are covered once no smallest node changes.
    """
    step = edges.groupBy(F.col("report_id").alias("node")).agg(F.min("manager_id").alias("tip"))
    walks = stored(step.select("node", "tip", F.col("node").alias("least"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("changed")))
    size, tips = 1, None
    while True:
        far = walks.select(F.col("node").alias("tip"), F.col("tip").alias("_t"), F.col("least").alias("_l"), F.col("at").alias("_a"))
        nearer = F.col("_l") < F.col("least")
        walks = stored(
            walks.join(far, "tip").select(  # a walk that ends at a root drops out
                "node", F.col("_t").alias("tip"), F.least("least", "_l").alias("least"), F.when(nearer, F.col("_a") + size).otherwise(F.col("at")).alias("at"), nearer.alias("changed"),
            )
        )
        size *= 2
        seen = walks.agg(F.count_distinct("tip").alias("tips"), F.coalesce(F.bool_or("changed"), F.lit(False)).alias("changed")).first()
        if seen["tips"] == tips and not seen["changed"]:
            break
        tips = seen["tips"]
    on = walks.join(walks.select(F.col("tip").alias("node")).distinct(), "node", "left_semi").select("node", "least", "at")
    sizes = on.groupBy("least").agg(F.count("*").alias("n"))  # no window, as a cycle may be of any length
    return on.join(sizes, "least").select("least", F.pmod(F.col("n") - F.col("at"), F.col("n")).alias("position"), "node")


def find_cycles(edges: DataFrame) -> DataFrame:
    """(least, cycle): each cycle once as text, its smallest member first."""
    listed = F.array_sort(F.collect_list(F.struct("position", F.col("node").cast("string").alias("node"))))
    return cycle_members(edges).groupBy("least").agg(F.array_join(F.transform(listed, lambda s: s["node"]), ">").alias("cycle"))


def layout(edges: DataFrame, people: DataFrame) -> DataFrame:
    """(company_id, person_id, depth, place): rows of an org chart and the order within each row.

    ``edges`` is (company_id, report_id, manager_id), ``people`` (person_id, domain, seniority, name). Roots have depth 0, others one more than their
    manager. A company whose edges are all on or below cycles takes its most senior person as root (missing seniority counts 0, ties to the smaller id); whoever no
    root is above then has depth 0. Within a depth: domain, seniority descending, name, id; missing values last.
    """
    ids = edges.select("company_id", F.col("report_id").alias("person_id")).unionByName(edges.select("company_id", F.col("manager_id").alias("person_id"))).distinct()
    # a person may stand in several companies, so a node is the pair
    node = lambda c: F.struct("company_id", F.col(c).alias("person_id"))
    links = edges.select("company_id", node("report_id").alias("report_id"), node("manager_id").alias("manager_id"))
    shown = stored(ids.join(people.select("person_id", "domain", "seniority", "name"), "person_id", "left"))
    reports = edges.select("company_id", F.col("report_id").alias("person_id")).distinct()
    rooted = ids.join(reports, ["company_id", "person_id"], "left_anti").select("company_id").distinct()
    senior = F.min_by("person_id", F.struct(-F.coalesce("seniority", F.lit(0)), F.col("person_id"))).alias("person_id")
    stand_in = shown.join(rooted, "company_id", "left_anti").groupBy("company_id").agg(senior).select("company_id", node("person_id").alias("report_id"))
    lines = climbed(links.join(stand_in, ["company_id", "report_id"], "left_anti"))
    depth = lines.select("node.company_id", "node.person_id", F.col("depth").cast("int").alias("depth"))
    by = W.partitionBy("company_id", "depth").orderBy(F.asc_nulls_last("domain"), F.desc_nulls_last("seniority"), F.asc_nulls_last("name"), "person_id")
    placed = shown.join(depth, ["company_id", "person_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return placed.withColumn("place", F.row_number().over(by)).select("company_id", "person_id", "depth", "place")
