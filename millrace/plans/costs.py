"""Cost attribution over line items: a line item is a cost line for its part, dated by its
shipping date; returned lines tell which supplier, as a cluster, the part belonged to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import attribution
from millrace.sinks.files import write_csv
from millrace.sources.tables import read_csv, table
from millrace.workspace import fresh_path

START, END = "1995-02-01", "2001-11-01"
LINE_COLUMNS = ("resource_id", "date", "order_id", "line_no", "supplier_id", "quantity", "cost")


def _costs(spark: SparkSession, directory: str) -> DataFrame:
    """Cost lines; accepted lines carry labels, finished ones among them an empty project."""
    lines = table(spark, directory, "lineitem")
    labelled = F.col("l_returnflag") == "A"
    return lines.select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("resource_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"),
        F.when(labelled, F.concat(F.lit("c-"), F.col("l_suppkey").cast("string"))).alias(attribution.CLUSTER_LABEL),
        F.when(labelled & (F.col("l_linenumber") == 7), "")
        .when(labelled, F.concat(F.lit("p-"), F.col("l_linenumber").cast("string")))
        .alias(attribution.PROJECT_LABEL),
    )


def _dictionary(spark: SparkSession, directory: str) -> DataFrame:
    """One row per day and part that is not open: the cluster of the greatest supplier."""
    lines = table(spark, directory, "lineitem").where("l_returnflag <> 'N'")
    owner = lines.groupBy(
        F.col("l_shipdate").cast("date").alias("dt"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("obj_id"),
    ).agg(F.max("l_suppkey").alias("owner"))
    return owner.select("dt", "obj_id", F.concat(F.lit("c-"), F.col("owner").cast("string")).alias("cluster_id"))


def _attributed(spark: SparkSession, directory: str, with_fan_out: bool = False) -> DataFrame:
    costs = _costs(spark, directory)
    labels = attribution.project_labels(costs, START, END)
    return attribution.attribute_costs(
        costs, _dictionary(spark, directory), labels, START, END, LINE_COLUMNS, with_fan_out
    )


def cost_attribution(spark: SparkSession, directory: str) -> DataFrame:
    """Costs and dictionary go out as CSV, in the columns of an export, and are read back."""
    exported = _costs(spark, directory).select(
        "resource_id", "date", "cost", F.col("quantity").alias("pricing_quantity"), F.col("order_id").alias("cloud_name"),
        F.col("line_no").alias("folder_name"), F.col("supplier_id").alias("service_name"),
        F.col(f"`{attribution.CLUSTER_LABEL}`"), F.col(f"`{attribution.PROJECT_LABEL}`"),
    )
    costs = attribution.read_billing(spark, write_csv(exported, fresh_path(spark, "billing")))
    known = _dictionary(spark, directory).select("dt", "obj_id", F.lit("vm").alias("obj_type"), F.col("obj_id").alias("vm_id"), "cluster_id")
    dictionary = attribution.read_dictionary(spark, write_csv(known, fresh_path(spark, "dictionary")))
    labels = attribution.project_labels(costs, START, END)
    keep = ["resource_id", "date", "cloud_name", "folder_name", "service_name", "pricing_quantity", "cost"]
    lines = attribution.attribute_costs(costs, dictionary, labels, START, END, keep)
    kinds = _costs(spark, directory).select(*LINE_COLUMNS).schema
    return lines.select(
        "cluster_id", "project_id",
        *[F.col(name).cast(field.dataType).alias(field.name) for name, field in zip(keep, kinds)],
    )


def cost_rollup(spark: SparkSession, directory: str) -> DataFrame:
    return attribution.cost_rollup(_attributed(spark, directory, True), ["cluster_id", "project_id"])


def cost_rollup_by_day(spark: SparkSession, directory: str) -> DataFrame:
    """The daily report, with the fan-out found by counting line keys."""
    line_key = [name for name in LINE_COLUMNS if name != "cost"]
    return attribution.cost_rollup(_attributed(spark, directory), ["date", "project_id"], line_key)


def project_mapping(spark: SparkSession, directory: str) -> DataFrame:
    """Customers as clusters: a customer maps to their segment, on the date of an urgent order to
    that order's status instead, and one customer in three by date only. The mapping is an
    external table."""
    customers = table(spark, directory, "customer")
    orders = table(spark, directory, "orders")
    cluster = F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("cluster_id")
    order_cluster = F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("cluster_id")
    order_date = F.col("o_orderdate").cast("date")
    by_date_only = F.col("c_custkey") % 3 == 0
    usual = customers.select(
        F.when(by_date_only, F.lit("1995-01-01").cast("date")).alias("valid_on"), cluster, F.col("c_mktsegment").alias("project_id")
    )
    urgent = orders.where("o_orderpriority = '1-URGENT'").groupBy(order_date.alias("valid_on"), order_cluster)
    daily = urgent.agg(F.max("o_orderstatus").alias("project_id")).where("valid_on <> DATE '1995-01-01'")
    rows = usual.unionByName(daily)
    mapping = read_csv(spark, write_csv(rows, fresh_path(spark, "mapping")), rows.schema)
    costs = orders.select("o_orderkey", order_cluster, order_date.alias("date"), "o_totalprice")
    return attribution.map_projects(costs, mapping)


QUERIES = {
    "cost_attribution": cost_attribution,
    "cost_rollup": cost_rollup,
    "cost_rollup_by_day": cost_rollup_by_day,
    "project_mapping": project_mapping,
}

# A line's cluster is that of its part on its day; its projects are those that labelled lines
# name for that cluster and day, and the line is repeated for each.
_PERIOD = f"l_shipdate >= DATE '{START}' AND l_shipdate < DATE '{END}'"
_ATTRIBUTED = f"""
    owners AS (
        SELECT l_shipdate::DATE AS day, l_partkey AS part, max(l_suppkey) AS supplier
        FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
    projects AS (
        SELECT l_shipdate::DATE AS day, l_suppkey AS supplier, list(DISTINCT 'p-' || l_linenumber) AS names
        FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber <> 7 AND {_PERIOD} GROUP BY ALL),
    placed AS (
        SELECT l.*, 'c-' || o.supplier AS cluster, coalesce(p.names, ['-']) AS names
        FROM lineitem AS l
        LEFT JOIN owners AS o ON (o.day, o.part) = (l.l_shipdate::DATE, l.l_partkey)
        LEFT JOIN projects AS p USING (day, supplier)
        WHERE {_PERIOD}),
    attributed AS (
        SELECT coalesce(cluster, '-') AS cluster_id, unnest(names) AS project_id, len(names) AS copies,
               'part-' || l_partkey AS resource_id, l_shipdate::DATE AS date, l_orderkey AS order_id,
               l_linenumber AS line_no, l_suppkey AS supplier_id, l_quantity AS quantity,
               l_extendedprice::DECIMAL(18,2) AS cost
        FROM placed)"""


def _rollup_sql(by: str) -> str:
    return f"""
        WITH {_ATTRIBUTED}
        SELECT {by}, CAST(SUM(cost) AS DECIMAL(28,2)) AS cost, COUNT(*) AS n_lines,
               COUNT(*) FILTER (WHERE copies > 1) AS fan_out
        FROM attributed GROUP BY {by}"""


ORACLES = {
    "cost_attribution": f"""
        WITH {_ATTRIBUTED}
        SELECT cluster_id, project_id, {', '.join(LINE_COLUMNS)} FROM attributed""",
    "cost_rollup": _rollup_sql("cluster_id, project_id"),
    "cost_rollup_by_day": _rollup_sql("date, project_id"),
    "project_mapping": """
        SELECT o.o_orderkey, 'c-' || o.o_custkey AS cluster_id, CAST(o.o_orderdate AS DATE) AS date, o.o_totalprice,
               COALESCE(d.project_id, c.c_mktsegment) AS project_id
        FROM orders o
        LEFT JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, MAX(o_orderstatus) AS project_id
                   FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) <> DATE '1995-01-01'
                   GROUP BY 1, 2
                   UNION ALL SELECT c_custkey, DATE '1995-01-01', c_mktsegment FROM customer WHERE c_custkey % 3 = 0) d
          ON d.o_custkey = o.o_custkey AND d.day = CAST(o.o_orderdate AS DATE)
        LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_custkey % 3 <> 0""",
}
