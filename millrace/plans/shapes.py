"""Queries of readers that find a table's header, titles and totals, of facets, and of counted recipes; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import Frame
from millrace.plans import insights, pipeline, recipe_text
from millrace.plans.catalog import Tables, query
from millrace.plans.roundtrips import say, text
from millrace.sources import headers, readers


def framed(f: Frame, above: list[str], line: Column, below: list[str], key: str) -> Frame:
    """Lines out of a table's rows with others above and below them."""
    rows = f.df.select(F.lit(1).alias("__part"), F.col(key).cast("long").alias("__k"), line.alias("line"))
    others = [(0, k, x) for k, x in enumerate(above)] + [(2, k, x) for k, x in enumerate(below)]
    return Frame(rows.unionByName(f.df.sparkSession.createDataFrame(others, "__part int, __k long, line string")), ("__part", "__k"))


@query("read_markdown_header", "SELECT o_orderkey::VARCHAR AS id, o_orderpriority || '|' AS \"the prio\" FROM orders")
def _(t: Tables) -> DataFrame:
    line = F.concat(say("| "), text("o_orderkey"), say(" | "), F.col("o_orderpriority"), say("\\| |"))
    return readers.markdown_table(framed(t("orders"), ["| id | the prio |", "|---|:--|"], line, [], "o_orderkey")).result()


@query("read_box_header", "SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS st FROM orders")
def _(t: Tables) -> DataFrame:
    rule = "+------+----+"
    line = F.concat(say("| "), text("o_orderkey"), say(" | "), F.col("o_orderstatus"), say("  |"))
    return readers.box_table(framed(t("orders"), [rule, "| id   | st |", rule], line, [rule, "150 rows in set"], "o_orderkey")).result()


@query("own_header", "SELECT c_custkey::VARCHAR AS \"No\", c_name AS \"Customer\", c_acctbal::DECIMAL(12,2)::VARCHAR AS \"Balance\" FROM customer")
def _(t: Tables) -> DataFrame:
    """A title, a blank line, a header, the rows, and totals, all as cells of text columns."""
    rows = t("customer").df.select(F.lit(1).alias("__part"), F.col("c_custkey").alias("__k"), text("c_custkey").alias("column_1"), F.col("c_name").alias("column_2"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("column_3"))
    others = [(0, 0, "Customers of the year", "", ""), (0, 1, "", "", ""), (0, 2, "No", "Customer", "Balance"), (2, 0, "Subtotal", "", "12"), (2, 1, "", "", ""), (2, 2, "Grand total", "", "24")]
    made = rows.unionByName(rows.sparkSession.createDataFrame(others, "__part int, __k long, column_1 string, column_2 string, column_3 string"))
    return headers.tidied(Frame(made, ("__part", "__k"))).result()


_A, _B, _C = "p_size > 20", "p_type = 'ECONOMY'", "contains(p_name, 'i')"


@query(
    "facets",
    f"SELECT 'p_size' AS \"column\", p_size::VARCHAR AS value, count(*) AS n FROM part WHERE {_B} AND {_C} GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE {_A} AND {_C} GROUP BY 2 "
    f"UNION ALL SELECT 'p_name', p_name, count(*) FROM part WHERE {_A} AND {_B} GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part WHERE {_A} AND {_B} AND {_C} GROUP BY 2",
)
def _(t: Tables) -> DataFrame:
    """Each column's values under the filters of the others, all in one scan."""
    filters = {"p_size": F.col("p_size") > 20, "p_type": F.col("p_type") == "ECONOMY", "p_name": F.col("p_name").contains("i")}
    return insights.facets(t("part"), filters, ["p_size", "p_type", "p_name", "p_brand"])


_STEPS = """
case title "p_name"
remove rows where "p_size" < 10
replace "Widget" with "Gadget" in "p_name" matchcase
group by "p_type" calculate "count"
"""


@query(
    "recipe_counters",
    "WITH big AS (SELECT * FROM part WHERE p_size >= 10) SELECT 1 AS step, count(*) AS rows_in, count(*) AS rows_out, count(*) FILTER (WHERE regexp_matches(p_name, '^[a-z]| [a-z]')) AS cells_changed FROM part "
    "UNION ALL SELECT 2, (SELECT count(*) FROM part), count(*), 0 FROM big UNION ALL SELECT 3, count(*), count(*), count(*) FILTER (WHERE contains(p_name, 'widget')) FROM big UNION ALL SELECT 4, count(*), count(DISTINCT p_type), NULL FROM big",
)
def _(t: Tables) -> DataFrame:
    """What four steps did, counted by the one job that runs them."""
    _, counts = pipeline.counted(t("part"), recipe_text.steps_of(_STEPS))
    rows = [(k, r["rows_in"], r["rows_out"], r["cells_changed"]) for k, r in enumerate(counts, 1)]
    return t("part").df.sparkSession.createDataFrame(rows, "step int, rows_in long, rows_out long, cells_changed long")
