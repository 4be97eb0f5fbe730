"""Queries of the three text languages (searches, formulas, recipes), of patterns, and of readers that find their own columns; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import operators as op
from millrace.functions import formula_text, search_text
from millrace.operators import Frame
from millrace.plans import recipe_text
from millrace.plans.catalog import Tables, query
from millrace.plans.roundtrips import lined, say, text
from millrace.sources import readers


@query(
    "search_text",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 20000 AND 260000 AND NOT contains(lower(o_orderpriority), 'low') AND (lower(trim(o_orderstatus)) = 'f' OR o_orderdate >= TIMESTAMP '1998-06-01') "
    "AND regexp_matches(o_orderpriority, '^[1-4]-', 'i') AND NOT contains(o_orderkey::VARCHAR, '7') AND o_custkey <> 10 AND lower(trim(o_orderstatus)) IN ('f', 'o') AND (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'spec'))",
)
def _(t: Tables) -> DataFrame:
    said = 'o_totalprice:20000..260000 -o_orderpriority:low (o_orderstatus:=F OR o_orderdate>=1998-06-01) O_ORDERPRIORITY:/^[1-4]-/i NOT o_orderkey:7 o_custkey!=10 "o orderstatus":(f|o) (urgent OR "SPEC")'
    return search_text.searched(t("orders").df, said).select("o_orderkey", "o_orderpriority")


@query("search_fallback", "SELECT p_partkey FROM part WHERE contains(lower(p_brand), 'brand#1') AND NOT contains(lower(p_type), 'eco')")
def _(t: Tables) -> DataFrame:
    """A text that reads as no test of a column is searched for as it stands."""
    return search_text.searched(t("part").df, "brand#1 -eco p_size>abc").select("p_partkey")


@query("search_formula", "SELECT o_orderkey FROM orders WHERE o_custkey <> 0 AND o_totalprice / o_custkey > 1000 AND o_orderstatus <> 'P'")
def _(t: Tables) -> DataFrame:
    return search_text.searched(t("orders").df, '=AND([o_totalprice] / [o_custkey] > 1000, o_orderstatus <> "p")').select("o_orderkey")


_PLAIN = "regexp_replace(regexp_replace(printf('%.2f', {}), '0+$', ''), '\\.$', '')"


@query(
    "formula_codes",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 OR o_orderkey % 7 = 6 THEN 'error' ELSE 'text' END AS kind, "
    f"CASE o_orderkey % 7 WHEN 0 THEN '#DIV/0!' WHEN 1 THEN '#VALUE!' WHEN 2 THEN '#NUM!' WHEN 3 THEN '#REF!' WHEN 4 THEN '#NAME?' WHEN 5 THEN o_orderstatus || '-' || {_PLAIN.format('o_totalprice')} ELSE '#N/A' END AS shown FROM orders",
)
def _(t: Tables) -> DataFrame:
    """Every error code, and a text with a number in it."""
    k = "MOD([o_orderkey],7)"
    said = f'IFS({k}=0, 1/0, {k}=1, "a"+1, {k}=2, (0-[o_orderkey])^0.5, {k}=3, [gone], {k}=4, NOPE(1), {k}=5, [o_orderstatus]&"-"&[o_totalprice])'
    return formula_text.evaluated(t("orders").df, said, "f").select("o_orderkey", "f.kind", F.col("f.text").alias("shown"))


@query(
    "formula_kinds",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'date' WHEN l_discount = 0 THEN 'text' ELSE 'number' END AS kind, "
    "CASE WHEN l_quantity > 25 THEN date_diff('day', DATE '1899-12-30', date_trunc('month', l_shipdate)::DATE)::DOUBLE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS number, CASE WHEN l_quantity > 25 THEN strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') WHEN l_discount = 0 THEN 'none' ELSE '' END AS shown FROM lineitem",
)
def _(t: Tables) -> DataFrame:
    """One column of dates, numbers and texts, each of its own kind."""
    said = 'IF([l_quantity]>25, DATE(YEAR([l_shipdate]),MONTH([l_shipdate]),1), IFERROR(ROUND([l_tax]/[l_discount],6), "none"))'
    f = formula_text.evaluated(t("lineitem").df, said, "f")
    return f.select("l_orderkey", "l_linenumber", "f.kind", "f.number", F.when(F.col("f.kind") != "number", F.col("f.text")).otherwise("").alias("shown"))


@query("formula_shown", f"SELECT p_partkey, length({_PLAIN.format('p_retailprice')}) || '|' || {_PLAIN.format('p_retailprice')} || '|' || upper(left(p_name, 3)) || '|' || (p_size::BIGINT * 12345678900) || '|' || upper((p_size > 20)::VARCHAR) AS shown FROM part")
def _(t: Tables) -> DataFrame:
    """Numbers inside of texts: no exponents, no trailing zeros."""
    said = 'CONCAT(LEN([p_retailprice]),"|",[p_retailprice],"|",UPPER(LEFT([p_name],3)),"|",[p_size]*12345678900,"|",[p_size]>20)'
    return formula_text.evaluated(t("part").df, said, "f").select("p_partkey", F.col("f.text").alias("shown"))


@query("pattern_groups", "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 1) AS brand_name, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS no_ FROM part")
def _(t: Tables) -> DataFrame:
    """Columns named by the groups of a pattern, with signs that Spark's own names of groups can't have."""
    return op.structure_pattern(t("part"), "p_brand", r"(?<brand_name>[a-z]+)#(?<no_>\d+)", flags="i").result().select("p_partkey", "brand_name", "no_")


@query("pattern_replace", "SELECT p_partkey, regexp_replace(p_name, '^([A-Za-z0-9_]+) ([A-Za-z0-9_]+)', '\\2 of {\\1}') AS p_name FROM part")
def _(t: Tables) -> DataFrame:
    return op.replace_text(t("part"), ["p_name"], r"^(?<first_word>\w+) (\w+)", "$2 of {$<first_word>}", regex=True).result().select("p_partkey", "p_name")


@query(
    "read_ndjson_paths",
    "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '' END AS \"a.s\", CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '' END AS \"items[0].sku\", CASE WHEN o_orderkey % 3 = 1 THEN 'x' || o_custkey ELSE '' END AS \"items[1].sku\", "
    "CASE WHEN o_orderkey % 3 = 2 THEN '1' ELSE '' END AS \"late one\", '' AS _unparsed FROM orders",
)
def _(t: Tables) -> DataFrame:
    """Rows of three shapes; the reader finds their paths."""
    k, sku = F.col("o_orderkey") % 3, lambda c: F.struct(c.alias("sku"))
    line = F.when(k == 0, F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("s")).alias("a"))))
    line = line.when(k == 1, F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.array(sku(F.col("o_orderpriority")), sku(F.concat(say("x"), text("o_custkey")))).alias("items"))))
    return readers.json_lines(lined(t("orders"), line.otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.lit(1).alias("late one")))))).result()


@query("read_prefixed_braces", "SELECT CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'svc[{' || o_custkey || '}]' END AS prefix, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderkey::VARCHAR END AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 'no {json' ELSE '' END AS _unparsed FROM orders")
def _(t: Tables) -> DataFrame:
    line = F.concat(say("svc[{"), text("o_custkey"), say("}] "), F.to_json(F.struct("o_orderkey", "o_orderstatus")))
    return readers.prefixed_json(lined(t("orders"), F.when(F.col("o_orderkey") % 5 == 0, "no {json").otherwise(line)), unparsed=True).result()


@query("read_logfmt_keys", "SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS prio, 'done' AS message FROM orders")
def _(t: Tables) -> DataFrame:
    prio = F.when(F.col("o_orderkey") % 2 == 0, F.concat(say(' prio="'), F.col("o_orderpriority"), say('"'))).otherwise("")
    return readers.logfmt(lined(t("orders"), F.concat(say("id="), text("o_orderkey"), say(" done status="), F.col("o_orderstatus"), prio))).result()


@query("names_with_signs", "SELECT o_custkey AS \"a`b\", max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS \"x`F\", max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS \"x`O\", max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS \"x`P\" FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Backticks, dots and blanks in the names of columns, of keys that become columns too."""
    rows = t("orders").df.select(F.col("o_custkey").alias("a`b"), F.concat(say(" x`"), "o_orderstatus", say(" ")).alias("k.`s"), F.col("o_orderkey").alias("v w"))
    f = op.sort_rows(op.trim(Frame.of(rows, "v w"), ["k.`s"]), ("v w", False, "number"))
    f = op.dedupe(f, ["a`b", "k.`s"])  # the latest order of each
    return op.long_to_wide(f, ["a`b"], "k.`s", "v w").result()


_RECIPE = """
# the flagship recipe, as text
keep rows where "o_totalprice" > 100000
#! delete columns "o_totalprice"
group by "o_orderpriority" calculate "count", "o_totalprice:sum"
sort by "o_totalprice_sum" desc
"""


@query("recipe_text", 'SELECT o_orderpriority, count(*) AS "count", round(sum(o_totalprice), 2) AS o_totalprice_sum, row_number() OVER (ORDER BY sum(o_totalprice) DESC)::BIGINT AS pos FROM orders WHERE o_totalprice > 100000 GROUP BY 1')
def _(t: Tables) -> DataFrame:
    out = recipe_text.run(t("orders"), _RECIPE).frame
    return out.positioned("pos").select("o_orderpriority", "count", F.round("o_totalprice_sum", 2).alias("o_totalprice_sum"), "pos")


_CLEANING = """
# columns, texts, a formula and a join; the step that names no column is passed over
trim *
case upper "p_type"
remove rows where "p_size" < 5 or "p_name" contains "ring"
trim "nothing"
split "p_brand" on "#" into "brand", "no" max 2 drop original
add column "cost" after "p_type" = ROUND([p_retailprice] * 1.15, 1)
join "types" left on "p_type" = "kind" normalize casefold bring "rank"
rename "p_name" -> "name"
keep columns "p_partkey", "name", "no", "cost", "rank"
"""


@query("recipe_steps", "SELECT p_partkey, trim(p_name) AS name, split_part(trim(p_brand), '#', 2) AS no, regexp_replace(printf('%.1f', round(p_retailprice * 1.15 + 1e-9, 1)), '\\.0$', '') AS cost, CASE upper(p_type) WHEN 'ECONOMY' THEN 'low' WHEN 'PROMO' THEN 'top' ELSE '' END AS rank FROM part WHERE NOT (p_size < 5 OR contains(lower(p_name), 'ring'))")
def _(t: Tables) -> DataFrame:
    f = t("part")
    types = Frame.of(f.df.sparkSession.createDataFrame([("Economy", "low"), ("promo", "top")], "kind string, rank string"), "kind")
    return recipe_text.run(f, _CLEANING, {"types": types}).frame.result()
