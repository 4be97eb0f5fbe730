"""Queries that write cells or lines out of the driver's tables, in the shapes an operator is for, and read them again; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import operators as op
from millrace.functions import formulas as fx
from millrace.functions import predicates as pr
from millrace.functions.staging import new_path
from millrace.operators import Frame
from millrace.operators.order_index import OrderIndex
from millrace.plans import insights, pipeline
from millrace.plans.catalog import Tables, query
from millrace.sources import quoted, readers, sinks


def lined(f: Frame, *lines: Column) -> Frame:
    """A Frame of lines: those of each row one after another."""
    keys = [t if isinstance(t, str) else t[0] for t in f.order]
    rows = f.df.select(*[F.col(k).alias(f"__{k}") for k in keys], F.posexplode(F.array(*lines)).alias("__n", "line"))
    return Frame(rows, (*[f"__{k}" for k in keys], "__n"))


def rows_of(f: Frame, rows: list[tuple], schema: str) -> DataFrame:
    return f.df.sparkSession.createDataFrame(rows, schema)


text = lambda c: F.col(c).cast("string")
say = F.lit

# Readers


@query("read_ndjson", "SELECT CASE WHEN bad THEN '' ELSE o_orderkey::VARCHAR END AS o_orderkey, CASE WHEN bad THEN '' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN bad THEN '' ELSE o_orderstatus END AS \"inner.s\", CASE WHEN bad THEN '{broken ' || o_orderkey ELSE '' END AS _unparsed FROM (SELECT *, o_orderkey % 10 = 0 AS bad FROM orders)")
def _(t: Tables) -> DataFrame:
    good = F.to_json(F.struct("o_orderkey", "o_orderpriority", F.struct(F.col("o_orderstatus").alias("s")).alias("inner")))
    return readers.json_lines(lined(t("orders"), F.when(F.col("o_orderkey") % 10 == 0, F.concat(say("{broken "), text("o_orderkey"))).otherwise(good)), ["o_orderkey", "o_orderpriority", "inner.s"]).result()


@query("read_prefixed_json", "SELECT 'svc-' || o_custkey || ' ready' AS prefix, o_orderkey::VARCHAR AS o_orderkey, o_orderstatus FROM orders")
def _(t: Tables) -> DataFrame:
    line = F.concat(say("svc-"), text("o_custkey"), say(" ready "), F.to_json(F.struct("o_orderkey", "o_orderstatus")))
    return readers.prefixed_json(lined(t("orders"), line), ["o_orderkey", "o_orderstatus"]).result()


@query("read_logfmt", "SELECT o_orderkey::VARCHAR AS id, 'a \"' || o_orderpriority || '\" b' AS prio, '' AS none, 'order ' || o_custkey || ' done' AS message FROM orders")
def _(t: Tables) -> DataFrame:
    line = F.concat(say("order id="), text("o_orderkey"), say(" "), text("o_custkey"), say(' prio="a \\"'), F.col("o_orderpriority"), say('\\" b" done'))
    return readers.logfmt(lined(t("orders"), line), ["id", "prio", "none"]).result()


@query(
    "read_access_log",
    "SELECT CASE WHEN bad THEN '' ELSE '10.0.0.' || o_custkey % 200 END AS ip, CASE WHEN bad THEN '' ELSE '10/Oct/2000:13:55:36 +0000' END AS time, CASE WHEN bad THEN '' ELSE 'GET' END AS method, CASE WHEN bad THEN '' ELSE '/o/' || o_orderkey END AS path, "
    "CASE WHEN bad THEN '' ELSE '200' END AS status, CASE WHEN bad THEN '' WHEN o_orderkey % 2 = 0 THEN 'curl/' || o_orderstatus ELSE '' END AS user_agent, CASE WHEN bad THEN 'restarted ' || o_orderkey ELSE '' END AS unparsed FROM (SELECT *, o_orderkey % 9 = 0 AS bad FROM orders)",
)
def _(t: Tables) -> DataFrame:
    head = F.concat(say("10.0.0."), (F.col("o_custkey") % 200).cast("string"), say(' - alice [10/Oct/2000:13:55:36 +0000] "GET /o/'), text("o_orderkey"), say(' HTTP/1.1" 200 17'))
    line = F.when(F.col("o_orderkey") % 9 == 0, F.concat(say("restarted "), text("o_orderkey"))).when(F.col("o_orderkey") % 2 == 0, F.concat(head, say(' "-" "curl/'), F.col("o_orderstatus"), say('"'))).otherwise(head)
    return readers.access_log(lined(t("orders"), line)).result().select("ip", "time", "method", "path", "status", "user_agent", "unparsed")


@query(
    "read_log_lines",
    "SELECT CASE p_partkey % 4 WHEN 0 THEN '2024-01-02 10:00' WHEN 1 THEN '2024/01/02 10:00:07.5' WHEN 2 THEN 'Jan  2 10:00:07' ELSE '10/Oct/2000:13:55:36 +0200' END AS timestamp, CASE p_partkey % 3 WHEN 0 THEN 'ERR' WHEN 1 THEN 'WARNING' ELSE '' END AS level, "
    "'api.core' AS source, p_name || chr(10) || '  at ' || p_brand AS message FROM part",
)
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    stamp = F.when(k % 4 == 0, "2024-01-02 10:00").when(k % 4 == 1, "[2024/01/02 10:00:07.5]").when(k % 4 == 2, "Jan  2 10:00:07").otherwise("[10/Oct/2000:13:55:36 +0200]")
    level = F.when(k % 3 == 0, " [err]").when(k % 3 == 1, " warning:").otherwise("")
    return readers.log_lines(lined(t("part"), F.concat(stamp, level, say(" api.core: "), F.col("p_name")), F.concat(say("  at "), F.col("p_brand")))).result()


@query("read_key_value_blocks", "SELECT s_name AS name, s_suppkey || ' and more' AS code, s_nationkey::VARCHAR AS code_2 FROM supplier")
def _(t: Tables) -> DataFrame:
    f = t("supplier")
    lines = [F.concat(say("name: "), F.col("s_name")), F.concat(say("code:"), text("s_suppkey")), say("  and more"), F.concat(say("code : "), text("s_nationkey"))]
    blank = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("  ")  # records run on until the first key returns, or a blank line comes
    some = lined(f, *lines, F.when(F.col("s_suppkey") % 2 == 0, blank))
    return readers.key_value_blocks(some.with_df(some.df.where("line IS NOT NULL")), ["name", "code", "code_2"]).result()


@query("read_line_blocks", "SELECT n_name AS field_1, 'region ' || n_regionkey AS field_2, 'a b ' || n_nationkey AS field_3 FROM nation")
def _(t: Tables) -> DataFrame:
    return readers.line_blocks(lined(t("nation"), F.col("n_name"), F.concat(say(" region "), text("n_regionkey")), say("a"), say("b"), text("n_nationkey"), say("")), 3).result()


@query("read_fixed_width", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def _(t: Tables) -> DataFrame:
    line = F.concat(F.rpad(text("c_custkey"), 12, " "), F.rpad("c_name", 40, " "), F.col("c_mktsegment"))
    return readers.fixed_width(lined(t("customer"), line), [0, 12, 52], ["id", "name", "segment"]).result()


@query("find_cuts", "SELECT * FROM (VALUES (0), (12), (52)) AS t(cut)")
def _(t: Tables) -> DataFrame:
    """Columns of fixed width found over all lines."""
    f = t("customer")
    line = F.concat(F.rpad(F.repeat(say("7"), 10), 12, " "), F.rpad(F.repeat(say("n"), 38), 40, " "), F.repeat(say("s"), 5))
    return rows_of(f, [(c,) for c in readers.find_cuts(lined(f, line))], "cut int")


@query("read_whitespace_runs", "SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_nationkey::VARCHAR AS nation, '' AS none FROM supplier")
def _(t: Tables) -> DataFrame:
    line = F.concat(text("s_suppkey"), say("   "), F.col("s_name"), say("\t\t"), text("s_nationkey"))
    return readers.whitespace_runs(lined(t("supplier"), line), ["id", "name", "nation", "none"]).result()


@query("read_markdown_table", "SELECT n_name || ' | x' AS name, n_regionkey::VARCHAR AS region FROM nation")
def _(t: Tables) -> DataFrame:
    return readers.markdown_table(lined(t("nation"), F.concat(say("| "), F.col("n_name"), say(" \\| x | "), text("n_regionkey"), say(" |")), say("|---|:-:|"), say("a line between")), ["name", "region"]).result()


@query("read_box_table", "SELECT n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def _(t: Tables) -> DataFrame:
    framed = F.concat(say("| "), F.col("n_name"), say(" | "), text("n_regionkey"), say(" |"))
    bare = F.concat(say(" "), F.col("n_name"), say(" | "), text("n_regionkey"))
    return readers.box_table(lined(t("nation"), F.when(F.col("n_nationkey") % 2 == 0, framed).otherwise(bare), say("+------+---+"), say("(25 rows)")), ["name", "region"]).result()


@query("read_list", "SELECT n_name AS item, CASE WHEN n_nationkey % 3 = 2 THEN '' ELSE 'region ' || n_regionkey END AS detail FROM nation")
def _(t: Tables) -> DataFrame:
    k, where = F.col("n_nationkey"), F.concat(say("region "), text("n_regionkey"))
    line = F.when(k % 3 == 0, F.concat(say("  - "), F.col("n_name"), say(": "), where)).when(k % 3 == 1, F.concat(text("n_nationkey"), say(") "), F.col("n_name"), say(" – "), where)).otherwise(F.concat(say("• "), F.col("n_name")))
    return readers.list_items(lined(t("nation"), line, say("no item")), split=True).result()


@query("read_lines", "SELECT c_name || ' ' || c_custkey AS line, row_number() OVER (ORDER BY c_custkey)::BIGINT AS pos FROM customer")
def _(t: Tables) -> DataFrame:
    """Lines come back in the order they were written in, over several files."""
    f = t("customer")
    path = new_path(f.df.sparkSession, "lines")
    sinks.write_lines(sinks.plain_lines(op.select_columns(f, "c_name", "c_custkey")), path)
    return readers.lines(f.df.sparkSession, path).positioned("pos").select("line", "pos")


@query("read_delimited", "SELECT doc_id::VARCHAR AS doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text, coalesce(source, '') AS source FROM documents")
def _(t: Tables) -> DataFrame:
    """Whole documents, with quotes and line breaks in them, written as CSV and read again."""
    f = op.select_columns(t("documents"), "doc_id", "text", "source")
    path = new_path(f.df.sparkSession, "csv")
    sinks.write_csv(f, path)
    return readers.delimited(f.df.sparkSession, path).result()


@query("read_delimited_ranges", "SELECT doc_id::VARCHAR AS doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS text, coalesce(source, '') AS source FROM documents")
def _(t: Tables) -> DataFrame:
    """Whole documents as CSV again, each file read by as many tasks as it has ranges, although texts have line breaks."""
    f = op.select_columns(t("documents"), "doc_id", "text", "source")
    path = new_path(f.df.sparkSession, "csv")
    sinks.write_csv(f, path)
    return quoted.delimited_ranges(f.df.sparkSession, path)[0].result()


@query(
    "read_unclosed_quotes",
    "SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN (o_orderkey // 100) % 2 = 0 THEN '\"' || o_orderpriority || '\"' ELSE o_orderpriority END AS prio FROM orders "
    "UNION ALL SELECT DISTINCT '-' || (o_orderkey // 100), '\"never' FROM orders WHERE (o_orderkey // 100) % 2 = 0",
)
def _(t: Tables) -> DataFrame:
    """Hundreds of orders, every other one with a quote at its end that never closes. Those are in files of their own, which keep their quotes as text, and all their rows. A file takes its hundreds of 10,000 orders, so that files keep their size."""
    f = t("orders")
    rows = f.df.select(F.expr("o_orderkey div 100").alias("bucket"), F.lit(0).alias("last"), "o_orderkey", F.concat(text("o_orderkey"), say(',"'), F.col("o_orderpriority"), say('"')).alias("value"))
    ends = rows.where("bucket % 2 = 0").select("bucket", F.lit(1).alias("last"), F.lit(0).cast("long").alias("o_orderkey"), F.concat(say("-"), F.col("bucket").cast("string"), say(',"never')).alias("value")).distinct()
    path = new_path(f.df.sparkSession, "unclosed")
    # A quote left open is shut by the next hundred's first row, the last one by none.
    placed = rows.unionByName(ends).withColumns({"part": F.expr("bucket div 100"), "odd": F.col("bucket") % 2})
    placed.repartition("part", "odd").sortWithinPartitions("part", "odd", "bucket", "last", "o_orderkey").select("part", "odd", "value").write.partitionBy("part", "odd").text(path)
    return quoted.delimited_ranges(f.df.sparkSession, path, header=False)[0].df.selectExpr("column_1 AS o_orderkey", "column_2 AS prio")


@query(
    "html_tables_planted",
    'WITH c(row, col, header, k) AS (VALUES (0, 0, true, 0), (0, 1, true, 1), (1, 0, false, 2), (1, 1, false, 3), (2, 0, false, 4), (2, 1, false, 5)) '
    "SELECT page_id AS page, row, col, header, CASE k WHEN 0 THEN 'page' WHEN 1 THEN 'n' WHEN 2 THEN 'p ' || page_id WHEN 3 THEN '1' WHEN 4 THEN 'p ' || page_id ELSE '2 & more' END AS value FROM pages, c",
)
def _(t: Tables) -> DataFrame:
    f = t("pages")
    table = F.concat(say("<table><tr><th>page<th>n</tr><tr><td rowspan=2>p\n "), text("page_id"), say("</td><td>1</td></tr><tr><td>2 &amp; <b>more</b></td></tr></table>"))
    return readers.html_tables(f.df.select("page_id", F.concat(table, F.coalesce("html", say(""))).alias("html"))).where("table = 0").drop("table")


# Sinks


@query("sink_json", "SELECT '{\"n_nationkey\":\"' || n_nationkey || '\",\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def _(t: Tables) -> DataFrame:
    return sinks.json_rows(op.select_columns(t("nation"), "n_nationkey", "n_name"))


@query("sink_jsoncols", "SELECT 'r_regionkey' AS \"column\", '[\"' || string_agg(r_regionkey::VARCHAR, '\",\"' ORDER BY r_regionkey) || '\"]' AS \"values\" FROM region UNION ALL SELECT 'r_name', '[\"' || string_agg(r_name, '\",\"' ORDER BY r_regionkey) || '\"]' FROM region")
def _(t: Tables) -> DataFrame:
    return sinks.columns_json(op.select_columns(t("region"), "r_regionkey", "r_name"))


@query("sink_plain_lines", "SELECT s_suppkey || ' ' || s_name AS value FROM supplier")
def _(t: Tables) -> DataFrame:
    return sinks.plain_lines(op.select_columns(t("supplier"), "s_suppkey", "s_name"))


@query("sink_size", "SELECT sum(strlen(text) + 1)::BIGINT AS bytes FROM documents WHERE text IS NOT NULL")
def _(t: Tables) -> DataFrame:
    f = op.select_columns(t("documents"), "text")
    lines = sinks.plain_lines(f.with_df(f.df.where("text IS NOT NULL")))
    return lines.agg(sinks.size_bytes(lines).alias("bytes"))


@query("sink_csv_guarded", "SELECT 'id,cell' AS value UNION ALL SELECT s_suppkey || ',' || CASE s_suppkey % 4 WHEN 0 THEN '''=1+' || s_suppkey WHEN 1 THEN '-5' WHEN 2 THEN '\"a, \"\"b\"\"\"' ELSE s_name END FROM supplier")
def _(t: Tables) -> DataFrame:
    f, k = t("supplier"), F.col("s_suppkey")
    cell = F.when(k % 4 == 0, F.concat(say("=1+"), text("s_suppkey"))).when(k % 4 == 1, "-5").when(k % 4 == 2, 'a, "b"').otherwise(F.col("s_name"))
    return sinks.csv_lines(op.select_columns(op.rename(op.add_column(f, "cell", cell), "s_suppkey", "id"), "id", "cell"), guard=True)


# Filters


def cells(f: Frame, name: str, value: Column) -> Frame:
    """f with a column of cells as people type them."""
    return op.add_column(f, name, value)


AMOUNT = "CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 13 = 0 THEN 'n/a' END"


def amounts(t: Tables) -> Frame:
    """orders with their price as text: $1,234.50 or (1,234.50), some blank or unreadable."""
    f, k = t("orders"), F.col("o_orderkey")
    shown = F.concat(say("$"), F.format_number("o_totalprice", 2))
    return cells(f, "amount", F.when(k % 11 == 0, " ").when(k % 13 == 0, "n/a").when(k % 2 == 0, F.concat(say("("), shown, say(")"))).otherwise(shown))


READ = "CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END"


@query("filter_text_numbers", f"SELECT o_orderkey FROM orders WHERE {READ} > 100000")
def _(t: Tables) -> DataFrame:
    f = amounts(t)
    return op.filter_rows(f, pr.leaf(f.df, "amount", "gt", "$100,000")).result().select("o_orderkey")


@query("filter_text_between", f"SELECT o_orderkey FROM orders WHERE {READ} BETWEEN -20000 AND 100000")
def _(t: Tables) -> DataFrame:
    f = amounts(t)
    return op.filter_rows(f, pr.leaf(f.df, "amount", "between", "100000", "(20,000)")).result().select("o_orderkey")


@query("filter_text_ne", f"SELECT o_orderkey FROM orders WHERE coalesce({READ} <> -5, true)")
def _(t: Tables) -> DataFrame:
    f = amounts(t)
    return op.filter_rows(f, pr.leaf(f.df, "amount", "ne", "-5")).result().select("o_orderkey")


@query("filter_eq_falls_back", "SELECT o_orderkey FROM orders WHERE lower(trim(o_orderpriority)) = '1-urgent'")
def _(t: Tables) -> DataFrame:
    f = t("orders")
    return op.filter_rows(f, pr.leaf(f.df, "o_orderpriority", "eq", "1-Urgent")).result().select("o_orderkey")


@query("filter_text_dates", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-02-03'")
def _(t: Tables) -> DataFrame:
    f = t("orders")
    f = cells(f, "day", F.date_format("o_orderdate", "M/d/yyyy"))
    return op.filter_rows(f, pr.leaf(f.df, "day", "gte", "2/3/1997")).result().select("o_orderkey")


@query("filter_eu_numbers", "SELECT o_orderkey FROM orders WHERE round(o_totalprice, 2) < 1234.5 * 100")
def _(t: Tables) -> DataFrame:
    """The number format is found from the column."""
    f = t("orders")
    f = cells(f, "betrag", F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    return op.filter_rows(f, pr.leaf(f.df, "betrag", "lt", "123.450,00")).result().select("o_orderkey")


BLANK = "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' || chr(9) ELSE event_type END"


def blanks(t: Tables) -> Frame:
    f, k = t("events"), F.col("event_id")
    return cells(f, "note", F.when(k % 3 == 1, "  \t").when(k % 3 == 2, F.col("event_type")))


@query("filter_empty", "SELECT event_id FROM events WHERE event_id % 3 <> 2")
def _(t: Tables) -> DataFrame:
    f = blanks(t)
    return op.filter_rows(f, pr.leaf(f.df, "note", "isEmpty")).result().select("event_id")


@query("filter_not_empty", "SELECT event_id FROM events WHERE event_id % 3 = 2")
def _(t: Tables) -> DataFrame:
    f = blanks(t)
    return op.filter_rows(f, pr.leaf(f.df, "note", "isNotEmpty")).result().select("event_id")


@query("filter_any_number", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49 OR l_discount > 49 OR l_tax > 49")
def _(t: Tables) -> DataFrame:
    f = t("lineitem")
    return op.filter_rows(f, pr.leaf(f.df.select("l_quantity", "l_discount", "l_tax", "l_returnflag"), "*", "gt", 49)).result().select("l_orderkey", "l_linenumber")


@query("filter_none_contains", "SELECT p_partkey FROM part WHERE NOT (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))")
def _(t: Tables) -> DataFrame:
    f = t("part")
    return op.filter_rows(f, pr.leaf(f.df.select("p_name", "p_type"), "*", "notContains", "Ring")).result().select("p_partkey")


@query("filter_row_text", "SELECT n_nationkey FROM nation WHERE regexp_matches(n_name || ' ' || n_regionkey, '_1[0-9]* [12]$')")
def _(t: Tables) -> DataFrame:
    f = t("nation")
    return op.filter_rows(f, pr.row_text(f.df.select("n_name", "n_regionkey")).rlike(r"_1[0-9]* [12]\z")).result().select("n_nationkey")


@query("filter_formula", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000 AND l_quantity - 7 * floor(l_quantity / 7) = 3")
def _(t: Tables) -> DataFrame:
    f = t("lineitem")
    condition = fx.And(F.col("l_extendedprice") * (1 - F.col("l_discount")) > 50000, fx.mod(F.col("l_quantity"), 7.0) == 3)
    return op.filter_rows(f, condition).result().select("l_orderkey", "l_linenumber")


# Rows and cells


@query("keep_rows", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(t: Tables) -> DataFrame:
    return op.remove_rows(t("supplier"), t("nation").df.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey")), ["s_nationkey"], keep=True).result().select("s_suppkey")


@query("drop_empty_rows_planted", "SELECT event_id FROM events WHERE event_id % 3 = 2 OR event_id % 2 = 0")
def _(t: Tables) -> DataFrame:
    f = blanks(t)
    f = cells(f, "other", F.when(F.col("event_id") % 2 == 0, "x").otherwise(" "))
    return op.drop_empty_rows(f, ["note", "other"]).result().select("event_id")


@query("dedupe_null_order", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) rn FROM orders) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    f = op.sort_rows(cells(t("orders"), "rated", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice"))), ("rated", False, "number"))
    return op.dedupe(f, ["o_custkey"]).result().select("o_custkey", "o_orderkey")


@query("remove_repeated_headers_planted", "SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation WHERE n_nationkey % 4 <> 1")
def _(t: Tables) -> DataFrame:
    f, head = t("nation"), F.col("n_nationkey") % 4 == 1
    f = f.select(F.when(head, " ID").otherwise(text("n_nationkey")).alias("id"), F.when(head, "Name ").otherwise(F.col("n_name")).alias("name"))
    return op.remove_repeated_headers(f).result()


@query("promote_header", "SELECT n_nationkey::VARCHAR AS \"0\", n_name AS NATION_0 FROM nation WHERE n_nationkey > 0")
def _(t: Tables) -> DataFrame:
    return op.promote_header(t("nation").select(text("n_nationkey").alias("a"), F.col("n_name").alias("b"))).result()


@query("sort_text_falling", "SELECT o_orderpriority, arg_min(o_orderkey, (o_orderkey % 1000, -o_orderkey)) AS o_orderkey_first, count(*) AS \"count\" FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    f = cells(t("orders"), "code", F.translate(F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), "0123456789", "9876543210"))
    f = Frame(f.df, (("code", False), ("o_orderkey", False)))
    return op.aggregate(f, ["o_orderpriority"], [("o_orderkey", "first"), "count"]).result()


@query("positions_of_two_values", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderkey)::BIGINT AS pos FROM orders")
def _(t: Tables) -> DataFrame:
    """A first term of three values is cut by the terms after it."""
    f = t("orders")
    return Frame(f.df, (("o_orderstatus", False), "o_orderkey")).positioned("pos").select("o_orderkey", "pos")


@query("clean_text_planted", "SELECT p_partkey, p_name || ' \"' || p_brand || '\"''s' AS p_name FROM part")
def _(t: Tables) -> DataFrame:
    f = cells(t("part"), "cell", F.concat(F.col("p_name"), say(" “"), F.col("p_brand"), say("​”’s\u0007﻿")))
    return op.rename(op.drop_columns(op.clean_text(f, ["cell"]), "p_name"), "cell", "p_name").result().select("p_partkey", "p_name")


@query("convert_numbers_text", f"SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE regexp_replace(({READ})::DECIMAL(20,2)::VARCHAR, '\\.?0+$', '') END AS amount FROM orders")
def _(t: Tables) -> DataFrame:
    return op.convert_numbers(amounts(t), "amount").result().select("o_orderkey", "amount")


@query("convert_dates_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def _(t: Tables) -> DataFrame:
    f, k, d = t("orders"), F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(k % 5 == 0, "soon").when(k % 5 == 1, F.date_format(d, "MMM d, yyyy")).when(k % 5 == 2, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy.M.d"))
    return op.normalize_dates(cells(f, "day", written), "day").result().select("o_orderkey", "day")


@query("fill_blank_planted", f"SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN 'unknown' ELSE {BLANK} END AS note FROM events")
def _(t: Tables) -> DataFrame:
    return op.fill_blank(blanks(t), ["note"], "unknown").result().select("event_id", "note")


@query("case_title", "SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' O''Brien-Ma' AS name FROM customer")
def _(t: Tables) -> DataFrame:
    return op.change_case(cells(t("customer"), "name", F.concat(F.lower("c_mktsegment"), say(" o'brien-MA"))), ["name"], "title").result().select("c_custkey", "name")


@query("trim_outer", "SELECT n_nationkey, n_name || '  x' AS name FROM nation")
def _(t: Tables) -> DataFrame:
    return op.trim(cells(t("nation"), "name", F.concat(say("　 \t"), F.col("n_name"), say("  x \n"))), ["name"], inner=False).result().select("n_nationkey", "name")


@query("split_to_rows_planted", "SELECT n_nationkey, unnest(CASE n_nationkey % 3 WHEN 0 THEN [n_name, 'b'] WHEN 1 THEN [''] ELSE [n_name] END) AS piece FROM nation")
def _(t: Tables) -> DataFrame:
    """A row without a piece stays, with an empty cell."""
    k = F.col("n_nationkey")
    f = cells(t("nation"), "piece", F.when(k % 3 == 0, F.concat(F.col("n_name"), say(" ; ; b;"))).when(k % 3 == 1, F.when(k % 2 == 0, " ; ;")).otherwise(F.concat(say(";"), F.col("n_name"))))
    return op.split_to_rows(f, "piece", ";").result().select("n_nationkey", "piece")


# Reshaping


@query("aggregate_eu_numbers", "SELECT o_orderpriority, round(sum(round(o_totalprice, 2)), 2) AS total, max(round(o_totalprice, 2)) AS most FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    f = cells(t("orders"), "betrag", F.concat(F.translate(F.format_number("o_totalprice", 2), ",.", ".,"), say(" €")))
    return op.aggregate(f, ["o_orderpriority"], [("betrag", "sum"), ("betrag", "max")]).result().select("o_orderpriority", F.round("betrag_sum", 2).alias("total"), F.col("betrag_max").alias("most"))


@query("extract_presets", "SELECT c_custkey, 'c' || c_custkey || '+x@mail.example.org' AS email, 'www.example.org/' || c_custkey AS url, '-$1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '.50' AS number, 'Mar 5, 2024' AS date, '#seg-' || c_custkey AS hashtag, '10.0.0.' || c_custkey % 256 AS ip FROM customer")
def _(t: Tables) -> DataFrame:
    f, k = t("customer"), text("c_custkey")
    parts = {
        "email": F.concat(say("c"), k, say("+x@mail.example.org")), "url": F.concat(say("www.example.org/"), k), "number": F.concat(say("-$1,"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), say(".50")),
        "date": say("Mar 5, 2024"), "hashtag": F.concat(say("#seg-"), k), "ip": F.concat(say("10.0.0."), (F.col("c_custkey") % 256).cast("string")),
    }
    for name, value in parts.items():
        f = op.extract(cells(f, f"in_{name}", F.concat(say("see "), value, say(" there"))), f"in_{name}", name, preset=name)
    return f.result().select("c_custkey", *parts)


@query("extract_named_group", "SELECT c_custkey, regexp_extract(c_name, '#0*(\\d+)', 1) AS n, regexp_extract(c_name, '[(]?Customer') AS word FROM customer")
def _(t: Tables) -> DataFrame:
    f = op.extract(t("customer"), "c_name", "n", pattern=r"#0*(?<n>\d+)")
    return op.extract(f, "c_name", "word", pattern=r"[(]?Customer").result().select("c_custkey", "n", "word")


# Formulas


@query(
    "formula_text_formats",
    "SELECT c_custkey, CASE WHEN x < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(x)) AS money, lpad((c_custkey % 1000)::VARCHAR, 5, '0') AS padded, "
    "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '.' || rtrim((c_custkey % 4 * 25)::VARCHAR, '0') END AS short, c_custkey % 4 * 25 || '.0% of it' AS share, '05 Mar, Tue' AS day "
    "FROM (SELECT *, round(c_acctbal, 2) AS x FROM customer)",
)
def _(t: Tables) -> DataFrame:
    k, quarter, day = F.col("c_custkey"), F.col("c_custkey") % 4 / 4, F.lit("2024-03-05").cast("date")
    return t("customer").df.select("c_custkey", fx.text(F.col("c_acctbal"), "$#,##0.00").alias("money"), fx.text(k % 1000, "00000").alias("padded"), fx.text(quarter, "#.##").alias("short"), fx.text(quarter, '0.0%" of it"').alias("share"), fx.text(day, "dd mmm, ddd").alias("day"))


# Insights


@query("histogram_days", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), e AS (SELECT min(d) AS lo, greatest(1, ceil((max(d) - min(d) + 1) / 20))::BIGINT AS w FROM d) SELECT ((d - lo) // w)::BIGINT AS bin, lo + ((d - lo) // w * w)::INT AS low, count(*) AS n FROM d, e GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return insights.date_histogram(t("orders"), "o_orderdate").select("bin", "low", "n")


@query("infer_types", "SELECT * FROM (VALUES ('amount', 'number', 'us'), ('betrag', 'number', 'eu'), ('day', 'date', 'us'), ('o_orderpriority', 'text', 'us')) AS t(\"column\", kind, locale)")
def _(t: Tables) -> DataFrame:
    f = cells(cells(t("orders"), "amount", F.concat(say("$"), F.format_number("o_totalprice", 2))), "betrag", F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    f = op.select_columns(cells(f, "day", F.date_format("o_orderdate", "MMM d, yyyy")), "amount", "betrag", "day", "o_orderpriority")
    return rows_of(f, [(c, *kind) for c, kind in insights.inferred(f).items()], "column string, kind string, locale string")


@query("top_values", "SELECT trim(l_shipmode) AS value, count(*) AS n FROM (SELECT CAST(CAST(l_quantity AS INT) AS VARCHAR) AS l_shipmode FROM lineitem) GROUP BY 1 ORDER BY n DESC, lpad(value, 40, '0') LIMIT 6")
def _(t: Tables) -> DataFrame:
    f = t("lineitem")
    return insights.top_values(cells(f, "q", F.col("l_quantity").cast("int").cast("string")), "q")


@query("page", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def _(t: Tables) -> DataFrame:
    return op.sort_rows(op.select_columns(t("customer"), "c_custkey", "c_name", "c_acctbal"), ("c_acctbal", False)).page(40, 20).select("c_custkey", "c_name")


_PLACES = "WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders)"


@query("index_page", f"{_PLACES} SELECT o_orderkey, o_totalprice FROM o WHERE pos BETWEEN (SELECT count(*) // 2 FROM orders) AND (SELECT count(*) // 2 + 24 FROM orders)")
def _(t: Tables) -> DataFrame:
    """A page from the middle of the orders by falling price, out of the index of their order."""
    index = OrderIndex.of(Frame(t("orders").df.select("o_orderkey", "o_totalprice"), (("o_totalprice", False), "o_orderkey")))
    return index.page(len(index) // 2, 25)


@query(
    "index_find",
    f"{_PLACES}, h AS (SELECT pos FROM o WHERE o_orderpriority = '1-URGENT'), a AS (SELECT unnest([-1, 10, 100, (SELECT count(*) - 1 FROM orders)]) AS after) "
    "SELECT after, coalesce((SELECT min(pos) FROM h WHERE pos > after), (SELECT min(pos) FROM h)) AS next, coalesce((SELECT max(pos) FROM h WHERE pos < after), (SELECT max(pos) FROM h)) AS previous FROM a",
)
def _(t: Tables) -> DataFrame:
    """The places of the next urgent order and of the one before, from several places on, around the table's ends."""
    index = OrderIndex.of(Frame(t("orders").df.select("o_orderkey", "o_orderpriority", "o_totalprice"), (("o_totalprice", False), "o_orderkey")))
    hit = F.col("o_orderpriority") == "1-URGENT"
    rows = [(k, index.find(hit, k), index.find(hit, k, back=True)) for k in (-1, 10, 100, len(index) - 1)]
    return t("orders").df.sparkSession.createDataFrame(rows, "after long, next long, previous long")


@query("case_variants", "SELECT lower(n_name) AS folded, 2::BIGINT AS variants, 2::BIGINT AS n FROM nation")
def _(t: Tables) -> DataFrame:
    f = op.split_to_rows(cells(t("nation"), "v", F.concat(F.col("n_name"), say(";"), F.lower("n_name"))), "v", ";")
    return insights.case_variants(f, "v")


@query("changed_cells", "SELECT 'n_name' AS \"column\", count(*) FILTER (n_nationkey % 5 = 0) AS n FROM nation UNION ALL SELECT 'n_regionkey', 0 FROM (SELECT 1)")
def _(t: Tables) -> DataFrame:
    f = t("nation")
    after = f.df.withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, "x").otherwise(F.col("n_name")))
    return insights.changed_cells(f.df, after, "n_nationkey")


@query("like_these", "SELECT 'o_orderstatus' AS \"column\", 'P' AS value, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS chosen, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT') AS others FROM orders UNION ALL SELECT 'o_orderpriority', '1-URGENT', count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), count(*) FILTER (o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT') FROM orders")
def _(t: Tables) -> DataFrame:
    f = t("orders")
    chosen = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    return rows_of(f, insights.like_these(f, chosen, ["o_orderstatus", "o_orderpriority"]), "column string, value string, chosen long, others long")


@query("drift", "SELECT * FROM (VALUES ('added', 'extra', ''), ('missing', 'n_name', ''), ('newValue', 'kind', 'b'), ('range', 'n_nationkey', '0 to 34')) AS t(kind, \"column\", detail)")
def _(t: Tables) -> DataFrame:
    f = cells(t("nation"), "kind", say("a"))
    new = f.df.withColumns({"n_nationkey": F.when(F.col("n_nationkey") == 24, 34).otherwise(F.col("n_nationkey")), "kind": F.when(F.col("n_nationkey") == 24, "b").otherwise("a"), "extra": say("x")}).drop("n_name")
    found = insights.drift(insights.contract(f), insights.contract(Frame(new, ("n_nationkey",))))
    return rows_of(f, found, "kind string, column string, detail string")


@query("lineage", "SELECT 'input' AS step, n_name AS cell FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'upper', upper(n_name) FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'lower', lower(n_name) FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'bad', lower(n_name) FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'gone', NULL")
def _(t: Tables) -> DataFrame:
    """A recipe run step by step: muted and failing steps pass their input through, and a row is followed through all states."""
    f = t("nation")
    steps = [
        pipeline.Step("upper", lambda x: op.change_case(x, ["n_name"], "upper")), pipeline.Step("lower", lambda x: op.change_case(x, ["n_name"], "lower")),
        pipeline.Step("bad", lambda x: op.rename(x, "n_name", "n_regionkey")), pipeline.Step("gone", lambda x: op.drop_columns(x, "n_name")),
    ]
    done = pipeline.run(f, steps)
    assert list(done.errors) == ["bad"]
    return rows_of(f, insights.lineage(done.states, "n_nationkey", 7, "n_name"), "step string, cell string")


@query(
    "issues_planted",
    "WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 50 = 3) AS bad, count(*) FILTER (o_orderkey % 10 = 1) AS iso, count(*) FILTER (o_orderkey % 7 = 2) AS wide, count(*) FILTER (o_orderkey % 6 = 5) AS nbsp, "
    "count(*) FILTER (day(o_orderdate) < 13 AND day(o_orderdate) <> month(o_orderdate) AND o_orderkey % 10 <> 1) AS ambiguous, count(DISTINCT o_orderpriority) AS kinds FROM orders) "
    "SELECT kind, \"column\", n, severity FROM (SELECT unnest([{'kind': 'numText', 'column': 'amount', 'n': n - bad, 'severity': 'low'}, {'kind': 'notNumber', 'column': 'amount', 'n': bad, 'severity': 'medium'}, {'kind': 'dates', 'column': 'day', 'n': n, 'severity': 'low'}, "
    "{'kind': 'mixedDates', 'column': 'day', 'n': iso, 'severity': 'medium'}, {'kind': 'ambiguousDates', 'column': 'day', 'n': ambiguous, 'severity': 'low'}, {'kind': 'whitespace', 'column': 'note', 'n': wide, 'severity': 'low'}, {'kind': 'invisible', 'column': 'note', 'n': nbsp, 'severity': 'medium'}, "
    "{'kind': 'caseVariants', 'column': 'o_orderpriority', 'n': kinds, 'severity': 'low'}, {'kind': 'emptyCols', 'column': 'none', 'n': 1, 'severity': 'low'}, {'kind': 'structured', 'column': 'props', 'n': n, 'severity': 'low'}], recursive := true) FROM n)",
)
def _(t: Tables) -> DataFrame:
    f, k, d = t("orders"), F.col("o_orderkey"), F.col("o_orderdate")
    note = F.concat(say("n"), F.when(k % 7 == 2, "  ").otherwise(" "), text("o_orderkey"), F.when(k % 6 == 5, "\u00a0x").otherwise(""))
    f = cells(cells(f, "amount", F.when(k % 50 == 3, "n/a").otherwise(F.concat(say("$"), F.format_number("o_totalprice", 2)))), "day", F.when(k % 10 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MM/dd/yyyy")))
    f = cells(cells(cells(f, "note", note), "none", say(" ")), "props", F.to_json(F.struct("o_orderkey")))
    f = f.rewritten({"o_orderpriority": F.when(k % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))})
    return insights.issues(op.select_columns(f, "o_orderkey", "amount", "day", "note", "none", "props", "o_orderpriority"))


@query("issues_junk_rows", "SELECT * FROM (VALUES ('totals', '', 5, 'high'), ('repeatedHeader', '', 5, 'high'), ('artifacts', '', 10, 'medium'), ('emptyRows', '', 5, 'medium'), ('duplicates', '', 20, 'medium')) AS t(kind, \"column\", n, severity)")
def _(t: Tables) -> DataFrame:
    f = t("region")
    lines = [F.concat(say("x"), F.col("r_name")), say("total 12"), say("NAME"), say("Page 2 of 9"), say("-----"), say(" ")]
    return insights.issues(lined(f, *lines).select(F.col("line").alias("name")))


@query("structure_spaces", "SELECT c_custkey, c_name AS c_line_1, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS c_line_2 FROM customer")
def _(t: Tables) -> DataFrame:
    line = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", say("   "), F.col("c_mktsegment"), say(" ")))
    return op.structure_spaces(cells(t("customer"), "c_line", line), "c_line").result().select("c_custkey", "c_line_1", "c_line_2")


@query("structure_delimited", "SELECT o_orderkey, o_orderstatus AS status, '\"' || o_orderpriority AS line_2, '\"' AS line_3 FROM orders")
def _(t: Tables) -> DataFrame:
    line = F.concat(F.col("o_orderstatus"), say(' , "'), F.col("o_orderpriority"), say(',"'))
    return op.structure_delimited(cells(t("orders"), "line", line), "line", ",", ["status"]).result().select("o_orderkey", "status", "line_2", "line_3")


@query("structure_key_values", "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority || ', soon' AS prio, o_custkey::VARCHAR AS prio_2, '' AS none, 'checked' AS text FROM orders")
def _(t: Tables) -> DataFrame:
    line = F.concat(say("status: "), F.col("o_orderstatus"), say(", prio:"), F.col("o_orderpriority"), say(", soon; checked | prio : "), text("o_custkey"))
    return op.structure_key_values(cells(t("orders"), "line", line), "line", ["status", "prio", "prio_2", "none"]).result().select("o_orderkey", "status", "prio", "prio_2", "none", "text")


@query("structure_json_unparsed", "SELECT o_orderkey, CASE WHEN bad THEN '' ELSE o_orderstatus END AS s, CASE WHEN bad THEN '{' || o_orderkey ELSE '' END AS _unparsed FROM (SELECT *, o_orderkey % 4 = 0 AS bad FROM orders)")
def _(t: Tables) -> DataFrame:
    line = F.when(F.col("o_orderkey") % 4 == 0, F.concat(say("{"), text("o_orderkey"))).otherwise(F.to_json(F.struct(F.col("o_orderstatus").alias("s"))))
    return op.structure_json(cells(t("orders"), "line", line), "line", ["s"], unparsed=True).result().select("o_orderkey", "s", "_unparsed")


@query("read_json_document", "SELECT n_nationkey::VARCHAR AS k, coalesce(n_name, '') AS \"in.name\", '[\"' || n_regionkey || '\"]' AS \"in.regions\" FROM nation")
def _(t: Tables) -> DataFrame:
    record = F.struct(F.col("n_nationkey").alias("k"), F.struct(F.col("n_name").alias("name"), F.array("n_regionkey").alias("regions")).alias("in"))
    path = new_path(t("nation").df.sparkSession, "json-document")  # 25 nations: one small document
    document = F.struct(F.lit(2).alias("version"), F.array(F.struct(F.lit(1).alias("x"))).alias("short"), F.collect_list(record).alias("rows"))
    t("nation").df.agg(F.to_json(document).alias("value")).write.text(path)
    return readers.json_document(t("nation").df.sparkSession, path).result()


@query("distinct_search", "SELECT trim(coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_type END, '')) AS value, count(*) AS n FROM part WHERE p_size > 10 AND (p_partkey % 7 = 0 OR lower(p_type) LIKE '%ar%') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    f = cells(t("part"), "v", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")))
    return insights.distinct_values(f, "v", "AR", F.col("p_size") > 10, blanks=True)


@query(
    "rules_like",
    "WITH c AS (SELECT *, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_custkey <= 50 AS chosen FROM orders), m AS (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi, count(*) AS k FROM c WHERE chosen) "
    "SELECT 'o_custkey lte ' || hi || ' and o_orderstatus equals f' AS rule, k AS chosen, (SELECT count(*) FROM c WHERE NOT chosen AND o_custkey <= hi AND o_orderstatus = 'F') AS others FROM m",
)
def _(t: Tables) -> DataFrame:
    f = t("orders")
    chosen = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0) & (F.col("o_custkey") <= 50)
    return rows_of(f, insights.rules_like(f, chosen, ["o_orderstatus", "o_custkey"], 1), "rule string, chosen long, others long")
