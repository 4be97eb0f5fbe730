"""The library's queries over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import operators as op
from millrace.functions import formulas as fx
from millrace.functions import predicates as pr
from millrace.functions import values as v
from millrace.operators import Frame
from millrace.plans import insights
from millrace.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",), "documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn"), "labels": ("doc_id",), "benchmark": ("item_id",),
}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: Frame.of(spark.read.parquet(f"{sf_dir}/{t}.parquet"), *KEYS[t]))
        if sql:
            SQL[name] = sql
        return f

    return add


Tables = Callable[[str], Frame]

# Rows


@query("filter_cmp_in", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 100000 AND lower(trim(o_orderpriority)) IN ('1-urgent','5-low')")
def _(t: Tables) -> DataFrame:
    f = t("orders")
    return op.filter_rows(f, pr.leaf(f.df, "o_totalprice", "gt", 100000) & pr.leaf(f.df, "o_orderpriority", "in", values=["1-URGENT", "5-LOW"])).result().select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("filter_tree", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (lower(trim(o_orderstatus))='p' OR lower(trim(o_orderstatus))='f') AND NOT (o_totalprice < 100000)")
def _(t: Tables) -> DataFrame:
    f = t("orders")
    tree = pr.all_of(pr.any_of(pr.leaf(f.df, "o_orderstatus", "equals", "P"), pr.leaf(f.df, "o_orderstatus", "equals", "F")), ~pr.leaf(f.df, "o_totalprice", "lt", 100000))
    return op.filter_rows(f, tree).result().select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("filter_any_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name),'ring') OR contains(lower(p_brand),'ring') OR contains(lower(p_type),'ring')")
def _(t: Tables) -> DataFrame:
    f = t("part")
    return op.filter_rows(f, pr.words_anywhere(f.df.select("p_name", "p_brand", "p_type"), "ring")).result().select("p_partkey", "p_name")


@query("filter_date_between", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'")
def _(t: Tables) -> DataFrame:
    f = t("orders")
    return op.filter_rows(f, pr.leaf(f.df, "o_orderdate", "between", "1998-03-31", "1998-01-01")).result().select("o_orderkey")


@query("filter_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name,'^small .*ring$','i')")
def _(t: Tables) -> DataFrame:
    f = t("part")
    return op.filter_rows(f, pr.leaf(f.df, "p_name", "matches", r"^small .*ring\z")).result().select("p_partkey", "p_name")


@query("filter_whole_word", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text),'(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])')")
def _(t: Tables) -> DataFrame:
    f = t("documents")
    return op.filter_rows(f, pr.leaf(f.df, "text", "wholeWord", "the")).result().select("doc_id")


@query("filter_starts_ends", "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(trim(p_name)),'s') AND NOT ends_with(lower(trim(p_name)),'g')")
def _(t: Tables) -> DataFrame:
    f = t("part")
    return op.filter_rows(f, pr.leaf(f.df, "p_name", "startsWith", "S") & ~pr.leaf(f.df, "p_name", "endsWith", "G")).result().select("p_partkey", "p_name")


@query("filter_not_equal_number", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE coalesce(l_quantity <> 10, true) AND l_discount <= 0.02")
def _(t: Tables) -> DataFrame:
    f = t("lineitem")
    return op.filter_rows(f, pr.leaf(f.df, "l_quantity", "ne", 10) & pr.leaf(f.df, "l_discount", "lte", 0.02)).result().select("l_orderkey", "l_linenumber")


@query("filter_above_average", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT round(avg(c_acctbal)*1e10)/1e10 FROM customer)")
def _(t: Tables) -> DataFrame:
    return pr.around_average(t("customer").df, "c_acctbal").select("c_custkey", "c_acctbal")


@query("filter_top_n_ties", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT min(v) FROM (SELECT o_totalprice v FROM orders ORDER BY v DESC LIMIT 10))")
def _(t: Tables) -> DataFrame:
    return pr.top_n(t("orders").df, "o_totalprice", 10).select("o_orderkey", "o_totalprice")


@query("filter_last_month", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-05-01' AND CAST(o_orderdate AS DATE) < DATE '1997-06-01'")
def _(t: Tables) -> DataFrame:
    f = t("orders")
    return op.filter_rows(f, pr.period(f.col("o_orderdate"), "lastMonth", F.lit("1997-06-17"))).result().select("o_orderkey")


@query("dedupe_keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders) WHERE rn=1")
def _(t: Tables) -> DataFrame:
    return op.dedupe(op.select_columns(t("orders"), "o_custkey", "o_orderkey"), ["o_custkey"]).result()


@query("dedupe_keep_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(t: Tables) -> DataFrame:
    return op.dedupe(op.select_columns(t("orders"), "o_custkey", "o_orderkey"), ["o_custkey"], keep="last").result()


@query("remove_and_keep_rows", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def _(t: Tables) -> DataFrame:
    nations = t("nation").df.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return op.remove_rows(t("supplier"), nations, ["s_nationkey"]).result().select("s_suppkey", "s_name")


@query("drop_empty_rows", "SELECT event_id FROM events WHERE NOT (coalesce(trim(event_type),'')='' AND coalesce(trim(props),'')='')")
def _(t: Tables) -> DataFrame:
    return op.drop_empty_rows(t("events"), ["event_type", "props"]).result().select("event_id")


@query("sort_with_position", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey)::BIGINT AS pos FROM customer")
def _(t: Tables) -> DataFrame:
    return op.sort_rows(t("customer"), ("c_acctbal", False)).positioned("pos").select("c_custkey", "pos")


@query("skip_rows", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) rn, count(*) OVER () n FROM part) WHERE rn > 5 AND rn <= n-3")
def _(t: Tables) -> DataFrame:
    return op.skip_rows(op.select_columns(t("part"), "p_partkey"), 5, 3).result()


@query("split_to_rows", "SELECT doc_id, trim(w, ' ' || chr(9) || chr(13) || chr(160)) AS piece FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS w FROM documents) WHERE trim(w, ' ' || chr(9) || chr(13) || chr(160)) <> ''")
def _(t: Tables) -> DataFrame:
    return op.split_to_rows(op.select_columns(t("documents"), "doc_id", "text"), "text", "\n").result().where("text <> ''").withColumnRenamed("text", "piece")


@query("remove_repeated_headers", "SELECT r_regionkey, r_name FROM region WHERE lower(trim(r_name)) <> 'r_name' OR r_regionkey IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return op.remove_repeated_headers(t("region")).result()


# Columns


@query("rename_duplicate_reorder", "SELECT n_name AS name, n_regionkey, n_nationkey, n_regionkey AS region_copy FROM nation")
def _(t: Tables) -> DataFrame:
    f = op.rename(op.duplicate_column(t("nation"), "n_regionkey", "region_copy"), "n_name", "name")
    return op.reorder_columns(f, "name", "n_regionkey").result()


@query("drop_select_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t: Tables) -> DataFrame:
    return op.drop_columns(op.select_columns(t("customer"), "c_mktsegment", "c_custkey", "c_name"), "c_name").result()


@query("drop_empty_columns", "SELECT * FROM supplier")
def _(t: Tables) -> DataFrame:
    f = t("supplier")
    return op.drop_empty_columns(op.add_column(f, "blank", F.lit("  "))).result()


@query("split_columns", "SELECT p_partkey, string_split(trim(p_name),' ')[1] AS p_name_1, coalesce(string_split(trim(p_name),' ')[2],'') AS p_name_2 FROM part")
def _(t: Tables) -> DataFrame:
    return op.split_column(op.select_columns(t("part"), "p_partkey", "p_name"), "p_name", " ").result().select("p_partkey", "p_name_1", "p_name_2")


@query("merge_columns", "SELECT n_nationkey, concat_ws('-', n_name, CAST(n_regionkey AS VARCHAR)) AS merged FROM nation")
def _(t: Tables) -> DataFrame:
    return op.merge_columns(t("nation"), ["n_name", "n_regionkey"], "-", "merged", keep=False).result()


@query("extract_number", r"SELECT c_custkey, regexp_extract(c_name,'#(\d+)',1) AS num FROM customer")
def _(t: Tables) -> DataFrame:
    return op.extract(t("customer"), "c_name", "num", pattern=r"#(\d+)").result().select("c_custkey", "num")


@query("extract_all_urls", r"""SELECT page_id, array_to_string(regexp_extract_all(html,'(?:https?://|www\.)[^\s<>"]+'),'; ') AS urls FROM pages""")
def _(t: Tables) -> DataFrame:
    return op.extract(t("pages"), "html", "urls", preset="url", every=True).result().select("page_id", "urls")


@query("parse_json_column", "SELECT event_id, coalesce(json_extract_string(props,'$.k'),'') AS k FROM events")
def _(t: Tables) -> DataFrame:
    return op.structure_json(t("events"), "props", ["k"]).result().select("event_id", "k")


@query("structure_pattern", r"SELECT c_custkey, regexp_extract(c_name,'^(\w+)#(\d+)$',1) AS kind, regexp_extract(c_name,'^(\w+)#(\d+)$',2) AS num FROM customer")
def _(t: Tables) -> DataFrame:
    return op.structure_pattern(t("customer"), "c_name", r"^(\w+)#(\d+)\z", ["kind", "num"]).result().select("c_custkey", "kind", "num")


@query("structure_fixed_width", "SELECT n_nationkey, trim(substr(n_name,1,4)) AS a, trim(substr(n_name,5)) AS b FROM nation")
def _(t: Tables) -> DataFrame:
    return op.structure_fixed(t("nation"), "n_name", [0, 4], ["a", "b"]).result().select("n_nationkey", "a", "b")


# Text


@query("trim_collapse", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\x{A0}]+', ' ', 'g'), '\A[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+\z', '', 'g') AS text_trimmed FROM documents""")
def _(t: Tables) -> DataFrame:
    return op.rename(op.trim(t("documents"), ["text"]), "text", "text_trimmed").result().select("doc_id", "text_trimmed")


QUERIES["trim_collapse_whole"], SQL["trim_collapse_whole"] = QUERIES["trim_collapse"], SQL["trim_collapse"]  # the name it had beside a narrower one


@query("case_upper", "SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def _(t: Tables) -> DataFrame:
    return op.change_case(t("supplier"), ["s_name"], "upper").result().select("s_suppkey", "s_name")


@query("case_sentence", "SELECT p_partkey, upper(left(p_name,1)) || lower(substr(p_name,2)) AS p_name FROM part")
def _(t: Tables) -> DataFrame:
    return op.change_case(t("part"), ["p_name"], "sentence").result().select("p_partkey", "p_name")


@query("clean_text", "SELECT doc_id, translate(replace(replace(text, chr(160), ' '), chr(8203), ''), '‘’“”', '''''\"\"') AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return op.clean_text(t("documents"), ["text"]).result().select("doc_id", "text")


@query("replace_literal", "SELECT n_nationkey, replace(n_name,'NATION_','N-') AS n_name FROM nation")
def _(t: Tables) -> DataFrame:
    return op.replace_text(t("nation"), ["n_name"], "NATION_", "N-", match_case=True).result().select("n_nationkey", "n_name")


@query("replace_regex", "SELECT c_custkey, regexp_replace(c_name,'[^0-9]','','g') AS digits FROM customer")
def _(t: Tables) -> DataFrame:
    return op.rename(op.replace_text(t("customer"), ["c_name"], "[^0-9]", "", regex=True), "c_name", "digits").result().select("c_custkey", "digits")


@query("dates_long", "SELECT o_orderkey, strftime(o_orderdate,'%b ') || CAST(day(o_orderdate) AS VARCHAR) || ', ' || strftime(o_orderdate,'%Y') AS o_orderdate FROM orders")
def _(t: Tables) -> DataFrame:
    return op.normalize_dates(t("orders"), "o_orderdate", "long").result().select("o_orderkey", "o_orderdate")


@query("convert_numbers", "SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer")
def _(t: Tables) -> DataFrame:
    f = t("customer")
    shown = F.when(f.col("c_acctbal") < 0, F.concat(F.lit("($"), F.format_number(-f.col("c_acctbal"), 2), F.lit(")"))).otherwise(F.concat(F.lit("$ "), F.format_number("c_acctbal", 2)))
    return op.typed(op.add_column(f, "balance", shown), "balance", "number").result().select("c_custkey", "balance")


@query("parse_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(t: Tables) -> DataFrame:
    f = t("orders")
    d = f.col("o_orderdate")
    shapes = [F.date_format(d, p) for p in ("yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyyMMdd")]
    written = F.get(F.array(*shapes), F.col("o_orderkey").cast("int") % 5)
    return op.typed(op.add_column(f, "day", written), "day", "date").result().select("o_orderkey", "day")


@query("fill_blank", "SELECT event_id, CASE WHEN event_type IS NULL OR trim(event_type)='' THEN 'unknown' ELSE event_type END AS event_type FROM events")
def _(t: Tables) -> DataFrame:
    return op.fill_blank(t("events"), ["event_type"], "unknown").result().select("event_id", "event_type")


@query("fill_down", "SELECT event_id, last_value(CASE WHEN event_type='error' THEN NULL ELSE event_type END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")
def _(t: Tables) -> DataFrame:
    f = t("events")
    f = op.select_columns(op.add_column(f, "filled", F.when(f.col("event_type") != "error", f.col("event_type"))), "event_id", "filled")
    return op.fill_down(f, "filled").result()


@query("override_cells", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'changed' ELSE n_name END AS n_name FROM nation")
def _(t: Tables) -> DataFrame:
    f = t("nation")
    cells = f.df.where("n_nationkey % 5 = 0").select("n_nationkey", F.lit("changed").alias("value"))
    return op.override_cells(f, "n_name", cells, "n_nationkey").result().select("n_nationkey", "n_name")


# Reshaping


@query("wide_to_long", "SELECT l_orderkey, l_linenumber, k, v FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR k IN (l_discount, l_tax))")
def _(t: Tables) -> DataFrame:
    f = op.select_columns(t("lineitem"), "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return op.wide_to_long(f, ["l_orderkey", "l_linenumber"], "*", "k", "v").result()


@query("long_to_wide", "SELECT user_id, round(sum(value) FILTER (event_type='error'),2) AS error, round(sum(value) FILTER (event_type='click'),2) AS click FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    f = op.long_to_wide(t("events"), ["user_id"], "event_type", "value", "sum", keys=["error", "click"])
    return f.result().select("user_id", F.round("error", 2).alias("error"), F.round("click", 2).alias("click"))


@query("aggregate_all", 'SELECT o_orderpriority, count(*) AS "count", round(sum(o_totalprice),2) AS o_totalprice_sum, round(avg(o_totalprice),4) AS o_totalprice_average, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, count(DISTINCT o_custkey) AS o_custkey_distinct FROM orders GROUP BY o_orderpriority')
def _(t: Tables) -> DataFrame:
    price = "o_totalprice"
    f = op.aggregate(t("orders"), ["o_orderpriority"], ["count", (price, "sum"), (price, "average"), (price, "min"), (price, "max"), ("o_custkey", "distinct")], ordered=False)
    return f.result().withColumns({"o_totalprice_sum": F.round("o_totalprice_sum", 2), "o_totalprice_average": F.round("o_totalprice_average", 4)})


@query("aggregate_concat_first_last", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS n_name_concat, arg_min(n_name,n_nationkey) AS n_name_first, arg_max(n_name,n_nationkey) AS n_name_last FROM nation GROUP BY n_regionkey")
def _(t: Tables) -> DataFrame:
    return op.aggregate(t("nation"), ["n_regionkey"], [("n_name", "concat"), ("n_name", "first"), ("n_name", "last")]).result()


@query("aggregate_lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS \"count\", round(sum(l_quantity),2) AS l_quantity_sum, round(avg(l_discount),6) AS l_discount_average, max(l_tax) AS l_tax_max FROM lineitem GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    f = op.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], ["count", ("l_quantity", "sum"), ("l_discount", "average"), ("l_tax", "max")], ordered=False)
    return f.result().withColumns({"l_quantity_sum": F.round("l_quantity_sum", 2), "l_discount_average": F.round("l_discount_average", 6)})


# Joins


@query("join_left", "SELECT c.c_custkey, c.c_nationkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey=n.n_nationkey")
def _(t: Tables) -> DataFrame:
    return op.join(t("customer"), t("nation"), [("c_nationkey", "n_nationkey")], bring=["n_name"]).result().select("c_custkey", "c_nationkey", "n_name")


@query("join_inner_first_match", "SELECT c.c_custkey, f.o_orderkey FROM customer c JOIN (SELECT o_custkey, min(o_orderkey) o_orderkey FROM orders GROUP BY o_custkey) f ON c.c_custkey=f.o_custkey")
def _(t: Tables) -> DataFrame:
    return op.join(t("customer"), t("orders"), [("c_custkey", "o_custkey")], "inner", ["o_orderkey"]).result().select("c_custkey", "o_orderkey")


@query("join_fanout", "SELECT o.o_orderkey, l.l_linenumber, l.l_partkey FROM orders o JOIN lineitem l ON o.o_orderkey=l.l_orderkey")
def _(t: Tables) -> DataFrame:
    return op.join(t("orders"), t("lineitem"), [("o_orderkey", "l_orderkey")], "inner", ["l_linenumber", "l_partkey"], "fanout").result().select("o_orderkey", "l_linenumber", "l_partkey")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t: Tables) -> DataFrame:
    o = t("orders")
    return op.join(t("customer"), op.filter_rows(o, o.col("o_totalprice") > 300000), [("c_custkey", "o_custkey")], "semi").result().select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t: Tables) -> DataFrame:
    o = t("orders")
    return op.join(t("customer"), op.filter_rows(o, o.col("o_totalprice") > 300000), [("c_custkey", "o_custkey")], "anti").result().select("c_custkey")


@query("join_normalized", "SELECT s.s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def _(t: Tables) -> DataFrame:
    left = op.add_column(t("supplier"), "code", F.format_string(" 00%d ", F.col("s_nationkey")))
    right = op.add_column(t("nation"), "code", F.col("n_nationkey").cast("string"))
    return op.join(left, right, [("code", "code")], bring=["n_name"], trimmed=True, numeric=True).result().select("s_suppkey", "n_name")


@query(
    "diff",
    "SELECT coalesce(a.p_partkey,b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN a.p_partkey IS NULL THEN 'removed' WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'changed' ELSE 'unchanged' END AS _diff, "
    "CASE WHEN a.p_size IS DISTINCT FROM b.p_size AND a.p_partkey IS NOT NULL AND b.p_partkey IS NOT NULL THEN 'p_size: ' || b.p_size || ' → ' || a.p_size ELSE '' END AS _changes "
    "FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 20 <> 3) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size+1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 20 <> 7) b USING (p_partkey)",
)
def _(t: Tables) -> DataFrame:
    f = op.select_columns(t("part"), "p_partkey", "p_size")
    new = op.filter_rows(f, f.col("p_partkey") % 20 != 3)
    old = f.with_df(f.df.where("p_partkey % 20 <> 7").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))))
    return op.compare(new, old, ["p_partkey"]).result().select("p_partkey", "_diff", "_changes")


QUERIES["diff_whole"], SQL["diff_whole"] = QUERIES["diff"], SQL["diff"]  # the name it had beside a narrower one


# Formulas


@query("formula_if", "SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'Large' WHEN o_totalprice >= 50000 THEN 'Medium' ELSE 'Small' END AS band FROM orders")
def _(t: Tables) -> DataFrame:
    f = t("orders")
    p = f.col("o_totalprice")
    return op.add_column(f, "band", fx.If(p >= 200000, F.lit("Large"), fx.If(p >= 50000, F.lit("Medium"), F.lit("Small")))).result().select("o_orderkey", "band")


@query("formula_text", "SELECT c_custkey, upper(left(c_mktsegment,1)) || lower(substr(c_mktsegment,2,20)) AS label FROM customer")
def _(t: Tables) -> DataFrame:
    f = t("customer")
    s = f.col("c_mktsegment")
    return op.add_column(f, "label", fx.concat(fx.upper(fx.left(s, 1)), fx.lower(fx.mid(s, 2, 20)))).result().select("c_custkey", "label")


@query("formula_edate", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH,'%Y-%m-%d') AS due FROM orders")
def _(t: Tables) -> DataFrame:
    f = t("orders")
    return op.add_column(f, "due", v.date_text(fx.edate(f.col("o_orderdate").cast("date"), 1))).result().select("o_orderkey", "due")


@query(
    "formula_datedif",
    "SELECT o_orderkey, abs(date_diff('day', d, DATE '1999-01-01'))::BIGINT AS days, ((year(b) - year(a)) * 12 + month(b) - month(a) - (day(b) < day(a))::INT)::BIGINT AS months, wd "
    "FROM (SELECT *, least(d, DATE '1999-02-28') AS a, greatest(d, DATE '1999-02-28') AS b FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, (isodow(o_orderdate) % 7 + 1)::BIGINT AS wd FROM orders))",
)
def _(t: Tables) -> DataFrame:
    """Either date may be the earlier one. A month is full on the same day of a later month: from the 31st none is at the end of February."""
    f = t("orders")
    d, new_year, february = f.col("o_orderdate").cast("date"), F.lit("1999-01-01").cast("date"), F.lit("1999-02-28").cast("date")
    days = fx.datedif(F.least(d, new_year), F.greatest(d, new_year), "D")
    months = fx.datedif(F.least(d, february), F.greatest(d, february), "M")
    return f.df.select("o_orderkey", days.alias("days"), months.alias("months"), fx.weekday(d).cast("long").alias("wd"))


QUERIES["formula_datedif_whole"], SQL["formula_datedif_whole"] = QUERIES["formula_datedif"], SQL["formula_datedif"]  # the name it had beside a narrower one


@query("formula_math", "SELECT l_orderkey, l_linenumber, round((l_quantity * 1.25)::DECIMAL(38,12), 1)::DOUBLE AS gross, l_quantity - 7 * floor(l_quantity / 7) AS rest, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio, greatest(l_discount, l_tax) AS most FROM lineitem")
def _(t: Tables) -> DataFrame:
    f = t("lineitem")
    return f.df.select(
        "l_orderkey", "l_linenumber", fx.round_(F.col("l_quantity") * 1.25, 1).alias("gross"), fx.mod(F.col("l_quantity"), 7.0).alias("rest"),
        fx.divide(F.col("l_tax"), F.col("l_discount")).alias("ratio"), fx.max_(F.col("l_discount"), F.col("l_tax")).alias("most"),
    )


@query("formula_text_functions", "SELECT p_partkey, length(p_name)::BIGINT AS n, right(p_name, 3) AS tail, replace(p_name, 'ring', 'RING') AS subst, nullif(instr(lower(p_name), 'ring'), 0)::BIGINT AS at, concat_ws('-', p_brand, p_type) AS joined, regexp_extract(p_type, '[A-Z]+') AS word FROM part")
def _(t: Tables) -> DataFrame:
    f = t("part")
    name = f.col("p_name")
    word = fx.iferror(fx.regexextract(f.col("p_type"), "[A-Z]+"), F.lit(""))
    return f.df.select("p_partkey", fx.length(name).cast("long").alias("n"), fx.right(name, 3).alias("tail"), fx.substitute(name, "ring", "RING").alias("subst"), fx.search("RING", name).cast("long").alias("at"), fx.textjoin("-", True, F.col("p_brand"), F.col("p_type")).alias("joined"), word.alias("word"))


# Insights


@query("distinct_values", "SELECT trim(c_mktsegment) AS value, count(*) AS n FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return insights.distinct_values(t("customer"), "c_mktsegment")


@query("profile_numeric", "SELECT count(*) AS n, count(c_acctbal) AS filled, count(DISTINCT c_acctbal) AS distinct_values, min(c_acctbal) AS min_value, max(c_acctbal) AS max_value FROM customer")
def _(t: Tables) -> DataFrame:
    p = insights.profile(t("customer"), ["c_acctbal"])
    return p.select("n", "filled", "distinct_values", F.col("min_number").alias("min_value"), F.col("max_number").alias("max_value"))


@query("profile_text", "SELECT 'p_name' AS \"column\", count(*) AS n, count(DISTINCT p_name) AS distinct_values, min(length(p_name))::BIGINT AS min_length, max(length(p_name))::BIGINT AS max_length FROM part")
def _(t: Tables) -> DataFrame:
    return insights.profile(t("part"), ["p_name"]).select("column", "n", "distinct_values", "min_length", "max_length")


@query("histogram_number", "WITH e AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return insights.histogram(t("orders"), "o_totalprice").select("bin", "n")


@query("histogram_date", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), e AS (SELECT min(d) AS lo, max(d) AS hi, ceil((max(d) - min(d) + 1) / 50)::INT AS w FROM d) SELECT lo + ((d - lo) // w * w)::INT AS low, least(lo + (((d - lo) // w + 1) * w - 1)::INT, hi) AS high, count(*) AS n FROM d, e GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return insights.date_histogram(t("orders"), "o_orderdate", 50).select("low", "high", "n")


@query("selection_stats", "SELECT count(*) AS \"count\", count(v) AS numeric_count, round(sum(v), 2) AS sum, min(v) AS min, max(v) AS max FROM (SELECT unnest([l_quantity, l_extendedprice]) AS v FROM lineitem)")
def _(t: Tables) -> DataFrame:
    return insights.selection_stats(t("lineitem"), ["l_quantity", "l_extendedprice"]).select("count", "numeric_count", F.round("sum", 2).alias("sum"), "min", "max")


@query("find_cells", "SELECT p_partkey, unnest(list_filter([CASE WHEN contains(lower(p_name),'ring') THEN 'p_name' END, CASE WHEN contains(lower(p_type),'ring') THEN 'p_type' END, CASE WHEN contains(lower(p_brand),'ring') THEN 'p_brand' END], lambda x: x IS NOT NULL)) AS \"column\" FROM part")
def _(t: Tables) -> DataFrame:
    return insights.find_cells(op.select_columns(t("part"), "p_partkey", "p_name", "p_brand", "p_type"), "ring", "p_partkey")


@query("issues_documents")
def _(t: Tables) -> DataFrame:
    return insights.issues(op.select_columns(t("documents"), "doc_id", "text", "lang", "source"))


@query("natural_sort", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY lpad(regexp_extract(n_name, '[0-9]+'), 40, '0'), n_nationkey)::BIGINT AS pos FROM nation")
def _(t: Tables) -> DataFrame:
    return op.sort_rows(t("nation"), ("n_name", True, "text")).positioned("pos").select("n_nationkey", "n_name", "pos")


# Sources and sinks


@query("html_tables")
def _(t: Tables) -> DataFrame:
    return readers.html_tables(t("pages").df)


@query("sink_csv_lines", "SELECT 'n_nationkey,n_name,n_regionkey' AS value UNION ALL SELECT n_nationkey || ',' || n_name || ',' || n_regionkey FROM nation")
def _(t: Tables) -> DataFrame:
    return sinks.csv_lines(op.select_columns(t("nation"), "n_nationkey", "n_name", "n_regionkey"), guard=True)


@query("sink_markdown", "SELECT unnest(['| r_regionkey | r_name |', '| --- | --- |']) AS value UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def _(t: Tables) -> DataFrame:
    return sinks.markdown_lines(t("region"))


@query("flagship_recipe", 'SELECT o_orderpriority, count(*) AS "count", round(sum(o_totalprice), 2) AS o_totalprice_sum, row_number() OVER (ORDER BY sum(o_totalprice) DESC)::BIGINT AS pos FROM orders WHERE o_totalprice > 100000 GROUP BY 1')
def _(t: Tables) -> DataFrame:
    f = t("orders")
    f = op.filter_rows(f, pr.leaf(f.df, "o_totalprice", "gt", 100000))
    f = op.aggregate(f, ["o_orderpriority"], ["count", ("o_totalprice", "sum")])
    return op.sort_rows(f, ("o_totalprice_sum", False)).positioned("pos").select("o_orderpriority", "count", F.round("o_totalprice_sum", 2).alias("o_totalprice_sum"), "pos")


from millrace.plans import languages, roundtrips, shapes  # noqa: E402, F401 - add their queries
