"""Searches, formulas and recipes as text, patterns, and names with any signs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace import operators as op
from millrace.functions import dialect, formula_text, formulas, predicates, search_text
from millrace.functions.search_text import Group, Not, Term
from millrace.operators import Frame
from millrace.plans import recipe_text
from millrace.sources import readers

SHEET = ["Status", "Amount", "Date", "Region", "Order ID", "Notes"]
ORDERS = [
    ("Paid", "150.00", "2025-01-15", "EMEA", "100", "new york office"),
    ("paid", "50", "2025-02-10", "APAC", "101", "York, New"),
    ("Pending", "700", "2025-03-31", "emea", "102", "ref 12"),
    ("PAID", "1,200.50", "2025-04-01", "US", "103", "test card"),
    ("Late", "-20", "2024-12-31", "APAC", "104", ""),
    ("", "100", "", "EMEA", "105", "ref 7"),
    ("Paid", "500", "2025-03-01", "US", "106", "New York"),
]


def table(spark, columns, rows):
    names = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"__n long, {names}")


SEARCHES = {
    "paid": [0, 1, 3, 6], "paid card": [3], '"new york"': [0, 6], "status:paid": [0, 1, 3, 6], "status:=paid": [0, 1, 3, 6], "status:!=paid": [2, 4, 5], "-status:paid": [2, 4, 5], "NOT status:paid": [2, 4, 5], "-test": [0, 1, 2, 4, 5, 6],
    "amount>100": [0, 2, 3, 6], "amount>=100": [0, 2, 3, 5, 6], "amount<0": [4], "amount:100..500": [0, 5, 6], "date>2025-01-01": [0, 1, 2, 3, 6], "date:2025-01-01..2025-03-31": [0, 1, 2, 6], "region:(emea|apac)": [0, 1, 2, 4, 5],
    'status:=""': [5], 'status:!=""': [0, 1, 2, 3, 4, 6], r"notes:/^ref \d+$/i": [2, 5], '"order id":103': [3], "[order id]:104": [4], "order_id:105": [5], "status:paid OR status:pending": [0, 1, 2, 3, 6], "(status:late OR region:us) -notes:test": [4, 6],
    "amount=100": [5], "amount!=100": [0, 1, 2, 3, 4, 6], "amount<>100": [0, 1, 2, 3, 4, 6], "region:=emea": [0, 2, 5], "status:paid amount>100": [0, 3, 6], "status:paid AND NOT (region:us OR region:apac)": [0], "/^york/": [1], "": [0, 1, 2, 3, 4, 5, 6],
    "=[Amount]*2>500": [2, 3, 6], '=OR([Region]="us",[Notes]="")': [3, 4, 6], "=1/0": [],
}


def test_searches(spark):
    df = table(spark, SHEET, ORDERS)
    for text, want in SEARCHES.items():
        errors: list[str] = []
        assert (text, sorted(r[0] for r in search_text.searched(df, text, errors).select("__n").collect()), errors) == (text, want, [])


def free(word):
    return Term("*", "contains", word)


def test_searches_never_fail(spark):
    read = lambda text: search_text.parse(text, SHEET)
    for text in ("10:30", "http://x.com", "a:b", "5>3", ":", "-", "status:", "and", "a-b"):
        assert read(text) == search_text.Search(free(text))
    assert read("--x").tree == Not(Not(free("x"))) and read(" " * 500).tree is None and read("").errors == ()
    assert read('"').tree is None and len(read('"').errors) == 1 and len(read("(").errors) == 1
    assert read('status:paid "new york').tree == Group("and", (Term("Status", "contains", "paid"), free("new"), free("york")))
    assert read("a) b").tree == Group("and", (free("a"), free("b"))) and read("a OR b OR c").tree == Group("or", (free("a"), free("b"), free("c")))
    assert read("notes:/(/").errors and read("notes:/(/").tree == Term("Notes", "contains", "/(/") and read("=1+").errors
    assert read("(" * 200 + "x").errors and read("x -" + "-" * 200 + "y").tree is not None
    assert read('paid status:x "b c"').words == ["paid", "b c"]
    df, errors = table(spark, SHEET, ORDERS), []
    assert search_text.searched(df, "amount>abc paid", errors).count() == 4 and len(errors) == 1
    assert [r[0] for r in df.orderBy("__n").select(search_text.hits(df, read("york paid"))).collect()][:3] == [["Status", "Notes"], ["Status", "Notes"], []]


#: Formulas of constants and what they show.
CONSTANT = {
    "1+2": "3", "2+3*4^2": "50", "-2^2": "4", "2^-2": "0.25", "2^3^2": "64", "200*10%": "20", "-(3)": "-3", "1e3+1": "1001", ".5+.25": "0.75", "0.1+0.2": "0.3", "1/3": "0.333333333333", "10^21": "1" + "0" * 21, "10^-7": "0.0000001", "--3": "3", "5-3-1": "1",
    "1/0": "#DIV/0!", "0^0": "#NUM!", "0^-1": "#DIV/0!", "(-8)^(1/3)": "#NUM!", "10^400": "#NUM!", "MOD(5,0)": "#DIV/0!", "[Missing]": "#REF!", "FOO()": "#NAME?", '"a"+1': "#VALUE!", "foo": "#NAME?", 'IFERROR(1/0,"x")': "x", 'IFERROR([No],"gone")': "gone",
    "ISBLANK(1/0)": "FALSE", "ISNUMBER(1/0)": "FALSE", '"a"&1+2': "a3", "1&2=12": "TRUE", '"a"="A"': "TRUE", '"b"<"a"': "FALSE", '1="1"': "TRUE", "TRUE+1": "2", 'TRUE&"x"': "TRUEx", '1<"a"': "TRUE", '"a"<TRUE': "TRUE", '""=""': "TRUE", '"say ""hi"""': 'say "hi"',
    "IF(FALSE,1)": "FALSE", 'IF("x",1,2)': "#VALUE!", 'IF("",1,2)': "2", "IF(TRUE,1,1/0)": "1", "IF(FALSE,1/0,2)": "2", 'IFS(1>2,"a",2>1,"b")': "b", 'IFS(1>2,"a")': "#N/A", 'AND(TRUE,1,"true")': "TRUE", "AND(1>2,1/0>1)": "FALSE", "OR(1<2,1/0>1)": "TRUE", "OR(1/0>1,TRUE)": "#DIV/0!",
    'COALESCE("","  ","x")': "x", "COALESCE(0,5)": "0", 'ISNUMBER("12")': "TRUE", "ISNUMBER(TRUE)": "FALSE", 'LEN("😀é")': "2", 'LEFT("abc",-1)': "#VALUE!", 'LEFT("😀ab",2)': "😀a", 'RIGHT("abc",0)': "", 'MID("abcdef",2,3)': "bcd", 'MID("abc",0,1)': "#VALUE!",
    'PROPER("it\'s a TEST")': "It'S A Test", 'TRIM("  a   b  ")': "a b", 'CONCAT("a",1,TRUE,12345678.5)': "a1TRUE12345678.5", "LEN(2)": "1", 'TEXTJOIN("-",TRUE,"a","","b")': "a-b", 'TEXTJOIN("-",FALSE,"a","","b")': "a--b", 'SUBSTITUTE("a-b-c","-","+",2)': "a-b+c", 'SUBSTITUTE("a-b","-","+",5)': "a-b",
    'REPLACE("abcdef",2,3,"X")': "aXef", 'FIND("b","abcb",3)': "4", 'FIND("B","abc")': "#VALUE!", 'SEARCH("B","abc")': "2", 'CONTAINS("Hello","ELL")': "TRUE", 'ENDSWITH("a","abc")': "FALSE", 'VALUE("(12)")': "-12", 'VALUE("5%")': "0.05", 'VALUE("")': "#VALUE!", 'VALUE("2025-01-01")': "45658",
    'TEXT(1234.5,"#,##0.00")': "1,234.50", 'TEXT(-5,"$0.00")': "-$5.00", 'TEXT(DATE(2025,3,5),"mmm d, yyyy")': "Mar 5, 2025", 'TEXT("abc","0.0")': "abc", 'TEXT(1,"abc")': "#VALUE!", "ROUND(-2.5,0)": "-3", "ROUND(1.005,2)": "1.01", "ROUND(1234.567,-2)": "1200", "ROUNDUP(-2.1,0)": "-3", "ROUNDDOWN(3.14159,3)": "3.141",
    "INT(-1.5)": "-2", 'ABS("-4.5")': "4.5", "MOD(-7,3)": "2", "MOD(7,-3)": "-2", 'SUM("1","2")': "3", 'SUM("a")': "#VALUE!", "AVERAGE(1,2,6)": "3", "MIN(3,1,2)": "1", "DATE(2025,13,1)": "2026-01-01", "DATE(2025,3,0)": "2025-02-28", "DATE(10000,1,1)": "#NUM!", 'MONTH("2025-03-05")': "3", "YEAR(45658)": "2025",
    "WEEKDAY(DATE(2025,3,2),3)": "6", "WEEKDAY(DATE(2025,3,5),9)": "#NUM!", 'YEAR("nope")': "#VALUE!", "EDATE(DATE(2025,1,31),1)": "2025-02-28", 'DATEDIF("2020-01-15","2025-03-10","MD")': "23", 'DATEDIF("2025-03-10","2020-01-15","Y")': "#NUM!", 'DATEDIF("2020-01-15","2025-03-10","X")': "#NUM!",
    "DATE(2025,1,31)+1": "2025-02-01", '1+"2025-01-31"': "2025-02-01", "DATE(2025,3,1)-DATE(2025,2,1)": "28", "1-DATE(2025,3,1)": "#VALUE!", "DATE(2025,1,1)+DATE(2025,1,1)": "#VALUE!", 'DATE(2025,1,31)&""': "2025-01-31", '"2025-01-31"="2025-1-31"': "TRUE",
    'REGEXMATCH("ABC","abc","i")': "TRUE", 'REGEXMATCH("a","a","x")': "#VALUE!", r'REGEXEXTRACT("order 123","(\d+)")': "123", r'REGEXEXTRACT("abc","\d")': "#N/A", r'REGEXREPLACE("john smith","(\w+) (\w+)","$2, $1")': "smith, john", 'REGEXMATCH("aaaa","(a+)+$")': "#VALUE!", 'REGEXMATCH("a","(")': "#VALUE!",
}
#: Formulas of text cells: columns, cells, order of dates, number format, and what the formulas show.
CELLS = [
    (["Qty", "Price", "Order Total", "order_id"], ["2", "3.5", "$1,200.50", "A1"], "mdy", "us", {"[Qty]*[Price]": "7", "qty*price": "7", "[order total]+1": "1201.5", "[Order_ID]": "A1", "[ qty ]": "2", "SUM([Qty],[Price],1)": "6.5", "[Qty]>[Price]": "FALSE"}),
    (["OR", "and"], ["x", "y"], "mdy", "us", {"[OR]": "x", '[and]&"!"': "y!"}),
    (["p"], ["1.234,50"], "mdy", "eu", {"[p]*2": "2469", "[p]>1000": "TRUE", "SUM([p],1)": "1235.5"}),
    (["Qty"], [""], "mdy", "us", {"[Qty]+1": "1", '[Qty]=""': "TRUE", "[Qty]=0": "FALSE", "[Qty]<5": "FALSE", "[Qty]<>5": "TRUE", "[Qty]*3": "0", "ISBLANK([Qty])": "TRUE"}),
    (["a", "b"], ["1,200", "900"], "mdy", "us", {"[a]>[b]": "TRUE", "[a]=[b]": "FALSE"}),
    (["a", "b"], ["01/02/2025", "03/01/2025"], "dmy", "us", {"[a]<[b]": "FALSE", "[b]-[a]": "-29"}),
    (["a", "b", "c"], ["5", "", "n/a"], "mdy", "us", {"SUM([a],[b],[c])": "5", "AVERAGE([b],[c])": "#DIV/0!", "MAX([b],[c])": "0", 'SUM([a],"")': "5", 'IF(ISBLANK([b]),"none",[b])': "none"}),
]


def shown(df, formulas_, **how):
    """What several formulas show, in one job."""
    for k, f in enumerate(formulas_):
        df = formula_text.evaluated(df, f, f"__out{k}", **how)
    return list(df.select(*[F.col(f"__out{k}.text") for k in range(len(formulas_))]).first())


def test_formulas_of_constants(spark):
    df, said = table(spark, ["none"], [("",)]), list(CONSTANT)
    for k in range(0, len(said), 20):
        part = said[k : k + 20]
        assert dict(zip(part, shown(df, part), strict=True)) == {f: CONSTANT[f] for f in part}


def test_formulas_of_cells(spark):
    for columns, cells, order, locale, want in CELLS:
        got = shown(table(spark, columns, [cells]), list(want), order=order, locales=dict.fromkeys(columns, locale))
        assert dict(zip(want, got, strict=True)) == want


def test_formulas_of_typed_columns(spark):
    df = spark.createDataFrame([(1, 2.5, True, "2025-03-05", "x"), (2, None, None, None, None)], "i int, d double, b boolean, day string, `t]x` string").withColumn("day", F.col("day").cast("date"))
    want = {"[i]*[d]": ["2.5", "0"], "[d]=0": ["FALSE", "FALSE"], "ISBLANK([d])": ["FALSE", "TRUE"], "[day]+1": ["2025-03-06", "1"], "IF([b],[day],[i])": ["2025-03-05", "2"], "[t]]x]&[d]": ["x2.5", ""], "1/([i]-1)": ["#DIV/0!", "1"], "[b]": ["TRUE", ""]}
    for k, f in enumerate(want):
        df = formula_text.evaluated(df, f, f"__out{k}")
    rows = df.orderBy("i").select(*[f"__out{k}.text" for k in range(len(want))], "__out4.kind", "__out4.number").collect()
    assert [[r[k] for r in rows] for k in range(len(want))] == list(want.values())
    assert [(r["kind"], r["number"]) for r in rows] == [("date", 45721.0), ("number", 2.0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "__f" not in df.columns


@pytest.mark.parametrize("text", ["1+", "(1", "IF(1)", '"a', "1 2", "[a", "SUM()", "1" * 3000, "(" * 70 + "1" + ")" * 70, 'TEXT(1,"a"&"b")'])
def test_no_formula(spark, text):
    with pytest.raises(formula_text.FormulaError):
        formula_text.evaluated(table(spark, ["none"], [("",)]), text)


def test_patterns(spark):
    cells = ["a{b", "x\ny", "no_1", "b\n1", "foo bar", " ", "it's", "2025-03-2025", "end\n", None]
    df = table(spark, ["c"], [(c,) for c in cells])
    hits = lambda p, flags="": [r[0] for r in df.where(F.col("c").rlike(dialect.translated(p, flags).java)).orderBy("__n").select("c").collect()]
    assert hits("a{b") == ["a{b"] and hits("b[^]1") == ["b\n1"] and hits("x.y") == [] and hits("x.y", "s") == ["x\ny"] and hits(r"^\s$") == [" "]
    assert hits("^y$", "m") == ["x\ny"] and hits("end$") == [] and hits(r"\bbar\b") == ["foo bar"] and hits(r"(?<y>\d{4})-\d\d-\k<y>") == ["2025-03-2025"] and hits("[[a]\\{") == ["a{b"] and hits(r"[\s]y") == ["x\ny"] and hits("FOO", "i") == ["foo bar"] and hits("[]") == []
    for bad in ("(", "[a", "(a+)+$", "(?:a*)*b", r"(a)\2", r"\k<no>", "a**", ")"):
        with pytest.raises(ValueError):
            dialect.translated(bad)
    p = dialect.translated(r"(?<my_name>\w+)-(\d)")
    assert p.names == ("my_name", None) and p.replacement(r"$2 $<my_name> $& $$ $9 $10 \ $x") == r"$2 $1 $0 \$ \$9 $1\0 \\ \$x"
    assert df.where(predicates.leaf(df, "c", "matches", r"(?<my_name>\d)$")).count() == 3
    f = op.structure_pattern(Frame.of(df, "__n"), "c", r"^(?<first_one>\w+) (?<c>\w+)", keep=True)
    assert f.columns == ["c", "first_one", "c_2"] and f.sorted().collect()[4][1:] == ("foo", "bar")


def test_numbers_as_text(spark):
    values = {2.0: "2", 12345678.5: "12345678.5", 1 / 3: "0.333333333333", 1e21: "1" + "0" * 21, 1e-7: "0.0000001", -0.001: "-0.001", 0.0: "0", 123456789.123456: "123456789.123", 999999999999.95: "1000000000000", None: None}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(formulas.shown_number(F.col("v"))).collect()] == list(values.values())
    got = df.where("v = 2").select(formulas.concat(F.lit(2), F.lit("x"), F.lit(12345678.5), F.lit(True), F.col("v")), formulas.length(F.col("v")), formulas.left(F.lit(2.50), 3)).first()
    assert tuple(got) == ("2x12345678.5TRUE2", 1, "2.5")


#: Recipes of one step: line, columns, rows, and the columns and rows that come out.
STEPS = [
    ('remove rows where "s" is empty', ["s"], [["a"], [" "], [""]], ["s"], [["a"]]),
    ('keep rows where "n" > 100 and "r" in ("EMEA", "APAC")', ["n", "r"], [["$1,200", "emea"], ["50", "APAC"], ["300", "US"]], ["n", "r"], [["$1,200", "emea"]]),
    ('keep rows where ("n" > 100 or "n" is empty) and not "r" contains "x"', ["n", "r"], [["200", "a"], ["", "x"], ["", "b"], ["1", "c"]], ["n", "r"], [["200", "a"], ["", "b"]]),
    ('keep rows where "s" contains "B" matchcase', ["s"], [["abc"], ["aBc"]], ["s"], [["aBc"]]),
    ('remove rows where any column contains "test"', ["a", "b"], [["x", "Test row"], ["y", "z"]], ["a", "b"], [["y", "z"]]),
    ('keep rows where "d" between "2025-01-01" and "2025-03-31"', ["d"], [["2025-02-10"], ["2025-05-01"], ["Jan 3, 2025"]], ["d"], [["2025-02-10"], ["Jan 3, 2025"]]),
    (r'remove rows where row text matches /^page \d+$/i', ["a", "b"], [["Page", "2"], ["x", "y"]], ["a", "b"], [["x", "y"]]),
    ("keep rows where formula [a]*2 > [b]", ["a", "b"], [["2", "3"], ["1", "5"], ["x", "1"]], ["a", "b"], [["2", "3"]]),
    ('@remove-rows {"rowIds":[1]}', ["a"], [["x"], ["y"], ["z"]], ["a"], [["x"], ["z"]]),
    ('@keep-rows {"mode":"allExcept","rowIds":[1]}', ["a"], [["x"], ["y"], ["z"]], ["a"], [["x"], ["z"]]),
    ('@override {"column":"a","overrides":[{"rowId":1,"value":"Z"}]}', ["a"], [["x"], ["y"]], ["a"], [["x"], ["Z"]]),
    ('@infer {"column":"a","candidate":{"type":"removePrefix","params":{"prefix":"ID-"}}}', ["a"], [["ID-7"], ["8"]], ["a"], [["7"], ["8"]]),
    ("trim *", ["a"], [["  b   c "]], ["a"], [["b c"]]),
    ('trim "a" keep inner', ["a"], [["  b   c "]], ["a"], [["b   c"]]),
    ('clean text in "a" without quotes', ["a"], [["“x y”"]], ["a"], [["“x y”"]]),
    ('case upper "a", "b"', ["a", "b"], [["x", "y"]], ["a", "b"], [["X", "Y"]]),
    ('replace "N/A" with "" in * whole', ["a"], [["n/a"], ["n/a x"]], ["a"], [[""], ["n/a x"]]),
    ('replace /(\\d)-(\\d)/ with "$2/$1" in "a"', ["a"], [["1-2"]], ["a"], [["2/1"]]),
    ('dates "d" -> long', ["d"], [["2025-03-05"], ["no"]], ["d"], [["Mar 5, 2025"], ["no"]]),
    ('convert "n" to number locale eu', ["n"], [["1.234,50"]], ["n"], [["1234.5"]]),
    ('fill down "g"', ["g"], [["a"], [""], ["b"]], ["g"], [["a"], ["a"], ["b"]]),
    ('fill blank "a" with "0"', ["a"], [[""], ["1"]], ["a"], [["0"], ["1"]]),
    ('remove empty rows in "b"', ["a", "b"], [["x", ""], ["y", "z"]], ["a", "b"], [["y", "z"]]),
    ('remove duplicates by "e" ignore case keep last', ["e", "n"], [["A@x", "1"], ["a@X", "2"]], ["e", "n"], [["a@X", "2"]]),
    ("skip rows top 1 bottom 1", ["a"], [["1"], ["2"], ["3"]], ["a"], [["2"]]),
    ("use row 2 as header", ["a", "b"], [["t", ""], ["x", "y"], ["1", "2"]], ["x", "y"], [["1", "2"]]),
    ("remove repeated headers", ["a"], [["1"], [" A"]], ["a"], [["1"]]),
    ('sort by "n" desc', ["n"], [["(3)"], ["1,200"], ["$5"], [""]], ["n"], [["1,200"], ["$5"], ["(3)"], [""]]),
    ('sort by "g" asc as text, "n" desc as number', ["g", "n"], [["b", "1"], ["a", "2"], ["a", "10"]], ["g", "n"], [["a", "10"], ["a", "2"], ["b", "1"]]),
    ('split "t" on ";" into rows', ["i", "t"], [["1", "a; b"], ["2", ""]], ["i", "t"], [["1", "a"], ["1", "b"], ["2", ""]]),
    ('split "n" on " " into "first", "last" max 2 drop original', ["n"], [["Ada King L"]], ["first", "last"], [["Ada", "King L"]]),
    ('parse json in "p"', ["p"], [['{"a":1,"b":{"c":"x"},"l":[{"s":1},2]}'], ["oops"]], ["a", "b.c", "l[0].s", "l[1]", "_unparsed"], [["1", "x", "1", "2", ""], ["", "", "", "", "oops"]]),
    ('split "l" by fixed-width at 0,3', ["l"], [["ab cd"]], ["l_1", "l_2"], [["ab", "cd"]]),
    (r'split "l" by pattern /(?<d>\d+) (?<the_rest>.*)/i', ["l"], [["12 x y"]], ["d", "the_rest"], [["12", "x y"]]),
    ('split "l" by logfmt', ["l"], [['a=1 b="x y"'], ["c=3"]], ["a", "b", "c"], [["1", "x y", ""], ["", "", "3"]]),
    ('split "l" by whitespace-runs into "x", "y"', ["l"], [["a  b"]], ["x", "y"], [["a", "b"]]),
    ('split "l" by character "|"', ["l"], [["a| b"]], ["l_1", "l_2"], [["a", "b"]]),
    ('rename "e-mail" -> "email"', ["e-mail"], [["x"]], ["email"], [["x"]]),
    ('delete columns "a"', ["a", "b"], [["1", "2"]], ["b"], [["2"]]),
    ('keep columns "b", "a"', ["a", "b", "c"], [["1", "2", "3"]], ["b", "a"], [["2", "1"]]),
    ('duplicate column "a" as "a"', ["a"], [["1"]], ["a", "a_2"], [["1", "1"]]),
    ('order columns "no", "b"', ["a", "b"], [["1", "2"]], ["b", "a"], [["2", "1"]]),
    ("remove empty columns", ["a", "b"], [["1", " "]], ["a"], [["1"]]),
    ('merge "a", "b" into "ab" joined by "-" keep blanks', ["a", "b"], [["1", ""]], ["a", "b", "ab"], [["1", "", "1-"]]),
    ('extract email from "c" into "mail"', ["c"], [["to a@b.co."]], ["c", "mail"], [["to a@b.co.", "a@b.co"]]),
    (r'extract /#(\d+)/ from "c" into "n" all', ["c"], [["#1 #22"]], ["c", "n"], [["#1 #22", "1; 22"]]),
    ('wide to long keep "id" unpivot "q1", "q2" into "k", "v" skip blanks', ["id", "q1", "q2"], [["1", "5", ""]], ["id", "k", "v"], [["1", "q1", "5"]]),
    ('long to wide "k" from "v" group by "id" combine sum', ["id", "k", "v"], [["1", "a`b", "2"], ["1", "a`b", "3"]], ["id", "a`b"], [["1", "5"]]),
    ('group by "g" calculate "count", "v:concat"', ["g", "v"], [["a", "1"], ["a", "2"]], ["g", "count", "v_concat"], [["a", "2", "1, 2"]]),
    ('join "people" left on "id" = "pid" normalize trim,numeric bring "name"', ["id"], [["7.0"], ["8"]], ["id", "name"], [["7.0", "Ada"], ["8", ""]]),
    ('join "people" anti on "id" = "pid"', ["id"], [["7"], ["8"]], ["id"], [["8"]]),
    ('diff "people" key "pid" compare * include-removed', ["pid", "name"], [["7", "Bo"]], ["_diff", "_changes", "pid", "name"], [["changed", "name: Ada → Bo", "7", "Bo"], ["removed", "", "9", "Cy"]]),
    ('add column "T" after "a" = ROUND([a] * 1.15, 1)', ["a", "b"], [["2", "x"], ["y", ""]], ["a", "T", "b"], [["2", "2.3", "x"], ["y", "#VALUE!", ""]]),
]


def cells(frame):
    return [["" if v is None else str(v) for v in r] for r in frame.sorted().collect()]


def test_recipe_steps(spark):
    people = Frame.of(table(spark, ["pid", "name"], [["7", "Ada"], ["9", "Cy"]]), "__n")
    for line, columns, rows, want_columns, want in STEPS:
        step = recipe_text.parse_step(line)
        assert recipe_text.print_step(step) == line and recipe_text.parse_step(recipe_text.print_step(step)) == step
        out = recipe_text.run(Frame.of(table(spark, columns, rows), "__n"), recipe_text.Recipe((step,)), {"people": people})
        assert (line, out.errors) == (line, {})
        if line.startswith("diff"):
            assert sorted(out.frame.columns) == sorted(want_columns) and len(cells(out.frame)) == len(want)
            continue
        assert (line, out.frame.columns, cells(out.frame)) == (line, want_columns, want)
    assert {recipe_text.parse_step(s[0]).op for s in STEPS} == set(recipe_text.STEPS)


def test_recipe_text(spark):
    text = "\n".join(["# any recipe v2", "# a note", '@source {"kind":"csv"}', "trim *", "", '#! sort by "n" desc', 'melt keep "a" unpivot * into "k", "v"', 'add column "x" = [n] & "[n]"'])
    recipe = recipe_text.parse(text)
    assert recipe.notes == ("a note",) and recipe.source == {"kind": "csv"} and [s.muted for s in recipe.steps] == [False, True, False, False]
    again = recipe_text.to_text(recipe)
    assert again.splitlines() == ["# millrace recipe v3", '@source {"kind":"csv"}', "trim *", '#! sort by "n" desc', 'wide to long keep "a" unpivot * into "k", "v"', 'add column "x" = [n] & "[n]"']
    assert recipe_text.parse(again).steps == recipe.steps
    for bad in ("nonsense", 'keep rows where "a" is "x" and "b" is "y" or "c" is "z"', 'rename "a"', "trim * please", 'keep rows where "a" near "b"', "@remove-rows {", 'add column "x" = 1 +', 'sort by "a" sideways'):
        with pytest.raises(recipe_text.RecipeError):
            recipe_text.parse("trim *\n" + bad)
    names = {"a": "A 1", "n": "N"}
    moved = [recipe_text.print_step(recipe_text.remapped(recipe_text.parse_step(x), names)) for x in ('keep rows where "a" > 1 and not "n" is empty', 'sort by "n" desc, "b" asc', 'group by "a" calculate "count", "n:sum"', 'add column "x" = [n] + [b] & "[n]"', 'join "t" left on "a" = "a"')]
    assert moved == ['keep rows where "A 1" > 1 and not "N" is empty', 'sort by "N" desc, "b" asc', 'group by "A 1" calculate "count", "N:sum"', 'add column "x" = [N] + [b] & "[n]"', 'join "t" left on "A 1" = "a"']
    assert recipe_text.columns_of(recipe_text.parse_step('keep rows where "a" > 1 and not "n" is empty')) == ["a", "n"]
    out = recipe_text.run(Frame.of(table(spark, ["a"], [["1"]]), "__n"), 'trim "no"\njoin "gone" left on "a" = "a"\nfill blank "a" with "x"')
    assert len(out.errors) == 2 and cells(out.frame) == [["1"]]


def test_names_with_signs(spark):
    names = ["a`b", "x.y", "two words", "`", "q``"]
    df = table(spark, names, [[" 1 ", "k`1", "v", "", "z"], ["1", "k`2", "w", "", "z"], ["1", "k`2", "w", "", "z"]])
    f = op.dedupe(op.trim(Frame.of(df, "__n")))
    assert cells(f) == [["1", "k`1", "v", "", "z"], ["1", "k`2", "w", "", "z"]]
    assert op.long_to_wide(f, ["a`b"], "x.y", "two words").columns == ["a`b", "k`1", "k`2"] and op.drop_empty_columns(f).columns == ["a`b", "x.y", "two words", "q``"]
    assert op.aggregate(f, ["a`b"], ["count", ("two words", "max")]).columns == ["a`b", "count", "two words_max"] and op.sort_rows(f, ("`", True), ("x.y", False)).sorted().count() == 2
    assert search_text.searched(f.df, '"two words":w OR a`b:1').count() == 2 and op.fill_down(f, "`").sorted().count() == 2


def test_readers_find_their_columns(spark):
    lines = lambda *t: Frame.of(spark.createDataFrame(list(enumerate(t)), "__n long, line string"), "__n")
    f = readers.json_lines(lines('{"b":1,"a":{"c d":[1,{"e":null}]}}', '{"it\'s":2,"b":[3]}', "bad", None))
    assert f.columns == ["b", "a.c d[0]", "a.c d[1].e", "it's", "b[0]", "_unparsed"] and cells(f)[:3] == [["1", "1", "", "", "", ""], ["[3]", "", "", "2", "3", ""], ["", "", "", "", "", "bad"]]
    f = readers.prefixed_json(lines('[a{b}] {"k":1}', "plain", 'p {"k":"a{b"}', "{bad} {", None), unparsed=True)
    assert f.columns == ["prefix", "k", "_unparsed"] and cells(f) == [["[a{b}]", "1", ""], ["", "", "plain"], ["p", "a{b", ""], ["", "", "{bad} {"], ["", "", ""]]
    f = readers.logfmt(lines("z=1 hello", 'a="b c" z=2'))
    assert f.columns == ["z", "a", "message"] and cells(f) == [["1", "", "hello"], ["2", "b c", ""]]
    assert readers.json_lines(lines("bad")).columns == ["_unparsed"] and readers.find_cuts(lines(" " * 3 + "x" * 600 + " " * 2 + "y")) == [3, 605]
