"""Work that must not grow: casts that fail row by row, tables read again, columns nobody asked for."""

import re

from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.dates import normalize_month
from tidewatch.functions.numbers import normalize_money


def test_no_match_is_kept_from_the_cast(spark):
    """A failed cast raises and catches an exception: nothing that a pattern did not find is cast."""
    for made in (normalize_month(F.col("c")), normalize_money(F.col("c"))):
        assert not re.search(r"try_cast\((replace\()?regexp_extract", str(made._jc.toString()).lower())
    cells = ["2020-3", "13/2020", "(4/2019)", "May, 2001", "Sep-99", "as on 7/2011 (rev)", "x", "", None, "Rs. 1,234.50 crore", "approx 7 (rev)", "Nil"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(normalize_month(F.col("c")).alias("m"), normalize_money(F.col("c")).alias("v")).collect()
    assert [r["m"] for r in got[:9]] == ["2020-03", None, "2019-04", "2001-05", "1999-09", "2011-07", None, None, None]
    assert [r["v"] for r in got[6:]] == [None, None, None, 1234.5, 7.0, None]


def test_clean_text_changes_what_the_whole_class_changes(spark):
    odd = ["a b", " a", "a ", "a  b", "a\tb", "a \tb", "a\t b", "a b", "a   b", "　x  y", "é é", "é  é\u0085", "", None, "\n", " ", "a​ b"]
    df = spark.createDataFrame([(c,) for c in odd], "c string")
    plain = F.trim(F.regexp_replace(F.coalesce("c", F.lit("")), T.SPACE_CLASS + "+", " "))
    assert df.where(~T.clean_text(F.col("c")).eqNullSafe(plain)).count() == 0


def test_cells_of_one_line_are_split_as_those_of_many(spark):
    """A closing empty line sends a cell through the fold; it changes nothing."""
    odd = ["a", " [a] ", "{a", "(a)", "(a", "a)", "()", "", "  ", None, " "]
    df = spark.createDataFrame([(c,) for c in odd], "c string")
    assert df.where(~T.multi_field(F.col("c")).eqNullSafe(T.multi_field(F.concat(F.coalesce("c", F.lit("")), F.lit("\n"))))).count() == 0
    # titles without a mark that a noise pattern needs stay as clean text leaves them
    names = spark.createDataFrame([(c,) for c in ["A  B", "A B -", "A (XY)", "A,", "[N00000001] A", None, "- A", "A B"]], "c string")
    assert [r[0] for r in names.select(T.clean_project_title(F.col("c"))).collect()] == ["A B", "A B", "A", "A", "", "", "A", "A B"]


def governance_rows(spark):
    from tidewatch.streaming import governance as G

    n = range(24)
    rows = [(f"P{e}", f"2020-{m % 12 + 1:02d}" if m < 12 else f"2021-{m % 12 + 1:02d}", "OBSERVE", 10 * m, [0.2, 0.7, 0.9, 0.6][(m + e) % 4]) for e in range(3) for m in n]
    rows += [(None, "2020-01", "OBSERVE", 3, 0.9), (None, "2020-01", "RESPOND", 4, None), ("P9", "2020-01", "RESPOND", 4, None)]
    rows += [(f"P{e}", "2020-01", "RESPOND", 10 * m + 5, None) for e in range(3) for m in n if m % 2]
    given = spark.createDataFrame(rows, "project_id string, reporting_month string, kind string, arrival_seq long, risk double")
    answer = F.col("kind") == "RESPOND"
    none = lambda t: F.lit(None).cast(t)
    return G, given.withColumns({
        "velocity": none("double"), "deviation": none("double"), "score": F.col("risk"), "persistence_cycles": none("int"), "warning_id": none("string"),
        "acknowledged": F.when(answer, F.col("arrival_seq") % 3 != 0), "response_text": F.when(answer, F.lit("seen")), "corrective_action": F.when(answer, F.lit("crews"))})


def test_governance_folds_once_and_sees_every_response(spark):
    G, events = governance_rows(spark)
    out = G.run_governance(events)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("ObjectHashAggregate(") == 2 and "Join" not in text  # one gathering, partial and final
    # the fold over all events, responses that it must refuse among them, gives the same rows
    plain = G.folded(events).select("project_id", F.inline("out"))
    named = "project_id is not null"  # rows without an entity share no warning
    assert out.count() == events.count() and out.where(named).exceptAll(plain.where(named)).count() == 0
    assert [r["outcome"] for r in out.where("project_id is null").orderBy("arrival_seq").collect()] == ["ISSUED", "RESPONSE_REJECTED"]
