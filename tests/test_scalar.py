import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citetrace.functions import identifiers as ids
from citetrace.sources import readers


def values(spark, expression, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expression(F.col("t")).alias("v"))
    return [str(r.v) if r.v is not None else None for r in rows.orderBy("i").collect()]


# Sentinel texts and the order of date formats are fixed values of the rules that are tested.
CASES = {
    "doi": (
        ids.doi,
        {
            "https://doi.org/10.98765/X.Y-7": "10.98765/x.y-7", "http://dx.doi.org/10.4000/books(12)": "10.4000/books(12)", "DOI: 10.5555/Late": "10.5555/late",
            "cf. https://doi.org/10.7777/in/text in the text": "10.7777/in/text", " 10.1234/abc.; ": "10.1234/abc", "10.short/a": "10.short/a",
            "": None, "unavailable": None, "n/a": None, "NA": None, "none": None, "null": None, "0": None, None: None,
        },
    ),
    "pmid": (ids.pmid, {"PMID: 123456": "123456", "0": None, "0.0": None, "unavailable": None, "n/a": None, "na": None, None: None, "abc": None}),
    "date": (
        ids.parse_date,
        {
            "12/9/2017 0:00": "2017-12-09", "2017-12-09": "2017-12-09", "12/9/2017": "2017-12-09", "2017/12/9": "2017-12-09", "2017-12": "2017-12-01", "2017": "2017-01-01",
            "03/04/2020": "2020-03-04", "13/04/2020": "2020-04-13", "2024-13": None, "0000-00-00": None, "0": None, "": None, None: None, "soon": None,
        },
    ),
    "author": (ids.author_last_name, {"Ada M. van Dyke; Other": "Dyke", "  ;  ": None, None: None, "": None, "Solo": "Solo"}),
    "text": (ids.as_text, {" a ": "a", "\t\n": None, "": None, None: None}),
    "xml": (ids.xml_text, {"a&b<c>\"'": "a&amp;b&lt;c&gt;&quot;&apos;", "": ""}),
    "node": (lambda c: ids.node_doi(ids.doi_node(c)), {"DOI:10.1234/X": "10.1234/x", None: None}),
    "pid": (lambda c: ids.pid(c, "pmid"), {"doi:10.1/a pmid:123456 pmcid:PMC789": "123456", "PMID:9": "9", "xpmid:1": None, None: None}),
}


@pytest.mark.parametrize("name", CASES)
def test_scalars(spark, name):
    expression, cases = CASES[name]
    assert values(spark, expression, list(cases)) == list(cases.values())


def test_notices(spark):
    got = values(spark, lambda c: ids.is_notice(c).cast("string"), ["Correction; Retraction", "Expression of Concern", "Correction", None])
    assert got == ["true", "true", "false", "false"]


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(max_size=30), min_size=1, max_size=10))
def test_doi_is_idempotent(spark, texts):
    once = values(spark, ids.doi, texts)
    assert values(spark, ids.doi, once) == once


def test_an_input_is_worked_out_once(spark):
    """Expressions over expressions stay small: none names its input twice where all rows go through it."""
    citing, cited, creation = F.concat(F.lit("doi:10.1000/a pmid:"), "id"), F.concat(F.lit("doi:10.1000/b"), "id"), F.date_format(F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")), "yyyy-MM")
    out = readers.citations_from_pids(spark.range(4), citing, cited, creation)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") <= 9 and plan.count("date_format") <= 3
    assert [tuple(map(str, r)) for r in out.orderBy("citing_pmid").collect()][1] == ("10.1000/a", "1", "10.1000/b1", "2020-01-01")


def test_texts_that_are_no_identifier(spark):
    assert values(spark, ids.doi, ["doi: N/A.", " https://doi.org/ ", "NULL;", "nullable", "0.", "00", "doi:none such"]) == [None, None, None, "nullable", None, "00", "none such"]
    assert values(spark, ids.pmid, [" 0 ", "0.0", "0.05", "10", "n/a 7", "\n12", "00"]) == [None, None, "0", "10", "7", "12", "00"]
    texts = [" 2017-1-9 x", "2017-1", "2017/12", "2017-12/09", "2017-02-30", "2/30/2017", "30/2/2017", "\t31/12/1999\n", "2017-12-09T00:00", "2017\n 1", "99999-01-01", "1/1/17"]
    assert values(spark, ids.parse_date, texts) == ["2017-01-09", None, None, None, None, None, None, "1999-12-31", None, None, None, None]
