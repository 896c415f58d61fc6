"""Property-based check of the number parser against the documented rule (STR-1)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weekcraft.functions import clean as C

NUMBER = re.compile(r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?")


def rule(x):
    """The documented rule, written plainly: strip; drop $ % and spaces; with both separators
    the dot groups thousands and the comma is decimal; a lone comma is decimal."""
    if x is None:
        return None
    t = x.strip().replace("$", "").replace("%", "").replace(" ", "")
    if "." in t and "," in t:
        t = t.replace(".", "").replace(",", ".")
    elif "," in t:
        t = t.replace(",", ".")
    return float(t) if NUMBER.fullmatch(t) else None


texts = st.text(alphabet="0123456789.,$% -+e ", max_size=10)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), texts), min_size=50, max_size=200))
def test_clean_number_matches_rule(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", C.clean_number(F.col("x")).alias("y")).collect()}
    assert got == {i: rule(x) for i, x in enumerate(xs)}
