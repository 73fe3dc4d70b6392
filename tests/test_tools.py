"""SQL functions, name matching and named tools."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import names
from quillgraph.functions.register import register
from quillgraph.plans import tools


def test_sql_functions(spark):
    assert "connection_strength" in register(spark)
    r = spark.sql(
        "SELECT connection_strength(0.5, 0.05, 0, 1, 1) s, seniority_tier(76) t, domain_from_title('VP of Research') d, seniority_from_title('VP of Research') y,"
        " attribution_keys_ok(map('a', 0.5D), array('a', 'b')) ok, attribution_keys_ok(map('c', 0.5D), array('a')) bad"
    ).first()
    assert (round(r.s, 9), r.t, r.d, r.y, r.ok, r.bad) == (0.55, "svp", "research", 70, True, False)


def test_names(spark):
    df = spark.createDataFrame([("  José  Álvarez ", "jose alvarez"), (None, "x"), ("", "y")], "a string, b string")
    got = df.select(names.folded("a").alias("f"), names.similarity("a", "b").alias("s")).collect()
    assert [(r.f, r.s) for r in got] == [("jose alvarez", 1.0), (None, 0.0), ("", 0.0)]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (("https://www.x.com/in/ann/", None, "A", None), ("http://x.com/in/ann?q=1", None, "B", None), True),
        (("x.com/ann", "a@b.c", "Ann Lee", "Acme"), ("x.com/bob", "A@b.c ", "Bob", None), False),
        (("x.com/ann", "a@b.c", "Ann Lee", "Acme"), (None, "A@b.c ", "Bob", None), True),
        (("x.com/ann", "a@b.c", "Ann Lee", "Acme"), (None, "b@b.c", "Ann Lee", "Acme"), False),
        (("x.com/ann", None, "Ann Lee", "Acme"), ("x.com/bob", None, "Ann Lee", "Acme"), False),
        ((None, None, "Ann Lee", "Acme Inc"), (None, None, "ann B. Lee", "acme"), True),
        ((None, None, "Jonathan Lee", "Acme"), (None, None, "Jonathon Lee", "Acme"), True),
        ((None, None, "Ann Lee", "Acme"), (None, None, "Ann Lee", "Contoso"), False),
        ((None, None, None, None), (None, None, None, None), False),
    ],
)
def test_same_person(spark, a, b, want):
    kind = "struct<url:string,email:string,name:string,company:string>"
    df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    assert df.select(names.same_person(F.col("a"), F.col("b")).alias("x")).first().x == want


def test_tools(spark):
    edges = spark.createDataFrame([(1, 2, 0.9, "t"), (2, 3, 0.8, "t"), (3, 4, 0.5, "u"), (1, 4, 0.31, "t")], "a long, b long, strength double, type string")
    got = {(r.connector, round(r.strength, 3), r.path) for r in tools.call("find_warm_paths", {"edges": edges}, target=1).collect()}
    assert got == {(2, 0.9, "1>2"), (3, 0.72, "1>2>3"), (4, 0.36, "1>2>3>4")}
    assert tools.call("top_partners", {"edges": edges}, k=1).count() == 4
    for bad in ({"k": "x"}, {"z": 1}):
        with pytest.raises(ValueError):
            tools.call("top_partners", {"edges": edges}, **bad)
    with pytest.raises(ValueError):
        tools.call("nothing", {})
