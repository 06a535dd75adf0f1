import random

from lectern.llm.common import components


def test_components_against_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5), (2100, 2000)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def test_tables_are_sent_by_what_their_rows_hold(spark, monkeypatch):
    from lectern.llm import common

    rows = spark.createDataFrame([("x" * 1000, [("ab", [1, 2])], ["q" * 10], None)] * 3, "s string, a array<struct<t:string,n:array<int>>>, l array<string>, e array<string>")
    total = rows.select(*(common.width(rows[f.name], f.dataType).alias(f.name) for f in rows.schema.fields)).first()
    assert total["s"] == 1016 and total["l"] == 42 and total["a"] == 16 + 16 + 18 + 32 and total["e"] == 8
    hinted = lambda: "strategy=broadcast" in common.sent_by_width(rows)._jdf.queryExecution().analyzed().toString()
    assert hinted()
    monkeypatch.setattr(common, "SENT_BYTES", 3000)
    assert not hinted()
