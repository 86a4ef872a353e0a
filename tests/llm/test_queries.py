"""The registered queries, and the SQL of those that have it."""

from quarry.llm.queries import ORACLES, QUERIES


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_topk_against_sql(spark, data, oracle):
    got = QUERIES["op10_exact_topk"](spark, data)
    columns, want = oracle(ORACLES["op10_exact_topk"])
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want)
