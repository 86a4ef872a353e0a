"""Queries without SQL do the whole job: no rows, words or weights are left out."""

import heapq

from pyspark.sql import functions as F

from quarry.plans import registry

QUERIES = registry.collect("QUERIES")


def test_shortest_paths_run_on_all_line_items(spark, data, oracle):
    _, rows = oracle("SELECT c_custkey, s_suppkey + 1000000, min(l_quantity) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
    near = {}
    for a, b, w in rows:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    want, heap = {}, [(0.0, min(near))]
    while heap:
        x, n = heapq.heappop(heap)
        if n not in want:
            want[n] = x
            for b, w in near[n]:
                heapq.heappush(heap, (x + w, b))
    got = {r.node: r.distance for r in QUERIES["shortest_paths"](spark, data).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-6 for n in want)


def test_components_of_the_whole_graph(spark, data, oracle):
    _, rows = oracle("SELECT DISTINCT c_custkey, s_suppkey + 1000000 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey")
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in rows:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    want = {}
    for x in list(top):
        want[root(x)] = want.get(root(x), 0) + 1
    assert {r.component: r.n for r in QUERIES["connected_components"](spark, data).collect()} == want


def test_whole_texts_are_encoded(spark, data):
    from quarry.operators import text

    words = {r.doc_id: r.w or [] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", text.tokens(F.col("text")).alias("w")).collect()}
    got = {r.doc_id: r.ids.split() for r in QUERIES["encode_padded"](spark, data).collect()}
    assert got.keys() == words.keys()
    term = {}
    for i, ids in got.items():
        assert len(ids) == len(words[i]) and all(int(x) > 1 for x in ids)
        assert all(term.setdefault(x, w) == w for x, w in zip(ids, words[i]))
    assert len(term) == len({w for ws in words.values() for w in ws})


def test_topics_give_weights_from_all_words(spark, data):
    got = QUERIES["topics"](spark, data).collect()
    assert all(len(r.weights) == 4 and abs(sum(r.weights) - 1) < 1e-5 for r in got)
    rare = " ".join(f"rare{k}" for k in range(300))
    from quarry.operators import ensembles

    docs = spark.createDataFrame([(1, "a b " * 9), (2, rare), (3, "")], "doc_id long, text string")
    assert len({tuple(round(x, 3) for x in r.weights) for r in ensembles.topics(docs, "doc_id", "text", 2, None, 2).filter("id <> 3").collect()}) == 2
