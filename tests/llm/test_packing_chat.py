import hashlib
import random

import numpy as np

from quarry.llm import chat, packing


def test_fullest_matches_brute_force():
    from itertools import product

    r = random.Random(0)
    for _ in range(60):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(4)}
        room = r.randint(1, 70)
        best = max(s for s in (sum(k * n for k, n in zip(counts, pick)) for pick in product(*(range(v + 1) for v in counts.values()))) if s <= room)
        got = packing.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


def test_plan_places_every_piece_once_and_is_tight():
    r = random.Random(1)
    lengths = [min(64, int(r.expovariate(1 / 20)) + 1) for _ in range(3000)]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    bins, seen = {}, {}
    for x, lo, hi, first, per, offset in packing.plan(histogram, 64):
        for rank in range(lo, hi):
            seen.setdefault(x, set()).add(rank)
            bins.setdefault(first + (rank - lo) // per, []).append((offset + (rank - lo) % per * x, x))
    assert {x: len(s) for x, s in seen.items()} == histogram
    for parts in bins.values():
        at = 0
        for offset, x in sorted(parts):
            assert offset == at
            at += x
        assert at <= 64
    assert len(bins) <= -(-sum(lengths) // 64) + 1


def test_pieces():
    assert packing.pieces_of(5, 4) == [(0, 1), (1, 4)] and packing.pieces_of(8, 4) == [(0, 4), (4, 4)] and packing.pieces_of(3, 4) == [(0, 3)]


def test_pack_nulls_repeats_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "a " * 50), (4, "a " * 7)], "doc_id long, text string").repartition(3)
    encode = lambda: lambda ts: [np.ones(len(t.split()), "<u4").tobytes() for t in ts]
    for k, rows in enumerate((df, df.limit(0))):
        packing.cut_pieces(rows, encode, capacity=8).write.parquet(str(tmp_path / f"p{k}"))
    got = packing.pack(spark.read.parquet(str(tmp_path / "p0")), 8).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted([(1, 0, 1), (1, 0, 1), (2, 0, 1), *((3, k, x) for k, x in enumerate([3] + [8] * 6)), (4, 0, 8)])
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and len({r.sequence_id for r in got}) == 8
    assert packing.pack(spark.read.parquet(str(tmp_path / "p1")), 8).count() == 0


def _tree(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_best_branches_of_a_tree(spark):
    rows = [(1, 1, None, "user", "hi", 1.0), (1, 2, 1, "assistant", "a", 5.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 3, "user", "c<>\\[", 4.0), (1, 5, 4, "x]y", "\\", None)]
    rows += [(2, 1, 9, None, None, 0.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0)]
    found = chat.best_paths(_tree(spark, rows), 2)
    paths = {}
    for r in sorted(found.collect(), key=lambda r: r.depth):
        paths.setdefault((r.tree, r.branch), []).append(r.node)
    assert paths == {(1, 1): [1, 3, 4, 5], (1, 2): [1, 2], (2, 1): [1]}
    said = {(r.tree, r.branch): chat.parsed(r.formatted) for r in chat.formatted_paths(found).collect()}
    assert [t[:2] for t in said[1, 1]] == [("user", "hi"), ("assistant", "b"), ("user", "c<>\\["), ("x]y", "\\")]
    assert [t[:2] for t in said[2, 1]] == [("", "")]
    assert chat.best_paths(_tree(spark, [])).count() == 0


def test_long_linear_conversations(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "[", "a\nb", "", None, "<s>x</s>", "\\[/INST]"]
    rows = [(7, t, "assistant" if t % 2 else "user", odd[t % len(odd)]) for t in range(70)] + [(8, 0, "user", "x"), (8, 0, "user", "x"), (9, None, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.summaries(chat.formatted_paths(chat.best_paths(chat.linear_trees(df)))).collect()}
    turns = [(r, x or "") for c, _, r, x in rows if c == 7]
    loss = "".join(x for r, x in turns if r == "assistant")
    assert got[7].n_turns == 70 and got[7].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    assert (got[7].loss_chars, got[7].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[8].n_turns == 2 and got[9].loss_chars == 0


def test_op9_alone_keeps_chunks_beyond_the_default(spark, monkeypatch):
    from quarry.llm import tokens

    made = []

    def encoder_of(texts, encode_with, **_):
        encode_with()
        return texts.sparkSession.createDataFrame([], packing.PIECES_DDL)

    monkeypatch.setattr(tokens, "chunk_ids", lambda path, kind="<u4", kept=None: made.append(kept))
    monkeypatch.setattr(packing, "cut_pieces", encoder_of)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(packing, "table", lambda *_: docs)
    assert packing.op9_packing(spark, "").count() == 0
    assert packing.packed_documents(docs).count() == 0
    assert made == [packing.KEPT_CHUNKS, None] and packing.KEPT_CHUNKS > tokens.KEPT
