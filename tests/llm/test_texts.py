"""Language ID, personal data, mixing, near duplicates, pages and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import dedup, html, langid, mixing, pii


def test_languages(spark):
    r = random.Random(0)
    words = {"xx": ["kato", "miru", "sane"], "yy": ["grünt", "schlaf", "zwerg"]}
    rows = [(i, " ".join(r.choices(words[k], k=12)), k, "clash") for i, k in enumerate(["xx", "yy"] * 60)]
    rows += [(900, None, "xx", ""), (901, "", "yy", ""), (902, "12 34 !!", None, ""), (903, "kato MIRU " * 90_000, None, ""), (904, rows[0][1], None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(df, ~langid.held_out())
    got = {x.doc_id: x for x in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows[:120])
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "xx" and got[904].score == got[0].score
    assert all(0 <= x.score <= 1 for x in got.values())
    none = langid.train(df.limit(0), F.lit(True))
    assert {x.lang_pred for x in langid.identify(df, none).collect()} == {"und"}


def test_long_texts_score_like_their_parts_together():
    model = langid.Model(["a", "b"], np.zeros(2), np.random.default_rng(0).standard_normal((langid.BUCKETS, 2)) / 1000)
    text = "".join(random.Random(1).choices("abcdefgh ", k=langid.PART_CHARS * 2 + 77))
    codes = langid._codes(text)
    want = sum(model.matrix[langid._buckets(codes, np.zeros(len(codes), np.int64), n)[0]].sum(axis=0) for n in langid.ORDERS)
    _, score = model.predict([text])
    assert score[0] == pytest.approx(1 / (1 + np.exp(-abs(want[0] - want[1]))), abs=1e-5)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_match_the_plain_patterns(spark):
    r = random.Random(5)
    texts = [None, "", "1.2.3.4.5.6.7.8 0001.002.3.000255 256.1.1.1 1.2.3.x.4", "a@b.com_x@y.org a@b a@c.d x@y@z.com é@b.c +a@b.co", "😀 +1 (234) 567-8901 é 4111 1111 1111 1111", "x" * 30000 + "@a" + ".b" * 9000, "1" * 50000, "4111111111111111", "5500 0000 0000 0004 12", "4111-1111-1111-1111"]
    texts += ["".join(r.choice("0123456789..@@+--  ab_%é😀()\n") for _ in range(r.randint(1, 80))) for _ in range(800)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for x in pii.summary(df).collect():
        want = base(texts[x.doc_id] or "")
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and x.spans.startswith(want)
    assert pii.summary(df.limit(0)).count() == 0


def test_context_finds_unseen_identifiers_and_leaves_others(spark):
    rows = [(i, f"name n{i % 3} badge: AB-{i}7731 thanks badge: u{i}@x.org ok") for i in range(40)] + [(i, f"plain the {i}12345 thing") for i in range(40, 60)]
    df = spark.createDataFrame([*rows, (60, None), (61, "")], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.summary(df).collect()}
    assert all("ctx:" in got[i] for i in range(40)) and not any("ctx" in got[i] for i in range(40, 62))
    masked = {x.doc_id: x.text for x in pii.redacted(df).collect()}
    assert masked[3] == "name n0 badge: <ctx> thanks badge: <email> ok" and masked[45] == rows[45][1] and masked[60] is None


def test_context_patterns_of_several_tokens_behind_a_quote(spark):
    rows = [(i, f'say key = "u{i}@x.org" here and there') for i in range(12)] + [(20 + i, f'then key = "ab{i}97731fe" went') for i in range(6)] + [(40 + i, f"let x = 5123456{i:02} end") for i in range(30)]
    got = {x.doc_id: x.spans for x in pii.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # one token (=) is known in 12 of 48 candidates, two (key =) in 12 of 18
    assert all(got[20 + i] == f"ctx:12:{12 + len(f'ab{i}97731fe')}" for i in range(6)) and not any(got[40 + i] for i in range(30))


def test_identifiers_of_any_length_and_far_contexts(spark):
    values = ["user@localhost", "@handle", "AB-123", "7", "s1" + "gn" * 200]
    rows = [(i, f"the badge is u{i}@x.org ok") for i in range(12)] + [(20 + i, f"the badge is{' ' * 90}{v} ok") for i, v in enumerate(values)]
    rows += [(30 + i, f"{'y' * 100} 9{i}x z") for i in range(5)]
    got = {x.doc_id: x.spans for x in pii.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[20 + i] for i in range(5)] == [f"ctx:102:{102 + len(v)}" for v in values] and not any(got[30 + i] for i in range(5))
    text = "y" * 100 + " 12345 " + "z" * 100
    near = pii.spans_table(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().free[0]
    assert (near.left, near.right) == (["y" * 100], ["z" * 100])


def test_contexts_of_dense_spans_match_a_plain_scan(spark):
    r = random.Random(8)
    texts = [" ".join(r.choice(["1", "a2", "x", "(b3)", "@", "a1@b.co", "+12 345 6789", "..", "4111 1111 1111 1111"]) for _ in range(r.randint(1, 25))) for _ in range(60)]
    texts += ["12a34a56a78a4111111111111111a55 x", "z" * 70 + " 1 2 " + "q" * 90]
    word = re.compile(r"[^\W]+|[^\w\s\"'`(){}<>\[\]]+")

    def sides(text, low, high):
        left, right = (word.findall(re.sub("[0-9]", "0", x.lower())) for x in (text[:low], text[high:]))
        return [" ".join(left[-n:]) for n in (1, 2, 3) if len(left) >= n], [" ".join(right[:n]) for n in (1, 2, 3) if len(right) >= n]

    rows = pii.spans_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(len(x.seeds) + len(x.free) for x in rows) > 300
    for x in rows:
        spans = [(s.start, s.end) for s in x.seeds]
        assert all(not any(a < s.end and s.start < b for a, b in spans) for s in x.free)
        for s in [*x.seeds, *x.free]:
            assert (s.left, s.right) == sides(texts[x.doc_id], s.start, s.end), texts[x.doc_id]


def test_long_texts_of_identifiers_take_linear_time(spark):
    import time

    text = " ".join(f"no. 55500{k:05} of u{k}@x.org," for k in range(8000)) + " " + " ".join(f"{k}x" for k in range(60000))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    began = time.perf_counter()
    rows = {x.doc_id: x for x in pii.spans_table(df).collect()}
    assert time.perf_counter() - began < 60
    assert len(rows[1].seeds) == 8000 and len(rows[1].free) == 68000 and rows[2].seeds == []
    spans = F.transform("seeds", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    got = pii.spans_table(df).filter("doc_id = 1").withColumn("text", F.lit(text)).select(pii.masked(F.col("text"), spans).alias("m")).first().m
    assert got == re.sub(r"u\d+@x\.org", "<email>", text)


def test_masked_joins_overlaps_and_keeps_other_columns(spark):
    kind = "array<struct<start:int,end:int,kind:string>>"
    rows = [("a" * 3000 + "é😀b", [(0, 5, "x"), (3, 1500, "y"), (1499, 1500, "z"), (1500, 2048, "w"), (3001, 3003, "v")])]
    got = spark.createDataFrame(rows, f"t string, s {kind}").select(pii.masked(F.col("t"), F.col("s"))).first()[0]
    assert got == "<x><w>" + "a" * 952 + "é<v>"
    df = spark.createDataFrame([(1, "mail a@b.co", "k", 7), (2, None, "l", 8)], "doc_id long, text string, _key string, _spans int")
    assert sorted(tuple(x) for x in pii.redacted(df).collect()) == [(1, "mail <email>", "k", 7), (2, None, "l", 8)]


def test_mix_reaches_targets(spark):
    def brute(rows):
        size = {}
        for _, t, s in rows:
            size[s] = size.get(s, 0) + len((t or "").split())
        names = sorted(s for s in size if s is not None) + [None] * (None in size)
        weight, total, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(size.values()), set()
        while True:
            rest, w = total - sum(3 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
            over = {s for s in names if s not in full and rest * weight[s] / w > 3 * size[s]}
            if not over:
                return {s: 3 * size[s] if s in full else rest * weight[s] / w for s in names}
            full |= over

    rows = [(1, "a b c", "x"), (2, "d " * 40, "y"), (3, "e " * 500, None), (4, "", "x"), (5, None, None), (6, "f", "zz"), (6, "f", "zz")] + [(i, "w " * (i % 7), "big") for i in range(100, 400)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, target double")
    got, again = (mixing.mix(x, shard_words=200, block_words=1).collect() for x in (df, df.repartition(7)))
    key = lambda x: (x.doc_id, x["size"], x.taken)
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    assert all(0 <= x.taken <= 3 * x["size"] for x in got)
    source = {i: s for i, _, s in rows}
    for s, target in brute(rows).items():
        own = [x for x in got if source[x.doc_id] == s]
        assert own[0].target == pytest.approx(target) and abs(sum(x.taken for x in own) - target) <= 4
    # the usual unit is the same for any table, and a target is met within a block or so
    usual = mixing.mix(df).collect()
    for s, target in brute(rows).items():
        assert abs(sum(x.taken for x in usual if source[x.doc_id] == s) - target) <= 1.5 * mixing.BLOCK_WORDS
    for few in ([], [(1, None, "a"), (2, "", None)]):
        assert {x.taken for x in mixing.mix(spark.createDataFrame(few, "doc_id long, text string, source string")).collect()} <= {0}


def near(rows, words=5, least=0.8):
    def grams(t):
        w = (t or "").split()
        return {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets, top, links = [grams(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and same / len(sets[i] | sets[j]) >= least:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    least_id = {}
    for k, (i, _) in enumerate(rows):
        least_id[root(k)] = min(least_id.get(root(k), i), i)
    return sorted((i, least_id[root(k)], links[k]) for k, (i, _) in enumerate(rows))


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "w%d" % r.randrange(500)
    rows = [(i, " ".join(word() for _ in range(r.choice([3, 5, 30, 80])))) for i in range(60)]
    for k in range(70):
        copy = r.choice(rows)[1].split()
        for _ in range(r.choice([0, 1, 1, 2])):
            copy[r.randrange(len(copy))] = word()
        rows.append((100 + k, " ".join(copy)))
    hot = [word() for _ in range(60)]
    rows += [(300 + k, " ".join([*hot[:58], word(), "z"])) for k in range(30)] + [(400, None), (401, ""), (402, " "), (403, ""), (5, rows[5][1])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, class_id int").repartition(4)
    monkeypatch.setattr(dedup, "BLOCK_TEXTS", 8)
    monkeypatch.setattr(dedup, "BUCKET_ROWS", 5)
    got = sorted(tuple(x) for x in dedup.near_duplicates(df).select("doc_id", "class_id", "n_links").collect())
    assert got == near(rows)
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def test_half_similar_texts_dont_chain(spark):
    # each text shares half of its n-grams with the next: one chain by chance buckets, no near copies
    texts = [" ".join(f"w{k}" for k in range(40 * i, 40 * i + 84)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dedup.near_duplicates(df).collect()
    assert all(x.n_links == 0 and x.class_id == x.doc_id for x in got)
    bands, rows = dedup.banding()
    sketches = np.array([dedup.signature(dedup.Shingles()(t), bands, rows)[1] for t in texts])
    least = 0.8 - dedup.SURE * np.sqrt(0.16 / (bands * rows))
    assert len(dedup.forest(sketches, int(np.ceil(least * bands * rows)))[0]) <= 3


def test_null_ids_keep_their_texts_links_and_classes(spark):
    import corpus_pipeline as cp

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    # a's near copy has only null ids, b's class has no id at all, c is alone
    rows = [(7, a), (None, a + " end"), (None, a + " end"), (9, a + " last"), (None, b), (None, b + " end"), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup.near_duplicates(docs).join(docs.select(F.md5("text").alias("text_key"), "text").distinct(), "text_key").collect()
    got = sorted((x.text[0], x.doc_id or 0, x.class_id or 0, x.n_links) for x in found)
    assert got == [("a", 0, 7, 3), ("a", 0, 7, 3), ("a", 7, 7, 3), ("a", 9, 7, 3), ("b", 0, 0, 1), ("b", 0, 0, 1), ("c", 0, 0, 0)]
    kept = sorted((x.text[0], x.doc_id or 0) for x in cp.near_duplicates(spark, docs, "").collect())
    assert kept == [("a", 7), ("b", 0), ("c", 0)]


def test_banding_reaches_its_recall():
    bands, rows = dedup.banding()
    assert 1 - (1 - dedup.THRESHOLD**rows) ** bands >= dedup.RECALL
    r, found = np.random.default_rng(0), 0
    for _ in range(100):
        pool = r.integers(0, 1 << 63, 220, dtype=np.uint64)
        a, b = (dedup.signature(np.unique(x), bands, rows)[0] for x in (pool[:200], pool[20:]))
        found += bool((a == b).any())
    assert found >= 99


def test_blocks_of_broken_pages():
    page = '<!DOCTYPE html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href="/x>y">home</a></nav><p>a &amp;lt;<b>b</b><br>c&nbsp; d<p>next<ul><li>one<li>two</ul><!-- <p>no --><style>p{}'
    found = html.blocks(page)
    assert [t for _, t, _ in found] == ["home", "a &lt;b c d", "next", "one", "two"]
    assert found[0][2] == 1.0 and "nav" in found[0][0].names()
    assert html.blocks(None) == html.blocks("") == html.blocks("<p></p>") == []


def test_heads_end_where_they_must():
    texts = lambda p: [t for _, t, _ in html.blocks(p)]
    assert texts("<html><head><title>t</title><p>hello main text</p>") == ["hello main text"]
    assert texts("<html><head><meta x><style>p{}</style>  plain <b>words</b>") == ["plain words"]
    assert texts("<head><title>t</title><link y></head><body>a") == ["a"]


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    found = html.blocks("<div class='row'>x" * 50_000 + "</p></section>" * 50_000)
    x, _, _ = html.features(found, html.Words())
    assert len(found) == 50_000 and np.isfinite(x).all() and time.perf_counter() - began < 30


def test_gradients():
    r = np.random.default_rng(0)
    size = html.PATH_SIZE + html.WORD_SIZE + html.SHARES
    model, rows = html.Labeller(3), [(r.standard_normal((n, size)).astype(np.float32), np.arange(2 * n) % 5, np.full(n, 2)) for n in (3, 5)]
    labels = [np.array([1, 0, 1], np.float32), np.array([0, 1, 1, 0, 0], np.float32)]
    _, (ahead, back, top, words) = model.step(rows, labels)
    for params, grads in ((model.ahead.p, ahead), (model.back.p, back), (model.top, top), (model.words, words)):
        for name, g in grads.items():
            at = tuple(int(r.integers(n)) for n in (g.shape if name != "e" else (5, g.shape[1])))
            params[name][at] += 1e-2
            up = model.step(rows, labels)[0]
            params[name][at] -= 2e-2
            down = model.step(rows, labels)[0]
            params[name][at] += 1e-2
            assert (up - down) / 2e-2 == pytest.approx(float(g[at]), abs=2e-3)


def test_words_and_layouts_count():
    model, make, buckets = html.trained(), html._Pages(99), html.Words()
    right = {False: 0, True: 0}
    for _ in range(120):
        found, labels = html.labelled(make.page())
        if found and make.plain:
            for blank in right:
                x, ids, sizes = html.features(found, buckets)
                made = (x, np.zeros_like(ids) if blank else ids, sizes)
                right[blank] += int(((model.probabilities([made])[0] >= 0.5) == labels).sum())
    assert right[False] > 1.1 * right[True]
    said = "The river rose again over the night and the people of the village left their houses for the hills."
    table = f"<table><tr><td><a href='/'>Home</a> <a href='/a'>About us</a></td></tr><tr><td>{said}</td></tr><tr><td>Copyright 2020 all rights reserved</td></tr></table>"
    divs = f"<div><div><a href=/>Home</a></div><div><a href=/x>Contact</a></div></div><div><div>{said}</div><div>{said}</div></div><div>We use cookies to improve your experience. Accept</div>"
    pages = [f"<body><p>{said}</p></body>", said, table, divs, "<html><head><title>t</title><p>" + said]
    assert html.main_texts(pages, model, buckets) == [said, said, said, f"{said} {said}", said]


def test_labeller_on_pages_it_has_not_seen(spark):
    model, make, buckets, right, all_blocks = html.trained(), html._Pages(99), html.Words(), 0, 0
    for _ in range(150):
        found, labels = html.labelled(make.page())
        if found:
            right += int(((model.probabilities([html.features(found, buckets)])[0] >= 0.5) == labels).sum())
            all_blocks += len(labels)
    assert right / all_blocks > 0.97
    page = "<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><article><h1>A title</h1><p>First  words &amp; more of them here.</p><p>Then some.</p></article><footer>&copy; 2020 all rights reserved</footer></body>"
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "", "", 1), (4, "u", page, 1)], "page_id long, url string, html string, text int")
    got = {x.page_id: x for x in html.extract(df, model).collect()}
    assert got[1].text == got[4].text == "A title First words & more of them here. Then some." and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")


def test_pages_of_the_test_tables(spark, data):
    rows = html.extract(spark.read.parquet(f"{data}/pages.parquet")).collect()
    pages = {x.page_id: x.html for x in spark.read.parquet(f"{data}/pages.parquet").collect()}
    want = {i: " ".join(t for path, t, _ in html.blocks(p) if "article" in path.names()) for i, p in pages.items()}
    assert sum(x.text == want[x.page_id] for x in rows) >= 0.98 * len(rows)


def test_held_out_languages(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = langid.identify(df.select("doc_id", "text", "lang"), langid.train(df, ~langid.held_out())).filter(langid.held_out()).collect()
    assert sum(x["lang"] == x.lang_pred for x in rows) >= 0.97 * len(rows)


def test_mixed_documents_keep_each_source_near_its_target(spark):
    import corpus_pipeline as cp

    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.randint(1, 12))), "en", r.choice(["a", "b", "c", None]), 1) for i in range(1200)]
    docs = spark.createDataFrame([*rows, (None, "one two three", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    size, target = F.size(F.split("text", " ")), {}
    for x in mixing.mix(docs.withColumn("_key", F.md5(F.concat_ws(":", "doc_id", "text"))).withColumn("doc_id", F.col("_key"))).join(docs.groupBy("source").agg(F.sum(size).alias("source_size")), "source_size").select("source", "target").distinct().collect():
        target[x.source] = x.target
    got = {x.source: x.n for x in cp.mixed(spark, docs, "").groupBy("source").agg(F.sum(size).alias("n")).collect()}
    assert len(target) == 4 and all(abs(got[s] - target[s]) <= 12 for s in target)


def test_stages_leave_clashing_columns_as_they_are(spark, data):
    import corpus_pipeline as cp
    from quarry.llm.common import materialised

    words = "the dog runs fast through a forest and then it sleeps"
    rows = [(k, f"{words} number {k} of many here " + "again and so on " * k, "en", "s", "key", k, "spans", 0.5, "pred") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _key string, _copy int, _spans string, size double, score string")
    for name, stage in cp.STAGES[:-1]:
        left = materialised(stage(spark, docs, data), name)
        assert left.columns == docs.columns and left.count() and {tuple(x)[4:] for x in left.collect()} <= {r[4:] for r in rows}


def test_pipeline_stages(spark, data):
    import corpus_pipeline as cp
    from quarry.llm.common import materialised

    rows = [(1, "der hund läuft schnell durch den wald und schläft", "de", "a", 5), (1, "the dog runs fast through a forest and then it sleeps", "en", "a", 5), (2, "the dog runs fast through a forest and then it sleeps", "en", None, 5), (3, None, "en", "b", 0), (4, "12 !!", None, "b", 5), (5, "write to me@mail.org about the house and the garden", "en", "b", 1)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")):
        columns, left = docs.columns, []
        for name, stage in cp.STAGES:
            docs = materialised(stage(spark, docs, data), name)
            left.append(docs.count())
            assert name == "packing" or docs.columns == columns
        assert left[:3] in ([4, 3, 3], [0, 0, 0])
