import zlib

import numpy as np
import pytest

from quarry.llm import media, rans


@pytest.mark.parametrize("kind", [None, 0, 1, 2, 3, 4])
@pytest.mark.parametrize("text", ["", "abc", "naïve – text " * 40, "x" * 128])
def test_png_round_trip(kind, text):
    n, payload = media.payload_of(text)
    assert n == len(text.encode()) and len(payload) % 64 == 0 and payload
    assert media.read_png(media.png(payload, kind)).tobytes() == payload


def test_mixed_filters():
    r = np.random.default_rng(0)
    image = r.integers(0, 256, (60, 64)).astype(np.uint8)
    rows = np.concatenate([media.filtered(image, int(k))[i:i + 1] for i, k in enumerate(r.integers(0, 5, 60))])
    assert (media.unfiltered(rows) == image).all()


def test_damage_is_found():
    stored = bytearray(media.png(media.payload_of("some text")[1]))
    for at in (0, 20, 45, len(stored) - 3):
        bad = bytearray(stored)
        bad[at] ^= 1
        with pytest.raises(media.CorruptImage):
            media.read_png(bytes(bad))
    with pytest.raises(media.CorruptImage):
        media.read_png(bytes(stored[:-6]))


def test_media_columns(spark):
    df = spark.createDataFrame([(1, "a", 9), (2, None, 9), (2, None, 9), (3, "ü" * 5000, 9)], "doc_id long, text string, media long")
    rows = sorted(media.media_features(media.with_media(df)).collect(), key=lambda r: r.doc_id)
    assert [r.n_bytes for r in rows] == [1, 0, 0, 10000]
    assert rows[1] == rows[2] and rows[1].payload_bytes == 64 and rows[1].tail_crc32 == zlib.crc32(bytes(64))
    assert media.media_features(media.with_media(df.limit(0))).count() == 0


def test_near_images_have_near_hashes():
    text = "the quick brown fox jumps over the lazy dog " * 50
    a, b = (media.cosine_hash(media.read_png(media.png(media.payload_of(t)[1]))) for t in (text, text[:-4] + "cat "))
    assert bin(int(a, 16) ^ int(b, 16)).count("1") <= 6


@pytest.mark.parametrize("documents", [[], [[5]], [[]], [[7] * 70000], [list(range(49000))], [[1, 2], [], [3] * 3000, list(range(2000)) * 140]])
def test_segments_round_trip(documents):
    arrays = [np.array(d, np.uint32) for d in documents]
    segment = rans.Segment(rans.write_segment(arrays))
    assert [d.tolist() for d in segment.documents()] == [list(d) for d in documents]
    for k, (_, marks, _, _) in enumerate(segment.blocks):
        assert (np.concatenate([segment.from_checkpoint(k, m) for m in range(len(marks))]) == segment.block(k)).all()


def test_damaged_segment():
    data = bytearray(rans.write_segment([np.arange(500, dtype=np.uint32)]))
    data[len(data) // 2] ^= 4
    with pytest.raises(rans.CorruptSegment):
        rans.Segment(bytes(data))


def test_files_keep_order_and_count_before(spark, tmp_path):
    rows = [(5, "b c"), (1, "a"), (None, "z"), (3, None), (9, ""), (7, "a " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rans.write_ids(df, str(tmp_path / "ids"), lambda: lambda ts: [np.array([len(w) for w in t.split()], "<u2").tobytes() for t in ts], shards=3)
    got = {r.doc_id: r for r in rans.read_ids(spark, str(tmp_path / "ids")).collect()}
    at = 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        ids = np.array([len(w) for w in (t or "").split()] + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rans.write_ids(df.limit(0), str(tmp_path / "none"), lambda: lambda ts: [])
    assert rans.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_tokens_equal_the_library():
    P = pytest.importorskip("public_tokenizers")
    import random

    from tokenizers import Tokenizer

    from quarry.llm.tokens import ChunkIds

    r = random.Random(4)
    texts = ["", "  ", " ", " a", "a ", "a\x1cb", "a\x1c b", "Don't I'LL _x__ 12_3 x²", "<|endoftext|> a", "a <|startoftext|>b <|endoftext|> c", "ΣΑΣ ﬁ 日本語", "x" * 3000, "İß º", "a  b\n\n c \t d "]
    texts += ["".join(r.choice("ab'strDL1 _.,!é\n-$<|²Ώ\u0301\xa0\u2003") for _ in range(r.randint(1, 60))) for _ in range(400)]
    # every character of the first plane before and after a cut
    points = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"x{c} y {c}z{c}  q" for c in points[k:k + 256]) for k in range(0, len(points), 256)]
    for name, kind in (("word_bpe_49k.json", "<u2"), ("byte_bpe_50k.json", "<u4")):
        chunks, library = ChunkIds(P.path(name), kind), Tokenizer.from_file(P.path(name))
        for _ in range(2):
            for t, got, e in zip(texts, chunks(texts), library.encode_batch(texts, add_special_tokens=False)):
                assert np.frombuffer(got, kind).tolist() == e.ids, t


def test_full_stores_of_chunks_stay_bounded(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from quarry.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 5)
    chunks = tokens.ChunkIds(P.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{k}{j}" for j in range(4)) for k in range(9)]
    want = tokens.ChunkIds(P.path("byte_bpe_50k.json"))(texts)
    assert [chunks([t])[0] for t in texts] == want and len(chunks.later) <= 9


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "<u4"), ("word_bpe_49k.json", "<u2")])
def test_new_chunks_are_encoded_together(name, kind):
    P, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers").Tokenizer
    import random

    from quarry.llm import tokens

    draw = random.Random(5)
    texts = ["".join(draw.choice("ab Z9'., \n\u00a0\u0301\u00a8\u4e2d\x01") for _ in range(draw.randint(0, 60))) for _ in range(2000)] + ["", " ", "a ", " a", "\x01 \x01"]
    chunks, calls = tokens.ChunkIds(P.path(name), kind), []
    encode = chunks.encode
    chunks.encode = lambda given, **more: calls.append(len(given)) or encode(given, **more)
    want = [np.array(e.ids, kind).tobytes() for e in library.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
    assert chunks(texts) == want
    calls.clear()
    # 640 words not seen before: runs of 64, nothing one by one but the first chunk
    words = [f"word{k}x" for k in range(641)]
    assert chunks([" ".join(words)]) == [np.array(library.from_file(P.path(name)).encode(" ".join(words), add_special_tokens=False).ids, kind).tobytes()]
    assert sum(calls) <= 12


def test_kept_chunks_take_little_memory():
    P = pytest.importorskip("public_tokenizers")
    import sys

    from quarry.llm import tokens

    chunks = tokens.ChunkIds(P.path("byte_bpe_50k.json"))
    for at in range(0, 300_000, 30_000):
        chunks([" ".join(f"word{k}x" for k in range(at, at + 30_000))])
    assert sys.getsizeof(chunks.later) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in chunks.later.items()) < 30e6


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "<u4"), ("word_bpe_49k.json", "<u2")])
def test_new_chunks_with_white_space_are_encoded_together(name, kind):
    P, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers").Tokenizer
    from quarry.llm import tokens

    chunks, calls = tokens.ChunkIds(P.path(name), kind), []
    encode = chunks.encode
    chunks.encode = lambda given, **more: calls.append(len(given)) or encode(given, **more)
    # lines that end within a chunk, white space before a space, a chunk of nothing but white space at the end, the mark
    text = " ".join(f"end{k}.\nWord{k} a\n\t  b{k}" for k in range(700)) + " a\x01b \x01\n\x01 \n "
    assert chunks([text]) == [np.array(library.from_file(P.path(name)).encode(text, add_special_tokens=False).ids, kind).tobytes()]
    assert sum(calls) <= 15


def test_op7_keeps_chunks_beyond_the_default(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import sys

    from quarry.llm import tokens

    made = {}
    monkeypatch.setattr(tokens, "_made", made)
    monkeypatch.setattr(rans, "table", lambda *_: None)
    monkeypatch.setattr(rans, "shared_dir", lambda *_: "")
    monkeypatch.setattr(rans, "read_ids", lambda *_: None)
    monkeypatch.setattr(rans, "write_ids", lambda texts, path, encoder: encoder())
    rans.op7_rans(None, "")
    (chunks,) = made.values()
    for at in range(0, 600_000, 30_000):
        chunks([" ".join(f"word{k}x" for k in range(at, at + 30_000))])
    calls, encode = [], chunks.encode
    chunks.encode = lambda given, **more: calls.append(len(given)) or encode(given, **more)
    chunks([" ".join(f"word{k}x" for k in range(300_000))])
    # only the first chunk and a run of those that began a text are encoded, and the store stays bounded
    assert sum(calls) == 2
    assert sys.getsizeof(chunks.later) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in chunks.later.items()) < 100e6


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "<u4"), ("word_bpe_49k.json", "<u2")])
def test_runs_of_words_have_no_marks(name, kind):
    P, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers").Tokenizer
    from quarry.llm import tokens

    chunks, given = tokens.ChunkIds(P.path(name), kind), []
    encode = chunks.encode
    chunks.encode = lambda texts, **more: given.extend(texts) or encode(texts, **more)
    text = " ".join(f"x{'abcdefghij'[k % 10] * (k // 10 + 1)} Été{'abcdefghij'[k % 10] * (k // 10 + 1)} x{'klmnopqrst'[k % 10] * (k // 10 + 1)}," for k in range(200))
    assert chunks([text]) == [np.array(library.from_file(P.path(name)).encode(text, add_special_tokens=False).ids, kind).tobytes()]
    # 600 words: runs of 128, and what begins the text
    assert len(given) <= 8 and not any(tokens.MARK in t for t in given)


def test_ascii_in_both_cases_is_stored_once():
    P, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers").Tokenizer
    from quarry.llm import tokens

    path = P.path("word_bpe_49k.json")
    chunks, whole = tokens.ChunkIds(path, "<u2"), library.from_file(path)
    points = [chr(k) for k in range(128)]
    texts = ["a Word word WORD, wOrd, DON'T don't <|ENDOFTEXT|> <|EndOfText|>x", *(f"a A{c}B a{c}b {c}B {c}b B{c} b{c} {c}" for c in points), *(f"a X{c}{d} x{c}{d}Y {c}X{d}" for c in points for d in points)]
    for _ in range(2):
        for text, got, e in zip(texts, chunks(texts), whole.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(got, "<u2").tolist() == e.ids, text
    assert {"word", "word,", "don't"} <= set(chunks.later) and not any(w.isascii() and w != w.lower() for w in chunks.later)


def test_runs_with_other_counts_of_pieces_are_encoded_one_by_one():
    P, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers").Tokenizer
    from quarry.llm import tokens

    for name, kind in (("byte_bpe_50k.json", "<u4"), ("word_bpe_49k.json", "<u2")):
        chunks, whole = tokens.ChunkIds(P.path(name), kind), library.from_file(P.path(name))
        # letters that lower case takes apart, digits, marks and characters of other planes beside plain words
        words = [w for k in range(300) for w in (f"W{'ab'[k % 2] * (k % 60)}", f"İ{'ab'[k % 2] * (k % 60)}", f"ŉé{k}", f"Σ{'σ' * (k % 9)}Σ", "áb'", f"{chr(0x10400 + k)}x", "'s", "x'")]
        want = [np.array(e.ids, kind).tobytes() for e in whole.encode_batch([f" {w}" for w in words], add_special_tokens=False)]
        assert chunks._encoded(words) == want
        assert chunks([" ".join(words)]) == [np.array(whole.encode(" ".join(words), add_special_tokens=False).ids, kind).tobytes()]
