"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows, in parallel, into one
row a language and bucket; the matrix of log probabilities has a fixed number of
buckets a language and is broadcast. Scoring hashes a batch of texts at once in numpy
and adds up matrix rows by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import unused

ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: Expected rows of a language in the training sample. All are taken if there are fewer.
SAMPLE_ROWS = 3000
#: Characters hashed at a time, which bounds a worker's memory; long texts go in parts.
PART_CHARS = 1 << 17
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point, whether it's a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-case code points, all but letters as one space each, a space at both ends."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[a], a, np.uint32(32))


def _parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of several texts, and the number of the text at each; 0 keeps texts
    apart. A text longer than a part goes on in the next, n-grams across included."""
    gap, codes, owners, held = max(ORDERS) - 1, [], [], 0

    def flush():
        return np.concatenate(codes), np.concatenate(owners)

    for k, text in enumerate(texts):
        if not text:
            continue
        whole = _codes(text)
        for at in range(0, len(whole), PART_CHARS):
            # windows start in the first PART_CHARS places and may reach gap beyond
            part = whole[at:at + PART_CHARS + gap]
            codes += [part, np.zeros(gap, np.uint32)]
            owner = np.full(len(part) + gap, k, np.int64)
            owner[min(len(part), PART_CHARS):] = -1
            owners.append(owner)
            held += len(part)
            if held >= PART_CHARS:
                yield flush()
                codes, owners, held = [], [], 0
    if codes:
        yield flush()


def _buckets(codes: np.ndarray, owners: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of one order that have a letter, and their texts."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, letter = np.full(n, order, np.uint64), np.zeros(n, bool)
    for k in range(order):
        c = codes[k:k + n]
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        letter |= c != 32
    use = letter & (owners[:n] >= 0) & (codes[:n] != 0) & (codes[order - 1:order - 1 + n] != 0)
    return (h[use] >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), owners[:n][use]


def training_counts(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n: how often n-grams of a bucket stand in a language's texts."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1)
            for lang in set(langs):
                counts = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for codes, owners in _parts(texts.filter(pa.array(langs == lang)).to_pylist()):
                    for order in ORDERS:
                        counts += np.bincount(_buckets(codes, owners, order)[0], minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], schema=schema)

    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(grams, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, log priors, and log probabilities by bucket and language."""

    def __init__(self, languages: list[str], priors: np.ndarray, matrix: np.ndarray):
        self.languages, self.priors, self.matrix = languages, priors, matrix

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its posterior probability; und and 0 without letters."""
        k = len(self.languages)
        total, grams = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        if k:
            for codes, owners in _parts(texts):
                for order in ORDERS:
                    at, owner = _buckets(codes, owners, order)
                    if len(at):
                        first = np.flatnonzero(np.diff(owner, prepend=-1))
                        total[owner[first]] += np.add.reduceat(self.matrix[at], first, axis=0)
                        grams[owner[first]] += np.diff(first, append=len(at))
        if not k:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total += self.priors
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = grams > 0
        return [self.languages[b] if x else UNKNOWN for b, x in zip(best, known)], np.where(known, np.round(score, 6), 0.0)


def train(documents: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, smoothing: float = 0.5) -> Model:
    """Fit on the labelled rows for which usable holds.

    Of each language, rows are taken by a hash of their id at the rate that gives
    sample_rows; of these every whole text counts. Priors come from all usable rows.
    Without a usable row the model knows no language.
    """
    labelled = documents.filter(usable & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).agg(F.count("*")).collect()}
    if not sizes:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    languages = sorted(sizes)
    rates = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, sample_rows / sizes[lang]))))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = training_counts(labelled.filter(draw < rates[F.col(lang_col)]), text_col=text_col, lang_col=lang_col).toPandas()
    matrix, place = np.full((BUCKETS, len(languages)), smoothing), {x: k for k, x in enumerate(languages)}
    np.add.at(matrix, (counts["bucket"].to_numpy(), counts["lang"].map(place).to_numpy(np.int64)), counts["n"].to_numpy())
    matrix = np.log(matrix / matrix.sum(axis=0))
    n = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(n / n.sum()), matrix.astype(np.float32).astype(np.float64))


def identify(documents: DataFrame, model: Model, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of documents, and the prediction and its score, which replace columns of their names.

    Null texts, empty ones and ones without letters are und with score 0. Rows are
    scored one by one, so repeated rows score alike.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts):
        import pandas as pd

        parts = [shared.value.predict(list(texts.iloc[at:at + 512])) for at in range(0, len(texts), 512)]
        return pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts]) if parts else []})

    rest, found = [c for c in documents.columns if c.lower() not in (pred_col.lower(), score_col.lower())], unused(documents, "_found")
    # else a filter on the result is pushed below it, and texts are scored a second time, by further workers
    return documents.select(*rest, scored.asNondeterministic()(text_col).alias(found)).select(*rest, F.col(f"{found}.lang_pred").alias(pred_col), F.col(f"{found}.score").alias(score_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op3_langid(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import table

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(documents, ~held_out())
    return identify(documents.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
