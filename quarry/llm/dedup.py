"""N-gram Jaccard join by MinHash banding.

Equal texts collapse to one class first. A signature of one minimum a hash function
is cut in bands; bands and rows are chosen so that a pair at the threshold shares a
band with the wanted probability. Band hashes are shuffled. Classes that share a bucket
are candidates; buckets of the same classes count once. Within a bucket, sketches (a byte a
minimum) leave out pairs far below the threshold, and a spanning forest of the rest
joins classes in groups, so that chance meetings of unlike texts don't chain. A
group's texts go to one task, or, if it's large, to one task for each pair of blocks of
bounded size. A task verifies its pairs on the full n-gram sets and returns a count a class and the
edges that hold the verified links together, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialised, release, spread_join, table, text_key

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: A task verifies at most two blocks, each of at most so many texts and characters (or one longer text).
BLOCK_TEXTS, BLOCK_CHARS = 1024, 1 << 23
#: A task compares the sketches of at most two blocks of a bucket, of about so many classes each.
BUCKET_ROWS = 4096
#: Standard deviations under the threshold at which a sketch rules a pair out (a pair at the threshold is lost once in three million).
SURE = 5
#: Columns of an incidence matrix at a time.
DIMENSIONS = 4096


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most_rows: int = 8, false_at: float = 0.5) -> tuple[int, int]:
    """(bands, rows): of the widest bands that reach the recall at the threshold within
    192 hash functions, those under which pairs at false_at collide least."""
    best = None
    for rows in range(1, most_rows + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= 192:
            chance = 1 - (1 - false_at**rows) ** bands
            if best is None or chance < best[0]:
                best = (chance, bands, rows)
    return best[1], best[2]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of hashed word n-grams. Words are what white space separates, as written."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct 64-bit hashes, sorted. A text of fewer words is one n-gram of all; without words, none."""
        import xxhash

        words = (text or "").split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 50_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = max(1, len(h) - self.words + 1)
        size = min(self.words, len(h))
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = _mixed(out ^ h[k:k + n]) + np.uint64(0x9E3779B97F4A7C15)
        return np.unique(out)


def signature(shingles: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash a band of the minima of bands * rows hash functions, and the lowest byte of each."""
    r = np.random.default_rng(20240501)
    a = (r.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
    b = r.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    base = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for at in range(0, len(base), 512):
        part = base[at:at + 512]
        x = part[None, :] * a[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x += b[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = _mixed(out ^ low.reshape(bands, rows)[:, k].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64), low.astype(np.uint8)


def forest(sketches: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """Edges that span what pairs with least equal bytes connect; each row is compared with those not reached yet."""
    u, v, left = [], [], np.arange(len(sketches))
    while len(left) > 1:
        open_rows, left = [left[0]], left[1:]
        while open_rows and len(left):
            x = open_rows.pop()
            near = (sketches[left] == sketches[x]).sum(axis=1) >= least
            new, left = left[near], left[~near]
            u += [int(x)] * len(new)
            v += new.tolist()
            open_rows += new.tolist()
    return u, v


def _likely(least: int):
    """For mapInArrow over group, key, sketch, a group's rows together: edges u, v."""

    def edges(table: pa.Table) -> pa.RecordBatch:
        group, keys, u, v = table.column("group").to_numpy(), table.column("key"), [], []
        data = b"".join(table.column("sketch").to_pylist())
        sketches = np.frombuffer(data, np.uint8).reshape(len(group), -1)
        cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        two = two[(sketches[two] == sketches[two + 1]).sum(axis=1) >= least]
        u, v = two.tolist(), (two + 1).tolist()
        for lo, hi in zip(cuts[:-1][sizes > 2].tolist(), cuts[1:][sizes > 2].tolist()):
            a, b = forest(sketches[lo:hi], least)
            u += [x + lo for x in a]
            v += [x + lo for x in b]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(x, pa.int64())).combine_chunks().cast(pa.string()) for x in (u, v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            group = held.column("group").to_numpy()
            # the last group may go on in the next batch
            last = int(np.searchsorted(group, group[-1])) if group[0] != group[-1] else 0
            if last:
                yield edges(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None:
            yield edges(held)

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Only n-grams of two sets or more can count; each is a
    dimension of 0/1 rows, and products of bounded slices are summed."""
    every = [*left, *right]
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    values = np.concatenate(every) if every else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    dim = np.cumsum(new) - 1
    keep = (np.bincount(dim) > 1)[dim] if len(dim) else np.zeros(0, bool)
    dim, owner = dim[keep], owner[keep]
    dim = np.unique(dim, return_inverse=True)[1] if len(dim) else dim
    out = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(dim, np.arange(0, (int(dim[-1]) + 1 if len(dim) else 0) + DIMENSIONS, DIMENSIONS))
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            x = np.zeros((len(every), min(DIMENSIONS, int(dim[hi - 1] - dim[lo] // DIMENSIONS * DIMENSIONS) + 1)), np.float32)
            x[owner[lo:hi], dim[lo:hi] % DIMENSIONS] = 1
            out += x[:len(left)] @ x[len(left):].T
    return out


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, for nodes with edges.

    Rounds of two steps: each node points its larger neighbours to its least one, then
    its smaller ones too. Both keep components and shrink paths; every round is
    written, and the loop ends when no edge changes. Rows stay within twice the edges,
    and a hub's edges are dealt over tasks.
    """
    e = materialised(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")

    def state(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def least(both: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
        # the least of a node's neighbours and itself, joined to its own edges
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return spread_join(pairs, m, "u", n, "inner")

    before = state(e)
    while before[0]:
        turned = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(turned, turned, 2 * before[0]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialised(large, "large-star")
        release(e)
        small = least(large, large, large.count())
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        e = materialised(small, "small-star")
        release(large)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _verify(words: int, threshold: float):
    schema = pa.schema([("u", pa.string()), ("v", pa.string()), ("links", pa.int64())])

    def task(rows: pa.Table) -> pa.Table:
        """Rows: key, copies, side (0, 1; one block twice: 0 only), text. Edges to the
        first linked text of a chain of them, and links of each text to texts here."""
        rows = rows.sort_by([("side", "ascending"), ("key", "ascending")])
        side, copies, keys = rows.column("side").to_numpy(), rows.column("copies").to_numpy(), rows.column("key").to_pylist()
        sets = Shingles(words)
        all_sets = [sets(t.as_py()) for t in rows.column("text")]
        cut = int(np.searchsorted(side, 1))
        one = cut == len(keys)
        left, right = (all_sets, all_sets) if one else (all_sets[:cut], all_sets[cut:])
        shift = 0 if one else cut
        sizes_l, sizes_r = np.array([len(s) for s in left], np.float32), np.array([len(s) for s in right], np.float32)
        same = overlaps(left, right)
        union = sizes_l[:, None] + sizes_r[None, :] - same
        linked = (same > 0) & (same >= threshold * union - 1e-6)
        if one:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(keys), np.int64)
        links[:len(left)] += (linked * copies[shift:shift + len(right)][None, :]).sum(axis=1)
        if not one:
            links[cut:] += (linked * copies[:cut][:, None]).sum(axis=0)
        u, v = [], []
        # a spanning forest: only edges that join two trees
        parent = list(range(len(keys)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in zip(*np.nonzero(linked)):
            a, b = top(int(i)), top(int(j) + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                u.append(keys[i])
                v.append(keys[int(j) + shift])
        return pa.table([[*u, *keys], [*v, *keys], [*([0] * len(u)), *links.tolist()]], schema=schema)

    return task


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_key, copy_id, class_id, class_key, n_links: one row for each row of documents.

    Two texts are linked if their sets of word n-grams have a Jaccard similarity of
    the threshold or more; equal texts are linked too. n_links counts the other rows
    that a row is linked to, class_id is the least id of the texts that links connect,
    copy_id the least id of equal texts; class_key names a class by its texts. Rows with
    null ids take part like others: ids are null where all ids of a class or of equal
    texts are. Null and empty texts and ones without words
    have no n-grams: each row is its own class without links. Texts shorter than an
    n-gram are one n-gram. Repeated rows are copies of each other. Other columns
    aren't read; an empty table gives an empty one.
    """
    bands, rows = banding(threshold, recall)
    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", text_key("text"))

    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles(words)
        for batch in batches:
            found = (sets(t.as_py()) for t in batch.column(2))
            made = [signature(s, bands, rows) if len(s) else (None, None) for s in found]
            sketches = pa.array([None if y is None else y.tobytes() for _, y in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in made], pa.list_(pa.int64())), sketches], names=["doc_id", "key", "bands", "sketch"])

    signed = materialised(base.select("doc_id", "key", "text").mapInArrow(signed_rows, "doc_id long, key string, bands array<long>, sketch binary"), "signatures")
    # any copy's bands do: equal texts have equal ones
    classes = signed.filter(F.col("bands").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialised(classes, "classes")
    buckets = classes.select("key", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).filter("n > 1")
    # buckets of the same classes need one look
    shared = shared.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("blocks"))
    members = buckets.join(shared, ["band", "bucket"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(F.xxhash64("band", "bucket", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "key")
    sketched = members.join(classes.select("key", "sketch"), "key").select("group", "key", "sketch").repartition("group").sortWithinPartitions("group")
    least = math.ceil(bands * rows * (threshold - SURE * math.sqrt(threshold * (1 - threshold) / (bands * rows))))
    groups = materialised(connected(sketched.mapInArrow(_likely(least), "u string, v string")), "groups")
    # sizes of groups, in texts; large groups are dealt in blocks by a hash of the text
    member = groups.join(classes.select(F.col("key").alias("node"), "copy_id", "copies"), "node")
    texts = base.select(F.col("doc_id").alias("_id"), F.col("key").alias("_node"), "text")
    # a text whose rows all have null ids has a null copy_id
    held = texts.join(member, (F.col("_node") == F.col("node")) & F.col("_id").eqNullSafe(F.col("copy_id"))).dropDuplicates(["node"])
    held = materialised(held.select(F.col("node").alias("key"), "root", "copies", "text"), "candidates")
    blocks = held.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS)).cast("int").alias("blocks"))
    dealt = spread_join(held, blocks, "root", held.count(), "inner").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.withColumn("other", other).select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "key", "copies", "text")
    found = pairs.groupBy("root", "low", "high").applyInArrow(_verify(words, threshold), "u string, v string, links long")
    found = materialised(found, "verified")
    components = connected(found.filter(F.col("u") != F.col("v")).select("u", "v"))
    links = found.filter(F.col("u") == F.col("v")).groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    named = classes.select("key", "copy_id", "copies").join(components.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = named.join(least, "root").select("key", "copy_id", "class_id", "root", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows_of = signed.select("doc_id", "key", F.col("bands").isNotNull().alias("some"))
    out = spread_join(rows_of, named, "key", signed.count())
    own = lambda c: F.when(F.col("some"), F.col(c)).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("key").alias("text_key"), own("copy_id").alias("copy_id"), own("class_id").alias("class_id"), F.when(F.col("some"), F.col("root")).otherwise(F.concat_ws(":", "key", "doc_id")).alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "copy_id", "n_links")
