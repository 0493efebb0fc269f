"""MinHash near-dedup: universal hash minima, banding, signature verification, components.

A document's set holds its distinct shingles of five words. Documents with equal sets are one
class, and only class representatives are compared. Each representative gets ``BANDS * ROWS``
minima of multiply-add-shift hashes of its shingles; ``ROWS`` minima make a band key. Of the
representatives with a key in common, the one with the most company over all its keys is the
hub: all others of the bucket are compared with it, first by signature, then by full sets. When
these links have been joined to components, large buckets that still hold several get further
hubs drawn by hash. Then the pairs between components that are left in a bucket are compared,
pair by pair in small buckets and block by block in large ones, so a link is lost only where two similar documents have no
key in common: at a similarity of 0.75 with probability (1 - 0.75 ** 4) ** 36 = 1e-6, or where
signatures of similar documents agree in fewer than ``AGREE`` minima (5 standard deviations).

Each class is a node, numbered by its smallest id, or, where an id has several texts and is the
smallest of several classes, by a number below all ids; so rows of one id with different texts are
documents of their own. A component is named by the smallest id of its rows.

Shingles are compared by 64-bit hashes. Cases: null or empty texts, or texts without words, have
the empty set and are components of their own; fewer than five words are one shingle; equal
rows are linked; very long texts are hashed in blocks; an empty table gives an empty table. Columns
are found by place, so others whose names differ in case only do no harm.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.llm.common import Tables, map_batches, map_rows, pick, table
from spectraloom.llm.components import components

WORDS, BANDS, ROWS = 5, 36, 4
LEAST, OF = 75, 100
AGREE = 82
#: Ids and digests of up to this many documents (32 bytes each) are broadcast to pick their texts; beyond it they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Buckets with up to this many representatives in several components are compared pair by pair; larger ones block by block.
PAIRWISE = 64
BLOCK = 1024
#: Large buckets first get up to so many further hubs, drawn by hash.
TURNS = 3


def shingles(text: str | None, width: int = WORDS):
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[k : len(h) - width + 1 + k]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    return np.unique(out)


@lru_cache(maxsize=4)
def family(n: int, seed: int = 1):
    """n random hashes x -> (a * x + b) >> 32 with odd 64-bit a."""
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(seed))
    a = draw.integers(0, 2**64, (n, 1), np.uint64, endpoint=False) | np.uint64(1)
    return a, draw.integers(0, 2**64, (n, 1), np.uint64, endpoint=False)


def minima(found, n: int):
    import numpy as np

    a, b = family(n)
    out = np.full(n, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(found), 2048):
        out = np.minimum(out, ((found[at : at + 2048] * a + b) >> np.uint64(32)).min(axis=1))
    return out


def band_keys(signature, rows: int = ROWS):
    import numpy as np

    s = signature.reshape(-1, rows)
    key = np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = (key ^ s[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2 (128 bits that stand for the set), sig, bands."""

    def setup():
        import numpy as np
        import xxhash

        def one(key, text):
            s = shingles(text)
            if not len(s):
                return key, 0, None, None, None, None
            d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
            sig = minima(s, BANDS * ROWS)
            return key, len(s), int(d[0]), int(d[1]), sig.astype(np.uint32).view(np.int32), band_keys(sig)

        return one

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n long, k1 long, k2 long, sig array<int>, bands array<long>", setup)


def picked_sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingle sets of the classes whose numbers (column node) are given: node, s. nodes: node, rep (an id
    that has the set), k1, k2."""
    chosen = nodes.join(F.broadcast(ids) if (few := ids.count() <= BROADCAST_IDS) else ids, "node").select(F.col("rep").alias("doc_id"), "node", "k1", "k2")

    def setup():
        import numpy as np
        import xxhash

        def batch(columns):
            out = []
            for node, k1, k2, text in zip(*columns):
                s = shingles(text)
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                if d[0] == k1 and d[1] == k2:  # else another text of the same id
                    out.append((node, s.view(np.int64)))
            return list(zip(*out)) if out else []

        return batch

    return map_batches(docs.join(F.broadcast(chosen) if few else chosen, "doc_id").select("node", "k1", "k2", "text"), "node long, s array<long>", setup)


def same(a, b):
    """How many places of two arrays agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)


def linked(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, nodes: DataFrame, store: Tables, name: str) -> DataFrame:
    """The pairs (u, v) of nodes that are links: sizes, then signatures, then full sets."""
    a = sigs.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su"))
    b = sigs.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv"))
    close = pairs.join(a, "u").join(b, "v").where(OF * F.least("nu", "nv") >= LEAST * F.greatest("nu", "nv"))
    close = store.save(close.where(same(F.col("su"), F.col("sv")) >= AGREE).select("u", "v"), f"{name}-close")
    ids = store.save(close.select(F.col("u").alias("node")).union(close.select("v")).distinct(), f"{name}-ids")
    sets = store.save(picked_sets(docs, nodes, ids), f"{name}-sets")
    a, b = sets.toDF("u", "a"), sets.toDF("v", "b")
    both = F.size(F.array_intersect("a", "b"))
    found = close.join(a, "u").join(b, "v").where(OF * both >= LEAST * (F.size("a") + F.size("b") - both))
    found = store.save(found.select("u", "v"), f"{name}-links")
    store.drop(f"{name}-sets")
    return found


def block_links(left: DataFrame, sigs: DataFrame, docs: DataFrame, nodes: DataFrame, store: Tables) -> DataFrame:
    """Links between components within large buckets (key, node, comp). The members of a bucket
    are dealt into blocks and every pair of blocks is one group of at most 2 * BLOCK sets, of
    which only links that join components come out. Its time, and the sets that travel (each once for
    every block of its bucket), grow with the square of such a bucket over BLOCK; memory does not."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("node")) - 1
    left = left.withColumn("block", F.floor(place / BLOCK).cast("int"))
    blocks = left.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    left = left.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    ids = store.save(left.select("node").distinct(), "block-ids")
    sets = store.save(picked_sets(docs, nodes, ids), "block-sets")

    def solve(group):
        import numpy as np
        import pyarrow as pa

        rows = group.select(["key", "node", "comp", "s", "block"]).to_pydict()
        ids, comp, block = np.array(rows["node"]), rows["comp"], np.array(rows["block"])
        sets = [np.array(s, np.int64) for s in rows["s"]]
        sig = np.array(group["sig"].to_pylist(), np.int32)
        n = np.array([len(s) for s in sets])
        number = {c: k for k, c in enumerate(sorted(set(comp)))}
        root = np.array([number[c] for c in comp])  # of each member, kept up to date
        two, out = len(set(rows["block"])) > 1, []
        band = int(np.flatnonzero(band_keys(sig[0].view(np.uint32).astype(np.uint64)) == rows["key"][0])[0])
        for x in range(1, len(ids)):
            open_ = (root[:x] != root[x]) & (OF * np.minimum(n[:x], n[x]) >= LEAST * np.maximum(n[:x], n[x]))
            if two:
                open_ &= block[:x] != block[x]  # pairs within a block have a group of their own
            at = np.flatnonzero(open_)
            same = sig[at] == sig[x]
            first = same.reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1)
            at = at[(same.sum(axis=1) >= AGREE) & (first == band)]  # of all buckets they share, the first
            for y in at:
                if root[x] != root[y]:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if OF * both >= LEAST * (n[x] + n[y] - both):
                        out.append((int(ids[x]), int(ids[y])))
                        root[root == root[x]] = root[y]
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    left = left.join(sets, "node").join(sigs.select("node", "sig"), "node")
    return store.save(left.groupBy("key", "i", "j").applyInArrow(solve, "u long, v long"), "block-links")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) after further links: only the graph of the components that the
    links join is solved anew."""
    u = found.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
    v = found.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    between = links.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    moved = components(between.distinct()).select(F.col("u").alias("comp"), F.col("v").alias("to"))
    own = moved.select(F.col("comp").alias("node"), F.col("to").alias("comp"))
    return found.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")).union(own)


def unsettled(keys: DataFrame, found: DataFrame) -> DataFrame:
    """The buckets that hold several components."""
    at = keys.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_key = Window.partitionBy("key")
    several = (F.min("comp").over(by_key) < F.max("comp").over(by_key)).alias("several")
    return at.select("key", "node", "comp", "company", several).where("several").drop("several")


def numbered(classes: DataFrame, store: Tables) -> DataFrame:
    """Classes (k1, k2, rep) with the numbers of their nodes."""
    shared = store.save(classes.groupBy("rep").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("rep"), "shared")
    if not (n := shared.count()):
        return classes.withColumn("node", F.col("rep"))
    below = min(classes.agg(F.min("rep")).first()[0], 0) - 1
    marked = shared.withColumn("_s", F.lit(True))
    own = F.when(F.col("_s"), F.lit(below) - F.monotonically_increasing_id()).otherwise(F.col("rep"))
    return store.save(classes.join(F.broadcast(marked) if n <= BROADCAST_IDS else marked, "rep", "left").select("k1", "k2", "rep", own.alias("node")), "nodes")


def cluster(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    spark = docs.sparkSession
    store = Tables(spark, "minhash")
    docs = pick(docs, doc_id=doc_id, text=text)
    sigs = store.save(signatures(docs), "sigs")
    nodes = numbered(store.save(sigs.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes"), store)
    reps = sigs.join(nodes.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), "rep", "node"), (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")) & (F.col("doc_id") == F.col("rep")))
    reps = store.save(reps.select("node", "n", "sig", "bands").dropDuplicates(["node"]), "reps")
    by_key = Window.partitionBy("key")
    keys = reps.select("node", F.explode("bands").alias("key")).withColumn("company", F.count(F.lit(1)).over(by_key))
    keys = store.save(keys.where("company > 1"), "keys")
    degree = keys.groupBy("node").agg(F.sum("company").alias("degree"))
    hub = F.max(F.struct("degree", -F.col("node"), "node")).over(by_key)["node"]
    hubs = keys.join(degree, "node").select("key", "node", hub.alias("hub")).where("node <> hub")
    pairs = store.save(hubs.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct(), "pairs")
    links = linked(pairs, reps, docs, nodes, store, "hub")
    found = store.save(components(links).select(F.col("u").alias("node"), F.col("v").alias("comp")), "found")
    left = unsettled(keys, found)
    for turn in range(TURNS):
        large = store.save(left.where(F.col("company") > PAIRWISE), f"large{turn}")
        if large.isEmpty():
            break
        dice = F.xxhash64("node", "key", F.lit(turn))
        other = F.min(F.struct(dice, "node", "comp")).over(by_key)
        tried = large.select("node", "comp", other["node"].alias("hub"), other["comp"].alias("hub_comp")).where("comp <> hub_comp")
        tried = tried.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
        links = linked(store.save(tried, f"pairs{turn}"), reps, docs, nodes, store, f"turn{turn}")
        found = store.save(merged(found, links), f"found{turn}")
        left = unsettled(keys, found)
    left = store.save(left, "left")
    small = left.where(F.col("company") <= PAIRWISE)
    other = small.select("key", F.col("node").alias("v"), F.col("comp").alias("c2"))
    more = small.join(other, "key").where("node > v and comp <> c2").select(F.col("node").alias("u"), "v").distinct()
    links = linked(store.save(more.join(pairs, ["u", "v"], "left_anti"), "more"), reps, docs, nodes, store, "more")
    large = left.where(F.col("company") > PAIRWISE).drop("company")
    if not large.isEmpty():
        links = links.union(block_links(large, reps, docs, nodes, store))
    found = merged(found, links)
    members = store.save(found.union(found.select("comp", "comp").distinct()), "members")
    names = store.save(members.join(nodes, "node").groupBy("comp").agg(F.min("rep").alias("component_id")), "names")
    named = store.save(nodes.join(members.join(names, "comp").select("node", "component_id"), "node", "left").select("k1", "k2", F.coalesce("component_id", "rep").alias("component_id")), "named")
    spent = [f"{part}{turn}" for turn in range(TURNS) for part in ("large", "pairs", "found")]
    spent += [f"{name}-{part}" for name in ("hub", "more", *(f"turn{turn}" for turn in range(TURNS))) for part in ("close", "ids", "links")]
    store.drop("classes", "shared", "nodes", "reps", "keys", "pairs", "found", "left", "more", "members", "names", "block-ids", "block-sets", "block-links", *spent)
    own = sigs.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))
