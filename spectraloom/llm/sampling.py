"""Document fingerprints by consistent weighted sampling (gamma-based).

Terms are pairs of adjacent words (a single word where there is just one) weighted by their
counts. For sample k a term t of weight w has gamma(2, 1) draws r and c and a uniform draw b,
from hashes of (t, k); with m = floor(ln w / r + b) the sample is the pair (t, m) of least
ln c - r * (m - b + 1). Two documents agree in a sample with a probability equal to their
generalised Jaccard similarity, so the share of equal samples estimates it; its standard
error is at most 0.5 / sqrt(SAMPLES).

Draws come from one table of 2 ** TABLE_BITS entries, indexed by a hash of (t, k); the sample
keeps the term's own 64-bit hash, so terms that share an entry do not count as equal.

Cases: null counts as empty; a text without words has the fingerprint of no terms, which equals
itself (likeness 1) and nothing else (0); equal texts have equal fingerprints; rows that repeat an
id are ordered by a 64-bit hash of their text, then by the text; long texts are sampled in blocks of
terms; an empty table stays empty; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.llm.common import Tables, arrow_schema, map_rows, pick, table

SAMPLES, TABLE_BITS, SEED = 64, 18, 11
BLOCK = 1024


@lru_cache(maxsize=2)
def draws(seed: int = SEED):
    """r, b, ln c and, for weight 1 (m = 0), the value ln c + r * (b - 1), as float32."""
    import numpy as np

    g = np.random.Generator(np.random.PCG64(seed))
    n = 1 << TABLE_BITS
    r = -np.log(1 - g.random(n)) - np.log(1 - g.random(n))
    c = -np.log(1 - g.random(n)) - np.log(1 - g.random(n))
    b = g.random(n)
    rates = np.frombuffer(hashlib.sha512(f"cws{seed}".encode()).digest() * (SAMPLES // 8), np.uint64)[:SAMPLES].copy()
    rates = (rates + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return r.astype(np.float32), b.astype(np.float32), np.log(c).astype(np.float32), (np.log(c) + r * (b - 1)).astype(np.float32), rates[:, None]


def terms(text: str | None):
    """Sorted distinct 64-bit hashes of the terms, and their counts."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) > 1:
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(h, return_counts=True)


def sample(text: str | None):
    """SAMPLES 64-bit values, each standing for a pair of term and level; empty without terms."""
    import numpy as np

    t, n = terms(text)
    if not len(t):
        return np.empty(0, np.uint64)
    r, b, lc, ones, rates = draws()
    shift = np.uint64(64 - TABLE_BITS)
    least = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, np.uint64)
    order = np.argsort(n > 1, kind="stable")
    t, n = t[order], n[order]
    single = int(np.count_nonzero(n == 1))
    for lo, hi, plain in [(x, min(x + BLOCK, single), True) for x in range(0, single, BLOCK)] + [(x, min(x + BLOCK, len(t)), False) for x in range(single, len(t), BLOCK)]:
        at = (t[lo:hi] * rates) >> shift
        if plain:
            value, level = ones[at], None
        else:
            level = np.floor(np.log(n[lo:hi]).astype(np.float32) / r[at] + b[at])
            value = lc[at] - r[at] * (level - b[at] + 1)
        k = value.argmin(axis=1)
        rows = np.arange(SAMPLES)
        best = value[rows, k]
        better = best < least
        least = np.where(better, best, least)
        got = t[lo:hi][k]
        if level is not None:
            got = got ^ (level[rows, k].astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        out = np.where(better, got, out)
    return out


def likeness(a, b) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).sum()) / SAMPLES


def tell(s) -> bytes:
    """A fingerprint as bytes: four for each sample."""
    import numpy as np

    return ((s ^ (s >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes()


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


DDL = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def measure(key, text: str, after: str) -> tuple:
    changed = edited(text, after)
    a, b, c = sample(text), sample(changed), sample(after)
    return key, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), tell(a), tell(b), likeness(a, b), likeness(a, c)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are dealt by ranges of ids (and hashes of texts, so that no text is sampled to find the
    ranges) and sorted. A task sees its rows in order, holds one of them back and measures it with
    the next. Only the texts of the first and last row of each range are written: the last of a
    range is measured with the first of the next range, or the very first. Digests and fingerprints
    are written as bytes and told in hexadecimal digits when they are read."""
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    spark = docs.sparkSession
    store = Tables(spark, "sampling")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    kind, schema = arrow_schema("part int, edge int, text string, " + DDL)

    def run(batches):
        import pyarrow as pa

        held = None
        none = (None,) * 6

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = []
                for key, text, part in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns)):
                    rows.append((part, 0, text, key, *none) if held is None else (part, 1, None, *measure(*held, text)))
                    held = (key, text)
                yield out(rows)
        if held is not None:
            yield out([(part, 2, held[1], held[0], *none)])

    rows = store.save(dealt.mapInArrow(run, kind), "measured")
    # at most two rows for each range
    edges = rows.where("edge <> 1")
    w = Window.orderBy("part", "edge")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = edges.withColumn("after", F.coalesce(F.lead("text").over(w), F.first("text").over(every))).where("edge = 2")
    rest = map_rows(lasts.select("doc_id", "text", "after"), DDL, lambda: measure)
    every = rows.where("edge = 1").select(*(f.name for f in kind.fields[3:])).union(rest)
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
