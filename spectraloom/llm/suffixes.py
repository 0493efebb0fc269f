"""Suffix-array dedup: every byte covered by a 100-byte string that also starts earlier goes.

Windows (100-byte strings) are dealt by content: the key of a window is the least hash of its
24-byte strings, so equal windows have equal keys, and consecutive windows of one key form one
*stretch* of text. Keys that occur once in the corpus are dropped after one narrow shuffle.
Stretches of the others meet by key in one sorted partition, where an enhanced suffix array
(sorted suffixes and common-prefix lengths) over the distinct stretches is scanned with a stack:
every interval of the common-prefix tree whose occurrences differ in the byte to their left is a
maximal repeat, and all its occurrences but the first of the corpus are covered. Of equal
stretches only the first takes part; the others are covered whole. A pair of equal windows,
extended both ways, is a maximal repeat, so this removes exactly the bytes asked for.

Documents equal to an earlier one are covered whole without taking part. Cases: null counts as
empty; texts under 100 bytes lose nothing; rows that repeat an id and a text count as one
document and give equal rows; rows of one id with different texts are documents of their own, in
the order of their texts' SHA-256 (``sub``, its first 60 bits, which only such tables carry); long
periodic texts are one stretch; empty tables stay empty. Columns are found by place, so others whose
names differ in case only do no harm.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.llm.common import Tables, map_batches, map_rows, pick, table

WIDTH, SEED = 100, 24
SPAN = WIDTH - SEED + 1
#: Ids of up to this many copies (8 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Bytes of stretches that are sorted at once, and distinct stretches that a task remembers.
BATCH, REMEMBER = 1 << 20, 100_000


def seed_hashes(data: bytes):
    """Mixed 64-bit polynomial hashes of all SEED-byte strings."""
    import numpy as np

    base, power = np.uint64(0x9E3779B97F4A7C15), {}
    for k in (1, 2, 4, 8, 16):
        power[k] = base if k == 1 else power[k // 2] * power[k // 2]
    h = {1: np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * power[k] + h[k][k:]
    out = h[16][:-8] * power[8] + h[8][16:]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def sliding(values, width: int, pick):
    """pick (minimum or maximum) over every run of width values."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def window_keys(data: bytes):
    """For each window its key, and the keys of all places chosen by some window."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = seed_hashes(data)
    low = sliding(h, SPAN, np.minimum)
    wide = np.concatenate([np.zeros(SPAN - 1, np.uint64), low, np.zeros(SPAN - 1, np.uint64)])
    return low, h[sliding(wide, SPAN, np.maximum) == h]


def stretches(low):
    """Starts and ends (windows, end exclusive) of the runs of one key."""
    import numpy as np

    cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(low)]])


def covered(texts: list[bytes], order: list[int]) -> list[list[int]]:
    """For distinct stretches, the covered ranges of each, flat (start, end, start, end ...).
    ``order[k]`` is the place of stretch k in the corpus."""
    import numpy as np

    n = np.array([len(t) for t in texts])
    at = np.concatenate([[0], np.cumsum(n + 7)])  # seven marks of an end after each
    size = int(at[-1])
    sym = np.zeros(size + 7, np.uint64)
    own = np.repeat(np.arange(len(texts)), n)
    inside = np.arange(int(n.sum())) + np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    sym[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    rest = np.zeros(size, np.int64)
    rest[inside] = np.repeat(at[:-1] + n, n) - inside
    owner = np.zeros(size, np.int64)
    owner[inside] = own
    starts = np.flatnonzero(rest >= WIDTH)
    # ranks of the first 7, 14, 28 ... symbols, until they tell the longest stretch
    packed = np.zeros(size, np.uint64)
    for k in range(7):
        packed = (packed << np.uint64(9)) | sym[k : k + size]
    levels = [(7, np.unique(packed, return_inverse=True)[1].astype(np.int64))]
    while levels[-1][0] < n.max():
        k, r = levels[-1]
        shifted = np.zeros(size, np.int64)
        shifted[: size - k] = r[k:] if k < size else 0
        shifted[rest <= k] = 0  # beyond the end of a stretch
        key = (r + 1) * (size + 2) + np.where(rest > k, shifted + 1, 0)
        new = np.unique(key[starts], return_inverse=True)[1] if 2 * k >= n.max() else None
        if new is None:
            levels.append((2 * k, np.unique(key, return_inverse=True)[1].astype(np.int64)))
            continue
        final = new
        break
    else:
        final = levels[-1][1][starts]
    sa = starts[np.argsort(final, kind="stable")]
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for k, r in reversed(levels):
        for _ in range(2 if k == levels[-1][0] else 1):
            x, y = a + lcp, b + lcp
            ok = (rest[a] - lcp >= k) & (rest[b] - lcp >= k)
            ok[ok] = r[x[ok]] == r[y[ok]]
            lcp += k * ok
    live = np.ones(len(a), bool)
    for _ in range(6):
        x, y = np.minimum(a + lcp, size), np.minimum(b + lcp, size)
        live &= (sym[x] == sym[y]) & (sym[x] > 0)
        lcp += live
    # the common-prefix tree above WIDTH
    left = np.where(at[owner[sa]] == sa, -1 - np.arange(len(sa)), sym[np.maximum(sa - 1, 0)].astype(np.int64))
    place = np.array(order, np.int64)[owner[sa]] * np.int64(1 << 32) + (sa - at[owner[sa]])
    cover = np.zeros(size + 1, np.int64)
    deep = lcp >= WIDTH
    before = np.concatenate([[False], deep[:-1]])
    after = np.concatenate([deep[1:], [False]])
    two = np.flatnonzero(deep & ~before & ~after)
    two = two[left[two] != left[two + 1]]
    later = np.where(place[two] > place[two + 1], sa[two], sa[two + 1])
    np.add.at(cover, later, 1)
    np.add.at(cover, later + lcp[two], -1)
    begins = np.flatnonzero(deep & ~before & after)
    ends = np.flatnonzero(deep & before & ~after)
    for lo, hi in zip(begins.tolist(), ends.tolist()):
        scan(lcp[lo : hi + 1].tolist(), sa[lo : hi + 2].tolist(), left[lo : hi + 2].tolist(), place[lo : hi + 2].tolist(), cover)
    mask = np.cumsum(cover)[:size] > 0
    mask[rest == 0] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    out: list[list[int]] = [[] for _ in texts]
    for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        k = int(owner[s])
        out[k] += [s - int(at[k]), e - int(at[k])]
    return out


def scan(lcp: list[int], sa: list[int], left: list[int], place: list[int], cover) -> None:
    """Intervals of the common-prefix tree by a stack of [length, first occurrences of its parts,
    byte to the left of all, or None if they differ]. When an interval closes and its left bytes
    differ, all occurrences but the first are covered; the first alone goes up to its parent,
    as the others are covered already, for longer."""
    stack = [[0, [], left[0]]]

    def close(node):
        if node[2] is not None:
            return None
        occurrences = node[1]
        best = min(occurrences, key=place.__getitem__)
        for i in occurrences:
            if i != best:
                cover[sa[i]] += 1
                cover[sa[i] + node[0]] -= 1
        return best

    def add(node, occurrences, mark):
        if node[1] and node[2] != mark:
            node[2] = None
        elif not node[1]:
            node[2] = mark
        node[1] += occurrences

    pending, mark = [0], left[0]
    for i, length in enumerate([*lcp, 0]):
        while stack[-1][0] > length:
            node = stack.pop()
            add(node, pending, mark)
            best = close(node)
            pending, mark = ([best] if best is not None else node[1]), node[2]
        if stack[-1][0] == length:
            if length:
                add(stack[-1], pending, mark)
        else:
            node = [length, [], None]
            add(node, pending, mark)
            stack.append(node)
        if i < len(lcp):
            pending, mark = [i + 1], left[i + 1]


def found_keys(docs: DataFrame, at: list[str]) -> DataFrame:
    """(key, *at, places) for the chosen places; ``at`` are the columns that name a document. Of a key that
    occurs several times in a batch only the first place is to be counted with those of other batches, for
    all of them; the others are known to be repeated and have places 0, so a key that many documents have is
    counted over few rows."""

    def setup():
        import numpy as np

        def batch(columns):
            keys, names, counts = [], [], []
            for *name, text in zip(*columns):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                if len(data) >= WIDTH:
                    keys.append(window_keys(data)[1].view(np.int64))
                    names.append(name)
                    counts.append(len(keys[-1]))
            if not keys:
                return []
            every = np.concatenate(keys)
            _, first, n = np.unique(every, return_index=True, return_counts=True)
            places = np.zeros(len(every), np.int32)
            places[first] = n
            return [every, *(np.repeat(np.array(c, np.int64), counts) for c in zip(*names)), places]

        return batch

    ddl = ", ".join(["key long", *(f"{c} long" for c in at), "places int"])
    return map_batches(docs.select(*at, "text"), ddl, setup, 128)


def repeated_stretches(marked: DataFrame, at: list[str]) -> DataFrame:
    """(key, s, *at, start) of stretches whose key is repeated. A task passes a stretch on only
    if it has not passed on an earlier equal one, as far as it remembers."""

    def setup():
        import numpy as np

        seen: dict[bytes, tuple] = {}

        def batch(columns):
            out = []
            for *name, text, wanted in zip(*columns):
                data = text.encode("utf-8", "surrogatepass")
                low, _ = window_keys(data)
                begin, end = stretches(low)
                value = low[begin]
                for i in np.flatnonzero(np.isin(value, np.array(wanted, np.int64).view(np.uint64))).tolist():
                    b = int(begin[i])
                    s = data[b : int(end[i]) + WIDTH - 1]
                    if (old := seen.get(s)) is None or (*name, b) < old:
                        if len(seen) >= REMEMBER:
                            seen.clear()
                        seen[s] = (*name, b)
                        out.append((int(value[i].view(np.int64)), s, *name, b))
            return list(zip(*out)) if out else []

        return batch

    ddl = ", ".join(["key long", "s binary", *(f"{c} long" for c in at), "start int"])
    return map_batches(marked.select(*at, "text", "wanted"), ddl, setup, 128)


def leaders(dealt: DataFrame, at: list[str]) -> DataFrame:
    """From stretches sorted by (s, *at, start): the first of each with its covered ranges."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([*((c, pa.int64()) for c in at), ("start", pa.int32()), ("ranges", pa.list_(pa.int32()))])

        def rows(group, ranges):
            columns = [[g[k] for g in group] for k in range(1, len(at) + 2)] + [[[g[-1] + x for x in r] for g, r in zip(group, ranges)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

        def solved(group):
            order = sorted(range(len(group)), key=lambda i: group[i][1:])
            rank = [0] * len(group)
            for place, i in enumerate(order):
                rank[i] = place
            return rows(group, covered([g[0] for g in group], rank))

        def repeats(group):
            seen, n = set(), 0
            for s, *_ in group:
                seen.update(hash(s[i : i + WIDTH]) for i in range(len(s) - WIDTH + 1))
                n += len(s) - WIDTH + 1
            return len(seen) < n  # equal windows have equal hashes; others seldom

        # the distinct stretches of one key; those to sort together; those that nothing in their key can equal
        key_group, group, alone, size, last_key, last = [], [], [], 0, None, None

        def close():
            nonlocal size
            if repeats(key_group):
                group.extend(key_group)
                size += sum(len(g[0]) for g in key_group)
            else:
                alone.extend(key_group)
            key_group.clear()

        for batch in batches:
            for key, s, *place in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last_key:
                    close()
                    if size >= BATCH:
                        yield solved(group)
                        group.clear()
                        size = 0
                    if len(alone) > 10_000:
                        yield rows(alone, [()] * len(alone))
                        alone.clear()
                if s != last or key != last_key:
                    key_group.append((s, *place))
                last_key, last = key, s
        close()
        if group:
            yield solved(group)
        if alone:
            yield rows(alone, [()] * len(alone))

    return dealt.mapInArrow(run, ", ".join([*(f"{c} long" for c in at), "start int", "ranges array<int>"]))


def settle(rows: DataFrame) -> DataFrame:
    """The result of each document from its text, repeated keys and the stretches it leads."""

    def setup():
        import numpy as np

        def one(key, text, wanted, led, copy):
            data = text.encode("utf-8", "surrogatepass") if text else b""
            n = len(data)
            if copy and n >= WIDTH:
                return key, n, n, 1, hashlib.sha256(b"").hexdigest()
            if not wanted or n < WIDTH:
                return key, n, 0, 0, hashlib.sha256(data).hexdigest()
            first = {x["start"]: x["ranges"] for x in led or ()}
            gone = np.zeros(n + 1, bool)
            low, _ = window_keys(data)
            begin, end = stretches(low)
            for i in np.flatnonzero(np.isin(low[begin], np.array(wanted, np.int64).view(np.uint64))).tolist():
                b = int(begin[i])
                r = first.get(b)
                if r is None:
                    gone[b : int(end[i]) + WIDTH - 1] = True
                else:
                    for k in range(0, len(r), 2):
                        gone[r[k] : r[k + 1]] = True
            gone[n] = False
            spans = int(np.count_nonzero(gone[1:] < gone[:-1]))
            kept = np.frombuffer(data, np.uint8)[~gone[:n]].tobytes()
            return key, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()

        return one

    return map_rows(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", setup, 128)


def told_apart(docs: DataFrame, store: Tables) -> tuple[DataFrame, DataFrame, list[str]]:
    """docs, the documents whose text an earlier id has, and the columns that name a document: doc_id, and
    ``sub`` where some id has several texts. Digests are saved once; such ids are as a rule none."""
    digests = store.save(docs.where("text <> ''").select("doc_id", F.sha2("text", 256).alias("d")), "digests")
    twins = store.save(digests.groupBy("doc_id").agg((F.min("d") < F.max("d")).alias("t")).where("t").select("doc_id"), "twins")
    n, part = twins.count(), lambda d: F.conv(F.substring(d, 1, 15), 16, 10).cast("long")

    def with_sub(df, digest):
        if not n:
            return df
        marked = twins.withColumn("_t", F.lit(True))
        joined = df.join(F.broadcast(marked) if n <= BROADCAST_IDS else marked, "doc_id", "left")
        return joined.withColumn("sub", F.coalesce(F.when(F.col("_t"), part(digest)), F.lit(0).cast("long"))).drop("_t")

    at = ["doc_id", "sub"] if n else ["doc_id"]
    firsts = digests.groupBy("d").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("d", "first")
    later = digests.join(firsts, "d").where("doc_id > first").select("doc_id", "d")
    copies = store.save(with_sub(later, F.col("d")).select(*at).distinct(), "copies")
    return with_sub(docs, F.sha2("text", 256)).select(*at, "text"), copies, at


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    store = Tables(docs.sparkSession, "suffixes")
    docs, copies, at = told_apart(pick(docs, doc_id=doc_id, text=text), store)
    few = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    own = docs.where(F.octet_length("text") >= WIDTH).join(few, at, "left_anti")
    alone = F.when(F.col("places") == 0, F.col("doc_id"))  # known to be repeated: in partitions of their own
    keys = found_keys(own, at).withColumn("n", F.sum("places").over(Window.partitionBy("key", alone))).where("n <> 1")
    wanted = store.save(keys.groupBy(*at).agg(F.collect_set("key").alias("wanted")), "wanted")
    dealt = repeated_stretches(own.join(wanted, at), at)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    led = leaders(dealt.repartition(parts, "key").sortWithinPartitions("key", "s", *at, "start"), at)
    led = store.save(led, "leaders").groupBy(*at).agg(F.collect_list(F.struct("start", "ranges")).alias("led"))
    marks = wanted.join(led, at, "left").select(*at, "wanted", "led", F.lit(False).alias("copy"))
    gone = copies.select(*at, F.lit(None).cast("array<long>").alias("wanted"), F.lit(None).cast(led.schema["led"].dataType).alias("led"), F.lit(True).alias("copy"))
    store.drop("digests")
    return settle(docs.join(marks.union(gone), at, "left").select("doc_id", "text", "wanted", "led", "copy"))


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
