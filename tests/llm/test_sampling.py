import hashlib
import random

from spectraloom.llm import sampling


def jaccard(a, b):
    ta, na = sampling.terms(a)
    tb, nb = sampling.terms(b)
    x, y = dict(zip(ta.tolist(), na.tolist())), dict(zip(tb.tolist(), nb.tolist()))
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def test_collision_rate_is_generalised_jaccard():
    r = random.Random(5)
    off = []
    for _ in range(300):
        base = [r.choice("abcdef") for _ in range(r.randint(20, 200))]
        other = [r.choice("abcdef") if r.random() < 0.3 else w for w in base]
        a, b = " ".join(base), " ".join(other)
        off.append(sampling.likeness(sampling.sample(a), sampling.sample(b)) - jaccard(a, b))
    assert abs(sum(off) / len(off)) < 0.015
    assert (sum(x * x for x in off) / len(off)) ** 0.5 < 0.075


def test_collision_rate_of_many_distinct_words():
    """Terms that share an entry of the table of draws are not independent: the error must stay small."""
    r, off = random.Random(6), []
    for n in (50, 400, 3000, 20000):
        for _ in range(12):
            base = [f"w{r.randrange(10**9)}" for _ in range(n)]
            a, b = " ".join(base), " ".join(base[: n // 2] + [f"v{r.randrange(10**9)}" for _ in range(n - n // 2)])
            off.append(sampling.likeness(sampling.sample(a), sampling.sample(b)) - jaccard(a, b))
    assert abs(sum(off) / len(off)) < 0.03
    assert (sum(x * x for x in off) / len(off)) ** 0.5 < 0.09


def test_rows_and_edges(spark):
    docs = [(5, "five words are in here"), (1, None), (2, ""), (9, "é" * 7), (7, "five words are in here"), (30, "last one, an odd 😀 text")]
    for parts in (1, 4):
        df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, after int").repartition(parts)
        got = {r.doc_id: r for r in sampling.fingerprints(df).collect()}
        order = sorted((i, t or "") for i, t in docs)  # no id repeats
        assert len(got) == len(docs)
        for k, (i, t) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            want = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(want.encode()).hexdigest())
        assert got[5].fingerprint == got[7].fingerprint and got[1].near_next == 1.0


def test_empty(spark):
    assert sampling.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sampling.fingerprints(spark.createDataFrame([(1, "one")], "doc_id long, text string")).first().near_next == 1.0


def test_repeated_ids_and_rows(spark):
    docs = [(1, "a b c d"), (1, "a b c d"), (1, "other words"), (2, "x y z")]
    rows = sampling.fingerprints(spark.createDataFrame(docs, "DOC_ID long, text string").withColumnRenamed("DOC_ID", "doc_id")).collect()
    assert sorted((r.doc_id, r.n_chars) for r in rows) == sorted((i, len(t)) for i, t in docs)
    same = [r for r in rows if r.n_chars == 7]
    assert len({r.fingerprint for r in same}) == 1 and 1.0 in {r.near_next for r in same}
