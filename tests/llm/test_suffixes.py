import hashlib
import random

from spectraloom.llm import suffixes


def brute(docs, width=suffixes.WIDTH):
    """Rows of one id with different texts are documents in the order of their texts' SHA-256."""
    first, out = {}, []
    datas = [(i, (t or "").encode()) for i, t in docs]
    for _, d in sorted(datas, key=lambda x: (x[0], hashlib.sha256(x[1]).digest())):
        gone = bytearray(len(d))
        for p in range(len(d) - width + 1):
            if first.setdefault(d[p : p + width], (id(d), p)) != (id(d), p):
                gone[p : p + width] = b"\x01" * width
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((_, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [prose(r.randint(15, 80)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [prose(r.randint(0, 30))]
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            parts += [s[a : a + r.randint(50, 400)], prose(r.randint(0, 15))]
        docs.append((i, "".join(parts)))
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, "ab" * 300), (104, "x" * 99), (105, "y" * 350), (106, "ab" * 200 + "zz"), (107, docs[3][1] + "."), (108, "short")]
    return docs


def test_equal_to_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, TEXT string, led string")
        got = sorted(tuple(r) for r in suffixes.dedup(df.repartition(3)).collect())
        assert got == brute(docs)


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.dedup(none).collect() == []
    t = "repeated row " * 20
    rows = suffixes.dedup(spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")).collect()
    assert len(rows) == 2 and rows[0] == rows[1]


def test_texts_of_one_id(spark):
    a, b = "first text, long enough to be removed whole " * 4, "second text of the very same id, which is nowhere else " * 3
    rows = sorted(tuple(r) for r in suffixes.dedup(spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string")).collect())
    assert rows == sorted(brute([(1, a), (5, a), (5, b)])) and rows[0][2] < len(a) and sorted(r[2] for r in rows[1:])[0] < len(b)
    docs = [(i % 7, t) for i, t in corpus(5) if t]
    docs = list({d: d for d in docs}.values())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in suffixes.dedup(df).collect()) == sorted(brute(docs))
