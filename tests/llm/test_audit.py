"""The filter audit against plain Python: every order applied to every row, one after another."""

import random
import re
from itertools import permutations

import pytest

from spectraloom.llm import audit
from spectraloom.llm.common import WORD


def brute_fails(docs):
    """The set of filters that each row fails."""
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = re.findall(WORD, t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= x <= "Z" for x in t) > 3 * len(t), any(x in t for x in "#$%&*|"), copy)
        out.append({f for f, fails in zip("ABCDE", tests) if fails})
    return out


def brute_audit(docs, labels):
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    fails, rows = brute_fails(docs), []
    for part in {p or "" for _, _, p in docs}:
        own = [(i, f) for (i, _, p), f in zip(docs, fails) if (p or "") == part]
        shares: dict = dict.fromkeys("ABCDE", 0)
        told = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in own) - len(gone)
                left = [x for x in left if f not in x[1]]
                shares[f] += len(gone)
                told.append((f, (part, "".join(order), k + 1, len(left), len(gone), redundant, sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))))
        rows += [(*row, shares[f]) for f, row in told]
    return sorted(rows)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    texts = []
    for k in range(40):
        words = [r.choice("abcdefghij") * r.randint(1, 4) + ("#" if k % 7 == 0 else "") for _ in range(r.choice([3, 150, 250]))]
        words = [w + str(n) if k % 3 else w for n, w in enumerate(words)]
        texts.append(" ".join(w.upper() if k % 5 == 0 else w for w in words))
    rows = [(r.randint(0, 10**6), r.choice(texts), r.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [(i, "the same text", "en") for i in range(2_000_000, 2_000_100)]
    rows += [(None, "the same text", "en"), (None, None, None), (7, None, "en"), (8, "", "en"), (8, "", "de"), (8, "another", "en"), (9, "x" * 300_000, "fr"), (9, "x" * 300_000, "fr")]
    return rows


def test_equals_brute_force(spark, docs):
    labels = [(i, n % 2, n % 3 == 0 and 1 or 0) for n, (i, _, _) in enumerate(docs[::2])] + [(8, None, 1), (8, 1, None), (8, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, TEXT string").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, audit.audit(df, lab).collect())) == brute_audit(docs, labels)
    assert sorted(x.doc_id for x in audit.copies(df).collect()) == sorted(i for (i, _, _), f in zip(docs, brute_fails(docs)) if "E" in f)


def test_empty_tables(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(df.limit(0), lab).collect() == []
    got = audit.audit(df, lab).collect()
    assert len(got) == 4 * 600 and not any(x.good_lost or x.toxic_lost for x in got)


@pytest.mark.parametrize("hold", [64 << 20, 2000])
def test_equal_fingerprints_and_full_chains(monkeypatch, docs, hold):
    monkeypatch.setattr(audit.xxhash, "xxh3_64_intdigest", lambda raw: 5)
    monkeypatch.setattr(audit, "HOLD", hold)
    parts = [docs[k::7] for k in range(7)]
    sent = [x for p in parts for x in audit.local_chains((i, t or "", p_ or "") for i, t, p_ in p)]
    got = sorted((i is None, i or 0, part, mask) for i, part, mask, n in audit.routed_chains(sent) for _ in range(n))
    bits = {f: 1 << k for k, f in enumerate("ABCDE")}
    assert got == sorted((i is None, i or 0, p or "", sum(bits[x] for x in f)) for (i, _, p), f in zip(docs, brute_fails(docs)))
    if hold > 10**6:
        assert sum(raw == b"the same text" for _, (_, raw, _, _) in sent) <= len(parts)
