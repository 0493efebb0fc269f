"""The manifest against trees built level by level in plain Python."""

import random
import zlib
from hashlib import sha256

import pytest

from spectraloom.llm import merkle


def H(parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(*fields):
    return H("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields)


def brute_tree(leaves, arity):
    """The root, and the siblings of every leaf by level as (before, after)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[k : k + arity] for k in range(0, len(level), arity)]
        for i, k in enumerate(at):
            run = runs[k // arity]
            paths[i].append((run[: k % arity], run[k % arity + 1 :]))
        at, level = [k // arity for k in at], [H(run) for run in runs]
    return level[0], paths


def brute_manifest(docs, arity=2):
    out, groups = [], {}
    for d in docs:
        groups.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, brute_leaf(*d), d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g])], arity) for g in order}
    root, above = brute_tree([trees[g][0] for g in order], arity)
    for g, top in zip(order, above):
        for (_, _, leaf, d), path in zip(sorted(groups[g]), trees[g][1]):
            i, source, lang, n, text = d
            hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
            folded = brute_leaf(i, source, lang, n + 1 if hit and n is not None else n, text)
            for before, after in [*path, *top]:
                folded = H([*before, folded, *after])
            out.append((i, leaf, trees[g][0], root, H(x for b, a in [*path, *top] for x in (*b, *a)), folded, folded == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    rows = [(k, f"s{k % 5}", r.choice(["en", "en", "en", "de", "é", "", None]), r.choice([None, 5, 99, 2**63 - 1]), "é" * r.randint(0, 9)) for k in range(700)]
    rows += [(5000 + k, None, f"lang{k:03}", 1, "x") for k in range(150)]
    return rows + [(None, None, None, None, None), (None, "a", "en", 1, "b"), (9001, "s", "zz", 3, "x" * 300_000)] + [(42, "same", "en", 7, "same row")] * 90 + [(42, "same", "en", 7, "other row")]


@pytest.mark.parametrize("arity", [2, 3])
def test_equals_brute_force(spark, docs, monkeypatch, arity):
    monkeypatch.setattr(merkle, "LEAVES", 40)
    mixed = random.Random(1).sample([(*d, 1) for d in docs], len(docs))
    df = spark.createDataFrame(mixed, "doc_id long, source string, lang string, n_chars long, text string, Doc_ID int").repartition(4)
    got = sorted(map(tuple, merkle.manifest(df, arity).collect()), key=repr)
    assert got == brute_manifest(docs, arity)
    assert not all(x[6] for x in got) and all(x[6] for x in got if x[0] is None)


def test_small_and_empty(spark, docs):
    ddl = "doc_id long, source string, lang string, n_chars long, text string"
    for few in (docs[:1], docs[:2], [docs[0]] * 2, [(1, None, None, None, None), (2, "a", "b", 1, "c")]):
        assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(few, ddl)).collect()), key=repr) == brute_manifest(few)
    assert merkle.manifest(spark.createDataFrame([], ddl)).collect() == []


def test_fragments_join_in_any_order():
    r = random.Random(8)
    for _ in range(60):
        arity, groups = r.choice([2, 3, 5]), [r.randint(1, 40) for _ in range(r.randint(1, 6))]
        leaves = [[str(r.random()) for _ in range(n)] for n in groups]
        want, _ = brute_tree([brute_tree(x, arity)[0] for x in leaves], arity)
        flat = [((k, 0, i), d) for k, x in enumerate(leaves) for i, d in enumerate(x)]
        sizes = merkle.Sizes(dict(enumerate(groups)) | {merkle.TOP: len(groups)}, arity)
        cuts = sorted({0, len(flat), *(r.randrange(len(flat)) for _ in range(5))})
        parts = [(merkle.join({}, flat[a:b], sizes, {}), {}) for a, b in zip(cuts, cuts[1:])]
        assert all(len(f) <= 4 * arity * 8 for f, _ in parts)
        r.shuffle(parts)
        while len(parts) > 1:
            parts.append(merkle.merged(sizes, parts.pop(), parts.pop(r.randrange(len(parts)))))
        assert list(parts[0][0].values()) == [want]
