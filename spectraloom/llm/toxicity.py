"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models; the model of a later
category also gets the probabilities of the earlier ones. For its training these are predicted
out of fold, by models that did not see the document, nor chose their features by it, so it learns how
far they can be trusted.

Features are the presence of words, of words' first four and five letters, and of marks. They
are hashed to 32 bits; those kept are all whose chi-square in some category reaches CHI_SQUARE over all
folds, or over all but one for the models of that fold: one aggregation over the features counts them
by fold. Training uses a bounded sample: the LABELLED labelled documents
with the least hash of their id. Their features are a table in the shared folder; only the kept ones
come to the driver, where the chain is fitted. All documents are then scored in one pass.

Cases: null counts as empty; a text without features has the probability that the biases give;
a category whose labels are all equal, or that has none, is predicted by a constant (0 without
labels); labels that repeat an id count once, the largest; of different texts of one labelled id the one
with the least list of features is trained on; equal texts get equal values, ties and rows that repeat
included; texts of any length are read whole; other columns do not matter, whatever their names; an
empty table stays empty.
"""

from __future__ import annotations

import re
from math import exp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import Tables, map_batches, map_rows, pick, table

CATEGORIES = ("quality", "toxic")
#: At most so many labelled documents are trained on.
LABELLED, FOLDS, ROUNDS, RIDGE = 4000, 5, 120, 0.05
#: Features with a smaller chi-square may be chance: at p = 4e-8 none of a million passes by it.
CHI_SQUARE = 30.0
THRESHOLD = 0.5
WORD = re.compile(r"[^\W\d_]+")
REMEMBER = 200_000


def hashes(word: str) -> tuple[int, ...]:
    import xxhash

    h = xxhash.xxh32_intdigest
    parts = ["w" + word] + [f"{k}{word[:k]}" for k in (4, 5) if len(word) >= k]
    return tuple(h(p) for p in parts)


def features(text: str | None, of_word=hashes) -> set[int]:
    if not text:
        return set()
    import xxhash

    low = text.lower()
    out: set[int] = set()
    out.update(*map(of_word, set(WORD.findall(low))))
    out.update(xxhash.xxh32_intdigest("c" + c) for c in set(low) if not c.isalnum())
    return out


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_one(rows, cols, n, width, y, extra):
    """Logistic regression on sparse presence (rows, cols) and dense extra columns."""
    import numpy as np

    if len(y) == 0 or y.min() == y.max():
        bias = -30.0 if len(y) == 0 or y.max() == 0 else 30.0
        return np.zeros(width), np.zeros(extra.shape[1]), bias
    w, v, b = np.zeros(width), np.zeros(extra.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    sw, sv, sb = np.full(width, 1e-6), np.full(extra.shape[1], 1e-6), 1e-6
    for _ in range(ROUNDS):
        p = _sigmoid(np.bincount(rows, w[cols], n) + extra @ v + b)
        d = p - y
        gw, gv, gb = np.bincount(cols, d[rows], width) + RIDGE * w, extra.T @ d + RIDGE * v, d.sum()
        sw += gw * gw
        sv += gv * gv
        sb += gb * gb
        w -= 0.5 * gw / np.sqrt(sw)
        v -= 0.5 * gv / np.sqrt(sv)
        b -= 0.5 * gb / np.sqrt(sb)
    return w, v, b


def fit(lists: list[list[int]], labels: list[tuple[int, ...]], folds: list[int], names: list[int], told: list[int], categories=CATEGORIES) -> dict:
    """The chain, from the places of each document's features in ``names``, its labels and its fold, and by
    feature the folds without which it was chosen (bits; bit FOLDS: with all of them): for each category
    weights, weights of earlier probabilities, bias."""
    import numpy as np

    n, width = len(lists), len(names)
    y = np.array(labels, float).reshape(n, len(categories))
    rows = np.repeat(np.arange(n), [len(x) for x in lists])
    cols = np.array([f for x in lists for f in x], np.int64)
    fold, bits = np.array(folds, np.int64), np.array(told, np.int64)
    whole = bits[cols] >> FOLDS & 1 == 1
    earlier, models = np.zeros((n, 0)), []
    for k in range(len(categories)):
        models.append(fit_one(rows[whole], cols[whole], n, width, y[:, k], earlier))
        if k + 1 == len(categories):
            break
        out = np.zeros(n)
        for f in range(FOLDS):
            renumber = np.cumsum(fold != f) - 1
            chosen = bits[cols] >> f & 1 == 1
            inside = chosen & (fold[rows] != f)
            w, v, b = fit_one(renumber[rows[inside]], cols[inside], int((fold != f).sum()), width, y[fold != f, k], earlier[fold != f])
            score = np.bincount(rows[chosen], w[cols[chosen]], n) + earlier @ v + b
            out[fold == f] = _sigmoid(score)[fold == f]
        earlier = np.column_stack([earlier, out])
    weights = {int(f): tuple(float(m[0][j]) for m in models) for j, f in enumerate(names) if bits[j] >> FOLDS & 1}
    return {"weights": weights, "earlier": [tuple(map(float, m[1])) for m in models], "bias": [float(m[2]) for m in models]}


def telling(rows: DataFrame, categories=CATEGORIES) -> dict[int, int]:
    """From (f: packed features, y, fold): the features that occur in several documents, not in all, and
    whose presence depends on some category, ascending, with the folds (bits) without which that is so;
    bit FOLDS tells that it is so with all of them."""
    k, at = len(categories), range(FOLDS)
    counts = [F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col("y")[i]), F.lit(0)).alias(f"s{i}") for i in range(k))]
    sums = {r["fold"]: r for r in rows.groupBy("fold").agg(*counts).collect()}
    if not sums:
        return {}

    def setup():
        import numpy as np

        def batch(columns):
            parts = [np.frombuffer(f, "<u4").astype(np.int64) for f in columns[0]]
            sizes = [len(p) for p in parts]
            return [np.concatenate(parts), np.repeat(columns[2], sizes), *(np.repeat([y[i] for y in columns[1]], sizes) for i in range(k))] if sum(sizes) else []

        return batch

    each = map_batches(rows.select("f", "y", "fold"), "f long, fold int, " + ", ".join(f"y{i} int" for i in range(k)), setup)
    of = lambda f, value: F.coalesce(F.sum(F.when(F.col("fold") == f, value)), F.lit(0))
    by = each.groupBy("f").agg(*(of(f, F.lit(1)).alias(f"d{f}") for f in at), *(of(f, F.col(f"y{i}")).alias(f"h{i}_{f}") for f in at for i in range(k)))

    def passing(used: list[int]):
        n = sum(sums[f]["n"] for f in used if f in sums)
        df = sum((F.col(f"d{f}") for f in used), F.lit(0))
        chi = []
        for i in range(k):
            share = sum(sums[f][f"s{i}"] for f in used if f in sums) / n if n else 0.0
            hit, want = sum((F.col(f"h{i}_{f}") for f in used), F.lit(0)), df * share
            chi.append(F.pow(hit - want, 2) / F.greatest(want * (1 - share) * (1 - df / max(n, 1)), F.lit(1e-9)))
        best = F.greatest(*chi) if k > 1 else chi[0]
        return (df >= 2) & (df < n) & (best >= CHI_SQUARE)

    bits = sum((F.when(passing([g for g in at if g != f]), 1 << f).otherwise(0) for f in at), F.when(passing(list(at)), 1 << FOLDS).otherwise(0))
    found = by.select("f", bits.alias("bits")).where("bits > 0").collect()
    return dict(sorted((r.f, r.bits) for r in found))


def predict(found: set[int], model: dict) -> list[float]:
    score, out = list(model["bias"]), []
    for f in sorted(found):
        for k, w in enumerate(model["weights"][f]):
            score[k] += w
    for s, earlier in zip(score, model["earlier"]):
        s += sum(w * p for w, p in zip(earlier, out))
        out.append(1 / (1 + exp(-max(-30.0, min(30.0, s)))))
    return out


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, text: str = "text", doc_id: str = "doc_id") -> dict:
    docs = pick(docs, doc_id=doc_id, text=text)
    labels = pick(labels, doc_id=doc_id, **{c: c for c in categories})
    for c in categories:
        labels = labels.where(F.col(c).isNotNull())
    labels = labels.groupBy("doc_id").agg(*(F.max(c).cast("int").alias(c) for c in categories))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    chosen = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", *categories)

    def setup():
        import numpy as np

        return lambda key, value, *ys: (key, np.array(sorted(features(value)), "<u4").tobytes(), list(ys))

    store = Tables(docs.sparkSession, "toxicity")
    rows = store.save(map_rows(chosen, "doc_id long, f binary, y array<int>", setup), "all")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = store.save(rows.groupBy("doc_id").agg(F.min(F.struct("f", "y")).alias("r")).select("doc_id", "r.*", fold), "sample")
    told = telling(rows, categories)
    names = list(told)

    def shorten():
        import numpy as np

        known = np.array(names, np.int64)
        return lambda key, f, y, fold: (key, np.flatnonzero(np.isin(known, np.frombuffer(f, "<u4"))).astype(np.int32), y, fold)

    few = sorted(map_rows(rows, "doc_id long, f array<int>, y array<int>, fold int", shorten).collect())
    store.drop("all", "sample")
    return fit([r.f for r in few], [tuple(r.y) for r in few], [r.fold for r in few], names, list(told.values()), categories)


def scorer(model: dict):
    known, kept = model["weights"].keys(), {}

    def of_word(word):
        found = kept.get(word)
        if found is None:
            if len(kept) >= REMEMBER:
                kept.clear()
            found = tuple(h for h in hashes(word) if h in known)
            if len(word) <= 40:
                kept[word] = found
        return found

    return lambda text: predict(features(text, of_word) & known, model)


def scored(docs: DataFrame, model: dict, categories=CATEGORIES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, p_<category> for each, and toxic: whether the last probability reaches THRESHOLD."""

    def setup():
        score = scorer(model)

        def one(key, value):
            p = score(value)
            return key, *p, p[-1] >= THRESHOLD

        return one

    ddl = "doc_id long, " + ", ".join(f"p_{c} double" for c in categories) + ", toxic boolean"
    return map_rows(pick(docs, doc_id=doc_id, text=text), ddl, setup)


def kept(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, with their columns."""
    names, at = docs.columns, docs.columns.index(text)

    def setup():
        score = scorer(model)

        def batch(columns):
            stay = [score(t)[-1] < THRESHOLD for t in columns[at]]
            return [[v for v, s in zip(c, stay) if s] for c in columns]

        return batch

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return map_batches(docs.toDF(*(f"c{i}" for i in range(len(names)))), kinds, setup).toDF(*names)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
