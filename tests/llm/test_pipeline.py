"""The pipeline, stage by stage, against plain Python over small tables."""

import random
import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import mixing, pieces, secrets, toxicity
from spectraloom.llm.common import WORD
from tests.llm.test_operators import brute_components


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, folder = random.Random(2), tmp_path_factory.mktemp("sf")
    words = ["".join(r.choice("abcdefghijk") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(160):
        w = [r.choice(words) for _ in range(40)]
        if i % 5 == 0:
            w[::7] = ["vile"] * len(w[::7])
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, i % 2, int(i % 5 == 0)))
    near = docs[1][1].split()
    docs += [(200, docs[1][1], "en", "s0", 0), (201, " ".join(near[:-1] + ["other"]), "en", None, 0), (202, docs[2][1] + " password = hunter22x9 done", "en", "s1", 0), (203, None, None, None, None), (204, "", "en", "s2", 0), (205, "vile vile vile", "en", "s2", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}", df


def test_stages(spark, tables):
    folder, docs = tables
    assert [name for name, _ in P.STAGES] == ["toxicity", "minhash", "secrets", "mixing", "sentencepiece"]
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = toxicity.scorer(model)
    kept = P.toxicity_stage(spark, docs, folder)
    want = [r for r in rows_of(docs) if score(r[1])[-1] < toxicity.THRESHOLD]
    assert rows_of(kept) == want and kept.columns == docs.columns
    assert not {r[0] for r in want} & {5, 10, 205} and {203, 204, 1} <= {r[0] for r in want}

    unique = P.minhash_stage(spark, kept, folder)
    leaders = {i for i, _, _, is_kept in brute_components([r[:2] for r in want]) if is_kept}
    want = [r for r in want if r[0] in leaders]
    assert rows_of(unique) == want and not {200, 201} & leaders

    clean = P.secrets_stage(spark, unique, folder)
    want = [(r[0], t := secrets.redact(r[1]), *r[2:4], len(t) if t != r[1] else r[4]) if r[1] is not None else r for r in want]
    assert rows_of(clean) == sorted(want, key=repr) and "hunter22x9" not in str(want)

    mixed = P.mixing_stage(spark, clean, folder)
    taken = {r.doc_id: r.taken for r in mixing.report(clean).collect()}
    size = lambda t: len(re.findall(WORD, t or ""))
    got = rows_of(mixed)
    assert mixed.columns == docs.columns and set(got) <= set(want)
    assert all(sum(size(x[1]) for x in got if x[0] == r[0]) == taken[r[0]] for r in want)

    encoded = P.tokens_stage(spark, mixed, folder)
    sp = pieces.prefix_table(open(pieces.default_model(), "rb").read()).sp
    assert sorted((r.doc_id, r.source, r.n_tokens, list(r.ids)) for r in encoded.collect()) == sorted((r[0], r[3], len(ids := sp.encode(r[1] or "")), ids) for r in got)

    whole = P.run(spark, folder)
    assert rows_of(whole.select("doc_id", "source", "n_tokens")) == rows_of(encoded.select("doc_id", "source", "n_tokens"))


def test_clashing_names_and_empty_tables(spark, tables, tmp_path):
    folder, docs = tables
    more = docs.select("doc_id", F.lit(1).alias("Extra"), F.lit("x").alias("DOC_ID"), "text", "lang", "source", "n_chars", F.lit("y").alias("TEXT"))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, more, folder)
        assert out.columns == more.columns and out.count() > 100
    assert P.tokens_stage(spark, more, folder).count() == more.count()
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0
