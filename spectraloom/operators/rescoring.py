"""Re-scoring of matches by logistic regression, and clustering of values in one dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from spectraloom.operators import ranking
from spectraloom.store import checkpointed


def logistic(train: DataFrame, df: DataFrame, features: list[str], label: str = "label", cost: float = 1.0, name: str = "probability", margin: bool = False) -> DataFrame:
    """df with the probability of label 1 (or its log odds, the ``margin``) by a regression with L2
    penalty 1 / cost for all rows together. Rows of train without a label or a feature are not used; a row of
    df without a feature has no probability."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    used = train.dropna(subset=[*features, label])
    n = used.count()
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    put = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / (cost * max(n, 1)), standardization=False, maxIter=100).fit(put.transform(used.select(*numbers, F.col(label).cast("double").alias("_y"))))
    model.setRawPredictionCol("_r").setProbabilityCol("_p").setPredictionCol("_l")
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    out = model.transform(put.transform(df)).withColumn(name, F.when(whole, vector_to_array("_r" if margin else "_p")[1]))
    return out.drop("_x", "_r", "_p", "_l")


def relabelled(df: DataFrame, sample: str, controls: list[str], label: str = "label") -> DataFrame:
    """Matches of control samples count as decoys."""
    return df.withColumn(label, F.when(F.col(sample).isin(*controls), -1).otherwise(F.col(label)))


def clusters(df: DataFrame, group: str, value: str, threshold: float, least: int = 1) -> DataFrame:
    """Centroid clustering: the closest neighbours no more than ``threshold`` apart merge, again and
    again. Values with a larger gap between them never meet, so a group is first cut at such gaps
    and each stretch is solved alone, from value to value (``Merger``). group, cluster (by value), n, mean, deviation (population);
    equal values count each, null values not at all."""
    rows = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_v")
    cut = F.when(F.col("_v") - F.lag("_v").over(w) > threshold, 1).otherwise(0)
    rows = rows.withColumn("_cut", cut).withColumn("_s", F.sum("_cut").over(w))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(group, "_s", "_v", "_n").repartition(parts, group, "_s").sortWithinPartitions(group, "_s", "_v")
    kind = StructType([next(f for f in df.schema.fields if f.name == group), *_parse_datatype_string("n long, mean double, deviation double").fields])

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in kind.fields])
        last, merger, found = None, Merger(threshold), []

        def rows(done):
            keys, found = [k for k, _ in done], [f for _, f in done]
            return pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), *(pa.array([f[k] for f in found], schema[k + 1].type) for k in range(3))], schema=schema)

        for batch in batches:
            for g, s, v, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, s) != last:
                    found += [(last and last[0], f) for f in merger.settle()]
                    last = g, s
                found += [(g, f) for f in merger.add(v, n)]
            if found:
                yield rows(found)
                found = []
        found += [(last and last[0], f) for f in merger.settle()]
        if found:
            yield rows(found)

    out = dealt.mapInArrow(run, kind)
    number = F.row_number().over(Window.partitionBy(group).orderBy("mean"))
    return out.where(F.col("n") >= least).withColumn("cluster", number)


class Merger:
    """Clusters of ascending values, given one by one. Two neighbours merge when their gap is less than that
    before them and no more than that behind: gaps beside them only grow when others merge, so this is what
    merging the closest first, the leftmost of equals, gives. Held are clusters whose gaps descend; those
    before a gap over the threshold are done, so a long stretch is not held."""

    def __init__(self, threshold: float):
        self.threshold, self.held = threshold, []  # size, total, squares about the mean, gap before it, value (None once merged)

    def gap(self, a, b) -> float:
        if a[4] is not None and b[4] is not None:
            return b[4] - a[4]
        return b[1] / b[0] - a[1] / a[0]

    def merge(self, at: int) -> None:
        """Cluster ``at`` into the one before it."""
        held = self.held
        a, b = held[at - 1], held.pop(at)
        apart = b[1] / b[0] - a[1] / a[0]
        a[2] += b[2] + apart * apart * a[0] * b[0] / (a[0] + b[0])
        a[0], a[1], a[4] = a[0] + b[0], a[1] + b[1], None
        if at > 1:
            a[3] = self.gap(held[at - 2], a)
        if at < len(held):
            held[at][3] = self.gap(a, held[at])

    def settle(self, new=None) -> list[tuple[int, float, float]]:
        """Merges what can be with ``new`` to come; the clusters that are done."""
        held = self.held
        while len(held) > 1 and held[-1][3] <= self.threshold and (new is None or held[-1][3] <= self.gap(held[-1], new)):
            self.merge(len(held) - 1)
            at = max(len(held) - 2, 1)
            while at < len(held) - 1:  # gaps beside a merged cluster have grown: those before them may come first now
                if held[at][3] <= min(held[at + 1][3], self.threshold):
                    self.merge(at)
                    at = max(at - 2, 1)
                else:
                    at += 1
        done = 0
        while done + 1 < len(held) and held[done + 1][3] > self.threshold:
            done += 1
        if new is None:
            done = len(held)
        out = [(n, total / n, (spread / n) ** 0.5) for n, total, spread, *_ in held[:done]]
        del held[:done]
        return out

    def add(self, value: float, count: int) -> list[tuple[int, float, float]]:
        new = [count, value * count, 0.0, 0.0, value]
        out = self.settle(new)
        if self.held:
            new[3] = self.gap(self.held[-1], new)
        self.held.append(new)
        return out


def levelled(df: DataFrame, score: str, decoy: str, at: float) -> DataFrame:
    """df with its scores shifted and scaled so that 0 is the least score of a target under the cutoff (the
    largest score if there is none) and -1 the median of the decoys: scores of models that were trained
    apart can then be ranked together."""
    under = ranking.q_values(df, score, decoy).where(~F.col(decoy) & (F.col("q_value") <= at)).agg(F.min(score).alias("cut"))
    cut, (top, low) = under.first()[0], df.agg(F.max(score), F.percentile_approx(F.when(F.col(decoy), F.col(score)), 0.5, 10_000)).first()
    cut = top if cut is None else cut
    if cut is None:
        return df
    width = cut - low if low is not None and cut > low else 1.0
    return df.withColumn(score, (F.col(score) - F.lit(float(cut))) / F.lit(float(width)))


def trained(df: DataFrame, score: str, decoy: str, at: float) -> DataFrame:
    """df with _label: 0 of decoys, 1 of targets under the cutoff, null of others."""
    found = ranking.q_values(df, score, decoy)
    return found.withColumn("_label", F.when(F.col(decoy), 0).when(F.col("q_value") <= at, 1)).drop("q_value")


def semi_supervised(df: DataFrame, features: list[str], score: str, keys: list[str], decoy: str = "is_decoy", rounds: int = 3, folds: int = 3, at: float = 0.01, costs: tuple[float, ...] = (1.0,)) -> DataFrame:
    """df with ``rescored`` and ``q_value``: in each round, targets under the cutoff by the score so
    far and all decoys train a regression, which scores the fold that it did not see. Folds are dealt
    by a hash of ``keys``. Of several costs, the one that puts most targets of the folds held out within the
    training folds under the cutoff is taken. The scores of each fold are levelled by its own cutoff and
    decoys before folds are ranked together. With no target under the cutoff a fold's score stays what it
    was; rows without a feature have no score."""
    dealt = df.withColumn("rescored", F.col(score).cast("double")).withColumn("_fold", F.pmod(F.xxhash64(*keys), F.lit(folds)))
    out = checkpointed(dealt)
    for _ in range(rounds):
        parts = []
        for fold in range(folds):
            train = trained(out.where(F.col("_fold") != fold), "rescored", decoy, at)
            part = out.where(F.col("_fold") == fold)
            if {0, 1} <= {r[0] for r in train.select("_label").distinct().collect()}:
                part = logistic(train, part.drop("rescored"), features, "_label", best_cost(train, features, decoy, fold, folds, at, costs), "rescored", True)
                part = levelled(part, "rescored", decoy, at)
            parts.append(part.select(*out.columns))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        out = checkpointed(whole)
    return ranking.q_values(out.drop("_fold"), "rescored", decoy)


def best_cost(train: DataFrame, features: list[str], decoy: str, fold: int, folds: int, at: float, costs: tuple[float, ...]) -> float:
    """The cost of the regression that, trained without one of the training folds, puts most of that fold's
    targets under the cutoff, summed over the training folds; the first among equals."""
    if len(costs) == 1:
        return costs[0]
    inner = [k for k in range(folds) if k != fold]

    def found(cost: float) -> int:
        n = 0
        for held in inner:
            seen, rest = train.where(F.col("_fold") != held), train.where(F.col("_fold") == held)
            if {0, 1} <= {r[0] for r in seen.select("_label").distinct().collect()}:
                scored = logistic(seen, rest, features, "_label", cost, "_inner", True)
                n += ranking.q_values(scored, "_inner", decoy).where(~F.col(decoy) & (F.col("q_value") <= at)).count()
        return n

    return max(costs, key=found)
