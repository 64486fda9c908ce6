"""Score of abusive, hateful or sexual language for every document.

Gradient-boosted trees over dense features of the whole text, fitted on reviewers'
labels, with isotonic calibration on out-of-fold scores. Besides the general lexicons
a lexicon of words and word pairs is learned from the labelled documents of the other
folds, so that what is particular to a collection comes from its own labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoward.llm.abuse_features import FEATURES, Weights, abuse_features, grams_of, shared_vocabulary, words_of
from chronoward.session import checkpoint

Batches = Iterator[pa.RecordBatch]


def _pieces(batches: Batches, rows: int = 2000) -> Batches:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def with_features(docs: DataFrame, extra: list[str], learned: list[Weights], use: str | None = None) -> DataFrame:
    """``id``, the ``extra`` columns and one double column per feature of ``text``.

    The learned weights are the last of ``learned``, or those that column ``use`` numbers.
    """
    names = ["id", *extra]
    types = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Batches) -> Batches:
        for batch in _pieces(batches):
            vocabulary = shared_vocabulary()
            weights = shared.value if use else shared.value[-1]
            number = batch.column(use).to_numpy() if use else None
            values = abuse_features(batch.column("text").to_pylist(), vocabulary, weights, number)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(np.ascontiguousarray(c)) for c in values.T],
                names=[*names, *FEATURES],
            )

    columns = list(dict.fromkeys([*names, "text", *([use] if use else [])]))
    return docs.select(*columns).mapInArrow(run, f"{types}, " + ", ".join(f"{f} double" for f in FEATURES))


def learned_lexicons(
    labelled: DataFrame, folds: int, min_groups: int, min_weight: float, max_grams: int
) -> list[Weights]:
    """Weights of grams from ``labelled(text, label, fold, group)``: one without each fold, and one of all.

    A gram counts if at least ``min_groups`` groups have an abusive text with it; its
    weight is the smoothed log ratio of its shares of abusive and other texts less its
    standard error, kept from ``min_weight`` on. ``labelled`` is the bounded sample and at most ``max_grams`` grams
    (those of the most groups) make the lexicon: a model of bounded size, like the trees.
    """

    def all_grams(batches: Batches) -> Batches:
        for batch in _pieces(batches, 200):
            vocabulary = shared_vocabulary()
            ids, doc, _ = words_of(batch.column("text").to_pylist(), vocabulary)
            hashes, at = grams_of(vocabulary.table()[ids][:, 4], doc)
            rows = np.unique(np.stack([doc[at], hashes]), axis=1) if len(hashes) else np.zeros((2, 0), dtype=np.int64)
            of = pa.array(rows[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[1]), batch.column("fold").take(of), batch.column("group").take(of)], names=["gram", "fold", "group"]
            )

    positive = (
        labelled.filter("label = 1").select("text", "fold", "group").mapInArrow(all_grams, "gram long, fold int, group long")
        .distinct().groupBy("gram", "fold").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("gram").agg(F.sum("n").alias("n"), F.collect_list(F.struct("fold", "n")).alias("by_fold"))
        .filter(F.col("n") >= min_groups).orderBy(F.desc("n"), "gram").limit(max_grams)
    ).toArrow()
    grams = positive.column("gram").to_numpy()
    pos = np.zeros((len(grams), folds))
    for i, parts in enumerate(positive.column("by_fold").to_pylist()):
        for part in parts:
            pos[i, part["fold"]] = part["n"]
    order = np.argsort(grams)
    grams, pos = grams[order], pos[order]
    shared = labelled.sparkSession.sparkContext.broadcast(Weights(grams, np.zeros(len(grams))))

    def known_grams(batches: Batches) -> Batches:
        known = shared.value
        counts = np.zeros((len(known.grams), folds), dtype=np.int64)
        for batch in _pieces(batches):
            vocabulary = shared_vocabulary()
            ids, doc, _ = words_of(batch.column("text").to_pylist(), vocabulary)
            hashes, at = grams_of(vocabulary.table()[ids][:, 4], doc)
            hit, row = known.find(hashes)
            pairs = np.unique(doc[at[hit]] * len(known.grams) + row)
            fold = batch.column("fold").to_numpy()[pairs // max(len(known.grams), 1)]
            np.add.at(counts, (pairs % max(len(known.grams), 1), fold), 1)
        g, f = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(g), pa.array(f.astype(np.int32)), pa.array(counts[g, f])], names=["row", "fold", "n"]
        )

    neg = np.zeros_like(pos)
    if len(grams):
        other = (
            labelled.filter("label = 0").select("text", "fold").mapInArrow(known_grams, "row long, fold int, n long")
            .groupBy("row", "fold").agg(F.sum("n").alias("n"))
        ).toArrow()
        neg[other.column("row").to_numpy(), other.column("fold").to_numpy()] = other.column("n").to_numpy()
    sizes = np.zeros((2, folds))
    for r in labelled.groupBy("label", "fold").agg(
        F.countDistinct("group").alias("groups"), F.count(F.lit(1)).alias("rows")
    ).collect():
        sizes[int(r["label"]), r["fold"]] = r["groups"] if r["label"] else r["rows"]

    def weights(use: np.ndarray) -> Weights:
        a, b = pos[:, use].sum(axis=1), neg[:, use].sum(axis=1)
        w = np.log((a + 0.5) / (sizes[1, use].sum() + 1)) - np.log((b + 0.5) / (sizes[0, use].sum() + 1))
        w = w - np.sqrt(1.0 / (a + 0.5) + 1.0 / (b + 0.5))
        keep = (a >= min_groups) & (w >= min_weight)
        return Weights(grams[keep], w[keep])

    every = np.arange(folds)
    return [weights(every[every != f]) for f in range(folds)] + [weights(every)]


def _labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int, folds: int, seed: int) -> DataFrame:
    """At most ``max_labelled`` documents with a majority verdict, dealt into folds by group and verdict.

    The windows run over the bounded sample's ids only.
    """
    verdict = (
        labels.filter("label is not null").groupBy(F.col("id").alias("lid")).agg(F.avg("label").alias("mean"))
        .filter("mean <> 0.5").select("lid", (F.col("mean") > 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("lid", F.lit(seed)), "lid").limit(max_labelled)
    )
    group = F.coalesce(F.col("group").cast("long"), -F.col("id") - 1) if "group" in docs.columns else F.col("id")
    labelled = checkpoint(
        docs.join(F.broadcast(verdict), F.col("id") == F.col("lid"))
        .select("id", "text", "label", group.cast("long").alias("group")).dropDuplicates(["id"])
    )
    groups = labelled.groupBy("group").agg(F.max("label").alias("kind"))
    order = Window.partitionBy("kind").orderBy(F.xxhash64("group", F.lit(seed + 1)), "group")
    dealt = groups.select("group", F.pmod(F.row_number().over(order), F.lit(folds)).cast("int").alias("fold"))
    return checkpoint(labelled.join(F.broadcast(dealt), "group"))


def score_abuse(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, folds: int = 3, trees: int = 20, depth: int = 3,
    leaf_share: float = 0.004, min_groups: int = 3, min_weight: float = 1.0, max_grams: int = 100_000, seed: int = 11,
) -> DataFrame:
    """``doc_id, source, score`` (calibrated probability) for ``docs(id, source, text)``.

    ``labels(id, label)`` holds verdicts 1, 0 or null, possibly several and
    contradictory per document; a document counts by the majority, ties and nulls not
    at all. At most ``max_labelled`` labelled documents (by hash) are used for
    fitting, with at least ``leaf_share`` of them (three or more) in a leaf; every
    document is scored on its whole text. A column ``group`` of ``docs`` (revisions of
    one page, say) keeps related documents in one fold. Null or empty texts get the
    score of a text without words. Repeated ids are scored once. Every fold needs
    verdicts of both kinds outside it; without them no model can be calibrated and the
    score is null.
    """
    docs = docs.filter("id is not null")
    labelled = _labelled_sample(docs, labels, max_labelled, folds, seed)
    counts = {(r["label"], r["fold"]): r["count"] for r in labelled.groupBy("label", "fold").count().collect()}
    outside = [sum(n for (kind, f), n in counts.items() if kind == k and f != fold) for k in (0, 1) for fold in range(folds)]
    if not counts or min(outside) == 0:
        return docs.select(
            F.col("id").alias("doc_id"), "source", F.lit(None).cast("double").alias("score")
        ).dropDuplicates(["doc_id"])
    learned = learned_lexicons(labelled, folds, min_groups, min_weight, max_grams)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = checkpoint(
        assembler.transform(with_features(labelled, ["label", "fold"], learned, use="fold")).select("label", "fold", "features")
    ).coalesce(2).persist()  # a bounded sample of short vectors
    leaf = max(3, int(leaf_share * sum(counts.values())))  # verdicts are noisy: no leaf of a few of them
    gbt = GBTClassifier(
        maxIter=trees, maxDepth=depth, stepSize=0.25, minInstancesPerNode=leaf, seed=seed, featuresCol="features",
        labelCol="label",
    )

    def raw(model, df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("raw", vector_to_array("rawPrediction")[1])

    held_out = None
    for fold in range(folds):
        part = raw(gbt.fit(train.filter(F.col("fold") != fold)), train.filter(F.col("fold") == fold)).select("raw", "label")
        held_out = part if held_out is None else held_out.unionByName(part)
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held_out)
    model = gbt.fit(train)
    train.unpersist()
    scored = assembler.transform(with_features(docs, ["source"], learned))
    result = calibration.transform(raw(model, scored).select("id", "source", "raw"))
    return result.select(F.col("id").alias("doc_id"), "source", "score").dropDuplicates(["doc_id"])
