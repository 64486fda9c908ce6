"""The abuse score: disguises, edge cases, and wording that the labels do not hold."""

from __future__ import annotations

import os

import numpy as np
import pytest

from chronoward.llm import abuse, abuse_features
from tests.llm import heldout

LABELLED = "/root/testdata/sf0.1"


def features(*texts) -> list[dict[str, float]]:
    rows = abuse_features.abuse_features(list(texts), abuse_features.Vocabulary())
    return [dict(zip(abuse_features.FEATURES, r, strict=True)) for r in rows]


def test_disguised_words_are_seen():
    texts = ["you are a total moron", "you are a t o t a l m o r o n", "you are a m0r0n", "you are a mo**n", "you are a mooooron",
             "you are a mo-ron", "you are a mo<!-- x -->ron", "yоu аrе а mоrоn", "you are a m.o.r.o.n", "you are a mor&#111;n",
             "you are a mo''r''on", "you are a MORON!!", "you are a mo<b>r</b>on", "you are a mo​ron"]
    for text, got in zip(texts, features(*texts), strict=True):
        assert got["open_hits"] == 1 and got["insult_with_second"] == 1, text
    assert all(f["obfuscated_hits"] == 1 for f in features(*texts[2:6]))


def test_hidden_text_is_scored():
    texts = ["A quiet village.<ref>you are a total moron</ref>", "A quiet village. <!-- you are a moron -->",
             "A quiet [[you are a moron|village]].", "A quiet village. {{you are a moron}}", "A house <ref>you are a moron and so on"]
    assert all(f["insult_with_second"] == 1 for f in features(*texts))


def test_windows_do_not_reach_into_the_next_text():
    got = features("the end of you", "moron begins this one", "", None, "x")
    assert [f["insult_with_second"] for f in got] == [0] * 5
    assert got[1]["open_hits"] == 1 and got[2]["log_words"] == got[3]["log_words"] == 0


def test_a_batch_gives_what_single_texts_give():
    texts = heldout.ABUSIVE + [None, ""] + heldout.NEUTRAL + ["word " * 20_000]
    alone = np.array([abuse_features.abuse_features([t], abuse_features.Vocabulary())[0] for t in texts])
    assert np.array_equal(alone, abuse_features.abuse_features(texts, abuse_features.Vocabulary()))


def test_every_kind_of_abuse_meets_a_lexicon():
    """Sentences of every kind heat up some window, more than plain ones."""
    heat = [f["open_heat_window"] for f in features(*heldout.ABUSIVE)]
    calm = [f["open_heat_window"] for f in features(*heldout.FILLER)]
    assert min(heat) > max(calm)


def test_learned_grams_come_from_several_groups(spark):
    rows = [(i, "pleasant words zorgle bax here", 1, i % 3, i) for i in range(6)]
    rows += [(10 + i, "pleasant words here", 0, i % 3, 10 + i) for i in range(30)]
    rows += [(50 + i, "pleasant quuxly words", 1, 0, 50) for i in range(6)]  # one group only
    labelled = spark.createDataFrame(rows, "id long, text string, label int, fold int, group long")
    learned = abuse.learned_lexicons(labelled, 3, min_groups=3, min_weight=1.0, max_grams=1000)
    assert len(learned) == 4
    got = abuse_features.abuse_features(["a zorgle bax", "a quuxly", "pleasant words"], abuse_features.Vocabulary(), learned[-1])
    top = dict(zip(abuse_features.FEATURES, got.T, strict=True))["learned_window"]
    assert top[0] > 1 and top[1] == top[2] == 0


def test_scores_need_verdicts_of_both_kinds_in_every_fold(spark):
    rows = [(i, "src", "you are a moron" if i % 2 else "a quiet village by the sea") for i in range(40)]
    rows += [(100, "src", None), (101, "src", ""), (102, None, "you are an idiot " * 2000), (0, "src", "a quiet village by the sea")]
    docs = spark.createDataFrame(rows, "id long, source string, text string")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(40)] + [(3, None), (5, 0), (None, 1), (999, 1)], "id long, label int"
    )
    scores = {r.doc_id: r.score for r in abuse.score_abuse(docs, labels, trees=3, depth=2).collect()}
    assert len(scores) == 43 and scores[1] > 0.5 > scores[0] and scores[100] == scores[101]
    few = abuse.score_abuse(docs, labels.filter("label = 0 or id = 1")).collect()
    assert len(few) == 43 and all(r.score is None for r in few)
    assert abuse.score_abuse(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.exists(LABELLED), reason="needs the labelled tables")
def test_unseen_wording_is_found(spark):
    """Trained on the given labels, scored on other sentences inside ordinary paragraphs (see heldout.py for its limits)."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{LABELLED}/review_label.parquet").select(F.col("doc_id").alias("id"), F.col("abusive").alias("label"))
    given = spark.read.parquet(f"{LABELLED}/documents.parquet").join(
        labels.select(F.col("id").alias("doc_id")).distinct(), "doc_id"
    ).select(F.col("doc_id").alias("id"), "source", "text", F.col("page_id").alias("group"))
    first = 10**12
    own = [
        (first + i, "own", " ".join([*heldout.FILLER[: i % 6 + 1], s, *heldout.FILLER[i % 6 + 1 :]]), first + i)
        for i, s in enumerate(heldout.ABUSIVE + heldout.NEUTRAL + heldout.FILLER)
    ]
    docs = given.unionByName(spark.createDataFrame(own, given.schema))
    scores = {r.doc_id - first: r.score for r in abuse.score_abuse(docs, labels).filter(F.col("doc_id") >= first).collect()}
    n = len(heldout.ABUSIVE)
    found = sum(scores[i] >= 0.5 for i in range(n))
    wrong = sum(scores[i] >= 0.5 for i in range(n, len(scores)))
    print(f"held-out: {found} of {n} found, {wrong} of {len(scores) - n} others flagged")
    print([heldout.ABUSIVE[i] for i in range(n) if scores[i] < 0.5], [i - n for i in range(n, len(scores)) if scores[i] >= 0.5])
    assert found / n >= 0.9 and found / (found + wrong) >= 0.8  # the others were written to mislead
