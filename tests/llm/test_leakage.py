"""Leaked passages: cleaning, seeds, alignment, stock text, and whole runs against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from chronoward.llm import leakage
from chronoward.llm.text_clean import WordNumbers, words

ITEM = ("The keeper of the northern lighthouse counted seventeen barrels of salted herring before the harbour froze and the ferry "
        "stayed on the far shore until the spring tide carried broken ice past the wooden pier and the chapel bell rang twice.")
STOCK = "This article about a settlement is a stub."


def test_leaked_passages(spark):
    w = ITEM.split()
    changed = " ".join("zzz" if i % 6 == 5 else x for i, x in enumerate(w))
    filler = " ".join(f"word{i}" for i in range(4000))
    docs = [
        (1, 1, f"== Head ==\nBefore. {ITEM} After."), (2, 2, "x " + " ".join(w[: len(w) * 6 // 10]) + " y"),
        (3, 3, "x " + " ".join(w[: len(w) // 3]) + " y"), (4, 4, changed.upper()),
        (5, 5, ITEM.replace("salted", "[[salt|salted]]<ref>note one two</ref>").replace(" ferry", "&nbsp;''ferry''")),
        (6, 6, "| " + " || ".join(w) + "\n|-"), (7, 7, STOCK), (8, 8, None), (9, 9, ""), (10, None, filler + " " + ITEM),
    ] + [(100 + i, 100 + i, f"{STOCK} place{i} has {i} houses") for i in range(40)]
    items = [(1, ITEM + " " + STOCK), (2, None), (3, ""), (1, ITEM + " " + STOCK)]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, page_id long, text string, item string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = leakage.find_leaks(d, i, "doc_id", "page_id", "text", "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(x, 1) for x in (1, 2, 4, 5, 6, 10)}
    assert leakage.find_leaks(d.limit(0), i, "doc_id", "page_id", "text", "item_id", "text").count() == 0


def test_a_passage_on_many_pages_still_leaks(spark):
    docs = [(i, i, f"page {i} {ITEM if i % 3 == 0 else 'nothing'} {STOCK} end {i}") for i in range(90)]
    items = [(1, ITEM + " " + STOCK), (2, "Four grey herons stood in the mill race while the miller slept. " + STOCK)]
    items += [(k, f"Item {k} holds words {k} of its own and {k} more, then closes. {STOCK}") for k in (3, 4)]
    d = spark.createDataFrame(docs, "doc_id long, page_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = leakage.find_leaks(d, i, "doc_id", "page_id", "text", "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(x, 1) for x in range(0, 90, 3)}


def test_stock_positions():
    one = np.ones(10, dtype=int)
    assert not leakage.stock_positions(np.full(10, 500), one, 33, 5, 3, 0.5).any()  # one item's own passage
    assert leakage.stock_positions(np.r_[np.full(7, 2), np.full(3, 200)], one, 33, 1, 3, 0.5).tolist() == [False] * 7 + [True] * 3
    assert leakage.stock_positions(np.full(10, 500), np.r_[one[:8], 3, 3], 33, 5, 3, 0.5).tolist() == [False] * 8 + [True] * 2


def plain_alignment(item, doc) -> int:
    """Best score by the textbook recurrence."""
    score = np.zeros((len(item) + 1, len(doc) + 1), dtype=int)
    for i in range(len(item)):
        for j in range(len(doc)):
            same = 1 if item[i] == doc[j] else -1
            score[i + 1, j + 1] = max(0, score[i, j] + same, score[i, j + 1] - 1, score[i + 1, j] - 1)
    return int(score.max())


def test_alignments_of_many_pairs():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 6, n) for n in (0, 1, 5, 12, 30, 8, 20)] * 3
    docs = [rng.integers(0, 6, n) for n in (4, 0, 9, 40, 25, 3, 60)] * 3
    docs[-1] = np.r_[docs[-1], items[-1], docs[-1]]
    got = leakage.align_pairs(items, docs, np.zeros(len(items)))
    assert got[:, 0].tolist() == [plain_alignment(a, b) for a, b in zip(items, docs, strict=True)]
    assert got[-1].tolist() == [20, 20, 20]
    a = np.arange(10)
    one = leakage.align_pairs([a, a], [np.array([0, 1, 2, 77, 4, 5, 6]), np.array([50, 51])], np.array([2.0, 2.0]))
    assert one.tolist() == [[5, 7, 6], [0, 0, 0]]


def test_windows_hold_every_alignment_through_a_seed():
    assert leakage.windows_of(np.array([5]), 10, 100) == [(0, 24)]
    assert leakage.windows_of(np.array([70, 5, -3, 33]), 10, 100) == [(0, 52), (61, 89)]


def random_items(n: int, length: int) -> list[list[str]]:
    rng = random.Random(5)
    names = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("bar", "den", "fin", "gul", "sot") for c in ("a", "e", "os", "um")]
    return [[rng.choice(names) for _ in range(length)] for _ in range(n)]


def test_copies_with_every_fourth_word_exchanged_or_on_many_pages(spark):
    items = random_items(30, 40)
    docs = []
    for k, item in enumerate(items):
        edited = [f"new{k}x{i}" if i % 4 == 3 else w for i, w in enumerate(item)]
        docs.append((k, k, f"Some page about thing {k}. {' '.join(edited)} It ends here."))
    wide = "Only this passage stands on very many pages of the whole set and nowhere else"
    docs += [(1000 + i, 1000 + i, f"page {i}: {wide}. And {i} more") for i in range(60)]
    docs += [(2000 + i, 2000 + i, f"a page {i} on velvet granite orchards") for i in range(5)]
    docs += [(3000 + i, 3000 + i, f"a page {i} on velvet {i} granite orchards") for i in range(5)]
    given = [(k, " ".join(x)) for k, x in enumerate(items)] + [(500, wide), (501, "Velvet granite orchards!")]
    d = spark.createDataFrame(docs, "doc_id long, page_id long, text string")
    i = spark.createDataFrame(given, "item_id long, text string")
    want = {(k, k) for k in range(30)} | {(1000 + k, 500) for k in range(60)} | {(2000 + k, 501) for k in range(5)}
    for bound in (2_000_000, 0):  # item side broadcast, and shuffled
        out = leakage.find_leaks(
            d, i, "doc_id", "page_id", "text", "item_id", "text", max_broadcast_grams=bound, max_broadcast_ids=bound
        ).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want


@pytest.mark.parametrize(("exchanged", "least"), [(0.1, 0.99), (0.2, 0.97), (0.25, 0.85)])
def test_recall_of_copies_with_random_exchanged_words(exchanged, least):
    """Seeds and alignment on copies of random items; stock text, insertions and deletions are not part of this."""
    rng = np.random.default_rng(11)
    found = accepted = 0
    items = [rng.integers(1, 2**62, n) for n in rng.integers(30, 95, 200)]
    for item in items:
        copy = np.where(rng.random(len(item)) < exchanged, rng.integers(1, 2**62, len(item)), item)
        text = np.r_[rng.integers(1, 2**62, 40), copy, rng.integers(1, 2**62, 40)]
        _, covered, matched = leakage.align_pairs(
            [(item & 0x7FFFFFFF).astype(np.int32)], [(text & 0x7FFFFFFF).astype(np.int32)], np.array([0.2 * len(item)])
        )[0]
        ok = covered >= 0.5 * len(item) and matched >= 0.7 * covered
        (h, _, holes), (t, _, text_holes) = leakage.item_grams_of(item, 5), leakage.item_grams_of(text, 5)
        whole = np.isin(h[holes == 0], t[text_holes == 0]).any()
        accepted += ok
        found += bool(ok and (whole or np.isin(np.unique(h), t).sum() > 1))
    assert found / len(items) >= least and found == accepted  # the seeds lose nothing that the alignment accepts


# words

def test_words_ignore_markup():
    assert words("'''Bo'''ld [[A b|c d]] {{cn|date=x}}&nbsp;e<ref name=\"q\">no</ref>f <!-- x --> {{{lead|g}}}") == \
        ["bold", "c", "d", "ef", "g"]
    assert words(None) == [] and not re.search("[A-Z]", " ".join(words("ÄB cD")))


def test_unclosed_tags_lose_nothing_but_themselves():
    assert words("one <ref name=a>two three <b>four</b> five") == ["one", "two", "three", "four", "five"]
    assert words("one <ref>two three <ref>note</ref> four <ref name=x /> five") == ["one", "two", "three", "four", "five"]
    assert words("one <!-- two three <!-- note --> four") == ["one", "two", "three", "four"]
    assert words("one <ref>two <i>three</i> <br> four</ref> five") == ["one", "five"]


def test_word_numbers_are_the_words():
    texts = ["'''Bo'''ld [[A b|c d]] don’t 'quoted' x‑y 30°C", None, "", "''", "°°°", "Ärger's ​ünde § 5a–6b", "a " * 30_000, "a'b''c"]
    h, of = WordNumbers().hashes(texts)
    want = [(k, xxhash.xxh64_intdigest(w) - (1 << 63)) for k, t in enumerate(texts) for w in words(t)]
    assert list(zip(of.tolist(), h.tolist(), strict=True)) == want
