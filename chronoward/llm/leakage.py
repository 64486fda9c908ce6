"""Evaluation passages that leaked into training documents.

Word n-grams of the test items, whole or around one left-out word, are seeds: a
document sharing a whole one or two of the others becomes a candidate for that item. N-grams found on many pages
are stock text if several items share them or they are an item's tail only; they seed
nothing, and an item's stock words do not count. A passage of one item stays a seed on
any number of pages. Smith-Waterman alignment of the words around the seeds then
scores edited copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoward.llm.text_clean import shared_numbers
from chronoward.session import broadcast_if_small, checkpoint

Batches = Iterator[pa.RecordBatch]

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Cells of one alignment step: pairs of a group times words of their windows.
_CELLS = 40_000


def gram_hashes(h: np.ndarray, doc: np.ndarray, size: int, hole: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the n-grams of ``size`` words within documents, around any word at ``hole`` (0: none).

    ``h`` are hashes of the words of all documents in order, ``doc`` the document of each.
    """
    span = size + (hole > 0)
    count = max(len(h) - span + 1, 0)
    at = np.flatnonzero(doc[:count] == doc[span - 1 : span - 1 + count])
    out = np.full(len(at), size + 64 * hole, dtype=np.uint64)
    u = h.view(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            if hole and k == hole:
                continue
            out = out * _MULTIPLIER + u[at + k]
            out ^= out >> np.uint64(29)
    return out.view(np.int64), at


def holes_of(gram: int) -> list[int]:
    """Where the seeds of ``gram`` words have their hole: nowhere, or before or after the middle word."""
    return [0, *sorted({gram // 2, gram - gram // 2} - {0})]


def item_grams_of(h: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions, holes) of the n-grams of one item; an item of fewer words has one gram of all its words."""
    doc = np.zeros(len(h), dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if len(h) < gram:
        hashes, at = gram_hashes(h, doc, len(h)) if len(h) else (none, none)
        return hashes, at, np.zeros(len(at), dtype=np.int64)
    parts = [(*gram_hashes(h, doc, gram, hole), hole) for hole in holes_of(gram)]
    return (
        np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
        np.repeat([p[2] for p in parts], [len(p[0]) for p in parts]),
    )


def align_pairs(items: list[np.ndarray], docs: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """pairs x (score, item words covered, words matched) of best Smith-Waterman alignments.

    Match +1, mismatch -1, gap -1; pairs that score below ``least`` give zeros. Pairs of
    like size are aligned together, one row of the item at a time.
    """
    out = np.zeros((len(items), 3), dtype=np.int64)
    for group, a, b in _groups(items, docs, np.arange(len(items))):
        out[group, 0] = _scores(a, b)
    enough = np.flatnonzero((out[:, 0] >= least) & (out[:, 0] > 0))
    out[out[:, 0] < least] = 0
    for group, a, b in _groups(items, docs, enough):
        out[group] = _paths(a, b)
    return out


def _groups(items, docs, chosen):
    """Groups of ``chosen`` pairs, padded with words that match nothing: (numbers, item words, document words)."""
    sizes = np.array([len(docs[i]) for i in chosen], dtype=np.int64)
    chosen = chosen[np.argsort(sizes, kind="stable")]
    lo = 0
    while lo < len(chosen):
        hi = lo + 1
        while hi < len(chosen) and (hi + 1 - lo) * (len(docs[chosen[hi]]) + 1) <= _CELLS:
            hi += 1
        group = chosen[lo:hi]
        a = np.full((len(group), max(len(items[i]) for i in group)), -1, dtype=np.int32)
        b = np.full((len(group), max(len(docs[i]) for i in group)), -2, dtype=np.int32)
        for row, i in enumerate(group):
            a[row, : len(items[i])] = items[i]
            b[row, : len(docs[i])] = docs[i]
        yield group, a, b
        lo = hi


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best score of each pair."""
    n = b.shape[1]
    ramp = np.arange(n, dtype=np.int32)
    score = np.zeros((len(a), n + 1), dtype=np.int32)
    best = np.zeros(len(a), dtype=np.int32)
    for k in range(a.shape[1]):
        value = np.where(a[:, k, None] == b, np.int32(1), np.int32(-1))
        value += score[:, :-1]
        np.maximum(value, score[:, 1:] - 1, out=value)
        np.maximum(value, 0, out=value)
        value += ramp  # gaps in the item: a run along the document is a running maximum
        np.maximum.accumulate(value, axis=1, out=value)
        value -= ramp
        score[:, 1:] = value
        np.maximum(best, value.max(axis=1, initial=0), out=best)
    return best


def _paths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(score, item words covered, words matched) of the best alignment of each pair."""
    pairs, n = b.shape
    ramp = np.arange(n)
    row = np.arange(pairs)
    score, start, match = (np.zeros((pairs, n + 1), dtype=np.int64) for _ in range(3))
    best = np.zeros((pairs, 3), dtype=np.int64)
    for k in range(a.shape[1]):
        hit = a[:, k, None] == b
        diagonal = score[:, :-1] + np.where(hit, 1, -1)
        up = score[:, 1:] - 1
        from_diagonal = diagonal >= up
        value = np.maximum(np.maximum(diagonal, up), 0)
        fresh = score[:, :-1] == 0
        begin = np.where(from_diagonal, np.where(fresh, k, start[:, :-1]), start[:, 1:])
        same = np.where(from_diagonal, np.where(fresh, 0, match[:, :-1]) + hit, match[:, 1:])
        lifted = value + ramp
        running = np.maximum.accumulate(lifted, axis=1)
        origin = np.maximum.accumulate(np.where(lifted == running, ramp, 0), axis=1)
        value = running - ramp
        score[:, 1:] = value
        start[:, 1:] = np.take_along_axis(begin, origin, axis=1)
        match[:, 1:] = np.take_along_axis(same, origin, axis=1)
        top = np.argmax(value, axis=1)
        better = np.flatnonzero(value[row, top] > best[:, 0])
        at = top[better]
        best[better, 0] = value[better, at]
        best[better, 1] = k - start[better, at + 1] + 1
        best[better, 2] = match[better, at + 1]
    return best


def stock_positions(
    pages: np.ndarray, texts: np.ndarray, limit: float, gram: int, stock_items: int, max_tail: float,
) -> np.ndarray:
    """Which n-grams of one item are stock text.

    ``pages`` and ``texts`` are the numbers of pages and of different item texts that
    hold each n-gram, in the item's order. Of those on more than ``limit`` pages, stock
    are the ones in ``stock_items`` texts, and a tail of less than ``max_tail`` of the
    words that is on more than twice as many pages as any other part of the item.
    """
    frequent = pages > limit
    stock = frequent & (texts >= stock_items)
    others = np.flatnonzero(~(frequent | stock))
    cut = int(others[-1]) + 1 if len(others) else 0
    n_words = len(pages) + gram - 1
    if 0 < cut < len(pages) and n_words - cut < max_tail * n_words:
        body = pages[:cut][~stock[:cut]]
        if pages[cut:].min() > 2 * max(1, body.max(initial=0)):
            stock[cut:] = True
    return stock


def windows_of(starts: np.ndarray, item_words: int, length: int, least_share: float = 0.2) -> list[tuple[int, int]]:
    """Stretches of a text of ``length`` words that hold every alignment through a seed.

    ``starts`` are where the item would begin if it went on around the seed unchanged. An
    alignment of score at least ``least_share`` of the item's words has at most the rest
    of them as gaps, so it lies within that many words of the item's place; places that
    overlap make one stretch.
    """
    gaps = int((1.0 - least_share) * item_words) + 1
    starts = np.sort(starts)
    cut = np.flatnonzero(np.diff(starts) > item_words + 2 * gaps)
    first = starts[np.r_[0, cut + 1]]
    last = starts[np.r_[cut, len(starts) - 1]]
    return [(max(0, int(a) - gaps), min(length, int(b) + item_words + gaps)) for a, b in zip(first, last, strict=True)]


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str, page: str, doc_text: str, item_id: str, item_text: str,
    gram: int = 5, stock_share: float = 0.01, stock_items: int = 3, min_share: float = 0.5,
    max_broadcast_grams: int = 2_000_000, max_broadcast_ids: int = 1_000_000,
) -> DataFrame:
    """``doc_id, item_id, covered_words, matched_words, item_words``: leaked pairs.

    A pair is reported if one alignment covers at least ``min_share`` of the item's
    words that are not stock text (n-grams on more than ``stock_share`` of all pages
    that :func:`stock_positions` accepts), at least 7 in 10 covered words agree, and the
    score reaches a fifth of the item's words. Seeds are the item's n-grams of ``gram``
    words, whole or around one exchanged word (:func:`holes_of`; of an item of fewer
    words, all its words). One whole seed makes a candidate, or two different ones
    around a word (one, if the item has fewer than four times ``gram`` words): a copy
    with every fourth word exchanged has many of those. A copy whose exchanged words
    leave neither is not found. Case, punctuation, markup, entities and inserted references are ignored; exchanged words inside the
    aligned stretch count as covered. Documents or items with null id or null or empty
    text match nothing; repeated rows count once; a null page counts as a page of its
    own document. No candidate is dropped, and every alignment that could be reported
    lies within the words that are aligned (:func:`windows_of`).
    """
    docs = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{page}`").cast("long"), -F.col(f"`{doc_id}`").cast("long") - 1).alias("page"),
        F.col(f"`{doc_text}`").alias("text"),
    ).filter("doc_id is not null and text is not null")
    tests = items.select(
        F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")
    ).filter("item_id is not null and text is not null").dropDuplicates(["item_id"])

    def item_grams(batches: Batches) -> Batches:
        numbers = shared_numbers()
        for batch in batches:
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = numbers.hashes([text])[0]
                grams, at, holes = item_grams_of(h, gram)
                body = xxhash.xxh64_intdigest(h.tobytes()) >> 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(grams), pa.int64()), pa.array(at, pa.int32()), pa.array(holes, pa.int32()), pa.array(grams),
                     pa.array([body] * len(grams), pa.int64()), pa.array([len(h)] * len(grams), pa.int32())],
                    names=["item_id", "pos", "hole", "h", "body", "n_words"],
                )

    grams_of_items = checkpoint(
        tests.mapInArrow(item_grams, "item_id long, pos int, hole int, h long, body long, n_words int")
    )
    wanted = grams_of_items.select("h").distinct()
    small = grams_of_items.count() <= max_broadcast_grams  # then the items' words are bounded too
    short = sorted(r[0] for r in grams_of_items.filter(F.col("n_words") < gram).select("n_words").distinct().collect())
    known = np.sort(wanted.toArrow().column("h").to_numpy()) if small else None
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def doc_grams(batches: Batches) -> Batches:
        numbers = shared_numbers()
        mask = (1 << 20) - 1
        if shared.value is not None:
            may = np.zeros(mask + 1, dtype=bool)
            may[shared.value & mask] = True
        for batch in (part for b in batches for part in _parts(b)):
            h, doc = numbers.hashes(batch.column("text").to_pylist())
            first = np.searchsorted(doc, np.arange(batch.num_rows))
            for size, hole in [*((gram, k) for k in holes_of(gram)), *((n, 0) for n in short)]:
                grams, at = gram_hashes(h, doc, size, hole)
                if shared.value is not None:
                    maybe = np.flatnonzero(may[grams & mask])
                    maybe = maybe[np.isin(grams[maybe], shared.value)]
                    grams, at = grams[maybe], at[maybe]
                for lo in range(0, len(grams), 500_000):
                    place = at[lo : lo + 500_000]
                    row = pa.array(doc[place])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(row), batch.column("page").take(row),
                         pa.array((place - first[doc[place]]).astype(np.int32)), pa.array(grams[lo : lo + 500_000])],
                        names=["doc_id", "page", "pos", "h"],
                    )

    hits = docs.mapInArrow(doc_grams, "doc_id long, page long, pos int, h long")
    hits = checkpoint(hits if small else hits.join(wanted, "h", "left_semi").select("doc_id", "page", "pos", "h"))
    pages = docs.select("page").distinct().count()
    limit = stock_share * pages
    spread = hits.groupBy("h").agg(F.countDistinct("page").alias("pages"))
    texts = grams_of_items.groupBy("h").agg(F.countDistinct("body").alias("texts"))
    of_item = (
        grams_of_items.join(spread, "h", "left").join(texts, "h")
        .groupBy("item_id", "n_words")
        .agg(F.sort_array(F.collect_list(
            F.struct("hole", "pos", "h", F.coalesce("pages", F.lit(0)).alias("pages"), "texts")
        )).alias("grams"))
    )

    def judge(batches: Batches) -> Batches:
        for batch in batches:
            out: list[tuple] = []
            for i, n, row in zip(*(batch.column(c).to_pylist() for c in ("item_id", "n_words", "grams")), strict=True):
                seeds: list[dict] = []
                stock_at: set[int] = set()
                for hole in holes_of(gram):
                    part = [g for g in row if g["hole"] == hole]
                    if not part:
                        continue
                    stock = stock_positions(
                        np.array([g["pages"] for g in part]), np.array([g["texts"] for g in part]), limit,
                        min(gram, n) + (hole > 0), stock_items, min_share,
                    )
                    if not hole:
                        stock_at = {g["pos"] for g, off in zip(part, stock, strict=True) if off}
                    seeds += [{"h": g["h"], "whole": not hole, "at": g["pos"]} for g, off in zip(part, stock, strict=True)
                              if g["pages"] and not off and g["pos"] not in stock_at]
                out.append((i, n, sorted(stock_at), seeds))
            if out:
                i, n, at, seeds = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.list_(pa.int32())),
                     pa.array(seeds, pa.list_(pa.struct([("h", pa.int64()), ("whole", pa.bool_()), ("at", pa.int32())])))],
                    names=["item_id", "n_words", "stock_pos", "seeds"],
                )

    judged = checkpoint(of_item.mapInArrow(judge, "item_id long, n_words int, stock_pos array<int>, seeds array<struct<h: long, whole: boolean, at: int>>"))
    seeds = judged.select("item_id", "n_words", F.explode("seeds").alias("s")).select("item_id", "n_words", "s.*").distinct()
    if small:
        seeds = F.broadcast(seeds)
    candidates = checkpoint(
        hits.select("doc_id", "pos", "h").distinct().join(seeds, "h").groupBy("doc_id", "item_id", "n_words").agg(
            F.collect_set(F.col("pos") - F.col("at")).alias("starts"), F.max("whole").alias("whole"),
            (F.min("h") != F.max("h")).alias("several"),
        )
        .filter(F.col("whole") | F.col("several") | (F.col("n_words") < 4 * gram))
        .groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "n_words", "starts")).alias("at"))
    )
    # texts of documents without a candidate are never shuffled
    ids = candidates.select("doc_id")
    around = (
        docs.select("doc_id", "text").join(broadcast_if_small(ids, max_broadcast_ids), "doc_id", "left_semi")
        .dropDuplicates(["doc_id", "text"]).join(candidates, "doc_id")
    )

    def cut_windows(batches: Batches) -> Batches:
        numbers = shared_numbers()
        for batch in (part for b in batches for part in _parts(b, 200)):
            h, doc = numbers.hashes(batch.column("text").to_pylist())
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            out: list[tuple] = []
            for k, (d, at) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                own = (h[first[k] : first[k + 1]] & 0x7FFFFFFF).astype(np.int32)
                for hit in at:
                    spans = windows_of(np.array(hit["starts"]), hit["n_words"], len(own))
                    out += [(d, hit["item_id"], own[a:b]) for a, b in spans if b > a]
            if out:
                d, i, own = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(own, pa.list_(pa.int32()))],
                    names=["doc_id", "item_id", "around"],
                )

    def passages_of(batches: Batches) -> Batches:
        numbers = shared_numbers()
        for batch in batches:
            out = []
            for text, stock_at in zip(batch.column("text").to_pylist(), batch.column("stock_pos").to_pylist(), strict=True):
                h = numbers.hashes([text])[0]
                keep = np.ones(len(h), dtype=bool)
                for p in stock_at or ():
                    keep[p : p + gram] = False
                out.append((h[keep] & 0x7FFFFFFF).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(out, pa.list_(pa.int32()))], names=["item_id", "passage"]
            )

    passages = tests.join(judged.select("item_id", "stock_pos"), "item_id").mapInArrow(
        passages_of, "item_id long, passage array<int>"
    )
    windows = around.mapInArrow(cut_windows, "doc_id long, item_id long, around array<int>").repartition("doc_id", "item_id")
    pairs = windows.join(F.broadcast(passages) if small else passages, "item_id").select("doc_id", "item_id", "passage", "around")

    def align(batches: Batches) -> Batches:
        for batch in (part for b in batches for part in _parts(b)):
            items_ = _lists(batch.column("passage"))
            docs_ = _lists(batch.column("around"))
            n = np.array([len(x) for x in items_], dtype=np.int64)
            found = align_pairs(items_, docs_, 0.2 * np.maximum(n, 1))
            hit = np.flatnonzero(
                (found[:, 0] > 0) & (found[:, 1] >= min_share * n) & (found[:, 2] >= 0.7 * found[:, 1])
            )
            if len(hit):
                at = pa.array(hit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("item_id").take(at), pa.array(found[hit, 1]),
                     pa.array(found[hit, 2]), pa.array(n[hit])],
                    names=["doc_id", "item_id", "covered_words", "matched_words", "item_words"],
                )

    found = pairs.mapInArrow(
        align, "doc_id long, item_id long, covered_words long, matched_words long, item_words long"
    )
    best = F.max(F.struct("covered_words", "matched_words", "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _parts(batch: pa.RecordBatch, rows: int = 1000) -> Batches:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column without nulls as arrays."""
    flat = column.flatten().to_numpy()
    ends = np.cumsum(column.value_lengths().to_numpy())
    return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
