"""Mixture of sources to target shares of tokens.

Each source's documents, in a pseudorandom order, form one token stream that is cut
into blocks of exactly one length. The sources' slots are fixed by their shares; every
output shard draws multinomial counts per source, conditional on those totals, so no
slot is missing or beyond its source's cap. The k-th slot of a source takes the block
that a pseudorandom permutation of the source's block numbers assigns to it, a new
permutation for each repetition. Blocks are joined to slots by number.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoward.operators.ordered_scan import Batches, running_sums
from chronoward.session import checkpoint

#: Fixed value: how the byte-level BPE splits text into pieces.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE of a ``.tiktoken`` vocabulary file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``id, source, n`` of ``docs(id, source, text)``: tokens of each whole text."""

    def count(batches: Batches) -> Batches:
        encoding = tokenizer(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("source"), pa.array(n, pa.int64())], names=["id", "source", "n"]
            )

    return docs.select("id", "source", "text").mapInArrow(count, "id long, source string, n long")


def running_totals(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``label`` and ``n``) plus ``before``: the sum of ``n`` of earlier rows of the label."""
    return running_sums(rows, "label", order, ["n"]).withColumnRenamed("before_n", "before")


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of range(size): Feistel rounds with cycle walking."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    out = index.astype(np.uint64)
    open_ = np.ones(len(out), dtype=bool)
    with np.errstate(over="ignore"):
        while open_.any():
            x, k = out[open_], key[open_].astype(np.uint64)
            left, right = x >> shift, x & mask
            for r in range(4):
                f = _mix64(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & mask
                left, right = right, left ^ f
            out[open_] = (left << shift) | right
            open_[open_] = out[open_] >= np.uint64(size)
    return out.astype(np.int64)


def slots_of(shares: dict[str, float], caps: dict[str, int]) -> dict[str, int]:
    """Whole slots per source, in the given shares (of sum 1), as many as the caps allow."""
    total = int(min((caps[s] / share for s, share in shares.items()), default=0))
    slots = {s: min(int(total * share), caps[s]) for s, share in shares.items()}
    for s in sorted(shares, key=lambda s: slots[s] - total * shares[s]):  # largest remainders first
        if sum(slots.values()) < total and slots[s] < caps[s]:
            slots[s] += 1
    return slots


#: Fixed value: from this many slots on a draw is rounded from the normal law (relative error under 1e-4).
_EXACT_DRAW = 900_000_000


def draw_without_replacement(rng: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """Counts per source of ``size`` slots out of ``left``: multinomial, given that all of ``left`` is drawn in the end."""
    total = int(left.sum())
    if total < _EXACT_DRAW:
        return rng.multivariate_hypergeometric(left, size, method="marginals")
    out = np.zeros_like(left)
    for i in range(len(left)):
        rest = int(left[i + 1 :].sum())
        here = int(left[i]) + rest
        share = left[i] / here if here else 0.0
        deviation = math.sqrt(max(size * share * (1 - share) * (here - size) / max(here - 1, 1), 0.0))
        out[i] = min(max(round(rng.normal(size * share, deviation)), size - rest, 0), left[i], size)
        size -= int(out[i])
    return out


def mix_sources(
    docs: DataFrame, targets: DataFrame, path: str, block_tokens: int = 256, shard_blocks: int = 256, seed: int = 7,
    tasks: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) of ``docs(id, source, text)`` for ``targets(source, target_share, max_repeats)``.

    mixture: ``shard, slot, source, copy, block, doc_id, token_from, token_to``: the
    pieces of documents that make up each slot's block of ``block_tokens`` tokens.
    shares: per target source ``target_share, max_repeats, available_tokens,
    used_tokens, actual_share, repeats, remainder_tokens``; the remainder are the tokens
    (fewer than a block) at the end of a source's stream that fill no block.

    ``path`` names the tokenizer's vocabulary file, on every machine. The total is the
    largest at which every source that fills a block meets its share (shares
    renormalised over those sources) within ``max_repeats`` full passes. Sources
    without a block or target give nothing; null source, null or empty text count no
    tokens; of repeated ids the row of the least source and fewest tokens counts.
    ``targets`` is one row per source and is read on the driver.
    """
    # every text is tokenised once, where it is read; texts are never shuffled
    counted = checkpoint(token_counts(docs.filter("id is not null and source is not null"), path))
    counted = (
        counted.groupBy("id").agg(F.min(F.struct("source", "n")).alias("row")).select("id", "row.*").filter("n > 0")
    )
    wanted = {
        r["source"]: (float(r["target_share"]), int(r["max_repeats"]))
        for r in targets.filter("source is not null and target_share > 0 and max_repeats > 0").collect()
    }
    listed = counted.filter(F.col("source").isin(sorted(wanted)))
    spans = running_totals(
        listed.select(F.col("source").alias("label"), F.xxhash64("id", F.lit(seed)).alias("h"), "id", "n"), ["h", "id"]
    )
    spans = checkpoint(spans)
    tokens = {r["label"]: r["t"] for r in spans.groupBy("label").agg(F.sum("n").alias("t")).collect()}
    blocks = {s: t // block_tokens for s, t in sorted(tokens.items()) if t >= block_tokens}
    names = list(blocks)
    share_sum = sum(wanted[s][0] for s in names)
    planned = slots_of({s: wanted[s][0] / share_sum for s in names}, {s: blocks[s] * wanted[s][1] for s in names})
    slots_total = sum(planned.values())
    shards = math.ceil(slots_total / shard_blocks)
    spark = docs.sparkSession

    # runs of shards, each with its counts: drawn on the driver, shard by shard inside the tasks
    left = np.array([planned[s] for s in names], dtype=np.int64)
    before = np.zeros_like(left)
    rng = np.random.default_rng([seed, 0])
    runs: list[tuple[int, int, list[int], list[int]]] = []
    per_run = max(1, math.ceil(shards / tasks))
    for first in range(0, shards, per_run):
        last = min(first + per_run, shards)
        size = min(last * shard_blocks, slots_total) - first * shard_blocks
        drawn = draw_without_replacement(rng, left, size)
        runs.append((first, last, drawn.tolist(), before.tolist()))
        left, before = left - drawn, before + drawn

    def fill(batches: Batches) -> Batches:
        for batch in batches:
            for first, last, drawn, begin in zip(*(batch.column(c).to_pylist() for c in ("first", "last", "drawn", "begin")), strict=True):
                rest, k0 = np.array(drawn), np.array(begin)
                rng = np.random.default_rng([seed, 1, first])
                parts: list[tuple[np.ndarray, ...]] = []
                for shard in range(first, last):
                    here = draw_without_replacement(rng, rest, int(min(shard_blocks, rest.sum())))
                    for i in np.flatnonzero(here):
                        k = np.arange(k0[i], k0[i] + here[i])
                        copy = k // blocks[names[i]]
                        block = permuted(k % blocks[names[i]], blocks[names[i]], copy * 1009 + int(i) * 7919 + seed)
                        parts.append((np.full(len(k), shard), k - k0[i] + here[:i].sum(), np.full(len(k), i), copy, block))
                    rest, k0 = rest - here, k0 + here
                    if parts and (len(parts) >= 1000 or shard == last - 1):
                        at, slot, source, copies, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
                        parts = []
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(at), pa.array(slot), pa.array(names).take(pa.array(source)), pa.array(copies), pa.array(numbers)],
                            names=["shard", "slot", "source", "copy", "block"],
                        )

    given = spark.createDataFrame(runs, "first long, last long, drawn array<long>, begin array<long>")
    slots = given.repartition(max(1, min(len(runs), tasks)), "first").mapInArrow(
        fill, "shard long, slot long, source string, copy long, block long"
    )
    end = F.col("before") + F.col("n")
    size = F.lit(block_tokens)
    n_blocks = F.create_map(*[F.lit(x) for s in names for x in (s, blocks[s])])[F.col("label")] if names else F.lit(0)
    pieces = (
        spans.withColumn(
            "block",
            F.explode(
                F.sequence(
                    F.floor(F.col("before") / size).cast("long"), F.floor((end - 1) / size).cast("long")
                )
            ),
        )
        .filter(F.col("block") < n_blocks)
        .select(
            F.col("label").alias("source"), "block", F.col("id").alias("doc_id"),
            F.greatest(F.col("block") * size - F.col("before"), F.lit(0)).cast("long").alias("token_from"),
            F.least((F.col("block") + 1) * size - F.col("before"), F.col("n")).cast("long").alias("token_to"),
        )
    )
    mixture = slots.join(pieces, ["source", "block"]).select(
        "shard", "slot", "source", "copy", "block", "doc_id", "token_from", "token_to"
    )
    used = slots.join(
        pieces.groupBy("source", "block").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("size")),
        ["source", "block"],
    ).groupBy("source").agg(F.sum("size").alias("used_tokens"))
    fixed = spark.createDataFrame(
        [(s, wanted[s][0], wanted[s][1], int(tokens.get(s, 0))) for s in sorted(wanted)] or [],
        "source string, target_share double, max_repeats int, available_tokens long",
    )
    total = used.agg(F.sum("used_tokens").alias("total"))
    shares = (
        fixed.join(used, "source", "left").join(F.broadcast(total))
        .select(
            "source", "target_share", "max_repeats", "available_tokens",
            F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
            F.coalesce(F.col("used_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
            F.when(F.col("available_tokens") > 0, F.coalesce("used_tokens", F.lit(0)) / F.col("available_tokens"))
            .otherwise(0.0).alias("repeats"), (F.col("available_tokens") % block_tokens).alias("remainder_tokens"),
        )
    )
    return mixture, shares
