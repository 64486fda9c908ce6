"""p3 to p6 and p8 to p10: brute force, awkward inputs, hot keys."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoward.llm import event_runs, linked_splits, mixing, nearest_time, percentiles
from chronoward.llm import queries as q
from tests.oracle import connection, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(q.QUERIES[name](spark, FOLDER), q.SQL[name], con) == ""


# p3

def quantiles(spark, rows, probs):
    df = spark.createDataFrame(rows, "g string, v double, n int, label string")
    counts = percentiles.value_counts(df, {"g": F.col("g")}, F.col("v"))
    return {(r.g, r.probability): (r.value, r.n_values) for r in percentiles.percentiles_of_counts(counts, ["g"], probs).collect()}


def test_percentiles_of_hot_group_with_ties(spark):
    rng = np.random.default_rng(1)
    hot = [float(x) for x in np.round(rng.lognormal(2, 1, 6000), 1)] + [7.0] * 3000
    rows = [("hot", v, 1, "x") for v in hot] + [("one", 3.0, 1, "x"), (None, 5.0, 1, "x"), (None, 9.0, 1, "x")]
    rows += [("hot", None, 1, "x"), ("hot", math.nan, 1, "x"), ("hot", math.inf, 1, "x")]
    probs = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]
    got = quantiles(spark, rows, probs)
    for p in probs:
        assert got[("hot", p)] == (pytest.approx(np.percentile(hot, 100 * p)), len(hot))
        assert got[("one", p)] == (3.0, 1)
    assert got[(None, 0.5)] == (7.0, 2)
    assert quantiles(spark, [], probs) == {}


def test_a_large_group_is_located_in_pieces(monkeypatch):
    """A group of known total passes in constant memory, every row handled a bounded number of times."""
    monkeypatch.setattr(percentiles, "HELD_ROWS", 1000)
    handled, largest = 0, 0

    def batches(labels):
        for lo in range(0, len(labels), 400):
            part = labels[lo : lo + 400]
            yield pa.RecordBatch.from_pydict({"label": part, "n": pa.array([2] * len(part), pa.int64())})

    labels = ["a"] * 30_000 + ["b", "c", "c"] + ["d"] * 800 + ["e"] * 2500
    for _, n in percentiles._edge_counts(batches(labels), None):
        assert n > 0
    known = {name: (0, n) for name, n in percentiles._edge_counts(batches(labels), None)}
    assert known == {"a": (0, 60_000), "e": (0, 5000)}
    seen = {}
    for table, starts, passed in percentiles._pieces(batches(labels), known):
        handled += table.num_rows
        largest = max(largest, table.num_rows)
        names = table.column("label").to_pylist()
        assert passed == seen.get(names[0], 0)
        for name in names:
            seen[name] = seen.get(name, 0) + 2
    assert handled == len(labels) and largest <= 2800
    assert seen == {"a": 60_000, "b": 2, "c": 4, "d": 1600, "e": 5000}


def test_daily_summaries_combine(spark):
    rng = random.Random(2)
    rows = [(d, float(rng.randint(0, 50))) for d in (1, 2, 3) for _ in range(200)]
    df = spark.createDataFrame(rows, "day int, v double")
    days = percentiles.value_counts(df, {"g": F.lit("a"), "day": F.col("day")}, F.col("v"))
    whole = percentiles.percentiles_of_counts(percentiles.combine_counts(days, ["g"]), ["g"], [0.25]).first()
    assert whole.value == pytest.approx(np.percentile([v for _, v in rows], 25))


# p4

def test_minute_runs(spark):
    rng = random.Random(3)
    b = event_runs.BLOCK_MINUTES
    minutes = {m for m in range(2 * b + 40) if rng.random() < 0.7} | set(range(b - 9, b + 9))
    rows = [("a", m, True) for m in minutes for _ in range(2)] + [("a", 10_000, True), ("a", 10_001, None), ("a", None, True), (None, 5, True)]
    df = spark.createDataFrame(rows, "k0 string, m long, e boolean")
    got = sorted((r.first_minute, r.last_minute) for r in event_runs.minute_runs(df, ["k0"], F.col("m"), F.col("e")).collect())
    want, run = [], []
    for m in sorted(minutes | {10_000}):
        if run and m == run[-1] + 1:
            run.append(m)
        else:
            want += [(run[0], run[-1])] if len(run) > 1 else []
            run = [m]
    want += [(run[0], run[-1])] if len(run) > 1 else []
    assert got == want


def brute_episodes(rows):
    out, by = [], {}
    for k, i, v, s, e in {r[1]: r for r in rows if None not in r}.values():
        by.setdefault(k, []).append((s, i, v, e))
    for k, xs in by.items():
        run = None
        for s, i, v, e in sorted(xs):
            if run and run[0] == v and s <= run[2] + 2:
                run = [v, run[1], max(run[2], e), run[3] + 1]
            else:
                out += [(k, run[0], run[1], run[2] - 1)] if run and run[3] > 1 else []
                run = [v, s, e, 1]
        out += [(k, run[0], run[1], run[2] - 1)] if run and run[3] > 1 else []
    return sorted(out)


def test_episode_runs_across_blocks(spark):
    rng = random.Random(4)
    for width in (7, 50):
        rows = []
        for i in range(400):
            s = rng.randint(0, 300)
            rows.append((rng.choice("xy"), i, rng.choice("ab"), s, s + rng.randint(1, 12)))
        rows += rows[:20] + [("x", 900, "a", None, 3), (None, 901, "a", 1, 2), ("x", 902, None, 1, 2)]
        df = spark.createDataFrame(rows, "seg string, id long, v string, s int, e int")
        out = event_runs.episode_runs(df, "seg", "id", F.col("v"), F.col("s"), F.col("e"), 2, block_minutes=width)
        assert sorted((r.seg, r.event_name, r.first_minute, r.last_minute) for r in out.collect()) == brute_episodes(rows)
    assert event_runs.episode_runs(df.limit(0), "seg", "id", F.col("v"), F.col("s"), F.col("e"), 2).count() == 0


def test_long_episode_carries_its_end_into_the_next_block(spark):
    for near in ([], [("x", 4, "a", 2152, 2155)]):
        rows = [("x", 1, "a", 2040, 2100), ("x", 2, "a", 2050, 2051), ("x", 3, "a", 2060, 2150), *near]
        rows += [("x", 9, "b", 2500, 2501), ("y", 20, "a", 2040, 6000)] + [("y", 21 + i, "a", 2100 + 300 * i, 2101 + 300 * i) for i in range(12)]
        df = spark.createDataFrame(rows, "seg string, id long, v string, s int, e int")
        out = event_runs.episode_runs(df, "seg", "id", F.col("v"), F.col("s"), F.col("e"), 2)
        assert sorted((r.seg, r.event_name, r.first_minute, r.last_minute) for r in out.collect()) == brute_episodes(rows)
    rng = random.Random(14)
    rows = []
    for i in range(300):
        s = rng.randint(0, 400)
        rows.append(("z", i, rng.choice("aaaaab"), s, s + rng.choice([1, 1, 1, 2, 40])))
    df = spark.createDataFrame(rows, "seg string, id long, v string, s int, e int")
    out = event_runs.episode_runs(df, "seg", "id", F.col("v"), F.col("s"), F.col("e"), 2, block_minutes=16)
    assert sorted((r.seg, r.event_name, r.first_minute, r.last_minute) for r in out.collect()) == brute_episodes(rows)


# p5

def test_components_and_splits(spark):
    rng = random.Random(5)
    rows = [(i, f"p{rng.randint(0, 60)}", f"s{rng.randint(0, 90)}") for i in range(80)]
    rows += [(1000 + i, "hub", f"h{i}") for i in range(200)] + [(2000 + i, f"c{i}", None) for i in range(3)]
    rows += [(2100 + i, f"c{i}", f"c{i + 1}x") for i in range(3)] + [(3000, None, None), (3001, None, None), (None, "p1", "s1")]
    df = spark.createDataFrame(rows, "rec long, p string, s string")
    out = {r.rec: (r.group_key, r.split_label) for r in linked_splits.assign_splits(
        df, "rec", [F.col("p"), F.col("s")], [("a", 0.5), ("b", 0.5)]).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p, s in rows:
        for e in (("p", p), ("s", s)):
            if i is not None and e[1] is not None:
                parent[find(("r", i))] = find(e)
    want = {}
    for i, p, s in rows:
        if i is not None:
            want.setdefault(find(("r", i)), set()).add(i)
    got = {}
    for i, (g, _) in out.items():
        got.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(len({out[i][1] for i in group}) == 1 for group in got.values())


def test_hubs_are_salted(spark):
    edges = [(f"a{i:03d}", "hub") for i in range(200)] + [(f"a{i:03d}", f"b{i % 50}") for i in range(200)] + [("x", "y")]
    e = spark.createDataFrame(edges, "u string, v string")
    plain = {r.node: r.component for r in linked_splits.connected_components(e).collect()}
    salted = {r.node: r.component for r in linked_splits.connected_components(e, hub_links=20, salts=4).collect()}
    assert plain == salted and set(plain.values()) == {"a000", "x"}


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(150)] + [("z", "z"), (None, "a")], "u string, v string")
    out = {r.node: r.component for r in linked_splits.connected_components(edges).collect()}
    assert set(out.values()) == {"0000", "z"} and len(out) == 152
    assert linked_splits.connected_components(edges.limit(0)).count() == 0


# p6

def test_nearest_equals_brute_force(spark):
    rng = random.Random(6)
    left = [(rng.choice("ab"), rng.uniform(0, 40_000), i) for i in range(300)]
    right = [(rng.choice("ab"), rng.uniform(0, 40_000), 10_000 + i) for i in range(900)]
    right += [(k, t, i + 5) for k, t, i in right[:30]] + right[:20]
    left += [(None, 5.0, 1), ("a", None, 2), ("a", math.nan, 3), ("a", 14_399.0, 4), ("a", 14_401.0, 5)]
    right += [("a", 14_400.0, 7), (None, 5.0, 8), ("a", None, 9)]
    schema = "k string, t double, id long"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    cols = (F.col("k"), F.col("t"), F.col("id"))
    got = {r.left_id: r.right_id for r in nearest_time.nearest_in_time(a, b, 30.0, cols, cols).collect()}
    want = {}
    for k, t, i in left:
        if k is None or t is None or t != t:
            continue
        near = [(abs(t - u), u, j) for h, u, j in right if h == k and u is not None and abs(t - u) <= 30.0]
        if near:
            want[i] = min(near)[2]
    assert got == want
    assert nearest_time.nearest_in_time(a.limit(0), b, 30.0, cols, cols).count() == 0


def test_nearest_ties_go_to_the_earlier(spark):
    a = spark.createDataFrame([("a", 10.0, 1)], "k string, t double, id long")
    b = spark.createDataFrame([("a", 15.0, 3), ("a", 5.0, 9), ("a", 5.0, 4)], "k string, t double, id long")
    cols = (F.col("k"), F.col("t"), F.col("id"))
    assert [r.right_id for r in nearest_time.nearest_in_time(a, b, 5.0, cols, cols).collect()] == [4]


# p9

def test_permutation_is_one_to_one():
    for n in (1, 2, 7, 100, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, np.full(n, 5))) == list(range(n))


def test_mixture_shares_and_caps(spark):
    rng = random.Random(7)
    docs = [(i, "big" if i % 4 else "small", " ".join(str(rng.randint(0, 999)) for _ in range(60))) for i in range(1200)]
    docs += [(5000, "big", None), (5001, "big", ""), (5002, None, "x y"), (5003, "other", "x y"), docs[0]]
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame([(*r, 1) for r in docs], "id long, source string, text string, block int")
    mix, shares = mixing.mix_sources(d, t, q.TOKENIZER_PATH, block_tokens=64, shard_blocks=32, tasks=3)
    got = {r.source: r for r in shares.collect()}
    rows = mix.collect()
    slots = {(r.shard, r.slot, r.source, r.copy, r.block) for r in rows}
    assert len({x[:2] for x in slots}) == len(slots) == len({x[2:] for x in slots})  # one block a slot, no block twice in a copy
    assert sorted({x[:2] for x in slots}) == [(i // 32, i % 32) for i in range(len(slots))]  # no slot is missing
    assert got["none"].used_tokens == 0 and abs(got["big"].actual_share - 0.6) < 0.01
    assert got["big"].repeats <= 1.0 and got["small"].repeats <= 2.0
    n_blocks = {s: got[s].available_tokens // 64 for s in ("big", "small")}
    assert len(slots) == min(int(n_blocks["big"] / 0.6), int(2 * n_blocks["small"] / 0.4))  # all that the caps allow
    size, used = {}, {}
    n = {r.id: r.n for r in mixing.token_counts(d.filter("text is not null"), q.TOKENIZER_PATH).collect()}
    seen = set()
    for r in rows:
        assert 0 <= r.token_from < r.token_to <= n[r.doc_id]
        assert (r.source, r.block, r.copy, r.doc_id) not in seen
        seen.add((r.source, r.block, r.copy, r.doc_id))
        size[r.shard, r.slot] = size.get((r.shard, r.slot), 0) + r.token_to - r.token_from
        used[r.source] = used.get(r.source, 0) + r.token_to - r.token_from
    assert set(size.values()) == {64}
    assert used == {s: got[s].used_tokens for s in ("big", "small")}
    empty_mix, empty_shares = mixing.mix_sources(d.limit(0), t, q.TOKENIZER_PATH)
    assert empty_mix.count() == 0 and {r.actual_share for r in empty_shares.collect()} == {0.0}


def test_draws_use_up_every_total():
    rng = np.random.default_rng(1)
    for left in (np.array([5, 0, 17]), np.array([3_000_000_000, 1_000_000_000, 7])):
        rest, size = left.copy(), int(left.sum()) // 4 + 1
        while rest.sum():
            drawn = mixing.draw_without_replacement(rng, rest, min(size, int(rest.sum())))
            assert drawn.sum() == min(size, rest.sum()) and (drawn <= rest).all() and (drawn >= 0).all()
            rest = rest - drawn
    assert mixing.slots_of({"a": 0.5, "b": 0.5}, {"a": 3, "b": 10}) == {"a": 3, "b": 3}
    assert mixing.slots_of({"a": 0.3, "b": 0.7}, {"a": 4, "b": 10}) == {"a": 4, "b": 9}
    assert mixing.slots_of({}, {}) == {}


def test_tokens_round_trip():
    enc = mixing.tokenizer(q.TOKENIZER_PATH)
    for text in ("", "Ein Säugling – 3 Äpfel…", "a\n\n  b\t<|endoftext|>", "漢字 " * 50):
        assert enc.decode(enc.encode_ordinary(text)) == text
