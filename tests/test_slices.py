"""Sliced state machines and recurrences against literal loops; how work spreads over tasks and rounds."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickspark.operators import folds, resample, slices, smooth

SECOND = 10**9


def walk(spark, n, seed, instruments="ab", calm=(0, 0), ties=True):
    """Quotes of a random walk in whole cents; between calm[0] and calm[1] prices stand still."""
    rng, t, bid, rows = random.Random(seed), 1_700_000_000 * SECOND, dict.fromkeys(instruments, 10_000), []
    for i in range(n):
        t += rng.choice([0, 1, 30, 7200] if ties else [1, 30]) * SECOND
        k = rng.choice(instruments)
        bid[k] += 0 if calm[0] <= i < calm[1] else rng.randrange(-9, 10)
        gone = rng.random() < 0.03
        rows.append((t, i, k, None if gone else Decimal(bid[k]) / 100, Decimal(bid[k] + rng.randrange(1, 6)) / 100, Decimal(1), Decimal(2)))
    return spark.createDataFrame(rows, "t long, seq long, instr string, bid decimal(18,2), ask decimal(18,2), bsz decimal(20,6), asz decimal(20,6)").repartition(3), rows


def streams(rows):
    out = {}
    for r in rows:
        if r[3] is not None and r[4] is not None:
            out.setdefault(r[2], []).append(r)
    return out


def moving(rows, quantum, repeat):
    out = set()
    for own in streams(rows).values():
        b = a = mid = Decimal(0)
        for t, seq, k, bid, ask, bsz, asz in own:
            moves = abs(bid - b) > quantum or abs(ask - a) > quantum if quantum is not None else not bid <= mid <= ask
            if moves:
                b, a, mid = bid, ask, (bid + ask) / 2
            if moves or repeat:
                out.add((t, seq, k, b, a, bsz, asz))
    return out


def turning(rows, limit):
    out = []
    for k, own in streams(rows).items():
        best, held = {}, None
        for t, _, _, bid, ask, _, _ in own:
            for side, other, here, back in (("SHORT", "LONG", bid, ask), ("LONG", "SHORT", -ask, -bid)):
                if side not in best or here >= best[side][0]:
                    best[side] = (here, t)
                elif held != side and best[side][0] - back > limit:
                    out.append((k, best[side][1], side, abs(best[side][0])))
                    held, best[other] = side, (-back, t)
        if held:
            price, at = best["SHORT" if held == "LONG" else "LONG"]
            out.append((k, at, "CANCEL", abs(price)))
    return sorted(out)


@pytest.mark.parametrize(("quantum", "repeat"), [("0.15", False), ("0.155", True), (None, False)])
def test_moves_over_slices_equal_the_loop(spark, quantum, repeat):
    df, rows = walk(spark, 400, 3)
    if quantum is None:
        assert sorted(map(str, folds.mid_latent(df).collect())) == sorted(map(str, folds.qq(df).collect()))
    want = moving(rows, None if quantum is None else Decimal(quantum), repeat)
    for size in (10**6, 17):
        got = folds.qq(df, quantum, repeat=repeat, rows=size)
        assert got.columns == df.columns
        assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize(("limit", "seed"), [("0", 1), ("0.25", 2)])
def test_turns_over_slices_equal_the_loop(spark, limit, seed):
    df, rows = walk(spark, 300, seed, calm=(100, 200))
    for size in (10**6, 17):
        got = folds.opt(df, limit, limit_orders=True, rows=size).select("instr", "t", "side", "price")
        assert sorted(tuple(r) for r in got.collect()) == turning(rows, Decimal(limit))


def test_calm_slices_need_no_rounds_and_wrong_guesses_few(spark):
    df, _ = walk(spark, 600, 5, instruments="a", calm=(150, 450), ties=False)
    told = []
    folds.qq(df, "0.15", rows=20, told=told).count()
    n = slices.sliced(df.where("bid is not null"), ["instr"], 20)[0].select("_slice").distinct().count()
    assert n >= 25 and len(told) <= n // 4 and told[-1] == 0 and told == sorted(told, reverse=True) and told[0] <= n // 2
    turns = []
    folds.opt(df, "0.3", rows=20, told=turns).count()
    assert len(turns) <= n // 4 and turns[-1] == 0
    alone = []
    folds.qq(df, "0.15", told=alone).count()
    assert alone == []  # one slice a stream: its start is known


def test_a_machine_that_never_forgets_takes_a_round_for_each_slice(spark):
    class Adds(slices.Machine):
        state, initial, seen = ("sum",), (0,), ("n",)

        def guess(self, t, b, a):
            return (-1,)

        def run(self, state, t, b, a, emit=None):
            return (state[0] + sum(b),)

        def observe(self, seen, t, b, a):
            return ((seen or (0,))[0] + len(t),)

        def quiet(self, state, seen):
            return None

    rows = spark.createDataFrame([(i * SECOND, i, None, i, i) for i in range(60)], "t long, seq long, instr string, b long, a long")
    told = []
    cut, _ = slices.sliced(rows, ["instr"], 10)
    starts = slices.settled_starts(cut, Adds(), ["instr"], told=told).orderBy("_slice").collect()
    edges = [r.lo for r in cut.groupBy("_slice").agg(F.min("b").alias("lo")).orderBy("_slice").collect()]
    assert [r.s_sum for r in starts] == [sum(range(e)) for e in edges] and len(edges) >= 5
    assert told[-1] == 0 and len(told) <= len(edges)


def test_one_busy_day_of_one_instrument_is_spread(spark):
    rng = random.Random(8)
    busy = [(10**18 + rng.randrange(86_400) * SECOND, i, "a", i % 7) for i in range(4000)]
    rest = [(10**18 + rng.randrange(300 * 86_400) * SECOND, 4000 + i, rng.choice("ab"), 1) for i in range(8000)]
    df = spark.createDataFrame(busy + rest, "t long, seq long, instr string, x long")
    sizes = [r["count"] for r in slices.sliced(df, ["instr"], 500)[0].groupBy("instr", "_slice").count().collect()]
    assert sum(sizes) == 12_000 and max(sizes) <= 750 and len(sizes) >= 24
    tasks = slices.in_order(slices.sliced(df, ["instr"], 500)[0], ["instr", "_slice"], ("t", "seq"))
    with_conf = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        per = [r[1] for r in tasks.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_conf)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(per) <= 12_000 / 5
    order = [(r.t, r._slice) for r in slices.sliced(df, [], 100)[0].collect()]
    assert all(a[1] <= b[1] for a, b in zip(sorted(order), sorted(order)[1:], strict=False))


def weighted(rows, column, halflife):
    base, out = 1 - math.log(2) / halflife, {}
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    for own in by.values():
        last, n, s, q = None, 0.0, 0.0, 0.0
        for r in own:
            decay = 0.0 if last is None else max(base, 0.0) ** ((r[0] - last) / 1e9)
            last, x = r[0], r[column]
            if x is None:
                out[r[1]] = (None, None)
                continue
            n, s = n * decay + 1, s * decay + float(x)
            q = q * decay + (float(x) - s / n) ** 2
            out[r[1]] = (s / n, math.sqrt(q / n))
    return out


def test_weighted_means_over_slices_equal_the_loop(spark):
    df, rows = walk(spark, 300, 6)
    want = weighted(rows, 3, 3600)
    for size in (10**6, 13):
        got = {r.seq: (r.bid_mean, r.bid_dev) for r in smooth.ewma(df, ["bid"], "1h", by=["instr"], rows=size).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == (None, None) if v[0] is None else got[k] == pytest.approx(v, abs=1e-7)
    whole = smooth.ewma(df, ["bid", "ask"], "1s", rows=50)
    assert whole.count() == 300 and whole.columns == ["t", "seq", "bid_mean", "bid_dev", "ask_mean", "ask_dev"]
    assert smooth.ewma(df.limit(0), ["bid"], "1h").count() == 0


@pytest.mark.parametrize("cells", [1, 2, 5])
def test_the_window_rule_over_slices_of_cells(spark, cells):
    """Ticks mostly on edges, so that runs of cells go over the slices' edges; against the literal rule."""
    rng, width, rows, want = random.Random(cells), 10 * SECOND, [], {}
    for k in ("x", "y"):
        times = sorted({rng.randrange(1, 60) * width + (0 if rng.random() < 0.8 else rng.randrange(width)) for _ in range(60)})
        edge = -1
        for t in times:
            edge = (t // width + 1) * width if t > edge else edge
            want[k, t] = edge
        rows += [(t, n, k) for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "t long, seq long, instr string")
    assert {(r.instr, r.t): r.edge for r in resample.window_edges(df, width, cells=cells).collect()} == want
    alone = [r for r in rows if r[2] == "x"]
    got = resample.window_edges(spark.createDataFrame(alone, df.schema), width, [], cells=cells)
    assert {("x", r.t): r.edge for r in got.collect()} == {k: v for k, v in want.items() if k[0] == "x"}


def test_slices_are_cut_once(spark):
    df, _ = walk(spark, 600, 3)
    cut, single = slices.sliced(df, ["instr"], 50)
    assert not single
    # all later passes read the same bounds: no sketch is left in the plan
    assert "percentile_approx" not in cut._jdf.queryExecution().analyzed().toString().lower()
    sketches = {str(df.repartition(n, "t").groupBy().agg(F.percentile_approx("t", [i / 97 for i in range(1, 97)], 50)).first()[0]) for n in (1, 2, 3, 7)}
    assert len(sketches) > 1
