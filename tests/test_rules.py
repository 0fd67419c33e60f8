"""Window rule against a literal loop, slices against whole streams, durations and stamps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tickspark.functions import bins, decimals, timeunits
from tickspark.operators import accounts, combine, events, folds, generate, resample, running, smooth
from tickspark.sources import ticks


@pytest.mark.parametrize("seed", range(4))
def test_window_edges_follow_the_literal_rule(spark, seed):
    rng, i = random.Random(seed), 10 * 10**9
    ticks = sorted({rng.randrange(1, 60) * (i if seed % 2 else i // 5) for _ in range(60)})
    df = spark.createDataFrame([(t, n, "x") for n, t in enumerate(ticks)], "t long, seq long, instr string")
    want, edge = {}, -1
    for t in ticks:
        if t > edge:
            edge = (t // i + 1) * i
        want[t] = edge
    assert {r.t: r.edge for r in resample.window_edges(df, i).collect()} == want


def some_quotes(spark, n=300, seed=5):
    rng = random.Random(seed)
    rows, t = [], 1_700_000_000 * 10**9
    for i in range(n):
        t += rng.randrange(0, 90) * 10**9
        bid = rng.randrange(100, 200)
        rows.append((t, i, rng.choice("ab"), bid, bid + rng.randrange(1, 5), rng.randrange(1, 9), rng.randrange(1, 9)))
    return spark.createDataFrame(rows, "t long, seq long, instr string, bid long, ask long, bsz long, asz long").selectExpr("t", "seq", "instr", *(f"cast({c} as decimal(18,2)) as {c}" for c in ("bid", "ask", "bsz", "asz")))


def test_slices_make_no_difference(spark):
    q = some_quotes(spark)
    one, many = (running.previous(q, {"x": "bid"}, ["instr"], every=e).select("seq", "x") for e in ("52w", "5m"))
    assert sorted(one.collect()) == sorted(many.collect())
    fwd = q.where("seq % 7 = 0").selectExpr("t", "seq", "'f' as fwd_id", "instr as underlying", "bid", "ask")
    a, b = (sorted(map(tuple, combine.fra(fwd, q, e).collect())) for e in ("52w", "3m"))
    assert a == b and len(a) == fwd.count()


def test_counts_add_up(spark):
    q = some_quotes(spark)
    per = {r.dimen: r["sum(cnt)"] for r in resample.quodist(q, "10m", res=2).groupBy("dimen").sum("cnt").collect()}
    assert set(per.values()) == {q.count()} and len(per) == 9
    assert events.evt_poisson(q, "10m").agg(F.sum(F.col("k") * F.col("cnt"))).first()[0] == q.count()
    assert resample.thours(q).agg(F.sum("cnt"), F.count("bin")).first()[:] == (q.count(), 168)


def test_rolling_windows_are_maximal(spark):
    q = some_quotes(spark, 60)
    rows = sorted((r.t, r.seq) for r in q.collect())
    w, want = 300 * 10**9, set()
    for j, (t, _) in enumerate(rows):
        members = [r for r in rows[: j + 1] if r[0] > t - w]
        if j + 1 == len(rows) or rows[j + 1][0] - members[0][0] >= w:
            want |= {(j + 1, *m) for m in members}
    assert {(r.window_id, r.t, r.seq) for r in smooth.rolling(q, "300").collect()} == want


def test_seasonality_is_undone(spark):
    q = some_quotes(spark)
    profile = smooth.sea_profile(q, "adev", "1h", "10m", by=["instr"])
    there = smooth.sea_apply(q, profile, "adev", "1h", "10m")
    again = there.selectExpr("t", "seq", "instr", "seasoned as bid", "seasoned as ask")
    back = smooth.sea_apply(again, profile, "adev", "1h", "10m", reverse=True)
    both = back.select("seq", "seasoned").join(q.selectExpr("seq", "cast((bid + ask) / 2 as double) as mid"), "seq")
    assert both.where(F.abs(F.col("seasoned") - F.col("mid")) > 1e-6).count() == 0


def test_hindsight_beats_a_round_trip(spark):
    q = some_quotes(spark)
    pnl = {}
    for r in folds.opt(q, limit_orders=True).orderBy("instr", "t").collect():
        turns = pnl.setdefault(r.instr, [])
        turns.append((r.side, float(r.price)))
    for instr, turns in pnl.items():
        total, side, at = 0.0, None, 0.0
        for s, px in turns:
            if side:
                total += (px - at) if side == "LONG" else (at - px)
            side, at = s, px
        rows = [(float(r.bid), float(r.ask)) for r in q.where(F.col("instr") == instr).orderBy("t", "seq").collect()]
        best = max(rows[j][0] - rows[i][1] for i in range(len(rows)) for j in range(i, len(rows)))
        assert total >= best - 1e-9


def test_calendar_windows(spark):
    import datetime

    utc = datetime.timezone.utc
    at = lambda *d: int(datetime.datetime(*d, tzinfo=utc).timestamp()) * 10**9
    days = [(2024, 1, 31, 12), (2024, 2, 29), (2024, 3, 1), (2024, 3, 1, 1), (2025, 1, 1)]
    df = spark.createDataFrame([(at(*d), i) for i, d in enumerate(days)], "t long, seq long")
    edges = lambda every: [r.edge for r in resample.window_edges(df, every, []).orderBy("seq").collect()]
    assert edges("mo") == [at(2024, 2, 1), at(2024, 3, 1), at(2024, 3, 1), at(2024, 4, 1), at(2025, 1, 1)]
    assert edges("2mo") == [at(2024, 3, 1)] * 3 + [at(2024, 5, 1), at(2025, 1, 1)]
    assert edges("y") == [at(2025, 1, 1)] * 5
    assert edges("1d") == [at(2024, 2, 1), at(2024, 2, 29), at(2024, 3, 1), at(2024, 3, 2), at(2025, 1, 1)]
    assert edges("30d")[:3] == [at(2024, 3, 1)] * 3


def test_sql_functions(spark):
    from tickspark import sql

    sql.register(spark)
    sql.views(spark, "/root/testdata/sf0.001")
    got = {tuple(r) for r in spark.sql("SELECT ceil_bucket(t, 600000000000) AS e, instr, max_by(seq, t) FROM quotes GROUP BY 1, 2").collect()}
    from tickspark.sources.ticks import event_quotes

    assert got == {(r.t, r.instr, r.seq) for r in resample.align(event_quotes(spark, "/root/testdata/sf0.001"), "10m").collect()}
    assert spark.sql("SELECT cascade_round(1770149, 2), window_label(5000000001)").first()[:] == (17702, "5.000000001")
    assert generate.mean_of_rate("4/h") == 900


def test_durations_stamps_and_rounding(spark):
    assert timeunits.duration("1.5") == 1_500_000_000 and timeunits.duration("-500ms") == -500_000_000 and timeunits.duration("2w") == 14 * 86400 * 10**9
    with pytest.raises(ValueError):
        timeunits.duration("3 parsecs")
    df = spark.createDataFrame([("5.123",), ("5.12",), ("0.123",), ("7",), ("x",)], ["s"])
    assert [r[0] for r in df.select(timeunits.parse_stamp(F.col("s"))).collect()] == [5_123_000_000, None, None, 7_000_000_000, None]
    # 0.1770149 goes to 0.177015, then 0.17702
    assert spark.range(1).select(decimals.cascade(F.lit(1770149), 2)).first()[0] == 17702
    for k in range(1, 6):
        for y in range(0, 10**k, 7):
            want = y
            for _ in range(k):
                want = (want + 5) // 10
            assert (y + 5 * (10**k - 1) // 9) // 10**k == want


def test_generated_trades(spark):
    got = generate.gentrades(spark, 50, seed=3, streams=2).orderBy("stream", "seq").collect()
    assert len(got) == 100 and {r.side for r in got} == {"CANCEL", "LONG", "SHORT"}
    assert all(a.stream != b.stream or (b.t >= a.t and b.side != a.side) for a, b in zip(got, got[1:], strict=False))


def test_generated_trades_over_slices(spark):
    """Equal to a walk from trade to trade, for any cut, with states that differ in all rates, and with a stream of a null name."""
    means, onward = (5.0, 60.0, 0.5), (0.9, 0.2, 0.5)
    drawn = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3 > 1).alias("stream"), (F.col("id") * 7 % 900).alias("id"))
    dice = drawn.select("stream", "id", (-F.log(1 - generate.draw(4, "wait"))).alias("w"), generate.draw(4, "turn").alias("v")).collect()
    want, held = set(), {}
    for r in sorted(dice, key=lambda r: r.id):
        state, t = held.get(r.stream, (0, 0))
        want.add((r.stream, r.id, t, generate.STATES[state]))
        held[r.stream] = (state + (1 if r.v < onward[state] else 2)) % 3, t + int(r.w * means[state] * 1000) * 10**6
    for rows in (10**6, 100, 7):
        got = [tuple(r) for r in generate.trades(drawn, means, onward, seed=4, rows=rows).collect()]
        assert len(got) == len(want) and set(got) == want
    assert generate.trades(drawn.limit(0)).count() == 0


def test_files_and_flat_forms(spark, tmp_path):
    q = some_quotes(spark)
    profile = smooth.sea_profile(q, "adev", "1h", "10m", by=["instr"])
    ticks.write_profile(profile, str(tmp_path / "p"), "adev", 3600 * 10**9, 600 * 10**9)
    back, mode, modulus, width = ticks.read_profile(spark, str(tmp_path / "p"))
    assert (mode, modulus, width) == ("adev", 3600 * 10**9, 600 * 10**9)
    for got, want in zip(sorted(back.collect()), sorted(profile.collect()), strict=True):
        assert tuple(got) == pytest.approx(tuple(want))
    (tmp_path / "s").write_text("5.123\nx\n7\n")
    assert [r.t for r in ticks.read_stamps(spark, str(tmp_path / "s")).orderBy("t").collect()] == [5_123_000_000, 7_000_000_000]
    shocks = q.where("seq % 100 = 5").select("t", "seq")
    ticks.write_chunks(combine.xevent(q, shocks, "60", "60", start=3), str(tmp_path / "c"))
    assert {r.chunk for r in spark.read.parquet(str(tmp_path / "c")).select("chunk").distinct().collect()} == {3, 4, 5}
    ticks.write_tsv(q, str(tmp_path / "t"), "t", "instr", "bid", "ask", "bsz", "asz")
    again = ticks.read_quotes(spark, str(tmp_path / "t")).select("t", "bid", "ask")
    assert sorted((r.t, float(r.bid)) for r in again.collect()) == sorted((r.t, float(r.bid)) for r in q.collect())
    hist = resample.loghist(q, "bid")
    full = resample.all_bins(hist, bins.octave_edges(5, 10)).orderBy("bin").collect()
    assert len(full) == 10 and sum(r["cnt"] for r in full) == q.count()
    assert all(f.lo <= h.lo and h.hi < f.hi for h in hist.collect() for f in full if f.bin == h.bin)
    windows = events.evt_erlagg(q.where("seq % 40 = 0"), "60", empty=True).collect()
    assert any(r.n is None for r in windows) and sum(r.n or 0 for r in windows) == q.where("seq % 40 = 0").count() - 1


def test_dense_arrays_at_the_finest_resolution(spark):
    q = some_quotes(spark, 80)
    hist = resample.quodist(q, None, res=5)
    dense = resample.to_arrays(hist, 1 << bins.BITS[5])
    got = dense.select("instr", "dimen", "metric", F.size("v").alias("size"), F.filter(F.transform("v", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"].isNotNull() & (e["x"] != 0)).alias("held")).collect()
    want = {}
    for r in hist.collect():
        for metric, x in (("n", r["cnt"]), ("L", r.lo), ("H", r.hi)):
            if x:
                want.setdefault((r.instr, r.dimen, metric), []).append((r.bin, float(x)))
    assert {r.size for r in got} == {1 << 21} and len(got) == 2 * 9 * 3
    assert {(r.instr, r.dimen, r.metric): [tuple(e) for e in r.held] for r in got if r.held} == {k: sorted(v) for k, v in want.items()}
    assert resample.to_arrays(hist.limit(0), 8).count() == 0


def test_flat_report(spark):
    rows = [(i, i, "x", b, t, 0, 0) for i, (b, t) in enumerate([(1, -5), (0, 2), (-1, 7), (0, 1)])]
    acc = spark.createDataFrame(rows, "t long, seq long, instr string, base long, term long, comb long, comt long").selectExpr("t", "seq", "instr", *(f"cast({c} as decimal(28,7)) as {c}" for c in ("base", "term", "comb", "comt")))
    flat = {r.key: r.value for r in accounts.accsum_table(accounts.accsum_report(acc)).collect()}
    assert (flat["L rpnl"], flat["S rpnl"], flat["L+S hits"], flat["L+S cnt_FL"]) == (2, -1, 1, 1)


def test_empty_tables(spark):
    q = some_quotes(spark).limit(0)
    for df in (resample.align(q, "1m"), resample.candle(q, "1m"), resample.quodist(q, "1m"), folds.qq(q, "1"), folds.opt(q), smooth.sma(q), smooth.rolling(q, "1m")):
        assert df.count() == 0


def test_table_functions(spark):
    from tickspark import sql

    some_quotes(spark).createOrReplaceTempView("quotes")
    sql.tables(spark)
    every = 600 * 10**9
    aligned = resample.align(some_quotes(spark), "10m")
    assert sorted(map(tuple, spark.sql(f"SELECT * FROM align_quotes({every})").select(*aligned.columns).collect())) == sorted(map(tuple, aligned.collect()))
    assert spark.sql("SELECT * FROM mid_quotes()").count() == some_quotes(spark).count()


def test_windows_are_no_sliding_frames(spark):
    q = some_quotes(spark, 40)
    for df in (smooth.sma(q, "1h"), smooth.rolling(q, "1h")):
        # a frame that begins a number of nanoseconds back is summed up anew for each row
        assert "rangeframe, -" not in df._jdf.queryExecution().analyzed().toString().lower()
    half = q.withColumn("ask", F.when(F.col("seq") >= 20, F.col("ask")))
    rows = sorted(map(tuple, smooth.sma(half, "5m").select("seq", "sma_ask", "smv_ask").collect()))
    assert all(r[1] is None and r[2] is None for r in rows if r[0] <= 18) and rows[-1][1] is not None


def test_rows_meet_intervals_by_hash(spark):
    q = some_quotes(spark, 40)
    for df in (combine.xevent(q, q.select("t", "seq"), "3m", "1m"), smooth.rolling(q, "1h", by=["instr"])):
        assert re.search(r"ShuffledHashJoin \[[^\]]*_cell", df._jdf.queryExecution().executedPlan().toString())
    # intervals of less than a cell's four parts
    ns = spark.createDataFrame([(t, t) for t in range(10)], "t long, seq long")
    assert {(r.chunk, r.t) for r in combine.xevent(ns, ns, 2, 0).collect()} == {(c, t) for c in range(10) for t in range(max(0, c - 2), c + 1)}
    assert {(r.window_id, r.t) for r in smooth.rolling(ns, 2).collect()} == {(k, t) for k in range(2, 11) for t in (k - 2, k - 1)}


def shuffled_rows(df):
    """Rows that the exchanges of a frame's last run have written."""
    count, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            count += plan.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        else:
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return count


def dense(spark, step, n=400):
    rng, t, rows = random.Random(8), 1_700_000_000 * 10**9, []
    for i in range(n):
        t += step * rng.choice([0, 1, 1, 2]) * 10**9
        rows.append((t + (step * 500 * 10**9 if i > n // 2 else 0), i))
    return rows, spark.createDataFrame(rows, "t long, seq long")


@pytest.mark.parametrize(("step", "before", "after"), [(1, "3m", "1m"), (30, "20s", "45m"), (7, "-1m", "4m"), (7, "4m", "-1m"), (1, "-9s", "4s")])
def test_chunks_grow_and_what_is_shuffled_does_not(spark, step, before, after):
    rows, q = dense(spark, step)
    lo, hi = timeunits.duration(before), timeunits.duration(after)
    found = combine.xevent(q, q, before, after, start=3, mark=True)
    got = sorted((r.chunk, r.t, -1 if r.seq is None else r.seq, r.mark or "") for r in found.collect())
    assert got == sorted([(3 + c, t, s, "") for c, (at, _) in enumerate(rows) for t, s in rows if at - lo <= t <= at + hi] + [(3 + c, at, -1, "SHOCK") for c, (at, _) in enumerate(rows)])
    assert shuffled_rows(found) < 3 * len(rows)
    assert combine.xevent(q, q, before, after).count() == len(got) - len(rows)


@pytest.mark.parametrize(("step", "width"), [(1, "1m"), (7, "5m"), (30, "3h"), (1, 1)])
def test_windows_grow_and_what_is_shuffled_does_not(spark, step, width):
    rows, q = dense(spark, step)
    w, want = timeunits.duration(width), set()
    for j, (t, _) in enumerate(rows):
        members = [r for r in rows[: j + 1] if r[0] > t - w]
        if j + 1 == len(rows) or rows[j + 1][0] - members[0][0] >= w:
            want |= {(j + 1, *m) for m in members}
    found = smooth.rolling(q, width)
    got = [(r.window_id, r.t, r.seq) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert shuffled_rows(found) < 5 * len(rows)
    # two streams, each with numbers of its own
    both = q.crossJoin(spark.createDataFrame([("a",), ("b",)], "instr string"))
    assert {r[0]: r[1] for r in smooth.rolling(both, width, by=["instr"]).groupBy("instr").count().collect()} == {"a": len(want), "b": len(want)}
