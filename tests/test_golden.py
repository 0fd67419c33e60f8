"""Known results on a minute of quotes, an account and a stream of one-sided quotes."""

import pytest

from tickspark.operators import accounts, execution, folds, resample, transforms
from tickspark.sources import ticks

# A minute of quotes (stamp, instrument, bid, ask, quantities).
TICKS = """\
1461065877.910000000 EURUSD 1.13322 1.13324 1.000000 1.120000
1461065878.416000000 EURUSD 1.13322 1.13324 1.870000 1.370000
1461065879.002000000 EURUSD 1.13323 1.13325 1.100000 2.810000
1461065879.508000000 EURUSD 1.13321 1.13325 4.870000 4.690000
1461065880.014000000 EURUSD 1.13322 1.13325 1.570000 3.120000
1461065880.940000000 EURUSD 1.13322 1.13325 1.570000 3.940000
1461065886.036000000 EURUSD 1.13323 1.13325 1.000000 1.310000
1461065887.708000000 EURUSD 1.13324 1.13326 1.000000 4.310000
1461065888.962000000 EURUSD 1.13323 1.13325 1.000000 2.060000
1461065889.013000000 EURUSD 1.13322 1.13325 5.700000 2.890000
1461065889.519000000 EURUSD 1.13323 1.13325 1.500000 4.310000
1461065889.671000000 EURUSD 1.13325 1.13326 1.000000 2.620000
1461065890.201000000 EURUSD 1.13325 1.13328 4.120000 3.450000
1461065890.719000000 EURUSD 1.13324 1.13327 7.120000 4.120000
1461065892.368000000 EURUSD 1.13325 1.13327 1.500000 4.310000
1461065893.735000000 EURUSD 1.13325 1.13327 1.500000 1.690000
1461065894.281000000 EURUSD 1.13325 1.13328 3.750000 1.120000
1461065895.588000000 EURUSD 1.13327 1.13329 1.000000 3.820000
1461065896.246000000 EURUSD 1.13327 1.13329 1.000000 3.000000
1461065896.847000000 EURUSD 1.13327 1.13329 1.000000 2.620000"""

# An account's rows as they stand in a file, a field between two bars; the first kind of row is to be ignored.
ACCOUNT = """\
1325472618.453000000|EXO||1
1325472618.453000000|ACC||10000.00|-10000.00|0.00|-0.5
1325472621.265000000|EXO||1
1325472621.265000000|ACC||20000.00|-21000.00|0.00|-1
1325491343.180000000|EXO||1
1325491343.180000000|ACC||10000.00|-9500.00|0.00|-1.5
1325491348.936000000|EXO||1
1325491348.936000000|ACC||0.00|500.00|0.00|-2
"""


@pytest.fixture(scope="module")
def quotes(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("q") / "quotes.tsv"
    path.write_text(TICKS.replace(" ", "\t") + "\nno stamp\tEURUSD\t1\t2\n")
    return ticks.read_quotes(spark, str(path)).drop("path").cache()


def offset(t):
    return round(t / 1e9 - 1461065800, 3)


def test_reading_skips_lines_without_a_stamp(quotes):
    assert quotes.count() == 20


def test_align(quotes):
    got = [(offset(r.t), float(r.bid), float(r.ask)) for r in resample.align(quotes, "2").orderBy("t").collect()]
    assert got == [(78, 1.13322, 1.13324), (80, 1.13321, 1.13325), (82, 1.13322, 1.13325), (88, 1.13324, 1.13326), (90, 1.13325, 1.13326), (92, 1.13324, 1.13327), (94, 1.13325, 1.13327), (96, 1.13327, 1.13329), (98, 1.13327, 1.13329)]


def test_align_twice_is_once(quotes):
    once = resample.align(quotes, "2")
    assert {tuple(r) for r in resample.align(once, "2").select("t", "bid", "ask").collect()} == {tuple(r) for r in once.select("t", "bid", "ask").collect()}


@pytest.mark.parametrize(("shift", "first", "n"), [("500ms", 78.5, 10), ("-500ms", 79.5, 8)])
def test_align_offset(quotes, shift, first, n):
    got = resample.align(quotes, "2", shift).orderBy("t").collect()
    assert (offset(got[0].t), len(got)) == (first, n)


def test_align_stamps(spark, quotes):
    stamps = spark.createDataFrame([(1461065879908000000,), (1461065895100000000,), (1461065896900000000,), (1461065800000000000,)], ["t"])
    got = [(offset(r.t), float(r.bid), float(r.bsz)) for r in resample.align_stamps(quotes, stamps).orderBy("t").collect()]
    assert got == [(79.908, 1.13321, 4.87), (95.1, 1.13325, 3.75), (96.9, 1.13327, 1.0)]


def test_candle(quotes):
    got = resample.candle(quotes, "60").orderBy("cndl").collect()
    assert [r.cndl for r in got] == ["1461065880.000000000", "1461065940.000000000"]
    names = ("minask", "maxbid", "minspr", "maxspr", "maxbsz", "maxasz", "maxbim", "maxsim", "maxdu", "maxdd")
    assert [round(float(got[1][c]), 5) for c in names] == [1.13325, 1.13327, 0.00001, 0.00003, 7.12, 4.31, 3.0, 3.31, 0.00007, -0.00004]
    assert [round(float(got[0][c]), 5) for c in names] == [1.13324, 1.13323, 0.00002, 0.00004, 4.87, 4.69, 0.5, 1.71, 0.00003, -0.00004]
    assert (got[1].mindlt, got[1].maxdlt) == (51_000_000, 5_096_000_000)


def test_quodist(quotes):
    got = {(r.cndl[7:10], r.dimen): (r.lo, r.hi, r.cnt) for r in resample.quodist(quotes, "60").collect()}
    assert got["880", "I"] == (-0.30864, 0.87468, 4)
    assert got["880", "R"] == (-0.13369, 0.30427, 4)
    assert got["940", "I"] == (-1.08008, 1.2467, 16)
    assert got["940", "R"] == (-0.35067, 0.38399, 16)
    assert got["940", "s"] == (0.00001, 0.00003, 16)
    assert got["880", "r"] == (0.00001, 0.00002, 4)
    assert got["940", "t"] == (0.0, 5.096, 16)


def test_mid(quotes):
    got = [float(r.bid) for r in transforms.mid(quotes).orderBy("t").limit(6).collect()]
    assert got == [1.13323, 1.13323, 1.13324, 1.13323, 1.13324, 1.13324]


def test_widening_and_despreading_are_undone(quotes):
    rows = sorted((r.t, float(r.bid), float(r.ask), float(r.bsz), float(r.asz)) for r in quotes.collect())
    there = transforms.mid_widen(transforms.mid_widen(quotes, "0.0001"), "-0.0001")
    back = transforms.despread(transforms.mid_spread(quotes))
    for df in (there, back):
        assert sorted((r.t, float(r.bid), float(r.ask), float(r.bsz), float(r.asz)) for r in df.collect()) == rows


def test_qq(quotes):
    assert folds.qq(quotes, "0").count() == 15
    assert [offset(r.t) for r in folds.qq(quotes, "0.00003").orderBy("t").collect()] == [77.91, 90.201]
    assert folds.qq(quotes, "0.00003", repeat=True).count() == 20


def test_opt(quotes):
    assert [(offset(r.t), r.side) for r in folds.opt(quotes).orderBy("t").collect()] == [(78.416, "LONG"), (96.847, "CANCEL")]


def orders(spark, *rows):
    made = [(round(float(t) * 1000) * 10**6, i, side, "EURUSD", *(list(px) + [None] * (3 - len(px)))) for i, (t, side, *px) in enumerate(rows)]
    return spark.createDataFrame(made, "t long, seq long, side string, instr string, limit_px string, target_px string, stop_px string")


def trades(df):
    return [(offset(r.t), r.verb, int(r.qty), None if r.px is None else float(r.px), round(r.age / 1e9, 3), float(r.base), float(r.term)) for r in df.orderBy("t").collect()]


def test_limit_and_target(spark, quotes):
    got = trades(execution.sex1(orders(spark, (1461065878, "LONG", "1.13324", "1.13326")), quotes, qty=10000))
    assert got == [(78.06, "EXE", 10000, 1.13324, 0.15, 10000, -11332.4), (95.588, "EXE", -10000, 1.13327, 0, 0, 0.3)]
    got = trades(execution.sex1(orders(spark, (1461065878, "SHORT", "1.13324", "1.13325")), quotes, qty=10000))
    assert got == [(87.708, "EXE", -10000, 1.13324, 0, -10000, 11332.4), (88.962, "EXE", 10000, 1.13325, 0, 0, -0.1)]


def test_delay_and_close_at_the_end(spark, quotes):
    got = trades(execution.sex1(orders(spark, (1461065880, "SHORT")), quotes, delay="1500ms", qty=10000))
    assert got == [(81.5, "EXE", -10000, 1.13322, 0.56, -10000, 11332.2), (96.847, "EXE", 10000, 1.13329, 0, 0, -0.7)]


def test_quantities(spark, quotes):
    snap = resample.align(quotes, "2")
    flip = (1461065880, "LONG"), (1461065880.5, "SHORT"), (1461065881, "CANCEL")
    got = trades(execution.sex1(orders(spark, *flip), snap, delay="1ms", qty=10000, absqty=True))
    assert [(g[2], g[5], g[6]) for g in got] == [(10000, 10000, -11332.5), (-20000, -10000, 11331.7), (10000, 0, -0.8)]
    same = (1461065880, "LONG"), (1461065880.5, "LONG"), (1461065881, "CANCEL")
    got = trades(execution.sex1(orders(spark, *same), snap, delay="1ms", qty=10000, maxqty=True))
    assert [(g[2], g[5], g[6]) for g in got] == [(10000, 10000, -11332.5), (0, 10000, -11332.5), (-10000, 0, -0.4)]


def test_missing_sides_reject(spark):
    # Bids and asks, a second apart.
    prices = [("6255", "6665"), (None, "6385"), ("6475", "6480"), ("6590", None), ("6305", "6765"), ("6315", "6720"), (None, "6545"), ("6580", None), (None, None), ("6140", "6435"), ("6275", "6630")]
    quotes = spark.createDataFrame([((47 + i) * 10**9, i, "X", b, a) for i, (b, a) in enumerate(prices)], "t long, seq long, instr string, bid string, ask string")
    given = [(47.1, "LONG"), (48.5, "SHORT"), (49.5, "SHORT"), (50.2, "LONG"), (51.2, "LONG"), (53.1, "CANCEL"), (55.1, "CANCEL"), (56.1, "CANCEL")]
    asked = orders(spark, *given).selectExpr("t", "seq", "side", "'X' as instr", "limit_px", "target_px", "stop_px")
    got = [(r.verb, int(r.qty), r.px and float(r.px), float(r.term)) for r in execution.sex1(asked, quotes, delay="0").orderBy("t").collect()]
    assert got == [("EXE", 1, 6665, -6665), ("REJ", -1, None, -6665), ("EXE", -1, 6475, -190), ("REJ", 1, None, -190), ("EXE", 1, 6765, -6955), ("REJ", -1, None, -6955), ("REJ", -1, None, -6955), ("EXE", -1, 6140, -815)]


@pytest.fixture(scope="module")
def account(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("a") / "account.tsv"
    path.write_text(ACCOUNT.replace("|", "\t"))
    return ticks.read_accounts(spark, str(path))[0]


def test_accsum(account):
    got = {r.side: (r.hits, r["count"], r.time, r.rpnl, r.rp, r.rl) for r in accounts.accsum(account).collect()}
    assert got == {"F": (0, 1, 0, 0, 0, 0), "L": (2, 3, 18730483000000, 498, 1998, -1500)}
    got = {r.side: (r.rpnl, r.rp, r.avg) for r in accounts.accsum(account, gross=1).collect()}
    assert got["L"] == (500, 2000, pytest.approx(166.666667))


def test_accsum_edges(account):
    got = {r.side: (r.hits, r["count"], r.time, r.rpnl) for r in accounts.accsum(account, edge=True).collect()}
    assert got["L"] == (2, 2, 18724727000000, 1998)
    assert got["S"] == (0, 2, 5756000000, -1500)


def test_report_and_realised_agree(account):
    report = {r.side: r for r in accounts.accsum_report(account).collect()}
    both = report["L+S"]
    assert (both.hit_r, both.hit_sk, both.loss_sk, both.cnt_FL, both.cnt_LL, both.cnt_LF, both.hit_LL) == (0.666667, 999, -1500, 1, 2, 1, 2)
    assert sum(r.rpnl for r in accounts.accrpl(account).collect()) == 498


# Executions, rejections and the account after each, a field between two bars.
EXECUTED = """\
1482109247.100000000|EXE||1|6665|410|0.100000000
1482109247.100000000|ACC||1.00|-6665.00|-1.00|0.00
1482109248.500000000|REJ||0|0|nan|0.500000000
1482109248.500000000|ACC||1.00|-6665.00|-1.00|0.00
1482109249.500000000|EXE||-1|6475|5|0.500000000
1482109249.500000000|ACC||0.00|-190.00|-2.00|0.00
1482109250.200000000|REJ||0|0|nan|0.200000000
1482109250.200000000|ACC||0.00|-190.00|-2.00|0.00
1482109251.200000000|EXE||1|6765|460|0.200000000
1482109251.200000000|ACC||1.00|-6955.00|-3.00|0.00
1482109253.100000000|REJ||0|0|nan|0.100000000
1482109253.100000000|ACC||1.00|-6955.00|-3.00|0.00
1482109255.100000000|REJ||0|0|nan|0.100000000
1482109255.100000000|ACC||1.00|-6955.00|-3.00|0.00
1482109256.100000000|EXE||-1.00|6140|295|0.100000000
1482109256.100000000|ACC||0.00|-815.00|-4.00|0.00
"""


def test_spreads_of_executions_are_given_back(spark, tmp_path):
    (tmp_path / "account.tsv").write_text(EXECUTED.replace("|", "\t"))
    kept, execs = ticks.read_accounts(spark, str(tmp_path / "account.tsv"))
    got = {r.side: (r.hits, r["count"], r.time, r.rpnl, r.rp, r.rl, r.avg, r.best, r.worst) for r in accounts.accsum(kept, execs, gross=2).collect()}
    assert got["L"] == (1, 2, 7_300_000_000, -230, 17.5, -247.5, -115, 17.5, -247.5)
    assert got["F"][:3] == (0, 2, 1_700_000_000)
    report = {r.side: r for r in accounts.accsum_report(kept, execs, gross=2).collect()}
    assert [(report[s].hit_r, report[s].hit_sk, report[s].loss_sk) for s in ("L", "L+S")] == [(0.5, 17.5, -247.5)] * 2
    assert (report["L"].cnt_FL, report["L"].cnt_LF, report["L"].hit_FL, report["L"].hit_LF) == (2, 2, 0, 1)


def test_one_candle_of_all_quotes(quotes):
    (got,) = resample.candle(resample.align(quotes, "2"), None).collect()
    assert (got.cndl, got.mindlt, got.maxdlt) == ("ALL", 2_000_000_000, 6_000_000_000)
    names = ("minask", "maxbid", "minspr", "maxspr", "maxbsz", "maxasz", "maxbim", "maxsim", "maxdu", "maxdd")
    assert [round(float(got[c]), 5) for c in names] == [1.13324, 1.13327, 0.00001, 0.00004, 7.12, 4.69, 3.0, 3.31, 0.00008, -0.00003]


def test_quodist_of_elapsed_time(quotes):
    got = {r.dimen: (r.cndl, r.lo, r.hi, r.cnt) for r in resample.quodist(quotes, elapsed=True).collect()}
    # known as 0.00001 for r, where a minimum of 0 is forgotten once a larger value follows; here it is the true one
    edges = {"t": (0.0, 5.096), "b": (1.13321, 1.13327), "a": (1.13324, 1.13329), "s": (0.00001, 0.00004), "r": (0.0, 0.00002), "B": (1.0, 7.12), "A": (1.12, 4.69), "I": (-1.08008, 1.2467), "R": (-0.35067, 0.38399)}
    assert got == {d: ("ALL", *e, 18_937_000_000) for d, e in edges.items()}
    first = {r.dimen: (r.lo, r.hi, r.cnt) for r in resample.quodist(quotes, "60", elapsed=True).where("cndl like '%880.%'").collect()}
    assert (first["t"], first["b"], first["A"], first["I"]) == ((0.0, 0.586, 1_598_000_000), (1.13321, 1.13323, 1_598_000_000), (1.12, 4.69, 1_598_000_000), (-0.30864, 0.87468, 1_598_000_000))


def test_quodist_in_detail(quotes):
    got = {}
    for r in resample.quodist(quotes, res=3).collect():
        got.setdefault(r.dimen, set()).add((r.lo, r.hi, r.cnt))
    assert got["b"] == {(1.13321, 1.13327, 20)} and got["a"] == {(1.13324, 1.13327, 15), (1.13328, 1.13329, 5)}
    assert got["s"] == {(0.00001, 0.00001, 1), (0.00002, 0.00002, 12), (0.00003, 0.00003, 6), (0.00004, 0.00004, 1)}
    assert {(hi, n) for _, hi, n in got["r"]} == {(0.0, 1), (0.00001, 18), (0.00002, 1)}
    assert got["B"] == {(x, x, n) for x, n in [(1.1, 1), (4.87, 1), (5.7, 1), (1.5, 3), (1.57, 2), (7.12, 1), (1.87, 1), (3.75, 1), (1.0, 8), (4.12, 1)]}
    assert {(1.31, 2.62, 3), (2.06, 4.12, 2), (4.31, 4.31, 3), (3.94, 3.94, 1)} < got["A"] and sum(n for *_, n in got["A"]) == 20
    assert {(0.11321, 0.11912, 2), (0.89503, 0.89503, 2), (-1.08008, -1.08008, 1), (1.2467, 1.2467, 1)} < got["I"]
    assert {(0.05357, 0.05621, 2), (0.30076, 0.30916, 4), (0.32599, 0.32599, 2), (0.38399, 0.38399, 1)} < got["R"]
    assert {(0.506, 0.506, 4), (5.096, 5.096, 1)} < got["t"] and len(got["t"]) == 17
