"""SQL for DuckDB that gives each query's rows by another road: literal loops as recursive tables, as-of joins, lags."""

Q = """q AS (SELECT epoch_us(ts) * 1000 AS t, event_id AS seq, event_type AS instr, CAST(value AS DECIMAL(18,2)) AS bid,
  CAST(CAST(value AS DECIMAL(18,2)) + (1 + event_id % 4) * 0.01 AS DECIMAL(18,2)) AS ask, 1 + user_id % 7 AS bsz, 1 + event_id % 5 AS asz FROM events)"""
O = f"{Q}, o AS (SELECT *, row_number() OVER (PARTITION BY instr ORDER BY t, seq) AS rn FROM q)"
MIN, HOUR, DAY = 60 * 10**9, 3600 * 10**9, 86400 * 10**9


def _align(every: int, offset: int = 0) -> str:
    return f"""WITH {Q} SELECT ((t - 1 - ({offset})) // {every} + 1) * {every} + ({offset}) AS t, instr, arg_max(seq, t) AS seq, CAST(arg_max(bid, t) AS DOUBLE) AS bid,
  CAST(arg_max(ask, t) AS DOUBLE) AS ask, CAST(arg_max(bsz, t) AS DOUBLE) AS bsz, CAST(arg_max(asz, t) AS DOUBLE) AS asz FROM q GROUP BY 1, 2"""


def _multi(column: str, names: dict[str, str], columns: str) -> str:
    rows = f"r AS (SELECT *, {column} AS src, ((t - 1) // {10 * MIN} + 1) * {10 * MIN} AS e FROM q), g AS (SELECT DISTINCT e FROM r)"
    parts = " ".join(f"ASOF LEFT JOIN (SELECT * FROM r WHERE src = '{n}') {a} ON g.e >= {a}.t" for n, a in names.items())
    cols = ", ".join(f"{'CAST(%s.%s AS DOUBLE)' % (a, c) if c != 'instr' else '%s.%s' % (a, c)} AS {n}_{c}" for n, a in names.items() for c in columns.split())
    return f"WITH {Q}, {rows} SELECT g.e AS t, {cols} FROM g {parts}"


def _windows(every: int | None, by: str = "PARTITION BY instr", src: str = "q") -> str:
    """w: rows with the upper edge of their window, by a literal loop."""
    if every is None:
        return f"w AS (SELECT *, 0 AS edge FROM {src})"
    return f"""n AS (SELECT *, row_number() OVER ({by} ORDER BY t, seq) AS k FROM {src}),
r AS (SELECT *, (t // {every} + 1) * {every} AS edge FROM n WHERE k = 1
  UNION ALL SELECT n.*, CASE WHEN n.t > r.edge THEN (n.t // {every} + 1) * {every} ELSE r.edge END FROM r JOIN n ON n.k = r.k + 1 {"AND n.instr = r.instr" if by else ""}),
w AS (SELECT * FROM r)"""


STAMP = "CAST(edge // 1000000000 AS VARCHAR) || '.' || lpad(CAST(edge % 1000000000 AS VARCHAR), 9, '0')"


def _candle(windows: str, label: str) -> str:
    return f"""WITH RECURSIVE {Q}, {windows},
v AS (SELECT *, t - lag(t) OVER p AS gap, ask - min(bid) OVER b AS up, bid - max(ask) OVER b AS down FROM w
  WINDOW p AS (PARTITION BY instr, edge ORDER BY t, seq), b AS (PARTITION BY instr, edge ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT {label} AS cndl, instr, min(t) AS _1st, max(t) AS last, min(gap) AS mindlt, max(gap) AS maxdlt, CAST(min(ask) AS DOUBLE) AS minask, CAST(max(bid) AS DOUBLE) AS maxbid,
  CAST(min(ask - bid) AS DOUBLE) AS minspr, CAST(max(ask - bid) AS DOUBLE) AS maxspr, CAST(max(bsz) AS DOUBLE) AS maxbsz, CAST(max(asz) AS DOUBLE) AS maxasz,
  CAST(-min(asz - bsz) AS DOUBLE) AS maxbim, CAST(max(asz - bsz) AS DOUBLE) AS maxsim,
  CAST(greatest(coalesce(max(up), 0), 0) AS DOUBLE) AS maxdu, CAST(least(coalesce(min(down), 0), 0) AS DOUBLE) AS maxdd FROM v GROUP BY edge, instr"""


def _ratio(over: str, under: str) -> str:
    """A quotient of seven digits, then one digit dropped at a time, half up, to five decimals."""
    exact = f"CAST((2 * CAST(abs({over}) AS HUGEINT) * 100000000000000 + abs({under})) // (2 * abs({under})) AS BIGINT)"
    return f"""(SELECT sign({over}) * list_reduce(list_prepend((x + CAST(10 ** d AS BIGINT) // 2) // CAST(10 ** d AS BIGINT), range(greatest(9 - d, 0))), lambda a, b: (a + 5) // 10)
  FROM (SELECT x, greatest(len(CAST(x AS VARCHAR)) - 7, 0) AS d FROM (SELECT {exact} AS x)))"""


def _top(x: str, bits: int) -> str:
    return f"CASE WHEN {x} = 0 OR {bits} = 0 THEN 0 WHEN len(bin({x})) >= {bits} THEN {x} >> (len(bin({x})) - {bits}) ELSE {x} << ({bits} - len(bin({x}))) END"


def _relative(x: str, bits: int) -> str:
    if not bits:
        return "0"
    p = 10 ** (bits >> 2)
    return f"least({(1 << bits) - 1}, CASE WHEN {x} < 0 THEN 0 " + " ".join(f"WHEN {x} < {p ** (k + 1)} THEN {x} // {p**k} + {k * (p - 1)}" for k in range(8 if p == 10 else 6)) + f" ELSE {(1 << bits) - 1} END)"


def _quodist(every: int | None, bits: int = 0, elapsed: bool = False, day: bool = False) -> str:
    windows = DAYS if day else _windows(every)
    name = "strftime(make_timestamp((edge // 1000000000 - 1) * 1000000), '%Y-%m-%d')" if day else STAMP if every else "'ALL'"
    signed = lambda x: f"CASE WHEN {x} < 0 THEN (-{_relative(f'abs({x})', bits)} - 1 + {1 << bits}) // 2 ELSE ({_relative(f'abs({x})', bits)} + {1 << bits}) // 2 END" if bits else "0"
    parts = max(1, 1 << (bits - 5)) if bits else 1
    octave = f"CAST(len(bin(g // 1000000000 + 1)) - 1 AS BIGINT)"
    time_bin = f"{octave} * {parts} + ((g // 1000000 - ((1 << {octave}) - 1) * 1000) * {parts}) // ((1 << {octave}) * 1000)" if bits else "0"
    dims = [("t", "g", time_bin, 10**9), ("b", "b", _top("b", bits), 100), ("a", "a", _top("a", bits), 100), ("s", "s", _relative("s", bits), 10**5), ("r", "r", _relative("r", bits), 10**5), ("B", "bq", _top("bq", bits), 10**6), ("A", "aq", _top("aq", bits), 10**6), ("I", "i", signed("i"), 10**5), ("R", "rq", signed("rq"), 10**5)]
    union = " UNION ALL ".join(f"SELECT edge, instr, wt, '{d}' AS dimen, CAST({v} AS BIGINT) AS v, CAST({n} AS BIGINT) AS bin, {u} AS unit FROM z" for d, v, n, u in dims)
    return f"""WITH RECURSIVE {Q}, {windows},
y AS (SELECT instr, edge, coalesce(t - lag(t) OVER (PARTITION BY instr, edge ORDER BY t, seq), 0) AS g, CAST(bid * 100 AS BIGINT) AS b, CAST(ask * 100 AS BIGINT) AS a, bsz * 1000000 AS bq, asz * 1000000 AS aq FROM w),
z AS (SELECT *, {"g" if elapsed else "1"} AS wt, {_ratio("2 * (a - b)", "(a + b)")} AS s, {_ratio("(a - b)", "(a + b + abs(a - b))")} AS r, {_ratio("2 * (aq - bq)", "(bq + aq)")} AS i, {_ratio("(aq - bq)", "(bq + aq + abs(aq - bq))")} AS rq FROM y),
h AS ({union})
SELECT {name} AS cndl, instr, dimen, bin, min(v) / any_value(unit) AS lo, max(v) / any_value(unit) AS hi, CAST(sum(wt) AS BIGINT) AS cnt FROM h GROUP BY edge, instr, dimen, bin"""


DAYS = f"w AS (SELECT *, ((t - 1) // {DAY} + 1) * {DAY} AS edge FROM q)"


def _qq(moves: str, first: str, mid: bool, repeat: bool = False) -> str:
    m = "CASE WHEN {m} THEN (o.bid + o.ask) / 2.0 ELSE r.mid END".format(m=moves) if mid else "0.0"
    return f"""WITH RECURSIVE {O},
r AS (SELECT instr, rn, t, seq, CAST(bsz AS DOUBLE) AS bsz, CAST(asz AS DOUBLE) AS asz, {first} AS m, CASE WHEN {first} THEN bid ELSE 0 END AS bid, CASE WHEN {first} THEN ask ELSE 0 END AS ask, CASE WHEN {first} THEN CAST((bid + ask) / 2.0 AS DOUBLE) ELSE 0.0 END AS mid FROM o WHERE rn = 1
  UNION ALL SELECT o.instr, o.rn, o.t, o.seq, o.bsz, o.asz, {moves}, CASE WHEN {moves} THEN o.bid ELSE r.bid END, CASE WHEN {moves} THEN o.ask ELSE r.ask END, {m}
  FROM r JOIN o ON o.instr = r.instr AND o.rn = r.rn + 1)
SELECT t, seq, instr, CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask, bsz, asz FROM r{"" if repeat else " WHERE m"}"""


_MOVES = "(abs(o.bid - r.bid) > 20 OR abs(o.ask - r.ask) > 20)"
_SIGN = "CASE WHEN {0} < 0 THEN '<' WHEN {0} > 0 THEN '>' ELSE '=' END"


def _pat(absolute: bool) -> str:
    turn = lambda x, by: f"({x} * CASE WHEN {by} = 0 THEN 1 ELSE {by} END)" if absolute else x
    pair = lambda s: f"{_SIGN.format(turn('p' + s, 'p' + s))} || {_SIGN.format(turn('n' + s, 'p' + s))}"
    return f"""WITH {Q}, l AS (SELECT t, seq, instr, sign(bid - lag(bid) OVER p) AS nb, sign(ask - lag(ask) OVER p) AS na FROM q WINDOW p AS (PARTITION BY instr ORDER BY t, seq)),
m AS (SELECT *, lag(nb) OVER p AS pb, lag(na) OVER p AS pa FROM l WINDOW p AS (PARTITION BY instr ORDER BY t, seq))
SELECT t, seq, instr, {pair("b")} AS bid_pattern, {pair("a")} AS ask_pattern FROM m WHERE pb IS NOT NULL AND (pb <> 0 OR pa <> 0)"""


ACC = f"""{Q}, ord AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS d FROM q),
acc AS (SELECT t, seq, instr, sum(d) OVER p AS base, CAST(sum(-d * CASE WHEN d > 0 THEN ask ELSE bid END) OVER p AS DOUBLE) AS term, count(*) OVER p * -0.01 AS comm, sum((ask - bid) / 2.0) OVER p AS sprd FROM ord
  WINDOW p AS (PARTITION BY instr ORDER BY t, seq))"""


def _segments(gross: bool, edge: bool) -> str:
    extra, side = ("sprd", ("b0 - pb", "base - b0")) if gross else ("comm", ("b0", "base"))
    old, new = side if edge else ("b0", "base")
    name = lambda x: f"CASE WHEN {x} > 0 THEN 'L' WHEN {x} < 0 THEN 'S' ELSE 'F' END"
    return f"""{ACC}, k AS (SELECT *, CAST(term + {extra} AS DOUBLE) AS x FROM acc),
l AS (SELECT *, coalesce(lag(base) OVER p, 0) AS b0, coalesce(lag(x) OVER p, 0) AS x0, coalesce(lag(t) OVER p, t) AS since, coalesce(lag(base, 2) OVER p, 0) AS pb FROM k WINDOW p AS (PARTITION BY instr ORDER BY t, seq)),
m AS (SELECT *, (x * b0 - base * x0) / (b0 - base) AS level FROM l),
seg AS (SELECT t, seq, instr, since, {name(old)} AS old, {name(new)} AS new, round(level - coalesce(lag(level) OVER (PARTITION BY instr ORDER BY t, seq), 0), 6) AS rpnl FROM m)"""


def _accsum(gross: bool, edge: bool) -> str:
    return f"""{_segments(gross, edge)}, held AS (SELECT instr, old AS side, count(*) FILTER (rpnl > 0) AS hits, CAST(sum(t - since) AS BIGINT) AS "time", CAST(sum(CAST(rpnl AS DECIMAL(28,6))) AS DOUBLE) AS rpnl, CAST(sum(CAST(greatest(rpnl, 0) AS DECIMAL(28,6))) AS DOUBLE) AS rp, CAST(sum(CAST(least(rpnl, 0) AS DECIMAL(28,6))) AS DOUBLE) AS rl, max(rpnl) AS best, min(rpnl) AS worst FROM seg GROUP BY 1, 2),
ent AS (SELECT instr, new AS side, count(*) AS n FROM seg GROUP BY 1, 2),
stats AS (SELECT instr, side, coalesce(hits, 0) AS hits, coalesce(n, 0) AS "count", coalesce("time", 0) AS "time", round(coalesce(rpnl, 0), 6) AS rpnl, round(coalesce(rp, 0), 6) AS rp, round(coalesce(rl, 0), 6) AS rl, round(best, 6) AS best, round(worst, 6) AS worst, round(coalesce(rpnl, 0) / nullif(n, 0), 6) AS avg FROM held FULL JOIN ent USING (instr, side))"""


_MOVED = ", ".join(f"count(*) FILTER (old = '{a}' AND new = '{b}') AS cnt_{a}{b}, count(*) FILTER (old = '{a}' AND new = '{b}' AND rpnl > 0) AS hit_{a}{b}" for a in "FLS" for b in "FLS")
_ORDERS = f"{Q}, ord AS (SELECT *, CASE WHEN seq % 4 = 1 THEN 'SHORT' ELSE 'LONG' END AS side FROM q WHERE seq % 4 <> 3)"


def _imp(lags: list[int], start: str) -> str:
    return f"""{_ORDERS}, e AS (SELECT ord.*, CASE WHEN side = 'LONG' THEN f.ask ELSE -f.bid END AS entry FROM ord ASOF JOIN q f ON ord.instr = f.instr AND ord.t <= f.t),
p AS (SELECT e.*, lag, {start} + lag AS at FROM e, (SELECT unnest({lags}) AS lag)),
imp AS (SELECT p.t, p.seq, p.instr, CAST(p.lag AS BIGINT) AS lag, CAST(CASE WHEN side = 'LONG' THEN m.bid ELSE -m.ask END - entry AS DOUBLE) AS pnl FROM p ASOF JOIN q m ON p.instr = m.instr AND p.at <= m.t)"""


_LAGS = [0, 10 * MIN, HOUR, 4 * HOUR]
_MID = f"""{Q}, md AS (SELECT *, CAST((bid + ask) / 2.0 AS DOUBLE) AS mid FROM q), ml AS (SELECT *, lag(mid) OVER p AS mid0 FROM md WINDOW p AS (PARTITION BY instr ORDER BY t, seq)),
ch AS (SELECT *, mid - mid0 AS change, (t - lag(t) OVER p) / 1e9 AS dt FROM (SELECT * FROM ml WHERE mid <> mid0) WINDOW p AS (PARTITION BY instr ORDER BY t, seq))"""


def _profile(value: str) -> str:
    return f"""{_MID}, vv AS (SELECT {value} AS v, (t % {DAY} - {HOUR // 2} + {DAY}) AS pos FROM ch), ok AS (SELECT * FROM vv WHERE v IS NOT NULL),
two AS (SELECT (pos // {HOUR}) % 24 AS bin, v * (1 - (pos % {HOUR}) / {HOUR}) AS x FROM ok UNION ALL SELECT (pos // {HOUR} + 1) % 24, v * ((pos % {HOUR}) / {HOUR}) FROM ok),
agg AS (SELECT bin, count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM two GROUP BY bin),
ev AS (SELECT b.bin, n, mean, var FROM (SELECT unnest(range(24)) AS bin) b LEFT JOIN agg USING (bin)),
prof AS (SELECT bin, coalesce(n, 0) AS n, coalesce(mean, 1) AS mean, CASE WHEN n > 1 THEN var ELSE 1 END AS var FROM ev
  UNION ALL SELECT -1, CAST(sum(coalesce(n, 0)) AS BIGINT), avg(coalesce(mean, 0)), var_samp(coalesce(mean, 0)) FROM ev)"""


def _even(x: str, n: str) -> str:
    """x / n as a whole number, halves to the even one."""
    return f"""(CASE WHEN abs(({x}) % {n}) * 2 = {n} THEN 2 * CAST(floor((floor(({x}) / {n}) + 1) / 2) AS BIGINT) ELSE CAST(floor((2 * CAST({x} AS HUGEINT) + {n}) / (2 * {n})) AS BIGINT) END)"""


def _sea(reverse: bool) -> str:
    f = "mean / (al * al)" if reverse else "al * al / mean"
    return f"""WITH {_profile("abs(change)")}, fac AS (SELECT bin, {f} AS f FROM prof, (SELECT mean AS al FROM prof WHERE bin = -1) WHERE bin >= 0)
SELECT t, seq, instr, round_even(base - half, 2) AS bid, round_even(base + half, 2) AS ask FROM (SELECT t, seq, instr,
  sum(CASE WHEN mid0 IS NULL THEN mid ELSE (mid - mid0) * f END) OVER p AS base, last_value(CASE WHEN mid0 IS NULL OR mid <> mid0 THEN CAST(ask - bid AS DOUBLE) / 2 END IGNORE NULLS) OVER p AS half
  FROM ml JOIN fac ON fac.bin = (t % {DAY}) // {HOUR} WINDOW p AS (PARTITION BY instr ORDER BY t, seq ROWS UNBOUNDED PRECEDING))"""


LINES = "l AS (SELECT epoch_us(l_shipdate) * 1000 AS t, l_extendedprice AS v FROM lineitem)"
_GAPS = f"{O}, g AS (SELECT instr, (t - lag(t) OVER (PARTITION BY instr ORDER BY t, seq)) AS gap FROM o{{where}}), hist AS (SELECT instr, CAST(len(bin(gap // 1000000000 + 1)) - 1 AS BIGINT) AS bin, min(gap) / 1e9 AS lo, max(gap) / 1e9 AS hi, count(*) AS cnt FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)"
_SLOTS = f"""{Q}, s AS (SELECT instr, t // {10 * MIN} AS slot, count(*) AS k FROM q GROUP BY 1, 2),
c AS (SELECT instr, k, count(*) AS cnt FROM s GROUP BY 1, 2 UNION ALL SELECT * FROM (SELECT instr, 0, max(slot) - min(slot) + 1 - count(*) AS z FROM s GROUP BY 1) WHERE z > 0)"""

_FITS = f"""{_GAPS.format(where='')}, s AS (SELECT instr, sum(cnt) AS n, sum(cnt * hi) AS every, sum(cnt * hi * 1e9) FILTER (bin > 0) AS su, sum(cnt * (ln(hi * 1e9) - ln(1e9))) FILTER (bin > 0) AS ls, sum(cnt * ln(hi * 1e9)) FILTER (bin > 0) AS sh FROM hist GROUP BY instr),
f AS (SELECT *, ln(su) - ln(n) - ln(1e9) - ls / n AS s FROM s), k AS (SELECT *, (3 - s + sqrt((s - 3) ** 2 + 24 * s)) / (12 * s) AS k FROM f),
fits AS (SELECT 'ALL' AS cndl, instr, CAST(n AS BIGINT) AS n, 1 AS erlang_shape, round(n / every, 12) AS erlang_rate, round(k / sqrt(k / (n * k / su)), 12) AS gamma_shape, round(n / sh, 9) AS lomax_shape FROM k)"""
_ZIP = f"""{_SLOTS}, m AS (SELECT instr, CAST(sum(cnt) AS BIGINT) AS n, sum(k * cnt) / sum(cnt) AS mean, coalesce(sum(cnt) FILTER (k = 0), 0) / sum(cnt) AS z FROM c GROUP BY instr),
r AS (SELECT *, CAST(2 AS DOUBLE) AS rate, 0 AS i FROM m UNION ALL SELECT instr, n, mean, z, mean * (1 - exp(-rate)) / (1 - z), i + 1 FROM r WHERE i < 10)"""

def _arrays(hist: str, by: str, n_bins: int) -> str:
    """The length of dense arrays, how many of their bins are filled and where, from a sparse histogram."""
    keys = f"{by}, " if by else ""
    parts = " UNION ALL ".join(f"SELECT {keys}'{m}' AS metric, {n_bins} AS bins, count(*) AS filled, CAST(sum(bin * CAST(floor(CAST({c} AS DOUBLE) * 100000 + 0.5) AS BIGINT)) AS BIGINT) AS places FROM hist_rows{' GROUP BY ' + by if by else ''}" for m, c in (("n", "cnt"), ("L", "lo"), ("H", "hi")))
    return f"WITH hist_rows AS ({hist}) {parts}"


ORACLES = {
    "align": _align(10 * MIN),
    "align_offset": _align(30 * MIN, -90 * 10**9),
    "align_stamps": f"""WITH {Q}, g AS (SELECT s.t + {30 * 10**9} AS t, f.instr FROM (SELECT t FROM q) s, (SELECT instr, min(t) AS first FROM q GROUP BY 1) f WHERE s.t + {30 * 10**9} >= first)
SELECT g.t, g.instr, CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask, CAST(bsz AS DOUBLE) AS bsz, CAST(asz AS DOUBLE) AS asz FROM g ASOF JOIN q ON g.instr = q.instr AND g.t >= q.t""",
    "align_multi": _multi("instr", {"click": "a", "view": "b"}, "bid ask"),
    "align_files": _multi("'s' || (seq % 2)", {"s0": "a", "s1": "b"}, "instr bid ask"),
    "mid": f"""WITH {Q}, h AS (SELECT *, CAST((bid + ask) * 100 AS BIGINT) - 2 AS lo, CAST((bid + ask) * 100 AS BIGINT) + 2 AS hi FROM q)
SELECT t, seq, instr, sign(lo) * ((abs(lo) + 1) // 2) / 100 AS bid, (hi + 1) // 2 / 100 AS ask, CAST(bsz AS DOUBLE) AS bsz, CAST(asz AS DOUBLE) AS asz FROM h""",
    "mid_widen": f"WITH {Q} SELECT t, seq, instr, CAST(bid - 0.02 AS DOUBLE) AS bid, CAST(ask + 0.02 AS DOUBLE) AS ask, CAST(bsz AS DOUBLE) AS bsz, CAST(asz AS DOUBLE) AS asz FROM q",
    "mid_spread": f"WITH {Q} SELECT t, seq, instr, CAST(bid + ask AS DOUBLE) / 2 AS mid, CAST(ask - bid AS DOUBLE) AS spread, (bsz + asz) / 2 AS qty, CAST(asz - bsz AS DOUBLE) AS imbalance FROM q",
    "despread": f"WITH {Q} SELECT t, seq, instr, CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask, CAST(bsz AS DOUBLE) AS bsz, CAST(asz AS DOUBLE) AS asz FROM q",
    "pat": _pat(False),
    "pat_absolute": _pat(True),
    "qq": _qq(_MOVES, "(abs(bid) > 20 OR abs(ask) > 20)", False),
    "qq_repeat": _qq(_MOVES, "(abs(bid) > 20 OR abs(ask) > 20)", False, repeat=True),
    "qq_latent": _qq("NOT (r.mid BETWEEN o.bid AND o.ask)", "NOT (0 BETWEEN bid AND ask)", True),
    "opt": f"""WITH RECURSIVE {O},
r AS (SELECT instr, rn, bid AS hb, t AS hbt, ask AS la, t AS lat, 0 AS side, FALSE AS es, CAST(0 AS BIGINT) AS est, bid AS esp, FALSE AS el, CAST(0 AS BIGINT) AS elt, ask AS elp FROM o WHERE rn = 1
  UNION ALL SELECT instr, rn, CASE WHEN lg THEN nb ELSE hb1 END, CASE WHEN lg THEN nt ELSE hbt1 END, CASE WHEN lt THEN nask ELSE la1 END, CASE WHEN lt THEN nt ELSE lat1 END, CASE WHEN lg THEN 1 ELSE side1 END, sh, hbt, hb, lg, lat1, la1
  FROM (SELECT *, nask <= la1 AS lt, nask > la1 AND side1 <> 1 AND nb - la1 > 5 AS lg
    FROM (SELECT *, CASE WHEN up THEN nb ELSE hb END AS hb1, CASE WHEN up THEN nt ELSE hbt END AS hbt1, CASE WHEN sh THEN nask ELSE la END AS la1, CASE WHEN sh THEN nt ELSE lat END AS lat1, CASE WHEN sh THEN -1 ELSE side END AS side1
      FROM (SELECT o.instr, o.rn, o.t AS nt, o.bid AS nb, o.ask AS nask, r.hb, r.hbt, r.la, r.lat, r.side, o.bid >= r.hb AS up, o.bid < r.hb AND r.side <> -1 AND r.hb - o.ask > 5 AS sh FROM r JOIN o ON o.instr = r.instr AND o.rn = r.rn + 1))))
SELECT instr, est AS t, 'SHORT' AS side, CAST(esp AS DOUBLE) AS price FROM r WHERE es UNION ALL SELECT instr, elt, 'LONG', CAST(elp AS DOUBLE) FROM r WHERE el
UNION ALL SELECT instr, CASE WHEN side = 1 THEN hbt ELSE lat END, 'CANCEL', CAST(CASE WHEN side = 1 THEN hb ELSE la END AS DOUBLE) FROM (SELECT *, max(rn) OVER (PARTITION BY instr) AS z FROM r) WHERE rn = z AND side <> 0""",
    # market orders only: each is done at the quote that stands when it comes; what is open at the end is closed
    "sex1_market": f"""WITH RECURSIVE {Q}, lq AS (SELECT instr, t, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask FROM q GROUP BY 1, 2), span AS (SELECT instr, max(t) AS hi FROM q GROUP BY 1),
od AS (SELECT instr, t + 60000000 AS t, seq, CASE seq % 4 WHEN 1 THEN -2 WHEN 3 THEN 0 ELSE 2 END AS qty, seq % 4 = 3 AS cancel FROM q),
met AS (SELECT od.instr, od.t, od.seq, od.qty, od.cancel, lq.t AS qt FROM od ASOF JOIN lq ON od.instr = lq.instr AND od.t >= lq.t JOIN span ON span.instr = od.instr WHERE od.t < hi),
a AS MATERIALIZED (SELECT met.instr, met.t, met.qty, met.cancel, met.qt, lq.bid, lq.ask, row_number() OVER (PARTITION BY met.instr ORDER BY met.t, met.seq) AS rn FROM met JOIN lq ON met.instr = lq.instr AND met.qt = lq.t),
r AS (SELECT instr, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS qt, 0 AS qty, CAST(NULL AS DECIMAL(18,2)) AS px, CAST(0 AS DECIMAL(18,2)) AS spread, 0 AS base, CAST(0 AS DECIMAL(18,2)) AS term, CAST(0 AS DECIMAL(18,2)) AS comb, CAST(0 AS DECIMAL(18,2)) AS comt FROM span
  UNION ALL SELECT instr, rn, t, qt, n, px, spread, base + CASE WHEN px IS NULL THEN 0 ELSE n END, CAST(term - CASE WHEN px IS NULL THEN 0 ELSE n * px END AS DECIMAL(18,2)),
    CAST(round(comb - CASE WHEN px IS NULL THEN 0 ELSE abs(n) * 0.001 END, 2) AS DECIMAL(18,2)), CAST(round(comt - CASE WHEN px IS NULL THEN 0 ELSE abs(n * px) * 0.0001 END, 2) AS DECIMAL(18,2))
  FROM (SELECT *, CASE WHEN n > 0 THEN ask WHEN n < 0 THEN bid END AS px, ask - bid AS spread
    FROM (SELECT a.*, r.base, r.term, r.comb, r.comt, CASE WHEN cancel THEN -r.base WHEN a.qty * r.base < 0 THEN a.qty - r.base ELSE a.qty END AS n FROM r JOIN a ON a.instr = r.instr AND a.rn = r.rn + 1))),
z AS (SELECT r.*, lq.t AS lt, lq.bid, lq.ask FROM (SELECT *, max(rn) OVER (PARTITION BY instr) AS last FROM r) r JOIN span USING (instr) JOIN lq ON lq.instr = r.instr AND lq.t = hi WHERE rn = last AND base <> 0),
every AS (SELECT instr, t, qty, px, spread, t - qt AS age, base, term, comb, comt FROM r WHERE rn > 0
  UNION ALL SELECT instr, lt, -base, p, ask - bid, 0, 0, term + base * p, round(comb - abs(base) * 0.001, 2), round(comt - abs(base * p) * 0.0001, 2) FROM (SELECT *, CASE WHEN base > 0 THEN bid ELSE ask END AS p FROM z))
SELECT instr, t, CASE WHEN px IS NULL THEN 'REJ' ELSE 'EXE' END AS verb, CAST(qty AS DOUBLE) AS qty, CAST(px AS DOUBLE) AS px, CAST(spread AS DOUBLE) AS spread, age, CAST(base AS DOUBLE) AS base, CAST(term AS DOUBLE) AS term, CAST(comb AS DOUBLE) AS comb, CAST(comt AS DOUBLE) AS comt FROM every""",
    "gentrades": """WITH RECURSIVE dice AS (SELECT event_type AS stream, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, CAST('0x' || substr(md5('7:wait:' || event_id), 1, 13) AS BIGINT) / (1::BIGINT << 52) AS u, CAST('0x' || substr(md5('7:turn:' || event_id), 1, 13) AS BIGINT) / (1::BIGINT << 52) AS v FROM events),
r AS (SELECT stream, seq, k, CAST(0 AS BIGINT) AS t, 0 AS s, u, v FROM dice WHERE k = 0
  UNION ALL SELECT d.stream, d.seq, d.k, r.t + CAST(floor(-ln(1 - r.u) * 60.0 * 1000) AS BIGINT) * 1000000, (r.s + CASE WHEN r.v < 0.5 THEN 1 ELSE 2 END) % 3, d.u, d.v FROM r JOIN dice d ON d.stream = r.stream AND d.k = r.k + 1)
SELECT stream, seq, t, ['CANCEL', 'LONG', 'SHORT'][s + 1] AS side FROM r""",
    "candle": _candle(_windows(10 * MIN), STAMP),
    "candle_all": _candle(_windows(None), "'ALL'"),
    "candle_day": _candle(DAYS, "strftime(make_timestamp((edge // 1000000000 - 1) * 1000000), '%Y-%m-%d')"),
    "quodist": _quodist(4 * HOUR),
    "quodist_fine": _quodist(None, bits=9),
    "quodist_res1": _quodist(None, bits=5),
    "quodist_res3": _quodist(None, bits=13),
    "quodist_res4": _quodist(None, bits=17),
    "quodist_res5": _quodist(None, bits=21),
    "quodist_time": _quodist(None, elapsed=True),
    "quodist_table": f"""WITH long AS ({_quodist(None, day=True)})
SELECT cndl, instr, dimen, 'n' AS metric, CAST(cnt AS DOUBLE) AS v0 FROM long UNION ALL SELECT cndl, instr, dimen, 'L', lo FROM long UNION ALL SELECT cndl, instr, dimen, 'H', hi FROM long""",
    "evt_erlagg": f"""WITH RECURSIVE {Q}, {_windows(4 * HOUR, "")}, g AS (SELECT edge, (t - lag(t) OVER (ORDER BY t, seq)) / 1e9 AS gap FROM w)
SELECT {STAMP} AS cndl, round(sum(1 / nullif(gap, 0)), 6) AS erlagg, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY edge""",
    "evt_erlang": f"WITH {_GAPS.format(where=' WHERE (rn - 1) % 2 = 0')} SELECT 'ALL' AS cndl, instr, bin, lo, hi, cnt FROM hist",
    "evt_erlang_fit": f"WITH {_FITS} SELECT * FROM fits",
    "evt_erlang_fitted": f"""WITH {_FITS}, d AS (SELECT hist.*, n, exp(ln(erlang_rate) - erlang_rate * hi) AS e, exp(gamma_shape * ln(gamma_shape) + (gamma_shape - 1) * ln(hi) - gamma_shape * hi - lgamma(gamma_shape)) AS g,
  exp(ln(lomax_shape) - (lomax_shape + 1) * ln(1 + hi * 1e9)) AS l FROM (SELECT instr, bin, lo, hi, cnt FROM hist) hist JOIN fits USING (instr) WHERE hi > 0)
SELECT 'ALL' AS cndl, hist.instr, hist.bin, hist.lo, hist.hi, hist.cnt, round(n * e / sum(e) OVER p, 6) AS erlang, round(n * g / sum(g) OVER p, 6) AS gamma, round(n * l / sum(l) OVER p, 6) AS lomax
FROM hist LEFT JOIN d ON d.instr = hist.instr AND d.bin = hist.bin WINDOW p AS (PARTITION BY hist.instr)""",
    "evt_poisson_fitted": f"""WITH RECURSIVE {_ZIP}, z AS (SELECT instr, n, round(rate, 6) AS rate, round(1 - mean / rate, 6) AS extra FROM r WHERE i = 10)
SELECT 'ALL' AS cndl, instr, k, cnt, round(n * CASE WHEN k = 0 THEN extra + (1 - extra) * exp(-rate) ELSE exp(ln(1 - extra) + k * ln(rate) - rate - lgamma(CAST(k + 1 AS DOUBLE))) END, 6) AS zip FROM c JOIN z USING (instr)""",
    "evt_poisson": f"WITH {_SLOTS} SELECT 'ALL' AS cndl, instr, k, cnt FROM c",
    "evt_poisson_fit": f"""WITH RECURSIVE {_ZIP}
SELECT 'ALL' AS cndl, instr, n, round(mean, 6) AS mean, round(rate, 6) AS rate, round(1 - mean / rate, 6) AS extra FROM r WHERE i = 10""",
    "loghist": f"WITH {LINES}, b AS (SELECT v, CAST(len(bin(CAST(floor(v) AS BIGINT) + 1)) - 1 AS BIGINT) AS bin FROM l WHERE v > 0) SELECT bin, min(v) AS lo, max(v) AS hi, count(*) AS cnt FROM b GROUP BY bin",
    "loghist_sums": f"""WITH {O}, g AS (SELECT instr, sum(bid) AS v, count(*) AS k FROM o GROUP BY instr, (rn - 1) // 3)
SELECT instr, CAST(len(bin(CAST(floor(v) AS BIGINT) + 1)) - 1 AS BIGINT) AS bin, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi, count(*) AS cnt FROM g WHERE k = 3 GROUP BY 1, 2""",
    "thours": f"WITH {LINES}, b AS (SELECT ((t - {4 * DAY}) % {7 * DAY} + {7 * DAY}) % {7 * DAY} // {HOUR} AS bin, count(*) AS cnt FROM l GROUP BY 1) SELECT r.bin, coalesce(cnt, 0) AS cnt FROM (SELECT unnest(range(168)) AS bin) r LEFT JOIN b USING (bin)",
    "fra": f"""WITH {Q}, f AS (SELECT t, seq, instr, CAST((1 + seq % 3) * 0.01 AS DECIMAL(18,2)) AS pb, CAST((2 + seq % 3) * 0.01 AS DECIMAL(18,2)) AS pa FROM q)
SELECT f.t, f.seq, 'F' || f.instr AS fwd_id, CAST(bid + pb AS DOUBLE) AS bid, CAST(ask + pa AS DOUBLE) AS ask FROM f ASOF JOIN q ON f.instr = q.instr AND f.t >= q.t""",
    "spread": f"""WITH {Q}, g AS (SELECT t, seq FROM q WHERE instr IN ('click', 'view'))
SELECT g.t, g.seq, '+1click-2view' AS instr, CAST(c.bid - 2 * v.ask AS DOUBLE) AS bid, CAST(c.ask - 2 * v.bid AS DOUBLE) AS ask FROM g ASOF JOIN (SELECT * FROM q WHERE instr = 'click') c ON g.t >= c.t ASOF JOIN (SELECT * FROM q WHERE instr = 'view') v ON g.t >= v.t""",
    "eva": f"""WITH {ACC}, h AS (SELECT *, lead(t) OVER (PARTITION BY instr ORDER BY t, seq) AS until FROM acc),
g AS (SELECT instr, base, term, comm, unnest(range((t + {10 * MIN - 1}) // {10 * MIN}, (until - 1) // {10 * MIN} + 1)) * {10 * MIN} AS t FROM h WHERE base <> 0 AND until IS NOT NULL)
SELECT g.t, g.instr, CAST(CAST(term AS DECIMAL(18,2)) + base * CASE WHEN base > 0 THEN q.bid ELSE q.ask END AS DOUBLE) AS nlv, CAST(comm AS DOUBLE) AS comm FROM g ASOF JOIN q ON g.instr = q.instr AND g.t >= q.t""",
    "imp": f"WITH {_imp(_LAGS, 't')} SELECT * FROM imp",
    "imp_tod": f"WITH {_imp([2 * HOUR, 12 * HOUR], f't - t % {DAY}')} SELECT * FROM imp",
    "imp_summary": f"""WITH {_imp(_LAGS, 't')}, m AS (SELECT lag, count(*) AS n, avg(pnl) AS mean, stddev_samp(pnl) AS sd FROM imp GROUP BY lag),
c AS (SELECT lag, sum((pnl - mean) ** 2) AS m2, sum((pnl - mean) ** 3) AS m3, sum((pnl - mean) ** 4) AS m4 FROM imp JOIN m USING (lag) GROUP BY lag)
SELECT lag, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sqrt(n) * m3 / m2 ** 1.5, 6) AS skew, round(n * m4 / m2 ** 2 - 3, 6) AS kurt FROM m JOIN c USING (lag)""",
    "xevent": f"""WITH {Q}, e AS (SELECT t, row_number() OVER (ORDER BY t, seq) + 4 AS chunk, CASE WHEN seq % 2 = 1 THEN instr ELSE 'SHOCK' END AS mark FROM q)
SELECT e.chunk, q.t, q.seq, q.instr, CAST(q.bid AS DOUBLE) AS bid, CAST(q.ask AS DOUBLE) AS ask, CAST(q.bsz AS DOUBLE) AS bsz, CAST(q.asz AS DOUBLE) AS asz, NULL AS mark FROM e JOIN q ON q.t BETWEEN e.t - {3 * MIN} AND e.t + {MIN}
UNION ALL SELECT chunk, t, NULL, NULL, NULL, NULL, NULL, NULL, mark FROM e""",
    "rolling": f"""WITH {Q}, n AS (SELECT *, row_number() OVER p AS k, lead(t) OVER p AS nxt FROM q WINDOW p AS (PARTITION BY instr ORDER BY t, seq)),
h AS (SELECT a.instr, a.k, a.nxt, min(b.t) AS head FROM n a JOIN n b ON a.instr = b.instr AND b.k <= a.k AND b.t > a.t - {HOUR} GROUP BY 1, 2, 3)
SELECT h.k AS window_id, n.t, n.seq, n.instr, CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask, CAST(bsz AS DOUBLE) AS bsz, CAST(asz AS DOUBLE) AS asz FROM h JOIN n ON n.instr = h.instr AND n.k <= h.k AND n.t >= head WHERE h.nxt IS NULL OR h.nxt - head >= {HOUR}""",
    "sma": f"""WITH {Q}, d AS (SELECT t, seq, instr, CAST((bid - lag(bid) OVER p) * 100 AS BIGINT) AS db, CAST((ask - lag(ask) OVER p) * 100 AS BIGINT) AS da FROM q WINDOW p AS (PARTITION BY instr ORDER BY t, seq)),
s AS (SELECT t, seq, instr, count(*) OVER r AS n, sum(db) OVER r AS sb, sum(db * db) OVER r AS qb, sum(da) OVER r AS sa, sum(da * da) OVER r AS qa FROM d WHERE db IS NOT NULL WINDOW r AS (PARTITION BY instr ORDER BY t RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW))
SELECT t, seq, instr, mb / 100 AS sma_bid, {_even('(qb - mb * mb) * 100', 'n')} / 1000000 AS smv_bid, ma / 100 AS sma_ask, {_even('(qa - ma * ma) * 100', 'n')} / 1000000 AS smv_ask
FROM (SELECT *, {_even('sb', 'n')} AS mb, {_even('sa', 'n')} AS ma FROM s)""",
    "ewma": f"""WITH RECURSIVE {O}, r AS (SELECT instr, rn, t, seq, CAST(1 AS DOUBLE) AS m0, CAST(bid AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2, CAST(ask AS DOUBLE) AS a1, CAST(0 AS DOUBLE) AS a2 FROM o WHERE rn = 1
  UNION ALL SELECT instr, rn, t, seq, m, b, d * b2 + (bid - b / m) ** 2, a, d * a2 + (ask - a / m) ** 2 FROM (SELECT *, d * m0 + 1 AS m, d * b1 + bid AS b, d * a1 + ask AS a
    FROM (SELECT o.instr, o.rn, o.t, o.seq, CAST(o.bid AS DOUBLE) AS bid, CAST(o.ask AS DOUBLE) AS ask, r.m0, r.b1, r.b2, r.a1, r.a2, (1 - ln(2) / 3600) ** ((o.t - r.t) / 1e9) AS d FROM r JOIN o ON o.instr = r.instr AND o.rn = r.rn + 1)))
SELECT t, seq, instr, round(b1 / m0, 6) AS bid_mean, round(sqrt(b2 / m0), 6) AS bid_dev, round(a1 / m0, 6) AS ask_mean, round(sqrt(a2 / m0), 6) AS ask_dev FROM r""",
    "sea_profile": f"WITH {_profile('abs(change)')} SELECT bin, n, round(mean, 6) AS mean, round(var, 6) AS var FROM prof",
    "sea_profile_velo": f"WITH {_profile('abs(change) / dt')} SELECT bin, n, round(mean, 6) AS mean, round(var, 6) AS var FROM prof",
    "sea_apply": _sea(False),
    "sea_reverse": _sea(True),
    "sea_tdlt": f"""WITH {_profile("dt")}, fac AS (SELECT bin, al * al / mean AS f FROM prof, (SELECT mean AS al FROM prof WHERE bin = -1) WHERE bin >= 0)
SELECT t, seq, instr, round(sum(coalesce(dt, 0) * f) OVER (PARTITION BY instr ORDER BY t, seq), 0) AS seasoned FROM ch JOIN fac ON fac.bin = (t % {DAY}) // {HOUR}""",
    "accsum": f"WITH {_accsum(False, False)} SELECT * FROM stats",
    "accsum_gross": f"WITH {_accsum(True, True)} SELECT * FROM stats",
    "accsum_report": f"""WITH {_accsum(False, False)}, b AS (SELECT * EXCLUDE (avg) FROM stats WHERE side <> 'F' UNION ALL BY NAME SELECT instr, 'L+S' AS side, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum("count") AS BIGINT) AS "count", CAST(sum("time") AS BIGINT) AS "time", round(sum(rpnl), 6) AS rpnl, round(sum(rp), 6) AS rp, round(sum(rl), 6) AS rl, max(best) AS best, min(worst) AS worst FROM stats WHERE side <> 'F' GROUP BY instr),
mv AS (SELECT instr, {_MOVED} FROM seg GROUP BY instr)
SELECT b.*, round(rpnl / nullif("count", 0), 6) AS avg, round(hits / nullif("count", 0), 6) AS hit_r, round(rp / nullif(hits, 0), 6) AS hit_sk, round(rl / nullif("count" - hits, 0), 6) AS loss_sk, mv.* EXCLUDE (instr) FROM b JOIN mv USING (instr)""",
    "accrpl": f"WITH {_segments(False, False)} SELECT since - 1000000000 AS t, seq, instr, round(rpnl, 2) AS rpnl, t - since AS exposure FROM seg WHERE old <> 'F'",
}

_ERLANG = f"WITH {_GAPS.format(where='')} SELECT 'ALL' AS cndl, instr, bin, lo, hi, cnt FROM hist"
ORACLES |= {
    "sea_profile_sprd": f"WITH {_profile('abs(change) / (CAST(ask - bid AS DOUBLE) / 2)')} SELECT bin, n, round(mean, 4) AS mean, round(var, 1) AS var FROM prof",
    "quodist_arrays": _arrays(ORACLES["quodist_res3"], "cndl, instr, dimen", 1 << 13),
    "evt_erlang_all": f"""WITH h AS ({_ERLANG}) SELECT 'ALL' AS cndl, g.instr, b.bin, CAST((1::BIGINT << b.bin) - 1 AS DOUBLE) AS lo, CAST((1::BIGINT << (b.bin + 1)) - 1 AS DOUBLE) AS hi, coalesce(cnt, 0) AS cnt
FROM (SELECT DISTINCT instr FROM h) g CROSS JOIN (SELECT CAST(unnest(range(32)) AS BIGINT) AS bin) b LEFT JOIN h ON h.instr = g.instr AND h.bin = b.bin""",
    "evt_erlang_arrays": _arrays(_ERLANG, "cndl, instr", 32),
    "loghist_arrays": _arrays(ORACLES["loghist"], "", 32),
}
