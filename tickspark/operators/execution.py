"""Order execution against quotes: each instrument runs through one task with its open orders, account and last quote."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.functions.timeunits import duration
from tickspark.operators.folds import fold

CENT = Decimal("0.01")
FIELDS = "t long, verb string, qty decimal(20,2), px decimal(18,9), spread decimal(18,9), age long, base decimal(38,2), term decimal(38,2), comb decimal(38,2), comt decimal(38,2)"


@dataclass
class Order:
    t: int
    side: str
    qty: Decimal
    limit: Decimal | None = None
    target: Decimal | None = None
    until: int | None = None  # good till then; None: for ever


class Book:
    """Account, last quote and open orders of one instrument."""

    def __init__(self, comb: Decimal, comt: Decimal, absqty: bool, maxqty: bool):
        self.rates, self.absqty, self.maxqty = (comb, comt), absqty, maxqty
        self.quote: tuple[int, Decimal | None, Decimal | None] | None = None
        self.open: list[Order] = []
        self.base = self.term = self.comb = self.comt = Decimal(0)

    def price(self, order: Order, qty: Decimal) -> Decimal | None:
        """What ``qty`` would trade at now: the ask for buying, the bid for selling; null beyond the limit or without a quote."""
        _, bid, ask = self.quote
        px = ask if qty > 0 else bid if qty < 0 else None
        if px is None or order.limit is None:
            return px
        return px if (px <= order.limit if qty > 0 else px >= order.limit) else None

    def book(self, t: int, qty: Decimal, px: Decimal | None) -> tuple:
        """Books a trade (none if px is null) and gives its result row."""
        at, bid, ask = self.quote
        if px is not None:
            cent = lambda x: x.quantize(CENT, ROUND_HALF_UP)
            self.base, self.term = cent(self.base + qty), cent(self.term - qty * px)
            self.comb, self.comt = cent(self.comb - abs(qty) * self.rates[0]), cent(self.comt - abs(qty * px) * self.rates[1])
        spread = None if bid is None or ask is None else ask - bid
        return t, "REJ" if px is None else "EXE", qty, px, spread, t - at, self.base, self.term, self.comb, self.comt

    def match(self, before: int):
        """Tries all open orders that come before a time at the last quote; orders made by fills are tried as well."""
        waiting, i = self.open, 0
        dead: set[int] = set()
        while i < len(waiting):
            order, i = waiting[i], i + 1
            if id(order) in dead or order.t >= before:
                continue
            t = max(order.t, self.quote[0])
            if order.side == "CANCEL":
                dead |= {id(o) for o in waiting if o.t <= order.t}
                qty = -self.base
            else:
                qty = order.qty
            px = self.price(order, qty)
            if px is None and (order.until is None or order.until > t):
                continue
            if px is not None and order.side != "CANCEL":
                if self.absqty and qty * self.base < 0:
                    qty -= self.base
                if self.maxqty and qty == self.base:
                    qty = Decimal(0)
            yield self.book(t, qty, px)
            dead.add(id(order))
            if order.target is not None:
                waiting.append(Order(t, "SHORT" if order.side == "LONG" else "LONG", -qty, order.target))
        self.open = [o for o in waiting if id(o) not in dead]


def sex1(orders: DataFrame, quotes: DataFrame, delay: str | int = "60ms", comb: float | str = 0, comt: float | str = 0, qty: float | str = 1, maxqty: bool = False, absqty: bool = False, retry: str | int = 0, by: list[str] | None = None) -> DataFrame:
    """Executions and rejections with the account after each: an order is tried at the quote that stands when it comes, and,
    with a limit or within ``retry``, at later ones; what is open at the end is closed at the last quote.

    Orders before an instrument's first quote are left out, those after its last one aren't tried. comb and comt are
    commission rates on quantity and value; absqty closes an opposite position too; maxqty forbids adding to an equal one.
    """
    by = ["instr"] if by is None else by
    wait, patience = duration(delay), duration(retry)
    amount = Decimal(str(qty))
    none = lambda kind: F.lit(None).cast(kind)
    price = "decimal(18,9)"
    left = quotes.select(*by, "t", "seq", F.lit(0).alias("rank"), none("string").alias("side"), F.col("bid").cast(price).alias("bid"), F.col("ask").cast(price).alias("ask"), none(price).alias("limit_px"), none(price).alias("target_px"))
    right = orders.select(*by, (F.col("t") + wait).alias("t"), "seq", F.lit(1).alias("rank"), "side", none(price).alias("bid"), none(price).alias("ask"), F.col("limit_px").cast(price).alias("limit_px"), F.col("target_px").cast(price).alias("target_px"))

    def start() -> Book:
        return Book(Decimal(str(comb)), Decimal(str(comt)), absqty, maxqty)

    def step(book: Book, t: int, side, bid, ask, limit, target):
        if side is not None:
            if book.quote is not None:
                book.open.append(Order(t, side, amount if side == "LONG" else -amount, limit, target, None if limit is not None else t + patience))
            return
        if book.quote is not None:
            yield from book.match(t)
        book.quote = (t, bid, ask)

    def finish(book: Book):
        if book.base:
            yield book.book(book.quote[0], -book.base, book.quote[1] if book.base > 0 else book.quote[2])

    merged = left.unionByName(right)
    return fold(merged, by, ["t", "side", "bid", "ask", "limit_px", "target_px"], FIELDS, start, step, finish=finish, order=("t", "rank", "seq"))
