"""The simulated broker: an order-matching state machine, run as one kernel per account.

Orders that a bar's program places fill from the next bar on. Within a bar the price is taken to go from the open to
the nearer extreme, the farther one and the close. A program is a Python callable ``on_bar(account, bar)``; a factory makes one
per symbol, so it may keep state. Lower bars, if given, take the place of a bar's own path.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

TINY = 1e-9


@dataclass(frozen=True)
class Settings:
    initial_capital: float = 1_000_000.0
    qty_type: str = "fixed"  # fixed, cash, percent_of_equity
    qty_value: float = 1.0
    commission_type: str = "percent"  # percent, cash_per_contract, cash_per_order
    commission_value: float = 0.0
    pyramiding: int = 1
    slippage: int = 0
    margin_long: float = 100.0
    margin_short: float = 100.0
    min_qty: float = 0.001
    mintick: float = 0.01
    process_orders_on_close: bool = False


@dataclass(frozen=True)
class Bar:
    open: float
    high: float
    low: float
    close: float
    time: object = None
    index: int = 0
    data: object = None

    def path(self) -> tuple[float, float, float, float]:
        up_first = self.high - self.open < self.open - self.low
        mid = (self.high, self.low) if up_first else (self.low, self.high)
        return (self.open, *mid, self.close)

    def up_first(self) -> bool:
        return self.high - self.open < self.open - self.low


@dataclass
class Order:
    id: str
    side: int  # 1 buy, -1 sell, 0 close
    kind: str  # entry, order, close, close_all
    qty: float | None = None
    limit: float | None = None
    stop: float | None = None
    number: int = 0
    armed: bool = False

    def price_at(self, bar: Bar, market: float, slip: float, held: int) -> float | None:
        """The fill price on a bar's path, None if it does not fill; a gap fills at the open."""
        s = self.side
        if self.limit is None and self.stop is None:
            return market + (s or -held) * slip
        against, favour = (bar.low, bar.high) if s > 0 else (bar.high, bar.low)
        if self.stop is None:
            if s * (self.limit - bar.open) >= 0:
                return bar.open
            return self.limit if s * (self.limit - against) >= 0 else None
        if self.limit is None:
            if s * (bar.open - self.stop) >= 0:
                return bar.open + s * slip
            return self.stop + s * slip if s * (favour - self.stop) >= 0 else None
        before = self.armed
        self.armed = before or s * (favour - self.stop) >= 0
        if not self.armed:
            return None
        at = bar.open if before else s * max(s * bar.open, s * self.stop)
        if s * (self.limit - at) >= 0:
            return at
        return self.limit if s * (self.limit - against) >= 0 else None


@dataclass
class Bracket:
    id: str
    from_entry: str = ""
    qty: float | None = None
    profit: float | None = None
    limit: float | None = None
    loss: float | None = None
    stop: float | None = None
    trail_price: float | None = None
    trail_points: float | None = None
    trail_offset: float | None = None
    upto: int = 0
    done: float = 0.0
    trail: float | None = None


@dataclass
class Lot:
    id: str
    qty: float
    price: float
    bar: Bar
    number: int
    command: bool
    fee: float
    up: float = 0.0
    down: float = 0.0


@dataclass
class Pot:
    """The money that one or several accounts trade with."""

    capital: float
    accounts: list = field(default_factory=list)

    def equity(self) -> float:
        return self.capital + sum(a.realized + a.open_profit(a.mark) for a in self.accounts)

    def others_margin(self, me: Account) -> float:
        return sum(abs(a.size) * a.mark * a.margin() for a in self.accounts if a is not me and a.size)

    def without(self, me: Account) -> float:
        """Equity without the open profit of one account."""
        return self.equity() - me.open_profit(me.mark)


class Account:
    """One symbol's position, orders and ledger."""

    def __init__(self, settings: Settings = Settings(), pot: Pot | None = None):
        self.s, self.pot = settings, pot or Pot(settings.initial_capital)
        self.pot.accounts.append(self)
        self.lots: list[Lot] = []
        self.orders: list[Order] = []
        self.brackets: list[Bracket] = []
        self.ledger: list[dict] = []
        self.curve: list[float] = []
        self.size = self.realized = self.commission_paid = self.mark = 0.0
        self.placed, self.bar = 0, None
        self.margin_calls, self.called = 0, -1
        self.peak = self.valley = self.pot.capital
        self.max_drawdown = self.max_runup = 0.0
        self.max_drawdown_percent = self.max_runup_percent = 0.0
        self.max_held = {0: 0.0, 1: 0.0, -1: 0.0}
        self.entry_name = ""
        # risk rules
        self.allowed = 0
        self.limits: dict[str, float] = {}
        self.halted, self.halted_day, self.day, self.day_fills, self.losing_days = False, None, None, 0, 0
        self.day_start = self.day_peak = self.last_equity = self.pot.capital

    # --- what programs read
    @property
    def position_size(self) -> float:
        return self.size

    @property
    def position_avg_price(self) -> float | None:
        held = sum(x.qty for x in self.lots)
        return sum(x.qty * x.price for x in self.lots) / held if held else None

    @property
    def equity(self) -> float:
        return self.pot.equity()

    @property
    def net_profit(self) -> float:
        return sum(t["profit"] for t in self.ledger)

    def open_profit(self, price: float) -> float:
        return math.copysign(1, self.size) * sum(x.qty * (price - x.price) for x in self.lots) if self.lots else 0.0

    def margin(self) -> float:
        return (self.s.margin_long if self.size > 0 else self.s.margin_short) / 100

    def liquidation_price(self) -> float | None:
        """Where equity equals the margin that the position requires."""
        m, n = self.margin(), self.size
        if not n or (n > 0 and m >= 1):
            return None
        price = (self.pot.without(self) - n * self.position_avg_price) / (abs(n) * m - n)
        return price if price > 0 else None

    def profits(self, sign: int) -> list[float]:
        """Profits of the closed trades that won (1), lost (-1) or came out even (0)."""
        return [t["profit"] for t in self.ledger if (t["profit"] > 0) - (t["profit"] < 0) == sign]

    def read(self, name: str) -> float | int | str | None:
        """A named statistic of the account, see ``READS``."""
        return READS[name](self)

    def trade(self, closed: bool, field: str, number: int) -> float | int | str | None:
        """A field of a closed trade or, one a lot, of an open one; None where there is no such trade or field."""
        if not 0 <= number < len(self.ledger if closed else self.lots):
            return None
        if closed:
            t = self.ledger[number]
            row = {**t, "size": t["dir"] * t["qty"], "entry_bar_index": t["entry_bar"], "exit_bar_index": t["exit_bar"], "cumprofit": t["cum_profit"], "cumulative_profit": t["cum_profit"]}
        else:
            x, side = self.lots[number], 1 if self.size > 0 else -1
            row = {
                "profit": side * (self.mark - x.price) * x.qty, "entry_price": x.price, "entry_bar_index": x.bar.index, "entry_time": x.bar.time, "size": side * x.qty, "qty": x.qty, "entry_id": x.id, "commission": x.fee,
                "max_runup": x.up * x.qty, "max_drawdown": x.down * x.qty,
            }
        base = field.removesuffix("_percent")
        if base != field:
            return of_cost(row[base], row["entry_price"], row["qty"]) if base in ("profit", "max_runup", "max_drawdown") else None
        return row.get(field)

    # --- what programs order
    def _open_for_orders(self) -> bool:
        return not self.halted and (self.halted_day is None or self.halted_day != self.day)

    def _submit(self, order: Order) -> None:
        if not self._open_for_orders():
            return
        self.placed += 1
        order.number = self.placed
        for i, o in enumerate(self.orders):
            if o.id == order.id and o.kind in ("entry", "order"):
                self.orders[i] = order
                return
        self.orders.append(order)

    def entry(self, id: str, side: int, qty: float | None = None, limit: float | None = None, stop: float | None = None, when: bool = True) -> None:
        if when:
            self._submit(Order(id, side, "entry", qty, limit, stop))

    def order(self, id: str, side: int, qty: float | None = None, limit: float | None = None, stop: float | None = None, when: bool = True) -> None:
        if when:
            self._submit(Order(id, side, "order", qty, limit, stop))

    def close(self, id: str, qty: float | None = None, when: bool = True) -> None:
        if when and self._open_for_orders() and any(x.id == id for x in self.lots):
            self.orders.append(Order(id, 0, "close", qty))

    def close_all(self, when: bool = True) -> None:
        if when and self._open_for_orders() and self.size:
            self.orders.append(Order("", 0, "close_all"))

    def exit(self, id: str, from_entry: str = "", when: bool = True, **levels) -> None:
        """A bracket over the entries ordered so far: qty, profit, limit, loss, stop, trail_price, trail_points, trail_offset."""
        if not (when and self._open_for_orders()):
            return
        new = Bracket(id, from_entry, upto=self.placed, **levels)
        for i, b in enumerate(self.brackets):
            if b.id == id:
                new.trail = b.trail
                self.brackets[i] = new
                return
        self.brackets.append(new)

    def cancel(self, id: str) -> None:
        self.orders = [o for o in self.orders if o.id != id or (o.limit is None and o.stop is None)]
        self.brackets = [b for b in self.brackets if b.id != id]

    def cancel_all(self) -> None:
        self.orders = [o for o in self.orders if o.limit is None and o.stop is None]
        self.brackets = []

    def risk(self, rule: str, value: float) -> None:
        """max_position_size, max_cons_loss_days, max_drawdown, max_drawdown_percent, max_intraday_filled_orders, max_intraday_loss, max_intraday_loss_percent; the strictest counts."""
        self.limits[rule] = min(value, self.limits.get(rule, value))

    def allow_entry_in(self, side: int) -> None:
        self.allowed = side

    # --- money
    def commission(self, qty: float, price: float) -> float:
        c, kind = self.s.commission_value, self.s.commission_type
        if c <= 0:
            return 0.0
        return c / 100 * qty * price if kind == "percent" else c * qty if kind == "cash_per_contract" else c

    def default_qty(self, price: float) -> float:
        s = self.s
        if s.qty_type == "fixed":
            return s.qty_value
        money = s.qty_value if s.qty_type == "cash" else s.qty_value / 100 * self.equity
        return self._step(money / price)

    def _step(self, qty: float) -> float:
        return math.floor(qty / self.s.min_qty + TINY) * self.s.min_qty if self.s.min_qty > 0 else qty

    def _affordable(self, side: int, qty: float, price: float) -> bool:
        if not qty > 0 or not math.isfinite(qty):
            return False
        m = (self.s.margin_long if side > 0 else self.s.margin_short) / 100
        if m <= 0:
            return True
        equity = self.pot.without(self) + self.open_profit(price)
        return equity - self.commission(qty, price) >= price * (abs(self.size) + qty) * m + self.pot.others_margin(self) - TINY

    def _open(self, o: Order, qty: float, price: float) -> bool:
        if not self._affordable(o.side, qty, price):
            return False
        fee = self.commission(qty, price)
        if not self.lots:
            self.entry_name = o.id
        self.lots.append(Lot(o.id, qty, price, self.bar, o.number, o.kind == "entry", fee))
        self.size += o.side * qty
        self.realized -= fee
        self.commission_paid += fee
        self._exposure()
        return True

    def _exposure(self) -> None:
        for k, v in ((0, abs(self.size)), (1, self.size), (-1, -self.size)):
            self.max_held[k] = max(self.max_held[k], v)

    def _close_lot(self, lot: Lot, qty: float, price: float, fee: float) -> None:
        side = 1 if self.size > 0 else -1
        own = lot.fee * qty / lot.qty
        lot.fee -= own
        profit = side * (price - lot.price) * qty - fee - own
        self.realized += profit + own  # the entry's fee was paid at the entry
        self.commission_paid += fee
        self.ledger.append({
            "entry_id": lot.id, "dir": side, "qty": qty, "entry_price": lot.price, "exit_price": price, "entry_bar": lot.bar.index, "exit_bar": self.bar.index,
            "entry_time": lot.bar.time, "exit_time": self.bar.time, "profit": profit, "cum_profit": self.realized, "commission": own + fee, "max_runup": lot.up * qty, "max_drawdown": lot.down * qty,
        })
        lot.qty -= qty
        self.lots = [x for x in self.lots if x.qty > TINY]
        self.size = side * sum(x.qty for x in self.lots)
        if not self.lots:
            self.size, self.brackets, self.entry_name = 0.0, [], ""

    def _close(self, price: float, qty: float | None = None, id: str | None = None) -> bool:
        """First in, first out; the exit's fee is shared by quantity."""
        lots = [x for x in self.lots if id is None or x.id == id]
        held = sum(x.qty for x in lots)
        total = held if qty is None else min(qty, held)
        if total <= 0:
            return False
        fee, rest = self.commission(total, price), total
        for lot in lots:
            take = min(lot.qty, rest)
            if take <= 0:
                break
            self._close_lot(lot, take, price, fee * take / total)
            rest -= take
        return True

    # --- matching
    def _execute(self, o: Order, price: float) -> bool:
        if o.side == 0:
            return self._close(price, o.qty, None if o.kind == "close_all" else o.id)
        qty = self.default_qty(price) if o.qty is None else o.qty
        against = self.size * o.side < 0
        if o.kind == "entry" and self.allowed and o.side != self.allowed:
            return against and self._close(price)
        done = False
        if against:
            if o.kind == "entry":
                done = self._close(price)
                qty = self.default_qty(price) if o.qty is None else o.qty
            else:
                part = min(qty, abs(self.size))
                done, qty = self._close(price, part), qty - part
        elif self.size and o.kind == "entry" and sum(x.command for x in self.lots) >= self.s.pyramiding:
            return False
        if o.kind == "entry" and "max_position_size" in self.limits:
            qty = min(qty, self.limits["max_position_size"] - abs(self.size))
        return (qty > 0 and self._open(o, qty, price)) or done

    def _match(self, bar: Bar, market: float, only_market: bool = False) -> None:
        slip, left = self.s.slippage * self.s.mintick, []
        waiting, self.orders = self.orders, []
        for o in waiting:
            held = (self.size > 0) - (self.size < 0)
            resting = o.limit is not None or o.stop is not None
            price = None if only_market and resting else o.price_at(bar, market, slip, held)
            if price is None:
                left.append(o)
            elif self._execute(o, price):
                self.day_fills += 1
        self.orders = left + self.orders

    def _shares(self) -> list[float]:
        """The quantity that each bracket may close: brackets reserve lots in the order of their calls."""
        free = {id(x): x.qty for x in self.lots}
        out = []
        for b in self.brackets:
            want, got = math.inf if b.qty is None else max(0.0, b.qty - b.done), 0.0
            for lot in self.lots:
                if self._covers(b, lot):
                    take = min(free[id(lot)], want - got)
                    free[id(lot)] -= take
                    got += take
            out.append(got)
        return out

    @staticmethod
    def _covers(b: Bracket, lot: Lot) -> bool:
        return (not b.from_entry or lot.id == b.from_entry) and lot.number <= b.upto

    def _exits(self, bar: Bar) -> None:
        tick, slip = self.s.mintick, self.s.slippage * self.s.mintick
        kept = []
        for b, share in zip(list(self.brackets), self._shares()):
            if not self.size:
                break
            side = 1 if self.size > 0 else -1
            for lot in [x for x in self.lots if self._covers(b, x)]:
                if share <= 0 or not self.size:
                    break
                price = self._bracket_price(b, lot, bar, side, tick, slip)
                if price is not None:
                    take = min(lot.qty, share)
                    self._close_lot(lot, take, price, self.commission(take, price))
                    b.done, share, self.day_fills = b.done + take, share - take, self.day_fills + 1
            if self.size and share > 0 and b.trail_offset is not None and (b.trail_points is not None or b.trail_price is not None):
                price = self._trail(b, bar, side, tick)
                lots = [x for x in self.lots if self._covers(b, x)]
                if price is not None and lots:
                    price -= side * slip
                    total = min(share, sum(x.qty for x in lots))
                    fee = self.commission(total, price)
                    for lot in lots:
                        take = min(lot.qty, share)
                        if take > 0:
                            self._close_lot(lot, take, price, fee * take / total)
                            b.done, share, self.day_fills = b.done + take, share - take, self.day_fills + 1
            spent = b.done > 0 and (not any(self._covers(b, x) for x in self.lots) or (b.qty is not None and b.done >= b.qty - TINY))
            if not spent:
                kept.append(b)
        self.brackets = kept if self.size else []

    @staticmethod
    def _bracket_price(b: Bracket, lot: Lot, bar: Bar, side: int, tick: float, slip: float) -> float | None:
        stops = [x for x in (b.stop, None if b.loss is None else lot.price - side * b.loss * tick) if x is not None]
        goals = [x for x in (b.limit, None if b.profit is None else lot.price + side * b.profit * tick) if x is not None]
        # of two levels of a kind the nearer to the price counts
        stop = side * max(side * x for x in stops) if stops else None
        goal = side * min(side * x for x in goals) if goals else None
        worst, best = (bar.low, bar.high) if side > 0 else (bar.high, bar.low)
        if stop is not None and side * (bar.open - stop) <= 0:
            return bar.open - side * slip
        if goal is not None and side * (bar.open - goal) >= 0:
            return bar.open
        hit, won = stop is not None and side * (worst - stop) <= 0, goal is not None and side * (best - goal) >= 0
        stop_first = bar.up_first() if side < 0 else not bar.up_first()
        if hit and (stop_first or not won):
            return stop - side * slip
        return goal if won else None

    def _trail(self, b: Bracket, bar: Bar, side: int, tick: float) -> float | None:
        start = b.trail_price if b.trail_price is not None else self.position_avg_price + side * b.trail_points * tick
        for i, p in enumerate(bar.path()):
            if b.trail is not None and side * (p - b.trail) <= 0:
                return p if i == 0 else b.trail
            level = p - side * b.trail_offset * tick
            if b.trail is None:
                b.trail = level if side * (p - start) >= 0 else None
            else:
                b.trail = side * max(side * b.trail, side * level)
        return None

    # --- marks, margin, risk
    def _ratchet(self, v: float) -> None:
        self.peak, self.valley = max(self.peak, v), min(self.valley, v)
        down, up = self.peak - v, v - self.valley
        self.max_drawdown, self.max_runup = max(self.max_drawdown, down), max(self.max_runup, up)
        if self.peak > 0:
            self.max_drawdown_percent = max(self.max_drawdown_percent, 100 * down / self.peak)
        if self.valley > 0:
            self.max_runup_percent = max(self.max_runup_percent, 100 * up / self.valley)

    def _mark(self, bar: Bar) -> None:
        self.mark = bar.close
        base = self.pot.without(self)
        points = [base + self.open_profit(p) for p in bar.path()] if self.size else [self.equity]
        for v in points:
            for a in self.pot.accounts:
                a._ratchet(v)
        for lot in self.lots:
            up, down = bar.high - lot.price, lot.price - bar.low
            up, down = (up, down) if self.size > 0 else (down, up)
            lot.up, lot.down = max(lot.up, up), max(lot.down, down)
        self._check_risk(points)
        self._margin_call(bar)

    def _margin_call(self, bar: Bar) -> None:
        """At the bar's worst price: four times the uncovered quantity goes, once a bar."""
        m = self.margin() if self.size else 0
        if m <= 0 or self.called == bar.index:
            return
        p = bar.low if self.size > 0 else bar.high
        missing = p * abs(self.size) * m + self.pot.others_margin(self) - self.pot.without(self) - self.open_profit(p)
        if missing <= TINY:
            return
        uncovered = self._step(missing / m / p)
        self._close(p, min(4 * uncovered if uncovered > 0 else 1.0, abs(self.size)))
        self.margin_calls += 1
        self.called = bar.index

    def _halt(self, for_day: bool) -> None:
        if for_day:
            self.halted_day = self.day
        else:
            self.halted = True
        self.orders = [Order("", 0, "close_all")] if self.size else []
        self.brackets = []

    def _roll_day(self, day) -> None:
        if day == self.day:
            return
        if self.day is not None:
            self.losing_days = self.losing_days + 1 if self.last_equity < self.day_start - TINY else 0
            if self.losing_days >= self.limits.get("max_cons_loss_days", math.inf):
                self._halt(False)
        self.day, self.day_fills = day, 0
        self.day_start = self.day_peak = self.last_equity

    def _check_risk(self, points: list[float]) -> None:
        if self.halted:
            return
        g = self.limits.get
        if self.max_drawdown >= g("max_drawdown", math.inf) - TINY or self.max_drawdown_percent >= g("max_drawdown_percent", math.inf) - TINY:
            self._halt(False)
            return
        for v in points:
            self.day_peak = max(self.day_peak, v)
            loss = self.day_start - v
            if self.halted_day != self.day and (loss >= g("max_intraday_loss", math.inf) - TINY or loss >= g("max_intraday_loss_percent", math.inf) / 100 * self.day_peak - TINY):
                self._halt(True)
                return

    def _tick(self, bar: Bar) -> None:
        self._match(bar, bar.open)
        if self.size and self.brackets:
            self._exits(bar)
        if self._open_for_orders() and self.day_fills >= self.limits.get("max_intraday_filled_orders", math.inf):
            self._halt(True)
        self._mark(bar)
        self.last_equity = self.equity

    def run_bar(self, bar: Bar, program: Callable[[Account, Bar], None], lower: list[Bar] | None = None) -> None:
        """One bar: fills of earlier orders, the program, fills at the close where asked."""
        self.bar, self.mark = bar, bar.open
        self._roll_day(getattr(bar.time, "date", lambda: bar.index)())
        for b in lower or [bar]:
            self._tick(replace(b, index=bar.index, time=bar.time))
        self.mark = bar.close
        program(self, bar)
        if self.s.process_orders_on_close:
            flat = Bar(bar.close, bar.close, bar.close, bar.close, bar.time, bar.index)
            self._match(flat, bar.close, only_market=True)
            self.last_equity = self.equity
        self.curve.append(self.equity)


def of_cost(amount: float, price: float, qty: float) -> float:
    """An amount in percent of what a trade cost."""
    cost = abs(price * qty)
    return 100 * amount / cost if cost else 0.0


def _mean(values: list[float]) -> float:
    return sum(values) / len(values) if values else 0.0


def _mean_percent(a: Account, keep: Callable[[float], bool], sign: int = 1) -> float:
    return sign * _mean([of_cost(t["profit"], t["entry_price"], t["qty"]) for t in a.ledger if keep(t["profit"])])


def _of_capital(a: Account, amount: float) -> float:
    return 100 * amount / a.pot.capital if a.pot.capital else 0.0


#: What programs may read of an account.
READS: dict[str, Callable[[Account], object]] = {
    "position_size": lambda a: a.size,
    "position_avg_price": lambda a: a.position_avg_price,
    "position_entry_name": lambda a: a.entry_name,
    "margin_liquidation_price": lambda a: a.liquidation_price(),
    "initial_capital": lambda a: a.pot.capital,
    "account_currency": lambda a: "USD",
    "equity": lambda a: a.equity,
    "netprofit": lambda a: a.net_profit,
    "netprofit_percent": lambda a: _of_capital(a, a.net_profit),
    "openprofit": lambda a: a.open_profit(a.mark),
    "openprofit_percent": lambda a: _of_capital(a, a.open_profit(a.mark)),
    "grossprofit": lambda a: sum(a.profits(1)),
    "grossprofit_percent": lambda a: _of_capital(a, sum(a.profits(1))),
    "grossloss": lambda a: -sum(a.profits(-1)),
    "grossloss_percent": lambda a: _of_capital(a, -sum(a.profits(-1))),
    "closedtrades": lambda a: len(a.ledger),
    "opentrades": lambda a: len(a.lots),
    "wintrades": lambda a: len(a.profits(1)),
    "losstrades": lambda a: len(a.profits(-1)),
    "eventrades": lambda a: len(a.profits(0)),
    "avg_trade": lambda a: _mean([t["profit"] for t in a.ledger]),
    "avg_trade_percent": lambda a: _mean_percent(a, lambda p: True),
    "avg_winning_trade": lambda a: _mean(a.profits(1)),
    "avg_winning_trade_percent": lambda a: _mean_percent(a, lambda p: p > 0),
    "avg_losing_trade": lambda a: -_mean(a.profits(-1)),
    "avg_losing_trade_percent": lambda a: _mean_percent(a, lambda p: p < 0, -1),
    "max_drawdown": lambda a: a.max_drawdown,
    "max_drawdown_percent": lambda a: a.max_drawdown_percent,
    "max_runup": lambda a: a.max_runup,
    "max_runup_percent": lambda a: a.max_runup_percent,
    "max_contracts_held_all": lambda a: a.max_held[0],
    "max_contracts_held_long": lambda a: a.max_held[1],
    "max_contracts_held_short": lambda a: a.max_held[-1],
    "closedtrades.first_index": lambda a: 0 if a.ledger else None,
    "opentrades.capital_held": lambda a: abs(a.size * a.position_avg_price) if a.size else 0.0,
}


LEDGER = "symbol string, entry_id string, dir int, qty double, entry_price double, exit_price double, entry_bar long, exit_bar long, entry_time timestamp_ntz, exit_time timestamp_ntz, profit double, cum_profit double, commission double, max_runup double, max_drawdown double"
Program = Callable[[], Callable[[Account, Bar], None]]


def _bars(rows: pd.DataFrame) -> list[Bar]:
    return [Bar(r.open, r.high, r.low, r.close, r.time, i, r) for i, r in enumerate(rows.itertuples(index=False))]


def _run(rows: pd.DataFrame, program: Program, settings: Settings) -> tuple[Account, pd.DataFrame]:
    rows = rows.sort_values("time", kind="stable")
    account, step = Account(settings), program()
    for bar in _bars(rows):
        got = getattr(bar.data, "lower", None)
        lower = None if got is None or not len(got) else [Bar(x["open"], x["high"], x["low"], x["close"]) for x in got]
        account.run_bar(bar, step, lower)
    return account, rows


def backtest(bars: DataFrame, program: Program, settings: Settings = Settings()) -> DataFrame:
    """The trade ledger of every symbol, each with its own account. A column ``lower`` of bar structs magnifies the bars."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        account, rows = _run(rows, program, settings)
        out = pd.DataFrame(account.ledger, columns=[c.split()[0] for c in LEDGER.split(", ")][1:])
        out.insert(0, "symbol", rows["symbol"].iloc[0])
        return out

    return bars.groupBy("symbol").applyInPandas(kernel, LEDGER)


def equity_curve(bars: DataFrame, program: Program, settings: Settings = Settings()) -> DataFrame:
    """symbol, time, bar_index, equity after every bar."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        account, rows = _run(rows, program, settings)
        return pd.DataFrame({"symbol": rows["symbol"].to_numpy(), "time": rows["time"].to_numpy(), "bar_index": range(len(rows)), "equity": account.curve})

    return bars.groupBy("symbol").applyInPandas(kernel, "symbol string, time timestamp_ntz, bar_index long, equity double")


def summary(bars: DataFrame, program: Program, settings: Settings = Settings()) -> DataFrame:
    """One row of results for every symbol."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        a, rows = _run(rows, program, settings)
        wins, losses = [t["profit"] for t in a.ledger if t["profit"] > 0], [t["profit"] for t in a.ledger if t["profit"] < 0]
        row = [rows["symbol"].iloc[0], len(a.ledger), len(wins), len(losses), sum(wins), -sum(losses), a.net_profit, a.equity, a.position_size, a.commission_paid, a.max_drawdown, a.max_runup, a.max_held[0], a.margin_calls]
        return pd.DataFrame([row], columns=[c.split()[0] for c in SUMMARY.split(", ")])

    return bars.groupBy("symbol").applyInPandas(kernel, SUMMARY)


SUMMARY = "symbol string, closed_trades long, wins long, losses long, gross_profit double, gross_loss double, net_profit double, equity double, position_size double, commission double, max_drawdown double, max_runup double, max_contracts double, margin_calls long"


def shared_portfolio(bars: DataFrame, program: Program, basket: list[str], settings: Settings = Settings()) -> DataFrame:
    """The merged ledger of a basket that trades one pot, symbols in basket order at each time.

    The pot couples all symbols, so this one runs as a single sequential group: its input is the basket's bars only.
    """
    if not basket or len(set(basket)) != len(basket) or settings.initial_capital <= 0:
        raise ValueError("a basket needs distinct symbols and a positive capital")
    if "lower" in bars.columns:
        raise ValueError("a shared pot does not look into finer bars")

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_rank=rows["symbol"].map(basket.index)).sort_values(["time", "_rank"], kind="stable")
        pot = Pot(settings.initial_capital)
        accounts, steps, seen = {s: Account(settings, pot) for s in basket}, {s: program() for s in basket}, dict.fromkeys(basket, 0)
        for r in rows.itertuples(index=False):
            accounts[r.symbol].run_bar(Bar(r.open, r.high, r.low, r.close, r.time, seen[r.symbol], r), steps[r.symbol])
            seen[r.symbol] += 1
        out = [{"symbol": s, **t} for s in basket for t in accounts[s].ledger]
        out.sort(key=lambda t: t["exit_time"])
        return pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])

    return bars.where(bars["symbol"].isin(basket)).groupBy().applyInPandas(kernel, LEDGER)
