"""Broker rules on engineered bars, with the arithmetic in place."""

import pytest

from barframe.operators.broker import Account, Bar, Pot, Settings


def run(bars, orders, settings=Settings(), account=None):
    """``orders``: bar number -> what the program does there."""
    a = account or Account(settings)
    for i, (o, h, lo, c) in enumerate(bars):
        a.run_bar(Bar(o, h, lo, c, i, i), lambda acc, bar: orders.get(bar.index, lambda _: None)(acc))
    return a


FLAT = (100, 101, 99, 100)


def test_market_orders_fill_at_the_next_open():
    a = run([FLAT, (102, 103, 101, 102), (105, 106, 104, 105), FLAT], {0: lambda a: a.entry("L", 1, 2), 1: lambda a: a.close("L")})
    t = a.ledger[0]
    assert (t["entry_price"], t["exit_price"], t["profit"], t["entry_bar"], t["exit_bar"]) == (102, 105, 6, 1, 2)


def test_commission_and_slippage():
    s = Settings(commission_value=1.0, slippage=10)
    a = run([FLAT, FLAT, (110, 111, 109, 110)], {0: lambda a: a.entry("L", 1, 1), 1: lambda a: a.close("L")}, s)
    t = a.ledger[0]
    assert t["entry_price"] == pytest.approx(100.1) and t["exit_price"] == pytest.approx(109.9)
    assert t["profit"] == pytest.approx(9.8 - 1.001 - 1.099) and a.equity == pytest.approx(1_000_000 + t["profit"])


@pytest.mark.parametrize(
    "order, bar, price",
    [
        ({"limit": 95}, (100, 101, 94, 99), 95), ({"limit": 95}, (94, 96, 93, 95), 94), ({"limit": 95}, (100, 101, 96, 99), None), ({"stop": 105}, (100, 106, 99, 104), 105), ({"stop": 105}, (107, 108, 106, 107), 107),
        ({"stop": 105, "limit": 104}, (100, 106, 99, 104), 104), ({"stop": 105, "limit": 107}, (100, 106, 99, 104), 105), ({"stop": 105, "limit": 90}, (100, 106, 99, 104), None),
    ],
)
def test_resting_buys(order, bar, price):
    a = run([FLAT, bar], {0: lambda a: a.entry("L", 1, 1, **order)})
    assert [x.price for x in a.lots] == ([] if price is None else [price])


def test_a_resubmitted_order_replaces_the_first():
    a = run([FLAT, FLAT, (96, 97, 89, 95)], {0: lambda a: a.entry("L", 1, 1, limit=80), 1: lambda a: a.entry("L", 1, 3, limit=90)})
    assert [(x.qty, x.price) for x in a.lots] == [(3, 90)]


def test_entries_reverse_and_orders_net():
    a = run([FLAT] * 4, {0: lambda a: a.entry("L", 1, 2), 1: lambda a: a.entry("S", -1, 1)})
    assert a.size == -1 and len(a.ledger) == 1
    b = run([FLAT] * 4, {0: lambda a: a.order("x", 1, 2), 1: lambda a: a.order("y", -1, 3)})
    assert b.size == -1 and b.ledger[0]["qty"] == 2
    c = run([FLAT] * 4, {0: lambda a: a.order("x", 1, 2), 1: lambda a: a.order("y", -1, 0.5)})
    assert c.size == 1.5


def test_pyramiding_counts_entries():
    place = {i: lambda a, i=i: a.entry(f"L{i}", 1, 1) for i in range(3)}
    assert run([FLAT] * 5, place).size == 1
    assert run([FLAT] * 5, place, Settings(pyramiding=2)).size == 2


def test_brackets_take_the_nearer_extreme_first():
    enter = {0: lambda a: (a.entry("L", 1, 1), a.exit("x", limit=105, stop=95))}
    # 100 up to 106, then down to 94: the open is nearer the high
    assert run([FLAT, (100, 106, 93, 100)], enter).ledger[0]["exit_price"] == 105
    assert run([FLAT, (100, 107, 94, 100)], enter).ledger[0]["exit_price"] == 95
    assert run([FLAT, FLAT, (90, 91, 89, 90)], enter).ledger[0]["exit_price"] == 90


def test_ticks_from_the_entry_and_quantities():
    a = run([FLAT, FLAT, (100, 104, 99.5, 103), FLAT], {0: lambda a: (a.entry("L", 1, 3), a.exit("x", "L", qty=1, profit=200), a.exit("y", "L", profit=300))})
    assert [(t["qty"], t["exit_price"]) for t in a.ledger] == [(1, 102), (2, 103)] and a.size == 0


def test_trailing_stop():
    bars = [FLAT, FLAT, (100, 110, 99.5, 109), (109, 109.5, 104, 105)]
    a = run(bars, {0: lambda a: (a.entry("L", 1, 1), a.exit("t", trail_points=500, trail_offset=300))})
    # armed at 105, ratcheted to 110 - 3
    assert a.ledger[0]["exit_price"] == pytest.approx(107)


def test_margin_call_closes_four_times_the_uncovered_part():
    s = Settings(initial_capital=1000, margin_long=50)
    a = run([FLAT, FLAT, (100, 100, 60, 60)], {0: lambda a: a.entry("L", 1, 15)}, s)
    # at 60: required 60 * 15 / 2 = 450, equity 1000 - 600 = 400, missing 50 -> 50 / 0.5 / 60 = 1.666 -> 6.664
    assert a.margin_calls == 1 and a.ledger[0]["qty"] == pytest.approx(6.664) and a.ledger[0]["exit_price"] == 60


def test_unaffordable_entries_do_not_fill():
    assert run([FLAT, FLAT], {0: lambda a: a.entry("L", 1, 11)}, Settings(initial_capital=1000)).size == 0


def test_sizing():
    assert run([FLAT, FLAT], {0: lambda a: a.entry("L", 1)}, Settings(qty_type="cash", qty_value=250)).size == 2.5
    assert run([FLAT, FLAT], {0: lambda a: a.entry("L", 1)}, Settings(initial_capital=1000, qty_type="percent_of_equity", qty_value=33)).size == pytest.approx(3.3)


def test_orders_on_close():
    a = run([FLAT, (100, 103, 99, 102)], {1: lambda a: a.entry("L", 1, 1)}, Settings(process_orders_on_close=True))
    assert a.lots[0].price == 102


def test_risk_rules():
    a = Account(Settings())
    a.allow_entry_in(1)
    assert run([FLAT] * 3, {0: lambda a: a.entry("S", -1, 1)}, account=a).size == 0
    b = Account(Settings())
    b.risk("max_position_size", 2)
    assert run([FLAT] * 3, {0: lambda a: a.entry("L", 1, 5)}, account=b).size == 2
    c = Account(Settings())
    c.risk("max_drawdown", 30)
    run([FLAT, FLAT, (100, 100, 60, 60), (60, 61, 59, 60), FLAT, FLAT], {0: lambda a: a.entry("L", 1, 1), 4: lambda a: a.entry("L", 1, 1)}, account=c)
    assert c.size == 0 and c.halted and len(c.ledger) == 1


def test_cancel_keeps_market_orders():
    a = run([FLAT, FLAT], {0: lambda a: (a.entry("m", 1, 1), a.entry("l", 1, 1, limit=100), a.cancel_all())})
    assert [x.id for x in a.lots] == ["m"]


def test_shared_pot_funds_both():
    pot = Pot(150)
    a, b = Account(Settings(), pot), Account(Settings(), pot)
    for i in range(3):
        for acc in (a, b):
            acc.run_bar(Bar(*FLAT, i, i), lambda acc, bar: acc.entry("L", 1, 1) if bar.index == 0 else None)
    assert (a.size, b.size) == (1, 0)


def test_lower_bars_decide_the_order_of_levels():
    a = Account(Settings())
    a.run_bar(Bar(*FLAT, 0, 0), lambda acc, _: (acc.entry("L", 1, 1), acc.exit("x", limit=105, stop=95)))
    lower = [Bar(100, 101, 99, 100), Bar(100, 100, 94, 95), Bar(95, 106, 95, 106)]
    a.run_bar(Bar(100, 106, 94, 106, 1, 1), lambda acc, _: None, lower)
    assert a.ledger[0]["exit_price"] == 95
