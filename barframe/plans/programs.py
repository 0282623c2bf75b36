"""Bar programs of the registered backtests."""

from __future__ import annotations

from barframe.operators import broker as B


def cross_program():
    """Long between an upward and a downward cross."""

    def on_bar(account: B.Account, bar: B.Bar) -> None:
        account.entry("long", 1, when=bar.data.up)
        account.close("long", when=bar.data.down)

    return on_bar


def bracket_program():
    """Both sides, each with a goal, a stop and a trailing stop."""

    def on_bar(account: B.Account, bar: B.Bar) -> None:
        account.entry("long", 1, when=bar.data.up)
        account.entry("short", -1, when=bar.data.down)
        account.exit("out", profit=4000, loss=2500, trail_points=1500, trail_offset=800)

    return on_bar
