"""Constant namespaces, symbol information and ticker names. Most constants are tags that outputs carry along."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barframe.na import col

# The members of each namespace; a member's tag is its name without the prefixes below.
_TAGS = {
    "plot": "style_line style_stepline style_histogram style_cross style_area style_columns style_circles style_linebr style_areabr style_stepline_diamond style_steplinebr",
    "shape": "triangleup triangledown arrowup arrowdown circle cross diamond flag labelup labeldown square xcross",
    "location": "abovebar belowbar top bottom absolute",
    "hline": "style_solid style_dotted style_dashed",
    "position": "top_left top_center top_right middle_left middle_center middle_right bottom_left bottom_center bottom_right",
    "size": "auto tiny small normal large huge",
    "xloc": "bar_index bar_time",
    "yloc": "price abovebar belowbar",
    "extend": "none left right both",
    "format": "inherit price percent volume mintick",
    "text": "align_left align_center align_right align_top align_bottom wrap_auto wrap_none format_bold format_italic format_none",
    "currency": "NONE USD EUR GBP JPY CHF AUD CAD NZD HKD SGD BTC ETH USDT EGP INR KRW MYR NOK PKR PLN RUB SEK TRY ZAR",
    "session": "regular extended",
    "scale": "right left none",
    "order": "ascending descending",
    "display": "none all data_window pane status_line price_scale",
    "backadjustment": "on off inherit",
    "settlement_as_close": "on off inherit",
    "earnings": "actual estimate standardized",
    "dividends": "gross net",
    "splits": "denominator numerator",
    "alert": "freq_all freq_once_per_bar freq_once_per_bar_close",
}
_PREFIXES = ("style_", "freq_", "align_", "wrap_", "format_")


def _tag(member: str) -> str:
    for p in _PREFIXES:
        member = member.removeprefix(p)
    return member


CONSTANTS: dict[str, object] = {f"{space}.{m}": _tag(m) for space, members in _TAGS.items() for m in members.split()}
CONSTANTS |= {"font.family_default": "Default", "font.family_monospace": "Monospace", "currency.NONE": ""}
CONSTANTS |= {f"dayofweek.{d}": i for i, d in enumerate("sunday monday tuesday wednesday thursday friday saturday".split(), 1)}
CONSTANTS |= {"barmerge.lookahead_on": True, "barmerge.lookahead_off": False, "barmerge.gaps_on": True, "barmerge.gaps_off": False}
CONSTANTS |= {f"adjustment.{m}": f"adjustment_{m}" for m in "none splits dividends".split()}


def syminfo(symbol: str, mintick: float = 0.01) -> dict[str, object]:
    """What is known of a symbol without a data service."""
    same = dict.fromkeys(("tickerid", "ticker", "root", "description"), symbol)
    return same | {
        "prefix": "", "currency": "USD", "basecurrency": "USD", "type": "crypto", "mintick": mintick, "minmove": 1, "pricescale": 100, "pointvalue": 1, "timezone": "UTC", "session": "regular", "volumetype": "base",
        "mincontract": 1, "country": "", "employees": 0, "shareholders": 0,
    }


def symbol_prefix(x) -> Column:
    """What stands before the colon, empty without one."""
    x = col(x)
    return F.when(F.contains(x, F.lit(":")), F.substring_index(x, ":", 1)).otherwise(F.lit(""))


def symbol_ticker(x) -> Column:
    """What follows the first colon, all without one."""
    x = col(x)
    return F.when(F.contains(x, F.lit(":")), F.substring(x, F.instr(x, ":") + 1, F.length(x))).otherwise(x)


#: Ticker names of synthetic chart types, and of a symbol on an exchange.
_CHARTS = {"heikinashi": "_HA", "renko": "_RK", "linebreak": "_LB", "kagi": "_KG", "pointfigure": "_PF", "standard": "", "modify": "", "inherit": ""}


def ticker(kind: str, *args: str) -> str:
    return ":".join(args[:2]) if kind == "new" else args[0] + _CHARTS[kind]
