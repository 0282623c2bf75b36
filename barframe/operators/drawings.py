"""Drawing objects as an event log: final state is the last writer of each property, less deletions, less evictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.na import div

EVENTS = "symbol string, seq long, bar long, op string, id long, type string, props map<string,string>"
# How many objects of a type a symbol may keep.
CAPS = {"line": 50, "label": 50, "box": 50, "polyline": 100, "linefill": 50, "table": 50}
#: Setters and the property that each writes; several values are written in the order given.
SETTERS = {
    "line": {"set_xy1": ("x1", "y1"), "set_xy2": ("x2", "y2"), "set_first_point": ("x1", "y1"), "set_second_point": ("x2", "y2"), "set_xloc": ("x1", "x2", "xloc"), **{f"set_{p}": (p,) for p in ("x1", "y1", "x2", "y2", "color", "width", "style", "extend")}},
    "label": {"set_xy": ("x", "y"), "set_point": ("x", "y"), "set_xloc": ("x", "xloc"), **{f"set_{p}": (p,) for p in ("x", "y", "text", "textalign", "tooltip", "text_formatting", "color", "textcolor", "style", "size", "text_font_family", "yloc")}},
    "box": {"set_lefttop": ("left", "top"), "set_rightbottom": ("right", "bottom"), "set_top_left_point": ("left", "top"), "set_bottom_right_point": ("right", "bottom"), "set_xloc": ("left", "right", "xloc"), **{f"set_{p}": (p,) for p in ("left", "top", "right", "bottom", "bgcolor", "border_color", "border_width", "border_style", "extend", "text", "text_color", "text_font_family", "text_size", "text_halign", "text_valign", "text_formatting", "text_wrap")}},
    "polyline": {}, "linefill": {"set_color": ("color",)},
    "table": {"merge_cells": ("merged",), **{f"set_{p}": (p,) for p in ("position", "bgcolor", "border_color", "border_width", "frame_color", "frame_width")}, **{f"cell_set_{p}": (p,) for p in ("text", "tooltip", "text_font_family", "bgcolor", "text_color", "text_size", "text_halign", "text_valign", "text_formatting", "width", "height")}},
}


#: Getters and the property that each reads.
GETTERS = {"line": ("x1", "y1", "x2", "y2"), "label": ("x", "y", "text"), "box": ("left", "top", "right", "bottom"), "polyline": (), "linefill": ("line1", "line2"), "table": ()}


class Log:
    """Collects events inside a kernel and keeps what is there now; ids count from 1 in each log.

    Where a new object exceeds its type's cap, the oldest is deleted for good.
    """

    def __init__(self, symbol: str, caps: dict[str, int] | None = None):
        self.symbol, self.rows, self.next, self.caps = symbol, [], 1, caps or CAPS
        self.objects: dict[int, tuple[str, dict]] = {}

    def _add(self, bar: int, op: str, id: int, kind: str, props: dict) -> None:
        self.rows.append((self.symbol, len(self.rows), bar, op, id, kind, {k: None if v is None else str(v) for k, v in props.items() if v is not None or op == "set"}))

    def new(self, bar: int, kind: str, **props) -> int:
        id, self.next = self.next, self.next + 1
        self._add(bar, "new", id, kind, props)
        self.objects[id] = (kind, {k: v for k, v in props.items() if v is not None})
        held = self.all(kind)
        for old in held[: max(0, len(held) - self.caps[kind])]:
            self.delete(bar, kind, old)
        return id

    def all(self, kind: str) -> list[int]:
        """The ids of a type that are there, the oldest first."""
        return [i for i, (k, _) in self.objects.items() if k == kind]

    def get(self, id: int, prop: str):
        """A property as it was written, na without the object or the property."""
        return self.objects[id][1].get(prop) if id in self.objects else None

    def price(self, id: int, x: float) -> float | None:
        """The height of a line at x, na for an upright line."""
        x1, y1, x2, y2 = (self.get(id, p) for p in ("x1", "y1", "x2", "y2"))
        return None if None in (x1, y1, x2, y2, x) or x1 == x2 else y1 + (y2 - y1) * (x - x1) / (x2 - x1)

    def copy(self, bar: int, kind: str, of: int) -> int | None:
        return self.new(bar, kind, **self.objects[of][1]) if of in self.objects else None

    def write(self, bar: int, kind: str, id: int, props: dict) -> None:
        """Properties of an object that is there; None takes one away."""
        if id in self.objects:
            self._add(bar, "set", id, kind, props)
            self.objects[id][1].update(props)

    def set(self, bar: int, kind: str, setter: str, id: int, *values, cell: tuple[int, int] | None = None) -> None:
        at = f"cell:{cell[0]}:{cell[1]}:" if cell else ""
        self.write(bar, kind, id, {at + n: v for n, v in zip(SETTERS[kind][setter], values)})

    def cell(self, bar: int, id: int, column: int, row: int, **props) -> None:
        """Defines a cell anew: what it had before is gone."""
        self.clear(bar, id, column, row)
        self.write(bar, "table", id, {f"cell:{column}:{row}:{k}": v for k, v in props.items() if v is not None})

    def clear(self, bar: int, id: int, column: int, row: int, end_column: int | None = None, end_row: int | None = None) -> None:
        """Takes the cells of a region away, both ends included."""
        columns, rows = range(column, (column if end_column is None else end_column) + 1), range(row, (row if end_row is None else end_row) + 1)
        gone = {k: None for k in self.objects.get(id, ("", {}))[1] if k.startswith("cell:") and int(k.split(":")[1]) in columns and int(k.split(":")[2]) in rows}
        if gone:
            self.write(bar, "table", id, gone)

    def delete(self, bar: int, kind: str, id: int) -> None:
        self._add(bar, "delete", id, kind, {})
        self.objects.pop(id, None)


def final_state(events: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """symbol, type, id, props of the objects that are left: the newest of each type up to its cap."""
    gone = events.where(F.col("op") == "delete").select("symbol", "id").distinct()
    kept = events.where(F.col("op") != "delete").join(gone, ["symbol", "id"], "left_anti")
    w = Window.partitionBy("symbol", "type").orderBy(F.desc("id"))
    cap = F.create_map(*[x for t, n in caps.items() for x in (F.lit(t), F.lit(n))])
    alive = kept.where(F.col("op") == "new").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap[F.col("type")]).select("symbol", "id")
    last = kept.join(alive, ["symbol", "id"]).select("symbol", "type", "id", "seq", F.explode("props").alias("k", "v")).groupBy("symbol", "type", "id", "k").agg(F.max_by("v", "seq").alias("v")).where("v IS NOT NULL")
    props = last.groupBy("symbol", "type", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return alive.join(kept.where(F.col("op") == "new").select("symbol", "id", "type"), ["symbol", "id"]).join(props, ["symbol", "type", "id"], "left").select("symbol", "type", "id", "props")


def line_price(x1: Column, y1: Column, x2: Column, y2: Column, x: Column) -> Column:
    """The straight line through two points at x."""
    return y1 + div((y2 - y1) * (x - x1), x2 - x1)
