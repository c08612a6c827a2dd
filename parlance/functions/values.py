"""Functions of times, numbers, arrays, JSON records, colours and rectangles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = "decimal(20,6)"


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def event_time(s: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with any fraction, as a timestamp without zone; null if it is none."""
    return s.try_cast("timestamp_ntz")


def format_event_time(t: Column) -> Column:
    """The shortest form with a fraction of one digit or more."""
    full = F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.regexp_replace(full, r"(\.[0-9])0+$|(\.[0-9]*?[1-9])0+$", "$1$2")


def offset_time(start: Column, seconds: Column) -> Column:
    """``start`` and a number of seconds, to the nearest microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(seconds.cast("double") * 1e6).cast("long"), start)


def seconds_between(a: Column, b: Column) -> Column:
    """Decimal seconds from ``a`` to ``b`` (timestamps)."""
    return to_seconds(micros(b) - micros(a))


def to_seconds(us: Column) -> Column:
    """A duration in microseconds as decimal seconds."""
    return (us.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast(SECONDS)


def _clock(ms: Column, hours: bool) -> Column:
    size = F.abs(ms)
    sign, minutes = F.when(ms < 0, F.lit("-")).otherwise(F.lit("")), F.floor(size / 60000)
    tail = [F.lpad(F.floor(size / 1000 % 60).cast("long").cast("string"), 2, "0"), F.lit("."), F.lpad((size % 1000).cast("long").cast("string"), 3, "0")]
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("long").cast("string"))).otherwise(c.cast("long").cast("string"))
    head = [two(F.floor(minutes / 60)), F.lit(":"), two(minutes % 60)] if hours else [two(minutes)]
    return F.concat(sign, *head, F.lit(":"), *tail)


def format_hours(ms: Column) -> Column:
    """``HH:mm:ss.SSS`` with a sign if negative."""
    return _clock(ms, True)


def format_minutes(ms: Column) -> Column:
    """``mm:ss.SSS`` with a sign if negative; minutes go on beyond 59."""
    return _clock(ms, False)


def format_secs(seconds: Column) -> Column:
    """Seconds as ``mm:ss.SSS``, milliseconds cut off."""
    return _clock(F.floor(F.round(seconds * 1e6) / 1000).cast("long"), False)


def iso_offset(t: Column, zone: str) -> Column:
    """A local time of ``zone`` in ISO form with its offset from UTC."""
    local = t.cast("timestamp_ntz")
    instant = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    minutes = F.timestamp_diff("MINUTE", instant, local)
    size = F.abs(minutes)
    offset = F.when(minutes == 0, F.lit("Z")).otherwise(F.concat(F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0")))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), offset)


def parse_tod(s: Column) -> Column:
    """``HHmmssSSS`` as milliseconds of the day; null if it is not nine digits."""
    part = lambda at, n: F.substring(s, at, n).cast("long")
    return F.when(s.rlike("^[0-9]{9}$"), ((part(1, 2) * 60 + part(3, 2)) * 60 + part(5, 2)) * 1000 + part(7, 3))


def int_or_null(s: Column) -> Column:
    """An int; null for the text "null" and for what is none."""
    return F.nullif(s, F.lit("null")).try_cast("int")


def record_get(json: Column, path: str) -> Column:
    """A field of a JSON record; ``:`` goes into subfields, a number into a list (from 0)."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(":"))
    return F.get_json_object(json, f"${steps}")


def as_type(c: Column, kind: str) -> Column:
    """``c`` as string, boolean, int, long, float, double or list, null where it cannot be."""
    if kind == "list":
        return F.array(c)
    if kind in ("int", "long"):  # numbers with a fraction are cut
        return c.cast("string").try_cast("double").try_cast("int" if kind == "int" else "bigint")
    if kind == "boolean":
        return F.lower(c.cast("string")).try_cast("boolean")
    return c.cast("string").try_cast(kind)


def record_fields(json: Column) -> Column:
    """Field names of a JSON record, sorted."""
    return F.array_sort(F.json_object_keys(json))


def to_map(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def adjoin(a: Mapping[str, Column], b: Mapping[str, Column], lists: frozenset[str] = frozenset()) -> dict[str, Column | dict]:
    """Record ``b`` merged into ``a``: fields named in ``lists`` are appended, dicts merged in turn, others overwritten where not null."""
    out: dict = dict(a)
    for name, value in b.items():
        old = out.get(name)
        if isinstance(value, Mapping) and isinstance(old, Mapping):
            out[name] = adjoin(old, value, lists)
        elif old is None or isinstance(value, Mapping):
            out[name] = value
        elif name in lists:
            out[name] = F.when(old.isNull(), value).when(value.isNull(), old).otherwise(F.concat(old, value))
        else:
            out[name] = F.coalesce(value, old)
    return out


def merge_records(a: Column, b: Column, depth: int = 8) -> Column:
    """Record ``b`` (VARIANT, of any schema) merged into ``a``: records field by field, lists appended, other values overwritten where ``b`` is not null.

    A field that one side has not is taken from the other; a null or missing side changes nothing. Records
    nested deeper than ``depth`` are overwritten as a whole.
    """
    if not depth:
        return F.when(b.isNull() | F.is_variant_null(b), F.coalesce(a, b)).otherwise(b)
    fields = lambda r: F.try_variant_get(r, "$", "map<string,variant>")
    items = lambda r: F.try_variant_get(r, "$", "array<variant>")

    def one(x: Column) -> Column:
        """``x`` has both sides as maps, as lists and as they are, each worked out once."""
        names = F.array_union(F.map_keys(x["fa"]), F.map_keys(x["fb"]))
        pairs = F.transform(names, lambda n: F.struct(F.try_element_at(x["fa"], n).alias("a"), F.try_element_at(x["fb"], n).alias("b")))
        merged = F.map_from_arrays(names, F.transform(pairs, lambda p: merge_records(p["a"], p["b"], depth - 1)))
        taken = F.when(x["b"].isNull() | F.is_variant_null(x["b"]), F.coalesce(x["a"], x["b"])).when(x["fa"].isNotNull() & x["fb"].isNotNull(), F.to_variant_object(merged))
        return taken.when(x["la"].isNotNull() & x["lb"].isNotNull(), F.to_variant_object(F.concat(x["la"], x["lb"]))).otherwise(x["b"])

    sides = F.struct(a.alias("a"), b.alias("b"), fields(a).alias("fa"), fields(b).alias("fb"), items(a).alias("la"), items(b).alias("lb"))
    return F.get(F.transform(F.array(sides), one), F.lit(0))


def put_all_except_null(a: Mapping[str, Column], b: Mapping[str, Column]) -> dict[str, Column]:
    """All fields of both; ``b`` counts where it is not null."""
    return {k: F.coalesce(b[k], a[k]) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}


def index_map(arr: Column) -> Column:
    """Value to index (from 0); of repeated values the last index."""
    entries = F.array_sort(F.transform(arr, lambda x, i: F.struct(x.alias("k"), i.alias("v"))))
    last = F.transform(F.array(entries), lambda s: F.filter(s, lambda e, i: ~F.get(s, i + 1)["k"].eqNullSafe(e["k"])))[0]
    return F.map_from_entries(last)


def player_roles(pairs: Column) -> Column:
    """Role-player pairs (array of two-element arrays) as a map; a player with two roles is an error."""
    players = F.transform(pairs, lambda p: p[1])
    checked = F.when(F.size(F.array_distinct(players)) == F.size(players), pairs).otherwise(F.raise_error(F.lit("a player has two roles")).cast("array<array<string>>"))
    return F.map_from_entries(F.transform(checked, lambda p: F.struct(p[0].alias("role"), p[1].alias("player"))))


def argb(c: Column) -> tuple[Column, Column, Column, Column]:
    """red, green, blue, alpha (0 to 255) of a packed ARGB int."""
    byte = lambda n: F.shiftrightunsigned(c.cast("int"), n).bitwiseAND(F.lit(255))
    return byte(16), byte(8), byte(0), byte(24)


def rgb_to_hsb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and brightness from 0 to 1; hue and saturation of greys are 0."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    safe = F.when(span > 0, span.cast("double"))
    sixth = F.when(span == 0, F.lit(0.0)).when(r == hi, (g - b) / safe).when(g == hi, 2.0 + (b - r) / safe).otherwise(4.0 + (r - g) / safe) / 6.0
    return F.when(sixth < 0, sixth + 1.0).otherwise(sixth), F.when(hi > 0, span / F.when(hi > 0, hi.cast("double"))).when(hi <= 0, F.lit(0.0)), hi / 255.0


# Rectangles are half-open: x0 <= x < x1, y0 <= y < y1; ``r`` maps these names to columns.
Rect = Mapping[str, Column]


def rect(prefix: str = "", suffix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}{suffix}") for k in ("x0", "x1", "y0", "y1")}


def region_area(r: Rect) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def product(ints: Column) -> Column:
    return F.aggregate(ints, F.lit(1).cast("long"), lambda a, x: a * x)


def intersects(a: Rect, b: Rect) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def subsumes(a: Rect, b: Rect) -> Column:
    """Whether ``b`` lies in ``a``, edges included."""
    return (a["x0"] <= b["x0"]) & (a["x1"] >= b["x1"]) & (a["y0"] <= b["y0"]) & (a["y1"] >= b["y1"])


def centre(r: Rect, rows: Column, cols: Column) -> tuple[Column, Column]:
    """The centre's place in the board's length and width, from 0 to 1."""
    return (r["x0"] + r["x1"]) / 2.0 / rows, (r["y0"] + r["y1"]) / 2.0 / cols


def relative_size(r: Rect, rows: Column, cols: Column) -> Column:
    return region_area(r) / (rows * cols).cast("double")


def entity_features(argb_: Column, place: Column, rows: int, cols: int) -> dict[str, Column]:
    """Size, colour and position of an entity with a packed colour at ``place`` (x0, x1, y0, y1) of a board."""
    box = {s: place[s] for s in ("x0", "x1", "y0", "y1")}
    red, green, blue, alpha = argb(argb_)
    hue, saturation, brightness = rgb_to_hsb(red, green, blue)
    x, y = centre(box, F.lit(rows), F.lit(cols))
    return {"size": relative_size(box, F.lit(rows), F.lit(cols)), "red": red, "green": green, "blue": blue, "alpha": alpha, "hue": hue, "saturation": saturation, "brightness": brightness, "position_x": x, "position_y": y}


def cell_coords(index: Column, cols: Column) -> tuple[Column, Column]:
    """(row, column) of a cell in a flat matrix."""
    return F.floor(index / cols).cast("int"), (index % cols).cast("int")


def matrix_row(cells: Column, cols: Column, row: Column) -> Column:
    return F.slice(cells, row * cols + 1, cols)


def matrix_col(cells: Column, cols: Column, col: Column) -> Column:
    return F.filter(cells, lambda x, i: i % cols == col)


def matrix_block(cells: Column, cols: Column, r: Rect) -> Column:
    """The cells inside a rectangle, row by row."""
    return F.filter(cells, lambda x, i: (F.floor(i / cols) >= r["x0"]) & (F.floor(i / cols) < r["x1"]) & (i % cols >= r["y0"]) & (i % cols < r["y1"]))


def count_subregions(rows: Column, cols: Column, height: Column, width: Column) -> Column:
    """Positions of a rectangle of the given size on a board."""
    return F.greatest(F.lit(0), rows - height + 1) * F.greatest(F.lit(0), cols - width + 1)
