"""Boards and rectangles: bounding boxes, intersections, free places.

Rectangles are half-open (x0, x1, y0, y1), x along rows, in a ``game``. Joins of rectangles are
equi-joins on the game and on the cells of grids, one for each order of size, with the exact condition
on top; a pair is taken in the first cell that both touch, so it comes once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.values import cell_coords, intersects, rect, subsumes

SIDES = ("x0", "x1", "y0", "y1")


def cells(boards: DataFrame, game: str, occupants: str, cols: str) -> DataFrame:
    """(game, index, row, col, element) of flat matrices; null and "null" cells are empty."""
    long = boards.select(game, cols, F.posexplode(occupants).alias("index", "element"))
    row, col = cell_coords(F.col("index"), F.col(cols))
    return long.select(game, "index", row.alias("row"), col.alias("col"), F.nullif("element", F.lit("null")).alias("element"))


def element_regions(cells_: DataFrame, game: str = "game") -> DataFrame:
    """The bounding box of each element."""
    return cells_.where("element is not null").groupBy(game, "element").agg(F.min("row").alias("x0"), (F.max("row") + 1).alias("x1"), F.min("col").alias("y0"), (F.max("col") + 1).alias("y1"))


def occupancy(cells_: DataFrame, game: str = "game") -> DataFrame:
    """Occupied cells, their share and the number of elements."""
    return cells_.groupBy(game).agg(F.count("element").alias("occupied"), (F.count("element") / F.count("*")).alias("ratio"), F.count_distinct("element").alias("elements"))


#: cells of a level are so many times those of the level below
STEP = 4


def level_of(length: Column, unit: int, most: int = 31) -> Column:
    """The least level whose cells, of ``unit`` times STEP to the level, are as long as ``length`` or longer; then it touches at most two in a row."""
    sizes = [unit * STEP**i for i in range(most)]
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in sizes]), lambda x: x < length))


def levels_in(df: DataFrame, level: Column) -> list[int]:
    """The levels that occur, at most 32."""
    return sorted(r[0] for r in df.select(level.alias("_l")).where("_l is not null").distinct().collect())


def _cells(r: dict, level: Column, unit: int) -> dict[str, Column]:
    """First and last cell of a rectangle on both axes of a level."""
    size = F.lit(float(unit)) * F.pow(F.lit(float(STEP)), level)
    return {"x": F.floor(r["x0"] / size), "xx": F.floor((r["x1"] - 1) / size), "y": F.floor(r["y0"] / size), "yy": F.floor((r["y1"] - 1) / size)}


def _spread(df: DataFrame, level: Column, unit: int, suffix: str) -> DataFrame:
    """Rows once for each cell of ``level`` (a level, or an array of levels) that they touch: ``_l``, ``_x``, ``_y``."""
    df = df.withColumn("_l", level)
    c = _cells(rect(suffix=suffix), F.col("_l"), unit)
    return df.withColumn("_x", F.explode(F.sequence(c["x"], c["xx"]))).withColumn("_y", F.explode(F.sequence(c["y"], c["yy"])))


def region_join(a: DataFrame, b: DataFrame, condition: Callable[[dict, dict], Column], game: str = "game", grid: int = 8) -> DataFrame:
    """Pairs of rectangles of a game that satisfy ``condition`` (which must imply that they intersect); columns of ``a`` end in ``_a``, those of ``b`` in ``_b``.

    A rectangle stands in the at most four cells that it touches on the level of its size, the least
    level having cells of ``grid``; the other side looks there and on the levels above its own that occur. So a
    rectangle of any size takes a few cells, and a pair is found on the level of its larger one.
    """
    left = a.select(game, *[F.col(c).alias(f"{c}_a") for c in a.columns if c != game])
    right = b.select(game, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != game])
    real = lambda s: (F.col(f"x0{s}") < F.col(f"x1{s}")) & (F.col(f"y0{s}") < F.col(f"y1{s}"))
    left, right = left.where(real("_a")), right.where(real("_b"))
    own = lambda s: level_of(F.greatest(F.col(f"x1{s}") - F.col(f"x0{s}"), F.col(f"y1{s}") - F.col(f"y0{s}")), grid)
    levels = sorted({*levels_in(left, own("_a")), *levels_in(right, own("_b"))})
    known = F.array(*map(F.lit, levels)).cast("array<int>")

    def found(one: DataFrame, two: DataFrame, s: str, t: str, above: bool) -> DataFrame:
        """Pairs on the level of the row of ``one``; the row of ``two`` is of that level or a lower one, with ``above`` a lower one."""
        from_level = F.filter(known, lambda x: (x > F.col("_own")) if above else (x >= F.col("_own")))
        looks = _spread(two.withColumn("_own", own(t)).withColumn("_seen", F.explode(from_level)), F.col("_seen"), grid, t).drop("_own", "_seen")
        both = _spread(one, own(s), grid, s).join(looks, [game, "_l", "_x", "_y"])
        c, d = _cells(rect(suffix=s), F.col("_l"), grid), _cells(rect(suffix=t), F.col("_l"), grid)
        # of the cells that both touch the first counts
        both = both.where((F.col("_x") == F.greatest(c["x"], d["x"])) & (F.col("_y") == F.greatest(c["y"], d["y"])))
        return both.where(condition(rect(suffix="_a"), rect(suffix="_b"))).select(game, *left.columns[1:], *right.columns[1:])

    pairs = found(left, right, "_a", "_b", False)
    return pairs if len(levels) < 2 else pairs.unionByName(found(right, left, "_b", "_a", True))


def intersecting(a: DataFrame, b: DataFrame, **how) -> DataFrame:
    return region_join(a, b, intersects, **how)


def subsumed(a: DataFrame, b: DataFrame, **how) -> DataFrame:
    """Pairs in which ``b`` lies in ``a``."""
    return region_join(a, b, subsumes, **how)


def subregions(df: DataFrame, rows: str, cols: str, height: str, width: str) -> DataFrame:
    """Every position of a rectangle of the given size on its board."""
    fits = df.where((F.col(rows) >= F.col(height)) & (F.col(cols) >= F.col(width)))
    at = fits.withColumn("x0", F.explode(F.sequence(F.lit(0), F.col(rows) - F.col(height)))).withColumn("y0", F.explode(F.sequence(F.lit(0), F.col(cols) - F.col(width))))
    return at.withColumn("x1", F.col("x0") + F.col(height)).withColumn("y1", F.col("y0") + F.col(width))


#: columns of a board that one mask holds
MASK = 62


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _mask(lo: Column, hi: Column) -> Column:
    """A long with the bits from ``lo`` to ``hi`` set; 0 if there are none."""
    return F.when(lo <= hi, _bit(hi + 1) - _bit(lo)).otherwise(F.lit(0).cast("long"))


def free_masks(pieces: DataFrame, occupied: DataFrame, rows: int, cols: int, game: str = "game") -> DataFrame:
    """(game, height, width, x, part, free): for each size of ``pieces`` and row of its game's board a mask of the columns, MASK to a part, where such a piece may have its corner.

    Pieces of one size have the same places. Each occupied rectangle blocks a range of columns in some rows; ranges of a
    row are joined by or, so no place is a row.
    """
    size = [game, "height", "width"]
    fits = pieces.select(*size).distinct().where((F.col("height") <= rows) & (F.col("width") <= cols) & (F.col("height") > 0) & (F.col("width") > 0))
    whole = occupied.select(game, *SIDES).where((F.col("x1") > 0) & (F.col("y1") > 0) & (F.col("x0") < rows) & (F.col("y0") < cols) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    near = fits.join(whole, game)
    x = F.sequence(F.greatest(F.col("x0") - F.col("height") + 1, F.lit(0)), F.least(F.col("x1") - 1, F.lit(rows) - F.col("height")))
    near = near.select(*size, F.greatest(F.col("y0") - F.col("width") + 1, F.lit(0)).alias("_lo"), F.least(F.col("y1") - 1, F.lit(cols) - F.col("width")).alias("_hi"), F.explode(x).alias("x"))
    near = near.where("_lo <= _hi").withColumn("part", F.explode(F.sequence((F.col("_lo") / MASK).cast("int"), (F.col("_hi") / MASK).cast("int"))))
    first = F.col("part") * MASK
    taken = near.groupBy(*size, "x", "part").agg(F.bit_or(_mask(F.greatest(F.col("_lo") - first, F.lit(0)), F.least(F.col("_hi") - first, F.lit(MASK - 1)))).alias("_taken"))
    every = fits.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(rows) - F.col("height")))).withColumn("part", F.explode(F.sequence(F.lit(0), ((F.lit(cols) - F.col("width")) / MASK).cast("int"))))
    room = _mask(F.lit(0), F.least(F.lit(cols) - F.col("width") - first, F.lit(MASK - 1)))
    return every.join(taken, [*size, "x", "part"], "left").select(*size, "x", "part", room.bitwiseAND(F.bitwise_not(F.coalesce("_taken", F.lit(0).cast("long")))).alias("free")).where("free <> 0")


#: boards of more rows are not kept as one array
BOARD_ROWS = 64
#: rows of pieces and rectangles to a task
TASK_ROWS = 200_000


def _dealt(dfs: Sequence[DataFrame], game: str) -> list[DataFrame]:
    """Each dealt by ``game`` to as many partitions as keep a task at about TASK_ROWS rows of all, at least one for each core; the rows are counted for it."""
    n = max(dfs[0].sparkSession.sparkContext.defaultParallelism, -(-sum(df.count() for df in dfs) // TASK_ROWS))
    return [df.repartition(n, game) for df in dfs]


def _free_corners(pieces: DataFrame, occupied: DataFrame, rows: int, cols: int, game: str, piece: str) -> DataFrame:
    """(game, height, width, piece, x, y) of the free places on boards of at most BOARD_ROWS rows and MASK columns.

    A game's board is one array with a mask of taken columns for each row; each piece reads it, so neither places nor sizes are keys.
    """
    taken = occupied.select(game, *SIDES).where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).withColumn("_m", _mask(F.greatest("y0", F.lit(0)), F.least(F.col("y1"), F.lit(cols)) - 1))
    taken = taken.where((F.col("x1") > 0) & (F.col("x0") < rows) & (F.col("y1") > 0) & (F.col("y0") < cols))
    fits = pieces.select(game, "height", "width", piece).where(F.col(game).isNotNull() & F.col("height").between(1, rows) & F.col("width").between(1, cols))
    fits, taken = _dealt([fits, taken], game)
    row = lambda r: F.coalesce(F.bit_or(F.when((F.col("x0") <= r) & (F.col("x1") > r), F.col("_m"))), F.lit(0).cast("long"))
    both = fits.join(taken.groupBy(game).agg(F.array(*[row(r) for r in range(rows)]).alias("_board")), game, "left")
    any_of = lambda masks: F.aggregate(masks, F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m))

    def blocked(x: Column) -> Column:
        """Columns in which a piece with its corner in row ``x`` would touch a taken one."""
        return F.aggregate(F.array(any_of(F.slice("_board", x + 1, F.col("height").cast("int")))), F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(any_of(F.transform(F.sequence(F.lit(0), F.col("width").cast("int") - 1), lambda d: F.call_function("shiftrightunsigned", m, d)))))

    masks = F.transform(F.sequence(F.lit(0), F.lit(rows) - F.col("height").cast("int")), blocked)
    at_rows = both.select(game, "height", "width", piece, F.posexplode(F.when(F.col("_board").isNotNull(), masks).otherwise(F.array_repeat(F.lit(0).cast("long"), F.lit(rows + 1) - F.col("height").cast("int")))).alias("x", "_blocked"))
    corners = F.filter(F.sequence(F.lit(0), F.lit(cols) - F.col("width").cast("int")), lambda y: F.col("_blocked").bitwiseAND(_bit(y)) == 0)
    return at_rows.select(game, "height", "width", piece, "x", F.explode(corners).alias("y"))


def free_regions(pieces: DataFrame, occupied: DataFrame, rows: int, cols: int, game: str = "game", piece: str = "piece") -> DataFrame:
    """(game, piece, x0, x1, y0, y1): places of a piece's size (height, width) that touch no occupied rectangle of the game; on large boards see ``free_masks``."""
    if rows <= BOARD_ROWS and cols <= MASK:
        found = _free_corners(pieces, occupied, rows, cols, game, piece)
    else:
        size = [game, "height", "width"]
        bits = F.filter(F.sequence(F.lit(0), F.lit(MASK - 1)), lambda i: F.col("free").bitwiseAND(_bit(i)) != 0)
        free = free_masks(pieces, occupied, rows, cols, game).select(*size, "x", F.explode(F.transform(bits, lambda i: i + F.col("part") * MASK)).alias("y"))
        found = pieces.select(*size, piece).join(free, size)
    return found.select(game, piece, F.col("x").alias("x0"), (F.col("x") + F.col("height")).cast("int").alias("x1"), F.col("y").alias("y0"), (F.col("y") + F.col("width")).cast("int").alias("y1"))


def invalid_moves(moves: DataFrame, occupied: DataFrame, move: str, game: str = "game") -> DataFrame:
    """Moves (game, move, piece, target rectangle) onto an occupied rectangle (game, piece, rectangle) of another piece."""
    hit = intersecting(moves, occupied, game=game).where("piece_a <> piece_b").select(game, F.col(f"{move}_a").alias(move)).distinct()
    return moves.join(hit, [game, move], "left_semi")


def colour_names(palette: DataFrame) -> DataFrame:
    """(rgb, names): upper-cased names of each colour, sorted."""
    return palette.groupBy("rgb").agg(F.array_sort(F.collect_set(F.upper("name"))).alias("names"))


def name_colours(df: DataFrame, names: DataFrame, rgb: str = "rgb") -> DataFrame:
    """``colour``: the names of the row's RGB value, alpha ignored, comma-separated; "?" if there is none."""
    return df.join(names.select(F.col("rgb").alias("_rgb"), F.array_join("names", ", ").alias("colour")), F.col(rgb).bitwiseAND(F.lit(0xFFFFFF)) == F.col("_rgb"), "left").drop("_rgb").withColumn("colour", F.coalesce("colour", F.lit("?")))


def with_edge_count(df: DataFrame, edges: DataFrame, shape: str = "shape") -> DataFrame:
    """``edge_count`` of each shape; an error for a shape that ``edges`` (shape, edges) has not."""
    joined = df.join(edges.select(F.col("shape").alias("_shape"), "edges"), F.col(shape) == F.col("_shape"), "left").drop("_shape")
    return joined.withColumn("edge_count", F.when(F.col("edges").isNotNull(), F.col("edges")).otherwise(F.raise_error(F.lit("unknown shape")).cast("int"))).drop("edges")


def entity_table(states: DataFrame, game: str, data: str, null: str = "-") -> DataFrame:
    """(game, entity, image, size, red, green, blue, alpha): one row for each appearance of a state's list, from 1; nulls shown as ``null``."""
    from parlance.functions.values import argb

    one = states.select(game, F.posexplode(data).alias("i", "d"))
    red, green, blue, alpha = argb(F.col("d.color"))
    show = lambda c, name: F.coalesce(c.cast("string"), F.lit(null)).alias(name)
    return one.select(game, (F.col("i") + 1).alias("entity"), show(F.col("d.resourceName"), "image"), show(F.col("d.size"), "size"), show(red, "red"), show(green, "green"), show(blue, "blue"), show(alpha, "alpha"))


FEATURES: dict[str, Callable[[], Column]] = {}


def register_feature(name: str, expression: Callable[[], Column]) -> None:
    """Make a feature known by name; it is a Column expression of the entity table."""
    FEATURES[name] = expression


def feature_vector(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``keys`` and the named features in this order."""
    return df.select(*keys, *[FEATURES[n]().alias(n) for n in names])
