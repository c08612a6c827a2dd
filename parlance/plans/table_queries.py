"""Queries over the star schema: numbers as colours, sizes, rectangles and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import values as v
from parlance.operators import geometry as g
from parlance.operators import stats as st
from parlance.plans import query
from parlance.plans.bindings import table

#: an 8 x 8 board for every order; each line is a rectangle
R = "r as (select l_orderkey as game, l_orderkey * 10 + l_linenumber as piece, cast(l_partkey % 6 as int) as x0, cast(l_partkey % 6 + 1 + l_linenumber % 3 as int) as x1, cast(l_suppkey % 6 as int) as y0, cast(l_suppkey % 6 + 1 + l_orderkey % 3 as int) as y1, l_linenumber as n from lineitem)"
HIT = "a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1"


def rects(spark, sf):
    li = table(spark, sf, "lineitem")
    x, y = (F.col("l_partkey") % 6).cast("int"), (F.col("l_suppkey") % 6).cast("int")
    return li.select(F.col("l_orderkey").alias("game"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("piece"), x.alias("x0"), (x + 1 + F.col("l_linenumber") % 3).cast("int").alias("x1"), y.alias("y0"), (y + 1 + F.col("l_orderkey") % 3).cast("int").alias("y1"), F.col("l_linenumber").alias("n"))


@query("j14_intersecting", f"with {R} select distinct a.game, a.piece as p, b.piece as q from r a join r b on a.game = b.game and a.piece < b.piece and {HIT}")
def intersecting(spark, sf):
    r = rects(spark, sf)
    return g.intersecting(r, r).where("piece_a < piece_b").select("game", F.col("piece_a").alias("p"), F.col("piece_b").alias("q")).distinct()


@query("j15_subsumed", f"with {R} select distinct a.game, a.piece as p, b.piece as q from r a join r b on a.game = b.game and a.piece <> b.piece and a.x0 <= b.x0 and a.x1 >= b.x1 and a.y0 <= b.y0 and a.y1 >= b.y1")
def subsumed(spark, sf):
    r = rects(spark, sf)
    return g.subsumed(r, r).where("piece_a <> piece_b").select("game", F.col("piece_a").alias("p"), F.col("piece_b").alias("q")).distinct()


@query("j16_free_regions", f"with {R}, pc as (select distinct game, x1 - x0 as h, y1 - y0 as w from r), pl as (select game, h, w, cast(x0 as int) as x0, cast(x0 + h as int) as x1, cast(y0 as int) as y0, cast(y0 + w as int) as y1 from (select *, unnest(range(0, 8 - w + 1)) as y0 from (select *, unnest(range(0, 8 - h + 1)) as x0 from pc))), fr as (select * from pl a where not exists (select 1 from r b where b.game = a.game and {HIT})) select r.game, r.piece, count(*) as places, sum(fr.x0 * 8 + fr.y0) as sum_of_corners from r join fr on fr.game = r.game and fr.h = r.x1 - r.x0 and fr.w = r.y1 - r.y0 group by r.game, r.piece")
def free_regions(spark, sf):
    """How many free places each line's rectangle would find on its order's board, and the sum of their corners' cell numbers."""
    r = rects(spark, sf)
    pieces = r.select("game", "piece", (F.col("x1") - F.col("x0")).alias("height"), (F.col("y1") - F.col("y0")).alias("width"))
    return g.free_regions(pieces, r, 8, 8).groupBy("game", "piece").agg(F.count("*").alias("places"), F.sum(F.col("x0") * 8 + F.col("y0")).alias("sum_of_corners"))


@query("j17_invalid_moves", f"with {R} select distinct a.game, a.piece from r a join r b on a.game = b.game and a.piece <> b.piece and {HIT}")
def invalid_moves(spark, sf):
    r = rects(spark, sf)
    return g.invalid_moves(r.withColumn("move", F.col("piece")), r.select("game", "piece", *g.SIDES), "move").select("game", "piece").distinct()


@query("f31_intersects", f"with {R} select piece, x0 < 8 and 4 < x1 and y0 < 9 and 3 < y1 as hit, x0 <= 5 and x1 >= 6 and y0 <= 5 and y1 >= 6 as covers from r")
def intersects(spark, sf):
    box = {k: F.lit(n) for k, n in zip(g.SIDES, (4, 8, 3, 9))}
    cell = {k: F.lit(n) for k, n in zip(g.SIDES, (5, 6, 5, 6))}
    return rects(spark, sf).select("piece", v.intersects(v.rect(), box).alias("hit"), v.subsumes(v.rect(), cell).alias("covers"))


@query("f32_subsumes", f"with {R} select piece from r where x0 <= 5 and x1 >= 6 and y0 <= 5 and y1 >= 6")
def subsumes(spark, sf):
    return rects(spark, sf).where(v.subsumes(v.rect(), {k: F.lit(n) for k, n in zip(g.SIDES, (5, 6, 5, 6))})).select("piece")


@query("f26_position", f"with {R} select piece, (x0 + x1) / 2 / 16 as x, (y0 + y1) / 2 / 16 as y from r")
def position(spark, sf):
    x, y = v.centre(v.rect(), F.lit(16), F.lit(16))
    return rects(spark, sf).select("piece", x.alias("x"), y.alias("y"))


@query("f27_relative_size", f"with {R} select piece, (x1 - x0) * (y1 - y0) / 256 as size from r")
def relative_size(spark, sf):
    return rects(spark, sf).select("piece", v.relative_size(v.rect(), F.lit(16), F.lit(16)).alias("size"))


@query("f30_region_area", f"with {R} select piece, (x1 - x0) * (y1 - y0) as area, cast((x1 - x0) * (y1 - y0) * n as bigint) as volume from r")
def region_area(spark, sf):
    volume = v.product(F.array(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("n")))
    return rects(spark, sf).select("piece", v.region_area(v.rect()).alias("area"), volume.alias("volume"))


B = "b as (select o_custkey // 30 as game, list(case when o_orderstatus = 'P' then null else o_orderpriority end order by o_orderkey) as occ from orders group by 1)"
CELLS = "ce as (select game, unnest(range(len(occ))) as index, unnest(occ) as element from b), c as (select game, index, index // 6 as \"row\", index % 6 as col, element from ce)"


def boards(spark, sf):
    o = table(spark, sf, "orders")
    cell = F.when(F.col("o_orderstatus") == "P", "null").otherwise(F.col("o_orderpriority"))
    b = o.groupBy(F.floor(F.col("o_custkey") / 30).alias("game")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", cell.alias("c")))).alias("x"))
    return b.select("game", F.transform("x", lambda s: s["c"]).alias("occ"), F.lit(6).alias("cols"))


@query("a28_element_regions", f'with {B}, {CELLS} select game, element, min("row") as x0, max("row") + 1 as x1, min(col) as y0, max(col) + 1 as y1 from c where element is not null group by all')
def element_regions(spark, sf):
    return g.element_regions(g.cells(boards(spark, sf), "game", "occ", "cols"))


@query("a29_occupancy", f"with {B}, {CELLS} select game, count(element) as occupied, count(element) / count(*) as ratio, count(distinct element) as elements from c group by game")
def occupancy(spark, sf):
    return g.occupancy(g.cells(boards(spark, sf), "game", "occ", "cols"))


@query("f33_matrix_slices", f"with {B}, {CELLS} select game, coalesce(string_agg(coalesce(element, 'null'), ',' order by index) filter (\"row\" = 1), '') as row1, coalesce(string_agg(coalesce(element, 'null'), ',' order by index) filter (col = 2), '') as col2, coalesce(string_agg(coalesce(element, 'null'), ',' order by index) filter (\"row\" between 1 and 2 and col between 3 and 4), '') as block from c  group by game")
def matrix_slices(spark, sf):
    b = boards(spark, sf)
    cells, cols = F.col("occ"), F.col("cols")
    block = {k: F.lit(n) for k, n in zip(g.SIDES, (1, 3, 3, 5))}
    return b.select("game", F.array_join(v.matrix_row(cells, cols, F.lit(1)), ",").alias("row1"), F.array_join(v.matrix_col(cells, cols, F.lit(2)), ",").alias("col2"), F.array_join(v.matrix_block(cells, cols, block), ",").alias("block"))


@query("f34_subregions", "select p_partkey, greatest(0, 16 - (p_size % 5 + 1) + 1) * greatest(0, 16 - (p_size % 3 + 1) + 1) as n, greatest(0, 16 - (p_size % 5 + 1) + 1) * greatest(0, 16 - (p_size % 3 + 1) + 1) as listed from part")
def subregions(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.lit(16).alias("rows"), F.lit(16).alias("cols"), (F.col("p_size") % 5 + 1).alias("h"), (F.col("p_size") % 3 + 1).alias("w"))
    listed = g.subregions(p, "rows", "cols", "h", "w").groupBy("p_partkey").agg(F.count("*").alias("listed"))
    return p.join(listed, "p_partkey").select("p_partkey", v.count_subregions(F.col("rows"), F.col("cols"), F.col("h"), F.col("w")).alias("n"), "listed")


ARGB = "k as (select p_partkey, (p_partkey * 2654435761) % 4294967296 as c from part), q as (select p_partkey, (c >> 16) & 255 as r, (c >> 8) & 255 as g, c & 255 as b, (c >> 24) & 255 as a from k)"


def colours(spark, sf):
    c = (F.col("p_partkey") * 2654435761) % 4294967296
    signed = F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c).cast("int")
    return table(spark, sf, "part").select("p_partkey", signed.alias("argb"), "p_size", "p_name")


@query("f24_argb", f"with {ARGB} select p_partkey, cast(r as int) as red, cast(g as int) as green, cast(b as int) as blue, cast(a as int) as alpha from q")
def argb(spark, sf):
    r, gr, b, a = v.argb(F.col("argb"))
    return colours(spark, sf).select("p_partkey", r.alias("red"), gr.alias("green"), b.alias("blue"), a.alias("alpha"))


HSB = "h as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from q), s as (select *, case when hi = lo then 0 when r = hi then (g - b) / (hi - lo) when g = hi then 2 + (b - r) / (hi - lo) else 4 + (r - g) / (hi - lo) end / 6 as sx from h)"


@query("f25_rgb_to_hsb", f"with {ARGB}, {HSB} select p_partkey, case when sx < 0 then sx + 1 else sx end as hue, case when hi > 0 then (hi - lo) / hi else 0.0 end as saturation, hi / 255 as brightness from s")
def rgb_to_hsb(spark, sf):
    h, s, b = v.rgb_to_hsb(*v.argb(F.col("argb"))[:3])
    return colours(spark, sf).select("p_partkey", h.alias("hue"), s.alias("saturation"), b.alias("brightness"))


g.register_feature("shape", lambda: F.substring_index("p_name", " ", -1))
g.register_feature("size", lambda: F.col("p_size") / 256.0)
g.register_feature("red", lambda: v.argb(F.col("argb"))[0])
g.register_feature("hue", lambda: v.rgb_to_hsb(*v.argb(F.col("argb"))[:3])[0])


@query("f28_feature_vector", f"with {ARGB}, {HSB} select p_partkey, string_split(p_name, ' ')[-1] as shape, p_size / 256 as size, cast(r as int) as red, case when sx < 0 then sx + 1 else sx end as hue from s join part using (p_partkey)")
def feature_vector(spark, sf):
    return g.feature_vector(colours(spark, sf), ["p_partkey"], ["shape", "size", "red", "hue"])


@query("x03_register_feature", "select p_partkey, p_size * 2 as double_size from part")
def registered_feature(spark, sf):
    g.register_feature("double_size", lambda: F.col("p_size") * 2)
    return g.feature_vector(colours(spark, sf), ["p_partkey"], ["double_size"])


@query("a31_colour_names", "select p_size as rgb, array_to_string(list_sort(list(distinct upper(p_type))), ', ') as names from part group by p_size")
def colour_names(spark, sf):
    return g.colour_names(table(spark, sf, "part").select(F.col("p_size").alias("rgb"), F.col("p_type").alias("name"))).withColumn("names", F.array_join("names", ", "))


@query("f29_colour_name", "with n as (select p_size as rgb, array_to_string(list_sort(list(distinct upper(p_type))), ', ') as names from part where p_size < 40 group by p_size) select p_partkey, coalesce(names, '?') as colour from part left join n on rgb = p_size")
def colour_name(spark, sf):
    p = table(spark, sf, "part")
    names = g.colour_names(p.where("p_size < 40").select(F.col("p_size").alias("rgb"), F.col("p_type").alias("name")))
    return g.name_colours(p, names, "p_size").select("p_partkey", "colour")


@query("j10_edge_counts", "with e as (select p_brand, max(p_size) as n from part group by p_brand) select p_partkey, n as edge_count from part join e using (p_brand)")
def edge_counts(spark, sf):
    p = table(spark, sf, "part")
    edges = p.groupBy(F.col("p_brand").alias("shape")).agg(F.max("p_size").alias("edges"))
    return g.with_edge_count(p.withColumn("shape", F.col("p_brand")), edges).select("p_partkey", "edge_count")


@query("s24_entity_table", f"with {ARGB} select p_partkey // 20 as game, cast(row_number() over (partition by p_partkey // 20 order by p_partkey) as int) as entity, p_name as image, case when p_size % 4 = 0 then '-' else cast(p_size as varchar) end as size, cast(r as varchar) as red, cast(g as varchar) as green, cast(b as varchar) as blue, cast(a as varchar) as alpha from q join part using (p_partkey)")
def entity_table(spark, sf):
    looks = F.struct(F.col("argb").alias("color"), F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("string")).alias("size"), F.col("p_name").alias("resourceName"))
    states = colours(spark, sf).groupBy(F.floor(F.col("p_partkey") / 20).alias("game")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", looks.alias("d")))), lambda x: x["d"]).alias("data"))
    return g.entity_table(states, "game", "data")


@query("a14_duration_summary", "with d as (select cast(l_extendedprice / 1000 as decimal(20, 6)) as d from lineitem) select 'MIN' as stat, cast(min(d) as double) as value from d union all select 'MAX', max(d) from d union all select 'MEAN', avg(d) from d union all select 'SUM', sum(d) from d")
def duration_summary(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).cast("decimal(20,6)").alias("d"))
    return st.duration_summary(d, "d")


@query("f46_adjoin", "select p_partkey, coalesce(nullif(p_size, 7), 0) as size, p_brand || ',' || p_type as tags from part")
def adjoin(spark, sf):
    p = table(spark, sf, "part").withColumn("zero", F.lit(0))
    merged = v.adjoin({"size": F.col("zero"), "tags": F.array("p_brand")}, {"size": F.nullif("p_size", F.lit(7)), "tags": F.array("p_type")}, frozenset(["tags"]))
    return p.select("p_partkey", merged["size"].alias("size"), F.array_join(merged["tags"], ",").alias("tags"))


@query("f46_merge_records", """select p_partkey, '{"brand":"' || p_brand || '","more":{"deep":{"x":1,"y":' || p_size || '},"n":2},"none":null,"tags":["' || p_brand || '","' || p_type || '",{"k":1}]' || case when p_size % 2 = 0 then ',"type":"' || p_type || '"' else '' end || '}' as merged from part""")
def merge_records(spark, sf):
    p = table(spark, sf, "part")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    a = F.concat(F.lit('{"tags":['), quoted("p_brand"), F.lit('],"more":{"n":1,"deep":{"x":1}},"none":null,"brand":'), quoted("p_brand"), F.lit("}"))
    b = F.concat(F.lit('{"tags":['), quoted("p_type"), F.lit(',{"k":1}],"more":{"deep":{"y":'), "p_size", F.lit('},"n":2},"brand":null'), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(',"type":'), quoted("p_type"))).otherwise(F.lit("")), F.lit("}"))
    return p.select("p_partkey", F.to_json(v.merge_records(F.parse_json(a), F.parse_json(b))).alias("merged"))


@query("f47_put_all", "select p_partkey, coalesce(nullif(p_type, 'ECONOMY'), p_brand) as label, p_size from part")
def put_all(spark, sf):
    m = v.put_all_except_null({"label": F.col("p_brand"), "p_size": F.col("p_size")}, {"label": F.nullif("p_type", F.lit("ECONOMY"))})
    return table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in m.items()])


@query("f52_player_roles", "select n_nationkey, n_name as instructor, 'R' || n_regionkey as manipulator from nation")
def player_roles(spark, sf):
    n = table(spark, sf, "nation")
    m = v.player_roles(F.array(F.array(F.lit("I"), F.col("n_name")), F.array(F.lit("M"), F.concat(F.lit("R"), F.col("n_regionkey")))))
    return n.select("n_nationkey", m["I"].alias("instructor"), m["M"].alias("manipulator"))
