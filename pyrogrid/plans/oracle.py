"""SQL text that states the same results for a relational engine.

Each function gives one named step; a query lists the steps it needs.
"""

from __future__ import annotations

from ..params import Params
from .inputs import RASTER

PX = {
    "events": """cell AS (SELECT event_type frame_id, date_part('day', ts) - 1 y,
  date_part('hour', ts) x, sum(CAST(round(value * 100) AS BIGINT)) w FROM events GROUP BY ALL),
px AS MATERIALIZED (
 SELECT f.frame_id, gy.y::INT y, gx.x::INT x, CASE WHEN top > 0
  THEN floor(greatest(coalesce(c.w, 0), 0) * 255 / top::DOUBLE) ELSE 0 END::INT v, 31 height, 24 width
 FROM (SELECT frame_id, greatest(max(w), 0) top FROM cell GROUP BY 1) f
 CROSS JOIN (SELECT unnest(range(31)) y) gy CROSS JOIN (SELECT unnest(range(24)) x) gx
 LEFT JOIN cell c USING (frame_id, y, x))""",
    "lineitem": """cell AS (SELECT l_linenumber::VARCHAR frame_id, l_suppkey y,
  l_quantity::BIGINT - 1 x, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) w
 FROM lineitem GROUP BY ALL),
px AS MATERIALIZED (
 SELECT f.frame_id, gy.y::INT y, gx.x::INT x, CASE WHEN top > 0
  THEN floor(greatest(coalesce(c.w, 0), 0) * 255 / top::DOUBLE) ELSE 0 END::INT v, height, 50 width
 FROM (SELECT frame_id, greatest(max(w), 0) top,
  (SELECT max(s_suppkey) + 1 FROM supplier)::INT height FROM cell GROUP BY 1) f
 CROSS JOIN (SELECT s_suppkey y FROM supplier) gy CROSS JOIN (SELECT unnest(range(50)) x) gx
 LEFT JOIN cell c USING (frame_id, y, x))""",
    "embeddings": """cells AS (
 SELECT vec_id::VARCHAR frame_id, unnest(range(64)) pos, unnest(embedding)::DOUBLE e
 FROM embeddings),
px AS MATERIALIZED (
 SELECT frame_id, (pos // 8)::INT y, (pos % 8)::INT x,
  CASE WHEN hi = lo THEN 0 ELSE floor((e - lo) * 255.0::DOUBLE / (hi - lo)) END::INT v,
  8 height, 8 width
 FROM cells JOIN (SELECT frame_id, min(e) lo, max(e) hi FROM cells GROUP BY 1) USING (frame_id))""",
}
PX["enlarged"] = PX["embeddings"].replace("px AS MATERIALIZED", "small AS MATERIALIZED") + """,
px AS MATERIALIZED (
 SELECT frame_id, (y * 4 + dy)::INT y, (x * 4 + dx)::INT x, v, 32 height, 32 width
 FROM small CROSS JOIN (SELECT unnest(range(4)) dy) CROSS JOIN (SELECT unnest(range(4)) dx))"""


def offsets(r: int) -> str:
    return (f"(SELECT dy, dx FROM (SELECT unnest(range(-{r}, {r} + 1)) dy) "
            f"CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) dx))")


def spread(name: str, agg: str, table: str, column: str, out: str, cells: str) -> str:
    """Aggregate over a symmetric set of offsets: send each value to every position it
    reaches, aggregate per position, keep positions inside the frame."""
    return f"""sent_{name} AS (
 SELECT frame_id, y + dy y, x + dx x, {agg}({column})::INT {out}
 FROM {table} CROSS JOIN {cells} o(dy, dx) GROUP BY ALL),
{name} AS MATERIALIZED (
 SELECT s.* FROM sent_{name} s SEMI JOIN {table} t USING (frame_id, y, x))"""


def near(name: str, agg: str, table: str, column: str, out: str, r: int) -> str:
    """Aggregate over the square around each pixel."""
    return spread(name, agg, table, column, out, offsets(r))


BLUR = near("box", "sum", "px", "v", "s", 1) + """,
blurred AS MATERIALIZED (
 SELECT px.*, CASE WHEN y = 0 OR x = 0 OR y = height - 1 OR x = width - 1 THEN v
  ELSE s // 9 END::INT blur FROM px JOIN box USING (frame_id, y, x))"""
IMG_RAW = "img AS MATERIALIZED (SELECT *, v g FROM px)"
IMG_BLUR = BLUR + ",\nimg AS MATERIALIZED (SELECT * EXCLUDE (blur), blur g FROM blurred)"


def level(p: Params = RASTER) -> str:
    return f"""hist AS (SELECT frame_id, g, count(*) n FROM img GROUP BY ALL),
sums AS (SELECT frame_id, g, sum(n) OVER up w_bg, sum(g * n) OVER up s_bg,
  sum(n) OVER f w, sum(g * n) OVER f s
 FROM hist WINDOW f AS (PARTITION BY frame_id), up AS (PARTITION BY frame_id ORDER BY g
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gaps AS (SELECT *, CASE WHEN w > w_bg THEN
  s_bg::DOUBLE / w_bg::DOUBLE - (s - s_bg)::DOUBLE / (w - w_bg)::DOUBLE END d FROM sums),
ranked AS (SELECT frame_id, g, coalesce(w_bg::DOUBLE * (w - w_bg)::DOUBLE * (d * d), 0) var
 FROM gaps),
best AS (SELECT frame_id, CASE WHEN var > 0 THEN g ELSE 0 END::INT otsu FROM ranked
 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY var DESC, g) = 1),
level AS MATERIALIZED (
 SELECT frame_id, otsu, v_min, v_max, least(greatest(
  CASE WHEN v_max - v_min < 30 THEN floor(v_min + 0.3::DOUBLE * (v_max - v_min))::INT
  ELSE otsu // 2 END, {p.otsu_min}), {p.otsu_max})::INT body_threshold
 FROM best JOIN (SELECT frame_id, min(g) v_min, max(g) v_max FROM img GROUP BY 1) USING (frame_id))"""


FG = """fg AS MATERIALIZED (
 SELECT i.*, g > body_threshold fg FROM img i JOIN level USING (frame_id))"""
DIST = """dist AS MATERIALIZED (
 SELECT p.frame_id, p.y, p.x, p.v, p.g, p.height, p.width, p.fg,
  CASE WHEN NOT p.fg THEN 0 ELSE coalesce(d, 1073741824) END::INT dist3
 FROM fg p LEFT JOIN (
  SELECT a.frame_id, a.y, a.x, min(3 * greatest(abs(a.y - b.y), abs(a.x - b.x))
   + least(abs(a.y - b.y), abs(a.x - b.x))) d
  FROM fg a JOIN fg b ON a.frame_id = b.frame_id WHERE a.fg AND NOT b.fg GROUP BY ALL) m
 USING (frame_id, y, x))"""


def body(p: Params = RASTER) -> str:
    return f"""deep AS (SELECT frame_id, max(dist3) max_dist3 FROM dist GROUP BY 1),
body AS MATERIALIZED (
 SELECT d.*, max_dist3 > 0 AND dist3 / 3.0::DOUBLE
  >= {p.dist_erosion_factor}::DOUBLE * (max_dist3 / 3.0::DOUBLE) mask
 FROM dist d JOIN deep USING (frame_id))"""


def hat(k: int, source: str = "g", table: str = "img") -> str:
    r = k // 2
    return near("ero", "min", table, source, "m", r) + ",\n" + \
        near("opn", "max", "ero", "m", "o", r) + f""",
hat AS MATERIALIZED (
 SELECT i.frame_id, i.y, i.x, greatest(i.{source} - o, 0)::INT tophat
 FROM {table} i JOIN opn USING (frame_id, y, x))"""


DIFF = """staged AS MATERIALIZED (
 SELECT b.*, CASE WHEN mask THEN tophat ELSE 0 END::INT diff
 FROM body b JOIN hat USING (frame_id, y, x))"""


def cut(k: float = RASTER.sigma_k, mad: bool = False, name: str = "cut") -> str:
    if mad:
        return f"""med_{name} AS (SELECT frame_id, count(*) body_px, median(diff)::DOUBLE centre,
 median(g)::DOUBLE baseline FROM staged WHERE mask GROUP BY 1),
dev_{name} AS (SELECT frame_id, median(abs(diff - centre))::DOUBLE mad
 FROM staged JOIN med_{name} USING (frame_id) WHERE mask GROUP BY 1),
{name} AS MATERIALIZED (SELECT frame_id, body_px, centre, 1.4826::DOUBLE * mad sigma, baseline,
 least(greatest(centre + {k}::DOUBLE * (1.4826::DOUBLE * mad), 0.0::DOUBLE), 254.0::DOUBLE) t,
 mad = 0 mad_is_zero FROM med_{name} JOIN dev_{name} USING (frame_id))"""
    return f"""mom_{name} AS (SELECT frame_id, count(*) n, sum(diff)::DOUBLE s,
 sum(diff * diff)::DOUBLE ss, sum(g)::DOUBLE sg FROM staged WHERE mask GROUP BY 1),
sig_{name} AS (SELECT frame_id, n body_px, s / n centre,
 sqrt(greatest(ss / n - (s / n) * (s / n), 0.0::DOUBLE)) sigma, sg / n baseline FROM mom_{name}),
{name} AS MATERIALIZED (SELECT *, least(greatest(centre + {k}::DOUBLE * sigma, 0.0::DOUBLE),
 254.0::DOUBLE) t FROM sig_{name})"""


def raw(cut_name: str = "cut", name: str = "raw") -> str:
    return f"""{name} AS MATERIALIZED (SELECT s.* FROM staged s JOIN {cut_name} USING (frame_id)
 WHERE diff > t AND g > baseline)"""


def labels(connectivity: int = 4, mask: str = "raw", name: str = "lab") -> str:
    reach = "abs(dy) + abs(dx) = 1" if connectivity == 4 else "abs(dy) + abs(dx) > 0"
    return f"""reach_{name}(frame_id, y, x, id) AS (
 SELECT frame_id, y, x, y::BIGINT * width + x FROM {mask}
 UNION
 SELECT n.frame_id, n.y, n.x, c.id FROM reach_{name} c
 JOIN (SELECT dy, dx FROM {offsets(1)} WHERE {reach}) o ON true
 JOIN {mask} n ON n.frame_id = c.frame_id AND n.y = c.y + o.dy AND n.x = c.x + o.dx
 WHERE c.id < n.y::BIGINT * n.width + n.x),
{name} AS MATERIALIZED (
 SELECT m.*, comp_id FROM {mask} m JOIN (
  SELECT frame_id, y, x, min(id) comp_id FROM reach_{name} GROUP BY ALL) USING (frame_id, y, x))"""


def regions(p: Params = RASTER, lab: str = "lab", name: str = "reg") -> str:
    m = p.border_margin
    return f"""sides_{name} AS (
 SELECT a.frame_id, a.y, a.x, count(b.y) < 4 boundary FROM {lab} a
 CROSS JOIN (SELECT dy, dx FROM {offsets(1)} WHERE abs(dy) + abs(dx) = 1) o
 LEFT JOIN {lab} b ON b.frame_id = a.frame_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx
 GROUP BY ALL),
{name} AS MATERIALIZED (
 SELECT frame_id, comp_id, count(*) area, count(*) FILTER (WHERE boundary) perimeter,
  bool_or(x <= {m} OR y <= {m} OR x >= width - 1 - {m} OR y >= height - 1 - {m}) touches_border,
  max(dist3) max_dist3, sum(y)::DOUBLE / count(*) centroid_y,
  sum(x)::DOUBLE / count(*) centroid_x, sum(v)::DOUBLE / count(*) mean_v, max(v) max_v,
  min(x) x0, min(y) y0, max(x) x1, max(y) y1, max(height) height, max(width) width,
  12.566370614359172::DOUBLE * count(*) / (count(*) FILTER (WHERE boundary)
   * count(*) FILTER (WHERE boundary)) circularity
 FROM {lab} JOIN sides_{name} USING (frame_id, y, x) GROUP BY ALL)"""


def judged(p: Params = RASTER, reg: str = "reg", cut_name: str = "cut", name: str = "judged",
           bbox: bool = False) -> str:
    size = "width" if bbox else "least(height, width)"
    rules = {
        "position": f"centroid_y > height * {p.lower_cutoff_y}::DOUBLE",
        "border": "touches_border",
        "depth": f"max_dist3 / 3.0::DOUBLE < greatest({p.min_dist_abs}::DOUBLE, "
                 f"{p.min_dist_factor}::DOUBLE * {size})",
        "area": f"area < greatest({p.min_area_abs}::DOUBLE, {p.min_area_factor}::DOUBLE * body_px)",
        "shape": f"circularity < {p.min_circularity}::DOUBLE"}
    order = ("position", "area", "border", "depth", "shape") if bbox else tuple(rules)
    whens = " ".join(f"WHEN {rules[r]} THEN '{r}'" for r in order)
    return f"""{name} AS MATERIALIZED (SELECT r.*, CASE {whens} END reject_reason
 FROM {reg} r JOIN {cut_name} USING (frame_id))"""


def hot(lab: str = "lab", judge: str = "judged", name: str = "hot") -> str:
    return f"""{name} AS MATERIALIZED (SELECT l.* FROM {lab} l SEMI JOIN
 (SELECT frame_id, comp_id FROM {judge} WHERE reject_reason IS NULL) USING (frame_id, comp_id))"""


FLAGGED = """flagged AS MATERIALIZED (SELECT s.*, h.y IS NOT NULL hot FROM staged s
 LEFT JOIN hot h ON h.frame_id = s.frame_id AND h.y = s.y AND h.x = s.x)"""


def segmented(raster: str, p: Params = RASTER) -> list[str]:
    """Steps up to the body mask of the raw grey values."""
    return [PX[raster], IMG_RAW, level(p), FG, DIST, body(p)]


def detection(raster: str, k: int, p: Params = RASTER, mad: bool = False,
              connectivity: int = 4) -> list[str]:
    """Steps of the whole detection."""
    return [PX[raster], IMG_BLUR, level(p), FG, DIST, body(p), hat(k), DIFF,
            cut(p.sigma_k, mad), raw(), labels(connectivity), regions(p), judged(p), hot(),
            FLAGGED]


def query(steps: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n" + select


def ellipse(k: int, raster: str) -> list[str]:
    """Top-hat with an elliptic element: the offsets whose row is no wider than its chord."""
    r = k // 2
    cells = (f"(SELECT dy, dx FROM {offsets(r)} WHERE abs(dx) <= "
             f"round_even({r} * sqrt(({r} * {r} - dy * dy) / {r * r}.0::DOUBLE), 0))")
    return [PX[raster], spread("ero", "min", "px", "v", "m", cells),
            spread("opn", "max", "ero", "m", "o", cells)]
