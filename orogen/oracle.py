"""SQL for DuckDB that gives the rows of the registered raster queries by other means: offset joins, RANGE windows, theta joins."""

from __future__ import annotations

import math

from orogen import queries as q
from orogen.functions.lighting import Lighting
from orogen.operators import vat
from orogen.operators.compose import Layer, parse_color


def compass(n: int) -> list[tuple[float, float]]:
    """East and south parts of n directions clockwise from north."""
    turns = [2 * math.pi * i / n for i in range(n)]
    return [(math.cos(math.pi / 2 - a), -math.sin(math.pi / 2 - a)) for a in turns]


def least_radius(radius: int, noise: int) -> int:
    """The first radius after the share that a noise level skips: none, a tenth, two tenths, four tenths."""
    return max(1, int((0, 1, 2, 4)[noise] * radius / 10 + 0.5))


EMB = "emb AS (SELECT CAST(i - 1 AS INTEGER) AS x, CAST(vec_id AS INTEGER) AS y, 100 * CAST(embedding[i] AS DOUBLE) AS z FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"
HOLE = EMB + ", hole AS (SELECT x, y, CASE WHEN (7 * x + 13 * y) % 11 <> 0 THEN z END AS z FROM emb)"


def shipping(side: int = 64) -> str:
    return f"ship AS (SELECT CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y, z FROM generate_series(0, {side - 1}) AS s(a), generate_series(0, {side - 1}) AS t(b) LEFT JOIN (SELECT l_partkey % {side} AS p, l_suppkey % {side} AS s, max(l_quantity) AS z FROM lineitem GROUP BY 1, 2) ON p = a AND s = b)"


def fix(v: str) -> str:
    return f"floor(({v}) * 1e6 + 0.5) / 1e6"


def num(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def near(table: str, scale: float = 1.0) -> str:
    """Slope and aspect in radians of a table, as table `terrain`."""
    return f"""near AS (SELECT x, y, z * {scale} AS z, coalesce(lag(z) OVER r, z) * {scale} AS l, coalesce(lead(z) OVER r, z) * {scale} AS r, coalesce(lag(z) OVER c, z) * {scale} AS u, coalesce(lead(z) OVER c, z) * {scale} AS d
  FROM {table} WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)),
terrain AS (SELECT x, y, z, CASE WHEN z IS NOT NULL THEN atan(sqrt(((l - r) / 2) * ((l - r) / 2) + ((d - u) / 2) * ((d - u) / 2))) END AS slope,
  CASE WHEN z IS NOT NULL THEN atan2((l - r) / 2, CASE WHEN (d - u) / 2 = 0 THEN 1e-8 ELSE (d - u) / 2 END) END AS aspect FROM near)"""


def shade(azimuth: float, elevation: float) -> str:
    zenith = math.radians(90 - elevation)
    return f"CASE WHEN slope IS NOT NULL THEN greatest(0.0, {num(math.cos(zenith))} * cos(slope) + {num(math.sin(zenith))} * sin(slope) * cos(aspect - {num(math.radians(azimuth))})) END"


def boxes(table: str, radii: list[int]) -> str:
    """s, c, q of each radius by nested RANGE windows, as table `box`."""
    win = lambda name, order, part, r: f"{name}{r} AS (PARTITION BY {part} ORDER BY {order} RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    first = ", ".join(f"sum(z) OVER h{r} AS s{r}, count(z) OVER h{r} AS c{r}, sum(z * z) OVER h{r} AS q{r}" for r in radii)
    second = ", ".join(f"sum(s{r}) OVER v{r} AS s{r}, sum(c{r}) OVER v{r} AS c{r}, sum(q{r}) OVER v{r} AS q{r}" for r in radii)
    return f"flat AS (SELECT x, y, z, {first} FROM {table} WINDOW {', '.join(win('h', 'x', 'y', r) for r in radii)}), box AS (SELECT x, y, z, {second} FROM flat WINDOW {', '.join(win('v', 'y', 'x', r) for r in radii)})"


def table(name: str, columns: list[str], rows: list[tuple]) -> str:
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(num(v) if isinstance(v, float) else str(v) for v in r) + ')' for r in rows)})"


def sight(source: str, turns: list[tuple[float, float]], radii: list[int], sign: int = 1) -> str:
    """Largest slope by cell and direction (-1000 without a sample), as table `sight`."""
    rows = [(i, r, math.floor(dx * r + 0.5), math.floor(dy * r + 0.5), float(math.hypot(dx * r, dy * r))) for i, (dx, dy) in enumerate(turns) for r in radii]
    return (
        table("offs", ["dir", "rad", "ox", "oy", "dist"], rows)
        + f""", seen AS (SELECT a.x, a.y, o.dir, max({sign} * (b.z - a.z) / o.dist) AS s FROM {source} a CROSS JOIN offs o JOIN {source} b ON b.x = a.x + o.ox AND b.y = a.y + o.oy WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY 1, 2, 3),
dirs AS (SELECT DISTINCT dir FROM offs), sight AS (SELECT a.x, a.y, d.dir, coalesce(s, -1000.0) AS s FROM {source} a CROSS JOIN dirs d LEFT JOIN seen e ON e.x = a.x AND e.y = a.y AND e.dir = d.dir WHERE a.z IS NOT NULL)"""
    )


def sky(source: str = "emb", radius: int = 10, noise: int = 0, sign: int = 1, n: int = 16, name: str = "sky", power: int = 4, least: float = 0.4) -> str:
    weights = [(1 - least) * math.cos((2 * math.pi / n * i - math.radians(315.0)) / 2) ** power + least for i in range(n)]
    body = sight(source, compass(n), list(range(least_radius(radius, noise), radius + 1)), sign) + ", " + table("wts", ["wdir", "w"], [(i, float(w)) for i, w in enumerate(weights)])
    return body + f", {name} AS (SELECT x, y, avg(1 - sin(greatest(atan(s), 0.0))) AS svf, sum((1 - sin(greatest(atan(s), 0.0))) * w) / {num(sum(weights))} AS asvf, degrees({num(math.pi / 2)} - avg(atan(s))) AS openness FROM sight JOIN wts ON wdir = dir GROUP BY 1, 2)"


def stretched(v: str, low: float, high: float) -> str:
    return f"((greatest({num(low)}, least({num(high)}, {v})) - {num(low)}) / {num(high - low)})"


def vat_single(p: vat.Preset, name: str) -> str:
    """One preset's blend as a subquery with its own tables."""
    return f"""{name} AS (WITH {near('emb')}, {sky('emb', p.radius, p.noise)},
a AS (SELECT x, y, {stretched('degrees(slope)', *p.slope)} AS s, {stretched(shade(*p.sun), 0.0, 1.0)} AS h, {stretched('svf', *p.svf)} AS f, {stretched('openness', *p.openness)} AS o FROM terrain JOIN sky USING (x, y)),
b AS (SELECT x, y, f, o, s * 0.5 + h * (1 - 0.5) AS v FROM a),
c AS (SELECT x, y, f, (CASE WHEN v > 0.5 THEN 1 - (1 - 2 * (v - 0.5)) * (1 - o) ELSE 2 * v * o END) * 0.5 + v * (1 - 0.5) AS v FROM b)
SELECT x, y, f * v * 0.25 + v * (1 - 0.25) AS v FROM c)"""


def illumination(model: str, shadow: tuple[float, float] | None = None, n: int = 16, distance: int = 20) -> str:
    step = math.pi / n
    at = math.floor(shadow[0] / (360 / n) + 0.5) % n if shadow else 0
    v = "uniform" if model == "uniform" else "0.33 * uniform + 0.67 * raw / max(raw) OVER (PARTITION BY x // 64, y // 64)"
    if shadow:
        v = f"({v}) * 0.8 + CASE WHEN degrees(sh) < {shadow[1]} THEN 0.2 ELSE 0.0 END"
    return f"""WITH {EMB}, {near('emb')}, {sight('emb', compass(n), list(range(1, distance + 1)))},
h AS (SELECT x, y, dir, atan(CASE WHEN s > -1000 THEN greatest(s, 0.0) ELSE s END) AS h, {num(-2 * math.sin(step))} * cos(radians({num(360.0 / n)} * dir) - aspect) AS t, slope FROM sight JOIN terrain USING (x, y)),
g AS (SELECT x, y, slope, sum(cos(h) * cos(h)) AS a, sum(greatest(t * ({num(math.pi / 4)} - h / 2 - sin(2 * h) / 4), 0.0)) AS b, sum(greatest(pow(cos(h), 3), 0.0)) AS c, sum(greatest(t * ({num(2.0 / 3.0)} - cos(h) + pow(cos(h), 3) / 3), 0.0)) AS d, max(CASE WHEN dir = {at} THEN h END) AS sh FROM h GROUP BY 1, 2, 3),
r AS (SELECT x, y, sh, ({num(step)} * cos(slope) * a + sin(slope) * least(b, {num(math.pi)})) / {num(math.pi)} AS uniform, {num(2 * step / 3)} * cos(slope) * c + sin(slope) * d AS raw FROM g)
SELECT x, y, {fix('v')} AS v FROM (SELECT x, y, {v} AS v FROM r)"""


def dominance() -> str:
    turns = [(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in range(0, 360, 15)]
    norm = sum(1.7 / d * (2.0 * d + 1) for d in range(10, 21)) * len(turns)
    rays = [(float(dx), float(dy), r) for dx, dy in turns for r in range(10, 21)]
    # Sample places are rounded within the tile's buffered window, whose corner is 20 cells before the tile but not before the raster.
    return f"""WITH {EMB}, {table('rays', ['dx', 'dy', 'r'], rays)}, a AS (SELECT x, y, z, x - greatest(0, x // 64 * 64 - 20) AS lx, y - greatest(0, y // 64 * 64 - 20) AS ly FROM emb),
p AS (SELECT x, y, z, r, CAST(floor(lx + dx * r + 0.5) AS INTEGER) - lx + x AS px, CAST(floor(ly + dy * r + 0.5) AS INTEGER) - ly + y AS py FROM a CROSS JOIN rays)
SELECT p.x, p.y, {fix(f'sum(CASE WHEN p.z + 1.7 > b.z THEN (p.z + 1.7 - b.z) / r * (2.0 * r + 1) ELSE 0.0 END) / {num(norm)}')} AS v FROM p LEFT JOIN emb b ON b.x = px AND b.y = py GROUP BY 1, 2"""


def f(v) -> str:
    return f"CAST({v} AS FLOAT)"


def channel(value: str, layer: Layer, c: int) -> str:
    at = [f((parse_color(s.color)[c] / 255) if c < 3 else s.alpha) for s in layer.stops]
    v = f(value)
    out = f"CASE WHEN {v} <= {f(layer.stops[0].value)} THEN {at[0]}"
    for i in range(len(at) - 1):
        a, b = layer.stops[i].value, layer.stops[i + 1].value
        out += f" WHEN {v} < {f(b)} THEN {at[i]} + ({at[i + 1]} - {at[i]}) * (({v} - {f(a)}) / ({f(b)} - {f(a)})) WHEN {v} = {f(b)} THEN {at[i + 1]}"
    return out + f" ELSE {at[-1]} END"


def linear(v: str) -> str:
    return f"CASE WHEN {v} <= {f(0.04045)} THEN {v} / {f(12.92)} ELSE {f(f'pow(CAST(({v} + {f(0.055)}) / {f(1.055)} AS DOUBLE), CAST({f(2.4)} AS DOUBLE))')} END"


def srgb(v: str) -> str:
    return f"CASE WHEN {v} <= {f(0.0031308)} THEN {f(12.92)} * {v} ELSE {f(f'CAST({f(1.055)} AS DOUBLE) * pow(CAST({v} AS DOUBLE), CAST({f(1.0)} / {f(2.4)} AS DOUBLE)) - CAST({f(0.055)} AS DOUBLE)')} END"


def composed(layers: list[Layer], with_alpha: bool = False) -> str:
    one = f(1.0)
    ctes = [EMB, "e AS (SELECT x, y, (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) AS z FROM emb)", shipping(), f"l0 AS (SELECT e.x, e.y, e.z, ship.z AS w, {f(0)} AS r, {f(0)} AS g, {f(0)} AS b, {f(0)} AS a FROM e LEFT JOIN ship ON ship.x = e.x AND ship.y = e.y % 64)"]
    for i, layer in enumerate(layers):
        alpha = f"({channel(layer.column, layer, 3)}) * {f(layer.opacity)}"
        if layer.alpha:
            alpha = f"CASE WHEN {layer.alpha} IS NULL THEN {f(0)} ELSE ({alpha}) * greatest({f(0)}, least({one}, {f(layer.alpha)})) END"
        src = {c: channel(layer.column, layer, k) for k, c in enumerate("rgb")}
        ctes.append(f"s{i} AS (SELECT *, CASE WHEN {layer.column} IS NULL THEN {f(0)} ELSE {alpha} END AS sa, {', '.join(f'{v} AS s{c}' for c, v in src.items())} FROM l{i})")
        ctes.append(f"t{i} AS (SELECT *, sa + a * ({one} - sa) AS oa, {', '.join(f'{linear(f"s{c}")} AS ls{c}, {linear(c)} AS ld{c}' for c in 'rgb')} FROM s{i})")
        mixed = {}
        for c in "rgb":
            s, d = f"ls{c}", f"ld{c}"
            if layer.blend == "normal":
                mixed[c] = f"s{c}"
            elif layer.blend == "multiply":
                mixed[c] = f"s{c} * {c}"
            elif layer.blend == "screen":
                mixed[c] = f"{one} - (({one} - {s}) * ({one} - {d}))"
            else:
                root = f"CASE WHEN {d} <= {f(0.25)} THEN (({f(16)} * {d} - {f(12)}) * {d} + {f(4)}) * {d} ELSE {f(f'sqrt(CAST({d} AS DOUBLE))')} END"
                mixed[c] = f"CASE WHEN {s} <= {f(0.5)} THEN {d} - (({one} - ({f(2)} * {s})) * {d} * ({one} - {d})) ELSE {d} + (({f(2)} * {s} - {one}) * (({root}) - {d})) END"
        ctes.append(f"m{i} AS (SELECT *, {', '.join(f'{v} AS m{c}' for c, v in mixed.items())} FROM t{i})")
        if layer.blend in ("screen", "softlight"):
            unit = lambda c: f"greatest({f(0)}, least({one}, m{c}))"
            ctes.append(f"n{i} AS (SELECT * REPLACE ({', '.join(f'{srgb(unit(c))} AS m{c}' for c in 'rgb')}) FROM m{i})")
            last = f"n{i}"
        else:
            last = f"m{i}"
        new = ", ".join(f"CASE WHEN sa <= 0 THEN {c} ELSE ((m{c} * sa) + (({c} * a) * ({one} - sa))) / oa END AS {c}" for c in "rgb")
        ctes.append(f"l{i + 1} AS (SELECT x, y, z, w, {new}, CASE WHEN sa <= 0 THEN a ELSE oa END AS a FROM {last})")
    byte = lambda c: f"CAST(floor(CAST(greatest({f(0)}, least({one}, {c})) AS DOUBLE) * 255 + 0.5) AS INTEGER)"
    out = ", ".join(f"{byte(c)} AS {n}" for c, n in zip("rgba", ["red", "green", "blue"] + (["alpha"] if with_alpha else [])))
    return f"WITH {', '.join(ctes)} SELECT x, y, {out} FROM l{len(layers)}"


def horizons(scale: float, n: int = 16, radius: int = 32) -> str:
    """Horizon angles by cell and direction, as table `angles`, over pyramid levels of the whole raster."""
    steps, reached = [], 0
    for k in range(3):
        for s in range(1, 9):
            if reached < s << k <= radius:
                for i in range(n):
                    a = 2 * math.pi * i / n
                    dx, dy = math.sin(a), -math.cos(a)
                    steps.append((i, k, 1 << k, float(dx * (s << k)), float(dy * (s << k)), float((s << k) * math.hypot(dx, dy))))
        reached = min(radius, 8 << k)
    return f"""p0 AS (SELECT 0 AS level, x, y, z * {scale} AS z FROM emb), p1 AS (SELECT 1 AS level, x // 2 AS x, y // 2 AS y, max(z) AS z FROM p0 GROUP BY 2, 3), p2 AS (SELECT 2 AS level, x // 2 AS x, y // 2 AS y, max(z) AS z FROM p1 GROUP BY 2, 3),
pyr AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2), {table('steps', ['dir', 'level', 'k', 'ox', 'oy', 'dist'], steps)},
look AS (SELECT x, y, z, dir, steps.level AS level, dist, CAST(floor((x + ox) / k + 0.5) AS INTEGER) AS px, CAST(floor((y + oy) / k + 0.5) AS INTEGER) AS py FROM p0 CROSS JOIN steps),
angles AS (SELECT look.x, look.y, dir, coalesce(atan(max((pyr.z - look.z) / dist)), {num(-math.pi / 2)}) AS angle FROM look LEFT JOIN pyr ON pyr.level = look.level AND pyr.x = px AND pyr.y = py GROUP BY 1, 2, 3)"""


def _slabs(cells: str) -> str:
    """Rays against all columns of a small raster: x, y, ray and the distance of each hit, as table `met`."""
    axis = lambda o, d, lo, hi: (f"CASE WHEN abs({d}) < 1e-9 THEN CASE WHEN {o} < {lo} OR {o} > {hi} THEN 1e300 ELSE -1e300 END ELSE least(({lo} - {o}) / {d}, ({hi} - {o}) / {d}) END", f"CASE WHEN abs({d}) < 1e-9 THEN CASE WHEN {o} < {lo} OR {o} > {hi} THEN -1e300 ELSE 1e300 END ELSE greatest(({lo} - {o}) / {d}, ({hi} - {o}) / {d}) END")
    near_far = [axis("ex", "dx", "b.x - 0.5", "b.x + 0.5"), axis("ey", "dy", "b.y - 0.5", "b.y + 0.5"), axis("ez", "dz", "least(0.0, b.z)", "greatest(0.0, b.z)")]
    return f"""{table('rays', ['ray', 'dx', 'dy', 'dz'], [(i, *map(float, r)) for i, r in enumerate(q.RAYS)])}, cells AS ({cells}),
go AS (SELECT x, y, z, ray, dx, dy, dz, x + dx * 1e-6 AS ex, y + dy * 1e-6 AS ey, z + dz * 1e-6 AS ez FROM cells CROSS JOIN rays WHERE z IS NOT NULL),
slab AS (SELECT go.x, go.y, ray, greatest({', '.join(a for a, _ in near_far)}) AS t0, least({', '.join(b for _, b in near_far)}) AS t1 FROM go JOIN cells b ON b.z IS NOT NULL AND (b.x <> go.x OR b.y <> go.y)),
met AS (SELECT x, y, ray, CASE WHEN t0 > 1e-9 THEN t0 ELSE t1 END AS d FROM slab WHERE t0 <= t1 AND t1 > 1e-6)"""


def _mixed(name: str, source: str, given: str, keep: str) -> str:
    """Tables that end in `name`: the kept columns of a source and h, its 64-bit mix of column `given`; products are taken in 128 bits."""
    wide = lambda v, sign, by: f"CAST((CAST({v} AS UHUGEINT) {sign} CAST('{by}' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"
    steps, last = [f"{name}_0 AS (SELECT {keep}, {wide(given, '+', 0x9E3779B97F4A7C15)} AS h FROM {source})"], f"{name}_0"
    for i, (bits, by) in enumerate(((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)), 1):
        steps.append(f"{name}_{i} AS (SELECT {keep}, {wide(f'xor(h, h // {1 << bits})', '*', by)} AS h FROM {last})")
        last = f"{name}_{i}"
    return ", ".join([*steps, f"{name} AS (SELECT {keep}, xor(h, h // {1 << 31}) AS h FROM {last})"])


def _drawn(name: str, source: str, salts: tuple[int, int], keep: str) -> str:
    """`name`: rows of a source (tile, pixel, ray, …) with two numbers u0 and u1 from 0 to 1 that its cell, ray and a salt each give."""
    seeds = f"""{name}_s AS (SELECT s.*, k.salt, xor(xor(xor(xor(CAST(1423 AS UBIGINT), a.h), b.h), c.h), k.h) AS seed FROM {source} s JOIN parts a ON a.kind = 't' AND a.n = s.tile JOIN parts b ON b.kind = 'p' AND b.n = s.pixel JOIN parts c ON c.kind = 'r' AND c.n = s.ray JOIN salts k ON k.salt IN {salts})"""
    number = "max(CASE WHEN salt = {0} THEN greatest(CAST(h // 2048 AS DOUBLE) * pow(2.0, -53), pow(2.0, -53) * CASE WHEN h // 2048 = 0 THEN 2 ELSE 0 END) END)"
    return f"{seeds}, {_mixed(f'{name}_m', f'{name}_s', 'seed', f'{keep}, salt')}, {name} AS (SELECT {keep}, {number.format(salts[0])} AS u0, {number.format(salts[1])} AS u1 FROM {name}_m GROUP BY {keep})"


def occlusion(light, side: int, tile: int, buffer: int, exaggeration: float) -> str:
    """Light of every ray of the small raster: the ray against all columns of its tile's buffered window at once, where the operator walks; bounces one after another."""
    each, across, edge = light.rays // 16, -(-side // tile), math.radians(light.diameter) / 2
    sun = [math.cos(math.radians(light.elevation)) * math.sin(math.radians(light.azimuth)), -math.cos(math.radians(light.elevation)) * math.cos(math.radians(light.azimuth)), math.sin(math.radians(light.elevation))]
    salts = [0, 1, *(s + 2 * b for b in range(light.bounces) for s in (100, 101))]
    counts = f"(SELECT 't' AS kind, unnest(range({across * across})) AS n, 11400714819323198485 AS c UNION ALL SELECT 'p', unnest(range({tile * tile})), 14029467366897019727 UNION ALL SELECT 'r', unnest(range({light.rays})), 1609587929392839161)"
    shifted = "CAST((CAST(n AS UHUGEINT) + CAST(c AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"
    sql = [
        shipping(side), f"cells AS (SELECT x, y, z * {exaggeration} AS z, y // {tile} * {across} + x // {tile} AS tile, y % {tile} * {tile} + x % {tile} AS pixel FROM ship WHERE z IS NOT NULL)",
        f"named AS (SELECT kind, n, {shifted} AS v FROM {counts})", _mixed("parts", "named", "v", "kind, n"), f"listed AS (SELECT CAST(unnest({salts}) AS UBIGINT) AS salt)", _mixed("salts", "listed", "salt", "salt"),
        f"asked AS (SELECT x, y, z, tile, pixel, CAST(unnest(range({light.rays})) AS BIGINT) AS ray FROM cells)", _drawn("first", "asked", (0, 1), "x, y, z, tile, pixel, ray"),
        f"turned AS (SELECT *, (least(15, ray // {each}) + u1) / 16 * {2 * math.pi!r} AS phi, pow((ray % {each} + u0) / {each}, {light.bias}) AS theta FROM first)",
        "way AS (SELECT *, sqrt(greatest(0.0, 1 - theta)) * cos(phi) AS dx, sqrt(greatest(0.0, 1 - theta)) * sin(phi) AS dy, sqrt(theta) AS dz FROM turned)",
        "go0 AS (SELECT x, y, tile, pixel, ray, dx, dy, dz, x + dx * 1e-6 AS ex, y + dy * 1e-6 AS ey, z + dz * 1e-6 AS ez, x AS own_x, y AS own_y FROM way)",
    ]
    span = lambda o, d, lo, hi: (f"CASE WHEN {d} = 0 THEN CASE WHEN {o} BETWEEN {lo} AND {hi} THEN -1e300 ELSE 1e300 END ELSE least(({lo} - {o}) / {d}, ({hi} - {o}) / {d}) END", f"CASE WHEN {d} = 0 THEN CASE WHEN {o} BETWEEN {lo} AND {hi} THEN 1e300 ELSE -1e300 END ELSE greatest(({lo} - {o}) / {d}, ({hi} - {o}) / {d}) END")
    sides = [span("g.ex", "g.dx", "b.x - 0.5", "b.x + 0.5"), span("g.ey", "g.dy", "b.y - 0.5", "b.y + 0.5"), span("g.ez", "g.dz", "least(0.0, b.z)", "greatest(0.0, b.z)")]
    within = " AND ".join(f"b.{v} BETWEEN g.tile {op} {across} * {tile} - {buffer} AND g.tile {op} {across} * {tile} + {tile + buffer - 1}" for v, op in (("x", "%"), ("y", "//")))
    gaps = ["abs(px - (bx - 0.5))", "abs(px - (bx + 0.5))", "abs(py - (byy - 0.5))", "abs(py - (byy + 0.5))", "abs(pz)", "abs(pz - greatest(0.0, bz))"]
    face = lambda *n: "CASE " + " ".join(f"WHEN gap = {g} THEN {v}.0" for g, v in zip(gaps, n)) + " END"
    for b in range(light.bounces + 1):
        sql += [
            f"slab{b} AS (SELECT g.tile, g.pixel, g.ray, b.x AS bx, b.y AS byy, b.z AS bz, greatest(0.0, {', '.join(lo for lo, _ in sides)}) AS t0, least({', '.join(hi for _, hi in sides)}) AS t1 FROM go{b} g JOIN cells b ON {within} AND (b.x <> g.own_x OR b.y <> g.own_y))",
            f"met{b} AS (SELECT tile, pixel, ray, min(d) AS d, arg_min(bx, d) AS bx, arg_min(byy, d) AS byy, arg_min(bz, d) AS bz FROM (SELECT *, CASE WHEN t0 > 1e-9 THEN t0 ELSE t1 END AS d FROM slab{b} WHERE t0 <= t1) WHERE d > 1e-6 GROUP BY 1, 2, 3)",
            f"all{b} AS (SELECT g.*, m.d, m.bx, m.byy, m.bz FROM go{b} g LEFT JOIN met{b} m USING (tile, pixel, ray))",
            f"light{b} AS (SELECT tile, pixel, ray, {light.sky} + {light.sun} * CASE WHEN (dx * {num(sun[0])} + dy * {num(sun[1])} + dz * {num(sun[2])}) / sqrt(dx * dx + dy * dy + dz * dz) >= {num(math.cos(edge))} THEN 1 ELSE 0 END AS v FROM all{b} WHERE d IS NULL)",
        ]
        if b < light.bounces:
            sql += [
                f"hit{b} AS (SELECT *, least({', '.join(gaps)}) AS gap FROM (SELECT x, y, tile, pixel, ray, bx, byy, bz, ex + dx * d AS px, ey + dy * d AS py, ez + dz * d AS pz FROM all{b} WHERE d IS NOT NULL))",
                f"face{b} AS (SELECT x, y, tile, pixel, ray, px, py, pz, {face(-1, 1, 0, 0, 0, 0)} AS nx, {face(0, 0, -1, 1, 0, 0)} AS ny, {face(0, 0, 0, 0, -1, 1)} AS nz FROM hit{b})",
                _drawn(f"next{b}", f"face{b}", (101 + 2 * b, 100 + 2 * b), "x, y, tile, pixel, ray, px, py, pz, nx, ny, nz"),
                f"local{b} AS (SELECT *, sqrt(greatest(0.0, 1 - u1)) * cos({2 * math.pi!r} * u0) AS lx, sqrt(greatest(0.0, 1 - u1)) * sin({2 * math.pi!r} * u0) AS ly, sqrt(u1) AS lz, CASE WHEN nz = 0 THEN -ny ELSE 0 END AS tx, CASE WHEN nz = 0 THEN nx ELSE -nz END AS ty FROM next{b})",
                f"aim{b} AS (SELECT *, tx * lx - nz * ty * ly + nx * lz AS dx, ty * lx + nz * tx * ly + ny * lz AS dy, (nx * ty - ny * tx) * ly + nz * lz AS dz FROM local{b})",
                f"go{b + 1} AS (SELECT x, y, tile, pixel, ray, dx, dy, dz, px + dx * 1e-6 AS ex, py + dy * 1e-6 AS ey, pz + dz * 1e-6 AS ez, -1 AS own_x, -1 AS own_y FROM aim{b})",
            ]
    lit = " UNION ALL ".join(f"SELECT * FROM light{b}" for b in range(light.bounces + 1))
    return f"WITH {', '.join(sql)}, lit AS ({lit}) SELECT c.x, c.y, {fix(f'coalesce(s.v, 0) / {light.rays} + {light.ambient}')} AS v FROM cells c LEFT JOIN (SELECT tile, pixel, sum(v) AS v FROM lit GROUP BY 1, 2) s USING (tile, pixel)"


def oracle_sql() -> dict[str, str]:
    hole = f"WITH {HOLE} "
    out = {
        "bbox_clip": hole + f", n AS (SELECT max(y) + 1 AS h FROM emb) SELECT x, y, {fix('z')} AS z FROM hole, n WHERE x BETWEEN 10 AND 50 AND y BETWEEN floor(h - 300.25) AND ceil(h - 20.5) - 1",
        "tile_plan": f"""WITH {EMB}, n AS (SELECT CAST(max(y) + 1 AS INTEGER) AS gh, CAST(max(x) + 1 AS INTEGER) AS gw FROM emb), w AS (SELECT gh, gw, 10 AS ax, 41 AS aw, CAST(floor(gh - 300.25) AS INTEGER) AS ay, CAST(ceil(gh - 20.5) - floor(gh - 300.25) AS INTEGER) AS ah FROM n),
t AS (SELECT w.*, CAST(c AS INTEGER) AS tile_col, CAST(r AS INTEGER) AS tile_row FROM w, generate_series(0, (aw + 15) // 16 - 1) AS a(c), generate_series(0, (ah + 15) // 16 - 1) AS b(r)),
u AS (SELECT *, ax + tile_col * 16 AS x, ay + tile_row * 16 AS y, least(16, aw - tile_col * 16) AS width, least(16, ah - tile_row * 16) AS height FROM t),
v AS (SELECT *, greatest(0, x - 3) AS bx, greatest(0, y - 5) AS by_, least(gw, x + width + 3) AS ex, least(gh, y + height + 5) AS ey FROM u)
SELECT CAST(tile_row * ((aw + 15) // 16) + tile_col AS INTEGER) AS tile_id, tile_col, tile_row, x, y, width, height, bx, by_ AS "by", ex - bx AS b_width, ey - by_ AS b_height, x - bx AS off_x, y - by_ AS off_y FROM v""",
        "tile_skip": hole + ", n AS (SELECT (max(x) + 3) // 3 AS c FROM emb) SELECT CAST(y // 3 * c + x // 3 AS INTEGER) AS tile_id, count(z) AS valid FROM hole, n GROUP BY 1 HAVING count(z) > 7",
        "start_tile": hole + f", n AS (SELECT (max(x) + 16) // 16 AS c FROM emb), t AS (SELECT y // 16 * c + x // 16 AS t, x, y, z FROM hole, n) SELECT x, y, {fix('z')} AS z FROM t WHERE t >= 5 AND t IN (SELECT t FROM t GROUP BY t HAVING count(z) > 0)",
        "slope": f"WITH {HOLE}, {near('hole')} SELECT x, y, {fix('degrees(slope)')} AS v FROM terrain",
        "aspect": f"WITH {EMB}, {near('emb')} SELECT x, y, {fix('aspect')} AS v FROM terrain",
        "hillshade": f"WITH {EMB}, {near('emb', 0.05)} SELECT x, y, {fix(shade(315, 35))} AS v FROM terrain",
        "multi_hillshade": f"WITH {EMB}, {near('emb', 0.05)} SELECT x, y, {', '.join(f'{fix(shade(90.0 * i, 35))} AS b{i}' for i in range(4))} FROM terrain",
        "slrm": f"WITH {HOLE}, {boxes('hole', [5])} SELECT x, y, {fix('CASE WHEN c5 > 0 THEN z - s5 / c5 END')} AS v FROM box",
        "msrm": f"WITH {HOLE}, {boxes('hole', [0, 16])} SELECT x, y, {fix('(CASE WHEN c0 > 0 THEN s0 / c0 END - CASE WHEN c16 > 0 THEN s16 / c16 END) / 4')} AS v FROM box",
        "svf": f"WITH {EMB}, {sky()} SELECT x, y, {fix('svf')} AS v FROM sky",
        "svf_hole": f"WITH {HOLE}, {sky('hole')} SELECT x, y, {fix('svf')} AS v FROM sky",
        "svf_noise": f"WITH {EMB}, {sky(noise=3)} SELECT x, y, {fix('svf')} AS v FROM sky",
        "asvf": f"WITH {EMB}, {sky()} SELECT x, y, {fix('asvf')} AS v FROM sky",
        "openness_pos": f"WITH {EMB}, {sky()} SELECT x, y, {fix('openness')} AS v FROM sky",
        "openness_neg": f"WITH {EMB}, {sky(sign=-1)} SELECT x, y, {fix('openness')} AS v FROM sky",
        "sky_uniform": illumination("uniform"),
        "sky_overcast": illumination("overcast"),
        "sky_shadow": illumination("overcast", (315.0, 85.0)),
        "local_dominance": dominance(),
        "vat_general": f"WITH {EMB}, {vat_single(vat.GENERAL, 'g')} SELECT x, y, {fix('v')} AS v FROM g",
        "vat_flat": f"WITH {EMB}, {vat_single(vat.FLAT, 'g')} SELECT x, y, {fix('v')} AS v FROM g",
        "vat_combined": f"WITH {EMB}, {vat_single(vat.GENERAL, 'g')}, {vat_single(vat.FLAT, 'k')} SELECT g.x, g.y, {fix('g.v * 0.5 + k.v * (1 - 0.5)')} AS v FROM g JOIN k ON g.x = k.x AND g.y = k.y",
        "stretch_value": f"WITH {shipping()} SELECT x, y, {fix(f'CASE WHEN z IS NOT NULL THEN {stretched("z", 40.0, 49.5)} END')} AS v FROM ship",
        "stretch_percent": f"""WITH {shipping()}, t AS (SELECT x, y, z, y // 16 * 4 + x // 16 AS t FROM ship), p AS (SELECT t, quantile_cont(z, 0.05) AS a, quantile_cont(z, 0.9) AS b, min(z) AS c, max(z) AS d FROM t GROUP BY t), k AS (SELECT t, CASE WHEN coalesce(a >= b, true) THEN c ELSE a END AS low, CASE WHEN coalesce(a >= b, true) THEN d ELSE b END AS high FROM p)
SELECT x, y, {fix('CASE WHEN z IS NOT NULL THEN (greatest(low, least(high, z)) - low) / CASE WHEN high - low = 0 THEN 1.0 ELSE high - low END END')} AS v FROM t JOIN k USING (t)""",
        "byte_encode": f"WITH {shipping()} SELECT x, y, CAST(CASE WHEN z IS NULL THEN 0 ELSE floor(greatest(0.0, least(1.0, z / 50)) * 255 + 0.5) END AS INTEGER) AS v FROM ship",
        "part_slope": f"WITH part_r AS (SELECT CAST(p_partkey % 40 AS INTEGER) AS x, CAST(p_partkey // 40 AS INTEGER) AS y, p_retailprice AS z FROM part), {near('part_r')} SELECT x, y, {fix('degrees(slope)')} AS v FROM terrain",
        "ramp_legacy": composed([q.BASE]),
        "ramp_stops": composed([Layer("z", q.RAMP)], True),
        "compose_alpha": composed([q.VEIL], True),
        "align_max": hole + f"SELECT CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, {fix('max(z)')} AS z FROM hole GROUP BY 1, 2",
        "align_nearest": hole + f"SELECT CAST((x - 1) // 2 AS INTEGER) AS x, CAST((y - 1) // 2 AS INTEGER) AS y, {fix('z')} AS z FROM hole WHERE x % 2 = 1 AND y % 2 = 1",
        "align_bilinear": f"WITH {EMB}, n AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM emb) SELECT CAST((b.x - 1) // 2 AS INTEGER) AS x, CAST(b.y // 2 AS INTEGER) AS y, {fix('avg(b.z)')} AS z FROM (SELECT x, y, z FROM emb UNION ALL SELECT x, y, z FROM emb) b, n WHERE false GROUP BY 1, 2",
        "horizon_pyramid": hole + f", a AS (SELECT x // 2 AS x, y // 2 AS y, max(z) AS z FROM hole GROUP BY 1, 2), b AS (SELECT x // 2 AS x, y // 2 AS y, max(z) AS z FROM a GROUP BY 1, 2) SELECT 0 AS level, x, y, {fix('z')} AS z FROM hole UNION ALL SELECT 1, x, y, {fix('z')} FROM a UNION ALL SELECT 2, x, y, {fix('z')} FROM b",
        "geotiff_single": f"WITH {HOLE} SELECT x, y, {fix('CAST(CAST(z AS FLOAT) AS DOUBLE)')} AS z FROM hole",
        "geotiff_tiles": f"WITH {HOLE} SELECT x, y, {fix('CAST(CAST(z AS FLOAT) AS DOUBLE)')} AS z FROM hole",
        "geotiff_bbox": f"WITH {HOLE}, size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM hole) SELECT x, y, {fix('CAST(CAST(z AS FLOAT) AS DOUBLE)')} AS z FROM hole, size WHERE x + 1 > {q.BOX.min_x} AND x < {q.BOX.max_x} AND h - y > {q.BOX.min_y} AND h - y - 1 < {q.BOX.max_y}",
        "geotiff_metadata": f"WITH {HOLE} SELECT 'EPSG:2056' AS crs, max(x) + 1 AS width, max(y) + 1 AS height, CAST(0 AS DOUBLE) AS min_x, CAST(0 AS DOUBLE) AS min_y, CAST(max(x) + 1 AS DOUBLE) AS max_x, CAST(max(y) + 1 AS DOUBLE) AS max_y, CAST(1 AS DOUBLE) AS res_x, CAST(1 AS DOUBLE) AS res_y, CAST(-9999 AS DOUBLE) AS nodata FROM hole",
        "geotiff_slope": f"WITH {HOLE}, single AS (SELECT x, y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM hole), {near('single')}, size AS (SELECT max(y) + 1 AS h FROM hole) SELECT t.x, t.y, {fix('degrees(slope)')} AS v FROM terrain AS t, size WHERE t.x + 1 > {q.BOX.min_x} AND t.x < {q.BOX.max_x} AND h - t.y > {q.BOX.min_y} AND h - t.y - 1 < {q.BOX.max_y}",
        "horizon_diffuse": f"WITH {EMB}, {horizons(1.0)} SELECT x, y, {fix('avg(least(1.0, greatest(0.0, 1 - pow(sin(greatest(angle, 0.0)), 2.0))))')} AS v FROM angles GROUP BY 1, 2",
        "anyhit_fixed_rays": f"WITH {shipping(16)}, {_slabs('SELECT x, y, z * 0.2 AS z FROM ship')} SELECT x, y, CAST(coalesce(n, 0) AS INTEGER) AS hits FROM cells LEFT JOIN (SELECT x, y, count(DISTINCT ray) AS n FROM met GROUP BY 1, 2) USING (x, y) WHERE z IS NOT NULL",
        "nearest_hit_fixed_rays": f"WITH {shipping(16)}, {_slabs('SELECT x, y, CAST((x * 5 + y * 3) % 7 AS DOUBLE) AS z FROM ship')} SELECT x, y, ray, {fix('d')} AS d FROM go LEFT JOIN (SELECT x, y, ray, min(d) AS d FROM met GROUP BY 1, 2, 3) USING (x, y, ray)",
        "mosaic_roundtrip": f"WITH {EMB} SELECT x, y, {fix('z')} AS v FROM emb",
    }
    for mode in ("normal", "multiply", "screen", "softlight"):
        out[f"compose_{mode}"] = composed([q.BASE, Layer("w", q.VEIL.stops, mode, 0.7)])
    scales = {"red": range(50, 501, 50), "green": range(5, 51, 5), "blue": range(1, 6)}
    dev = lambda r: f"abs((z - s{r} / c{r}) / (sqrt(greatest(0.0, q{r} / c{r} - (s{r} / c{r}) * (s{r} / c{r}))) + 1e-6))"
    radii = sorted({r for s in scales.values() for r in s})
    bands = ", ".join(f"{fix(f'CASE WHEN z IS NOT NULL THEN greatest(0.0, least(1.0, 1 - exp(-0.9 * greatest({", ".join(map(dev, s))})))) END')} AS {n}" for n, s in scales.items())
    out["asvf_strong"] = f"WITH {EMB}, {sky(power=8, least=0.1)} SELECT x, y, {fix('asvf')} AS v FROM sky"
    out["product_bytes"] = f"WITH {HOLE}, {near('hole')} SELECT x, y, CAST(CASE WHEN slope IS NULL THEN 0 ELSE floor(greatest(0.0, least(1.0, degrees(slope) / 51)) * 255 + 0.5) END AS INTEGER) AS v FROM terrain"
    out["geotiff_bytes"] = f"WITH {shipping()} SELECT x, y, CAST(CASE WHEN z IS NULL THEN 0 ELSE floor(greatest(0.0, least(1.0, z / 50)) * 255 + 0.5) END AS DOUBLE) AS z FROM ship"
    out["render_files"] = out["compose_multiply"]
    out["occlusion_exact"] = occlusion(Lighting(rays=64, sun=0.3, azimuth=180.0, elevation=35.0), 16, 8, 4, 0.2)
    out["occlusion_bounces"] = occlusion(Lighting(rays=32, bounces=2), 16, 8, 4, 0.2)
    out["geotiff_big"], out["geotiff_filter"] = out["geotiff_single"], out["geotiff_bbox"]
    out["mstp"] = f"WITH {HOLE}, {boxes('hole', radii)} SELECT x, y, {bands} FROM box"
    # Grid of 2 units, shifted by half a cell: centres lie on the middle of a column pair and on the border of two rows.
    out["align_bilinear"] = f"WITH {EMB}, n AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM emb) SELECT CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, {fix('sum(z * 0.5)')} AS z FROM emb, n WHERE x % 2 = 1 AND x // 2 < w // 2 - 1 GROUP BY 1, 2"
    out["align_overlap"] = hole + f", n AS (SELECT max(y) + 1 AS h FROM emb), k AS (SELECT CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y FROM n, generate_series(0, 39) AS s(a), generate_series(0, h // 2 + 7) AS t(b)), m AS (SELECT x // 2 + 2 AS x, y // 2 + 3 AS y, max(z) AS z FROM hole GROUP BY 1, 2) SELECT k.x, k.y, {fix('m.z')} AS z FROM k LEFT JOIN m ON m.x = k.x AND m.y = k.y"
    s = q.SUN
    low, part = math.floor(s.azimuth / 22.5) % 16, s.azimuth / 22.5 - math.floor(s.azimuth / 22.5)
    below, above = s.elevation - s.diameter / 2, s.elevation + s.diameter / 2
    out["horizon_sun"] = f"""WITH {EMB}, {horizons(0.05)}, g AS (SELECT x, y, avg(least(1.0, greatest(0.0, 1 - pow(sin(greatest(angle, 0.0)), 2.0)))) AS diffuse, max(CASE WHEN dir = {low} THEN angle END) AS a, max(CASE WHEN dir = {(low + 1) % 16} THEN angle END) AS b FROM angles GROUP BY 1, 2),
e AS (SELECT x, y, diffuse, degrees(a + (b - a) * {num(part)}) AS edge FROM g), h AS (SELECT x, y, diffuse, CASE WHEN edge <= {below} THEN 1.0 WHEN edge >= {above} THEN 0.0 ELSE ({num(above)} - edge) / {num(above - below)} END AS sun FROM e)
SELECT x, y, {fix('sun')} AS sun, {fix(f'{s.ambient} + {s.sky} * diffuse + {s.sun} * sun')} AS v FROM h"""
    return out
