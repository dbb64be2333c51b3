"""Shapes in tile coordinates: measures as expressions; clipping, rings and triangles in numpy, batch by batch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(points: str | Column) -> Column:
    """Length of an array of points (x, y)."""
    p = F.col(points) if isinstance(points, str) else points
    step = lambda i: F.sqrt(F.pow(F.get(p, i + 1)["x"] - F.get(p, i)["x"], 2) + F.pow(F.get(p, i + 1)["y"] - F.get(p, i)["y"], 2))
    return F.when(F.size(p) < 2, 0.0).otherwise(F.aggregate(F.transform(F.sequence(F.lit(0), F.size(p) - 2), step), F.lit(0.0), lambda a, x: a + x))


def signed_area(points: str | Column) -> Column:
    """Half the shoelace sum of a ring that closes by itself."""
    p = F.col(points) if isinstance(points, str) else points
    after = lambda i: F.get(p, (i + 1) % F.size(p))
    cross = lambda q, i: q["x"] * after(i)["y"] - after(i)["x"] * q["y"]
    return F.when(F.size(p) < 3, 0.0).otherwise(F.aggregate(F.transform(p, cross), F.lit(0.0), lambda a, x: a + x) / 2)


# --- shapes as lists of (x, y), one at a time ---------------------------------------

Point = tuple[float, float]
Ring = list[Point]


def clip_ring(ring: Ring, low: float, high: float) -> Ring:
    """A ring cut to a square, side by side; what lies on a side is outside of it."""
    for axis, bound, sign in ((0, low, 1), (0, high, -1), (1, low, 1), (1, high, -1)):
        out: Ring = []
        for a, b in zip([*ring[-1:], *ring[:-1]], ring, strict=True):
            ins = [sign * (p[axis] - bound) > 0 for p in (a, b)]
            if ins[0] != ins[1]:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cross = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                cross[axis] = bound
                out.append((cross[0], cross[1]))
            if ins[1]:
                out.append(b)
        ring = out
        if not ring:
            return []
    return ring


def clip_line(line: list[Point], low: float, high: float, slack: float = 1e-4) -> list[tuple[list[Point], bool, bool]]:
    """Pieces of a line inside a square, and whether each was cut at its start and at its end."""
    pieces: list[tuple[list[Point], bool, bool]] = []
    for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
        t0, t1, ok = 0.0, 1.0, True
        for p, q in ((x0 - x1, x0 - low), (x1 - x0, high - x0), (y0 - y1, y0 - low), (y1 - y0, high - y0)):
            if p == 0:
                ok &= q >= 0
            elif p < 0:
                t0 = max(t0, q / p)
            else:
                t1 = min(t1, q / p)
        if not ok or t0 > t1 or (t0 == t1 and (x0, y0) != (x1, y1)):
            continue
        a, b = ((x0 + t * (x1 - x0), y0 + t * (y1 - y0)) for t in (t0, t1))
        joined = pieces and not pieces[-1][2] and t0 == 0 and abs(pieces[-1][0][-1][0] - a[0]) <= slack and abs(pieces[-1][0][-1][1] - a[1]) <= slack
        if joined:
            pieces[-1] = ([*pieces[-1][0], b], pieces[-1][1], t1 < 1)
        else:
            pieces.append(([a, b], t0 > 0, t1 < 1))
    return pieces


def inside(ring: Ring, p: Point, edge: float | None = 1e-3) -> bool:
    """Whether a point lies in a ring; within ``edge`` of its line it does, or doesn't if ``edge`` is None."""
    x, y = p
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
        if edge is not None:
            dx, dy = x1 - x0, y1 - y0
            n = dx * dx + dy * dy
            t = 0.0 if n == 0 else min(1.0, max(0.0, ((x - x0) * dx + (y - y0) * dy) / n))
            if (x0 + t * dx - x) ** 2 + (y0 + t * dy - y) ** 2 <= edge * edge:
                return True
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def canonical_ring(ring: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The least of all rotations of a ring in both directions: equal for equal shapes. A closing point is left out."""
    if len(ring) > 1 and ring[0] == ring[-1]:
        ring = ring[:-1]
    if not ring:
        return []
    best = None
    for way in (ring, ring[::-1]):
        low = min(way)
        for i in (k for k, p in enumerate(way) if p == low):
            turned = way[i:] + way[:i]
            best = turned if best is None or turned < best else best
    return best


def area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True)) / 2


def is_convex(ring: Ring) -> bool:
    turns = set()
    for a, b, c in zip(ring, [*ring[1:], *ring[:1]], [*ring[2:], *ring[:2]], strict=True):
        turn = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
        if turn:
            turns.add(turn > 0)
    return len(turns) < 2


def _bridged(ring: Ring, holes: list[Ring]) -> Ring:
    """One ring that runs into each hole and back, holes from the right first."""
    for hole in sorted(holes, key=lambda h: -max(p[0] for p in h)):
        i = max(range(len(hole)), key=lambda k: hole[k])
        p = hole[i]
        loop = hole[i:] + hole[: i + 1]
        # the visible corner: of all corners, the nearest whose line to the hole crosses no edge
        # (one that carries no bridge yet: there, which side of it to leave from would be open)
        rank = sorted((k for k in range(len(ring)) if ring.count(ring[k]) == 1), key=lambda k: (ring[k][0] - p[0]) ** 2 + (ring[k][1] - p[1]) ** 2)
        edges = list(zip(ring, [*ring[1:], *ring[:1]], strict=True)) + [e for h in holes for e in zip(h, [*h[1:], *h[:1]], strict=True)]
        k = next((k for k in rank if not any(_cross(p, ring[k], a, b) for a, b in edges)), rank[0])
        ring = [*ring[: k + 1], *loop, *ring[k:]]
    return ring


def _side(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _cross(p: Point, q: Point, a: Point, b: Point) -> bool:
    return _side(p, q, a) * _side(p, q, b) < 0 and _side(a, b, p) * _side(a, b, q) < 0


def triangles(ring: Ring, holes: list[Ring] = ()) -> list[tuple[Point, Point, Point]]:
    """A polygon as triangles: a fan if it is convex and whole, else ear by ear."""
    if len(ring) < 3:
        return []
    if not holes and is_convex(ring):
        return [(ring[0], b, c) for b, c in zip(ring[1:], ring[2:], strict=False)]
    ring = ring if area(ring) > 0 else ring[::-1]
    rest = list(_bridged(ring, [h if area(h) < 0 else h[::-1] for h in holes if len(h) > 2]))
    out = []
    i = missed = 0
    while len(rest) > 2 and missed <= len(rest):
        a, b, c = rest[i - 1], rest[i], rest[(i + 1) % len(rest)]
        turn = _side(a, b, c)
        ear = turn > 0 and not any(p not in (a, b, c) and _side(a, b, p) >= 0 and _side(b, c, p) >= 0 and _side(c, a, p) >= 0 for p in rest)
        if turn == 0 or ear:
            if ear:
                out.append((a, b, c))
            del rest[i]
            missed = 0
            i = max(0, i - 1) % max(1, len(rest))
        else:
            missed += 1
            i = (i + 1) % len(rest)
    return out


def deviation(ring: Ring, holes: list[Ring], parts: list) -> float:
    """How far the triangles' area is from the polygon's, as a share of it."""
    whole = abs(area(ring)) - sum(abs(area(h)) for h in holes)
    return 0.0 if not whole and not parts else abs(sum(abs(area(list(t))) for t in parts) - whole) / max(whole, 1e-12)


def line_length(line: list[Point]) -> float:
    return sum(((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 for a, b in zip(line, line[1:], strict=False))


def dashes(line: list[Point], dash: float, gap: float) -> list[list[Point]]:
    """Dashes along a line, carried on over its corners."""
    out, on, left = [], True, dash
    held = [line[0]] if line else []
    for a, b in zip(line, line[1:], strict=False):
        n, at = line_length([a, b]), 0.0
        while n - at > left:
            at += left
            p = (a[0] + (b[0] - a[0]) * at / n, a[1] + (b[1] - a[1]) * at / n)
            if on:
                out.append([*held, p])
            on, held, left = not on, [p], gap if on else dash
        left -= n - at
        held.append(b)
    if on and len(held) > 1:
        out.append(held)
    return out


def split_at(line: list[Point], junctions: set[Point]) -> list[tuple[list[Point], float]]:
    """Pieces of a line between inner points that are junctions, and where along the line each begins."""
    out, held, at = [], line[:1], 0.0
    for p, q in zip(line, line[1:], strict=False):
        held.append(q)
        if q in junctions and q is not line[-1]:
            out.append((held, at))
            at += line_length(held)
            held = [q]
    if len(held) > 1:
        out.append((held, at))
    return out


def stitched(lines: list[tuple[str | None, list[Point]]], drives: list[bool] | None = None) -> list[tuple[str | None, list[Point]]]:
    """Lines (street, points) joined end to end: at a point where two ends of one street meet and no other road for
    cars ends, of whatever street or none. Lines without a street stay as they are; ``drives`` tells roads for cars."""
    ends: dict = {}
    roads: dict = {}
    for i, (street, line) in enumerate(lines):
        for end in (0, -1):
            if street is not None:
                ends.setdefault((street, line[end]), []).append((i, end))
            if drives is None or drives[i]:
                roads.setdefault(line[end], set()).add(i)
    joins = {k: v for k, v in ends.items() if len(v) == 2 and v[0][0] != v[1][0] and len(roads.get(k[1], ())) == 2}
    used, out = set(), []
    for i, (street, line) in enumerate(lines):
        if i in used:
            continue
        used.add(i)
        run = list(line)
        for forward in (True, False):
            while True:
                meet = joins.get((street, run[-1] if forward else run[0]))
                step = next(((j, e) for j, e in meet or () if j not in used), None)
                if not step:
                    break
                j, e = step
                used.add(j)
                more = lines[j][1] if (e == 0) == forward else lines[j][1][::-1]
                run = run + more[1:] if forward else more[:-1] + run
        out.append((street, run))
    return out


def anchors(line: list[Point], width: float, spacing: float = 800.0, most: int = 7) -> list[float]:
    """Where along a line labels of a width are set: in the middle of a line up to the spacing, however short; else
    from half the spacing (or half the label) on, every spacing, as many as fit and ``most`` at most."""
    total = line_length(line)
    if total <= 0 or width <= 0:
        return []
    half = min(width, total) / 2
    if total <= spacing:
        return [total / 2]
    first = max(spacing / 2, half)
    return [first + k * spacing for k in range(most) if first + k * spacing <= total - half]


def hull(points: list[Point]) -> list[Point]:
    """The convex hull, counter-clockwise from the least point."""
    ps = sorted(set(points))
    if len(ps) < 3:
        return ps

    def half(order: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in order:
            while len(out) > 1 and _side(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(ps) + half(ps[::-1])


def outermost(rings: list[Ring], heights: list[tuple[float, float]] | None = None) -> list[int]:
    """Places of the rings that no larger kept one holds, as deep and as high: by area, largest first."""
    order = sorted(range(len(rings)), key=lambda i: (-abs(area(rings[i])), i))
    box = [(min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)) for r in rings]
    kept: list[int] = []

    def holds(k: int, i: int) -> bool:
        a, b = box[i], box[k]
        tall = heights is None or (heights[k][0] <= heights[i][0] and heights[k][1] >= heights[i][1])
        return tall and b[0] <= a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3] and all(inside(rings[k], p) for p in rings[i])

    for i in order:
        if not any(holds(k, i) for k in kept):
            kept.append(i)
    return sorted(kept)


def outside(line: list[Point], areas: list[Ring]) -> list[list[Point]]:
    """Pieces of a line that lie in none of the areas: segments are cut where they cross edges, and a part counts by its middle."""
    out: list[list[Point]] = []
    for p, q in zip(line, line[1:], strict=False):
        cuts = {0.0, 1.0}
        for ring in areas:
            for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True):
                ex, ey, fx, fy = q[0] - p[0], q[1] - p[1], b[0] - a[0], b[1] - a[1]
                cross = ex * fy - ey * fx
                if cross:
                    t, u = ((a[0] - p[0]) * fy - (a[1] - p[1]) * fx) / cross, ((a[0] - p[0]) * ey - (a[1] - p[1]) * ex) / cross
                    if 0 < t < 1 and 0 <= u <= 1:
                        cuts.add(t)
        at = lambda t, p=p, q=q: (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))
        steps = sorted(cuts)
        for a, b in zip(steps, steps[1:], strict=False):
            if not any(inside(r, at((a + b) / 2), None) for r in areas):
                start, end = (p if a == 0 else at(a)), (q if b == 1 else at(b))
                if out and out[-1][-1] == start:
                    out[-1].append(end)
                else:
                    out.append([start, end])
    return out


def offset(line: list[Point], by: float, most: float = 2.0) -> list[Point]:
    """A line moved to its left; at corners by the miter, ``most`` times the distance at most."""
    normals = []
    for (x0, y0), (x1, y1) in zip(line, line[1:], strict=False):
        n = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        if n:
            normals.append(((y0 - y1) / n, (x1 - x0) / n))
    if len(normals) != len(line) - 1 or not normals:
        return []
    out = []
    for p, a, b in zip(line, [normals[0], *normals], [*normals, normals[-1]], strict=True):
        mx, my = a[0] + b[0], a[1] + b[1]
        n = (mx * mx + my * my) ** 0.5
        scale = 1.0 if not n else min(most, 2 / n)
        ux, uy = (a if not n else (mx / n, my / n))
        out.append((p[0] + by * scale * ux, p[1] + by * scale * uy))
    return out


def inset(line: list[Point], start: float, end: float) -> list[Point] | None:
    """A line without its first and last bit; None if that leaves nothing."""
    total = line_length(line)
    if total <= start + end:
        return None
    out, at = [], 0.0
    for p, q in zip(line, line[1:], strict=False):
        n = line_length([p, q])
        for mark in (start, total - end):
            if at <= mark <= at + n and n:
                c = (p[0] + (q[0] - p[0]) * (mark - at) / n, p[1] + (q[1] - p[1]) * (mark - at) / n)
                if not out or out[-1] != c:
                    out.append(c)
        at += n
        if start < at < total - end and out and out[-1] != q:
            out.append(q)
    return out


def merged(lines: list[list[Point]]) -> list[list[Point]]:
    """Lines of one name joined into long ones: the longest first, grown at its tail, then at its head, by the longest that touches."""
    left = sorted(range(len(lines)), key=lambda i: (-line_length(lines[i]), i))
    out = []
    while left:
        run = list(lines[left.pop(0)])
        for tail in (True, False):
            while True:
                end = run[-1] if tail else run[0]
                i = next((i for i in left if end in (lines[i][0], lines[i][-1])), None)
                if i is None:
                    break
                left.remove(i)
                more = lines[i] if (lines[i][0] == end) == tail else lines[i][::-1]
                run = run + more[1:] if tail else more[:-1] + run
        out.append(run)
    return out
