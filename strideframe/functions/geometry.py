"""Geometry as Column expressions; nothing here leaves the JVM.

A Point is a pair of columns that are both NULL where the point is absent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strideframe.functions import skeleton as sk

USABLE, MIN_HEIGHT_PX = 0.2, 20.0
GOAL_WIDTH_M, GOAL_HEIGHT_M, GOAL_AREA_M = 7.32, 2.44, 5.5
#: Width and height of a goal in metres; functions that measure by a goal take another size.
REGULAR = (GOAL_WIDTH_M, GOAL_HEIGHT_M)
#: Shares of stature: nose to shoulders, shoulders to hips, hips to knees, knees to ankles.
CHAIN = (0.12, 0.29, 0.245, 0.246)
#: Joints and their shares of body mass.
MASS = ((sk.L_SHOULDER, 0.15), (sk.R_SHOULDER, 0.15), (sk.L_HIP, 0.35), (sk.R_HIP, 0.35))
LENGTHS = 1.5


@dataclass(frozen=True)
class Point:
    x: Column
    y: Column

    @property
    def there(self) -> Column:
        return self.x.isNotNull()

    def minus(self, other: Point) -> Point:
        return Point(self.x - other.x, self.y - other.y)

    def dot(self, other: Point) -> Column:
        return self.x * other.x + self.y * other.y

    def distance(self, other: Point) -> Column:
        return F.hypot(self.x - other.x, self.y - other.y)

    def struct(self) -> Column:
        return F.when(self.there, F.struct(self.x.alias("x"), self.y.alias("y")))


def columns(x: str, y: str) -> Point:
    return Point(F.col(x), F.col(y))


def joint(kp: Column, index: int, min_conf: float = 0.0) -> Point:
    """The joint at an index, NULL if it is out of range, unsure or has no place."""
    k = F.get(kp, F.lit(index))
    ok = (k["conf"] >= min_conf) & k["x"].isNotNull() & k["y"].isNotNull()
    return Point(F.when(ok, k["x"]), F.when(ok, k["y"]))


def midpoint(a: Point, b: Point, both: bool = False) -> Point:
    """The middle, or, unless both are asked for, the one that is there."""
    mid = Point((a.x + b.x) / 2, (a.y + b.y) / 2)
    return mid if both else Point(F.coalesce(mid.x, a.x, b.x), F.coalesce(mid.y, a.y, b.y))


def mean_confidence(kp: Column) -> Column:
    known = F.filter(F.transform(kp, lambda k: k["conf"]), lambda c: c.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)).otherwise(0.0)


def visible(kp: Column, min_conf: float = 0.3) -> Column:
    return F.transform(kp, lambda k: F.coalesce((k["conf"] >= min_conf) & k["x"].isNotNull() & k["y"].isNotNull(), F.lit(False)))


def angle(a: Point, b: Point, c: Point) -> Column:
    """Degrees at b; NULL if a point is absent or a side has no length."""
    u, v = a.minus(b), c.minus(b)
    sides = F.hypot(u.x, u.y) * F.hypot(v.x, v.y)
    return F.when(sides > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u.dot(v) / sides)))))


def lean(low: Point, high: Point) -> Column:
    """Degrees of a segment from the vertical, positive to the right of the image."""
    dx, dy = high.x - low.x, low.y - high.y
    return F.when((dx != 0) | (dy != 0), F.degrees(F.atan2(dx, F.when(dy == 0, F.lit(1e-9)).otherwise(F.abs(dy)))))


def stature(kp: Column) -> Column:
    """Body height in pixels from the visible part of the chain nose, shoulders, hips, knees, ankles."""
    at = lambda i: joint(kp, i, USABLE)
    chain = [at(sk.NOSE), *(midpoint(at(a), at(b)) for a, b in ((sk.L_SHOULDER, sk.R_SHOULDER), (sk.L_HIP, sk.R_HIP), (sk.L_KNEE, sk.R_KNEE), (sk.L_ANKLE, sk.R_ANKLE)))]
    length, share = F.lit(0.0), F.lit(0.0)
    for a, b, part in zip(chain, chain[1:], CHAIN, strict=False):
        d = a.distance(b)
        length, share = length + F.coalesce(d, F.lit(0.0)), share + F.when(d.isNotNull(), F.lit(part)).otherwise(0.0)
    height = length / F.nullif(share, F.lit(0.0))
    return F.when(height >= MIN_HEIGHT_PX, height)


def centre_of_mass(kp: Column) -> Point:
    at = [(joint(kp, i, USABLE), w) for i, w in MASS]
    weight = sum((F.when(p.there, F.lit(w)).otherwise(0.0) for p, w in at), F.lit(0.0))
    total = lambda axis: sum((F.coalesce(getattr(p, axis) * w, F.lit(0.0)) for p, w in at), F.lit(0.0)) / F.nullif(weight, F.lit(0.0))
    return Point(total("x"), total("y"))


def feet(kp: Column) -> Point:
    return midpoint(joint(kp, sk.L_ANKLE, USABLE), joint(kp, sk.R_ANKLE, USABLE))


def by_height(value: Column, height: Column) -> Column:
    """value in body heights; NULL without a height."""
    return F.when(height > 0, value / height)


def metres_per_pixel(height: Column, stature_m: float = 1.80) -> Column:
    return F.when(height > 0, F.lit(stature_m) / height)


def root_relative(kp3d: Column) -> Column:
    """3D keypoints relative to the middle of the hips; unchanged if a hip is absent."""
    left, right = F.get(kp3d, F.lit(sk.L_HIP)), F.get(kp3d, F.lit(sk.R_HIP))
    root = {c: (left[c] + right[c]) / 2 for c in "xyz"}
    moved = F.transform(kp3d, lambda k: F.struct(*[(k[c] - root[c]).alias(c) for c in "xyz"]))
    return F.when(root["x"].isNotNull() & root["y"].isNotNull() & root["z"].isNotNull(), moved).otherwise(kp3d)


# Boxes: structs x1, y1, x2, y2.


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre(b: Column) -> Point:
    return Point((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2)


def intersection(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x1", "x2") * side("y1", "y2")


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller box that the other holds."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(0.0)


def affinity(a: Column, b: Column, reach: float = LENGTHS) -> Column:
    """1 at equal centres, falling to 0 at ``reach`` mean diagonals."""
    scale = (F.hypot(width(a), height(a)) + F.hypot(width(b), height(b))) / 2
    ratio = centre(a).distance(centre(b)) / F.nullif(scale, F.lit(0.0))
    return F.coalesce(F.when(ratio < reach, 1 - ratio / reach), F.lit(0.0))


def box_of(kp: Column, padding: float = 0.0) -> Column:
    """The box of the placed keypoints, widened on each side by a share of its size; all zero without any."""
    placed = F.filter(kp, lambda k: k["x"].isNotNull() & k["y"].isNotNull())
    values = {"x": F.transform(placed, lambda k: k["x"]), "y": F.transform(placed, lambda k: k["y"])}
    low, high = {c: F.array_min(v) for c, v in values.items()}, {c: F.array_max(v) for c, v in values.items()}
    pad = {c: (high[c] - low[c]) * padding for c in "xy"}
    some = F.size(placed) > 0
    edge = lambda v: F.when(some, v).otherwise(0.0)
    return F.struct(edge(low["x"] - pad["x"]).alias("x1"), edge(low["y"] - pad["y"]).alias("y1"), edge(high["x"] + pad["x"]).alias("x2"), edge(high["y"] + pad["y"]).alias("y2"), F.when(some, 1.0).otherwise(0.0).alias("score"))


def crop(b: Column, w: Column, h: Column, padding: float = 0.15) -> Column:
    """Whole-pixel rectangle of a padded box inside an image; no size where nothing is left."""
    px, py = width(b) * padding, height(b) * padding
    x1, y1 = F.greatest(F.lit(0), (b["x1"] - px).cast("int")), F.greatest(F.lit(0), (b["y1"] - py).cast("int"))
    x2, y2 = F.least(w, (b["x2"] + px).cast("int")), F.least(h, (b["y2"] + py).cast("int"))
    some = (x2 > x1) & (y2 > y1)
    return F.struct(*[F.when(some, v).otherwise(0).alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])


def torso_patch(kp: Column, w: Column, h: Column, inset: float = 0.2) -> Column:
    """Whole-pixel rectangle of shoulders and hips, inset on each side; NULL unless all four are there."""
    four = [joint(kp, i, USABLE) for i in (sk.L_SHOULDER, sk.R_SHOULDER, sk.L_HIP, sk.R_HIP)]
    xs, ys = [p.x for p in four], [p.y for p in four]
    all_there = four[0].there & four[1].there & four[2].there & four[3].there
    x1, x2, y1, y2 = F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)
    dx, dy = (x2 - x1) * inset, (y2 - y1) * inset
    left, right = F.greatest(F.lit(0), (x1 + dx).cast("int")), F.least(w, (x2 - dx).cast("int"))
    top, bottom = F.greatest(F.lit(0), (y1 + dy).cast("int")), F.least(h, (y2 - dy).cast("int"))
    return F.when(all_there & (right > left) & (bottom > top), F.struct(left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2")))


@dataclass(frozen=True)
class Goal:
    """Goal posts in pixels as columns lx, ly, rx, ry and, if known, crossbar_y; the left post has the smaller x."""

    lx: Column
    ly: Column
    rx: Column
    ry: Column
    bar: Column
    width_m: float = GOAL_WIDTH_M
    height_m: float = GOAL_HEIGHT_M

    @classmethod
    def of(cls, prefix: str = "", size: tuple[float, float] = REGULAR) -> Goal:
        c = lambda n: F.col(prefix + n)
        swap = c("lx") > c("rx")
        pick = lambda a, b: F.when(swap, c(b)).otherwise(c(a))
        return cls(pick("lx", "rx"), pick("ly", "ry"), pick("rx", "lx"), pick("ry", "ly"), c("crossbar_y"), *size)

    @property
    def width_px(self) -> Column:
        return F.hypot(self.rx - self.lx, self.ry - self.ly)

    @property
    def px_per_m(self) -> Column:
        """NULL where the posts coincide."""
        return F.nullif(self.width_px, F.lit(0.0)) / self.width_m

    @property
    def middle(self) -> Point:
        return Point((self.lx + self.rx) / 2, (self.ly + self.ry) / 2)

    @property
    def height_px(self) -> Column:
        return F.coalesce(F.abs(self.middle.y - self.bar), self.px_per_m * self.height_m)

    @property
    def consistency(self) -> Column:
        """Measured over expected crossbar height; NULL without a crossbar."""
        return F.abs(self.middle.y - self.bar) / (self.px_per_m * self.height_m)

    @property
    def direction(self) -> Point:
        w = F.nullif(self.width_px, F.lit(0.0))
        return Point((self.rx - self.lx) / w, (self.ry - self.ly) / w)

    @property
    def normal(self) -> Point:
        """Unit vector into the pitch: down the image."""
        d = self.direction
        flip = F.when(d.x > 0, 1.0).otherwise(-1.0)
        return Point(-d.y * flip, d.x * flip)

    def lateral_m(self, p: Point) -> Column:
        return p.minus(self.middle).dot(self.direction) / self.px_per_m

    def depth_m(self, p: Point) -> Column:
        return p.minus(self.middle).dot(self.normal) / self.px_per_m

    def coverage(self, p: Point) -> Column:
        return 0.5 + self.lateral_m(p) / self.width_m

    def in_area(self, p: Point) -> Column:
        depth = self.depth_m(p)
        return (F.abs(self.lateral_m(p)) <= self.width_m / 2 + GOAL_AREA_M) & (depth >= 0) & (depth <= GOAL_AREA_M)

    def in_mouth(self, p: Point) -> Column:
        return F.abs(self.lateral_m(p)) <= self.width_m / 2 + GOAL_AREA_M


def project(h: Column, p: Point) -> Point:
    """A point through a homography of nine values by rows; NULL at its horizon."""
    w = h[6] * p.x + h[7] * p.y + h[8]
    far = F.when(F.abs(w) > 1e-9, w)
    return Point((h[0] * p.x + h[1] * p.y + h[2]) / far, (h[3] * p.x + h[4] * p.y + h[5]) / far)


def inverse(h: Column) -> Column:
    """The inverse homography by cofactors; NULL if it is singular."""
    c = [h[4] * h[8] - h[5] * h[7], h[2] * h[7] - h[1] * h[8], h[1] * h[5] - h[2] * h[4], h[5] * h[6] - h[3] * h[8], h[0] * h[8] - h[2] * h[6], h[2] * h[3] - h[0] * h[5], h[3] * h[7] - h[4] * h[6], h[1] * h[6] - h[0] * h[7], h[0] * h[4] - h[1] * h[3]]
    det = F.nullif(h[0] * c[0] + h[1] * c[3] + h[2] * c[6], F.lit(0.0))
    return F.when(det.isNotNull(), F.array(*[v / det for v in c]))
