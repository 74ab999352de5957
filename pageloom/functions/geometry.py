"""Box arithmetic as Column expressions. Pixel boxes are corner pairs; wire boxes are x, y, width, height.

Rounding is half to even (``rint``). Every function is pure and stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x1", "y1", "x2", "y2")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[col(v).cast("int").alias(n) for v, n in zip((x1, y1, x2, y2), AXES, strict=True)])


def whole(c) -> Column:
    """Half-even rounding to an integer."""
    return F.rint(col(c)).cast("int")


def cut(c) -> Column:
    """Truncation towards zero."""
    return col(c).cast("int")


def from_corners(x1, y1, x2, y2) -> Column:
    return box(*(cut(v) for v in (x1, y1, x2, y2)))


def from_extent(x, y, w, h) -> Column:
    return box(cut(x), cut(y), cut(x) + cut(w), cut(y) + cut(h))


def checked(b: Column) -> Column:
    """The box itself; an inverted one raises when the row is evaluated."""
    bad = (b["x2"] < b["x1"]) | (b["y2"] < b["y1"])
    return F.when(bad, F.raise_error(F.concat(F.lit("inverted box "), F.to_json(b)))).otherwise(b)


def denormalised(nx, ny, nw, nh, img_w, img_h) -> Column:
    """Relative x, y, width, height to pixels inside the image; the far corner never lies before the near one."""
    w, h = col(img_w), col(img_h)
    x1, y1 = F.greatest(F.lit(0), whole(col(nx) * w)), F.greatest(F.lit(0), whole(col(ny) * h))
    x2, y2 = F.least(w, whole((col(nx) + col(nw)) * w)), F.least(h, whole((col(ny) + col(nh)) * h))
    return box(x1, y1, F.greatest(x2, x1), F.greatest(y2, y1))


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b).cast("long") * height(b)


def safe_area(b: Column) -> Column:
    """Area with negative extents read as zero."""
    return F.greatest(F.lit(0), width(b)).cast("long") * F.greatest(F.lit(0), height(b))


def degenerate(b: Column, min_w: int = 1, min_h: int = 1) -> Column:
    return (width(b) < min_w) | (height(b) < min_h)


def wire_box(bbox: Column, img_w, img_h) -> Column:
    """Array of four relative numbers to a pixel box; null for a wrong length, no extent, or a box that rounds away."""
    made = denormalised(bbox[0], bbox[1], bbox[2], bbox[3], img_w, img_h)
    return F.when((F.size(bbox) == 4) & (bbox[2] > 0) & (bbox[3] > 0) & ~degenerate(made), made)


def augmented_box(x1, y1, x2, y2) -> Column:
    """Float corners back to pixels: rounded, then inversions closed."""
    a, b, c, d = (whole(v) for v in (x1, y1, x2, y2))
    return box(a, b, F.greatest(a, c), F.greatest(b, d))


def as_extent(b: Column) -> Column:
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), width(b).alias("w"), height(b).alias("h"))


def as_floats(b: Column) -> Column:
    return F.array(*[b[k].cast("double") for k in AXES])


def clipped(b: Column, img_w, img_h) -> Column:
    x, y = (lambda v: F.greatest(F.lit(0), F.least(v, col(img_w)))), (lambda v: F.greatest(F.lit(0), F.least(v, col(img_h))))
    return box(x(b["x1"]), y(b["y1"]), x(b["x2"]), y(b["y2"]))


def padded(b: Column, px: int) -> Column:
    """Grown by px on each side, shrunk where px is negative; shrinking past the middle raises."""
    out = box(b["x1"] - px, b["y1"] - px, b["x2"] + px, b["y2"] + px)
    return checked(out) if px < 0 else out


def expanded(b: Column, px: int) -> Column:
    return b if px == 0 else box(b["x1"] - px, b["y1"] - px, b["x2"] + px, b["y2"] + px)


def scaled(b: Column, sx, sy) -> Column:
    return box(whole(b["x1"] * col(sx)), whole(b["y1"] * col(sy)), whole(b["x2"] * col(sx)), whole(b["y2"] * col(sy)))


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x1"] <= inner["x1"]) & (outer["y1"] <= inner["y1"]) & (outer["x2"] >= inner["x2"]) & (outer["y2"] >= inner["y2"])


def quad_box(xs: Column, ys: Column, min_points: int = 3) -> Column:
    """Bounding box of a polygon: extremes, then truncation; null for few points or no extent."""
    made = box(cut(F.array_min(xs)), cut(F.array_min(ys)), cut(F.array_max(xs)), cut(F.array_max(ys)))
    return F.when((F.size(xs) >= min_points) & ~degenerate(made), made)


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0), w).cast("long") * F.greatest(F.lit(0), h)


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    union = safe_area(a) + safe_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def fit_scale(w, h, canvas_w, canvas_h) -> Column:
    """Factor that fits a page into a canvas; pages are never enlarged."""
    return F.least(col(canvas_h) / col(h), col(canvas_w) / col(w), F.lit(1.0))


def fit_size(w, h, canvas_w, canvas_h) -> Column:
    s = fit_scale(w, h, canvas_w, canvas_h)
    return F.struct(whole(col(w) * s).alias("w"), whole(col(h) * s).alias("h"), s.alias("scale"))


def up_to_multiple(v, m: int) -> Column:
    return (F.ceil(col(v) / m) * m).cast("int")


def scaled_lines(lines: Column, s: Column) -> Column:
    """Lines of a page after the page is resized by s."""
    return F.transform(lines, lambda x: F.struct(x["text"].alias("text"), *[whole(x[k] * s).alias(k) for k in AXES]))


def rotated(b: Column, degrees, cx, cy) -> Column:
    """Bounding box of the box turned by -degrees about a centre, truncated."""
    t = F.radians(-col(degrees))
    c, s = F.cos(t), F.sin(t)
    corners = [(b["x1"], b["y1"]), (b["x2"], b["y1"]), (b["x2"], b["y2"]), (b["x1"], b["y2"])]
    xs = [col(cx) + (x - col(cx)) * c - (y - col(cy)) * s for x, y in corners]
    ys = [col(cy) + (x - col(cx)) * s + (y - col(cy)) * c for x, y in corners]
    return box(cut(F.least(*xs)), cut(F.least(*ys)), cut(F.greatest(*xs)), cut(F.greatest(*ys)))


def line_crop(b: Column, img_w, img_h, pad: int = 4, min_h: int = 12, max_h: int = 96, min_w: int = 32) -> Column:
    """Crop of one line of usable size: padded, clipped, with the box of the whole crop; null for other lines."""
    grown = clipped(expanded(b, pad), img_w, img_h)
    usable = height(b).between(min_h, max_h) & (width(b) >= min_w)
    return F.when(usable, F.struct(grown.alias("crop"), box(0, 0, width(grown), height(grown)).alias("box")))


# ---- the token grid


def cells(extent: int, quantizer: int) -> int:
    return -(-extent // quantizer)


def cell(px, quantizer: int, n: int) -> Column:
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(col(px) / quantizer).cast("int")))


def axis_token(px, axis: str, quantizer: int, n: int) -> Column:
    return F.concat(F.lit(f"<{axis}_"), cell(px, quantizer, n).cast("string"), F.lit(">"))


def token_px(token: Column, quantizer: int) -> Column:
    """Lower edge of a token's cell: the inverse loses what lies within the cell."""
    return F.regexp_extract(token, r"^<(?:xy|x|y)_(\d+)>$", 1).cast("int") * quantizer


def grid_tokens(canvas_w: int, canvas_h: int, quantizer: int, unified: bool = False) -> Column:
    """All tokens of a grid: x, then y; or one list of the longer axis."""
    name = lambda axis: lambda k: F.concat(F.lit(f"<{axis}_"), k.cast("string"), F.lit(">"))
    nx, ny = cells(canvas_w, quantizer), cells(canvas_h, quantizer)
    if unified:
        return F.transform(F.sequence(F.lit(0), F.lit(max(nx, ny) - 1)), name("xy"))
    return F.concat(*[F.transform(F.sequence(F.lit(0), F.lit(n - 1)), name(a)) for a, n in (("x", nx), ("y", ny))])


# Page presets by name as height and width, and the memory in GB from which a preset fits.
PAGE_PRESETS = {"tiny": (700, 550), "small": (900, 700), "medium": (1100, 850), "large": (1400, 1050), "paper": (2200, 1700)}
PRESET_MEMORY = {"tiny": 0, "small": 14, "medium": 20, "large": 38, "paper": 78}


def page_preset(name: str | None = None, memory_gb: float | None = None) -> tuple[int, int]:
    """Height and width of a named page size. None is the medium one; ``auto`` the largest that fits the memory, tiny if unknown."""
    if name == "auto":
        name = max((p for p, need in PRESET_MEMORY.items() if need <= (memory_gb or 0)), key=PRESET_MEMORY.get)
    if (name or "medium") not in PAGE_PRESETS:
        raise ValueError(f"unknown page preset {name!r}; known are auto, {', '.join(PAGE_PRESETS)}")
    return PAGE_PRESETS[name or "medium"]
