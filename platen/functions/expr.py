"""Column helpers: rounding, clamping, boxes, angles and the geometry of four corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MM_PER_INCH, PT_PER_INCH = 25.4, 72.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def round1(x) -> Column:
    """To one decimal, halves up: the same in every engine for lengths, which are not negative."""
    return F.floor(col(x) * 10 + 0.5) / 10


def round0(x) -> Column:
    return F.floor(col(x) + 0.5)


def tidy(x, places: int = 6) -> Column:
    """Rounds what libraries differ on in the last bits."""
    return F.floor(col(x) * 10.0**places + 0.5) / 10.0**places


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(col(x), col(low)), col(high))


def safe_div(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), col(b))


def fold_angle(angle, w, h) -> tuple[Column, Column, Column]:
    """Brings an angle into [-45, 45] by quarter turns; each swaps width and height."""
    a = col(angle)
    n = F.greatest(F.ceil((F.abs(a) - 45) / 90), F.lit(0))
    odd = n % 2 == 1
    return a - F.signum(a) * 90 * n, F.when(odd, col(h)).otherwise(col(w)), F.when(odd, col(w)).otherwise(col(h))


def overlap(a: str, b: str) -> Column:
    """Area shared by the upright boxes cx, cy, w, h of aliases a and b."""
    side = lambda c, s: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{c}") + F.col(f"{a}.{s}") / 2, F.col(f"{b}.{c}") + F.col(f"{b}.{s}") / 2) - F.greatest(F.col(f"{a}.{c}") - F.col(f"{a}.{s}") / 2, F.col(f"{b}.{c}") - F.col(f"{b}.{s}") / 2))
    return side("cx", "w") * side("cy", "h")


def iou(a: str, b: str) -> Column:
    inter = overlap(a, b)
    union = F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def containment(a: str, b: str) -> Column:
    smaller = F.least(F.col(f"{a}.w") * F.col(f"{a}.h"), F.col(f"{b}.w") * F.col(f"{b}.h"))
    return F.when(smaller > 0, overlap(a, b) / smaller).otherwise(0.0)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions use by name: a generator of one row stands between, so the optimizer doesn't write them out again at each use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def side_lengths() -> dict[str, Column]:
    """Lengths of the sides of the quad x0..y3 (top-left, top-right, bottom-right, bottom-left)."""
    side = lambda i, j: hypot(F.col(f"x{j}") - F.col(f"x{i}"), F.col(f"y{j}") - F.col(f"y{i}"))
    return {"top": side(0, 1), "right": side(1, 2), "bottom": side(3, 2), "left_side": side(0, 3)}
