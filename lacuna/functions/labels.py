"""Labels, calls, clipping, economics and the other per-row algebra of the studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vessel classes: substrings of the upper-cased type, class and plate yield, in order of precedence (fixed values).
VESSELS = (
    (("TANKER", "LNG", "LPG"), "tanker", 0.765),
    (("BULK",), "bulker", 0.66),
    (("CONTAINER",), "container", 0.65),
    (("CARGO", "RORO", "RO-RO"), "general_cargo", 0.63),
    (("PLATFORM", "RIG", "DRILL", "BARGE"), "special_structure", 0.35),
)
VESSEL_OTHER = ("other", 0.60)


def holds(test: Column) -> Column:
    """A test whose missing result is false."""
    return F.coalesce(test, F.lit(False))


def row_mean(*xs: Column) -> Column:
    """Mean of the values present; null if there are none."""
    n = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


def all_present(*xs: Column) -> Column:
    return F.forall(F.array(*[x.isNotNull() for x in xs]), lambda p: p)


def any_present(*xs: Column) -> Column:
    return F.exists(F.array(*[x.isNotNull() for x in xs]), lambda p: p)


def direction(start: Column, end: Column) -> Column:
    """1, 0 or -1 as end is above, at or below start."""
    return F.signum(end - start).cast("int")


def fade_call(z: Column, at: float = 1.0) -> Column:
    """-1 above the threshold, 1 below its negative, else 0 (also where z is missing)."""
    return F.when(z > at, -1).when(z < -at, 1).otherwise(0)


def joint_call(z: Column, momenta: Sequence[Column], at: float = 1.0) -> Column:
    """The fade call where all momenta agree with it, else 0."""
    up, down = F.lit(True), F.lit(True)
    for m in momenta:
        up, down = up & (m > 0), down & (m < 0)
    return F.when((z < -at) & up, 1).when((z > at) & down, -1).otherwise(0)


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (F.lit(v) if isinstance(v, int | float) else v for v in (lo, hi))
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def hinge(z: Column) -> tuple[Column, Column]:
    """max(z - 1, 0) and max(-z - 1, 0)."""
    zero = F.lit(0.0)
    return F.when(z.isNotNull(), F.greatest(z - 1, zero)), F.when(z.isNotNull(), F.greatest(-z - 1, zero))


def interaction(a: Column, b: Column, most: float = 6.0) -> Column:
    return clip(a * b, -most, most)


def nearly(a: Column, b: Column, by: float = 1e-9) -> Column:
    return holds(F.abs(a - b) <= by)


def reasons(tests: Sequence[tuple[Column, str]]) -> Column:
    """Texts of the tests that hold, in order, once each, joined by '; '."""
    given = F.array(*[F.when(holds(t), F.lit(text)) for t, text in tests])
    return F.array_join(F.array_distinct(F.filter(given, lambda x: x.isNotNull())), "; ")


def looked_up(x: Column, table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[x]


def vessel(text: Column) -> tuple[Column, Column]:
    """Class and plate yield of a vessel type."""
    name, cls, share = F.upper(text), None, None
    for words, label, value in VESSELS:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(name, F.lit(w))
        cls = F.when(test, label) if cls is None else cls.when(test, label)
        share = F.when(test, value) if share is None else share.when(test, value)
    return cls.otherwise(VESSEL_OTHER[0]), share.otherwise(VESSEL_OTHER[1])


def gamma3_cdf(age: Column, theta: Column | float) -> Column:
    """Share of a gamma kernel of shape 3 that is past at an age."""
    x = F.greatest(age.cast("double"), F.lit(0.0)) / theta
    return 1 - F.exp(-x) * (1 + x + x * x / 2)


def outcome(call: Column, ret: Column, change: Column, horizon: Column, carry: float = 30.0) -> dict[str, Column]:
    """What a call earned: signed return and change, hurdle of carry a day, net change and hits."""
    hurdle = carry * horizon
    net = change - hurdle
    economic = F.signum(net).cast("int")
    return {
        "signed_ret": call * ret,
        "signed_change": call * change,
        "hit": (F.signum(change).cast("int") == call).cast("int"),
        "holding_hurdle": hurdle,
        "net_hold_change": net,
        "economic_target": economic,
        "economic_hit": (economic == call).cast("int"),
        "signed_net_value": call * net,
    }


def brier(onehot: Sequence[Column], p: Sequence[Column]) -> Column:
    return sum(((a - b) * (a - b) for a, b in zip(onehot[1:], p[1:], strict=True)), (onehot[0] - p[0]) * (onehot[0] - p[0]))


def log_loss(p_true: Column, floor: float = 1e-12) -> Column:
    return -F.log(F.greatest(p_true, F.lit(floor)))


def on_simplex(raw: Sequence[Column], frequency: Sequence[Column], shrink: float = 0.15) -> list[Column]:
    """Scores cut at 0 plus a share of the class frequencies, made to add up to 1."""
    lifted = [F.greatest(r, F.lit(0.0)) + shrink * f for r, f in zip(raw, frequency, strict=True)]
    total = sum(lifted[1:], lifted[0])
    return [x / total for x in lifted]


def first_best(scores: Column) -> Column:
    """Place, from 1, of an array's largest value; the first of equal ones."""
    return F.array_position(scores, F.array_max(scores))
