"""Per-row scoring expressions over logit arrays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, _c


def to_double_array(logits: ColumnLike) -> Column:
    return F.transform(_c(logits), lambda x: x.cast("double"))


def argmax(logits: ColumnLike) -> Column:
    """A3: 0-based index of the first maximum (``np.argmax`` semantics)."""
    arr = _c(logits)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def cross_entropy(logits: ColumnLike, target: ColumnLike) -> Column:
    """``logsumexp(x) - x[target]`` computed stably (max-shifted), in double;
    NULL for a target outside the logits (-1 marks ignored rows)."""
    x = to_double_array(logits)
    m = F.array_max(x)
    sum_exp = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))
    t = _c(target).cast("int")
    picked = F.get(x, F.when((t >= 0) & (t < F.size(x)), t))
    return m + F.log(sum_exp) - picked
