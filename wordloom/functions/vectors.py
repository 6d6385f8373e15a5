"""Vector column expressions (array<float> / array<double>), all built-in
higher-order functions: no Python, no per-row serialisation (but ``fmt_batches``,
which takes Arrow batches).

Float work is done in double; results can be cast back to float.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NORM_TOLERANCE, PARITY_TOLERANCE, Q8_BLOCK


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it as a lambda variable for ``body``.

    Catalyst does not hoist common expressions out of lambda bodies, so a
    per-row statistic used inside ``transform`` would be recomputed per
    element; binding it first keeps the work linear in the vector length.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(v) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sequential sum of products (left fold, same order in every engine)."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def vsum(v) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """V / ||v||; a zero vector is returned unchanged."""
    vv = as_double(v)
    return let(norm(v), lambda n: F.when(n > 0, F.transform(vv, lambda x: x / n)).otherwise(vv))


def cosine(a, b) -> Column:
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb))


def layer_norm(v, gamma: Sequence[float] | Column | None = None,
               beta: Sequence[float] | Column | None = None, eps: float = 1e-12) -> Column:
    """(x - mean) / sqrt(var + eps) * gamma + beta, population variance."""
    vv = as_double(v)
    n = F.size(vv).cast("double")

    def with_mean(mean):
        var = F.aggregate(vv, F.lit(0.0).cast("double"),
                          lambda acc, x: acc + (x - mean) * (x - mean)) / n
        return let(F.lit(1.0) / F.sqrt(var + F.lit(eps)),
                   lambda inv: F.transform(vv, lambda x: (x - mean) * inv))

    normed = let(vsum(vv) / n, with_mean)
    if gamma is not None:
        g = gamma if isinstance(gamma, Column) else F.array(*[F.lit(float(x)) for x in gamma])
        normed = F.zip_with(normed, g, lambda x, y: x * y)
    if beta is not None:
        b = beta if isinstance(beta, Column) else F.array(*[F.lit(float(x)) for x in beta])
        normed = F.zip_with(normed, b, lambda x, y: x + y)
    return normed


def mat_vec(w, x, bias: Column | None = None) -> Column:
    """z = W @ x for a row-major ``array<array<double>>`` W; optional bias."""
    wc = w if isinstance(w, Column) else F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in w])
    z = F.transform(wc, lambda row: dot(row, x))
    if bias is not None:
        z = F.zip_with(z, bias, lambda a, b: a + b)
    return z


def q8_quantize(v, block: int = Q8_BLOCK) -> Column:
    """Blocks of ``block`` values -> array<struct<scale float, codes array<tinyint>>>.

    scale = max|x| / 127 (stored as a 4-byte float), code = round(x / scale)
    half away from zero; an all-zero block has scale 0 and codes 0.  The
    length must be a multiple of ``block`` (otherwise the result is null).
    """

    def blocks(vv):
        def one_block(b):
            def with_part(part):
                def with_scale(scale):
                    codes = F.transform(part, lambda x: F.when(scale > 0, F.round(x / scale, 0))
                                        .otherwise(0).cast("tinyint"))
                    return F.struct(scale.cast("float").alias("scale"), codes.alias("codes"))

                return let(F.array_max(F.transform(part, lambda x: F.abs(x))) / F.lit(127.0), with_scale)

            return let(F.slice(vv, b * block + 1, block), with_part)

        last = (F.size(vv) / block).cast("int") - 1
        return F.when(((F.size(vv) % block) == 0) & (F.size(vv) > 0),
                      F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one_block))

    return let(as_double(v), blocks)


def q8_dequantize(q) -> Column:
    """D7 inverse: codes * scale, flattened back to one vector (double)."""
    return F.flatten(F.transform(_col(q), lambda blk: F.transform(
        blk["codes"], lambda c: c.cast("double") * blk["scale"].cast("double"))))


def max_abs_diff(a, b) -> Column:
    return F.array_max(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def count_over(a, b, tol: float = PARITY_TOLERANCE) -> Column:
    return F.size(F.filter(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)),
                           lambda d: d > tol))


def is_finite_vector(v) -> Column:
    return F.forall(as_double(v), lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def healthy(v, dim: int, tol: float = NORM_TOLERANCE) -> Column:
    """Right dimension, all finite, |norm - 1| < tol."""
    return (F.size(_col(v)) == dim) & is_finite_vector(v) & (F.abs(norm(v) - 1) < tol)


def head(v, k: int = 8) -> Column:
    """S3: first k components."""
    return F.slice(_col(v), 1, k)


def fmt(v, digits: int = 6) -> Column:
    """Vector as text with fixed decimals (stable across engines)."""
    return F.array_join(F.transform(_col(v), lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ",")


def fixed_decimals(batch: pa.Array, digits: int = 6) -> pa.Array:
    """``fmt`` of a batch of vectors.  A number below 1e5 is scaled to an integer, which
    is the text as a decimal; one that lies near a tie, rounds to a negative zero or is
    larger is rounded by its own digits (half up), as ``fmt`` does."""
    lists = batch.cast(pa.list_(pa.float64()))
    flat = lists.flatten()
    x = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = x * 10.0 ** digits
        whole = np.rint(scaled)
        odd = ~((np.abs(x) < 1e5) & (np.abs(np.abs(scaled - whole) - 0.5) > 1e-4)) | ((whole == 0) & np.signbit(x))
    units = pa.array(np.where(odd, 0, whole).astype(np.int64)).cast(pa.decimal128(19, 0))
    text = pa.Array.from_buffers(pa.decimal128(19, digits), len(units), units.buffers()).cast(pa.string())
    if odd.any():
        text = pc.replace_with_mask(text, pa.array(odd), pa.array([_fixed(v, digits) for v in x[odd].tolist()], pa.string()))
    text = pc.if_else(pc.is_null(flat), "null", text)
    n = pc.list_value_length(lists)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False))])
    split = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text, mask=pc.is_null(n))
    return pc.binary_join(split, ",")


def _fixed(v: float, digits: int) -> str:
    if not math.isfinite(v):
        return "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    with decimal.localcontext(prec=400):
        return format(decimal.Decimal(repr(v)).quantize(decimal.Decimal(1).scaleb(-digits), decimal.ROUND_HALF_UP), "f")


def fmt_batches(v) -> Column:
    """``fmt`` for tables of very many vectors: whole Arrow batches at a time."""

    def fixed(vectors: pa.Array) -> pa.Array:
        return fixed_decimals(vectors)

    # Spark reads the types themselves, not their names
    fixed.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(fixed, "string")(_col(v))
