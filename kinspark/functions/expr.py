"""Column expressions over numeric arrays and 64-bit seeds.

Degenerate input has the results the lineage signals rely on: similarity is 0
for arrays of different lengths, too few values or no variance, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit
#: FNV-1a 64, and the sampling generator's multiplier, increment and seed mask (fixed values).
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
LCG_MASK, LCG_MULTIPLIER, LCG_INCREMENT, LCG_SHIFT = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407, 11
#: Floor of a singular value before its logarithm.
LOG_FLOOR = 1e-12


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(_col(a), lambda x: x * x)))


def mean(a) -> Column:
    return F.try_divide(total(a), F.size(_col(a)))


def centred(a) -> Column:
    """An array minus its mean; the mean is folded once, not for each element."""
    a = _col(a)
    means = F.array_repeat(mean(a), F.size(a))
    return F.zip_with(a, means, lambda x, m: x - m)


def clip1(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def _ratio(over: Column, under: Column, ok: Column) -> Column:
    value = F.try_divide(over, under)
    fine = ok & (under > 0) & (under < float("inf")) & value.isNotNull() & ~F.isnan(value)
    return F.when(fine, clip1(value)).otherwise(F.lit(0.0))


def cosine(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _ratio(dot(a, b), norm(a) * norm(b), (F.size(a) == F.size(b)) & (F.size(a) > 0))


def unit(a) -> Column:
    """An array over its norm; zeros without a finite one, so that products with it are the 0 that similarity has then."""
    a = _col(a)
    scale = F.array_repeat(norm(a), F.size(a))
    return F.zip_with(a, scale, lambda x, s: F.when((s > 0) & (s < float("inf")), x / s).otherwise(0.0))


def pearson(a, b) -> Column:
    a, b = _col(a), _col(b)
    x, y = centred(a), centred(b)
    return _ratio(dot(x, y), norm(x) * norm(y), (F.size(a) == F.size(b)) & (F.size(a) >= 3))


def zscore(a) -> Column:
    """Array in units of its population deviation around its mean; zeros without deviation."""
    a = _col(a)
    x = centred(a)
    scale = F.array_repeat(norm(x) / F.sqrt(F.size(a)), F.size(a))
    return F.zip_with(x, scale, lambda v, s: F.when(s > 0, v / s).otherwise(0.0))


def log_floor(a) -> Column:
    return F.transform(_col(a), lambda x: F.log(F.greatest(x, F.lit(LOG_FLOOR))))


def log_distance(a, b) -> Column:
    """Root mean square difference of log spectra over their common length; infinite without any."""
    n = F.least(F.size(_col(a)), F.size(_col(b)))
    x = F.zip_with(F.slice(log_floor(a), 1, n), F.slice(log_floor(b), 1, n), lambda p, q: (p - q) * (p - q))
    return F.when(n > 0, F.sqrt(total(x) / n)).otherwise(F.lit(float("inf")))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def pcs_quota(layers) -> Column:
    """Sample elements that each layer gives to a role's positional sample."""
    return F.greatest(F.lit(1024), F.floor(F.lit(98304) / F.greatest(_col(layers), F.lit(1))).cast("int"))


def even_subsample(a, cap: int = 256) -> Column:
    """At most `cap` values at evenly spaced, truncated places."""
    a = _col(a)
    picks = F.transform(F.arrays_zip(F.sequence(F.lit(0), F.lit(cap - 1)).alias("i"), F.array_repeat(F.size(a), cap).alias("n")), lambda s: (s["i"] * (s["n"] - 1) / (cap - 1)).cast("int"))
    return F.when(F.size(a) <= cap, a).otherwise(F.transform(picks, lambda i: F.get(a, i)))


def _wide(value: int, digits: int = 20) -> Column:
    return F.lit(str(value)).cast(f"decimal({digits},0)")


def fnv1a(*parts) -> Column:
    """FNV-1a 64 over the text of each part and a 0x1F after it, as DECIMAL(20,0): Spark has no unsigned 64 bits.

    The exclusive-or reaches the low byte alone, and a state times the prime fits 34 digits.
    """
    text = F.concat(*[F.concat(_col(p).cast("string"), F.lit("\x1f")) for p in parts])
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(text.cast("binary"), i, F.lit(1))), 16, 10).cast("int"))
    modulus = _wide(1 << 64)

    def step(state: Column, byte: Column) -> Column:
        low = (state % 256).cast("int")
        mixed = (state - low + low.bitwiseXOR(byte)).cast("decimal(20,0)")
        return (mixed * _wide(FNV_PRIME, 13) % modulus).cast("decimal(20,0)")

    return F.aggregate(codes, _wide(FNV_OFFSET), step)


def lcg_offsets(numel, blocks, block_len, seed) -> Column:
    """Sorted distinct starts of `blocks` blocks inside `numel` elements, drawn by a 64-bit congruential generator.

    Products are split into 32-bit halves, so that they fit DECIMAL(38,0).
    """
    numel, blocks, block_len, seed = _col(numel), _col(blocks), _col(block_len), _col(seed).cast("decimal(20,0)")
    two32, two64 = _wide(1 << 32, 10), _wide(1 << 64)

    def halves(x: Column) -> tuple[Column, Column]:
        low = (x % two32).cast("bigint")
        return ((x - low) / two32).cast("bigint"), low

    high, low = halves(seed)
    start = high.bitwiseXOR(LCG_MASK >> 32).cast("decimal(20,0)") * two32 + low.bitwiseXOR(LCG_MASK & 0xFFFFFFFF).cast("decimal(20,0)")
    a = _wide(LCG_MULTIPLIER, 19)

    def step(states: Column, _: Column) -> Column:
        h, l = halves(F.element_at(states, -1))
        upper = ((h.cast("decimal(10,0)") * a) % two32).cast("decimal(10,0)") * two32
        fresh = (l.cast("decimal(10,0)") * a + upper + _wide(LCG_INCREMENT, 19)) % two64
        return F.concat(states, F.array(fresh.cast("decimal(20,0)")))

    states = F.aggregate(F.sequence(F.lit(1), blocks), F.array(start.cast("decimal(20,0)")), step)
    span = numel - block_len
    drawn = F.transform(F.slice(states, 2, blocks), lambda s: F.pmod(F.expr("0L") + F.floor(s / (1 << LCG_SHIFT)).cast("bigint"), F.greatest(span, F.lit(1))).cast("bigint"))
    return F.when(span <= 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_sort(F.array_distinct(drawn)))


def float32(c) -> Column:
    """A number as single precision keeps it."""
    return _col(c).cast("float").cast("double")


def day(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def stamp(c) -> Column:
    """A time of the session's zone, taken for UTC, to the second."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def html_escape(c) -> Column:
    out = _col(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out
