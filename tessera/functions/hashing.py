"""Reproducible pseudo-random numbers from a row key.

Anything that is compared with an independent SQL engine (random imputation,
folds, samples) must draw the same numbers there, so the generator is plain
64-bit integer arithmetic on the key: a Lehmer generator modulo the Mersenne
prime 2^31-1 evaluated with two multipliers and glued into a 62-bit value.
No ``rand()``: draws are a pure function of (key, salt), which also makes them
stable when a lost task is recomputed.

``mix_sql`` renders the very same formula as ANSI SQL text for oracles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The modulus and the two full-period multipliers (public
# Lehmer-generator constants for modulus 2^31-1).
MODULUS = 2147483647
MULT_HI = 742938285
MULT_LO = 950706376
HIGH_FOLD = 16807


def _seed(key: Column, salt: int) -> Column:
    # whole-number division: keys may use all 64 bits
    k = key.cast("long")
    low = F.pmod(k, F.lit(MODULUS))
    high = F.pmod(F.call_function("div", k - low, F.lit(MODULUS).cast("long")), F.lit(MODULUS))
    return F.pmod(low + high * F.lit(HIGH_FOLD) + F.lit(int(salt) % MODULUS), F.lit(MODULUS))


def mix(key: Column | str, salt: int = 0) -> Column:
    """A 62-bit non-negative pseudo-random long determined by (key, salt)."""
    key = F.col(key) if isinstance(key, str) else key
    x0 = _seed(key, salt)
    hi = F.pmod(x0 * F.lit(MULT_HI), F.lit(MODULUS))
    lo = F.pmod(x0 * F.lit(MULT_LO), F.lit(MODULUS))
    return hi * F.lit(2147483648) + lo


def draw_index(key: Column | str, salt: int, size: Column | int) -> Column:
    """Uniform-ish integer in [0, size) for each row."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.pmod(mix(key, salt), size.cast("long"))


def unit_uniform(key: Column | str, salt: int = 0) -> Column:
    """A double in (0, 1) from the hash (used for Gaussian noise draws)."""
    return (F.pmod(mix(key, salt), F.lit(MODULUS)).cast("double") + F.lit(0.5)) / F.lit(float(MODULUS))


def std_normal(key: Column | str, salt: int = 0) -> Column:
    """Box-Muller standard normal from two independent hash uniforms."""
    u1 = unit_uniform(key, salt)
    u2 = unit_uniform(key, salt + 7919)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def hashed_normal(key: Column | str, salt: int = 0) -> Column:
    """Box-Muller standard normal from two unrelated 53-bit hashes. The two
    uniforms of ``std_normal`` (which SQL can repeat) differ by a constant, and
    so do those of two salts; use this where draws of one row must be independent."""
    key = F.col(key) if isinstance(key, str) else key
    u1, u2 = ((F.shiftrightunsigned(F.xxhash64(key, F.lit(int(salt)), F.lit(j)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
              for j in (1, 2))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def mix_sql(key: str, salt: int = 0) -> str:
    """The same generator as SQL text (BIGINT arithmetic; operands non-negative)."""
    s = int(salt) % MODULUS
    x0 = (f"(({key}) % {MODULUS} + (({key}) // {MODULUS}) % {MODULUS} * {HIGH_FOLD} + {s}) % {MODULUS}")
    return (f"((({x0}) * {MULT_HI}) % {MODULUS} * 2147483648 + (({x0}) * {MULT_LO}) % {MODULUS})")


def draw_index_sql(key: str, salt: int, size: str) -> str:
    return f"({mix_sql(key, salt)} % ({size}))"
