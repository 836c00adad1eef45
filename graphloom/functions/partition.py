"""Owner expressions: which of ``parts`` parts a vertex lives in, and its number there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The golden ratio and its 32-bit hash constant (fixed values).
PHI, GOLDEN = 1.618034, 0x9E3779B9

Owner = Callable[[Column, int, int], Column]


def _row(v: Column, parts: int) -> Column:
    return F.floor(v / parts).cast("long")


def cyclic(v: Column, parts: int, n: int) -> Column:
    return F.pmod(v, F.lit(parts))


def block_range(v: Column, parts: int, n: int) -> Column:
    """Blocks of ceil(n / parts) neighbouring ids."""
    return F.floor(v / max(1, -(-n // parts))).cast("long")


def snake(v: Column, parts: int, n: int) -> Column:
    """Cyclic, but every second round runs backwards."""
    c = cyclic(v, parts, n)
    return F.when(_row(v, parts) % 2 == 1, parts - 1 - c).otherwise(c)


def rotation(v: Column, parts: int, n: int) -> Column:
    """Every round starts one part later."""
    return F.pmod(v + _row(v, parts), F.lit(parts))


def snake_rotation(v: Column, parts: int, n: int) -> Column:
    """Snake, and every second round starts one part later."""
    r, c = _row(v, parts), cyclic(v, parts, n)
    k = F.floor(r / 2).cast("long")
    return F.when(r % 2 == 1, F.pmod(parts - 1 - c - k, F.lit(parts))).otherwise(F.pmod(c + k, F.lit(parts)))


def fibonacci(v: Column, parts: int, n: int) -> Column:
    return F.pmod(F.floor(v * F.lit(PHI)).cast("long"), F.lit(parts))


def xor(v: Column, parts: int, n: int) -> Column:
    return F.pmod(v.bitwiseXOR(F.lit(GOLDEN)), F.lit(parts))


def fibonacci_xor(v: Column, parts: int, n: int) -> Column:
    return F.pmod(xor(v, parts, n) * fibonacci(v, parts, n), F.lit(parts))


#: Schemes by name; ``register`` adds more.
SCHEMES: dict[str, Owner] = {
    "cyclic": cyclic, "range": block_range, "snake": snake, "rotation": rotation, "snake_rotation": snake_rotation,
    "fibonacci": fibonacci, "xor": xor, "fibonacci_xor": fibonacci_xor,
}


def register(name: str, owner: Owner) -> None:
    SCHEMES[name] = owner


def owner(scheme: str, v: Column | str, parts: int, n: int) -> Column:
    return SCHEMES[scheme](F.col(v) if isinstance(v, str) else v, parts, n).cast("long")
