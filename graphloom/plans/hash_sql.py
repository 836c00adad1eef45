"""SQL of Spark's ``xxhash64`` on whole numbers, so that hash-based random tables can be computed again elsewhere.

Values are kept below 2**64 in 128-bit unsigned numbers, so products do not overflow.
"""

from __future__ import annotations

from itertools import count

#: Fixed values of the hash.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5

_names = count()


def _n(value: int) -> str:
    return f"{value}::UHUGEINT"


def _low(x: str) -> str:
    return f"(({x}) % {_n(1 << 64)})"


def _times(x: str, p: int) -> str:
    return _low(f"({x}) * {_n(p)}")


def _let(value: str, body) -> str:
    """``body`` of a name that stands for ``value``, which is so computed once."""
    name = f"x{next(_names)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _turned(x: str, bits: int) -> str:
    return f"({_low(f'{x} * {_n(1 << bits)}')} + {x} // {_n(1 << (64 - bits))})"


def _stirred(h: str, down: int) -> str:
    return _let(h, lambda x: f"xor({x}, {x} // {_n(1 << down)})")


def _last(h: str) -> str:
    return _stirred(_times(_stirred(_times(_stirred(h, 33), P2), 29), P3), 32)


def _long(value: str, seed: str) -> str:
    word = _let(_times(f"({value})::UHUGEINT", P2), lambda x: _times(_turned(x, 31), P1))
    mixed = f"xor({_low(f'{seed} + {_n((P5 + 8) % (1 << 64))}')}, {word})"
    return _last(_let(mixed, lambda x: _low(f"{_times(_turned(x, 27), P1)} + {_n(P4)}")))


def _int(value: str, seed: str) -> str:
    mixed = f"xor({_low(f'{seed} + {_n((P5 + 4) % (1 << 64))}')}, {_times(f'({value})::UHUGEINT', P1)})"
    return _last(_let(mixed, lambda x: _low(f"{_times(_turned(x, 23), P2)} + {_n(P3)}")))


def hashed(*longs: str, ints: tuple = ()) -> str:
    """SQL of the hash, unsigned, of columns of longs from 0 on and then of ints from 0 on."""
    h = _n(42)
    for value in longs:
        h = _long(value, h)
    for value in ints:
        h = _int(str(value), h)
    return h


def signed(h: str) -> str:
    """SQL of the signed number that an unsigned hash stands for."""
    return _let(f"({h})::HUGEINT", lambda x: f"if({x} >= {1 << 63}::HUGEINT, {x} - {1 << 64}::HUGEINT, {x})")


def uniform(*longs: str, ints: tuple = ()) -> str:
    """SQL of ``functions.rng.uniform``; the seed is the last of ``ints``."""
    return f"(({hashed(*longs, ints=ints)} // {_n(1 << 11)})::DOUBLE / {1 << 53}::DOUBLE)"


def scrambled(table: str, scale: str, seed: int) -> str:
    """SQL of CTEs, the last of them z: the rows of ``table`` (id, side, x) with x as ``generate.scramble`` makes it; ``scale`` is a table of that one number."""
    steps = [f"z0 AS (SELECT id, side, scale // 2 AS low, scale - scale // 2 AS high, x & ((1::BIGINT << (scale // 2)) - 1) AS lo, x >> (scale // 2) AS hi FROM {table}, {scale})"]
    for r in range(4):
        of, to, bits = ("lo", "hi", "high") if r % 2 == 0 else ("hi", "lo", "low")
        new = f"xor({to}, ({hashed(of, ints=(seed + r,))} % (1::BIGINT << {bits})::UHUGEINT)::BIGINT) AS {to}"
        steps.append(f"z{r + 1} AS MATERIALIZED (SELECT id, side, low, high, {of}, {new} FROM z{r})")
    return ", ".join([*steps, "z AS (SELECT id, side, (hi << low) | lo AS x FROM z4)"])
