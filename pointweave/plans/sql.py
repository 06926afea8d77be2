"""SQL text that adds and multiplies, so that oracles can be written in the same algebra."""

from __future__ import annotations


class Sql(str):
    def _two(self, op, other, swap=False):
        a, b = (other, self) if swap else (self, other)
        return Sql(f"({a} {op} {b})")

    def __add__(self, o):
        return self._two("+", o)

    def __radd__(self, o):
        return self._two("+", o, True)

    def __sub__(self, o):
        return self._two("-", o)

    def __rsub__(self, o):
        return self._two("-", o, True)

    def __mul__(self, o):
        return self._two("*", o)

    def __rmul__(self, o):
        return self._two("*", o, True)

    def __truediv__(self, o):
        return self._two("/", o)

    def __neg__(self):
        return Sql(f"(-{self})")

    def __lt__(self, o):
        return self._two("<", o)

    def __le__(self, o):
        return self._two("<=", o)

    def __gt__(self, o):
        return self._two(">", o)

    def __ge__(self, o):
        return self._two(">=", o)

    def __eq__(self, o):
        return self._two("=", o)

    def __or__(self, o):
        return self._two("OR", o)

    __hash__ = str.__hash__


def _call(name):
    return staticmethod(lambda *a: Sql(f"{name}({', '.join(str(x) for x in a)})"))


class Duck:
    sqrt, sin, cos, acos, exp, log, absolute, least = (_call(n) for n in ("sqrt", "sin", "cos", "acos", "exp", "ln", "abs", "least"))

    @staticmethod
    def when(condition, a, b):
        return Sql(f"(CASE WHEN {condition} THEN {a} ELSE {b} END)")


def vec(prefix: str = "", names=("x", "y", "z")) -> tuple:
    return tuple(Sql(prefix + n) for n in names)


def pose(prefix: str = "") -> tuple:
    return vec(prefix, ("qx", "qy", "qz", "qw")), vec(prefix)


def listed(values: dict) -> str:
    """name: SQL -> rounded select list."""
    return ", ".join(f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {k}" for k, v in values.items())
