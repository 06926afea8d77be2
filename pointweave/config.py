"""Options from YAML, with overrides by dotted path, and metrics and poses to YAML.

Options are dataclasses. A file names fields as the dataclass does; an unknown name raises, and so
does a value of another type, so a misspelt option isn't passed over.
"""

from __future__ import annotations

import dataclasses
import types
import typing
from enum import Enum
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

POSE = ("qx", "qy", "qz", "qw", "x", "y", "z")


def load(text: str) -> dict[str, Any]:
    """The tree of a YAML text; an empty one is an empty tree."""
    return yaml.safe_load(text) or {}


def find(tree: dict[str, Any], path: str, default: Any = None) -> Any:
    """The node at a dotted path."""
    for part in path.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return default
        tree = tree[part]
    return tree


def put(tree: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """A tree with another value at a dotted path; nodes on the way are made."""
    first, _, rest = path.partition(".")
    below = tree.get(first) if isinstance(tree.get(first), dict) else {}
    return {**tree, first: put(below, rest, value) if rest else value}


def merged(tree: dict[str, Any], other: dict[str, Any]) -> dict[str, Any]:
    """A tree with the values of another one laid over it, node by node."""
    out = dict(tree)
    for k, v in other.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def overridden(tree: dict[str, Any], arguments: list[str]) -> dict[str, Any]:
    """A tree with arguments `path=value` laid over it; values are YAML."""
    for a in arguments:
        path, sign, value = a.partition("=")
        if not sign:
            raise ValueError(f"{a} has no value")
        tree = put(tree, path.strip(), yaml.safe_load(value))
    return tree


def options(kind: type, tree: dict[str, Any], base: Any = None):
    """A dataclass from a tree; fields that aren't there are those of base, or the defaults."""
    hints = typing.get_type_hints(kind)
    unknown = set(tree) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"{kind.__name__} has no option {', '.join(sorted(unknown))}")
    values = {k: _value(hints[k], v, k) for k, v in tree.items()}
    return kind(**values) if base is None else dataclasses.replace(base, **values)


def _value(kind: Any, v: Any, name: str) -> Any:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if dataclasses.is_dataclass(kind) and isinstance(v, dict):
        return options(kind, v)
    if isinstance(kind, type) and issubclass(kind, Enum):
        return kind[v]
    if origin is tuple:
        if not isinstance(v, list):
            raise ValueError(f"{name} is a list")
        return tuple(_value(args[0] if len(args) == 2 and args[1] is ... else args[i], x, name) for i, x in enumerate(v))
    if origin in (types.UnionType, typing.Union):
        return None if v is None else _value(next(a for a in args if a is not type(None)), v, name)
    if kind is float and isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(kind, type) and (not isinstance(v, kind) or (isinstance(v, bool) and kind is not bool)):
        raise ValueError(f"{name} is a {kind.__name__}, not {v!r}")
    return v


def dump(value: Any) -> str:
    """YAML of a dataclass or a tree."""
    plain = lambda x: {k: plain(v) for k, v in dataclasses.asdict(x).items()} if dataclasses.is_dataclass(x) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, (list, tuple)) else x
    return yaml.safe_dump(plain(value), sort_keys=False)


def metrics(table: DataFrame, key: str = "seq") -> str:
    """YAML of a table of metrics, one row a sequence: {sequence: {metric: value}}."""
    return dump({str(r[key]): {k: v for k, v in r.asDict().items() if k != key} for r in table.orderBy(key).collect()})


def poses(spark: SparkSession, nodes: list[dict[str, Any]]) -> DataFrame:
    """pose_id, frame_id, t and unit pose of nodes with quaternion, translation and, where given, dest_frame_id and dest_timestamp (else their number)."""
    rows = []
    for i, n in enumerate(nodes):
        size = sum(v * v for v in n["quaternion"]) ** 0.5
        rows.append((i, int(n.get("dest_frame_id", i)), float(n.get("dest_timestamp", n.get("dest_frame_id", i))), *[v / size for v in n["quaternion"]], *map(float, n["translation"])))
    return spark.createDataFrame(rows, "pose_id long, frame_id long, t double, " + ", ".join(f"{n} double" for n in POSE))


def pose_nodes(table: DataFrame) -> list[dict[str, Any]]:
    """What poses() reads."""
    return [{"quaternion": [r[n] for n in POSE[:4]], "translation": [r[n] for n in POSE[4:]], "dest_frame_id": r.frame_id, "dest_timestamp": r.t} for r in table.orderBy("t", "pose_id").collect()]
