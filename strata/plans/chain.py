"""Named operators, their parameters, and chains of them as lazy DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": (dict, DataFrame), "array": list}
REFERENCE = re.compile(r"\$\{?(input|steps)\.([A-Za-z0-9_]+)\}?")


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str = "string"
    required: bool = False
    default: object = None
    description: str = ""


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    parameters: tuple[Parameter, ...] = ()
    description: str = ""

    def schema(self) -> dict:
        """A JSON schema of the parameters, as function-calling interfaces want it."""
        props = {p.name: {"type": p.type, "description": p.description} for p in self.parameters}
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": props, "required": [p.name for p in self.parameters if p.required]}}}

    def check(self, args: dict) -> dict:
        """args with defaults, without unknown names (but for those that begin with _)."""
        out = {k: v for k, v in args.items() if k.startswith("_")}
        for p in self.parameters:
            if args.get(p.name) is None:
                if p.required:
                    raise ValueError(f"{self.name}: {p.name} is missing")
                if p.default is not None:
                    out[p.name] = p.default
                continue
            v = args[p.name]
            if p.type == "integer" and isinstance(v, float) and v.is_integer():
                v = int(v)
            if not isinstance(v, TYPES[p.type]) or isinstance(v, bool) and p.type in ("integer", "number"):
                raise ValueError(f"{self.name}: {p.name} is not of type {p.type}")
            out[p.name] = v
        return out


class Registry:
    def __init__(self):
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        self._tools[tool.name] = tool

    def get(self, name: str) -> Tool:
        if name not in self._tools:
            raise KeyError(f"unknown operator {name!r}")
        return self._tools[name]

    def names(self) -> list[str]:
        return sorted(self._tools)


@dataclass(frozen=True)
class Step:
    name: str
    tool: str
    args: dict = field(default_factory=dict)
    parallel: bool = False


def expand(value, inputs: dict, done: dict):
    """A value that is one reference becomes what it names (a DataFrame too); references within text become text."""
    if not isinstance(value, str):
        return value
    table = {"input": inputs, "steps": done}
    whole = REFERENCE.fullmatch(value)
    return table[whole[1]][whole[2]] if whole else REFERENCE.sub(lambda m: str(table[m[1]][m[2]]), value)


class Chain:
    """Steps in order; neighbouring parallel ones form a group and may not use each other. Nothing runs before the last result is read, so what is
    parallel is left to the scheduler."""

    def __init__(self, registry: Registry, steps: list[Step]):
        self.registry, self.steps = registry, steps
        seen, group = set(), set()
        for s in steps:
            group = group if s.parallel else set()
            if s.name in seen:
                raise ValueError(f"two steps are called {s.name!r}")
            for v in s.args.values():
                for kind, name in REFERENCE.findall(v) if isinstance(v, str) else ():
                    if kind == "steps" and (name not in seen or name in group):
                        raise ValueError(f"{s.name} uses {name!r}, which is not there yet")
            registry.get(s.tool)
            seen.add(s.name)
            group.add(s.name)

    def run(self, **inputs) -> DataFrame:
        done: dict[str, DataFrame] = {}
        for s in self.steps:
            tool = self.registry.get(s.tool)
            done[s.name] = tool.run(**tool.check({k: expand(v, inputs, done) for k, v in s.args.items()}))
        return done[self.steps[-1].name]
