"""Plans: a linear list of steps, as objects and as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


class PlanError(ValueError):
    pass


@dataclass
class Step:
    op: str
    args: dict = field(default_factory=dict)


class Param(dict):
    """A value that is filled in when the plan is run; in JSON an object with the key $param."""


def param(name: str, default=None) -> Param:
    return Param({"$param": name, "default": default})


def _filled(x, values: dict):
    if isinstance(x, dict):
        if "$param" in x:
            if x["$param"] not in values and x.get("default") is None:
                raise PlanError(f"no value for parameter {x['$param']}")
            return values.get(x["$param"], x.get("default"))
        return {k: _filled(v, values) for k, v in x.items()}
    return [_filled(v, values) for v in x] if isinstance(x, (list, tuple)) else x


DECODERS = ("codec.csv.decode", "codec.jsonl.decode", "codec.text.decode", "codec.parquet.decode")
ENCODERS = ("codec.csv.encode", "codec.jsonl.encode", "codec.text.encode", "codec.table.encode", "codec.parquet.encode")


@dataclass
class Plan:
    steps: list[Step]

    def to_json(self) -> str:
        return json.dumps({"steps": [{"op": s.op, "args": s.args} for s in self.steps]})

    @classmethod
    def from_json(cls, text: str | dict) -> Plan:
        data = json.loads(text) if isinstance(text, str) else text
        if not isinstance(data, dict) or not isinstance(data.get("steps"), list):
            raise PlanError('a plan is an object with a list "steps"')
        for s in data["steps"]:
            if not isinstance(s, dict) or not isinstance(s.get("op"), str):
                raise PlanError('each step needs a string "op"')
        return cls([Step(s["op"], dict(s.get("args") or {})) for s in data["steps"]]).validate()

    def validate(self) -> Plan:
        from ..operators import OPS

        if not self.steps:
            raise PlanError("empty plan")
        for k, s in enumerate(self.steps):
            if s.op in DECODERS:
                if k:
                    raise PlanError(f"{s.op} must come first")
            elif s.op in ENCODERS:
                if k < len(self.steps) - 1:
                    raise PlanError(f"{s.op} must come last")
            elif s.op not in OPS:
                raise PlanError(f"unknown operator {s.op}")
            else:
                missing = [a for a in OPS[s.op].required if s.args.get(a) in (None, "", [], {})]
                if missing:
                    raise PlanError(f"{s.op}: missing {', '.join(missing)}")
        return self

    @property
    def capabilities(self) -> dict[str, bool]:
        """What holds for all its operators: whether the plan runs on a stream, holds bounded memory in a task, gives the same result each time, and whether it reads no further files."""
        from ..operators import OPS

        ops = [OPS[s.op] for s in self.steps if s.op in OPS]
        ends = [s.op for s in self.steps if s.op == "codec.table.encode"]
        return {
            "streaming": all(o.stateless or o.stateful for o in ops) and not ends,
            "bounded_memory": all(o.bounded for o in ops) and not ends,
            "deterministic": all(o.deterministic or s.args.get("seed") is not None for o, s in zip(ops, (s for s in self.steps if s.op in OPS))),
            "no_files": not any(o.files for o in ops),
        }

    def with_params(self, values: dict) -> Plan:
        """The plan with its parameters filled in."""
        return Plan([Step(s.op, _filled(s.args, values)) for s in self.steps])

    @property
    def streamable(self) -> bool:
        """Whether every transform runs row by row, so that the plan runs on a streaming DataFrame as it is."""
        from ..operators import OPS

        return all(OPS[s.op].stateless for s in self.steps if s.op in OPS)
