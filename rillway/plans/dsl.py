"""The pipe language: `csv | filter "col(age) > 30" | sort -age | csv`, parsed to a plan."""

from __future__ import annotations

import re

from .plan import Plan, Step


class DslError(ValueError):
    pass


CODECS = ("csv", "jsonl", "text", "table", "parquet")
AGGS = ("sum", "avg", "count", "min", "max", "stddev", "var", "median")


def _split(text: str, sep: str) -> list[str]:
    """Parts between sep (a character or white space), outside quotes and parentheses."""
    out, held, quote, depth = [], "", "", 0
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        if not quote and not depth and c != ")" and (c == sep or sep == " " and c.isspace()):
            out.append(held)
            held = ""
        else:
            held += c
    if quote:
        raise DslError(f"unclosed quote in {text!r}")
    return out + [held]


def _bare(t: str) -> str:
    return t[1:-1] if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'" else t


def _tokens(stage: str) -> list[str]:
    return [t for t in _split(stage.strip(), " ") if t]


def _list(tokens: list[str]) -> list[str]:
    return [x.strip() for t in tokens for x in _bare(t).split(",") if x.strip()]


def _pairs(tokens: list[str]) -> dict[str, str]:
    out = {}
    for t in tokens:
        for part in _split(t, ",") if t.count("=") > 1 and "(" not in t else [t]:
            if "=" in part:
                k, v = part.split("=", 1)
                out[k.strip()] = _bare(v)
    return out


def _number(t: str):
    return float(t) if re.search(r"[.eE]|inf|nan", t) else int(t)


def _count(op: str, tokens: list[str], least: int) -> dict:
    try:
        n = int(tokens[0])
    except (IndexError, ValueError):
        raise DslError(f"{op} needs a number") from None
    if n < least:
        raise DslError(f"{op} needs a number of {least} or more")
    return {"n": n}


def _flags(tokens: list[str]) -> tuple[set[str], list[str]]:
    return {t for t in tokens if re.fullmatch(r"--?[A-Za-z][A-Za-z-]*", t)}, [t for t in tokens if not re.fullmatch(r"--?[A-Za-z][A-Za-z-]*", t)]


def _codec_args(tokens: list[str]) -> dict:
    args: dict = {}
    for t in tokens:
        k, _, v = t.partition("=")
        v = _bare(v)
        if k == "repair":
            args["repair"] = v != "false"
        elif k == "header":
            args["header"] = v != "false"
        elif k == "delimiter":
            args["delimiter"] = {"tab": "\t", "\\t": "\t"}.get(v, v)
        elif k in ("batch_size", "max_width", "max_rows", "infer_rows"):
            args[k] = int(v)
        elif k == "path":
            args["path"] = v
    return args


def _step(op: str, t: list[str]) -> dict:
    bare = [_bare(x) for x in t]
    first = bare[0] if bare else None
    if op in ("filter", "validate"):
        if not t:
            raise DslError(f"{op} needs an expression")
        return {"expr": _bare(t[0]) if len(t) == 1 else " ".join(t)}
    if op in ("select", "reorder", "unique", "dedup", "trim", "hash", "frequency", "fill-down", "unpivot", "stats"):
        if op == "stats":
            return {"stats": [x for x in _list(t) if x not in ("--exact", "--approx")]} | {x.lstrip("-"): True for x in bare if x in ("--exact", "--approx")}
        return {"columns": _list(t)}
    if op == "rename":
        return {"mapping": _pairs([y for x in t for y in _split(x, ",")])}
    if op == "derive":
        cols = []
        for x in t:
            if "=" not in x:
                raise DslError(f"derive: expected name=expression, got {x!r}")
            k, v = x.split("=", 1)
            cols.append({"name": k, "expr": _bare(v)})
        return {"columns": cols}
    if op in ("cast", "fill-null"):
        return {"mapping": _pairs(t)}
    if op == "head":
        return _count(op, t, 0)
    if op == "sample":
        seed = [x.partition("=")[2] for x in bare[1:] if x.startswith("seed=")] + [b for a, b in zip(bare[1:], bare[2:]) if a == "--seed"]
        return _count(op, t, 1) | ({"seed": int(seed[0])} if seed else {})
    if op in ("skip", "tail"):
        return _count(op, t, 1 if op != "skip" else 0)
    if op == "top":
        args = _count(op, t, 1)
        c = bare[1] if len(bare) > 1 else ""
        return args | {"column": c.lstrip("+-"), "desc": not c.startswith("+")}
    if op == "sort":
        return {"columns": [{"name": c.lstrip("+-"), "desc": c.startswith("-")} for c in _list(t)]}
    if op == "grep":
        opts, rest = _flags(t)
        rest = [_bare(x) for x in rest]
        if not rest:
            raise DslError("grep needs a pattern")
        letters = "".join(o.lstrip("-") for o in opts if o != "--regex")
        return {"pattern": rest[0], "column": rest[1] if len(rest) > 1 else "_line", "invert": "v" in letters, "regex": "r" in letters or "--regex" in opts}
    if op == "replace":
        opts, rest = _flags(t[:1])
        rest = [_bare(x) for x in rest + t[1:]]
        if len(rest) < 3:
            raise DslError("replace needs column, pattern and replacement")
        return {"column": rest[0], "pattern": rest[1], "replacement": rest[2], "regex": bool(opts)}
    if op == "clip":
        args, named = {"column": first}, _pairs(t[1:])
        plain = [x for x in bare[1:] if "=" not in x]
        for k, v in zip(("min", "max"), plain):
            args[k] = _number(v)
        return args | {k: _number(v) for k, v in named.items() if k in ("min", "max")}
    if op == "bin":
        return {"column": first, "boundaries": [_number(x) for x in _list(t[1:])]}
    if op == "split":
        return {"column": first, "delimiter": bare[1] if len(bare) > 1 else " ", "names": _list(t[2:])}
    if op == "datetime":
        return {"column": first, "extract": _list(t[1:])}
    if op == "date-trunc":
        return {"column": first, "trunc": bare[1] if len(bare) > 1 else "day"} | ({"result": bare[2]} if len(bare) > 2 else {})
    if op == "flatten":
        return {}
    if op == "split-data":
        opts = {}
        rest = list(bare)
        if "--seed" in rest:
            k = rest.index("--seed")
            opts["seed"] = int(rest[k + 1])
            del rest[k : k + 2]
        for x in rest:
            if x.startswith("result="):
                opts["result"] = x[7:]
            elif x.startswith("ratio="):
                opts["ratio"] = float(x[6:])
            elif x:
                opts["ratio"] = float(x)
        return opts
    if op == "stack":
        args = {"file": first}
        if "--tag" in bare:
            args["tag"] = bare[bare.index("--tag") + 1]
        return args
    if op == "join":
        args = {"file": first, "how": "inner"}
        rest = bare[1:]
        k = 0
        while k < len(rest):
            x = rest[k]
            if x == "on" and k + 1 < len(rest):
                args["on"] = rest[k + 1]
                k += 1
            elif x.startswith("on="):
                args["on"] = x[3:]
            elif x.startswith("--"):
                args["how"] = x[2:]
            k += 1
        return args
    if op == "group-agg":
        keys, aggs = [], []
        for x in t:
            parts = _bare(x).split(":")
            if len(parts) == 1:
                keys += _list([x])
            else:
                col, func = parts[0], parts[1]
                if func not in AGGS and col in AGGS:
                    col, func = func, col
                aggs.append({"column": col, "func": func} | ({"name": parts[2]} if len(parts) > 2 else {}))
        return {"group_by": keys, "aggs": aggs}
    if op == "window":
        if len(bare) < 3:
            raise DslError("window needs column, size and function")
        return {"column": first, "size": int(bare[1]), "func": bare[2]} | ({"result": bare[3]} if len(bare) > 3 else {})
    if op == "step":
        if len(bare) < 2:
            raise DslError("step needs column and function")
        return {"column": first, "func": bare[1]} | ({"result": bare[2]} if len(bare) > 2 else {})
    if op in ("lead", "diff"):
        args: dict = {"column": first}
        for x in bare[1:]:
            if re.fullmatch(r"\d+", x):
                args["offset" if op == "lead" else "order"] = int(x)
            else:
                args["result"] = x
        return args
    if op in ("ewma", "anomaly"):
        key = "alpha" if op == "ewma" else "threshold"
        args = {"column": first}
        for x in bare[1:]:
            try:
                args[key] = float(x)
            except ValueError:
                args["result"] = x
        return args
    if op == "interpolate":
        return {"column": first, "method": bare[1] if len(bare) > 1 else "linear"}
    if op == "normalize":
        cols = _list(t)
        method = cols.pop() if len(cols) > 1 and cols[-1] in ("minmax", "zscore") else "minmax"
        return {"columns": cols, "method": method}
    if op == "acf":
        return {"column": first, "lags": int(bare[1]) if len(bare) > 1 else 20}
    if op == "label-encode":
        return {"column": first} | ({"result": bare[1]} if len(bare) > 1 else {})
    if op == "onehot":
        opts, rest = _flags(t)
        return {"column": _bare(rest[0]) if rest else None, "drop": "--drop" in opts}
    if op == "explode":
        return {"column": first, "delimiter": bare[1] if len(bare) > 1 else ","}
    if op == "pivot":
        return {"name_column": first, "value_column": bare[1] if len(bare) > 1 else None, "agg": bare[2] if len(bare) > 2 else "first"}
    raise DslError(f"unknown operator {op!r}")


def parse_dsl(text: str) -> Plan:
    stages = [s.strip() for s in _split(text, "|")]
    if any(not s for s in stages):
        raise DslError("empty stage")
    steps = []
    for k, stage in enumerate(stages):
        op, *rest = _tokens(stage)
        if op in CODECS and (k in (0, len(stages) - 1)):
            way = "decode" if k == 0 and op != "table" else "encode"
            steps.append(Step(f"codec.{op}.{way}", _codec_args(rest)))
        else:
            steps.append(Step(op, _step(op, rest)))
    return Plan(steps).validate()
