"""Strategy documents as dictionaries: parameters, operand classes, reflection and identity.

An operand is a number, "$name" (a parameter), {"op", "a", "b"} or {"ind", ...}; a condition is {"cmp"}, {"cross"},
{"touch"}, {"reject"}, {"break"}, {"bar"}, {"time"}, {"news"}, {"all"}, {"any"}, {"not"}, {"for"} or {"within"}.
"""

from __future__ import annotations

import json
import math
from typing import Any

Operand = Any
Condition = dict[str, Any]

# Operand classes: constant, price level, price difference, oscillator, neutral.
CONSTANT, LEVEL, DIFFERENCE, OSCILLATOR, NEUTRAL = "k", "n", "e", "o", "u"
CLASSES = {
    "close": LEVEL, "open": LEVEL, "high": LEVEL, "low": LEVEL, "hl2": LEVEL, "hlc3": LEVEL, "vwap": LEVEL, "prev": LEVEL, "sess": LEVEL, "or": LEVEL, "at": LEVEL, "level": LEVEL, "nearest": LEVEL,
    "range": DIFFERENCE, "body": DIFFERENCE, "atr": DIFFERENCE, "sd": DIFFERENCE,
    "rsi": OSCILLATOR, "rvol": NEUTRAL, "volume": NEUTRAL, "time": NEUTRAL, "dow": NEUTRAL, "sessmin": NEUTRAL, "dist": NEUTRAL,
}
#: Indicators that take the class of the series they smooth, which is the close unless told.
SMOOTHED = ("sma", "ema", "hh", "ll", "tf")


class DocumentError(ValueError):
    """A document that has no meaning."""


def resolve(node: Any, params: dict[str, float]) -> Any:
    """The document with every "$name" replaced by its parameter."""
    if isinstance(node, str) and node.startswith("$"):
        if node[1:] not in params:
            raise DocumentError(f"no parameter {node}")
        return params[node[1:]]
    if isinstance(node, dict):
        return {k: resolve(v, params) for k, v in node.items()}
    if isinstance(node, list):
        return [resolve(v, params) for v in node]
    return node


def operand_class(x: Operand) -> str:
    """Class of an operand; raises for sums of levels, products with levels, arithmetic on oscillators."""
    if isinstance(x, (int, float)):
        return CONSTANT
    if isinstance(x, str):
        x = {"ind": x}
    if "op" in x:
        a, b = operand_class(x["a"]), operand_class(x["b"])
        if OSCILLATOR in (a, b):
            raise DocumentError("an oscillator takes no part in arithmetic")
        if x["op"] == "-" and a == b == LEVEL:
            return DIFFERENCE
        if x["op"] in "+-":
            if LEVEL in (a, b):
                if a == b or (x["op"] == "-" and b == LEVEL) or NEUTRAL in (a, b):
                    raise DocumentError(f"{a} {x['op']} {b} has no meaning")
                return LEVEL
            return DIFFERENCE if DIFFERENCE in (a, b) else NEUTRAL if NEUTRAL in (a, b) else CONSTANT
        if LEVEL in (a, b):
            raise DocumentError("a price level is neither multiplied nor divided")
        if x["op"] == "/" and a == b == DIFFERENCE:
            return NEUTRAL
        return DIFFERENCE if DIFFERENCE in (a, b) else NEUTRAL if NEUTRAL in (a, b) else CONSTANT
    if x["ind"] in SMOOTHED:
        return operand_class(x.get("of", "close"))
    if x["ind"] not in CLASSES:
        raise DocumentError(f"no indicator {x['ind']}")
    return CLASSES[x["ind"]]


def comparable(a: Operand, b: Operand) -> bool:
    """Whether two operands may be compared: equal classes, or a constant with anything but a level."""
    p, q = operand_class(a), operand_class(b)
    return p == q or (CONSTANT in (p, q) and LEVEL not in (p, q)) or (NEUTRAL in (p, q) and LEVEL not in (p, q) and OSCILLATOR not in (p, q))


# reflection of prices, p -> K - p

_FIELD = {"high": "low", "low": "high"}
_SIDE = {"up": "down", "down": "up", "above": "below", "below": "above", "<": ">", ">": "<", "<=": ">=", ">=": "<=", "hh": "ll", "ll": "hh"}


def mirror_operand(x: Operand) -> tuple[Operand, int]:
    """The reflected operand, and the sign its value takes: -1 for differences and levels alike, 1 for what has none."""
    if isinstance(x, (int, float)):
        return x, 1
    if isinstance(x, str):
        x = {"ind": x}
    kind = operand_class(x)
    if "op" in x:
        (a, s), (b, t) = mirror_operand(x["a"]), mirror_operand(x["b"])
        if x["op"] in "+-" and s != t:
            # a constant distance changes side with the level it is added to
            flip = "-" if x["op"] == "+" else "+"
            if CONSTANT not in (operand_class(x["a"]), operand_class(x["b"])) and DIFFERENCE not in (operand_class(x["a"]), operand_class(x["b"])):
                raise DocumentError("a level and a neutral number have no reflection")
            return {"op": flip, "a": a, "b": b}, s
        return {"op": x["op"], "a": a, "b": b}, s if x["op"] in "+-" else s * t
    out = {k: (mirror_operand(v)[0] if k in ("of", "a", "b") else v) for k, v in x.items()}
    out["ind"] = _SIDE.get(_FIELD.get(x["ind"], x["ind"]), _FIELD.get(x["ind"], x["ind"]))
    if "k" in out:
        out["k"] = -out["k"]
    for key in ("field", "side"):
        if key in out:
            out[key] = _SIDE.get(_FIELD.get(out[key], out[key]), _FIELD.get(out[key], out[key]))
    return out, -1 if kind == LEVEL or x["ind"] in ("body", "dist") else 1


def mirror(condition: Condition) -> Condition:
    """The condition that holds on reflected prices exactly where this one holds."""
    if "all" in condition or "any" in condition:
        key = "all" if "all" in condition else "any"
        return {key: [mirror(c) for c in condition[key]]}
    if "not" in condition:
        return {"not": mirror(condition["not"])}
    for key in ("for", "within"):
        if key in condition:
            return {key: condition[key], "cond": mirror(condition["cond"])}
    if "cmp" in condition:
        kinds = {operand_class(condition["a"]), operand_class(condition["b"])}
        if kinds == {LEVEL, CONSTANT}:
            raise DocumentError("a level against a constant has no reflection")
        (a, s), (b, t) = mirror_operand(condition["a"]), mirror_operand(condition["b"])
        if OSCILLATOR in kinds:
            a, b = ({"op": "-", "a": 100, "b": x} if not isinstance(x, (int, float)) else 100 - x for x in (condition["a"], condition["b"]))
            return {"cmp": _SIDE[condition["cmp"]], "a": condition["a"], "b": b} if isinstance(b, (int, float)) else {"cmp": _SIDE[condition["cmp"]], "a": condition["a"], "b": condition["b"]}
        if s == -1 and t == 1 and isinstance(b, (int, float)):
            return {"cmp": _SIDE[condition["cmp"]], "a": a, "b": -b}
        return {"cmp": _SIDE[condition["cmp"]] if -1 in (s, t) else condition["cmp"], "a": a, "b": b}
    for key in ("cross", "touch", "reject", "break", "bar"):
        if key in condition:
            out = {k: mirror_operand(v)[0] for k, v in condition.items() if k != key}
            return {key: _SIDE[condition[key]], **out}
    return condition


# identity


def canonical(node: Any) -> str:
    """Sorted keys, no blanks, minus zero as zero, whole numbers without a fraction."""

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            if not math.isfinite(x):
                return None
            return int(x) if x == int(x) and abs(x) < 1 << 53 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x

    return json.dumps(plain(node), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fnv1a(text: str) -> str:
    """FNV-1a, 64 bits, in hexadecimal."""
    value = 0xCBF29CE484222325
    for byte in text.encode("utf-8"):
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{value:016x}"


def document_hash(document: dict[str, Any]) -> str:
    """Identity of what a document computes: its rules and parameters, not its name or status."""
    return fnv1a(canonical({k: v for k, v in document.items() if k not in ("id", "name", "status", "note", "hash", "version")}))


_SIGNS = {"above": "from above", "below": "from below", "up": "upwards", "down": "downwards"}


def describe(x: Any) -> str:
    """An operand or condition in words."""
    if isinstance(x, (int, float)):
        return f"{x:g}"
    if isinstance(x, str):
        return x
    if "op" in x:
        return f"({describe(x['a'])} {x['op']} {describe(x['b'])})"
    if "ind" in x:
        told = ", ".join(f"{k} {describe(v)}" for k, v in x.items() if k not in ("ind", "lag"))
        return x["ind"] + (f"({told})" if told else "") + (f" {x['lag']} bars ago" if x.get("lag") else "")
    for key, word in (("all", " and "), ("any", " or ")):
        if key in x:
            return "(" + word.join(describe(c) for c in x[key]) + ")"
    if "not" in x:
        return f"not {describe(x['not'])}"
    if "cmp" in x:
        return f"{describe(x['a'])} {x['cmp']} {describe(x['b'])}"
    if "cross" in x:
        return f"{describe(x['a'])} crosses {describe(x['b'])} {_SIGNS[x['cross']]}"
    for key, word in (("touch", "touches"), ("reject", "rejects"), ("break", "breaks")):
        if key in x:
            return f"price {word} {describe(x['level'])} {_SIGNS[x[key]]}"
    if "bar" in x:
        return f"bar goes {_SIGNS[x['bar']]}"
    if "time" in x:
        return f"time from {describe(x['time'][0])} to {describe(x['time'][1])}"
    if "news" in x:
        return f"no news of impact {describe(x['news'])} from {describe(x.get('before', 0))} bars before to {describe(x.get('after', 0))} after"
    for key, word in (("for", "for"), ("within", "within")):
        if key in x:
            return f"{describe(x['cond'])} {word} {describe(x[key])} bars"
    raise DocumentError(f"no condition {canonical(x)}")


def grid(params: dict[str, list[float]], most: int = 400) -> list[dict[str, float]]:
    """All combinations of one or two parameter lists, in order."""
    out: list[dict[str, float]] = [{}]
    for name, values in params.items():
        out = [{**p, name: v} for p in out for v in values]
    if len(params) > 2 or len(out) > most:
        raise DocumentError(f"a sweep takes two parameters and {most} settings at most")
    return out


def guard(select_to: int, out_of_sample_from: int | None) -> None:
    """Refuse a range that reaches the sealed out-of-sample part."""
    if out_of_sample_from is not None and select_to >= out_of_sample_from:
        raise DocumentError("the range reaches sealed sessions")


# Templates: seven ready documents, by rule; "$" names are parameters.
TEMPLATES: dict[str, dict[str, Any]] = {
    "vwap_band": {"params": {"k": 2.0}, "trigger": {"reject": "below", "level": {"ind": "vwap", "k": -2}}, "stop": {"kind": "atr", "n": 14, "x": 1.0}, "target": {"kind": "r", "x": 1.5}},
    "range_break": {"params": {"to": 2}, "trigger": {"break": "up", "level": {"ind": "or", "field": "high", "from": 0, "to": "$to"}}, "stop": {"kind": "points", "x": 20.0}, "target": {"kind": "r", "x": 2.0}},
    "rsi_return": {"params": {"low": 30}, "trigger": {"cross": "up", "a": {"ind": "rsi", "n": 14}, "b": "$low"}, "stop": {"kind": "atr", "n": 14, "x": 1.5}, "target": {"kind": "r", "x": 1.0}},
    "previous_level": {"params": {}, "trigger": {"reject": "below", "level": {"ind": "prev", "field": "low", "n": 1}}, "stop": {"kind": "points", "x": 15.0}, "target": {"kind": "r", "x": 2.0}},
    "average_pursuit": {"params": {"n": 20}, "trigger": {"cross": "up", "a": "close", "b": {"ind": "ema", "n": "$n"}}, "stop": {"kind": "atr", "n": 14, "x": 2.0}, "target": {"kind": "r", "x": 2.0}},
    "nearest_level": {"params": {}, "trigger": {"reject": "below", "level": {"ind": "nearest", "side": "below"}}, "stop": {"kind": "points", "x": 10.0}, "target": {"kind": "r", "x": 1.5}},
    "previous_close": {"params": {}, "trigger": {"cross": "up", "a": "close", "b": {"ind": "prev", "field": "close", "n": 1}}, "stop": {"kind": "points", "x": 25.0}, "target": {"kind": "r", "x": 1.0}},
}
