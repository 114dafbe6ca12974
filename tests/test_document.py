"""Documents: identity, classes, parameters, reflection."""

from __future__ import annotations

import pytest

from tideframe.plans.document import DocumentError, canonical, document_hash, fnv1a, grid, guard, mirror, operand_class, resolve


def test_identity():
    assert fnv1a("") == "cbf29ce484222325"
    assert fnv1a("a") == "af63dc4c8601ec8c"
    assert canonical({"b": -0.0, "a": [1.0, None]}) == '{"a":[1,null],"b":0}'
    assert document_hash({"trigger": {"bar": "up"}, "name": "x"}) == document_hash({"trigger": {"bar": "up"}, "name": "y"})


def test_classes():
    assert operand_class({"op": "-", "a": "close", "b": "open"}) == "e"
    assert operand_class({"op": "+", "a": "close", "b": {"ind": "atr", "n": 14}}) == "n"
    for bad in ({"op": "+", "a": "close", "b": "open"}, {"op": "*", "a": "close", "b": 2}, {"op": "+", "a": {"ind": "rsi", "n": 3}, "b": 1}):
        with pytest.raises(DocumentError):
            operand_class(bad)


def test_parameters_and_guard():
    assert resolve({"a": "$k", "b": [1, "$k"]}, {"k": 3}) == {"a": 3, "b": [1, 3]}
    with pytest.raises(DocumentError):
        resolve("$no", {})
    assert len(grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    with pytest.raises(DocumentError):
        guard(10, 10)


def test_mirror_is_its_own_inverse():
    for c in (
        {"reject": "above", "level": {"ind": "vwap", "k": -1}},
        {"cross": "up", "a": "close", "b": {"ind": "sma", "n": 5}},
        {"all": [{"bar": "up"}, {"not": {"touch": "below", "level": {"ind": "prev", "field": "high", "n": 1}}}]},
        {"for": 3, "cond": {"cmp": ">", "a": "close", "b": {"ind": "hh", "n": 5, "of": "high"}}},
    ):
        twice = mirror(mirror(c))
        assert canonical(mirror(twice)) == canonical(mirror(c))
    with pytest.raises(DocumentError):
        mirror({"cmp": ">", "a": "close", "b": 100})


def test_described():
    from tideframe.plans.document import TEMPLATES, describe

    assert describe({"all": [{"cmp": ">", "a": "close", "b": {"ind": "sma", "n": 12}}, {"not": {"bar": "up"}}]}) == "(close > sma(n 12) and not bar goes upwards)"
    assert describe({"cross": "up", "a": {"ind": "close", "lag": 3}, "b": {"op": "-", "a": "high", "b": 2.5}}) == "close 3 bars ago crosses (high - 2.5) upwards"
    assert describe({"for": 3, "cond": {"reject": "below", "level": {"ind": "vwap", "k": -2}}}) == "price rejects vwap(k -2) from below for 3 bars"
    assert all(describe(t["trigger"]) for t in TEMPLATES.values())
