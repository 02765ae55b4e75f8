"""Restricted expression languages, compiled once to columns; nothing is ever evaluated as Python.

`composite` formulas: + - * / **, unary minus, one ==, literals, min, max, abs, names and names in back quotes.
`utility` equations: def utility(x, c): return <expr>, with + - *, powers 0 to 2, five functions, x[0..3] and c[0..7].
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """The text is no formula of the language."""


def _names(text: str) -> tuple[str, dict[str, str]]:
    """Names in back quotes become plain ones."""
    named: dict[str, str] = {}

    def plain(m: re.Match) -> str:
        key = f"__quoted_{len(named)}"
        named[key] = m[1]
        return key

    out = re.sub(r"`([^`]+)`", plain, text)
    if "`" in out:
        raise FormulaError("a back quote is not closed")
    return out, named


def composite(text: str, kinds: Mapping[str, str], fallback: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """The column a formula stands for. kinds: column types by name.

    A value that isn't finite (a division by zero, a missing operand) gives the fallback; then the bounds apply.
    Equality with a missing value is 0. Text in arithmetic and unknown names are errors at once.
    """
    source, quoted = _names(text)
    try:
        tree = ast.parse(source, mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise FormulaError(f"no expression: {text!r}") from e

    def name(node: ast.Name) -> str:
        real = quoted.get(node.id, node.id)
        if real not in kinds:
            raise FormulaError(f"unknown column {real!r}")
        return real

    def number(node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            real = name(node)
            if kinds[real] == "string":
                raise FormulaError(f"text column {real!r} in arithmetic")
            column = F.col(f"`{real}`")
            return column.cast("int").cast("double") if kinds[real] == "boolean" else column.cast("double")
        if isinstance(node, ast.Constant) and isinstance(node.value, bool | int | float):
            return F.lit(float(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -number(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = number(node.left), number(node.right)
            match node.op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return F.try_divide(a, b)
                case ast.Pow():
                    return F.pow(a, b)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], ast.Eq):
            return F.coalesce(value(node.left) == value(node.comparators[0]), F.lit(False)).cast("int").cast("double")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords and node.args:
            args = [number(a) for a in node.args]
            if node.func.id == "abs" and len(args) == 1:
                return F.abs(args[0])
            if node.func.id in ("min", "max") and len(args) > 1:
                # a missing operand makes the whole missing, unlike least and greatest
                missing = args[0].isNull()
                for a in args[1:]:
                    missing = missing | a.isNull()
                return F.when(~missing, (F.least if node.func.id == "min" else F.greatest)(*args))
        raise FormulaError(f"not allowed: {ast.dump(node)[:80]}")

    def value(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return F.lit(node.value)
        if isinstance(node, ast.Name) and kinds[name(node)] == "string":
            return F.col(f"`{name(node)}`")
        return number(node)

    if sum(isinstance(n, ast.Compare) for n in ast.walk(tree)) > 1:
        raise FormulaError("more than one comparison")
    out = number(tree)
    out = F.when(out.isNull() | F.isnan(out) | (F.abs(out) == float("inf")), F.lit(fallback).cast("double")).otherwise(out)
    out = out if low is None else F.greatest(out, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    # least and greatest skip missing values; a missing result stays missing
    return out if fallback is not None or (low is None and high is None) else F.when(number(tree).isNotNull(), out)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_power(x: Column, p: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(p)))


def safe_ratio(a: Column, b: Column) -> Column:
    return a / (b + 1e-8 * F.when(b < 0, -1.0).otherwise(1.0))


def clipped_exp(x: Column) -> Column:
    return F.exp(F.least(F.greatest(x, F.lit(-10.0)), F.lit(10.0)))


#: The functions that a utility equation may call.
UTILITY_FUNCTIONS = {"log1p": signed_log, "exp": clipped_exp, "sqrt": lambda x: F.sqrt(F.abs(x)), "tanh": F.tanh, "abs": F.abs}
UTILITY_INPUTS, UTILITY_COEFFICIENTS = 4, 8


NUMPY_FUNCTIONS = {
    "log1p": lambda x: np.sign(x) * np.log1p(np.abs(x)), "exp": lambda x: np.exp(np.clip(x, -10, 10)), "sqrt": lambda x: np.sqrt(np.abs(x)), "tanh": np.tanh, "abs": np.abs,
}


#: Slopes of the same functions, in columns and in arrays. Where a function bends, the slope is 0.
UTILITY_SLOPES = {
    "log1p": lambda x: 1.0 / (1.0 + F.abs(x)), "exp": lambda x: F.when(F.abs(x) < 10, F.exp(x)).otherwise(0.0),
    "sqrt": lambda x: F.when(x != 0, F.signum(x) / (2.0 * F.sqrt(F.abs(x)))).otherwise(0.0), "tanh": lambda x: 1.0 - F.tanh(x) * F.tanh(x), "abs": F.signum,
}


def _root_slope(x: np.ndarray) -> np.ndarray:
    root = np.sqrt(np.abs(x))
    return np.divide(np.sign(x), 2 * root, out=np.zeros_like(root), where=root > 0)


NUMPY_SLOPES = {
    "log1p": lambda x: 1 / (1 + np.abs(x)), "exp": lambda x: np.where(np.abs(x) < 10, np.exp(np.clip(x, -10, 10)), 0.0),
    "sqrt": _root_slope, "tanh": lambda x: 1 - np.tanh(x) ** 2, "abs": np.sign,
}


def _returned(text: str) -> ast.expr:
    """What a utility equation returns, as a tree."""
    try:
        module = ast.parse(text.strip())
    except (SyntaxError, ValueError) as e:
        raise FormulaError("no function") from e
    if len(module.body) != 1 or not isinstance(f := module.body[0], ast.FunctionDef) or f.name != "utility" or f.decorator_list:
        raise FormulaError("expected def utility(x, c)")
    args = f.args
    if [a.arg for a in args.args] != ["x", "c"] or args.defaults or args.vararg or args.kwarg or args.kwonlyargs or args.posonlyargs:
        raise FormulaError("expected the arguments x and c")
    if len(f.body) != 1 or not isinstance(f.body[0], ast.Return) or f.body[0].value is None:
        raise FormulaError("expected one return")
    return f.body[0].value


def utility(text: str, inputs: list, coefficients: list[float], functions: Mapping[str, Callable] = UTILITY_FUNCTIONS, literal: Callable = F.lit) -> tuple[Any, int]:
    """(column, number of coefficients) of a utility equation; anything outside the grammar raises FormulaError.

    With NUMPY_FUNCTIONS and float as the literal, the inputs and the result are arrays.
    """
    value, slopes = utility_gradient(text, inputs, coefficients, functions, None, literal)
    return value, 1 + max(slopes, default=-1)


def utility_gradient(
    text: str, inputs: list, coefficients: list[float], functions: Mapping[str, Callable] = UTILITY_FUNCTIONS, slopes: Mapping[str, Callable] | None = UTILITY_SLOPES, literal: Callable = F.lit
) -> tuple[Any, dict[int, Any]]:
    """(column, its derivative by each coefficient it has) of a utility equation, both compiled from its tree.

    Without ``slopes`` the derivatives are left out: only the coefficients' numbers stand.
    """

    def joined(a: dict, b: dict, left: Callable, right: Callable) -> dict:
        """Derivatives of what is made of two parts, by the rule for each part."""
        out = {}
        for k in {**a, **b}:
            if slopes is None:
                out[k] = None
                continue
            parts = [f(d[k]) for d, f in ((a, left), (b, right)) if k in d]
            out[k] = parts[0] if len(parts) == 1 else parts[0] + parts[1]
        return out

    def build(node: ast.expr) -> tuple[Any, dict[int, Any]]:
        same, minus = (lambda d: d), (lambda d: -d)
        match node:
            case ast.Constant(value=v) if isinstance(v, int | float) and not isinstance(v, bool):
                return literal(float(v)), {}
            case ast.Subscript(value=ast.Name(id="x"), slice=ast.Constant(value=int(i))) if 0 <= i < UTILITY_INPUTS:
                return inputs[i], {}
            case ast.Subscript(value=ast.Name(id="c"), slice=ast.Constant(value=int(i))) if 0 <= i < UTILITY_COEFFICIENTS:
                return literal(float(coefficients[i] if i < len(coefficients) else 0.0)), {i: literal(1.0)}
            case ast.UnaryOp(op=ast.USub(), operand=a):
                u, du = build(a)
                return -u, joined(du, {}, minus, same)
            case ast.BinOp(left=a, op=ast.Add() | ast.Sub() | ast.Mult() as op, right=b):
                (u, du), (v, dv) = build(a), build(b)
                if isinstance(op, ast.Add):
                    return u + v, joined(du, dv, same, same)
                if isinstance(op, ast.Sub):
                    return u - v, joined(du, dv, same, minus)
                return u * v, joined(du, dv, lambda d: d * v, lambda d: u * d)
            case ast.BinOp(left=a, op=ast.Pow(), right=ast.Constant(value=int(p))) if p in (0, 1, 2):
                u, du = build(a)
                if p == 0:
                    return literal(1.0), joined(du, {}, lambda d: d * 0.0, same)
                return (u, du) if p == 1 else (u * u, joined(du, {}, lambda d: 2.0 * u * d, same))
            case ast.Call(func=ast.Name(id=n), args=[a], keywords=[]) if n in functions:
                u, du = build(a)
                return functions[n](u), joined(du, {}, lambda d: slopes[n](u) * d, same)
        raise FormulaError(f"not allowed: {ast.dump(node)[:80]}")

    return build(_returned(text))


def canonical(node: ast.expr) -> str:
    """An expression's form without its numbers: coefficients and constants as c, sums and products in sorted order."""
    match node:
        case ast.Constant() | ast.Subscript(value=ast.Name(id="c")):
            return "c"
        case ast.UnaryOp(operand=a):
            return canonical(a)
        case ast.BinOp(left=a, op=op, right=b):
            parts = [canonical(a), canonical(b)]
            sign = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Pow: "**"}[type(op)]
            if sign in "+*":
                parts.sort()
            return f"({parts[0]}{sign}{ast.unparse(b) if sign == '**' else parts[1]})"
        case ast.Call(func=f, args=[a]):
            return f"{ast.unparse(f)}({canonical(a)})"
        case _:
            return ast.unparse(node)


def _depth(node: ast.expr) -> int:
    inner = [_depth(n) for n in ast.iter_child_nodes(node) if isinstance(n, ast.expr) and not isinstance(node, ast.Subscript)]
    return 1 + max(inner, default=0)


def concepts(text: str, low: int = 2, high: int = 4) -> set[str]:
    """The canonical forms of an equation's parts of these depths that use an input."""
    tree = _returned(text)
    return {canonical(n) for n in ast.walk(tree) if isinstance(n, ast.BinOp | ast.Call) and low <= _depth(n) <= high and "x[" in ast.unparse(n)}


def trivial(concept: str) -> bool:
    """Whether a canonical part is no abstraction: it has no input, or is a coefficient times an input."""
    return "x[" not in concept or re.fullmatch(r"\(c\*x\[\d\]\)|\(\(c\*x\[\d\]\)\+0\)", concept) is not None


def instance(concept: str, first: int) -> tuple[str, int]:
    """A canonical part as part of an equation: its coefficients numbered from ``first`` on, and the number after them."""
    at = first

    def number(_: re.Match) -> str:
        nonlocal at
        at += 1
        return f"c[{at - 1}]"

    return re.sub(r"\bc\b", number, concept), at
