"""Formulas as double columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek import nodes as n
from sparkseek.errors import fail
from sparkseek.functions import geo
from sparkseek.functions.fields import Scope
from sparkseek.functions.filters import compile_filter

_ONE = {"neg": lambda x: -x, "abs": F.abs, "sqrt": F.sqrt, "log": F.log10, "ln": F.ln, "exp": F.exp}


def compile_formula(node: Any, scope: Scope, score: Column, defaults: dict[str, Any]) -> Column:
    go = lambda x: compile_formula(x, scope, score, defaults)
    if isinstance(node, n.Number):
        return F.lit(float(node.value))
    if isinstance(node, n.Variable):
        own = score if node.name in ("score", "$score") else scope.number(node.name)
        key = next((k for k in defaults if k == node.name or {k, node.name} <= {"score", "$score"}), None)
        return own if key is None else F.coalesce(own, F.lit(float(defaults[key])))
    if isinstance(node, n.Binary):
        left, right = go(node.left), go(node.right)
        if node.op == "/":
            zero = F.raise_error(F.lit("division by zero without a default")).cast("double") if node.default is None else F.lit(node.default)
            return F.when(right == 0, zero).otherwise(left / right)
        return left + right if node.op == "+" else left - right if node.op == "-" else left * right
    if isinstance(node, n.Call):
        args = [go(a) for a in node.args]
        return F.pow(*args) if node.name == "pow" else _ONE[node.name](args[0])
    if isinstance(node, n.GeoDistance):
        lat, lon = scope.number(f"{node.field}.lat"), scope.number(f"{node.field}.lon")
        return geo.distance(lat, lon, node.origin)
    if isinstance(node, n.Matches):
        return F.when(compile_filter(n.In(node.field, node.values), scope), 1.0).otherwise(0.0)
    if isinstance(node, n.DateTime):
        return F.unix_micros(F.to_timestamp(F.lit(node.text))) / F.lit(1e6)
    if isinstance(node, n.DateTimeKey):
        return scope.seconds(node.field)
    if isinstance(node, n.Case):
        return F.when(compile_filter(node.where, scope), go(node.then)).otherwise(go(node.otherwise))
    if isinstance(node, n.Decay):
        x = go(node.x)
        target = F.lit(0.0) if node.target is None else go(node.target)
        scale = F.lit(1.0) if node.scale is None else go(node.scale)
        middle = F.lit(0.5) if node.midpoint is None else go(node.midpoint)
        far = F.abs(x - target)
        if node.kind == "exp":
            return F.exp(F.ln(middle) / scale * far)
        if node.kind == "gauss":
            return F.exp(F.ln(middle) / (scale * scale) * far * far)
        return F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(1.0) - middle) / scale * far)
    return fail("PARSE-SYNTAX", f"no formula: {node!r}")
