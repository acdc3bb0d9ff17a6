"""Recursive descent over the tokens. `parse` takes a script, `parse_one` a single statement."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from sparkseek import nodes as n
from sparkseek.config import FIELD_TYPES, check_block
from sparkseek.errors import fail
from sparkseek.lexer import Token, byte_span, tokenize

MOST_STATEMENTS = 256
DISTANCES = ("COSINE", "DOT", "EUCLID", "MANHATTAN")
KINDS = {"DENSE": "dense", "SPARSE": "sparse", "MULTI": "multi", "MULTIVECTOR": "multi"}
STRATEGIES = ("average_vector", "best_score", "sum_scores")
#: The clauses behind FROM, in their order.
TAIL = ("USING", "PREFETCH", "WHERE", "SHARD", "PARAMS", "SCORE", "GROUP", "WITH PAYLOAD", "WITH VECTOR", "LIMIT", "OFFSET")
_BY_FIRST = {first: [tuple(t.split()) for t in TAIL if t.split()[0] == first] for first in {t.split()[0] for t in TAIL}}
COMPARISONS = ("=", "!=", ">", ">=", "<", "<=")


class Parser:
    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, tokenize(source), 0

    # --- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def step(self) -> Token:
        token = self.now
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return token

    def error(self, code: str, message: str):
        fail(code, f"{message}, found {self.now.text or 'the end'!r}", byte_span(self.source, self.now.start, self.now.stop))

    def is_word(self, *words: str, at: int = 0) -> bool:
        """Whether these keywords come next."""
        i, tokens = self.at + at, self.tokens
        for w in words:
            if i >= len(tokens) or tokens[i].key != w:
                return False
            i += 1
        return True

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += len(words)
            return True
        return False

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            self.error("PARSE-EXPECTED", f"expected {' '.join(words)}")

    def is_mark(self, mark: str) -> bool:
        token = self.tokens[self.at]
        return token.text == mark and token.kind == "mark"

    def mark(self, mark: str) -> bool:
        if self.is_mark(mark):
            self.step()
            return True
        return False

    def need_mark(self, mark: str) -> None:
        if not self.mark(mark):
            self.error("PARSE-EXPECTED", f"expected {mark}")

    def many(self, item: Callable[[], Any], opening: str = "(", closing: str = ")") -> tuple:
        """One or more items in brackets, with commas between."""
        self.need_mark(opening)
        out = [item()]
        while self.mark(","):
            out.append(item())
        self.need_mark(closing)
        return tuple(out)

    def listed(self, item: Callable[[], Any]) -> tuple:
        out = [item()]
        while self.mark(","):
            out.append(item())
        return tuple(out)

    # --- terminals

    def name(self, code: str = "PARSE-IDENTIFIER") -> str:
        if self.now.kind not in ("name", "string"):
            self.error(code, "expected a name")
        return self.step().value

    def field(self) -> str:
        return self.name("PARSE-FIELD")

    def string(self) -> str:
        if self.now.kind != "string":
            self.error("PARSE-EXPECTED", "expected a string")
        return self.step().value

    def number(self, code: str = "PARSE-NUMBER") -> int | float:
        sign = -1 if self.mark("-") else 1
        if self.now.kind not in ("int", "float"):
            self.error(code, "expected a number")
        value = sign * self.step().value
        if isinstance(value, float) and not math.isfinite(value):
            self.error("PARSE-FLOAT", "a number is not finite")
        return value

    def whole(self, least: int) -> int:
        code = "PARSE-POSITIVE-INTEGER" if least else "PARSE-NONNEGATIVE-INTEGER"
        if self.now.kind != "int" or self.now.value < least:
            self.error(code, f"expected an integer of at least {least}")
        if self.now.value >= 1 << 64:
            self.error("PARSE-INTEGER", "an integer is too large")
        return self.step().value

    def positive(self) -> int:
        return self.whole(1)

    def boolean(self, code: str) -> bool:
        if self.is_word("TRUE") or self.is_word("FALSE"):
            return self.step().text.upper() == "TRUE"
        return self.error(code, "expected true or false")

    def point_id(self) -> n.PointId:
        if self.now.kind == "string":
            return self.step().value
        if self.now.kind != "int" or self.now.value >= 1 << 64:
            self.error("PARSE-POINT-ID", "a point id is an unsigned integer or a string")
        return self.step().value

    def point_ids(self) -> tuple[n.PointId, ...]:
        if self.is_mark("(") and self.ahead().kind == "mark" and self.ahead().text == ")":
            self.error("PARSE-POINT-IDS", "a list of point ids is not empty")
        return self.many(self.point_id)

    # --- values

    def scalar(self, code: str = "PARSE-VALUE") -> Any:
        if self.now.kind == "string":
            return self.step().value
        if self.now.kind in ("int", "float") or self.is_mark("-"):
            value = self.number()
            if isinstance(value, int) and not -(1 << 63) <= value < 1 << 64:
                self.error("PARSE-INTEGER", "an integer is too large")
            return value
        if self.now.kind == "name":
            token = self.step()
            return {"TRUE": True, "FALSE": False, "NULL": None}.get(token.text.upper(), token.text)
        return self.error(code, "unexpected value")

    def value(self) -> Any:
        if self.is_mark("{"):
            return dict(self.entries())
        if self.mark("["):
            if self.mark("]"):
                return ()
            out = self.listed(self.value)
            self.need_mark("]")
            return out
        return self.scalar()

    def entries(self) -> tuple[tuple[str, Any], ...]:
        """{key: value, ...}; keys are unique, whatever their case."""
        self.need_mark("{")
        out: list[tuple[str, Any]] = []
        while not self.mark("}"):
            if out:
                self.need_mark(",")
            key = self.name("PARSE-OBJECT-KEY")
            self._once(key, out)
            self.need_mark(":")
            out.append((key, self.value()))
        return tuple(out)

    def _once(self, key: str, seen: list) -> None:
        if any(k.lower() == key.lower() for k, *_ in seen):
            self.error("PARSE-DUPLICATE-KEY", f"{key} occurs twice")

    def block(self) -> tuple[tuple[str, Any], ...]:
        """(key = value, ...)."""
        out: list[tuple[str, Any]] = []

        def entry() -> None:
            key = self.name("PARSE-OBJECT-KEY")
            self._once(key, out)
            self.need_mark("=")
            out.append((key, self.value()))

        self.many(entry)
        return tuple(out)

    def vector(self) -> n.Vector:
        return self.to_vector(self.value())

    def to_vector(self, v: Any) -> n.Vector:
        """The vector that a value stands for."""
        real = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
        if isinstance(v, dict) and sorted(k.lower() for k in v) == ["indices", "values"]:
            low = {k.lower(): x for k, x in v.items()}
            i, x = low["indices"], low["values"]
            if isinstance(i, tuple) and isinstance(x, tuple) and len(i) == len(x) > 0 and all(isinstance(k, int) and 0 <= k < 1 << 32 for k in i) and all(map(real, x)) and len(set(i)) == len(i):
                return n.Sparse(i, tuple(map(float, x)))
        elif isinstance(v, tuple) and v and all(map(real, v)):
            return tuple(map(float, v))
        elif isinstance(v, tuple) and v and all(isinstance(row, tuple) and row and all(map(real, row)) and len(row) == len(v[0]) for row in v):
            return tuple(tuple(map(float, row)) for row in v)
        return self.error("VALIDATION-VECTOR", "expected [numbers], [[numbers], ...] or {indices: [...], values: [...]}")

    def geo(self, v: Any) -> n.Geo:
        low = {k.lower(): x for k, x in v.items()} if isinstance(v, dict) else {}
        if sorted(low) != ["lat", "lon"] or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in low.values()):
            self.error("VALIDATION-GEO", "expected {lat: number, lon: number}")
        lat, lon = float(low["lat"]), float(low["lon"])
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            self.error("VALIDATION-GEO", "a latitude is in [-90, 90] and a longitude in [-180, 180]")
        return n.Geo(lat, lon)

    # --- filters

    def filter(self) -> Any:
        parts = [self.conjunction()]
        while self.word("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else n.Or(tuple(parts))

    def conjunction(self) -> Any:
        parts = [self.negation()]
        while self.word("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else n.And(tuple(parts))

    def negation(self) -> Any:
        return n.Not(self.negation()) if self.word("NOT") else self.condition()

    def condition(self) -> Any:
        if self.mark("("):
            inner = self.filter()
            self.need_mark(")")
            return inner
        if self.is_word("NESTED") and self.ahead().text == "(":
            self.at += 2
            path = self.string()
            self.need_mark(",")
            inner = self.filter()
            self.need_mark(")")
            return n.Nested(path, inner)
        if self.is_word("HAS_VECTOR") and self.ahead().kind in ("name", "string") and not self.is_word("IS", at=1):
            self.step()
            return n.HasVector(self.name())
        quoted = self.now.kind == "string"
        field = self.field()
        return self.id_condition() if field.lower() == "id" and not quoted else self.predicate(field)

    def literals(self, code: str) -> tuple:
        if not self.is_mark("(") or self.ahead().text == ")":
            self.error(code, "expected a list that is not empty")
        return self.many(lambda: self.scalar("PARSE-LITERAL"))

    def operator(self) -> str:
        if self.now.kind != "mark" or self.now.text not in COMPARISONS:
            self.error("PARSE-COMPARISON", "expected a comparison")
        return self.step().text

    def id_condition(self) -> Any:
        no = self.is_word("NOT", "IN")
        if no or self.is_word("IN"):
            self.at += 2 if no else 1
            ids = self.literals("PARSE-IN")
        elif self.is_mark("=") or self.is_mark("!="):
            no = self.step().text == "!="
            ids = (self.scalar("PARSE-LITERAL"),)
        else:
            self.error("VALIDATION-ID-PREDICATE", "an id is compared by =, !=, IN or NOT IN")
        for i in ids:
            if isinstance(i, bool) or not (isinstance(i, str) or isinstance(i, int) and i >= 0):
                self.error("VALIDATION-POINT-ID", "a point id is an unsigned integer or a string")
        return n.Not(n.IdIn(ids)) if no else n.IdIn(ids)

    def predicate(self, field: str) -> Any:
        if self.now.kind == "mark" and self.now.text in COMPARISONS:
            op = self.step().text
            value = self.value()
            return n.Not(n.Compare(field, "=", value)) if op == "!=" else n.Compare(field, op, value)
        if self.word("BETWEEN"):
            low = self.value()
            self.need_word("AND")
            return n.Between(field, low, self.value())
        if self.word("NOT", "IN"):
            return n.Not(n.In(field, self.literals("PARSE-IN")))
        if self.word("IN"):
            return n.In(field, self.literals("PARSE-IN"))
        if self.word("IS"):
            no = self.word("NOT")
            if not (self.is_word("NULL") or self.is_word("EMPTY")):
                self.error("PARSE-FILTER", "expected NULL or EMPTY")
            inner = n.IsNull(field) if self.step().text.upper() == "NULL" else n.IsEmpty(field)
            return n.Not(inner) if no else inner
        if self.word("MATCH", "ANY"):
            return n.In(field, self.literals("PARSE-MATCH-ANY"))
        if self.word("MATCH", "PHRASE"):
            return n.MatchPhrase(field, self.string())
        if self.word("MATCH"):
            return n.MatchText(field, self.string())
        if self.word("VALUES_COUNT"):
            op = self.operator()
            count = n.ValuesCount(field, "=" if op == "!=" else op, self.whole(0))
            return n.Not(count) if op == "!=" else count
        if self.word("GEO_BBOX"):
            shape = self._shape("top_left", "bottom_right")
            return n.GeoBox(field, self.geo(shape["top_left"]), self.geo(shape["bottom_right"]))
        if self.word("GEO_RADIUS"):
            shape = self._shape("center", "radius")
            radius = shape["radius"]
            if isinstance(radius, bool) or not isinstance(radius, (int, float)) or radius <= 0:
                self.error("VALIDATION-GEO", "a radius is positive")
            return n.GeoRadius(field, self.geo(shape["center"]), float(radius))
        if self.word("GEO_POLYGON"):
            shape = self._shape("exterior", "interiors", least=1)
            holes = shape.get("interiors", ())
            if not isinstance(holes, tuple):
                self.error("VALIDATION-GEO", "interiors are a list of rings")
            return n.GeoPolygon(field, self._ring(shape["exterior"]), tuple(map(self._ring, holes)))
        return self.error("PARSE-FILTER", "expected a condition")

    def _shape(self, *keys: str, least: int | None = None) -> dict:
        found = {k.lower(): v for k, v in self.entries()}
        if not set(keys[:least]) <= set(found) <= set(keys):
            self.error("VALIDATION-GEO", f"expected {{{', '.join(keys)}}}")
        return found

    def _ring(self, v: Any) -> tuple[n.Geo, ...]:
        if not isinstance(v, tuple) or len(v) < 3:
            self.error("VALIDATION-GEO", "a ring has at least three points")
        return tuple(map(self.geo, v))

    # --- formulas

    def formula(self) -> Any:
        left = self.product()
        while self.is_mark("+") or self.is_mark("-"):
            left = n.Binary(self.step().text, left, self.product())
        return left

    def product(self) -> Any:
        left = self.unary()
        while self.is_mark("*") or self.is_mark("/"):
            op, right, default = self.step().text, self.unary(), None
            if op == "/" and self.is_mark("[") and self.is_word("DEFAULT", at=1):
                self.at += 2
                self.need_mark("=")
                default = float(self.number())
                self.need_mark("]")
            left = n.Binary(op, left, right, default)
        return left

    def unary(self) -> Any:
        return n.Call("neg", (self.unary(),)) if self.mark("-") else self.operand()

    def operand(self) -> Any:
        if self.now.kind in ("int", "float"):
            return n.Number(float(self.number()))
        if self.mark("("):
            inner = self.formula()
            self.need_mark(")")
            return inner
        if self.word("CASE", "WHEN"):
            where = self.filter()
            self.need_word("THEN")
            then = self.formula()
            self.need_word("ELSE")
            other = self.formula()
            self.need_word("END")
            return n.Case(where, then, other)
        if self.now.kind != "name":
            self.error("PARSE-SYNTAX", "expected a formula")
        if self.ahead().text != "(" or self.ahead().kind != "mark":
            return n.Variable(self.step().text)
        name = self.now.text.lower()
        if name in ("abs", "sqrt", "log", "ln", "exp"):
            self.step()
            return n.Call(name, self._arguments(name, 1))
        if name == "pow":
            self.step()
            return n.Call(name, self._arguments(name, 2))
        if name in ("exp_decay", "gauss_decay", "lin_decay"):
            self.step()
            return self.decay(name.split("_")[0])
        self.at += 2
        if name in ("match", "match_any"):
            field = self.field()
            self.need_mark(",")
            found = self.value()
            out: Any = n.Matches(field, found if isinstance(found, tuple) else (found,))
        elif name == "datetime":
            out = n.DateTime(self.string())
        elif name == "datetime_key":
            out = n.DateTimeKey(self.string())
        elif name == "geo_distance":
            if self.is_mark("{"):
                origin = self.geo(self.value())
                self.mark(",")
            else:
                lat = self.number()
                self.need_mark(",")
                origin = self.geo({"lat": lat, "lon": self.number()})
                self.need_mark(",")
            out = n.GeoDistance(origin, self.field())
        else:
            self.at -= 2
            self.error("PARSE-SYNTAX", f"unknown function {name}")
        self.need_mark(")")
        return out

    def _arguments(self, name: str, count: int) -> tuple:
        out = self.many(self.formula)
        if len(out) != count:
            self.error("PARSE-SYNTAX", f"{name} takes {count} arguments")
        return out

    def decay(self, kind: str) -> n.Decay:
        order, found = ("x", "target", "scale", "midpoint"), {}

        def argument() -> None:
            key = self.now.text.lower()
            if self.now.kind == "name" and key in (*order, "decay") and self.ahead().text == "=":
                self.at += 2
                key = "midpoint" if key == "decay" else key
            elif len(found) < 4 and order[len(found)] not in found:
                key = order[len(found)]
            else:
                self.error("PARSE-SYNTAX", "too many arguments")
            if key in found:
                self.error("PARSE-SYNTAX", f"{key} occurs twice")
            found[key] = self.formula()

        self.many(argument)
        if "x" not in found:
            self.error("PARSE-SYNTAX", "a decay needs x")
        return n.Decay(kind, found["x"], found.get("target"), found.get("scale"), found.get("midpoint"))

    # --- query expressions

    def input(self) -> n.Input:
        if self.word("TEXT"):
            return n.Text(self.string(), self.model())
        if self.word("IMAGE"):
            return n.Image(self.string(), self.model())
        if self.word("VECTOR"):
            return n.VectorInput(self.vector())
        if self.word("POINT"):
            return n.PointInput(self.point_id())
        if self.now.kind == "string":
            return n.Text(self.string())
        return self.error("PARSE-QUERY-INPUT", "expected TEXT, IMAGE, VECTOR, POINT or a string")

    def model(self) -> str | None:
        return self.string() if self.word("MODEL") else None

    def pairs(self) -> tuple[tuple[n.Input, n.Input], ...]:
        if not self.is_mark("(") or self.ahead().text == ")":
            self.error("PARSE-CONTEXT", "CONTEXT has at least one pair")

        def pair() -> tuple[n.Input, n.Input]:
            self.need_word("POSITIVE")
            a = self.input()
            self.need_word("NEGATIVE")
            return a, self.input()

        return self.many(pair)

    def fusion_method(self) -> str:
        if not (self.is_word("RRF") or self.is_word("DBSF")):
            self.error("VALIDATION-FUSION", "the fusion is RRF or DBSF")
        return self.step().text.lower()

    def hybrid_names(self) -> dict:
        out = {}
        if self.word("DENSE"):
            out["dense"] = self.name()
        if self.word("SPARSE"):
            out["sparse"] = self.name()
        if self.word("FUSION"):
            out["method"] = self.fusion_method()
        return out

    def expression(self) -> Any:
        if self.word("POINTS"):
            return n.Points(self.point_ids())
        if self.word("RECOMMEND"):
            self.need_word("POSITIVE")
            positive = self.point_ids()
            negative = self.point_ids() if self.word("NEGATIVE") else ()
            strategy = STRATEGIES[0]
            if self.word("STRATEGY"):
                strategy = self.now.text.lower()
                if self.now.kind != "name" or strategy not in STRATEGIES:
                    self.error("VALIDATION-RECOMMEND-STRATEGY", f"the strategy is one of {', '.join(STRATEGIES)}")
                self.step()
            return n.Recommend(positive, negative, strategy)
        if self.word("CONTEXT"):
            return n.Context(self.pairs())
        if self.word("DISCOVER"):
            self.need_word("TARGET")
            target = self.input()
            self.need_word("CONTEXT")
            return n.Discover(target, self.pairs())
        if self.word("ORDER", "BY"):
            field = self.field()
            return n.OrderBy(field, not self.word("ASC") and self.word("DESC"))
        if self.word("SAMPLE"):
            if not self.word("RANDOM"):
                self.error("PARSE-SAMPLE", "expected RANDOM")
            return n.Sample()
        if self.word("FUSION"):
            return n.Fusion(self.fusion_method())
        if self.word("FORMULA"):
            expr = self.formula()
            return n.Formula(expr, self.block() if self.word("DEFAULTS") else ())
        if self.word("RELEVANCE", "FEEDBACK"):
            return self.feedback()
        if self.word("MMR"):
            start = self.input()
            self.need_word("DIVERSITY")
            diversity = float(self.number())
            if not 0 <= diversity <= 1:
                self.error("VALIDATION-MMR", "DIVERSITY is in [0, 1]")
            self.need_word("CANDIDATES")
            return n.Mmr(start, diversity, self.positive())
        if self.word("HYBRID"):
            text = self.input()
            if not isinstance(text, n.Text):
                self.error("VALIDATION-HYBRID", "HYBRID takes text")
            return n.Hybrid(text, **self.hybrid_names())
        if self.word("CROSS", "RERANK"):
            self.word("TEXT")
            if self.now.kind != "string":
                self.error("PARSE-CROSS-RERANK", "CROSS RERANK takes text")
            text = self.string()
            self.need_word("MODEL")
            model = self.string()
            return n.CrossRerank(text, model, self.field() if self.word("ON", "FIELD") else "text")
        if self.word("RERANK"):
            if not any(self.is_word(w) for w in ("TEXT", "VECTOR", "POINT")):
                self.error("PARSE-RERANK", "RERANK takes TEXT, VECTOR or POINT")
            if self.word("TEXT"):
                start: n.Input = n.Text(self.string())
            else:
                start = self.input()
            self.need_word("MODEL")
            return n.Rerank(start, self.string())
        self.word("NEAREST")
        return n.Nearest(self.input())

    def feedback(self) -> n.Feedback:
        self.need_word("TARGET")
        target = self.input()
        self.need_word("FEEDBACK")

        def item() -> tuple[n.Input, float]:
            self.need_mark("(")
            example = self.input()
            self.need_mark(",")
            score = float(self.number())
            self.need_mark(")")
            return example, score

        items = self.many(item)
        self.need_word("STRATEGY", "NAIVE")
        self.need_mark("(")
        found = []
        for i, key in enumerate("abc"):
            if i and not self.mark(",") or not self.is_word(key.upper()):
                self.error("PARSE-FEEDBACK-STRATEGY", "NAIVE takes a, b and c in this order")
            self.step()
            self.need_mark("=")
            found.append(float(self.number()))
        if not self.mark(")"):
            self.error("PARSE-FEEDBACK-STRATEGY", "NAIVE takes a, b and c in this order")
        return n.Feedback(target, items, *found)

    # --- queries

    def with_query(self) -> n.Query:
        ctes: list[tuple[str, n.Query]] = []
        if self.word("WITH"):

            def table() -> None:
                name = self.name()
                if any(k.lower() == name.lower() for k, _ in ctes):
                    self.error("PARSE-DUPLICATE-CTE", f"{name} is defined twice")
                self.need_word("AS")
                self.need_mark("(")
                self.need_word("QUERY")
                ctes.append((name, self.query(False, tuple(ctes))))
                self.need_mark(")")

            self.listed(table)
        self.need_word("QUERY")
        return self.query(True, tuple(ctes))

    def query(self, top: bool, ctes: tuple) -> n.Query:
        expr = self.expression()
        collection = self.name() if self.word("FROM") else None
        if collection is None and top:
            self.error("VALIDATION-FROM", "a query needs FROM")
        given: dict[str, Any] = {"expr": expr, "collection": collection, "ctes": ctes}
        last = -1
        while (clause := self.clause()) is not None:
            place = TAIL.index(clause)
            if place <= last:
                self.error("PARSE-CLAUSE-ORDER", f"{clause} is out of order or occurs twice")
            last = place
            given |= self.tail(expr, clause, ctes)
        return check_query(n.Query(**given))

    def clause(self) -> str | None:
        for words in _BY_FIRST.get(self.tokens[self.at].key, ()):
            if self.is_word(*words):
                return " ".join(words)
        if self.is_word("WITH"):
            return self.error("PARSE-EXPECTED", "expected PAYLOAD or VECTOR")
        return None

    def tail(self, expr: Any, clause: str, ctes: tuple) -> dict[str, Any]:
        """What a clause gives to the fields of the query."""
        put = dict
        for _ in clause.split():
            self.step()
        if clause == "USING":
            if self.is_word("HYBRID"):
                self.step()
                if not isinstance(expr, n.Nearest) or not isinstance(expr.input, n.Text):
                    self.error("VALIDATION-HYBRID", "USING HYBRID takes a text query")
                return put(expr=n.Hybrid(expr.input, **self.hybrid_names()))
            name, kind = self.name(), None
            if self.word("AS"):
                kind = KINDS.get(self.now.text.upper()) if self.now.kind == "name" else None
                if kind is None:
                    self.error("PARSE-VECTOR-KIND", "expected DENSE, SPARSE, MULTI or MULTIVECTOR")
                self.step()
            return put(using=n.Target(name, kind))
        if clause == "PREFETCH":
            if self.is_mark("(") and self.ahead().text == ")":
                self.error("PARSE-PREFETCH", "PREFETCH is not empty")
            return put(prefetch=self.many(lambda: self.prefetch(ctes)))
        if clause == "WHERE":
            return put(where=self.filter())
        if clause == "SHARD":
            return put(shard=self.string())
        if clause == "PARAMS":
            return put(params=self.params())
        if clause == "SCORE":
            self.need_word("THRESHOLD")
            value = float(self.number("VALIDATION-SCORE"))
            return put(threshold=value)
        if clause == "GROUP":
            self.need_word("BY")
            field = self.field()
            size = self.positive() if self.word("SIZE") else None
            return put(group=n.Group(field, size, self.name() if self.word("LOOKUP", "FROM") else None))
        if clause == "WITH PAYLOAD":
            return put(payload=self.payload_selector())
        if clause == "WITH VECTOR":
            return put(vectors=self.vector_selector())
        return put(limit=self.positive()) if clause == "LIMIT" else put(offset=self.whole(0))

    def names(self) -> tuple[str, ...]:
        if self.is_mark("(") and self.ahead().text == ")":
            self.error("PARSE-SELECTOR", "a selector is not empty")
        return self.many(self.name)

    def payload_selector(self) -> n.Selector:
        if self.word("INCLUDE"):
            return n.Selector(include=self.names())
        if self.word("EXCLUDE"):
            return n.Selector(exclude=self.names())
        return n.Selector(self.boolean("PARSE-PAYLOAD-SELECTOR"))

    def vector_selector(self) -> n.Selector:
        if self.is_mark("("):
            return n.Selector(include=self.names())
        return n.Selector(self.boolean("PARSE-SELECTOR")) if self.is_word("TRUE") or self.is_word("FALSE") else n.Selector(True)

    def prefetch(self, ctes: tuple) -> n.Prefetch:
        if self.word("QUERY"):
            source: Any = self.query(False, ctes)
        else:
            source = self.name()
            if not any(k.lower() == source.lower() for k, _ in ctes):
                self.error("VALIDATION-PREFETCH-CTE", f"{source} is not defined")
        where = self.filter() if self.word("WHERE") else None
        threshold = float(self.number("VALIDATION-SCORE")) if self.word("SCORE", "THRESHOLD") else None
        lookup = self.name() if self.word("LOOKUP", "FROM") else None
        return n.Prefetch(source, where, threshold, lookup, self.name() if lookup and self.word("VECTOR") else None)

    def params(self) -> tuple[tuple[str, Any], ...]:
        out: list[tuple[str, Any]] = []

        def param() -> None:
            key = self.name().lower()
            self._once(key, out)
            self.need_mark("=")
            if key in ("hnsw_ef", "rrf_k", "timeout"):
                value: Any = self.positive()
            elif key in ("exact", "acorn", "indexed_only"):
                value = self.boolean("VALIDATION-SEARCH-PARAM")
            elif key == "max_selectivity":
                value = float(self.number())
                if value <= 0:
                    self.error("VALIDATION-SEARCH-PARAM", "max_selectivity is positive")
            elif key == "rrf_weights":
                value = tuple(map(float, self.many(self.number, "[", "]")))
            elif key == "quantization":
                value = tuple(self.entries())
                if any(k.lower() not in ("ignore", "rescore", "oversampling") for k, _ in value):
                    self.error("VALIDATION-SEARCH-PARAM", "quantization takes ignore, rescore and oversampling")
            elif key == "consistency":
                value = self.scalar()
                if isinstance(value, bool) or not (isinstance(value, int) and value >= 0 or isinstance(value, str) and value.lower() in ("majority", "quorum", "all")):
                    self.error("VALIDATION-CONSISTENCY", "consistency is a number, majority, quorum or all")
            else:
                self.error("VALIDATION-SEARCH-PARAM", f"unknown parameter {key}")
            out.append((key, value))

        self.many(param)
        found = dict(out)
        if "max_selectivity" in found and not found.get("acorn"):
            self.error("VALIDATION-ACORN-SELECTIVITY", "max_selectivity needs acorn = true")
        return tuple(out)

    # --- points

    def shard(self) -> str | None:
        return self.string() if self.word("SHARD") else None

    def scroll(self) -> n.Scroll:
        self.need_word("FROM")
        name = self.name()
        where = self.filter() if self.word("WHERE") else None
        after = self.point_id() if self.word("AFTER") else None
        shard = self.shard()
        vectors = self.vector_selector() if self.word("WITH", "VECTOR") else None
        self.need_word("LIMIT")
        return n.Scroll(name, self.positive(), where, after, shard, vectors)

    def count(self) -> n.Count:
        self.need_word("FROM")
        name = self.name()
        where = self.filter() if self.word("WHERE") else None
        shard, exact = self.shard(), True
        if self.word("WITH"):
            entries = self.block()
            if [k.lower() for k, _ in entries] != ["exact"] or not isinstance(entries[0][1], bool):
                self.error("PARSE-COUNT-CONFIG", "COUNT takes exact = true or exact = false")
            exact = entries[0][1]
        if any(self.is_word(w) for w in ("WHERE", "SHARD", "WITH")):
            self.error("PARSE-CLAUSE-ORDER", "a clause is out of order or occurs twice")
        return n.Count(name, where, shard, exact)

    def upsert(self) -> n.Upsert:
        self.need_word("INTO")
        name = self.name()
        self.need_word("VALUES")
        points = self.listed(self.point)
        specs: list[n.Embedding] = []
        if self.word("USING"):
            specs += self.listed(self.embedding)
        if self.word("EMBED"):
            specs += self.listed(self.directive)
        return n.Upsert(name, points, tuple(specs), self.shard())

    def point(self) -> n.Point:
        payload, vectors, point_id = [], [], None
        for key, value in self.entries():
            if key.lower() == "id":
                if isinstance(value, bool) or not (isinstance(value, str) or isinstance(value, int) and value >= 0):
                    self.error("VALIDATION-UPSERT-ID", "a point's id is an unsigned integer or a string")
                point_id = value
            elif key.lower() in ("vector", "vectors"):
                named = isinstance(value, dict) and sorted(k.lower() for k in value) != ["indices", "values"]
                vectors += [(k, self.to_vector(v)) for k, v in value.items()] if named else [(None, self.to_vector(value))]
            else:
                payload.append((key, value))
        if point_id is None:
            self.error("VALIDATION-UPSERT-ID", "a point needs an id")
        return n.Point(point_id, tuple(vectors), tuple(payload))

    def _modifiers(self) -> dict:
        out: dict[str, str] = {}
        while True:
            if self.word("MODEL"):
                key, value = "model", self.string()
            elif self.is_word("VECTOR") or self.is_word("INTO"):
                self.step()
                key, value = "into", self.name()
            elif self.word("ON"):
                self.word("FIELD")
                key, value = "field", self.field()
            else:
                return out
            if key in out:
                self.error("PARSE-EMBEDDING", f"{key} occurs twice")
            out[key] = value

    def embedding(self) -> n.Embedding:
        if self.word("HYBRID"):
            dense = self._modifiers() if self.word("DENSE") else {}
            sparse = self._modifiers() if self.word("SPARSE") else {}
            if self.is_word("DENSE") or self.is_word("SPARSE"):
                self.error("PARSE-EMBEDDING", "a side of HYBRID occurs twice")
            return n.Embedding("hybrid", dense.get("model"), dense.get("into"), dense.get("field") or sparse.get("field"), sparse.get("model"), sparse.get("into"))
        kind = "image" if self.is_word("IMAGE") else KINDS.get(self.now.text.upper()) if self.now.kind == "name" else None
        if kind:
            self.step()
        found = self._modifiers()
        if not kind and not found:
            self.error("PARSE-EXPECTED", "expected an embedding")
        return n.Embedding(kind or "dense", **found)

    def directive(self) -> n.Embedding:
        field = self.field()
        self.need_word("INTO")
        into, kind, model = self.name(), "dense", None
        if self.word("USING"):
            found = "image" if self.is_word("IMAGE") else KINDS.get(self.now.text.upper())
            if found:
                self.step()
                kind = found
            elif not self.is_word("MODEL"):
                self.error("PARSE-EMBED", "expected DENSE, SPARSE, MULTI, IMAGE or MODEL")
            model = self.model()
        return n.Embedding(kind, model, into, field, explicit=True)

    def mandatory_where(self) -> Any:
        self.need_word("WHERE")
        return self.filter()

    def delete(self) -> Any:
        if self.word("FROM"):
            return n.Delete(self.name(), self.mandatory_where(), self.shard())
        if self.word("PAYLOAD"):
            keys = self.listed(self.field)
            self.need_word("FROM")
            name = self.name()
            return n.DeletePayload(name, keys, self.mandatory_where(), self.shard())
        self.need_word("VECTOR")
        names = self.listed(self.name)
        self.need_word("FROM")
        name = self.name()
        return n.DeleteVector(name, names, self.mandatory_where(), self.shard())

    def update(self) -> Any:
        collection = self.name()
        self.need_word("SET")
        if self.word("VECTOR"):
            name = None if self.is_mark("=") else self.name()
            self.need_mark("=")
            vector = self.vector()
            self.need_word("WHERE")
            if not self.is_word("ID"):
                self.error("VALIDATION-ID-PREDICATE", "SET VECTOR takes WHERE id = ...")
            self.step()
            self.need_mark("=")
            return n.UpdateVector(collection, name, vector, self.point_id(), self.shard())
        if not self.word("PAYLOAD"):
            self.error("PARSE-UPDATE", "expected VECTOR or PAYLOAD")
        self.need_mark("=")
        payload = self.entries()
        return n.UpdatePayload(collection, payload, self.mandatory_where(), self.shard())

    # --- collections

    def config(self, allowed: tuple[str, ...], alter: bool = False) -> tuple[tuple[str, tuple], ...]:
        out: list[tuple[str, tuple]] = []
        while self.is_word("WITH"):
            block = self.ahead().text.upper()
            if block not in allowed:
                self.step()
                self.error("PARSE-EXPECTED", f"expected {', '.join(allowed)}")
            self.at += 2
            self._once(block, out)
            out.append((block, check_block("SPARSE" if block == "INDEX" else block, self.block(), alter)))
        return tuple(out)

    def create(self) -> Any:
        if self.word("INDEX"):
            self.need_word("ON", "COLLECTION")
            collection = self.name()
            self.need_word("FOR")
            field, kind, options = self.field(), None, ()
            if self.word("TYPE"):
                if self.now.kind != "name" or self.now.text.lower() not in FIELD_TYPES:
                    self.error("PARSE-INDEX-TYPE", f"the type is one of {', '.join(FIELD_TYPES)}")
                kind = self.step().text.lower()
            if self.word("WITH"):
                options = check_block("INDEX", self.block())
            return n.CreateIndex(collection, field, kind, options)
        if self.word("SHARD"):
            self.need_word("KEY")
            key = self.string()
            self.need_word("ON", "COLLECTION")
            name, options = self.name(), ()
            if self.word("WITH"):
                options = tuple((k.lower(), v) for k, v in self.block())
                if any(k not in ("shards_number", "replication_factor") or isinstance(v, bool) or not isinstance(v, int) or v < 1 for k, v in options):
                    self.error("PARSE-SHARD-KEY-CONFIG", "a shard key takes shards_number and replication_factor, both positive integers")
            return n.CreateShardKey(key, name, options)
        self.need_word("COLLECTION")
        return self.create_collection(self.name())

    def create_collection(self, name: str) -> n.CreateCollection:
        found: dict[str, Any] = {"mode": "plain"}
        if self.word("USING"):
            if self.word("HYBRID"):
                found["mode"] = "hybrid"
                if self.is_word("MODEL"):
                    self.error("VALIDATION-CREATE-MODEL", "HYBRID takes no single model")
            else:
                self.word("DENSE")
                self.need_word("MODEL")
                found |= {"mode": "dense", "model": self.string()}
        elif self.word("HYBRID"):
            found["mode"] = "hybrid"
            if self.is_word("MODEL"):
                self.error("VALIDATION-CREATE-MODEL", "HYBRID takes no single model")
            if self.word("RERANK"):
                found["mode"] = "hybrid_rerank"
            else:
                if self.word("DENSE", "VECTOR"):
                    found["dense"] = self.name()
                if self.word("SPARSE", "VECTOR"):
                    found["sparse"] = self.name()
        vectors: list[n.VectorSpec] = []
        if self.is_mark("("):

            def one() -> None:
                spec = self.vector_spec()
                if any(v.name == spec.name for v in vectors):
                    self.error("PARSE-DUPLICATE-KEY", f"{spec.name} is defined twice")
                vectors.append(spec)

            self.many(one)
        config = self.config(("HNSW", "VECTOR", "OPTIMIZERS", "PARAMS", "QUANTIZATION"))
        return n.CreateCollection(name, vectors=tuple(vectors), config=config, **found)

    def vector_spec(self) -> n.VectorSpec:
        name = self.name()
        if self.word("SPARSE"):
            return n.VectorSpec(name, "sparse", config=self.config(("SPARSE", "INDEX")))
        if not self.word("VECTOR"):
            self.error("PARSE-SYNTAX", "expected VECTOR or SPARSE")
        self.need_mark("(")
        if self.now.kind != "int" or self.now.value < 1:
            self.error("PARSE-SYNTAX", "a vector has a positive size")
        size = self.step().value
        self.need_mark(",")
        distance = self.now.text.upper()
        if self.now.kind != "name" or distance not in DISTANCES:
            self.error("PARSE-SYNTAX", f"the distance is one of {', '.join(DISTANCES)}")
        self.step()
        self.need_mark(")")
        config = self.config(("HNSW", "QUANTIZATION", "MULTIVECTOR", "VECTOR"))
        return n.VectorSpec(name, "multi" if any(k == "MULTIVECTOR" for k, _ in config) else "dense", size, distance, config)

    def drop(self) -> Any:
        if self.word("COLLECTION"):
            return n.DropCollection(self.name())
        if self.word("INDEX"):
            self.need_word("ON", "COLLECTION")
            name = self.name()
            self.need_word("FOR")
            return n.DropIndex(name, self.field())
        self.need_word("SHARD", "KEY")
        key = self.string()
        self.need_word("ON", "COLLECTION")
        return n.DropShardKey(key, self.name())

    def alter(self) -> n.AlterCollection:
        self.need_word("COLLECTION")
        name = self.name()
        config = self.config(("HNSW", "VECTOR", "OPTIMIZERS", "PARAMS", "QUANTIZATION"), alter=True)
        return n.AlterCollection(name, config) if config else self.error("PARSE-EXPECTED", "expected WITH")

    def show(self) -> Any:
        if self.word("COLLECTIONS"):
            return n.ShowCollections()
        if self.word("COLLECTION"):
            return n.ShowCollection(self.name())
        self.need_word("SHARD", "KEYS", "ON", "COLLECTION")
        return n.ShowShardKeys(self.name())

    # --- scripts

    def statement(self) -> Any:
        if self.is_word("QUERY") or self.is_word("WITH"):
            return self.with_query()
        kinds = {"SCROLL": self.scroll, "COUNT": self.count, "UPSERT": self.upsert, "DELETE": self.delete, "UPDATE": self.update, "CREATE": self.create, "ALTER": self.alter, "DROP": self.drop, "SHOW": self.show}
        word = self.now.text.upper() if self.now.kind == "name" else ""
        if word == "CLEAR":
            self.step()
            self.need_word("PAYLOAD", "FROM")
            return n.ClearPayload(self.name(), self.mandatory_where(), self.shard())
        if word not in kinds:
            self.error("PARSE-STATEMENT", "unknown statement")
        self.step()
        return kinds[word]()

    def script(self) -> list[Any]:
        out: list[Any] = []
        while self.now.kind != "end":
            if self.is_mark(";"):
                self.error("PARSE-EMPTY-STATEMENT", "a statement is empty")
            if len(out) == MOST_STATEMENTS:
                self.error("PARSE-STATEMENT-LIMIT", f"a script has at most {MOST_STATEMENTS} statements")
            out.append(self.statement())
            if not self.mark(";") and self.now.kind != "end":
                words = ("QUERY", "WITH", "SCROLL", "COUNT", "UPSERT", "DELETE", "UPDATE", "CREATE", "ALTER", "DROP", "SHOW", "CLEAR")
                if any(self.is_word(w) for w in words):
                    self.error("PARSE-SEPARATOR", "statements are separated by ;")
                if isinstance(out[-1], n.Query) and self.now.kind == "name" and self.now.text.upper() in {t.split()[0] for t in TAIL}:
                    self.error("PARSE-CLAUSE-ORDER", "a clause is out of order or occurs twice")
                self.error("PARSE-EXPECTED" if self.is_mark(")") else "PARSE-TRAILING", "unexpected token")
        return out


def check_query(q: n.Query) -> n.Query:
    """What can be said of a query without a schema."""
    expr, least = q.expr, {n.Fusion: "FUSION", n.Rerank: "RERANK", n.CrossRerank: "CROSS-RERANK"}
    if type(expr) in least and not q.prefetch:
        fail(f"VALIDATION-{least[type(expr)]}-PREFETCH", "the query needs PREFETCH")
    if isinstance(expr, n.Rerank) and q.using is None:
        fail("VALIDATION-RERANK-USING", "RERANK needs USING")
    if isinstance(expr, n.Points) and (q.using or q.prefetch or q.where is not None or q.params or q.threshold is not None or q.group or q.limit is not None or q.offset is not None):
        fail("VALIDATION-POINTS-CLAUSE", "POINTS takes SHARD, WITH PAYLOAD and WITH VECTOR only")
    if isinstance(expr, (n.OrderBy, n.Sample, n.Hybrid)):
        if q.using:
            fail("VALIDATION-HYBRID" if isinstance(expr, n.Hybrid) else "VALIDATION-USING", "the query takes no USING")
        if q.prefetch:
            fail("VALIDATION-HYBRID" if isinstance(expr, n.Hybrid) else "VALIDATION-PREFETCH", "the query takes no PREFETCH")
    if (q.limit or 0) + (q.offset or 0) >= 1 << 64 or isinstance(expr, n.Hybrid) and (q.limit or 0) * 10 >= 1 << 64:
        fail("VALIDATION-LIMIT-OVERFLOW", "LIMIT and OFFSET are too large")
    params = dict(q.params)
    if "rrf_k" in params or "rrf_weights" in params:
        method = expr.method if isinstance(expr, (n.Fusion, n.Hybrid)) else None
        if method != "rrf":
            fail("PLAN-RRF-PARAMS", "rrf_k and rrf_weights go with RRF only")
        sources = len(q.prefetch) if isinstance(expr, n.Fusion) else 2
        if "rrf_weights" in params and len(params["rrf_weights"]) != sources:
            fail("PLAN-RRF-WEIGHTS", "rrf_weights has a number for each source")
    inputs = [expr.input] if isinstance(expr, (n.Nearest, n.Mmr, n.Rerank)) else []
    inputs += [expr.target] if isinstance(expr, (n.Discover, n.Feedback)) else []
    inputs += [i for pair in getattr(expr, "pairs", ()) for i in pair] + [i for i, _ in getattr(expr, "items", ())]
    kinds = {"sparse" if isinstance(i.vector, n.Sparse) else "dense" for i in inputs if isinstance(i, n.VectorInput)}
    if len(kinds) > 1 or q.using and q.using.kind and kinds and (q.using.kind == "sparse") != (kinds == {"sparse"}):
        fail("PLAN-VECTOR-KIND", "the input and the vector are of different kinds")
    return q


def parse(source: str) -> list[Any]:
    """The statements of a script."""
    return Parser(source).script()


def parse_one(source: str) -> Any:
    out = parse(source)
    if len(out) != 1:
        fail("PARSE-EXPECTED", "expected one statement")
    return out[0]


def is_valid(source: str) -> bool:
    from sparkseek.errors import SeekError

    try:
        parse(source)
    except SeekError:
        return False
    return True
