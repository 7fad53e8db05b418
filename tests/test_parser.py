import random

import pytest

from seriesforge.model import QueryError
from seriesforge.plans.matchers import Matcher, literal_set
from seriesforge.plans.parser import Aggregate, Binary, Number, Selector, Subquery, Unary, duration_ms, parse


class Sentences:
    """Random sentences of the grammar."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def one(self, *choices):
        return self.rng.choice(choices)

    def names(self):
        return ", ".join(self.rng.sample(["site", "floor", "unit", "le"], self.rng.randrange(0, 3)))

    def number(self):
        return self.one("7", "0.25", ".5", "6e2", "2.5E-1", "0x1f", "Inf", "NaN")

    def duration(self):
        return self.one("90s", "15m", "2h", "1d", "1w", "1h30m", "250ms")

    def selector(self):
        matchers = ", ".join(f"{self.one('site', 'floor')}{self.one('=', '!=', '=~', '!~')}{chr(34)}{self.one('a', 'b.c', '')}{chr(34)}" for _ in range(self.rng.randrange(3)))
        name = self.one("pump_flow", "valve:open", "Door_1")
        return self.one(f"{name}{{{matchers}}}" if matchers else name, f'{{__name__="{name}"{", " + matchers if matchers else ""}}}')

    def placed(self, text):
        return text + self.one("", "", f" offset {self.one('', '-')}{self.duration()}", " @ end()", " @ start()", " @ 12.75")

    def vector(self, depth):
        if depth == 0:
            return self.placed(self.selector())
        inner = lambda: self.vector(depth - 1)
        kind = self.rng.randrange(8)
        if kind == 0:
            return self.placed(self.selector())
        if kind == 1:
            return f"{self.one('rate', 'increase', 'last_over_time', 'changes', 'stddev_over_time')}({self.placed(self.selector() + f'[{self.duration()}]')})"
        if kind == 2:
            return f"{self.one('min', 'max', 'avg')}_over_time(({inner()})[{self.duration()}:{self.one('', self.duration())}])"
        if kind == 3:
            by = f" {self.one('by', 'without')} ({self.names()}) "
            body = self.one(f"({inner()})",) if self.rng.random() < 0.7 else f"(({inner()}))"
            return self.one(f"{self.one('sum', 'count', 'stdvar', 'group')}{by}{body}", f"min{body}{by}", f"topk(2, {inner()})", f"quantile by (site) (0.25, {inner()})")
        if kind == 4:
            return self.one(f"abs({inner()})", f"clamp_min({inner()}, {self.number()})", f"round({inner()})", f"vector(scalar({inner()}))", f'label_join({inner()}, "to", "/", "site", "unit")', f'label_replace({inner()}, "to", "<$1>", "site", "(.)x*")')
        if kind == 5:
            return f"-({inner()})"
        operator = self.one("+", "-", "*", "/", "%", "^", "atan2", "==", "!= bool", "<", ">= bool")
        if kind == 6:
            match = self.one("", f"on({self.names()})", f"ignoring({self.names()})")
            group = self.one("", "", "group_left(kind)", "group_right()") if match else ""
            return f"({inner()}) {operator} {match} {group} ({inner()})"
        return self.one(f"({inner()}) {self.one('and', 'or', 'unless')} on({self.names()}) ({inner()})", f"{self.number()} {operator} ({inner()})", f"({inner()}) {operator} {self.number()}")


@pytest.mark.parametrize("seed", range(120))
def test_parses(seed):
    parse(Sentences(seed).vector(3))


@pytest.mark.parametrize("seed", range(40))
def test_precedence(seed):
    """Constant arithmetic equals the same arithmetic with all its brackets."""
    rng = random.Random(seed)
    parts = [str(rng.randrange(1, 9))]
    for _ in range(6):
        parts += [rng.choice("+-*/"), str(rng.randrange(1, 9))]

    def value(node):
        if isinstance(node, Number):
            return node.value
        a, b = value(node.left), value(node.right)
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[node.op]

    assert value(parse(" ".join(parts))) == pytest.approx(eval(" ".join(parts)))


@pytest.mark.parametrize("text", ['{__name__=~".*"}', "m{", "m[5m", "rate(m[5m]", "1 +", 'm{a="b"', "sum(m, n)", "m offset", 'm{a=~"(.*"}', 'm{a=~"(?=x)"}', "a and on(b) group_left c", "", "m offset 5m offset 1m", "1[5m]"])
def test_refuses(text):
    with pytest.raises(QueryError):
        parse(text)


def test_shapes():
    assert parse("-1 ^ 2") == Unary("-", Binary("^", Number(1.0), Number(2.0)))
    assert parse("2 ^ 3 ^ 2") == Binary("^", Number(2.0), Binary("^", Number(3.0), Number(2.0)))
    assert parse("1 - 2 - 3") == Binary("-", Binary("-", Number(1.0), Number(2.0)), Number(3.0))
    got = parse('m{a="b"}[5m] offset -1h30m')
    assert isinstance(got, Selector) and got.range_ms == 300_000 and got.offset_ms == -5_400_000
    assert parse("sum without(a) (m)") == Aggregate("sum", parse("m"), None, ("a",), True)
    sub = parse("m[1h:5m] @ start()")
    assert isinstance(sub, Subquery) and (sub.range_ms, sub.step_ms, sub.at) == (3_600_000, 300_000, "start")
    assert duration_ms("1w2d3h4m5s6ms") == 604_800_000 + 2 * 86_400_000 + 3 * 3_600_000 + 245_006


@pytest.mark.parametrize(("pattern", "values"), [("a|b", ["a", "b"]), ("abc", ["abc"]), ("x(a|b)", ["xa", "xb"]), ("x(?:a|b)z", ["xaz", "xbz"]), (r"a\.b|c", ["a.b", "c"]), ("^a$", ["a"]), ("a.*", None), ("[ab]", None), ("", [""]), ("|".join("abcdefghijk"), None), (r"\d", None)])
def test_literal_set(pattern, values):
    assert literal_set(pattern) == values


def test_matcher():
    assert Matcher("a", "=~", "u.").test("up") and not Matcher("a", "=~", "u").test("up")
    assert Matcher("a", "!=", "").matches_empty() is False
