"""Parsing of semi-structured replies: source lists, judge and classifier JSON."""

from __future__ import annotations

import ast
import json
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import count

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from citelode.functions import text as T

# Fixed values -------------------------------------------------------------------
SOURCES_HEADER = "מקורות:"
REFUSAL = "אין לי מספיק מידע במסמכים כדי לענות על שאלה זו."
CITATION_LOOKALIKES = "־–—｜："
CITATION_PLAIN = "---|:"
CITATION_LINE = (
    r'(?mi)^[-•]\s*file:\s*([^|]+?)\s*\|\s*page:\s*(-|null|\d+)\s*(?:\|\s*quote:\s*"([^"]*)")?\s*$'
)
NON_ANSWERS = (
    "אינו מציין", "אינה מציינת", "אינו מפרט", "לא מצוין", "לא מצויין",
    "אין מידע", "לא מופיע", "אינו כולל מידע", "לא נמסר מידע", "הדף אינו",
    "המסמך אינו", "does not state", "does not specify", "no information",
)
#: Difficulties, and limits of a generated item in characters.
LEVELS = ("easy", "medium", "hard")
LEAST_QUESTION, LEAST_ANSWER, SKIP_CHARS = 20, 10, 200
VERDICTS = ("correct", "partially_correct", "incorrect", "refusal")
SUPPORT = ("fully", "partially", "not_at_all")
LABELS = ("establishes", "partial", "unrelated")
MAX_EXPRESSION = 500
#: Ours: page of a citation whose number does not fit.
BEYOND = 2**63 - 1
MAX_EXPONENT = 100
#: Ours: bits of an integer power, so that nested powers cannot stop an executor.
MAX_BITS = 1 << 16
# --------------------------------------------------------------------------------


def source_list(text: Column) -> Column:
    """Citations after the last sources header as ``array<struct<file,page,quote>>``;
    empty without a header. A null page is a citation without one; a number too long for a
    page is ``BEYOND``, which no document has."""
    cleaned = F.translate(T.strip_format_chars(text), CITATION_LOOKALIKES, CITATION_PLAIN)
    block = F.when(
        F.contains(cleaned, F.lit(SOURCES_HEADER)), F.substring_index(cleaned, SOURCES_HEADER, -1)
    ).otherwise("")
    part = lambda group: F.regexp_extract_all(block, F.lit(CITATION_LINE), F.lit(group))
    rows = F.arrays_zip(part(1).alias("file"), part(2).alias("page"), part(3).alias("quote"))
    return F.transform(
        rows,
        lambda r: F.struct(
            T.strip(r["file"]).alias("file"),
            F.when(r["page"].rlike(r"^\d+$"), F.coalesce(r["page"].try_cast("bigint"), F.lit(BEYOND))).alias("page"),
            F.nullif(r["quote"], F.lit("")).alias("quote"),
        ),
    )


def without_source_list(text: Column) -> Column:
    """Answer text up to its last sources header."""
    tail = F.length(F.substring_index(text, SOURCES_HEADER, -1)) + len(SOURCES_HEADER)
    body = F.rtrim(F.left(text, F.length(text) - tail), F.lit(T.SPACE_CHARS))
    return F.when(F.contains(text, F.lit(SOURCES_HEADER)), body).otherwise(text)


def is_refusal(text: Column) -> Column:
    return F.contains(text, F.lit(REFUSAL)) & ~F.contains(text, F.lit(SOURCES_HEADER))


def is_non_answer(text: Column) -> Column:
    found = F.lit(False)
    for marker in NON_ANSWERS:
        found = found | F.contains(text, F.lit(marker))
    return found


def json_object(text: Column) -> Column:
    """Outermost braces of a reply, code fences and prose aside; null without one."""
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.nullif(span, F.lit(""))


def truthy(value: Column) -> Column:
    """Whether a JSON value (a variant) holds something: not missing, null, false, zero or empty."""
    text = F.to_json(value)
    zero = F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False)) & ~text.startswith('"')
    return F.coalesce(~text.isin("null", "false", '""', "[]", "{}") & ~zero, F.lit(False))


def judgment(reply: Column) -> Column:
    """Judge reply to ``struct<verdict,hallucination,correctness,completeness,
    conversational_quality,reasoning,claims>``; null when the reply breaks the schema. Any value that is not
    empty counts as a hallucination; ``claims`` is kept (as JSON text) if it is an object."""
    raw = F.from_json(
        json_object(reply),
        "verdict string, hallucination variant, correctness double, completeness double, "
        "conversational_quality double, reasoning string, claims variant",
    )
    verdict = F.lower(T.strip(raw["verdict"]))
    score = lambda f: F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.bround(raw[f]))).cast("int").alias(f)
    valid = (
        verdict.isin(*VERDICTS) & raw["correctness"].isNotNull()
        & raw["completeness"].isNotNull() & raw["conversational_quality"].isNotNull()
    )
    claims = F.to_json(raw["claims"])
    return F.when(
        valid,
        F.struct(
            verdict.alias("verdict"), (truthy(raw["hallucination"]) & (verdict != "refusal")).alias("hallucination"),
            score("correctness"), score("completeness"), score("conversational_quality"),
            T.strip(F.coalesce(raw["reasoning"], F.lit(""))).alias("reasoning"),
            F.when(claims.startswith("{"), claims).alias("claims"),
        ),
    )


def _kept_text(value: Column) -> Column:
    return T.strip(F.coalesce(value, F.lit("")))


def generated(reply: Column) -> Column:
    """Generator reply to ``struct<skip,question,ground_truth_answer,rationale>``: a skip with its reason (cut to
    ``SKIP_CHARS``), or an item. Null when it is neither: no object, or question or answer too short."""
    text = json_object(reply)
    raw = F.from_json(text, "skip string, question string, ground_truth_answer string, rationale string")
    skips = F.array_contains(F.json_object_keys(text), "skip")
    question, answer = _kept_text(raw["question"]), _kept_text(raw["ground_truth_answer"])
    nothing = F.lit(None).cast("string")
    item = F.struct(nothing.alias("skip"), question.alias("question"), answer.alias("ground_truth_answer"), _kept_text(raw["rationale"]).alias("rationale"))
    skip = F.struct(
        F.substring(F.coalesce(raw["skip"], F.lit("None")), 1, SKIP_CHARS).alias("skip"), nothing.alias("question"),
        nothing.alias("ground_truth_answer"), nothing.alias("rationale"),
    )
    fits = (F.length(question) >= LEAST_QUESTION) & (F.length(answer) >= LEAST_ANSWER)
    return F.when(F.coalesce(skips, F.lit(False)), skip).when(F.coalesce(fits, F.lit(False)) & raw.isNotNull(), item)


def difficulty_ruling(reply: Column) -> Column:
    """``struct<difficulty,reason>`` of a difficulty reply; null for another word."""
    raw = F.from_json(json_object(reply), "difficulty string, reason string")
    level = F.lower(T.strip(raw["difficulty"]))
    return F.when(level.isin(*LEVELS), F.struct(level.alias("difficulty"), _kept_text(raw["reason"]).alias("reason")))


def citation_judgment(reply: Column, n_citations: Column) -> Column:
    """Support ruling and one label per citation; a citation without a valid label is
    ``unrelated``, of two labels the later counts."""
    raw = F.from_json(json_object(reply), "citation_support string, per_citation array<struct<idx int, label string>>")
    support = F.lower(T.strip(raw["citation_support"]))
    given = F.filter(
        F.coalesce(raw["per_citation"], F.array()),
        lambda e: F.lower(T.strip(e["label"])).isin(*LABELS),
    )
    places = F.when(n_citations > 0, F.sequence(F.lit(0), n_citations - 1)).otherwise(F.array().cast("array<int>"))
    labels = F.transform(
        places,
        lambda i: F.coalesce(
            F.lower(T.strip(F.try_element_at(F.filter(given, lambda e: e["idx"] == i), F.lit(-1))["label"])),
            F.lit("unrelated"),
        ),
    )
    return F.when(support.isin(*SUPPORT), F.struct(support.alias("support"), labels.alias("labels")))


def sub_questions(reply: Column, categories: list[str]) -> Column:
    """Classifier reply to ``array<struct<question,categories>>``: blank questions go,
    unknown categories go, repeated ones count once. ``reply`` is a JSON object."""
    raw = F.from_json(reply, "sub_questions array<struct<question string, categories array<string>>>")
    known = F.array(*[F.lit(c) for c in categories])
    shaped = F.transform(
        F.coalesce(raw["sub_questions"], F.array()),
        lambda s: F.struct(
            T.strip(F.coalesce(s["question"], F.lit(""))).alias("question"),
            F.array_distinct(
                F.filter(F.coalesce(s["categories"], F.array()), lambda c: F.array_contains(known, c))
            ).alias("categories"),
        ),
    )
    return F.filter(shaped, lambda s: s["question"] != "")


def category_union(subs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(subs, lambda s: s["categories"])))


def retained(proposed: Column, reply: Column, known: list[str]) -> Column:
    """Second-stage reply ``{"keep": [...]}``: it can only take tags away. A malformed
    reply keeps every tag."""
    keep = F.from_json(json_object(reply), "keep array<string>")["keep"]
    allowed = F.array_intersect(keep, F.array(*[F.lit(c) for c in known]))
    return F.when(keep.isNull(), proposed).otherwise(F.filter(proposed, lambda c: F.array_contains(allowed, c)))


# -- helpers that need Python -------------------------------------------------------

_MARK = re.compile(r'\\.|["{}\[\],:]|\s+|[^\\"{}\[\],:\s]+|\\', re.S)
_STARTS = frozenset('"{[-0123456789tfn')
_PARTNER = {"}": "{", "]": "["}


def _last_quotes(marks: list[str]) -> set[int]:
    """Places of quotes that can end a string: at the end, before a colon or a closer, or
    before a comma with a new value behind it. White space is no neighbour."""
    solid = [at for at, mark in enumerate(marks) if not mark.isspace()]
    ends = set()
    for at, second, third in zip(solid, [*solid[1:], None], [*solid[2:], None, None]):
        follow = "" if second is None else marks[second]
        value = "" if third is None else marks[third][0]
        if marks[at] == '"' and (follow in ("", ":", "}", "]") or follow == "," and value in _STARTS):
            ends.add(at)
    return ends


def mend_json(text: str) -> str:
    """Escape stray quotes inside strings and drop closers that close nothing. The text is
    cut into marks once, and each quote is judged by the marks around it."""
    marks = _MARK.findall(text)
    ends, opened, quoted = _last_quotes(marks), [], False
    for at, mark in enumerate(marks):
        if mark == '"' and quoted and at not in ends:
            marks[at] = '\\"'
        elif mark[-1] == '"' and (mark == '"' or not quoted):
            quoted = not quoted
        elif not quoted and mark in ("{", "["):
            opened.append(mark)
        elif not quoted and mark in _PARTNER:
            if opened[-1:] == [_PARTNER[mark]]:
                opened.pop()
            else:
                marks[at] = ""
    return "".join(marks)


@F.pandas_udf(StringType())
def _mend_objects(spans: pd.Series) -> pd.Series:
    def mend(span):
        if span is None:
            return None
        fixed = mend_json(span)
        try:
            return fixed if isinstance(json.loads(fixed), dict) else None
        except ValueError:
            return None

    return spans.map(mend)


def repaired_object(text: Column) -> Column:
    """JSON object of a reply, mended if it does not parse as it stands. Replies that
    parse never reach Python."""
    span = json_object(text)
    fine = F.try_parse_json(span).isNotNull()
    return F.when(fine, span).otherwise(_mend_objects(F.when(~fine, span)))


#: Binding strength of the binary operators; a power binds to the right and tighter than
#: a sign before it.
_STRENGTH = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "**": 4}
_SIGN = 3
_FUNCTIONS = {"round": (1, 2), "abs": (1, 1), "min": (2, None), "max": (2, None)}
_ITEM = re.compile(r"\s*(?:(?P<number>(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>\*\*|//|[-+*/%(),]))")


def _items(expression: str) -> list[str]:
    items, at = [], 0
    expression = expression.rstrip()
    while at < len(expression):
        found = _ITEM.match(expression, at)
        if not found:
            raise ValueError("only arithmetic is allowed")
        items.append(found[found.lastgroup])
        at = found.end()
    return items


def _power(base: float, exponent: float) -> float:
    if abs(exponent) > MAX_EXPONENT:
        raise ValueError("exponent too large")
    if isinstance(base, int) and isinstance(exponent, int) and base.bit_length() * abs(exponent) > MAX_BITS:
        raise ValueError("result too large")
    result = base**exponent
    if isinstance(result, complex):
        raise ValueError("not a number")
    return result


#: The functions that an expression may call, and the operators with two sides.
_CALLS = {"round": round, "abs": abs, "min": min, "max": max}
_BINARY = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "//": operator.floordiv, "%": operator.mod, "**": _power,
}


def _number(item: str) -> float:
    """A number as Python reads it; what plain digits and points do not settle is left to Python."""
    if item.isascii() and item.isdigit() and (item[0] != "0" or len(item) == 1):
        return int(item)
    if item.isascii() and "_" not in item and not item.isdigit():
        return float(item)
    return ast.literal_eval(item)


def _apply(values: list[float], action: str | tuple[str, int]) -> None:
    """Replace the last values by the result of an operator, a sign or a call."""
    if isinstance(action, tuple):
        name, count = action
        least, most = _FUNCTIONS[name]
        if count < least or most is not None and count > most:
            raise ValueError("wrong number of arguments")
        given = values[len(values) - count :]
        del values[len(values) - count :]
        values.append(_CALLS[name](*given))
        return
    right = values.pop()
    if action in ("u+", "u-"):
        values.append(right if action == "u+" else -right)
        return
    left = values.pop()
    values.append(_BINARY[action](left, right))


def _steps(items: list[str]) -> Iterator[str | tuple[str, int]]:
    """Numbers, operators, signs and calls (function, arguments) in the order in which a stack of values takes them.

    One pass over the items with a stack of what waits for its right side: operators, signs, and open
    brackets with the function before them."""
    waiting: list[tuple[str, int]] = []  # what, and its strength; an open bracket has 0
    calls: list[list] = []  # for every open bracket: function or None, arguments so far
    name, operand = None, True  # operand: a value has to come next

    def settle(strength: int) -> Iterator[str]:
        while waiting and waiting[-1][1] >= strength and waiting[-1][1] > 0:
            yield waiting.pop()[0]

    for item in items:
        if name is not None and item != "(":
            raise ValueError("only arithmetic is allowed")
        if item in _FUNCTIONS and operand:
            name = item
        elif item == "(" and operand:
            waiting.append(("(", 0))
            calls.append([name, 0])
            name = None
        elif item in ("+", "-") and operand:
            waiting.append((f"u{item}", _SIGN))
        elif (item[0].isdigit() or item[0] == ".") and operand:
            yield item
            operand = False
        elif item in _STRENGTH and not operand:
            strength = _STRENGTH[item]
            yield from settle(strength + (item == "**"))
            waiting.append((item, strength))
            operand = True
        elif item in (",", ")") and calls and not operand:
            yield from settle(1)
            calls[-1][1] += 1
            if item == ",":
                if calls[-1][0] is None:
                    raise ValueError("only arithmetic is allowed")
                operand = True
                continue
            waiting.pop()
            function, count = calls.pop()
            if function:
                yield function, count
        else:
            raise ValueError("only arithmetic is allowed")
    if operand or calls or name is not None:
        raise ValueError("only arithmetic is allowed")
    yield from settle(1)


def _is_number(step: str | tuple[str, int]) -> bool:
    return isinstance(step, str) and (step[0].isdigit() or step[0] == ".")


def evaluate(expression: str) -> float:
    """Arithmetic over numbers and round/abs/min/max; anything else is an error."""
    if len(expression) > MAX_EXPRESSION:
        raise ValueError("expression too long")
    values: list[float] = []
    for step in _steps(_items(expression)):
        if _is_number(step):
            values.append(_number(step))
        else:
            _apply(values, step)
    return float(values[0])


@lru_cache(maxsize=1024)
def _program(shape: tuple[str, ...]) -> Callable[[list[float]], float] | None:
    """A function of the numbers between the parts of ``shape``, which does what ``evaluate`` does in the same order;
    null for what is no expression. Its source consists of operators, known functions and places of numbers alone."""
    if any(map(_OTHER.search, shape)):
        return None
    sources: list[str] = []
    places = count(0)
    try:
        for step in _steps([item for at, part in enumerate(shape) for item in (["0"] if at else []) + _items(part)]):
            if _is_number(step):
                sources.append(f"n[{next(places)}]")
            elif isinstance(step, tuple):
                name, size = step
                if size < _FUNCTIONS[name][0] or size > (_FUNCTIONS[name][1] or size):
                    return None
                given = sources[len(sources) - size :]
                del sources[len(sources) - size :]
                sources.append(f"{name}({', '.join(given)})")
            elif step in ("u+", "u-"):
                sources.append(sources.pop() if step == "u+" else f"(-{sources.pop()})")
            else:
                right, left = sources.pop(), sources.pop()
                sources.append(f"power({left}, {right})" if step == "**" else f"({left} {step} {right})")
        return eval(f"lambda n: {sources[0]}", {"__builtins__": {}, "power": _power, **_CALLS})
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        return None


#: Numbers cut the shape of an expression from it; a digit or point that is left makes it no shape.
_NUMBERS = re.compile(r"(?<!\w)((?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)")
_OTHER = re.compile(r"[\d.]")


def evaluated(expressions: Iterable[str]) -> Iterator[tuple[float | None, str | None]]:
    """Value or error of each expression. A shape that comes again, with other numbers, is not parsed again."""
    met: set[tuple[str, ...]] = set()
    for expression in expressions:
        program, numbers = None, []
        if len(expression) <= MAX_EXPRESSION:
            parts = _NUMBERS.split(expression)
            shape = tuple(parts[::2])
            if shape in met:
                program = _program(shape)
                try:
                    numbers = [_number(part) for part in parts[1::2]]
                except (ValueError, SyntaxError):
                    program = None
            met.add(shape)
        try:
            yield (float(program(numbers)) if program else evaluate(expression)), None
        except ZeroDivisionError:
            yield None, "division by zero"
        except (ValueError, SyntaxError, TypeError, OverflowError, RecursionError) as error:
            yield None, str(error).split("(")[0].strip() or type(error).__name__


@F.pandas_udf(StructType([StructField("value", DoubleType()), StructField("error", StringType())]))
def calculate(expressions: pd.Series) -> pd.DataFrame:
    """``struct<value,error>`` per expression; exactly one is set."""
    asked = list(expressions.dropna().unique())
    seen = dict(zip(asked, evaluated(asked)))
    done = [seen.get(expression, (None, None)) for expression in expressions]
    return pd.DataFrame({"value": pd.Series([value for value, _ in done], dtype="float64"), "error": pd.Series([error for _, error in done], dtype="object")})
