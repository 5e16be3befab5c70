"""Parameter expressions of circuits: values by a precedence parser, as folds over tokens with an operator and a value stack."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Functions of the OpenQASM 2 grammar.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "ln": F.ln, "sqrt": F.sqrt}
#: Names in parameters that are no free parameter.
KNOWN_NAMES = ("pi", *FUNCTIONS)
_NUMBER = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_NAME = r"[A-Za-z_]\w*"
#: A name with the parenthesis behind it is one token: a call.
_TOKEN = rf"{_NUMBER}|{_NAME}\s*\(|{_NAME}|\S"
#: So many distinct expressions are sent to every task with their values.
MAX_SENT = 1 << 14
#: How tightly operators bind; ``neg`` is the sign before an operand, a comma parts the operands of an unknown function.
BINDS = {",": 1, "+": 2, "-": 2, "*": 3, "/": 3, "neg": 4, "^": 5}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _strength(op: Column) -> Column:
    table = F.expr("map(" + ", ".join(f"'{name}', {strength}" for name, strength in BINDS.items()) + ")")
    return F.coalesce(F.try_element_at(table, op), F.lit(0))


def _top(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _dropped(items: Column, n: int | Column) -> Column:
    return F.slice(items, 1, F.size(items) - n)


def _pushed(items: Column, item: Column) -> Column:
    return F.concat(items, F.array(item))


def _apply(values: Column, op: Column) -> Column:
    """The value stack after an operator took its operands; what has no value makes none."""
    y, x = _top(values), F.try_element_at(values, F.lit(-2))
    two = F.when(op == "+", x + y).when(op == "-", x - y).when(op == "*", x * y).when(op == "/", F.try_divide(x, y)).when(op == "^", F.pow(x, y))
    return F.when(op == "neg", _pushed(_dropped(values, 1), -y)).otherwise(_pushed(_dropped(values, 2), two))


def _reduced(state: Column, strength: Column) -> Column:
    """(values, pending) after all pending operators of the innermost parentheses that bind at least so tightly were applied."""
    first = _top(state["frames"])
    own = F.reverse(F.slice(state["pending"], first + 1, F.size(state["pending"]) - first))
    start = F.struct(state["values"].alias("values"), F.lit(0).alias("done"), F.lit(True).alias("more"))
    end = F.aggregate(own, start, lambda acc, op: bind(acc["more"] & (_strength(op) >= strength), lambda more: F.struct(
        F.when(more, _apply(acc["values"], op)).otherwise(acc["values"]).alias("values"), (acc["done"] + more.cast("int")).alias("done"), more.alias("more"))))
    done = bind(end, lambda e: F.struct(e["values"].alias("values"), _dropped(state["pending"], e["done"]).alias("pending")))
    return F.when(_strength(_top(state["pending"])) >= strength, done).otherwise(F.struct(state["values"].alias("values"), state["pending"].alias("pending")))


def _state(values: Column, pending: Column, frames: Column, operand: Column, bad: Column) -> Column:
    return F.struct(values.alias("values"), pending.alias("pending"), frames.alias("frames"), operand.alias("operand"), bad.alias("bad"))


def _wanted(state: Column, token: Column) -> Column:
    """The state after a token where an operand is wanted."""
    values, pending, frames = state["values"], state["pending"], state["frames"]
    opens, sign, plain = token.endswith("("), token == "-", token.rlike(r"^(?:\d|\.\d|[A-Za-z_])")
    value = F.when(token == "pi", F.lit(math.pi)).otherwise(token.try_cast("double"))  # a name has none
    after = F.when(opens, _pushed(pending, F.regexp_replace(token, r"\s", ""))).when(sign, _pushed(pending, F.lit("neg"))).otherwise(pending)
    operand = plain & ~opens
    return _state(F.when(operand, _pushed(values, value)).otherwise(values), after, F.when(opens, _pushed(frames, F.size(after))).otherwise(frames),
                  operand, ~(opens | sign | plain | (token == "+")))


def _ready(state: Column, token: Column) -> Column:
    """The state after a token where an operator or the end of parentheses may come."""
    known = F.element_at(state["pending"], _top(state["frames"])).isin("(", *[f + "(" for f in FUNCTIONS])
    closes = token == ")"
    fits = closes | token.isin("+", "-", "*", "/", "^") | ((token == ",") & ~known)
    least = F.when(closes, F.lit(1)).when(token == "^", F.lit(BINDS["^"] + 1)).otherwise(_strength(token))  # powers group from the right

    def after(done: Column) -> Column:
        x, call = _top(done["values"]), _top(done["pending"])
        result = F.when(call == "(", x)
        for name, function in FUNCTIONS.items():
            result = result.when(call == name + "(", function(x))
        return _state(F.when(closes, _pushed(_dropped(done["values"], 1), result)).otherwise(done["values"]),
                      F.when(closes, _dropped(done["pending"], 1)).otherwise(_pushed(done["pending"], token)),
                      F.when(closes, _dropped(state["frames"], 1)).otherwise(state["frames"]), closes, ~fits)

    return bind(_reduced(state, least), after)


def evaluate(expression: Column) -> Column:
    """(value, valid) of a parameter expression.

    Numbers, pi, + - * / ^ (from the right, tighter than a sign before it), signs, the functions sin, cos, tan, exp, ln and sqrt, and
    parentheses to any depth; doubles, left to right. ``value`` is null for what has no finite value: free names and calls of other
    names, division by zero, roots and logarithms of what has none. ``valid`` is false if the tokens are no expression. Work
    grows with the tokens, and for nested parentheses with their depth at each.
    """
    text = F.trim(expression)
    start = F.expr("named_struct('values', cast(array() as array<double>), 'pending', array('('), 'frames', array(1), 'operand', false, 'bad', false)")

    def step(state: Column, token: Column) -> Column:
        # the parentheses around the whole are closed by the last token only
        over = F.size(state["frames"]) == 0
        return F.when(state["bad"] | over, _state(state["values"], state["pending"], state["frames"], state["operand"], F.lit(True))).when(
            state["operand"], _ready(state, token)).otherwise(_wanted(state, token))

    def finish(state: Column) -> Column:
        return bind(state["operand"] & ~state["bad"] & (F.size(state["frames"]) == 0), lambda valid: F.struct(
            F.when(valid, F.try_element_at(state["values"], F.lit(1))).alias("value"), valid.alias("valid")))

    tokens = _pushed(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), F.lit(")"))
    simple = F.struct(text.try_cast("double").alias("value"), F.lit(True).alias("valid"))
    finite = lambda r: F.struct(F.when(~F.isnan(r["value"]) & (F.abs(r["value"]) < float("inf")), r["value"]).alias("value"), r["valid"].alias("valid"))
    return bind(F.when(text.rlike(rf"^-?{_NUMBER}$"), simple).otherwise(F.aggregate(tokens, start, step, finish)), finite)


def evaluated(rows: DataFrame, expression: str) -> DataFrame:
    """``rows`` with ``value`` and ``valid`` of their ``expression``, by :func:`evaluate`, which each distinct expression goes through once.

    A first pass evaluates them, when the function is called; up to MAX_SENT are sent to every task, more are joined by their text.
    """
    known = rows.select(F.col(expression).alias("__text")).distinct().select("__text", evaluate(F.col("__text")).alias("__e")).select("__text", "__e.*")
    sent = None if rows.isStreaming else known.limit(MAX_SENT + 1).collect()
    if sent is not None and len(sent) <= MAX_SENT:
        known = F.broadcast(rows.sparkSession.createDataFrame(sent, "__text string, value double, valid boolean"))
    return rows.join(known, F.col(expression).eqNullSafe(F.col("__text")), "left").drop("__text")


def value(expression: Column) -> Column:
    return evaluate(expression)["value"]


def parts(parameters: Column) -> Column:
    """Parameters parted at the commas outside of parentheses, to any depth; none for a blank text."""
    balance = lambda s: F.length(F.replace(s, F.lit(")"), F.lit(""))) - F.length(F.replace(s, F.lit("("), F.lit("")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("depth"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + balance(piece)
        open_ = _pushed(acc["open"], piece)
        return F.when(depth > 0, F.struct(acc["done"].alias("done"), open_.alias("open"), depth.alias("depth"))).otherwise(F.struct(
            _pushed(acc["done"], F.trim(F.array_join(open_, ","))).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("depth")))

    whole = F.aggregate(F.split(parameters, ","), start, step, lambda acc: F.when(
        F.size(acc["open"]) > 0, _pushed(acc["done"], F.trim(F.array_join(acc["open"], ",")))).otherwise(acc["done"]))
    return F.when(F.trim(parameters) == "", F.array().cast("array<string>")).otherwise(whole)


def substituted(expression: Column, names: Column, actual: Column) -> Column:
    """The expression with each of ``names`` replaced by what stands for it, in parentheses unless that is a plain number or name."""
    def one(token: Column) -> Column:
        at = F.array_position(names, token)
        found = F.try_element_at(actual, F.when(at > 0, at.cast("int")))
        return F.when(found.isNull(), token).when(found.rlike(rf"^(?:{_NUMBER}|{_NAME})$"), found).otherwise(F.concat(F.lit("("), found, F.lit(")")))

    return F.array_join(F.transform(F.regexp_extract_all(expression, F.lit(rf"{_NUMBER}|{_NAME}|\s+|."), F.lit(0)), one), "")


def free_names(expression: Column) -> Column:
    """Names in an expression that stand for no function or constant, each once."""
    tokens = F.regexp_extract_all(expression, F.lit(rf"{_NUMBER}|({_NAME})"), F.lit(1))
    return F.array_except(F.filter(tokens, lambda t: t != ""), F.array(*[F.lit(n) for n in KNOWN_NAMES]))
