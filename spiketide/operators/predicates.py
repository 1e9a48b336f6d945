"""Row predicates in disjunctive normal form, from plain dictionaries."""

from __future__ import annotations

import ast
import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONDITION = re.compile(r"\s*(>=|<=|!=|==|>|<)?\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*")
_NOT = re.compile(r"\s*(!=|==)\s*(.+?)\s*")


def condition(column: str, value) -> Column:
    """A comparison written as text (">= 0.3", "!= fff"), or equality with any other value. The whole text has to be a
    comparison, so "20px_20Hz" is a name and not the number 20."""
    c = F.col(column)
    if not isinstance(value, str):
        return c == F.lit(value)
    operator, operand = "==", value
    if m := _CONDITION.fullmatch(value):
        operator, operand = m[1] or "==", float(m[2])
    elif m := _NOT.fullmatch(value):
        operator, operand = m[1], m[2]
    right = F.lit(operand)
    return {">=": c >= right, "<=": c <= right, ">": c > right, "<": c < right, "!=": c != right, "==": c == right}[operator]


def matches(branches: list[dict]) -> Column:
    """Any of the branches; a branch asks for all its columns; a list as value asks for any of its members. No branch: all rows."""

    def one(column: str, value) -> Column:
        if isinstance(value, list | tuple | set):
            values = list(value)
            plain = [v for v in values if not isinstance(v, str)]
            texts = [condition(column, v) for v in values if isinstance(v, str)]
            return reduce(lambda a, b: a | b, texts + ([F.col(column).isin(plain)] if plain else []))
        return condition(column, value)

    both = [reduce(lambda a, b: a & b, [one(k, v) for k, v in branch.items()], F.lit(True)) for branch in branches]
    return reduce(lambda a, b: a | b, both) if both else F.lit(True)


def where(df: DataFrame, branches: list[dict]) -> DataFrame:
    return df.filter(matches(branches))


def chosen(df: DataFrame, columns: dict) -> DataFrame:
    """Rows that every column's choice allows: "all" or None anything, a pair (low, high) of numbers what lies between, both
    included, a list its members, another value itself."""

    def one(column: str, choice) -> Column:
        if choice is None or choice == "all":
            return F.lit(True)
        if isinstance(choice, tuple):
            return F.col(column).between(*choice)
        return F.col(column).isin(list(choice)) if isinstance(choice, list | set) else F.col(column) == F.lit(choice)

    return df.filter(reduce(lambda a, b: a & b, [one(k, v) for k, v in columns.items()], F.lit(True)))


def triples(recordings, stimuli, cells) -> list[dict]:
    """Conditions for where() from lists of recordings, stimuli and cells taken in step; a list of one serves all the
    others, and "all" sets no condition. Lists of other lengths are an error."""
    lists = {"recording": recordings, "stimulus_index": stimuli, "cell_index": cells}
    lists = {k: v if isinstance(v, list) else [v] for k, v in lists.items()}
    most = max(map(len, lists.values()))
    if any(len(v) not in (1, most) for v in lists.values()):
        raise ValueError("recordings, stimuli and cells differ in length")
    at = [{k: v[i % len(v)] for k, v in lists.items()} for i in range(most)]
    return [{k: v for k, v in row.items() if not (isinstance(v, str) and v == "all")} for row in at]


_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_JOIN = {ast.And: operator.and_, ast.Or: operator.or_, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}


def expression(text: str, **values) -> Column:
    """A condition written as a Python expression over columns: comparisons (chains too), `in` and `not in` lists, and / or /
    not or & | ~, arithmetic, and @name for a value given by name.

    Names are columns, a name in backticks may hold spaces. As in Python & and | bind more tightly than comparisons unless these are in
    brackets. Anything else in the text, such as a call, is an error; nothing is evaluated but the condition.
    """
    quoted: list[str] = []
    plain = re.sub(r"`([^`]+)`", lambda m: quoted.append(m[1]) or f"__column_{len(quoted) - 1}", text)
    tree = ast.parse(re.sub(r"@(?=[A-Za-z_])", "__value_", plain).strip(), mode="eval").body

    def given(node):
        """A plain value or a list of them; None if it is a column."""
        if isinstance(node, ast.Name) and node.id.startswith("__value_"):
            return values[node.id.removeprefix("__value_")]
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.List | ast.Tuple | ast.Set):
            return [given(x) for x in node.elts]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
            return -node.operand.value
        return None

    def column(node) -> Column:
        if isinstance(node, ast.Name) and not node.id.startswith("__value_"):
            return F.col(f"`{quoted[int(node.id.removeprefix('__column_'))]}`" if node.id.startswith("__column_") else node.id)
        if isinstance(node, ast.BoolOp):
            return reduce(_JOIN[type(node.op)], map(column, node.values))
        if isinstance(node, ast.BinOp) and type(node.op) in _JOIN:
            return _JOIN[type(node.op)](column(node.left), column(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not | ast.Invert):
            return ~column(node.operand)
        if isinstance(node, ast.Compare):
            return reduce(operator.and_, [compared(a, op, b) for a, op, b in zip([node.left, *node.comparators], node.ops, node.comparators, strict=False)])
        value = given(node)
        if value is None or isinstance(value, list):
            raise ValueError(f"not a condition: {ast.unparse(node)}")
        return F.lit(value)

    def compared(a, op, b) -> Column:
        many = given(b)
        if isinstance(op, ast.In | ast.NotIn) or isinstance(many, list | tuple | set):
            if not isinstance(many, list | tuple | set) or not isinstance(op, ast.In | ast.NotIn | ast.Eq | ast.NotEq):
                raise ValueError(f"not a list: {ast.unparse(b)}")
            inside = column(a).isin(list(many))
            return ~inside if isinstance(op, ast.NotIn | ast.NotEq) else inside
        return _COMPARE[type(op)](column(a), column(b))

    return column(tree)


def query(df: DataFrame, text: str, **values) -> DataFrame:
    """Rows for which expression() is true."""
    return df.filter(expression(text, **values))
