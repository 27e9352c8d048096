"""Redaction: which columns of its sources a report shows, traced through the plan, before any row is read.

A report may count, compare and name fields; it must not show their values. ``shown`` follows every output column back to
the columns it is made of; what only decides (conditions of a case, filters, join and group keys that are not put out)
or is turned into a count or a truth value shows nothing; names of fields (keys of a map) are no values.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Expressions that give a number of things, or the names of a map's fields, and no value.
_NO_VALUE = {"Count", "Size", "Length", "MapKeys"}


class LeakError(ValueError):
    """A report shows a column that it must not."""


def _items(sequence) -> Iterator:
    return (sequence.apply(k) for k in range(sequence.size()))


def _parts(expression) -> list:
    """What an expression's value is made of: branches of a case, not its conditions; nothing of truth values and counts."""
    name = expression.getClass().getSimpleName()
    if name in _NO_VALUE or expression.dataType().typeName() == "boolean":
        return []
    if name == "CaseWhen":
        made = [branch._2() for branch in _items(expression.branches())]
        return made + ([expression.elseValue().get()] if expression.elseValue().isDefined() else [])
    if name == "If":
        return [expression.trueValue(), expression.falseValue()]
    return list(_items(expression.children()))


def _read(expression) -> set[int]:
    """Ids of the attributes that an expression's value is made of."""
    if expression.getClass().getSimpleName() == "AttributeReference":
        return {expression.exprId().id()}
    return set().union(*map(_read, _parts(expression)))


def shown(report: DataFrame) -> dict[str, set[str]]:
    """Output column -> names of the source columns whose values it may show.

    Source columns are those of leaves of the analysed plan: files, tables and rows given by the caller.
    """
    plan = report._jdf.queryExecution().analyzed()
    made: dict[int, set[int]] = {}
    names: dict[int, str] = {}

    def walk(node) -> None:
        children = list(_items(node.children()))
        for child in children:
            walk(child)
        if not children:
            names.update({a.exprId().id(): a.name() for a in _items(node.output())})
        if node.getClass().getSimpleName() == "Union":
            for k, out in enumerate(_items(node.output())):
                made[out.exprId().id()] = {child.output().apply(k).exprId().id() for child in children}
            return
        for expression in _named(node):
            made.setdefault(expression.exprId().id(), set()).update(_read(expression.child()) if hasattr(expression, "child") else set())

    def _named(node) -> Iterator:
        for expression in _items(node.expressions()):
            if expression.getClass().getSimpleName() == "Alias":
                yield expression
        if node.getClass().getSimpleName() == "Generate":
            outputs = list(_items(node.generatorOutput()))
            of_map = node.generator().children().head().dataType().typeName() == "map"
            for k, out in enumerate(outputs):
                keys = of_map and k == len(outputs) - 2  # the names of its fields
                made.setdefault(out.exprId().id(), set()).update(set() if keys else _read(node.generator()))

    def sources(attribute: int, seen: frozenset = frozenset()) -> set[str]:
        if attribute in seen:
            return set()
        if attribute in made:
            return set().union(*[sources(a, seen | {attribute}) for a in made[attribute]])
        return {names[attribute]} if attribute in names else set()

    walk(plan)
    return {a.name(): sources(a.exprId().id()) for a in _items(plan.output())}


def assert_redacted(report: DataFrame, values: list[str]) -> DataFrame:
    """The report itself, if none of its text columns shows a source column of ``values``; else LeakError names them."""
    text = {f.name for f in report.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))}
    found = {c: sorted(of & set(values)) for c, of in shown(report).items() if c in text and of & set(values)}
    if found:
        raise LeakError(f"columns that show values: {found}")
    return report
