"""The column-selection language: `a, ns.b as c, ns.{x, y as z}, *, ns.*-{p, q}`.

Names ignore case.  An unknown column or namespace is an error, except among
those taken away; a column chosen twice comes once, under its first name; an
empty expression selects nothing; text that does not parse is an error."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?://[^\n]*|/\*.*?\*/|(?P<name>[A-Za-z0-9_/$\u0080-￾]+)|(?P<sign>[.,{}*-]))", re.S)


class SelectionError(ValueError):
    pass


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SelectionError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        out += [x for x in (m["name"], m["sign"]) if x]
        at = m.end()
    return out


def parse(text: str) -> list[tuple]:
    """Items ('col', ns, name, alias) and ('all', ns, names left out)."""
    tokens = _tokens(text)
    items, i = [], 0

    def take(want: str | None = None) -> str:
        nonlocal i
        if i >= len(tokens) or (want and tokens[i] != want) or (not want and tokens[i] in ".,{}*-"):
            raise SelectionError(f"expected {want or 'a name'} in {text!r}")
        i += 1
        return tokens[i - 1]

    def at(sign: str) -> bool:
        return i < len(tokens) and tokens[i] == sign

    def alias() -> str | None:
        nonlocal i
        if i < len(tokens) and tokens[i] in ("as", "AS"):
            i += 1
            return take()
        return None

    def listed() -> list[tuple[str, str | None]]:
        nonlocal i
        take("{")
        out = [(take(), alias())]
        while at(","):
            i += 1
            out.append((take(), alias()))
        take("}")
        return out

    def item(ns: str | None) -> None:
        nonlocal i
        if at("*"):
            i += 1
            gone = []
            if at("-"):
                i += 1
                gone = [n.lower() for n, _ in listed()]
            items.append(("all", ns, gone))
        elif at("{"):
            items.extend(("col", ns, n, a) for n, a in listed())
        else:
            name = take()
            if ns is None and at("."):
                i += 1
                return item(name)
            items.append(("col", ns, name, alias()))

    while i < len(tokens):
        item(None)
        if i < len(tokens):
            take(",")
            if i >= len(tokens):
                raise SelectionError(f"nothing after the last comma in {text!r}")
    return items


def resolve(text: str, schemas: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(namespace, column, output name) in order."""
    known = {ns.lower(): (ns, {c.lower(): c for c in cols}) for ns, cols in schemas.items()}
    out: dict[tuple[str, str], str] = {}

    def spaces(ns: str | None):
        if ns is None:
            if len(known) > 1 and "" not in known:
                raise SelectionError("a namespace is needed")
            return [known.get("", next(iter(known.values())))]
        if ns.lower() not in known:
            raise SelectionError(f"unknown namespace: {ns}")
        return [known[ns.lower()]]

    for kind, ns, *rest in parse(text):
        for space, cols in spaces(ns):
            if kind == "all":
                for low, c in cols.items():
                    if low not in rest[0]:
                        out.setdefault((space, c), c)
                continue
            name, alias = rest
            if name.lower() not in cols:
                raise SelectionError(f"unknown column: {name}")
            out.setdefault((space, cols[name.lower()]), alias or cols[name.lower()])
    return [(space, c, name) for (space, c), name in out.items()]


def select(df: DataFrame, text: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(n) for _, c, n in resolve(text, {"": df.columns})])


def select_joined(left: DataFrame, right: DataFrame, on, text: str | None = None, how: str = "inner") -> DataFrame:
    """A join of two tables seen as `left` and `right`; by default all columns, prefixed left_ and right_."""
    joined = left.alias("left").join(right.alias("right"), on, how)
    if text is None:
        chosen = [("left", c, f"left_{c}") for c in left.columns] + [("right", c, f"right_{c}") for c in right.columns]
    else:
        chosen = resolve(text, {"left": left.columns, "right": right.columns})
    return joined.select(*[F.col(f"{s}.`{c}`").alias(n) for s, c, n in chosen])
