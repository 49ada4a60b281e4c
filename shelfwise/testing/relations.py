"""Plain relations from a table, its columns and the tables its rows refer to (DuckDB text)."""

from __future__ import annotations


def relation(base: str, columns: str, where: str = "", computed: dict[str, str] | None = None, **links: str) -> str:
    """``columns``: names of the base table, or link.name. A link is ``table.key=expression``; with a final ``!`` rows
    that refer to nothing are left out. ``computed`` columns follow, or take the place of ``*name`` in ``columns``.
    """
    joins, conditions = [], [where] if where else []
    for alias, link in links.items():
        target, expression = link.rstrip("!").split("=", 1)
        table, key = target.split(".")
        expression = expression if "." in expression else f"b.{expression}"
        joins.append(f"LEFT JOIN oltp_{table} {alias} ON {alias}.{key} = {expression}")
        if link.endswith("!"):
            conditions.append(f"{alias}.{key} IS NOT NULL")
    computed = dict(computed or {})
    chosen = [f"{computed.pop(c[1:])} AS {c[1:]}" if c[0] == "*" else c if "." in c else f"b.{c}" for c in columns.split()]
    chosen += [f"{expression} AS {name}" for name, expression in computed.items()]
    text = f"SELECT {', '.join(chosen)} FROM oltp_{base} b {' '.join(joins)}"
    return text + (f" WHERE {' AND '.join(conditions)}" if conditions else "")
