"""Pipelines from Airflow files: DAGs, tasks and their order are read from the source text; nothing of it is run.

SQL operators become SQL steps.  Other tasks become steps without SQL that carry a note of what has to be written by hand; they
keep their place in the order.  Values that are no literals are kept as their source text in the note.
"""

from __future__ import annotations

import ast

#: Operators without work of their own.
EMPTY = ("EmptyOperator", "DummyOperator")
PRESETS = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *"}


class _File:
    """What one source file says: names bound to tasks, tasks with their settings, and edges between them."""

    def __init__(self) -> None:
        self.dag: dict[str, object] = {}
        self.tasks: dict[str, tuple[str, dict[str, object]]] = {}
        self.names: dict[str, list[str]] = {}
        self.edges: list[tuple[str, str]] = []

    @staticmethod
    def settings(call: ast.Call) -> dict[str, object]:
        out: dict[str, object] = {}
        for k in call.keywords:
            if k.arg:
                try:
                    out[k.arg] = ast.literal_eval(k.value)
                except ValueError:
                    out[k.arg] = k.value
        return out

    def statement(self, node: ast.stmt) -> None:
        if isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                self.value(item.context_expr)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            name = next((t.id for t in targets if isinstance(t, ast.Name)), None)
            found = self.value(node.value, name)
            if name and found:
                self.names[name] = found
        elif isinstance(node, ast.Expr):
            self.value(node.value)
        for part in ("body", "orelse", "finalbody"):
            for inner in getattr(node, part, []):
                if isinstance(inner, ast.stmt):
                    self.statement(inner)

    def value(self, node: ast.expr, name: str | None = None) -> list[str]:
        """The tasks that an expression stands for; calls and shifts add tasks and edges."""
        if isinstance(node, ast.Name):
            return self.names.get(node.id, [])
        if isinstance(node, (ast.List, ast.Tuple)):
            return [t for e in node.elts for t in self.value(e)]
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.RShift, ast.LShift)):
            left, right = self.value(node.left), self.value(node.right)
            self.link(left, right) if isinstance(node.op, ast.RShift) else self.link(right, left)
            return right
        if isinstance(node, ast.Call):
            return self.call(node, name)
        return []

    def link(self, before: list[str], after: list[str]) -> None:
        self.edges += [(a, b) for a in before for b in after if a != b]

    def call(self, node: ast.Call, name: str | None) -> list[str]:
        kind = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
        if kind == "DAG":
            own = self.settings(node)
            if node.args and isinstance(node.args[0], ast.Constant):
                own.setdefault("dag_id", node.args[0].value)
            self.dag = own
            return []
        if kind in ("set_downstream", "set_upstream") and isinstance(node.func, ast.Attribute):
            own, others = self.value(node.func.value), [t for a in node.args for t in self.value(a)]
            self.link(own, others) if kind == "set_downstream" else self.link(others, own)
            return []
        if kind == "chain":
            groups = [self.value(a) for a in node.args]
            for a, b in zip(groups, groups[1:], strict=False):
                self.link(a, b)
            return []
        if kind.endswith(("Operator", "Sensor")):
            own = self.settings(node)
            ident = own.get("task_id") if isinstance(own.get("task_id"), str) else name
            if ident:
                self.tasks[ident] = (kind, own)
                return [ident]
        return []


def _cron(schedule: object) -> str | None:
    if not isinstance(schedule, str) or schedule in ("@once", "None"):
        return None
    return PRESETS.get(schedule, schedule)


def import_dag(text: str) -> dict[str, object]:
    """A pipeline as ``Pipeline.from_dict`` takes it, with ``cron`` (None: by hand) and ``notes`` by step."""
    file = _File()
    for node in ast.parse(text).body:
        file.statement(node)
    if not isinstance(file.dag.get("dag_id"), str):
        raise ValueError("the file has no DAG with a literal id")
    plain = lambda v: ast.unparse(v) if isinstance(v, ast.AST) else v
    steps, notes = [], {}
    for ident, (kind, own) in file.tasks.items():
        step: dict[str, object] = {"id": ident, "deps": list(dict.fromkeys(a for a, b in file.edges if b == ident))}
        if isinstance(own.get("retries"), int):
            step["retries"] = own["retries"]
        if isinstance(own.get("sql"), str):
            step["sql"] = own["sql"]
        elif kind not in EMPTY:
            notes[ident] = f"{kind}: " + ", ".join(f"{k}={plain(v)}" for k, v in own.items() if k not in ("task_id", "retries", "dag"))
        steps.append(step)
    schedule = file.dag.get("schedule", file.dag.get("schedule_interval"))
    return {"name": file.dag["dag_id"], "cron": _cron(schedule), "steps": steps, "notes": notes}
