"""A runner for sqllogictest files: statement ok / error, query with nosort, rowsort or valuesort, halt."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from tessera.plans.sql import SqlEngine


@dataclass
class Record:
    line: int
    kind: str
    sql: str
    sort: str = "nosort"
    expected: tuple[str, ...] = ()


def parse(text: str) -> list[Record]:
    records: list[Record] = []
    block: list[tuple[int, str]] = []
    for number, line in enumerate([*text.splitlines(), ""], 1):
        if line.strip() and not line.lstrip().startswith("#"):
            block.append((number, line))
            continue
        if line.strip() or not block:
            continue
        (at, head), *rest = block
        words, lines, block = head.split(), [x for _, x in rest], []
        if words[0] == "halt":
            break
        if words[0] == "statement":
            records.append(Record(at, words[1], "\n".join(lines)))
        elif words[0] == "query":
            cut = lines.index("----") if "----" in lines else len(lines)
            records.append(Record(at, "query", "\n".join(lines[:cut]), words[2] if len(words) > 2 else "nosort", tuple(lines[cut + 1 :])))
        else:
            raise ValueError(f"line {at}: unknown record {head!r}")
    return records


def shown(value: object) -> str:
    return "NULL" if value is None else str(value)


def run(engine: SqlEngine, path: str | Path) -> list[str]:
    """Failures, one message each; none means that the file passed."""
    failures = []
    for r in parse(Path(path).read_text()):
        try:
            rows = [[shown(v) for v in row] for row in engine.execute(r.sql).collect()]
        except Exception as e:  # noqa: BLE001  any failure of the statement counts
            if r.kind != "error":
                failures.append(f"line {r.line}: {type(e).__name__}: {str(e)[:200]}")
            continue
        if r.kind == "error":
            failures.append(f"line {r.line}: expected an error")
        elif r.kind == "query":
            rows = sorted(rows) if r.sort == "rowsort" else rows
            got = [v for row in rows for v in row]
            got = sorted(got) if r.sort == "valuesort" else got
            if tuple(got) != r.expected:
                failures.append(f"line {r.line}: expected {list(r.expected)}, got {got}")
    return failures
