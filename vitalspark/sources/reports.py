"""Reports: derived variables as JSON lines, and the checks and scores of a population as text to read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.derive import Derived
from vitalspark.sources.sinks import write_json


def by_patient(rows: DataFrame, name: str) -> DataFrame:
    """patient_id, name: a patient's rows as an array of structs, in the order of their columns."""
    rest = [c for c in rows.columns if c != "patient_id"]
    return rows.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))


def therapy_report(lines: DataFrame, warnings: DataFrame) -> DataFrame:
    """patient_id, lines, warnings of each patient with lines; those without warnings have an empty array."""
    told = by_patient(warnings, "warnings")
    rows = by_patient(lines, "lines").join(told, "patient_id", "left")
    return rows.select("patient_id", "lines", F.coalesce("warnings", F.array().cast(told.schema["warnings"].dataType)).alias("warnings"))


def write_derived(found: Derived, folder: str) -> None:
    """lines_of_therapy (a line for each patient), survival, km, first_line_classes and summary as folders of JSON lines."""
    parts = {"lines_of_therapy": therapy_report(found.lines, found.warnings), "survival": found.records, "km": found.curve, "first_line_classes": found.first_line_classes, "summary": found.summary}
    for name, rows in parts.items():
        write_json(rows, f"{folder.rstrip('/')}/{name}.json")


def _table(head: Iterable[str], rows: Iterable[Iterable[str]]) -> list[str]:
    """Lines of a table: the first column to the left, the others to the right, each as wide as its widest cell."""
    cells = [list(map(str, x)) for x in (head, *rows)]
    widths = [max(map(len, c)) for c in zip(*cells, strict=True)]
    lines = ["  ".join(x.ljust(w) if i == 0 else x.rjust(w) for i, (x, w) in enumerate(zip(row, widths, strict=True))) for row in cells]
    return [lines[0], "-" * len(lines[0]), *lines[1:]]


def checks_text(checks: DataFrame) -> str:
    """The result of quality_gate.run() (check, n_fail, status) as a table, and whether all have passed; it has a row for each check, so the driver may hold it."""
    rows = sorted(map(tuple, checks.select("check", "status", "n_fail").collect()))
    return "\n".join([*_table(("check", "status", "failures"), rows), "", "all checks passed" if all(r[1] == "PASS" for r in rows) else "one or more checks failed"])


def scores_text(scalars: DataFrame, numeric: DataFrame, sets: DataFrame, macro: DataFrame) -> str:
    """Scores of the note fields (as notes.scalar_scores(), numeric_accuracy(), set_scores() and macro_accuracy() give them) as tables; they have a row for each field."""
    number = lambda x: "-" if x is None else f"{x:.3f}"
    one = [(r["field"], number(r["accuracy"]), number(r["miss_rate"])) for r in sorted(scalars.collect(), key=lambda r: r["field"])]
    one += [(r["field"], number(r["accuracy"]), "-") for r in numeric.collect()]
    many = [(r["field"], *(number(r[c]) for c in ("precision", "recall", "f1"))) for r in sorted(sets.collect(), key=lambda r: r["field"])]
    total = macro.first()
    return "\n".join([f"macro accuracy: {number(total[0] if total else None)}", "", *_table(("field", "accuracy", "miss rate"), one), "", *_table(("set", "precision", "recall", "f1"), many)])
