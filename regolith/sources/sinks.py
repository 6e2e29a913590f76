"""Sinks: Markdown reports, one JSON payload, and slugs; every report passes the language lint before it is returned.

Reports show a bounded number of rows of results that are aggregated already; the rest is counted, not printed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.operators.documents import assert_clean


def slug(text: str) -> str:
    """A file name of a title."""
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def _cell(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "yes" if v else ""
    if isinstance(v, (list, tuple)):
        return ", ".join(map(_cell, v))
    return str(v).replace("|", r"\|").replace("\n", " ")


def markdown_table(df: DataFrame, most: int = 25) -> str:
    """The first rows as a Markdown table, and how many more there are."""
    rows = df.limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(_cell(r[c]) for c in df.columns) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\n… and {df.count() - most} more")
    return "\n".join(lines)


def report(title: str, sections: dict[str, DataFrame], notes: dict[str, str] | None = None, most: int = 25) -> str:
    """A Markdown report of one table a section, with a note above where given."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        note = (notes or {}).get(name)
        parts += [f"## {name}", *([note] if note else []), markdown_table(df, most)]
    return assert_clean("\n\n".join(parts) + "\n")


def portfolio_report(company: str, coverage: DataFrame, entities: DataFrame, matrix: DataFrame, cells: DataFrame) -> str:
    """Coverage, entities, where each product is held, where it was not found, and what the sources' windows exclude."""
    gaps = cells.where("state = 'gap'").orderBy("tier", F.desc(F.size("present_in")), "competitors", "country")
    outside = cells.where("state = 'out_of_window'").groupBy("country").agg(F.count("*").alias("products"), F.min("held_since").alias("held_since"))
    return report(company, {"Coverage": coverage, "Entities": entities, "Presence": matrix, "Not found": gaps.select("inn", "strength", "form", "country", "present_in", "competitors", "examples"), "Outside the window": outside})


def scope_sheet(note: str, facts: DataFrame, lines: DataFrame, questions: DataFrame) -> str:
    """What was said, what it comes to, what is held already and what is open, for one note."""
    return report(note, {"Said": facts.orderBy("start").select("kind", "value", "quote"), "Lines": lines, "Held already": lines.where(F.coalesce("already_held", F.lit(False))), "Open": questions.orderBy("impact", "kind")})


def payload(parts: dict[str, DataFrame], path: str) -> None:
    """Each part as JSON lines in a folder of its own, written by the executors."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{slug(name)}")


def small_payload(parts: dict[str, DataFrame], most: int = 10_000) -> str:
    """The parts as one compact JSON text; a part of more than ``most`` rows belongs in ``payload`` and is refused."""
    out = {}
    for name, df in parts.items():
        rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = [json.loads(r.j) for r in rows]
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))
