"""Cards of datasets: licences and citations read from one, and cards written from a step's lineage."""

from __future__ import annotations

import json
import re
from typing import Any

FRONT = re.compile(r"\A---\s*\n(.*?)\n---\s*(?:\n|\Z)", re.S)
ENTRY = re.compile(r"@[A-Za-z]+\s*\{")


def licences(card: str) -> list[str]:
    """The licences a card's front matter names, as one value or a list."""
    front = FRONT.match(card)
    if not front:
        return []
    found = re.search(r"^license\s*:[ \t]*(.*)((?:\n\s*-\s*.+)*)", front[1], re.M)
    if not found:
        return []
    values = [found[1], *re.findall(r"-\s*(.+)", found[2])]
    return [v for v in (x.strip().strip("[]").strip("'\"") for v in values for x in v.split(",")) if v]


def citations(card: str) -> list[str]:
    """The BibTeX entries of a card: from each @type{ to its closing brace; one that never closes is left out."""
    out = []
    for start in ENTRY.finditer(card):
        depth = 0
        for i in range(start.end() - 1, len(card)):
            depth += {"{": 1, "}": -1}.get(card[i], 0)
            if not depth:
                out.append(card[start.start() : i + 1])
                break
    return out


def written_card(name: str, rows: int, size: str, lineage: dict[str, dict[str, list[Any]]], synthetic: bool = False, examples: dict[str, list[Any]] | None = None) -> str:
    """A card in Markdown: front matter with licences and size, then the lineage of each step and the first values of each column."""
    found = list(dict.fromkeys(str(v) for kinds in lineage.values() for v in kinds.get("License Information", [])))
    lines = ["---", *(["license:", *(f"- {x}" for x in found)] if found else []), "size_categories:", f"- {size}", *(["tags:", "- synthetic"] if synthetic else []), "---", f"# {name}", "", f"{rows} rows.", ""]
    for step, kinds in lineage.items():
        lines += [f"## {step}", ""]
        lines += [f"- {kind}: {value}" for kind, values in kinds.items() for value in values]
        lines.append("")
    if examples:
        lines += ["## First rows", "", "```json", *(json.dumps(dict(zip(examples, row)), default=str, ensure_ascii=False) for row in zip(*examples.values())), "```", ""]
    return "\n".join(lines)
