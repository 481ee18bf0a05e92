"""Reports of small aggregates as JSON and Markdown, thresholds, and model bundles with their metadata."""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

MAX_ROWS = 10_000


def percent(part: float | None, whole: float | None) -> str:
    """One decimal, or n/a where there is nothing to divide by."""
    return "n/a" if not whole or part is None else f"{100 * part / whole:.1f}%"


def rows_of(df: DataFrame) -> list[dict]:
    """Rows of a small aggregate; refuses what isn't one."""
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a report of more than {MAX_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def audit_json(parts: dict[str, DataFrame]) -> str:
    return json.dumps({name: rows_of(df) for name, df in parts.items()}, ensure_ascii=False, indent=1, default=str)


def markdown(title: str, parts: dict[str, DataFrame]) -> str:
    """A section with a table for each aggregate; null is n/a."""
    out = [f"# {title}"]
    for name, df in parts.items():
        rows = rows_of(df)
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
        show = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
        out += ["| " + " | ".join(show(r[c]) for c in df.columns) + " |" for r in rows]
    return "\n".join(out) + "\n"


def threshold_json(picks: DataFrame, path: str, targets: tuple[str, ...] = ("f1_at_both", "precision_at_recall", "f1")) -> dict:
    """Write the first policy of `targets` that has a threshold, with the reason and its value."""
    by = {r["policy"]: r for r in rows_of(picks)}
    chosen = next(({"policy": p, "threshold": by[p]["threshold"], "value": by[p]["value"]} for p in targets if by.get(p, {}).get("threshold") is not None), None)
    if chosen is None:
        raise ValueError("no policy has a threshold")
    with open(path, "w") as f:
        json.dump(chosen, f, indent=1)
    return chosen


def save_model(model: PipelineModel, path: str, meta: dict) -> None:
    """A model and its meta.json (version, time, snapshot, metrics); refuses an existing path."""
    model.save(f"file://{os.path.abspath(path)}/model")
    with open(os.path.join(path, "meta.json"), "w") as f:
        json.dump(meta, f, indent=1, sort_keys=True)


def load_model(path: str) -> tuple[PipelineModel, dict]:
    with open(os.path.join(path, "meta.json")) as f:
        meta = json.load(f)
    return PipelineModel.load(f"file://{os.path.abspath(path)}/model"), meta
