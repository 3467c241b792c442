"""HTML reports from small tables."""

from __future__ import annotations

import html
from collections.abc import Iterable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

from weldrow.operators.model import parameter_rows

STYLE = "body{font:14px sans-serif;max-width:70em;margin:2em auto}table{border-collapse:collapse}td,th{padding:.2em .7em;border-bottom:1px solid #ddd;text-align:left}.tiles{display:flex;gap:1em}.tile{border:1px solid #ddd;padding:.8em}.tile b{font-size:1.6em;display:block}"


def esc(value: Any) -> str:
    return "" if value is None else html.escape(str(value))


def page(title: str, subtitle: str, body: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(title)}</title><style>{STYLE}</style></head><body><h1>{esc(title)}</h1><p>{esc(subtitle)}</p>{body}</body></html>"


def table(rows: Sequence[dict[str, Any]], max_rows: int | None = None, number: str = "{:.4g}") -> str:
    if not rows:
        return "<p>none</p>"
    head = "".join(f"<th>{esc(c)}</th>" for c in rows[0])
    show = lambda v: number.format(v) if isinstance(v, float) else esc(v)
    body = "".join("<tr>" + "".join(f"<td>{show(v)}</td>" for v in r.values()) + "</tr>" for r in rows[:max_rows])
    return f"<table><tr>{head}</tr>{body}</table>"


def tiles(items: Iterable[tuple[str, Any, str]]) -> str:
    return "<div class='tiles'>" + "".join(f"<div class='tile'>{esc(a)}<b>{esc(b)}</b>{esc(c)}</div>" for a, b, c in items) + "</div>"


def line_chart(series: dict[str, Sequence[tuple[float, float]]], x: str, y: str, width: int = 640, height: int = 360) -> str:
    """Lines over the unit square as SVG."""
    px, py = (lambda v: 50 + v * (width - 70)), (lambda v: height - 40 - v * (height - 60))
    colors = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd")
    lines = ""
    for i, (name, points) in enumerate(series.items()):
        path = " ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in points)
        lines += f"<polyline points='{path}' fill='none' stroke='{colors[i % 4]}'/><text x='{width - 150}' y='{20 + 16 * i}' fill='{colors[i % 4]}'>{esc(name)}</text>"
    axes = f"<path d='M50 20V{height - 40}H{width - 20}' fill='none' stroke='#888'/><text x='{width // 2}' y='{height - 8}'>{esc(x)}</text><text x='5' y='15'>{esc(y)}</text>"
    return f"<svg width='{width}' height='{height}'>{axes}{lines}</svg>"


def explanation(result, out_path: str | Path, sample: int = 25, seed: int = 0) -> Path:
    """What the model learned, and sampled pairs with the evidence of each comparison; rejected pairs apart from accepted ones."""
    bits = [f"bf_{c.name}" for c in result.comparisons]

    def pairs(df) -> list[dict]:
        order = F.xxhash64("unique_id_l", "unique_id_r", F.lit(seed))
        return [r.asDict() for r in df.orderBy(order).limit(sample).select("unique_id_l", "unique_id_r", "match_probability", *[F.round(F.log2(b), 2).alias(b.removeprefix("bf_")) for b in bits]).collect()]

    accepted = result.predictions.join(result.rejected.select("unique_id_l", "unique_id_r"), ["unique_id_l", "unique_id_r"], "left_anti")
    body = tiles([("records", result.stats.get("records"), ""), ("entities", result.stats.get("entities"), ""), ("edges", result.stats.get("edges"), "")])
    body += "<h2>Parameters</h2>" + table(parameter_rows(result.model)) + "<h2>Training</h2>" + table(result.model.log)
    body += "<h2>Accepted pairs, bits of evidence</h2>" + table(pairs(accepted)) + "<h2>Rejected pairs</h2>" + table(pairs(result.rejected))
    Path(out_path).write_text(page("Linkage explanation", result.profile.name, body), encoding="utf-8")
    return Path(out_path)


def evaluation(summary: Sequence[dict], curves: dict[str, Sequence[dict]], cluster: dict, out_path: str | Path, more: dict[str, Sequence[dict]] | None = None) -> Path:
    """Scores by method, precision-recall curves, the clusters' figures and further tables by title."""
    chart = line_chart({n: [(r["recall"], r["precision"]) for r in c] for n, c in curves.items()}, "recall", "precision")
    body = tiles([("cluster F1", cluster.get("f1"), ""), ("exact entities", cluster.get("entity_exact_match_rate"), "")]) + "<h2>Methods</h2>" + table(summary) + chart
    body += "".join(f"<h2>{esc(title)}</h2>{table(rows)}" for title, rows in (more or {}).items())
    Path(out_path).write_text(page("Evaluation", "", body), encoding="utf-8")
    return Path(out_path)


def to_markdown(rows: Sequence[dict]) -> str:
    if not rows:
        return ""
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(rows[0]), line("---" for _ in rows[0]), *[line(r.values()) for r in rows]])
