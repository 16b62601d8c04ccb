"""Web pages over the views of an index: experiments, one experiment, a comparison, a question's trace, a store's graph."""

from __future__ import annotations

import json
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, quote, urlsplit

from strandmill.plans.index import Index

MOST_ROWS = 500  # of a table on a page, which says how many there are; the views have them all


def _table(rows: list[dict[str, Any]]) -> str:
    if not rows:
        return "<p>no rows</p>"
    cells = lambda tag, values: "".join(f"<{tag}>{escape(v if isinstance(v, str) else json.dumps(v, default=str))}</{tag}>" for v in values)
    return "<table>" + "".join(f"<tr>{x}</tr>" for x in (cells("th", rows[0]), *(cells("td", r.values()) for r in rows))) + "</table>"


def _bars(values: dict[str, float]) -> str:
    most = max(values.values(), default=0) or 1
    return "".join(f"<div><span style='display:inline-block;width:{300 * max(v, 0) / most:.0f}px;background:#888'>&nbsp;</span> {escape(k)} {v:.4g}</div>" for k, v in values.items())


def _frame(frame) -> str:
    """The first rows of a view as a table; where there are more, the page says so."""
    rows = [r.asDict(recursive=True) for r in frame.limit(MOST_ROWS + 1).collect()]
    return _table(rows[:MOST_ROWS]) + (f"<p>the first {MOST_ROWS} of {frame.count()} rows</p>" if len(rows) > MOST_ROWS else "")


def page(index: Index, path: str) -> str:
    """The body of a page; a KeyError or FileNotFoundError says that there is none."""
    place = urlsplit(path)
    asked = {k: v[0] for k, v in parse_qs(place.query).items()}
    if place.path == "/":
        return "<ul>" + "".join(f"<li><a href='/experiment?name={quote(n)}'>{escape(n)}</a></li>" for n in index.experiments()) + "</ul>"
    if place.path == "/experiment":
        seen = index.overview(asked["name"])
        plain = [{"": k, "value": v} for k, v in seen.items() if not isinstance(v, (dict, list))]
        charts = "".join(f"<h3>{escape(k)}</h3>{_bars(v)}" for k, v in {"metrics": seen["metrics"], **seen["taxonomy_breakdown"], "tokens by source": {s: u["total_tokens"] for s, u in seen["usage"].items()}}.items())
        return f"<h2>{escape(asked['name'])}</h2>{_table(plain)}{charts}<h3>errors</h3>{_frame(index.errors(asked['name']))}"
    if place.path == "/compare":
        return _frame(index.compare(asked["a"], asked["b"]))
    if place.path == "/trace":
        found = index.trace(asked["name"], asked["question"])
        return _table([{"": k, "value": v} for k, v in found.items() if k != "stages"]) + _table(found["stages"])
    if place.path == "/graph":
        parts = index.graph(asked["name"], int(asked.get("run", 0)), asked["sample"])
        return "".join(f"<h3>{escape(k)}</h3>{_frame(v)}" for k, v in parts.items())
    raise KeyError(place.path)


def server(index: Index, host: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            try:
                code, body = 200, page(index, self.path)
            except (KeyError, FileNotFoundError, ValueError) as wrong:
                code, body = 404, f"<p>not found: {escape(str(wrong))}</p>"
            raw = f"<!doctype html><meta charset='utf-8'><title>experiments</title>{body}".encode()
            self.send_response(code)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_: Any) -> None:
            return

    return ThreadingHTTPServer((host, port), Handler)


def serve(index: Index, host: str, port: int) -> None:
    with server(index, host, port) as held:
        held.serve_forever()
