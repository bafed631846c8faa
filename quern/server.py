"""The HTTP endpoint: ``GET /query?sql=...`` gives ``{headers, data, truncated}`` or ``{error}``.

Only queries are run: a page of another site may send requests too.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .dialect import parse
from .engine import Engine
from .printing import cell, printable

PAGE = """<!DOCTYPE html><meta charset="utf-8"><title>Quern</title>
<style>body{font-family:sans-serif;margin:2em}textarea{width:100%;height:8em}td,th{padding:.2em .6em;border:1px solid #ccc}</style>
<textarea id="sql" placeholder="SELECT ..."></textarea><p><button id="run">Run</button> <button id="back">&lt;</button> <span id="at"></span> <button id="on">&gt;</button></p><div id="out"></div>
<script>
const size = 20, $ = id => document.getElementById(id);
let result = {headers: [], data: []}, page = 0;
const row = (cells, tag) => { const tr = document.createElement('tr'); for (const c of cells) { const td = document.createElement(tag); td.textContent = c; tr.append(td); } return tr; };
function show() {
  const pages = Math.max(1, Math.ceil(result.data.length / size));
  page = Math.min(Math.max(page, 0), pages - 1);
  const table = document.createElement('table');
  table.append(row(result.headers, 'th'), ...result.data.slice(page * size, page * size + size).map(r => row(r, 'td')));
  $('out').replaceChildren(table); $('at').textContent = `${page + 1} / ${pages}` + (result.truncated ? ' (cut off)' : '');
}
async function run() {
  const got = await (await fetch('/query?sql=' + encodeURIComponent($('sql').value))).json();
  if (got.error) { $('out').textContent = got.error; return; }
  result = got; page = 0; show();
}
$('run').onclick = run; $('back').onclick = () => { page--; show(); }; $('on').onclick = () => { page++; show(); };
$('sql').onkeydown = e => { if (e.ctrlKey && e.key === 'Enter') run(); };
</script>"""


class Handler(BaseHTTPRequestHandler):
    engine: Engine
    max_rows: int

    def _send(self, status: int, body: bytes, kind: str = "application/json") -> None:
        self.send_response(status)
        for k, v in (("Content-Type", f"{kind}; charset=utf-8"), ("Content-Length", str(len(body))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type")):
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def _json(self, status: int, value: dict) -> None:
        self._send(status, json.dumps(value).encode())

    def do_GET(self) -> None:
        url = urlsplit(self.path)
        if url.path == "/":
            return self._send(200, PAGE.encode(), "text/html")
        if url.path != "/query":
            return self._json(404, {"error": "no such path"})
        sql = parse_qs(url.query).get("sql", [""])[0].strip()
        if not sql:
            return self._json(400, {"error": "the sql parameter is missing or empty"})
        try:
            statement = parse(sql.rstrip("; \n"))
            if statement.kind != "select" or statement.name is not None:
                return self._json(403, {"error": "only queries are run over HTTP"})
            df = self.engine.execute(sql.rstrip("; \n"))
            rows = printable(df.limit(self.max_rows + 1)).collect()
            data = [[cell(v) for v in r] for r in rows[: self.max_rows]]
            self._json(200, {"headers": df.columns, "data": data, "truncated": len(rows) > self.max_rows})
        except Exception as e:  # the client gets what went wrong
            self._json(200, {"error": str(e)})

    def do_OPTIONS(self) -> None:
        self._send(200, b"")

    def _refuse(self) -> None:
        self._json(405, {"error": "only GET is allowed"})

    do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = _refuse

    def log_message(self, *args) -> None:
        pass


def serve(engine: Engine, port: int = 8080, host: str = "127.0.0.1", max_rows: int = 10_000) -> ThreadingHTTPServer:
    """A server, not yet running: ``serve(engine).serve_forever()``.

    Answers hold ``max_rows`` rows at most, as they go through the driver, and tell if there
    are more.
    """
    return ThreadingHTTPServer((host, port), type("BoundHandler", (Handler,), {"engine": engine, "max_rows": max_rows}))


def main() -> None:
    from .session import build_session

    serve(Engine(build_session("quern server"))).serve_forever()


if __name__ == "__main__":
    main()
