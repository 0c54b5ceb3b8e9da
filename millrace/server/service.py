"""The service: ``GET /datashape``, ``POST /compute``, and, where allowed, ``POST /add``.

Bodies are JSON.  Trees name operations from a fixed list; nothing that arrives is executed as
code.  Run it with ``python -m millrace.server.service catalog.yaml``.
"""

from __future__ import annotations

import argparse
import base64
import cProfile
import datetime as dt
import decimal
import hashlib
import io
import json
import logging
import math
import pstats
import time
import traceback
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

from ..plans import types
from ..plans.expr import Expr
from ..plans.results import Database, data, frame, session
from ..plans.tree import from_tree, to_tree
from ..sources import catalog

#: Fixed value: the port that clients expect.
PORT = 6363
#: Fixed value: the media type of an Arrow stream.
ARROW = "application/vnd.apache.arrow.stream"
log = logging.getLogger("millrace.server")


def plain(v: Any) -> Any:
    """A value as JSON has it."""
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, dt.timedelta):
        return v.total_seconds()
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, bytes | bytearray):
        return base64.b64encode(v).decode()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float) and not math.isfinite(v):
        return None if v != v else str(v)  # JSON has no infinity: "inf" or "-inf"
    return v


def digest(e: Expr) -> str:
    """A name for an expression: the md5 of its text."""
    return hashlib.md5(str(e).encode(), usedforsecurity=False).hexdigest()


class Refused(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


class Server:
    """Serves the tables of a database (or one table).

    ``authorize`` is asked with the request's authorization header; ``allow_add`` opens
    ``/add``; ``allow_profile`` lets a request ask for a profile, ``profile`` makes each one, and
    ``profile_folder`` keeps them in files, by expression and time; ``most_rows`` bounds what a
    result may send; ``tell`` makes the text that the log has of an exception.

    A request may hold ``compute_kwargs`` (``most_rows``, a lower bound of its own) and
    ``odo_kwargs`` (``orient``: ``rows`` or ``columns``, how a table's data are laid out).
    """

    def __init__(
        self, tables: Any, authorize: Callable[[str | None], bool] | None = None, allow_add: bool = False, allow_profile: bool = False,
        profile: bool = False, most_rows: int = 1_000_000, host: str = "127.0.0.1", port: int = PORT,
        profile_folder: str | None = None, tell: Callable[[BaseException], str] | None = None,
    ):
        self.tables = tables if isinstance(tables, dict) else Database({"data": data(tables)})
        self.authorize, self.allow_add = authorize, allow_add
        self.allow_profile, self.profile, self.most_rows = allow_profile, profile, most_rows
        self.profile_folder, self.tell = profile_folder, tell or (lambda err: "".join(traceback.format_exception(err)))
        self.host, self.port, self._http = host, port, None

    # -- what it answers -------------------------------------------------------------------
    def datashape(self) -> dict:
        def say(tables):
            return {n: say(t) if isinstance(t, dict) else t.dshape for n, t in tables.items()}

        return say(self.tables)

    def compute_arrow(self, body: dict) -> bytes:
        """The rows of an expression as an Arrow stream, with all their types; an expression of one value has one row."""
        import pyarrow as pa

        e = self._expression(body, {"expr", "namespace", "compute_kwargs"})
        most, _ = self._asked(body)
        try:
            table = frame(e).limit(most + 1).toArrow()
        except NotImplementedError as err:
            raise Refused(501, str(err)) from err
        if table.num_rows > most:
            raise Refused(413, f"more than {most} rows")
        held = io.BytesIO()
        with pa.ipc.new_stream(held, table.schema) as out:
            out.write_table(table)
        return held.getvalue()

    def _asked(self, body: dict) -> tuple[int, str]:
        """How many rows at most, and how they are laid out."""
        wanted = {"compute_kwargs": {"most_rows": self.most_rows}, "odo_kwargs": {"orient": "rows"}}
        for part, known in wanted.items():
            given = body.get(part) or {}
            if not isinstance(given, dict) or set(given) - set(known):
                raise Refused(400, f"{part} may hold {sorted(known)}")
            known.update(given)
        most, orient = wanted["compute_kwargs"]["most_rows"], wanted["odo_kwargs"]["orient"]
        if not isinstance(most, int) or most < 0 or orient not in ("rows", "columns"):
            raise Refused(400, "most_rows is a whole number, orient is rows or columns")
        return min(most, self.most_rows), orient

    def _expression(self, body: dict, known: set[str]) -> Expr:
        unknown = set(body) - known
        if unknown or "expr" not in body:
            raise Refused(400, f"unknown keys {sorted(unknown)}" if unknown else "no expression")
        try:
            e = from_tree(body["expr"], dict(self.tables))
        except (ValueError, TypeError, KeyError) as err:
            raise Refused(400, str(err)) from err
        if not isinstance(e, Expr):
            raise Refused(400, "not an expression")
        return e

    def compute(self, body: dict) -> dict:
        e = self._expression(body, {"expr", "profile", "namespace", "compute_kwargs", "odo_kwargs"})
        most, orient = self._asked(body)
        asked = body.get("profile", self.profile)
        if asked and not self.allow_profile:
            raise Refused(403, "profiles are not allowed")
        profiler = cProfile.Profile() if asked else None
        if profiler:
            profiler.enable()
        try:
            df = frame(e)
            rows = df.limit(most + 1).collect()
        except NotImplementedError as err:
            raise Refused(501, str(err)) from err
        finally:
            if profiler:
                profiler.disable()
        if len(rows) > most:
            raise Refused(413, f"more than {most} rows")
        table = isinstance(e.measure, types.Record)
        out = [plain(tuple(r)) if table else plain(r[0]) for r in rows]
        if table and e.dims and orient == "columns":
            out = {n: [r[i] for r in out] for i, n in enumerate(e.fields)}
        answer = {"datashape": e.dshape, "names": e.fields or df.columns, "data": out if e.dims else (out[0] if out else None), "digest": digest(e)}
        if profiler:
            text = io.StringIO()
            pstats.Stats(profiler, stream=text).sort_stats("cumulative").print_stats(30)
            answer["profile"] = text.getvalue()
            if self.profile_folder:
                kept = Path(self.profile_folder) / digest(e)
                kept.mkdir(parents=True, exist_ok=True)
                profiler.dump_stats(kept / str(time.time_ns()))
        return answer

    def add(self, body: dict) -> dict:
        if not self.allow_add:
            raise Refused(404, "adding is not allowed")
        for name, uri in body.items():
            if name in self.tables:
                raise Refused(409, f"{name} is there already")
            entry = uri if isinstance(uri, dict) else {"source": uri}
            try:
                self.tables[name] = data(entry["source"], entry.get("dshape"), name=name)
            except Exception as err:
                raise Refused(422, f"{name}: {str(err)[:300]}") from err
        return {"added": sorted(body)}

    # -- HTTP ------------------------------------------------------------------------------
    def _handler(server):
        class Handler(BaseHTTPRequestHandler):
            def log_message(self, form, *args):
                log.info(form, *args)

            def answer(self, status: int, body: Any):
                arrow = isinstance(body, bytes)
                raw = body if arrow else json.dumps(body, allow_nan=False).encode()
                self.send_response(status)
                self.send_header("Content-Type", ARROW if arrow else "application/json")
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def run(self, what: Callable[[], dict]):
                try:
                    if server.authorize is not None and not server.authorize(self.headers.get("Authorization")):
                        raise Refused(401, "not authorised")
                    self.answer(200, what())
                except Refused as err:
                    self.answer(err.status, {"error": str(err)})
                except Exception as err:
                    log.error("failed: %s", server.tell(err))
                    self.answer(500, {"error": str(err)[:1000]})

            def do_GET(self):
                self.run({"/datashape": server.datashape}.get(self.path) or self.lost)

            def lost(self):
                raise Refused(404, f"no {self.path}")

            def do_POST(self):
                def act():
                    compute = server.compute_arrow if ARROW in self.headers.get("Accept", "") else server.compute
                    f = {"/compute": compute, "/add": server.add}.get(self.path) or self.lost
                    if self.headers.get_content_type() != "application/json":
                        raise Refused(415, "send application/json")
                    try:
                        body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                    except ValueError as err:
                        raise Refused(400, "not JSON") from err
                    if not isinstance(body, dict):
                        raise Refused(400, "send an object")
                    return f(body)

                self.run(act)

        return Handler

    def start(self, background: bool = True):
        """Listen; in the background unless told."""
        import threading

        self._http = ThreadingHTTPServer((self.host, self.port), self._handler())
        self.port = self._http.server_address[1]
        if background:
            threading.Thread(target=self._http.serve_forever, daemon=True).start()
        else:
            self._http.serve_forever()
        return self

    def stop(self) -> None:
        if self._http:
            self._http.shutdown()
            self._http.server_close()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Serve the tables of a catalog file or a directory.")
    p.add_argument("catalog")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=PORT)
    p.add_argument("--allow-add", action="store_true")
    p.add_argument("--allow-profile", action="store_true")
    a = p.parse_args(args)
    spark = session()
    tables = catalog.from_file(a.catalog, spark) if a.catalog.endswith((".yaml", ".yml", ".json")) else catalog.from_directory(a.catalog, spark)
    Server(tables, allow_add=a.allow_add, allow_profile=a.allow_profile, host=a.host, port=a.port).start(background=False)


__all__ = ["PORT", "Server", "digest", "main", "to_tree"]

if __name__ == "__main__":
    main()
