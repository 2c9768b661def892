"""HTTP service of prepared pipelines, on the standard library's threading server."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import PySparkException

from tidewell.plans.pipeline import Engine, Pipeline, RequestError, failure, now, success
from tidewell.sources.context import is_remote


class Service:
    """Answers as (status, body); what the HTTP handler sends."""

    def __init__(self, engine: Engine, pipelines: list[Pipeline]):
        self.engine = engine
        self.pipelines = {p.metadata.name: engine.prepare(p) for p in pipelines}

    def _missing(self, name: str) -> tuple[int, dict]:
        return 404, failure("pipeline_not_found", f"no pipeline {name!r}", {"available_pipelines": sorted(self.pipelines)})

    def health(self) -> tuple[int, dict]:
        return 200, {"status": "healthy", "service": "tidewell", "timestamp": now()}

    def pipeline_health(self, name: str) -> tuple[int, dict]:
        if name not in self.pipelines:
            return self._missing(name)
        started, checks = time.time(), []
        for s in self.engine.sources:
            entry = {"name": s.name, "status": "healthy", "accessible": True}
            try:
                self.engine.spark.table(s.name).schema  # noqa: B018
            except PySparkException as e:
                entry |= {"status": "unhealthy", "accessible": False, "error": str(e).splitlines()[0]}
            checks.append(entry)
        good = sum(c["accessible"] for c in checks)
        p = self.pipelines[name]
        return 200, {
            "status": "healthy" if good == len(checks) else "degraded",
            "pipeline": {"name": name, "version": p.metadata.version, "parameters": len(p.request)},
            "data_sources": {"total": len(checks), "healthy": good, "checks": checks},
            "health_check_time_ms": int((time.time() - started) * 1000),
            "timestamp": now(),
        }

    def list(self) -> tuple[int, dict]:
        entries = [{"name": n, "version": p.metadata.version, "endpoint": f"/{n}/execute"} for n, p in sorted(self.pipelines.items())]
        return 200, {"success": True, "pipelines": entries, "count": len(entries), "data_sources": len(self.engine.sources), "timestamp": now()}

    def describe(self, name: str) -> tuple[int, dict]:
        if name not in self.pipelines:
            return self._missing(name)
        p = self.pipelines[name]
        return 200, {
            "success": True,
            "pipeline": {
                "name": name, "version": p.metadata.version, "endpoint": f"/{name}/execute",
                "parameters": [{"name": x.name, "type": x.type.simpleString()} for x in p.request],
                "created_at": p.metadata.created_at, "updated_at": p.metadata.updated_at,
            },
            "timestamp": now(),
        }

    def sources(self) -> tuple[int, dict]:
        data = []
        for s in self.engine.sources:
            fields = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in self.engine.spark.table(s.name).schema]
            place = {"url" if is_remote(s.path) else "path": s.path} if s.path else {}
            data.append({"name": s.name, "type": s.type, **place, "tables": [{"name": s.name, "schema": fields}]})
        return 200, {"success": True, "data": data, "count": len(data), "timestamp": now()}

    def execute(self, name: str, request: object) -> tuple[int, dict]:
        if name not in self.pipelines:
            return self._missing(name)
        if not isinstance(request, dict):
            return 400, failure("parameter_validation_error", "the body must be a JSON object")
        started = time.time()
        try:
            return 200, success(self.engine.execute(self.pipelines[name], request), started)
        except RequestError as e:
            return 400, failure("parameter_validation_error", str(e), e.details)
        except PySparkException as e:
            return 500, failure("query_execution_error", str(e).splitlines()[0])
        except (TypeError, ValueError) as e:
            return 500, failure("internal_error", str(e))

    def get(self, path: str) -> tuple[int, dict]:
        match [p for p in path.split("?")[0].split("/") if p]:
            case ["health"]:
                return self.health()
            case ["health", name]:
                return self.pipeline_health(name)
            case ["pipelines"]:
                return self.list()
            case ["pipeline", name]:
                return self.describe(name)
            case ["data_source"]:
                return self.sources()
        return 404, failure("not_found", path)

    def post(self, path: str, body: bytes) -> tuple[int, dict]:
        match [p for p in path.split("?")[0].split("/") if p]:
            case [name, "execute"]:
                try:
                    return self.execute(name, json.loads(body or b"{}"))
                except json.JSONDecodeError as e:
                    return 400, failure("parameter_validation_error", f"the body is not JSON: {e}")
        return 404, failure("not_found", path)


def server(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict | None) -> None:
            raw = b"" if body is None else json.dumps(body, default=str).encode()
            self.send_response(status)
            for k, v in (("Content-Type", "application/json"), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "*"), ("Access-Control-Allow-Methods", "*"), ("Content-Length", str(len(raw)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def do_OPTIONS(self) -> None:
            self._send(204, None)

        def do_GET(self) -> None:
            self._send(*service.get(self.path))

        def do_POST(self) -> None:
            self._send(*service.post(self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0))))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
