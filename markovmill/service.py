"""Models over HTTP: load, unload, stats and generate, answered in JSON."""

from __future__ import annotations

import json
import threading
import time
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.model import Model

# Paths, parameters and fields of the interface
PREFIX = "/api/v1/"


@dataclass
class _Loaded:
    model: Model
    started: float = field(default_factory=time.monotonic)
    at: int = field(default_factory=lambda: int(time.time()))
    requests: int = 0


class Service:
    """Answers requests; one at a time, as each generation already runs on the whole cluster."""

    def __init__(self, spark: SparkSession, seed: int | None = None):
        self.spark, self.seed = spark, seed
        self.models: dict[str, _Loaded] = {}
        self.lock = threading.Lock()
        self.calls = {"load": self._load, "unload": self._unload, "stats": self._stats, "generate": self._generate}

    def respond(self, method: str, url: str) -> dict | None:
        """The answer, or None for "not found" (other methods than GET too)."""
        parts = urlsplit(url)
        call = self.calls.get(parts.path.removeprefix(PREFIX)) if parts.path.startswith(PREFIX) and method == "GET" else None
        if call is None:
            return None
        asked: dict[str, str] = {}
        for k, v in parse_qsl(parts.query, keep_blank_values=True):
            asked.setdefault(k, v)
        if call != self._stats and "model" not in asked:
            return _error("no model given")
        if call == self._generate and "query" not in asked:
            return _error("no query given")
        with self.lock:
            return call(**{k: asked[k] for k in ("model", "query") if k in asked and (k == "model" or call == self._generate)} if call != self._stats else {})

    def _load(self, model: str) -> dict:
        try:
            self.models[model] = _Loaded(Model.load(self.spark, model))
        except Exception as e:  # whatever is wrong with the files is the caller's to know
            return _error("the model can't be read", context=str(e).splitlines()[0], path=model)
        return {"status": "success"}

    def _unload(self, model: str) -> dict:
        self.models.pop(model, None)
        return {"status": "success"}

    def _stats(self) -> dict:
        return {"status": "success", "stats": [self._one(path, x) for path, x in self.models.items()]}

    def _one(self, path: str, x: _Loaded) -> dict:
        rows = {(r.part, r.expert): {"len": r["items"], "size": r.bytes} for r in x.model.summary().collect()}
        experts = [{"transitions": v} for (part, _), v in sorted(rows.items(), key=lambda i: (i[0][1] is not None, i[0][1] or 0)) if part == "expert"]
        base = {"transitions": rows["base", None]}
        known = {"total_size": rows["total", None]["size"], "tokens": rows["vocabulary", None], "base": base, "experts": experts, "metadata": x.model.keys}
        clock = {"server_time": int(time.time()), "loaded_time": x.at, "running_time": int(time.monotonic() - x.started)}
        return {"path": path, "model": known, "stats": {"time": clock, "requests": {"count": x.requests}}}

    def _generate(self, model: str, query: str) -> dict:
        if model not in self.models:
            return _error("load the model first", path=model)
        x = self.models[model]
        x.requests += 1
        try:
            words = generate_all(self.spark, x.model, [query], self.seed)[0][0]
        except Exception as e:
            return _error("generation failed", context=str(e).splitlines()[0], path=model, query=query)
        return {"status": "success", "response": " ".join(words)}

    def serve(self, address: str = "0.0.0.0:8080") -> ThreadingHTTPServer:
        """A server that is bound to the address and not yet running."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self) -> None:
                found = service.respond(self.command, self.path)
                body = b"" if found is None else json.dumps(found).encode()
                self.send_response(404 if found is None else 200)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            do_GET = do_POST = do_PUT = do_DELETE = _answer

        host, _, port = address.rpartition(":")
        return ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)


def _error(what: str, **more: str) -> dict:
    return {"type": "error", "error": what, **more}


def generate_all(spark: SparkSession, model: Model, texts: list[str], seed: int | None = None, steps: int | None = None) -> list[tuple[list[str], list[tuple[int, float]]]]:
    """The words for each prompt and the experts' shares, all prompts in one run. No seed: one from the clock."""
    seed = time.time_ns() % (1 << 31) if seed is None else seed
    prompts = spark.createDataFrame([(i, t.strip()) for i, t in enumerate(texts)], "query_id int, text string")
    found, used = model.generate(prompts, steps, seed)
    shares: dict[int, list[tuple[int, float]]] = {}
    for r in used.where("frequency > 0").orderBy("query_id", F.desc("frequency"), "expert").collect():
        shares.setdefault(r.query_id, []).append((r.expert, r.frequency))
    return [(r.words, shares.get(r.query_id, [])) for r in found.orderBy("query_id").collect()]
