"""Named queries over JSON-RPC lines: one request in, one response out."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: The error codes of JSON-RPC 2.0.
PARSE, INVALID, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603

#: Method names and the catalogue queries behind them.
METHODS = {
    "queryEvents": "json_event_filter", "getStreamSummary": "stream_summary", "queryClaims": "claims", "queryHighlights": "event_highlights",
    "queryChatters": "chatter_profiles", "querySlang": "lexicon_listing", "produceShorts": "short_packages", "listShorts": "shorts_listing",
    "publishShort": "publish_dispatch", "groundClaim": "claim_grounding", "queryStanceShifts": "stance_shifts", "synthesizeEntityOpinions": "streamer_knowledge",
    "alignCoStreams": "unified_clock", "compareCrossAudience": "sentiment_timeline", "runFullSpectrum": "fusion_matrix", "getFullSpectrumManifest": "timeline_bundle",
    "getCoStreamStatus": "live_status", "harvest.listHarvestedVods": "catalog_queue", "harvest.getHarvesterStatus": "status_counts", "harvest.syncRoster": "anti_join_new",
    "harvest.triggerPipeline": "enqueue_requests", "harvest.listVods": "catalog_queue", "harvest.getStatus": "status_counts",
}
#: Methods on running streams, by what they do.
STREAMS = {"startLiveTail": "start", "startCoStream": "start", "getLiveStatus": "status", "stopLiveTail": "stop", "stopCoStream": "stop"}


class Dispatcher:
    """Answers requests for catalogue queries and registered handlers. Rows come back paged, never whole tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], page: int = 100):
        self.spark, self.sf_dir, self.queries, self.page = spark, sf_dir, queries, page
        self.handlers: dict[str, Callable[[dict], Any]] = {"ping": lambda p: {"status": "ok"}, "listMethods": lambda p: sorted({*METHODS, *self.queries, *self.handlers})}
        self.handlers |= {"listSchemas": lambda p: sorted(self.queries), "getJsonSchema": lambda p: json.loads(self.queries[p["name"]](self.spark, self.sf_dir).schema.json())}
        self.handlers |= {method: partial(self._stream, act) for method, act in STREAMS.items()}
        self.starts: dict[str, Callable[[dict], StreamingQuery]] = {}
        self.running: dict[str, StreamingQuery] = {}

    def register(self, method: str, handler: Callable[[dict], Any]) -> None:
        self.handlers[method] = handler

    def register_stream(self, name: str, start: Callable[[dict], StreamingQuery]) -> None:
        """Names a stream that requests may start; start() gets the request's parameters."""
        self.starts[name] = start

    def _stream(self, act: str, params: dict) -> dict:
        name = params["name"]
        if act == "start":
            start = self.starts[name]
            if name not in self.running or not self.running[name].isActive:
                self.running[name] = start(params)
        elif act == "stop" and name in self.running:
            self.running[name].stop()
        query = self.running.get(name)
        last = query.lastProgress if query is not None else None
        return {"name": name, "active": query is not None and query.isActive, "rows": None if last is None else last["numInputRows"], "error": None if query is None or query.exception() is None else "failed"}

    def _run(self, name: str, params: dict) -> dict:
        """Rows of a query that fit params["where"] (column to value), ordered by all orderable columns."""
        df = self.queries[name](self.spark, self.sf_dir)
        for column, value in (params.get("where") or {}).items():
            if column not in df.columns:
                raise KeyError(column)
            df = df.where(F.col(column) == value)
        limit, offset = min(int(params.get("limit", self.page)), self.page), int(params.get("offset", 0))
        flat = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
        rows = df.orderBy(*flat).offset(offset).limit(limit).toJSON().collect()
        return {"columns": df.columns, "rows": [json.loads(r) for r in rows]}

    def handle(self, request: Any) -> dict:
        def failed(code: int, message: str) -> dict:
            return {"jsonrpc": "2.0", "id": request.get("id") if isinstance(request, dict) else None, "error": {"code": code, "message": message}}

        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return failed(INVALID, "not a request")
        method, params = request["method"], request.get("params") or {}
        if not isinstance(params, dict):
            return failed(BAD_PARAMS, "params must be an object")
        try:
            if method in self.handlers:
                result = self.handlers[method](params)
            elif (name := METHODS.get(method, method)) in self.queries:
                result = self._run(name, params)
            else:
                return failed(NO_METHOD, f"no method {method}")
        except (KeyError, ValueError, TypeError) as e:
            return failed(BAD_PARAMS, str(e))
        except Exception as e:
            return failed(INTERNAL, str(e).split("\n")[0])
        return {"jsonrpc": "2.0", "id": request.get("id"), "result": result}

    def handle_line(self, line: str) -> str:
        try:
            request = json.loads(line)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "not JSON"}})
        return json.dumps(self.handle(request))
