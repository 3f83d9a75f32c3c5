"""Raw requests to responses, in batches and streams: parsed, checked, inspected, enforced, and forwarded by an adapter."""

from __future__ import annotations

import json
import socket
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.operators import cascade, enforce, segments

#: Statuses of requests that go no further.
NO_JSON, INVALID, NO_STREAMS = 400, 422, 501
_BODY = "struct<model:string,stream:boolean,session_id:string,messages:string,context:string>"
_MESSAGE = "array<struct<role:string,content:string>>"
_BLOCKS = f"array<{segments.BLOCK}>"


class UpstreamError(RuntimeError):
    """What came of a request that was forwarded and not answered as it should."""

    def __init__(self, status: int, message: str, payload: dict | None = None):
        super().__init__(message)
        self.status, self.payload = status, payload


Adapter = Callable[[dict], dict]


def echo(body: dict) -> dict:
    """An adapter without a network: answers with the last message."""
    return {"model": body.get("model"), "choices": [{"index": 0, "message": {"role": "assistant", "content": (body.get("messages") or [{}])[-1].get("content")}}]}


def http(url: str, key: str = "", timeout: float = 60.0) -> Adapter:
    """An adapter that posts to a URL: 504 for no answer in time, 503 for none at all, 502 for one that is no JSON."""

    def send(body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            try:
                payload = json.loads(e.read())
            except ValueError:
                payload = None
            raise UpstreamError(e.code, f"upstream answered {e.code}", payload) from e
        except (TimeoutError, socket.timeout) as e:
            raise UpstreamError(504, "upstream took too long") from e
        except urllib.error.URLError as e:
            late = isinstance(e.reason, (TimeoutError, socket.timeout))
            raise UpstreamError(504 if late else 503, "upstream took too long" if late else "upstream can't be reached") from e
        except ValueError as e:
            raise UpstreamError(502, "upstream's answer is no JSON") from e

    return send


#: Adapters by provider, made from keyword options.
ADAPTERS: dict[str, Callable[..., Adapter]] = {"echo": lambda **_: echo, "http": http}


def adapter(provider: str, **options) -> Adapter:
    if provider not in ADAPTERS:
        raise ValueError(f"no provider {provider!r} among {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[provider](**options)


def parsed(bodies: DataFrame) -> DataFrame:
    """Rows (request_id, body) as requests, with `status` and `error` of those that can't be inspected, else null."""
    df = bodies.withColumn("_b", F.from_json("body", _BODY)).withColumn("_m", F.from_json("_b.messages", _MESSAGE))
    df = df.withColumn("_k", F.from_json("_b.messages", "array<map<string,string>>"))
    object_ = F.expr("try_variant_get(try_parse_json(body), '$', 'map<string,variant>')").isNotNull()
    bad = ~object_ | F.col("_m").isNull() | (F.size("_m") == 0) | F.exists("_m", lambda m: m.isNull() | m["role"].isNull())
    status = F.when(F.expr("try_parse_json(body)").isNull(), NO_JSON).when(bad, INVALID).when(F.coalesce(F.col("_b.stream"), F.lit(False)), NO_STREAMS)
    error = F.when(F.col("status") == NO_JSON, "The body must be valid JSON.").when(F.col("status") == INVALID, "Messages with a role each are needed.").when(F.col("status") == NO_STREAMS, "Streamed answers are not supported; set stream to false.")
    of = lambda m: F.struct(m["role"].alias("role"), F.when(~F.ltrim(m["content"]).startswith("["), m["content"]).alias("content"), F.when(F.ltrim(m["content"]).startswith("["), F.from_json(m["content"], _BLOCKS)).alias("blocks"))
    df = df.withColumn("status", status).withColumn("error", error)
    return df.select(
        "request_id", F.lit(0).cast("long").alias("ord"), F.col("_b.session_id").alias("session_id"), F.coalesce("_b.model", F.lit(segments.DEFAULT_MODEL)).alias("model"), F.col("_b.stream").alias("stream"),
        F.when(F.col("status").isNull(), F.transform("_m", of)).alias("messages"), F.when(F.col("status").isNull(), F.from_json("_b.context", segments.CONTEXT)).alias("context"), "status", "error",
    )


def handled(bodies: DataFrame, config: cascade.Config = cascade.Config(stage2=True), send: Adapter | None = None, **policy) -> DataFrame:
    """(request_id, status, action, response): what becomes of every raw request, as JSON.

    400 for what is no JSON, 422 for what is no chat request, 501 for streams, 403 with the reason and the request's id for
    what enforcement blocks; the others are forwarded by `send` (without one, the body that would be is the response).
    """
    df = enforce.run(parsed(bodies), config, **policy)
    message = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.to_json(m["blocks"])).alias("content")))
    forward = F.to_json(F.struct("model", message.alias("messages")))
    fault = lambda text: F.to_json(F.struct(F.struct(text.alias("message"), F.lit("veriloom_error").alias("type"), "request_id").alias("error")))
    status = F.coalesce("status", "response_status")
    out = df.select(
        "request_id",
        status.alias("status"),
        F.when(F.col("status").isNotNull(), "N/A").otherwise(F.col("action")).alias("action"),
        F.when(F.col("status").isNotNull(), fault(F.col("error"))).when(F.col("decision") == "block", fault(F.col("reason"))).otherwise(forward).alias("response"),
    )
    if send is None:
        return out

    def run(batches):
        for pdf in batches:
            for k in pdf.index[pdf["status"] == 200]:
                try:
                    pdf.at[k, "response"] = json.dumps(send(json.loads(pdf.at[k, "response"])))
                except UpstreamError as e:
                    pdf.at[k, "status"], pdf.at[k, "action"] = e.status, "N/A"
                    pdf.at[k, "response"] = json.dumps(e.payload if e.payload is not None else {"error": {"message": str(e), "type": "veriloom_error"}})
            yield pd.DataFrame(pdf)

    return out.mapInPandas(run, "request_id string, status int, action string, response string")
