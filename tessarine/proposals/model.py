"""The one model call: prompt, schema, a recorded client and retries."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ASK = "Name the things and relations that these records give evidence of. Cite the records of every claim."


def prompt(declared: list[str], records: list[tuple[str, dict]], known: list[tuple[str, str]] = (), gray: list[tuple[str, str]] = (), *, types: list[tuple[str, list[str]]] = (), mentioned: list[tuple[str, str]] = (), groups: list[list[str]] = (), candidates: list[tuple[str, str]] = (), left_out: int = 0, type_relations: bool = False) -> str:
    """The request's text: sections in a fixed order, each only when it has something, so equal input gives equal text.

    declared: rendered structures; known and mentioned: key and name; types: name and the ids of specimens; groups: records
    that linkage took together; gray and candidates: undecided pairs of records, and of a record and a known key; left_out:
    how many of these found no room.
    """
    parts = [ASK]
    if type_relations:
        parts.append("Say also which kinds of things are kinds of others, where a record says so.")
    pairs = [f"{a} ~ {b}" for a, b in gray]
    if left_out and pairs + list(candidates):
        pairs.append(f"and {left_out} more that are not listed")
    sections = (
        ("Declared", sorted(declared)),
        ("Types in use", [f"{n} (as in {', '.join(r)})" if r else n for n, r in sorted(types)]),
        ("Known", [f"{k}: {n}" for k, n in sorted(known)]),
        ("Mentioned before", [f"{k}: {n}" for k, n in sorted(mentioned)]),
        ("One thing each", [", ".join(g) for g in groups if len(g) > 1]),
        ("Undecided pairs", pairs),
        ("Perhaps known", [f"{r} ~ {k}" for r, k in candidates]),
        ("Records", [f"{i} {json.dumps(f, ensure_ascii=False, sort_keys=True)}" for i, f in records]),
    )
    for title, lines in sections:
        if lines:
            parts.append(f"{title}:\n" + "\n".join(lines))
    return "\n\n".join(parts)


def schema(known: bool, mentioned: bool, type_relations: bool) -> dict:
    """The strict JSON schema of an answer, one of eight."""
    text, many = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    base = {"claim": text, "sources": many, "confidence": {"type": "number"}}
    entity = {"id": text, "name": text, "type": text, "denotedBy": many} | base | ({"knownEntityKey": {"type": ["string", "null"]}} if known else {})
    make = lambda p: {"type": "array", "items": {"type": "object", "properties": p, "required": list(p), "additionalProperties": False}}
    properties = {"entities": make(entity), "relations": make({"name": text, "from": text, "to": text} | base)}
    if mentioned:
        properties["mergeCandidates"] = make({"entity": text, "key": text, "claim": text, "confidence": {"type": "number"}})
    if type_relations:
        properties["typeRelations"] = make({"sub": text, "super": text} | base)
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def request_key(text: Column, schema_text: Column) -> Column:
    return F.sha2(F.concat(text, F.lit("\n"), schema_text), 256)


def replayed(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests (batch_id, prompt, schema) with the recorded answers (key, body); unknown requests get null."""
    return requests.withColumn("key", request_key(F.col("prompt"), F.col("schema"))).join(responses, "key", "left")


class EndpointError(Exception):
    """An answer other than success; retry_after in seconds, if the endpoint asked for it."""

    def __init__(self, status: int, text: str = "", retry_after: float | None = None):
        super().__init__(f"status {status}: {text[:200]}")
        self.status, self.retry_after = status, retry_after


def is_transient(e: Exception) -> bool:
    """Whether another try may help: a lost connection, a timeout, or a status that says so (408, 429, 500 and above)."""
    if isinstance(e, EndpointError):
        return e.status in (408, 429) or e.status >= 500
    return isinstance(e, (ConnectionError, TimeoutError))


def http_client(url: str, model: str, schema_: dict | None = None, key: str | None = None, temperature: float | None = None, stream: bool = False, timeout: float = 600.0) -> Callable[[str], str]:
    """A call to a chat-completions endpoint: the prompt as the user's message, the answer's text back. With stream the answer
    comes as server-sent events."""
    body = {"model": model} | ({"temperature": temperature} if temperature is not None else {}) | ({"stream": True} if stream else {})
    if schema_ is not None:
        body["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": schema_}}

    def call(text: str) -> str:
        data = json.dumps(body | {"messages": [{"role": "user", "content": text}]}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=timeout) as answer:
                if stream:
                    return streamed(line.decode("utf-8", "replace") for line in answer)
                return answered(json.loads(answer.read()))
        except urllib.error.HTTPError as e:
            after = e.headers.get("Retry-After") if e.headers else None
            raise EndpointError(e.code, e.read().decode("utf-8", "replace"), float(after) if after and after.replace(".", "", 1).isdigit() else None) from e
        except urllib.error.URLError as e:
            raise (TimeoutError if isinstance(e.reason, TimeoutError) else ConnectionError)(str(e.reason)) from e

    return call


def answered(message: dict) -> str:
    """The text of a whole answer; one that was cut off or holds none is an error."""
    choice = (message.get("choices") or [{}])[0]
    text = (choice.get("message") or {}).get("content")
    if choice.get("finish_reason") == "length":
        raise ValueError("the answer was cut off")
    if not text:
        raise ValueError("the answer holds no text")
    return text


def streamed(lines) -> str:
    """The text of an answer that comes in events."""
    parts, reason = [], None
    for line in lines:
        if not line.startswith("data:"):
            continue
        data = line[5:].strip()
        if data == "[DONE]":
            break
        for choice in json.loads(data).get("choices") or []:
            parts.append((choice.get("delta") or {}).get("content") or "")
            reason = choice.get("finish_reason") or reason
    return answered({"choices": [{"message": {"content": "".join(parts)}, "finish_reason": reason}]})


def recorded(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """What replayed() reads later: key and body, the first answer of every request (batch_id, prompt, schema) that has one
    (batch_id, body)."""
    keyed = requests.select("batch_id", request_key(F.col("prompt"), F.col("schema")).alias("key")).join(answers.where(F.col("body").isNotNull()), "batch_id")
    return keyed.groupBy("key").agg(F.min_by("body", "batch_id").alias("body"))


def with_retries(call: Callable[[str], str], most: int = 4, first_delay: float = 1.0, transient: Callable[[Exception], bool] = is_transient, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """call, tried again after transient failures; the delay doubles, up to an hour, or follows the error's retry_after."""

    def run(text: str) -> str:
        delay = first_delay
        for k in range(most):
            try:
                return call(text)
            except Exception as e:
                if k + 1 == most or not transient(e):
                    raise
                sleep(min(3600.0, max(delay, getattr(e, "retry_after", None) or 0.0)))
                delay *= 2
        raise AssertionError

    return run


def completed(requests: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """batch_id and body: one call a request, a client a task."""
    import pandas as pd

    def run(batches):
        call = client()
        for part in batches:
            yield pd.DataFrame({"batch_id": part["batch_id"], "body": [call(p) for p in part["prompt"]]})

    return requests.select("batch_id", "prompt").mapInPandas(run, "batch_id string, body string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:8]
