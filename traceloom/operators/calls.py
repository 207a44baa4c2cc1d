"""Tool calls, their outputs and the final cost out of streams of JSON events whose arguments come in pieces.

Fixed values: the field names and words of the events are those of the external stream.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Each cost and where the final event has it.
COSTS = {
    "tokens_in": "usage.input_tokens",
    "tokens_out": "usage.output_tokens",
    "tokens_cache_write": "usage.cache_creation_input_tokens",
    "tokens_cache_read": "usage.cache_read_input_tokens",
    "cost_usd": "total_cost_usd",
}
UNPARSED = "unparsed"  # holds arguments that are no JSON
_CALLS = "stream string, ord bigint, kind string, name string, id string, args string, text string, failed boolean, cost map<string,double>"


def tool_events(events: DataFrame) -> DataFrame:
    """The columns of _CALLS from events(stream, ord, raw): kind is call, output or result.

    A block is the events of one index from a start to its stop; its pieces are put together in the order of ord. A
    block without a stop is no call yet.
    """
    at = lambda path: F.get_json_object("raw", f"$.{path}")
    typed = events.withColumn("type", at("type"))
    inner = typed.filter("type = 'stream_event'").select(
        "stream", "ord", at("event.index").cast("int").alias("index"), at("event.type").alias("what"), at("event.content_block.type").alias("block"),
        at("event.content_block.name").alias("name"), at("event.content_block.id").alias("id"), at("event.delta.partial_json").alias("piece"),
    )
    upto = Window.partitionBy("stream", "index").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    blocks = inner.filter("index is not null").withColumn("nth", F.count_if(F.col("block").isNotNull()).over(upto)).groupBy("stream", "index", "nth")
    pieces = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("ord", "piece"))))
    calls = blocks.agg(
        F.max(F.when(F.col("what") == "content_block_stop", F.col("ord"))).alias("ord"), F.max(F.when(F.col("block") == "tool_use", F.col("name"))).alias("name"), F.max("id").alias("id"),
        F.count_if(F.col("block") == "tool_use").alias("uses"), F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("given"),
    ).filter("ord is not null and uses > 0")
    args = F.when(F.col("given") == "", "{}").when(F.try_parse_json("given").isNotNull(), F.col("given")).otherwise(F.to_json(F.struct(F.col("given").alias(UNPARSED))))
    none = lambda c: F.lit(None).alias(c)
    calls = calls.select("stream", "ord", F.lit("call").alias("kind"), "name", "id", args.alias("args"), none("text"), none("failed"), none("cost"))
    content = F.from_json(at("message.content"), "array<struct<type:string,tool_use_id:string,content:string,is_error:boolean>>")
    outputs = typed.filter("type = 'user'").select("stream", "ord", F.explode(content).alias("b")).filter("b.type = 'tool_result'")
    outputs = outputs.select("stream", "ord", F.lit("output").alias("kind"), none("name"), F.col("b.tool_use_id").alias("id"), none("args"), F.col("b.content").alias("text"), F.coalesce("b.is_error", F.lit(False)).alias("failed"), none("cost"))
    cost = F.map_filter(F.create_map(*[c for own, path in COSTS.items() for c in (F.lit(own), at(path).cast("double"))]), lambda k, v: v.isNotNull())
    ends = typed.filter("type = 'result'").select("stream", "ord", F.lit("result").alias("kind"), none("name"), none("id"), none("args"), at("result").alias("text"), F.coalesce(at("is_error").cast("boolean"), F.lit(False)).alias("failed"), cost.alias("cost"))
    out = calls.unionByName(outputs).unionByName(ends)
    fields = [f.strip().split(" ", 1) for f in _CALLS.split(", ")]
    return out.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def structured_answers(events: DataFrame, schema: str) -> DataFrame:
    """stream, answer: what each stream's final event gives as structured output, of a schema; a null answer is none of that schema."""
    answer = F.from_json(F.get_json_object("raw", "$.structured_output"), schema)
    return events.filter(F.get_json_object("raw", "$.type") == "result").select("stream", answer.alias("answer"))


def _at(event: dict[str, Any], path: str) -> Any:
    for key in path.split("."):
        event = event.get(key) if isinstance(event, dict) else None
    return event


def _block(log: list[dict[str, Any]]) -> dict[str, Any] | None:
    """The call that the events of one block make."""
    opened = next((e["content_block"] for e in log if _at(e, "content_block.type") == "tool_use"), None)
    if opened is None:
        return None
    given = "".join(_at(e, "delta.partial_json") or "" for e in log)
    try:
        args = json.loads(given or "{}")
    except ValueError:
        args = {UNPARSED: given}
    return {"kind": "call", "name": opened["name"], "id": opened["id"], "args": args}


def assembled_calls(events: Iterable[dict[str, Any]]) -> Iterator[dict[str, Any]]:
    """The same from the events of one stream as they come: each call when its block stops."""
    blocks: dict[int, list[dict[str, Any]]] = defaultdict(list)
    for event in events:
        match event:
            case {"type": "stream_event", "event": {"type": "content_block_stop", "index": index}}:
                if call := _block(blocks.pop(index, [])):
                    yield call
            case {"type": "stream_event", "event": {"index": index, **inner}}:
                blocks[index].append(inner)
            case {"type": "user", "message": {"content": list(parts)}}:
                for part in parts:
                    if _at(part, "type") == "tool_result":
                        yield {"kind": "output", "text": part.get("content"), "error": bool(part.get("is_error"))}
            case {"type": "result"}:
                yield {"kind": "result", "cost": {own: v for own, path in COSTS.items() if (v := _at(event, path)) is not None}, "event": event}


def validated_answer(events: Iterable[dict[str, Any]], validate: Callable[[Any], Any]) -> Any:
    """The structured output of a stream's final event, as `validate` gives it back or refuses it."""
    final = next((c["event"] for c in assembled_calls(events) if c["kind"] == "result"), None)
    if final is None or final.get("is_error"):
        raise RuntimeError(f"the stream gave no answer: {(final or {}).get('result')}")
    if final.get("structured_output") is None:
        raise RuntimeError("the final event has no structured output")
    return validate(final["structured_output"])
