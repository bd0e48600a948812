"""Replies streamed as server-sent events, in four wire formats: text is held to whole words, tool calls until they
are whole, so that stand-ins are never cut in two. Held events are then swapped by a join.

A format is an adapter that reads an event into pieces (text, call, end) and writes pieces back; holding is the same
for all. State of a reply is one JSON text, bounded by a word and the open calls. Batch and stream use the
same step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators import standins
from quillon.streaming.rewrite import released

Event = tuple[str | None, str]
FORMATS = ("anthropic", "chat", "responses", "gemini")


def _dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class Holder:
    """What one reply holds: texts and calls by the place they belong to."""

    def __init__(self, state: str | None = None, longest: int = 0):
        held = json.loads(state) if state else {}
        self.texts: dict[str, str] = held.get("texts", {})
        self.calls: dict[str, str] = held.get("calls", {})
        self.base: dict = held.get("base", {})
        self.longest = longest

    def state(self) -> str:
        return _dump({"texts": self.texts, "calls": self.calls, "base": self.base})

    def text(self, place: str, more: str, done: bool = False) -> str:
        out, rest = released(self.texts.pop(place, ""), more, done, self.longest)
        if not done:
            self.texts[place] = rest
        return out

    def call(self, place: str, more: str) -> None:
        self.calls[place] = self.calls.get(place, "") + more

    def take(self, place: str) -> str:
        return self.calls.pop(place, "")


def _anthropic(h: Holder, event: str | None, data: dict) -> list[Event]:
    kind, place = data.get("type"), str(data.get("index", ""))
    delta = lambda d: ("content_block_delta", _dump({"type": "content_block_delta", "index": data.get("index"), "delta": d}))
    if kind == "content_block_start":
        block = data.get("content_block") or {}
        if block.get("type") == "tool_use":
            h.calls[place] = ""
            if block.get("input"):
                h.base["start " + place] = _dump(block["input"])
                block["input"] = {}
        elif block.get("type") == "text":
            h.texts[place] = ""
        return [(event, _dump(data))]
    if kind == "content_block_delta":
        d = data.get("delta") or {}
        if d.get("type") == "text_delta" and place in h.texts:
            out = h.text(place, d.get("text") or "")
            return [delta({"type": "text_delta", "text": out})] if out else []
        if d.get("type") == "input_json_delta" and place in h.calls:
            h.call(place, d.get("partial_json") or "")
            return []
    if kind == "content_block_stop":
        before = []
        if place in h.texts and (rest := h.text(place, "", True)):
            before.append(delta({"type": "text_delta", "text": rest}))
        if place in h.calls and (whole := h.take(place) or h.base.pop("start " + place, "")):
            before.append(delta({"type": "input_json_delta", "partial_json": whole}))
        return [*before, (event, _dump(data))]
    return [(event, _dump(data))]


def _anthropic_rest(h: Holder) -> list[Event]:
    out = []
    for place in sorted({*h.texts, *h.calls}, key=lambda p: (len(p), p)):
        d = {"type": "text_delta", "text": h.text(place, "", True)} if place in h.texts else {"type": "input_json_delta", "partial_json": h.take(place) or h.base.pop("start " + place, "")}
        if d.get("text") or d.get("partial_json"):
            out.append(("content_block_delta", _dump({"type": "content_block_delta", "index": int(place or 0), "delta": d})))
    return out


def _chat_choice(h: Holder, index: int, **delta) -> Event:
    reason = delta.pop("reason", None)
    return None, _dump({**h.base, "choices": [{"index": index, "delta": delta, "finish_reason": reason}]})


def _chat_calls(h: Holder, index: int) -> list[Event]:
    places = sorted(p for p in h.calls if p.startswith(f"{index}/"))
    calls = [{"index": int(p.split("/")[1]), "function": {"arguments": h.take(p)}} for p in places]
    return [_chat_choice(h, index, tool_calls=calls)] if calls else []


def _chat(h: Holder, event: str | None, data: dict) -> list[Event]:
    if not isinstance(data.get("choices"), list):
        return [(event, _dump(data))]
    h.base = {k: data[k] for k in ("id", "object", "created", "model") if k in data}
    ended = []
    for choice in data["choices"]:
        index, delta, reason = choice.get("index", 0), choice.get("delta") or {}, choice.get("finish_reason")
        for call in delta.get("tool_calls") or []:
            function = call.get("function") or {}
            given = function.get("arguments")
            if given is not None:
                h.call(f"{index}/{call.get('index', 0)}", given if isinstance(given, str) else _dump(given))
                function["arguments"] = ""
        if isinstance(delta.get("content"), str) or (reason is not None and str(index) in h.texts):
            delta["content"] = h.text(str(index), delta.get("content") or "", reason is not None)
        choice["delta"] = delta
        if reason is not None and any(p.startswith(f"{index}/") for p in h.calls):
            ended.append((index, reason))
            choice["finish_reason"] = None
    out = [(event, _dump(data))]
    for index, reason in ended:
        out += [*_chat_calls(h, index), _chat_choice(h, index, reason=reason)]
    return out


def _chat_rest(h: Holder) -> list[Event]:
    out = [_chat_choice(h, int(p), content=rest) for p in sorted(h.texts) if (rest := h.text(p, "", True))]
    return out + [e for index in sorted({int(p.split("/")[0]) for p in h.calls}) for e in _chat_calls(h, index)]


# The events of streamed calls, and the field of an item that holds what they carry.
RESPONSE_CALLS = {"response.function_call_arguments": "arguments", "response.custom_tool_call_input": "input"}


def _responses(h: Holder, event: str | None, data: dict) -> list[Event]:
    """Text comes in deltas and again in three later events, which have it whole and pass as they are."""
    kind = str(data.get("type", event or ""))
    place = f"{data.get('item_id', '')}/{data.get('content_index', 0)}"
    named = lambda fields: (kind, _dump({"type": kind, **fields}))
    if kind == "response.output_text.delta":
        out = h.text(place, data.get("delta") or "")
        h.base[place] = {k: v for k, v in data.items() if k not in ("type", "delta")}
        return [named({**h.base[place], "delta": out})] if out else []
    name, _, step = kind.rpartition(".")
    if name in RESPONSE_CALLS and step == "delta":
        h.call(f"{name} {data.get('item_id', '')}", data.get("delta") or "")
        return []
    before: list[Event] = []
    if name in RESPONSE_CALLS and step == "done":
        whole = h.take(f"{name} {data.get('item_id', '')}") or data.get(RESPONSE_CALLS[name]) or ""
        if whole:
            before.append((f"{name}.delta", _dump({"type": f"{name}.delta", "item_id": data.get("item_id"), "delta": whole})))
    elif kind in ("response.output_text.done", "response.content_part.done", "response.output_item.done"):
        item = str(data.get("item_id") or (data.get("item") or {}).get("id") or "")
        for p in [p for p in h.texts if p.split("/")[0] == item]:
            before += _responses_text(h, p)
    elif kind in ("response.completed", "response.incomplete", "response.failed"):
        before = _responses_rest(h)
    return [*before, (event, _dump(data))]


def _responses_text(h: Holder, place: str) -> list[Event]:
    rest, at, kind = h.text(place, "", True), h.base.pop(place, {}), "response.output_text.delta"
    return [(kind, _dump({"type": kind, **at, "delta": rest}))] if rest else []


def _responses_rest(h: Holder) -> list[Event]:
    out = [e for p in sorted(h.texts) for e in _responses_text(h, p)]
    for place in sorted(h.calls):
        name, item = place.split(" ", 1)
        out.append((f"{name}.delta", _dump({"type": f"{name}.delta", "item_id": item, "delta": h.take(place)})))
    return out


def _gemini(h: Holder, event: str | None, data: dict) -> list[Event]:
    """Parts come whole; only text is held, and goes out before anything else that a candidate says."""
    for candidate in data.get("candidates") or []:
        place, content = str(candidate.get("index", 0)), candidate.get("content") or {}
        out: list[dict] = []
        for part in content.get("parts") or []:
            if isinstance(part.get("text"), str) and part.get("thought") is not True:
                text = h.text(place, part["text"])
                if text or len(part) > 1:
                    out.append({**part, "text": text})
                continue
            if place in h.texts and (rest := h.text(place, "", True)):
                out.append({"text": rest})
            out.append(part)
        if candidate.get("finishReason") is not None and place in h.texts and (rest := h.text(place, "", True)):
            out.append({"text": rest})
        if "parts" in content:
            content["parts"] = out
    return [(event, _dump(data))]


def _gemini_rest(h: Holder) -> list[Event]:
    found = [{"index": int(p), "content": {"role": "model", "parts": [{"text": rest}]}} for p in sorted(h.texts) if (rest := h.text(p, "", True))]
    return [(None, _dump({"candidates": found}))] if found else []


ADAPTERS = {"anthropic": (_anthropic, _anthropic_rest), "chat": (_chat, _chat_rest), "responses": (_responses, _responses_rest), "gemini": (_gemini, _gemini_rest)}


class Rewriter:
    """Events of one reply in, events that may go out: push() each, flush() at the end."""

    def __init__(self, style: str, state: str | None = None, longest: int = 0):
        if style not in ADAPTERS:
            raise ValueError(f"not a wire format: {style!r}")
        self.step, self.rest = ADAPTERS[style]
        self.holder = Holder(state, longest)

    def push(self, event: str | None, data: str) -> list[Event]:
        if data.strip() == "[DONE]":
            return [*self.flush(), (event, data)]
        try:
            read = json.loads(data)
        except ValueError:
            return [(event, data)]
        return self.step(self.holder, event, read) if isinstance(read, dict) else [(event, data)]

    def flush(self) -> list[Event]:
        return self.rest(self.holder)

    def state(self) -> str:
        return self.holder.state()


OUT = "reply string, seq long, part int, event string, data string"


def _rows(reply: str, chunk: pd.DataFrame, rewriter: Rewriter) -> tuple[list[tuple], bool]:
    rows, ended = [], False
    for seq, event, data, done in zip(chunk["seq"], chunk["event"], chunk["data"], chunk["done"], strict=True):
        out = rewriter.push(event, data or "")
        if done:
            out += rewriter.flush()
            ended = True
        rows += [(reply, int(seq), k, e, d) for k, (e, d) in enumerate(out)]
    return rows, ended


def hold_events(events: DataFrame, longest: int = 0) -> DataFrame:
    """A stream of (reply, seq, style, event, data, done) -> OUT, with words and calls whole. Also for tables, where
    the events of a reply are one group."""
    columns = [c.split()[0] for c in OUT.split(", ")]
    given = events.select("reply", "seq", "style", "event", "data", "done")
    if not events.isStreaming:

        def whole(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
            chunk = batch.sort_values("seq")
            rows, ended = _rows(key[0], chunk, rewriter := Rewriter(chunk["style"].iloc[0], longest=longest))
            if not ended:
                rows += [(key[0], int(chunk["seq"].iloc[-1]), 1000 + k, e, d) for k, (e, d) in enumerate(rewriter.flush())]
            return pd.DataFrame(rows, columns=columns)

        return given.groupBy("reply").applyInPandas(whole, OUT)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(list(batches)).sort_values("seq")
        rewriter = Rewriter(chunk["style"].iloc[0], state.get[0] if state.exists else None, longest)
        rows, ended = _rows(key[0], chunk, rewriter)
        if ended:
            state.remove()
        else:
            state.update((rewriter.state(),))
        yield pd.DataFrame(rows, columns=columns)

    return given.groupBy("reply").applyInPandasWithState(step, OUT, "held string", "append", GroupStateTimeout.NoTimeout)


def swapped_events(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """Held events with stand-ins swapped back, by a join of their tokens; for a table or one micro-batch."""
    from quillon.operators.documents import json_text

    keys = ("reply", "seq", "part")
    once = pairs.select("stand_in", json_text(F.col("value")).alias("value"))
    twice = once.select("stand_in", json_text(F.col("value")).alias("value"))  # calls are JSON within a string
    is_call = F.col("data").rlike(r'"(?:partial_json|arguments)":|_call_(?:arguments|input)\.delta"')
    texts, calls = held.where(~is_call), held.where(is_call)
    swapped = standins.swapped_back(texts, once, "data", keys).unionByName(standins.swapped_back(calls, twice, "data", keys))
    return held.drop("data").join(swapped, list(keys))


def thinking_of_event(style: Column, data: Column) -> Column:
    """The thinking that one stream event carries; empty for most, which are not parsed."""
    at = lambda path: F.get_json_object(data, path)
    parts = F.from_json(at("$.candidates[0].content.parts"), "array<struct<text:string,thought:boolean>>")
    thoughts = F.array_join(F.transform(F.filter(parts, lambda p: p["thought"]), lambda p: p["text"]), "")
    found = (
        F.when(style == "anthropic", F.when(at("$.delta.type") == "thinking_delta", at("$.delta.thinking")))
        .when(style == "chat", F.coalesce(at("$.choices[0].delta.reasoning_content"), at("$.choices[0].delta.reasoning")))
        .when(style == "responses", F.when(at("$.type").rlike(r"^response\.reasoning(?:_summary)?_text\.delta$"), at("$.delta"))).when(style == "gemini", thoughts)
    )
    worth = F.contains(data, F.lit("thinking")) | F.contains(data, F.lit("reasoning")) | F.contains(data, F.lit('"thought"'))
    return F.when(worth, F.coalesce(found, F.lit(""))).otherwise("")


def usage_of_event(style: Column, data: Column) -> Column:
    """The usage that a stream event names, as measures.usage_of gives it; null for events that name none."""
    from quillon.operators.measures import usage_of

    inner = F.coalesce(F.get_json_object(data, "$.message"), F.get_json_object(data, "$.response"), data)
    return F.when(F.contains(data, F.lit('"usage')), usage_of(inner, style))
