"""What the checks need of a record, drawn from its payload once."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, let

TEXT_KEYS = tuple("prompt completion input output chosen rejected text label instruction response question answer".split())
PRIMARY_KEYS = ("prompt", "input", "instruction", "question", "text", "messages_joined")
PAIRS = (("prompt", "completion"), ("input", "output"), ("instruction", "response"), ("question", "answer"))
CHAT_ROLES = frozenset(("assistant", "system", "tool", "user"))
_ALIASES = {"ai": "assistant", "bot": "assistant", "function": "tool", "human": "user"}
CHATS = ("openai_chat", "anthropic_chat")

MESSAGE = "struct<role:string,content:string,calls:string,bad_calls:int,excused:boolean,answers:boolean,sample:string>"
#: kind: record, empty_line, json_error or file_error. A record with an error can be checked but not compared. facts: what schema validation asks of the payload.
RECORD = (
    "file string, file_ord int, idx bigint, line bigint, kind string, fmt string, own_split string, canonical string, sample string, error string, "
    f"fields array<struct<name:string,value:string>>, messages array<{MESSAGE}>, "
    "facts struct<is_object:boolean,text_key:boolean,prompt_missing:boolean,chosen:string,rejected:string,pair:boolean,text_missing:boolean,label_missing:boolean>, "
    "label string, prompt string, chosen string, rejected string, pair struct<input_name:string,input:string,output_name:string,output:string>"
)
#: The place of error among the columns from kind on.
ERROR = 5


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def stringify(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return str(value) if isinstance(value, (bool, int, float)) else canonical_json(value)


def extract_messages(record: object) -> list[dict]:
    if not isinstance(record, dict):
        return []
    for key in ("messages", "conversation"):
        if isinstance(record.get(key), list):
            return [m for m in record[key] if isinstance(m, dict)]
    if "human" in record and "assistant" in record:
        return [{"role": r, "content": record[k]} for r, k in (("user", "human"), ("assistant", "assistant"))]
    return []


def message_role(message: dict) -> str:
    said = next((v for k in ("role", "speaker", "from", "type") if (v := message.get(k))), None)
    role = stringify(said).lower().strip()
    return _ALIASES.get(role, role)


def message_content(message: dict) -> str:
    return next((stringify(message[k]) for k in ("content", "text", "value") if k in message), "")


def text_fields(record: object) -> list[tuple[str, str]]:
    """Names and texts in order."""
    if isinstance(record, str):
        return [("text", record)]
    if not isinstance(record, dict):
        return []
    said = [(message_role(m), message_content(m)) for m in extract_messages(record)]
    out = [(f"messages[{i}].content", c) for i, (_, c) in enumerate(said)]
    if said:
        out.append(("messages_joined", "\n".join(f"{r}: {c}" for r, c in said)))
    out += [(k, stringify(record[k])) for k in TEXT_KEYS if k in record]
    return out or [(k, v) for k, v in record.items() if isinstance(v, str)]


def detect_format(record: object, raw_text: bool = False) -> str:
    """The record's shape; the first rule that holds."""
    if isinstance(record, str):
        return "raw_text"
    if not isinstance(record, dict):
        return "unknown"
    keys = record.keys()
    if keys >= {"human", "assistant"} and not keys & {"messages", "conversation"}:
        return "anthropic_chat"
    if messages := extract_messages(record):
        return "openai_chat" if {message_role(m) for m in messages} <= CHAT_ROLES else "anthropic_chat"
    if keys >= {"chosen", "rejected"} and keys & {"prompt", "input", "question"}:
        return "preference_pair"
    if any(keys >= set(p) for p in PAIRS):
        return "prompt_completion"
    if keys >= {"text", "label"}:
        return "classification"
    if raw_text or record.get("__raw_text__") or (len(keys) == 1 and keys & {"content", "document", "text"}):
        return "raw_text"
    return "unknown"


def get_path(record: object, path: str) -> object:
    """The value at a dotted path; None if there is none."""
    for part in path.split("."):
        if not isinstance(record, dict) or part not in record:
            return None
        record = record[part]
    return record


def _message(m: dict) -> tuple:
    calls = m.get("tool_calls")
    kind = "none" if calls is None else "list" if isinstance(calls, list) else "other"
    bad = sum(not (isinstance(c, dict) and c.get("id") and c.get("type")) for c in calls) if kind == "list" else 0
    return (message_role(m), message_content(m), kind, bad, bool(calls or m.get("function_call")), bool(m.get("tool_call_id") or m.get("name")), canonical_json(m))


def _state(record: dict, key: str) -> str:
    value = record.get(key)
    return "missing" if value is None else "fine" if isinstance(value, (str, dict, list)) else "bad"


def describe(record: object, raw_text: bool = False) -> tuple:
    """The columns of RECORD from kind on, for a payload that could be read."""
    r = record if isinstance(record, dict) else {}
    prompt = next((r[k] for k in ("prompt", "input", "question") if k in r), None)
    pair = next(((a, stringify(r[a]), b, stringify(r[b])) for a, b in PAIRS if a in r and b in r), None)
    own = None if r.get("split") is None else str(r["split"])
    shown = canonical_json(record | {"__raw_text__": True} if raw_text else record)
    facts = (isinstance(record, dict), "text" in r, prompt is None, _state(r, "chosen"), _state(r, "rejected"), pair is not None, r.get("text") is None, r.get("label") is None)
    messages = [_message(m) for m in extract_messages(record)]
    texts = [stringify(r[k]) if k in r else None for k in ("label", "chosen", "rejected")]
    sample = record if isinstance(record, str) else shown
    return ("record", detect_format(record, raw_text), own, shown, sample, None, text_fields(record), messages, facts, texts[0], stringify(prompt), *texts[1:], pair)


def unreadable(kind: str, error: str | None, raw: str | None) -> tuple:
    """The same for a blank line or one that is no JSON."""
    record = {"__empty_line__": True} if kind == "empty_line" else {"__json_error__": error, "__raw__": raw}
    facts = (True, False, True, "missing", "missing", False, True, True)
    return (kind, "invalid", None, canonical_json(record), raw, error, text_fields(record), [], facts, None, "", None, None, None)


def describe_line(raw: str) -> tuple:
    if not raw.strip():
        return unreadable("empty_line", None, raw)
    try:
        return describe(json.loads(raw))
    except json.JSONDecodeError as error:
        return unreadable("json_error", str(error), raw)


def primary_text(fields: Column) -> Column:
    """The first of the leading fields that isn't blank; else all fields' texts."""
    names = F.array(*map(F.lit, PRIMARY_KEYS))

    def first(f: Column) -> Column:
        leading = F.filter(f, lambda x: x["name"].isin(*PRIMARY_KEYS) & ~is_blank(x["value"]))
        found = F.get(F.sort_array(F.transform(leading, lambda x: F.struct(F.array_position(names, x["name"]).alias("at"), x["value"].alias("value")))), F.lit(0))["value"]
        return F.coalesce(found, F.array_join(F.transform(f, lambda x: x["value"]), "\n"))

    return let(fields, first)


def bundle(fields: Column, canonical: Column) -> Column:
    """All fields as name: text lines; the whole record if it has none."""
    lines = F.transform(fields, lambda f: F.concat(f["name"], F.lit(": "), f["value"]))
    return F.when(F.size(fields) > 0, F.array_join(lines, "\n")).otherwise(canonical)


def rows_of(records: Iterator[tuple]) -> dict[str, list]:
    """Tuples in the order of RECORD as columns, for Arrow."""
    names = [c.strip().split(" ")[0] for c in _top_level(RECORD)]
    columns = list(zip(*records)) or [[] for _ in names]
    return dict(zip(names, map(list, columns)))


def _top_level(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]
