"""Tables at hand as records, without a Python step: the same columns as files give, by expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records
from ..functions.text import strip


def _text(payload: dict[str, Column], key: str) -> Column:
    return F.coalesce(payload[key], F.lit("")) if key in payload else F.lit(None).cast("string")


def table_records(table: DataFrame, payload: dict[str, Column], idx: Column, file: Column | str = "table", file_ord: Column | int = 0, messages: Column | None = None) -> DataFrame:
    """Rows as records whose keys are payload's, with string values that may be null; messages, if there are any, is an
    array of structs with role and content. idx numbers the rows within file."""
    known = {k: v.cast("string") for k, v in payload.items()}
    keys = dict.fromkeys([*known, *(["messages"] if messages is not None else [])])
    shape = records.detect_format(dict.fromkeys(known)) if messages is None else None
    said = F.transform(messages, _message) if messages is not None else F.array().cast(f"array<{records.MESSAGE}>")
    fields = [F.array(F.struct(F.lit(k).alias("name"), _text(known, k).alias("value"))) for k in records.TEXT_KEYS if k in known]
    if messages is not None:
        joined = F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
        each = F.transform(said, lambda m, i: F.struct(F.concat(F.lit("messages["), i.cast("string"), F.lit("].content")).alias("name"), m["content"].alias("value")))
        fields = [each, F.when(F.size(said) > 0, F.array(F.struct(F.lit("messages_joined").alias("name"), joined.alias("value")))).otherwise(F.array()), *fields]
        roles = F.array_distinct(F.transform(said, lambda m: m["role"]))
        known_roles = F.forall(roles, lambda r: r.isin(*records.CHAT_ROLES))
        shape = F.when(F.size(said) == 0, records.detect_format(dict.fromkeys(known))).when(known_roles, "openai_chat").otherwise("anthropic_chat")
    else:
        shape = F.lit(shape)
    own = {k: v for k, v in known.items()} | ({"messages": messages} if messages is not None else {})
    canonical = F.to_json(F.struct(*(own[k].alias(k) for k in sorted(keys))), {"ignoreNullFields": "false"})
    first_prompt = next((k for k in ("prompt", "input", "question") if k in known), None)
    pair = next((p for p in records.PAIRS if set(p) <= set(known)), None)
    state = lambda k: F.when(known[k].isNull(), "missing").otherwise("fine") if k in known else F.lit("missing")
    facts = F.struct(
        F.lit(True).alias("is_object"), F.lit("text" in known).alias("text_key"), (known[first_prompt].isNull() if first_prompt else F.lit(True)).alias("prompt_missing"),
        state("chosen").alias("chosen"), state("rejected").alias("rejected"), F.lit(pair is not None).alias("pair"),
        (known["text"].isNull() if "text" in known else F.lit(True)).alias("text_missing"), (known["label"].isNull() if "label" in known else F.lit(True)).alias("label_missing"),
    )
    both = F.struct(F.lit(pair[0]).alias("input_name"), _text(known, pair[0]).alias("input"), F.lit(pair[1]).alias("output_name"), _text(known, pair[1]).alias("output")) if pair else F.lit(None).cast("struct<input_name:string,input:string,output_name:string,output:string>")
    null = F.lit(None)
    return table.select(
        (F.lit(file) if isinstance(file, str) else file).alias("file"), (F.lit(file_ord) if isinstance(file_ord, int) else file_ord).cast("int").alias("file_ord"), idx.cast("long").alias("idx"), null.cast("long").alias("line"),
        F.lit("record").alias("kind"), shape.alias("fmt"), (known["split"] if "split" in known else null.cast("string")).alias("own_split"), canonical.alias("canonical"), canonical.alias("sample"), null.cast("string").alias("error"),
        (F.flatten(F.array(*fields)) if fields else F.array().cast("array<struct<name:string,value:string>>")).alias("fields"), said.alias("messages"), facts.alias("facts"),
        _text(known, "label").alias("label"), (_text(known, first_prompt) if first_prompt else F.lit("")).alias("prompt"), _text(known, "chosen").alias("chosen"), _text(known, "rejected").alias("rejected"), both.alias("pair"),
    )


def _message(m: Column) -> Column:
    role = F.lower(strip(F.coalesce(m["role"].cast("string"), F.lit(""))))
    for alias, name in records._ALIASES.items():
        role = F.when(role == alias, name).otherwise(role)
    return F.struct(
        role.alias("role"), F.coalesce(m["content"].cast("string"), F.lit("")).alias("content"), F.lit("none").alias("calls"), F.lit(0).alias("bad_calls"),
        F.lit(False).alias("excused"), F.lit(False).alias("answers"), F.to_json(m).alias("sample"),
    )
