"""Schema and content of each record, held against its file's format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import CHATS
from ..functions.text import bounded, is_blank, let, strip
from .formats import UNUSABLE
from .shared import exploded, issue

SPECIAL_TOKENS = ("</s>", "<s>", "<|endoftext|>", "<|im_end|>", "<|im_start|>", "[/INST]", "[INST]")
#: The order in which a field is searched; its first find is the one reported.
_SEARCHED = [SPECIAL_TOKENS[i] for i in (2, 4, 3, 1, 0, 6, 5)]
_NONE = "array<struct<severity:string,code:string,message:string,sample:string>>"


def _field(f: Column, sample: Column, least: int) -> Column:
    return let(strip(f["value"]), lambda said: _of(f["name"], f["value"], said, sample, least))


def _of(name: Column, value: Column, said: Column, sample: Column, least: int) -> Column:
    say = lambda s: F.concat(name, F.lit(s))
    token = F.get(F.filter(F.array(*map(F.lit, _SEARCHED)), lambda t: F.contains(value, t)), F.lit(0))
    return F.array_compact(F.array(
        F.when(is_blank(value), issue("WARNING", "empty_text", say(" is empty or whitespace-only"), sample)).when(F.char_length(said) < least, issue("WARNING", "trivial_text", say(f" is under {least} characters"), sample)),
        F.when(F.lower(said) == F.lower(name), issue("WARNING", "fieldname_as_value", say(" is identical to the field name"), sample)),
        F.when(token.isNotNull(), issue("WARNING", "special_token", F.concat(name, F.lit(" contains special token "), token), sample)),
        F.when(F.contains(value, F.lit("\x00")), issue("CRITICAL", "null_byte_in_text", say(" contains NULL byte"), sample)),
    ))


def issues(records: DataFrame, formats: DataFrame, least: int = 3) -> DataFrame:
    """Issues of the records of usable files. formats: file and format; one small row a file."""
    fmt, facts, sample = F.col("format"), F.col("facts"), bounded(F.col("sample"), 800)
    bad = lambda cond, code, message: F.when(cond, issue("CRITICAL", code, message, sample))
    is_chat, no_messages = fmt.isin(*CHATS), F.size("messages") == 0
    pref, labelled = fmt == "preference_pair", fmt == "classification"
    roles = F.transform("messages", lambda m, i: F.when(is_chat & (m["role"] == ""), issue("CRITICAL", "missing_role", F.concat(F.lit("messages["), i.cast("string"), F.lit("] missing role/speaker")), bounded(m["sample"], 800))))
    shape = F.array(
        bad(is_chat & no_messages, "missing_messages", "a chat record has no messages"),
        bad(pref & facts["prompt_missing"], "missing_prompt", "a preference pair has no prompt"),
        *(x for side in ("chosen", "rejected") for x in (bad(pref & (facts[side] == "missing"), f"missing_{side}", f"a preference pair has no {side}"), bad(pref & (facts[side] == "bad"), f"bad_{side}_type", f"{side} has an unsupported type"))),
        bad((fmt == "prompt_completion") & ~facts["pair"], "missing_prompt_completion", "no prompt with its completion"),
        bad((labelled & facts["text_missing"]) | ((fmt == "raw_text") & ~facts["text_key"]), "missing_text", "the record has no text"),
        bad(labelled & facts["label_missing"], "missing_label", "the record has no label"),
    )
    content = F.flatten(F.transform("fields", lambda f: _field(f, sample, least)))
    none = F.array().cast(_NONE)
    found = (
        F.when(F.col("kind") == "json_error", F.array(issue("CRITICAL", "invalid_json", F.col("error"), sample)))
        .when(F.col("kind") == "empty_line", F.array(issue("CRITICAL", "empty_line", "Empty line in JSONL dataset")))
        .when(~facts["is_object"], F.when(fmt != "raw_text", F.array(issue("CRITICAL", "record_not_object", "the record is no object", sample))).otherwise(none))
        .when(fmt == "unknown", none)
        .otherwise(F.concat(shape, roles, content))
    )
    usable = formats.where(~F.col("format").isin(*UNUSABLE)).select("file", "format")
    return exploded(records.join(F.broadcast(usable), "file"), found)
