"""Single rules: shapes, splits, lines, expressions, sets, severities."""

import io
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaykit.config import Config, load_config
from assaykit.functions import text as fn
from assaykit.functions.patterns import PATTERNS, _PYTHON, matches, redact
from assaykit.functions.records import canonical_json, describe_line, detect_format, get_path, message_role
from assaykit.operators import encoding
from assaykit.operators.lengths import _CUTS, bars, tokenizer
from assaykit.plans.runner import Run
from assaykit.severity import exit_code, severity_rank, worst
from assaykit.sources.files import UnsupportedFile, json_rows, list_files, read_records, too_large


@pytest.mark.parametrize(
    "record, want",
    [
        ({"messages": [{"role": "human", "content": "a"}, {"from": "bot", "value": "b"}]}, "openai_chat"),
        ({"messages": [{"role": "developer", "content": "a"}]}, "anthropic_chat"),
        ({"messages": []}, "unknown"),
        ({"human": "a", "assistant": "b"}, "anthropic_chat"),
        ({"chosen": 1, "rejected": None, "question": ""}, "preference_pair"),
        ({"instruction": "", "response": None}, "prompt_completion"),
        ({"text": None, "label": None}, "classification"),
        ({"document": "hello world"}, "raw_text"),
        ("plain", "raw_text"),
        ({"foo": 1}, "unknown"),
        (3, "unknown"),
    ],
)
def test_shapes(record, want):
    assert detect_format(record) == want


def test_json_fidelity():
    assert [canonical_json(json.loads(x)) for x in ("1.0", "1.00", "1", "1e2")] == ["1.0", "1.0", "1", "100.0"]
    assert describe_line('{"a":NaN,"a":Infinity}')[0] == "record"
    assert describe_line("﻿{}")[0] == "json_error" and describe_line("  ")[0] == "empty_line"
    assert get_path({"a": {"b": 2}}, "a.b") == 2 and get_path({"a": 1}, "a.b") is None
    assert message_role({"role": 0, "speaker": " AI "}) == "assistant"


def test_splits(spark):
    names = ["train-0001.jsonl", "validation.csv", "x/valid_x.json", "devset.txt", "mytrain.jsonl", "training.jsonl", "test"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select(fn.split_of_path(F.col("p"))).collect()
    assert [r[0] for r in got] == ["train", "val", "val", "devset", "mytrain", "training", "test"]


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"a":1}\r{"a":2}\r\n{"a":3}\n')
    (tmp_path / "b.jsonl").write_bytes(b'\xef\xbb\xbf{"text":"x"}\n\nnot json\n')
    (tmp_path / "c.txt").write_text("one\n\ntwo\n")
    rows = read_records(spark, [str(tmp_path / n) for n in ("a.jsonl", "b.jsonl", "c.txt")]).orderBy("file_ord", "idx").collect()
    assert [(r.file_ord, r.idx, r.line, r.kind) for r in rows[:3]] == [(0, 0, 1, "record"), (0, 1, 2, "record"), (0, 2, 3, "record")]
    assert [r.kind for r in rows[3:6]] == ["json_error", "empty_line", "json_error"]
    assert [(r.fmt, r.fields[0].value) for r in rows[6:]] == [("raw_text", "one"), ("raw_text", ""), ("raw_text", "two")]


def test_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "long.jsonl").write_text("".join(json.dumps({"text": f"{i} " + "x" * 50}) + "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_records(spark, [str(tmp_path / "long.jsonl")]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3000 and all(r.fields[0].value.startswith(f"{r.idx} ") for r in rows)


def test_other_kinds(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.ipc as ipc
    import pyarrow.parquet as pq

    table = pa.table({"text": ["a", None, "c"], "label": ["x", "y", None]})
    pq.write_table(table, tmp_path / "p.parquet")
    with ipc.new_file(str(tmp_path / "q.arrow"), table.schema) as w:
        w.write_table(table, max_chunksize=2)
    (tmp_path / "r.json").write_text(json.dumps({"data": [{"text": "a", "label": "x"}, 5]}))
    (tmp_path / "s.tsv").write_text('text\tlabel\n"a\tb"\tx\nc\n')
    files = list_files(str(tmp_path))
    rows = read_records(spark, files).orderBy("file_ord", "idx").collect()
    got = {}
    for r in rows:
        got.setdefault(r.file.rpartition("/")[2], []).append((r.idx, r.line, r.fmt, r.label))
    assert got["p.parquet"] == got["q.arrow"] == [(0, None, "classification", "x"), (1, None, "classification", "y"), (2, None, "classification", "")]
    assert got["r.json"] == [(0, None, "classification", "x"), (1, None, "unknown", None)]
    assert got["s.tsv"] == [(0, 2, "classification", "x"), (1, 3, "classification", "")]
    with pytest.raises(UnsupportedFile):
        read_records(spark, ["x.bin"])
    assert "not found" in too_large(str(tmp_path / "none"), 1) and too_large(files[0], 1e-12) and too_large(files[0], 1) is None


def test_unreadable_and_blank(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    (tmp_path / "ragged.csv").write_text("text,label\na,b,c\nd\n")
    (tmp_path / "blank.jsonl").write_text('{"prompt":"p","completion":"c"}\n\n\n')
    run = Run(spark, list_files(str(tmp_path)))
    exact = {f["file"].rpartition("/")[2]: f for f in run.exact_duplicates()["files"]}
    assert exact["bad.parquet"]["severity"] == exact["ragged.csv"]["severity"] == "CRITICAL" and "more cell(s) than the header" in exact["ragged.csv"]["finding"] and exact["blank.jsonl"]["duplicate_count"] == 0
    near = {f["file"].rpartition("/")[2]: f for f in run.near_duplicates()["files"]}
    assert near["blank.jsonl"]["cluster_count"] == 1
    assert {f["file"].rpartition("/")[2]: f["format"] for f in run.format_detection()["files"]} == {"bad.parquet": "unreadable", "ragged.csv": "classification", "blank.jsonl": "invalid"}
    labels = {f["file"].rpartition("/")[2]: f for f in run.classification()["files"]}
    assert labels["ragged.csv"]["label_counts"] == {"b": 1, "": 1} and labels["ragged.csv"]["record_count_checked"] == 2


def test_a_page_that_only_a_scan_shows_to_be_bad(spark, tmp_path):
    """A Parquet file whose footer is whole and whose data is not: it alone is lost."""
    for name in ("fine", "torn"):
        pq.write_table(pa.table({"text": [f"{name} {i} " + "x" * 50 for i in range(500)]}), tmp_path / f"{name}.parquet", compression="none", use_dictionary=False)
    raw = bytearray((tmp_path / "torn.parquet").read_bytes())
    raw[4:200] = b"\xff" * 196
    (tmp_path / "torn.parquet").write_bytes(bytes(raw))
    run = Run(spark, list_files(str(tmp_path)) + [str(tmp_path / "gone.jsonl")])
    got = {f["file"].rpartition("/")[2]: f for f in run.exact_duplicates()["files"]}
    assert got["fine.parquet"]["record_count"] == 500 and got["torn.parquet"]["severity"] == got["gone.jsonl"]["severity"] == "CRITICAL"
    assert {f["file"].rpartition("/")[2]: f["severity"] for f in run.encoding_sanity()["files"]}["gone.jsonl"] == "CRITICAL"


def test_many_small_files_are_one_scan(spark, tmp_path):
    for i in range(300):
        pq.write_table(pa.table({"text": [f"file {i}", f"row {i}"]} if i % 2 else {"prompt": [f"p{i}"], "completion": ["c"]}), tmp_path / f"f{i:03}.parquet")
    files = list_files(str(tmp_path))
    read = read_records(spark, files)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 4
    rows = read.select("file", "file_ord", "idx", "fmt").collect()
    assert len(rows) == 450 and {(files[r.file_ord], r.idx) for r in rows} == {(r.file, r.idx) for r in rows} and {r.fmt for r in rows} == {"raw_text", "prompt_completion"}


def test_uris(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.jsonl").write_text('{"text": "x"}\n')
    (tmp_path / "in" / "c.csv").write_text("text,label\nx,y\n")
    pq.write_table(pa.table({"text": ["x"]}), tmp_path / "in" / "d.parquet")
    files = list_files(f"file://{tmp_path}/in")
    assert len(files) == 3 and all(f.startswith("file:///") for f in files)
    assert read_records(spark, [f for f in files if " " not in f]).where("kind = 'record'").count() == 2
    assert too_large(f"file://{tmp_path}/none", 1)


def test_capped_chat_issues(spark, tmp_path):
    talks = [[{"role": "user", "content": "x"}]] * 5 + [[{"role": "user", "content": "x"}, {"role": "assistant", "content": " "}]]
    talks += [[{"role": "tool", "content": "x"}, {"role": "assistant", "content": "", "tool_calls": [{"id": 1}, {"id": 1, "type": "f"}]}]]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"messages": t}) + "\n" for t in talks))
    f = Run(spark, [str(tmp_path / "a.jsonl")]).chat_format()["files"][0]
    assert f["severity"] == "WARNING" and f["uncapped_severity"] == "CRITICAL"
    assert f["issue_counts"] == {"does_not_end_assistant": 5, "empty_assistant_turn": 1, "bad_tool_response": 1, "bad_tool_call_object": 1}
    assert [i["code"] for i in f["issues"]] == ["does_not_end_assistant"] * 5 + ["bad_tool_response", "bad_tool_call_object"]


def test_conflicts_and_leaks(spark, tmp_path):
    rows = [("P", "A", "B"), ("p ", "B", "A"), ("P", "a", "b"), ("P", "B", "A")]
    (tmp_path / "pref.jsonl").write_text("".join(json.dumps(dict(zip(("prompt", "chosen", "rejected"), r))) + "\n" for r in rows))
    assert Run(spark, [str(tmp_path / "pref.jsonl")]).preference_pairs()["files"][0]["issue_counts"] == {"conflicting_prompt_pairs": 2}
    for name, n in (("train", 2), ("val", 2), ("test", 1)):
        (tmp_path / f"{name}.jsonl").write_text('{"text":"same row"}\n' * n)
    r = Run(spark, [str(tmp_path / f"{n}.jsonl") for n in ("train", "val", "test")]).split_leakage()
    assert r["exact_leakage_count"] == 3 and r["exact_examples"][0]["loc_a"]["index"] == 1


def test_patterns(spark):
    texts = ["SSN 123-45-6789, ip 10.0.0.1, on 2024-01-31 order 12345678", "4111 1111 1111 1111 or 4111 1111 1111 1112", "fe80:0:0:1::", "2001:db8:0:1:1:1:1:1", "sk-" + "a" * 20, "12 Old Mill Rd. and é555-1234", "+1 (415) 555-0100", "a.b@c.de x@y"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(F.size(matches(F.col("t"), p)).alias(p) for p in PATTERNS)).collect()
    for r in got:
        for p in PATTERNS:
            want = [m[0] for m in _PYTHON[p].finditer(r.t)]
            if p == "phone":
                want = [m for m in want if 7 <= sum(c.isdigit() for c in m) <= 15]
            if p == "credit_card_candidate":
                from assaykit.functions.patterns import luhn

                want = [m for m in want if luhn(m)]
            assert r[p] == len(want), (p, r.t)
    assert got[0].phone == 3 and redact(texts[1]).startswith("[REDACTED_CREDIT_CARD] or ")


@settings(deadline=None, max_examples=15)
@given(st.lists(st.text(alphabet="ab \t\x1c ", max_size=12), min_size=1, max_size=8))
def test_space(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.normalize_space(F.col("t")).alias("n"), fn.is_blank(F.col("t")).alias("b")).collect()
    assert all(r.n == " ".join(r.t.split()) and r.b == (not r.t.strip()) for r in rows)


def test_sets(spark):
    df = spark.createDataFrame([("a b c d e f",), ("a b",), ("",)], "t string").withColumn("w", fn.words(F.col("t")))
    rows = df.select(fn.shingles(F.col("w")).alias("s"), F.size(fn.shingle_hashes(F.col("w"))).alias("n")).collect()
    assert [r.s for r in rows] == [["a b c d e", "b c d e f"], ["a", "b"], []] and [r.n for r in rows] == [2, 2, 0]
    pairs = spark.sql("SELECT array('a','b') x, array('b','c') y UNION ALL SELECT array(), array() UNION ALL SELECT array(), array('a')")
    assert sorted(r[0] for r in pairs.select(fn.jaccard(F.col("x"), F.col("y"))).collect()) == [0.0, 1 / 3, 1.0]


def whole(data):
    """Issues and counts of a file, from all its bytes at once."""
    counts = {k: n for k, n in (("null_bytes", data.count(b"\0")), ("bom_at_start", int(data.startswith(b"\xef\xbb\xbf"))), ("stray_bom", data.count(b"\xef\xbb\xbf") - data.startswith(b"\xef\xbb\xbf"))) if n}
    try:
        data.decode("utf-8")
        wrong = None
    except UnicodeDecodeError as error:
        wrong = str(error), data[max(0, error.start - 40) : error.end + 40].hex()
    text = data.decode("utf-8", "replace")
    samples = {p: redact(text[max(0, text.find(p) - 80) : text.find(p) + 120]) for p in encoding.MOJIBAKE if p in text}
    return counts | {f"mojibake:{p}": text.count(p) for p in samples}, wrong, samples


def in_blocks(data, length, around):
    held = {}
    for start in range(0, max(1, len(data)), length):
        low, end = max(0, start - around), min(len(data), start + length)
        for key, at, n, sample in encoding.scan_block(data[low : end + around], low, start - low, end - low):
            first = held.setdefault(key, {"key": key, "n": 0, "at": at, "sample": sample})
            first["n"] += n
            if at < first["at"]:
                first |= {"at": at, "sample": sample}
    return encoding.told(list(held.values()))


@pytest.mark.parametrize("length", [7, 64, 1000, 1 << 20])
def test_encoding_by_blocks(length):
    """The same whatever the blocks, which cut characters and marks."""
    rng = random.Random(length)
    parts = [b"abc ", "\u00e9\u00fc".encode(), "\U0001f600".encode(), b"\xef\xbb\xbf", b"\0", b"\xff", b"\xe2\x82", *(p.encode() for p in encoding.MOJIBAKE), b"plain words and more of them "]
    for n in range(60):
        odd = n % 3 == 0
        data = b"".join(rng.choice(parts if odd else [x for x in parts if x not in (b"\xff", b"\xe2\x82")]) for _ in range(rng.randrange(0, 120)))
        counts, wrong, samples = whole(data)
        issues, got = in_blocks(data, length, encoding.AROUND)
        assert got == counts
        assert [(i["message"], i["sample_bytes_hex"]) for i in issues if i["pattern"] == "invalid_utf8"] == ([wrong] if wrong else [])
        if not wrong:
            assert {i["pattern"]: i["samples"][0] for i in issues if i["pattern"] in samples} == samples


def test_encoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfab\0\xff" + "\u00e2\u20ac\u2122".encode() + b"\xef\xbb\xbf")
    (tmp_path / "b.txt").write_bytes(b"")
    a, b = Run(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).encoding_sanity()["files"]
    assert [i["pattern"] for i in a["issues"]][:4] == ["NULL byte", "BOM", "stray BOM", "invalid_utf8"] and a["counts"]["mojibake:\u00e2\u20ac\u2122"] == 1 and a["bytes"] == 18
    assert b["severity"] == "OK" and b["bytes"] == 0 and len(encoding.MOJIBAKE) == 10


def test_small_things(tmp_path):
    assert bars([(5, 5, 3)]) == ["      5-5       | ### 3"] and bars([(1, 2, 2)])[0].endswith("# 2")
    assert worst(["OK", "WARNING"]) == "WARNING" and worst([]) == "OK" and severity_rank("nothing") == 1
    assert exit_code({"files": [{"critical": True}]}) == 2 and exit_code({"severity": "WARNING"}) == 0
    (tmp_path / "c.json").write_text('{"sample_size": 7, "unknown": 1}')
    assert load_config(str(tmp_path / "c.json")).sample_size == 7 and load_config(None, tmp_path, tmp_path) == Config()
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.json"))
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "d.json"))


def test_tokens_by_a_file_of_ranks(spark):
    """Against the encoding itself, cut as it cuts; an encoding that isn't known raises."""
    import base64

    import tiktoken

    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    texts = ["Hello there, it's 12345 o'clock\n\n  now", "", "\u00fcber  \t x", "a" * 500]
    for name in ("gpt2", "cl100k_base"):
        own = tiktoken.Encoding("own", pat_str=_CUTS[name], mergeable_ranks=merges, special_tokens={})
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenizer(ranks, name)(F.col("t")).alias("n")).collect()
        assert {r.t: r.n for r in got} == {t: len(own.encode_ordinary(t)) for t in texts}
    with pytest.raises(ValueError):
        tokenizer(ranks, "none")


def whole_json(text):
    data = json.loads(text)
    return data if isinstance(data, list) else data["data"] if isinstance(data, dict) and isinstance(data.get("data"), list) else [data if isinstance(data, dict) else {"__raw_json__": data}]


@settings(deadline=None, max_examples=400)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=12), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["data", "a", "]"]), x, max_size=3), max_leaves=12), st.integers(1, 9), st.sampled_from([None, 1]), st.sampled_from(["", " ", "x", "]", ",", "]]"]))
def test_json_documents_in_pieces(value, chunk, indent, tail):
    """The same records as of the document at once, or an error as well, whatever the pieces it is read in."""
    for text in (json.dumps(value, indent=indent) + tail, json.dumps(value)[:-1], "\n[" + json.dumps(value) + "]\n"):
        try:
            want = whole_json(text)
        except json.JSONDecodeError:
            with pytest.raises(json.JSONDecodeError):
                list(json_rows(io.StringIO(text), chunk))
        else:
            assert list(json_rows(io.StringIO(text), chunk)) == want
