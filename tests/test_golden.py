"""A folder with planted faults of every kind, through all checks."""

import hashlib
import json
import math
import statistics

import pytest

from assaykit.cli import main
from assaykit.config import Config
from assaykit.plans.report import load_results, write_report
from assaykit.plans.runner import Run, run_all

SYSTEM = {"role": "system", "content": "You answer questions about parcels."}
ASKED = {"role": "user", "content": "Write to jane.roe@example.org or send it to 77 Harbour Lane, please; where is my parcel now?"}
TOLD = {"role": "assistant", "content": "It left the depot this morning."}


def user(text):
    return {"role": "user", "content": text}


def answer(text, **more):
    return {"role": "assistant", "content": text, **more}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    leak = [SYSTEM, ASKED, TOLD]
    train = [leak, leak, [SYSTEM, user("Can a parcel be sent back?"), answer("Yes, within two weeks.")]]
    train += [[user("Name a colour."), answer("Gladly."), answer("Ochre is one.")], [user("Anyone there?"), answer("")]]
    train += [[user("What does <|endoftext|> stand for?"), answer("It ends a text.")], [user("Is it going to rain?"), answer("", tool_calls={"name": "weather"})]]
    val = [leak, [SYSTEM, user("What does a return cost?"), answer("Returns are free of charge.")]]
    long = "Good morning to you, and welcome! " * 5
    write = lambda name, rows: (at / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    write("train.chat.jsonl", [{"messages": m} for m in train])
    write("val.chat.jsonl", [{"messages": m} for m in val])
    same = "Water boils sooner on a mountain."
    greet = "Greet me in two words."
    write("preference.jsonl", [{"prompt": p, "chosen": c, "rejected": r} for p, c, r in (("Say something about water.", same, same), (greet, long, "Hi."), (greet, "Hey there!", long))])
    write("prompt_completion.jsonl", [{"prompt": f"The Latin word for {w}", "completion": c} for w, c in (("cat", "The Latin word for cat"), ("dog", ""), ("bird", "avis"))])
    rows = ["Fine work,Positive", "I would buy it again,positive", "It broke, negative", "It is blue,neutral", "Better than the last,positive", "Arrived early,positive", "No complaints,positive"]
    (at / "classification.csv").write_text("\n".join(["text,label", *rows]) + "\n")
    return at


@pytest.fixture(scope="module")
def results(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    got, code = run_all(spark, str(folder), str(out))
    return got, code, out


def by_name(result):
    return {f["file"].rpartition("/")[2]: f for f in result["files"]}


def test_severities(results):
    got, code, _ = results
    assert code == 2
    want = {"split_leakage_openai_chat": "CRITICAL", "chat_format": "CRITICAL", "preference_pairs": "CRITICAL", "prompt_completion": "CRITICAL", "schema_validation": "WARNING", "exact_duplicates": "WARNING", "near_duplicates": "WARNING", "pii_scan": "WARNING", "classification": "WARNING", "format_detection": "OK", "encoding_sanity": "OK", "length_distribution": "OK"}
    assert {k: r["summary"]["severity"] for k, r in got.items()} == want


def test_formats(results):
    assert {k: f["format"] for k, f in by_name(results[0]["format_detection"]).items()} == {"train.chat.jsonl": "openai_chat", "val.chat.jsonl": "openai_chat", "preference.jsonl": "preference_pair", "prompt_completion.jsonl": "prompt_completion", "classification.csv": "classification"}


def test_leakage(results):
    r = results[0]["split_leakage_openai_chat"]
    assert r["split_counts"] == {"train": 7, "val": 2} and r["exact_leakage_count"] == 1 and r["near_leakage_cluster_count"] == 1
    assert r["exact_examples"][0]["loc_a"]["index"] == 1 and r["near_examples"][0]["size"] == 3
    record = json.dumps({"messages": [SYSTEM, ASKED, TOLD]}, sort_keys=True, separators=(",", ":"))
    assert r["exact_examples"][0]["hash"] == hashlib.sha256(record.encode()).hexdigest()


def test_chats(results):
    f = by_name(results[0]["chat_format"])
    assert f["train.chat.jsonl"]["issue_counts"] == {"same_role_consecutive_assistant": 1, "empty_assistant_turn": 1, "bad_tool_calls_type": 1}
    assert [(p["count"], p["excerpt"]) for p in f["train.chat.jsonl"]["system_prompt_top"]] == [(4, ""), (3, SYSTEM["content"])]


def test_preferences(results):
    f = by_name(results[0]["preference_pairs"])["preference.jsonl"]
    assert f["issue_counts"] == {"chosen_equals_rejected": 1, "conflicting_prompt_pairs": 1}
    chosen, rejected = (33 + 170 + 10) / 3, (33 + 3 + 170) / 3
    assert f["length_bias"]["ratio_vs_rejected"] == pytest.approx((chosen - rejected) / rejected)


def test_completions_and_schema(results):
    assert by_name(results[0]["prompt_completion"])["prompt_completion.jsonl"]["issue_counts"] == {"completion_copies_prompt": 1, "empty_completion": 1}
    total = {}
    for f in results[0]["schema_validation"]["files"]:
        for k, n in f["issue_counts"].items():
            total[k] = total.get(k, 0) + n
    assert total == {"empty_text": 3, "special_token": 2}


def test_duplicates_and_pii(results):
    assert by_name(results[0]["exact_duplicates"])["train.chat.jsonl"]["unique_records"] == 6
    near = by_name(results[0]["near_duplicates"])
    assert near["train.chat.jsonl"]["cluster_count"] == 1 and near["preference.jsonl"]["clusters"][0]["size"] == 2
    f = by_name(results[0]["pii_scan"])
    assert f["train.chat.jsonl"]["pattern_counts"] == {"email": 4, "street_address": 4} and f["val.chat.jsonl"]["pattern_counts"] == {"email": 2, "street_address": 2}
    assert "jane" not in json.dumps(results[0]["pii_scan"])


def test_classes_and_lengths(results, folder):
    c = by_name(results[0]["classification"])["classification.csv"]
    assert c["label_counts"] == {" negative": 1, "Positive": 1, "neutral": 1, "positive": 4} and c["majority_minority_ratio"] == 4
    f = by_name(results[0]["length_distribution"])
    lines = (folder / "classification.csv").read_text().splitlines()[1:]
    tokens = sorted(math.ceil(len("text: \nlabel: ") / 4 + (len(x) - 1) / 4) for x in lines)
    p = f["classification.csv"]["token_stats"]
    assert p["max"] == tokens[-1] and p["p50"] == statistics.median(tokens) and p["p90"] == pytest.approx(tokens[5] + 0.4 * (tokens[6] - tokens[5]))
    assert sum(int(x.split()[-1]) for x in f["classification.csv"]["token_histogram"]) == 7
    chat = f["train.chat.jsonl"]["token_stats"]
    told = sum(len(f"messages[{i}].content: {m['content']}\n") for i, m in enumerate([SYSTEM, ASKED, TOLD]))
    joined = len("messages_joined: " + "\n".join(f"{m['role']}: {m['content']}" for m in (SYSTEM, ASKED, TOLD)))
    assert chat["max"] == math.ceil((told + joined) / 4)


def test_encoding(results):
    assert [f["severity"] for f in results[0]["encoding_sanity"]["files"]] == ["OK"] * 5


def test_report(results):
    text = (results[2] / "report.md").read_text()
    assert "| split_leakage | CRITICAL | 1 exact cross-split leak(s); 1 near cross-split cluster(s) |" in text
    assert "role_alternation (1); empty_assistant_turn (1); bad_tool_calls_type (1)" in text
    again = write_report(load_results([str(results[2])]))
    assert again.split("## Header")[1] == text.split("## Header")[1]


def test_single_check(spark, folder, capsys):
    assert main(["classification", str(folder / "classification.csv"), "--sample-size", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["severity"] == "WARNING"


def test_declared_labels(spark, folder):
    run = Run(spark, [str(folder / "classification.csv")], Config(declared_labels=("positive", "neutral")))
    issue = run.classification()["files"][0]["issues"][0]
    assert issue["code"] == "label_not_in_declared_set" and issue["message"].startswith("2 ")
