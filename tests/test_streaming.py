"""Running counts over files that arrive."""

import json

from assaykit.streaming.records import format_counts, pattern_counts, stream_records


def test_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(json.dumps({"text": "me@example.com"}) + "\nnope\n")
    queries = [f(stream_records(spark, str(folder))).writeStream.format("memory").queryName(n).outputMode("complete").start() for n, f in (("shapes", format_counts), ("hits", pattern_counts))]
    for q in queries:
        q.processAllAvailable()
    (folder / "b.jsonl").write_text(json.dumps({"prompt": "p", "completion": "you@example.com"}) + "\n")
    for q in queries:
        q.processAllAvailable()
        q.stop()
    assert {r.fmt: r.n for r in spark.table("shapes").collect()} == {"raw_text": 1, "invalid": 1, "prompt_completion": 1}
    assert {r.pattern: r.n for r in spark.table("hits").collect()} == {"email": 2}
