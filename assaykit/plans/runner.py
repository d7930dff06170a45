"""All checks over dataset files, as results that can be written as JSON and put into a report.

Records are read once and persisted; each check is a plan over them whose small results come to the driver. A check
that fails on one file is critical for that file and leaves the others whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.patterns import redact, redacted
from ..functions.records import CHATS, primary_text
from ..functions.text import bounded, split_of_path
from ..operators import chats, classes, completions, encoding, exact_duplicates, formats, leakage, lengths, near_duplicates, pii, preferences, review, schema
from ..operators.shared import capped, first_n
from ..severity import exit_code, worst
from ..sources import storage
from ..sources.files import byte_blocks, list_files, read_records, too_large

CHECKS = ("format_detection", "split_leakage", "schema_validation", "encoding_sanity", "exact_duplicates", "near_duplicates", "length_distribution", "pii_scan", "chat_format", "preference_pairs", "classification", "prompt_completion")
FORMAT_CHECKS = {**dict.fromkeys(CHATS, "chat_format"), "preference_pair": "preference_pairs", "classification": "classification", "prompt_completion": "prompt_completion"}
SPLIT_NAMES = ("train", "val", "dev", "test")


def now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


def place(row) -> dict:
    return {"file": row["file"], "index": row["idx"]} | ({} if row["line"] is None else {"line": row["line"]})


def result(check: str, finding: str, files: list, severity: str | None = None, **more) -> dict:
    if severity is None:
        severity = worst(f.get("severity", "CRITICAL" if f.get("critical") else "OK") for f in files)
    return {"check": check, "timestamp": now(), "files": files, "summary": {"check": check, "severity": severity, "finding": finding}, **more}


def _grouped(rows) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["file"], []).append(r)
    return out


def _issue(row, **more) -> dict:
    out = {"severity": row["severity"], "code": row["code"], "message": row["message"], "loc": place(row), **more}
    return out | ({"sample": row["sample"]} if row["sample"] is not None else {})


class Run:
    """One dataset under one configuration."""

    def __init__(self, spark: SparkSession, files: list[str], config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.files = list(files)
        held = read_records(spark, self.files).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = self._file_errors(held)
        except Exception:
            # bytes that only a scan shows to be bad: whose they are is asked file by file, the others are read again
            held.unpersist()
            found = self._bad_files()
            held = read_records(spark, [f for f in self.files if f not in found]).persist(StorageLevel.MEMORY_AND_DISK)
            order = spark.createDataFrame([(f, i) for i, f in enumerate(self.files)], "file string, file_ord int")
            held, found = held.drop("file_ord").join(order, "file").select(*held.columns), found | self._file_errors(held)
        self.errors = found
        self.readable = [f for f in self.files if f not in found]
        self.records = held.where(~F.col("file").isin(*found)) if found else held
        self._held = held

    @staticmethod
    def _file_errors(held: DataFrame) -> dict[str, str]:
        return {r["file"]: r["error"] for r in held.where("kind = 'file_error'").select("file", "error").collect()}

    def _bad_files(self) -> dict[str, str]:
        out = {}
        for f in self.files:
            try:
                read_records(self.spark, [f]).write.format("noop").mode("overwrite").save()
            except Exception as error:
                out[f] = (str(error).strip() or type(error).__name__).splitlines()[-1][:500]
        return out

    def close(self) -> None:
        self._held.unpersist()

    def each(self, make: Callable[[str], dict]) -> list[dict]:
        """make for each readable file, and a critical entry for each other."""
        return [make(f) if f not in self.errors else {"file": f, "severity": "CRITICAL", "finding": self.errors[f], "issues": [{"severity": "CRITICAL", "code": "read_error", "message": self.errors[f]}]} for f in self.files]

    def _counts(self) -> dict[str, int]:
        return {r["file"]: r["n"] for r in self.records.groupBy("file").agg(F.count("*").alias("n")).collect()}

    def _file_formats(self, sniffed: int = formats.SNIFFED) -> dict[str, dict]:
        found = {r["file"]: r.asDict() for r in formats.file_formats(self.records, sniffed).collect()}
        empty = {"format": "empty", "sampled": 0, "invalid": 0, "critical": True, "counts": {}}
        return {f: {"format": "unreadable", "sampled": 0, "invalid": 0, "critical": True, "counts": {}} if f in self.errors else found.get(f, empty) for f in self.files}

    def format_detection(self, sniffed: int = formats.SNIFFED) -> dict:
        found = self._file_formats(sniffed)
        bad = _grouped(formats.invalid_examples(self.records, 5, sniffed).collect())
        firsts = _grouped(formats.format_counts(self.records, sniffed).collect())
        out = []
        for f in self.files:
            if large := too_large(f, self.config.max_file_size_gb):
                out.append({"file": f, "format": "too_large", "critical": True, "issues": [{"severity": "CRITICAL", "message": large}]})
                continue
            own, issues = found[f], []
            if own["format"] == "unreadable":
                issues.append({"severity": "CRITICAL", "message": self.errors[f]})
            elif own["format"] == "empty":
                issues.append({"severity": "CRITICAL", "message": "File has 0 records"})
            elif own["format"] == "invalid":
                issues.append({"severity": "CRITICAL", "message": f"Invalid JSON/empty-line records in sample: {own['invalid']}", "examples": [{**place(r), "error": r["error"]} for r in bad.get(f, [])]})
            elif own["format"] == "mixed":
                issues.append({"severity": "CRITICAL", "message": "Mixed dataset formats within one file", "format_counts": own["counts"], "examples": {r["fmt"]: r["first"].asDict() for r in firsts[f]}})
            elif own["format"] == "unknown":
                issues.append({"severity": "WARNING", "message": "no known format of fine-tuning records was found"})
            out.append({"file": f, "format": own["format"], "format_counts": own["counts"], "record_count_sampled": own["sampled"], "critical": own["critical"], "issues": issues})
        return result("format_detection", f"Detected formats for {len(out)} file(s)", out, "CRITICAL" if any(x["critical"] for x in out) else "OK")

    def schema_validation(self) -> dict:
        n, detected, counts = self.config.sample_size, {x["file"]: x for x in self.format_detection()["files"]}, self._counts()
        named = self.spark.createDataFrame([(f, "invalid" if d["format"] == "too_large" else d["format"]) for f, d in self._file_formats().items()], "file string, format string")
        found = schema.issues(self.records, named, self.config.min_trivial_chars)
        codes = _grouped(found.groupBy("file", "code").agg(F.count("*").alias("n"), F.min(F.struct("idx", "ord")).alias("first")).orderBy("first").collect())
        kept = _grouped(capped(found, 10 * n).withColumn("sample", redacted(F.col("sample"))).orderBy("file_ord", "rn").collect())

        def make(f: str) -> dict:
            fmt = self._format(detected[f])
            head = detected[f]["issues"][:n]
            if fmt in formats.UNUSABLE:
                return {"file": f, "detected_format": fmt, "record_count": detected[f].get("record_count_sampled", 0), "severity": "CRITICAL", "finding": f"the schema can't be validated, as the format is {fmt}", "issues": head, "issue_counts": {i["message"]: 1 for i in head}}
            issues = head + [_issue(r) for r in kept.get(f, [])][: max(0, 10 * n - len(head))]
            tally = {i["message"]: 1 for i in head} | {r["code"]: r["n"] for r in codes.get(f, [])}
            return {"file": f, "detected_format": fmt, "record_count": counts.get(f, 0), "severity": worst(i["severity"] for i in issues), "finding": "Schema/content issues found" if issues else "Schema validation passed", "issues": issues, "issue_counts": tally}

        files = self.each(make)
        return result("schema_validation", f"Validated {sum(x.get('record_count', 0) for x in files)} record(s) across {len(files)} file(s)", files)

    def _format(self, detected: dict) -> str:
        return detected["format"] if detected["format"] != "too_large" else self._file_formats()[detected["file"]]["format"]

    def encoding_sanity(self) -> dict:
        sizes = {f: storage.size(f) for f in self.files}
        there = [f for f in self.files if sizes[f] is not None]
        got = _grouped(encoding.scan_blocks(byte_blocks(self.spark, there, encoding.BLOCK)).collect()) if there else {}
        files = []
        for f in self.files:
            issues, counts = encoding.told(got.get(f, [])) if sizes[f] is not None else ([{"severity": "CRITICAL", "pattern": "read_error", "message": f"File not found: {f}"}], {})
            files.append({"file": f, "severity": worst(i["severity"] for i in issues), "finding": "Encoding issues found" if issues else "UTF-8/encoding sanity checks passed", "issues": issues, "counts": counts, "bytes": sizes[f] or 0})
        return result("encoding_sanity", "Encoding sanity checks complete", files)

    def exact_duplicates(self) -> dict:
        got = {r["file"]: r for r in exact_duplicates.summary(self.records).collect()}
        shown = _grouped(exact_duplicates.examples(self.records, self.config.sample_size).orderBy("file_ord", "rn").collect())
        odd = {r["file"]: r for r in exact_duplicates.not_comparable(self.records).collect()}

        def make(f: str) -> dict:
            if f in odd:
                said = f"{odd[f]['n']} record(s) can't be compared; the first: {odd[f]['error']}"
                return {"file": f, "record_count": got[f]["record_count"], "severity": "CRITICAL", "finding": said, "issues": [{"severity": "CRITICAL", "code": "not_comparable", "message": odd[f]["error"]}], "examples": []}
            n = {k: got[f][k] if f in got else 0 for k in ("record_count", "unique_records", "duplicate_count", "duplicate_rate")}
            some = n["duplicate_count"] > 0
            examples = [{"hash": r["hash"], "first": place({"file": f, "idx": r["first_idx"], "line": r["first_line"]}), "duplicate": place(r), "sample": r["sample"]} for r in shown.get(f, [])]
            return {"file": f, **n, "severity": "WARNING" if some else "OK", "finding": f"{n['duplicate_count']} exact duplicate record(s)" if some else "No exact full-record duplicates", "examples": examples}

        files = self.each(make)
        return result("exact_duplicates", f"Found {sum(x.get('duplicate_count', 0) for x in files)} exact duplicate record(s)", files)

    def near_duplicates(self) -> dict:
        c, counts = self.config, self._counts()
        found = near_duplicates.clusters(self.records, c.near_duplicate_threshold, method=c.near_duplicate_method, num_perm=c.near_duplicate_num_perm).persist(StorageLevel.MEMORY_AND_DISK)
        totals = {r["file"]: r for r in near_duplicates.summary(found).collect()}
        top = first_n(found.groupBy("file", "cluster", "size").count(), c.sample_size, ["file"], F.desc("size"), F.asc("cluster")).select("cluster", F.col("rn").alias("nth"))
        shown = first_n(found.join(F.broadcast(top), "cluster"), c.sample_size, ["cluster"], "id")
        shown = shown.join(self.records.select("file", "idx", primary_text(F.col("fields")).alias("text")), ["file", "idx"])
        rows = _grouped(shown.withColumn("text", redacted(F.left("text", F.lit(300)))).orderBy("nth", "rn").collect())
        found.unpersist()

        def make(f: str) -> dict:
            limit = "near_duplicate_max_records" if c.near_duplicate_method == "lsh" else "near_duplicate_fallback_max_records"
            if c.parity_limits and counts.get(f, 0) > getattr(c, limit):
                return {"file": f, "record_count": counts[f], "severity": "WARNING", "finding": f"more than {limit}={getattr(c, limit)} records; not compared", "clusters": [], "cluster_count": 0, "method": "skipped_too_many_records"}
            n = totals[f]["cluster_count"] if f in totals else 0
            groups: dict[int, list] = {}
            for r in rows.get(f, []):
                groups.setdefault(r["nth"], []).append(r)
            clusters = [{"size": g[0]["size"], "members": [{"loc": place(r), "input_excerpt": r["text"]} for r in g]} for g in groups.values()]
            finding = f"{n} near-duplicate cluster(s) at threshold {c.near_duplicate_threshold}" if n else "No near-duplicate prompt/input clusters found"
            return {"file": f, "record_count": counts.get(f, 0), "severity": "WARNING" if n else "OK", "finding": finding, "threshold": c.near_duplicate_threshold, "method": self._method(), "cluster_count": n, "records_in_clusters": totals[f]["records_in_clusters"] if f in totals else 0, "clusters": clusters}

        files = self.each(make)
        return result("near_duplicates", f"Found {sum(x.get('cluster_count', 0) for x in files)} near-duplicate cluster(s)", files)

    def _method(self) -> str:
        return "exact_jaccard_join" if self.config.near_duplicate_method == "exact" else "minhash_lsh_verified"

    def length_distribution(self) -> dict:
        c = self.config
        measured = lengths.measured(self.records, c.token_ranks, c.token_encoding).persist(StorageLevel.MEMORY_AND_DISK)
        stats = {r["file"]: r for r in lengths.stats(measured, c.length_windows).collect()}
        longest = lengths.longest(measured, c.sample_size).withColumn("bundle", redacted(F.left("bundle", F.lit(500))))
        longest = _grouped(longest.orderBy("file_ord", "rn").collect())
        histograms = {k: _grouped(lengths.histogram(measured, k).orderBy("file", "bin").collect()) for k in ("chars", "tokens")}
        measured.unpersist()

        def make(f: str) -> dict:
            s = stats.get(f)
            over = {str(w): s[f"over_{w}"] for w in c.length_windows if s and s[f"over_{w}"]}
            stat = lambda k: {"count": s["record_count"], "p50": s[f"{k}_p"][0], "p90": s[f"{k}_p"][1], "p99": s[f"{k}_p"][2], "max": s[f"{k}_max"], "mean": s[f"{k}_mean"]} if s else {"count": 0, "p50": None, "p90": None, "p99": None, "max": None, "mean": None}
            finding = ("Length outliers exceed common context windows" if over else "Length distribution computed") + ("" if c.token_ranks else " using approximate token heuristic")
            bars = {k: lengths.bars([(r["low"], r["high"], r["n"]) for r in h.get(f, [])]) for k, h in histograms.items()}
            return {
                "file": f, "record_count": s["record_count"] if s else 0, "severity": "WARNING" if over else "OK", "finding": finding, "tokenizer": c.token_encoding if c.token_ranks else "chars_div_4_heuristic",
                "token_counts_are_approximate": not c.token_ranks, "char_stats": stat("chars"), "token_stats": stat("tokens"), "context_window_exceed_counts": over, "empty_text_bundle_records": s["empty_text_bundle_records"] if s else 0,
                "longest_examples": [{"token_count": r["tokens"], "loc": place(r), "text_excerpt": r["bundle"]} for r in longest.get(f, [])], "char_histogram": bars["chars"], "token_histogram": bars["tokens"],
            }

        return result("length_distribution", "Length stats computed", self.each(make))

    def pii_scan(self) -> dict:
        c, counts = self.config, self._counts()
        found = pii.hits(self.records).persist(StorageLevel.MEMORY_AND_DISK)
        totals = _grouped(pii.pattern_counts(found).collect())
        shown = _grouped(pii.samples(found, self.records, c.pii_sample_size or c.sample_size).orderBy("pattern", "rn").collect())
        found.unpersist()

        def make(f: str) -> dict:
            hits = {r["pattern"]: r["n"] for r in totals.get(f, [])}
            samples: dict[str, list] = {}
            for r in shown.get(f, []):
                samples.setdefault(r["pattern"], []).append({"loc": place(r), "sample": r["sample"], "match_count": r["match_count"]})
            return {"file": f, "record_count": counts.get(f, 0), "severity": "WARNING" if hits else "OK", "finding": "Potential PII/secrets found by regex scan" if hits else "No regex PII/secrets matches found", "pattern_counts": hits, "samples_redacted": samples}

        files = self.each(make)
        return result("pii_scan", f"Found {sum(sum(x.get('pattern_counts', {}).values()) for x in files)} regex PII/secret hit(s)", files)

    def chat_format(self) -> dict:
        n, found = self.config.sample_size, chats.issues(self.records)
        checked = {r["file"]: r["n"] for r in chats.chats(self.records).groupBy("file").agg(F.count("*").alias("n")).collect()}
        counts = _grouped(chats.issue_counts(found).collect())
        kept = _grouped(capped(found, n, chats.UNCAPPED).orderBy("file_ord", "idx", "ord").collect())
        true = {r["file"]: r for r in found.groupBy("file").agg(F.collect_set("severity").alias("all")).collect()}
        prompts = _grouped(chats.top_system_prompts(self.records, n).orderBy("file", "rn").collect())
        unique = {r["file"]: r["n"] for r in chats.system_prompts(self.records).groupBy("file").agg(F.count("*").alias("n")).collect()}

        def make(f: str) -> dict:
            issues = [_issue(r, **({"roles": list(r["roles"])} if r["code"] in ("system_not_at_start", "role_alternation", "does_not_end_assistant") else {})) for r in kept.get(f, [])]
            return {
                "file": f, "record_count_checked": checked.get(f, 0), "severity": worst(i["severity"] for i in issues), "uncapped_severity": worst(true[f]["all"] if f in true else ()),
                "finding": "Chat format issues found" if issues else "Chat role and tool/function format checks passed", "issue_counts": {r["counted"]: r["n"] for r in counts.get(f, [])}, "issues": issues[: 2 * n],
                "unique_system_prompt_count": unique.get(f, 0), "system_prompt_top": [{"count": r["n"], "excerpt": r["excerpt"]} for r in prompts.get(f, [])],
            }

        return result("chat_format", "Chat format checks complete", self.each(make))

    def preference_pairs(self) -> dict:
        c, n, found = self.config, self.config.sample_size, preferences.issues(self.records)
        counts = _grouped(found.groupBy("file", "code").agg(F.count("*").alias("n")).collect())
        kept = _grouped(capped(found, n).withColumn("sample", redacted(F.col("sample"))).orderBy("file_ord", "rn").collect())
        bias = {r["file"]: r for r in preferences.length_bias(self.records, c.preference_length_bias_warning_ratio).collect()}
        shown = _grouped(preferences.review(self.records, n).orderBy("file", "rn").collect())

        def make(f: str) -> dict:
            issues = [_issue(r, **({"previous_loc": place({"file": f, "idx": r["first_idx"], "line": r["first_line"]})} if r["code"] == "conflicting_prompt_pairs" else {})) for r in kept.get(f, [])]
            tally, b = {r["code"]: r["n"] for r in counts.get(f, [])}, bias.get(f)
            means = {k: b[k] if b else 0 for k in ("mean_chosen_chars", "mean_rejected_chars", "mean_delta_chars", "ratio_vs_rejected")}
            if b and b["biased"]:
                tally["chosen_much_longer"] = 1
                issues.append({"severity": "WARNING", "code": "chosen_much_longer", "message": f"chosen answers are {b['ratio_vs_rejected']:.1%} longer than rejected ones on average", "mean_chosen_chars": b["mean_chosen_chars"], "mean_rejected_chars": b["mean_rejected_chars"]})
            samples = [{"loc": place(r), **{k: r[k] for k in ("prompt_excerpt", "chosen_excerpt", "rejected_excerpt")}, "note": "for reading only: whether the chosen answer is better isn't judged"} for r in shown.get(f, [])]
            return {"file": f, "record_count_checked": b["record_count"] if b else 0, "severity": worst(i["severity"] for i in issues), "finding": "Preference-pair issues found" if issues else "Preference-pair deterministic checks passed", "issue_counts": tally, "issues": issues[: 2 * n], "length_bias": means, "manual_swap_review_samples": samples}

        return result("preference_pairs", "Preference pair checks complete", self.each(make))

    def classification(self) -> dict:
        c, n = self.config, self.config.sample_size
        counts = classes.label_counts(self.records).persist(StorageLevel.MEMORY_AND_DISK)
        labels = _grouped(counts.orderBy("first").collect())
        drift = _grouped(classes.drift(counts).orderBy("first").collect())
        balance = {r["file"]: r for r in classes.balance(counts).collect()}
        counts.unpersist()
        wrong = _grouped(classes.undeclared_examples(self.records, c.declared_labels, n).orderBy("file", "rn").collect()) if c.declared_labels else {}

        def make(f: str) -> dict:
            issues, own = [], {r["label"]: r["n"] for r in labels.get(f, [])}
            if c.declared_labels and (k := sum(v for x, v in own.items() if x not in c.declared_labels)):
                examples = [{"loc": place(r), "label": r["label"], "sample": redact(r["sample"][:800])} for r in wrong.get(f, [])]
                issues.append({"severity": "CRITICAL", "code": "label_not_in_declared_set", "message": f"{k} labels not in declared label set", "examples": examples})
            if f in drift:
                issues.append({"severity": "WARNING", "code": "label_normalization", "message": "Labels differ only by case/whitespace", "examples": [{"normalized": r["normalized"], "variants": r["variants"]} for r in drift[f][:n]]})
            ratio = balance[f]["ratio"] if f in balance else None
            if ratio is not None and ratio >= c.classification_majority_minority_warning_ratio:
                issues.append({"severity": "WARNING", "code": "class_imbalance", "message": f"Majority/minority ratio is {ratio:.2f}", "majority_minority_ratio": ratio})
            return {"file": f, "record_count_checked": sum(own.values()), "severity": worst(i["severity"] for i in issues), "finding": "Classification label issues found" if issues else "Classification label checks passed", "label_counts": own, "majority_minority_ratio": ratio, "declared_labels": sorted(c.declared_labels) if c.declared_labels else None, "issues": issues}

        return result("classification", "Classification checks complete", self.each(make))

    def prompt_completion(self) -> dict:
        n, found = self.config.sample_size, completions.issues(self.records)
        checked = {r["file"]: r["n"] for r in self.records.where(F.col("fmt") == "prompt_completion").groupBy("file").agg(F.count("*").alias("n")).collect()}
        counts = _grouped(found.groupBy("file", "code").agg(F.count("*").alias("n")).collect())
        kept = _grouped(capped(found, n).withColumn("sample", redacted(bounded(F.col("sample"), 800))).orderBy("file_ord", "rn").collect())

        def make(f: str) -> dict:
            issues = [_issue(r) for r in kept.get(f, [])]
            return {"file": f, "record_count_checked": checked.get(f, 0), "severity": worst(i["severity"] for i in issues), "finding": "Prompt-completion issues found" if issues else "Prompt-completion deterministic checks passed", "issue_counts": {r["code"]: r["n"] for r in counts.get(f, [])}, "issues": issues}

        return result("prompt_completion", "Prompt-completion checks complete", self.each(make))

    def leakage_jobs(self, detected: dict) -> list[tuple[str, list[str]]]:
        """Format and files of each comparison: the files with a split field, if a format has any; else those that are
        named after a split, if they name two."""
        usable = {x["file"]: x["format"] for x in detected["files"] if x["format"] not in (*formats.UNUSABLE, "unknown")}
        own = {r["file"] for r in self.records.where((F.col("idx") < formats.SNIFFED) & F.col("own_split").isNotNull()).select("file").distinct().collect()}
        names = self.spark.createDataFrame([(f,) for f in usable], "file string").select("file", split_of_path(F.col("file")).alias("split")).collect() if usable else []
        named = {r["file"]: r["split"] for r in names if r["split"] in SPLIT_NAMES}
        jobs = []
        for fmt in sorted(set(usable.values())):
            files = [f for f in self.files if usable.get(f) == fmt]
            if some := [f for f in files if f in own]:
                jobs.append((fmt, some))
            elif len({named[f] for f in files if f in named}) > 1:
                jobs.append((fmt, [f for f in files if f in named]))
        return jobs

    def split_leakage(self, files: list[str] | None = None) -> dict:
        c = self.config
        files = self.readable if files is None else files
        placed = leakage.with_splits(self.records.where(F.col("file").isin(*files))).persist(StorageLevel.MEMORY_AND_DISK)
        counts = {r["split"]: r["n"] for r in leakage.split_counts(placed).orderBy("split_ord").collect()}
        exact = leakage.exact_leaks(placed).persist(StorageLevel.MEMORY_AND_DISK)
        leaks = exact.count()
        where = placed.select("pos", "file", "idx", "line", "sample", primary_text(F.col("fields")).alias("text"))
        spots = exact.orderBy("pos_b").limit(c.sample_size)
        b = where.toDF("pos_b", "file", "idx", "line", "sample", "text")
        a = where.select(F.col("pos").alias("pos_a"), F.struct("file", "idx", "line").alias("a"))
        shown = spots.join(b, "pos_b").join(a, "pos_a").withColumn("sample", redacted(bounded(F.col("sample"), 800))).orderBy("pos_b").collect()
        examples = [{"hash": r["hash"], "split_a": r["split_a"], "loc_a": place(r["a"]), "split_b": r["split_b"], "loc_b": place(r), "sample": r["sample"]} for r in shown]
        near = leakage.near_leaks(placed, c.near_duplicate_threshold, c.near_duplicate_method, c.near_duplicate_num_perm, c.split_near_leakage_max_records_per_split if c.parity_limits else None).persist(StorageLevel.MEMORY_AND_DISK)
        groups = near.select("cluster").distinct().count()
        top = near.select("cluster").distinct().orderBy("cluster").limit(c.sample_size)
        some = first_n(near.join(F.broadcast(top), "cluster"), c.sample_size, ["cluster"], "pos").join(where, "pos").withColumn("text", redacted(F.left("text", F.lit(250)))).orderBy("cluster", "pos").collect()
        splits = {r["cluster"]: sorted(r["s"]) for r in near.join(F.broadcast(top), "cluster").groupBy("cluster").agg(F.collect_set("split").alias("s")).collect()}
        members: dict[int, list] = {}
        for r in some:
            members.setdefault(r["cluster"], []).append(r)
        near_examples = [{"size": g[0]["size"], "splits": splits[k], "members": [{"split": r["split"], "loc": place(r), "input_excerpt": r["text"]} for r in g]} for k, g in members.items()]
        for x in (placed, exact, near):
            x.unpersist()
        severity = "CRITICAL" if leaks else "WARNING" if groups else "OK"
        finding = f"{leaks} exact cross-split leak(s); {groups} near cross-split cluster(s)" if leaks else f"{groups} near-duplicate cross-split cluster(s); no exact leakage" if groups else "No exact or near cross-split leakage found"
        method = "not_enough_records" if sum(counts.values()) < 2 else self._method()
        return result("split_leakage", finding, list(files), severity, split_counts=counts, exact_leakage_count=leaks, exact_examples=examples, near_leakage_cluster_count=groups, near_examples=near_examples, near_method=method)

    def review(self) -> list[dict]:
        rows = review.review_sample(self.records, self.config.random_review_sample, len(self.files), self.config.review_seed).orderBy("file_ord", "rn").collect()
        return [{"loc": place(r), "record": r["record"]} for r in rows] + [{"loc": {"file": f}, "error": e} for f, e in self.errors.items()]


def run_checks(run: Run, skip_near: bool = False) -> dict[str, dict]:
    """All checks that the formats call for, by the name of their result."""
    out: dict[str, dict] = {}
    for name in ("format_detection", "encoding_sanity", "schema_validation", "exact_duplicates", "near_duplicates", "length_distribution", "pii_scan"):
        if not (skip_near and name == "near_duplicates"):
            out[name] = _guarded(name, getattr(run, name))
    detected = out["format_detection"]
    if not skip_near:
        for fmt, files in run.leakage_jobs(detected):
            out[f"split_leakage_{fmt}"] = _guarded("split_leakage", lambda files=files: run.split_leakage(files))
    for name in sorted({FORMAT_CHECKS[x["format"]] for x in detected["files"] if x["format"] in FORMAT_CHECKS}):
        out[name] = _guarded(name, getattr(run, name))
    return out


def _guarded(name: str, check: Callable[[], dict]) -> dict:
    """A check that fails is a critical result under its own name."""
    try:
        return check()
    except Exception as error:
        return result(name, f"the check failed: {str(error).splitlines()[0][:500] if str(error) else type(error).__name__}", [], "CRITICAL")


def run_all(spark: SparkSession, path: str, output: str, config: Config | None = None, skip_near: bool = False) -> tuple[dict[str, dict], int]:
    """Run all checks on a file or folder, write results and report to output; the results and the exit code."""
    from .report import write_report

    config = config or Config()
    folder = Path(output)
    folder.mkdir(parents=True, exist_ok=True)
    files = list_files(path)
    if not files:
        none = result("run_all", "No supported dataset files found", [], "CRITICAL")
        return {"run_all": none}, 2
    (folder / "effective_config.json").write_text(config.to_json(), encoding="utf-8")
    run = Run(spark, files, config)
    results = run_checks(run, skip_near)
    for name, r in results.items():
        (folder / f"{name}.json").write_text(dump(r), encoding="utf-8")
        (folder / f"{name}.stderr.txt").write_text(summary_line(r) + "\n", encoding="utf-8")
    (folder / "manual_review_samples.json").write_text(dump(run.review()), encoding="utf-8")
    (folder / "report.md").write_text(write_report(list(results.values())), encoding="utf-8")
    code = 2 if any(r["summary"]["severity"] == "CRITICAL" for r in results.values()) else 0
    summary = {"timestamp": now(), "inputs": files, "output_dir": str(folder), "report": str(folder / "report.md"), "returncode_max": max(exit_code(r) for r in results.values())}
    (folder / "run_all_summary.json").write_text(dump(summary), encoding="utf-8")
    run.close()
    return results, code


def summary_line(r: dict) -> str:
    """What a check says of itself on the error stream."""
    return f"[{r['summary']['severity']}] {r['summary']['check']}: {r['summary']['finding']}"


def dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str)
