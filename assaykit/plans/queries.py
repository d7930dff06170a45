"""The checks over the tables of a data folder, each with its SQL.

documents are raw texts, or the sides of derived prompts, pairs and labels; conversations are chats. Each query covers
its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as fn
from ..functions.patterns import PATTERNS, matches
from ..operators import chats, classes, completions, encoding, exact_duplicates, formats, leakage, lengths, near_duplicates, pii, preferences, review, schema
from ..severity import rank_column, worst_column
from ..sources.tables import table_records
from . import file_queries

CONFIG = Config()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table_records(table(spark, sf, "documents"), {"text": F.col("text")}, F.col("doc_id"), "documents")


def talks(spark: SparkSession, sf: str, without_turn: int | None = None) -> DataFrame:
    turns = table(spark, sf, "conversations")
    if without_turn is not None:
        turns = turns.where(F.col("turn") != without_turn)
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    said = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return table_records(grouped, {}, F.col("conv_id"), "conversations", messages=said)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    spelled = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("lang"))
    return table_records(table(spark, sf, "documents"), {"text": F.col("text"), "label": spelled}, F.col("doc_id"), "labelled")


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 11 == 0, F.col("text")).when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("lang"))
    return table_records(table(spark, sf, "documents"), {"prompt": F.col("text"), "completion": said}, F.col("doc_id"), "prompts")


def choices(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("rejected"))
    payload = {"prompt": F.concat_ws(" ", "source", "lang"), "chosen": F.col("text"), "rejected": F.col("rejected")}
    return table_records(docs.join(after, "doc_id"), payload, F.col("doc_id"), "choices")


def splits(spark: SparkSession, sf: str) -> DataFrame:
    own = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    order = F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)
    return table_records(table(spark, sf, "documents"), {"text": F.col("text")}, F.col("doc_id"), F.concat(own, F.lit(".jsonl")), order)


_BUNDLE = "SELECT doc_id, 'text: ' || coalesce(text, '') AS b FROM documents"
_MEASURED = f"WITH m AS (SELECT doc_id, length(b) AS chars, CAST(ceil(length(b) / 4.0) AS BIGINT) AS tokens FROM ({_BUNDLE}))"
_TURNS = "SELECT conv_id, turn, CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'bot' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'function' THEN 'tool' ELSE lower(trim(role)) END AS role, text FROM conversations"


@query("SELECT doc_id, hash, first_doc_id FROM (SELECT doc_id, sha256('{\"text\":' || CAST(to_json(text) AS VARCHAR) || '}') AS hash, min(doc_id) OVER (PARTITION BY text) AS first_doc_id FROM documents) WHERE doc_id > first_doc_id")
def exact_duplicate_records(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates.duplicates(texts(spark, sf)).select(F.col("idx").alias("doc_id"), "hash", F.col("first_idx").alias("first_doc_id"))


@query("SELECT count(*) AS record_count, count(DISTINCT text) AS unique_records, count(*) - count(DISTINCT text) AS duplicate_count, round((count(*) - count(DISTINCT text)) / count(*), 9) AS duplicate_rate FROM documents")
def exact_duplicate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates.summary(texts(spark, sf)).select("record_count", "unique_records", "duplicate_count", F.round("duplicate_rate", 9).alias("duplicate_rate"))


_SHINGLES = r"""
    RECURSIVE toks AS (SELECT {key}, CAST(doc_id AS BIGINT) AS id, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_'']+') AS t FROM {source}),
    sh AS (SELECT DISTINCT {key}, id, unnest(CASE WHEN len(t) >= 5 THEN [array_to_string(t[i:i+4], ' ') FOR i IN range(1, len(t) - 3)] ELSE t END) AS s FROM toks),
    sizes AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
    shared AS (SELECT a.id AS u, b.id AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id {same} GROUP BY 1, 2),
    edges AS (SELECT u, v FROM shared JOIN sizes x ON x.id = u JOIN sizes y ON y.id = v WHERE k / (x.n + y.n - k) >= 0.85
              UNION SELECT a.id, b.id FROM toks a JOIN toks b ON len(a.t) = 0 AND len(b.t) = 0 AND a.id < b.id),
    both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
    reach(id, root) AS (SELECT u, u FROM both_ways UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.id),
    comp AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id)"""


@query("WITH " + _SHINGLES.format(key="0 AS g", text="text", source="documents", same="").replace("SELECT DISTINCT 0 AS g", "SELECT DISTINCT g") + " SELECT id AS doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM comp")
def near_duplicate_clusters(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates.clusters(texts(spark, sf), CONFIG.near_duplicate_threshold)
    return found.select(F.col("idx").alias("doc_id"), "cluster", "size")


@query("WITH " + _SHINGLES.format(key="0 AS g", text="text", source="documents", same="").replace("SELECT DISTINCT 0 AS g", "SELECT DISTINCT g") + " SELECT count(DISTINCT cluster) AS cluster_count, count(*) AS records_in_clusters FROM comp")
def near_duplicate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.summary(near_duplicates.clusters(texts(spark, sf), CONFIG.near_duplicate_threshold)).drop("file")


@query()
def near_duplicate_clusters_lsh(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates.clusters(texts(spark, sf), CONFIG.near_duplicate_threshold, method="lsh", num_perm=CONFIG.near_duplicate_num_perm)
    return found.select(F.col("idx").alias("doc_id"), "cluster", "size")


@query("""
    WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS o, text FROM documents),
    firsts AS (SELECT text, min(o) AS o FROM s GROUP BY text), a AS (SELECT s.text, s.o, max(doc_id) AS doc_id_a FROM s JOIN firsts f ON s.text = f.text AND s.o = f.o GROUP BY 1, 2)
    SELECT CASE a.o WHEN 0 THEN 'train' ELSE 'test' END AS split_a, doc_id_a, CASE s.o WHEN 0 THEN 'train' ELSE 'test' END AS split_b, s.doc_id AS doc_id_b
    FROM s JOIN a ON s.text = a.text AND s.o > a.o""")
def split_leakage_exact(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.exact_leaks(leakage.with_splits(splits(spark, sf)))
    low = F.lit((1 << 40) - 1)
    return found.select("split_a", F.col("pos_a").bitwiseAND(low).alias("doc_id_a"), "split_b", F.col("pos_b").bitwiseAND(low).alias("doc_id_b"))


@query("WITH " + _SHINGLES.format(key="0 AS g", text="text", source="documents", same="").replace("SELECT DISTINCT 0 AS g", "SELECT DISTINCT g") + ", named AS (SELECT *, CASE WHEN id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM comp), spans AS (SELECT cluster, count(*) AS size FROM named GROUP BY cluster HAVING count(DISTINCT split) > 1) SELECT id AS doc_id, split, size FROM named JOIN spans USING (cluster)")
def split_leakage_near(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.near_leaks(leakage.with_splits(splits(spark, sf)), CONFIG.near_duplicate_threshold)
    return found.select(F.col("pos").bitwiseAND(F.lit((1 << 40) - 1)).alias("doc_id"), "split", "size")


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS split_ord FROM documents GROUP BY ALL")
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.split_counts(leakage.with_splits(splits(spark, sf)))


def _stats_sql(c: str) -> str:
    return f"round(quantile_cont({c}, 0.5), 6) AS {c}_p50, round(quantile_cont({c}, 0.9), 6) AS {c}_p90, round(quantile_cont({c}, 0.99), 6) AS {c}_p99, max({c}) AS {c}_max, round(avg({c}), 6) AS {c}_mean"


@query(f"{_MEASURED} SELECT count(*) AS record_count, {_stats_sql('chars')}, {_stats_sql('tokens')} FROM m")
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    got = lengths.stats(lengths.measured(texts(spark, sf)), CONFIG.length_windows)
    out = [F.col("record_count")]
    for c in ("chars", "tokens"):
        out += [F.round(F.col(f"{c}_p")[i], 6).alias(f"{c}_p{p}") for i, p in enumerate((50, 90, 99))] + [F.col(f"{c}_max"), F.round(f"{c}_mean", 6).alias(f"{c}_mean")]
    return got.select(*out)


@query(f"{_MEASURED} SELECT " + ", ".join(f"count(*) FILTER (tokens > {w}) AS over_{w}" for w in CONFIG.length_windows) + ", 0 AS empty_text_bundle_records FROM m")
def context_window_exceed(spark: SparkSession, sf: str) -> DataFrame:
    got = lengths.stats(lengths.measured(texts(spark, sf)), CONFIG.length_windows)
    return got.select(*(f"over_{w}" for w in CONFIG.length_windows), "empty_text_bundle_records")


@query(f"""{_MEASURED}, e AS (SELECT min(tokens) AS lo, max(tokens) AS hi, least(10, greatest(1, max(tokens) - min(tokens))) AS bins FROM m),
    b AS (SELECT least(bins - 1, CAST(floor((tokens - lo) / ((hi - lo) / bins)) AS BIGINT)) AS bin, count(*) AS n FROM m, e GROUP BY 1)
    SELECT r.bin AS bin, CAST(floor(lo + r.bin * ((hi - lo) / bins)) AS BIGINT) AS low, CAST(floor(lo + (r.bin + 1) * ((hi - lo) / bins)) AS BIGINT) AS high, coalesce(n, 0) AS n
    FROM e, unnest(range(10)) r(bin) LEFT JOIN b ON b.bin = r.bin WHERE r.bin < bins""")
def token_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return lengths.histogram(lengths.measured(texts(spark, sf)), "tokens").drop("file")


@query(f"{_MEASURED} SELECT doc_id, tokens, chars FROM m ORDER BY tokens DESC, doc_id LIMIT 5")
def longest_records(spark: SparkSession, sf: str) -> DataFrame:
    return lengths.overall_longest(lengths.measured(texts(spark, sf)), CONFIG.sample_size).select(F.col("idx").alias("doc_id"), "tokens", "chars")


def _luhn_sql(x: str) -> str:
    """Sum of Luhn digits of the digits in x."""
    return f"list_sum([CASE WHEN (len(d) - i) % 2 = 1 THEN CASE WHEN 2 * d[i] > 9 THEN 2 * d[i] - 9 ELSE 2 * d[i] END ELSE d[i] END FOR i IN range(1, len(d) + 1)])".replace("X", x)


_CARDS = f"""SELECT doc_id, 'credit_card_candidate' AS pattern, count(*) AS n FROM (
    SELECT doc_id, [CAST(c AS INT) FOR c IN string_split(regexp_replace(m, '[^0-9]', '', 'g'), '')] AS d
    FROM (SELECT doc_id, unnest(regexp_extract_all(b, '{PATTERNS["credit_card_candidate"][1]}')) AS m FROM ({_BUNDLE})))
    WHERE len(d) BETWEEN 13 AND 19 AND {_luhn_sql('')} % 10 = 0 GROUP BY doc_id"""
def _phone_sql() -> str:
    """RE2 has no look-around. With every character that is no word's written twice, one of each pair can stand for what
    comes before a number and what comes after the one before it, so that none is wanted twice."""
    gap, group, edge = r"(?:--|\.\.|\s\s)?", r"\d{2,4}", r"[^\p{L}\p{N}_]"
    number = rf"(?:(?:\+\+)?\d{{1,3}}{gap})?(?:(?:\(\()?{group}(?:\)\))?{gap}){{2,4}}{group}"
    found = rf"regexp_extract_all(regexp_replace(b, '({edge})', '\1\1', 'g'), '(?:^|{edge})({number})(?:{edge}|$)', 1)"
    return f"SELECT doc_id, 'phone' AS pattern, len(list_filter({found}, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)) AS n FROM ({_BUNDLE})"


_FOUND = " UNION ALL ".join(
    [f"SELECT doc_id, '{k}' AS pattern, len(regexp_extract_all(b, '{('(?i)' if i else '') + p.replace(chr(39), chr(39) * 2)}')) AS n FROM ({_BUNDLE})" for k, (i, p) in PATTERNS.items() if k not in ("phone", "credit_card_candidate")] + [_CARDS, _phone_sql()]
)


@query(f"SELECT doc_id, pattern, n AS match_count FROM ({_FOUND}) WHERE n > 0")
def pii_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.hits(texts(spark, sf))
    return found.select(F.col("idx").alias("doc_id"), "pattern", "match_count")


@query(f"SELECT pattern, CAST(sum(n) AS BIGINT) AS n, count(*) AS records FROM ({_FOUND}) WHERE n > 0 GROUP BY pattern")
def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pattern_counts(pii.hits(texts(spark, sf))).drop("file")


@query(f"SELECT doc_id, n AS match_count FROM ({_phone_sql()}) WHERE n > 0")
def pii_phone(spark: SparkSession, sf: str) -> DataFrame:
    found = texts(spark, sf).select(F.col("idx").alias("doc_id"), F.size(matches(F.concat(F.lit("text: "), F.get("fields", F.lit(0))["value"]), "phone")).cast("long").alias("match_count"))
    return found.where("match_count > 0")


@query(f"SELECT pattern, doc_id, n AS match_count FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY doc_id) AS k FROM ({_FOUND}) WHERE n > 0) WHERE k <= {CONFIG.pii_sample_size}")
def pii_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The records that are shown for each pattern."""
    return pii_samples(spark, sf).drop("sample")


@query()
def pii_samples(spark: SparkSession, sf: str) -> DataFrame:
    return pii.samples(pii.hits(records := texts(spark, sf)), records, CONFIG.pii_sample_size).select("pattern", F.col("idx").alias("doc_id"), "match_count", "sample")


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN ' ' || upper(lang) ELSE lang END AS label, count(*) AS n FROM documents GROUP BY 1")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return classes.label_counts(labelled(spark, sf)).select("label", "n")


_LABELS = "SELECT CASE WHEN doc_id % 7 = 0 THEN ' ' || upper(lang) ELSE lang END AS label, count(*) AS n FROM documents GROUP BY 1"


@query(f"SELECT lower(trim(label)) AS normalized, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS records FROM ({_LABELS}) GROUP BY 1 HAVING count(*) > 1")
def label_normalization(spark: SparkSession, sf: str) -> DataFrame:
    return classes.drift(classes.label_counts(labelled(spark, sf))).select("normalized", "spellings", "records")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS record_count, round(max(n) / greatest(1, min(n)), 6) AS ratio, max(n) / greatest(1, min(n)) >= 10.0 AS imbalanced FROM ({_LABELS})")
def class_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    got = classes.balance(classes.label_counts(labelled(spark, sf)))
    return got.select("record_count", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= CONFIG.classification_majority_minority_warning_ratio).alias("imbalanced"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' || upper(lang) ELSE lang END AS label FROM documents WHERE NOT (doc_id % 7 <> 0 AND lang IN ('en', 'de', 'fr'))")
def label_not_in_declared_set(spark: SparkSession, sf: str) -> DataFrame:
    return classes.undeclared(labelled(spark, sf), ("en", "de", "fr")).select(F.col("idx").alias("doc_id"), "label")


@query("""
    SELECT label, value, count(*) AS n FROM (SELECT 'quality' AS label, quality AS value FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT 'toxic', toxic FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def joined_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs, marks = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    out = None
    for name in ("quality", "toxic"):
        own = table_records(docs.join(marks, "doc_id"), {"text": F.col("text"), "label": F.col(name).cast("string")}, F.col("doc_id"), name)
        one = classes.label_counts(own).select(F.col("file").alias("label"), F.col("label").cast("int").alias("value"), "n")
        out = one if out is None else out.union(one)
    return out


_CHAT_CODES = f"""
    WITH t AS ({_TURNS}), kept AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM t WHERE role NOT IN ('system', 'tool') {{w}}),
    alternation AS (SELECT conv_id, arg_min(role, turn) AS role FROM kept WHERE role = prev AND role IN ('user', 'assistant') GROUP BY conv_id),
    ends AS (SELECT conv_id, arg_max(role, turn) AS role FROM t WHERE TRUE {{w}} GROUP BY conv_id),
    late AS (SELECT DISTINCT conv_id FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t WHERE TRUE {{w}}) WHERE k > 1 AND role = 'system')
    SELECT conv_id, 'same_role_consecutive_' || role AS counted FROM alternation UNION ALL SELECT conv_id, 'does_not_end_assistant' FROM ends WHERE role <> 'assistant'
    UNION ALL SELECT conv_id, 'system_not_at_start' FROM late UNION ALL SELECT conv_id, 'empty_assistant_turn' FROM t WHERE role = 'assistant' AND trim(coalesce(text, '')) = '' {{w}}"""


@query(_CHAT_CODES.replace("{w}", ""))
def chat_issues(spark: SparkSession, sf: str) -> DataFrame:
    return chats.issues(talks(spark, sf)).select(F.col("idx").alias("conv_id"), "counted")


@query(_CHAT_CODES.replace("{w}", "AND turn <> 1"))
def chat_issues_without_a_turn(spark: SparkSession, sf: str) -> DataFrame:
    return chats.issues(talks(spark, sf, 1)).select(F.col("idx").alias("conv_id"), "counted")


@query("SELECT counted, count(*) AS n FROM (" + _CHAT_CODES.replace("{w}", "AND turn <> 1") + ") GROUP BY 1")
def chat_issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chats.issue_counts(chats.issues(talks(spark, sf, 1))).drop("file")


@query(f"SELECT prompt, count(*) AS n FROM (SELECT conv_id, CASE WHEN arg_min(role, turn) = 'system' THEN trim(arg_min(text, turn)) ELSE '' END AS prompt FROM ({_TURNS}) GROUP BY conv_id) GROUP BY 1")
def system_prompt_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chats.system_prompts(talks(spark, sf)).select("prompt", "n")


_PROMPTS = "SELECT doc_id, text AS p, CASE WHEN doc_id % 11 = 0 THEN text WHEN doc_id % 13 = 0 THEN '' ELSE lang END AS c FROM documents"


@query(rf"SELECT doc_id, 'empty_completion' AS code, 'CRITICAL' AS severity FROM ({_PROMPTS}) WHERE trim(c) = '' UNION ALL SELECT doc_id, 'completion_copies_prompt', 'WARNING' FROM ({_PROMPTS}) WHERE trim(p) <> '' AND trim(regexp_replace(p, '\s+', ' ', 'g')) = trim(regexp_replace(c, '\s+', ' ', 'g'))")
def prompt_completion_issues(spark: SparkSession, sf: str) -> DataFrame:
    return completions.issues(prompts(spark, sf)).select(F.col("idx").alias("doc_id"), "code", "severity")


_CHOICES = r"SELECT a.doc_id, a.source || ' ' || a.lang AS p, a.text AS c, b.text AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"
_CHOICE_FIRST = rf"""
    WITH x AS (SELECT *, lower(trim(regexp_replace(p, '\s+', ' ', 'g'))) AS k, lower(trim(regexp_replace(c, '\s+', ' ', 'g'))) || chr(0) || lower(trim(regexp_replace(r, '\s+', ' ', 'g'))) AS pair FROM ({_CHOICES})),
    f AS (SELECT k, arg_min(pair, doc_id) AS pair FROM x GROUP BY k)"""


@query(f"{_CHOICE_FIRST} SELECT doc_id, 'conflicting_prompt_pairs' AS code FROM x JOIN f USING (k) WHERE x.pair <> f.pair UNION ALL SELECT doc_id, 'chosen_equals_rejected' FROM x WHERE c = r")
def preference_issues(spark: SparkSession, sf: str) -> DataFrame:
    return preferences.issues(choices(spark, sf)).select(F.col("idx").alias("doc_id"), "code")


@query(f"SELECT count(*) AS record_count, round(avg(length(c)), 6) AS mean_chosen_chars, round(avg(length(r)), 6) AS mean_rejected_chars, round((avg(length(c)) - avg(length(r))) / greatest(1.0, avg(length(r))), 6) AS ratio_vs_rejected, (avg(length(c)) - avg(length(r))) / greatest(1.0, avg(length(r))) > 0.35 AS biased FROM ({_CHOICES})")
def preference_length_bias(spark: SparkSession, sf: str) -> DataFrame:
    got = preferences.length_bias(choices(spark, sf), CONFIG.preference_length_bias_warning_ratio)
    return got.select("record_count", *(F.round(c, 6).alias(c) for c in ("mean_chosen_chars", "mean_rejected_chars", "ratio_vs_rejected")), "biased")


def _schema_sql() -> str:
    fields = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, {v} AS value FROM ({_PROMPTS})" for n, v in (("prompt", "p"), ("completion", "c")))
    tokens = " OR ".join(f"contains(value, '{t}')" for t in schema.SPECIAL_TOKENS)
    return f"""
        WITH f AS (SELECT doc_id, name, value, trim(value, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM ({fields}))
        SELECT doc_id, 'empty_text' AS code, name || ' is empty or whitespace-only' AS message FROM f WHERE s = ''
        UNION ALL SELECT doc_id, 'trivial_text', name || ' is under 3 characters' FROM f WHERE length(s) BETWEEN 1 AND 2
        UNION ALL SELECT doc_id, 'fieldname_as_value', name || ' is identical to the field name' FROM f WHERE lower(s) = name
        UNION ALL SELECT doc_id, 'special_token', name FROM f WHERE {tokens}
        UNION ALL SELECT doc_id, 'null_byte_in_text', name FROM f WHERE contains(value, chr(0))"""


@query(_schema_sql())
def schema_issues(spark: SparkSession, sf: str) -> DataFrame:
    records = prompts(spark, sf)
    return schema.issues(records, formats.file_formats(records)).select(F.col("idx").alias("doc_id"), "code", "message")


@query("SELECT 'documents' AS file, 'raw_text' AS format, least(2000, count(*)) AS sampled FROM documents WHERE doc_id < 2000 UNION ALL SELECT 'conversations', 'openai_chat', count(DISTINCT conv_id) FROM conversations WHERE conv_id < 2000 UNION ALL SELECT 'labelled', 'classification', count(*) FROM documents WHERE doc_id < 2000 UNION ALL SELECT 'prompts', 'prompt_completion', count(*) FROM documents WHERE doc_id < 2000 UNION ALL SELECT 'choices', 'preference_pair', count(*) FROM documents WHERE doc_id < 2000 AND doc_id + 1 IN (SELECT doc_id FROM documents)")
def format_detection(spark: SparkSession, sf: str) -> DataFrame:
    every = texts(spark, sf)
    for f in (talks, labelled, prompts, choices):
        every = every.union(f(spark, sf))
    return formats.file_formats(every).select("file", "format", "sampled")


@query("SELECT pattern, CAST(sum((length(text) - length(replace(text, pattern, ''))) // length(pattern)) AS BIGINT) AS n FROM documents, unnest([" + ", ".join(" || ".join(f"chr({ord(c)})" for c in p) for p in encoding.MOJIBAKE) + "]) p(pattern) GROUP BY pattern")
def mojibake(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select(F.explode(encoding.mojibake_counts(F.col("text"))).alias("m"))
    return found.groupBy("m.pattern").agg(F.sum("m.n").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5('documents ' || doc_id || ' 0') LIMIT 25")
def review_sample(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_sample(texts(spark, sf), CONFIG.random_review_sample, 1, CONFIG.review_seed).select(F.col("idx").alias("doc_id"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normalized, sha256(text) AS text_hash, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')) AS words, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS excerpt FROM documents")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", fn.normalize_space(c).alias("normalized"), fn.text_hash(c).alias("text_hash"), F.size(fn.words(c)).cast("long").alias("words"), fn.estimated_tokens(c).alias("tokens"), fn.bounded(c).alias("excerpt"))


@query(f"""
    SELECT file, CASE max(r) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'OK' END AS severity FROM (
    SELECT 'prompts' AS file, CASE severity WHEN 'CRITICAL' THEN 3 ELSE 2 END AS r FROM (SELECT 'CRITICAL' AS severity FROM ({_PROMPTS}) WHERE trim(c) = '' UNION ALL SELECT 'WARNING' FROM ({_PROMPTS}) WHERE p = c)) GROUP BY file""")
def severity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return completions.issues(prompts(spark, sf)).groupBy("file").agg(worst_column(F.col("severity")).alias("severity"))


@query(rf"SELECT doc_id, code, rn FROM (SELECT doc_id, code, row_number() OVER (ORDER BY doc_id, o) AS rn FROM (SELECT doc_id, 'empty_completion' AS code, 0 AS o FROM ({_PROMPTS}) WHERE trim(c) = '' UNION ALL SELECT doc_id, 'completion_copies_prompt', 1 FROM ({_PROMPTS}) WHERE trim(p) <> '' AND trim(regexp_replace(p, '\s+', ' ', 'g')) = trim(regexp_replace(c, '\s+', ' ', 'g')))) WHERE rn <= 5")
def capped_issues(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.shared import capped

    return capped(completions.issues(prompts(spark, sf)), CONFIG.sample_size).select(F.col("idx").alias("doc_id"), "code", "rn")


@query("SELECT s AS severity, r AS rank FROM (VALUES ('OK', 0), ('INFO', 1), ('WARNING', 2), ('CRITICAL', 3), ('other', 1)) v(s, r)")
def severity_ranks(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([(s,) for s in ("OK", "INFO", "WARNING", "CRITICAL", "other")], "severity string")
    return names.select("severity", rank_column(F.col("severity")).alias("rank"))


QUERIES |= file_queries.QUERIES
ORACLE_SQL |= file_queries.ORACLE_SQL
