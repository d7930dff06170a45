r"""Secret scans weighed by corpus-wide ownership.

Candidates are found with one expression a kind, in the JVM; texts without a kind's marker are not searched for it.
Each candidate is known by its SHA-256 only. Over all documents it is counted in how many repositories and by how
many owners it occurs: what MANY_OWNERS owners have is a copied example, what fewer have and looks random is live.
The repository is the source; its owner is the source up to the first slash.

Defined results. Null and empty texts hold nothing. A null source is a repository and an owner of its own, apart from
the empty one; rows without an id are one document. A candidate that occurs several times in a document is one row with its occurrences; repeated rows of one id and source
add up. Kinds are judged apart: a string found as two kinds gives two rows. An empty table gives an empty result.
Other columns are ignored, whatever their names. verdict is placeholder (an example by its look), shared_example,
live or weak (fewer than DIVERSE distinct characters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import materialise

MANY_OWNERS = 3
DIVERSE = 10
#: kind: (markers of which a text must hold one, expression with the secret as group 1), for Java and RE2 alike.
KINDS: dict[str, tuple[tuple[str, ...], str]] = {
    "assigned": (("=", ":"), r"""(?i)(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth)["']?\s*[:=]\s*["']?([A-Za-z0-9+/_\-]{16,})"""),
    "aws": (("AKIA", "ASIA"), r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    "github": (("ghp_", "gho_", "ghs_", "github_pat_"), r"\b((?:gh[pos]_|github_pat_)[A-Za-z0-9_]{20,})"),
    "google": (("AIza",), r"\b(AIza[0-9A-Za-z_\-]{20,})"),
    "slack": (("xox",), r"\b(xox[abprs]-[A-Za-z0-9\-]{10,})"),
    "openai": (("sk-",), r"\b(sk-[A-Za-z0-9_\-]{16,})"),
    "jwt": (("eyJ",), r"\b(eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})"),
    "private_key": (("PRIVATE KEY",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*([A-Za-z0-9+/=]{16,})"),
}
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456789|1234567890"


def _candidates(kind: str) -> Column:
    markers, pattern = KINDS[kind]
    there = F.lit(False)
    for m in markers:
        there = there | F.contains("text", F.lit(m))
    found = F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("secret")))
    return F.when(there, found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, kind, secret_sha256, occurrences (in the document), documents, repositories, owners, verdict."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("repository"))
    every = F.flatten(F.array_compact(F.array(*(_candidates(k) for k in KINDS))))
    found = slim.where(F.col("text").isNotNull()).select("doc_id", "repository", F.explode(every).alias("c"))
    found = materialise(
        found.select(
            "doc_id", "repository", F.substring_index("repository", "/", 1).alias("owner"), "c.kind", F.sha2("c.secret", 256).alias("secret_sha256"),
            F.rlike("c.secret", F.lit(PLACEHOLDER)).alias("placeholder"), F.size(F.array_distinct(F.split("c.secret", ""))).alias("distinct_chars"),
        ),
        "secrets",
    )
    places = found.groupBy("kind", "secret_sha256", "repository", "owner").agg(F.first("placeholder").alias("placeholder"), F.first("distinct_chars").alias("distinct_chars"))
    owned = places.groupBy("kind", "secret_sha256").agg(
        F.count("*").alias("repositories"), (F.countDistinct("owner") + F.max(F.col("owner").isNull().cast("int"))).alias("owners"), F.first("placeholder").alias("placeholder"), F.first("distinct_chars").alias("distinct_chars")
    )
    per_doc = found.groupBy("kind", "secret_sha256", "doc_id").agg(F.count("*").alias("occurrences"))
    documents = per_doc.groupBy("kind", "secret_sha256").agg(F.count("*").alias("documents"))
    verdict = F.when(F.col("placeholder"), "placeholder").when(F.col("owners") >= MANY_OWNERS, "shared_example").when(F.col("distinct_chars") >= DIVERSE, "live").otherwise("weak")
    out = per_doc.join(owned.join(documents, ["kind", "secret_sha256"]), ["kind", "secret_sha256"])
    return out.select("doc_id", "kind", "secret_sha256", "occurrences", "documents", "repositories", "owners", verdict.alias("verdict"))


def oracle_sql() -> str:
    """The same in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(f"SELECT doc_id, source AS repository, '{k}' AS kind, unnest(regexp_extract_all(text, {quote(p)}, 1)) AS secret FROM documents" for k, (_, p) in KINDS.items())
    return f"""
        WITH found AS (SELECT *, sha256(secret) AS secret_sha256, split_part(repository, '/', 1) AS owner FROM ({each})),
        owned AS (SELECT kind, secret_sha256, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS documents,
                         count(DISTINCT repository) + max((repository IS NULL)::INT) AS repositories, count(DISTINCT owner) + max((owner IS NULL)::INT) AS owners,
                         bool_or(regexp_matches(secret, {quote(PLACEHOLDER)})) AS placeholder, max(len(list_distinct(string_split(secret, '')))) AS distinct_chars
                  FROM found GROUP BY ALL)
        SELECT doc_id, kind, secret_sha256, count(*) AS occurrences, documents, repositories, owners,
               CASE WHEN placeholder THEN 'placeholder' WHEN owners >= {MANY_OWNERS} THEN 'shared_example' WHEN distinct_chars >= {DIVERSE} THEN 'live' ELSE 'weak' END AS verdict
        FROM found JOIN owned USING (kind, secret_sha256) GROUP BY ALL"""
