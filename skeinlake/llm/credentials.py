"""Secret scans with corpus-wide ownership: a candidate that many owners have is a copied example, one that a single owner has looks live."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: Forms that are known by themselves, in the subset of syntax that Java and RE2 read alike.
_SHARED = "AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk-"
_REST = "|eyJ[0-9A-Za-z_-]{10,}[.]eyJ[0-9A-Za-z_-]{10,}[.][0-9A-Za-z_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]{20,}"
FORMS = f"{_SHARED}(?:[a-z]{{2,8}}-)?[0-9A-Za-z_-]{{32,}}{_REST}"
#: A key name in any case, bare or quoted and with words joined to it (as in AWS_SECRET_ACCESS_KEY), and what stands between it and its value.
ASSIGNMENT = "(?i:password|passwd|secret|token|api_?key)(?:_[0-9A-Za-z_]{1,30})?[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?"
#: One pattern for all kinds. Assignments come last, so that a known form inside one is taken for itself.
PATTERN = f"{FORMS}|{ASSIGNMENT}[0-9A-Za-z_/+.-]{{12,}}"
ASSIGNED = f"^{ASSIGNMENT}"
#: An assigned value is random-looking if it has so many different characters, a letter, and a digit; or, without a digit, both cases and no joined words.
DIFFERENT, LOOSE = 6, "^[A-Za-z+]{20,}$"
#: Every candidate contains one of these, or its lower-cased text one of LOWER_HINTS; looking for plain text first spares most documents the pattern.
HINTS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk-", "eyJ", "PRIVATE KEY")
LOWER_HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: The forms of the SQL text, which knows neither upper-case, joined or quoted names nor the shape of a value: where there are such the rows differ.
SQL_ASSIGNMENT = "(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey)[ ]{0,3}[=:][ ]{0,3}[\"']?"
SQL_PATTERN, SQL_ASSIGNED = f"{_SHARED}[0-9A-Za-z]{{32,}}{_REST}|{SQL_ASSIGNMENT}[0-9A-Za-z_/+.-]{{12,}}", f"^{SQL_ASSIGNMENT}"
KINDS = (("AKIA", "aws key"), ("gh", "github token"), ("xox", "slack token"), ("AIza", "google key"), ("sk-", "service key"), ("eyJ", "json web token"), ("-----", "private key"))
#: A candidate is a widely copied example from so many distinct owners, or so many distinct repositories of at least two owners, on.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
MASK = "[secret]"
#: Documents with a live credential whose ids and hashes are sent to all executors at most: about 15 MB.
SENT_ROWS = 100_000


def _has(text: Column) -> Column:
    """Whether a text has a candidate."""
    # As a lambda's variable the lower-cased text is made once for all hints.
    lower = F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [t.contains(h) for h in LOWER_HINTS]))
    hint = reduce(or_, [text.contains(h) for h in HINTS]) | lower
    return F.coalesce(hint & text.rlike(PATTERN), F.lit(False))


def _random(value: Column) -> Column:
    """Whether an assigned value looks like a credential rather than like a placeholder, a name or a number."""
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]") | value.rlike(LOOSE) & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT)


def _candidates(text: Column) -> Column:
    """The distinct candidates of a text, as (candidate, secret)."""
    both = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))), lambda c: F.struct(c.alias("candidate"), F.regexp_replace(c, ASSIGNED, "").alias("secret")))
    return F.filter(both, lambda x: (x["candidate"] == x["secret"]) | _random(x["secret"]))


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, repository, owner, secret_hash, kind) of each distinct candidate of each row, written once: only hashes leave the texts."""
    text = F.col("text").cast("string")
    found = docs.where(_has(text)).select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws("/", F.col("source").cast("string"), F.col("lang").cast("string")).alias("repository"), F.col("source").cast("string").alias("owner"), F.explode(_candidates(text)).alias("c"))
    return stored(found.select("doc_id", "repository", "owner", F.sha2("c.secret", 256).alias("secret_hash"), _kind(F.col("c.candidate")).alias("kind")), "secrets")


def _kind(candidate: Column) -> Column:
    kind = F.lit("assignment")
    for prefix, name in reversed(KINDS):
        kind = F.when(candidate.startswith(prefix), F.lit(name)).otherwise(kind)
    return kind


def _ownership(found: DataFrame) -> DataFrame:
    """(secret_hash, n_documents, n_repositories, n_owners, verdict) over the whole corpus. A null owner is no owner."""
    return (
        found.groupBy("secret_hash")
        .agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct(F.when(F.col("owner").isNotNull(), F.col("repository"))).alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))
        .withColumn("verdict", F.when((F.col("n_owners") >= EXAMPLE_OWNERS) | ((F.col("n_owners") >= 2) & (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)), "example").otherwise("live"))
    )


def secret_ownership(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, secret_hash, n_documents, n_repositories, n_owners, verdict), a row for each document and candidate.

    secret_hash is the SHA-256 of the credential itself, so the result discloses none. A document's owner is its source and
    its repository the source with the language. verdict is example or live. Candidates of a document count once, repeated
    rows too. An assigned value that doesn't look random (a placeholder, joined words, a bare number) is no candidate. Rows
    with a null or empty text have no candidates; a null doc_id stays null, and counts as no document; a null source counts
    as no owner, which leaves the candidate live.
    """
    found = _found(docs).distinct()
    return found.join(_ownership(found), "secret_hash").select("doc_id", "kind", "secret_hash", "n_documents", "n_repositories", "n_owners", "verdict").distinct()


def mask_secrets(docs: DataFrame, evidence: DataFrame | None = None, most: int = SENT_ROWS) -> DataFrame:
    """docs with every live-looking credential replaced by MASK in text, n_chars set to the new length; copied examples stay.

    evidence (documents) is what ownership is counted over, besides docs: in a pipeline the raw table, as its copies tell an
    example, and an earlier stage may have taken them away. All rows and columns stay, unshuffled but for those with a
    candidate where documents with a live credential are more than `most`; up to so many their ids and hashes are sent to
    all executors. Null texts and ids pass as they are.
    """
    columns = docs.columns
    found = _found(docs)
    seen = found if evidence is None else found.unionByName(_found(evidence))
    live = _ownership(seen).where("verdict = 'live'").select("secret_hash")
    key, of, has_live = (fresh(docs, name) for name in ("__key", "__of", "__live"))
    by_doc = stored(found.join(live, "secret_hash", "left_semi").groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("secret_hash").alias(has_live)), "secrets-live")
    small = by_doc.count() <= most
    has = F.lit(True) if small else _has(F.col("text").cast("string"))
    joined = docs.where(has).withColumn(key, F.col("doc_id").cast("long")).join(F.broadcast(by_doc) if small else by_doc, F.col(key).eqNullSafe(F.col(of)), "left")
    text = F.col("text").cast("string")
    secrets = F.array_distinct(F.transform(F.filter(_candidates(text), lambda x: F.array_contains(has_live, F.sha2(x["secret"], 256))), lambda x: x["secret"]))
    # Longer ones first: one credential may be part of another.
    ordered = F.array_sort(secrets, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    masked = F.when(F.col(has_live).isNull(), text).otherwise(F.aggregate(ordered, text, lambda t, secret: F.replace(t, secret, F.lit(MASK))))
    masked_docs = joined.withColumn("text", masked)
    if "n_chars" in columns:
        masked_docs = masked_docs.withColumn("n_chars", F.when(F.col(has_live).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    masked_docs = masked_docs.select(*[F.col(f"`{c}`") for c in columns])
    return masked_docs if small else docs.where(~has).unionByName(masked_docs)


ORACLE = f"""
WITH found AS (
  SELECT doc_id, concat_ws('/', source, lang) AS repository, source AS owner, unnest(list_distinct(regexp_extract_all(text, '{SQL_PATTERN.replace("'", "''")}'))) AS candidate
  FROM documents),
hashed AS (
  SELECT DISTINCT doc_id, repository, owner, sha256(regexp_replace(candidate, '{SQL_ASSIGNED.replace("'", "''")}', '')) AS secret_hash,
    CASE {' '.join(f"WHEN starts_with(candidate, '{p}') THEN '{k}'" for p, k in KINDS)} ELSE 'assignment' END AS kind
  FROM found),
owned AS (
  SELECT secret_hash, count(DISTINCT doc_id) AS n_documents, count(DISTINCT CASE WHEN owner IS NOT NULL THEN repository END) AS n_repositories, count(DISTINCT owner) AS n_owners
  FROM hashed GROUP BY secret_hash)
SELECT DISTINCT doc_id, kind, secret_hash, n_documents, n_repositories, n_owners,
  CASE WHEN n_owners >= {EXAMPLE_OWNERS} OR (n_owners >= 2 AND n_repositories >= {EXAMPLE_REPOSITORIES}) THEN 'example' ELSE 'live' END AS verdict
FROM hashed JOIN owned USING (secret_hash)
"""
