"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Candidates are found by pattern in every whole text. Each candidate value is hashed, and its hash is
counted over distinct owners (source), distinct repositories (source and language) and documents. A value
that several owners or many repositories hold is a copied example; one that a single owner holds in few
repositories, and that looks random, is live; the rest is shared. The verdict decides which spans are added
to the base ones: a candidate of the further shapes is a span only if it is live.

Positions come from marking matches in the text: marks are put around each match, the text is cut at
the marks, and the lengths of the pieces add up to code-point positions. Characters equal to a mark
are first exchanged for another control character, one for one, so positions stay.

Cases: a null text is empty; repeated rows are judged each on its own and give repeated results; a null
source is an owner of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import Stages, read

_OPEN, _MID, _SHUT, _SPARE = "\u0001", "\u0002", "\u0003", "\u0004"

#: The base patterns of the contract. Group 1 is what stands before the secret, group 2 the secret,
#: group 3 what must follow it.
BASE = {
    "assign": "((?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?)([A-Za-z0-9+/_.=-]+)()",
    "access": "()(AKIA[A-Z0-9]+)()",
    "hex": "()([0-9a-f]+)()",
}
#: Further shapes of credentials, beyond the base.
MORE = {
    "bearer": "((?i:bearer)\\x20+)([A-Za-z0-9+/_.=-]{16,})()",
    "jwt": "()(eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,})()",
    "forge": "()(gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})()",
    "url": "(://[^\\s:/@]+:)([^\\s:/@]+)(@)",
}
#: Least length of group 2.
LEAST = {"assign": 6, "access": 20, "hex": 24, "url": 6}
#: Texts of which a match holds one: looked for first, as bytes.
HINTS = {"access": ("AKIA",), "jwt": ("eyJ",), "forge": ("gho_", "ghp_", "ghs_", "ghu_", "xox", "sk_live_"), "url": ("://",)}
KINDS = [*BASE, *MORE]
#: From so many owners or repositories on a value is a copied example; in up to so many repositories of one owner it can be live.
OWNERS_COPIED, REPOSITORIES_COPIED, REPOSITORIES_LIVE = 3, 6, 2
_BLOCK = 256


def _at_least(kind: str) -> str:
    """Runs of one class can carry their least length in the pattern: a shorter run has no longer part."""
    return {"access": "()(AKIA[A-Z0-9]{16,})()", "hex": "()([0-9a-f]{24,})()"}.get(kind) or (BASE | MORE)[kind]


def pieces(text: Column, kind: str) -> Column:
    """Null where nothing matches, else the text's pieces: (length, secret, lead), matches at odd places."""
    marked = F.regexp_replace(text, F.lit(_at_least(kind)), F.lit(f"{_OPEN}$1{_MID}$2{_SHUT}$3"))
    cut = F.split(marked, f"[{_OPEN}{_SHUT}]")
    # inside a match the middle mark divides what stands before from the secret
    piece = lambda x, i: F.when(i % 2 == 0, F.struct(F.length(x).cast("long").alias("n"), F.lit(None).cast("string").alias("secret"))).otherwise(
        F.struct((F.length(x) - 1).cast("long").alias("n"), F.substring_index(x, _MID, -1).alias("secret"))
    )
    found = F.when(F.contains(marked, F.lit(_OPEN)), F.transform(cut, piece))
    hints = [F.contains(text, F.lit(h)) for h in HINTS.get(kind, ())]
    return F.when(reduce(lambda x, y: x | y, hints), found) if hints else found


def spans(parts: Column, kind: str) -> Column:
    """array<struct<start,end,kind,secret>> of the matches in pieces(); block sums keep it near linear."""
    lens = F.transform(parts, lambda p: p["n"])
    n = F.size(parts)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(lens, b * _BLOCK + 1, _BLOCK)))

    def one(i):
        b = F.floor(i / _BLOCK).cast("int")
        start = total(F.slice(blocks, F.lit(1), b)) + total(F.slice(lens, b * _BLOCK + 1, i % _BLOCK))
        p = F.element_at(parts, i + 1)
        return F.struct(start.alias("start"), (start + p["n"]).alias("end"), F.lit(kind).alias("kind"), p["secret"].alias("secret"))

    odd = F.filter(F.sequence(F.lit(0), n - 1), lambda i: i % 2 == 1)
    found = F.filter(F.transform(odd, one), lambda s: F.length(s["secret"]) >= LEAST.get(kind, 1))
    return F.when(parts.isNull(), F.array().cast("array<struct<start:bigint,end:bigint,kind:string,secret:string>>")).otherwise(found)


def scan(docs: DataFrame, stages: Stages) -> DataFrame:
    """uid, doc_id, owner, repository, found: the candidates in order of start, then kind."""
    clean = F.translate(F.coalesce("text", F.lit("")), _OPEN + _MID + _SHUT, _SPARE * 3)
    cut = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", "lang", clean.alias("text")).select("uid", "doc_id", F.coalesce("source", F.lit("")).alias("owner"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("repository"), *[pieces(F.col("text"), k).alias(f"p_{k}") for k in KINDS])
    cut = stages.put(cut, "pieces")
    found = cut.select("uid", "doc_id", "owner", "repository", *[spans(F.col(f"p_{k}"), k).alias(k) for k in KINDS])
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(F.concat(*KINDS), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["secret"].cast("binary"), 256).alias("hash"), looks_live(s["secret"]).alias("random")))
    out = stages.put(found.select("uid", "doc_id", "owner", "repository", F.array_sort(keyed).alias("found")), "spans")
    stages.drop(cut)
    return out


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repositories, documents: how widely each candidate is held (two-step, no key in one task)."""
    each = found.where(F.size("found") > 0).select("owner", "repository", F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash"))
    by_repository = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("documents"))


def looks_live(secret: Column) -> Column:
    """At least 12 characters, of them 6 distinct, and a digit: not a placeholder."""
    return (F.length(secret) >= 12) & (F.size(F.array_distinct(F.split(secret, ""))) >= 6) & secret.rlike("[0-9]")


def join_spans(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def verdict(owners: Column, repositories: Column, random: Column) -> Column:
    copied = (owners >= OWNERS_COPIED) | (repositories >= REPOSITORIES_COPIED)
    return F.when(copied, "copied").when((owners == 1) & (repositories <= REPOSITORIES_LIVE) & random, "live").otherwise("shared")


def judged(found: DataFrame) -> DataFrame:
    """doc_id, base, spans, numbers of distinct secrets by verdict, and counts of the widest held one.

    Every candidate is joined to its hash's one row of counts and gathered by row of the table, so a secret
    that a third of all rows hold only meets that one row; AQE splits such a key.
    """
    held = ownership(found)
    each = found.where(F.size("found") > 0).select("uid", F.explode("found").alias("s")).select("uid", "s", F.col("s.hash").alias("hash"))
    rated = each.join(held, "hash").withColumn("verdict", verdict(F.col("owners"), F.col("repositories"), F.col("s.random")))
    sure = F.struct("s.start", "s.rank", "s.end", "s.kind")
    is_base = F.col("s.kind").isin(*BASE)
    distinct = [F.size(F.collect_set(F.when(F.col("verdict") == v, F.col("hash")))).cast("long").alias(f"n_{v}") for v in ("copied", "live", "shared")]
    widest = [F.max(c).alias(f"most_{c}") for c in ("owners", "repositories", "documents")]
    by_row = rated.groupBy("uid").agg(F.array_sort(F.collect_list(F.when(is_base, sure))).alias("base"), F.array_sort(F.collect_list(F.when(is_base | (F.col("verdict") == "live"), sure))).alias("spans"), *distinct, *widest)
    bare = found.where(F.size("found") == 0).select("doc_id")
    none = bare.select("doc_id", *[F.array().cast(by_row.schema[c].dataType).alias(c) for c in ("base", "spans")], *[F.lit(0).cast("long").alias(c) for c in by_row.columns if c.startswith(("n_", "most_"))])
    some = found.where(F.size("found") > 0).select("uid", "doc_id").join(by_row, "uid").drop("uid")
    return some.unionByName(none)


_COUNTS = ("n_copied", "n_live", "n_shared", "most_owners", "most_repositories", "most_documents")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), Stages(spark, "secrets"))

    def counted(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in BASE]
    return judged(found).select("doc_id", *counts, F.sha2(join_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), join_spans(F.col("spans")).alias("spans"), *_COUNTS)


def _sql() -> str:
    """The same in DuckDB: match by marks, positions by summed lengths, owners and repositories by secret."""
    kinds = []
    for i, kind in enumerate(KINDS):
        pattern = _at_least(kind).replace("'", "''")
        kinds.append(
            f"SELECT doc_id, source, repository, {i} AS rank, '{kind}' AS kind, coalesce(list_sum(list_transform(range(1, k), lambda j: length(parts[j]) - (j % 2 = 0)::INT)), 0)::BIGINT AS start, length(parts[k]) - 1 AS n, regexp_extract(parts[k], '(?s)\\x02(.*)$', 1) AS secret "
            f"FROM (SELECT doc_id, source, repository, parts, unnest(range(2, len(parts) + 1, 2)) AS k FROM (SELECT doc_id, source, repository, string_split_regex(regexp_replace(text, '{pattern}', chr(1) || '\\1' || chr(2) || '\\2' || chr(3) || '\\3', 'g'), '[\\x01\\x03]') AS parts FROM clean))"
        )
    least = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in LEAST.items()) + " ELSE 1 END"
    base = ", ".join(f"'{k}'" for k in BASE)
    one = "kind || ':' || start || ':' || start + n"
    return f"""
WITH clean AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(source, '') || '/' || coalesce(lang, '') AS repository, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)) AS text FROM documents),
s AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(kinds)}) WHERE length(secret) >= {least}),
o AS (SELECT secret, count(DISTINCT source) AS owners, count(DISTINCT repository) AS repositories, count(DISTINCT doc_id) AS documents FROM s GROUP BY secret),
v AS (SELECT s.*, owners, repositories, documents, CASE WHEN owners >= {OWNERS_COPIED} OR repositories >= {REPOSITORIES_COPIED} THEN 'copied' WHEN owners = 1 AND repositories <= {REPOSITORIES_LIVE} AND length(secret) >= 12 AND len(list_distinct(string_split(secret, ''))) >= 6 AND regexp_matches(secret, '[0-9]') THEN 'live' ELSE 'shared' END AS verdict FROM s JOIN o USING (secret)),
d AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, coalesce(string_agg({one}, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '') AS base, coalesce(string_agg({one}, ',' ORDER BY start, rank) FILTER (kind IN ({base}) OR verdict = 'live'), '') AS spans,
  {', '.join(f"count(DISTINCT secret) FILTER (verdict = '{x}') AS n_{x}" for x in ("copied", "live", "shared"))}, {', '.join(f"max({x}) AS most_{x}" for x in ("owners", "repositories", "documents"))} FROM v GROUP BY doc_id)
SELECT x.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, {', '.join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in _COUNTS)}
FROM documents x LEFT JOIN d ON d.doc_id = x.doc_id
"""


QUERIES = {"op8_secrets": op8_secrets}
ORACLE_SQL = {"op8_secrets": _sql()}
