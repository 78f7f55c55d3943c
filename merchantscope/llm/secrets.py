"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidate spans. Their values' hashes are counted over the corpus by
distinct owners and repositories. A value that many owners hold is a widely copied
example, and so is one that its owners hold in many repositories each, however few they
are; a value that stays in few repositories of few owners and looks live is a credential
of theirs. The method then adds spans of kind ``bare``: places where such an
owner-specific value stands outside any pattern match.

Edge cases: a null text is an empty one; null owners count as one owner, null repositories
of an owner as one repository; repeated rows get a result each (and count once as a
repository); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs of at least so many characters: the same spans as runs that are filtered by length.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Whole tokens that hold a digit; ``bare`` candidates.
TOKEN = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])[A-Za-z0-9+/_.=-]{16,}+"
KINDS = ["assign", "access", "hex", "bare"]
SAMPLE_WORDS = r"(?i)example|sample|dummy|change_?me|placeholder|xxxx|your[_-]|12345678"


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, value) of all matches, in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(F.slice(gap, 1, F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("n"), value.alias("value"))
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,kind:int,end:int,value:string>>))")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["n"]).alias("end"), x["value"].alias("value"))
        return F.struct(
            (start + x["n"]).alias("at"),
            F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    found = F.aggregate(parts, empty, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"))


def _live(value: Column) -> Column:
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(SAMPLE_WORDS)


def candidates(docs: DataFrame, id_: str, text: str, owner: str, repository: str) -> DataFrame:
    """Stored rows: row, doc_id, owner, repository, base and bare spans with hashed values."""
    content = F.coalesce(F.col(text), F.lit(""))
    raw = docs.select(
        F.col(id_).alias("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.concat(_matches(content, ASSIGN, 0, 2, 8), _matches(content, ACCESS, 1), _matches(content, HEX, 2)).alias("base"),
        _matches(content, TOKEN, 3).alias("bare"),
    )
    outside = F.filter("bare", lambda x: _live(x["value"]) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))

    def hashed(spans: Column) -> Column:
        return F.transform(
            spans,
            lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"),
                               F.sha2(x["value"].cast("binary"), 256).alias("hash"), _live(x["value"]).alias("live")),
        )

    return stage_table(
        raw.select("doc_id", "owner", "repository", F.array_sort(hashed(F.col("base"))).alias("base"), hashed(outside).alias("bare"))
        .withColumn("row", F.monotonically_increasing_id()),
        "secret_spans",
    )


def ownership(found: DataFrame, wide_owners: int, wide_repositories: int) -> DataFrame:
    """Per candidate hash: owners, repositories, uses, live and whether it is widely copied.

    Wide is a value of ``wide_owners`` owners or more, or of ``wide_repositories``
    repositories or more for each of its owners on average.
    """
    uses = found.select("owner", "repository", F.explode("base").alias("s")).select("owner", "repository", "s.hash", "s.live")
    by_repository = uses.groupBy("hash", "owner", "repository").agg(F.count("*").alias("uses"), F.max("live").alias("live"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"), F.max("live").alias("live"))
    return by_owner.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses"), F.max("live").alias("live")
    ).withColumn("wide", (F.col("owners") >= wide_owners) | (F.col("repositories") >= F.col("owners") * wide_repositories))


def secret_spans(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", wide_owners: int = 3,
    wide_repositories: int = 20,
) -> DataFrame:
    """Per row: doc_id, base spans, added bare spans, live (owner-specific) and example counts,
    and the most owners and repositories that any value of its spans has (0 without spans)."""
    found = candidates(docs, id_, text, owner, repository)
    verdict = stage_table(ownership(found, wide_owners, wide_repositories), "ownership")
    spans = found.select("row", F.explode(F.concat("base", "bare")).alias("s")).select("row", "s.*")
    judged = spans.join(verdict.select("hash", "owners", "repositories", "wide"), "hash").groupBy("row").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") == 3) & ~F.col("wide"), F.struct("start", "kind", "end")))).alias("added"),
        F.count_if((F.col("kind") != 3) & F.col("wide")).alias("n_example"),
        F.count_if(F.col("live") & ~F.col("wide")).alias("n_live"),
        *[F.max(F.when((F.col("kind") != 3) | ~F.col("wide"), F.col(c))).alias(f"max_{c}") for c in ("owners", "repositories")],
    )
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return found.join(judged, "row", "left").select(
        "doc_id",
        F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("base"),
        F.coalesce("added", none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("max_owners", "max_repositories")],
    )


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op3_ownership_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_example",
        "max_owners",
        "max_repositories",
    )


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
pat AS (SELECT * FROM (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
  (1, 'access', '(AKIA[A-Z0-9]+)', 16), (2, 'hex', '([0-9a-f]{32,})', 32), (3, 'bare', '([A-Za-z0-9+/_.=-]{16,})', 16)) v(k, kind, p, least)),
parts AS (
  SELECT row, k, kind, least, CASE k WHEN 0 THEN regexp_extract_all(t, (SELECT p FROM pat WHERE k = 0), 0)
      WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) WHEN 2 THEN regexp_extract_all(t, '[0-9a-f]{32,}', 0)
      ELSE regexp_extract_all(t, '[A-Za-z0-9+/_.=-]{16,}', 0) END AS m,
    CASE k WHEN 0 THEN regexp_extract_all(t, (SELECT p FROM pat WHERE k = 0), 1)
      WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) WHEN 2 THEN regexp_extract_all(t, '[0-9a-f]{32,}', 0)
      ELSE regexp_extract_all(t, '[A-Za-z0-9+/_.=-]{16,}', 0) END AS v,
    CASE k WHEN 0 THEN string_split_regex(t, (SELECT p FROM pat WHERE k = 0))
      WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]+') WHEN 2 THEN string_split_regex(t, '[0-9a-f]{32,}')
      ELSE string_split_regex(t, '[A-Za-z0-9+/_.=-]{16,}') END AS g
  FROM d, pat),
ex AS (SELECT row, k, kind, least, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM parts WHERE len(m) > 0),
sp AS (
  SELECT row, k, kind, v[i] AS v, least,
    cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
    length(m[i]) AS n FROM ex),
span AS (
  SELECT row, k, kind, s, s + n AS e, v, length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND NOT regexp_matches(v, '(?i)example|sample|dummy|change_?me|placeholder|xxxx|your[_-]|12345678') AS live
  FROM sp WHERE length(v) >= least),
own AS (
  SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, coalesce(doc_id::VARCHAR, ''))) AS repositories,
    count(DISTINCT owner) >= 3 OR count(DISTINCT (owner, coalesce(doc_id::VARCHAR, ''))) >= 20 * count(DISTINCT owner) AS wide
  FROM span JOIN d USING (row) WHERE k < 3 GROUP BY v),
used AS (
  SELECT span.*, owners, repositories, wide FROM span LEFT JOIN own USING (v)
  WHERE k < 3 OR (live AND NOT wide AND NOT EXISTS (SELECT 1 FROM span b WHERE b.row = span.row AND b.k < 3 AND b.s < span.e AND span.s < b.e))),
by_row AS (
  SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
    count(*) FILTER (live AND NOT wide) AS n_live, count(*) FILTER (k < 3 AND wide) AS n_example,
    max(owners) AS max_owners, max(repositories) AS max_repositories
  FROM used GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
  coalesce(max_owners, 0) AS max_owners, coalesce(max_repositories, 0) AS max_repositories
FROM d LEFT JOIN by_row USING (row)
"""
