"""Secret scan with multipart credential linking.

Base secrets stand alone: labelled values (``assign``), access identifiers
(``access``) and long hex runs (``hex``).  Weak parts are evidence only together:
unlabelled mixed-case tokens of key length (``bare``), account names (``login``)
and endpoints (``endpoint``).  Parts of one document are joined where their
intervals lie within ``SCOPE`` code points of each other (an equi-join on scope
cells of that width, then the exact distance), and a weak part is reported when
its complement is in scope: a bare token with an identifier (access or login) or
an endpoint, a login with a secret (assign or bare), an endpoint with both an
identifier and a secret.  A weak part overlapping an assign value is that value
and no part of its own.

Offsets come from the gaps between matches, summed per document and kind, so the
text itself is read once and never shuffled; only parts are.  Parts of a kind do
not overlap, so a scope cell holds a bounded number of them.

Defined cases: a null text counts as empty; a document without spans has zero
counts and the digest of the empty string; repeated rows are scanned one by one;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankaudit.llm.store import written

SCOPE = 200

#: kind -> (pattern, characters that its deciding group must have, that group).  Fixed values of the contract:
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    "access": (r"AKIA[A-Z0-9]{14,}", 18, 0),
    "hex": (r"[0-9a-f]{16,}", 16, 0),
}
#: Weak parts, after the base kinds in order.
WEAK = {
    "bare": (r"[A-Za-z0-9/+]{40,}", 40, 0),
    "login": (r"""(?i:username|user|login|client_id|account_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 3, 1),
    "endpoint": (r"""https?://[^\x20\x09-\x0D"'<>]+""", 12, 0),
}
KINDS = {**BASE, **WEAK}
ORDER = {kind: i for i, kind in enumerate(KINDS)}


def kind_parts(text: Column, kind: str) -> Column:
    """array<struct<kind, gap, size, ok>> of all matches in order: ``gap`` code points
    since the match before, ``ok`` whether it counts."""
    pattern, least, group = KINDS[kind]
    p = F.lit(pattern)
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else matches

    def part(x: Column) -> Column:
        ok = F.char_length(x["value"]) >= least
        if kind == "bare":  # key length exactly, and upper, lower and digits
            ok = (F.char_length(x["value"]) == least) & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]") & x["value"].rlike("[0-9]")
        return F.struct(
            F.lit(ORDER[kind]).alias("kind"), F.char_length(x["gap"]).cast("long").alias("gap"),
            F.char_length(x["match"]).cast("long").alias("size"), ok.alias("ok"),
        )

    zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value"))
    found = F.transform(F.filter(zipped, lambda x: x["match"].isNotNull()), part)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,ok:boolean>>"))


def located(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the parts that count."""
    parts = scanned.select("row", F.posexplode("parts").alias("pos", "p")).select("row", "pos", "p.*")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return parts.withColumn("end", end).where("ok").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _cells(parts: DataFrame, reach: int) -> DataFrame:
    return parts.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - reach) / SCOPE), F.floor((F.col("end") + reach) / SCOPE))))


def linked_weak(parts: DataFrame) -> DataFrame:
    """The weak parts of ``parts`` whose complement is in scope."""
    base = len(BASE)
    weak, assign = parts.where(F.col("kind") >= base), parts.where(F.col("kind") == ORDER["assign"])

    def near(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
        """Pairs of parts within ``reach`` (0: overlapping), b's columns as b_*."""
        other = _cells(b, 0).select("row", "cell", *[F.col(c).alias(f"b_{c}") for c in ("kind", "start", "end")])
        apart = F.greatest(F.col("b_start") - F.col("end"), F.col("start") - F.col("b_end"))
        return _cells(a, reach).join(other, ["row", "cell"]).where(apart <= reach if reach else apart < 0)

    key = ["row", "kind", "start", "end"]
    weak = written(weak.join(near(weak, assign, 0).select(*key).distinct(), key, "left_anti"), "weak-parts")
    solid = parts.where(F.col("kind") < base)
    kind = F.col("b_kind")
    roles = near(weak, solid.unionByName(weak), SCOPE).groupBy(*key).agg(
        F.max(kind.isin(ORDER["access"], ORDER["login"])).alias("identifier"),
        F.max(kind.isin(ORDER["assign"], ORDER["bare"])).alias("secret"),
        F.max(kind == ORDER["endpoint"]).alias("endpoint"),
    )
    report = (
        F.when(F.col("kind") == ORDER["bare"], F.col("identifier") | F.col("endpoint"))
        .when(F.col("kind") == ORDER["login"], F.col("secret"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return roles.where(report).select(*key)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``found``, the array<struct<start, kind, end>> of
    its base and linked spans, by start and then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
            "doc_id", F.monotonically_increasing_id().alias("row"), F.concat(*[kind_parts(text, k) for k in KINDS]).alias("parts")
        ),
        "secret-parts",
    )
    parts = written(located(scanned.where(F.size("parts") > 0)), "secret-spans")
    found = parts.where(F.col("kind") < len(BASE)).unionByName(linked_weak(parts))
    lists = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scanned.select("doc_id", "row").join(lists, "row", "left").select("doc_id", F.coalesce("found", none).alias("found"))


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    out = scan_secrets(docs)
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(low: int, high: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"].between(low, high))).cast("long")

    return out.select(
        "doc_id",
        *[count(ORDER[k], ORDER[k]).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("found", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count(len(BASE), len(KINDS)).alias("n_linked"),
    )


def _oracle() -> str:
    quoted = {k: p.replace("'", "''") for k, (p, _, _) in KINDS.items()}
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {ORDER[k]} AS kind, string_split_regex(t, '{quoted[k]}') AS gaps,
        regexp_extract_all(t, '{quoted[k]}') AS found, regexp_extract_all(t, '{quoted[k]}', {group}) AS worth, {least} AS least FROM d"""
        for k, (_, least, group) in KINDS.items()
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({each}),
u AS (SELECT doc_id, kind, least, unnest(range(len(found))) AS i, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS m, unnest(worth) AS v FROM k),
o AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM u),
p AS (SELECT doc_id, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM o
  WHERE length(v) >= least AND (kind <> {ORDER["bare"]} OR (length(v) = least
    AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')))),
w AS (SELECT * FROM p WHERE kind >= {len(BASE)} AND NOT EXISTS (SELECT 1 FROM p a
  WHERE a.doc_id = p.doc_id AND a.kind = {ORDER["assign"]} AND a.s < p.e AND p.s < a.e)),
x AS (SELECT * FROM p WHERE kind < {len(BASE)} UNION ALL SELECT * FROM w),
r AS (SELECT w.doc_id, w.kind, w.s, w.e, bool_or(b.kind IN ({ORDER["access"]}, {ORDER["login"]})) AS identifier,
    bool_or(b.kind IN ({ORDER["assign"]}, {ORDER["bare"]})) AS secret, bool_or(b.kind = {ORDER["endpoint"]}) AS endpoint
  FROM w JOIN x b ON w.doc_id = b.doc_id AND greatest(b.s - w.e, w.s - b.e) <= {SCOPE} GROUP BY ALL),
f AS (SELECT doc_id, kind, s, e FROM p WHERE kind < {len(BASE)} UNION ALL
  SELECT doc_id, kind, s, e FROM r WHERE CASE kind WHEN {ORDER["bare"]} THEN identifier OR endpoint
    WHEN {ORDER["login"]} THEN secret ELSE identifier AND secret END),
n AS (SELECT *, concat(['{"', '".join(KINDS)}'][kind + 1], ':', s, ':', e) AS name FROM f),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(name, ',' ORDER BY s, kind, e) FILTER (kind < {len(BASE)}), '') AS base,
    string_agg(name, ',' ORDER BY s, kind, e) AS spans, count(*) FILTER (kind >= {len(BASE)}) AS n_linked FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()
