"""Independent SQL (DuckDB dialect) for every registered query.

Written from the formulas, not from the Spark code: the adapters (see
``sources/adapters.py``) are restated as CTEs over the driver tables, and every
computed column is aliased and rounded exactly as the Spark side rounds it.
"""

from __future__ import annotations

import re

# Fixed value: the token pattern (same as functions/text.py).
TOKEN = r"[\p{L}\p{N}_]{2,}"
R = 6  # decimals kept on floating outputs (both sides)

NQ = "(SELECT count(*) FROM benchmark)"

CORPUS = (
    "corpus AS (SELECT doc_id AS id, coalesce(text, '') AS paperAbstract, "
    "coalesce(split_part(text, chr(10), 1), '') AS title, coalesce(source, '') AS venue, n_chars "
    "FROM documents)"
)
QUERIES = "queries AS (SELECT item_id AS qid, coalesce(text, '') AS query FROM benchmark)"
JUDGED = (
    f"judged AS (SELECT l.doc_id % {NQ} AS qid, q.query, l.doc_id, CAST(l.quality AS DOUBLE) AS relevance "
    f"FROM labels l JOIN queries q ON q.qid = l.doc_id % {NQ})"
)
KNOWN = "kn AS (SELECT * FROM judged WHERE doc_id IN (SELECT id FROM corpus))"

BASE = [CORPUS, QUERIES, JUDGED, KNOWN]


def toks(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), '{TOKEN}')"


def field_ctes(field: str, a: str, judged_only: bool = True) -> list[str]:
    """Per-field statistics: post_a, len_a, cs_a, terms_a, qt_a, norm_a, c_a."""
    ctes = [
        f"tok_{a} AS (SELECT id, unnest({toks(field)}) AS term FROM corpus)",
        f"post_{a} AS (SELECT id, term, count(*) AS tf FROM tok_{a} GROUP BY id, term)",
        f"len_{a} AS (SELECT id, CAST(len({toks(field)}) AS BIGINT) AS d FROM corpus)",
        f"tstat_{a} AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post_{a} GROUP BY term)",
        f"cs_{a} AS (SELECT (SELECT count(*) FROM corpus) AS n, (SELECT sum(cf) FROM tstat_{a}) AS total)",
        f"terms_{a} AS (SELECT term, df, cf, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf, "
        f"cf / total AS p FROM tstat_{a}, cs_{a})",
        f"qt_{a} AS (SELECT DISTINCT x.qid, x.term, t.df, t.idf, t.p FROM "
        f"(SELECT qid, unnest({toks('query')}) AS term FROM queries) x JOIN terms_{a} t ON t.term = x.term)",
    ]
    scope = "WHERE p.id IN (SELECT doc_id FROM kn)" if judged_only else ""
    ctes.append(
        f"norm_{a} AS (SELECT p.id, sqrt(sum((p.tf * t.idf) * (p.tf * t.idf))) AS norm "
        f"FROM post_{a} p JOIN terms_{a} t ON t.term = p.term {scope} GROUP BY p.id)"
    )
    avg = f"(SELECT CAST(total AS DOUBLE) / n FROM cs_{a})"
    ctes.append(
        f"c_{a} AS (SELECT k.qid, k.doc_id, CAST(coalesce(po.tf, 0) AS DOUBLE) AS tf, q.idf, q.df, q.p, "
        f"CAST(l.d AS DOUBLE) AS d, nm.norm, {avg} AS avgd "
        f"FROM kn k JOIN qt_{a} q ON q.qid = k.qid "
        f"LEFT JOIN post_{a} po ON po.id = k.doc_id AND po.term = q.term "
        f"JOIN len_{a} l ON l.id = k.doc_id LEFT JOIN norm_{a} nm ON nm.id = k.doc_id)"
    )
    ctes.append(
        f"f_{a} AS (SELECT qid, doc_id, sum(tf) AS tf, sum(idf) AS idf, "
        f"sum(CASE WHEN tf > 0 THEN tf * idf / norm ELSE 0.0::DOUBLE END) AS tfidf, "
        f"sum(idf * (tf * (1.2::DOUBLE + 1.0::DOUBLE)) / (tf + 1.2::DOUBLE * (1.0::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * d / avgd))) AS bm25, "
        f"sum(CASE WHEN d > 0 THEN -ln(greatest(tf - 0.7::DOUBLE, 0.0::DOUBLE) / d + 0.7::DOUBLE * df / d * p) ELSE 0.0::DOUBLE END) AS lmir_abs, "
        f"sum(CASE WHEN d > 0 THEN -ln((tf + 2000.0::DOUBLE * p) / (d + 2000.0::DOUBLE)) ELSE 0.0::DOUBLE END) AS lmir_dir, "
        f"sum(CASE WHEN d > 0 THEN -ln((1.0::DOUBLE - 0.1::DOUBLE) * tf / d + 0.1::DOUBLE * p) ELSE 0.0::DOUBLE END) AS lmir_jm "
        f"FROM c_{a} GROUP BY qid, doc_id)"
    )
    return ctes


TEXT_FEATURES = ("tf", "idf", "tfidf", "bm25", "lmir_abs", "lmir_dir", "lmir_jm")
FIELDS = (("paperAbstract", "ab"), ("title", "ti"), ("venue", "ve"))


def with_(ctes: list[str], body: str) -> str:
    """``body`` with those of ``ctes`` that it needs, directly or through others."""
    named = {re.match(r"\w+", c)[0]: c for c in ctes}
    used, look = set(), [body]
    while look:
        new = set(re.findall(r"\w+", look.pop())) & named.keys() - used
        used |= new
        look += [named[n] for n in new]
    kept = [c for n, c in named.items() if n in used]
    return ("WITH " + ",\n".join(kept) + "\n" if kept else "") + body


def rnd(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {R})"


def q_judged_features() -> str:
    ctes = list(BASE)
    for f, a in FIELDS:
        ctes += field_ctes(f, a)
    cols = []
    i = 0
    for _, a in FIELDS:
        for n in TEXT_FEATURES:
            cols.append(f"{rnd(f'coalesce({a}.{n}, 0.0)')} AS f{i:02d}")
            i += 1
    for f, _ in FIELDS:
        cols.append(f"{rnd(f'length(c.{f})')} AS f{i:02d}")
        i += 1
    cols.append(f"{rnd('c.n_chars')} AS f{i:02d}")
    body = (
        "SELECT k.qid, k.doc_id, k.relevance, " + ", ".join(cols) + " FROM kn k "
        "JOIN corpus c ON c.id = k.doc_id "
        + " ".join(f"LEFT JOIN f_{a} {a} ON {a}.qid = k.qid AND {a}.doc_id = k.doc_id" for _, a in FIELDS)
    )
    return with_(ctes, body)


def q_text_feature(name: str) -> str:
    ctes = list(BASE) + field_ctes("paperAbstract", "ab")
    body = (
        f"SELECT k.qid, k.doc_id, {rnd(f'coalesce(ab.{name}, 0.0)')} AS {name} FROM kn k "
        "LEFT JOIN f_ab ab ON ab.qid = k.qid AND ab.doc_id = k.doc_id"
    )
    return with_(ctes, body)


def q_termstat(kind: str) -> str:
    ctes = [CORPUS, QUERIES, JUDGED, KNOWN] + field_ctes("paperAbstract", "ab", judged_only=False)
    bodies = {
        "tokenize": "SELECT id AS doc_id, CAST(unnest(generate_series(1, len(l))) AS BIGINT) AS pos, "
        f"unnest(l) AS term FROM (SELECT id, {toks('paperAbstract')} AS l FROM corpus)",
        "term_counts": "SELECT id AS doc_id, term, tf FROM post_ab",
        "vocabulary": "SELECT term FROM terms_ab",
        "idf": f"SELECT term, df, {rnd('idf')} AS idf FROM terms_ab",
        "tfidf": f"SELECT p.id AS doc_id, p.term, p.tf, {rnd('p.tf * t.idf / n.norm')} AS tfidf "
        "FROM post_ab p JOIN terms_ab t ON t.term = p.term JOIN norm_ab n ON n.id = p.id",
        "doc_length": f"SELECT id AS doc_id, d, {rnd('(SELECT CAST(total AS DOUBLE) / n FROM cs_ab)')} AS avg_d FROM len_ab",
        "collection_stats": f"SELECT term, cf, (SELECT total FROM cs_ab) AS total_tokens, {rnd('p')} AS p FROM terms_ab",
        "index_segments": f"SELECT term, df, cf, {rnd('idf')} AS idf, {rnd('p')} AS p FROM terms_ab",
        "query_terms": "SELECT qid, term, df, " + rnd("idf") + " AS idf FROM qt_ab",
    }
    return with_(ctes, bodies[kind])


def q_search_top_k(k: int = 1) -> str:
    ctes = [CORPUS, QUERIES, JUDGED, KNOWN] + field_ctes("paperAbstract", "ab", judged_only=False)
    ctes.append(
        "sc AS (SELECT q.qid, p.id AS doc_id, sum(p.tf * t.idf / n.norm) AS score FROM qt_ab q "
        "JOIN post_ab p ON p.term = q.term JOIN terms_ab t ON t.term = q.term JOIN norm_ab n ON n.id = p.id "
        "GROUP BY q.qid, p.id)"
    )
    ctes.append(
        f"fb AS (SELECT q.qid, c.id AS doc_id, 0.0::DOUBLE AS score FROM queries q, "
        f"(SELECT id FROM corpus ORDER BY id LIMIT {k}) c)"
    )
    ctes.append(
        "cand AS (SELECT * FROM sc UNION ALL SELECT * FROM fb "
        "WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.qid = fb.qid AND sc.doc_id = fb.doc_id))"
    )
    body = (
        "SELECT qid, rk AS rank, doc_id, " + rnd("score") + " AS score FROM ("
        "SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rk FROM cand) "
        f"WHERE rk <= {k}"
    )
    return with_(ctes, body)


def q_score_corpus() -> str:
    ctes = [CORPUS, QUERIES, JUDGED, KNOWN] + field_ctes("paperAbstract", "ab", judged_only=False)
    ctes.append(
        "sc AS (SELECT q.qid, p.id AS doc_id, sum(p.tf * t.idf / n.norm) AS score FROM qt_ab q "
        "JOIN post_ab p ON p.term = q.term JOIN terms_ab t ON t.term = q.term JOIN norm_ab n ON n.id = p.id "
        "GROUP BY q.qid, p.id)"
    )
    # a document that shares no term with the query scores 0
    body = (
        "SELECT q.qid, c.id AS doc_id, " + rnd("coalesce(sc.score, 0.0)") + " AS score "
        "FROM (SELECT DISTINCT qid FROM queries) q CROSS JOIN (SELECT DISTINCT id FROM corpus WHERE id IS NOT NULL) c "
        "LEFT JOIN sc ON sc.doc_id = c.id AND sc.qid IS NOT DISTINCT FROM q.qid"
    )
    return with_(ctes, body)


def q_feature_len() -> str:
    return with_(
        list(BASE),
        "SELECT k.qid, k.doc_id, CAST(length(c.paperAbstract) AS BIGINT) AS len_abstract, "
        "CAST(length(c.title) AS BIGINT) AS len_title, CAST(length(c.venue) AS BIGINT) AS len_venue "
        "FROM kn k JOIN corpus c ON c.id = k.doc_id",
    )


def q_feature_num() -> str:
    # venue strings ('src12') do not parse -> null; n_chars parses
    return with_(
        list(BASE),
        "SELECT k.qid, k.doc_id, CAST(c.n_chars AS BIGINT) AS num_n_chars, "
        "CASE WHEN regexp_matches(trim(c.venue), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(c.venue) AS BIGINT) END AS num_venue "
        "FROM kn k JOIN corpus c ON c.id = k.doc_id",
    )


def text_sql() -> dict[str, str]:
    out: dict[str, str] = {
        "judged_features": q_judged_features(),
        "search_top_k": q_search_top_k(1),
        "search_top_3": q_search_top_k(3),
        "search_top_k_pruned": q_search_top_k(1),
        "score_corpus": q_score_corpus(),
        "feature_len": q_feature_len(),
        "feature_num": q_feature_num(),
    }
    for n in TEXT_FEATURES:
        out[f"feature_{n}"] = q_text_feature(n)
    for k in ("tokenize", "term_counts", "vocabulary", "idf", "tfidf", "doc_length", "collection_stats", "query_terms", "index_segments"):
        out[k] = q_termstat(k)
    return out


# ---------------------------------------------------------------- bibliographic world
BIB = [
    "li AS (SELECT l_orderkey, count(l_partkey) AS n_in, count(l_suppkey) AS n_out FROM lineitem GROUP BY l_orderkey)",
    "bib AS (SELECT o.o_orderkey AS id, coalesce(o.o_orderpriority, '') AS title, "
    "CAST(year(o.o_orderdate) AS INTEGER) AS year, coalesce(o.o_orderstatus, '') AS venue, "
    "coalesce(c.c_name, '') AS name, o.o_custkey AS author_id, CAST(coalesce(li.n_in, 0) AS INTEGER) AS n_in, "
    "CAST(coalesce(li.n_out, 0) AS INTEGER) AS n_out FROM orders o "
    "LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN li ON li.l_orderkey = o.o_orderkey)",
    "ba AS (SELECT id, n_in, 1 AS pos, 0 AS idpos, name, CAST(author_id AS VARCHAR) AS raw FROM bib WHERE id % 11 <> 0 AND id % 13 <> 0 "
    "UNION ALL SELECT id, n_in, 1, 1, name, 'x' || author_id FROM bib WHERE id % 11 <> 0 AND id % 13 <> 0 AND id % 7 = 0 "
    "UNION ALL SELECT b.id, b.n_in, 1 + row_number() OVER (PARTITION BY b.id ORDER BY s.k), 0, 'Supplier ' || s.k, CAST(s.k + 1000000 AS VARCHAR) "
    "FROM bib b JOIN (SELECT DISTINCT l_orderkey, l_suppkey AS k FROM lineitem) s ON s.l_orderkey = b.id)",
    "au AS (SELECT *, TRY_CAST(raw AS BIGINT) AS aid, CASE WHEN TRY_CAST(raw AS BIGINT) IS NULL THEN raw END AS rk FROM ba)",
    "prof AS (SELECT aid AS corpus_author_id, rk, arg_min(name, {'i': id, 'p': pos, 'q': idpos}) AS name, CAST(sum(n_in) AS BIGINT) AS num_citations, "
    "count(*) AS num_papers, CAST(count_if(n_in >= 10) AS BIGINT) AS i10 FROM au GROUP BY aid, rk)",
    "hx AS (SELECT aid AS corpus_author_id, rk, CAST(max(CASE WHEN n_in >= rn THEN rn ELSE 0 END) AS INTEGER) AS h_index "
    "FROM (SELECT aid, rk, n_in, row_number() OVER (PARTITION BY aid, rk ORDER BY n_in DESC) AS rn FROM au) GROUP BY aid, rk)",
    "auth AS (SELECT p.*, h.h_index, CASE WHEN h.h_index >= 10 THEN 'H' ELSE 'L' END AS h_class "
    "FROM prof p JOIN hx h ON h.corpus_author_id IS NOT DISTINCT FROM p.corpus_author_id AND h.rk IS NOT DISTINCT FROM p.rk)",
    # the corpus records of papers: unique ones only
    "fd AS (SELECT * FROM bib WHERE id % 5 <> 0)",
    "na AS (SELECT b.id, 1 + count(DISTINCT l.l_suppkey) AS n FROM bib b LEFT JOIN lineitem l ON l.l_orderkey = b.id GROUP BY b.id)",
    "pas AS (SELECT DISTINCT u.id, a.corpus_author_id, a.name, a.h_index FROM au u JOIN fd ON fd.id = u.id JOIN auth a ON a.corpus_author_id = u.aid)",
]

JUDGED_TITLES = "jt AS (SELECT l.doc_id, c.title FROM labels l JOIN corpus c ON c.id = l.doc_id)"


def bib_sql() -> dict[str, str]:
    b = list(BIB)
    d = [CORPUS, JUDGED_TITLES]
    return {
        "papers": with_(b, "SELECT id AS paper_sha, title AS paper_title, year AS paper_year, venue AS paper_venue, "
                        "n_in AS n_key_citations, n_out AS n_citations FROM bib"),
        "paper_authors": with_(b, "SELECT id AS paper_sha, aid AS corpus_author_id, CAST(pos AS INTEGER) AS position FROM au"),
        "author_profile": with_(b, "SELECT corpus_author_id, name, num_citations, num_papers, i10 FROM prof"),
        "author_h_index": with_(b, "SELECT corpus_author_id, h_index FROM hx"),
        "author_h_class": with_(b, "SELECT corpus_author_id, name, num_citations, num_papers, i10, h_index, h_class FROM auth"),
        "derive_groups": with_(b, "SELECT corpus_author_id AS author_id, CASE WHEN i10 >= 5 THEN 'i10_5' "
                               "WHEN i10 >= 1 THEN 'i10_1' ELSE 'i10_0' END AS gid FROM prof"),
        "paper_by_idx": with_(d, "SELECT l.doc_id AS doc_idx, c.title, c.venue, c.n_chars FROM labels l JOIN corpus c ON c.id = l.doc_id"),
        "paper_by_sha": with_(d, "SELECT j.title, c.id FROM jt j JOIN corpus c ON c.title = j.title "
                              "WHERE j.title IN (SELECT title FROM corpus GROUP BY title HAVING count(*) = 1)"),
        "paper_with_corpus": with_(b, "SELECT b.id AS paper_sha, b.title AS paper_title, "
                                   "CASE WHEN b.id % 5 <> 0 AND b.id % 9 <> 0 THEN CAST(na.n AS INTEGER) END AS n_authors FROM bib b JOIN na USING (id)"),
        "paper_author_set": with_(b, "SELECT id AS paper_sha, corpus_author_id, h_index FROM pas"),
        "article_record": with_(b, "SELECT b.id AS paper_sha, b.title AS paper_title, b.year AS paper_year, "
                                "b.n_in AS n_key_citations, p.corpus_author_id, p.name, p.h_index FROM bib b LEFT JOIN pas p USING (id)"),
        "sha_to_idx": with_(d, "SELECT j.doc_id, min(c.id) AS doc_idx FROM jt j JOIN corpus c ON c.title = j.title GROUP BY j.doc_id"),
        "judged_doc_ids": with_([QUERIES, JUDGED], "SELECT DISTINCT doc_id FROM judged"),
        "corpus_ids": "SELECT o_orderkey AS doc_id FROM orders",
        "missing_doc_ids": with_([QUERIES, JUDGED], "SELECT DISTINCT doc_id FROM judged j "
                                 "WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = j.doc_id AND o.o_orderstatus = 'F')"),
        "selection_counts": with_([QUERIES, JUDGED], "SELECT count(DISTINCT doc_id) AS total, "
                                  "count(DISTINCT doc_id) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = j.doc_id AND o.o_orderstatus = 'F')) AS missing "
                                  "FROM judged j"),
        "reshape_api_records": with_(b, "SELECT CAST(id AS VARCHAR) AS id, title, year, venue, venue AS journalName, "
                                     "CAST(id AS VARCHAR) AS s2id, n_in, n_out, CAST(na.n AS INTEGER) AS n_authors, "
                                     "CASE WHEN id % 11 <> 0 AND id % 13 <> 0 THEN CAST(author_id AS VARCHAR) END AS first_author "
                                     "FROM bib JOIN na USING (id) WHERE venue = 'F'"),
        "route_responses": with_(b, "SELECT CAST(id AS VARCHAR) AS doc_id, CAST(CASE venue WHEN 'F' THEN 200 WHEN 'O' THEN 429 ELSE 404 END AS INTEGER) AS status_code, "
                                 "CASE venue WHEN 'F' THEN 'corpus' WHEN 'O' THEN 'retry' ELSE 'error' END AS route FROM bib"),
    }


# ---------------------------------------------------------------- ranking world
def rank_ctes(binary: bool, turn: int = 0) -> list[str]:
    """``turn``: feature i weighs 1 / (1 + (i + turn) mod 64)."""
    rel = "label % 2" if binary else "label"
    return [
        f"fr AS (SELECT vec_id AS ord, vec_id // 20 AS qid, vec_id AS doc_id, CAST({rel} AS DOUBLE) AS rel, "
        "CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
        "sc AS (SELECT *, list_sum(list_transform(x, lambda v, i: coalesce(v, 0.0) * (1.0::DOUBLE / ((i - 1 + " + str(turn) + ") % 64 + 1)))) AS score FROM fr)",
        "rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS INTEGER) AS rank FROM sc)",
        "ex AS (SELECT *, coalesce(product(0.5::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE * rel)) OVER "
        "(PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0::DOUBLE) AS exposure FROM rk)",
        "da AS (SELECT DISTINCT d.doc_id, (d.doc_id * 13 + k.k * 17) % (SELECT count(*) FROM customer) AS author_id "
        "FROM documents d, LATERAL (SELECT unnest(generate_series(0, d.doc_id % 3)) AS k) k)",
        "das AS (SELECT * FROM da WHERE author_id IN (SELECT c_custkey FROM customer))",
        "grp AS (SELECT c.c_custkey AS author_id, r.r_name AS gid FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey "
        "JOIN region r ON r.r_regionkey = n.n_regionkey)",
        "ae AS (SELECT a.author_id, sum(e.exposure) AS exposure, sum(0.7::DOUBLE * e.rel) AS relevance FROM ex e JOIN das a ON a.doc_id = e.doc_id GROUP BY a.author_id)",
        "ge AS (SELECT g.gid, sum(coalesce(a.exposure, 0.0)) AS exposure, sum(coalesce(a.relevance, 0.0)) AS relevance "
        "FROM grp g LEFT JOIN ae a ON a.author_id = g.author_id GROUP BY g.gid)",
        "gs AS (SELECT gid, coalesce(exposure / nullif((SELECT sum(exposure) FROM ge), 0), 0.0) AS exposure_share, "
        "coalesce(relevance / nullif((SELECT sum(relevance) FROM ge), 0), 0.0) AS relevance_share FROM ge)",
        "nd AS (SELECT qid, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(irank + 1)) AS idcg FROM "
        "(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS irank FROM rk) GROUP BY qid)",
        "apq AS (SELECT qid, avg(CASE WHEN rel > 0 THEN hits / rank END) AS ap FROM "
        "(SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM rk) GROUP BY qid)",
    ]


def rank_sql() -> dict[str, str]:
    g, b = rank_ctes(False), rank_ctes(True)
    return {
        "rank_documents": with_(g, f"SELECT qid, rank, doc_id, rel, {rnd('score')} AS score FROM rk"),
        "exposure": with_(b, f"SELECT qid, rank, doc_id, rel, {rnd('exposure')} AS exposure FROM ex"),
        "ndcg": with_(g, f"SELECT qid, {rnd('dcg')} AS dcg, {rnd('idcg')} AS idcg, {rnd('CASE WHEN idcg <> 0 THEN dcg / idcg END')} AS ndcg FROM nd"),
        "mean_ndcg": with_(b, f"SELECT 'skip' AS mode, {rnd('avg(CASE WHEN idcg <> 0 THEN dcg / idcg END)')} AS ndcg FROM nd UNION ALL "
                           f"SELECT 'zero', {rnd('avg(CASE WHEN idcg <> 0 THEN dcg / idcg ELSE 0.0 END)')} FROM nd UNION ALL "
                           f"SELECT 'nan', CASE WHEN count(*) FILTER (idcg = 0) > 0 THEN 'NaN'::DOUBLE ELSE {rnd('avg(dcg / idcg)')} END FROM nd"),
        "average_precision": with_(g, f"SELECT qid, {rnd('ap')} AS ap FROM apq"),
        "mean_average_precision": with_(g, f"SELECT {rnd('avg(ap)')} AS map FROM apq"),
        "relevance_utility": with_(b, f"SELECT {rnd('sum(exposure * rel * 0.7::DOUBLE) / count(DISTINCT qid)')} AS utility FROM ex"),
        "author_exposure": with_(b, f"SELECT author_id, {rnd('exposure')} AS exposure, {rnd('relevance')} AS relevance FROM ae"),
        "group_exposure": with_(b, f"SELECT gid, {rnd('exposure')} AS exposure, {rnd('relevance')} AS relevance FROM ge"),
        "group_shares": with_(b, f"SELECT gid, {rnd('exposure_share')} AS exposure_share, {rnd('relevance_share')} AS relevance_share FROM gs"),
        "exposure_fairness": with_(b, f"SELECT {rnd('sqrt(sum(pow(exposure_share - relevance_share, 2)))')} AS fairness FROM gs"),
        "exposure_curve": with_(b, f"SELECT DISTINCT rank, {rnd('pow(0.5, rank - 1) * pow(0.2, rank - 1)')} AS relevant, "
                                f"{rnd('pow(0.5, rank - 1)')} AS irrelevant FROM rk"),
        "tolerance_sweep": " UNION ALL ".join(
            f"SELECT {tol}::DOUBLE AS tol, (" + with_(rank_ctes(True, 16 * k), f"SELECT {rnd('sqrt(sum(pow(exposure_share - relevance_share, 2)))')} FROM gs") + ") AS fairness, ("
            + with_(rank_ctes(True, 16 * k), f"SELECT {rnd('sum(exposure * rel * 0.7::DOUBLE) / count(DISTINCT qid)')} FROM ex") + ") AS utility"
            for tol, k in (("1e-2", 1), ("1e-4", 2), ("1e-6", 3), ("1e-8", 4))),
        "group_share_stack": with_(b + [
            "lg AS (SELECT gid, 'relevance' AS measure, relevance_share AS share FROM gs UNION ALL "
            "SELECT gid, 'exposure', exposure_share FROM gs)",
            "st AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY measure ORDER BY gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bottom FROM lg)",
        ], f"SELECT gid, measure, {rnd('share')} AS share, {rnd('bottom')} AS bottom, {rnd('bottom + share / 2')} AS label_y, "
           "printf('%.1f%%', share * 100) AS label FROM st"),
    }


# ---------------------------------------------------------------- pairs world
def pair_ctes() -> list[str]:
    g = rank_ctes(False)[:2]
    return g + [
        "pr AS (SELECT a.qid, a.ord AS i, b.ord AS j, CAST(sign(a.rel - b.rel) AS INTEGER) AS sign, a.x AS xa, b.x AS xb "
        "FROM fr a JOIN fr b ON a.qid = b.qid AND a.ord < b.ord AND a.rel <> b.rel)",
        "bp AS (SELECT *, CAST(((i * (2 * n - i - 1)) // 2 + (j - i - 1)) % 2 AS INTEGER) AS k_parity FROM pr, (SELECT count(*) AS n FROM fr))",
        "bl AS (SELECT *, CASE WHEN k_parity = 0 THEN 1 ELSE -1 END AS label FROM bp)",
        "bd AS (SELECT *, list_transform(xa, lambda v, m: (coalesce(v, 0.0) - coalesce(xb[m], 0.0)) * CAST(label * sign AS DOUBLE)) AS diff FROM bl)",
        "raw AS (SELECT a.qid, a.ord AS i, b.ord AS j, list_transform(a.x, lambda v, m: coalesce(v, 0.0) - coalesce(b.x[m], 0.0)) AS dx "
        "FROM fr a JOIN fr b ON a.qid = b.qid AND a.ord + 1 = b.ord)",
    ]


def wsum(col: str, dim: int = 64, turn: int = 0) -> str:
    return " + ".join(f"coalesce({col}[{m + 1}], 0.0) * (1.0::DOUBLE / {(m + turn) % dim + 1})" for m in range(dim))


def pair_sql() -> dict[str, str]:
    p = pair_ctes()
    stats = [
        "el AS (SELECT unnest(diff) AS v, unnest(generate_series(1, len(diff))) AS idx FROM bd)",
        "stt AS (SELECT list(mu ORDER BY idx) AS mu, list(sd ORDER BY idx) AS sd FROM (SELECT idx, avg(v) AS mu, "
        "CASE WHEN stddev_pop(v) = 0 THEN 1.0 ELSE stddev_pop(v) END AS sd FROM el GROUP BY idx))",
        "sd AS (SELECT qid, i, j, label, list_transform(diff, lambda v, m: (v - stt.mu[m]) / stt.sd[m]) AS sx FROM bd, stt)",
    ]
    split = [
        "sp AS (SELECT qid, i, j, CASE WHEN row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || i || ':' || j), 1, 15) AS BIGINT), i, j) "
        "<= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM bd)",
    ]
    scored = [
        f"hits AS (SELECT split, CASE WHEN (CASE WHEN ({wsum('sx')}) + 0.1::DOUBLE > 0 THEN 1 ELSE -1 END) = label THEN 1.0 ELSE 0.0 END AS hit "
        "FROM sd JOIN sp USING (qid, i, j))",
    ]
    zero_gradient = "SELECT CAST(i AS INTEGER) AS idx, 0.0::DOUBLE AS gradient FROM range((SELECT max(len(embedding)) + 1 FROM embeddings)) t(i)"
    report = with_(p + stats + split + scored, f"SELECT {rnd('avg(hit)')} AS all_accuracy, "
            f"{rnd(chr(97) + 'vg(hit) FILTER (split = ' + chr(39) + 'test' + chr(39) + ')')} AS test_accuracy, "
            f"{rnd(chr(97) + 'vg(hit) FILTER (split = ' + chr(39) + 'train' + chr(39) + ')')} AS train_accuracy, "
            "count(*) AS n_pairs, count(*) FILTER (split = 'test') AS n_test FROM hits")
    dcols = lambda f: ", ".join(f"{rnd(f(m))} AS d{m:02d}" for m in range(64))
    return {
        "pairwise_diffs": with_(p, "SELECT qid, i, j, sign, " + dcols(lambda m: f"coalesce(xa[{m + 1}], 0.0) - coalesce(xb[{m + 1}], 0.0)") + " FROM pr"),
        "balance_pairs": with_(p, "SELECT qid, i, j, k_parity, label, " + dcols(lambda m: f"diff[{m + 1}]") + " FROM bd"),
        "scale_features": with_(p + stats, "SELECT qid, i, j, " + dcols(lambda m: f"sx[{m + 1}]") + " FROM sd"),
        "split_pairs": with_(p + split, "SELECT qid, i, j, split FROM sp"),
        "fit_rank_svm": zero_gradient,
        "saved_model_report": report,
        "performance_report": report,
        "learning_curve": with_(p + stats + split, " UNION ALL ".join(
            f"SELECT CAST({n} AS BIGINT) AS max_iter, round(avg(CASE WHEN (CASE WHEN ({wsum('sx', turn=16 * k)}) + {0.1 * k}::DOUBLE > 0 THEN 1 ELSE -1 END) = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), {R}) AS accuracy "
            "FROM sd JOIN sp USING (qid, i, j) WHERE split = 'test'" for n, k in ((1, 1), (2, 2), (3, 3), (10, 4), (100000, 4)))),
        "fit_rank_svm_rows": zero_gradient,
        "pair_moments": with_(p + stats, "SELECT CAST(idx - 1 AS INTEGER) AS idx, (SELECT count(*) FROM bd) AS n_pairs, "
            f"{rnd('mu')} AS mean, {rnd('sd')} AS std, (SELECT round(avg(CASE WHEN (CASE WHEN ({wsum('diff')}) + 0.1::DOUBLE > 0 THEN 1 ELSE -1 END) = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), {R}) FROM bd) AS accuracy "
            "FROM (SELECT idx, avg(v) AS mu, stddev_pop(v) AS sd FROM el GROUP BY idx)"),
        "classify_pairs": with_(p, f"SELECT qid, i, j, CASE WHEN ({wsum('diff')}) + 0.1::DOUBLE > 0 THEN 1 ELSE -1 END AS pred FROM bd"),
        "pair_accuracy": with_(p, f"SELECT {rnd(f'avg(CASE WHEN (CASE WHEN ({wsum(chr(100) + chr(105) + chr(102) + chr(102))}) + 0.1::DOUBLE > 0 THEN 1 ELSE -1 END) = label THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM bd"),
        "predict_order": with_(p, "SELECT qid, ord, CAST(row_number() OVER (PARTITION BY qid ORDER BY score, ord) - 1 AS INTEGER) AS position FROM sc"),
        "prefer": with_(p, f"SELECT qid, i, j, CASE WHEN ({wsum('dx')}) + 0.1::DOUBLE > 0 THEN 1 ELSE -1 END AS prefer FROM raw"),
        "preference_margin": with_(p, f"SELECT qid, i, j, {rnd(wsum('dx'))} AS margin FROM raw"),
    }


# ---------------------------------------------------------------- re-ranking world
def rerank_sql() -> dict[str, str]:
    b = rank_ctes(True) + [
        "ends AS (SELECT qid, arg_min(score, rank) AS s_top, arg_max(score, rank) AS s_last FROM rk GROUP BY qid)",
        "rh AS (SELECT r.*, CASE WHEN e.s_top - e.s_last = 0 THEN 'NaN'::DOUBLE ELSE "
        "((r.score - e.s_top) + (e.s_top - e.s_last)) / (2.0::DOUBLE * (e.s_top - e.s_last)) * 2.0::DOUBLE END AS rhat FROM rk r JOIN ends e USING (qid))",
        "exh AS (SELECT *, coalesce(product(0.5::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE * rhat)) OVER "
        "(PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0::DOUBLE) AS eh FROM rh)",
        "w AS (SELECT a.doc_id, g.gid, count(*) AS n FROM das a JOIN grp g ON g.author_id = a.author_id GROUP BY a.doc_id, g.gid)",
        "qg AS (SELECT e.qid, w.gid, sum(e.exposure * w.n) AS E, sum(0.7::DOUBLE * e.rel * w.n) AS R FROM ex e JOIN w ON w.doc_id = e.doc_id GROUP BY e.qid, w.gid)",
        "qt AS (SELECT qid, sum(E) AS te, sum(R) AS tr FROM qg GROUP BY qid)",
        "qf AS (SELECT g.qid, sqrt(sum(pow(CASE WHEN t.te = 0 THEN 'NaN'::DOUBLE ELSE g.E / t.te END - "
        "CASE WHEN t.tr = 0 THEN 'NaN'::DOUBLE ELSE g.R / t.tr END, 2))) AS fairness FROM qg g JOIN qt t USING (qid) GROUP BY g.qid)",
    ]
    # one step per rank: document a is carried, b comes next; whichever stays above is placed
    num = "list_transform(exposed, lambda x, k: x * list_sum(ch) - ch[k] * list_sum(exposed))"
    ssq = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x, k: pow(x / list_sum({v}) - tgt[k], 2))))"
    walk = [
        "gids AS (SELECT list(gid ORDER BY gid) AS g FROM (SELECT DISTINCT gid FROM grp))",
        "dw AS (SELECT doc_id, map_from_entries(list((gid, CAST(n AS DOUBLE)))) AS m FROM w GROUP BY doc_id)",
        "dv AS (SELECT h.qid, h.rank, h.doc_id, h.rel, h.rhat, h.score, 0.5::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE * h.rel) AS f, "
        "0.5::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE * h.rhat) AS fh, "
        "list_transform(gids.g, lambda x: coalesce(element_at(dw.m, x)[1], 0.0::DOUBLE)) AS wt "
        "FROM rh h CROSS JOIN gids LEFT JOIN dw ON dw.doc_id = h.doc_id)",
        "un AS (SELECT v.qid, g.k, sum(e.exposure * v.wt[g.k]) AS ex, sum(0.7::DOUBLE * v.rel * v.wt[g.k]) AS re FROM dv v JOIN ex e USING (qid, rank), "
        "(SELECT unnest(generate_series(1, (SELECT len(g) FROM gids))) AS k) g GROUP BY v.qid, g.k)",
        "ini AS (SELECT qid, list(ex ORDER BY k) AS exposed, list_transform(list(re ORDER BY k), lambda x: x / sum(re)) AS tgt, sum(re) AS tr FROM un GROUP BY qid)",
        "st(qid, i, placed, a, fa, fha, rha, wa, exposed, tgt, ok, e, eh) AS ("
        "SELECT v.qid, 1, CAST(NULL AS BIGINT), v.doc_id, v.f, v.fh, v.rhat, v.wt, i.exposed, i.tgt, i.tr <> 0 AND i.tr IS NOT NULL, 1.0::DOUBLE, 1.0::DOUBLE "
        "FROM dv v JOIN ini i USING (qid) WHERE v.rank = 1 UNION ALL "
        "SELECT qid, i + 1, CASE WHEN sw THEN b ELSE a END, CASE WHEN sw THEN a ELSE b END, CASE WHEN sw THEN fa ELSE fb END, CASE WHEN sw THEN fha ELSE fhb END, "
        "CASE WHEN sw THEN rha ELSE rhb END, CASE WHEN sw THEN wa ELSE wb END, CASE WHEN sw THEN exn ELSE exposed END, tgt, ok, "
        "e * CASE WHEN sw THEN fb ELSE fa END, eh * CASE WHEN sw THEN fhb ELSE fha END FROM ("
        "SELECT *, ok AND gain > 0 AND e * gain - eh * cost > 1e-12 * greatest(abs(e * gain), abs(eh * cost)) AS sw FROM ("
        "SELECT *, CASE WHEN abs(g0) <= 1e-12 * gm THEN 0 ELSE g0 END AS gain, CASE WHEN abs(c0) <= 1e-12 * cm THEN 0 ELSE c0 END AS cost FROM ("
        "SELECT *, list_sum(list_transform(mv, lambda x, k: x * (2 * (exposed[k] / list_sum(exposed) - tgt[k]) - e * x))) / fs AS g0, "
        "list_max(list_transform(mv, lambda x, k: abs(x * 2 * (exposed[k] / list_sum(exposed) - tgt[k])))) / fs AS gm, "
        "0.7::DOUBLE * ((1 - fha) * rhb - (1 - fhb) * rha) AS c0, 0.7::DOUBLE * greatest(abs((1 - fha) * rhb), abs((1 - fhb) * rha)) AS cm FROM ("
        f"SELECT *, list_transform({num}, lambda x, k: CASE WHEN abs(x) <= 1e-12 * greatest(abs(exposed[k] * list_sum(ch)), abs(ch[k] * list_sum(exposed))) THEN 0 ELSE x END "
        f"/ (list_sum(exposed) * list_sum(exn))) AS mv, {ssq('exposed')} + {ssq('exn')} AS fs FROM ("
        "SELECT *, list_transform(exposed, lambda x, k: x + e * ch[k]) AS exn FROM ("
        "SELECT s.*, v.doc_id AS b, v.f AS fb, v.fh AS fhb, v.rhat AS rhb, v.wt AS wb, "
        "list_transform(v.wt, lambda x, k: (1 - s.fa) * x - (1 - v.f) * s.wa[k]) AS ch "
        "FROM st s JOIN dv v ON v.qid = s.qid AND v.rank = s.i + 1)))))))",
        "last AS (SELECT qid, max(i) AS i FROM st GROUP BY qid)",
        "adj AS (SELECT qid, CAST(i - 1 AS INTEGER) AS rank, placed AS doc_id FROM st WHERE i > 1 UNION ALL "
        "SELECT s.qid, CAST(s.i AS INTEGER), s.a FROM st s JOIN last USING (qid, i))",
    ]
    measured = lambda name, src: (
        f"e_{name} AS (SELECT r.qid, r.rank, r.doc_id, v.rel, coalesce(product(0.5::DOUBLE * (1.0::DOUBLE - 0.7::DOUBLE * v.rel)) OVER "
        f"(PARTITION BY r.qid ORDER BY r.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0::DOUBLE) AS exposure FROM {src} r JOIN rk v ON v.qid = r.qid AND v.doc_id = r.doc_id), "
        f"a_{name} AS (SELECT a.author_id, sum(e.exposure) AS exposure, sum(0.7::DOUBLE * e.rel) AS relevance FROM e_{name} e JOIN das a ON a.doc_id = e.doc_id GROUP BY a.author_id), "
        f"g_{name} AS (SELECT g.gid, sum(coalesce(a.exposure, 0.0)) AS x, sum(coalesce(a.relevance, 0.0)) AS r FROM grp g LEFT JOIN a_{name} a ON a.author_id = g.author_id GROUP BY g.gid)"
    )
    row = lambda name: (
        f"SELECT '{name}' AS stage, (SELECT {rnd(f'sqrt(sum(pow(coalesce(x / nullif((SELECT sum(x) FROM g_{name}), 0), 0.0) - coalesce(r / nullif((SELECT sum(r) FROM g_{name}), 0), 0.0), 2)))')} FROM g_{name}) AS fairness, "
        f"(SELECT {rnd('sum(exposure * rel * 0.7::DOUBLE) / count(DISTINCT qid)')} FROM e_{name}) AS utility"
    )
    recursive = lambda ctes, body: with_(ctes, body).replace("WITH ", "WITH RECURSIVE ", 1)
    return {
        "adjust_for_exposure": recursive(b + walk, "SELECT qid, rank, doc_id FROM adj"),
        "adjustment_report": recursive(b + walk + [measured("before", "rk"), measured("after", "adj")], row("before") + " UNION ALL " + row("after")),
        "model_relevance": with_(b, f"SELECT qid, rank, doc_id, {rnd('rhat')} AS rhat FROM rh"),
        "query_model_utility": with_(b, f"SELECT qid, {rnd('sum(eh * rhat * 0.7::DOUBLE)')} AS utility FROM exh GROUP BY qid"),
        "query_exposure_fairness": with_(b, f"SELECT q.qid, {rnd('coalesce(f.fairness, 0.0)')} AS fairness FROM (SELECT DISTINCT qid FROM rk) q LEFT JOIN qf f USING (qid)"),
    }


def io_sql() -> dict[str, str]:
    jf = q_judged_features()
    body = jf.split("\nSELECT ", 1)
    ctes = body[0]
    sel = "SELECT " + body[1]
    return {
        "judged_features_papers": ctes + ", " + ",\n".join(BIB[:2]) + ", jf AS (" + sel + ")\n"
        "SELECT jf.* REPLACE (CAST(b.n_out AS DOUBLE) AS f24) FROM jf JOIN bib b ON b.id = jf.doc_id",
        "ranking_text_roundtrip": ctes + ", jf AS (" + sel + ")\n"
        "SELECT CAST(row_number() OVER (ORDER BY qid, doc_id) - 1 AS BIGINT) AS ord, * FROM jf",
    }


def boundary_sql() -> dict[str, str]:
    records = (
        "rec AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, coalesce(split_part(text, chr(10), 1), '') AS title, coalesce(text, '') AS body, "
        "coalesce(source, '') AS venue, CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, '') ELSE '' END AS journal, CAST(n_chars AS INTEGER) AS year FROM documents)"
    )
    grp = rank_ctes(True)[6]
    return {
        "read_corpus": with_([records], "SELECT id, title, CAST(length(body) AS INTEGER) AS n, venue, journal AS journalName, year, '' AS doi, CAST(NULL AS INTEGER) AS n_authors FROM rec"),
        "read_table_csv": with_([records], "SELECT id, md5(body) AS digest, venue FROM rec"),
        "write_trec_tables": with_(BIB + [
            "kn AS (SELECT corpus_author_id, max(h_index) AS h_index, CAST(sum(num_papers) AS BIGINT) AS num_papers FROM auth GROUP BY corpus_author_id)",
        ], "SELECT a.id AS paper_sha, a.aid AS corpus_author_id, CAST(a.pos AS INTEGER) AS position, b.title AS paper_title, b.n_out AS n_citations, kn.h_index, kn.num_papers "
           "FROM au a JOIN bib b ON b.id = a.id JOIN kn ON kn.corpus_author_id = a.aid"),
        "read_judgements": with_([QUERIES, JUDGED], "SELECT qid, query, row_number() OVER (PARTITION BY qid, query ORDER BY doc_id, relevance) - 1 AS pos, "
                                 "CAST(doc_id AS VARCHAR) AS doc_id, relevance FROM judged"),
        "read_groups": with_([grp], "SELECT author_id, gid FROM grp"),
        "load_inputs": with_([grp], "SELECT 'corpus' AS name, count(*) AS n_rows, least(10, count(*)) AS shown FROM documents UNION ALL "
                             "SELECT 'groups', count(*), least(10, count(*)) FROM grp UNION ALL SELECT 'orders', count(*), least(10, count(*)) FROM orders"),
        "append_corpus": with_([records], "SELECT id, CAST(1 AS BIGINT) AS n, CAST(length(body) AS INTEGER) AS n_chars FROM rec"),
    }


def all_sql() -> dict[str, str]:
    """DuckDB SQL of every registered query that has an oracle."""
    parts = (text_sql, bib_sql, rank_sql, pair_sql, rerank_sql, io_sql, boundary_sql)
    return {name: sql for part in parts for name, sql in part().items()}
