"""SQL counterparts of the registered queries, written for DuckDB over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

REFERENCE = "TIMESTAMP '2001-09-01 00:00:00'"
# Every character the cleaning rule counts as white space (RE2's \\s is ASCII only).
WHITE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
TOKENS = r"regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '{WHITE}', ' ', 'g'))"


def names(x: str) -> str:
    raw = f"CASE WHEN starts_with(ltrim(x), '{{') THEN json_extract_string(x, '$.name') ELSE x END"
    kept = f"list_filter(list_transform(coalesce({x}, []), lambda x: {raw}), lambda x: x IS NOT NULL AND x <> '')"
    return f"list_transform({kept}, lambda x: {clean('x')})"


def log_share(x: str, decades: float) -> str:
    return f"least(1.0::DOUBLE, log10(({x} + 1)::DOUBLE) / {decades}::DOUBLE)"


def activity(commits: str, pulls: str, issues: str, days: str) -> str:
    return (
        f"round(0.35::DOUBLE * {log_share(commits, 4.0)} + 0.25::DOUBLE * {log_share(f'{pulls} + {issues}', 4.0)}"
        f" + 0.40::DOUBLE * exp(-0.0019::DOUBLE * {days}), 4)"
    )


def popularity(stars: str, forks: str) -> str:
    return f"round(0.75::DOUBLE * {log_share(stars, 5.5)} + 0.25::DOUBLE * {log_share(forks, 4.5)}, 4)"


def full_document(nwo: str, desc: str, lang: str, languages: str, topics: str, act: str) -> str:
    others = f"list_filter({languages}, lambda x: x <> {lang})"
    return f"""concat_ws(' | ', 'Repository: ' || {nwo},
        CASE WHEN {lang} <> '' AND {lang} <> 'Unknown' THEN 'Primary Language: ' || {lang} END,
        CASE WHEN len({others}) > 0 THEN 'Languages: ' || array_to_string(({others})[1:5], ', ') END,
        CASE WHEN len({topics}) > 0 THEN 'Topics and tags: ' || array_to_string(({topics})[1:12], ', ') END,
        CASE WHEN {desc} <> '' THEN 'Description: ' || {desc} END,
        CASE WHEN {act} > 0.7 THEN 'Status: Highly active and maintained'
             WHEN {act} < 0.3 THEN 'Status: Inactive or legacy' END)"""


# --- customers as records -------------------------------------------------------------------

RAW = """
o AS (
  SELECT o_custkey, count(*) AS commits,
    count(*) FILTER (o_orderstatus = 'F') AS pulls, count(*) FILTER (o_orderstatus = 'O') AS issues,
    count(*) FILTER (o_orderstatus = 'P') AS forks,
    strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS created_at, max(o_orderdate) AS pushed,
    strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS pushed_at,
    list_sort(list(DISTINCT o_orderstatus)) AS statuses, list_sort(list(DISTINCT o_orderpriority)) AS priorities
  FROM orders GROUP BY o_custkey),
raw AS (
  SELECT c_custkey AS seq, o.*,
    CASE WHEN c_mktsegment = 'FURNITURE' AND c_acctbal < 0 THEN '' ELSE n_name END AS owner,
    CASE WHEN c_mktsegment = 'FURNITURE' AND c_acctbal < 0 THEN NULL ELSE '<i>' || c_name || '</i>' || chr(10) END AS name,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '' WHEN c_mktsegment <> 'FURNITURE' THEN n_name || '/' || c_name END AS nwo,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN
      '<p>Orders &amp; accounts of <b>' || c_name || '</b></p>' || chr(10) || chr(9) || ' in  ' || n_name END AS description,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS segment,
    list_concat(['{"name":"' || c_mktsegment || '","size":1}'],
      list_transform(statuses, lambda x: CASE WHEN x = 'P' THEN x ELSE '{"name":"' || x || '","size":1}' END)) AS languages,
    list_transform(priorities,
      lambda x: CASE WHEN x = '3-MEDIUM' THEN x ELSE '{"name":"' || x || '","size":1}' END) AS topics,
    CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::BIGINT ELSE 0 END AS stars,
    trunc(c_acctbal)::BIGINT AS disk,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Apache <u>License</u> 2.0' END AS license
  FROM customer LEFT JOIN o ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey)"""

IDENTITY = f"coalesce(nullif(nwo, ''), {clean('owner')} || '/' || {clean('name')})"
FRACTION = f"""CASE WHEN pushed IS NULL THEN 1500.0::DOUBLE
    ELSE greatest(0.0::DOUBLE, epoch_us({REFERENCE} - pushed) / 86400000000.0) END"""
DAYS = """CASE WHEN pushed IS NULL THEN 1500.0::DOUBLE
    ELSE greatest(0, date_diff('day', pushed::DATE, DATE '2001-09-01'))::DOUBLE END"""


def curated(days: str = FRACTION, compact: bool = False) -> str:
    if compact:
        document = """'Repository: ' || name_with_owner || ' | Primary Language: ' || primary_language
          || ' | Topics: ' || array_to_string(topics, ', ') || ' | Description: ' || description
          || ' | Stars: ' || stars || ' | Activity: ' || activity_score"""
    else:
        document = full_document(
            "name_with_owner", "description", "primary_language", "languages", "topics", "activity_score"
        )
    return f"""{RAW},
c1 AS (
  SELECT seq AS id, {IDENTITY} AS name_with_owner, {clean('owner')} AS owner, {clean('name')} AS name,
    {clean('description')} AS description, coalesce(segment, 'Unknown') AS primary_language,
    {names('languages')} AS languages, list_transform({names('topics')}, lambda x: lower(x)) AS topics,
    stars, coalesce(forks, 0) AS forks, 0::BIGINT AS watchers, coalesce(pulls, 0) AS pull_requests,
    coalesce(issues, 0) AS issues, coalesce(commits, 0) AS commits, disk AS disk_usage_kb,
    coalesce(pulls > issues, false) AS is_fork, false AS is_archived, created_at, pushed_at,
    nullif({clean('license')}, '') AS license, {days} AS days
  FROM raw WHERE {IDENTITY} <> '/'),
c2 AS (
  SELECT * EXCLUDE (days), {activity('commits', 'pull_requests', 'issues', 'days')} AS activity_score,
    {popularity('stars', 'forks')} AS popularity_score
  FROM c1),
repos AS (SELECT *, {document} AS synthesized_text FROM c2)"""


REPOS = f"WITH {curated()}"
TEXT_LISTS = "* REPLACE (array_to_string(languages, ',') AS languages, array_to_string(topics, ',') AS topics)"

ORACLES |= {
    "clean_html": f"SELECT page_id, {clean('html')} AS clean FROM pages",
    "identity_filter": f"WITH {RAW} SELECT seq, {IDENTITY} AS name_with_owner FROM raw WHERE {IDENTITY} <> '/'",
    "fill_defaults": f"""WITH {RAW} SELECT seq, coalesce(segment, 'Unknown') AS primary_language,
        nullif({clean('license')}, '') AS license, coalesce(pulls > issues, false) AS is_fork, false AS is_archived,
        stars, coalesce(forks, 0) AS forks, 0::BIGINT AS watchers, coalesce(pulls, 0) AS pull_requests,
        coalesce(issues, 0) AS issues, coalesce(commits, 0) AS commits, disk AS disk_usage_kb FROM raw""",
    "unreadable_counts": """SELECT c_custkey AS seq, 'unreadable:stars=' || format('{:,}', floor(c_acctbal)::BIGINT) AS unreadable
        FROM customer WHERE floor(c_acctbal) >= 1000""",
    "mixed_lists": """SELECT 'c/' || c_custkey AS name_with_owner, 'Go,' || c_mktsegment || ',' || c_mktsegment AS languages,
        '{,5' AS topics FROM customer""",
    "nested_names": f"""WITH {RAW} SELECT seq, array_to_string({names('languages')}, ',') AS languages,
        array_to_string(list_transform({names('topics')}, lambda x: lower(x)), ',') AS topics FROM raw""",
    "parse_timestamps": """SELECT event_id, CASE event_type WHEN 'click' THEN epoch_us(ts)
        WHEN 'error' THEN epoch_us(ts) - 7200000000 WHEN 'purchase' THEN epoch_us(ts)
        WHEN 'signup' THEN epoch_us(date_trunc('day', ts)::TIMESTAMP) END AS epoch_us FROM events""",
    "recency_decay": f"""WITH {RAW}, d AS (SELECT seq, {FRACTION} AS days FROM raw)
        SELECT seq, round(days, 6) AS days, round(exp(-0.0019::DOUBLE * days), 6) AS recency FROM d""",
    "recency_decay_days": f"""WITH {RAW}, d AS (SELECT seq, {DAYS} AS days FROM raw)
        SELECT seq, days, round(exp(-0.0019::DOUBLE * days), 6) AS recency FROM d""",
    "activity_score": f"{REPOS} SELECT id, activity_score FROM repos",
    "activity_score_days": f"WITH {curated(DAYS)} SELECT id, activity_score FROM repos",
    "popularity_score": f"{REPOS} SELECT id, popularity_score FROM repos",
    "search_document": f"{REPOS} SELECT id, synthesized_text FROM repos",
    "search_document_compact": f"WITH {curated(compact=True)} SELECT id, synthesized_text FROM repos",
    "curate_records": f"{REPOS} SELECT {TEXT_LISTS} FROM repos",
    "payload_projection": f"""{REPOS} SELECT {TEXT_LISTS.replace('*', '* EXCLUDE (synthesized_text)', 1)} FROM repos""",
    "result_cards": f"""{REPOS} SELECT name_with_owner, 'https://github.com/' || name_with_owner AS url,
        coalesce(nullif(description, ''), 'No description provided.') AS description,
        coalesce(nullif(primary_language, ''), 'Unknown') AS language, stars, forks,
        coalesce(license, 'No license') AS license, activity_score,
        array_to_string(topics[1:10], ',') AS topics FROM repos""",
    "filter_min_stars": "WITH {docs} SELECT * FROM docs WHERE stars >= 1000",
    "filter_language": "WITH {docs} SELECT * FROM docs WHERE primary_language = 'fr'",
    "partitioned_roundtrip": "WITH {docs} SELECT * FROM docs WHERE primary_language = 'de'",
    "format_roundtrip": "WITH {docs} SELECT * FROM docs",
    "lookup_by_key": f"""{REPOS} SELECT id, name_with_owner, stars, activity_score FROM repos
        WHERE name_with_owner = 'NATION_19/Customer#000000001'""",
    "table_stats": f"""{REPOS} SELECT count(*) AS total_repositories, round(coalesce(avg(stars), 0), 2) AS avg_stars,
        round(coalesce(avg(activity_score), 0), 4) AS avg_activity_score FROM repos""",
    "top_languages": f"""{REPOS} SELECT primary_language AS language, count(*) AS count FROM repos
        WHERE primary_language <> 'Unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "distinct_languages": f"""{REPOS} SELECT DISTINCT primary_language AS language FROM repos
        WHERE primary_language NOT IN ('Unknown', '') ORDER BY 1""",
    "stats_record": f"""{REPOS}, top AS (SELECT primary_language AS l, count(*) AS c FROM repos
          WHERE primary_language <> 'Unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
        SELECT count(*) AS total_repositories, round(coalesce(avg(stars), 0), 2) AS avg_stars,
          round(coalesce(avg(activity_score), 0), 4) AS avg_activity_score,
          (SELECT count(*) FROM embeddings) AS indexed_in_search,
          (SELECT string_agg(l || '=' || c, ',' ORDER BY c DESC, l) FROM top) AS top_languages FROM repos""",
    "index_freshness": """WITH c AS (SELECT (SELECT count(*) FROM embeddings) AS indexed,
          (SELECT count(*) FROM documents) AS stored)
        SELECT indexed, stored, NOT (indexed > 0 AND abs(indexed - stored) <= greatest(10, floor(stored * 0.01))) AS stale,
          CASE WHEN indexed > 0 THEN 'ready' ELSE 'warming_up' END AS status FROM c""",
    "metadata_score": "WITH {docs} SELECT id, round({meta_en}, 4) AS metadata_score FROM docs",
}
for _name in ("json_lines_roundtrip", "json_array_roundtrip", "json_array_to_lines"):
    ORACLES[_name] = f"{REPOS} SELECT {TEXT_LISTS.replace('*', '* EXCLUDE (id)', 1)} FROM repos"

PREFIXED = TEXT_LISTS.replace("* REPLACE (", """* EXCLUDE (id) REPLACE ('a "}{][" \\ b' || license AS license, """, 1)
ORACLES["json_array_pretty"] = f"{REPOS} SELECT {PREFIXED} FROM repos"

# --- documents as arrivals ------------------------------------------------------------------

ARRIVALS = f"""
a AS (SELECT doc_id AS seq, source || '/' || n_chars AS name_with_owner, {clean('source')} AS owner,
    doc_id::VARCHAR AS name, {clean('text')} AS description, lang AS primary_language, n_chars AS stars FROM documents),
first AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY name_with_owner ORDER BY seq) = 1),
known AS (SELECT DISTINCT source || '/' || n_chars AS name_with_owner FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels)),
fresh AS (SELECT * FROM first ANTI JOIN known USING (name_with_owner)),
scored AS (SELECT *, {activity('0', '0', '0', '1500.0::DOUBLE')} AS activity_score, {popularity('stars', '0')} AS popularity_score
    FROM first)"""
ARRIVAL_TEXT = full_document("name_with_owner", "description", "primary_language", "[]::VARCHAR[]", "[]::VARCHAR[]", "activity_score")

ORACLES |= {
    "dedupe_first": """SELECT doc_id, source, text FROM documents
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "anti_join_existing": "SELECT doc_id, lang, n_chars FROM documents ANTI JOIN labels USING (doc_id)",
    "ingest_incremental": f"""WITH {ARRIVALS} SELECT scored.*, {ARRIVAL_TEXT} AS synthesized_text
        FROM scored SEMI JOIN fresh USING (seq)""",
    "sample_first_n": f"WITH {ARRIVALS} SELECT seq, name_with_owner, stars FROM fresh ORDER BY seq LIMIT 100",
    "assign_ids": "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS id FROM documents",
    "index_upsert": """SELECT vec_id AS id, label::BIGINT AS value FROM embeddings UNION ALL
        SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "constraint_violations": """WITH d AS (SELECT doc_id, concat_ws(',',
          CASE WHEN lang = 'de' THEN 'required:owner' END,
          CASE WHEN length(text) > 128 THEN 'length:name' END,
          CASE WHEN count(*) OVER (PARTITION BY source, n_chars) > 1 THEN 'unique:name_with_owner' END) AS violations
        FROM documents) SELECT * FROM d WHERE violations <> ''""",
    "batch_loads": f"""WITH {ARRIVALS} SELECT row_number() OVER (ORDER BY seq) AS id, name_with_owner, stars,
        CASE WHEN row_number() OVER (ORDER BY seq) <= 100 THEN 0 ELSE 1 END AS load_id FROM first""",
    "load_report": f"""WITH {ARRIVALS}, n AS (SELECT count(*) AS c, least(100, count(*)) AS h FROM first)
        SELECT 0 AS load_id, 0::BIGINT AS existing, h AS saved, 0::BIGINT AS rejected FROM n
        UNION ALL SELECT 1, h, c - h, 0 FROM n UNION ALL SELECT 2, c, 0, 0 FROM n""",
    "stats_from_loads": f"""WITH {ARRIVALS}, top AS (SELECT primary_language AS l, count(*) AS c FROM scored
          WHERE primary_language <> 'Unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
        SELECT count(*) AS total_repositories, round(coalesce(avg(stars), 0), 2) AS avg_stars,
          round(coalesce(avg(activity_score), 0), 4) AS avg_activity_score,
          (SELECT count(*) FROM embeddings) AS indexed_in_search,
          (SELECT string_agg(l || '=' || c, ',' ORDER BY c DESC, l) FROM top) AS top_languages FROM scored""",
    "job_reruns": f"""WITH {ARRIVALS},
        f AS (SELECT name_with_owner, any_value(stars) AS stars, min(seq) FILTER (seq % 2 = 0) AS even, min(seq) AS any_,
          min(seq) FILTER (seq % 4 = 0) AS fourth FROM a GROUP BY 1)
        SELECT row_number() OVER (ORDER BY even IS NULL, coalesce(even, any_)) AS id, name_with_owner, stars,
          CASE WHEN fourth IS NOT NULL THEN 'a' WHEN even IS NULL THEN 'b' ELSE 'c' END AS load_id FROM f""",
    "stream_loads": f"WITH {ARRIVALS} SELECT name_with_owner, owner, stars FROM first",
    "stream_index_terms": f"""WITH {ARRIVALS},
        t AS (SELECT seq, unnest({TOKENS.format(ARRIVAL_TEXT)}) AS term FROM scored),
        l AS (SELECT seq, count(*) AS n FROM t WHERE term <> '' GROUP BY 1)
        SELECT term, count(DISTINCT t.seq) AS df, (SELECT sum(n)::BIGINT FROM l l2 WHERE l2.seq IN
          (SELECT t2.seq FROM t t2 WHERE t2.term = t.term)) AS total_len FROM t WHERE term <> '' GROUP BY term""",
}

# --- retrieval and search -------------------------------------------------------------------

DOCS = """
docs AS (SELECT doc_id AS id, source || '/' || doc_id AS name_with_owner, lang AS primary_language, n_chars AS stars,
    0.5::DOUBLE * coalesce(quality, 0) + 0.5::DOUBLE * (1 - coalesce(toxic, 0)) AS activity_score,
    CASE WHEN quality IS NOT NULL THEN '2001-0' || (quality + 1) || '-01T00:00:00Z' END AS pushed_at
  FROM documents LEFT JOIN labels USING (doc_id))"""


def metadata(language: str | None = None) -> str:
    bonus = f"CASE WHEN lower(primary_language) = '{language.lower()}' THEN 0.25::DOUBLE ELSE 0 END" if language else "0"
    return (
        f"least(1.0::DOUBLE, 0.5::DOUBLE * {log_share('stars', 5.0)}"
        f" + 0.5::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, activity_score)) + {bonus})"
    )


for _name, _sql in ORACLES.items():
    ORACLES[_name] = _sql.replace("{docs}", DOCS).replace("{meta_en}", metadata("EN"))

TERMS = f"""
tok AS (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS t FROM documents),
tf AS (SELECT id, t, count(*) AS tf FROM tok WHERE t <> '' GROUP BY id, t),
dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t)"""

QUERIES = "q AS (SELECT item_id AS query_id, text, embedding::DOUBLE[] AS qv FROM benchmark JOIN embeddings ON vec_id = item_id)"


def rank(source: str, n: int, name: str) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM {source} QUALIFY rank <= {n})"""


def bm25(idf: bool, where: str = "true", queries: str = "(SELECT item_id AS query_id, text FROM benchmark)") -> str:
    if idf:
        weight = "ln(1 + (st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE))"
    else:
        weight = "qt.tf * 2.2::DOUBLE / (qt.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * qt.ql / st.avgdl))"
    return f"""{TERMS},
qtok AS (SELECT query_id, unnest({TOKENS.format('text')}) AS t FROM {queries}),
qt AS (SELECT query_id, t, count(*) AS tf, sum(count(*)) OVER (PARTITION BY query_id) AS ql
  FROM qtok WHERE t <> '' GROUP BY query_id, t),
bm AS (SELECT query_id, tf.id, round(sum({weight} * (tf.tf * 2.2::DOUBLE
      / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / st.avgdl)))), 6) AS score
  FROM qt JOIN tf USING (t) JOIN df USING (t) JOIN dl ON dl.id = tf.id
    JOIN (SELECT doc_id AS id, lang AS primary_language, n_chars AS stars FROM documents) m ON m.id = tf.id, st
  WHERE {where} GROUP BY query_id, tf.id)"""


def cosine(where: str = "true") -> str:
    return f"""cos AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 6) AS score
  FROM embeddings JOIN (SELECT doc_id, lang AS primary_language, n_chars AS stars FROM documents) m ON doc_id = vec_id, q
  WHERE {where})"""


def search(
    mode: str = "hybrid",
    language: str | None = None,
    min_stars: int = 0,
    sort_by: str = "relevance",
    limit: int = 20,
    offset: int = 0,
    idf: bool = True,
) -> str:
    """CTEs up to ``scored``: every candidate with its scores and position."""
    n = min(offset + limit + 200, 2000)
    where = " AND ".join(
        ([f"primary_language = '{language}'"] if language else []) + ([f"stars >= {min_stars}"] if min_stars else [])
    ) or "true"
    parts = [DOCS, QUERIES]
    if mode != "lexical":
        parts += [cosine(where), rank("cos", n, "dense")]
    if mode != "semantic":
        parts += [bm25(idf, where, "q"), rank("bm", n, "lexical")]
    if mode == "hybrid":
        parts += [
            """fused AS (SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + dense.rank), 0)
              + coalesce(1.0::DOUBLE / (60 + lexical.rank), 0), 10) AS score
              FROM dense FULL JOIN lexical USING (query_id, id))""",
            rank("fused", n, "cand"),
        ]
    else:
        parts.append(f"cand AS (SELECT * FROM {'dense' if mode == 'semantic' else 'lexical'})")
    key = {
        "relevance": "score",
        "stars": "stars",
        "activity": "activity_score",
        "recency": "coalesce(pushed_at, '')",
    }[sort_by]
    lexical = "round(norm, 4)" if mode == "lexical" else "0.0::DOUBLE"
    parts += [
        """norms AS (SELECT query_id, id, rank, (score - min(score) OVER w) / coalesce(nullif(max(score) OVER w
          - min(score) OVER w, 0), 1) AS norm FROM cand WINDOW w AS (PARTITION BY query_id))""",
        f"""blended AS (SELECT query_id, rank, docs.*, round(0.85::DOUBLE * norm + 0.15::DOUBLE * {metadata(language)}, 4) AS score,
          round(norm, 4) AS dense_score, {lexical} AS lexical_score, round({metadata(language)}, 4) AS metadata_score
          FROM norms JOIN docs USING (id))""",
        f"""scored AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {key} DESC, rank, id) AS position
          FROM blended)""",
    ]
    return "WITH " + ", ".join(parts)


HIT = "query_id, position, id, name_with_owner, score, dense_score, lexical_score, metadata_score"


def hits(limit: int = 20, offset: int = 0, **options) -> str:
    found = search(limit=limit, offset=offset, **options)
    return f"{found} SELECT {HIT} FROM scored WHERE position > {offset} AND position <= {offset + limit}"


def summary(mode: str = "hybrid", limit: int = 20, offset: int = 0, **options) -> str:
    return f"""{search(mode=mode, limit=limit, offset=offset, **options)},
        t AS (SELECT query_id, count(*) AS total FROM scored GROUP BY 1)
        SELECT query_id, text AS query, '{mode}' AS mode, coalesce(total, 0) AS total,
          greatest(0, least({limit}, coalesce(total, 0) - {offset})) AS count, {offset} AS "offset", {limit} AS "limit"
        FROM q LEFT JOIN t USING (query_id)"""


ORACLES |= {
    "token_counts": f"WITH {TERMS} SELECT id, t AS term, tf FROM tf",
    "corpus_stats": f"WITH {TERMS} SELECT t AS term, df, n AS n_docs, round(avgdl, 6) AS avg_len FROM df, st",
    "bm25_okapi": f"WITH {bm25(True)}, {rank('bm', 220, 'top')} SELECT query_id, id, score, rank FROM top",
    "bm25_tf_only": f"WITH {bm25(False)}, {rank('bm', 220, 'top')} SELECT query_id, id, score, rank FROM top",
    "query_text": """SELECT item_id, 'Represent this sentence for searching relevant passages: '
        || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS query_text FROM benchmark""",
    "l2_normalise": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings),
        u AS (SELECT vec_id, v, greatest(sqrt(list_dot_product(v, v)), 1e-9) AS norm FROM e)
        SELECT vec_id, i::INTEGER AS pos, round(v[i + 1] / norm, 6) AS x FROM u, unnest(range(len(v))) AS r(i)""",
    "dense_topk": f"WITH {QUERIES}, {cosine()}, {rank('cos', 220, 'top')} SELECT query_id, id, score, rank FROM top",
    "index_rows": f"""WITH {TERMS} SELECT doc_id AS id, len(embedding)::INTEGER AS dim, dl::INTEGER AS doc_len,
        n_terms::INTEGER AS n_terms FROM documents LEFT JOIN embeddings ON vec_id = doc_id
        LEFT JOIN (SELECT tf.id, any_value(dl) AS dl, count(*) AS n_terms FROM tf JOIN dl ON dl.id = tf.id GROUP BY 1) x
          ON x.id = doc_id""",
    "rrf_fusion": f"""WITH {QUERIES}, {cosine()}, {rank('cos', 220, 'dense')}, {bm25(True, queries='q')},
        {rank('bm', 220, 'lexical')}, fused AS (SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + dense.rank), 0)
          + coalesce(1.0::DOUBLE / (60 + lexical.rank), 0), 10) AS score FROM dense FULL JOIN lexical USING (query_id, id))
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused""",
    "minmax_scores": f"""WITH {bm25(True)}, {rank('bm', 220, 'top')} SELECT query_id, id,
        round((score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0), 1), 4) AS norm
        FROM top WINDOW w AS (PARTITION BY query_id)""",
    "search_semantic": hits(mode="semantic"),
    "search_lexical": hits(mode="lexical"),
    "search_lexical_tf": hits(mode="lexical", idf=False),
    "search_hybrid": hits(),
    "search_hybrid_filtered": hits(language="en", min_stars=1000),
    "search_empty": summary(language="tlh"),
    "search_summary": summary(mode="lexical", language="fr", offset=10, limit=50),
    "search_report": f"""{search(limit=3)}, t AS (SELECT query_id, count(*) AS total FROM scored GROUP BY 1)
        SELECT q.query_id, coalesce(total, 0) AS total, position, name_with_owner, primary_language, stars, score,
          dense_score, lexical_score, metadata_score
        FROM q LEFT JOIN t USING (query_id) LEFT JOIN (SELECT * FROM scored WHERE position <= 3) USING (query_id)""",
    "sort_stars": hits(mode="semantic", sort_by="stars"),
    "sort_activity": hits(mode="semantic", sort_by="activity"),
    "sort_recency": hits(mode="semantic", sort_by="recency"),
    "page_slice": hits(mode="semantic", offset=40, limit=20),
    "page_summary": """WITH t AS (SELECT source, count(*) AS total FROM documents GROUP BY 1)
        SELECT source, total, greatest(1, ceil(total / 15.0))::BIGINT AS total_pages, least(31, total) AS start_row,
          least(45, total) AS end_row FROM t""",
}
for same in ("stored_index_search", "search_ann", "index_refresh"):
    ORACLES[same] = ORACLES["search_hybrid"]
ORACLES["page_cursor"] = f"""WITH {QUERIES}, {cosine()}, {rank('cos', 240, 'dense')}, {bm25(True, queries='q')}, {rank('bm', 240, 'lexical')}
    SELECT 'semantic' AS mode, query_id, rank, id, score FROM dense UNION ALL SELECT 'lexical', query_id, rank, id, score FROM lexical"""
ORACLES["stored_search_filtered"] = ORACLES["search_hybrid_filtered"]
ORACLES["dense_topk_floors"] = ORACLES["dense_topk"]
ORACLES["ann_topk_all_cells"] = ORACLES["dense_topk"]
