"""SQL of the core queries, for any engine that has lists and regular expressions."""

from __future__ import annotations

from codequarry.functions import fulltext, identifiers, sqltext, structure

_CHUNKS = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST) = 1)"
_TAGS = r"""t AS (
    SELECT chunk_id, lower(regexp_replace(tag, '^\s+|\s+$', '', 'g')) AS tag, max(coalesce(weight, 1)) AS weight
    FROM chunk_tags WHERE regexp_replace(tag, '^\s+|\s+$', '', 'g') <> '' GROUP BY ALL)"""
_USABLE = "v AS (SELECT DISTINCT ON (chunk_id) chunk_id, embedding::DOUBLE[] AS e FROM chunks_vec WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))))"


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _knn(scope_before: bool = False, scope_after: bool = False) -> str:
    pool = "(SELECT * FROM v WHERE chunk_id IN (SELECT chunk_id FROM c WHERE scope = 'backend'))" if scope_before else "v"
    after = "AND chunk_id IN (SELECT chunk_id FROM c WHERE scope = 'backend')" if scope_after else ""
    return f"""WITH {_CHUNKS}, {_USABLE}, d AS (
        SELECT q.chunk_id AS query_id, p.chunk_id, list_distance(q.e, p.e) AS distance FROM v AS q CROSS JOIN {pool} AS p WHERE q.chunk_id % 100 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d QUALIFY rank <= 20)
    SELECT COLS FROM r WHERE true {after}"""


def _tokens(expr: str) -> str:
    return rf"regexp_extract_all(translate(lower({expr}), '{fulltext.ACCENTED}', '{fulltext.PLAIN}'), '[\p{{L}}\p{{N}}]+')"


def _bm25(scope: str | None = None) -> str:
    where = f"WHERE chunk_id IN (SELECT chunk_id FROM c WHERE scope = '{scope}')" if scope else ""
    return rf"""{_CHUNKS}, texts AS (
        SELECT chunk_id, 0 AS col, signature AS x FROM c UNION ALL SELECT chunk_id, 1, symbol_name FROM c UNION ALL SELECT chunk_id, 2, content FROM c
    ), lists AS (SELECT chunk_id, col, {_tokens("x")} AS ts FROM texts WHERE x IS NOT NULL),
    p AS (SELECT chunk_id, col, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM lists),
    q AS (SELECT DISTINCT chunk_id AS query_id, symbol_name AS query FROM chunks WHERE chunk_id % 100 = 0 AND symbol_name IS NOT NULL),
    w AS (SELECT query_id, unnest(l) AS term, generate_subscripts(l, 1) AS phrase FROM (SELECT query_id, regexp_extract_all(query, '[\p{{L}}\p{{N}}_]{{2,}}') AS l FROM q)),
    wt AS (SELECT query_id, phrase, upper(term) NOT IN ({_list(fulltext.RESERVED)}) AS pre, {_tokens("term")} AS ts FROM w),
    parts AS (SELECT query_id, phrase, pre, len(ts) AS parts, unnest(ts) AS token, generate_subscripts(ts, 1) AS part FROM wt),
    words AS (SELECT DISTINCT token FROM p),
    x AS (SELECT DISTINCT a.query_id, a.phrase, a.part, a.parts, b.token FROM parts AS a JOIN words AS b
          ON b.token = a.token OR (a.pre AND a.part = a.parts AND starts_with(b.token, a.token))),
    h AS (SELECT query_id, phrase, chunk_id, count(*) AS tf FROM (
            SELECT query_id, phrase, parts, chunk_id, col, pos - part AS start FROM x JOIN p USING (token) GROUP BY ALL HAVING count(DISTINCT part) = parts) GROUP BY ALL),
    df AS (SELECT query_id, phrase, count(*) AS df FROM h GROUP BY ALL),
    dl AS (SELECT chunk_id, count(*) AS dl FROM p GROUP BY ALL),
    st AS (SELECT (SELECT count(DISTINCT chunk_id) FROM chunks)::DOUBLE AS n, (SELECT count(*) FROM p)::DOUBLE AS a),
    s AS (SELECT query_id, chunk_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
            * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (a / n)))) AS score
          FROM h JOIN df USING (query_id, phrase) JOIN dl USING (chunk_id) CROSS JOIN st {where} GROUP BY ALL),
    text_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s QUALIFY rank <= 20)"""


_HYBRID = f"""WITH {_bm25()}, {_USABLE}, near AS (
        SELECT q.chunk_id AS query_id, p.chunk_id, list_distance(q.e, p.e) AS distance FROM v AS q CROSS JOIN v AS p WHERE q.chunk_id IN (SELECT query_id FROM q)
    ), vec_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM near QUALIFY rank <= 20),
    f AS (SELECT query_id, chunk_id, a.rank AS vec_rank, b.rank AS text_rank, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS rrf
          FROM vec_hits AS a FULL JOIN text_hits AS b USING (query_id, chunk_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, vec_rank NULLS LAST, text_rank NULLS LAST, chunk_id) AS rank FROM f QUALIFY rank <= 10)"""


def _related(refs: str, resource_only: bool = False) -> str:
    only = "WHERE starts_with(tag, 'resource:')" if resource_only else ""
    return rf"""WITH {_CHUNKS}, {_TAGS}, tt AS (SELECT * FROM t {only}), r AS ({refs}), w AS (SELECT DISTINCT query_id, tag FROM r JOIN tt USING (chunk_id)),
    s AS (SELECT query_id, chunk_id, sum(weight) AS score FROM w JOIN tt USING (tag) GROUP BY ALL),
    x AS (SELECT s.*, c.file_path, c.start_line FROM s JOIN c USING (chunk_id) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = s.query_id AND r.file_path = c.file_path))
    SELECT query_id, chunk_id, score::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path NULLS FIRST, start_line NULLS FIRST, chunk_id)::INT AS rank FROM x QUALIFY rank <= 20"""


def _words(expr: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({expr}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


def _resource(expr: str) -> str:
    telling = f"list_filter({_words(expr)}, lambda w: w NOT IN ({_list(identifiers.TEST_WORDS + identifiers.STOPWORDS)}) AND regexp_matches(w, '[a-z]'))"
    return f"CASE WHEN length(array_to_string({telling}, '-')) >= 3 THEN array_to_string({telling}, '-') END"


_FRAMEWORK, _STRUCTURAL = _list(identifiers.FRAMEWORK_FILES), _list(identifiers.STRUCTURAL)
_RESOURCES = rf"""{_CHUNKS}, seg AS (SELECT chunk_id, file_path, symbol_name, list_filter(string_split(file_path, '/'), lambda s: s <> '') AS s FROM c WHERE file_path <> ''),
    cut AS (SELECT *, list_concat(s[:len(s) - 1], [string_split(s[len(s)], '.')[1]]) AS k FROM seg),
    fil AS (SELECT *, list_filter(k, lambda s: s NOT IN ({_STRUCTURAL})) AS f, list_filter(k, lambda s: s NOT IN ({_STRUCTURAL}) AND lower(s) NOT IN ({_FRAMEWORK})) AS g FROM cut),
    ends AS (SELECT *, f[-1] AS leaf, f[-2] AS above, g[-2] AS parent, g[-1] AS child, regexp_replace(symbol_name, '(.)(?:{"|".join(identifiers.SUFFIXES)})$', '\1') AS bare FROM fil),
    named AS (SELECT chunk_id, file_path, {_resource("leaf")} AS rl, {_resource("above")} AS ra, {_resource("parent")} AS rp, {_resource("child")} AS rc, {_resource("bare")} AS rs, leaf, above FROM ends),
    listed AS (SELECT chunk_id, file_path, [CASE WHEN lower(leaf) NOT IN ({_FRAMEWORK}) THEN rl WHEN lower(above) NOT IN ({_FRAMEWORK}) THEN ra END,
        CASE WHEN rc IS NOT NULL THEN rp END, CASE WHEN rp IS NOT NULL AND rc IS NOT NULL THEN rp || '-' || rc END, rs] AS l FROM named),
    res AS (SELECT chunk_id, tag, min(n) AS n FROM (SELECT chunk_id, 'resource:' || unnest(l) AS tag, generate_subscripts(l, 1) AS n FROM listed WHERE EXCLUDED) WHERE tag IS NOT NULL GROUP BY ALL)"""
_NOT_VENDORED = "NOT regexp_matches(file_path, '^node_modules/.*$|^vendor/.*$')"

_RULES = r"""list_filter([CASE WHEN regexp_matches(s, '\bcache\w*') THEN 'uses-cache' END, CASE WHEN regexp_matches(s, '(?:throw new|raise) \w+') THEN 'raises' END, CASE WHEN regexp_matches(s, 'receipts?/') THEN 'receipts' END], lambda t: t IS NOT NULL)"""
_LANGUAGE = "CASE regexp_extract(lower(file_path), '(\\.[^.]*)$', 1) " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in structure.LANGUAGES.items()) + " END"
_LOOKUPS = "l AS (SELECT event_id AS lookup_id, sha256(event_type || ' ' || (user_id % 50)) AS query_hash, event_type || ' ' || (user_id % 50) AS query_text, CASE WHEN user_id % 4 = 0 THEN 'v1' ELSE 'v2' END AS version_sha, ts::TIMESTAMP AS ts FROM events)"
_CACHE = f"""{_LOOKUPS}, e AS (SELECT query_hash, query_text, min(version_sha) AS version_sha, min(ts) AS created_at, min(ts) + INTERVAL 24 HOUR AS expires_at, 1 AS hit_count,
    '["' || query_text || '"]' AS result_json FROM l GROUP BY query_hash, query_text), n AS (SELECT max(created_at) AS now FROM e)"""
_SEMANTIC = """every AS (SELECT vec_id AS entry_id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 5 = 0 THEN 'v1' ELSE 'v2' END AS version_sha, CASE WHEN vec_id % 3 = 0 THEN 'backend' END AS scope,
    vec_id % 7 AS hit_count, TIMESTAMP '2026-01-01 00:00:00' + to_minutes((vec_id % 997)::BIGINT) AS created_at FROM embeddings),
    cache AS (SELECT * FROM every QUALIFY row_number() OVER (ORDER BY hit_count DESC, created_at DESC, entry_id DESC) <= 1000)"""
_STATE = "s AS (SELECT * FROM index_ledger WHERE file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY indexed_at DESC NULLS LAST, blob_sha DESC NULLS LAST, signature_hash DESC NULLS LAST, chunk_count DESC NULLS LAST, chunk_hashes_json DESC NULLS LAST) = 1)"
_CHANGES = f"{_STATE}, ch AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.file_path IS NULL THEN 'new' WHEN a.file_path IS NULL THEN 'deleted' WHEN a.file_hash IS NOT DISTINCT FROM b.blob_sha THEN 'unchanged' ELSE 'content-only' END AS change FROM files AS a FULL JOIN s AS b ON a.file_path = b.file_path)"


def _tight(expr: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({expr}, ''), '\s+', ' ', 'g'), ' ?([(){{}}\[\],:;<>]) ?', '\1', 'g'))"


_SIG = f"sha256(array_to_string(list_sort(list_filter([{_tight('chunk_type')}, {_tight('receiver_type')}, {_tight('symbol_name')}, {_tight('signature')}], lambda p: p <> '')), chr(10)))"
_KEY = "chunk_type || ':' || coalesce(symbol_name, '') || CASE WHEN start_line IS NULL THEN '' ELSE ':' || start_line END"


def _score(dialect: str) -> str:
    return " + ".join(f"len(regexp_extract_all(content, '{p}')) * {w}" for p, w in sqltext.DIALECT_MARKS[dialect])


def _features() -> str:
    rows = sqltext.COMMON_FEATURES + sqltext.DIALECT_FEATURES["postgres"]
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN 'sql-feature:{t}' END" for p, t in rows) + "], lambda x: x IS NOT NULL)[:8]"


ORACLES = {
    "knn_search": _knn().replace("COLS", "query_id, chunk_id, round(distance, 5) AS distance, round(greatest(-1.0, least(1.0, 1 - distance * distance / 2)), 5) AS similarity"),
    "knn_scope_after": _knn(scope_after=True).replace("COLS", "query_id, chunk_id, rank::INT AS rank"),
    "knn_scope_before": _knn(scope_before=True).replace("COLS", "query_id, chunk_id, rank::INT AS rank"),
    "bm25_search": f"WITH {_bm25()} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM text_hits",
    "bm25_scope": f"WITH {_bm25('frontend')} SELECT query_id, chunk_id, round(score, 6) AS score FROM text_hits",
    "hybrid_search": f"{_HYBRID} SELECT query_id, chunk_id, file_path, symbol_name, round(rrf, 9) AS rrf, vec_rank::INT AS vec_rank, text_rank::INT AS text_rank, rank::INT AS rank FROM ranked JOIN c USING (chunk_id)",
    "hybrid_by_file": f"{_HYBRID} SELECT query_id, file_path, count(*)::INT AS n, string_agg(chunk_id::VARCHAR, ',' ORDER BY start_line NULLS FIRST, chunk_id) AS chunks FROM ranked JOIN c USING (chunk_id) GROUP BY ALL",
    "fts_query_terms": rf"""SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS n, unnest(l) AS term, upper(unnest(l)) NOT IN ({_list(fulltext.RESERVED)}) AS is_prefix
        FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]{{2,}}') AS l FROM documents WHERE lower(trim(source)) = 'search_query' AND text IS NOT NULL)""",
    "lookup_file": f"WITH {_CHUNKS} SELECT file_path, chunk_id, start_line, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS FIRST, chunk_id)::INT AS place FROM c WHERE file_path IN (SELECT file_path FROM files WHERE file_id % 100 = 0) QUALIFY place <= 100",
    "search_symbol": f"WITH {_CHUNKS} SELECT chunk_id, symbol_name, file_path, start_line FROM c WHERE translate(symbol_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%_rchard%' ORDER BY file_path NULLS FIRST, start_line NULLS FIRST, chunk_id LIMIT 100",
    "search_symbol_exact": f"WITH {_CHUNKS} SELECT chunk_id, symbol_name, file_path, start_line FROM c WHERE symbol_name IN (SELECT symbol_name FROM c WHERE chunk_id % 100 = 0)",
    "related_by_chunk": _related("SELECT chunk_id AS query_id, chunk_id, file_path FROM c WHERE chunk_id % 100 = 0"),
    "related_by_file": _related("SELECT file_id AS query_id, chunk_id, c.file_path FROM c JOIN files ON c.file_path = files.file_path WHERE file_id % 100 = 0"),
    "related_resources": _related("SELECT chunk_id AS query_id, chunk_id, file_path FROM c WHERE chunk_id % 100 = 0", resource_only=True),
    "index_totals": "SELECT (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks, count(*) AS files, max(last_indexed_at) AS last_indexed_at FROM files",
    "index_languages": "SELECT language, count(*) AS n FROM files GROUP BY language",
    "index_health": f"WITH {_CHUNKS}, k AS (SELECT file_path, count(*) AS n FROM c GROUP BY ALL) SELECT files.file_path, coalesce(k.n, 0) <> chunk_count AS count_differs, last_indexed_at < (SELECT max(last_indexed_at) FROM files) - INTERVAL 72 HOUR AS stale FROM files LEFT JOIN k USING (file_path)",
    "vector_dimensions": "SELECT len(embedding)::INT AS dim, count(*) AS n FROM chunks_vec GROUP BY 1",
    "vector_norms": "WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS norm FROM x) SELECT vec_id, round(norm, 5) AS norm, round(CASE WHEN norm = 0 THEN 0 ELSE list_sum(e) / norm END, 5) AS unit_sum FROM n",
    "snippets": f"WITH {_CHUNKS}, x AS (SELECT chunk_id, content, string_split(content, chr(10)) AS l FROM c) SELECT chunk_id, CASE WHEN len(l) > 30 THEN array_to_string(l[:30], chr(10)) || chr(10) || '// ...(truncated)' ELSE content END AS snippet FROM x",
    "long_chunk_parts": f"""WITH {_CHUNKS}, x AS (SELECT *, string_split(content, chr(10)) AS l FROM c WHERE content IS NOT NULL),
        p AS (SELECT *, unnest(CASE WHEN len(l) > 100 THEN range(0, len(l), 100) ELSE [0] END) AS a FROM x)
        SELECT chunk_id, CASE WHEN len(l) > 100 THEN coalesce(symbol_name, '') || '#part' || (a // 100 + 1) ELSE symbol_name END AS symbol_name, (start_line + a)::INT AS start_line,
        md5(CASE WHEN len(l) > 100 THEN array_to_string(l[a + 1:a + 100], chr(10)) ELSE content END) AS digest FROM p""",
    "identifier_words": f"WITH {_CHUNKS} SELECT chunk_id, array_to_string({_words('symbol_name')}, ' ') AS words, array_to_string({_words('symbol_name')}, '-') AS kebab FROM c WHERE symbol_name IS NOT NULL",
    "base_tags": f"WITH {_CHUNKS} SELECT DISTINCT chunk_id, unnest(list_concat([chunk_type], list_filter(string_split(file_path, '/'), lambda s: s IN ({_list(identifiers.BASE_BUCKETS)})))) AS tag FROM c WHERE file_path IS NOT NULL",
    "resource_tags": f"WITH {_RESOURCES.replace('EXCLUDED', _NOT_VENDORED)} SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY n) - 1)::INT AS n, tag, 3 AS weight FROM res",
    "rule_tags": rf"""WITH {_CHUNKS}, x AS (SELECT chunk_id, concat_ws(chr(10), file_path, content) AS s FROM c)
        SELECT chunk_id, unnest({_RULES}) AS tag FROM x""",
    "chunk_tag_rows": rf"""WITH {_RESOURCES.replace('EXCLUDED', 'true')}, x AS (SELECT chunk_id, concat_ws(chr(10), file_path, content) AS s FROM c),
        every AS (SELECT chunk_id, unnest(list_concat([chunk_type], list_filter(string_split(file_path, '/'), lambda s: s IN ({_list(identifiers.BASE_BUCKETS)})))) AS tag FROM c WHERE file_path IS NOT NULL
            UNION ALL SELECT chunk_id, tag FROM res UNION ALL SELECT chunk_id, unnest({_RULES}) FROM x)
        SELECT DISTINCT chunk_id, tag, CASE WHEN starts_with(tag, 'resource:') THEN 3 ELSE 1 END AS weight FROM every WHERE tag IS NOT NULL""",
    "hashed_embeddings": f"""WITH {_CHUNKS}, x AS (SELECT chunk_id, array_to_string(list_filter([signature, doc_comment, content], lambda s: s IS NOT NULL AND s <> ''), chr(10) || chr(10)) AS s FROM c),
        u AS (SELECT chunk_id, list_transform(list_filter(string_split(s, ''), lambda k: k <> ''), lambda k: CASE WHEN unicode(k) < 65536 THEN unicode(k) ELSE 55296 + ((unicode(k) - 65536) >> 10) END::BIGINT) AS l FROM x),
        h AS (SELECT chunk_id, list_reduce(list_prepend(2166136261::BIGINT, l), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS h FROM u)
        SELECT chunk_id, (abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 64 + 1)::BIGINT AS component FROM h""",
    "script_blocks": rf"""WITH {_CHUNKS}, w AS (SELECT chunk_id, '<script>' || chr(10) || content || chr(10) || '</script>' || chr(10) || '<p>' || coalesce(symbol_name, '') || '</p>' AS s FROM c
            WHERE language = 'svelte' AND content IS NOT NULL AND file_path IS NOT NULL),
        b AS (SELECT chunk_id, s, unnest(regexp_extract_all(s, '(?is)<script\b[^>]*>.*?</script\s*>')) AS b FROM w)
        SELECT chunk_id, regexp_matches(regexp_extract(b, '(?is)^<script\b([^>]*)>', 1), '(?i)context\s*=\s*["'']?module|\bmodule\b') AS is_module, length(regexp_extract(b, '(?is)^<script\b[^>]*>(.*?)</script\s*>$', 1))::INT AS n,
            (length(split_part(s, b, 1)) - length(replace(split_part(s, b, 1), chr(10), '')) + 1)::INT AS first_line,
            regexp_replace(regexp_replace(s, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '^\s+|\s+$', '', 'g') AS template FROM b""",
    "clean_tags": f"WITH {_TAGS} SELECT chunk_id, tag, weight FROM t",
    "file_languages": f"SELECT file_path, {_LANGUAGE} AS detected FROM files",
    "glob_matches": r"SELECT file_path FROM files WHERE regexp_matches(file_path, '^src/(?:.*/)?[^/]*\.ts$|^services/[^/]*/src/.*$|^(?:.*/)?api/[^/]*\.go$')",
    "eligible_files": rf"""SELECT file_path, {_LANGUAGE} AS language FROM files WHERE {_LANGUAGE} IN ('typescript', 'javascript', 'go', 'python')
        AND NOT (CASE WHEN regexp_matches(file_path, '\.sql(/.*)?$') THEN true WHEN regexp_matches(file_path, '^services/ocr/.+') THEN false WHEN regexp_matches(file_path, '^services/.+') THEN true
        WHEN regexp_matches(file_path, '^vendor/.*') THEN true WHEN regexp_matches(file_path, '\.min\.js(/.*)?$') THEN true WHEN regexp_matches(file_path, '(^|/)node_modules/') THEN true ELSE false END)""",
    "file_admission": r"SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN octet_length(encode(text)) > 2000 THEN 'too-large' WHEN contains(text, chr(0)) THEN 'binary' ELSE 'ok' END AS reason FROM documents",
    "chunk_signatures": f"WITH {_CHUNKS} SELECT chunk_id, {_KEY} AS key, {_SIG} AS sig, sha256(content) AS content_hash FROM c",
    "file_signatures": f"""WITH {_CHUNKS}, p AS (SELECT file_path, {_tight("chunk_type || ':' || symbol_name || ':' || coalesce(signature, '')")} AS x FROM c WHERE symbol_name IS NOT NULL AND file_path IS NOT NULL)
        SELECT file_path, sha256(array_to_string(list_sort(list(x) FILTER (WHERE x <> '')), chr(10))) AS signature_hash FROM p GROUP BY ALL""",
    "embedding_texts": f"WITH {_CHUNKS}, x AS (SELECT chunk_id, array_to_string(list_filter([signature, doc_comment, content], lambda s: s IS NOT NULL AND s <> ''), chr(10) || chr(10)) AS s FROM c) SELECT chunk_id, md5(s) AS digest, length(s)::INT AS n FROM x",
    "sql_dialects": f"""WITH {_CHUNKS}, x AS (SELECT chunk_id, {", ".join(f"{_score(d)} AS {d}" for d in sqltext.DIALECT_MARKS)} FROM c WHERE language = 'sql' AND content IS NOT NULL),
        y AS (SELECT *, greatest(postgres, mysql, sqlite, mssql) AS best FROM x)
        SELECT chunk_id, CASE WHEN best = 0 OR (postgres = best)::INT + (mysql = best)::INT + (sqlite = best)::INT + (mssql = best)::INT > 1 THEN 'ansi'
        WHEN postgres = best THEN 'postgres' WHEN mysql = best THEN 'mysql' WHEN sqlite = best THEN 'sqlite' ELSE 'mssql' END AS dialect FROM y""",
    "sql_features": f"WITH {_CHUNKS} SELECT chunk_id, unnest({_features()}) AS tag FROM c WHERE content IS NOT NULL",
    "ledger_state": f"WITH {_STATE} SELECT file_path, blob_sha, indexed_at FROM s",
    "streamed_ledger": f"WITH {_STATE} SELECT file_path, blob_sha, indexed_at FROM s",
    "ledger_changes": f"WITH {_CHANGES} SELECT file_path, change FROM ch",
    "run_summary": f"WITH {_CHANGES} SELECT change, count(*) AS n FROM ch GROUP BY ALL",
    "name_status": "SELECT ['A', 'M', 'D', 'R'][file_id % 5 + 1] AS status, CASE WHEN file_id % 5 = 3 THEN 'moved/' || file_path ELSE file_path END AS path, CASE WHEN file_id % 5 = 3 THEN file_path END AS old_path FROM files WHERE file_id % 5 < 4",
    "diff_files_to_index": "WITH x AS (SELECT CASE WHEN file_id % 5 = 3 THEN 'moved/' || file_path ELSE file_path END AS path FROM files WHERE file_id % 5 IN (0, 1, 3)) SELECT DISTINCT path, file_hash AS blob_sha FROM x JOIN files ON path = file_path",
    "renamed_chunks": f"WITH {_CHUNKS} SELECT chunk_id, CASE WHEN f.file_path IS NULL THEN c.file_path ELSE 'moved/' || c.file_path END AS file_path FROM c LEFT JOIN (SELECT file_path FROM files WHERE file_id % 5 = 3) AS f ON f.file_path = c.file_path",
    "remaining_tags": f"WITH {_CHUNKS}, {_TAGS} SELECT t.* FROM t WHERE chunk_id IN (SELECT chunk_id FROM c WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM files WHERE file_id % 5 = 2))",
    "upserted_chunks": """SELECT chunk_id, file_path, symbol_name FROM chunks WHERE symbol_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path, symbol_name, chunk_type, start_line ORDER BY indexed_at DESC NULLS LAST, chunk_id DESC) = 1
        UNION ALL SELECT DISTINCT chunk_id, file_path, symbol_name FROM chunks WHERE symbol_name IS NULL""",
    "replaced_files": f"""WITH {_CHUNKS}, k AS (SELECT chunk_id, file_path, indexed_at, file_path IN (SELECT file_path FROM files WHERE file_id % 100 = 0) AS again FROM c WHERE file_path IS NOT NULL)
        SELECT CASE WHEN again THEN -chunk_id ELSE chunk_id END AS chunk_id, file_path, CASE WHEN again THEN TIMESTAMP '2026-01-01 00:00:00' ELSE indexed_at END AS indexed_at FROM k""",
    "chunk_reuse": f"""WITH {_CHUNKS}, w AS (SELECT *, {_KEY} AS key, {_SIG} AS sig FROM c WHERE file_path IS NOT NULL),
        sh AS (SELECT file_path, sig, chunk_type || ':' || coalesce(symbol_name, '') || CASE WHEN start_line IS NULL THEN '' ELSE ':' || (CASE WHEN chunk_id % 3 = 0 THEN start_line ELSE start_line - 3 END) END AS key FROM w WHERE chunk_id % 7 <> 0),
        o AS (SELECT file_path, key, min(sig) AS sig FROM sh GROUP BY ALL), m AS (SELECT file_path, sig, min(key) AS moved FROM o GROUP BY ALL)
        SELECT chunk_id, w.file_path, w.key, CASE WHEN o.sig = w.sig THEN 'same' WHEN moved IS NOT NULL AND symbol_name IS NOT NULL THEN 'moved' ELSE 'embed' END AS reuse,
        CASE WHEN o.sig = w.sig THEN w.key WHEN moved IS NOT NULL AND symbol_name IS NOT NULL THEN moved END AS source_key
        FROM w LEFT JOIN o ON o.file_path = w.file_path AND o.key = w.key LEFT JOIN m ON m.file_path = w.file_path AND m.sig = w.sig""",
    "chunk_state": f"""WITH {_CHUNKS}, {_STATE}, told AS (SELECT file_path, unnest(from_json(chunk_hashes_json, '[{{"key": "VARCHAR", "sig": "VARCHAR"}}]')) AS x FROM s WHERE chunk_hashes_json IS NOT NULL AND json_valid(chunk_hashes_json)),
        re AS (SELECT file_path, {_KEY} AS key, {_SIG} AS sig FROM c WHERE file_path IN (SELECT file_path FROM s WHERE chunk_hashes_json IS NULL OR NOT json_valid(chunk_hashes_json)))
        SELECT file_path, key, min(sig) AS sig FROM (SELECT file_path, x.key AS key, x.sig AS sig FROM told WHERE x.key IS NOT NULL UNION ALL SELECT * FROM re) GROUP BY ALL""",
    "cache_hits": f"WITH {_CACHE} SELECT lookup_id, result_json, hit_count::BIGINT + 1 AS hit_count FROM l JOIN e USING (query_hash, version_sha) CROSS JOIN n WHERE expires_at > now",
    "cache_counts": f"WITH {_CACHE} SELECT query_hash, (1 + count(l.lookup_id))::BIGINT AS hit_count FROM e LEFT JOIN l USING (query_hash, version_sha) GROUP BY ALL",
    "cache_purged": f"WITH {_CACHE} SELECT query_hash, query_text FROM e CROSS JOIN n WHERE NOT expires_at < now AND version_sha = 'v1'",
    "cache_stats": f"WITH {_CACHE} SELECT count(*) AS entries, count(*) FILTER (WHERE expires_at < now) AS expired, coalesce(sum(hit_count), 0)::BIGINT AS hits FROM e CROSS JOIN n",
    "cache_put": f"""WITH {_CACHE} SELECT query_hash, CASE WHEN version_sha = 'v1' THEN '[]' ELSE result_json END AS result_json, CASE WHEN version_sha = 'v1' THEN 'v3' ELSE version_sha END AS version_sha, hit_count::BIGINT AS hit_count,
        CASE WHEN version_sha = 'v1' THEN TIMESTAMP '2026-01-02 00:00:00' ELSE expires_at END AS expires_at FROM e""",
    "semantic_evicted": f"WITH {_SEMANTIC} SELECT entry_id, hit_count FROM cache QUALIFY row_number() OVER (ORDER BY hit_count DESC, created_at DESC, entry_id DESC) <= 200",
    "semantic_hits": f"""WITH {_SEMANTIC}, p AS (SELECT a.vec_id AS lookup_id, entry_id, list_distance(a.embedding::DOUBLE[], e) AS dist FROM embeddings AS a JOIN cache
            ON version_sha = 'v2' AND scope IS NOT DISTINCT FROM CASE WHEN a.vec_id % 2 = 0 THEN 'backend' END),
        f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY lookup_id ORDER BY dist, entry_id) = 1)
        SELECT lookup_id, entry_id, round(greatest(-1.0, least(1.0, 1 - dist * dist / 2)), 5) AS similarity FROM f WHERE 1 - dist * dist / 2 >= 0.5""",
    "windowed_hits": f"WITH {_LOOKUPS} SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, query_hash, count(*) AS hits FROM l GROUP BY ALL",
}
