"""DuckDB SQL that gives what the queries give."""

from __future__ import annotations

from quillmill.functions.text import OMISSION_CUES
from quillmill.plans import queries as q

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOKENS = r"len(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def space(c: str) -> str:
    return strip(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def field(name: str) -> str:
    return f"coalesce(list_filter(map_entries(fields), lambda x: lower(x.key) = '{name}')[1].value, '')"


DOI = strip(r"regexp_replace(regexp_replace(lower({0}), '^https?://(dx\.)?doi\.org/', ''), '^doi:" + WS + "*', '')").replace("{0}", strip(field("doi")))
TITLE = r"lower(trim(regexp_replace(replace(replace(regexp_replace({0}, '\\[A-Za-z]+" + WS + r"*', ' ', 'g'), '{{', ''), '}}', ''), '[^0-9A-Za-z]+', ' ', 'g')))"
TITLE = TITLE.replace("{{", "{").replace("}}", "}").replace("{0}", field("title"))

# blocks without empty ones and neighbours that repeat, then the pieces of each, then chunks
PIECES = rf"""
WITH RECURSIVE raw AS (
  SELECT doc, coalesce(max_chars, 900) AS top, i, {space('blocks[i + 1]')} AS b
  FROM (SELECT *, unnest(range(len(blocks))) AS i FROM block_list)
), kept AS (SELECT * FROM (SELECT *, lag(b) OVER (PARTITION BY doc ORDER BY i) AS before FROM raw WHERE b <> '') WHERE before IS NULL OR before <> b
), s AS (
  SELECT doc, top, i, b, list_filter(string_split(regexp_replace(b, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM kept WHERE length(b) > top
), f AS (
  SELECT doc, top, i, ss, 0 AS k, CAST([] AS VARCHAR[]) AS done, '' AS cur FROM s
  UNION ALL
  SELECT doc, top, i, ss, k + 1,
    CASE WHEN length(ss[k + 1]) > top THEN list_concat(done, CASE WHEN cur <> '' THEN [trim(cur)] ELSE [] END,
           list_transform(range(CAST(ceil(length(ss[k + 1]) / top) AS BIGINT)), lambda j: trim(substring(ss[k + 1], CAST(j * top + 1 AS BIGINT), CAST(top AS BIGINT)))))
         WHEN length(cur) + length(ss[k + 1]) + 1 <= top THEN done ELSE list_append(done, trim(cur)) END,
    CASE WHEN length(ss[k + 1]) > top THEN '' WHEN length(cur) + length(ss[k + 1]) + 1 <= top THEN trim(cur || ' ' || ss[k + 1]) ELSE ss[k + 1] END
  FROM f WHERE k < len(ss)
), pieces AS (
  SELECT doc, top, i, CASE WHEN cur <> '' THEN list_append(done, trim(cur)) ELSE done END AS p FROM f WHERE k = len(ss)
  UNION ALL SELECT doc, top, i, [b] FROM kept WHERE length(b) <= top
), parts AS (SELECT doc, any_value(top) AS top, flatten(list(p ORDER BY i)) AS p FROM pieces GROUP BY doc
), g AS (
  SELECT doc, top, p, 0 AS k, CAST([] AS VARCHAR[]) AS done, '' AS cur FROM parts
  UNION ALL
  SELECT doc, top, p, k + 1,
    CASE WHEN length(cur) + length(p[k + 1]) + 2 <= top OR cur = '' THEN done ELSE list_append(done, cur) END,
    CASE WHEN length(cur) + length(p[k + 1]) + 2 <= top THEN {strip("cur || chr(10) || chr(10) || p[k + 1]")} ELSE p[k + 1] END
  FROM g WHERE k < len(p)
), chunks AS (SELECT doc, CASE WHEN cur <> '' THEN list_append(done, cur) ELSE done END AS c FROM g WHERE k = len(p)
), flat AS (SELECT doc, CAST(n AS INTEGER) AS chunk_no, c[n + 1] AS chunk FROM (SELECT doc, c, unnest(range(len(c))) AS n FROM chunks))
"""

SIDES = """
  SELECT e.*, CASE WHEN s.src_kind IN ('publisher', 'library') THEN 0 ELSE 1 END AS side, lower(coalesce(id, '')) AS key
  FROM bib_entry e LEFT JOIN bib_source s ON e.src = s.src
"""
MERGED = f"""
WITH e AS ({SIDES}), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY side, entry_id) AS k FROM e)
SELECT entry_id, CASE WHEN key = '' THEN 'no_key' WHEN k > 1 THEN 'dup' WHEN side = 0 THEN 'base' ELSE 'added' END AS disposition FROM r
"""
CANONICAL = f"array_to_string(list_transform(list_sort(list_transform(map_entries(fields), lambda x: {{'k': lower(x.key), 'v': {strip('x.value')}}})), lambda x: x.k || '=' || x.v), chr(10)) || chr(1) || {strip("coalesce(entry_type, '')")} || chr(1) || {strip("coalesce(id, '')")}"


def merged_in_order(clash: str) -> str:
    """The merge, an entry at a time: tokens seen, keys taken (latest first) with their entry's content and place. clash: the fate of a taken key with other content."""
    token = lambda kind, v: f"CASE WHEN {v} <> '' THEN [hash('{kind}|' || {v})] ELSE [] END"
    return f"""
WITH RECURSIVE e AS (SELECT *, {DOI} AS d, {TITLE} AS t FROM ({SIDES})
), r AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY side, entry_id) AS k, entry_id, side, coalesce(id, '') AS id, key, hash(key) AS kh, hash({CANONICAL}) AS c,
         list_concat({token('doi', 'd')}, {token('title', 't')}) AS others, {token('key', 'key')} AS own FROM e
), f AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS entry_id, '' AS disposition, '' AS new_id, CAST(NULL AS BIGINT) AS replaces,
         CAST([] AS UBIGINT[]) AS seen, CAST([] AS UBIGINT[]) AS pk, CAST([] AS UBIGINT[]) AS pc, CAST([] AS BIGINT[]) AS pl
  UNION ALL
  SELECT k, entry_id, disposition, new_id, CASE WHEN disposition = 'replaced' THEN pl[spot] END,
         CASE WHEN publishes THEN list_concat(seen, others, CASE WHEN disposition = 'renamed' THEN [hash('key|' || lower(new_id))] ELSE own END) ELSE seen END,
         CASE WHEN publishes THEN list_prepend(CASE WHEN disposition = 'renamed' THEN hash(lower(new_id)) ELSE kh END, pk) ELSE pk END,
         CASE WHEN publishes THEN list_prepend(c, pc) ELSE pc END,
         CASE WHEN publishes THEN list_prepend(CASE WHEN disposition = 'replaced' THEN pl[spot] ELSE entry_id END, pl) ELSE pl END
  FROM (
    SELECT *, disposition IN ('base', 'added', 'replaced', 'renamed') AS publishes,
           CASE WHEN disposition = 'renamed' THEN id || '_2' || list_filter(list_transform(range(1, 200), lambda n: CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END), lambda x: NOT list_contains(pk, hash(lower(id || '_2' || x))))[1] ELSE id END AS new_id
    FROM (
      SELECT *, CASE WHEN key = '' THEN 'no_key' WHEN side = 0 THEN CASE WHEN spot > 0 THEN 'dup' ELSE 'base' END
                     WHEN spot = 0 THEN CASE WHEN list_has_any(seen, list_concat(others, own)) THEN 'dup' ELSE 'added' END
                     WHEN pc[spot] = c THEN 'dup' ELSE '{clash}' END AS disposition
      FROM (SELECT r.*, f.seen, f.pk, f.pc, f.pl, coalesce(list_position(f.pk, r.kh), 0) AS spot FROM f JOIN r ON r.k = f.k + 1)
    )
  )
)
SELECT entry_id, disposition, new_id, replaces FROM f WHERE k > 0
"""


PAGES = """
  SELECT doc, i AS place, pages[i + 1] AS p FROM (SELECT doc, pages, unnest(range(len(pages))) AS i FROM ocr_response) WHERE pages[i + 1] IS NOT NULL
"""
SUFFIX = """CASE WHEN regexp_matches(lower({0}), '^data:[^/,;]*/jpe?g[;,]') OR regexp_matches(lower({0}), '^data:[^/,;]*/jpe?g$') THEN '.jpg'
  WHEN regexp_extract(lower({0}), '^data:[^/,;]*/([^;,]*)', 1) IN ('gif', 'webp', 'bmp', 'tiff') THEN '.' || regexp_extract(lower({0}), '^data:[^/,;]*/([^;,]*)', 1) ELSE '.png' END"""
STEM = r"left(regexp_replace(regexp_replace(string_split(doc, '/')[-1], '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9._-]', '_', 'g'), 255)"
HTML = "'<html><body><nav><a href=''/''>Home</a></nav><article><p>' || regexp_replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '\\n{2,}', '</p><p>', 'g') || '</p></article></body></html>'"
BLOCKS = "SELECT CAST(user_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events"


def quoted(v) -> str:
    """A value as SQL."""
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)


def rows(columns: str, *given: tuple) -> str:
    """A table of literals: what must come out, written down by hand."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, g)) + ')' for g in given)}) AS t({columns})"


def literal(rows: list, column: str) -> str:
    return f"(VALUES {', '.join('(' + (repr(x) if isinstance(x, str) else str(x)) + ')' for x in rows)}) AS t({column})"


SQL = {
    "doc_token_report": f"SELECT doc_id, {TOKENS.format('text')} AS tokens, length(coalesce(text, '')) AS chars, CASE WHEN length(text) > 0 THEN CAST(floor({TOKENS.format('text')}::DOUBLE / length(text) * 1000000) AS BIGINT) END AS ratio_millionths FROM documents",
    "token_grand_total": f"SELECT s AS source, sum({TOKENS.format('text')}) AS tokens, sum(length(text)) AS chars, count(*) AS n_files, grouping(s) AS is_total, CAST(floor(CASE WHEN sum(length(text)) > 0 THEN sum({TOKENS.format('text')})::DOUBLE / sum(length(text)) END * 1000000) AS BIGINT) AS ratio_millionths FROM (SELECT coalesce(source, '') AS s, text FROM documents) GROUP BY ROLLUP (s)",
    "size_report": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, CAST(floor(octet_length(encode(coalesce(text, '')))::DOUBLE / 1048576 * 1000000) AS BIGINT) AS megabyte_millionths FROM documents",
    "whitespace_normalized": f"SELECT doc_id, md5({space('text')}) AS digest FROM documents",
    "clean_markdown": f"SELECT doc_id, md5({strip(chr(114) + 'egexp_replace(regexp_replace(regexp_replace(text, ' + chr(39) + chr(92) + 'r' + chr(92) + 'n?' + chr(39) + ', chr(10), ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + chr(92) + 'n{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '[^' + chr(92) + 'S' + chr(92) + 'n]+(' + chr(92) + 'n|$)' + chr(39) + ', ' + chr(39) + chr(92) + '1' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} || chr(10)) AS digest FROM documents",
    "strip_image_links": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?m)^[ \t]*!\[[^\]]*\]\([^)]+\)[ \t]*\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents",
    "text_previews": "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS preview, md5(CASE WHEN length(text) > 1200 THEN left(text, 1200) || chr(10) || chr(10) || '…' ELSE text END) AS long_digest FROM documents",
    "table_sniff": rf"SELECT doc_id, coalesce(len(l) >= 2 AND contains(l[1], '|') AND regexp_matches(l[2], '^\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)+\|?$'), false) AS is_table FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM documents)",
    "output_names": r"SELECT doc_id, regexp_replace(path, '([^/])\.[^./]*$', '\1') || '.md' AS md, regexp_replace(path, '([^/])\.[^./]*$', '\1') || '.ocr.json' AS sidecar, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS suffix, left(regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g'), 255) AS safe FROM documents WHERE path IS NOT NULL",
    "filename_titles": r"SELECT page_id, array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substring(t, CAST(i - 1 AS BIGINT), 1), '\p{L}') THEN upper(substring(t, CAST(i AS BIGINT), 1)) ELSE lower(substring(t, CAST(i AS BIGINT), 1)) END), '') AS title FROM (SELECT page_id, translate(regexp_replace(string_split(image, '/')[-1], '(.)\.[^.]*$', '\1'), '_-', '  ') AS t FROM png2md)",
    "lines_adjacent_dedupe": f"SELECT doc, CAST(i AS INTEGER) AS pos, md5(b) AS digest FROM (SELECT *, lag(b) OVER (PARTITION BY doc ORDER BY i) AS before FROM (SELECT doc, i, {space('blocks[i + 1]')} AS b FROM (SELECT doc, blocks, unnest(range(len(blocks))) AS i FROM block_list)) WHERE b <> '') WHERE before IS NULL OR before <> b",
    "sentence_split": rf"SELECT doc, CAST(i AS INTEGER) AS pos, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (SELECT doc, i, list_filter(string_split(regexp_replace({space('blocks[i + 1]')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM (SELECT doc, blocks, unnest(range(len(blocks))) AS i FROM block_list) WHERE blocks[i + 1] IS NOT NULL)",
    "chunk_pack": PIECES + "SELECT doc, chunk_no, length(chunk) AS chars, md5(chunk) AS digest FROM flat",
    "chunk_batches": PIECES + "SELECT doc, chunk_no // 2 AS batch, count(*) AS n_chunks, sum(length(chunk)) AS chars FROM flat GROUP BY ALL",
    "omission_cues": "SELECT b.doc, c.kind, max(CASE WHEN c.lang = b.lang THEN c.cue END) AS cue FROM block_list b, (VALUES " + ", ".join(f"('{la}', '{k}', '{cue}')" for la, kinds in OMISSION_CUES.items() for k, cue in kinds.items()) + ") AS c(lang, kind, cue) GROUP BY b.doc, c.kind",
    "skip_existing": "SELECT doc_id, path FROM documents WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM documents WHERE path IS NOT NULL AND n_chars IS NOT NULL)",
    "normalize_title_keys": f"SELECT entry_id, {TITLE} AS title_key FROM bib_entry",
    "normalize_doi_keys": f"SELECT entry_id, {DOI} AS doi_key FROM bib_entry",
    "canonical_records": f"SELECT entry_id, md5(array_to_string(list_transform(list_sort(list_transform(map_entries(fields), lambda x: {{'k': lower(x.key), 'v': {strip('x.value')}}})), lambda x: x.k || '=' || x.v), chr(10))) AS digest FROM bib_entry",
    "dedupe_tokens": f"SELECT kind, count(*) AS n, count(DISTINCT v) AS n_values FROM (SELECT 'key' AS kind, lower(coalesce(id, '')) AS v FROM bib_entry UNION ALL SELECT 'doi', {DOI} FROM bib_entry UNION ALL SELECT 'title', {TITLE} FROM bib_entry) WHERE v <> '' GROUP BY kind",
    "dedupe_first_wins": f"SELECT entry_id FROM (SELECT entry_id, t, row_number() OVER (PARTITION BY t ORDER BY entry_id) AS k FROM (SELECT entry_id, {TITLE} AS t FROM bib_entry)) WHERE k = 1 OR t = ''",
    "merge_two_sets": MERGED,
    "merge_summary": f"SELECT disposition, count(*) AS n FROM ({MERGED}) GROUP BY disposition",
    "abstract_rows": f"SELECT entry_id, {TOKENS.format('a')} AS tokens, length(a) AS chars, CASE WHEN length(a) > 50 THEN left(a, 50) || '...' ELSE a END AS preview FROM (SELECT entry_id, {field('abstract')} AS a FROM bib_entry) WHERE a <> ''",
    "abstract_stats": f"SELECT count(*) AS n_entries, count(*) FILTER (a <> '') AS n_abstracts, sum({TOKENS.format('a')}) AS tokens, CAST(floor(sum({TOKENS.format('a')})::DOUBLE / count(*) FILTER (a <> '') * 1000) AS BIGINT) AS mean_tokens_thousandths FROM (SELECT {field('abstract')} AS a FROM bib_entry)",
    "bibtex_text": "SELECT entry_id, md5('@' || lower(entry_type) || '{' || coalesce(id, '') || ',' || chr(10) || array_to_string(list_transform(list_sort(list_transform(map_entries(fields), lambda x: {'o': coalesce(nullif(list_position(['title', 'author', 'journal', 'booktitle', 'year', 'doi', 'url'], lower(x.key)), 0), 99), 'k': lower(x.key), 'v': coalesce(x.value, '')})), lambda x: '  ' || x.k || ' = {' || x.v || '}'), ',' || chr(10)) || chr(10) || '}' || chr(10)) AS digest FROM bib_entry",
    "ocr_pages_from_json": f"SELECT doc, CAST(place AS INTEGER) AS place, p.index AS index, md5(coalesce(p.markdown, '')) AS digest, coalesce(len(p.images), 0) AS n_images FROM ({PAGES})",
    "image_filenames": f"SELECT doc, CAST(place AS INTEGER) AS place, CAST(k + 1 AS INTEGER) AS image_no, i.id AS id, {STEM} || printf('_p%03d_img%03d', place + 1, k + 1) || {SUFFIX.format('i.image_base64')} AS path, md5(TRY(from_base64(regexp_replace(i.image_base64, '^[^,]*,', '')))) AS digest FROM (SELECT doc, place, k, p.images[k + 1] AS i FROM (SELECT doc, place, p, unnest(range(len(p.images))) AS k FROM ({PAGES}))) WHERE i.image_base64 <> ''",
    "page_image_links": f"WITH RECURSIVE f AS (SELECT doc, place, coalesce(p.images, []) AS im, 0 AS k, coalesce(p.markdown, '') AS m FROM ({PAGES}) UNION ALL SELECT doc, place, im, k + 1, CASE WHEN im[k + 1].id <> '' THEN replace(m, '](' || im[k + 1].id || ')', '](' || {STEM} || printf('_p%03d_img%03d', place + 1, k + 1) || {SUFFIX.format(chr(99) + 'oalesce(im[k + 1].image_base64, ' + chr(39) * 2 + ')')} || ')') ELSE m END FROM f WHERE k < len(im)) SELECT doc, CAST(place AS INTEGER) AS place, md5(m) AS digest FROM f WHERE k = len(im)",
    "disposition_failures": "SELECT count(*) AS n, count(*) FILTER (trim(coalesce(content, '')) = '') AS n_failed, CASE WHEN count(*) FILTER (trim(coalesce(content, '')) = '') > 0 THEN 1 ELSE 0 END AS exit_code FROM png2md",
    "line_clusters": "SELECT user_id, sum(j) + 1 AS n_lines FROM (SELECT user_id, CASE WHEN abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY v, event_id)) > greatest(0.1, h * 0.6) THEN 1 ELSE 0 END AS j FROM (SELECT user_id, event_id, coalesce(value, 0.0) AS v, avg(event_id % 5 / 4.0::DOUBLE) OVER (PARTITION BY user_id) AS h FROM events)) GROUP BY user_id",
    "image_sections": rf"SELECT scan, md5(string_agg('## ' || title || chr(10) || chr(10) || CASE WHEN {strip('content')} <> '' THEN '```' || chr(10) || content || chr(10) || '```' ELSE '_No content extracted._' END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_id)) AS digest FROM (SELECT p.* REPLACE (coalesce(p.scan, '') AS scan), t.title FROM png2md p JOIN (__TITLES__) t ON p.page_id = t.page_id) GROUP BY scan",
    "page_article": f"SELECT doc_id, md5(regexp_extract(h, '(?s)(<article[ >].*?</article>)', 1)) AS digest FROM (SELECT doc_id, {HTML} AS h FROM documents WHERE text IS NOT NULL)",
    "call_graph_semi": "SELECT caller, count(*) AS n_callees, min(ord) AS first_ord FROM (SELECT 'p' || l_partkey AS caller, 's' || l_suppkey AS callee, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2) GROUP BY caller",
    "bounding_box": "SELECT img, min(x) FILTER (v > 0.15) AS \"left\", min(y) FILTER (v > 0.15) AS top, max(x) FILTER (v > 0.15) + 1 AS \"right\", max(y) FILTER (v > 0.15) + 1 AS bottom FROM (SELECT vec_id AS img, CAST(k % 8 AS INTEGER) AS x, CAST(k // 8 AS INTEGER) AS y, CAST(embedding[k + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM embeddings)) GROUP BY img",
    "rms_energy": "SELECT vec_id, CAST(floor(sqrt(list_sum(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 10000) * floor(CAST(x AS DOUBLE) * 10000))) / len(embedding)) * 100) AS BIGINT) AS rms_hundredths FROM embeddings",
    "gain_overlay_mix": "SELECT label AS mix, CAST(k AS INTEGER) AS sample_idx, CAST(greatest(least(sum(CASE WHEN vec_id % 5 = 2 THEN raw ELSE greatest(least(floor(raw * pow(10.0::DOUBLE, (vec_id % 5 * 1.5::DOUBLE - 3.0) / 20)), 32767), -32768) END), 32767), -32768) AS INTEGER) AS value FROM (SELECT *, CAST(floor(CAST(embedding[k + 1] AS DOUBLE) * 10000) AS BIGINT) AS raw FROM (SELECT label, vec_id, embedding, unnest(range(len(embedding))) AS k FROM embeddings)) e JOIN (SELECT label AS l, arg_min(len(embedding), vec_id) AS n FROM embeddings GROUP BY label) f ON e.label = f.l AND k < n GROUP BY label, k",
    "transcript_timestamps": "SELECT event_id, printf('[%02d:%02d.%02d]', s // 6000, (s % 6000) // 100, s % 100) AS mark FROM (SELECT event_id, CAST(coalesce(sum(CAST(floor(coalesce(value, 0.0) * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM events)",
    "fixed_buffer_batch": f"SELECT stream_id, seq // 30 AS buffer, min(seq) AS first_seq, max(seq) AS last_seq, 100 * count(*) AS ms FROM ({BLOCKS}) GROUP BY 1, 2 HAVING count(*) = 30",
    "fixed_buffer_stream": f"SELECT stream_id, seq // 30 AS buffer, min(seq) AS first_seq, max(seq) AS last_seq, 100 * count(*) AS ms FROM ({BLOCKS}) GROUP BY 1, 2 HAVING count(*) = 30",
    "props_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "page_range": "SELECT * FROM (VALUES ('1,3-5', '0,2,3,4'), ('5-1', ''), ('x,2', '1'), ('-3', ''), ('1-2-3', ''), ('4,4,2', '1,3'), ('0', '-1'), (' 7 - 9 ,1', '0,6,7,8'), ('', '')) AS t(spec, pages)",
    "colours": "SELECT spec, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM (VALUES ('#fff', 255, 255, 255), ('#A1b2C3', 161, 178, 195), ('white', 255, 255, 255), ('12, 34,56', 12, 34, 56), ('red', 255, 0, 0)) AS t(spec, r, g, b)",
    "track_specs": rf"SELECT spec, CASE WHEN contains(spec, ':') THEN regexp_extract(spec, '^(.*):([^:]*)$', 1) ELSE spec END AS path, CASE WHEN contains(spec, ':') THEN TRY_CAST(regexp_extract(spec, '^(.*):([^:]*)$', 2) AS DOUBLE) ELSE 0.0 END AS volume_db FROM {literal(q.TRACKS, 'spec')}",
    "timestamp_marks": f"SELECT CAST(cs AS BIGINT) AS cs, printf('[%02d:%02d.%02d]', cs // 6000, (cs % 6000) // 100, cs % 100) AS mark FROM {literal(q.MARKS, 'cs')}",
}
SQL["clean_markdown"] = "SELECT doc_id, md5(" + strip(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[^\S\n]+(\n|$)', '\1', 'g')") + " || chr(10)) AS digest FROM documents"
SQL["image_sections"] = SQL["image_sections"].replace("__TITLES__", SQL["filename_titles"])

# The silence rules as a recursion over each stream's blocks.
SQL["vad_segments_batch"] = SQL["vad_segments_stream"] = """
WITH RECURSIVE b AS (
  SELECT CAST(user_id AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, coalesce(value, 0.0) < 5 AS quiet FROM events
), n AS (SELECT stream_id, max(seq) AS last FROM b GROUP BY stream_id
), f AS (
  SELECT stream_id, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS segment, CAST(-1 AS BIGINT) AS first, CAST(0 AS BIGINT) AS ms, CAST(0 AS BIGINT) AS q, '' AS reason, CAST(0 AS BIGINT) AS done_first, CAST(0 AS BIGINT) AS done_ms FROM n
  UNION ALL
  SELECT stream_id, seq, segment + CASE WHEN reason <> '' THEN 1 ELSE 0 END, CASE WHEN reason <> '' THEN -1 ELSE first END, CASE WHEN reason <> '' THEN 0 ELSE ms END, CASE WHEN reason <> '' THEN 0 ELSE q END, reason, first, ms
  FROM (
    SELECT stream_id, seq, segment, first, ms, q, CASE WHEN ms >= 5000 THEN 'full' WHEN q >= 300 AND ms >= 1000 THEN 'silence' WHEN seq = last AND ms >= 1000 THEN 'end' ELSE '' END AS reason
    FROM (SELECT f.stream_id, b.seq, f.segment, CASE WHEN f.first < 0 THEN b.seq ELSE f.first END AS first, f.ms + 100 AS ms, CASE WHEN b.quiet THEN f.q + 100 ELSE 0 END AS q, n.last
          FROM f JOIN b ON b.stream_id = f.stream_id AND b.seq = f.seq + 1 JOIN n ON n.stream_id = f.stream_id)
  )
)
SELECT stream_id, segment - 1 AS segment, done_first AS first_seq, seq AS last_seq, CAST(done_ms // 100 AS INTEGER) AS n_blocks, done_ms AS ms, reason FROM f WHERE reason <> ''
"""


SQL |= {
    "token_ranking": f"SELECT doc_id, {TOKENS.format('text')} AS tokens, length(coalesce(text, '')) AS chars FROM documents ORDER BY tokens DESC, doc_id",
    "size_ranking": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents ORDER BY bytes DESC, doc_id",
    "merge_policy_keep_first": merged_in_order("dup"),
    "merge_policy_error": merged_in_order("error"),
    "merge_policy_keep_second": merged_in_order("replaced"),
    "merge_policy_rename": merged_in_order("renamed"),
}

RULE = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
IMAGES_NAMED = SQL["page_image_links"].replace("md5(m) AS digest", "m")
SQL["page_join"] = f"SELECT doc, md5(string_agg(m, {RULE} ORDER BY place)) AS digest FROM ({IMAGES_NAMED}) GROUP BY doc"
WITHOUT_LINKS = r"regexp_replace(regexp_replace(coalesce(p.markdown, ''), '(?m)^[ \t]*!\[[^\]]*\]\([^)]+\)[ \t]*\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
SQL["page_join_without_images"] = f"SELECT doc, md5(string_agg({WITHOUT_LINKS}, {RULE} ORDER BY place)) AS digest FROM ({PAGES}) GROUP BY doc"
SQL["ocr_sidecar"] = rf"SELECT regexp_replace(doc, '\.[^./]*$', '') || '.ocr.json' AS name, CAST(place AS INTEGER) AS place, md5(coalesce(p.markdown, '')) AS digest FROM ({PAGES})"
SQL["text_tree"] = f"SELECT regexp_replace(doc, '[^A-Za-z0-9]', '_', 'g') || '.md' AS name, length(t) AS chars, octet_length(encode(t)) AS bytes, md5(t) AS digest FROM (SELECT doc, regexp_replace(string_agg(m, {RULE} ORDER BY place), chr(13) || chr(10) || '?', chr(10), 'g') AS t FROM ({IMAGES_NAMED}) GROUP BY doc) WHERE t <> ''"
SQL["bibtex_roundtrip"] = "SELECT src, count(*) AS n_entries, 0 AS n_errors FROM bib_entry WHERE regexp_matches(id, '^[A-Za-z0-9_:.-]+$') AND src IS NOT NULL AND entry_type IS NOT NULL GROUP BY src"

# Boxes: lines from top to bottom, each from left to right.
SQL["boxes_to_text"] = """
WITH b AS (SELECT CAST(user_id AS VARCHAR) AS image, event_id % 97 * 1.0::DOUBLE AS x, value * 3 AS y0, value * 3 + (1.0::DOUBLE + event_id % 4) AS y1, event_type || event_id AS text FROM events WHERE value IS NOT NULL AND event_id % 10 >= 3
), m AS (SELECT *, (y0 + y1) / 2 AS y, greatest(avg(y1 - y0) OVER (PARTITION BY image) * 0.6, 8.0) AS top FROM b
), j AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY image ORDER BY y, x)) > top THEN 1 ELSE 0 END AS jump FROM m
), n AS (SELECT *, sum(jump) OVER (PARTITION BY image ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS line FROM j
), l AS (SELECT image, line, string_agg(text, ' ' ORDER BY x, y, text) AS t FROM n GROUP BY image, line)
SELECT image, md5(string_agg(t, chr(10) ORDER BY line)) AS digest FROM l GROUP BY image
"""

BODY = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
KINDS = ", ".join(f"({k}, {quoted(a)}, {quoted(z)})" for k, (_, a, z) in enumerate(q.OUTER))
SQL["page_container_priority"] = f"""
SELECT doc_id, md5(CASE WHEN a = '' THEN '<body>' ELSE a END || '<p>' || {BODY} || '</p>' || CASE WHEN a = '' THEN '</body>' ELSE z END) AS digest
FROM documents JOIN (VALUES {KINDS}) AS o(k, a, z) ON doc_id % {len(q.OUTER)} = k WHERE text IS NOT NULL
"""
SQL["page_clean_html"] = "SELECT doc_id, true AS is_there, true AS is_part FROM documents WHERE text IS NOT NULL"
SQL["page_decode"] = "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL"
SQL["buffered_samples"] = """
SELECT stream_id, buffer, string_agg(seq || ',' || level, ',' ORDER BY seq) AS samples FROM (
  SELECT CAST(user_id AS VARCHAR) AS stream_id, seq, seq // 10 AS buffer, CAST(floor(CASE WHEN value < 5 THEN 0.0 ELSE coalesce(value, 0.0) END * 100) AS BIGINT) AS level
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)
) GROUP BY stream_id, buffer HAVING count(*) = 10
"""
SQL["buffer_offsets"] = f"SELECT stream_id, buffer, buffer * 700 AS \"offset\" FROM (SELECT stream_id, seq // 7 AS buffer, count(*) AS n FROM ({BLOCKS}) GROUP BY 1, 2) WHERE n = 7"
MARK = "printf('[%02d:%02d.%02d]', event_id * 37 // 6000, event_id * 37 % 6000 // 100, event_id * 37 % 100)"
SQL["transcripts"] = f"SELECT CAST(user_id AS VARCHAR) AS audio, md5(string_agg({MARK} || ' ' || event_type, chr(10) ORDER BY event_id)) AS digest, md5(string_agg(event_type, ' ' ORDER BY event_id)) AS plain_digest FROM events WHERE event_id % 9 <> 0 GROUP BY user_id"
SQL["synthesis_metrics"] = "SELECT user_id, count(*) AS n_chunks, CAST(ceil(count(*) / 2) AS BIGINT) AS n_batches, sum(event_id % 16 / 4.0::DOUBLE) AS audio_seconds, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE sum(event_id % 16 / 4.0::DOUBLE) / 8.0 END AS realtime_factor, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE count(*) / 8.0::DOUBLE END AS chunks_per_second FROM events GROUP BY user_id"
SQL["crop_report"] = f"""
SELECT img, l AS "left", t AS top, r AS "right", b AS bottom, CAST(floor(100 * (1 - ((r - l) * (b - t))::DOUBLE / (8 * h)) * 100 + 0.001) AS BIGINT) AS removed_hundredths FROM (
  SELECT img, h, CAST(CASE WHEN "left" IS NULL THEN 0 ELSE greatest("left" - 1, 0) END AS INTEGER) AS l, CAST(CASE WHEN "left" IS NULL THEN 0 ELSE greatest(top - 1, 0) END AS INTEGER) AS t,
         CAST(CASE WHEN "left" IS NULL THEN 8 ELSE least("right" + 1, 8) END AS INTEGER) AS r, CAST(CASE WHEN "left" IS NULL THEN h ELSE least(bottom + 1, h) END AS INTEGER) AS b
  FROM ({SQL['bounding_box']}) JOIN (SELECT vec_id, CAST(ceil(len(embedding) / 8) AS INTEGER) AS h FROM embeddings) ON img = vec_id)
"""
SQL["dark_inversion"] = "SELECT vec_id, array_to_string(CASE WHEN list_avg(p) < 128 THEN list_transform(p, lambda x: 255 - x) ELSE p END, ',') AS pixels FROM (SELECT vec_id, list_transform(embedding, lambda x: (CAST(floor(CAST(x AS DOUBLE) * 1000) AS INTEGER) % 256 + 256) % 256) AS p FROM embeddings)"
SQL["durations"] = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE event_id / (event_id % 5 * 8000)::DOUBLE END AS seconds, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE least(100.0, (event_id % 300)::DOUBLE / (event_id % 4 * 100) * 100) END AS percent, CASE WHEN user_id % 2 = 0 THEN 0.0 ELSE event_id / 4.0::DOUBLE END AS factor FROM events"
SQL["adjacency_lists"] = """
SELECT name, coalesce(n, 0) AS n, md5(coalesce(c, '')) AS digest FROM (SELECT 'p' || p_partkey AS name FROM part UNION SELECT 's' || s_suppkey FROM supplier)
LEFT JOIN (SELECT 'p' || l_partkey AS caller, CAST(count(*) AS INTEGER) AS n, string_agg('s' || l_suppkey, ',' ORDER BY l_orderkey * 10 + l_linenumber, 's' || l_suppkey) AS c FROM lineitem
           WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1) ON name = caller
"""

# What must come out of parsers of literals, written down by hand.
SQL["output_templates"] = rows("template, named", ("%(id)s", "%(id)s.%(ext)s"), ("a.%(ext)s", "a.%(ext)s"), ("%(ext)s.b", "%(ext)s.b.%(ext)s"), ("", ".%(ext)s"), (None, "%(title)s.%(ext)s"))
SQL["audio_options"] = rows("codec, quality, cover", ("mp3", "192", True), ("m4a", "192", True), ("opus", "192", False), ("wav", None, False), ("flac", None, False))
SQL["separation_commands"] = rows("command", *[(f"demucs -n htdemucs -o out {x} x.wav",) for x in ("--mp3", "--float32 -j 2", "--mp3 -j 1", "-j 4", "--int24")])
SQL["page_choices"] = rows("spec, n_pages, kept, skipped, error", ("1,3-5", 4, "0,2,3", "4", None), ("9", 3, "", "8", "no page is left"), ("x", 3, "", "", "no page range"), ("2-1,2", 2, "1", "", None), ("0,1", 1, "0", "-1", None))
SQL["speakers"] = rows("speaker, supported, allowed", ("Ana", "Ana,Rui", True), ("Eva", "Ana,Rui", False), ("Eva", "", True))
REQUEST = '{{"model":"m","document":{{"type":"document_url","document_url":"u"}},"include_image_base64":true{0}}}'
SQL["ocr_requests"] = rows("payload", *[(REQUEST.format(x),) for x in (',"include_blocks":true', ',"table_format":"html","extract_header":true,"confidence_scores_granularity":"page"', ',"table_format":"markdown","extract_header":true,"include_blocks":true,"confidence_scores_granularity":"word"')])
SQL["markdown_blocks"] = rows("markdown, blocks", *zip([m for m, _ in q.MARKDOWN], [
    "Title one / Text with a link and bold words. / first / second",
    "Code block omitted. / Table omitted. / HTML block omitted. / Image omitted. / Footnote omitted.",
    "Bloco de codigo omitido. / Nota de rodape omitida.",
    "line one. line two c*d / Code block omitted. / quote lazy / Head",
]))
SQL["page_markdown_cases"] = rows("html, markdown, tier", *[(h, m, "container") for h, m in zip(q.PAGES, ["## A\n\n* b **c**\n", "one\ntwo\n\n---\n\n*three* `f(x)`\n", "# T\n\nsee [here](u)\n\n1. x\n1. y\n", "```\na  b\nc\n```\n\n> q\n", "| h | v |\n\n![i](s.png)\n"])])
CALLS = {
    "a.py": ("f g h", "f>g f>h f>z f>k f>deco h>g h>g h>add_node h>h"),
    "b.c": ("sq main", "main>sq main>printf main>sq"),
    "d.py": ("build step run route", "build>my_add_node build>step build>add_node build>run build>run build>add_conditional_edges build>route step>run"),
}
SQL["py_call_edges"] = rows("file, kind, caller, callee, ord", ("c.py", "error", None, None, 0), *[(f, "node", n, None, k) for f, (ns, _) in CALLS.items() for k, n in enumerate(ns.split())], *[(f, "edge", *e.split(">"), k) for f, (_, es) in CALLS.items() for k, e in enumerate(es.split())])
GRAPHS = {
    "a.py": ("f g h", "f>g f>h h>g h>h", '{"f":["g","h"],"g":[],"h":["g","g","h"]}'),
    "b.c": ("main sq", "main>sq", '{"main":["sq","sq"],"sq":[]}'),
    "d.py": ("build route run step", "build>step build>run build>route step>run", '{"build":["step","run","run","route"],"route":[],"run":[],"step":["run"]}'),
}
HEAD = 'digraph G {{\n  label="{0}";\n  labelloc=t;\n  rankdir=LR;\n  node [shape=box, style=rounded, fontname="Helvetica"];\n  edge [fontname="Helvetica"];\n  ordering=out;\n'
SQL["call_graph_dot"] = rows("file, dot, json", *[(f, HEAD.format(f) + "".join(f'  "{n}";\n' for n in ns.split()) + "".join('  "{}" -> "{}";\n'.format(*e.split(">")) for e in es.split()) + "}", j) for f, (ns, es, j) in GRAPHS.items()])
