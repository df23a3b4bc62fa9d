"""SQL for the queries of `queries`, each over the given tables alone."""

from __future__ import annotations

import re

from .functions.rules import CONTENTS

ORACLE_SQL: dict[str, str] = {}

_CODE = r"^[ \t]*([0-9]+(?:\.[0-9]+)*)\.?[ \t]+"
_LEADERS = r"(?:\.{5,}|(?:\. ){5,}\.?)"
_HEADER = rf"(?im)^[ \t]*(?:{CONTENTS})[ \t]*$"
_NUMBERED = r"^[ \t]*([0-9]+(?:\.[0-9]+)*)\.?[ \t]+([^ \t]+(?:[ \t]+[^ \t]+){0,11})[ \t]*$"
_CHAPTER = r"(?i)^[ \t]*(?:chapter|section|part)[ \t]+([0-9]+)(?:[.: \t].*)?$"
_PAGE = r"[: \t][ \t]*([0-9]+)[ \t]*$"


def _squash(c: str) -> str:
    return rf"regexp_replace(lower({c}), '\s+', '', 'g')"


def _squashed_line(c: str) -> str:
    return _squash(f"regexp_replace({c}, '{_CODE}', '')")


def _clip(c: str, n: int) -> str:
    return rf"""CASE WHEN length({c}) <= {n} THEN trim({c})
      WHEN regexp_matches(substr({c}, {n + 1}, 1), '\s') THEN trim(substr({c}, 1, {n}))
      WHEN regexp_extract(substr({c}, 1, {n}), '(?s)^(.*\S)\s+\S*$', 1) = '' THEN substr({c}, 1, {n})
      ELSE regexp_extract(substr({c}, 1, {n}), '(?s)^(.*\S)\s+\S*$', 1) END"""


_BODY = "list_transform(range(0, CAST(ceil(len(l) / 10.0) AS BIGINT)), lambda i: array_to_string(l[i * 10 + 1:i * 10 + 10], chr(10)))"
_CHAP = "CAST((i - 1) // 3 + 1 AS VARCHAR)"
_C = f"CASE WHEN (i - 1) % 3 = 0 THEN {_CHAP} ELSE {_CHAP} || '.' || CAST((i - 1) % 3 + 1 AS VARCHAR) END"

#: Common table expressions by name; each may use those before it.
_CTES = {
    "d": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS n, source, text, coalesce(doc_id % 5, 0) AS kind, string_split(coalesce(text, ''), chr(10)) AS l FROM documents",
    "bodies": f"SELECT doc_id, kind, unnest({_BODY}) AS body, generate_subscripts({_BODY}, 1) AS i FROM d",
    "parts": rf"SELECT doc_id, kind, i, body, array_to_string(list_filter(string_split_regex(body, '\s+'), lambda w: w <> '')[1:4], ' ') AS title, {_C} AS code, count(*) OVER (PARTITION BY doc_id) AS pages FROM bodies",
    "headed": "SELECT doc_id, kind, pages, i, CASE WHEN kind = 3 AND (i - 1) % 3 = 2 THEN body ELSE code || ' ' || title || chr(10) || body END AS text FROM parts",
    "contents": "SELECT doc_id, 'Contents' || chr(10) || string_agg(code || ' ' || title || CASE WHEN kind = 4 AND (i - 1) % 3 = 1 THEN ' zz' ELSE '' END || CASE WHEN kind = 1 THEN '' ELSE ' ......... ' || CAST(i AS VARCHAR) END, chr(10) ORDER BY i) AS text FROM parts WHERE pages >= 3 AND kind <> 2 GROUP BY doc_id",
    "p0": "SELECT h.doc_id, CASE WHEN c.doc_id IS NULL THEN i ELSE i + 2 END AS page, h.text FROM headed h LEFT JOIN contents c ON c.doc_id = h.doc_id UNION ALL SELECT doc_id, 1, 'Document ' || doc_id FROM contents UNION ALL SELECT doc_id, 2, text FROM contents",
    "pages": "SELECT doc_id, CAST(page AS INTEGER) AS page, text, CAST(length(text) // 4 AS INTEGER) AS token_length FROM p0",
    "stats": "SELECT doc_id, CAST(count(*) AS INTEGER) AS n_pages, CAST(sum(token_length) AS BIGINT) AS n_tokens FROM pages GROUP BY doc_id",
    "flags": rf"SELECT doc_id, page, regexp_matches(text, '{_HEADER}') OR len(regexp_extract_all(text, '(?m)^.*{_LEADERS}[ \t]*[0-9]+[ \t]*$')) >= 3 AS is_toc FROM pages",
    "lines": "SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM pages",
    "h0": rf"SELECT lines.doc_id, lines.page, k, CASE WHEN regexp_matches(line, '{_LEADERS}[ \t]*[0-9]*[ \t]*$') THEN 0 WHEN regexp_matches(line, '{_NUMBERED}') THEN 1 WHEN regexp_matches(line, '{_CHAPTER}') THEN 2 ELSE 0 END AS form, line FROM lines JOIN flags ON flags.doc_id = lines.doc_id AND flags.page = lines.page WHERE NOT is_toc",
    "headings": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS INTEGER) AS pos, CASE form WHEN 1 THEN regexp_extract(line, '{_NUMBERED}', 1) ELSE regexp_extract(line, '{_CHAPTER}', 1) END AS structure, CASE form WHEN 1 THEN regexp_extract(line, '{_NUMBERED}', 2) ELSE trim(line) END AS title, page AS physical_index FROM h0 WHERE form > 0",
    # Contents: first runs of flagged pages.
    "islands": "SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM flags WHERE is_toc AND page <= 20",
    "runs": "SELECT doc_id, page, min(page) OVER (PARTITION BY doc_id, g) AS run FROM islands",
    "toc_text": r"SELECT r.doc_id, run, list(r.page ORDER BY r.page) AS toc_pages, regexp_replace(regexp_replace(string_agg(text, '' ORDER BY r.page), '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g') AS toc_content FROM runs r JOIN pages USING (doc_id, page) GROUP BY r.doc_id, run",
    "toc_lines": rf"SELECT doc_id, run, unnest(list_filter(string_split(toc_content, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '(?i)^[ \t]*(?:{CONTENTS})[ \t]*$'))) AS line, generate_subscripts(list_filter(string_split(toc_content, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '(?i)^[ \t]*(?:{CONTENTS})[ \t]*$')), 1) AS k FROM toc_text",
    "toc_numbers": f"SELECT doc_id, run, count(*) FILTER (regexp_matches(line, '{_PAGE}')) AS numbered, count(*) AS all_lines FROM toc_lines GROUP BY doc_id, run",
    "ranked": "SELECT t.*, coalesce(numbered > 0 AND 2 * numbered >= all_lines, false) AS has, row_number() OVER (PARTITION BY t.doc_id ORDER BY coalesce(numbered > 0 AND 2 * numbered >= all_lines, false) DESC, t.run) AS turn FROM toc_text t LEFT JOIN toc_numbers n ON n.doc_id = t.doc_id AND n.run = t.run",
    "detected": "SELECT s.doc_id, toc_content, coalesce(toc_pages, []) AS toc_pages, coalesce(has, false) AS has_page_numbers FROM stats s LEFT JOIN ranked r ON r.doc_id = s.doc_id AND turn = 1",
    "e0": rf"SELECT l.doc_id, l.k, nullif(regexp_extract(line, '{_PAGE}', 1), '') AS page, regexp_replace(line, '[: \t]+[0-9]+[ \t]*$', '') AS rest FROM toc_lines l JOIN ranked r ON r.doc_id = l.doc_id AND r.run = l.run AND turn = 1",
    "e1": f"SELECT doc_id, k, nullif(regexp_extract(rest, '{_CODE}', 1), '') AS structure, trim(regexp_replace(rest, '{_CODE}', '')) AS title, CAST(CASE WHEN page IS NULL THEN NULL WHEN length(ltrim(page, '0')) > 10 THEN 2147483647 ELSE least(CAST(page AS HUGEINT), 2147483647) END AS INTEGER) AS page FROM e0",
    "entries": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS pos, structure, title, page FROM e1 WHERE title <> ''",
    "toc_out": "SELECT doc_id, unnest(toc_pages) AS page FROM detected",
    "norms": f"SELECT doc_id, page, {_squashed_line('line')} AS norm, min(k) AS k FROM (SELECT *, 0 AS z FROM lines WHERE trim(line) <> '') GROUP BY ALL",
    "tops": "SELECT doc_id, page, min(k) AS k FROM lines WHERE trim(line) <> '' GROUP BY doc_id, page",
    "places": f"SELECT e.doc_id, e.pos, n.page, n.k = t.k AS at_top FROM entries e JOIN norms n ON n.doc_id = e.doc_id AND n.norm = {_squash('e.title')} JOIN tops t ON t.doc_id = n.doc_id AND t.page = n.page WHERE {_squash('e.title')} <> ''",
    "pairs": "SELECT e.doc_id, CAST(row_number() OVER (PARTITION BY e.doc_id ORDER BY e.pos, h.pos) - 1 AS INTEGER) AS pair_order, e.title, e.page, h.physical_index FROM entries e JOIN headings h ON h.doc_id = e.doc_id AND h.title = e.title JOIN detected d ON d.doc_id = e.doc_id WHERE physical_index >= coalesce(list_max(toc_pages), 0)",
    "diffs": 'SELECT doc_id, physical_index - page AS diff, count(*) AS c, min(pair_order) AS first FROM pairs WHERE page IS NOT NULL GROUP BY ALL',
    "offsets": 'SELECT doc_id, arg_max(diff, c * 1000000 - first) AS "offset" FROM diffs WHERE doc_id IN (SELECT doc_id FROM pairs GROUP BY doc_id HAVING count(*) >= 3) GROUP BY doc_id',
    "bounds": "SELECT h.doc_id, pos, CAST(coalesce(last_value(CASE WHEN pos % 3 = 0 THEN physical_index END IGNORE NULLS) OVER (PARTITION BY h.doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS prev_index, CAST(coalesce(first_value(CASE WHEN pos % 3 = 0 THEN physical_index END IGNORE NULLS) OVER (PARTITION BY h.doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_pages) AS INTEGER) AS next_index FROM headings h JOIN stats ON stats.doc_id = h.doc_id",
    "shifted": "SELECT doc_id, pos, structure, title, CAST(physical_index + CASE WHEN pos % 4 = 3 THEN 1 ELSE 0 END AS INTEGER) AS physical_index FROM headings",
    "checks": f"SELECT s.doc_id, pos, physical_index, {_squash('title')} <> '' AND (starts_with({_squash('coalesce(text, chr(0))')}, {_squash('title')}) OR starts_with({_squashed_line('coalesce(text, chr(0))')}, {_squash('title')})) AS at_start, {_squash('title')} <> '' AND contains({_squash('coalesce(text, chr(0))')}, {_squash('title')}) AS there FROM shifted s LEFT JOIN pages p ON p.doc_id = s.doc_id AND p.page = s.physical_index",
    # Trees on headings with a preface.
    "firsts": "SELECT doc_id, arg_min(physical_index, pos) AS f FROM headings GROUP BY doc_id HAVING f > 1",
    "items": "SELECT h.doc_id, CAST(CASE WHEN f IS NULL THEN pos ELSE pos + 1 END AS INTEGER) AS pos, structure, title, physical_index FROM headings h LEFT JOIN firsts ON firsts.doc_id = h.doc_id UNION ALL SELECT doc_id, 0, '0', 'Preface', 1 FROM firsts",
    "starts": f"SELECT i.*, {_squash('title')} <> '' AND (starts_with({_squash('coalesce(text, chr(0))')}, {_squash('title')}) OR starts_with({_squashed_line('coalesce(text, chr(0))')}, {_squash('title')})) AS opens FROM items i LEFT JOIN pages p ON p.doc_id = i.doc_id AND p.page = i.physical_index",
    "ranged": "SELECT s.doc_id, pos, structure, title, CAST(physical_index AS INTEGER) AS start_index, CAST(CASE WHEN lead(pos) OVER w IS NULL THEN n_pages WHEN lead(opens) OVER w THEN lead(physical_index) OVER w - 1 ELSE lead(physical_index) OVER w END AS INTEGER) AS end_index FROM starts s JOIN stats ON stats.doc_id = s.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY pos)",
    "ups": r"SELECT *, nullif(regexp_extract(structure, '^(.*)\.[^.]*$', 1), '') AS up FROM ranged",
    "parents": "SELECT a.doc_id, a.pos, max(b.pos) AS parent_pos FROM ups a JOIN ranged b ON b.doc_id = a.doc_id AND b.structure = a.up AND b.pos < a.pos GROUP BY a.doc_id, a.pos",
    "linked": "SELECT r.*, parent_pos FROM ranged r LEFT JOIN parents p ON p.doc_id = r.doc_id AND p.pos = r.pos",
    "paths": "SELECT doc_id, pos, [pos] AS path FROM linked WHERE parent_pos IS NULL UNION ALL SELECT l.doc_id, l.pos, list_append(p.path, l.pos) FROM linked l JOIN paths p ON p.doc_id = l.doc_id AND p.pos = l.parent_pos",
    "seqs": "SELECT doc_id, pos, path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INTEGER) AS node_seq FROM paths",
    "nodes": "SELECT l.doc_id, l.pos, title, start_index, end_index, s.node_seq, printf('%04d', s.node_seq) AS node_id, u.node_seq AS parent_seq, CAST(len(s.path) - 1 AS INTEGER) AS depth, l.pos NOT IN (SELECT parent_pos FROM linked x WHERE x.doc_id = l.doc_id AND parent_pos IS NOT NULL) AS is_leaf FROM linked l JOIN seqs s ON s.doc_id = l.doc_id AND s.pos = l.pos LEFT JOIN seqs u ON u.doc_id = l.doc_id AND u.pos = l.parent_pos",
    "leaf_text": "SELECT n.doc_id, n.node_seq, coalesce(string_agg(text, '' ORDER BY page), '') AS text FROM nodes n LEFT JOIN pages p ON p.doc_id = n.doc_id AND p.page BETWEEN n.start_index AND n.end_index WHERE is_leaf GROUP BY n.doc_id, n.node_seq",
    # Catalog and requests.
    "catalog": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'Doc-' || doc_id || '.pdf' AS doc_name, source AS doc_description, source || '/Doc-' || doc_id || '.pdf' AS path FROM documents",
    "questions": "SELECT conv_id || '-' || turn AS request_id, CASE turn % 3 WHEN 0 THEN 'Doc-' || conv_id || '.pdf' WHEN 1 THEN 'DOC-' || conv_id ELSE 'none-' || conv_id END AS doc_name, list_filter([turn + 1, 1, 99], lambda x: x >= 1) AS pages, text AS question FROM conversations",
    "q_found": r"SELECT request_id, q.doc_name, c.doc_id, CASE WHEN c.doc_id IS NULL THEN 'unknown document: ' || coalesce(q.doc_name, '') END AS error, list_distinct(pages) AS p, pages, question FROM questions q LEFT JOIN catalog c ON c.doc_name = q.doc_name OR lower(regexp_replace(c.doc_name, '\.[^.]*$', '')) = lower(regexp_replace(q.doc_name, '\.[^.]*$', ''))",
    "asked": "SELECT conv_id || '-' || turn AS request_id, CASE WHEN turn % 5 = 4 THEN 'none-' || conv_id ELSE CAST(conv_id AS VARCHAR) END AS doc_id, CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 2 = 0 THEN [1, 2, 3, 4] ELSE list_sort(list_distinct([turn + 1, 1])) END AS want FROM conversations",
}


def _sql(body: str) -> str:
    """body after the expressions that it needs, directly or not, in their order."""
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in _CTES:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                todo.append(_CTES[name])
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in _CTES.items() if k in need) + f"\n{body}" if need else body


def _add(name: str, body: str) -> None:
    ORACLE_SQL[name] = _sql(body)


_add("s1_pages", "SELECT doc_id, page, md5(text) AS text_md5, token_length FROM pages")
_add("s2_paginate", "SELECT doc_id, CAST(i AS INTEGER) AS page, md5(body) AS text_md5, CAST(length(body) // 4 AS INTEGER) AS token_length FROM bodies")
_add("s5_read_index", "SELECT d.doc_id, 'Doc-' || d.doc_id AS doc_name, source AS doc_description, count(*) AS n_nodes FROM d JOIN nodes ON nodes.doc_id = d.doc_id WHERE source <> 'src3' GROUP BY ALL HAVING count(*) <> 2")
# Names that several documents share, case aside, get a digest of the id; a seventh of the files is broken afterwards.
_CTES["filed"] = "SELECT doc_id, n, 'Vol/' || (n % 40) || CASE WHEN n % 3 = 0 THEN '.PDF' ELSE '.pdf' END AS doc_name, CASE WHEN n % 400 < 40 AND n % 40 <> 7 THEN 'single-' || n || '.pdf' END AS alone FROM d"
_CTES["filed_as"] = "SELECT doc_id, coalesce(alone, doc_name) AS doc_name, CASE WHEN alone IS NOT NULL THEN 'single-' || n ELSE 'Vol-' || (n % 40) || '-' || sha256(doc_id)[1:24] END AS stem FROM filed"
_add("s3_list_sources", "SELECT stem || '_structure.json' AS name, stem || '_structure' AS stem, 'out/' || stem || '_structure_structure.json' AS output FROM filed_as f WHERE f.doc_id IN (SELECT doc_id FROM nodes)")
_add("s4_write_index", "SELECT f.doc_id, doc_name, mode, count(*) AS n_nodes FROM filed_as f JOIN nodes ON nodes.doc_id = f.doc_id CROSS JOIN (VALUES ('file'), ('line')) m(mode) GROUP BY ALL")
_add("s6_upsert", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'new' ELSE source END AS source, CAST(length(text) AS INTEGER) AS n FROM documents")
_add("s6_stored_upsert", "SELECT d.doc_id, CASE WHEN length(text) > 1000 THEN 'new' ELSE source END AS source, CAST(CASE WHEN length(text) > 1000 AND n % 3 = 0 THEN 0 ELSE coalesce(c, 0) END AS BIGINT) AS n_nodes FROM d LEFT JOIN (SELECT doc_id, count(*) AS c FROM nodes GROUP BY doc_id) k ON k.doc_id = d.doc_id")
_add("c7_incremental", "SELECT s.doc_id, s.doc_id AS doc_name, CAST(n_pages + CASE WHEN n % 20 = 7 THEN 1 ELSE 0 END AS INTEGER) AS page_count, CAST(CASE WHEN n % 20 = 7 THEN 2 ELSE 1 END AS BIGINT) AS times FROM stats s JOIN d ON d.doc_id = s.doc_id")
_add("j7_not_indexed", "SELECT doc_id, source FROM documents WHERE NOT coalesce(length(text) > 1000, false)")
_add("s7_rebuild_catalog", "SELECT d.doc_id, 'pdf' AS type, 'Doc-' || d.doc_id AS doc_name, CASE WHEN source <> 'src1' THEN source ELSE '' END AS doc_description, '' AS path, CASE WHEN n_pages > 1 THEN n_pages ELSE 0 END AS page_count FROM d JOIN stats ON stats.doc_id = d.doc_id")
_add("s8_run_report", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'Doc-' || doc_id AS name, 'out/' || doc_id || '_structure.json' AS output, CASE WHEN length(text) > 1000 THEN 'ok' ELSE 'failed' END AS status FROM documents")
_TAG = "'<physical_index_' || page || '>'"
_add("p2_tag_page", f"SELECT doc_id, page, md5({_TAG} || chr(10) || text || chr(10) || {_TAG} || chr(10) || chr(10)) AS tagged_md5, md5({_TAG} || chr(10) || text || chr(10) || {_TAG} || chr(10)) AS labelled_md5 FROM pages")
_add("p3_leaders", r"SELECT doc_id, page, md5(regexp_replace(regexp_replace(text, '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g')) AS normal_md5 FROM pages")
_add("p4_physical_index", r"SELECT doc_id, page, page AS tagged, CASE WHEN regexp_matches(w, '^[0-9]+$') THEN CAST(least(CAST(w AS HUGEINT), 2147483647) AS INTEGER) END AS bare, CAST(NULL AS INTEGER) AS strict FROM (SELECT *, regexp_extract(text, '^(\S+)', 1) AS w FROM pages)")
_add("p5_page_number", r"SELECT l.doc_id, CAST(l.k - 1 AS INTEGER) AS k, CASE WHEN regexp_matches(w, '^[+-]?[0-9]+$') THEN CAST(w AS INTEGER) END AS page FROM (SELECT *, regexp_extract(line, '(\S+)[ \t]*$', 1) AS w FROM toc_lines) l JOIN ranked r ON r.doc_id = l.doc_id AND r.run = l.run AND turn = 1")
_CTES["specs"] = "SELECT doc_id, min(page) AS a, max(page) AS b, arg_min(title, pos) AS title FROM entries GROUP BY doc_id"
_add("p6_page_spec", r"SELECT s.doc_id, CASE WHEN a IS NOT NULL THEN array_to_string(range(a, least(b, n_pages) + 1), ',') END AS pages, CASE WHEN a IS NULL THEN 'not a page: ''' || list_filter(list_transform(string_split(title, ','), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^[0-9]+(\s*-\s*[0-9]+)?$'))[1] || '''' END AS error FROM specs s JOIN stats ON stats.doc_id = s.doc_id")
_CTES["listed"] = "SELECT doc_id, page - 2 AS x, pos AS i FROM entries WHERE page IS NOT NULL UNION ALL SELECT doc_id, page - 3, pos + 1000000 FROM entries WHERE page IS NOT NULL"
_CTES["cleaned"] = "SELECT doc_id, x, min(i) AS i FROM listed WHERE x >= 1 GROUP BY ALL"
_add("p7_page_list", "SELECT l.doc_id, coalesce(string_agg(c.x, ',' ORDER BY c.i), '') AS pages FROM (SELECT DISTINCT doc_id FROM listed) l LEFT JOIN cleaned c ON c.doc_id = l.doc_id GROUP BY l.doc_id")
_add("p8_validate", "SELECT h.doc_id, pos, CASE WHEN physical_index + CAST(h.doc_id AS BIGINT) % 3 <= n_pages THEN CAST(physical_index + CAST(h.doc_id AS BIGINT) % 3 AS INTEGER) END AS physical_index FROM headings h JOIN stats ON stats.doc_id = h.doc_id")
_add("p9_names", r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, lower(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '')) AS stem, replace(url, '/', '-') AS safe, CASE WHEN lower(url) LIKE '%.pdf' THEN url ELSE url || '.pdf' END AS source_path FROM pages".replace("FROM pages", "FROM main.pages"))
_add("p10_json", r"SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' THEN replace(replace(t, ',]', ']'), ',}', '}') ELSE t END) AS answer_md5 FROM (SELECT *, regexp_replace(replace(text, 'None', 'null'), ' +', ' ', 'g') AS t FROM conversations)")
_add("p12_parent_code", r"SELECT doc_id, pos, structure, nullif(regexp_extract(structure, '^(.*)\.[^.]*$', 1), '') AS parent FROM headings")
_add("r1_toc_flags", "SELECT * FROM flags WHERE page <= 4")
_add("r3_toc_entries", "SELECT * FROM entries")
_add("r4_headings", "SELECT * FROM headings")
_add("r6_locate", "SELECT e.doc_id, e.pos, CASE WHEN count(*) FILTER (at_top) = 1 THEN min(p.page) FILTER (at_top) ELSE min(p.page) END AS physical_index, CASE WHEN count(*) FILTER (at_top) = 1 THEN 'high' ELSE 'low' END AS confidence FROM entries e LEFT JOIN (SELECT * FROM places x WHERE NOT EXISTS (SELECT 1 FROM toc_out o WHERE o.doc_id = x.doc_id AND o.page = x.page)) p ON p.doc_id = e.doc_id AND p.pos = e.pos GROUP BY e.doc_id, e.pos")
_add("w2_toc_runs", "SELECT doc_id, string_agg(page, ',' ORDER BY page) AS toc_pages FROM (SELECT *, min(run) OVER (PARTITION BY doc_id) AS first FROM (SELECT *, min(page) OVER (PARTITION BY doc_id, g) AS run FROM (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM pages WHERE (page * 7 + CAST(doc_id AS BIGINT)) % 5 < 3 AND page BETWEEN 2 AND 20))) WHERE run = first GROUP BY doc_id")
_add("w3_detect_toc", "SELECT doc_id, md5(toc_content) AS content_md5, array_to_string(toc_pages, ',') AS toc_pages, has_page_numbers FROM detected")
_add("j1_title_pairs", "SELECT * FROM pairs")
_add("a3_page_offset", "SELECT * FROM offsets")
_add("u4_apply_offset", 'SELECT e.doc_id, pos, CASE WHEN "offset" IS NULL THEN page END AS page, page + "offset" AS physical_index FROM entries e LEFT JOIN offsets o ON o.doc_id = e.doc_id')
_add("w4_evenly_spaced", "SELECT e.doc_id, e.pos FROM entries e JOIN (SELECT doc_id, count(*) AS c FROM entries GROUP BY doc_id) n ON n.doc_id = e.doc_id WHERE c <= 8 OR list_contains(list_transform(range(0, 8), lambda i: CAST(round_even(i * (c - 1) / 7.0, 0) AS BIGINT)), e.pos)")
_add("w5_prefix", "SELECT doc_id, page FROM (SELECT p.doc_id, page, sum(token_length) OVER (PARTITION BY p.doc_id ORDER BY page) AS total FROM pages p JOIN detected d ON d.doc_id = p.doc_id WHERE page > coalesce(list_max(toc_pages), 0) AND page <= coalesce(list_max(toc_pages), 0) + 6) WHERE total <= 400")
_add(
    "w6_group_pages",
    """SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS group_no, CAST(page AS INTEGER) AS page FROM (
  SELECT doc_id, g, page FROM walk UNION ALL SELECT doc_id, g, page - 1 FROM walk WHERE fresh AND page > 1)""",
)
_CTES["targets"] = "SELECT doc_id, n_tokens, ceil((n_tokens / ceil(n_tokens / 400.0) + 400) / 2.0) AS target FROM stats"
_CTES["walk"] = """SELECT t.doc_id, 1 AS page, 0 AS g, p.token_length AS size, false AS fresh, p.token_length AS own FROM targets t JOIN pages p ON p.doc_id = t.doc_id AND p.page = 1
  UNION ALL
  SELECT w.doc_id, p.page, CASE WHEN n_tokens > 400 AND w.size + p.token_length > target THEN g + 1 ELSE g END,
         CASE WHEN n_tokens > 400 AND w.size + p.token_length > target THEN w.own + p.token_length ELSE w.size + p.token_length END,
         n_tokens > 400 AND w.size + p.token_length > target, p.token_length
  FROM walk w JOIN pages p ON p.doc_id = w.doc_id AND p.page = w.page + 1 JOIN targets t ON t.doc_id = w.doc_id"""
ORACLE_SQL["w6_group_pages"] = _sql(ORACLE_SQL["w6_group_pages"])
_add("j2_neighbours", "SELECT * FROM bounds")
_add("w7_whole_window", "SELECT b.doc_id, pos, CAST(greatest(prev_index, 1) AS INTEGER) AS first_page, CAST(least(next_index, n_pages) AS INTEGER) AS last_page FROM bounds b JOIN stats ON stats.doc_id = b.doc_id WHERE greatest(prev_index, 1) <= least(next_index, n_pages)")
_add("j3_range_text", f"SELECT r.doc_id, r.pos, md5(coalesce(string_agg({_TAG} || chr(10) || text || chr(10) || {_TAG} || chr(10), '' ORDER BY page), '')) AS text_md5 FROM ranged r LEFT JOIN pages p ON p.doc_id = r.doc_id AND page BETWEEN start_index AND end_index GROUP BY r.doc_id, r.pos")
_add("u2_pages_needed", "SELECT DISTINCT doc_id, CAST(unnest(range(start_index, end_index + 1)) AS INTEGER) AS page FROM ranged")
_add("u3_append", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY 1 - pos % 2, pos) - 1 AS INTEGER) AS pos, title FROM headings")
_add("j8_title_places", "SELECT * FROM places")
_add("r5_check_titles", "SELECT doc_id, pos, physical_index, there OR at_start AS appears, at_start FROM checks")
_add("a1_doc_stats", "SELECT * FROM stats")
_add("a4_accuracy", "SELECT s.doc_id, coalesce(round(CASE WHEN last >= n_pages / 2.0 THEN right_ / all_ ELSE 0 END, 6), 0.0) AS accuracy, CAST(CASE WHEN last >= n_pages / 2.0 THEN all_ - right_ ELSE 0 END AS BIGINT) AS incorrect FROM stats s LEFT JOIN (SELECT doc_id, arg_max(physical_index, pos) AS last, CAST(count(*) FILTER (there OR at_start) AS DOUBLE) AS right_, CAST(count(*) AS DOUBLE) AS all_ FROM checks GROUP BY doc_id) c ON c.doc_id = s.doc_id")
# Repair: twice, what is wrong is looked for between the nearest items that are not.
_CTES["hplaces"] = f"SELECT s.doc_id, s.pos, n.page, n.k = t.k AS at_top FROM shifted s JOIN norms n ON n.doc_id = s.doc_id AND n.norm = {_squash('s.title')} JOIN tops t ON t.doc_id = n.doc_id AND t.page = n.page WHERE {_squash('s.title')} <> ''"
_CTES["i1"] = "SELECT doc_id, pos, physical_index, NOT (there OR at_start) AS wrong FROM checks"
for _round in (1, 2):
    _sure = "CASE WHEN NOT wrong THEN physical_index END IGNORE NULLS"
    _CTES[f"b{_round}"] = f"SELECT i.doc_id, pos, wrong, greatest(coalesce(last_value({_sure}) OVER (PARTITION BY i.doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 1) AS lo, least(coalesce(first_value({_sure}) OVER (PARTITION BY i.doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_pages), n_pages) AS hi FROM i{_round} i JOIN stats ON stats.doc_id = i.doc_id"
    _CTES[f"f{_round}"] = f"SELECT b.doc_id, b.pos, CASE WHEN count(*) FILTER (at_top) = 1 THEN min(page) FILTER (at_top) ELSE min(page) END AS found FROM b{_round} b JOIN hplaces p ON p.doc_id = b.doc_id AND p.pos = b.pos AND p.page BETWEEN lo AND hi WHERE wrong GROUP BY b.doc_id, b.pos"
    _CTES[f"i{_round + 1}"] = f"SELECT i.doc_id, i.pos, CAST(coalesce(found, physical_index) AS INTEGER) AS physical_index, wrong AND found IS NULL AS wrong FROM i{_round} i LEFT JOIN f{_round} f ON f.doc_id = i.doc_id AND f.pos = i.pos"
_add("c4_repair", "SELECT doc_id, pos, physical_index, wrong AS still_wrong FROM i3")
_add("a8_repair_report", "SELECT a.doc_id, count(*) FILTER (b.physical_index <> a.physical_index) AS fixed, count(*) FILTER (b.wrong) AS invalid, count(*) FILTER (a.physical_index > n_pages) AS truncated FROM shifted a JOIN i3 b ON b.doc_id = a.doc_id AND b.pos = a.pos JOIN stats ON stats.doc_id = a.doc_id GROUP BY a.doc_id")
_add("c6_appear_start", "SELECT doc_id, pos, at_start AS appear_start FROM checks")
_add("w11_batches", "SELECT doc_id, CAST((page - 1) // 4 AS INTEGER) AS batch, page FROM pages")
_add("w12_sample", "SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || pos || ':0'), pos) AS turn FROM headings) WHERE turn <= 5")
_add("u1_preface", "SELECT * FROM items")
_add("w1_ranges", "SELECT doc_id, pos, start_index, end_index FROM ranged")
_add("j4_parents", "SELECT doc_id, pos, structure, parent_pos FROM linked")
_add("w10_paths", "SELECT doc_id, pos, array_to_string(path, '.') AS path, CAST(len(path) - 1 AS INTEGER) AS depth FROM paths")
_add("w9_node_ids", "SELECT doc_id, pos, node_id, parent_seq, is_leaf FROM nodes")
_add("w8_large_nodes", "SELECT doc_id, 1 AS start_index, n_pages AS end_index FROM stats WHERE n_pages - 1 > 3 AND n_tokens >= 300")
_add("k3_leaf_text", "SELECT n.doc_id, node_id, md5(text) AS text_md5 FROM nodes n LEFT JOIN leaf_text t ON t.doc_id = n.doc_id AND t.node_seq = n.node_seq")
_add("a5_page_counts", "SELECT doc_id, max(end_index) AS page_count FROM nodes GROUP BY doc_id")
_add("a7_depths", "SELECT doc_id, depth, count(*) AS n_nodes FROM nodes GROUP BY ALL")
_CTES["leaf_sums"] = f"SELECT n.doc_id, n.node_seq, n.parent_seq, n.node_id, n.title, depth, {_clip('text', 200)} AS summary FROM nodes n LEFT JOIN leaf_text t ON t.doc_id = n.doc_id AND t.node_seq = n.node_seq"
for _depth in (3, 2, 1, 0):
    _below = f"sums{_depth + 1}" if _depth < 3 else "leaf_sums"
    _CTES[f"sums{_depth}"] = f"SELECT b.doc_id, b.node_seq, b.parent_seq, b.node_id, b.title, b.depth, CASE WHEN b.depth = {_depth} AND b.summary IS NULL THEN (SELECT string_agg(c.title || CASE WHEN c.summary = '' THEN '' ELSE ': ' || {_clip('c.summary', 80)} END, '; ' ORDER BY c.node_seq) FROM {_below} c WHERE c.doc_id = b.doc_id AND c.parent_seq = b.node_seq) ELSE b.summary END AS summary FROM {_below} b"
_add("k5_summaries", "SELECT doc_id, node_id, coalesce(summary, '') AS summary FROM sums0")
_add("a6_child_titles", "SELECT doc_id, parent_seq AS node_seq, string_agg(title, '|' ORDER BY node_seq) AS titles, md5(string_agg(coalesce(summary, ''), '|' ORDER BY node_seq)) AS summaries_md5 FROM sums0 WHERE parent_seq IS NOT NULL GROUP BY doc_id, parent_seq")
_add("k6_descriptions", f"SELECT doc_id, {_clip('t', 300)} AS doc_description FROM (SELECT doc_id, string_agg(title, '; ' ORDER BY node_seq) AS t FROM nodes WHERE depth = 0 GROUP BY doc_id)")
_add("p13_description_fields", "SELECT doc_id, node_seq, parent_seq, title, node_id, coalesce(summary, '') AS summary FROM sums0")
_add("k2_k4_round_trip", "SELECT doc_id, node_id, node_seq, parent_seq, depth, title, start_index, end_index, is_leaf FROM nodes")
_add("c2_path_b", "SELECT e.doc_id, e.pos, structure, title, min(p.page) AS physical_index FROM entries e LEFT JOIN (SELECT * FROM places x WHERE NOT EXISTS (SELECT 1 FROM toc_out o WHERE o.doc_id = x.doc_id AND o.page = x.page)) p ON p.doc_id = e.doc_id AND p.pos = e.pos GROUP BY ALL")
_add("c7_section_tree", "SELECT n.doc_id, node_id, depth, title, start_index, end_index, is_leaf, CAST(length(text) AS INTEGER) AS text_chars FROM nodes n LEFT JOIN leaf_text t ON t.doc_id = n.doc_id AND t.node_seq = n.node_seq")
_add("c8_list_documents", "SELECT c.doc_id, doc_name, doc_description, CAST(coalesce(max(end_index), 0) AS INTEGER) AS page_count FROM catalog c LEFT JOIN nodes n ON n.doc_id = c.doc_id GROUP BY ALL")
_add("j5_find_documents", "SELECT request_id, doc_id, error FROM q_found")
_add("c9_get_documents", "SELECT request_id, a.doc_id, doc_name, doc_description, n_pages AS page_count, CASE WHEN c.doc_id IS NOT NULL THEN 'completed' END AS status, CASE WHEN c.doc_id IS NULL THEN 'unknown document: ' || a.doc_id END AS error FROM asked a LEFT JOIN catalog c ON c.doc_id = a.doc_id LEFT JOIN stats ON stats.doc_id = a.doc_id")
_add("c11_page_content", "SELECT request_id, a.doc_id, CASE WHEN c.doc_id IS NULL OR want IS NULL THEN NULL ELSE md5(coalesce((SELECT string_agg(page || ':' || text, chr(10) ORDER BY page) FROM pages p WHERE p.doc_id = a.doc_id AND list_contains(want, page)), '')) END AS content_md5, CASE WHEN c.doc_id IS NULL THEN 'unknown document: ' || a.doc_id WHEN want IS NULL THEN 'start after end: ''5-3''' END AS error FROM asked a LEFT JOIN catalog c ON c.doc_id = a.doc_id")
_PROMPT = f"'Answer the question from these pages of ' || doc_name || '.' || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || chr(10) || string_agg({_TAG} || chr(10) || text || chr(10) || {_TAG} || chr(10) || chr(10), '' ORDER BY o)"
_CTES["q_pages"] = "SELECT request_id, doc_id, doc_name, question, x, min(i) AS o FROM (SELECT request_id, doc_id, doc_name, question, unnest(pages) AS x, generate_subscripts(pages, 1) AS i FROM q_found WHERE error IS NULL) GROUP BY ALL"
_CTES["q_text"] = f"SELECT request_id, string_agg(page, ',' ORDER BY o) AS pages, md5({_PROMPT}) AS prompt_md5 FROM q_pages q JOIN pages p ON p.doc_id = q.doc_id AND p.page = q.x GROUP BY request_id, doc_name, question"
_add("c12_answer_requests", "SELECT f.request_id, f.doc_id, t.pages, prompt_md5, CASE WHEN f.error IS NOT NULL THEN f.error WHEN prompt_md5 IS NULL THEN 'no valid page' END AS error FROM q_found f LEFT JOIN q_text t ON t.request_id = f.request_id")
_ASK = "'Is the following page part of a table of contents? Answer as JSON: {\"answer\": \"yes\" or \"no\"}.' || chr(10) || chr(10) || text"
_add("x1_requests", f"SELECT DISTINCT sha256(doc_id || chr(10) || 'toc_page' || chr(10) || {_ASK}) AS request_id, doc_id, 'toc_page' AS stage, CAST(length({_ASK}) // 4 AS INTEGER) AS est_tokens, md5({_ASK}) AS prompt_md5 FROM pages")
_add("x2_responses", "SELECT f.doc_id || '-' || f.page AS request_id, CASE WHEN is_toc THEN true END AS answer, is_toc AS at_start, CASE WHEN NOT is_toc AND f.page = 1 THEN 1 END AS physical_index, CASE WHEN NOT is_toc AND f.page = 1 THEN 'high' ELSE 'low' END AS confidence, is_toc OR f.page = 1 AS ok FROM flags f")
_add("x4_run_model", "SELECT DISTINCT doc_id, md5(text) AS text_md5, starts_with(text, 'Contents') AS is_toc FROM pages")
_add("x3_answers", "SELECT doc_id || '-' || page AS request_id, is_toc OR page = 1 AS is_toc FROM flags WHERE page <= 4")
_CTES["node_json"] = """SELECT doc_id, node_seq, parent_seq, '{"title": ' || to_json(title) || ', "node_id": "' || node_id || '", "start_index": ' || start_index || ', "end_index": ' || end_index AS j FROM nodes"""
_CTES["child_json"] = "SELECT doc_id, parent_seq, string_agg(j || '}', ', ' ORDER BY node_seq) AS js FROM node_json WHERE parent_seq IS NOT NULL GROUP BY ALL"
_CTES["tree_json"] = """SELECT n.doc_id, '[' || string_agg(j || CASE WHEN js IS NULL THEN '}' ELSE ', "nodes": [' || js || ']}' END, ', ' ORDER BY node_seq) || ']' AS structure_json FROM node_json n LEFT JOIN child_json c ON c.doc_id = n.doc_id AND c.parent_seq = n.node_seq WHERE n.parent_seq IS NULL GROUP BY n.doc_id"""
# Codes of the book view have two levels, so trees have too.
_add("k4_export", "SELECT doc_id, structure_json FROM tree_json")
_add("c10_structures", "SELECT request_id, f.doc_id, CASE WHEN error IS NULL THEN coalesce(structure_json, '[]') END AS structure_json, error FROM q_found f LEFT JOIN tree_json t ON t.doc_id = f.doc_id")
# Splitting of one node over all pages: where it is large and has headings, these stand below it. Nothing they span is large again.
_CTES["big"] = "SELECT doc_id, n_pages, n_pages - 1 > 3 AND n_tokens >= 300 AND doc_id IN (SELECT doc_id FROM headings) AS split FROM stats"
_CTES["h_starts"] = f"SELECT i.*, {_squash('title')} <> '' AND (starts_with({_squash('coalesce(text, chr(0))')}, {_squash('title')}) OR starts_with({_squashed_line('coalesce(text, chr(0))')}, {_squash('title')})) AS opens FROM headings i JOIN big ON big.doc_id = i.doc_id AND split LEFT JOIN pages p ON p.doc_id = i.doc_id AND p.page = i.physical_index"
_CTES["h_ranged"] = "SELECT s.doc_id, pos, structure, title, physical_index AS start_index, CASE WHEN lead(pos) OVER w IS NULL THEN n_pages WHEN lead(opens) OVER w THEN lead(physical_index) OVER w - 1 ELSE lead(physical_index) OVER w END AS end_index FROM h_starts s JOIN stats ON stats.doc_id = s.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY pos)"
_CTES["h_parents"] = r"SELECT a.doc_id, a.pos, max(b.pos) AS up FROM h_ranged a JOIN h_ranged b ON b.doc_id = a.doc_id AND b.structure = nullif(regexp_extract(a.structure, '^(.*)\.[^.]*$', 1), '') AND b.pos < a.pos GROUP BY a.doc_id, a.pos"
_CTES["h_nodes"] = "SELECT h.doc_id, title, start_index, end_index, CASE WHEN up IS NULL THEN [0, h.pos] ELSE [0, up, h.pos] END AS path, h.pos NOT IN (SELECT up FROM h_parents x WHERE x.doc_id = h.doc_id) AS is_leaf FROM h_ranged h LEFT JOIN h_parents u ON u.doc_id = h.doc_id AND u.pos = h.pos UNION ALL SELECT b.doc_id, 'Everything', 1, CASE WHEN split THEN (SELECT arg_min(physical_index, pos) FROM headings x WHERE x.doc_id = b.doc_id) ELSE n_pages END, [0], NOT split FROM big b"
_add("k7_split", "SELECT doc_id, printf('%04d', row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1) AS node_id, CAST(len(path) - 1 AS INTEGER) AS depth, title, CAST(start_index AS INTEGER) AS start_index, CAST(end_index AS INTEGER) AS end_index, is_leaf FROM h_nodes")
# Splitting by every second heading.
_CTES["k_headings"] = "SELECT h.doc_id, CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, structure, title, physical_index FROM headings h WHERE pos % 2 = 0"
_SPLIT = ("headings", "big", "h_starts", "h_ranged", "h_parents", "h_nodes")
for _name in _SPLIT[1:]:
    _CTES[f"k_{_name}"] = re.sub(rf"\b({'|'.join(_SPLIT)})\b", r"k_\1", _CTES[_name])
_add("k7_answered", "SELECT doc_id, printf('%04d', row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1) AS node_id, CAST(len(path) - 1 AS INTEGER) AS depth, title, CAST(start_index AS INTEGER) AS start_index, CAST(end_index AS INTEGER) AS end_index, is_leaf FROM k_h_nodes")
# Detection with answers: pages without leaders are no contents pages.
ORACLE_SQL["w3_answered"] = ORACLE_SQL["w3_detect_toc"].replace("AS is_toc FROM pages", "AS rule, contains(text, '.........') AND rule AS is_toc FROM pages")


def _windows(p: str, bounds: str, budget: int) -> str:
    """The windows w7 finds for a table of bounds, as expressions of names that begin with p; the name of the last."""
    _CTES[f"{p}_pages"] = f"SELECT b.doc_id, pos, page, token_length AS t, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY b.doc_id, pos) AS n, sum(token_length) OVER w AS s FROM {bounds} b JOIN pages p ON p.doc_id = b.doc_id AND page BETWEEN greatest(prev_index, 1) AND next_index WINDOW w AS (PARTITION BY b.doc_id, pos ORDER BY page)"
    _CTES[f"{p}_middle"] = f"SELECT doc_id, pos, n // 2 AS m, n - 1 - n // 2 AS r FROM {p}_pages GROUP BY doc_id, pos, n"
    # Pages right and left of the middle one come by turns; the turns that fit are counted by their running totals.
    _CTES[f"{p}_turns"] = f"""SELECT m.doc_id, m.pos, count(*) AS turns FROM (SELECT *, unnest(range(1, 2 * r + 1)) AS k FROM {p}_middle) m
  JOIN {p}_pages a ON a.doc_id = m.doc_id AND a.pos = m.pos AND a.i = m.m + (k + 1) // 2 JOIN {p}_pages b ON b.doc_id = m.doc_id AND b.pos = m.pos AND b.i = m.m - k // 2
  WHERE a.s - (b.s - b.t) <= {budget} GROUP BY ALL"""
    _CTES[f"{p}_reach"] = f"SELECT m.*, coalesce(turns, 0) % 2 = 1 AS right_goes, m + (coalesce(turns, 0) + 1) // 2 AS high, m - coalesce(turns, 0) // 2 AS low FROM {p}_middle m LEFT JOIN {p}_turns t ON t.doc_id = m.doc_id AND t.pos = m.pos"
    _CTES[f"{p}_ends"] = f"""SELECT w.*, lo.s - lo.t AS from_, hi.s AS to_ FROM {p}_reach w
  JOIN {p}_pages lo ON lo.doc_id = w.doc_id AND lo.pos = w.pos AND lo.i = low JOIN {p}_pages hi ON hi.doc_id = w.doc_id AND hi.pos = w.pos AND hi.i = high"""
    _CTES[f"{p}_windows"] = f"""SELECT e.doc_id, e.pos, CAST(min(CASE WHEN p.i = low OR NOT right_goes AND p.i < low AND to_ - (p.s - p.t) <= {budget} THEN page END) AS INTEGER) AS first_page,
  CAST(max(CASE WHEN p.i = high OR right_goes AND p.i > high AND p.s - from_ <= {budget} THEN page END) AS INTEGER) AS last_page
  FROM {p}_ends e JOIN {p}_pages p ON p.doc_id = e.doc_id AND p.pos = e.pos GROUP BY e.doc_id, e.pos"""
    return f"{p}_windows"


_add("w7_resolve_window", f"SELECT * FROM {_windows('w', 'bounds', 400)}")

# Path A: an offset from a sample of titles found on the first pages, and a search for what has no page then.
_LOCATED = "CASE WHEN count(*) FILTER (at_top) = 1 THEN min(p.page) FILTER (at_top) ELSE min(p.page) END"
_CTES["a_docs"] = "SELECT doc_id, coalesce(list_max(toc_pages), 0) AS after FROM detected WHERE has_page_numbers"
_CTES["a_entries"] = "SELECT e.*, after, count(*) OVER (PARTITION BY e.doc_id) AS c FROM entries e JOIN a_docs d ON d.doc_id = e.doc_id"
_CTES["a_near"] = "SELECT doc_id, page FROM (SELECT p.doc_id, page, sum(token_length) OVER (PARTITION BY p.doc_id ORDER BY page) AS total FROM pages p JOIN a_docs d ON d.doc_id = p.doc_id WHERE page > after AND page <= after + 20) WHERE total <= 6000"
_CTES["a_sample"] = "SELECT doc_id, pos, title FROM a_entries WHERE c <= 8 OR list_contains(list_transform(range(0, 8), lambda i: CAST(round_even(i * (c - 1) / 7.0, 0) AS BIGINT)), pos)"
_CTES["a_found"] = f"SELECT s.doc_id, s.pos, s.title, {_LOCATED} AS physical_index FROM a_sample s JOIN places p ON p.doc_id = s.doc_id AND p.pos = s.pos JOIN a_near n ON n.doc_id = p.doc_id AND n.page = p.page GROUP BY ALL"
_CTES["a_pairs"] = "SELECT e.doc_id, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.pos, f.pos) - 1 AS pair_order, e.page, f.physical_index FROM a_entries e JOIN a_found f ON f.doc_id = e.doc_id AND f.title = e.title WHERE f.physical_index >= after"
_CTES["a_diffs"] = "SELECT doc_id, physical_index - page AS diff, count(*) AS c, min(pair_order) AS first FROM a_pairs WHERE page IS NOT NULL GROUP BY ALL"
_CTES["a_offsets"] = "SELECT doc_id, arg_max(diff, c * 1000000 - first) AS off FROM a_diffs WHERE doc_id IN (SELECT doc_id FROM a_pairs GROUP BY doc_id HAVING count(*) >= 3) GROUP BY doc_id"
_CTES["a_items"] = "SELECT e.doc_id, pos, structure, title, CASE WHEN off IS NULL THEN page END AS page, page + off AS physical_index FROM a_entries e LEFT JOIN a_offsets o ON o.doc_id = e.doc_id"
_CTES["a_spans"] = "SELECT i.doc_id, pos, physical_index, coalesce(last_value(physical_index IGNORE NULLS) OVER (PARTITION BY i.doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_index, coalesce(first_value(physical_index IGNORE NULLS) OVER (PARTITION BY i.doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_pages) AS next_index FROM a_items i JOIN stats ON stats.doc_id = i.doc_id"
_CTES["a_bounds"] = "SELECT doc_id, pos, prev_index, next_index FROM a_spans WHERE physical_index IS NULL"
_CTES["a_rest"] = f"SELECT p.doc_id, p.pos, {_LOCATED} AS found FROM places p JOIN {_windows('a', 'a_bounds', 6000)} w ON w.doc_id = p.doc_id AND w.pos = p.pos AND p.page BETWEEN first_page AND last_page LEFT JOIN toc_out o ON o.doc_id = p.doc_id AND o.page = p.page WHERE o.page IS NULL GROUP BY p.doc_id, p.pos"
_CTES["path_a"] = "SELECT i.doc_id, i.pos, structure, title, CASE WHEN found IS NULL THEN page END AS page, CAST(coalesce(physical_index, found) AS INTEGER) AS physical_index FROM a_items i LEFT JOIN a_rest r ON r.doc_id = i.doc_id AND r.pos = i.pos"
_add("c1_path_a", "SELECT * FROM path_a")

# The cascade: each path's items are checked; what fails goes to the next path.
_CTES["path_b"] = "SELECT e.doc_id, e.pos, structure, title, min(p.page) AS physical_index FROM entries e LEFT JOIN (SELECT x.* FROM places x LEFT JOIN toc_out o ON o.doc_id = x.doc_id AND o.page = x.page WHERE o.page IS NULL) p ON p.doc_id = e.doc_id AND p.pos = e.pos GROUP BY ALL"
_CTES["path_c"] = "SELECT * FROM headings"


def _judged(p: str, docs: str) -> None:
    """Items of one path for docs, with their outcome: checked, and repaired in two rounds where enough of them are right."""
    t = _squash("title")
    _CTES[f"{p}_n"] = f"SELECT i.doc_id, CAST(row_number() OVER (PARTITION BY i.doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, structure, title, CASE WHEN physical_index <= n_pages THEN physical_index END AS physical_index FROM path_{p} i JOIN {docs} d ON d.doc_id = i.doc_id JOIN stats ON stats.doc_id = i.doc_id WHERE physical_index IS NOT NULL"
    _CTES[f"{p}_checks"] = f"SELECT n.doc_id, pos, {t} <> '' AND (contains({_squash('coalesce(text, chr(0))')}, {t}) OR starts_with({_squashed_line('coalesce(text, chr(0))')}, {t})) AS appears FROM {p}_n n LEFT JOIN pages p ON p.doc_id = n.doc_id AND p.page = n.physical_index WHERE n.physical_index IS NOT NULL"
    _CTES[f"{p}_sums"] = f"SELECT n.doc_id, arg_max(physical_index, n.pos) AS last, avg(CASE WHEN appears THEN 1.0 ELSE 0.0 END) AS rate, count(*) FILTER (NOT appears) AS wrong FROM {p}_n n JOIN {p}_checks c ON c.doc_id = n.doc_id AND c.pos = n.pos GROUP BY n.doc_id"
    _CTES[f"{p}_rates"] = f"SELECT d.doc_id, CASE WHEN last >= n_pages / 2.0 AND rate = 1 AND wrong = 0 THEN 'accepted' WHEN last >= n_pages / 2.0 AND rate > 0.6 AND wrong > 0 THEN 'repaired' ELSE '{'best effort' if p == 'c' else 'next'}' END AS outcome FROM {docs} d JOIN stats ON stats.doc_id = d.doc_id LEFT JOIN {p}_sums s ON s.doc_id = d.doc_id"
    _CTES[f"{p}_lines"] = f"SELECT s.doc_id, s.pos, n.page, n.k = t.k AS at_top FROM {p}_n s JOIN norms n ON n.doc_id = s.doc_id AND n.norm = {_squash('s.title')} JOIN tops t ON t.doc_id = n.doc_id AND t.page = n.page WHERE {_squash('s.title')} <> ''"
    _CTES[f"{p}_i1"] = f"SELECT n.doc_id, n.pos, physical_index, coalesce(NOT appears, false) AS wrong FROM {p}_n n LEFT JOIN {p}_checks c ON c.doc_id = n.doc_id AND c.pos = n.pos"
    for k in (1, 2):
        sure = "CASE WHEN NOT wrong THEN physical_index END IGNORE NULLS"
        _CTES[f"{p}_b{k}"] = f"SELECT i.doc_id, pos, wrong, greatest(coalesce(last_value({sure}) OVER (PARTITION BY i.doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 1) AS lo, least(coalesce(first_value({sure}) OVER (PARTITION BY i.doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_pages), n_pages) AS hi FROM {p}_i{k} i JOIN stats ON stats.doc_id = i.doc_id"
        _CTES[f"{p}_f{k}"] = f"SELECT b.doc_id, b.pos, {_LOCATED} AS found FROM {p}_b{k} b JOIN {p}_lines p ON p.doc_id = b.doc_id AND p.pos = b.pos AND p.page BETWEEN lo AND hi WHERE wrong GROUP BY b.doc_id, b.pos"
        _CTES[f"{p}_i{k + 1}"] = f"SELECT i.doc_id, i.pos, coalesce(found, physical_index) AS physical_index, wrong AND found IS NULL AS wrong FROM {p}_i{k} i LEFT JOIN {p}_f{k} f ON f.doc_id = i.doc_id AND f.pos = i.pos"
    _CTES[f"{p}_out"] = f"SELECT n.doc_id, n.pos, structure, title, CAST(CASE WHEN outcome = 'repaired' THEN i.physical_index ELSE n.physical_index END AS INTEGER) AS physical_index, '{p.upper()}' AS path, outcome FROM {p}_n n JOIN {p}_rates r ON r.doc_id = n.doc_id AND outcome <> 'next' JOIN {p}_i3 i ON i.doc_id = n.doc_id AND i.pos = n.pos"


_judged("a", "a_docs")
_CTES["b_docs"] = "SELECT doc_id FROM a_rates WHERE outcome = 'next'"
_judged("b", "b_docs")
_CTES["c_docs"] = "SELECT doc_id FROM b_rates WHERE outcome = 'next' UNION ALL SELECT s.doc_id FROM stats s LEFT JOIN a_docs a ON a.doc_id = s.doc_id WHERE a.doc_id IS NULL"
_judged("c", "c_docs")
_CTES["cascade"] = "SELECT * FROM a_out UNION ALL SELECT * FROM b_out UNION ALL SELECT * FROM c_out"
_add("c5_cascade", "SELECT * FROM cascade")

# The whole job: the tree of the cascade's items, with summaries and descriptions. Its leaves are all too short to be split.
_CTES["x_headings"] = "SELECT doc_id, pos, structure, title, physical_index FROM cascade WHERE physical_index IS NOT NULL"
_TREE = ("headings", "firsts", "items", "starts", "ranged", "ups", "parents", "linked", "paths", "seqs", "nodes", "leaf_text", "leaf_sums", "sums3", "sums2", "sums1", "sums0")
for _name in _TREE[1:]:
    _CTES[f"x_{_name}"] = re.sub(rf"\b({'|'.join(_TREE)})\b", r"x_\1", _CTES[_name])
_CTES["x_json"] = """SELECT n.doc_id, n.node_seq, n.parent_seq, '{"title": ' || to_json(n.title) || ', "node_id": "' || n.node_id || '", "start_index": ' || start_index || ', "end_index": ' || end_index || ', "summary": ' || to_json(coalesce(summary, '')) AS j FROM x_nodes n JOIN x_sums0 s ON s.doc_id = n.doc_id AND s.node_seq = n.node_seq"""
_CTES["x_child_json"] = "SELECT doc_id, parent_seq, string_agg(j || '}', ', ' ORDER BY node_seq) AS js FROM x_json WHERE parent_seq IS NOT NULL GROUP BY ALL"
_CTES["x_tree_json"] = """SELECT n.doc_id, '[' || string_agg(j || CASE WHEN js IS NULL THEN '}' ELSE ', "nodes": [' || js || ']}' END, ', ' ORDER BY node_seq) || ']' AS structure_json FROM x_json n LEFT JOIN x_child_json c ON c.doc_id = n.doc_id AND c.parent_seq = n.node_seq WHERE n.parent_seq IS NULL GROUP BY n.doc_id"""
_CTES["x_described"] = f"SELECT doc_id, {_clip('t', 300)} AS doc_description FROM (SELECT doc_id, string_agg(title, '; ' ORDER BY node_seq) AS t FROM x_nodes WHERE depth = 0 GROUP BY doc_id)"
_add("c7_build_index", "SELECT s.doc_id, s.doc_id AS doc_name, doc_description, coalesce(structure_json, '[]') AS structure_json FROM stats s LEFT JOIN x_tree_json t ON t.doc_id = s.doc_id LEFT JOIN x_described d ON d.doc_id = s.doc_id")
