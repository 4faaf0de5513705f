"""DuckDB SQL for the queries of plans.corpus. That engine has no look-behind and ASCII classes only, so sentences are cut at a
mark that replaces the blanks behind a full stop, and words are bounded by what stands beside them."""

from lexweave.plans.corpus import GLOSSARY

# Fixed values, written here once more so that the SQL stands on its own: white space, line ends, the forms of report lines.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NUMBERED = rf"^([A-D]\d+(?:\.\d+)+){WS}+(.*)$"
FIRST_LEVEL = rf"^([A-D]\d){WS}+(.*)$"
FIGURE = rf"^Figure{WS}+(SPM\.\d+):{WS}+(.*)$"
ITEM = rf"^(?:#{{1,6}}{WS}+)?\[(ES\d+\.\d+(?:\.\d+)?)\]{WS}+(.*)$"
ASSESSMENT = r"(?i)\((?:very |high |medium |low )?(?:confidence|agreement|evidence)(?:,\s*(?:very |high |medium |low )?(?:confidence|agreement|evidence))?\)|\{[^}]*\}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def cut(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))"


def exploded(source: str, keep: str, items: str, at: str, name: str) -> str:
    return f"SELECT {keep}, unnest(range(len({items}))) AS {at}, unnest({items}) AS {name} FROM {source}"


def bounded(text: str, term: str) -> str:
    """Whether a constant term stands in text with no word character beside it; the plain search goes first."""
    return rf"(contains({text}, '{term}') AND regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}_]){term}($|[^\p{{L}}\p{{N}}_])'))"


_rows = ", ".join("(" + ", ".join([str(i), *("'" + x.replace("'", "''") + "'" for x in g)]) + ")" for i, g in enumerate(GLOSSARY))
GLOSS = f"""
gloss_raw(pos, term, explanation, parent, source) AS (VALUES {_rows}),
gloss AS (
  SELECT {fold('term')} AS term_key, term, explanation, parent, source, CASE source WHEN 'first' THEN 0 WHEN 'second' THEN 1 ELSE 2 END AS src_rank, min(pos) AS load_pos
  FROM gloss_raw WHERE term <> '' AND explanation <> '' AND source <> '' GROUP BY ALL
),
terms AS (SELECT term_key, arg_min(term, (src_rank, source, load_pos)) AS term FROM gloss GROUP BY term_key)"""
PARTS = f"""
part_raw AS (
  SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || ' ' || p_size AS term,
         ['See ' || p_type || '.', 'See also ' || p_type, 'See x (under ' || p_brand || ').', 'see ' || p_name || ' (under a (b)).', 'means ' || p_type, p_type || ' ' || p_partkey][p_partkey % 6 + 1] AS explanation,
         CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS parent, p_brand AS source FROM part
),
gloss AS (
  SELECT {fold('term')} AS term_key, term, explanation, parent, source, CASE source WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 ELSE 2 END AS src_rank, min(pos) AS load_pos
  FROM part_raw GROUP BY ALL
),
terms AS (SELECT term_key, arg_min(term, (src_rank, source, load_pos)) AS term FROM gloss GROUP BY term_key)"""
KEYS = sorted({g[0].lower() for g in GLOSSARY if g[0]})

DOC_SENTENCES = f"""
doc_lines AS ({exploded('documents', 'doc_id AS doc', f"CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '(?:{LINE_END})$', ''), '{LINE_END}') END", 'pos', 'line')}),
doc_cut AS ({exploded('doc_lines', 'doc, pos', cut('line'), 'sp', 'raw')}),
doc_sentences AS (SELECT doc, pos, sp, {strip('raw')} AS sentence FROM doc_cut WHERE {strip('raw')} <> '')"""

MARKED = """
kinds AS (SELECT *, ((conv_id * 7 + turn * 3) % 11)::INTEGER AS kind, replace(text, chr(10), ' ') AS body, substr('ABCD', (conv_id % 4 + 1)::INTEGER, 1) AS letter FROM conversations),
marked AS (
  SELECT conv_id // 40 AS doc, conv_id * 1000 + turn AS pos, CASE
    WHEN kind = 0 THEN '# Talk ' || conv_id
    WHEN kind = 1 THEN '## Section ' || substr('ABCDQ', (conv_id % 5 + 1)::INTEGER, 1) || ': talk'
    WHEN kind = 2 THEN letter || (turn % 9 + 1) || '  ' || body
    WHEN kind IN (3, 4, 9) THEN letter || (conv_id % 3 + 1) || '.' || (turn + 1) || ' ' || body || ' {1.' || turn || '; 2.' || (conv_id % 17) || ' , CCB; 1.' || turn || '}'
    WHEN kind = 5 THEN 'Figure SPM.' || (turn + 1) || ': ' || body
    WHEN kind = 6 AND conv_id % 3 = 0 THEN 'Table of Contents'
    WHEN kind = 7 THEN '## Introduction'
    WHEN kind = 8 THEN '[ES' || (conv_id % 5 + 1) || '.' || (turn + 1) || '.' || (conv_id % 9 + 1) || '] ' || body
    ELSE body || ' (high confidence)' END AS line
  FROM kinds
)"""
SECTION_LIST = "['Author Team', 'Introduction', 'Section A', 'Section B', 'Section C', 'Section D']"
REPORT = f"""{MARKED},
bare AS (SELECT doc, pos, {collapse('line')} AS line FROM marked WHERE {collapse('line')} <> ''),
events_of AS (
  SELECT *, starts_with(line, '## ') AS is_heading, lower(line) = 'table of contents' AS is_contents, lower(trim(substr(line, 4))) AS heading FROM bare
),
named AS (
  SELECT *, CASE WHEN NOT is_heading THEN NULL WHEN heading = 'introduction' THEN 'Introduction'
    WHEN regexp_matches(heading, '^section [a-d]') THEN 'Section ' || upper(substr(heading, 9, 1)) ELSE '' END AS name,
    CASE WHEN is_heading THEN false WHEN is_contents THEN true END AS toc
  FROM events_of
),
state AS (
  SELECT doc, pos, line, is_heading OR is_contents OR starts_with(line, '# ') AS marker,
    coalesce(last_value(name IGNORE NULLS) OVER w, 'Author Team') AS section, coalesce(last_value(toc IGNORE NULLS) OVER w, false) AS in_toc
  FROM named WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
report AS (
  SELECT doc, section, list_position({SECTION_LIST}, section)::INTEGER AS section_rank, pos, line FROM state WHERE NOT marker AND NOT in_toc AND section <> ''
),
titles AS (
  SELECT doc, coalesce(arg_max(nullif(trim(substr(line, 3)), ''), pos) FILTER (starts_with(line, '# ') AND trim(substr(line, 3)) <> ''), 'untitled') AS title FROM bare GROUP BY doc
)"""
STATED = f"""{REPORT},
is_fig AS (SELECT *, starts_with(section, 'Section ') AND regexp_matches(line, '{FIGURE}') AS whole FROM report),
stated AS (
  SELECT doc, section_rank, pos,
    CASE WHEN whole THEN substr(section, 9) || '-Figure ' || regexp_extract(line, '{FIGURE}', 1) WHEN regexp_matches(line, '{NUMBERED}') THEN regexp_extract(line, '{NUMBERED}', 1)
      WHEN regexp_matches(line, '{FIRST_LEVEL}') THEN regexp_extract(line, '{FIRST_LEVEL}', 1) ELSE section END AS statement,
    CASE WHEN whole THEN regexp_extract(line, '{FIGURE}', 2) WHEN regexp_matches(line, '{NUMBERED}') THEN regexp_extract(line, '{NUMBERED}', 2)
      WHEN regexp_matches(line, '{FIRST_LEVEL}') THEN regexp_extract(line, '{FIRST_LEVEL}', 2) ELSE line END AS statement_text,
    whole
  FROM is_fig
),
items AS (
  SELECT doc, pos, regexp_extract({strip('line')}, '{ITEM}', 1) AS statement, regexp_extract({strip('line')}, '{ITEM}', 2) AS statement_text FROM marked WHERE regexp_matches({strip('line')}, '{ITEM}')
)"""
SENTENCES = f"""{STATED},
parts AS (
  {exploded('stated', 'doc, 0 AS origin, section_rank, pos, statement, statement_text', f"CASE WHEN whole THEN [statement_text] ELSE {cut('statement_text')} END", 'sp', 'raw')}
  UNION ALL {exploded('items', 'doc, 1 AS origin, 0 AS section_rank, pos, statement, statement_text', cut(collapse('statement_text')), 'sp', 'raw')}
),
sentences AS (SELECT doc, origin, section_rank, pos, sp::INTEGER AS sp, statement, {strip('raw')} AS sentence, statement_text FROM parts WHERE {strip('raw')} <> '')"""
CITED = f"""{REPORT},
numbered AS (SELECT doc, section_rank, pos, regexp_extract(line, '{NUMBERED}', 1) AS statement, regexp_extract(line, '{NUMBERED}', 2) AS body FROM report WHERE regexp_matches(line, '{NUMBERED}')),
blocks AS (SELECT *, list_filter(list_transform(flatten(list_transform(regexp_extract_all(body, '\\{{([^}}]*)\\}}', 1), lambda b: regexp_split_to_array(b, '[;,]'))), lambda p: {collapse('p')}), lambda p: regexp_matches(p, '^\\d+(?:\\.\\d+)+$')) AS refs FROM numbered),
each_ref AS ({exploded('blocks', 'doc, section_rank, pos, statement', 'refs', 'nth', 'reference')}),
first_ref AS (SELECT doc, section_rank, pos, statement, reference, min(nth) AS nth FROM each_ref GROUP BY ALL),
cited AS (SELECT doc, section_rank, pos, (row_number() OVER (PARTITION BY doc, section_rank, pos ORDER BY nth) - 1)::INTEGER AS ref_pos, statement, reference FROM first_ref)"""
NODES_OF = """
labels AS (
  SELECT DISTINCT 0 AS side, statement AS label, substr(statement, 1, 1) AS letter, list_transform(string_split(substr(statement, 2), '.'), lambda p: p::INTEGER) AS parts FROM cited {where}
  UNION SELECT DISTINCT 1, reference, '', list_transform(string_split(reference, '.'), lambda p: p::INTEGER) FROM cited {where}
),
sankey AS (SELECT row_number() OVER (ORDER BY side, letter, parts, label) - 1 AS node_index, label, side::INTEGER AS side, CASE side WHEN 0 THEN 0.02::DOUBLE ELSE 0.98::DOUBLE END AS x FROM labels)"""


def hits(source: str, text: str) -> str:
    """hits: the rows of source with each term, one branch for each so that every pattern is constant."""
    return "hits AS (" + " UNION ALL ".join(f"SELECT '{k}' AS term_key, * FROM {source} WHERE {bounded(text, k)}" for k in KEYS) + ")"


FOLDED = f"{SENTENCES}, {GLOSS}, folded AS (SELECT *, {fold('sentence')} AS f FROM sentences), {hits('folded', 'f')}, usage AS (SELECT k.term_key, count(h.term_key)::BIGINT AS n FROM (SELECT DISTINCT term_key FROM gloss) AS k LEFT JOIN hits AS h ON h.term_key = k.term_key GROUP BY 1)"
NETWORK = f"""{FOLDED},
clean AS (SELECT *, {fold(f"regexp_replace(sentence, '{ASSESSMENT}', '', 'g')")} AS c FROM sentences),
clean_hits AS ({' UNION ALL '.join(f"SELECT '{k}' AS term_key, * FROM clean WHERE {bounded('c', k)}" for k in KEYS)}),
pairs AS (
  SELECT a.term_key AS source, b.term_key AS target, a.origin, a.section_rank, a.doc, a.pos, a.sp, a.statement, a.sentence
  FROM clean_hits AS a JOIN clean_hits AS b ON (a.origin, a.section_rank, a.doc, a.pos, a.sp) = (b.origin, b.section_rank, b.doc, b.pos, b.sp) AND a.term_key < b.term_key
),
nodes AS (SELECT u.term_key AS id, t.term AS label, u.n AS count FROM usage AS u JOIN terms AS t ON t.term_key = u.term_key WHERE u.n > 0),
edges AS (
  SELECT source, target, count(*)::BIGINT AS weight, array_to_string(list_sort(list(DISTINCT statement)), ',') AS statements,
    string_agg(statement || ': ' || sentence, chr(10) ORDER BY origin, section_rank, doc, pos, sp) AS evidence
  FROM pairs GROUP BY source, target
),
kept_edges AS (SELECT e.* FROM edges AS e WHERE weight BETWEEN 2 AND 100000 AND source IN (SELECT id FROM nodes WHERE count BETWEEN 2 AND 100000) AND target IN (SELECT id FROM nodes WHERE count BETWEEN 2 AND 100000))"""
DEFS = "list({} ORDER BY src_rank, source, load_pos, term, explanation, parent)"
#: Each value at its first place.
ONCE = f"list_transform(list_filter(list_zip({DEFS}, range(len({DEFS}))), lambda z: list_position({DEFS}, z[1]) = z[2] + 1), lambda z: z[1])".replace("{}", "{0}")
SOURCES = "CASE WHEN bool_or(source = 'first') AND bool_or(source = 'second') THEN 'first + second' WHEN bool_or(source = 'first') THEN 'first' WHEN bool_or(source = 'second') THEN 'second' ELSE '' END"


def overview(issue: str, where: str) -> str:
    return f"""WITH {FOLDED}, labelled AS (SELECT term_key, {SOURCES} AS sources FROM gloss GROUP BY term_key),
    listed AS (SELECT t.term_key, t.term, u.n, l.sources, {issue} AS issue FROM terms AS t JOIN usage AS u ON u.term_key = t.term_key JOIN labelled AS l ON l.term_key = t.term_key)
    SELECT row_number() OVER (ORDER BY lower(term), term_key)::INTEGER AS place, * FROM listed {where}"""


def chars_at(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({x}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"


ESCAPED = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""

PARAGRAPHS = f"""
paragraphs AS (
  SELECT conv_id // 40 AS doc, conv_id * 1000 + turn AS pos, turn % 2 = 0 AS is_term, turn % 4 = 2 AS is_sub,
    {collapse("CASE WHEN turn % 2 = 0 THEN role || ' ' || (conv_id % 7) WHEN turn % 7 = 3 THEN 'See ' || role ELSE text END")} AS text,
    ((conv_id + turn * 2) % 11)::INTEGER AS style
  FROM conversations
)"""
ANCHORED = f"""{STATED},
unit_keys AS (SELECT *, {fold(collapse('statement'))} AS number_key, {fold(collapse('statement_text'))} AS text_key FROM stated),
first_units AS (SELECT doc, number_key, text_key, min((section_rank, pos)) AS place FROM unit_keys GROUP BY ALL),
anchors AS (SELECT doc, number_key, text_key, 'source-statement-' || row_number() OVER (PARTITION BY doc ORDER BY place) AS anchor FROM first_units)"""

ALTERNATION = "(?i)(?:" + "|".join(sorted(KEYS, key=lambda k: (-len(k), k))) + ")"


def escape(x: str) -> str:
    return ESCAPED.replace("(text,", f"({x},")


def glued(beside: str) -> str:
    return f"regexp_matches({beside}, '[\\p{{L}}\\p{{N}}_]')"


# m: the spans that the alternation takes, g: what stands before, between and behind them; a span counts if no word goes on at its ends
SPANS = f"regexp_extract_all(x, '{ALTERNATION}') AS m, regexp_split_to_array(x, '{ALTERNATION}') AS g"
FREE = f"""(NOT {glued("CASE WHEN g[i] <> '' THEN right(g[i], 1) WHEN i > 1 THEN right(m[i - 1], 1) ELSE ' ' END")} AND NOT {glued("CASE WHEN g[i + 1] <> '' THEN left(g[i + 1], 1) WHEN i < len(m) THEN left(m[i + 1], 1) ELSE ' ' END")})"""
LINKED = f"""{escape('g[1]')} || array_to_string(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN {FREE} THEN '<a href="#" data-term="' || labels[lower(m[i])] || '">' || {escape('m[i]')} || '</a>' ELSE {escape('m[i]')} END || {escape('g[i + 1]')}), '')"""
ANCHORED_TERMS = LINKED.replace("""'<a href="#" data-term="' || labels[lower(m[i])] || '">'""", """'<a class="glossary-link" href="#term-' || replace(lower(m[i]), ' ', '-') || '">'""")
LABELS = "labels AS (SELECT map(list(term_key), list(term)) AS labels FROM terms)"
MARKED_TURNS = """
WITH t AS (
  SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' +', ' ', 'g')) AS b FROM conversations
)
SELECT conv_id, turn, md5(concat(
  '<h2>', role, '</h2>', chr(10), '<blockquote>', chr(10), '<p><em><strong>', b, '</strong></em> and <a href="/u" title="t">the <em>', b, '</em></a>', chr(10),
  'lazy<br />', chr(10), 'end</p>', chr(10), '</blockquote>', chr(10), '<ol start="7">', chr(10), '<li><code>', b, '</code></li>', chr(10),
  '<li>', chr(10), '<ul>', chr(10), '<li>', chr(10), '<p><img src="/i" alt="x y" /></p>', chr(10), '</li>', chr(10), '<li>', chr(10),
  '<p><strong>', b, '</strong> &amp; &lt;b&gt;</p>', chr(10), '<p><em>code</em></p>', chr(10), '</li>', chr(10), '</ul>', chr(10), '</li>', chr(10), '</ol>', chr(10),
  '<h1>', b, '</h1>', chr(10), '<pre><code class="language-py">', b, ' *x*', chr(10), '</code></pre>', chr(10),
  '<p>snake_case_x <a href="a%20b" title="q">r</a> *open</p>', chr(10))) AS html_md5,
  md5(concat(role, ' ', b, ' and the ', b, ' lazy end ', b, ' ', b, ' & <b> code ', b, ' ', b, ' *x* snake_case_x r *open')) AS plain_md5
FROM t WHERE b <> ''
"""
UNESCAPED = "replace(replace(replace(replace(x, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
# the furniture of pages and the blanks that end a line, as the cleaning sees them
FURNITURE = r"^\d{1,3}$|(?i)do\s+not\s+cite,\s*quote\s+or\s+distribute|(?i)total\s+pages\s*:\s*\d+"
JOIN_WORDS = r"regexp_replace({}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
CLEANED = f"""raw AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda l: regexp_replace(l, '{WS}+$', '')) AS rows FROM documents),
joined AS (SELECT doc_id, array_to_string(list_filter(rows, lambda l: NOT regexp_matches({strip('l')}, '{FURNITURE}')), chr(10)) AS x FROM raw),
words AS (SELECT doc_id, string_split({JOIN_WORDS.format(JOIN_WORDS.format('x'))}, chr(10)) AS rows FROM joined),
cleaned AS (SELECT doc_id, {strip(f"regexp_replace(array_to_string(list_transform(rows, lambda l: regexp_replace(l, '([^ ]){WS}+[0-9]{{1,3}}$', '\\1')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS x FROM words)"""
BESIDE = r"[^\p{L}\p{N}_\x01\x02]"


def marked_once(x: str) -> str:
    """x with the word between two characters that no text holds; twice, as neighbours share the blank between them."""
    return f"regexp_replace({x}, '(?i)(^|{BESIDE})(the)($|{BESIDE})', " + r"'\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"



#: The sections of the exported reports, as parts (doc, section_rank, html) and every (doc, section).
REPORT_HTML = f"""{STATED}, {GLOSS}, {LABELS},
      keyed AS (SELECT *, {fold(collapse('statement'))} AS number_key, {fold(collapse('statement_text'))} AS text_key FROM stated),
      anchors AS (SELECT number_key, text_key, 'source-statement-' || row_number() OVER (ORDER BY min((section_rank, pos))) AS anchor FROM keyed GROUP BY ALL),
      shown AS (SELECT k.doc, k.section_rank, k.pos, CASE WHEN row_number() OVER (PARTITION BY k.number_key, k.text_key ORDER BY section_rank, pos) = 1 THEN ' id="' || anchor || '" class="statement-target"' ELSE '' END AS attributes FROM keyed AS k JOIN anchors AS a ON (a.number_key, a.text_key) = (k.number_key, k.text_key)),
      t AS (SELECT r.doc, r.section_rank, r.pos, r.line AS x, attributes, CASE WHEN regexp_matches(line, '{FIRST_LEVEL}') THEN 'h4' ELSE 'p' END AS tag, labels FROM report AS r JOIN shown AS s ON (s.doc, s.section_rank, s.pos) = (r.doc, r.section_rank, r.pos), labels),
      cuts AS (SELECT *, {SPANS} FROM t),
      lines AS (SELECT doc, section_rank, string_agg('<' || tag || attributes || '>' || {ANCHORED_TERMS} || '</' || tag || '>', chr(10) ORDER BY pos) AS html FROM cuts GROUP BY doc, section_rank),
      every AS (SELECT doc, unnest({SECTION_LIST}) AS section, unnest(range(1, 7)) AS section_rank FROM (SELECT DISTINCT doc FROM report)),
      parts AS (SELECT e.doc, e.section_rank, '<section id="report-' || e.doc || '-' || replace(lower(section), ' ', '-') || '">' || chr(10) || '<h3>' || section || '</h3>' || chr(10) || coalesce(html, '<p>No content parsed for this section.</p>') || chr(10) || '</section>' AS html FROM every AS e LEFT JOIN lines AS l ON l.doc = e.doc AND l.section_rank = e.section_rank)"""
ORACLE_SQL = {
    "clean_pages": f"WITH {CLEANED} SELECT doc_id, md5(x) AS clean_md5 FROM cleaned",
    "highlighted": f"SELECT item_id, replace(replace({marked_once(marked_once(ESCAPED))}, chr(1), '<mark>'), chr(2), '</mark>') AS html FROM benchmark",
    "linked_items": f"WITH {GLOSS}, {LABELS}, t AS (SELECT item_id, text AS x, labels FROM benchmark, labels), s AS (SELECT *, {SPANS} FROM t), p AS (SELECT *, list_filter(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN {FREE} THEN lower(m[i]) END), lambda k: k IS NOT NULL) AS keys FROM s) SELECT item_id, {LINKED} AS html, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(keys), lambda k: [list_position(keys, k)::VARCHAR.lpad(9, '0'), k])), lambda y: y[2]), ','), '') AS terms FROM p",
    "linked_pages": f"""WITH {GLOSS}, {LABELS}, cuts AS (SELECT page_id, regexp_extract_all(html, '<[^>]+>') AS tags, regexp_split_to_array(html, '<[^>]+>') AS texts FROM pages),
      each_text AS (SELECT page_id, unnest(range(1, len(texts) + 1)) * 2 AS nth, unnest(texts) AS x, 'text' AS kind FROM cuts),
      each_tag AS (SELECT page_id, unnest(range(1, len(tags) + 1)) * 2 + 1 AS nth, unnest(tags) AS x FROM cuts),
      named AS (SELECT *, CASE WHEN regexp_matches(x, '^</?[a-zA-Z]') THEN 'tag' ELSE 'text' END AS kind FROM each_tag),
      parts AS (SELECT *, CASE WHEN kind = 'tag' AND lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) = 'a' THEN CASE WHEN starts_with(x, '</') THEN -1 WHEN ends_with(x, '/>') THEN 0 ELSE 1 END ELSE 0 END AS step FROM (SELECT * FROM each_text UNION ALL BY NAME SELECT * FROM named)),
      deep AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS depth FROM parts),
      open AS (SELECT page_id, nth, {UNESCAPED} AS x, labels FROM deep, labels WHERE kind = 'text' AND depth = 0),
      spans AS (SELECT *, {SPANS} FROM open),
      made AS (SELECT page_id, nth, {LINKED} AS x FROM spans UNION ALL SELECT page_id, nth, x FROM deep WHERE kind = 'tag' OR depth <> 0)
      SELECT page_id, string_agg(x, '' ORDER BY nth) AS html FROM made GROUP BY page_id""",
    "html_reports": f"WITH {REPORT_HTML} SELECT doc, md5(string_agg(html, chr(10) ORDER BY section_rank)) AS html_md5 FROM parts GROUP BY doc",
    "report_page_file": f"""WITH {REPORT_HTML},
      told AS (SELECT unnest(string_split(html, chr(10))) AS line FROM parts UNION ALL SELECT '<a href="#report-' || doc || '-' || replace(lower(section), ' ', '-') || '">' || doc || ' ' || section || '</a>' FROM every)
      SELECT md5(line) AS line_md5, count(*) AS n FROM told GROUP BY line""",
    "marked_turns": MARKED_TURNS,
    "markdown_items": f"SELECT item_id, '<p>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p>' || chr(10) AS html, {collapse('text')} AS plain FROM benchmark",
    "document_files": """WITH l AS (SELECT conv_id AS doc, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS pos, turn, role, text FROM conversations)
      SELECT doc, pos, ['Heading 2', '0th Level Chapter Heading', 'X 1st level heading', '2nd level heading ', '3rd level heading', '4th level heading', 'Normal', 'heading  12', 'My 3rd level', 'heading 0', '2nd level Heading 3'][turn % 11 + 1] AS style, CASE WHEN turn % 2 = 1 THEN turn * 1.5::DOUBLE END AS left_indent_pt, 2::BIGINT AS runs, CASE turn % 3 WHEN 1 THEN true WHEN 2 THEN false END AS bold, role || ' & <' || text || '>' AS text FROM l""",
    "workbook_files": f"WITH n AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::BIGINT AS pos FROM part) SELECT p_brand AS brand, pos, {collapse('p_name')} AS term, {collapse('p_type')} AS explanation, '' AS parent FROM n WHERE p_partkey % 7 <> 0",
    "archive_files": "SELECT conv_id AS archive, turn || '.txt' AS name, sha256(text) AS sha256 FROM conversations",
    "sealed_texts": "SELECT conv_id, turn, (4 * ((57 + 16 * (strlen(text) // 16 + 1) + 2) // 3))::BIGINT AS token_chars, sha256(text) AS sha256 FROM conversations",
    "markdown_files": f"WITH {MARKED} SELECT doc, md5(regexp_replace(string_agg(line, chr(10) || chr(10) ORDER BY pos), '\\n+$', '')) AS text_md5 FROM marked GROUP BY doc",
    "pdf_files": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      p AS (SELECT doc_id, t, unnest(range(0, greatest((length(t) + 3999) // 4000, 1))) AS page FROM d),
      l AS (SELECT doc_id, page, substring(t, (page * 4000 + 1)::BIGINT, 4000) AS t FROM p)
      SELECT doc_id, page, md5(array_to_string(list_transform(range(0, (length(t) + 79) // 80), lambda j: substring(t, (j * 80 + 1)::BIGINT, 80)), chr(10))) AS text_md5 FROM l""",
    "artifact_file": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Term ' ELSE 'term ' END || (doc_id - doc_id % 2) AS term_key, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'said é ' || doc_id END AS summary FROM documents)
      SELECT term_key, 'summary' AS kind, summary AS value FROM d UNION ALL SELECT term_key, 'failure', 'error' FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT lower(term_key), 'usable', arg_max(summary, doc_id) FROM d WHERE summary <> ' ' GROUP BY lower(term_key)""",
    "stamps": """WITH m AS (SELECT event_id, ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 182 DAY ELSE INTERVAL 0 DAY END AS moment, event_id % 2 = 0 AS summer FROM events)
      SELECT event_id, strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS utc, CASE WHEN summer THEN strftime(moment + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00' ELSE strftime(moment + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+01:00' END AS paris FROM m""",
    "settings": """SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN 'a' || turn WHEN 2 THEN '"' || role || '''' ELSE CASE WHEN conv_id % 2 = 0 THEN role END END AS value FROM conversations""",
    "run_lines": """WITH k AS (SELECT conv_id AS doc, turn AS pos, role, (conv_id + turn) % 6 AS kind, conv_id % 4 = 0 AS third FROM conversations),
      m AS (SELECT *, CASE kind WHEN 0 THEN '**' || role || ' ' || pos || '**' WHEN 1 THEN '(*' || role || '*) ' || pos WHEN 2 THEN '__' || role || '__ and *' || pos || '*' WHEN 3 THEN '__*' || role || '-' || pos || '*__' ELSE role || ' ' || pos END AS x FROM k WHERE kind <> 4)
      SELECT doc, pos, CASE WHEN third THEN '### ' WHEN kind = 0 THEN '## ' ELSE '' END || x AS line FROM m""",
    "chapters": "SELECT conv_id, turn, conv_id::INTEGER AS chapter FROM conversations",
    "report_without_section": f"WITH {REPORT} SELECT * FROM report WHERE section <> 'Section B'",
    "first_terms": f"WITH {PARTS} SELECT * FROM (SELECT term_key, term, 'first' AS of FROM terms ORDER BY {fold('term')}, term_key LIMIT 5) UNION ALL SELECT term_key, term, 'asked' FROM terms WHERE term_key IN ('small ring 11', 'red widget 28')",
    "run_outcomes": "SELECT count(*) FILTER (doc_id % 4 <> 0 AND NOT (doc_id % 4 = 2 AND doc_id % 10 = 0))::BIGINT AS completed, count(*) FILTER (doc_id % 4 = 0)::BIGINT AS skipped, count(*) FILTER (doc_id % 4 = 2 AND doc_id % 10 = 0)::BIGINT AS failed FROM documents",
    "statement_links": """WITH p AS (SELECT conv_id, turn, role, 'B' || turn AS b FROM conversations),
      f AS (SELECT unnest(['<a href=''#'' data-statement=''@'' title=''Open full statement''>', '<a class="statement-link" href="#@">']) AS form, unnest(['by_index', 'by_anchor']) AS name),
      l AS (SELECT conv_id, turn, name, '<p>See ' || replace(form, '@', '0') || 'a1.1</a> &amp; ' || replace(form, '@', '7') || 'A1.10</a>, xA1.1; ' || role || ' (' || CASE WHEN turn = 2 THEN replace(form, '@', 's&lt;2') || 'B2</a>' ELSE b END || ') A1.1.2</p><a href=''A1.1''>A1.1</a><pre>b1 <code>A1.10</code> B2</pre> ' || replace(form, '@', 's&lt;2') || 'b2</a>' AS page FROM p, f)
      SELECT conv_id, turn, max(page) FILTER (name = 'by_index') AS by_index, max(page) FILTER (name = 'by_anchor') AS by_anchor FROM l GROUP BY conv_id, turn""",
    "anchored_links": """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<a class="glossary-link" href="#term-a-b">' WHEN role = 'user' THEN '<a class="glossary-link" href="#term-user">' ELSE '<a href="#" data-term="' || role || '">' END || 'x</a> <a href="y">z</a>' AS html FROM conversations""",
    "sent_chats": "SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 200 WHEN turn = 2 THEN 500 ELSE 200 END::BIGINT AS status, CASE WHEN role <> 'user' THEN 'as_number' WHEN turn = 2 THEN NULL ELSE 'as_text' END AS accepted FROM conversations",
    "usage_counts": f"WITH {DOC_SENTENCES}, {GLOSS}, folded AS (SELECT {fold('sentence')} AS f FROM doc_sentences), {hits('folded', 'f')} SELECT k.term_key, count(h.term_key)::BIGINT AS n FROM (SELECT DISTINCT term_key FROM gloss) AS k LEFT JOIN hits AS h ON h.term_key = k.term_key GROUP BY 1",
    "usage_by_first_word": f"WITH {DOC_SENTENCES}, folded AS (SELECT {fold('sentence')} AS f FROM doc_sentences), {hits('folded', 'f')} SELECT term_key, count(*)::BIGINT AS n FROM hits GROUP BY 1",
    "line_counts": f"WITH {DOC_SENTENCES} SELECT doc, count(*)::BIGINT AS lines, count(*) FILTER ({strip('line')} <> '')::BIGINT AS filled FROM doc_lines GROUP BY doc",
    "report_lines": f"WITH {REPORT} SELECT * FROM report",
    "report_titles": f"WITH {REPORT} SELECT doc, title FROM titles",
    "report_sections": f"WITH {REPORT}, every AS (SELECT doc, unnest({SECTION_LIST}) AS section, unnest(range(1, 7))::INTEGER AS section_rank FROM (SELECT DISTINCT doc FROM marked)) SELECT e.doc, e.section, e.section_rank, count(r.pos)::BIGINT AS n_lines FROM every AS e LEFT JOIN report AS r ON r.doc = e.doc AND r.section = e.section GROUP BY ALL",
    "report_statements": f"WITH {STATED} SELECT * FROM stated",
    "sentences": f"WITH {SENTENCES} SELECT * FROM sentences",
    "citations": f"WITH {CITED} SELECT * FROM cited",
    "sankey_nodes": f"WITH {CITED}, {NODES_OF.format(where='')} SELECT * FROM sankey",
    "sankey_links": "WITH {}, {} SELECT a.node_index AS source, b.node_index AS target, 1 AS value FROM cited AS c JOIN sankey AS a ON a.side = 0 AND a.label = c.statement JOIN sankey AS b ON b.side = 1 AND b.label = c.reference WHERE starts_with(c.statement, 'A')".format(CITED, NODES_OF.format(where="WHERE starts_with(statement, 'A')")),
    "numbered_turns": """WITH l AS (SELECT conv_id AS doc, turn AS pos, conv_id % 5 + 1 AS chapter, role, CASE WHEN turn = 0 THEN 'title' WHEN turn % 3 = 0 THEN 'heading' ELSE 'text' END AS kind FROM conversations),
      s AS (SELECT *, coalesce(sum(CASE WHEN kind = 'heading' THEN 1 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS section FROM l),
      p AS (SELECT *, sum(CASE WHEN kind = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, section ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS paragraph FROM s)
      SELECT doc, pos, kind, section, paragraph, CASE kind WHEN 'title' THEN '# ' || role WHEN 'heading' THEN '## [ES' || chapter || '.' || section || '] ' || role ELSE '[ES' || chapter || '.' || section || '.' || paragraph || '] ' || role END AS line FROM p""",
    "first_assistant_section": """WITH a AS (SELECT conv_id AS doc, turn AS pos, role, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS a FROM conversations),
      z AS (SELECT *, min(pos) FILTER (role = 'user' AND pos > a) OVER (PARTITION BY doc) AS z FROM a) SELECT doc, pos, role FROM z WHERE pos >= a AND (z IS NULL OR pos < z)""",
    "glossary_union": f"WITH {PARTS} SELECT term_key, term, explanation, parent, source, src_rank FROM gloss",
    "glossary_labels": f"WITH {PARTS} SELECT term_key, {DEFS.format('term')}[1] AS term, {SOURCES.replace('first', 'Brand#1').replace('second', 'Brand#2')} AS sources, coalesce(array_to_string(list_filter({ONCE.format('parent')}, lambda p: p <> ''), '; '), '') AS parents, coalesce(nullif(array_to_string(list_filter({DEFS.format("CASE WHEN source = 'Brand#1' THEN explanation END")}, lambda e: e IS NOT NULL), chr(10) || chr(10)), ''), 'Definition not available') AS first FROM gloss GROUP BY term_key",
    "part_glossary": f"""WITH r AS (SELECT {collapse('p_name')} AS term, p_type AS explanation, p_brand AS source, min(p_partkey) AS pos, CASE p_brand WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 ELSE 2 END AS src_rank FROM part WHERE p_name <> '' AND p_type <> '' AND p_brand <> '' GROUP BY ALL)
      SELECT {fold('term')} AS term_key, arg_min(term, (src_rank, source, pos)) AS term, count(*)::BIGINT AS definitions, CASE WHEN bool_or(src_rank = 0) AND bool_or(src_rank = 1) THEN 'Brand#1 + Brand#2' WHEN bool_or(src_rank = 0) THEN 'Brand#1' WHEN bool_or(src_rank = 1) THEN 'Brand#2' ELSE '' END AS sources FROM r GROUP BY 1""",
    "explanation_parents": rf"WITH {PARTS} SELECT term_key, source, CASE WHEN regexp_matches(explanation, '(?i)^See\s+also\b') THEN '' WHEN regexp_matches(explanation, '(?i)^See\s+.+?\s+\(under\s+.*\)\.*$') THEN regexp_extract(explanation, '(?i)^See\s+.+?\s+\(under\s+(.*?)\s*\)\.*$', 1) WHEN regexp_matches(explanation, '(?i)^See\s+.+') THEN trim(regexp_extract(explanation, '(?i)^See\s+(.+?)\.*$', 1)) ELSE '' END AS found FROM gloss",
    "occurrence_rows": f"WITH {FOLDED} SELECT term_key, statement, sentence, doc, pos, sp, origin FROM hits",
    "marked_usage": f"WITH {FOLDED} SELECT * FROM usage",
    "overview": overview("t.term_key = 'of'", ""),
    "overview_search": overview("false", "WHERE contains(term_key, 'o')"),
    "used_terms": f"WITH {FOLDED} SELECT count(*) FILTER (n > 0)::BIGINT AS used, count(*)::BIGINT AS total FROM usage",
    "network_nodes": f"WITH {NETWORK} SELECT * FROM nodes",
    "network_edges": f"WITH {NETWORK} SELECT source, target, count(*)::BIGINT AS weight, count(DISTINCT statement)::BIGINT AS statements FROM pairs GROUP BY 1, 2",
    "network_evidence": f"WITH {NETWORK} SELECT source, target, origin, section_rank, doc, pos, sp, statement, sentence FROM pairs",
    "network_gathered": f"WITH {NETWORK} SELECT * FROM edges",
    "network_filtered": f"WITH {NETWORK} SELECT 'node' AS kind, id, '' AS target, count FROM nodes WHERE count BETWEEN 2 AND 100000 AND (id IN (SELECT source FROM kept_edges) OR id IN (SELECT target FROM kept_edges)) UNION ALL SELECT 'edge', source, target, weight FROM kept_edges",
    "network_ranges": f"WITH {NETWORK} SELECT 'count' AS of, min(count) AS lowest, greatest(min(count), least(5, max(count))) AS default_low, max(count) AS highest FROM nodes UNION ALL SELECT 'weight', min(weight), greatest(min(weight), least(5, max(weight))), max(weight) FROM edges",
    "network_file": f"WITH {NETWORK} SELECT id AS a, label AS b, count AS n FROM nodes UNION ALL SELECT source, target, weight FROM edges",
    "statement_anchors": f"""WITH {STATED}, units AS (SELECT doc, 0 AS origin, section_rank, pos, statement, statement_text FROM stated UNION ALL SELECT doc, 1, 0, pos, statement, statement_text FROM items),
      keyed AS (SELECT doc, {fold(collapse('statement'))} AS number_key, {fold(collapse('statement_text'))} AS text_key, min((origin, section_rank, pos)) AS place FROM units GROUP BY ALL)
      SELECT doc, number_key, text_key, 'source-statement-' || row_number() OVER (PARTITION BY doc ORDER BY place) AS anchor FROM keyed""",
    "term_anchors": f"WITH {PARTS} SELECT term_key, 'term-' || coalesce({chars_at('lower(term_key)')}, 'item') AS anchor FROM (SELECT DISTINCT term_key FROM gloss)",
    "colliding_anchors": f"""WITH RECURSIVE keys AS (SELECT DISTINCT lower(p_name) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || (p_partkey % 30) ELSE ' ' || (p_partkey % 30) || ' ' || (p_partkey % 5) END || repeat('!', (p_partkey % 7)::INT) AS term_key FROM part),
      based AS (SELECT term_key, 'term-' || coalesce({chars_at('term_key')}, 'item') AS base FROM keys),
      placed AS (SELECT *, regexp_replace(base, '(-[0-9]+)+$', '') AS stem, row_number() OVER (PARTITION BY regexp_replace(base, '(-[0-9]+)+$', '') ORDER BY term_key) AS i FROM based),
      claimed AS (
        SELECT DISTINCT stem, 0::BIGINT AS i, []::VARCHAR[] AS taken, '' AS term_key, '' AS anchor FROM placed
        UNION ALL
        SELECT stem, i, list_append(taken, anchor), term_key, anchor FROM (
          SELECT p.stem, p.i, c.taken, p.term_key, CASE WHEN list_contains(c.taken, p.base) THEN list_filter(list_transform(range(2, p.i + 2), lambda n: p.base || '-' || n), lambda x: NOT list_contains(c.taken, x))[1] ELSE p.base END AS anchor
          FROM claimed AS c JOIN placed AS p ON p.stem = c.stem AND p.i = c.i + 1)
      ) SELECT term_key, anchor FROM claimed WHERE i > 0""",
    "routes": f"""WITH {FOLDED} SELECT t.term_key, t.term, u.n, CASE WHEN t.term_key = 'confidence' THEN 'notice' WHEN t.term_key = 'zzz unused' AND n = 0 THEN 'skip' WHEN n <= 1 THEN 'local' WHEN t.term_key = 'of' THEN 'skip' ELSE 'model' END AS route,
      CASE WHEN t.term_key = 'confidence' THEN 'LLM is not applied to the term ' || t.term || '.' WHEN n = 1 THEN 'The term ''' || t.term || ''' is only used once in the provided texts.' WHEN n = 0 THEN 'The term ''' || t.term || ''' is not used in the provided texts.' WHEN t.term_key = 'of' THEN 'kept' END AS summary
      FROM terms AS t JOIN usage AS u ON u.term_key = t.term_key""",
    "prompts": f"""WITH {FOLDED}, said AS (SELECT term_key, count(*) AS c, string_agg('| ' || replace({collapse('statement')}, '|', '\\|') || ' | ' || replace({collapse('sentence')}, '|', '\\|') || ' |', chr(10) ORDER BY origin, section_rank, doc, pos, sp) AS rows FROM hits GROUP BY 1),
      defs AS (SELECT term_key, coalesce(string_agg(explanation, chr(10) || chr(10) ORDER BY load_pos, term, explanation) FILTER (source = 'first'), 'Definition not available') AS a, coalesce(string_agg(explanation, chr(10) || chr(10) ORDER BY load_pos, term, explanation) FILTER (source = 'second'), 'Definition not available') AS b FROM gloss GROUP BY 1),
      made AS (SELECT t.term_key, 'Term ' || t.term || chr(10) || a || chr(10) || b || chr(10) || 'Occurrence count: ' || coalesce(c, 0) || chr(10) || chr(10) || '| Statement | Sentence |' || chr(10) || '| --- | --- |' || coalesce(chr(10) || rows, '') AS p FROM terms AS t JOIN defs AS d ON d.term_key = t.term_key LEFT JOIN said AS s ON s.term_key = t.term_key)
      SELECT term_key, md5(p) AS prompt_md5, length(p)::BIGINT AS chars FROM made""",
    "unknown_terms": f"WITH {GLOSS} SELECT DISTINCT {fold('p_name')} AS term_key FROM part WHERE {fold('p_name')} NOT IN (SELECT term_key FROM gloss)",
    "table_cells": f"SELECT doc_id, md5(replace({collapse('text')}, '|', '\\|')) AS cell_md5, 'h-' || coalesce({chars_at(fold('text'))}, 'section') AS anchor FROM documents",
    "chunked_texts": f"WITH s AS (SELECT doc_id, {strip('text')} AS t FROM documents), c AS (SELECT doc_id, t, unnest(range((length(t) + 1999) // 2000)) AS i FROM s) SELECT doc_id, md5(substr(t, i * 2000 + 1, 2000)) AS chunk_md5, length(substr(t, i * 2000 + 1, 2000))::INTEGER AS chars FROM c",
    "audit_records": """WITH r AS (SELECT event_id, event_type AS name, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CASE WHEN user_id % 300 < 256 THEN '10.0.' || (user_id % 300) || '.7' ELSE '192.0.2.' || (user_id % 256) END AS ip, event_type = 'error' AS wrong FROM events)
      SELECT event_id, ip, '{"properties":{"name":{"title":[{"text":{"content":"' || name || '"}}]},"date":{"date":{"start":"' || stamp || '"}},"ip address":{"rich_text":[{"text":{"content":"' || ip || '"}}]},"wrong pwd":{"checkbox":' || wrong || '}}}' AS payload FROM r""",
    "bold_entries": f"""WITH {PARAGRAPHS},
      r AS (SELECT *, max(is_term::INTEGER) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM paragraphs WHERE text <> ''),
      m AS (SELECT *, CASE WHEN is_term AND (NOT is_sub OR coalesce(seen, 0) = 0) THEN text END AS main, sum(is_term::INTEGER) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM r),
      p AS (SELECT *, CASE WHEN is_term AND main IS NULL THEN last_value(main IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS up FROM m),
      e AS (SELECT doc, n, min(pos) AS pos, max(text) FILTER (is_term) AS term, {collapse("coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (NOT is_term), '')")} AS explanation, coalesce(max(up), '') AS parent FROM p WHERE n > 0 GROUP BY doc, n),
      c AS (SELECT *, row_number() OVER (PARTITION BY doc, {fold('term')} ORDER BY starts_with(lower(explanation), 'see ')::INTEGER, pos) AS k, min(pos) OVER (PARTITION BY doc, {fold('term')}) AS place FROM e)
      SELECT doc, place AS pos, term, md5(explanation) AS explanation_md5, parent FROM c WHERE k = 1""",
    "styled_paragraphs": f"WITH {PARAGRAPHS} SELECT doc, pos, md5(['## ', '# ', '## ', '### ', '#### ', '##### ', '', '###### ', '', '# ', '### '][style + 1] || text) AS line_md5 FROM paragraphs WHERE text <> ''",
    "paragraphs_before_style": f"WITH {PARAGRAPHS}, z AS (SELECT *, min(pos) FILTER (style = 8) OVER (PARTITION BY doc) AS z FROM paragraphs) SELECT doc, pos FROM z WHERE z IS NULL OR pos < z",
    "listed_entries": """WITH l AS (SELECT conv_id AS doc, turn AS pos, turn % 3 = 1 AS is_entry, turn = 6 AND conv_id % 2 = 0 AS is_stop, 'Term' || turn AS term, CASE WHEN turn % 3 = 1 THEN 'of ' || role ELSE 'more ' || turn END AS rest FROM conversations),
      b AS (SELECT *, min(pos) FILTER (pos = 1) OVER (PARTITION BY doc) AS a FROM l), z AS (SELECT *, min(pos) FILTER (is_stop) OVER (PARTITION BY doc) AS z FROM b WHERE pos >= a),
      n AS (SELECT *, sum(is_entry::INTEGER) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM z WHERE z IS NULL OR pos < z)
      SELECT doc, min(pos) AS pos, max(term) FILTER (is_entry) AS term, string_agg(rest, ' ' ORDER BY pos) AS definition FROM n WHERE n > 0 GROUP BY doc, n""",
    "page_documents": "SELECT conv_id AS doc, '# talk ' || conv_id || chr(10) || chr(10) || ltrim(string_agg(chr(10) || '## Page ' || turn || chr(10) || chr(10) || chr(10) || CASE WHEN turn % 4 = 3 THEN '_No extractable text on this page._' ELSE role || ' ends' END, chr(10) || chr(10) ORDER BY turn), '') || chr(10) AS markdown FROM conversations GROUP BY conv_id",
    "archive_differences": "SELECT doc_id::VARCHAR AS name, 'missing' AS side FROM documents WHERE doc_id % 25 = 1 OR doc_id % 10 = 0 UNION ALL SELECT doc_id::VARCHAR, 'unexpected' FROM documents WHERE doc_id % 25 <> 1 AND doc_id % 10 = 0",
    "merged_records": "SELECT doc_id::VARCHAR AS term_key, 'summary' AS kind, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS value FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0 UNION ALL SELECT doc_id::VARCHAR, 'failure', CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE 'old' END FROM documents WHERE doc_id % 3 <> 0 AND (doc_id % 7 = 0 OR doc_id % 5 = 0)",
    "issue_flags": "SELECT doc_id, doc_id % 6 IN (0, 4, 5) AS issue FROM documents",
    "shifted_headings": "SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 0 AND turn % 7 BETWEEN 1 AND 4 THEN repeat('#', least(turn % 7 + 2, 6)::INTEGER) ELSE repeat('#', (turn % 7)::INTEGER) END || CASE WHEN conv_id % 3 = 0 THEN '' ELSE ' ' END || role AS line FROM conversations",
    "picked_occurrences": "SELECT c.conv_id, max(t.turn || ' ' || t.role) AS turn FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations) AS t ON t.conv_id = c.conv_id AND ((c.conv_id % 5 = 0 AND nth = 0) OR (c.conv_id % 5 = 1 AND nth = 2)) GROUP BY c.conv_id",
    "source_attributes": f"WITH {ANCHORED} SELECT u.doc, u.pos, CASE WHEN row_number() OVER (PARTITION BY u.doc, u.number_key, u.text_key ORDER BY section_rank, pos) = 1 THEN ' id=\"' || anchor || '\" class=\"statement-target\"' ELSE '' END AS attributes FROM unit_keys AS u JOIN anchors AS a ON (a.doc, a.number_key, a.text_key) = (u.doc, u.number_key, u.text_key)",
    "linked_statements": f"WITH {SENTENCES}, {ANCHORED[len(STATED) + 2:]} SELECT s.doc, s.pos, s.sp, s.origin, CASE WHEN anchor IS NULL THEN s.statement ELSE '<a class=\"statement-link\" href=\"#' || anchor || '\">' || s.statement || '</a>' END AS label FROM sentences AS s LEFT JOIN anchors AS a ON a.doc = s.doc AND a.number_key = {fold(collapse('s.statement'))} AND a.text_key = {fold(collapse('s.statement_text'))}",
    "last_statement_targets": f"WITH {STATED} SELECT {fold(collapse('statement'))} AS number_key, arg_max(pos, (doc, section_rank, pos)) AS pos FROM stated GROUP BY 1",
    "chat_records": """SELECT conv_id, turn, '{"properties":{"Title":{"title":[{"text":{"content":"chat log"}}]},"App name":{"rich_text":[{"text":{"content":"app"}}]},"questions":{"rich_text":[{"text":{"content":"' || role || '"}}]},"answer":{"rich_text":[]},"ip address":{"rich_text":[{"text":{"content":"10.0.0.1"}}]},"datetime":{"date":{"start":"now"}},"token_input":{"number":' || turn || '},"token_output":{"number":' || CASE WHEN turn > 1 THEN turn::VARCHAR ELSE 'null' END || '}}}' AS payload FROM conversations""",
    "schema_problems": """WITH p AS (SELECT DISTINCT user_id, ['name', 'date', 'ip address', 'wrong pwd', 'other'][event_id % 5 + 1] AS property, ['title', 'date', 'rich_text', 'checkbox'][event_id % 4 + 1] AS found FROM events WHERE event_type <> 'error'),
      w(property, wanted) AS (VALUES ('name', 'title'), ('date', 'date'), ('ip address', 'rich_text'), ('wrong pwd', 'checkbox|select|status|rich_text'))
      SELECT u.user_id, w.property, w.wanted, p.found FROM (SELECT DISTINCT user_id FROM p) AS u, w LEFT JOIN p ON p.user_id = u.user_id AND p.property = w.property
      WHERE p.found IS NULL OR NOT list_contains(string_split(w.wanted, '|'), p.found)""",
}
