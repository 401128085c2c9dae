"""DuckDB SQL that gives the rows of the queries."""

from __future__ import annotations

from stratalake.llm import quality_rules, warc
from stratalake.llm.reply_trees import END, ROLE_END, START
from stratalake.llm.statistics import STOP_WORDS

WORD = "[^\\x20\\x09-\\x0D]+"
CRLF = "chr(13) || chr(10)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _record_id(kind: str, *parts: str) -> str:
    h = f"md5(concat_ws(chr(31), '{kind}', {', '.join(parts)}))"
    return f"('<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-3' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>')"


_BREAKING = "address article aside blockquote body br div dd dl dt footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table title tr ul"


def _plain_text(html: str) -> str:
    unseen = "(?is)<!--.*?-->|<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>"
    breaking = "(?i)</?(" + _BREAKING.replace(" ", "|") + ")([ \\t\\n\\r/][^>]*)?>"
    for pattern, put in ((unseen, "''"), (breaking, "chr(10)"), ("<[a-zA-Z!?/][^>]*>", "''")):
        html = f"regexp_replace({html}, {_quoted(pattern)}, {put}, 'g')"
    for name, sign in warc.ENTITIES.items():
        html = f"replace({html}, '&{name};', {_quoted(sign)})"
    return html


_CODE = "CASE WHEN lower(ref[3]) = 'x' THEN TRY_CAST('0x' || ref[4:-2] AS INT) ELSE TRY_CAST(ref[3:-2] AS INT) END"
_NUMBERED = f"""list_reduce(
        list_prepend(named_text, list_distinct(regexp_extract_all(named_text, '&#(?:0*[1-9][0-9]{{0,6}}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{{0,5}});'))),
        lambda acc, ref: CASE WHEN {_CODE} = 38 THEN acc WHEN {_CODE} > 1114111 OR {_CODE} BETWEEN 55296 AND 57343 THEN replace(acc, ref, chr(65533))
            ELSE replace(acc, ref, chr({_CODE})) END)"""


def _record(kind: str, content_type: str, block: str, more: str) -> str:
    return f"""'{warc.VERSION}' || nl || 'WARC-Type: {kind}' || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Refers-To: ' || refers_to || nl
        || 'WARC-Target-URI: ' || target_uri || nl || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || {more}'WARC-Block-Digest: sha256:' || sha256({block}) || nl
        || 'Content-Type: {content_type}' || nl || 'Content-Length: ' || strlen({block}) || nl || nl || {block} || nl || nl"""


OP1 = f"""
WITH page AS (
    SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html, {CRLF} AS nl,
        {_record_id("response", "coalesce(CAST(page_id AS VARCHAR), '')", "coalesce(url, '')")} AS refers_to
    FROM pages),
named AS (SELECT *, {_plain_text("html")} AS named_text FROM page),
numbered AS (SELECT *, {_NUMBERED} AS text FROM named),
clean AS (
    SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(text, '&(?:amp|#0*38|#[xX]0*26);', '&', 'g'),
        '[ \\t\\x0B\\f\\r\\x{{A0}}]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS plain,
        'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html AS source
    FROM numbered),
blocks AS (
    SELECT page_id, 'metadata' AS warc_type, {_record_id("metadata", "refers_to")} AS record_id, refers_to, target_uri, nl, html,
        'source-status: 200' || nl || 'source-block-digest: sha256:' || sha256(source) || nl || 'source-payload-digest: sha256:' || sha256(html) || nl
        || 'source-header-Content-Type: text/html; charset=utf-8' || nl || 'source-header-Content-Length: ' || strlen(html) || nl AS block
    FROM clean
    UNION ALL
    SELECT page_id, 'conversion', {_record_id("conversion", "refers_to")}, refers_to, target_uri, nl, html, plain FROM clean)
SELECT page_id, warc_type, record_id, refers_to, target_uri, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length,
    sha256(CASE WHEN warc_type = 'metadata' THEN {_record("metadata", "application/warc-fields", "block", "")}
        ELSE {_record("conversion", "text/plain; charset=utf-8", "block", "'WARC-Source-Payload-Digest: sha256:' || sha256(html) || nl || ")} END) AS record_sha256
FROM blocks
"""


def _escaped_length(text: str) -> str:
    control = "[<\\[](?:\\|im_(?:start|sep|end)\\|>|/?s>|/?INST\\])"
    return f"(length({text}) + length({text}) - length(replace({text}, chr(92), '')) + len(regexp_extract_all({text}, '{control}')))"


OP4 = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
    FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL
        VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place)) AS loss_sha256,
    CAST(sum({len(START + ROLE_END + END)} + {_escaped_length("role")} + {_escaped_length("text")}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _lower(text: str) -> str:
    """Only ASCII letters."""
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(name: str, key: str, source: str) -> str:
    """Distinct shingles of five words, of fewer where the text has fewer."""
    return f"""{name}_words AS (SELECT {key}, regexp_extract_all({_lower("text")}, '{WORD}') AS w FROM {source}),
{name}_at AS (SELECT {key}, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 3, 2)) END) AS i FROM {name}_words),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i : i + 4], ' ') AS shingle, least(5, len(w)) AS words FROM {name}_at)"""


OP6 = f"""
WITH {_shingles("item", "item_id", "benchmark")},
sizes AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id),
doc_words AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '{WORD}') AS w FROM documents),
widths AS (SELECT DISTINCT words FROM item),
doc_at AS (SELECT doc_id, words, w, unnest(range(1, len(w) - words + 2)) AS i FROM doc_words, widths),
doc AS (SELECT DISTINCT doc_id, words, array_to_string(w[i : i + words - 1], ' ') AS shingle FROM doc_at),
found AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc JOIN item USING (words, shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM found JOIN sizes USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""

OP8 = f"""
WITH RECURSIVE {_shingles("doc", "doc_id", "documents")},
sizes AS (SELECT doc_id, count(*) AS n FROM doc GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM doc a JOIN doc b ON a.shingle = b.shingle AND a.words = b.words AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * same >= 75 * (p.n + q.n - same)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reached.doc_id, links.y FROM reached JOIN links ON links.x = reached.other)
SELECT reached.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes ON sizes.doc_id = reached.doc_id GROUP BY reached.doc_id
"""


def _broken(name: str) -> str:
    part, whole, least, most = quality_rules.RULES[name]
    ratio = f"CAST({part} AS DOUBLE) / nullif({whole}, 0)"
    tests = [f"{ratio} < {least}"] * (least is not None) + [f"{ratio} > {most}"] * (most is not None)
    return f"coalesce({' OR '.join(tests)}, false)"


_STOP = ", ".join(_quoted(w) for w in sorted({w for group in STOP_WORDS.values() for w in group}))
OP9 = f"""
WITH held AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM held) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM held),
stops AS (SELECT doc_id, count(*) AS n_stop_words FROM words WHERE word IN ({_STOP}) GROUP BY doc_id),
windows AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS three FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM windows WHERE three IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
figures AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM held LEFT JOIN lines USING (doc_id) LEFT JOIN stops USING (doc_id) LEFT JOIN again USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({" OR ".join(_broken(name) for name in quality_rules.RULES)}) AS kept
FROM judged
"""

OP10 = """
WITH held AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 49)) AS i FROM held)),
first AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
gone AS (SELECT doc_id, i FROM windows JOIN first USING (s) WHERE least < doc_id),
steps AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM gone),
grouped AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM grouped GROUP BY doc_id, run),
gaps AS (SELECT doc_id, b AS x, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM spans
    UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (coalesce(y, n_bytes) - x) AS BIGINT)), '' ORDER BY x) AS kept FROM gaps JOIN held USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM held LEFT JOIN counted USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


def _added(key: str, cost: str, edit: str) -> str:
    """A cost of nine digits followed by an audit, with one more edit; such keys sort as costs, then audits."""
    return f"lpad(CAST(CAST(substr({key}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{edit}'"


def _row_step() -> str:
    cut, free = "CASE WHEN r.fault = 3 THEN 1 ELSE 0 END", "r.fault NOT IN (1, 2)"
    delete = {q: _added(f"acc.k{q}", "3", "D") for q in range(4)}
    kept = {q: _added(f"acc.k{q}", cut, "K") for q in range(4)}
    other = {q: f"CASE WHEN {free} THEN {_added(f'acc.k{q}', f'2 + {cut}', 'R')} END" for q in range(4)}

    def keep(q: int, initial: str) -> str:
        return f"CASE WHEN {free} AND r.initial = '{initial}' THEN {kept[q]} END"

    user = ", ".join(f"{keep(q, 'u')}, {other[q]}" for q in (0, 1, 3))
    return f"""{{'k0': {delete[0]}, 'k1': least({delete[1]}, {keep(0, 's')}), 'k2': least({delete[2]}, {user}), 'k3': least({delete[3]}, {keep(2, 'a')}, {other[2]})}}"""


OP11 = f"""
WITH coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS code
    FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy,
        CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM coded WHERE code <> 0),
judged AS (
    SELECT *, row_number() OVER o AS place, CASE WHEN NOT regexp_matches(text, '{WORD[:-1]}') THEN 1
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 2
            WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
        CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS initial
    FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
linked AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM judged),
gathered AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list({{'op': 3, 'fault': fault, 'initial': initial, 'role': role, 'text': text}} ORDER BY place) AS turns
    FROM linked GROUP BY conv_id),
-- Before each row and at the end: insert a user row, then an assistant row.
steps AS (
    SELECT *, list_concat(flatten(list_transform(turns, lambda t: [{{'op': 1, 'fault': 0, 'initial': '', 'role': '', 'text': ''}}, {{'op': 2, 'fault': 0, 'initial': '', 'role': '', 'text': ''}}, t])),
        [{{'op': 1, 'fault': 0, 'initial': '', 'role': '', 'text': ''}}, {{'op': 2, 'fault': 0, 'initial': '', 'role': '', 'text': ''}}]) AS work
    FROM gathered),
solved AS (
    SELECT *, list_reduce(work, lambda acc, r: CASE
            WHEN r.op = 1 THEN {{'k0': acc.k0, 'k1': acc.k1, 'k2': least(acc.k2, {_added("acc.k0", "2", "I")}, {_added("acc.k1", "2", "I")}, {_added("acc.k3", "2", "I")}), 'k3': acc.k3}}
            WHEN r.op = 2 THEN {{'k0': acc.k0, 'k1': acc.k1, 'k2': acc.k2, 'k3': least(acc.k3, {_added("acc.k2", "2", "I")})}}
            ELSE {_row_step()} END,
        {{'k0': '000000000', 'k1': CAST(NULL AS VARCHAR), 'k2': CAST(NULL AS VARCHAR), 'k3': CAST(NULL AS VARCHAR)}}) AS best
    FROM steps),
audited AS (SELECT *, CAST(substr(least(best.k0, best.k3), 1, 9) AS BIGINT) AS cost, substr(least(best.k0, best.k3), 10) AS audit FROM solved),
replayed AS (
    SELECT *, list_reduce(string_split(audit, ''), lambda acc, e: {{
            'row': acc.row + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
            'state': CASE WHEN e = 'D' THEN acc.state WHEN e = 'K' THEN instr('sua', turns[acc.row].initial) WHEN acc.state = 2 THEN 3 ELSE 2 END,
            'said': acc.said || CASE WHEN e = 'D' THEN '' WHEN e = 'K' THEN chr(10) || turns[acc.row].role || ':' || turns[acc.row].text
                ELSE chr(10) || CASE WHEN acc.state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN turns[acc.row].text ELSE '' END END}},
        {{'row': CAST(1 AS BIGINT), 'state': CAST(0 AS BIGINT), 'said': ''}}) AS played
    FROM audited)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(played.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN replayed ON ids.conv_id IS NOT DISTINCT FROM replayed.conv_id
"""


def _decoded(text: str) -> str:
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "'"), ("#39", "'"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"replace({text}, '&{name};', {_quoted(sign)})"
    return text


#: The pages of the tables have one article each, without parts that are no text, and escape with these references only.
OP12 = f"""
WITH found AS (SELECT row_number() OVER () AS row, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
pieces AS (SELECT row, unnest(string_split(regexp_replace(body, '</?(?:p|h1|br)>', chr(0), 'g'), chr(0))) AS piece, generate_subscripts(string_split(regexp_replace(body, '</?(?:p|h1|br)>', chr(0), 'g'), chr(0)), 1) AS pos FROM found),
lines AS (SELECT row, pos, trim(regexp_replace({_decoded("regexp_replace(piece, '<[^>]*>', '', 'g')")}, '[\\s\\x{{A0}}]+', ' ', 'g')) AS line FROM pieces),
texts AS (SELECT row, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines WHERE line <> '' GROUP BY row)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM found LEFT JOIN texts USING (row)
"""


def _terms(text: str) -> str:
    return f"regexp_extract_all({_lower(text)}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"


OP13 = f"""
WITH item AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark),
occurs AS (SELECT doc_id, unnest({_terms("text")}) AS term FROM documents),
length AS (SELECT doc_id, count(*) AS n FROM occurs GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM length),
counted AS (SELECT doc_id, term, count(*) AS tf FROM occurs SEMI JOIN item USING (term) GROUP BY doc_id, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, corpus GROUP BY term),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
    FROM counted JOIN weight USING (term) JOIN item USING (term) JOIN length USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
