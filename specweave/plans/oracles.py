"""The same queries as SQL, for another engine to compute. Keyed by the names in ``queries``."""

from __future__ import annotations

from specweave.functions.ids import WS
from specweave.functions.text import LIGATURES, MATH_GLYPHS, MATH_LINE, MATH_SHARE, SUGGESTING, WORD
from specweave.functions.values import NUMBER
from specweave.operators.conflicts import COSMETIC, RATIO
from specweave.operators.documents import HEADER, SHORTEST, TRIAGE_LEAST, TRIAGE_SHARE
from specweave.operators.gaps import ABBREVIATION, RESPELT
from specweave.operators.rules import CHECKLIST, FIDELITY_CONFIDENCE, KNOWN_SETTINGS, RANGES, REVIEWED, SECTION_PATTERNS, SEVERITIES, SPELLINGS, STRUCTURAL, STRUCTURAL_PROBLEMS, TRAINING


def _q(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return repr(x) + "::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _in(names: list[str]) -> str:
    return "(" + ", ".join(map(_q, names)) + ")"


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows)


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def _slug(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"coalesce(nullif(regexp_replace(substr({s}, 1, 40), '_+$', ''), ''), 'unnamed')"


def _number(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '{NUMBER}') THEN try_cast(trim({x}) AS DOUBLE) END"


def _key(x: str) -> str:
    return f"coalesce(format('{{:.11e}}', ({_number(x)}) + 0.0), lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))))"


def _cond(x: str) -> str:
    return f"coalesce(regexp_replace(lower(regexp_replace({x}, '\\s+', ' ', 'g')), '^[ .,;]+|[ .,;]+$', '', 'g'), '')"


def _id(prefix: str, *parts: str) -> str:
    joined = "concat_ws(chr(31), " + ", ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts) + ")"
    return f"'{prefix}_' || substr(sha256({joined}), 1, 16)"


def _cluster(kind: str, name: str) -> str:
    return f"'cnc_' || substr({_slug(kind)}, 1, 4) || '_' || {_slug(name)}"


_PLAIN_NAME = r"regexp_replace(lower(regexp_replace(canonical_name, '^ +| +$', '', 'g')), '[\s-]+', '_', 'g')"
ONCE = "once AS (SELECT DISTINCT ON (claim_id) * FROM claims ORDER BY claim_id, loaded_at DESC)"
VIEW = f"""WITH {ONCE},
syn(kind, spelling, stands_for) AS ({_values([(t, s, n) for t, pairs in SPELLINGS.items() for s, n in pairs.items()])}),
v AS (SELECT claim_id, paper_id, type, status, canonical_name, paper_symbol, value, value_type, unit, applies_to, condition, stated_explicitly, quote, confidence,
  provenance.span_id AS span_id, provenance.scope_id AS scope_id, provenance.section AS section, verification.citation_trace AS trace_result, verification.symbol_check AS symbol_result,
  coalesce(stands_for, {_PLAIN_NAME}) AS name_key, {_number('value')} AS value_num, {_key('value')} AS value_key, {_cond('condition')} AS cond,
  provenance.char_end AS char_end, provenance.quote_hash AS quote_hash
  FROM once LEFT JOIN syn ON once.type = kind AND CASE WHEN once.type = 'result' THEN lower(trim(canonical_name)) ELSE {_PLAIN_NAME} END = spelling)"""

_SPECIFICITY = "round(least(1.0, greatest(0.0, 0.5 + CASE WHEN coalesce(trim({c}), '') <> '' THEN 0.3 ELSE 0.0 END + CASE WHEN coalesce({a}, 'global') <> 'global' THEN 0.1 ELSE 0.0 END + CASE WHEN {e} = false THEN -0.3 ELSE 0.1 END)), 2)::DOUBLE"
_REVIEWED = "coalesce(regexp_matches(lower(venue), '" + "|".join(REVIEWED) + "'), false)"

CONFLICTS = f"""{VIEW},
h AS (SELECT *, coalesce(lower(trim(unit)), '') AS unit_key FROM v WHERE status = 'verified' AND type = 'hyperparameter' AND value_key IS NOT NULL),
answers AS (SELECT name_key, cond, unit_key, value_key, min(claim_id) AS claim_id, arg_min(paper_id, claim_id) AS paper_id, arg_min(applies_to, claim_id) AS applies_to,
  arg_min(stated_explicitly, claim_id) AS stated_explicitly, min(coalesce(condition, '')) AS condition, min(paper_id) AS p_lo, max(paper_id) AS p_hi, min(value_num) AS num FROM h GROUP BY ALL),
g AS (SELECT name_key, cond, unit_key, count(*) AS n_values, count(num) AS n_numeric, min(num) AS low, max(num) AS high, string_agg(claim_id, ',' ORDER BY claim_id) AS ids
  FROM answers GROUP BY ALL HAVING count(*) >= 2 AND min(p_lo) <> max(p_hi)),
conflicts AS (SELECT {_id('ctr', _cluster("'hyperparameter'", 'name_key'), "'VALUE_CONFLICT'", 'ids')} AS contradiction_id, {_cluster("'hyperparameter'", 'name_key')} AS cluster_id, 'VALUE_CONFLICT' AS conflict_type,
  CASE WHEN n_numeric < n_values THEN CASE WHEN name_key IN {_in(STRUCTURAL)} THEN 'BLOCKING' ELSE 'MATERIAL' END WHEN high - low <= {COSMETIC} THEN 'COSMETIC' WHEN name_key IN {_in(STRUCTURAL)} THEN 'BLOCKING'
  WHEN low <= 0 OR high <= 0 THEN 'BLOCKING' WHEN high / low >= {RATIO} THEN 'BLOCKING' ELSE 'MATERIAL' END AS severity, name_key, cond, unit_key, n_values FROM g),
positions AS (SELECT contradiction_id, conflict_type, severity, claim_id, a.paper_id, value_key || CASE WHEN unit_key <> '' THEN ' ' || unit_key ELSE '' END || CASE WHEN stated_explicitly = false THEN ' (inferred, not stated)' ELSE '' END AS position, {_SPECIFICITY.format(c='a.cond', a='applies_to', e='stated_explicitly')} AS specificity, stated_explicitly, (cond <> '') AS has_condition, venue, year, {_REVIEWED} AS peer_reviewed
  FROM conflicts JOIN answers a USING (name_key, cond, unit_key) LEFT JOIN (SELECT paper_id, min(venue) AS venue, min(year) AS year FROM papers GROUP BY 1) p ON p.paper_id = a.paper_id)"""

# One pass over the positions of a conflict gives what the rules ask for.
RESOLVED = f"""{CONFLICTS},
facts AS (SELECT contradiction_id, any_value(severity) AS severity, count(*) AS n, count(*) FILTER (has_condition) AS scoped, max(specificity) AS s1, list(specificity ORDER BY specificity DESC)[2] AS s2,
  arg_max(claim_id, (specificity, claim_id)) AS most_specific, min(claim_id) AS first_claim, max(claim_id) FILTER (has_condition) AS only_scoped, max(year) AS y1, min(year) AS y0, count(year) AS dated, arg_max(claim_id, (year, claim_id)) FILTER (year IS NOT NULL) AS recent FROM positions GROUP BY 1),
newest AS (SELECT contradiction_id, count(*) FILTER (year = y1) AS at_newest, count(*) FILTER (year = y1 AND peer_reviewed) AS reviewed FROM positions JOIN facts USING (contradiction_id) GROUP BY 1),
fired AS (SELECT *, CASE WHEN scoped = 1 AND n > 1 THEN 'prefer_scoped_over_global' WHEN n >= 2 AND s1 - s2 >= 0.3 THEN 'prefer_specific_over_general'
  WHEN dated >= 2 AND y1 - y0 >= 3 AND at_newest = 1 AND reviewed = 1 THEN 'prefer_recent_peer_reviewed' WHEN severity = 'COSMETIC' THEN 'cosmetic_conflicts_auto_resolve' END AS rule_fired FROM facts JOIN newest USING (contradiction_id)),
chosen AS (SELECT *, CASE rule_fired WHEN 'prefer_scoped_over_global' THEN only_scoped WHEN 'prefer_specific_over_general' THEN most_specific WHEN 'prefer_recent_peer_reviewed' THEN recent WHEN 'cosmetic_conflicts_auto_resolve' THEN first_claim END AS choice FROM fired),
resolved AS (SELECT c.contradiction_id, c.severity, rule_fired, first_claim,
  CASE WHEN c.severity = 'BLOCKING' OR choice IS NULL OR NOT coalesce(p.stated_explicitly, false) THEN 'ESCALATED' WHEN rule_fired = 'prefer_recent_peer_reviewed' THEN 'DEFERRED' WHEN rule_fired = 'prefer_scoped_over_global' THEN 'SCOPED' ELSE 'SELECTED' END AS outcome,
  CASE WHEN c.severity = 'BLOCKING' OR NOT coalesce(p.stated_explicitly, false) THEN NULL ELSE choice END AS selected_claim_id
  FROM chosen c LEFT JOIN positions p ON p.contradiction_id = c.contradiction_id AND p.claim_id = choice)"""

_NORMAL = "text"
for _a, _b in LIGATURES.items():
    _NORMAL = f"replace({_NORMAL}, {_q(_a)}, {_q(_b)})"
_NORMAL = f"regexp_replace({_NORMAL}, '({WORD})-{WS}*\\n{WS}*({WORD})', '\\1\\2', 'g')"
_NORMAL = f"regexp_replace(regexp_replace(regexp_replace({_NORMAL}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g')"
_NORMAL = f"regexp_replace(regexp_replace({_NORMAL}, '(?m)^{WS}+|(?m){WS}+$', '', 'g'), '\\A{WS}+|{WS}+\\z', '', 'g')"

_RANGE = f"""{VIEW}, rules(name, kind, hard_lo, hard_hi, soft_lo, soft_hi, positive) AS ({_values(RANGES)}),
ranged AS (SELECT v.*, CASE WHEN name IS NULL OR type <> 'hyperparameter' THEN 'n/a' WHEN value_num IS NULL OR value_type = 'bool' THEN 'fail' WHEN positive AND value_num <= 0 THEN 'fail'
  WHEN value_num < hard_lo OR value_num > hard_hi THEN 'fail' WHEN value_num < soft_lo OR value_num > soft_hi THEN 'warn' ELSE 'pass' END AS range_result FROM v LEFT JOIN rules ON name_key = name)"""

_CHECK = f"needs(field, name_key, criticality) AS ({_values([(f, n, c) for f, names, c in CHECKLIST for n in names])})"
_GAPS = f"""{VIEW}, {_CHECK}, trains AS (SELECT DISTINCT paper_id FROM v WHERE name_key IN {_in(TRAINING)}), have AS (SELECT DISTINCT paper_id, name_key, 1 AS one FROM v WHERE status = 'verified'),
gaps AS (SELECT t.paper_id, field, any_value(criticality) AS criticality FROM trains t CROSS JOIN needs n LEFT JOIN have h ON h.paper_id = t.paper_id AND h.name_key = n.name_key GROUP BY t.paper_id, field HAVING count(one) = 0)"""

_LEDGER = "WITH ledger AS (SELECT event_id, ts, event_type AS provider, value AS tokens, event_type = 'error' AS failed, (props::JSON->>'$.k')::INT % 4 = 0 AS cached, (props::JSON->>'$.k')::INT AS prompt_hash FROM events)"
_USED = "used AS (SELECT provider, ts::DATE AS day, count(*) AS requests FROM ledger WHERE NOT cached GROUP BY 1, 2)"

_SPEC_NUMBER = "CASE WHEN regexp_matches(b, '" + NUMBER + "') THEN try_cast(b AS DOUBLE) END"
_P5 = f"""WITH vals AS (SELECT DISTINCT spec_id, snapshot_no, coalesce(component_id, '') || '|' || coalesce(canonical_name, '') || '|' || coalesce(condition, '') AS item, trim(value, ' ' || chr(9) || chr(10) || chr(13)) AS b FROM spec_values),
val AS (SELECT spec_id, snapshot_no, 'value' AS kind, item, string_agg(DISTINCT coalesce(format('{{:.11e}}', ({_SPEC_NUMBER}) + 0.0), lower(b)), '|' ORDER BY coalesce(format('{{:.11e}}', ({_SPEC_NUMBER}) + 0.0), lower(b))) AS val FROM vals GROUP BY ALL),
e AS (SELECT * FROM val UNION ALL SELECT DISTINCT spec_id, snapshot_no, 'conflict', contradiction_id, '' FROM spec_conflicts UNION ALL SELECT DISTINCT spec_id, snapshot_no, 'gap', field, '' FROM spec_gaps),
steps AS (SELECT * FROM (SELECT spec_id, snapshot_no AS step, lag(snapshot_no) OVER (PARTITION BY spec_id ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT spec_id, snapshot_no FROM spec_values)) WHERE prev IS NOT NULL),
now AS (SELECT s.spec_id, step, kind, item, val FROM steps s JOIN e ON e.spec_id = s.spec_id AND e.snapshot_no = step), old AS (SELECT s.spec_id, step, kind, item, val FROM steps s JOIN e ON e.spec_id = s.spec_id AND e.snapshot_no = prev)
SELECT coalesce(n.spec_id, o.spec_id) AS spec_id, coalesce(n.step, o.step) AS snapshot_no, CASE WHEN o.item IS NULL THEN CASE n.kind WHEN 'value' THEN 'value_added' ELSE n.kind || '_opened' END WHEN n.item IS NULL THEN CASE o.kind WHEN 'value' THEN 'value_removed' ELSE o.kind || '_closed' END ELSE 'value_changed' END AS change_kind,
coalesce(n.item, o.item) AS item FROM now n FULL JOIN old o ON n.spec_id = o.spec_id AND n.step = o.step AND n.kind = o.kind AND n.item = o.item WHERE n.item IS NULL OR o.item IS NULL OR n.val <> o.val"""

_SUPERSEDED = """winners AS (SELECT DISTINCT type, name_key, cond, value_key AS won FROM v WHERE claim_id IN (SELECT selected_claim_id FROM resolved WHERE outcome IN ('SELECTED', 'SCOPED'))),
lost AS (SELECT claim_id FROM v JOIN winners w ON v.type = w.type AND v.name_key = w.name_key AND v.cond = w.cond WHERE status = 'verified' GROUP BY claim_id HAVING bool_and(value_key <> won))"""
_KNOWN = _in(KNOWN_SETTINGS)
_MERGED = "min(claim_id) AS exemplar, count(DISTINCT claim_id) AS n_refs, count(DISTINCT paper_id) AS n_papers"

_CANDIDATE = f"""WITH c AS (SELECT record_id, paper_id, scope_id, json_valid(payload) AS readable, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM claim_candidates),
f AS (SELECT record_id, paper_id, scope_id, readable, j->>'$.canonical_name' AS canonical_name, j->>'$.value' AS value, j->>'$.value_type' AS value_type, j->>'$.condition' AS condition, j->>'$.quote' AS quote FROM c),
k AS (SELECT *, {_PLAIN_NAME} AS name_key FROM f),
r AS (SELECT *, CASE WHEN NOT readable THEN 'unreadable reply' WHEN coalesce(trim(quote), '') = '' THEN 'no supporting quote supplied' WHEN NOT coalesce(regexp_matches(name_key, '^[a-z][a-z0-9_]*$'), false) THEN 'schema violation: canonical_name' WHEN value IS NULL THEN 'schema violation: value' END AS reason FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, paper_id, scope_id, name_key, {_key('value')}, {_cond('condition')}, {_squeeze('quote')} ORDER BY record_id) AS rank FROM r)"""


# Numbers in a text. The engine has no look-around, so what stands before and behind a number is consumed:
# separators are doubled before, and signs between digits set off from the digits behind them.
def _numbers(x: str) -> str:
    tidy = lambda t: f"replace(replace({t}, ',', ''), '−', '-')"
    apart = x
    for _ in range(2):
        apart = f"regexp_replace({apart}, '(\\d)([-+−])(\\d)', '\\1\\2 \\3', 'g')"
    apart = f"regexp_replace({apart}, '([^\\w.,+−-])', '\\1\\1', 'g')"
    plain = f"list_transform(regexp_extract_all({apart}, '(?:^|[^\\w.])([-+−]?\\d[\\d,]*(?:\\.\\d+)?(?:[eE][-+]?\\d+)?)(?:$|\\W)', 1), lambda t: try_cast({tidy('t')} AS DOUBLE))"
    sci = "'([-+−]?\\d+(?:\\.\\d+)?)\\s*(?:x|×|\\*|·)\\s*10\\s*\\^?\\s*\\{?([-+−]?\\d+)\\}?'"
    both = f"list_transform(regexp_extract_all({x}, {sci}, 0), lambda t: try_cast({tidy(f'regexp_extract(t, {sci}, 1)')} || 'e' || {tidy(f'regexp_extract(t, {sci}, 2)')} AS DOUBLE))"
    return f"list_filter(list_concat({both}, {plain}), lambda n: n IS NOT NULL)"


def _stated(nums: str, v: str) -> str:
    return f"len(list_filter({nums}, lambda n: (n = 0 AND {v} = 0) OR abs(n - {v}) < 1e-6 * greatest(abs(n), abs({v})))) > 0"


_VERIFIED = f"""{_RANGE}, n AS (SELECT *, CASE WHEN quote IS NOT NULL THEN {_numbers('quote')} END AS nums FROM ranged),
checked AS (SELECT *, CASE WHEN value_num IS NULL OR value_type = 'bool' OR quote IS NULL THEN 'n/a' WHEN {_stated('nums', 'value_num')} THEN 'pass' ELSE 'warn' END AS numeric_result,
  CASE WHEN trace_result = 'fail' THEN 'citation_trace' WHEN range_result = 'fail' THEN 'range_check' WHEN symbol_result = 'fail' THEN 'symbol_check' END AS failed_check FROM n),
verified AS (SELECT *, CASE WHEN failed_check IS NOT NULL THEN 'rejected' WHEN confidence < 0.6 THEN 'extracted' ELSE 'verified' END AS new_status FROM checked),
report AS (SELECT paper_id, count(*) AS total, count(*) FILTER (new_status = 'verified') AS n_verified, count(*) FILTER (new_status = 'rejected') AS n_rejected, count(*) FILTER (new_status = 'extracted') AS low_confidence,
  count(*) FILTER (range_result = 'warn' OR numeric_result = 'warn') AS warned, count(*) FILTER (failed_check = 'citation_trace') AS by_trace, count(*) FILTER (failed_check = 'range_check') AS by_range FROM verified GROUP BY 1)"""

# Similarity of word sets by longest common subsequences, a row of the table of lengths at a time.
_LCS = """list_reduce(list_prepend(list_transform(range(0, len(sb) + 1), lambda i: 0), list_transform(string_split(sa, ''), lambda c: [ord(c)::INTEGER])),
  lambda acc, e: list_prepend(0, list_transform(range(1, len(sb) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(acc[k + 1], acc[k] + CASE WHEN ord(sb[k]) = e[1] THEN 1 ELSE 0 END))))))[len(sb) + 1]"""


def _similar(forms: str, cut_at: float) -> str:
    """CTEs from ``forms(name_key, cond, text, form)`` to ``named(name_key, cond, text, answer)``."""
    return f"""pairs AS (SELECT a.name_key, a.cond, a.text AS l, b.text AS r, list_distinct(list_filter(string_split(a.form, ' '), lambda w: w <> '')) AS aw, list_distinct(list_filter(string_split(b.form, ' '), lambda w: w <> '')) AS bw
  FROM {forms} a JOIN {forms} b ON a.name_key = b.name_key AND a.cond = b.cond AND a.text < b.text),
parts AS (SELECT *, array_to_string(list_sort(list_filter(aw, lambda w: list_contains(bw, w))), ' ') AS s, array_to_string(list_sort(list_filter(aw, lambda w: NOT list_contains(bw, w))), ' ') AS sa, array_to_string(list_sort(list_filter(bw, lambda w: NOT list_contains(aw, w))), ' ') AS sb FROM pairs WHERE len(aw) > 0 AND len(bw) > 0),
sized AS (SELECT *, len(s) AS n, CASE WHEN s = '' THEN 0 ELSE 1 END AS g FROM parts),
scored AS (SELECT name_key, cond, l, r, CASE WHEN s <> '' AND (sa = '' OR sb = '') THEN 100.0 ELSE greatest(100.0 * (1 - (len(sa) + len(sb) - 2 * {_LCS})::DOUBLE / (2 * (n + g) + len(sa) + len(sb))), CASE WHEN s <> '' THEN 100.0 * (1 - (g + len(sa))::DOUBLE / (2 * n + g + len(sa))) ELSE 0 END, CASE WHEN s <> '' THEN 100.0 * (1 - (g + len(sb))::DOUBLE / (2 * n + g + len(sb))) ELSE 0 END) END AS ratio FROM sized),
near AS (SELECT DISTINCT name_key, cond, l, r FROM scored WHERE ratio >= {cut_at}),
ways AS (SELECT name_key, cond, l AS a, r AS b FROM near UNION SELECT name_key, cond, r, l FROM near),
reach AS (SELECT name_key, cond, a AS node, a AS other FROM ways UNION SELECT x.name_key, x.cond, x.node, w.b FROM reach x JOIN ways w ON w.name_key = x.name_key AND w.cond = x.cond AND w.a = x.other),
comp AS (SELECT name_key, cond, node, min(other) AS component FROM reach GROUP BY ALL),
named AS (SELECT st.name_key, st.cond, st.text, st.claim_id, st.paper_id, st.p_lo, st.p_hi, coalesce(component, st.text) AS answer FROM st LEFT JOIN comp c ON c.name_key = st.name_key AND c.cond = st.cond AND c.node = st.text)"""


_RECURSIVE = VIEW.replace("WITH ", "WITH RECURSIVE ", 1)


def _stands(kind: str, text: str) -> str:
    return f"""st AS (SELECT name_key, cond, {text} AS text, min(claim_id) AS claim_id, arg_min(paper_id, claim_id) AS paper_id, min(paper_id) AS p_lo, max(paper_id) AS p_hi FROM v WHERE status = 'verified' AND type = '{kind}' AND trim(value) <> '' GROUP BY ALL)"""


_FLAT = "lower(trim(regexp_replace(regexp_replace(text, '\\([^()]*\\)', ' ', 'g'), '[^\\p{L}\\p{N}%]+', ' ', 'g')))"
_METHODS = f"""{_stands('method', "lower(trim(regexp_replace(value, '\\s+', ' ', 'g')))")},
words AS (SELECT *, {_FLAT} AS flat, list_filter(string_split({_FLAT}, ' '), lambda w: w <> '') AS w FROM st),
listed AS (SELECT *, list_filter(list_concat([flat, CASE WHEN len(w) >= 2 THEN array_to_string(list_transform(w, lambda x: x[1]), '') END], list_transform(regexp_extract_all(text, '\\(([^()]+)\\)', 1), lambda x: lower(trim(x)))), lambda x: x IS NOT NULL AND x <> '') AS f FROM words),
forms AS (SELECT name_key, cond, text, unnest(CASE WHEN len(f) > 0 THEN f ELSE [lower(trim(text))] END) AS form FROM listed),
{_similar('forms', 90)}"""
_DEFINITIONS = f"""{_stands('definition', 'lower(trim(value))')}, forms AS (SELECT name_key, cond, text, text AS form FROM st), {_similar('forms', 88)}"""
_MC = f"""{_METHODS}, m_pos AS (SELECT name_key, cond, answer, min(claim_id) AS claim_id, min(p_lo) AS p_lo, max(p_hi) AS p_hi FROM named GROUP BY ALL),
m_g AS (SELECT name_key, cond, count(*) AS n_values, string_agg(claim_id, ',' ORDER BY claim_id) AS ids, string_agg(answer, ' | ' ORDER BY answer) AS answers FROM m_pos GROUP BY ALL HAVING count(*) >= 2 AND min(p_lo) <> max(p_hi)),
mc AS (SELECT {_id('ctr', _cluster("'method'", 'name_key'), "'METHOD_CONFLICT'", 'ids')} AS contradiction_id, {_cluster("'method'", 'name_key')} AS cluster_id, 'METHOD_CONFLICT' AS conflict_type, CASE WHEN name_key IN {_in(STRUCTURAL_PROBLEMS)} THEN 'BLOCKING' ELSE 'MATERIAL' END AS severity, name_key, cond, n_values::INT AS n_values, answers FROM m_g)"""
_DC = f"""{_DEFINITIONS}, d_pos AS (SELECT name_key, cond, answer, min(claim_id) AS claim_id, arg_min(paper_id, claim_id) AS paper_id FROM named GROUP BY ALL),
d_g AS (SELECT name_key, cond, count(*) AS n_values, string_agg(claim_id, ',' ORDER BY claim_id) AS ids, string_agg(answer, ' | ' ORDER BY answer) AS answers FROM d_pos GROUP BY ALL HAVING count(*) >= 2 AND min(paper_id) <> max(paper_id)),
dc AS (SELECT {_id('ctr', _cluster("'definition'", 'name_key'), "'DEFINITION_CONFLICT'", 'ids')} AS contradiction_id, {_cluster("'definition'", 'name_key')} AS cluster_id, 'DEFINITION_CONFLICT' AS conflict_type, 'MATERIAL' AS severity, name_key, cond, n_values::INT AS n_values, answers FROM d_g)"""
# The last kept answer is carried along the sorted ones: those close to it are left out.
_RC = f"""r AS (SELECT *, coalesce(lower(trim(regexp_replace(applies_to, '\\s+', ' ', 'g'))), '') AS applies_key, format('{{:.9e}}', value_num + 0.0) AS answer FROM v WHERE status = 'verified' AND type = 'result' AND value_num IS NOT NULL),
r_ans AS (SELECT name_key, applies_key, cond, answer, arg_min(value_num, claim_id) AS num, min(claim_id) AS claim_id, min(paper_id) AS p_lo, max(paper_id) AS p_hi FROM r GROUP BY ALL),
r_order AS (SELECT *, row_number() OVER (PARTITION BY name_key, applies_key, cond ORDER BY num, claim_id) AS i FROM r_ans),
r_kept AS (SELECT name_key, applies_key, cond, i, num, num AS last, claim_id, true AS kept FROM r_order WHERE i = 1 UNION ALL
  SELECT o.name_key, o.applies_key, o.cond, o.i, o.num, CASE WHEN abs(o.num - k.last) <= 1e-6 * greatest(abs(o.num), abs(k.last)) THEN k.last ELSE o.num END, o.claim_id, NOT abs(o.num - k.last) <= 1e-6 * greatest(abs(o.num), abs(k.last))
  FROM r_kept k JOIN r_order o ON o.name_key = k.name_key AND o.applies_key = k.applies_key AND o.cond = k.cond AND o.i = k.i + 1),
r_papers AS (SELECT name_key, applies_key, cond FROM r_ans GROUP BY ALL HAVING min(p_lo) <> max(p_hi)),
r_g AS (SELECT name_key, applies_key, cond, count(*) AS n_values, min(num) AS low, max(num) AS high, string_agg(claim_id, ',' ORDER BY claim_id) AS ids FROM r_kept JOIN r_papers USING (name_key, applies_key, cond) WHERE kept GROUP BY ALL HAVING count(*) >= 2),
rc AS (SELECT {_id('ctr', _cluster("'result'", 'name_key'), "'RESULT_CONFLICT'", 'ids')} AS contradiction_id, {_cluster("'result'", 'name_key')} AS cluster_id, 'RESULT_CONFLICT' AS conflict_type, 'MATERIAL' AS severity, name_key, '' AS dataset_key, '' AS split_key, applies_key, cond, n_values::INT AS n_values, low, high FROM r_g)"""
_RANKED = "CASE severity " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(SEVERITIES)) + " ELSE 9 END"

_PARAGRAPHS = f"""raw AS (SELECT doc_id, paper_id, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) AS text, generate_subscripts(string_split_regex(text, '\\n[ \\t\\r]*\\n'), 1) AS i FROM documents),
para AS (SELECT doc_id, paper_id, i, {_NORMAL} AS n FROM raw), kept_p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS paragraph FROM para WHERE length(n) >= {SHORTEST}),
sec AS (SELECT doc_id, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) - 1 AS section_index FROM documents),
addr AS (SELECT doc_id, paper_id, section_index, paragraph, n AS text FROM kept_p JOIN sec USING (doc_id))"""


def _traced(claims: str) -> str:
    """CTE ``traced`` from ``claims(claim_id, paper_id, span_id, char_end, quote_hash, value_num, value_type)``."""
    part = lambda i: f"try_cast(regexp_extract(span_id, '^([^#]+)#s(\\d+)\\.p(\\d+)\\.(\\d+)$', {i}) AS BIGINT)"
    return f"""spot AS (SELECT claim_id, paper_id, span_id, char_end, quote_hash, value_num, value_type, regexp_extract(span_id, '^([^#]+)#s(\\d+)\\.p(\\d+)\\.(\\d+)$', 1) AS s_paper, {part(2)} AS s_sec, {part(3)} AS s_par, {part(4)} AS s_off FROM {claims}),
found AS (SELECT spot.*, CASE WHEN s_off <= length(a.text) THEN substr(a.text, s_off + 1, greatest(greatest(least(coalesce(char_end, length(a.text)), length(a.text)), s_off) - s_off, 0)) END AS span_text FROM spot LEFT JOIN addr a ON a.paper_id = spot.paper_id AND spot.s_paper = spot.paper_id AND a.section_index = s_sec AND a.paragraph = s_par),
hashed AS (SELECT *, CASE WHEN span_text IS NULL THEN 'fail' ELSE 'pass' END AS span_result, CASE WHEN span_text IS NULL THEN 'n/a' WHEN 'sha256:' || sha256({_squeeze('span_text')}) = quote_hash THEN 'pass' ELSE 'fail' END AS hash_result FROM found),
told AS (SELECT *, CASE WHEN hash_result <> 'pass' OR value_num IS NULL OR value_type = 'bool' THEN 'n/a' WHEN {_stated(_numbers('span_text'), 'value_num')} THEN 'pass' ELSE 'warn' END AS numeric_result FROM hashed),
traced AS (SELECT *, CASE WHEN span_result = 'fail' OR hash_result = 'fail' THEN 'fail' WHEN numeric_result = 'warn' THEN 'warn' ELSE 'pass' END AS trace_result,
  CASE WHEN span_result = 'fail' THEN 'span does not resolve' WHEN hash_result = 'fail' THEN 'text at span differs from recorded hash' WHEN numeric_result = 'warn' THEN 'number not in span' END AS trace_reason FROM told)"""


_CANDIDATES = f"""one AS (SELECT type, name_key, min(paper_id) AS paper_id, min(claim_id) AS claim_id, arg_min((unit, applies_to, section), claim_id) AS f FROM v WHERE status = 'verified' GROUP BY 1, 2 HAVING min(paper_id) = max(paper_id)),
cand AS (SELECT type, name_key, paper_id, claim_id, array_to_string(list_filter([replace(name_key, '_', ' '), CASE WHEN trim(f[1]) NOT IN ('', 'global') THEN trim(f[1]) END, CASE WHEN trim(f[2]) NOT IN ('', 'global') THEN trim(f[2]) END, '(section: ' || nullif(f[3], '') || ')'], lambda x: x IS NOT NULL), ' ') AS description FROM one)"""
_MERGES = "merges AS (SELECT type, ascii(name_key) AS proposal, name_key FROM cand QUALIFY count(*) OVER (PARTITION BY type, ascii(name_key)) >= 2 AND min(paper_id) OVER (PARTITION BY type, ascii(name_key)) <> max(paper_id) OVER (PARTITION BY type, ascii(name_key)))"
_SPLIT = f"""c AS (SELECT {_cluster('type', 'name_key')} AS cluster_id, claim_id, value_key, coalesce(lower(trim(unit)), '') AS unit_key, CASE WHEN applies_to <> 'global' THEN nullif(lower(trim(applies_to)), '') END AS label FROM v WHERE status = 'verified'),
k AS (SELECT cluster_id, count(label) > 0 AS split FROM c GROUP BY 1), kids AS (SELECT c.*, CASE WHEN split THEN coalesce(label, 'unassigned_' || claim_id) ELSE '' END AS child FROM c JOIN k USING (cluster_id)),
val AS (SELECT cluster_id, child, count(*) AS n, count(DISTINCT (value_key, unit_key)) AS kinds, bool_and(value_key IS NOT NULL) AS closed, any_value(value_key || '|' || unit_key) AS key FROM kids GROUP BY 1, 2),
again AS (SELECT cluster_id, n, CASE WHEN closed AND kinds = 1 THEN 'v|' || key ELSE 'c|' || child END AS child FROM val)"""


def _like(a: str, b: str) -> str:
    apart = f"len(list_filter(range(1, len({a}) + 1), lambda i: {a}[i] <> {b}[i]))"
    return f"({a} = {b} OR (len({a}) >= {ABBREVIATION} AND starts_with({b}, {a})) OR (len({b}) >= {ABBREVIATION} AND starts_with({a}, {b})) OR (len({a}) = len({b}) AND len({a}) >= {RESPELT} AND {apart} = 1))"


def _same(l: str, r: str) -> str:
    words = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[_\\s-]+'), lambda t: t <> '')"
    covered = lambda p, q: f"len(list_filter({p}, lambda t: len(list_filter({q}, lambda o: {_like('t', 'o')})) = 0)) = 0"
    return f"(len({words(l)}) > 0 AND len({words(r)}) > 0 AND ({covered(words(l), words(r))} OR {covered(words(r), words(l))}))"


_OLD_GAPS = "f AS (SELECT g.*, min(snapshot_no) OVER (PARTITION BY spec_id) AS first FROM spec_gaps g), old AS (SELECT spec_id, field, min(gap_id) AS gap_id, min(question) AS question, min(criticality) AS criticality FROM f WHERE snapshot_no = first GROUP BY 1, 2)"
_PROPOSED = f"""WITH {_OLD_GAPS},
q AS (SELECT spec_id, snapshot_no AS rank, nullif(regexp_replace(lower(trim(field)), '[\\s-]+', '_', 'g'), '') AS field, nullif(trim(array_to_string(list_filter(list_transform(regexp_extract_all(question, '[^.?!]+[.?!]*'), lambda s: trim(s)), lambda s: NOT regexp_matches(s, '{SUGGESTING}')), ' ')), '') AS question, criticality FROM f WHERE snapshot_no > first),
p AS (SELECT spec_id, field, min(rank) AS rank, arg_min(question, (rank, question)) AS question, arg_min(criticality, (rank, question)) AS criticality FROM q WHERE field IS NOT NULL AND question IS NOT NULL GROUP BY 1, 2),
supplied AS (SELECT DISTINCT spec_id, canonical_name AS name FROM spec_values WHERE coalesce(condition, '') = ''), contested AS (SELECT DISTINCT spec_id, canonical_name AS name FROM spec_values WHERE coalesce(condition, '') <> ''),
p1 AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM supplied s WHERE s.spec_id = p.spec_id AND {_same('p.field', 's.name')})),
lent AS (SELECT o.spec_id, o.field, arg_max(p1.question, p1.rank) AS lent FROM old o JOIN p1 ON p1.spec_id = o.spec_id AND {_same('p1.field', 'o.field')} GROUP BY 1, 2),
p2 AS (SELECT * FROM p1 WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.spec_id = p1.spec_id AND {_same('p1.field', 'o.field')})),
p3 AS (SELECT * FROM p2 WHERE NOT EXISTS (SELECT 1 FROM contested c WHERE c.spec_id = p2.spec_id AND ({_same('p2.field', 'c.name')} OR contains(replace(p2.field, '_', ' ') || ' ' || lower(p2.question), replace(lower(c.name), '_', ' ')))))
SELECT o.spec_id, o.gap_id, o.field, coalesce(lent, o.question) AS question, o.criticality, 'checklist' AS origin FROM old o LEFT JOIN lent l ON l.spec_id = o.spec_id AND l.field = o.field
UNION ALL SELECT spec_id, {_id('gap', "'global'", 'field')}, field, question, CASE WHEN criticality IN ('BLOCKING', 'MATERIAL', 'COSMETIC') THEN criticality ELSE 'MATERIAL' END, 'proposed' FROM p3"""

_RES = """held AS (SELECT DISTINCT spec_id, snapshot_no, resolved_from AS item FROM spec_values WHERE resolved_from <> ''),
steps2 AS (SELECT * FROM (SELECT spec_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY spec_id ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT spec_id, snapshot_no FROM spec_values)) WHERE prev IS NOT NULL),
res AS (SELECT s.spec_id, s.snapshot_no, 'resolution_added' AS change_kind, h.item FROM steps2 s JOIN held h ON h.spec_id = s.spec_id AND h.snapshot_no = s.snapshot_no WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.spec_id = s.spec_id AND o.snapshot_no = s.prev AND o.item = h.item)
UNION ALL SELECT s.spec_id, s.snapshot_no, 'resolution_withdrawn', h.item FROM steps2 s JOIN held h ON h.spec_id = s.spec_id AND h.snapshot_no = s.prev WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.spec_id = s.spec_id AND o.snapshot_no = s.snapshot_no AND o.item = h.item))"""

_SOLD = """sold AS (SELECT s_nationkey, c_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
e AS (SELECT a.s_nationkey AS s, a.c_nationkey AS t FROM sold a LEFT JOIN sold b ON a.s_nationkey = b.c_nationkey AND a.c_nationkey = b.s_nationkey WHERE a.s_nationkey <> a.c_nationkey AND a.n > coalesce(b.n, 0) UNION SELECT n_nationkey, n_regionkey + 1000 FROM nation)"""


def oracle_sql() -> dict[str, str]:
    return {
        "value_conflict": f"{CONFLICTS} SELECT contradiction_id, cluster_id, severity, name_key, cond, unit_key, n_values FROM conflicts",
        "value_conflict_severity": f"{CONFLICTS} SELECT severity, count(*) AS n FROM conflicts GROUP BY 1",
        "specificity": f"{VIEW} SELECT claim_id, {_SPECIFICITY.format(c='condition', a='applies_to', e='stated_explicitly')} AS specificity FROM v",
        "paper_support": f"{CONFLICTS} SELECT contradiction_id, claim_id, paper_id, position, venue, year, peer_reviewed FROM positions",
        "quote_hash_dups": f"SELECT 'sha256:' || sha256({_squeeze('text')}) AS quote_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents WHERE regexp_matches(text, '[^{WS[1:-1]}]') GROUP BY 1 HAVING count(*) > 1",
        "normalized_texts": f"SELECT doc_id, sha256(n) AS digest, length(n) AS n_chars FROM (SELECT doc_id, {_NORMAL} AS n FROM documents WHERE text IS NOT NULL)",
        "paragraph_spans": f"""WITH raw AS (SELECT doc_id, paper_id, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) AS text, generate_subscripts(string_split_regex(text, '\\n[ \\t\\r]*\\n'), 1) AS i FROM documents),
            p AS (SELECT doc_id, paper_id, i, {_NORMAL} AS n FROM raw), kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS paragraph FROM p WHERE length(n) >= {SHORTEST}),
            s AS (SELECT doc_id, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) - 1 AS section_index FROM documents)
            SELECT doc_id, paper_id, section_index::INT AS section_index, paragraph::INT AS paragraph, paper_id || '#s' || section_index || '.p' || paragraph || '.0' AS span_id, length(n) AS n_chars, 'sha256:' || sha256({_squeeze('n')}) AS quote_hash FROM kept JOIN s USING (doc_id)""",
        "slugs": f"SELECT paper_id, {_slug('title')} AS slug, 'cmp_' || CASE WHEN venue IS NULL THEN 'unnamed' ELSE {_slug('venue')} END AS component_id FROM papers",
        "span_parts": r"""SELECT DISTINCT claim_id, try_cast(regexp_extract(s, '^([^#]+)#s(\d+)\.p(\d+)\.(\d+)$', 2) AS BIGINT) AS section, try_cast(regexp_extract(s, '^([^#]+)#s(\d+)\.p(\d+)\.(\d+)$', 3) AS BIGINT) AS paragraph, try_cast(regexp_extract(s, '^([^#]+)#s(\d+)\.p(\d+)\.(\d+)$', 4) AS BIGINT) AS char_offset,
            coalesce(nullif(regexp_extract(s, '^([^#]+#s\d+)', 1), ''), s) AS scope_id, coalesce(nullif(regexp_extract(s, '^([^#]+#s\d+)', 1), ''), s) = given AS round_trip FROM (SELECT claim_id, provenance.span_id AS s, provenance.scope_id AS given FROM claims)""",
        "content_ids": f"{VIEW} SELECT claim_id, {_id('clm', 'paper_id', 'type', 'span_id', 'value')} AS content_id, {_cluster('type', 'name_key')} AS cluster_id FROM v",
        "claims_once": f"WITH {ONCE} SELECT claim_id, paper_id, type, status, value, confidence, loaded_at FROM once",
        "value_keys": f"{VIEW} SELECT value_type, count(DISTINCT value_key) AS n_keys, count(value_num) AS n_numeric FROM v GROUP BY 1",
        "citation_keys": r"""WITH k AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[([A-Za-z][A-Za-z0-9_:.-]{2,})\]', 1)) AS ref_key FROM documents)
            SELECT doc_id, ref_key, count(*) AS n FROM k WHERE regexp_matches(ref_key, '\d') AND NOT regexp_matches(ref_key, '^[A-Z0-9_:.-]+$') GROUP BY 1, 2""",
        "find_span": f"""WITH n AS (SELECT item_id, {_squeeze('text')} AS needle FROM eval_items WHERE text IS NOT NULL), t AS (SELECT doc_id, text, {_squeeze('text')} AS body FROM documents WHERE text IS NOT NULL),
            hit AS (SELECT item_id, min(doc_id) AS doc_id FROM n JOIN t ON contains(body, needle) WHERE needle <> '' GROUP BY item_id),
            pos AS (SELECT item_id, doc_id, text, replace(regexp_escape(needle), '\\ ', '{WS}+') AS pattern FROM hit JOIN n USING (item_id) JOIN t USING (doc_id))
            SELECT item_id, doc_id, length(regexp_extract(text, '(?s)^(.*?)' || pattern, 1))::INT AS at FROM pos""",
        "latex_equations": r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '(?s)\\begin\{(?:equation|align|gather|multline|eqnarray|flalign|displaymath)\*?\}(.*?)\\end\{(?:equation|align|gather|multline|eqnarray|flalign|displaymath)\*?\}', 1) AS env, list_filter(regexp_extract_all(text, '(?s)(?:^|[^\\])\\\[(.*?)\\\]', 1), lambda x: trim(x) <> '') AS br FROM documents),
            l AS (SELECT doc_id, unnest(list_concat(env, br)) AS raw, unnest(range(0, len(env) + len(br))) AS i FROM e)
            SELECT doc_id, i::INT AS equation_index, trim(regexp_replace(regexp_replace(raw, '\\label\{[^{}]*\}', '', 'g'), '\s+', ' ', 'g')) AS latex FROM l""",
        "reference_entries": r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^(\[\d+\] [^\n]+)', 1)) AS line FROM documents)
            SELECT doc_id, regexp_extract(line, '^\[(\d+)\]', 1)::INT AS ref_key, substr(regexp_replace(line, '^\[\d+\] ', ''), 1, 500) AS raw, nullif(regexp_extract(line, '((?:19|20)\d\d)', 1), '')::INT AS year FROM l""",
        "suspect_math_lines": f"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
            SELECT doc_id, count(*) AS n_lines FROM l WHERE length(line) >= {MATH_LINE} AND (length(line) - length(translate(line, '{MATH_GLYPHS}', '')))::DOUBLE / length(line) >= {MATH_SHARE} GROUP BY 1""",
        "section_triage": " UNION ALL ".join(
            f"""(WITH p AS (SELECT paper_id, count(*) AS n_sections, count(*) FILTER (regexp_matches(section, '{pattern}')) AS n_matched, coalesce(sum(length(text)) FILTER (regexp_matches(section, '{pattern}')), 0) AS m, coalesce(sum(length(text)), 0) AS a FROM documents GROUP BY 1)
            SELECT paper_id, '{kind}' AS kind, n_sections, n_matched, CASE WHEN n_sections < {TRIAGE_LEAST} THEN 'all' WHEN m >= {TRIAGE_SHARE} * a THEN 'pattern' WHEN n_matched > 0 THEN 'pattern_fallback' ELSE 'all_fallback' END AS decision FROM p)"""
            for kind, pattern in SECTION_PATTERNS.items()
        ),
        "batch_packing": f"""WITH RECURSIVE s AS (SELECT paper_id, doc_id, (length(coalesce(text, '')) + length(coalesce(section, '')) + {HEADER})::INT AS size, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) AS i FROM documents),
            f AS (SELECT paper_id, doc_id, size, i, 0 AS batch, size AS used FROM s WHERE i = 1 UNION ALL
            SELECT s.paper_id, s.doc_id, s.size, s.i, CASE WHEN f.used + s.size > 9000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + s.size > 9000 THEN s.size ELSE f.used + s.size END FROM f JOIN s ON s.paper_id = f.paper_id AND s.i = f.i + 1)
            SELECT paper_id, doc_id, size, batch FROM f""",
        "read_candidates": f"{_CANDIDATE} SELECT record_id, readable, canonical_name, value_type FROM f",
        "admitted": f"{_CANDIDATE} SELECT coalesce(reason, CASE WHEN rank = 1 THEN 'admitted' ELSE 'duplicate' END) AS outcome, count(*) AS n FROM n GROUP BY 1",
        "extraction_confidence": "SELECT paper_id, CASE math_fidelity " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in FIDELITY_CONFIDENCE.items()) + " ELSE 0.8 END::DOUBLE AS confidence FROM papers",
        "canonicalized_names": f"{VIEW} SELECT name_key, count(*) AS n_claims, count(DISTINCT canonical_name) AS n_spellings FROM v GROUP BY 1",
        "range_check": f"{_RANGE} SELECT claim_id, range_result FROM ranged",
        "internal_consistency": f"{VIEW} SELECT scope_id, count(*) AS n_claims, count(DISTINCT name_key) AS n_names FROM v WHERE type = 'hyperparameter' AND status IN ('verified', 'extracted') AND name_key NOT IN {_KNOWN} AND value_num IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT name_key) >= 2",
        "self_consistency_vote": f"""{VIEW} SELECT paper_id, type, lower(canonical_name) AS name_key, value_key, arg_min(claim_id, (pass, claim_id)) AS claim_id, count(DISTINCT pass) || '/3' AS self_consistency FROM (SELECT *, strpos('0123456789abcdef', right(claim_id, 1)) % 3 AS pass FROM v) GROUP BY 1, 2, 3, 4""",
        "judged_claims": f"{VIEW} SELECT type, count(*) FILTER (trace_result = 'pass') AS entailed, count(*) FILTER (trace_result <> 'pass') AS not_entailed FROM v GROUP BY 1",
        "alignment_blocks": f"""{VIEW}, b AS (SELECT type, name_key, value_key, count(*) AS n FROM v WHERE status = 'verified' GROUP BY ALL), t AS (SELECT type, name_key, sum(n)::BIGINT AS n_claims, count(*) AS n_values, max(n) AS top FROM b GROUP BY ALL),
            p AS (SELECT type, name_key, count(DISTINCT paper_id) AS n_papers, min(claim_id) AS first_claim FROM v WHERE status = 'verified' GROUP BY ALL)
            SELECT {_cluster('type', 'name_key')} AS cluster_id, type, name_key, n_claims, n_papers, n_values, first_claim, CASE WHEN n_papers <= 1 THEN 'singleton' WHEN n_values = 1 THEN 'unanimous' WHEN top * 2 > n_claims THEN 'majority' ELSE 'conflicting' END AS agreement FROM t JOIN p USING (type, name_key)""",
        "usual_names": f"{VIEW}, n AS (SELECT name_key, canonical_name, count(*) AS n FROM v GROUP BY ALL) SELECT name_key, arg_min(canonical_name, (-n, canonical_name)) AS canonical_name FROM n GROUP BY 1",
        "symbol_map": f"{VIEW} SELECT trim(paper_symbol) AS symbol, name_key, count(DISTINCT paper_id) AS n_papers FROM v WHERE status = 'verified' AND trim(paper_symbol) <> '' GROUP BY 1, 2",
        "single_paper_keys": f"{VIEW} SELECT type, name_key, min(paper_id) AS paper_id, count(*) AS n_claims FROM v WHERE status = 'verified' GROUP BY 1, 2 HAVING min(paper_id) = max(paper_id)",
        "paper_components": f"""{_RECURSIVE}, c AS (SELECT DISTINCT paper_id, trim(paper_symbol) || chr(31) || name_key AS k FROM v WHERE status = 'verified' AND trim(paper_symbol) <> ''), hub AS (SELECT k, min(paper_id) AS hub FROM c GROUP BY 1),
            e AS (SELECT DISTINCT paper_id AS a, hub AS b FROM c JOIN hub USING (k)), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS reach FROM ways UNION SELECT r.node, ways.b FROM r JOIN ways ON r.reach = ways.a)
            SELECT node, min(reach) AS component FROM r GROUP BY 1""",
        "cluster_split": f"""{VIEW}, c AS (SELECT {_cluster('type', 'name_key')} AS cluster_id, claim_id, CASE WHEN applies_to <> 'global' THEN lower(trim(applies_to)) END AS label FROM v WHERE status = 'verified'), k AS (SELECT cluster_id, count(label) > 0 AS split FROM c GROUP BY 1)
            SELECT cluster_id, count(DISTINCT CASE WHEN split THEN coalesce(label, 'unassigned_' || claim_id) ELSE '' END) AS n_children, count(*) AS n_claims FROM c JOIN k USING (cluster_id) GROUP BY 1""",
        "policy_resolve": f"{RESOLVED} SELECT contradiction_id, severity, rule_fired, outcome, selected_claim_id FROM resolved",
        "policy_by_rule": f"{RESOLVED} SELECT coalesce(rule_fired, 'none') AS rule, outcome, count(*) AS n FROM resolved GROUP BY 1, 2",
        "human_upsert": f"{RESOLVED} SELECT contradiction_id, CASE WHEN severity = 'BLOCKING' THEN 'SELECTED' ELSE outcome END AS outcome, CASE WHEN severity = 'BLOCKING' THEN first_claim ELSE selected_claim_id END AS selected_claim_id, CASE WHEN severity = 'BLOCKING' THEN 'human' ELSE 'policy' END AS resolved_by FROM resolved",
        "gap_checklist": f"{_GAPS} SELECT paper_id, {_id('gap', 'paper_id', 'field')} AS gap_id, field, criticality FROM gaps",
        "gap_summary": f"{_GAPS} SELECT criticality, count(*) AS n_gaps FROM gaps GROUP BY 1",
        "gap_ablation": f"""{VIEW}, {_CHECK}, have AS (SELECT DISTINCT paper_id, field FROM v JOIN needs USING (name_key) WHERE status = 'verified'),
            rest AS (SELECT DISTINCT h.paper_id, h.field FROM have h JOIN v ON v.paper_id = h.paper_id WHERE v.name_key IN {_in(TRAINING)} AND v.name_key NOT IN (SELECT name_key FROM needs WHERE needs.field = h.field))
            SELECT field, count(*) AS trials, count(r.paper_id) AS gap_appears FROM have LEFT JOIN rest r USING (paper_id, field) GROUP BY 1""",
        "stripped_questions": f"""WITH q AS (SELECT DISTINCT gap_id, question || ' We suggest a default. It is open.' AS q FROM spec_gaps), s AS (SELECT gap_id, trim(unnest(regexp_extract_all(q, '[^.?!]+[.?!]*'))) AS s, generate_subscripts(regexp_extract_all(q, '[^.?!]+[.?!]*'), 1) AS i, q FROM q)
            SELECT DISTINCT gap_id, string_agg(s, ' ' ORDER BY i) AS question FROM s WHERE NOT regexp_matches(s, '{SUGGESTING}') GROUP BY gap_id, q""",
        "merge_agreeing": f"{VIEW} SELECT type, name_key, cond, value_key, {_MERGED}, {_id('val', 'type', 'name_key', 'cond', 'value_key')} AS value_id FROM v WHERE status = 'verified' GROUP BY type, name_key, cond, value_key",
        "superseded": f"{RESOLVED}, {_SUPERSEDED} SELECT claim_id FROM lost",
        "spec_components": f"""{RESOLVED}, {_SUPERSEDED}, disputed AS (SELECT DISTINCT name_key, cond FROM conflicts JOIN resolved USING (contradiction_id) WHERE outcome IN ('ESCALATED', 'DEFERRED')),
            u AS (SELECT v.*, CASE WHEN name_key IN {_KNOWN} THEN 'cmp_' || {_slug("coalesce(applies_to, 'global')")} ELSE 'cmp_' || {_slug('scope_id')} END AS component_id, CASE WHEN name_key IN {_KNOWN} OR cond <> '' THEN cond ELSE 'reported in section ''' || coalesce(section, '') || '''' END AS c2
            FROM v WHERE status = 'verified' AND type = 'hyperparameter' AND (name_key, cond) NOT IN (SELECT (name_key, cond) FROM disputed) AND claim_id NOT IN (SELECT claim_id FROM lost))
            SELECT component_id, name_key, c2 AS cond, value_key, min(claim_id) AS exemplar, count(DISTINCT claim_id) AS n_refs, count(DISTINCT paper_id) AS n_papers FROM u GROUP BY component_id, name_key, c2, value_key""",
        "expected_results": f"""{VIEW} SELECT name_key, applies_to, cond, min(value_key) AS value_key, min(claim_id) AS exemplar, count(*) AS n_claims FROM v WHERE status = 'verified' AND type = 'result' AND value_num IS NOT NULL GROUP BY name_key, applies_to, cond HAVING min(value_key) = max(value_key)""",
        "assumptions": f"{VIEW} SELECT claim_id, paper_id, type, name_key, value_key FROM v WHERE status = 'verified' AND NOT stated_explicitly",
        "provenance_closure": f"""{VIEW}, refs AS (SELECT claim_id FROM v UNION ALL SELECT candidate_id FROM merge_candidates), j AS (SELECT refs.claim_id, status FROM refs LEFT JOIN v ON v.claim_id = refs.claim_id)
            SELECT count(*) AS total, count(*) FILTER (status = 'verified') AS closed, count(*) FILTER (status <> 'verified') AS unverified, count(*) FILTER (status IS NULL) AS missing, round(count(*) FILTER (status = 'verified')::DOUBLE / count(*), 4) AS completeness FROM j""",
        "dag_cycle": f"""WITH RECURSIVE {_SOLD}, r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s), c AS (SELECT s AS node FROM r WHERE s = t)
            SELECT node FROM c UNION SELECT a.t FROM r a JOIN r b ON a.t = b.s WHERE a.s IN (SELECT node FROM c) AND b.t IN (SELECT node FROM c)""",
        "blocking_gate": f"{RESOLVED} SELECT contradiction_id, conflict_type, name_key, cond FROM conflicts WHERE severity = 'BLOCKING' AND contradiction_id NOT IN (SELECT contradiction_id FROM resolved WHERE outcome NOT IN ('ESCALATED', 'DEFERRED'))",
        "ledger_summary": f"{_LEDGER} SELECT provider, count(*) AS calls, count(*) FILTER (cached) AS cached_calls, count(*) FILTER (failed) AS errors, round(sum(tokens), 2) AS tokens, max(ts) AS last_call FROM ledger GROUP BY 1",
        "quota_headroom": f"{_LEDGER}, {_USED}, lim(provider, daily_limit) AS (VALUES ('view', 80), ('click', 60), ('error', 50)) SELECT provider, day, requests, CASE WHEN daily_limit IS NOT NULL THEN greatest(floor(daily_limit * 0.9) - requests, 0) END::BIGINT AS headroom, requests >= floor(daily_limit * 0.9) AS exhausted FROM used LEFT JOIN lim USING (provider)",
        "provider_fallback": f"""{_LEDGER}, {_USED}, lim(provider, daily_limit) AS (VALUES ('view', 80), ('click', 60)), full_days AS (SELECT provider, day FROM used JOIN lim USING (provider) WHERE requests >= floor(daily_limit * 0.9)), legs(leg, provider) AS (VALUES (1, 'view'), (2, 'click'), (3, 'signup'))
            SELECT event_id AS request_id, arg_min(l.provider, leg) AS provider FROM ledger g CROSS JOIN legs l WHERE failed AND NOT EXISTS (SELECT 1 FROM full_days f WHERE f.provider = l.provider AND f.day = g.ts::DATE) GROUP BY 1""",
        "text_coverage": """WITH d AS (SELECT paper_id, CASE WHEN regexp_matches(section, '(?i)(result|experiment|setup)') THEN length(coalesce(text, '')) ELSE 0 END AS r, length(coalesce(text, '')) AS a FROM documents)
            SELECT paper_id, sum(r)::BIGINT AS read_chars, sum(a)::BIGINT AS all_chars, round(sum(r)::DOUBLE / nullif(sum(a), 0), 3) AS coverage, coalesce(round(sum(r)::DOUBLE / nullif(sum(a), 0), 3), 0.0) < 0.25 AS thin FROM d GROUP BY 1""",
        "cache_misses": f"{_LEDGER} SELECT DISTINCT prompt_hash FROM ledger WHERE NOT cached AND prompt_hash NOT IN (SELECT prompt_hash FROM ledger WHERE cached)",
        "daily_ledger": "SELECT ts::DATE AS day, event_type AS provider, count(*) AS calls, round(sum(value), 2) AS amount FROM events GROUP BY 1, 2",
        "numeric_literals": f"{VIEW}, n AS (SELECT claim_id, {_numbers('quote')} AS nums FROM v WHERE quote IS NOT NULL) SELECT claim_id, len(nums)::INT AS n_numbers, coalesce(list_max(nums), 0.0) AS largest FROM n",
        "numeric_literal_check": f"{_VERIFIED} SELECT claim_id, numeric_result FROM checked",
        "verify_status": f"{_VERIFIED} SELECT claim_id, new_status, failed_check, round(CASE WHEN new_status = 'verified' AND numeric_result = 'warn' THEN round_even(confidence * 0.8, 4) ELSE confidence END, 3) AS new_confidence FROM verified",
        "verification_report": f"{_VERIFIED} SELECT *, round(n_rejected::DOUBLE / total, 6) AS rejection_rate FROM report",
        "verification_summary": f"{_VERIFIED} SELECT " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("total", "n_verified", "n_rejected", "low_confidence", "warned", "by_trace", "by_range")) + " FROM report",
        "formula_quality": r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '(?s)\\begin\{(?:equation|align|gather|multline|eqnarray|flalign|displaymath)\*?\}(.*?)\\end\{(?:equation|align|gather|multline|eqnarray|flalign|displaymath)\*?\}', 1) AS env, list_filter(regexp_extract_all(text, '(?s)(?:^|[^\\])\\\[(.*?)\\\]', 1), lambda x: trim(x) <> '') AS br FROM documents),
            l AS (SELECT doc_id, unnest(list_concat(env, br)) AS raw, unnest(range(0, len(env) + len(br))) AS i FROM e), q AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(raw, '\\label\{[^{}]*\}', '', 'g'), '\s+', ' ', 'g')) AS latex FROM l),
            b AS (SELECT *, regexp_replace(latex, '\\[(){}\[\]]', '', 'g') AS bare, length(regexp_replace(latex, '[^\p{Co}\p{Cc}\x{FFFD}\x{FEFF}]|[\t\n\r]', '', 'g')) AS bad FROM q)
            SELECT doc_id, i::INT AS equation_index, CASE WHEN latex = '' THEN 'empty' WHEN length(latex) < 6 THEN 'too short' WHEN bad > 0.08 * length(latex) THEN 'unusable characters'
            WHEN length(replace(bare, '(', '')) <> length(replace(bare, ')', '')) OR length(replace(bare, '[', '')) <> length(replace(bare, ']', '')) OR length(replace(bare, '{', '')) <> length(replace(bare, '}', '')) THEN 'unbalanced brackets'
            WHEN len(regexp_extract_all(latex || ' ', '\\left[^a-z]')) <> len(regexp_extract_all(latex || ' ', '\\right[^a-z]')) THEN 'unbalanced left and right' ELSE 'fine' END AS quality FROM b""",
        "result_conflict": f"{_RECURSIVE}, {_RC} SELECT * FROM rc",
        "method_conflict": f"{_RECURSIVE}, {_MC} SELECT * FROM mc",
        "definition_conflict": f"{_RECURSIVE}, {_DC} SELECT * FROM dc",
        "conflict_scan": f"""SELECT contradiction_id, conflict_type, severity, name_key, n_values FROM ({CONFLICTS} SELECT contradiction_id, conflict_type, severity, name_key, n_values FROM conflicts) UNION ALL SELECT contradiction_id, conflict_type, severity, name_key, n_values FROM ({_RECURSIVE}, {_RC} SELECT * FROM rc)
            UNION ALL SELECT contradiction_id, conflict_type, severity, name_key, n_values FROM ({_RECURSIVE}, {_MC} SELECT * FROM mc) UNION ALL SELECT contradiction_id, conflict_type, severity, name_key, n_values FROM ({_RECURSIVE}, {_DC} SELECT * FROM dc) ORDER BY {_RANKED}, contradiction_id""",
        "conflict_descriptions": f"""{CONFLICTS}, said AS (SELECT contradiction_id, conflicts.name_key, conflicts.cond, string_agg(value_key || CASE WHEN unit_key <> '' THEN ' ' || unit_key ELSE '' END || CASE WHEN stated_explicitly = false THEN ' (inferred, not stated)' ELSE '' END, ', ' ORDER BY a.claim_id) AS answers FROM conflicts JOIN answers a USING (name_key, cond, unit_key) GROUP BY 1, 2, 3)
            SELECT contradiction_id, 'Papers set ' || name_key || CASE WHEN cond <> '' THEN ' under ''' || cond || '''' ELSE '' END || ' differently: ' || answers || '.' AS description FROM said""",
        "near_approaches": f"""{_RECURSIVE}, st AS (SELECT DISTINCT name_key, '' AS cond, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS text, '' AS claim_id, '' AS paper_id, '' AS p_lo, '' AS p_hi FROM v WHERE type = 'method' AND trim(value) <> ''), forms AS (SELECT name_key, cond, text, text AS form FROM st), {_similar('forms', 90)} SELECT name_key, l, r FROM near""",
        "citation_trace": f"{VIEW}, {_PARAGRAPHS}, {_traced('v')} SELECT claim_id, span_result, hash_result, numeric_result, trace_result, trace_reason FROM traced",
        "quote_trace": f"""WITH {_PARAGRAPHS}, q AS (SELECT doc_id || '/' || paragraph AS claim_id, paper_id, paper_id || '#s' || section_index || '.p' || paragraph || '.3' AS span_id, CASE WHEN paragraph % 2 = 0 THEN length(text) ELSE length(text) - 4 END AS char_end, 'sha256:' || sha256({_squeeze('substr(text, 4)')}) AS quote_hash, paragraph::DOUBLE AS value_num, 'int' AS value_type FROM addr),
            {_traced('q')} SELECT claim_id, span_result, hash_result, numeric_result, trace_result FROM traced""",
        "claim_schema": f"""{VIEW} SELECT claim_id, 'applies_to' AS path, 'required' AS error FROM v WHERE type IN ('hyperparameter', 'method') AND applies_to IS NULL UNION ALL SELECT claim_id, 'canonical_name', 'required' FROM v WHERE canonical_name IS NULL
            UNION ALL SELECT claim_id, 'canonical_name', 'pattern' FROM v WHERE type = 'hyperparameter' AND NOT regexp_matches(canonical_name, '^[a-z][a-z0-9_]*$') UNION ALL SELECT claim_id, 'confidence', 'range' FROM v WHERE coalesce(confidence NOT BETWEEN 0 AND 1, true)
            UNION ALL SELECT claim_id, 'stated_explicitly', 'required' FROM v WHERE stated_explicitly IS NULL UNION ALL SELECT claim_id, 'status', 'enum' FROM v WHERE coalesce(status NOT IN ('extracted', 'verified', 'rejected', 'superseded'), true) UNION ALL SELECT claim_id, 'value', 'required' FROM v WHERE value IS NULL
            UNION ALL SELECT claim_id, 'value', 'number' FROM v WHERE type = 'result' AND value IS NOT NULL AND value_num IS NULL UNION ALL SELECT claim_id, 'value_type', 'enum' FROM v WHERE type = 'hyperparameter' AND coalesce(value_type NOT IN ('float', 'int', 'bool', 'categorical'), true)""",
        "typed_values": f"""WITH {ONCE}, t AS (SELECT claim_id, trim(value) AS v, replace(replace(trim(value), ',', ''), '−', '-') AS n, value_type AS d FROM once), k AS (SELECT *, coalesce(regexp_matches(n, '{NUMBER}'), false) AS num, coalesce(lower(v) IN ('true', 'false'), false) AS flag, coalesce(regexp_matches(n, '^[+-]?[0-9]+$'), false) AS whole FROM t)
            SELECT claim_id, CASE WHEN coalesce(d NOT IN ('float', 'int', 'bool', 'categorical'), true) OR flag THEN CASE WHEN flag THEN 'bool' WHEN whole THEN 'int' WHEN num THEN 'float' ELSE 'categorical' END WHEN d = 'int' AND num AND NOT whole THEN 'float' ELSE d END AS value_type, CASE WHEN d IN ('float', 'int') AND num THEN n ELSE v END AS value FROM k""",
        "cited_references": r"""WITH k AS (SELECT doc_id, paper_id, unnest(regexp_extract_all(text, '\[([A-Za-z][A-Za-z0-9_:.-]{2,})\]', 1)) AS ref_key, generate_subscripts(regexp_extract_all(text, '\[([A-Za-z][A-Za-z0-9_:.-]{2,})\]', 1), 1) AS i FROM documents)
            SELECT doc_id AS claim_id, arg_min(ref_key, i) AS ref_key FROM k WHERE regexp_matches(ref_key, '\d') AND NOT regexp_matches(ref_key, '^[A-Z0-9_:.-]+$') GROUP BY 1""",
        "anchored": f"""{_CANDIDATE}, t AS (SELECT DISTINCT paper_id, {_squeeze('text')} AS body FROM documents WHERE text IS NOT NULL), a AS (SELECT f.record_id FROM f WHERE EXISTS (SELECT 1 FROM t WHERE t.paper_id = f.paper_id AND {_squeeze('f.quote')} <> '' AND contains(t.body, {_squeeze('f.quote')}))),
            w AS (SELECT k.*, CASE WHEN NOT readable THEN 'unreadable reply' WHEN coalesce(trim(quote), '') = '' THEN 'no supporting quote supplied' WHEN a.record_id IS NULL THEN 'quote does not appear in the document' WHEN NOT coalesce(regexp_matches(name_key, '^[a-z][a-z0-9_]*$'), false) THEN 'schema violation: canonical_name' WHEN value IS NULL THEN 'schema violation: value' END AS why FROM k LEFT JOIN a USING (record_id)),
            z AS (SELECT *, row_number() OVER (PARTITION BY why IS NULL, paper_id, scope_id, name_key, {_key('value')}, {_cond('condition')}, {_squeeze('quote')} ORDER BY record_id) AS rank FROM w)
            SELECT coalesce(why, CASE WHEN rank = 1 THEN 'admitted' ELSE 'duplicate' END) AS outcome, count(*) AS n FROM z GROUP BY 1""",
        "merge_candidates": f"{VIEW}, {_CANDIDATES} SELECT * FROM cand",
        "merge_candidates_shown": f"{VIEW}, {_CANDIDATES} SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY type ORDER BY name_key, paper_id) <= 60",
        "valid_merges": f"{VIEW}, {_CANDIDATES}, {_MERGES} SELECT type, proposal, name_key FROM merges",
        "merged_keys": f"""{VIEW}, {_CANDIDATES}, {_MERGES}, per AS (SELECT type, proposal, name_key, count(*) AS n, arg_min((unit, value_type), claim_id) AS f FROM v JOIN merges USING (type, name_key) WHERE status = 'verified' GROUP BY ALL),
            lead AS (SELECT type, proposal, arg_min(name_key, (-n, name_key)) AS to_key, arg_min(f, (-n, name_key)) AS g FROM per GROUP BY 1, 2)
            SELECT type, name_key, to_key AS merged_key FROM per JOIN lead USING (type, proposal) WHERE coalesce(f[1] = g[1], true) AND coalesce((f[2] IN ('float', 'int')) = (g[2] IN ('float', 'int')), true)""",
        "cluster_members": f"{VIEW} SELECT {_cluster('type', 'name_key')} AS cluster_id, count(*) AS n_claims, count(DISTINCT paper_id) AS n_papers, count(DISTINCT nullif(trim(paper_symbol), '')) AS n_symbols FROM v WHERE status = 'verified' GROUP BY 1",
        "remerged_clusters": f"{VIEW}, {_SPLIT} SELECT cluster_id, count(DISTINCT child) AS n_children, sum(n)::BIGINT AS n_claims FROM again GROUP BY 1",
        "matching_fields": f"SELECT DISTINCT g.spec_id, field AS l, canonical_name AS r FROM (SELECT DISTINCT spec_id, field FROM spec_gaps) g JOIN (SELECT DISTINCT spec_id, canonical_name FROM spec_values) n ON n.spec_id = g.spec_id WHERE {_same('field', 'canonical_name')}",
        "proposed_gaps": _PROPOSED,
        "value_links": f"{VIEW} SELECT {_id('val', 'type', 'name_key', 'cond', 'value_key')} AS value_id, claim_id FROM v WHERE status = 'verified'",
        "design_decisions": f"""{VIEW} SELECT 'cmp_' || {_slug("coalesce(nullif(trim(applies_to), ''), 'global')")} AS component_id, name_key AS sub_problem, trim(value) AS approach, true AS adopted, claim_id FROM v WHERE status = 'verified' AND type = 'method'""",
        "component_kinds": f"""{VIEW}, d AS (SELECT 'cmp_' || {_slug("coalesce(nullif(trim(applies_to), ''), 'global')")} AS component_id, count(*) AS n FROM v WHERE status = 'verified' AND type = 'method' GROUP BY 1),
            u AS (SELECT DISTINCT CASE WHEN name_key IN {_KNOWN} THEN 'cmp_' || {_slug("coalesce(applies_to, 'global')")} ELSE 'cmp_' || {_slug('scope_id')} END AS component_id, name_key, CASE WHEN name_key IN {_KNOWN} OR cond <> '' THEN cond ELSE 'reported in section ''' || coalesce(section, '') || '''' END AS c2, value_key FROM v WHERE status = 'verified' AND type = 'hyperparameter'),
            n AS (SELECT component_id, count(*) AS n FROM u GROUP BY 1) SELECT component_id, coalesce(n.n, 0) AS n_values, coalesce(d.n, 0) AS n_decisions FROM n FULL JOIN d USING (component_id)""",
        "contribution": f"{VIEW} SELECT p.paper_id, count(v.claim_id) AS contributed FROM (SELECT DISTINCT paper_id FROM papers) p LEFT JOIN v ON v.paper_id = p.paper_id AND status = 'verified' GROUP BY 1",
        "contributing_papers": f"{VIEW} SELECT paper_id, title FROM papers WHERE paper_id IN (SELECT paper_id FROM v WHERE status = 'verified')",
        "conflict_states": f"""{RESOLVED}, states AS (SELECT CASE WHEN outcome NOT IN ('ESCALATED', 'DEFERRED') THEN 'resolved' WHEN c.severity = 'BLOCKING' THEN 'blocking' WHEN c.severity = 'MATERIAL' THEN 'open' END AS state, c.severity FROM conflicts c JOIN resolved USING (contradiction_id))
            SELECT state, severity, count(*) AS n FROM states WHERE state IS NOT NULL GROUP BY 1, 2""",
        "latex_algorithms": "SELECT doc_id AS paper_id, 0 AS algorithm_index, 'alg:x' AS label, trim('Steps of ' || section) AS caption, '\\caption{Steps of ' || section || '}\\label{alg:x} do it' AS body FROM documents",
        "front_matter": "SELECT doc_id AS paper_id, 'On ' || section AS title, CASE WHEN year BETWEEN 1900 AND 2099 THEN year END AS year, 'We study ' || section || '.' AS abstract FROM documents",
        "bibliography": "SELECT doc_id AS paper_id, 'k' || doc_id AS ref_key, 'Some work, arXiv:1409.0473, 2014.' AS raw, '1409.0473' AS arxiv_id, 2014 AS year FROM documents UNION ALL SELECT doc_id, 'other', 'Old, 1999.', NULL, 1999 FROM documents",
        "plain_sections": "SELECT doc_id AS paper_id, 0 AS section_index, 'Abstract' AS title, 'We study ' || section || '.' AS body FROM documents UNION ALL SELECT doc_id, 1, 'One', 'A bold claim [a].' FROM documents",
        "page_paragraphs": f"""WITH ff AS (SELECT doc_id, string_split(replace(text, chr(10) || chr(10), chr(12)), chr(12)) AS parts FROM documents), pg AS (SELECT doc_id, unnest(parts) AS body, generate_subscripts(parts, 1) AS page FROM ff),
            pp AS (SELECT doc_id, page, unnest(string_split_regex(body, '\\n[ \\t\\r]*\\n')) AS text, generate_subscripts(string_split_regex(body, '\\n[ \\t\\r]*\\n'), 1) AS i FROM pg), pn AS (SELECT doc_id, page, i, length({_NORMAL}) AS n_chars FROM pp)
            SELECT doc_id, page::INT AS page, (row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1)::INT AS paragraph, n_chars FROM pn WHERE n_chars >= {SHORTEST}""",
        "readers": r"""SELECT paper_id, CASE WHEN regexp_matches(r, '(?:^|[/:\s])\d{4}\.\d{4,5}(?:v\d+)?(?:\.pdf)?/?$') THEN 'preprint' WHEN ends_with(r, '.pdf') THEN 'pages' WHEN ends_with(r, '/') THEN 'latex' END AS reader FROM (SELECT paper_id, paper_id || CASE ingest_method WHEN 'pdf' THEN '.pdf' WHEN 'latex' THEN '/' ELSE '' END AS r FROM papers)""",
        "user_sessions": """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true) AS fresh FROM events), s AS (SELECT user_id, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
            SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, max(n) AS longest FROM n GROUP BY 1""",
        "blocked_until": f"{_LEDGER} SELECT provider, strftime(max(CASE WHEN prompt_hash % 2 = 0 THEN date_trunc('second', ts) + to_seconds(prompt_hash) ELSE date_trunc('day', ts) + INTERVAL 1 DAY END), '%Y-%m-%d %H:%M:%S') AS until FROM ledger WHERE failed GROUP BY 1",
        "lost_batches": "SELECT paper_id, 'all' AS kind, round(sum(CASE WHEN doc_id % 3 > 0 THEN length(coalesce(text, '')) ELSE 0 END)::DOUBLE / nullif(sum(length(coalesce(text, ''))), 0), 3) AS coverage, count(*) FILTER (text IS NULL) AS batches_lost FROM documents GROUP BY 1",
        "resolution_diff": f"WITH {_RES} SELECT * FROM res",
        "snapshot_summary": f"WITH {_RES}, a AS (SELECT * FROM ({_P5}) UNION ALL SELECT * FROM res) SELECT spec_id, snapshot_no, count(*) AS n_changes, count(*) FILTER (change_kind IN ('value_changed', 'value_removed', 'resolution_withdrawn')) AS n_breaking FROM a GROUP BY 1, 2",
        "reviewed_formulas": r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '(?s)\\begin\{(?:equation|align|gather|multline|eqnarray|flalign|displaymath)\*?\}(.*?)\\end\{(?:equation|align|gather|multline|eqnarray|flalign|displaymath)\*?\}', 1) AS env, list_filter(regexp_extract_all(text, '(?s)(?:^|[^\\])\\\[(.*?)\\\]', 1), lambda x: trim(x) <> '') AS br FROM documents),
            l AS (SELECT doc_id, trim(regexp_replace(regexp_replace(unnest(list_concat(env, br)), '\\label\{[^{}]*\}', '', 'g'), '\s+', ' ', 'g')) AS latex FROM e),
            q AS (SELECT doc_id, latex, regexp_replace(latex, '\\[(){}\[\]]', '', 'g') AS bare FROM l),
            p AS (SELECT doc_id, length(latex) < 6 OR length(regexp_replace(latex, '[^\p{Co}\p{Cc}\x{FFFD}\x{FEFF}]', '', 'g')) > 0.08 * length(latex) OR length(replace(bare, '(', '')) <> length(replace(bare, ')', '')) OR length(replace(bare, '[', '')) <> length(replace(bare, ']', '')) OR length(replace(bare, '{', '')) <> length(replace(bare, '}', '')) OR len(regexp_extract_all(latex || ' ', '\\left[^a-z]')) <> len(regexp_extract_all(latex || ' ', '\\right[^a-z]')) AS bad FROM q)
            SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'latex_native' WHEN bool_or(bad) THEN 'text_layer_suspect' ELSE 'text_layer' END AS fidelity FROM p GROUP BY 1""",
        "p5_found": _P5,
    }
