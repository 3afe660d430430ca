"""Plain SQL for the same results, written separately from the Spark plans.

The SQL runs on another engine over the same tables and states each operator
in its most literal form: stage by stage with NOT EXISTS for the detectors,
recursion for folds, ordinary windows over whole keys.  It is a check, not a
plan for large data.
"""

from __future__ import annotations

from cloakframe.functions import constants as K
from cloakframe.functions.patterns import SPACE, re2
from cloakframe.plans import synth

ORACLES: dict[str, str] = {}


# --- building blocks ---------------------------------------------------------------

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(q(v) for v in values)})"


def any_of(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def match(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(re2(pattern))})"


def trim_all(expr: str) -> str:
    return f"regexp_replace({expr}, {q(rf'^[{SPACE}]+|[{SPACE}]+' + chr(92) + 'z')}, '', 'g')"


def digits(expr: str) -> str:
    return f"regexp_replace({expr}, '[^0-9]', '', 'g')"


def luhn(d: str) -> str:
    total = (f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 "
             f"THEN (CAST({d}[i] AS INT) * 2) // 10 + (CAST({d}[i] AS INT) * 2) % 10 ELSE CAST({d}[i] AS INT) END))")
    return f"(length({d}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


PREV1 = "(CASE WHEN start_pos > 0 THEN substr(content, start_pos, 1) ELSE '' END)"
PREV2 = "(CASE WHEN start_pos > 1 THEN substr(content, start_pos - 1, 2) WHEN start_pos = 1 THEN substr(content, 1, 1) ELSE '' END)"
NEXT1, NEXT2 = "substr(content, end_pos + 1, 1)", "substr(content, end_pos + 1, 2)"
LONE_NUMBER = (f"NOT (regexp_matches({PREV2}, {q(f'[0-9][{SPACE}' + chr(92) + '-]?' + chr(92) + 'z')}) "
               f"OR regexp_matches({NEXT2}, {q(f'^[{SPACE}' + chr(92) + '-]?[0-9]')}))")
LONE_WORD = f"NOT (regexp_matches({PREV1}, '[0-9A-Za-z]') OR regexp_matches({NEXT1}, '[0-9A-Za-z]'))"
LONE_DIGITS = f"NOT (regexp_matches({PREV1}, '[0-9]') OR regexp_matches({NEXT1}, '[0-9]'))"
_D = digits("value")
_DOMAIN = "lower(split_part(value, '@', 2))"
STATE = in_("upper(left(value, 2))", K.STATE_CODES)

# priority, type, pattern, context condition, condition on the match
STAGES = [
    (2, "UPI", "UPI", "true", in_(_DOMAIN, K.UPI_PROVIDERS)),
    (3, "EMAIL", "EMAIL", "NOT public_area",
     f"NOT {in_(f'split_part({_DOMAIN}, ' + q('.') + ', 1)', K.UPI_PROVIDERS)} "
     f"AND NOT {in_('lower(split_part(value, ' + q('@') + ', 1))', K.SYSTEM_MAILBOXES)}"),
    (4, "CARD", "CARD", "true", f"{luhn(_D)} AND {LONE_NUMBER}"),
    (5, "BANK_ACCOUNT", "BANK_ACCOUNT", "bank", LONE_NUMBER),
    (6, "EPFO_UAN", "EPFO_UAN", "uan", LONE_NUMBER),
    (7, "AADHAAR", "AADHAAR", "NOT bank AND NOT uan",
     f"length({_D}) = 12 AND {LONE_NUMBER} AND {_D} <> repeat(left({_D}, 1), 12)"),
    (8, "PAN", "PAN", "true", LONE_WORD),
    (9, "PHONE", "PHONE_IN", "NOT support_phone AND NOT page_edge",
     f"{LONE_NUMBER} AND NOT regexp_matches({PREV1}, '[0-9A-Za-z]')"),
    (10, "PHONE", "PHONE_INTL", "NOT support_phone", "NOT regexp_matches(value, '^[+]91[^0-9A-Za-z_]')"),
    (11, "IP", "IP", "true", "NOT " + in_("value", K.HARMLESS_IPS)),
    (12, "IFSC", "IFSC", "true", LONE_WORD),
    (13, "DOB", "DOB", "dob", "true"),
    (14, "PASSPORT", "PASSPORT", "passport", LONE_WORD),
    (15, "OTP", "OTP", "otp", LONE_DIGITS),
    (16, "VOTER_ID", "VOTER_ID", "true", LONE_WORD),
    (17, "DL", "DL", "true", f"{LONE_WORD} AND ({STATE} OR dl)"),
    (18, "VEHICLE_RC", "VEHICLE_RC", "true",
     f"{LONE_WORD} AND ({STATE} OR vehicle OR regexp_matches(value, {q(rf'^(?i)[0-9]{{2}}[-{SPACE}]?BH')}))"),
]


def detect(source: str, keys: list[str]) -> str:
    """CTE list ending in ``found``: kept spans of ``source``.

    ``source`` yields the keys, field, content, password and the context flags.
    """
    k = ", ".join(keys)
    same = " AND ".join(f"p.{c} = c.{c}" for c in [*keys, "field"])
    ctes = [f"src AS MATERIALIZED ({source})",
            f"k1 AS MATERIALIZED (SELECT {k}, field, 1 AS prio, 'PASSWORD_FIELD' AS type, {q(K.HIDDEN_VALUE)} AS value, "
            "0 AS start_pos, length(content) AS end_pos FROM src WHERE password AND content <> '')"]
    last = "k1"
    for prio, kind, name, context, keep in STAGES:
        pattern = K.PATTERNS[name].replace(r"(?!91\b)", "")
        p = q(re2(pattern))
        ctes.append(
            f"c{prio} AS MATERIALIZED (SELECT *, start_pos + length(value) AS end_pos FROM (SELECT * EXCLUDE (parts, i), parts[i] AS value, "
            "CAST(coalesce(list_sum(list_transform(parts[1:i-1], lambda x: length(x))), 0) AS INT) AS start_pos "
            f"FROM (SELECT *, unnest(range(2, len(parts) + 1, 2)) AS i FROM (SELECT *, "
            f"string_split(regexp_replace(content, {p}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts "
            f"FROM src WHERE NOT password AND content <> '' AND ({context}) AND regexp_matches(content, {p})))))")
        ctes.append(
            f"k{prio} AS MATERIALIZED (SELECT * FROM {last} UNION ALL SELECT {k}, field, {prio} AS prio, {q(kind)} AS type, value, "
            f"start_pos, end_pos FROM c{prio} c WHERE ({keep}) AND NOT EXISTS (SELECT 1 FROM {last} p WHERE {same} "
            "AND c.start_pos < p.end_pos AND c.end_pos > p.start_pos))")
        last = f"k{prio}"
    ctes.append(f"found AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS confidence, 'REGEX' AS method FROM {last})")
    return ",\n".join(ctes)


NO_CONTEXT = "false AS password, " + ", ".join(
    f"false AS {f}" for f in ("public_area", "page_edge", "support_phone", "bank", "uan", "dob", "passport", "otp", "dl", "vehicle"))


def clean(expr: str) -> str:
    return f"replace({expr}, chr(1), chr(2))"


def context(parent_tag: str, parent_class: str, parent_id: str, labels: str, kind: str, auto: str) -> str:
    label = f"regexp_replace(lower({labels}), {q(f'[^a-z0-9{SPACE}]')}, '', 'g')"
    parts = [f"(coalesce({kind}, '') = 'password' OR contains(coalesce({auto}, ''), 'password')) AS password",
             f"({in_(f'lower({parent_tag})', K.NON_PERSONAL_AREAS)} OR {any_of(f'lower(coalesce({parent_class}, ' + q('') + '))', K.NON_PERSONAL_AREAS)} "
             f"OR {any_of(f'lower(coalesce({parent_id}, ' + q('') + '))', K.NON_PERSONAL_AREAS)}) AS public_area",
             f"upper({parent_tag}) IN ('FOOTER', 'NAV') AS page_edge"]
    for name, words in K.LABELS.items():
        parts.append(f"{any_of(label, words)} AS {name}")
    return ", ".join(parts)


def derived(base: str, columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(synth.select_list(columns))} FROM {base}"


SPAN_COLUMNS = "field, type, value, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos, confidence, method"
DOC_SOURCE = f"SELECT doc_id, source AS session_id, 'text' AS field, {clean('text')} AS content, {NO_CONTEXT} FROM documents"
DOCS = detect(DOC_SOURCE, ["doc_id", "session_id"])
LABELLED = (f"el AS (SELECT *, {context('parent_tag', 'parent_class', 'parent_id', 'nearby_labels', 'NULL', 'NULL')} "
            f"FROM ({derived('orders', synth.ELEMENTS)})),\n"
            + detect(f"SELECT *, 'text' AS field, {clean('text')} AS content FROM el", ["element_id"]))

ORACLES["spans_greedy"] = f"WITH {DOCS} SELECT doc_id, {SPAN_COLUMNS} FROM found"
for _name, _kind in (("det_email", "EMAIL"), ("det_ip", "IP"), ("det_card_luhn", "CARD")):
    ORACLES[_name] = f"WITH {DOCS} SELECT doc_id, {SPAN_COLUMNS} FROM found WHERE type = {q(_kind)}"
ORACLES["det_phone_intl"] = "WITH " + detect(
    "SELECT o_orderkey AS doc_id, 'text' AS field, concat(CASE o_orderkey % 3 WHEN 0 THEN '+44 ' WHEN 1 THEN '+91 ' ELSE '+1-' END, "
    f"lpad(CAST(o_orderkey AS STRING), 9, '2'), ' ext') AS content, {NO_CONTEXT} FROM orders", ["doc_id"]) + (
    f" SELECT doc_id, {SPAN_COLUMNS} FROM found")
for _name, _kind in {"upi": "UPI", "email_context": "EMAIL", "card_labelled": "CARD", "bank_account": "BANK_ACCOUNT",
                     "epfo_uan": "EPFO_UAN", "aadhaar": "AADHAAR", "pan": "PAN", "phone_in": "PHONE", "ifsc": "IFSC",
                     "dob": "DOB", "passport": "PASSPORT", "otp": "OTP", "voter_id": "VOTER_ID", "dl": "DL",
                     "vehicle_rc": "VEHICLE_RC"}.items():
    ORACLES[f"det_{_name}"] = f"WITH {LABELLED} SELECT element_id, {SPAN_COLUMNS} FROM found WHERE type = {q(_kind)}"

_CARDNO = "concat('4', lpad(CAST(o_orderkey AS STRING), 15, '0'))"
ORACLES["luhn_valid"] = f"SELECT o_orderkey, {luhn('c')} AS ok FROM (SELECT o_orderkey, {_CARDNO} AS c FROM orders)"
ORACLES["span_counts"] = f"WITH {DOCS} SELECT doc_id, type, method, count(*) AS n_spans FROM found GROUP BY ALL"
ORACLES["pii_by_quality"] = f"""WITH {DOCS},
    per AS (SELECT d.doc_id, count(f.type) AS n FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id)
    SELECT CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, count(*) AS n_docs,
           count(*) FILTER (n > 0) AS with_pii, CAST(sum(n) AS BIGINT) AS n_spans
    FROM per JOIN labels USING (doc_id) GROUP BY quality, toxic"""

# --- attribute rules ---------------------------------------------------------------------

A = {k: v for k, v in K.ATTRIBUTE_PATTERNS.items()}
_LAB = "label"
_V, _T = "coalesce(value, '')", "coalesce(text, '')"
_TV, _TT = trim_all(_V), trim_all(_T)


def _has(field: str, kind: str) -> str:
    return f"EXISTS (SELECT 1 FROM found f WHERE f.element_id = e.element_id AND f.field = {q(field)} AND f.type = {q(kind)})"


def _rule(n: int, field: str, kind: str, value: str, start: str, end: str, conf: str, where: str, method: str = "DOM_ATTRIBUTE") -> str:
    return (f"SELECT session_id, element_id, element_pos, {field} AS field, {100 + n} AS prio, {q(kind)} AS type, {value} AS value, "
            f"{start} AS start_pos, {end} AS end_pos, {conf}::DOUBLE AS confidence, {q(method)} AS method FROM ai e WHERE {where}")


def _whole(n: int, kind: str, where: str) -> str:
    return _rule(n, "'value'", kind, _TV, "0", f"length({_TV})", "0.95", f"{_V} <> '' AND {where} AND NOT {_has('value', kind)}")


_HOLDER = f"({_V} <> '' AND {match(_LAB, A['holder_label'])} AND regexp_matches({_V}, '[a-zA-Z]{{2}}'))"
_GREETED = f"nullif(regexp_extract({_T}, {q(re2(A['greeting']))}, 1), '')"
_GREETS = f"({_T} <> '' AND {match(_LAB, A['account_nav'])} AND {_GREETED} IS NOT NULL)"
_TARGET = f"(CASE WHEN {_V} <> '' THEN {_TV} ELSE {_TT} END)"
_AVATAR = f"(CASE WHEN {_T} <> '' THEN {_T} ELSE {q(K.AVATAR_VALUE)} END)"
_FIELDS = ("SELECT session_id, element_id, element_pos, 'text' AS field, {c1} AS content, {ctx} FROM ai WHERE text <> '' "
           "UNION ALL SELECT session_id, element_id, element_pos, 'placeholder', {c2}, {ctx} FROM ai WHERE placeholder <> '' "
           "UNION ALL SELECT session_id, element_id, element_pos, 'value', {c3}, {ctx} FROM ai WHERE value <> '' AND coalesce(type, '') <> 'password'")
_CTX_NAMES = "password, public_area, page_edge, support_phone, bank, uan, dob, passport, otp, dl, vehicle"
INPUT_SPANS = (
    f"ai AS (SELECT *, lower(concat(selector, ' ', coalesce(nearby_labels, ''), ' ', coalesce(placeholder, ''), ' ', element_id)) AS label, "
    f"{context('parent_tag', 'parent_class', 'parent_id', 'coalesce(nearby_labels, ' + q('') + ')', 'type', 'autocomplete')} "
    f"FROM ({derived('orders', synth.INPUTS)})),\n"
    + detect(_FIELDS.format(c1=clean("text"), c2=clean("placeholder"), c3=clean("value"), ctx=_CTX_NAMES),
             ["session_id", "element_id", "element_pos"]) + ",\nspans AS MATERIALIZED (SELECT session_id, element_id, element_pos, field, prio, type, value, "
    "start_pos, end_pos, confidence, method FROM found\nUNION ALL " + "\nUNION ALL ".join([
        _rule(0, "'text'", "PASSWORD_FIELD", q(K.HIDDEN_VALUE), "0", "0", "1.0", "type = 'password'", "REGEX"),
        _whole(1, "CARD", f"{match(_LAB, A['card_label'])} AND regexp_matches({_V}, '[0-9]{{4}}')"),
        _rule(2, "'value'", "NAME", _TV, "0", f"length({_TV})", "0.9", _HOLDER),
        _rule(3, "'text'", "ADDRESS", _TT, "0", f"length({_TT})", "0.95",
              f"{_T} <> '' AND {match(f'concat({_LAB}, ' + q(' ') + f', {_T})', A['address_label'])} AND {match(_T, A['address_text'])}"),
        _rule(4, "'text'", "NAME", _GREETED, f"instr({_T}, {_GREETED}) - 1", f"instr({_T}, {_GREETED}) - 1 + length({_GREETED})", "0.85", _GREETS),
        _rule(5, "'text'", "AVATAR", _AVATAR, "0", f"length({_AVATAR})", "0.95",
              f"{match(_LAB, A['avatar'])} OR (role = 'img' AND {match(_LAB, A['avatar_img'])})"),
        _rule(6, f"(CASE WHEN {_V} <> '' THEN 'value' ELSE 'text' END)", "NAME", _TARGET, "0", f"length({_TARGET})", "0.9",
              f"{_TARGET} <> '' AND {match(_LAB, A['name_label'])} AND {match(_TARGET, A['name_value'])} AND NOT {_HOLDER} AND NOT {_GREETS}"),
        _whole(7, "BANK_ACCOUNT", f"{match(_LAB, A['bank_label'])} AND length({digits(_V)}) BETWEEN 9 AND 18"),
        _whole(8, "DL", match(_LAB, A["dl_label"])),
        _whole(9, "VOTER_ID", match(_LAB, A["voter_label"])),
        _whole(10, "EPFO_UAN", f"{match(_LAB, A['uan_label'])} AND length({digits(_V)}) = 12"),
        _whole(11, "VEHICLE_RC", match(_LAB, A["vehicle_label"])),
    ]) + ")")
for _name, _kind in {"password": "PASSWORD_FIELD", "card": "CARD", "name": "NAME", "address": "ADDRESS", "avatar": "AVATAR",
                     "bank_account": "BANK_ACCOUNT", "dl": "DL", "voter_id": "VOTER_ID", "epfo_uan": "EPFO_UAN",
                     "vehicle_rc": "VEHICLE_RC"}.items():
    ORACLES[f"att_{_name}"] = f"WITH {INPUT_SPANS} SELECT element_id, {SPAN_COLUMNS} FROM spans WHERE type = {q(_kind)}"

ORACLES["ctx_flags"] = (
    f"SELECT element_id, {context('parent_tag', 'parent_class', 'parent_id', 'nearby_labels', 'NULL', 'NULL')} FROM ({derived('orders', synth.ELEMENTS)})")
ORACLES["label_normalize"] = (
    f"SELECT element_id, trim(regexp_replace(lower(concat(' #', nearby_labels, '! ')), '[^a-z0-9 ]', '', 'g')) AS label FROM ({derived('orders', synth.ELEMENTS)})")
ORACLES["context_build"] = (
    "SELECT element_id, parent_tag AS context_tag, '' AS context_label, coalesce(text, '') AS text, coalesce(value, '') AS value, "
    f"'' AS nearby_labels FROM ({derived('orders', synth.INPUTS)})")
ORACLES["digit_functions"] = (
    "SELECT o_orderkey, d AS digits, length(d) > 1 AND replace(d, left(d, 1), '') = '' AS same, left('No. ' || d, 5) AS clipped "
    "FROM (SELECT o_orderkey, repeat(CAST(o_orderkey % 13 AS STRING), 3) AS d FROM orders)")
ORACLES["email_parts"] = (
    "SELECT element_id, lower(split_part(text, '@', 1)) AS mailbox, lower(split_part(split_part(text, '@', 2), '.', 1)) AS provider "
    f"FROM ({derived('orders', synth.ELEMENTS)}) WHERE text LIKE '%@%'")
_TAIL = "CASE o_orderkey % 5 WHEN 0 THEN '-12 34' WHEN 1 THEN '-1x34' WHEN 2 THEN ':34' WHEN 3 THEN '--34' ELSE 'z 34' END"
_GUARD_TEXT = f"concat(CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN ' ' ELSE '7-' END, o_orderkey, {_TAIL})"


def _guards(start: str, end: str) -> str:
    return f"SELECT o_orderkey, NOT {LONE_NUMBER} AS in_number, NOT {LONE_WORD} AS touches FROM (SELECT o_orderkey, content, {start} AS start_pos, {end} AS end_pos FROM guarded)"


ORACLES["number_guards"] = f"""WITH guarded AS (SELECT o_orderkey, {_GUARD_TEXT} AS content FROM orders), tails AS ({_guards('length(content) - 2', 'length(content)')}), heads AS ({_guards('1', '2')})
    SELECT t.o_orderkey, t.in_number AS tail_in_number, h.in_number AS head_in_number, t.touches AS tail_touches, h.touches AS head_touches
    FROM tails t JOIN heads h USING (o_orderkey)"""

# --- tokens -----------------------------------------------------------------------------------


def vault(spans: str, step: str) -> str:
    order = f"{step}, element_pos, -length(value), start_pos, CASE field WHEN 'text' THEN 0 WHEN 'placeholder' THEN 1 ELSE 2 END, prio"
    return f"""real AS MATERIALIZED (SELECT * FROM {spans} WHERE value <> '' AND value <> {q(K.HIDDEN_VALUE)}),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, value ORDER BY {order}) AS rn FROM real) WHERE rn = 1),
    vault AS MATERIALIZED (SELECT *, concat('[', type, '_', token_no, ']') AS token, {tier('type')} AS category FROM (
        SELECT *, {step} AS first_step, row_number() OVER (PARTITION BY session_id, type ORDER BY {order}, value) AS token_no FROM firsts))"""


def tier(expr: str) -> str:
    return (f"CASE WHEN {in_(expr, K.TIERS['SPII'])} THEN 'SPII' WHEN {in_(expr, K.TIERS['PII'])} THEN 'PII' ELSE 'CONTEXTUAL' END")


DOC_VAULT = DOCS + ",\nspans AS (SELECT *, doc_id AS step_no, 0 AS element_pos FROM found),\n" + vault("spans", "step_no")


def redaction(elements: str, fields: list[str]) -> str:
    """``redacted``: fields after replacing the pairs of each element one by one."""
    ctes = ["""pairs AS MATERIALIZED (SELECT s.ek, s.value, v.token, s.type, row_number() OVER (PARTITION BY s.ek ORDER BY
        -length(s.value), s.start_pos, s.fo, s.prio) AS n FROM (SELECT *, CASE field WHEN 'text' THEN 0 WHEN 'placeholder' THEN 1 ELSE 2 END AS fo FROM keyed) s
        JOIN vault v ON v.session_id = s.session_id AND v.value = s.value)"""]
    for f in fields:
        ctes.append(f"""r_{f} AS (SELECT ek, {f} AS body, 0 AS n, CAST([] AS VARCHAR[]) AS tokens, CAST([] AS VARCHAR[]) AS types FROM {elements}
        UNION ALL SELECT r.ek, replace(r.body, p.value, p.token), CAST(p.n AS INT),
            CASE WHEN contains(r.body, p.value) THEN list_append(r.tokens, p.token) ELSE r.tokens END,
            CASE WHEN contains(r.body, p.value) THEN list_append(r.types, p.type) ELSE r.types END
        FROM r_{f} r JOIN pairs p ON p.ek = r.ek AND p.n = r.n + 1)""")
        ctes.append(f"f_{f} AS MATERIALIZED (SELECT ek, arg_max(body, n) AS body, arg_max(tokens, n) AS tokens, arg_max(types, n) AS types FROM r_{f} GROUP BY ek)")
    return ",\n".join(ctes)


def unique_join(lists: str) -> str:
    """Comma-joined distinct items of a list, in order of first appearance."""
    return f"coalesce(array_to_string(list_filter({lists}, lambda x, i: list_position({lists}, x) = i), ','), '')"


DOC_REDACTED = (DOC_VAULT + ",\nkeyed AS (SELECT *, doc_id AS ek FROM real),\nels AS (SELECT doc_id AS ek, source AS session_id, text FROM documents),\n"
                + redaction("els", ["text"])
                + ",\nredacted AS MATERIALIZED (SELECT e.session_id, e.ek AS step_no, f.body AS text, f.tokens, f.types FROM els e JOIN f_text f USING (ek))")
WR = "WITH RECURSIVE "

ORACLES["tok_number"] = f"WITH {DOC_VAULT} SELECT session_id, token, type, value, token_no, first_step FROM vault"
ORACLES["tok_redact"] = (
    f"{WR}{DOC_REDACTED} SELECT session_id, step_no, text, len(tokens) > 0 AS is_redacted, {unique_join('types')} AS redacted_types, "
    f"{unique_join('tokens')} AS redacted_tokens FROM redacted")
INPUT_VAULT = INPUT_SPANS + ",\nspans2 AS (SELECT *, 0 AS step_no FROM spans),\n" + vault("spans2", "step_no")
_PW = "(coalesce(type, '') = 'password' OR contains(autocomplete, 'password'))"
INPUT_REDACTED = (
    INPUT_VAULT + ",\nkeyed AS (SELECT *, element_id AS ek FROM real),\nels AS (SELECT *, element_id AS ek FROM ai),\n"
    + redaction("els", ["text", "value"])
    + f""",\nredacted AS MATERIALIZED (SELECT e.session_id, e.element_id, e.element_pos,
        CASE WHEN {_PW} THEN {q(K.PASSWORD_TOKEN)} ELSE a.body END AS text,
        CASE WHEN {_PW} THEN {q(K.PASSWORD_TOKEN)} ELSE b.body END AS value,
        list_concat(a.tokens, list_concat(b.tokens, CASE WHEN {_PW} THEN [{q(K.PASSWORD_TOKEN)}] ELSE CAST([] AS VARCHAR[]) END)) AS tokens,
        list_concat(a.types, list_concat(b.types, CASE WHEN {_PW} THEN ['PASSWORD_FIELD'] ELSE CAST([] AS VARCHAR[]) END)) AS types
        FROM els e JOIN f_text a USING (ek) JOIN f_value b USING (ek))""")
ORACLES["tok_inputs"] = (
    f"{WR}{INPUT_REDACTED} SELECT session_id, element_id, text, value, len(tokens) > 0 AS is_redacted, {unique_join('types')} AS redacted_types, "
    f"{unique_join('tokens')} AS redacted_tokens FROM redacted")
ORACLES["tok_manifest"] = f"""{WR}{DOC_REDACTED}, placed AS (SELECT session_id, token, count(DISTINCT step_no) AS n FROM
    (SELECT session_id, step_no, unnest(tokens) AS token FROM redacted) GROUP BY ALL)
    SELECT v.session_id, v.token, v.type AS token_type, coalesce(p.n, 0) AS n_elements FROM vault v LEFT JOIN placed p USING (session_id, token)"""
ORACLES["tok_snapshot_manifest"] = f"""{WR}{DOC_REDACTED},
    used AS (SELECT DISTINCT session_id, step_no, unnest(tokens) AS token FROM redacted)
    SELECT session_id, step_no, string_agg(token, ',' ORDER BY token) AS tokens_used, count(*) AS total_tokens,
    concat('{{', string_agg(concat('"', token, '":"', regexp_replace(token, '^.([A-Z_]+)_[0-9]+.$', '\\1'), '"'), ',' ORDER BY token), '}}') AS token_types
    FROM used GROUP BY session_id, step_no"""
ORACLES["tok_elements"] = f"""{WR}{DOC_REDACTED} SELECT session_id, step_no, concat('e_', step_no) AS element_id,
    {unique_join('types')} AS types, {unique_join('tokens')} AS tokens FROM redacted WHERE len(tokens) > 0"""
_INPUT_AUDIT = f"""audit AS (SELECT session_id, CAST(0 AS BIGINT) AS step_no, element_id, token, type, method, confidence, category FROM vault
    UNION ALL SELECT session_id, 0, element_id, {q(K.PASSWORD_TOKEN)}, 'PASSWORD_FIELD', 'DOM_ATTRIBUTE', 1.0, 'SPII' FROM ai WHERE {_PW})"""
ORACLES["tok_audit"] = f"WITH {INPUT_VAULT}, {_INPUT_AUDIT} SELECT * FROM audit"
ORACLES["audit_readout"] = f"WITH {INPUT_VAULT}, {_INPUT_AUDIT} SELECT session_id, count(*) AS audit_rows, count(DISTINCT token) AS token_count FROM audit GROUP BY session_id"
ORACLES["tok_category"] = f"WITH {DOC_VAULT} SELECT category, type, count(*) AS n_tokens FROM vault GROUP BY ALL"
ORACLES["tok_restore"] = "SELECT source AS session_id, doc_id AS step_no, text FROM documents"
ORACLES["tok_resolve"] = f"""WITH {DOC_VAULT}
    SELECT session_id, token, session_id AS caller_session, value, 'resolved' AS status FROM vault
    UNION ALL SELECT session_id, token, 'src0', CASE WHEN session_id = 'src0' THEN value END, CASE WHEN session_id = 'src0' THEN 'resolved' ELSE 'rejected' END FROM vault
    UNION ALL SELECT session_id, token || 'x', session_id, NULL, 'not_found' FROM vault"""
ORACLES["structure_check"] = """SELECT count(*) AS n_raw, count(*) FILTER (doc_id % 7 <> 0) AS n_redacted, count(*) FILTER (doc_id % 7 = 0) AS n_unmatched,
    count(*) FILTER (doc_id % 7 = 0 OR doc_id % 5 = 1) AS n_changed FROM documents"""
ORACLES["vault_encryption"] = f"WITH {DOC_VAULT} SELECT session_id, token, value, false AS visible FROM vault"
ORACLES["vault_flags"] = """SELECT CAST(user_id AS STRING) AS session_id,
    bool_or(event_type = 'view') AND user_id % 4 <> 0 AS has_email, false AS has_password,
    bool_or(event_type = 'click' AND event_id % 90 <> 0) AND user_id % 4 <> 0 AS has_phone, false AS has_card, false AS has_aadhaar,
    bool_or(event_id % 90 = 0 AND event_type <> 'view') AND user_id % 4 <> 0 AS has_pan, user_id % 4 = 0 AS locked
    FROM events GROUP BY user_id"""
ORACLES["vault_fields"] = f"WITH {DOC_VAULT} SELECT DISTINCT session_id, lower(type) AS field, true AS available FROM vault"
ORACLES["vault_reset"] = f"WITH {DOC_VAULT} SELECT session_id, count(*) AS n_tokens FROM vault WHERE session_id <> 'src0' GROUP BY session_id"

# --- proof and statistics ------------------------------------------------------------------------------


def report(texts: str) -> str:
    return f"""leaks AS (SELECT t.session_id, t.step_no, v.token FROM {texts} t JOIN vault v ON v.session_id = t.session_id
        WHERE length(v.value) >= 3 AND contains(t.text, v.value)),
    report AS MATERIALIZED (SELECT t.session_id, t.step_no, count(l.token) AS leaked_count,
        coalesce(string_agg(l.token, ',' ORDER BY l.token), '') AS leaked_tokens, count(l.token) = 0 AS safe
        FROM {texts} t LEFT JOIN leaks l ON l.session_id = t.session_id AND l.step_no = t.step_no GROUP BY t.session_id, t.step_no)"""


ORACLES["egress_report"] = f"{WR}{DOC_REDACTED}, {report('redacted')} SELECT * FROM report"
_RAW = "raws AS (SELECT source AS session_id, doc_id AS step_no, text FROM documents)"
ORACLES["egress_raw"] = f"WITH {DOC_VAULT}, {_RAW}, {report('raws')} SELECT * FROM report"
ORACLES["egress_cross_session"] = f"""WITH {DOC_VAULT} SELECT d.source AS session_id, d.doc_id AS step_no, v.session_id AS owner_session, v.token
    FROM documents d JOIN vault v ON contains(d.text, v.value) WHERE length(v.value) >= 3"""
ORACLES["egress_split"] = f"""{WR}{DOC_REDACTED}, mixed AS MATERIALIZED (SELECT session_id, step_no, text FROM redacted WHERE step_no % 3 <> 0
    UNION ALL SELECT source, doc_id, text FROM documents WHERE doc_id % 3 = 0), {report('mixed')}
    SELECT session_id, CASE WHEN safe THEN 'released' ELSE 'blocked' END AS outcome, count(*) AS n_rows FROM report GROUP BY ALL"""
ORACLES["telemetry_leaks"] = f"""{WR}{DOC_REDACTED}, mixed AS MATERIALIZED (SELECT session_id, step_no, text FROM redacted WHERE step_no % 3 <> 0
    UNION ALL SELECT source, doc_id, text FROM documents WHERE doc_id % 3 = 0), {report('mixed')},
    proof AS (SELECT session_id, CAST(sum(leaked_count) AS BIGINT) AS leaked_count, bool_and(safe) AS zero_egress_verified FROM report GROUP BY session_id)
    SELECT p.session_id, count(v.token) FILTER (v.category = 'SPII') AS spii_count, count(v.token) FILTER (v.category = 'PII') AS pii_count,
    count(v.token) FILTER (v.category = 'CONTEXTUAL') AS contextual_count, count(v.token) AS total_masked, p.leaked_count, p.zero_egress_verified
    FROM proof p LEFT JOIN vault v USING (session_id) GROUP BY p.session_id, p.leaked_count, p.zero_egress_verified"""
_EXTRA = """extra AS (SELECT doc_id, source AS session_id, left(text, 4) AS value, CASE WHEN doc_id % 4 = 0 THEN 1.5 ELSE 0.9 END AS confidence FROM documents WHERE doc_id % 2 = 0 AND length(text) >= 4),
    hit AS (SELECT f.doc_id, min(f.start_pos) AS start_pos FROM found f JOIN extra x USING (doc_id) WHERE f.start_pos < 4 AND f.end_pos > 0 GROUP BY f.doc_id),
    spans AS (SELECT f.session_id, f.doc_id AS step_no, 0 AS element_pos, f.field, f.type, f.value, f.start_pos, f.confidence, f.method, f.start_pos AS prio
        FROM found f LEFT JOIN hit h ON h.doc_id = f.doc_id AND h.start_pos = f.start_pos LEFT JOIN extra x ON x.doc_id = f.doc_id WHERE h.doc_id IS NULL OR x.confidence <= f.confidence
      UNION ALL SELECT x.session_id, x.doc_id, 0, 'text', 'NAME', x.value, 0, x.confidence, 'NER', 0 FROM extra x LEFT JOIN hit h USING (doc_id)
        LEFT JOIN found f ON f.doc_id = h.doc_id AND f.start_pos = h.start_pos WHERE h.doc_id IS NULL OR x.confidence > f.confidence)"""
ORACLES["extra_spans"] = f"WITH {DOCS}, {_EXTRA}, {vault('spans', 'step_no')} SELECT session_id, token, type, value, token_no, first_step, method, CAST(confidence AS DOUBLE) AS confidence FROM vault"
ORACLES["telemetry"] = f"""WITH {DOC_VAULT} SELECT s.session_id, count(v.token) FILTER (v.category = 'SPII') AS spii_count,
    count(v.token) FILTER (v.category = 'PII') AS pii_count, count(v.token) FILTER (v.category = 'CONTEXTUAL') AS contextual_count,
    count(v.token) AS total_masked, CAST(0 AS BIGINT) AS leaked_count, true AS zero_egress_verified
    FROM (SELECT DISTINCT source AS session_id FROM documents) s LEFT JOIN vault v USING (session_id) GROUP BY s.session_id"""


def buckets() -> str:
    named = ", ".join(f"count(*) FILTER (type = {q(k)}) AS {b}" for k, b in K.BREAKDOWN_BUCKETS.items())
    return f"{named}, count(*) FILTER (NOT {in_('type', K.BREAKDOWN_BUCKETS)}) AS other"


ORACLES["pii_breakdown"] = f"WITH {DOCS} SELECT session_id, {buckets()} FROM found GROUP BY session_id"
ORACLES["input_breakdown"] = f"""WITH {INPUT_SPANS}, rows_ AS (SELECT session_id, type FROM spans WHERE value <> {q(K.HIDDEN_VALUE)}
    UNION ALL SELECT session_id, 'PASSWORD_FIELD' FROM ai WHERE {_PW}) SELECT session_id, {buckets()} FROM rows_ GROUP BY session_id"""
ORACLES["method_counts"] = f"""WITH {INPUT_SPANS} SELECT session_id, count(*) FILTER (method = 'REGEX') AS regex, CAST(0 AS BIGINT) AS ner,
    CAST(0 AS BIGINT) AS ocr_regex, CAST(0 AS BIGINT) AS ocr_ner, count(*) FILTER (method = 'DOM_ATTRIBUTE') AS dom_attribute FROM spans GROUP BY session_id"""
ORACLES["masked_counts"] = f"""{WR}{DOC_REDACTED}, new AS (SELECT session_id, first_step AS step_no, count(*) AS n FROM vault GROUP BY ALL)
    SELECT r.session_id, r.step_no, CAST(1 AS BIGINT) AS n_elements, CAST(len(r.tokens) > 0 AS BIGINT) AS fields_masked, coalesce(n.n, 0) AS new_tokens,
    CAST(sum(coalesce(n.n, 0)) OVER (PARTITION BY r.session_id ORDER BY r.step_no) AS BIGINT) AS session_tokens
    FROM redacted r LEFT JOIN new n USING (session_id, step_no)"""
_CALLS = "(SELECT CAST(user_id AS STRING) AS session_id, event_id AS call_no, event_id % 7 AS pii_tokens, event_id % 3 AS faces, CAST(floor(value) AS BIGINT) AS time_ms FROM events)"
ORACLES["session_stats"] = f"""SELECT session_id, count(*) AS total_calls, CAST(sum(pii_tokens) AS BIGINT) AS total_pii,
    CAST(sum(faces) AS BIGINT) AS total_faces, round(avg(time_ms), 6) AS avg_time_ms FROM {_CALLS} GROUP BY session_id"""
ORACLES["running_stats"] = f"""SELECT session_id, call_no, count(*) OVER w AS total_calls, CAST(sum(pii_tokens) OVER w AS BIGINT) AS total_pii,
    round(avg(time_ms) OVER w, 6) AS avg_time_ms FROM {_CALLS} WINDOW w AS (PARTITION BY session_id ORDER BY call_no)"""

# --- incremental and span algebra --------------------------------------------------------------------------

TURNS = f"""turns AS MATERIALIZED (SELECT CAST(conv_id AS STRING) AS session_id, {synth.TURN_STEP} AS step_no, role AS element_id,
    {synth.TURN_TEXT} AS text FROM conversations CROSS JOIN (VALUES (0), (1)) r(again))"""
_DIFF = f"""WITH {TURNS}, diffed AS (SELECT t.session_id, t.step_no, t.element_id, CASE WHEN p.session_id IS NULL THEN 'new'
    WHEN p.text IS NOT DISTINCT FROM t.text THEN 'unchanged' ELSE 'modified' END AS change
    FROM turns t LEFT JOIN turns p ON p.session_id = t.session_id AND p.element_id = t.element_id AND p.step_no = t.step_no - 1)"""
ORACLES["inc_diff"] = f"{_DIFF} SELECT * FROM diffed"
ORACLES["inc_stats"] = f"""{_DIFF} SELECT session_id, step_no, count(*) AS total, count(*) FILTER (change = 'unchanged') AS unchanged,
    count(*) FILTER (change <> 'unchanged') AS changed FROM diffed GROUP BY ALL"""
ORACLES["inc_spans"] = f"WITH {TURNS}, " + detect(
    f"SELECT session_id, step_no, element_id, 'text' AS field, {clean('text')} AS content, {NO_CONTEXT} FROM turns",
    ["session_id", "step_no", "element_id"]) + f" SELECT session_id, step_no, element_id, {SPAN_COLUMNS} FROM found"
ORACLES["span_lines"] = f"""WITH {DOCS}, {{LINES}} SELECT f.doc_id AS image_id, f.type, CAST(f.start_pos AS BIGINT) AS start_pos, l.line_no, l.line_start, l.line_end
    FROM found f JOIN placed l ON l.image_id = f.doc_id WHERE f.start_pos < l.line_end AND f.end_pos > l.line_start"""
LINES = """lines AS MATERIALIZED (SELECT doc_id AS image_id, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS text, CAST(10 AS BIGINT) AS x, CAST((i - 1) * 20 AS BIGINT) AS y,
    CAST(length(parts[i]) * 8 AS BIGINT) AS w, CAST(16 AS BIGINT) AS h
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
    placed AS MATERIALIZED (SELECT *, line_start + length(text) AS line_end FROM (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY image_id ORDER BY line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM lines))"""
ORACLES["span_lines"] = ORACLES["span_lines"].replace("{LINES}", LINES)

# --- session and memory tables -------------------------------------------------------------------------------

MEM = f"""log AS ({derived('events', synth.MEMORY_LOG)}),
    mem AS MATERIALIZED (SELECT key, value, category, source_session_id, ts, seq, epoch_us(ts) AS created_at, epoch_us(ts) AS updated_at
        FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM log) WHERE rn = 1)"""
_MEM_COLS = "key, value, category, source_session_id, created_at, updated_at"
ORACLES["mem_upsert"] = f"WITH {MEM} SELECT {_MEM_COLS} FROM mem"
ORACLES["mem_search"] = f"WITH {MEM} SELECT {_MEM_COLS} FROM mem WHERE key ILIKE '%1\\_view%' ESCAPE '\\'"
ORACLES["mem_delete"] = f"WITH {MEM} SELECT key, value FROM mem WHERE seq % 2 <> 0"
ORACLES["mem_clear"] = f"WITH {MEM} SELECT count(*) FILTER (category <> 'goals') AS remaining, count(*) FILTER (category = 'goals') AS deleted FROM mem"
ORACLES["mem_context"] = f"""WITH {MEM}
    SELECT source_session_id, CASE category WHEN 'preferences' THEN 'user_preferences' ELSE 'known_entities' END AS part, key, value, CAST(NULL AS BIGINT) AS rank
    FROM mem WHERE category IN ('preferences', 'entities')
    UNION ALL SELECT source_session_id, 'recent_goals', key, value, rk FROM (SELECT *, row_number() OVER (PARTITION BY source_session_id ORDER BY updated_at DESC, key DESC) AS rk
        FROM mem WHERE category = 'goals') WHERE rk <= 5"""
ORACLES["top_history"] = f"WITH {MEM} SELECT key, value, updated_at FROM mem WHERE category = 'history' ORDER BY updated_at DESC, key DESC LIMIT 50"
ORACLES["top_goals"] = f"""WITH {MEM} SELECT source_session_id, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_session_id ORDER BY updated_at DESC, key DESC) AS rank
    FROM mem WHERE category = 'goals') WHERE rank <= 5"""
SESS = f"""log AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS n FROM ({derived('events', synth.SESSION_LOG)})),
    born AS (SELECT session_id, max(n) FILTER (op = 'create') AS c, coalesce(max(n) FILTER (op = 'delete'), 0) AS d FROM log GROUP BY session_id),
    sess AS MATERIALIZED (SELECT session_id, arg_max(goal, n) FILTER (goal IS NOT NULL) AS goal, arg_max(plan_id, n) FILTER (plan_id IS NOT NULL) AS plan_id,
        epoch_us(min(ts) FILTER (op = 'create')) AS created_at, epoch_us(max(ts)) AS updated_at, bool_or(op = 'archive') AS archived
        FROM log JOIN born USING (session_id) WHERE c IS NOT NULL AND d < c AND n >= c GROUP BY session_id)"""
ORACLES["session_table"] = f"WITH {SESS} SELECT * FROM sess"
ORACLES["session_partial_update"] = f"""WITH {SESS} SELECT session_id, arg_max(goal, n) FILTER (goal IS NOT NULL) AS goal,
    arg_max(plan_id, n) FILTER (plan_id IS NOT NULL) AS plan_id, epoch_us(max(ts)) AS updated_at FROM log GROUP BY session_id"""
ORACLES["session_list"] = f"WITH {SESS} SELECT session_id, goal, created_at, updated_at, archived FROM sess WHERE NOT archived"
ORACLES["session_restore"] = f"""WITH {SESS} SELECT u.session_id, s.plan_id, s.session_id IS NOT NULL AS restored
    FROM (SELECT DISTINCT CAST(user_id AS STRING) AS session_id FROM events) u LEFT JOIN (SELECT * FROM sess WHERE NOT archived) s USING (session_id)"""
ORACLES["session_files"] = f"""WITH {SESS} SELECT session_id, goal, plan_id, concat('1,', length(session_id)) AS step_ids, CAST(0 AS BIGINT) AS n_completed,
    session_id AS lang, archived FROM sess"""
ORACLES["memory_files"] = f"WITH {MEM} SELECT key, value, source_session_id AS session_id FROM mem WHERE source_session_id = '7'"

# --- messages --------------------------------------------------------------------------------------------------

MSG = f"""raw AS ({derived('events', synth.MESSAGES)}),
    msg AS MATERIALIZED (SELECT *, CASE WHEN NOT ok THEN 'INVALID_JSON' WHEN NOT ({in_("coalesce(j->>'$.type', '')", K.MESSAGE_TYPES)}
        AND coalesce(json_type(j, '$.session_id'), '') = 'VARCHAR' AND length(j->>'$.session_id') > 0
        AND coalesce(json_type(j, '$.payload'), 'OBJECT') = 'OBJECT') THEN 'INVALID_ENVELOPE' END AS code
        FROM (SELECT event_id, json_valid(value) AND coalesce(json_type(CASE WHEN json_valid(value) THEN value END), '') = 'OBJECT' AS ok,
            CAST(CASE WHEN json_valid(value) THEN value END AS JSON) AS j FROM raw))"""
ORACLES["msg_validate"] = f"WITH {MSG} SELECT event_id, code FROM msg"
ORACLES["msg_parse"] = f"""WITH {MSG} SELECT event_id, j->>'$.type' AS type, j->>'$.session_id' AS session_id, CAST(j->>'$.client_timestamp' AS DOUBLE) AS client_timestamp,
    coalesce(CAST(j->'$.payload' AS VARCHAR), '{{}}') AS payload FROM msg WHERE code IS NULL"""
ORACLES["msg_dead_letters"] = f"WITH {MSG} SELECT code, count(*) AS n_messages FROM msg WHERE code IS NOT NULL GROUP BY code"
_ROUTES = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.MESSAGE_ROUTES.items())
ORACLES["msg_route"] = f"WITH {MSG} SELECT event_id, j->>'$.session_id' AS session_id, CASE j->>'$.type' {_ROUTES} ELSE 'unknown_type' END AS route FROM msg WHERE code IS NULL"
ORACLES["goal_asof"] = f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS n FROM ({derived('events', synth.GOALS)})),
    w AS (SELECT *, max(CASE WHEN goal IS NOT NULL THEN n END) OVER (PARTITION BY session_id ORDER BY n) AS goal_n,
        max(CASE WHEN triggers_plan THEN n END) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trig_n FROM g)
    SELECT w.session_id, w.seq, CASE WHEN coalesce(w.trig_n, 0) < w.goal_n THEN s.goal END AS goal
    FROM w LEFT JOIN g s ON s.session_id = w.session_id AND s.n = w.goal_n WHERE w.triggers_plan"""

_MOVES = ", ".join(q(f"{a}>{b}") for a, bs in K.STEP_TRANSITIONS.items() for b in bs)
_STOPPED = "CASE WHEN {s} IN ('PENDING', 'RETRYING') THEN 'CANCELLED' ELSE {s} END"
STEPS = f"""ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS g FROM ({derived('events', synth.STEP_EVENTS)})),
    sv AS MATERIALIZED (SELECT *, max(CASE WHEN op = 'stop' THEN g END) OVER (PARTITION BY session_id ORDER BY g) AS stop_g FROM ev),
    own AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, step_id ORDER BY g) AS n FROM sv WHERE op NOT IN ('stop', 'pause', 'resume')),
    fold AS (SELECT DISTINCT session_id, step_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS g, 'PENDING' AS state, 0 AS attempts, 0 AS rejected, false AS fb, false AS granted FROM own
      UNION ALL SELECT session_id, step_id, n, g, CASE WHEN ok THEN target ELSE now_ END, attempts + CASE WHEN ok AND target = 'RUNNING' THEN 1 ELSE 0 END,
        rejected + CASE WHEN ok THEN 0 ELSE 1 END, fb OR op = 'fallback' OR (ok AND target = 'HYBRID_FALLBACK'),
        CASE WHEN op = 'deny' OR (ok AND target = 'BLOCKED_APPROVAL') THEN false WHEN op = 'approve' AND ok THEN true ELSE granted END
      FROM (SELECT *, concat(now_, '>', target) IN ({_MOVES}) AS ok FROM (SELECT *, CASE op WHEN 'run' THEN 'RUNNING' WHEN 'success' THEN 'SUCCESS' WHEN 'fail' THEN 'FAILED'
          WHEN 'block' THEN 'BLOCKED_APPROVAL' WHEN 'retry' THEN CASE WHEN attempts >= {K.MAX_RETRIES} THEN 'HYBRID_FALLBACK' ELSE 'RETRYING' END
          WHEN 'fallback' THEN 'HYBRID_FALLBACK' WHEN 'deny' THEN 'CANCELLED' WHEN 'skip' THEN 'SKIPPED'
          WHEN 'approve' THEN CASE WHEN now_ = 'BLOCKED_APPROVAL' THEN 'RUNNING' ELSE 'NONE' END END AS target
        FROM (SELECT f.session_id, f.step_id, o.n, o.g, o.op, f.attempts, f.rejected, f.fb, f.granted,
            CASE WHEN o.stop_g > f.g THEN {_STOPPED.format(s='f.state')} ELSE f.state END AS now_
          FROM fold f JOIN own o ON o.session_id = f.session_id AND o.step_id = f.step_id AND o.n = f.n + 1)))),
    lastf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, step_id ORDER BY n DESC) AS rn FROM fold) WHERE rn = 1),
    errs AS (SELECT session_id, step_id, arg_max(error, g) AS error, arg_max(error_code, g) AS code FROM own WHERE op = 'fail' GROUP BY ALL),
    stops AS (SELECT session_id, max(g) AS sg FROM ev WHERE op = 'stop' GROUP BY session_id),
    done AS MATERIALIZED (SELECT l.session_id, CAST(l.step_id AS BIGINT) AS step_id, CASE WHEN s.sg > l.g THEN {_STOPPED.format(s='l.state')} ELSE l.state END AS state,
        CAST(l.attempts AS BIGINT) AS attempts, CAST(l.rejected AS BIGINT) AS rejected, l.fb AS fallback_used, l.granted AS approved, e.error AS last_error, e.code AS last_error_code
        FROM lastf l LEFT JOIN errs e USING (session_id, step_id) LEFT JOIN stops s USING (session_id))"""
ORACLES["step_fold"] = f"{WR}{STEPS} SELECT * FROM done"
ORACLES["step_state_counts"] = f"{WR}{STEPS} SELECT session_id, state, count(*) AS n_steps FROM done GROUP BY ALL"
_CONTROLS = """ctl AS (SELECT session_id, coalesce(arg_max(op, g) FILTER (op IN ('pause', 'resume', 'stop')) = 'pause', false) AS paused, bool_or(op = 'stop') AS stopped FROM ev GROUP BY session_id)"""
ORACLES["step_controls"] = f"{WR}{STEPS}, {_CONTROLS} SELECT * FROM ctl"
_TERMINAL = in_("state", K.TERMINAL_STATES)
ORACLES["plan_flags"] = f"""{WR}{STEPS} SELECT p.session_id, count(d.step_id) AS total_steps, coalesce(bool_and({_TERMINAL}) FILTER (state IS NOT NULL), true) AS is_complete,
    coalesce(bool_and(state IN ('FAILED', 'HYBRID_FALLBACK') AND attempts >= {K.MAX_RETRIES}) FILTER (NOT {_TERMINAL}), false) AS is_failed,
    coalesce(bool_or(state = 'BLOCKED_APPROVAL'), false) AS is_blocked
    FROM (SELECT DISTINCT session_id FROM ev) p LEFT JOIN done d USING (session_id) GROUP BY p.session_id"""
ORACLES["step_lists"] = f"""{WR}{STEPS} SELECT session_id, step_id, CASE state WHEN 'FAILED' THEN 'failed' WHEN 'BLOCKED_APPROVAL' THEN 'blocked' ELSE 'completed' END AS list
    FROM done WHERE state IN ('SUCCESS', 'SKIPPED', 'FAILED', 'BLOCKED_APPROVAL')"""
ORACLES["next_step"] = f"""{WR}{STEPS}, {_CONTROLS} SELECT p.session_id, CAST(min(p.step_id) AS BIGINT) AS next_step_id
    FROM (SELECT session_id, unnest(range(1, 9)) AS step_id FROM (SELECT DISTINCT session_id FROM ev)) p LEFT JOIN done d ON d.session_id = p.session_id AND d.step_id = p.step_id
    JOIN ctl c ON c.session_id = p.session_id WHERE coalesce(d.state, 'PENDING') = 'PENDING' AND NOT c.paused AND NOT c.stopped GROUP BY p.session_id"""
_RETRY = f"CASE WHEN attempts < {K.MAX_RETRIES} THEN 'RETRYING' ELSE 'HYBRID_FALLBACK' END"
ORACLES["step_results"] = f"""{WR}{STEPS} SELECT r.session_id, CAST(r.step_id AS BIGINT) AS step_id, r.seq,
    CASE WHEN r.op = 'success' THEN 'SUCCESS' WHEN r.error_code = 'SELECTOR_NOT_FOUND' THEN 'HYBRID_FALLBACK' WHEN r.error_code = 'AUTH_REQUIRED' THEN 'BLOCKED_APPROVAL' ELSE {_RETRY} END AS next_state,
    CASE WHEN r.op = 'success' THEN 'DISPATCH_NEXT' WHEN r.error_code = 'SELECTOR_NOT_FOUND' AND r.seq % 2 = 0 THEN 'NEXT_STEP_HYBRID' WHEN r.error_code = 'PAGE_TIMEOUT' THEN 'NEXT_STEP_WAIT'
        WHEN r.error_code = 'AUTH_REQUIRED' THEN 'APPROVAL_REQUIRED_AUTH' ELSE 'DISPATCH_NEXT' END AS response
    FROM own r JOIN done d ON d.session_id = r.session_id AND d.step_id = r.step_id WHERE r.op IN ('success', 'fail')"""

# --- risk and plans ------------------------------------------------------------------------------------------------

_DESC = "lower(description)"
_LEVEL = (f"CASE WHEN {in_('action', K.CRITICAL_ACTIONS)} OR {any_of(_DESC, K.CRITICAL_WORDS)} THEN 'CRITICAL' "
          f"WHEN {any_of(_DESC, K.CAUTION_WORDS)} AND NOT {any_of(_DESC, K.SAFE_WORDS)} THEN 'CAUTION' ELSE 'SAFE' END")
_NAMED = " ".join(f"WHEN level = 'CRITICAL' AND contains({_DESC}, {q(w)}) THEN {q(f'Action involves {w} — sensitive operation')}" for w in K.REASON_WORDS)
PLANS = f"steps_ AS MATERIALIZED (SELECT *, {_LEVEL} AS level FROM ({derived('part', synth.PLAN_STEPS)}))"
ORACLES["risk_levels"] = f"""WITH {PLANS} SELECT session_id, CAST(step_id AS BIGINT) AS step_id, level, CASE action WHEN 'TYPE_FROM_VAULT' THEN {q(K.REASONS['vault'])}
    WHEN 'CAPTCHA_HANDOFF' THEN {q(K.REASONS['captcha'])} ELSE CASE {_NAMED} WHEN level = 'CRITICAL' THEN {q(K.REASONS['critical'])}
    WHEN level = 'CAUTION' THEN {q(K.REASONS['caution'])} ELSE {q(K.REASONS['safe'])} END END AS reason FROM steps_"""
ORACLES["critical_steps"] = f"WITH {PLANS} SELECT session_id, bool_or(level = 'CRITICAL') AS has_critical, count(*) FILTER (level = 'CRITICAL') AS n_critical FROM steps_ GROUP BY session_id"
ORACLES["plan_validate"] = f"""WITH {PLANS} SELECT session_id, CAST(step_id AS BIGINT) AS step_id, CASE WHEN total_steps < 1 THEN 'total_steps below 1' WHEN step_id < 1 THEN 'step id below 1'
    WHEN NOT {in_('action', K.ACTIONS)} THEN 'unknown action' END AS reason FROM steps_"""
ORACLES["plan_start"] = f"""WITH {PLANS} SELECT session_id, CASE WHEN count(*) FILTER (level = 'CRITICAL') > 0 THEN 'APPROVAL_REQUIRED' ELSE 'NEXT_STEP' END AS message,
    CAST(coalesce(min(step_id) FILTER (level = 'CRITICAL'), min(step_id)) AS BIGINT) AS step_id, count(*) FILTER (level = 'CRITICAL') AS blocked_steps FROM steps_ GROUP BY session_id"""
_XY = "concat(CAST(k % 100 AS STRING), '.0,', CAST(k % 50 AS STRING), '.0')"
_NORM = f"""norm AS MATERIALIZED (SELECT k, k % 9 + 1 AS step_id,
    CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN concat('#f', k) END WHEN k % 3 = 0 THEN concat('#b', k) END AS selector,
    CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 2 THEN {_XY} END WHEN k % 3 = 1 THEN {_XY} END AS coordinates,
    CASE WHEN k % 2 = 1 AND k % 5 = 0 THEN concat('item ', k) END AS text FROM (SELECT o_orderkey AS k FROM orders))"""
_MODE = "CASE WHEN selector IS NULL AND coordinates IS NOT NULL THEN 'VISION' ELSE 'DOM' END"
_LVL = "CASE WHEN k % 2 = 0 THEN 'CAUTION' ELSE 'SAFE' END"
ORACLES["step_normalize"] = f"""WITH {_NORM} SELECT k AS o_orderkey, step_id, selector, coordinates, text, {_MODE} AS execution_mode, {_LVL} AS protocol_level,
    concat('item ', k) AS description FROM norm"""
ORACLES["step_wire"] = f"""WITH {_NORM} SELECT k AS o_orderkey, concat('{{"id":', step_id, ',"action":"CLICK"',
    CASE WHEN selector IS NOT NULL OR coordinates IS NOT NULL OR text IS NOT NULL THEN concat(',"target":{{', array_to_string(list_filter([
        '"selector":"' || selector || '"', '"coordinates":[' || coordinates || ']', '"text":"' || text || '"'], lambda x: x IS NOT NULL), ','), '}}') ELSE '' END,
    ',"execution_mode":"', {_MODE}, '","protocol_level":"', {_LVL}, '","description":"item ', k, '","timeout_ms":5000}}') AS wire FROM norm"""
ORACLES["backoff"] = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(least(300 * power(2, l_linenumber - 1), 2000) AS BIGINT) AS backoff_ms FROM lineitem"
ORACLES["retry_schedule"] = """WITH w AS (SELECT attempt, wait, CAST(sum(wait) OVER (ORDER BY attempt) AS BIGINT) AS elapsed FROM
    (SELECT i AS attempt, CAST(least(300 * power(2, i - 1), 2000) AS BIGINT) AS wait FROM range(1, 20) t(i)))
    SELECT o_orderkey, o_orderkey % 12000 AS timeout_ms, w.attempt, w.wait AS backoff_ms, w.elapsed AS elapsed_ms FROM orders JOIN w ON w.elapsed < o_orderkey % 12000"""
ORACLES["debounce"] = """WITH e AS (SELECT *, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 21600000000 THEN 1 ELSE 0 END AS opens FROM
    (SELECT CAST(user_id AS STRING) AS session_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)),
    b AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS burst FROM e),
    s AS (SELECT *, min(ts) OVER (PARTITION BY session_id, burst) AS t0 FROM b)
    SELECT session_id, CAST(burst AS BIGINT) AS burst, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 86400000000.0) AS BIGINT) AS piece, epoch_us(min(ts)) AS started_at,
    epoch_us(max(ts)) AS last_event_at, count(*) AS n_events FROM s GROUP BY session_id, burst, piece"""

# --- pages ------------------------------------------------------------------------------------------------------------

_LINK = q('(?i)<a\\s+[^>]*?href="([^"]*)"')
LINKS = f"""links AS MATERIALIZED (SELECT page_id, url, i, hs[i] AS href FROM (SELECT page_id, url, hs, unnest(range(1, len(hs) + 1)) AS i FROM
    (SELECT page_id, url, regexp_extract_all(html, {_LINK}, 1) AS hs FROM pages)))"""
ORACLES["html_links"] = f"WITH {LINKS} SELECT page_id, CAST(i - 1 AS BIGINT) AS link_no, href FROM links"
ORACLES["html_link_elements"] = f"WITH {LINKS} SELECT page_id, concat('e_', i) AS id, 'link' AS role, href, 'li' AS parent_tag FROM links"
ORACLES["page_snapshots"] = f"""WITH {LINKS} SELECT p.page_id, p.url, count(l.i) AS elements_count, count(l.i) > 0 AS context_sufficient
    FROM pages p LEFT JOIN links l USING (page_id) GROUP BY p.page_id, p.url"""
ORACLES["html_forms"] = """SELECT c_custkey AS page_id, CAST(0 AS BIGINT) AS form_pos, 'form-0' AS id, concat('/save/', c_custkey % 3) AS action,
    CASE WHEN c_custkey % 2 = 0 THEN 'post' ELSE 'get' END AS method, 'name,phone,seg,csrf,note' AS inputs, CAST(NULL AS STRING) AS error FROM customer"""
_TEXT_LINK = q('(?i)<a\\s+[^>]*?href="[^"]*"[^>]*>(.*?)</a>')


def _unescaped(expr: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        expr = f"replace({expr}, '{name}', '{char}')"
    return expr


ORACLES["html_elements"] = f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS element_pos, concat('e_', i) AS id, 'A' AS tag, 'body > nav > ul > li > a' AS selector, 'link' AS role,
    CAST(NULL AS STRING) AS type, CAST(NULL AS STRING) AS placeholder, nullif({_unescaped('hs[i]')}, '') AS href, CAST(NULL AS STRING) AS autocomplete,
    nullif(trim({_unescaped('ts[i]')}), '') AS text, CAST(NULL AS STRING) AS value, 'li' AS parent_tag, CAST(NULL AS STRING) AS parent_class, CAST(NULL AS STRING) AS parent_id,
    CAST(NULL AS STRING) AS nearby_labels, true AS interactive, CAST(NULL AS STRING) AS error
    FROM (SELECT page_id, hs, ts, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, {_LINK}, 1) AS hs, regexp_extract_all(html, {_TEXT_LINK}, 1) AS ts FROM pages))"""
ORACLES["form_elements"] = """SELECT c.c_custkey AS page_id, e.* REPLACE (CASE e.id WHEN 'e_1' THEN c.c_name WHEN 'e_3' THEN c.c_mktsegment WHEN 'e_5' THEN concat('n', c.c_custkey) END AS value,
      CASE e.id WHEN 'e_3' THEN concat('A', c.c_mktsegment) ELSE e.text END AS text)
    FROM customer c, (VALUES
    (CAST(0 AS BIGINT), 'e_1', 'INPUT', '#n', 'textbox', NULL, NULL, CAST(NULL AS STRING), CAST(NULL AS STRING), NULL, 'v', 'form', CAST(NULL AS STRING), CAST(NULL AS STRING), 'Full name'),
    (1, 'e_2', 'INPUT', 'div > form > label > input', 'textbox', NULL, '98xxx', NULL, NULL, NULL, NULL, 'label', NULL, NULL, 'Phone'),
    (2, 'e_3', 'SELECT', 'div > form > p > select', 'listbox', NULL, NULL, NULL, NULL, NULL, 'v', 'p', NULL, NULL, NULL),
    (3, 'e_search_4', 'INPUT', 'div > form > p > input.q', 'searchbox', 'search', NULL, NULL, NULL, NULL, NULL, 'p', NULL, NULL, NULL),
    (4, 'e_5', 'TEXTAREA', 'div > form > p > textarea', 'textbox', NULL, NULL, NULL, NULL, NULL, 'v', 'p', NULL, NULL, NULL),
    (5, 'e_6', 'BUTTON', 'div > form > p > button', 'button', NULL, NULL, NULL, NULL, 'Save', NULL, 'p', NULL, NULL, NULL))
    e(element_pos, id, tag, selector, role, type, placeholder, href, autocomplete, text, value, parent_tag, parent_class, parent_id, nearby_labels)"""
ORACLES["role_infer"] = f"""WITH e AS (SELECT *, CASE element_pos % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'select' WHEN 2 THEN 'div' ELSE 'input' END AS t, coalesce(type, 'text') AS k
    FROM ({derived('orders', synth.INPUTS)}))
    SELECT element_id, CASE WHEN element_pos % 7 = 0 AND coalesce(role, '') <> '' THEN role WHEN t = 'a' THEN 'link' WHEN t = 'select' THEN 'listbox' WHEN t = 'div' THEN 'generic'
    WHEN k = 'search' THEN 'searchbox' ELSE 'textbox' END AS role,
    CASE WHEN type = 'search' THEN concat('e_search_', element_pos + 1) ELSE concat('e_', element_pos + 1) END AS assigned_id FROM e"""
_BLOB = "lower(concat(' ', url, ' ', html))"
_SCREENS = " ".join(f"WHEN {any_of(_BLOB, ws)} THEN {q(n)}" for n, ws in K.SCREEN_WORDS.items())
ORACLES["screen_types"] = f"SELECT page_id, CASE {_SCREENS} ELSE {q(K.DEFAULT_SCREEN)} END AS screen_type FROM pages"
_LINES = """txt AS MATERIALIZED (SELECT p.page_id, p.url, count(l.i) AS n, coalesce(string_agg(concat('[e_', l.i, '] <A> role=link', CASE WHEN l.href <> '' THEN concat(' text="', left(l.href, 40), '"') ELSE '' END), chr(10) ORDER BY l.i), 'No interactive elements found.') AS lines
    FROM pages p LEFT JOIN links l USING (page_id) GROUP BY p.page_id, p.url)"""
_LINES = _LINES.replace("coalesce(string_agg(", "coalesce(string_agg(CASE WHEN l.i IS NOT NULL THEN ").replace(", chr(10) ORDER BY", " END, chr(10) ORDER BY")
ORACLES["prompt_lines"] = f"WITH {LINKS}, {_LINES} SELECT page_id, lines, n > 0 AS sufficient FROM txt"
ORACLES["goal_context"] = f"""WITH {LINKS}, {_LINES} SELECT page_id, concat('USER GOAL: open page ', page_id, chr(10), chr(10), 'CURRENT URL: ', url, chr(10), chr(10), 'DOM SNAPSHOT (', n,
    ' interactive elements):', chr(10), lines, chr(10), chr(10), 'VAULT MANIFEST: ', CASE WHEN page_id % 2 = 0 THEN 'email=True, card=False' ELSE 'none' END,
    CASE WHEN page_id % 3 = 0 THEN concat(chr(10), chr(10), 'PREVIOUS STEPS: [{{"id": 1}}]') ELSE '' END) AS context FROM txt"""

# --- targets ----------------------------------------------------------------------------------------------------------------

BOXED = """boxed AS MATERIALIZED (SELECT l_orderkey AS k, pos - 1 AS pos, concat('e_', pos) AS element_id, concat('#line', l_linenumber) AS selector, concat(' part ', l_partkey, ' ') AS text,
    CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS value, (pos - 1) * 10.0 AS y
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos FROM lineitem))"""
ORACLES["resolve_target"] = f"""WITH {BOXED}, aims AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN concat('#line', o_orderkey % 8) END AS sel,
    CASE WHEN o_orderkey % 3 <> 2 THEN 'part 1' ELSE '' END AS txt, CASE WHEN o_orderkey % 2 = 0 THEN 50.0 END AS tx, o_orderkey % 60 AS ty FROM orders),
    hits AS (SELECT a.k, b.element_id, b.value, b.text, b.pos, CASE WHEN a.sel = b.selector THEN 1 WHEN a.txt <> '' AND contains(trim(b.text), a.txt) THEN 2
        WHEN a.tx BETWEEN 0 AND 100 AND a.ty BETWEEN b.y AND b.y + 15 THEN 3 END AS rule FROM aims a JOIN boxed b USING (k)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rule, CASE WHEN rule = 3 THEN -pos ELSE pos END) AS rn FROM hits WHERE rule IS NOT NULL) WHERE rn = 1)
    SELECT CAST(a.k AS STRING) AS session_id, b.element_id, CAST(b.rule AS BIGINT) AS matched_by, coalesce(b.value, trim(coalesce(b.text, ''))) AS data FROM aims a LEFT JOIN best b USING (k)"""
ORACLES["verify_condition"] = f"""WITH {BOXED} SELECT CAST(o_orderkey AS STRING) AS session_id, o_orderkey % 5 <> 4 AS checked, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 2 = 0
    WHEN 1 THEN EXISTS (SELECT 1 FROM boxed b WHERE b.k = o_orderkey AND b.selector = concat('#line', o_orderkey % 8))
    WHEN 2 THEN EXISTS (SELECT 1 FROM boxed b WHERE b.k = o_orderkey AND contains(b.text, concat('part ', o_orderkey % 10))) END AS passed FROM orders"""

# --- named entities ------------------------------------------------------------------------------------------------------------

TOKENS = f"""words AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, parts[i] AS raw_word FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM
        (SELECT doc_id, string_split_regex(text, '[ \\n]+') AS parts FROM documents))),
    toks AS MATERIALIZED (SELECT doc_id, pos, {synth.NER_WORD} AS word, {synth.NER_LABEL} AS entity, {synth.NER_SCORE} AS score, pos * 10 AS s, pos * 10 + length(raw_word) AS e,
        pos // {synth.NER_WORDS_PER_GROUP * 10} AS chunk_no FROM words),
    kinds AS (SELECT *, regexp_replace(entity, '^[BI]-', '') AS kind, starts_with(word, '##') AS sub, row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY pos) AS n FROM toks),
    seen AS (SELECT *, max(CASE WHEN NOT sub THEN n END) OVER (PARTITION BY doc_id, chunk_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ln FROM kinds),
    cont AS (SELECT a.*, a.n > 1 AND (a.sub OR (starts_with(a.entity, 'I-') AND a.kind = coalesce(b.kind, c.kind))) AS joins FROM seen a
        LEFT JOIN kinds b ON b.doc_id = a.doc_id AND b.chunk_no = a.chunk_no AND b.n = a.ln
        LEFT JOIN kinds c ON c.doc_id = a.doc_id AND c.chunk_no = a.chunk_no AND c.n = 1),
    runs AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, chunk_no ORDER BY n) AS entity_no FROM cont),
    ents AS MATERIALIZED (SELECT doc_id, chunk_no, CAST(entity_no AS BIGINT) AS entity_no,
        string_agg(CASE WHEN NOT joins THEN word WHEN sub THEN substr(word, 3) ELSE concat(' ', word) END, '' ORDER BY n) AS word, arg_min(kind, n) AS entity, min(score) AS score,
        CAST(min(s) AS BIGINT) AS start_pos, CAST(arg_max(e, n) AS BIGINT) AS end_pos, count(*) AS n_tokens FROM runs GROUP BY doc_id, chunk_no, entity_no)"""
ORACLES["ner_merge"] = f"WITH {TOKENS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, entity_no, word, entity, score, start_pos, end_pos, n_tokens FROM ents"
ORACLES["ner_context"] = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'card,div,profile' WHEN 1 THEN 'div,main,nav' WHEN 2 THEN 'company,div,info' ELSE 'div' END AS words FROM documents"""


def _near(words: list[str]) -> str:
    return f"list_has_any(ctx, [{', '.join(q(w) for w in words)}])"


_N = "lower(trim(word))"
_KEEP = f"""length({_N}) >= 2 AND CASE entity
    WHEN 'PER' THEN NOT {in_(_N, K.NER_BRANDS)} AND NOT {in_(_N, K.NER_STOP_NAMES)} AND score >= 0.75 AND ({_near(K.NER_PERSON_CONTEXT)} OR score >= 0.9)
    WHEN 'LOC' THEN (NOT {in_(_N, K.NER_GENERIC_PLACES)} OR {_near(K.NER_ADDRESS_CONTEXT)}) AND NOT {_near(K.NER_PUBLIC_PLACE_CONTEXT)} AND score >= 0.8
    WHEN 'ORG' THEN {_near(K.NER_EMPLOYER_CONTEXT)} AND score >= 0.9 AND NOT {in_(_N, K.NER_BRANDS)} ELSE false END"""
_TYPE = "CASE entity WHEN 'PER' THEN 'NAME' WHEN 'LOC' THEN 'ADDRESS' WHEN 'ORG' THEN 'ORGANIZATION' END"
ORACLES["ner_filter"] = f"""WITH {TOKENS}, near AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN ['profile', 'card', 'div'] WHEN 1 THEN ['main', 'nav', 'div'] WHEN 2 THEN ['company', 'info', 'div'] ELSE ['div'] END AS ctx FROM ents)
    SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, entity_no, {_TYPE} AS type, word AS value, CAST(start_pos + chunk_no * 3 AS BIGINT) AS start_pos, CAST(end_pos + chunk_no * 3 AS BIGINT) AS end_pos,
    round(score, 4) AS confidence, 'NER' AS method, entity AS ner_label FROM near WHERE {_KEEP}"""
_CHUNK_WORDS = q(f"[{SPACE}]+")
ORACLES["ner_chunks"] = f"""WITH f AS (SELECT doc_id, text, string_split(regexp_replace(text, {_CHUNK_WORDS}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE length(text) > 0),
    w AS MATERIALIZED (SELECT doc_id, text, parts, (len(parts) + 1) // 2 AS n FROM f),
    g AS (SELECT *, unnest(CASE WHEN n <= {K.NER_CHUNK_WORDS} THEN [0] ELSE range(0, n, {K.NER_CHUNK_STRIDE}) END) AS s FROM w),
    o AS (SELECT doc_id, s // {K.NER_CHUNK_STRIDE} AS chunk_no, CAST(coalesce(list_sum(list_transform(parts[1:2 * s], lambda x: length(x))), 0) AS BIGINT) AS start_offset,
        CASE WHEN n <= {K.NER_CHUNK_WORDS} THEN text ELSE array_to_string(list_transform(range(s, least(s + {K.NER_CHUNK_WORDS}, n)), lambda j: parts[2 * j + 1]), ' ') END AS chunk_text FROM g)
    SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, start_offset, start_offset + length(chunk_text) AS end_offset, chunk_text FROM o"""

# The line of spans is cut where a span is kept whatever came before it; each stretch is folded span by span.
ORACLES["ner_dedupe"] = f"""{WR}{TOKENS}, typed AS (SELECT doc_id, {_TYPE} AS type, word AS value, start_pos, end_pos, round(score, 4) AS confidence FROM ents WHERE entity IN ('PER', 'LOC', 'ORG')),
    twice AS (SELECT * FROM typed UNION ALL SELECT doc_id, type, value, start_pos + 1, end_pos + 3, CASE WHEN start_pos % 3 = 0 THEN 0.99 ELSE 0.5 END FROM typed),
    placed AS (SELECT *, lag(type) OVER w AS kind, max(end_pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM twice
        WINDOW w AS (PARTITION BY doc_id ORDER BY start_pos, end_pos, type, value, confidence)),
    cut AS (SELECT *, sum(CASE WHEN kind = type AND end_pos <= reach + 5 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, type, value, confidence ROWS UNBOUNDED PRECEDING) AS stretch FROM placed),
    line AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, stretch ORDER BY start_pos, end_pos, type, value, confidence) AS i FROM cut),
    fold AS (SELECT doc_id, stretch, i, 1 AS kept, start_pos, end_pos, type, value, confidence FROM line WHERE i = 1
      UNION ALL SELECT l.doc_id, l.stretch, l.i, f.kept + CASE WHEN goes THEN 0 ELSE 1 END, CASE WHEN stays THEN f.start_pos ELSE l.start_pos END, CASE WHEN stays THEN f.end_pos ELSE l.end_pos END,
        l.type, CASE WHEN stays THEN f.value ELSE l.value END, CASE WHEN stays THEN f.confidence ELSE l.confidence END
      FROM fold f JOIN line l ON l.doc_id = f.doc_id AND l.stretch = f.stretch AND l.i = f.i + 1,
        LATERAL (SELECT l.start_pos >= f.start_pos AND l.end_pos <= f.end_pos + 5 AND l.type = f.type AS goes) g, LATERAL (SELECT goes AND l.confidence <= f.confidence AS stays) s)
    SELECT doc_id, arg_max(start_pos, i) AS start_pos, arg_max(end_pos, i) AS end_pos, arg_max(type, i) AS type, arg_max(value, i) AS value, CAST(arg_max(confidence, i) AS DOUBLE) AS confidence
    FROM fold GROUP BY doc_id, stretch, kept"""
_SPAN = "{'field': field, 'type': type, 'value': value, 's': start_pos, 'e': end_pos, 'c': confidence, 'm': method}"
ORACLES["spans_merge"] = f"""{WR}{DOCS}, base AS (SELECT doc_id, field, type, value, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos, confidence, method FROM found),
    other AS (SELECT doc_id, field, 'NAME' AS type, value, CASE WHEN start_pos % 2 = 0 THEN start_pos - 3 ELSE end_pos + 5 END AS start_pos, CASE WHEN start_pos % 2 = 0 THEN start_pos + 1 ELSE end_pos + 9 END AS end_pos,
        CASE WHEN start_pos % 4 = 0 THEN 1.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence, 'NER' AS method FROM base),
    lists AS MATERIALIZED (SELECT doc_id, list({_SPAN} ORDER BY start_pos, end_pos, type) AS kept FROM base GROUP BY doc_id),
    others AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, type, value) AS i, {_SPAN} AS x FROM other),
    fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, kept FROM lists
      UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN coalesce(p, 0) = 0 THEN list_append(f.kept, o.x) WHEN o.x.c > f.kept[p].c THEN list_concat(list_append(f.kept[:p - 1], o.x), f.kept[p + 1:]) ELSE f.kept END
      FROM (SELECT f.doc_id, f.i, f.kept, list_position(list_transform(f.kept, lambda k: o.x.s < k.e AND o.x.e > k.s), true) AS p, o.x AS x FROM fold f JOIN others o ON o.doc_id = f.doc_id AND o.i = f.i + 1) f,
        LATERAL (SELECT f.x AS x) o),
    last AS (SELECT doc_id, unnest(arg_max(kept, i)) AS k FROM fold GROUP BY doc_id)
    SELECT doc_id, k.field AS field, k.type AS type, k.value AS value, k.s AS start_pos, k.e AS end_pos, k.c AS confidence, k.m AS method FROM last"""

# --- images ------------------------------------------------------------------------------------------------------------------------

ORACLES["ocr_lines"] = f"WITH {LINES} SELECT image_id, line_no, line_start, line_end FROM placed"
WORDS = """wds AS MATERIALIZED (SELECT * FROM (SELECT image_id, line_no, y, CAST(i - 1 AS BIGINT) AS word_no, parts[i] AS text, CAST((i - 1) * 50 + 10 AS BIGINT) AS x, CAST(length(parts[i]) * 8 AS BIGINT) AS w,
        (image_id * 7 + line_no * 3 + (i - 1) * 13) % 101 AS confidence
        FROM (SELECT image_id, line_no, y, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT image_id, line_no, y, string_split(text, ' ') AS parts FROM lines)))
    WHERE confidence >= 40 AND trim(text) <> '')"""
ORACLES["ocr_words"] = f"WITH {LINES}, {WORDS} SELECT image_id, count(*) AS n_words, CAST(sum(w) AS BIGINT) AS width FROM wds GROUP BY image_id"
ORACLES["ocr_regions"] = f"""WITH {DOCS}, {LINES}, {WORDS},
    onl AS MATERIALIZED (SELECT f.doc_id, f.start_pos, f.end_pos, f.type, f.value, count(*) AS n, min(p.line_no) AS line_no, min(p.x) AS x, min(p.y) AS y, max(p.x + p.w) - min(p.x) AS w, max(p.y + p.h) - min(p.y) AS h
        FROM found f JOIN placed p ON p.image_id = f.doc_id AND f.start_pos < p.line_end AND f.end_pos > p.line_start GROUP BY ALL),
    tight AS (SELECT o.doc_id, o.start_pos, o.type, min(d.x) AS x, min(d.y) AS y, max(d.x + d.w) - min(d.x) AS w, CAST(16 AS BIGINT) AS h FROM onl o
        JOIN wds d ON d.image_id = o.doc_id AND d.line_no = o.line_no WHERE o.n = 1 AND contains(lower(o.value), lower(d.text)) GROUP BY o.doc_id, o.start_pos, o.type)
    SELECT o.doc_id AS image_id, CAST(o.start_pos AS BIGINT) AS start_pos, o.type, coalesce(t.x, o.x) AS x, coalesce(t.y, o.y) AS y, coalesce(t.w, o.w) AS w, coalesce(t.h, o.h) AS h
    FROM onl o LEFT JOIN tight t USING (doc_id, start_pos, type)"""
FACES = """fc AS MATERIALIZED (SELECT image_id, x, y, r * 1280 - x AS w, b * 720 - y AS h FROM (SELECT vec_id AS image_id, l * 1280 AS x, t * 720 AS y, r, b FROM
    (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS t, abs(CAST(embedding[2] AS DOUBLE)) AS l,
        abs(CAST(embedding[1] AS DOUBLE)) + abs(CAST(embedding[3] AS DOUBLE)) AS b, abs(CAST(embedding[2] AS DOUBLE)) + abs(CAST(embedding[4] AS DOUBLE)) AS r FROM embeddings))
    WHERE r * 1280 - x >= 5 AND b * 720 - y >= 5)"""


def _padded(x: str, y: str, w: str, h: str, px: str, py: str) -> str:
    def half_up(e: str) -> str:
        return f"floor({e} + 0.5)"
    return (f"greatest(0, {half_up(f'{x} - {px}')}) AS px, greatest(0, {half_up(f'{y} - {py}')}) AS py, "
            f"{half_up(f'{w} + 2 * {px}')} AS pw, {half_up(f'{h} + 2 * {py}')} AS ph")


ORACLES["face_boxes"] = f"""WITH {FACES} SELECT image_id, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, CAST(px AS BIGINT) AS pad_x, CAST(py AS BIGINT) AS pad_y,
    CAST(least(1280 - px, pw) AS BIGINT) AS pad_w, CAST(least(720 - py, ph) AS BIGINT) AS pad_h FROM (SELECT *, {_padded('x', 'y', 'w', 'h', '(w * 0.1)', '(h * 0.1)')} FROM fc)"""
ORACLES["text_boxes"] = f"""WITH {LINES} SELECT image_id, line_no, CAST(px AS BIGINT) AS x, CAST(py AS BIGINT) AS y, CAST(least(1280 - px, pw) AS BIGINT) AS w, CAST(least(720 - py, ph) AS BIGINT) AS h
    FROM (SELECT image_id, line_no, {_padded('x', 'y', 'w', 'h', '2', '2')} FROM lines)"""
ORACLES["merged_boxes"] = f"WITH {LINES} SELECT image_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM lines GROUP BY image_id"
ORACLES["reading_regions"] = f"""WITH {FACES}, r AS (SELECT image_id, 'face_vicinity' AS label, greatest(0, x - w) AS x, y, w * 3 AS w, h * 2.5 AS h FROM fc
    UNION ALL SELECT image_id, CASE image_id % 4 WHEN 0 THEN 'auth_card' WHEN 2 THEN 'form_area' ELSE 'profile_section' END, x, y, w, h FROM fc WHERE image_id % 4 <> 1)
    SELECT image_id, label, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM r WHERE image_id % 10 <> 0"""
ORACLES["reading_needed"] = "SELECT vec_id AS image_id, vec_id % 2 = 0 AND (vec_id % 5 = 0 OR vec_id % 6 = 0 OR vec_id % 7 < 3) AS needed FROM embeddings"
ORACLES["all_regions"] = f"""{WR}{INPUT_REDACTED}, {FACES} SELECT CAST(image_id AS STRING) AS image_id, 'face' AS type, CAST(NULL AS STRING) AS label, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM fc
    UNION ALL SELECT element_id, 'text_pii', types[1], 1.0, 2.0, 30.0, 10.0 FROM redacted WHERE len(tokens) > 0 AND element_pos % 5 <> 0"""
ORACLES["softmax_argmax"] = """WITH m AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS x, embedding FROM embeddings)
    SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS predicted_class, round(list_max(x) / list_sum(x), 6) AS confidence FROM m"""

# --- model text -------------------------------------------------------------------------------------------------------------------------

_PX = "CAST(trunc({v} / 1000.0 * {e}) AS BIGINT)"


def px(v: str, e: int) -> str:
    return _PX.format(v=v, e=e)


ORACLES["ground_parse"] = f"""WITH n AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m, o_orderkey * 3 % 1001 AS a, o_orderkey * 7 % 1001 AS b, o_orderkey * 11 % 1001 AS c, o_orderkey * 13 % 1001 AS d FROM orders),
    v AS (SELECT k, m, a, b, CASE WHEN m = 4 THEN a + 0.5 ELSE a END AS t, CASE WHEN m = 4 THEN b + 0.5 ELSE b END AS l, CASE WHEN m = 4 THEN c + 0.5 ELSE c END AS bt, CAST(d AS DOUBLE) AS r FROM n),
    e AS (SELECT k, m, {px('l', 1280)} AS x1, {px('t', 720)} AS y1, {px('r', 1280)} AS x2, {px('bt', 720)} AS y2,
        CASE WHEN a <= 1000 AND b <= 1000 THEN {px('a', 1280)} ELSE a END AS qx, CASE WHEN a <= 1000 AND b <= 1000 THEN {px('b', 720)} ELSE b END AS qy FROM v)
    SELECT k AS o_orderkey, CASE WHEN m = 5 THEN NULL WHEN m = 3 THEN qx ELSE (x1 + x2) // 2 END AS cx, CASE WHEN m = 5 THEN NULL WHEN m = 3 THEN qy ELSE (y1 + y2) // 2 END AS cy,
    CASE WHEN m = 5 THEN NULL WHEN m = 3 THEN greatest(0, qx - 15) ELSE x1 END AS x, CASE WHEN m = 5 THEN NULL WHEN m = 3 THEN greatest(0, qy - 15) ELSE y1 END AS y,
    CASE WHEN m = 5 THEN NULL WHEN m = 3 THEN 30 ELSE greatest(1, x2 - x1) END AS w, CASE WHEN m = 5 THEN NULL WHEN m = 3 THEN 30 ELSE greatest(1, y2 - y1) END AS h,
    CAST(CASE WHEN m = 5 THEN 0.0 WHEN m = 3 THEN 0.9 ELSE 0.95 END AS DOUBLE) AS confidence FROM e"""
_CLEAN = """CASE o_orderkey % 7 WHEN 0 THEN concat('{"id": ', o_orderkey, '}') WHEN 1 THEN concat('{"id": ', o_orderkey, ', "x": [1, 2,],}') WHEN 2 THEN concat('{"id": ', o_orderkey, ' // the order', chr(10), '}')
    WHEN 3 THEN concat('{"steps": [{"id": ', o_orderkey, '} {"id": 2}]}') WHEN 4 THEN concat('{"id": ', o_orderkey, ', broken') WHEN 5 THEN concat('{"note": "a', chr(9), 'b", "id": ', o_orderkey, '}') ELSE '' END"""
ORACLES["json_clean"] = f"SELECT o_orderkey, {_CLEAN} AS clean FROM orders"
ORACLES["json_repair"] = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN concat('{"id": ', o_orderkey, '}') WHEN 1 THEN concat('{"id": ', o_orderkey, ', "x": [1, 2]}') WHEN 2 THEN concat('{"id": ', o_orderkey, ' }')
    WHEN 3 THEN concat('{"steps": [{"id": ', o_orderkey, '}, {"id": 2}]}') WHEN 4 THEN concat('{"id": ', o_orderkey, ', broken') WHEN 5 THEN concat('{"note": "a b", "id": ', o_orderkey, '}') ELSE '' END AS repaired,
    o_orderkey % 7 IN (0, 1, 2, 3, 5) AS parses FROM orders"""
ORACLES["vision_parse"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('s', o_orderkey) ELSE 'unknown' END AS screen_type,
    CAST(CASE o_orderkey % 3 WHEN 1 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS confidence, 'medium' AS visual_density, false AS has_active_modal, false AS has_sticky_footer, o_orderkey % 3 = 0 AS canvas_heavy,
    CAST(o_orderkey % 3 = 0 AS BIGINT) AS n_regions, CASE WHEN o_orderkey % 3 = 0 THEN 'header' END AS region_type,
    CASE WHEN o_orderkey % 3 = 0 THEN x1 END AS x, CASE WHEN o_orderkey % 3 = 0 THEN y1 END AS y, CASE WHEN o_orderkey % 3 = 0 THEN greatest(1, x2 - x1) END AS w,
    CASE WHEN o_orderkey % 3 = 0 THEN greatest(1, y2 - y1) END AS h
    FROM (SELECT o_orderkey, CAST(trunc(o_orderkey % 300 / 1000.0 * 1280) AS BIGINT) AS x1, CAST(trunc(o_orderkey % 500 / 1000.0 * 720) AS BIGINT) AS y1,
        CAST(trunc((o_orderkey % 300 + 50) / 1000.0 * 1280) AS BIGINT) AS x2, CAST(trunc((o_orderkey % 500 + 100) / 1000.0 * 720) AS BIGINT) AS y2 FROM orders)"""
ORACLES["obstacle_parse"] = """SELECT o_orderkey, o_orderkey % 3 = 0 AS has_obstacle, CASE WHEN o_orderkey % 3 = 0 THEN 'cookie_banner' ELSE 'none' END AS obstacle_type,
    CAST(CASE o_orderkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN o_orderkey % 3 = 2 THEN 'no json' ELSE '' END AS description, 'NONE' AS suggested_action,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(trunc(15 / 1000.0 * 1280) AS BIGINT) END AS dismiss_x, CASE WHEN o_orderkey % 3 = 0 THEN CAST(trunc((o_orderkey % 1000 + 500) / 2.0 / 1000.0 * 720) AS BIGINT) END AS dismiss_y FROM orders"""
ORACLES["verify_parse"] = """SELECT o_orderkey, o_orderkey % 3 <> 0 AS verified, o_orderkey % 3 <> 1 AS change_detected, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence,
    CASE o_orderkey % 3 WHEN 0 THEN 'r' WHEN 1 THEN '' ELSE left(concat('no json ', repeat(CAST(o_orderkey AS STRING), 60)), 200) END AS reasoning FROM orders"""
ORACLES["image_decode"] = "SELECT c_custkey, c_name AS body FROM customer"
ORACLES["image_source"] = """SELECT c_nationkey AS nation, 'gif' AS format, count(*) % 120 + 1 + 256 * (c_nationkey % 100 + 1) AS width,
    max(c_custkey) % 120 + 1 + 256 * (c_nationkey % 50 + 1) AS height, CAST(11 AS BIGINT) AS length FROM customer GROUP BY c_nationkey"""
ORACLES["epoch_time"] = "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS epoch, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM events"
ORACLES["json_columns"] = "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, concat('{\"k\":', props->>'$.k', '}') AS again FROM events"
ORACLES["map_merge"] = "SELECT event_id, event_type AS k, CAST(event_id AS STRING) AS id, CAST(2 AS BIGINT) AS n FROM events"

# --- streams -------------------------------------------------------------------------------------------------------------------------------

ORACLES["stream_redact"] = f"{WR}{DOC_REDACTED} SELECT session_id, step_no, text FROM redacted"
# A reset at step 3 of every fourth conversation: what follows is another session to the vault.
_TURN_ELEMENTS = f"""turns_ AS MATERIALIZED (SELECT concat(conv_id, '|', CASE WHEN conv_id % 4 = 0 AND {synth.TURN_STEP} >= 3 THEN 1 ELSE 0 END) AS session_id,
    {synth.TURN_STEP} AS step_no, CAST(turn % 2 AS INT) AS element_pos, role AS element_id, {synth.TURN_TEXT} AS text
    FROM conversations CROSS JOIN (VALUES (0), (1)) r(again))"""
_PLACE = ["session_id", "step_no", "element_pos", "element_id"]
_TURN_VAULT = f"{_TURN_ELEMENTS}, " + detect(f"SELECT session_id, step_no, element_pos, element_id, 'text' AS field, {clean('text')} AS content, {NO_CONTEXT} FROM turns_", _PLACE) + (
    ",\nspans AS (SELECT * FROM found),\n" + vault("spans", "step_no"))
_EK = "concat(session_id, '/', step_no, '/', element_pos) AS ek"
ORACLES["stream_turns"] = f"{WR}{_TURN_VAULT}, keyed AS (SELECT *, {_EK} FROM real), els AS (SELECT *, {_EK} FROM turns_),\n" + redaction("els", ["text"]) + (
    " SELECT split_part(e.session_id, '|', 1) AS session_id, e.step_no, e.element_id, CAST(e.element_pos AS BIGINT) AS element_pos, f.body AS text FROM els e JOIN f_text f USING (ek)")
ORACLES["stream_vault"] = f"""WITH {_TURN_VAULT} SELECT split_part(session_id, '|', 1) AS session_id, token, type, value, token_no, first_step FROM vault
    WHERE split_part(session_id, '|', 2) = CASE WHEN CAST(split_part(session_id, '|', 1) AS BIGINT) % 4 = 0 THEN '1' ELSE '0' END"""
ORACLES["stream_scans"] = f"""WITH {_TURN_ELEMENTS}, seen AS (SELECT *, lag(text) OVER w AS before, row_number() OVER w AS n FROM turns_
    WINDOW w AS (PARTITION BY session_id, element_id ORDER BY step_no, element_pos))
    SELECT split_part(session_id, '|', 1) AS session_id, step_no, count(*) AS total, count(*) FILTER (n = 1) AS new,
    count(*) FILTER (n > 1 AND text <> before) AS modified, count(*) FILTER (n > 1 AND text = before) AS unchanged,
    count(*) FILTER (n = 1 OR text <> before) AS scanned FROM seen GROUP BY session_id, step_no"""
_EVENTS = f"({derived('events', synth.STEP_EVENTS)})"
_OUTCOMES = """ SELECT split_part(f.session_id, '|', 1) AS session_id, CAST(f.step_id AS BIGINT) AS step_id, o.seq, o.op, f.state, CAST(f.attempts AS BIGINT) AS attempts,
    f.rejected = p.rejected AS accepted, CASE WHEN f.rejected > p.rejected THEN CASE o.op WHEN 'approve' THEN 'INVALID_APPROVAL' ELSE 'INVALID_TRANSITION' END
        WHEN o.op = 'deny' THEN 'APPROVAL_DENIED' END AS code
    FROM fold f JOIN own o ON o.session_id = f.session_id AND o.step_id = f.step_id AND o.n = f.n
    JOIN fold p ON p.session_id = f.session_id AND p.step_id = f.step_id AND p.n = f.n - 1"""


def lives(opens: str) -> str:
    """The step machine over sessions that start over: a new life at every row where ``opens``."""
    lived = f"""(SELECT * REPLACE (concat(session_id, '|', life) AS session_id) FROM (SELECT *, sum(CASE WHEN {opens} THEN 1 ELSE 0 END)
        OVER (PARTITION BY session_id ORDER BY ts, seq) AS life FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, seq) AS before
        FROM {_EVENTS})) WHERE NOT {synth.CLOSES})"""
    return f"{WR}{STEPS.replace(_EVENTS, lived)}{_OUTCOMES}"


ORACLES["stream_steps"] = lives(synth.CLOSES)
ORACLES["stream_cleanup"] = lives(f"{synth.CLOSES} OR epoch_us(ts) - epoch_us(before) > 86400000000")
ORACLES["stream_debounce"] = ORACLES["debounce"]

# --- extension points ------------------------------------------------------------------------------------------

_LUHN = " + ".join(f"d{i} // 5 + d{i} * 2 % 10" if i % 2 else f"d{i}" for i in range(1, 17))
ORACLES["sql_functions"] = f"""WITH {PLANS}, digits AS (SELECT *, concat('411111111111111', step_id) AS card FROM steps_),
    each_digit AS (SELECT *, {", ".join(f"CAST(card[{i}] AS INT) AS d{i}" for i in range(1, 17))} FROM digits)
    SELECT session_id, step_id, level, CASE step_id % 3 WHEN 0 THEN 'SPII' WHEN 1 THEN 'PII' ELSE {q("PII") if "NAME" in K.TIERS["PII"] else q("SPII") if "NAME" in K.TIERS["SPII"] else q("CONTEXTUAL")} END AS category,
    action AS kind, ({_LUHN}) % 10 = 0 AS luhn FROM each_digit"""
ORACLES["custom_detector"] = """SELECT doc_id, CAST(len(found) AS BIGINT) AS n, CAST(strpos(text, found[1]) - 1 AS BIGINT) AS first_start, found[1] AS first_value
    FROM (SELECT doc_id, text, regexp_extract_all(text, '[0-9A-Fa-f]{32,}') AS found FROM documents) WHERE len(found) > 0"""
ORACLES["snapshot_stream"] = ORACLES["snapshot_source"] = f"WITH {TURNS} SELECT session_id, step_no, element_id, text FROM turns"
