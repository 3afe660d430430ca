"""Working tables derived from the base tables by plain formulas.

The base tables hold no labelled page elements, protocol messages or model
outputs, so these are computed from their rows.  Every formula is SQL that
Spark and other engines read alike.
"""

from __future__ import annotations

K = "o_orderkey"


def _pad(n: int, modulo: int | None = None, key: str = K) -> str:
    value = f"({key} % {modulo})" if modulo else key
    return f"lpad(CAST({value} AS STRING), {n}, '0')"


def _pick(selector: str, options: list[str], default: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {selector} {whens} ELSE {default} END"


_LABELS = ["Email", "Email", "Email", "Saved Card", "Account Number", "UAN", "Aadhaar Number", "PAN",
           "Mobile", "Customer Care", "Date of Birth", "Order Date", "Passport Number", "Enter OTP",
           "UPI ID", "Bank IFSC", "Voter ID", "Vehicle", "Licence", "Price"]
_PHONE = f"concat('+91 98', {_pad(3, 1000)}, ' ', {_pad(5, 100000)})"
_DATE = f"concat('15/03/19', {_pad(2, 100)})"
_TEXTS = [
    f"concat('user', CAST({K} AS STRING), '@mail.example.com')", "'support@mail.example.com'",
    f"concat('user', CAST({K} AS STRING), '@mail.example.com')", f"concat('Card: 4', {_pad(15)})",
    _pad(12), f"concat('1', {_pad(11)})", f"concat('2', {_pad(11)})",
    f"concat('ABCPD', {_pad(4, 10000)}, 'E')", _PHONE, _PHONE, _DATE, _DATE,
    f"concat('J', {_pad(7, 10000000)})", _pad(6, 1000000),
    f"concat('user', CAST({K} AS STRING), '@ybl')", f"concat('HDFC0', {_pad(6, 1000000)})",
    f"concat('ABC', {_pad(7, 10000000)})", f"concat('DL 01 AB ', {_pad(4, 10000)})",
    f"concat('DL-0119', {_pad(2, 100)}, {_pad(7, 10000000)})",
    f"concat('Item ', CAST({K} AS STRING), ' costs 449')",
]
_KIND = f"({K} % 20)"

ELEMENTS = {
    "session_id": "CAST(o_custkey AS STRING)",
    "step_no": "CAST(0 AS BIGINT)",
    "element_pos": f"CAST({K} AS INT)",
    "element_id": f"concat('e_', CAST({K} AS STRING))",
    "tag": "'SPAN'",
    "text": _pick(_KIND, _TEXTS, "''"),
    "parent_tag": f"CASE {_KIND} WHEN 0 THEN 'DIV' WHEN 1 THEN 'DIV' WHEN 2 THEN 'FOOTER' WHEN 19 THEN 'DIV' ELSE 'SPAN' END",
    "parent_class": f"CASE WHEN {K} % 60 = 0 THEN 'site-footer' WHEN {K} % 60 = 20 THEN 'profile' ELSE '' END",
    "parent_id": f"CASE WHEN {K} % 120 = 40 THEN 'terms-box' ELSE '' END",
    "nearby_labels": _pick(_KIND, [f"'{x}'" for x in _LABELS], "''"),
    "coordinates_x": f"CAST({K} % 1280 AS DOUBLE)",
}

# Form inputs whose kind shows only in their attributes: (selector, value, text, role, type).
_INPUTS = [
    ("'input.card-number'", f"concat('4111 ', {_pad(4, 10000)})", "NULL", "'textbox'", "'text'"),
    ("'#cardholder'", f"concat(' Asha N', CAST({K} AS STRING), ' ')", "NULL", "'textbox'", "'text'"),
    ("'div.shipping address'", "NULL", f"concat('  Flat ', CAST({K} AS STRING), ', MG Road ')", "'generic'", "NULL"),
    ("'a.nav-link-account'", "NULL", "'Hello, Asha'", "'link'", "NULL"),
    ("'img.user-avatar'", "NULL", "NULL", "'img'", "NULL"),
    ("'span.user'", "NULL", f"concat('pic ', CAST({K} AS STRING))", "'img'", "NULL"),
    ("'input.first-name'", f"CASE WHEN {K} % 32 = 6 THEN 'Asha' ELSE 'R2-D2' END", "NULL", "'textbox'", "'text'"),
    ("'input.account-number'", _pad(11), "NULL", "'textbox'", "'text'"),
    ("'input.dl-no'", f"concat('X', {_pad(6)})", "NULL", "'textbox'", "'text'"),
    ("'input.voter-id'", f"concat('V', {_pad(6)})", "NULL", "'textbox'", "'text'"),
    ("'input.uan-no'", f"concat('1', {_pad(11)})", "NULL", "'textbox'", "'text'"),
    ("'input.plate-no'", f"concat('P', {_pad(6)})", "NULL", "'textbox'", "'text'"),
    ("'input.pass'", f"concat('pw', CAST({K} AS STRING))", "'••••'", "'textbox'", "'password'"),
    ("'input.pass2'", f"concat('pw', CAST({K} AS STRING))", "NULL", "'textbox'", "'text'"),
    ("'span.instructor'", "NULL", "'Asha Rao'", "'generic'", "NULL"),
    ("'input.search'", f"concat('shoes ', CAST({K} AS STRING))", "NULL", "'searchbox'", "'search'"),
]
_SLOT = f"({K} % 16)"

INPUTS = {
    "session_id": "CAST(o_custkey AS STRING)",
    "step_no": "CAST(0 AS BIGINT)",
    "element_pos": f"CAST({K} AS INT)",
    "element_id": f"concat('e_', CAST({K} AS STRING))",
    "tag": "'INPUT'",
    "selector": _pick(_SLOT, [r[0] for r in _INPUTS], "''"),
    "text": _pick(_SLOT, [r[2] for r in _INPUTS], "NULL"),
    "placeholder": "CAST(NULL AS STRING)",
    "value": _pick(_SLOT, [r[1] for r in _INPUTS], "NULL"),
    "type": _pick(_SLOT, [r[4] for r in _INPUTS], "NULL"),
    "autocomplete": f"CASE {_SLOT} WHEN 13 THEN 'new-password' ELSE '' END",
    "role": _pick(_SLOT, [r[3] for r in _INPUTS], "NULL"),
    "parent_tag": "'FORM'",
    "parent_class": "''",
    "parent_id": "''",
    "nearby_labels": "CAST(NULL AS STRING)",
}

_S = "CAST(user_id AS STRING)"
_E = "CAST(event_id AS STRING)"

# Turns of a conversation as elements, whole texts.  Every turn is shown in two steps, and two of three stay as
# they are in the second, so that elements are new, modified and unchanged; every third conversation leaves an address.
TURN_STEP = "CAST(2 * floor(turn / 2) + again AS BIGINT)"
TURN_TEXT = ("concat(coalesce(text, ''), CASE WHEN conv_id % 3 = 0 THEN concat(' write to user', CAST(conv_id AS STRING), '@mail.example.com') ELSE '' END, "
             "CASE WHEN again = 1 AND (conv_id + turn) % 3 = 0 THEN ' (edited)' ELSE '' END)")

# Raw protocol lines, some of them broken.
MESSAGES = {
    "event_id": "event_id",
    "value": (
        "CASE event_type "
        f"WHEN 'view' THEN concat('{{\"type\":\"USER_QUERY\",\"session_id\":\"s', {_S}, '\",\"client_timestamp\":', {_E}, ',\"payload\":{{\"query\":\"q', {_E}, '\"}}}}') "
        f"WHEN 'click' THEN concat('{{\"type\":\"STEP_RESULT\",\"session_id\":\"s', {_S}, '\",\"payload\":{{\"step_id\":', {_E}, '}}}}') "
        f"WHEN 'signup' THEN concat('{{\"type\":\"', CASE event_id % 4 WHEN 0 THEN 'APPROVAL_RESPONSE' WHEN 1 THEN 'PAUSE_AGENT' WHEN 2 THEN 'RESUME_AGENT' ELSE 'STOP_AGENT' END, '\",\"session_id\":\"s', {_S}, '\"}}') "
        f"WHEN 'purchase' THEN concat('{{\"type\":\"', CASE event_id % 3 WHEN 0 THEN 'SESSION_RESTORE' WHEN 1 THEN 'PLAN' ELSE 'ERROR' END, '\",\"session_id\":\"s', {_S}, '\",\"payload\":{{}}}}') "
        f"ELSE CASE event_id % 6 WHEN 0 THEN concat('{{\"type\": ', {_E}) "
        f"WHEN 1 THEN concat('{{\"type\":\"NO_SUCH_TYPE\",\"session_id\":\"s', {_S}, '\"}}') "
        "WHEN 2 THEN '{\"type\":\"USER_QUERY\",\"session_id\":\"\"}' "
        "WHEN 3 THEN '[1, 2]' "
        f"WHEN 4 THEN concat('{{\"type\":\"USER_QUERY\",\"session_id\":\"s', {_S}, '\",\"payload\":[', {_E}, ']}}') "
        f"ELSE concat('{{\"type\":\"STOP_AGENT\",\"session_id\":', {_S}, '}}') END END"),
}

# Goals and plan triggers per session.
GOALS = {
    "session_id": _S, "ts": "ts", "seq": "event_id",
    "goal": f"CASE WHEN event_type IN ('view', 'purchase') THEN concat('g', {_E}) END",
    "triggers_plan": "event_type IN ('click', 'purchase')",
}

STEP_EVENTS = {
    "session_id": _S, "step_id": "CAST(event_id % 5 + 1 AS INT)", "ts": "ts", "seq": "event_id",
    "op": ("CASE event_type WHEN 'view' THEN 'run' WHEN 'click' THEN 'success' WHEN 'error' THEN 'fail' "
           "WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'retry' "
           "WHEN 2 THEN 'block' ELSE 'fallback' END "
           "ELSE CASE event_id % 40 WHEN 0 THEN 'skip' WHEN 1 THEN 'deny' WHEN 2 THEN 'stop' "
           "WHEN 3 THEN 'pause' WHEN 4 THEN 'resume' ELSE 'run' END END"),
    "error": f"CASE WHEN event_type = 'error' THEN concat('err ', {_E}) END",
    "error_code": ("CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'SELECTOR_NOT_FOUND' "
                   "WHEN 1 THEN 'PAGE_TIMEOUT' ELSE 'AUTH_REQUIRED' END END"),
}

# Events that close their session.
CLOSES = "seq % 61 = 7"

MEMORY_LOG = {
    "key": "concat('k', CAST(user_id AS STRING), '_', event_type)",
    "value": "props",
    "category": ("CASE event_type WHEN 'view' THEN 'history' WHEN 'click' THEN 'preferences' "
                 "WHEN 'purchase' THEN 'goals' WHEN 'signup' THEN 'entities' ELSE 'general' END"),
    "source_session_id": "CAST(user_id % 50 AS STRING)",
    "ts": "ts", "seq": "event_id",
}

SESSION_LOG = {
    "session_id": "CAST(user_id AS STRING)", "ts": "ts", "seq": "event_id",
    "op": ("CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'delete' "
           "WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'archive' ELSE 'update' END"),
    "goal": f"CASE WHEN event_type IN ('signup', 'click') THEN concat('goal ', {_E}) END",
    "plan_id": f"CASE WHEN event_type = 'purchase' THEN concat('plan_', {_E}) END",
}

# Plan steps: one per part, grouped into plans of nine.
PLAN_STEPS = {
    "session_id": "CAST(CAST(floor(p_partkey / 9) AS BIGINT) AS STRING)",
    "step_id": "CAST(p_partkey % 9 AS INT)",
    "total_steps": "CAST(CASE WHEN p_partkey % 63 = 5 THEN 0 ELSE 9 END AS INT)",
    "action": ("CASE p_partkey % 11 WHEN 0 THEN 'TYPE_FROM_VAULT' WHEN 1 THEN 'CAPTCHA_HANDOFF' "
               "WHEN 2 THEN 'TYPE' WHEN 3 THEN 'SCROLL' WHEN 4 THEN 'TELEPORT' ELSE 'CLICK' END"),
    "description": ("concat(CASE p_partkey % 13 WHEN 0 THEN 'Buy ' WHEN 1 THEN 'View ' WHEN 2 THEN 'Fill form for ' "
                    "WHEN 3 THEN 'Check and update ' WHEN 4 THEN 'Transfer money for ' WHEN 5 THEN 'Go back to ' "
                    "WHEN 6 THEN 'Place border around ' ELSE 'Look at ' END, p_name)"),
}

# Entity tokens: words of the documents with a label and a score by formula.
NER_WORDS_PER_GROUP = 7
NER_LABEL = ("CASE WHEN (doc_id + pos) % 7 = 0 THEN 'B-PER' WHEN (doc_id + pos) % 7 = 1 THEN 'I-PER' "
             "WHEN (doc_id + pos) % 7 = 2 THEN 'I-PER' WHEN (doc_id + pos) % 7 = 3 THEN 'B-LOC' "
             "WHEN (doc_id + pos) % 7 = 4 THEN 'I-PER' WHEN (doc_id + pos) % 7 = 5 THEN 'B-ORG' ELSE 'I-MISC' END")
NER_WORD = "CASE WHEN (doc_id + pos) % 7 = 2 THEN concat('##', raw_word) ELSE raw_word END"
NER_SCORE = "round((70 + (doc_id * 31 + pos * 17) % 30) / CAST(100 AS DOUBLE), 4)"


def select_list(columns: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in columns.items()]
