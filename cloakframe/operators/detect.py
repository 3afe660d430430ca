"""Pattern and attribute detectors.

Detection is row-local: every element carries its fields, its context and, as
the result, an array of spans.  Nothing is shuffled, and the whole scan stays
in the JVM as one expression per element.

Stages run in priority order.  Each pattern is matched over the whole field,
its matches are filtered, and a match is kept only if it overlaps nothing kept
before it.  Offsets are code points, ``start`` inclusive and ``end`` exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.functions.patterns import SPACE, jvm
from cloakframe.functions.sqltext import SOH, STX, any_word, filled, in_list, quoted, raw, trimmed
from cloakframe.schema import SPAN

_HIT = "array<struct<value:string,start:int,`end`:int>>"
_CAND = "array<struct<start:int,prio:int,`end`:int,type:string,value:string>>"
FIELDS = ("text", "placeholder", "value", "href")
CONTEXT_COLUMNS = ("tag", "parent_tag", "parent_class", "parent_id", "nearby_labels",
                   "placeholder", "type", "autocomplete")


@dataclass(frozen=True)
class Detector:
    """One detection stage.

    ``keep`` is a predicate over a match ``m`` and the field content ``{c}``.
    ``gate`` is a cheap test that must hold before the pattern is tried; the
    default always holds.  ``when`` is a context flag (or its negation with ``!``).
    """

    priority: int
    type: str
    pattern: str
    gate: str = "always"
    keep: str = "true"
    when: tuple[str, ...] = field(default_factory=tuple)


def _before(width: int) -> str:
    return f"substring({{c}}, greatest(m.start - {width - 1}, 1), least(m.start, {width}))"


def _after(width: int) -> str:
    return f"substring({{c}}, m.`end` + 1, {width})"


_LONE_NUMBER = (f"NOT ({_before(2)} rlike {raw(rf'[0-9][{SPACE}' + chr(92) + '-]?' + chr(92) + 'z')} "
                f"OR {_after(2)} rlike {raw(rf'^[{SPACE}' + chr(92) + '-]?[0-9]')})")
_LONE_WORD = f"NOT ({_before(1)} rlike '[0-9A-Za-z]' OR {_after(1)} rlike '[0-9A-Za-z]')"
_LONE_DIGITS = f"NOT ({_before(1)} rlike '[0-9]' OR {_after(1)} rlike '[0-9]')"
_DIGITS = r"regexp_replace(m.value, '[^0-9]', '')"
_STATE = in_list("upper(left(m.value, 2))", K.STATE_CODES)
_BHARAT = f"m.value rlike {raw(rf'(?i)^[0-9]{{2}}[-{SPACE}]?BH')}"

REGISTRY: tuple[Detector, ...] = (
    Detector(2, "UPI", "UPI", "at",
             in_list("lower(substring_index(m.value, '@', -1))", K.UPI_PROVIDERS)),
    Detector(3, "EMAIL", "EMAIL", "at",
             "NOT " + in_list("lower(substring_index(substring_index(m.value, '@', -1), '.', 1))",
                              K.UPI_PROVIDERS)
             + " AND NOT " + in_list("lower(substring_index(m.value, '@', 1))", K.SYSTEM_MAILBOXES),
             ("!public_area",)),
    Detector(4, "CARD", "CARD", "digits5",
             f"length({_DIGITS}) BETWEEN 13 AND 19 AND luhn_check({_DIGITS}) AND {_LONE_NUMBER}"),
    Detector(5, "BANK_ACCOUNT", "BANK_ACCOUNT", "digits5", _LONE_NUMBER, ("bank",)),
    Detector(6, "EPFO_UAN", "EPFO_UAN", "digits5", _LONE_NUMBER, ("uan",)),
    Detector(7, "AADHAAR", "AADHAAR", "digits5",
             f"length({_DIGITS}) = 12 AND {_LONE_NUMBER} "
             f"AND {_DIGITS} <> repeat(left({_DIGITS}, 1), 12)", ("!bank", "!uan")),
    Detector(8, "PAN", "PAN", "digits4", _LONE_WORD),
    Detector(9, "PHONE", "PHONE_IN", "digits5",
             f"{_LONE_NUMBER} AND NOT {_before(1)} rlike '[0-9A-Za-z]'",
             ("!support_phone", "!page_edge")),
    Detector(10, "PHONE", "PHONE_INTL", "plus", "true", ("!support_phone",)),
    Detector(11, "IP", "IP", "dotted", "NOT " + in_list("m.value", K.HARMLESS_IPS)),
    Detector(12, "IFSC", "IFSC", "zero", _LONE_WORD),
    Detector(13, "DOB", "DOB", "digits4", "true", ("dob",)),
    Detector(14, "PASSPORT", "PASSPORT", "digits5", _LONE_WORD, ("passport",)),
    Detector(15, "OTP", "OTP", "digits4", _LONE_DIGITS, ("otp",)),
    Detector(16, "VOTER_ID", "VOTER_ID", "digits5", _LONE_WORD),
    Detector(17, "DL", "DL", "digits5", f"{_LONE_WORD} AND ({_STATE} OR {{dl}})"),
    Detector(18, "VEHICLE_RC", "VEHICLE_RC", "digits4",
             f"{_LONE_WORD} AND ({_STATE} OR {_BHARAT} OR {{vehicle}})"),
)

_FLAGS = ("public_area", "page_edge", "support_phone", "bank", "uan", "dob", "passport",
          "otp", "dl", "vehicle")
_GATES = {
    "always": "true",
    "at": "contains({c}, '@')",
    "plus": "contains({c}, '+')",
    "dotted": "({c} rlike '[0-9][.][0-9]')",
    "zero": "({c} rlike '[A-Z]{{4}}0')",
    "digits4": "({c} rlike '[0-9]{{4}}')",
    "digits5": f"({{c}} rlike {raw('[0-9]{{4}}[' + SPACE.replace('{', '{{').replace('}', '}}') + chr(92) + '-]?[0-9]')})",
}


BLOCK = 256


def _matches(content: str, pattern: str) -> str:
    """All matches of a pattern with their offsets, in one pass over the text.

    Matches are fenced with a control character, so after splitting every odd
    part is a match and offsets are the running length of the parts.  Offsets
    run within blocks of parts and over the blocks' lengths, so the cost stays
    in proportion to the number of matches.
    """
    parts = f"split(regexp_replace({content}, {raw(jvm(pattern))}, '\\u0001$0\\u0001'), {SOH})"
    blocks = f"transform(sequence(0, (size(parts) - 1) div {BLOCK}), b -> slice(parts, b * {BLOCK} + 1, {BLOCK}))"
    firsts = "aggregate(blocks, array(0), (a, b) -> concat(a, array(element_at(a, -1) + aggregate(b, 0, (n, p) -> n + length(p)))))"
    hits = f"""flatten(transform(blocks, (b, k) -> aggregate(
        b, named_struct('pos', firsts[k], 'odd', false, 'out', cast(array() AS {_HIT})),
        (a, p) -> named_struct(
            'pos', a.pos + length(p), 'odd', NOT a.odd,
            'out', if(a.odd, concat(a.out, array(named_struct(
                'value', p, 'start', a.pos, 'end', a.pos + length(p)))), a.out)),
        a -> a.out)))"""
    return let("parts", parts, let("blocks", blocks, let("firsts", firsts, hits)))


def _stage(det: Detector, has_context: bool) -> str | None:
    """Candidate expression of one detector, or None if it can never fire."""
    conditions = [f"f.{det.gate}"]
    for flag in det.when:
        name, negated = flag.lstrip("!"), flag.startswith("!")
        if has_context:
            conditions.append(f"NOT ctx.{name}" if negated else f"ctx.{name}")
        elif not negated:
            return None
    names = {flag: (f"ctx.{flag}" if has_context else "false") for flag in _FLAGS}
    keep = _fill(det.keep, c="f.content", **names)
    pattern = K.PATTERNS.get(det.pattern, det.pattern)
    # Most fields hold no match; a plain test is cheaper than cutting the text.
    conditions.append(f"f.content rlike {raw(jvm(pattern))}")
    found = _matches("f.content", pattern)
    if keep != "true":
        found = f"filter({found}, m -> {keep})"
    return (f"CASE WHEN {' AND '.join(conditions)} THEN transform({found}, m -> named_struct("
            f"'start', m.start, 'prio', {det.priority}, 'end', m.`end`, "
            f"'type', {quoted(det.type)}, 'value', m.value)) ELSE cast(array() AS {_CAND}) END")


def _fill(template: str, **names: str) -> str:
    for key, value in names.items():
        template = template.replace("{" + key + "}", value)
    return template


_EMPTY = f"cast(array() AS {_CAND})"
_CLUSTER = f"""if(size({{cl}}) < 2, {{cl}}, array_sort(aggregate(
    array_sort({{cl}}, (x, y) -> CASE WHEN x.prio <> y.prio THEN x.prio - y.prio
                                      ELSE x.start - y.start END),
    {_EMPTY},
    (kept, c) -> if(exists(kept, k -> c.start < k.`end` AND c.`end` > k.start),
                    kept, concat(kept, array(c))))))"""


def resolve_overlaps(candidates: str) -> str:
    """Priority-greedy choice of non-overlapping spans, ordered by start.

    Candidates are sorted by start and cut into clusters at every point that no
    candidate crosses; only inside a cluster are spans compared.  A fold copies
    what it has gathered at every step, so the furthest end so far runs within
    blocks and over blocks, and the cost follows the number of candidates.
    """
    blocks = f"transform(sequence(0, (size(sorted) - 1) div {BLOCK}), b -> slice(sorted, b * {BLOCK} + 1, {BLOCK}))"
    limits = "aggregate(blocks, array(0), (a, b) -> concat(a, array(greatest(element_at(a, -1), array_max(transform(b, c -> c.`end`))))))"
    opens = """flatten(transform(blocks, (b, k) -> aggregate(
        b, named_struct('lim', limits[k], 'out', cast(array() AS array<boolean>)),
        (a, c) -> named_struct('lim', greatest(a.lim, c.`end`), 'out', concat(a.out, array(c.start >= a.lim))),
        a -> a.out)))"""
    heads = f"filter(transform({let('blocks', blocks, let('limits', limits, opens))}, (o, i) -> if(o, i, cast(NULL AS int))), i -> i IS NOT NULL)"
    one = let("cl", "slice(sorted, h + 1, coalesce(get(heads, k + 1), size(sorted)) - h)", _CLUSTER.format(cl="cl"))
    swept = let("heads", heads, f"flatten(transform(heads, (h, k) -> {one}))")
    return let("sorted", f"array_sort({candidates})", f"if(size(sorted) < 2, sorted, {swept})")


def context_flags(df: DataFrame, word_labels: bool = False) -> str | None:
    """Context predicates of an element as one struct; None without context columns.

    ``word_labels`` asks for whole-word label matches; by default a label also
    matches inside a longer word.
    """
    have = set(df.columns)
    if not have & (set(CONTEXT_COLUMNS) - {"placeholder"}):
        return None

    def col(name: str) -> str:
        return f"`{name}`" if name in have else "cast(NULL AS string)"

    parent_tag = f"coalesce({filled(col('parent_tag'))}, {col('tag')}, '')"
    labels = f"coalesce({filled(col('nearby_labels'))}, {col('placeholder')}, '')"
    label = "lab"
    normalized = f"regexp_replace(lower({labels}), {raw(f'[^a-z0-9{SPACE}]')}, '')"
    areas = f"concat_ws({SOH}, lower({col('parent_class')}), lower({col('parent_id')}))"
    auto = f"coalesce({col('autocomplete')}, '')"
    parts = [
        f"coalesce({col('type')}, '') = 'password' OR contains({auto}, 'password') AS password",
        f"{in_list(f'lower({parent_tag})', K.NON_PERSONAL_AREAS)} "
        f"OR {any_word(areas, K.NON_PERSONAL_AREAS)} AS public_area",
        f"upper({parent_tag}) IN ('FOOTER', 'NAV') AS page_edge",
    ]
    for name, words in K.LABELS.items():
        reachable = [w for w in words if re.fullmatch("[a-z0-9 ]+", w)]
        parts.append(f"{any_word(label, reachable, word_labels)} AS {name}")
    return let("lab", normalized, "struct(" + ", ".join(parts) + ")")


def scan_fields(df: DataFrame, fields: tuple[str, ...], out: str = "spans", *,
                detectors: tuple[Detector, ...] = REGISTRY,
                word_labels: bool = False) -> DataFrame:
    """Add the pattern spans of the named string columns as an array column."""
    flags = context_flags(df, word_labels)
    has_context = flags is not None
    needed = sorted({d.gate for d in detectors})
    gates = ", ".join(f"'{g}', {_GATES[g].format(c='x.content')}" for g in needed)
    listed = []
    for name in fields:
        content = f"replace(`{name}`, {SOH}, {STX})"
        if name == "value" and "type" in df.columns:
            content = f"CASE WHEN coalesce(`type`, '') <> 'password' THEN {content} END"
        listed.append(f"named_struct('field', '{name}', 'content', {content})")
    stages = [s for s in (_stage(d, has_context)
                          for d in sorted(detectors, key=lambda d: d.priority)) if s]
    candidates = f"concat({', '.join([_EMPTY, *stages])})"
    if has_context:
        candidates = (
            "CASE WHEN ctx.password THEN array(named_struct('start', 0, 'prio', 1, "
            f"'end', length(f.content), 'type', 'PASSWORD_FIELD', 'value', {quoted(K.HIDDEN_VALUE)})) "
            f"ELSE {candidates} END")
    content = (f"transform(filter(array({', '.join(listed)}), x -> x.content <> ''), "
               f"x -> named_struct('field', x.field, 'content', x.content, {gates}))")
    found = f"transform({content}, f -> named_struct('field', f.field, 'cands', {candidates}))"
    spans = (f"flatten(transform({found}, g -> transform({resolve_overlaps('g.cands')}, "
             "s -> named_struct('field', g.field, 'type', s.type, 'value', s.value, "
             "'start', s.start, 'end', s.`end`, 'confidence', 1.0D, 'method', 'REGEX'))))")
    return df.withColumn(out, F.expr(let("ctx", flags, spans) if has_context else spans))


def let(name: str, value: str, body: str) -> str:
    """Bind ``value`` to a name inside ``body``.

    A struct column would be inlined into every place that reads one of its
    fields; a lambda variable is computed once.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _att(field_name: str, kind: str, value: str, start: str, end: str, confidence: str) -> str:
    return (f"named_struct('field', '{field_name}', 'type', '{kind}', 'value', {value}, "
            f"'start', {start}, 'end', {end}, 'confidence', {confidence}D, 'method', 'DOM_ATTRIBUTE')")


def attribute_spans(df: DataFrame, out: str = "attribute_spans") -> DataFrame:
    """Add the spans that follow from an element's attributes and labels.

    Expects ``spans`` from :func:`scan_fields`; a rule adds its span unless the
    field already has one of that type.
    """
    have = set(df.columns)

    def col(name: str) -> str:
        return f"coalesce(`{name}`, '')" if name in have else "''"

    def rule(name: str, expr: str) -> str:
        return f"({expr} rlike {raw(jvm(K.ATTRIBUTE_PATTERNS[name]))})"

    def has(field_name: str, kind: str) -> str:
        return f"exists(spans, s -> s.field = '{field_name}' AND s.type = '{kind}')"

    t, v, lab = col("text"), "a.value", "a.label"
    wide = f"concat({lab}, ' ', {t})"
    greeting = raw(jvm(K.ATTRIBUTE_PATTERNS["greeting"]))
    inputs = (f"struct({col('value')} AS value, {trimmed(col('value'))} AS trimmed, "
              f"regexp_replace({col('value')}, '[^0-9]', '') AS digits, "
              f"lower(concat({col('selector')}, ' ', {col('nearby_labels')}, ' ', "
              f"{col('placeholder')}, ' ', {col('element_id')})) AS label)")
    names = f"""struct(
        {v} <> '' AND {rule('holder_label', lab)} AND {v} rlike '[a-zA-Z]{{2}}' AS holder,
        CASE WHEN {rule('account_nav', lab)}
             THEN nullif(regexp_extract({t}, {greeting}, 1), '') END AS greeted,
        CASE WHEN {rule('name_label', lab)}
             THEN if({v} <> '', a.trimmed, {trimmed(t)}) ELSE '' END AS target)"""

    def whole(kind: str, when: str) -> str:
        span = _att("value", kind, "a.trimmed", "0", "length(a.trimmed)", "0.95")
        return f"CASE WHEN {v} <> '' AND {when} AND NOT {has('value', kind)} THEN {span} END"

    full_name = (f"named_struct('field', if({v} <> '', 'value', 'text'), 'type', 'NAME', "
                 "'value', b.target, 'start', 0, 'end', length(b.target), "
                 "'confidence', 0.9D, 'method', 'DOM_ATTRIBUTE')")
    avatar = f"if({t} <> '', {t}, {quoted(K.AVATAR_VALUE)})"
    greeted_at = f"instr({t}, b.greeted) - 1"
    rules = [
        f"CASE WHEN {col('type')} = 'password' THEN named_struct('field', 'text', "
        f"'type', 'PASSWORD_FIELD', 'value', {quoted(K.HIDDEN_VALUE)}, 'start', 0, 'end', 0, "
        "'confidence', 1.0D, 'method', 'REGEX') END",
        whole("CARD", f"{rule('card_label', lab)} AND {v} rlike '[0-9]{{4}}'"),
        f"CASE WHEN b.holder THEN "
        f"{_att('value', 'NAME', 'a.trimmed', '0', 'length(a.trimmed)', '0.9')} END",
        f"CASE WHEN {t} <> '' AND {rule('address_label', wide)} AND {rule('address_text', t)} THEN "
        f"{_att('text', 'ADDRESS', trimmed(t), '0', f'length({trimmed(t)})', '0.95')} END",
        f"CASE WHEN b.greeted IS NOT NULL THEN "
        f"{_att('text', 'NAME', 'b.greeted', greeted_at, f'{greeted_at} + length(b.greeted)', '0.85')} END",
        f"CASE WHEN {rule('avatar', lab)} OR ({col('role')} = 'img' AND {rule('avatar_img', lab)}) "
        f"THEN {_att('text', 'AVATAR', avatar, '0', f'length({avatar})', '0.95')} END",
        f"CASE WHEN b.target <> '' AND {rule('name_value', 'b.target')} "
        f"AND NOT b.holder AND b.greeted IS NULL THEN {full_name} END",
        whole("BANK_ACCOUNT", f"{rule('bank_label', lab)} AND length(a.digits) BETWEEN 9 AND 18"),
        whole("DL", rule("dl_label", lab)),
        whole("VOTER_ID", rule("voter_label", lab)),
        whole("EPFO_UAN", f"{rule('uan_label', lab)} AND length(a.digits) = 12"),
        whole("VEHICLE_RC", rule("vehicle_label", lab)),
    ]
    body = f"filter(array({', '.join(rules)}), s -> s IS NOT NULL)"
    return df.withColumn(out, F.expr(let("a", inputs, let("b", names, body))))


def scan_text(df: DataFrame, text: str = "text", *,
              detectors: tuple[Detector, ...] = REGISTRY) -> DataFrame:
    """Pattern spans of one free-text column, without element context."""
    bare = df.select([c for c in df.columns if c not in CONTEXT_COLUMNS or c == text])
    return scan_fields(bare, (text,), detectors=detectors)


def scan_elements(elements: DataFrame, *, scan_href: bool = True,
                  detectors: tuple[Detector, ...] = REGISTRY,
                  word_labels: bool = False) -> DataFrame:
    """All spans of each element: patterns over its fields, then attribute rules."""
    fields = tuple(f for f in FIELDS
                   if f in elements.columns and (f != "href" or scan_href))
    found = scan_fields(elements, fields, detectors=detectors, word_labels=word_labels)
    found = attribute_spans(found)
    return (found.withColumn("spans", F.expr(f"cast(concat(spans, attribute_spans) AS array<{SPAN}>)"))
            .drop("attribute_spans"))
