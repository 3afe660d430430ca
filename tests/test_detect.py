"""Detectors: cases as data, and random text against a literal restatement."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import constants as K
from cloakframe.operators import detect
from cloakframe.operators.spans import explode_spans

# (text, context, expected (type, value) pairs)
CASES = [
    ("Write to user.one@mail.example.org now", {"parent_tag": "SPAN"}, [("EMAIL", "user.one@mail.example.org")]),
    ("From: noreply@shop.example.org", {}, []),
    ("support@shop.example.org", {}, []),
    ("user@shop.example.org", {"parent_tag": "FOOTER"}, []),
    ("user@shop.example.org", {"parent_class": "main-sitemap"}, []),
    ("a@b.example c@d.example", {"parent_tag": "DIV"}, [("EMAIL", "a@b.example"), ("EMAIL", "c@d.example")]),
    ("+91 98111 22233", {"parent_tag": "SPAN"}, [("PHONE", "+91 98111 22233")]),
    ("Call 9811122233", {}, [("PHONE", "9811122233")]),
    ("+91-98111-22233", {}, [("PHONE", "+91-98111-22233")]),
    ("9811122233", {"parent_tag": "FOOTER"}, []),
    ("9811122233", {"nearby_labels": "Customer Care"}, []),
    ("1800-123-4567", {}, []),
    ("+44 7700900123", {}, [("PHONE", "+44 7700900123")]),
    ("Aadhaar: 2345 6789 0123", {}, [("AADHAAR", "2345 6789 0123")]),
    ("2345-6789-0123", {}, [("AADHAAR", "2345-6789-0123")]),
    ("0123 4567 8901", {}, []),
    ("2222 2222 2222", {}, []),
    ("PAN: ABCPD1234E", {}, [("PAN", "ABCPD1234E")]),
    ("pan is abcpd1234e", {}, [("PAN", "abcpd1234e")]),
    ("ABCXD1234E", {}, []),
    ("Card: 4532 0151 1283 0366", {}, [("CARD", "4532 0151 1283 0366")]),
    ("Card 4532-0151-1283-0366", {}, [("CARD", "4532-0151-1283-0366")]),
    ("4532 1234 5678 9012", {}, []),
    ("Pay ravi@ybl or to shop.pay-9@okicici", {}, [("UPI", "ravi@ybl"), ("UPI", "shop.pay-9@okicici")]),
    ("15/03/1998", {"nearby_labels": "Date of Birth"}, [("DOB", "15/03/1998")]),
    ("15/03/2024", {"nearby_labels": "Order Date"}, []),
    ("Your IP: 203.45.67.89", {}, [("IP", "203.45.67.89")]),
    ("Server: 127.0.0.1", {}, []),
    ("IFSC: HDFC0001234", {}, [("IFSC", "HDFC0001234")]),
    ("J1234567", {"nearby_labels": "Passport Number"}, [("PASSPORT", "J1234567")]),
    ("A1234567", {"nearby_labels": "Order"}, []),
    ("code 482913", {"nearby_labels": "Enter OTP"}, [("OTP", "482913")]),
    ("Voter ABC1234567", {}, [("VOTER_ID", "ABC1234567")]),
    ("EPIC: XYZ/9876543", {}, [("VOTER_ID", "XYZ/9876543")]),
    ("DL-0420110012345 issued", {}, [("DL", "DL-0420110012345")]),
    ("MH02 20180012345", {"nearby_labels": "Driving Licence"}, [("DL", "MH02 20180012345")]),
    ("Your UAN is 101234567890", {"nearby_labels": "EPFO UAN Number"}, [("EPFO_UAN", "101234567890")]),
    ("201234567890", {"nearby_labels": "EPFO UAN Number"}, [("EPFO_UAN", "201234567890")]),
    ("barcode 101234567890", {"nearby_labels": "Package tracking"}, []),
    ("DL 01 AB 1234", {"nearby_labels": "Vehicle RC"}, [("VEHICLE_RC", "DL 01 AB 1234")]),
    ("Car: 22-BH-1234-AA", {}, [("VEHICLE_RC", "22-BH-1234-AA")]),
    ("512345678901", {"nearby_labels": "Bank Account Number"}, [("BANK_ACCOUNT", "512345678901")]),
    ("serial 112345678901", {"nearby_labels": "Invoice ID"}, []),
    ('("user@mail.example") / [+91 98111 22233] / {ABCPD1234E}', {},
     [("EMAIL", "user@mail.example"), ("PHONE", "+91 98111 22233"), ("PAN", "ABCPD1234E")]),
    ("Order OD123456789012345678", {}, []),
    ("#FFFFFF 1920x1080 ₹1,49,999 WH-1000XM5", {}, []),
    ("secret", {"type": "password"}, [("PASSWORD_FIELD", "[hidden]")]),
    ("secret", {"autocomplete": "new-password"}, [("PASSWORD_FIELD", "[hidden]")]),
    # accents are no word characters, NBSP is a space, emoji count one code point
    ("éABCPD1234E", {}, [("PAN", "ABCPD1234E")]),
    ("2345 6789 0123", {}, [("AADHAAR", "2345 6789 0123")]),
    ("\U0001f600 203.45.67.89", {}, [("IP", "203.45.67.89")]),
    ("a\u000198111\u000122233", {}, []),
    ("", {}, []),
]
CONTEXT = ["parent_tag", "parent_class", "parent_id", "nearby_labels", "type", "autocomplete"]


def test_cases(spark):
    rows = [(i, text, *[ctx.get(c) for c in CONTEXT]) for i, (text, ctx, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "n int, text string, " + ", ".join(f"{c} string" for c in CONTEXT))
    got = {i: [] for i in range(len(CASES))}
    found = explode_spans(detect.scan_fields(df, ("text",)), ("n",))
    for r in found.orderBy("n", "start").collect():
        got[r.n].append((r.type, r.value))
        if r.value != K.HIDDEN_VALUE:
            assert CASES[r.n][0][r.start:r.end] == r.value
    for i, (text, ctx, expected) in enumerate(CASES):
        assert got[i] == expected, (text, ctx)


def brute_force(text):
    """Stages over ASCII text without context, written out plainly."""
    kept = []

    def luhn(d):
        s = sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d)))
        return s % 10 == 0

    def lone_number(s, e):
        return not (re.search(r"[0-9][\s-]?\Z", text[max(s - 2, 0):s]) or re.match(r"[\s-]?[0-9]", text[e:]))

    def lone_word(s, e):
        return not ((s and re.match("[0-9A-Za-z]", text[s - 1])) or re.match("[0-9A-Za-z]", text[e:]))

    for det in sorted(detect.REGISTRY, key=lambda d: d.priority):
        if any(not w.startswith("!") for w in det.when):
            continue
        for m in re.finditer(K.PATTERNS[det.pattern], text, re.ASCII):
            v, s, e = m.group(0), m.start(), m.end()
            d = re.sub(r"\D", "", v, flags=re.ASCII)
            domain = v.split("@")[-1].lower().split(".")[0]
            ok = {
                "UPI": lambda: v.split("@")[1].lower() in K.UPI_PROVIDERS,
                "EMAIL": lambda: domain not in K.UPI_PROVIDERS and v.split("@")[0].lower() not in K.SYSTEM_MAILBOXES,
                "CARD": lambda: 13 <= len(d) <= 19 and luhn(d) and lone_number(s, e),
                "AADHAAR": lambda: len(d) == 12 and len(set(d)) > 1 and lone_number(s, e),
                "PAN": lambda: lone_word(s, e),
                "PHONE_IN": lambda: lone_number(s, e) and not (s and re.match("[0-9A-Za-z]", text[s - 1])),
                "PHONE_INTL": lambda: True, "IP": lambda: v not in K.HARMLESS_IPS, "IFSC": lambda: lone_word(s, e),
                "VOTER_ID": lambda: lone_word(s, e),
                "DL": lambda: lone_word(s, e) and v[:2] in K.STATE_CODES,
                "VEHICLE_RC": lambda: lone_word(s, e) and (v[:2] in K.STATE_CODES or re.match(r"(?i)\d{2}[-\s]?BH", v)),
            }[det.pattern]()
            if ok and not any(s < b and e > a for _, _, a, b in kept):
                kept.append((det.type, v, s, e))
    return sorted(kept, key=lambda k: k[2])


PIECES = ["4532 0151 1283 0366", "9811122233", "+91 98111 22233", "2345 6789 0123", "ABCPD1234E", "203.45.67.89",
          "HDFC0001234", "ABC1234567", "DL-0420110012345", "MH 01 AB 1234", "22 BH 1234 AA", "u.v@mail.example.com",
          "x@ybl", "+44 770090012", "noreply@a.example", " ", "-", ".", "a", "7", "12", "0366", "_", "@", "+", "\n", "B"]


def test_random_text_matches_brute_force(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(4)
    got = {i: [] for i in range(len(texts))}
    for r in explode_spans(detect.scan_text(df), ("n",)).collect():
        got[r.n].append((r.type, r.value, r.start, r.end))
    for i, text in enumerate(texts):
        assert sorted(got[i], key=lambda k: k[2]) == brute_force(text), repr(text)


def test_long_text_is_scanned_whole(spark):
    words = [f"w{i} " for i in range(20000)]
    for i in range(0, 20000, 100):
        words[i] = f"u{i}@mail.example.com "
    df = spark.createDataFrame([(0, "".join(words))], "n int, text string")
    rows = explode_spans(detect.scan_text(df), ("n",)).collect()
    assert len(rows) == 200 and rows[-1].value == "u19900@mail.example.com"


INPUTS = [
    ({"selector": "input.card-number", "value": " 4111 2222 "}, [("value", "CARD", "4111 2222", 0.95)]),
    ({"nearby_labels": "Name on card", "value": "Asha Rao"}, [("value", "NAME", "Asha Rao", 0.9)]),
    ({"nearby_labels": "Delivery Address", "text": "Flat 4, MG Road"}, [("text", "ADDRESS", "Flat 4, MG Road", 0.95)]),
    ({"selector": "#nav-link-account", "text": "Hello, Asha"}, [("text", "NAME", "Asha", 0.85)]),
    ({"selector": "img.user-avatar"}, [("text", "AVATAR", "[USER_AVATAR]", 0.95)]),
    ({"selector": "i.user", "role": "img", "text": "me"}, [("text", "AVATAR", "me", 0.95)]),
    ({"nearby_labels": "First name", "value": "Asha"}, [("value", "NAME", "Asha", 0.9)]),
    ({"nearby_labels": "First name", "value": "R2-D2!"}, []),
    ({"selector": "input.account-num", "value": "12 3456 789"}, [("value", "BANK_ACCOUNT", "12 3456 789", 0.95)]),
    ({"selector": "input.dl-no", "value": "X1"}, [("value", "DL", "X1", 0.95)]),
    ({"selector": "input.voter-id", "value": "V1"}, [("value", "VOTER_ID", "V1", 0.95)]),
    ({"selector": "input.uan-no", "value": "1000-0000-0001"}, [("value", "EPFO_UAN", "1000-0000-0001", 0.95)]),
    ({"selector": "input.plate-no", "value": "P1"}, [("value", "VEHICLE_RC", "P1", 0.95)]),
    ({"type": "password", "value": "hunter2"}, [("text", "PASSWORD_FIELD", "[hidden]", 1.0)]),
    ({"selector": "input.q", "value": "shoes"}, []),
]


def test_attribute_rules(spark):
    names = ["selector", "text", "placeholder", "value", "type", "role", "nearby_labels", "tag"]
    rows = [(f"e_{i}", *[e.get(n) for n in names]) for i, (e, _) in enumerate(INPUTS)]
    df = spark.createDataFrame(rows, "element_id string, " + ", ".join(f"{n} string" for n in names))
    got = {}
    for r in explode_spans(detect.scan_elements(df), ("element_id",)).collect():
        got.setdefault(r.element_id, []).append((r.field, r.type, r.value, r.confidence))
    for i, (element, expected) in enumerate(INPUTS):
        assert got.get(f"e_{i}", []) == expected, element


def test_word_bounded_labels(spark):
    df = spark.createDataFrame([("Quantity", "201234567890")], "nearby_labels string, text string")
    loose = explode_spans(detect.scan_fields(df, ("text",)), ("text",)).first()
    strict = explode_spans(detect.scan_fields(df, ("text",), word_labels=True), ("text",)).first()
    assert loose.type == "EPFO_UAN" and strict.type == "AADHAAR"


def test_custom_detector(spark):
    ticket = detect.Detector(1, "TICKET", r"\bTCK-\d{4}\b", "digits4")
    df = spark.createDataFrame([("see TCK-1234 now",)], "text string")
    rows = explode_spans(detect.scan_text(df, detectors=(*detect.REGISTRY, ticket)), ("text",)).collect()
    assert [(r.type, r.value) for r in rows] == [("TICKET", "TCK-1234")]


def test_custom_detector_without_gate(spark, tmp_path):
    from cloakframe.plans.registry import QUERIES

    values = ["abcdef" * 6, "a1b2c3d4" * 4, "0123" * 8]
    rows = [(i, f"see {v} now", "en", "s") for i, v in enumerate(values)] + [(3, "abcdef", "en", "s"), (4, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["custom_detector"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n, r.first_start, r.first_value) for r in got) == [(i, 1, 4, v) for i, v in enumerate(values)]


@pytest.mark.parametrize("number,ok", [("4532015112830366", True), ("1234567890123456", False), ("42", False)])
def test_luhn(spark, number, ok):
    from cloakframe.functions.text import luhn_valid
    assert spark.createDataFrame([(number,)], "s string").select(luhn_valid(F.col("s"))).first()[0] is ok
