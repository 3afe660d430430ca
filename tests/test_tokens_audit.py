"""Numbering, redaction, restoring and the proof."""

import random

from pyspark.sql import functions as F

from cloakframe.operators import audit, tokens
from cloakframe.operators.spans import explode_spans
from cloakframe.plans import privacy

SPANS = ("session_id string, step_no bigint, element_pos int, element_id string, span_ord int, field string, "
         "type string, value string, start int, `end` int, confidence double, method string, field_ord int")


def elements_of(spark, rows):
    return spark.createDataFrame(
        [(s, n, p, f"e_{p}", t) for s, n, p, t in rows],
        "session_id string, step_no bigint, element_pos int, element_id string, text string")


def test_numbering_follows_first_sight_per_session(spark):
    z = privacy.sanitize(elements_of(spark, [
        ("b", 0, 0, "x@m.example y@m.example"), ("a", 1, 0, "y@m.example"), ("a", 0, 1, "long.name@m.example z@m.example"),
        ("a", 0, 0, "x@m.example"), ("a", 2, 0, "x@m.example 203.45.67.89")]))
    got = {(r.session_id, r.token): r.value for r in z.vault.collect()}
    assert got == {
        ("a", "[EMAIL_1]"): "x@m.example", ("a", "[EMAIL_2]"): "long.name@m.example", ("a", "[EMAIL_3]"): "z@m.example",
        ("a", "[EMAIL_4]"): "y@m.example", ("a", "[IP_1]"): "203.45.67.89",
        ("b", "[EMAIL_1]"): "x@m.example", ("b", "[EMAIL_2]"): "y@m.example"}
    texts = {(r.session_id, r.step_no, r.element_pos): r.text for r in z.redacted.collect()}
    assert texts["a", 0, 1] == "[EMAIL_2] [EMAIL_3]" and texts["a", 2, 0] == "[EMAIL_1] [IP_1]"


def test_huge_groups_get_the_same_numbers(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.randint(0, 5)}", i, 0, f"u{rng.randint(0, 400)}@m.example")
            for i in range(600)]
    found = privacy.scan(elements_of(spark, rows))
    plain, cut = tokens.build_vault(found), tokens.build_vault(found, group_limit=20)
    assert plain.count() > 100
    assert plain.exceptAll(cut).count() == 0 and cut.exceptAll(plain).count() == 0
    dense = cut.groupBy("session_id", "type").agg(F.max("token_no").alias("m"), F.count("*").alias("n"))
    assert dense.where("m <> n").count() == 0


def test_literal_replacement_longest_first(spark):
    text = "User A$1 Rao (a.rao@m.example) paid a.rao@ybl \\1"
    e = elements_of(spark, [("s", 0, 0, text)])
    rows = [("NAME", "A$1 Rao", 5), ("EMAIL", "a.rao@m.example", 14), ("UPI", "a.rao@ybl", 36), ("NAME", "\\1", 46)]
    spans = spark.createDataFrame(
        [("s", 0, 0, "e_0", i, "text", t, v, s, s + len(v), 1.0, "NER", 0) for i, (t, v, s) in enumerate(rows)], SPANS)
    vault = tokens.build_vault(spans)
    red = tokens.redact(e, spans, vault)
    got = red.first()
    assert got.text == "User [NAME_1] ([EMAIL_1]) paid [UPI_1] [NAME_2]"
    assert got.redacted_tokens == ["[EMAIL_1]", "[UPI_1]", "[NAME_1]", "[NAME_2]"]
    assert tokens.restore(red, vault).first().text == text


def test_shorter_value_inside_longer_is_not_reported(spark):
    spans = spark.createDataFrame(
        [("s", 0, 0, "e_0", 0, "text", "EMAIL", "asha@m.example", 0, 14, 1.0, "REGEX", 0),
         ("s", 0, 0, "e_0", 1, "text", "NAME", "asha", 0, 4, 0.9, "NER", 0)], SPANS)
    red = tokens.redact(elements_of(spark, [("s", 0, 0, "asha@m.example")]), spans, tokens.build_vault(spans)).first()
    assert red.text == "[EMAIL_1]" and red.redacted_tokens == ["[EMAIL_1]"]


def test_password_inputs_are_overwritten(spark):
    e = spark.createDataFrame(
        [("s", 0, 0, "e_0", "dots", "hunter2", "password", None), ("s", 0, 1, "e_1", None, "hunter2", "text", "new-password"),
         ("s", 0, 2, "e_2", "plain", "v", "text", "")],
        "session_id string, step_no bigint, element_pos int, element_id string, text string, value string, type string, autocomplete string")
    z = privacy.sanitize(e)
    rows = {r.element_id: r for r in z.redacted.collect()}
    for name in ("e_0", "e_1"):
        assert rows[name].value == "[PASSWORD_FIELD]" and rows[name].is_redacted
    assert rows["e_2"].value == "v" and not rows["e_2"].is_redacted
    assert z.audit.where("type = 'PASSWORD_FIELD'").count() == 2


def test_round_trip_and_proof_over_random_pages(spark):
    rng = random.Random(11)
    words = ["hello", "order", "été", "\U0001f600", "[x]", "a\u0001b", "\u0002a"]
    def text():
        parts = [rng.choice(words) if rng.random() < 0.7 else f"u{rng.randint(0, 50)}@m.example" for _ in range(12)]
        return " ".join(parts)
    e = elements_of(spark, [(f"s{i % 4}", i // 4, 0, text()) for i in range(200)])
    z = privacy.sanitize(e)
    assert z.report.where("not safe").count() == 0
    back = tokens.restore(z.redacted, z.vault).select("session_id", "step_no", "text")
    assert back.exceptAll(e.select("session_id", "step_no", "text")).count() == 0
    check = tokens.structure_check(e, z.redacted).first()
    assert (check.n_raw, check.n_redacted, check.n_unmatched, check.n_changed) == (200, 200, 0, 0)


def test_leak_search_equals_direct_comparison(spark):
    rng = random.Random(5)
    letters = "abé@\n"
    values = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(60)}
    vault = spark.createDataFrame([(f"s{i % 2}", f"[T_{i}]", v) for i, v in enumerate(sorted(values))],
                                  "session_id string, token string, value string")
    e = elements_of(spark, [(f"s{i % 3}", i, 0, "".join(rng.choice(letters) for _ in range(60))) for i in range(150)])
    key = ["session_id", "step_no", "token"]
    found = audit.leaks(e, vault).select(*key)
    brute = {(r.session_id, r.step_no, v.token) for r in e.collect() for v in vault.collect()
             if v.session_id == r.session_id and len(v.value) >= 3 and v.value in r.text}
    assert len(brute) > 20
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute
    shorter = {(r.session_id, r.step_no, r.token) for r in audit.leaks(e, vault, min_secret=1).collect()}
    assert shorter == {(r.session_id, r.step_no, v.token) for r in e.collect() for v in vault.collect()
                       if v.session_id == r.session_id and v.value in r.text}
    across = audit.leaks_across_sessions(e, vault)
    brute = {(r.step_no, v.token) for r in e.collect() for v in vault.collect() if len(v.value) >= 3 and v.value in r.text}
    assert {(r.step_no, r.token) for r in across.collect()} == brute


def test_unsafe_rows_are_blocked(spark, tmp_path):
    from cloakframe.sources.snapshots import guarded_write
    vault = spark.createDataFrame([("s", "[NAME_1]", "Asha Rao")], "session_id string, token string, value string")
    e = elements_of(spark, [("s", 0, 0, "hi [NAME_1]"), ("s", 1, 0, "hi Asha Rao"), ("t", 1, 0, "Asha Rao elsewhere")])
    guarded_write(e, vault, f"{tmp_path}/out", f"{tmp_path}/held")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.session_id, r.step_no) for r in out.collect()} == {("s", 0), ("t", 1)}
    assert spark.read.parquet(f"{tmp_path}/held").first().text == "hi Asha Rao"


def test_tokens_resolve_in_their_own_session_only(spark):
    vault = spark.createDataFrame([("a", "[EMAIL_1]", "x")], "session_id string, token string, value string")
    asked = spark.createDataFrame([("a", "[EMAIL_1]", "a"), ("a", "[EMAIL_1]", "b"), ("a", "[EMAIL_9]", "a")],
                                  "session_id string, token string, caller_session string")
    got = {(r.token, r.caller_session): (r.value, r.status) for r in tokens.resolve_tokens(asked, vault).collect()}
    assert got == {("[EMAIL_1]", "a"): ("x", "resolved"), ("[EMAIL_1]", "b"): (None, "rejected"),
                   ("[EMAIL_9]", "a"): (None, "not_found")}


def test_extra_spans_are_merged_per_field(spark):
    e = elements_of(spark, [("s", 0, 0, "Asha asha@m.example")])
    extra = spark.createDataFrame(
        [("s", 0, 0, "e_0", "text", "NAME", "Asha", 0, 4, 0.9, "NER"), ("s", 0, 0, "e_0", "text", "NAME", "asha", 5, 9, 0.9, "NER")],
        "session_id string, step_no bigint, element_pos int, element_id string, field string, type string, value string, "
        "start int, `end` int, confidence double, method string")
    z = privacy.sanitize(e, extra)
    assert z.redacted.first().text == "[NAME_1] [EMAIL_1]"


def test_locked_vault_shows_nothing(spark):
    rows = spark.createDataFrame([("a", "Email", False), ("a", "PAN", False), ("b", "email", True)],
                                 "session_id string, field string, locked boolean")
    got = {r.session_id: r for r in tokens.availability(rows).collect()}
    assert got["a"].has_email and got["a"].has_pan and not got["a"].has_card
    assert got["b"].locked and not got["b"].has_email


def test_vault_encryption(spark):
    v = spark.createDataFrame([("a", "[EMAIL_1]", "x@m.example"), ("a", "[EMAIL_2]", "x@m.example")],
                              "session_id string, token string, value string")
    key = F.lit("0123456789abcdef0123456789abcdef")
    stored = tokens.encrypt_vault(v, key).cache()
    assert stored.select("value").distinct().count() == 2
    assert tokens.decrypt_vault(stored, key).exceptAll(v).count() == 0


def test_explode_keeps_listed_order(spark):
    df = spark.createDataFrame([(1, [("value", "A", "x", 3, 4, 1.0, "R"), ("text", "B", "y", 0, 1, 1.0, "R")]), (2, [])],
                               "n int, spans array<struct<field:string,type:string,value:string,start:int,`end`:int,confidence:double,method:string>>")
    rows = explode_spans(df, ("n",)).orderBy("span_ord").collect()
    assert [(r.n, r.type, r.field_ord) for r in rows] == [(1, "A", 2), (1, "B", 0)]
