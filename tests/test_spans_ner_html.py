"""Span merging, entity post-processing, pages and snapshot diffs."""

import random

from pyspark.sql import functions as F

from cloakframe.operators import incremental, ner, spans
from cloakframe.operators.detect import scan_elements
from cloakframe.sources import html

ARRAY = "array<struct<field:string,type:string,value:string,start:int,`end`:int,confidence:double,method:string>>"


def span(rng, method):
    s = rng.randint(0, 40)
    return ("text", rng.choice("AB"), "v", s, s + rng.randint(1, 8), rng.choice([0.5, 0.7, 0.9, 1.0]), method)


def test_merge_equals_one_by_one(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        base, at = [], 0
        for _ in range(rng.randint(0, 4)):
            s = at + rng.randint(0, 9)
            base.append(("text", "A", "v", s, s + 3, rng.choice([0.6, 1.0]), "REGEX"))
            at = s + 3
        rows.append((i, base, sorted((span(rng, "NER") for _ in range(rng.randint(0, 4))), key=lambda x: x[3])))
    df = spark.createDataFrame(rows, f"n int, b {ARRAY}, x {ARRAY}")
    got = {r.n: [tuple(s) for s in r.spans] for r in spans.merge_span_arrays(df, "b", "x").collect()}
    for n, base, extra in rows:
        kept = list(base)
        for e in extra:
            at = next((i for i, k in enumerate(kept) if e[3] < k[4] and e[4] > k[3]), None)
            if at is None:
                kept.append(e)
            elif e[5] > kept[at][5]:
                kept[at] = e
        assert sorted(got[n], key=lambda k: (k[3], k[4], k)) == sorted(kept, key=lambda k: (k[3], k[4], k))
        assert [s[3] for s in got[n]] == sorted(s[3] for s in got[n])


def test_dedupe_keeps_the_surer(spark):
    rng = random.Random(6)
    rows = [(d, rng.choice(["NAME", "ADDRESS"]), "v", s := rng.randint(0, 60), s + rng.randint(1, 9), rng.choice([0.8, 0.9, 0.95]))
            for d in range(40) for _ in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, type string, value string, start int, `end` int, confidence double")
    got = {}
    for r in ner.dedupe_spans(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.type, r.confidence))
    for d in range(40):
        kept = []
        for s, e, t, c in sorted((r[3], r[4], r[1], r[5]) for r in rows if r[0] == d):
            if kept and s >= kept[-1][0] and e <= kept[-1][1] + 5 and t == kept[-1][2]:
                if c > kept[-1][3]:
                    kept[-1] = (s, e, t, c)
            else:
                kept.append((s, e, t, c))
        assert sorted(got[d]) == sorted(kept)


def test_entities(spark):
    rows = [(0, "Ash", "B-PER", 0.99, 0, 3), (1, "##a", "I-PER", 0.9, 3, 4), (2, "Rao", "I-PER", 0.95, 5, 8), (3, "Pune", "B-LOC", 0.9, 12, 16),
            (4, "##x", "B-ORG", 0.8, 16, 17), (5, "Rao", "I-PER", 0.7, 20, 23), (6, "B", "B-PER", 0.8, 30, 31), (7, "C", "B-PER", 0.8, 33, 34)]
    df = spark.createDataFrame([(1, 0, *r) for r in rows], "doc_id int, chunk_no int, pos int, word string, entity string, score double, start int, `end` int")
    got = [(r.word, r.entity, r.score, r.start, r.end) for r in ner.merge_tokens(df).orderBy("entity_no").collect()]
    assert got == [("Asha Rao", "PER", 0.9, 0, 8), ("Punex", "LOC", 0.8, 12, 17), ("Rao", "PER", 0.7, 20, 23),
                   ("B", "PER", 0.8, 30, 31), ("C", "PER", 0.8, 33, 34)]


def test_entity_rules(spark):
    cases = [("Asha Rao", "PER", 0.80, "profile-card", True), ("Asha Rao", "PER", 0.80, "main", False), ("Asha Rao", "PER", 0.95, "main", True),
             ("Amazon", "PER", 0.99, "profile", False), ("the", "PER", 0.99, "profile", False), ("A", "PER", 0.99, "profile", False),
             ("Pune", "LOC", 0.85, "x", True), ("Pune", "LOC", 0.85, "city filter", False), ("India", "LOC", 0.9, "x", False),
             ("India", "LOC", 0.9, "shipping", True), ("Acme", "ORG", 0.95, "employer", True), ("Acme", "ORG", 0.95, "x", False),
             ("X1", "MISC", 0.99, "profile", False), ("Asha Rao", "PER", 0.80, "my-account", True)]
    df = spark.createDataFrame(cases, "word string, entity string, score double, cls string, expected boolean")
    ctx = ner.context_words(F.col("cls"), F.lit(""), F.lit("div"), F.lit(None).cast("string"))
    for r in df.withColumn("keep", ner.keep_entity(F.col("word"), F.col("entity"), F.col("score"), ctx)).collect():
        assert r.keep == r.expected, r


def test_chunks_point_into_the_text(spark):
    text = "  ".join(f"w{i}" for i in range(700))
    df = spark.createDataFrame([(1, text), (2, "short one"), (3, "")], "doc_id int, text string")
    rows = ner.chunk_text(df).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.chunk_no) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    for r in rows[:3]:
        first = r.chunk_text.split(" ")[0]
        assert first == f"w{257 * r.chunk_no}" and text[r.start_offset:].startswith(first)
    assert rows[3].chunk_text == "short one"


PAGE = """<html><head><title> Shop </title></head><body><nav class="top bar"><a href="/a?x=1&amp;y=2">Home</a></nav>
<form id="f" method="POST"><label for="em">Email</label><input id="em" type="email" placeholder="you" autocomplete="email" value="a@b.example">
<label>Pass <input type="password" name="pw"></label><label>Q</label><input type="search" class="q x">
<p><div style="display: none"><button>Ghost</button></div><select name="s"><option value="1">One<option value="2" selected>Two</select>
<textarea name="t">note</textarea></p></form><div role="button" tabindex="0"><b>Go</b> now</div><span onclick="x()">s</span><a>no link</a></body></html>"""


def test_page_elements_and_forms(spark):
    pages = spark.createDataFrame([(1, "http://x.example/", PAGE), (2, "http://y.example/", None)], "page_id bigint, url string, html string")
    rows = html.page_elements(pages).orderBy("element_pos").collect()
    assert [(r.id, r.tag, r.role) for r in rows] == [
        ("e_1", "A", "link"), ("e_2", "INPUT", "textbox"), ("e_3", "INPUT", "textbox"), ("e_search_4", "INPUT", "searchbox"),
        ("e_5", "SELECT", "listbox"), ("e_6", "TEXTAREA", "textbox"), ("e_7", "DIV", "button"), ("e_8", "SPAN", "generic")]
    by = {r.id: r for r in rows}
    assert by["e_1"].href == "/a?x=1&y=2" and by["e_1"].parent_class == "top bar" and by["e_1"].text == "Home"
    assert by["e_2"].selector == "#em" and by["e_2"].nearby_labels == "Email" and by["e_2"].value == "a@b.example"
    assert by["e_3"].nearby_labels == "Pass" and by["e_search_4"].nearby_labels == "Q"
    assert by["e_search_4"].selector == "html > body > form > input.q"
    assert by["e_5"].value == "2" and by["e_6"].value == "note" and by["e_6"].text is None and by["e_7"].text == "Go now"
    forms = html.page_forms(pages).collect()
    assert [(f.id, f.method, f.action, f.inputs) for f in forms] == [("f", "post", "", ["em", "pw", "s", "t"])]
    snap = {r.page_id: r for r in html.page_snapshots(pages).collect()}
    assert snap[1].title == "Shop" and snap[1].elements_count == 8 and snap[1].context_sufficient and not snap[2].context_sufficient


def test_incremental_scan_reuses_spans(spark):
    schema = "session_id string, step_no bigint, element_pos int, element_id string, text string, nearby_labels string"
    first = spark.createDataFrame([("s", 0, 0, "a", "u@m.example", None), ("s", 0, 1, "b", "9811122233", None), ("s", 0, 2, "c", "x", None)], schema)
    second = spark.createDataFrame([("s", 1, 0, "a", "u@m.example", None), ("s", 1, 1, "b", "9811122233", "Customer Care"),
                                    ("s", 1, 2, "c", "v@m.example", None), ("s", 1, 3, "d", "w@m.example", None)], schema)
    scanned = []
    def scan(df):
        scanned.append({r.element_id for r in df.collect()})
        return scan_elements(df)
    cache = incremental.scan_step(first, None, None, scan)
    after = incremental.scan_step(second, first, cache, scan)
    assert scanned == [{"a", "b", "c"}, {"b", "c", "d"}]
    fresh = scan_elements(second).select("session_id", "step_no", "element_pos", "element_id", "spans")
    assert after.count() == 4 and after.exceptAll(fresh).count() == 0
    both = first.unionByName(second)
    diff = {(r.step_no, r.element_id): r.change for r in incremental.diff_snapshots(both).collect()}
    assert diff == {(0, "a"): "new", (0, "b"): "new", (0, "c"): "new", (1, "a"): "unchanged", (1, "b"): "modified",
                    (1, "c"): "modified", (1, "d"): "new"}
    keys = ["session_id", "step_no", "element_id", "type", "value"]
    full = spans.explode_spans(scan_elements(both)).select(keys)
    assert incremental.incremental_spans(both).select(keys).exceptAll(full).count() == 0
    assert incremental.incremental_spans(both).count() == full.count()


def test_bad_pages_do_not_stop_the_job(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + '<a href="x">end</a>'
    pages = spark.createDataFrame([(1, "u", "<a href='a'>one</a><![foo[ x ]]><a href='b'>two</a>"), (2, "u", deep), (3, "u", None)],
                                  "page_id long, url string, html string")
    got = {r.page_id: r for r in html.page_snapshots(pages).collect()}
    assert got[2].error is None and got[2].elements[-1].text == "end" and got[3].elements_count == 0
    assert got[1].elements[0].text == "one"
    rows = html.page_elements(pages).collect()
    assert {r.page_id for r in rows} == {1, 2} and [r.page_id for r in rows if r.error] == [1] == [r.page_id for r in html.page_forms(pages).collect() if r.error]


def test_long_fields_stay_whole_unless_a_length_is_given(spark):
    mail, long = "jo@site.example", "x" * 300 + " "
    page = (f'<label for="a">{long}{mail}</label><textarea id="a">{long}{mail}</textarea><a href="/">{long}{mail}</a>'
            f'<input value="{long}{mail}"><button>{long}{mail}</button>')
    pages = spark.createDataFrame([(1, "http://x.example/", page)], "page_id bigint, url string, html string")
    whole = long + mail
    fields = lambda rows: [(e.tag, e.text, e.value, e.nearby_labels) for e in rows]
    expected = [("TEXTAREA", None, whole, whole), ("A", whole, None, None), ("INPUT", None, whole, None), ("BUTTON", whole, None, None)]
    assert fields(html.page_elements(pages).orderBy("element_pos").collect()) == expected
    assert fields(html.page_snapshots(pages).first().elements) == expected
    cut = [(t, a and a[:200], b and b[:150], c and c[:100]) for t, a, b, c in expected]
    assert fields(html.page_elements(pages, 200, 150, 100).orderBy("element_pos").collect()) == cut
    assert fields(html.page_snapshots(pages, max_text=200, max_value=150, max_label=100).first().elements) == cut
