"""Web pages as elements and forms.

Parsing HTML needs a real parser, so this is the one place where rows pass
through Python, in Arrow batches and page by page.  There is no layout engine:
coordinates are null, and an element counts as invisible only if it or an
ancestor is hidden by attribute or inline style.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "form", "h1", "h2", "h3", "article", "section",
                   "footer", "nav", "header"},
             "li": {"li"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}}
INTERACTIVE_TAGS = {"button", "input", "select", "textarea"}
INTERACTIVE_ROLES = {"button", "link", "searchbox", "checkbox", "radio"}
HIDDEN_STYLE = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)")

ELEMENT_ROW = (
    "page_id bigint, element_pos int, id string, tag string, selector string, role string, "
    "type string, placeholder string, href string, autocomplete string, text string, value string, "
    "parent_tag string, parent_class string, parent_id string, nearby_labels string, interactive boolean")
FORM_ROW = ("page_id bigint, form_pos int, id string, action string, method string, "
            "inputs array<string>")


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children", "parts", "hidden", "prev")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts, self.children = [], []
        self.prev = parent.children[-1] if parent is not None and parent.children else None
        style = attrs.get("style") or ""
        self.hidden = ((parent is not None and parent.hidden) or "hidden" in attrs
                       or bool(HIDDEN_STYLE.search(style))
                       or (tag == "input" and (attrs.get("type") or "").lower() == "hidden"))

    def text(self) -> str:
        """All text inside, in order; a loop, as pages nest tags without limit."""
        out, todo = [], list(reversed(self.parts))
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                out.append(part)
            else:
                todo.extend(reversed(part.parts))
        return "".join(out)


class _Page(HTMLParser):
    """Document order list of nodes with their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None)
        self.open, self.nodes = self.root, []

    def handle_starttag(self, tag, attrs):
        if self.open.tag in CLOSED_BY and tag in CLOSED_BY[self.open.tag]:
            self.open = self.open.parent
        node = _Node(tag, {k: (v if v is not None else "") for k, v in reversed(attrs)}, self.open)
        self.open.parts.append(node)
        self.open.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.parts.append(data)


def _parse(html: str | None) -> tuple[list[_Node], str | None]:
    """Nodes of a page up to its first fault, and the fault (null for a page that parses)."""
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError, IndexError, RecursionError) as fault:
        return page.nodes, f"{type(fault).__name__}: {fault}"
    return page.nodes, None


def _selector(node: _Node) -> str:
    if node.attrs.get("id"):
        return f"#{node.attrs['id']}"
    steps: list[str] = []
    while node is not None and node.tag != "#root" and len(steps) < 5:
        classes = (node.attrs.get("class") or "").split()
        steps.append(f"{node.tag}.{classes[0]}" if classes else node.tag)
        node = node.parent
    return " > ".join(reversed(steps))


def _label(node: _Node, by_target: dict[str, _Node], most: int | None) -> str | None:
    target = by_target.get(node.attrs.get("id") or "")
    if target is None:
        up = node
        while up is not None and up.tag != "label":
            up = up.parent
        target = up
    if target is None and node.prev is not None and node.prev.tag == "label":
        target = node.prev
    return (target.text().strip()[:most] or None) if target is not None else None


def _role(node: _Node) -> str:
    if node.attrs.get("role"):
        return node.attrs["role"]
    kind = (node.attrs.get("type") or "text").lower()
    if node.tag == "input":
        named = {"search": "searchbox", "submit": "button", "button": "button",
                 "checkbox": "checkbox", "radio": "radio"}
        return named.get(kind, "textbox")
    return {"a": "link", "button": "button", "select": "listbox", "textarea": "textbox"}.get(
        node.tag, "generic")


def _is_interactive(node: _Node) -> bool:
    a = node.attrs
    return (node.tag in INTERACTIVE_TAGS or (node.tag == "a" and "href" in a)
            or a.get("role") in INTERACTIVE_ROLES or "onclick" in a or "tabindex" in a)


def _value(node: _Node) -> str:
    if node.tag == "textarea":
        return node.text()
    if node.tag == "select":
        options = [n for n in node.children if n.tag == "option"]
        chosen = [n for n in options if "selected" in n.attrs] or options
        return chosen[0].attrs.get("value", chosen[0].text().strip()) if chosen else ""
    return node.attrs.get("value", "") if node.tag in ("input", "button") else ""


def _elements(nodes: list[_Node], max_text: int | None, max_value: int | None, max_label: int | None) -> Iterator[dict]:
    by_target: dict[str, _Node] = {}
    for n in nodes:
        if n.tag == "label" and n.attrs.get("for"):
            by_target.setdefault(n.attrs["for"], n)
    count = 0
    for n in nodes:
        if n.hidden or not _is_interactive(n):
            continue
        count += 1
        kind = n.attrs.get("type") or ""
        body = "" if n.tag in ("input", "textarea") else n.text().strip()[:max_text]
        up = n.parent if n.parent is not None and n.parent.tag != "#root" else None
        yield {
            "element_pos": count - 1,
            "id": f"e_search_{count}" if kind.lower() == "search" else f"e_{count}",
            "tag": n.tag.upper(), "selector": _selector(n), "role": _role(n), "type": kind or None,
            "placeholder": n.attrs.get("placeholder") or None, "href": n.attrs.get("href") or None,
            "autocomplete": n.attrs.get("autocomplete") or None, "text": body or None,
            "value": _value(n)[:max_value] or None, "parent_tag": up.tag if up else None,
            "parent_class": ((up.attrs.get("class") or "").strip() or None) if up else None,
            "parent_id": (up.attrs.get("id") or None) if up else None,
            "nearby_labels": _label(n, by_target, max_label), "interactive": True}


def _forms(nodes: list[_Node]) -> Iterator[dict]:
    forms = [n for n in nodes if n.tag == "form"]
    inputs: dict[int, list[str]] = {id(f): [] for f in forms}
    for n in nodes:
        name = n.attrs.get("name") or n.attrs.get("id")
        if n.tag in ("input", "select", "textarea") and name:
            up = n.parent
            while up is not None:
                if up.tag == "form":
                    inputs[id(up)].append(name)
                up = up.parent
    for i, f in enumerate(forms):
        yield {"form_pos": i, "id": f.attrs.get("id") or f"form-{i}", "action": f.attrs.get("action") or "",
               "method": (f.attrs.get("method") or "get").lower(), "inputs": inputs[id(f)]}


def _extract(pages: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows of each page; of a page with a fault, those before it, and one more that only has the fault in ``error``."""
    schema = f"{schema}, error string"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, html in zip(batch["page_id"], batch["html"]):
                nodes, error = _parse(html)
                rows += [{"page_id": pid, "error": None, **row} for row in rows_of(nodes)]
                if error:
                    rows.append(dict.fromkeys(names) | {"page_id": pid, "error": error})
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "html").mapInPandas(run, schema)


def page_elements(pages: DataFrame, max_text: int | None = None, max_value: int | None = None,
                  max_label: int | None = None) -> DataFrame:
    """Interactive, visible elements of each page in document order.

    Texts, values and labels are whole unless a greatest length is given (the
    reference has 200, 200 and 100); what is cut off is not seen by detection.
    """
    return _extract(pages, lambda nodes: _elements(nodes, max_text, max_value, max_label), ELEMENT_ROW)


def page_forms(pages: DataFrame) -> DataFrame:
    """Forms of each page with the names of their inputs."""
    return _extract(pages, _forms, FORM_ROW)


def page_snapshots(pages: DataFrame, max_text: int | None = None, max_value: int | None = None,
                   max_label: int | None = None) -> DataFrame:
    """One snapshot row per page, elements and forms nested, in a single pass.

    A page that cannot be parsed to its end keeps what was read, and ``error`` says why.
    The greatest lengths are those of ``page_elements``.
    """
    def nested(schema: str) -> str:
        fields = [part.split(" ", 1) for part in schema.split(", ")[1:]]
        return "array<struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">>"

    schema = f"page_id bigint, url string, title string, elements {nested(ELEMENT_ROW)}, forms {nested(FORM_ROW)}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                nodes, error = _parse(html)
                title = next((n.text().strip() for n in nodes if n.tag == "title"), "")
                rows.append((pid, url, title, list(_elements(nodes, max_text, max_value, max_label)), list(_forms(nodes)), error))
            yield pd.DataFrame(rows, columns=["page_id", "url", "title", "elements", "forms", "error"])

    return (pages.select("page_id", "url", "html").mapInPandas(run, schema)
            .withColumn("elements_count", F.size("elements"))
            .withColumn("context_sufficient", F.size("elements") > 0))


def page_links(pages: DataFrame) -> DataFrame:
    """Targets of ``<a href>`` in page order, without leaving the JVM."""
    pattern = r'(?i)<a\s+[^>]*?href="([^"]*)"'
    return pages.select("page_id", F.posexplode_outer(
        F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("link_no", "href")).where(
        F.col("href").isNotNull())


def infer_role(tag: Column, kind: Column, given: Column) -> Column:
    """Accessibility role of an element: the given one, else by tag and type."""
    t = F.lower(tag)
    k = F.lower(F.coalesce(F.when(kind != "", kind), F.lit("text")))
    return (F.when(F.coalesce(given, F.lit("")) != "", given)
            .when(t == "a", "link").when(t == "button", "button").when(t == "select", "listbox")
            .when(t == "textarea", "textbox")
            .when((t == "input") & (k == "search"), "searchbox")
            .when((t == "input") & k.isin("submit", "button"), "button")
            .when((t == "input") & k.isin("checkbox", "radio"), k)
            .when(t == "input", "textbox").otherwise("generic"))
