"""Pages as element tables: one row per element of the parsed page, with its path, depth, own text and attributes."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IRRELEVANT_TAGS

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TEXT_CUT = 500
#: Pages of a batch that are parsed together (bounds a task's memory).
PAGES = 200
COLUMNS = "page_id long, ord long, hpid string, tag_name string, depth int, element_id string, class_name string, text_content string, attributes map<string,string>"


#: Part of a path that stands for the border of a shadow root.
BORDER = "0"


def depth(hpid: str) -> int:
    """Levels below the first element; the border of a shadow root is none."""
    return sum(part != BORDER for part in hpid.split(".")) - 1


class _Elements(HTMLParser):
    """Collects accepted elements below body; a pruned tag takes its subtree along.

    An open declarative shadow root is a scope of its own: its elements are counted from one behind a border, its end and its texts touch nothing outside, and a
    host has one at most (a second one, or a closed one, is a template like others).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[dict] = []
        self.pruned = 0
        self.top = {"hpid": "", "children": 0, "tag": "", "row": None, "pruned": False}

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head"):
            return
        inside = next((k for k in range(len(self.stack), 0, -1) if self.stack[k - 1].get("border")), 0)
        if tag in ENDS_PARAGRAPH and any(s["tag"] == "p" for s in self.stack[inside:]):
            self.handle_endtag("p")
        if tag == "li" and self.stack and self.stack[-1]["tag"] == "li":
            self.handle_endtag("li")
        prune = self.pruned > 0 or tag in IRRELEVANT_TAGS
        parent = self.stack[-1] if self.stack else self.top
        if tag == "template" and parent["row"] and not parent.get("shadow") and (dict(attrs).get("shadowrootmode") or "").lower() == "open":
            parent["shadow"] = True
            self.stack.append({"hpid": f"{parent['hpid']}.{BORDER}", "children": 0, "tag": tag, "row": None, "pruned": False, "border": True})
            return
        row = None
        hpid = ""
        if not prune:
            if tag != "body" and not self.stack:
                return  # nothing outside the body counts
            parent["children"] += 1
            hpid = f"{parent['hpid']}.{parent['children']}" if parent["hpid"] else "1"
            given = {k: v or "" for k, v in attrs}
            row = {"hpid": hpid, "tag_name": tag, "depth": depth(hpid), "element_id": given.get("id") or None, "class_name": given.get("class") or None, "text": [], "attributes": given}
            self.rows.append(row)
        if tag not in VOID:
            self.stack.append({"hpid": hpid, "children": 0, "tag": tag, "row": row, "pruned": prune})
            self.pruned += prune

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].get("border") and tag != "template":
                return  # the end of something outside the shadow root
            if self.stack[k]["tag"] == tag:
                self.pruned -= sum(s["pruned"] for s in self.stack[k:])
                del self.stack[k:]
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1]["row"] is not None:
            self.stack[-1]["row"]["text"].append(data)


def parse(html: str | None) -> list[dict]:
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    for row in parser.rows:
        text = "".join(row.pop("text")).strip()
        row["text_content"] = (text[:TEXT_CUT] + "..." if len(text) > TEXT_CUT else text) or None
    return sorted(parser.rows, key=lambda row: [int(part) for part in row["hpid"].split(".")])  # what is in a host's shadow root comes before its children


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The element table of all pages."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]

    def run(batches):
        for batch in (whole.slice(k, PAGES) for whole in batches for k in range(0, whole.num_rows, PAGES)):
            rows = [{"page_id": p, "ord": k, **e} for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, e in enumerate(parse(h), 1)]
            arrays = [pa.array([list(r[n].items()) if n == "attributes" else r[n] for r in rows], t) for n, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pages.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(run, COLUMNS)
