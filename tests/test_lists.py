"""Styles of nested lists against a loop that writes the outer list before the inner ones."""

from __future__ import annotations

import random
from xml.etree import ElementTree

from quire.operators.elements import convert_lists
from quire.sources.corpus import explode_elements

STYLES = ("", "", "", "letters", "numbers", "symbols", "hanging", "empty", "format %d.", "format a", "odd", " letters ")


def nested(rng: random.Random, depth: int) -> str:
    if depth == 0:
        return ""
    tag = rng.choice(["list", "list", "list", "list", "ol", "ul", "dl", "t"])
    attrs = f' style="{rng.choice(STYLES)}"' if tag == "list" and rng.random() < 0.7 else rng.choice(["", ' type="i"', ' type="A"', ' type="1"']) if tag == "ol" else ""
    if tag == "list" and rng.random() < 0.3:
        attrs += ' counter="c"'
    return f"<{tag}{attrs}>" + "".join(nested(rng, rng.randint(0, depth - 1)) for _ in range(2)) + f"</{tag}>"


def expected(xml: str) -> list:
    out = []

    def walk(e, around):
        tag, attrs = e.tag, dict(e.attrib)
        if tag == "list":
            style, counter = attrs.pop("style", "").strip(), attrs.pop("counter", None)
            if style == "" and around is None:
                tag, attrs = "ul", {"empty": "true"}
            elif style == "":
                tag, attrs = around[0], {}
                if tag == "ol":
                    attrs["type"] = around[1].swapcase() if around[1] in ("a", "A", "i", "I") else around[1]
            elif style == "empty":
                tag, attrs = "ul", {"empty": "true"}
            elif style == "hanging":
                tag, attrs = "dl", {}
            elif style in ("numbers", "letters") or style.startswith("format"):
                tag, attrs = "ol", {"type": {"numbers": "1", "letters": "a"}.get(style, style[7:])}
            else:
                tag, attrs = "ul", {}
            if tag == "dl":
                attrs["newline"] = "false"
            if tag == "ol" and counter is not None:
                attrs["group"] = counter
        out.append((tag, attrs))
        inner = (tag, attrs.get("type", "1")) if tag in ("ol", "ul", "dl") else around
        for x in e:
            walk(x, inner)

    walk(ElementTree.fromstring(xml), None)
    return out


def test_lists_take_the_style_around_them(spark):
    rng = random.Random(5)
    docs = {str(i): f"<rfc>{nested(rng, 7)}{nested(rng, 5)}</rfc>" for i in range(60)}
    got: dict = {}
    el = explode_elements(spark.createDataFrame(list(docs.items()), "doc_id string, xml string"))
    out = convert_lists(el)
    assert out.columns == el.columns
    for r in sorted(out.collect(), key=lambda r: r.node_id):
        got.setdefault(r.doc_id, []).append((r.tag, r.attrs))
    assert got == {i: expected(x) for i, x in docs.items()}
    assert sum(t == "ol" for x in got.values() for t, _ in x) > 50
    assert convert_lists(el.limit(0)).count() == 0
