"""Field extraction from marked-up records held in a string column
(S2-S6). Regular expressions run per row in the JVM; the XML *file* source
is in :mod:`lexframe.sources.files`.

Like a DOM reader that takes ``firstChild.data``, only the text directly
after an opening tag counts: an element-first child or an empty or
self-closing element yields nothing, text after an inner element is not
collected. The five predefined entities are decoded. A block's end is found
by counting the tags of its name, so blocks may nest; the items of a nested
block belong to the outer one as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes of an open tag: quoted values may hold any character; a slash counts only before the end.
_ATTRIBUTES = r"""((?:\s(?:[^>"'/]|"[^"]*"|'[^']*'|/(?!>))*)?)"""


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unescape(c: Column) -> Column:
    """Decode the five predefined entities, the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def _value(attributes: Column, attr: str) -> Column:
    both = F.regexp_extract(attributes, f"""\\s{attr}\\s*=\\s*("[^"]*"|'[^']*')""", 1)
    return unescape(F.substring(both, F.lit(2), F.greatest(F.length(both) - 2, F.lit(0))))


def attribute(c: str | Column, tag: str, attr: str) -> Column:
    """Value of ``attr`` on the first ``tag`` element, ``''`` if that one
    has none."""
    return _value(F.regexp_extract(_c(c), f"<{tag}{_ATTRIBUTES}/?>", 1), attr)


def _open(tag: str) -> str:
    return f"<{tag}{_ATTRIBUTES}>"


def tag_texts(c: str | Column, tag: str) -> Column:
    """S3: first text child of every ``tag`` element at any depth."""
    raw = F.regexp_extract_all(_c(c), F.lit(_open(tag) + "([^<]*)"), 2)
    return F.transform(F.filter(raw, lambda x: x != ""), unescape)


def nested_texts(c: str | Column, tag: str, inner: str) -> Column:
    """First text child of every ``inner`` inside every ``tag`` block, in
    the order of the blocks."""
    marks = F.regexp_extract_all(_c(c), F.lit(f"{_open(tag)}|</{tag}\\s*>|{_open(inner)}[^<]*"), 0)
    opens = lambda t: t.rlike(f"^<{tag}[\\s>]")
    none = F.array().cast("array<string>")
    begin = F.struct(F.lit(1).alias("depth"), none.alias("out"))

    def step(acc: Column, t: Column) -> Column:
        text = F.regexp_extract(t, _open(inner) + "([^<]*)", 2)
        closed, item = t.startswith("</"), ~opens(t) & ~t.startswith("</") & (text != "")
        depth = acc["depth"] + F.when(closed, -1).when(opens(t), 1).otherwise(0)
        inside = acc["depth"] > 0
        return F.struct(F.when(inside, depth).otherwise(acc["depth"]).alias("depth"),
                        F.when(inside & item, F.concat(acc["out"], F.array(text))).otherwise(acc["out"]).alias("out"))

    def block(t: Column, i: Column) -> Column:
        rest = F.slice(marks, i + 2, F.greatest(F.size(marks) - i - 1, F.lit(0)))
        return F.when(opens(t), F.aggregate(rest, begin, step)["out"]).otherwise(none)

    return F.transform(F.flatten(F.transform(marks, block)), unescape)


def outer_attributes(c: str | Column, tag: str, attr: str) -> Column:
    """``attr`` of every ``tag`` element (``''`` where missing)."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit(f"<{tag}{_ATTRIBUTES}/?>"), 1), lambda o: _value(o, attr))


def zip_classification(section: Column, cls: Column, subclass: Column, main: Column, sub: Column) -> Column:
    """``section+class+subclass + ' ' + main/sub`` by position; stop at
    the first position missing a class part; the group part is ``''`` when
    either group list is short there."""
    n = F.least(F.size(section), F.size(cls), F.size(subclass))
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def one(i):
        groups = F.when((i < F.size(main)) & (i < F.size(sub)),
                        F.concat(F.get(main, i), F.lit("/"), F.get(sub, i))).otherwise(F.lit(""))
        return F.concat(F.get(section, i), F.get(cls, i), F.get(subclass, i), F.lit(" "), groups)

    return F.transform(idx, one)


def cited_edges(items: Column) -> Column:
    """S6: "code num year" of every complete cited item (array<struct<code,
    num, year>>); incomplete items are skipped."""
    complete = F.filter(items, lambda x: x["code"].isNotNull() & x["num"].isNotNull() & x["year"].isNotNull())
    return F.transform(complete, lambda x: F.concat_ws(" ", x["code"], x["num"], x["year"]))
