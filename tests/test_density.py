"""Bodies by text density against a plain recursion, and on pages without a known place."""

import pytest

from corpusflow.plans import fixtures as X
from corpusflow.runtime import TEXT_ROWS
from corpusflow.sources import html as HT
from corpusflow.sources import jsondocs as JS

PROSE = "The council met on Monday and agreed on the plan for the harbour, which had been open for two years. " * 3
LINKS = "".join(f'<li><a href="/{i}">Another story with a rather long headline number {i}</a></li>' for i in range(30))


def plain(root):
    """Worth of every element by recursion over its own text; returns the text of the best or None."""

    def strings(node, inside):
        for c in node.children:
            if isinstance(c, str):
                yield len(" ".join(c.split())), inside
            elif c.tag in HT.INLINE:
                yield from strings(c, inside or c.tag == "a")

    found = []

    def worth(node, depth, inside):
        here = inside or node.tag == "a"
        at = len(found)
        found.append(None)
        own = list(strings(node, here)) if node.tag not in HT.INLINE or depth == 0 else []
        n, m = sum(x for x, _ in own), sum(x for x, a in own if a)
        total = n - 2 * m - HT.BLOCK_COST if n else 0
        for c in node.children:
            if not isinstance(c, str):
                total += worth(c, depth + 1, here)
        found[at] = (total, depth, node)
        return total

    worth(root, 0, False)
    able = [(t, d, -i, n) for i, (t, d, n) in enumerate(found) if t > 0 and n.tag not in HT.INLINE]
    most = max((t for t, *_ in able), default=None)
    able = [x for x in able if x[0] == most]
    # of equals those that hold no other of them, and of these the first in the page
    able = [x for x in able if not any(y is not x and HT._above(x[3], y[3]) for y in able)]
    return max(able, key=lambda x: x[2])[3] if able else None


def test_the_one_pass_equals_a_recursion(spark, sf):
    pages = [r.html for r in X.read(spark, sf, "pages").select("html").collect()]
    pages += ["", "<p>short</p>", f"<div><div><p>{PROSE}</p></div></div>", f"<section><p>{PROSE}</p></section><section><p>{PROSE}</p></section>", f"text alone {PROSE}"]
    pages += [f"<a href='/x'><div>{PROSE}</div></a>", f"<div>{PROSE}<b>bold <p>{PROSE}</p></b><a href='/y'>go</a></div>", f"<ul>{LINKS}</ul>"]
    some = 0
    for html in pages:
        root = HT.tree(html)
        root.remove(HT.NOISE)
        want, got = plain(root), HT.densest(root)
        assert got is want, html[:200]
        some += got is not None
    assert some > 3


def test_bodies_without_a_known_place(spark):
    page = f'<body><div class="menu"><ul>{LINKS}</ul></div><div id="x7"><h1>Harbour plan</h1><p>{PROSE}</p><p>{PROSE}</p></div><div>{LINKS}</div><p>Imprint</p></body>'
    known = f"<body><article><p>{PROSE}{PROSE}</p></article><div><p>{PROSE * 4}</p></div></body>"
    thin = f"<body><article>Short teaser.</article><div><p>{PROSE}</p></div></body>"
    deep = "<div>" * 5_000 + f"<p>{PROSE}</p>" + "</div>" * 5_000
    rows = [(1, page), (2, known), (3, thin), (4, f"<ul>{LINKS}</ul>"), (5, None), (6, ""), (7, deep)]
    got = {r.page_id: (r.body, r.extractor) for r in HT.dense_bodies(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    squeezed = " ".join(PROSE.split())
    assert got[1] == (f"Harbour plan {squeezed} {squeezed}", "density")
    assert got[2] == (f"{squeezed} {squeezed}", "article")
    assert got[3] == (squeezed, "density") and got[7] == (squeezed, "density")
    assert got[4] == got[5] == got[6] == ("", None)


def test_bodies_that_the_places_fill_stay(spark, sf):
    pages = X.read(spark, sf, "pages")
    places = {r.page_id: (r.body, r.extractor) for r in HT.page_bodies(pages).collect()}
    dense = {r.page_id: (r.body, r.extractor) for r in HT.dense_bodies(pages).collect()}
    assert places.keys() == dense.keys()
    for k, (body, place) in places.items():
        assert dense[k] == (body, place) if len(body) >= 500 else len(dense[k][0]) >= len(body)


@pytest.mark.parametrize("scan", [HT.dense_bodies, HT.anchors, JS.embedded_articles, JS.state_bodies, JS.json_ld_articles])
def test_pages_come_in_small_batches(spark, scan):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    scan(spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string"))
    small = int(spark.conf.get(key)) <= TEXT_ROWS
    spark.conf.set(key, before)
    assert small


def test_one_tree_is_held_at_a_time():
    """A tree that was taken apart goes by itself, without a search for cycles."""
    import gc
    import weakref

    from corpusflow.sources import html as HT

    class Watched(HT.Node):
        __slots__ = ("__weakref__",)

    gc.collect()
    gc.disable()
    try:
        root = Watched("#root")
        seen = [weakref.ref(root)]
        at = root
        for _ in range(5_000):
            child = Watched("div", (), at)
            at.children += ["text", child]
            seen.append(weakref.ref(child))
            at = child
        root.free()
        del root, at, child
        assert not any(ref() for ref in seen)
    finally:
        gc.enable()


def test_long_pages_come_in_batches_of_few_bytes(spark):
    from pyspark.sql import functions as F

    from corpusflow.runtime import text_batches

    text_batches(spark)
    pages = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("html"))  # 60 MB in one part

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    got = [r.n for r in pages.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 60 and max(got) <= 18
