"""Main text of web pages: wrappers inferred per host by union-free alignment of its pages.

1. Every page is read into a tree of blocks (``html_tree``). Repeated siblings, and
   repeated groups of siblings, become one repeated node; what is left is the page's
   skeleton. Its texts are slots.
2. Pages of one host and skeleton are added up in the tasks and then by (host, skeleton,
   slot): pages, characters, characters in links, and whether the slot always says the same.
   So a host with a third of all pages is a few rows.
3. A host's skeletons are aligned, in order of their digest: nodes that stand in both are
   joined, mismatches become optional or repeated. Skeletons are dealt to groups of a few
   dozen, whose wrappers are aligned again, until one wrapper per host is left.
4. The wrapper says which slots are main text. The main part is the article or main
   element, else the deepest part that holds most of the host's text outside links; without
   menus, footers, asides, forms, adverts, notices, comments and hidden parts, which tags, roles
   and words of class and id tell, and without slots that say the same on all pages of a
   skeleton while its other slots vary.
5. Pages meet their host's wrapper and give the texts of its main slots. A page that the
   wrapper finds nothing in is judged by its own tree.

Inside a block white space (also non-breaking) becomes one space, br counts as white space; a
table cell, list item or heading is a block.

Defined results for odd input: null or empty html gives an empty text; a null url, or one
without "://", has the empty host; markup that ends early is read as far as it goes;
unclosed and misplaced tags end as browsers end them; repeated rows are extracted alike; an
empty table gives no rows; extra columns are ignored. Elements nested deeper than
``html_tree.DEEPEST`` belong to the one at that depth. A wrapper grows with the
variety of a host's markup, not with its pages.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import html_tree as H
from tidewave.llm.common import cut, require, table
from tidewave.llm.url_filter import canonical

#: Skeletons that one task aligns at a time.
GROUP = 48
#: Pages of a skeleton from which a slot that always says the same counts as furniture.
SAME_PAGES = 5
#: Sums a task holds before it passes them on.
HELD = 20_000
_SLOT = "host string, skeleton string, slot int, pages long, chars long, links long, low long, high long"


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per host, skeleton and slot over the pages of a task."""
    held: dict[tuple[str, str], list] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, s, i, *v) for (h, s), slots in held.items() for i, v in enumerate(slots)]
        held.clear()
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5]
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SLOT.split(", ")])

    for batch in batches:
        for host, source in zip(batch["host"].to_pylist(), batch["html"], strict=True):
            page = H.Page(source.as_py())
            tree = page.skeleton()
            # Slot 0 stands for the page as a whole.
            now = [(1, 0, 0, 0, 0)]
            for leaf in H.leaves(tree):
                said = [page.texts[i] for i in leaf[3]]
                mark = H.fingerprint("\n".join(said))
                now.append((1, sum(map(len, said)), sum(page.links[i] for i in leaf[3]), mark, mark))
            key = (host, json.dumps(H.shape(tree), separators=(",", ":"), ensure_ascii=False))
            old = held.get(key)
            if old is None:
                held[key] = [list(x) for x in now]
            else:
                for x, y in zip(old, now, strict=True):
                    x[:] = [x[0] + y[0], x[1] + y[1], x[2] + y[2], min(x[3], y[3]), max(x[4], y[4])]
        if len(held) > HELD:
            yield out()
    yield out()


def _grown(shape: list, slots: Iterator[dict]) -> list:
    """A shape with its leaves' sums."""
    if shape[0] == "#":
        return ["#", shape[1], [], next(slots)]
    return [shape[0], shape[1], [_grown(x, slots) for x in shape[2]], None]


def _first_tree(skeleton: str, slots: list[dict]) -> list:
    """The tree of one skeleton: its slots, and which of them always say the same while others vary."""
    slots = sorted(slots, key=lambda s: s["slot"])[1:]
    many = bool(slots) and slots[0]["pages"] >= SAME_PAGES
    tree = _grown(json.loads(skeleton), iter(slots))
    plain = [leaf[3] for leaf in _soft_leaves(tree)]
    vary = any(s["low"] != s["high"] for s in plain)
    digest = int(hashlib.md5(skeleton.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    for s in slots:
        s["constant"] = s["pages"] if many and vary and s["low"] == s["high"] else 0
        s["at"] = digest
    return _kept_sums(tree)


def _kept_sums(node: list) -> list:
    if node[0] == "#":
        return ["#", node[1], [], {k: node[3][k] for k in ("pages", "chars", "links", "constant", "at")}]
    return [node[0], node[1], [_kept_sums(x) for x in node[2]], None]


def _soft_leaves(node: list) -> list[list]:
    if node[0] == "#":
        return [node]
    return [] if H.hard(node[0]) else [x for c in node[2] for x in _soft_leaves(c)]


def _holds(node: list, what) -> bool:
    return what(node[0]) or any(_holds(x, what) for x in node[2])


def _tag(sign: str) -> str:
    return sign.lstrip("!").partition("@")[0].partition(".")[0]


def _is_main(sign: str) -> bool:
    return _tag(sign) in ("article", "main") or sign.endswith("@main") or sign.endswith("@article")


def mark_main(tree: list) -> list:
    """The wrapper with its leaves' sums replaced by whether they are main text; inner nodes say whether they lie in the main part."""

    def plain(node: list) -> int:
        return node[3]["chars"] - node[3]["links"] if node[0] == "#" else sum(map(plain, node[2]))

    whole_plain = plain(tree)

    def dropped(node: list, inside: bool) -> bool:
        sign, tag = node[0], _tag(node[0])
        head = tag == "header" or "header" in H.words_of(sign)
        if not H.hard(sign) and not (head and not inside):
            return False
        # What frames the main part, a main heading or most of the page may bear a layout's name; hidden parts and comments never do.
        if sign.startswith("!") or tag in H.HARD_TAGS or tag == "header" or "comment" in sign:
            return True
        if any(_holds(x, _is_main) for x in node[2]):
            return False
        names = {w for w in H.words_of(sign) if H.hard_word(w) or w == "header"}
        if any(w not in H.LAYOUT_WORDS and not w.endswith(tuple(H.LAYOUT_WORDS)) for w in names) or "@" in sign:
            return True
        frames = any(_holds(x, lambda s: _tag(s) == "h1" or any(w in H.MAIN_WORDS for w in H.words_of(s))) for x in node[2])
        return not (frames and not head or 10 * plain(node) >= 7 * whole_plain)

    def weight(node: list, inside: bool = False) -> float:
        if node[0] == "#":
            s = node[3]
            return 0.0 if 2 * s["constant"] > s["pages"] else max(0.0, s["chars"] - 2.0 * s["links"])
        return 0.0 if dropped(node, inside) else sum(weight(x, inside or _is_main(node[0])) for x in node[2])

    def mains(node: list) -> list[list]:
        if node[0] == "#" or dropped(node, False):
            return []
        below = [x for c in node[2] for x in mains(c)]
        if not _is_main(node[0]):
            return below
        # An article inside main speaks for it, if it holds at least half of it.
        return below if below and 2 * sum(weight(x, True) for x in below) >= weight(node, True) else [node]

    chosen = [x for x in mains(tree) if weight(x, True) > 0]
    by_tag = bool(chosen)
    if not chosen:
        whole = weight(tree)

        def named(node: list) -> list[list]:
            if node[0] == "#" or dropped(node, False) or 2 * weight(node) < whole or not whole:
                return []
            below = [x for c in node[2] for x in named(c)]
            own = any(w in H.MAIN_WORDS for w in H.words_of(node[0]))
            return below or ([node] if own else [])

        spot = (named(tree) or [tree])[0]
        while True:
            deeper = [x for x in spot[2] if x[0] != "#" and x[2] and not dropped(x, False) and 10 * weight(x) >= 7 * weight(spot) > 0]
            # A repeated or plain block of text is the text itself, no frame.
            if not deeper or _tag(deeper[0][0]) in ("p", "li", "td", "th", "dd", "dt", "pre", "tr", *H.HEADINGS):
                break
            spot = deeper[0]
        chosen = [spot]
    tops = {id(x) for x in chosen}

    def judged(node: list, inside: bool, out: bool) -> list:
        inside = inside or id(node) in tops
        if node[0] == "#":
            s = node[3]
            furniture = 2 * s["constant"] > s["pages"]
            linked = not by_tag and 2 * s["links"] > s["chars"]
            return ["#", node[1], [], inside and not out and not furniture and not linked]
        out = out or dropped(node, inside)
        return [node[0], node[1], [judged(x, inside, out) for x in node[2]], inside and not out]

    return judged(tree, False, False)


def main_slots(wrapper: list, skeleton: list) -> list[bool]:
    """For every leaf of a page's skeleton, whether the wrapper takes it for main text."""

    def unmet(node: list, inside: bool) -> list[bool]:
        if node[0] == "#":
            return [inside]
        inside = inside and not H.hard(node[0])
        return [x for c in node[2] for x in unmet(c, inside)]

    def met(w: list, node: list) -> list[bool]:
        if node[0] == "#":
            return [bool(w[3])]
        mate = {j: w[2][i] for i, j in H.pairs(w[2], node[2])}
        return [x for j, c in enumerate(node[2]) for x in (met(mate[j], c) if j in mate else unmet(c, bool(w[3])))]

    return met(wrapper, skeleton)


def own_slots(page: H.Page, skeleton: list) -> list[bool]:
    """The same from the page's own tree."""

    def summed(node: list) -> list:
        if node[0] == "#":
            return ["#", node[1], [], {"pages": 1, "chars": sum(len(page.texts[i]) for i in node[3]), "links": sum(page.links[i] for i in node[3]), "constant": 0, "at": 0}]
        return [node[0], node[1], [summed(x) for x in node[2]], None]

    return [bool(x[3]) for x in H.leaves(mark_main(summed(skeleton)))]


def page_text(source: str | None, wrapper: list | None, known: dict | None = None) -> str:
    """The main text of a page under its host's wrapper."""
    page = H.Page(source)
    tree = page.skeleton()
    keep = None
    if wrapper is not None:
        key = json.dumps(H.shape(tree)) if known is not None else None
        keep = known.get(key) if known is not None else None
        if keep is None:
            keep = main_slots(wrapper, tree)
            if known is not None:
                known[key] = keep
    if keep is None or not any(keep):
        keep = own_slots(page, tree)
    taken = sorted(i for leaf, k in zip(H.leaves(tree), keep, strict=True) if k for i in leaf[3])
    return "\n".join(page.texts[i] for i in taken)


def infer_wrappers(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """host and wrapper (JSON): one row per host of pages(host, html)."""
    slots = pages.select("host", "html").mapInArrow(_slots, _SLOT)
    slots = slots.withColumn("sid", F.md5("skeleton")).groupBy("host", "sid", "slot").agg(
        F.max(F.when(F.col("slot") == 0, F.col("skeleton"))).alias("skeleton"),
        *[F.sum(c).alias(c) for c in ("pages", "chars", "links")], F.min("low").alias("low"), F.max("high").alias("high"),
    )
    each = slots.groupBy("host", "sid").agg(
        F.max("skeleton").alias("skeleton"), F.collect_list(F.struct("slot", "pages", "chars", "links", "low", "high")).alias("slots")
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [json.dumps(_first_tree(s, v)) for s, v in zip(batch["skeleton"].to_pylist(), batch["slots"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["host"], batch["sid"], pa.array(trees, pa.string())], names=["host", "sid", "tree"])

    def aligned(found: pa.Table) -> pa.Table:
        rows = sorted(zip(found["sid"].to_pylist(), found["tree"].to_pylist(), strict=True))
        tree = json.loads(rows[0][1])
        for _, other in rows[1:]:
            other = json.loads(other)
            tree = [tree[0], "1", H.align(tree[2], other[2]), None]
        return pa.table({"host": [found["host"][0].as_py()], "sid": [rows[0][0]], "tree": [json.dumps(tree)]}, schema=found.select(["host", "sid", "tree"]).schema)

    trees = cut(each.mapInArrow(first, "host string, sid string, tree string"))
    while True:
        most = trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        # Fewer groups than half the trees, so that every round joins some.
        n = 1 if most <= group else max(1, min(-(-2 * most // group), most // 2))
        trees = cut(trees.withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(n))).groupBy("host", "part").applyInArrow(aligned, "host string, sid string, tree string"))
        if n == 1:
            break

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(mark_main(json.loads(t))) for t in batch["tree"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(found, pa.string())], names=["host", "wrapper"])

    return cut(trees.mapInArrow(marked, "host string, wrapper string"))


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url and text of every page."""
    require(pages, ["page_id", "url", "html"])
    slim = pages.select("page_id", "url", canonical(F.col("url"))[0].alias("host"), "html")
    wrappers = infer_wrappers(slim, group).withColumnRenamed("host", "of")
    both = slim.join(wrappers, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapped: dict[str | None, tuple] = {None: (None, None)}
        for batch in batches:
            texts = []
            for source, wrapper in zip(batch["html"], batch["wrapper"].to_pylist(), strict=True):
                if wrapper not in wrapped:
                    if len(wrapped) > 256:
                        wrapped = {None: (None, None)}
                    wrapped[wrapper] = (json.loads(wrapper), {})
                tree, known = wrapped[wrapper]
                if known is not None and len(known) > 1000:
                    known.clear()
                texts.append(page_text(source.as_py(), tree, known))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return both.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: For these tables' one template: the article element, its blocks, and the references that they use.
ORACLE = r"""
with a as (
  select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '\s+', ' ', 'g') as x from pages
), blocks as (
  select page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '</?(p|h1)>', chr(10), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g') as x from a
), decoded as (
  select page_id, url, regexp_replace(replace(replace(regexp_replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&#39;', ''''), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') as x
  from blocks
), joined as (
  select page_id, url, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) as text from decoded
)
select page_id, url, text, length(text)::bigint as n_chars from joined
"""

QUERIES = {"op13_html_extraction": op13_html_extraction}
ORACLES = {"op13_html_extraction": ORACLE}
