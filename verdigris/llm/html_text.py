"""Main text of web pages by wrapper induction.

1. Pages of a host with the same containers are one layout. Up to ``EXEMPLARS`` pages of each layout with ``agree`` different
   articles are aligned with each other by simple tree matching; the page that matches the others best is the seed, and those of its nodes
   that at least half of the others have are the layout's template. Pages of rarer layouts share a template of
   their host. Runs of neighbours of one form are folded into one node, so a page with very many siblings costs little.
2. Every page is aligned with its template, and every block of text belongs to the nearest template node around it. Blocks are
   counted over all pages: one that more than half of the different articles with its node have, or more than half of
   its host's articles, is a constant of the template and goes. A single word beside texts that vary (a cell, a list's item)
   stays, as it can be the articles' own.
3. What is left of a node over all pages is its slot. The content is found from the root downwards: into the one container that
   holds most of the varying text while nothing else there is large, with a first heading that stands before it. All
   slots below the container where that ends are content, template or not; slots elsewhere (menus, adverts, boxes
   whose text varies as well) go. An ``article`` is never cut up further.

No page is left out for its size, depth or number of siblings. Pages with the same title and heading (without: all text) count
as one article, because copies of an article would make its text look constant.

Elements that are no article text by what they are (menus, footers, forms, scripts ...) are never text, and a section
is none if one of its class or id tokens says nothing else than that it is a menu, advert, comment and so on; a token that
merely contains such a word (``recipe-menu``) does not count. On pages without a template, of hosts with fewer than ``agree`` different
articles, and on a page where a template finds no content, the marked article (without: the body) is the content.

Pages are parsed twice: for layouts, then for blocks. Counts are partial aggregates of hashes, so a host with a third of all
pages is no burden; templates are broadcast up to ``NEAR_BYTES``, else joined.

A null html is empty, and so is its text. A null url has no host and no template. Every row is a page.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import discard, map_batches, materialize, read, texts
from verdigris.llm.dom import DIGITS, TEXT, Matching, Node, Shape, classes, fold, parse, run_text, walk

EXEMPLARS, AGREE, NEAR_BYTES, NEAR_ROWS = 8, 3, 64 << 20, 2_000_000
#: Shares of a container's varying text: the most that the one to go into must have, what makes another container or text beside it large.
MOST, LARGE, BESIDE = 0.5, 0.2, 0.05
#: Elements, roles and words of class or id that mark what is no article text.
GONE_TAGS = frozenset("head nav footer aside form button select datalist textarea iframe canvas video audio template dialog menu option optgroup title search noframes noembed".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
GONE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer foot masthead topbar cookie cookies consent gdpr notice notices alert banner banners popup popups modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist commentary disqus respond reply replies toolbar pagination pager paging widget widgets".split()
)
#: Words that say nothing of their own beside one of those.
FILLERS = frozenset(
    "box boxes area block slot bar list container wrapper wrap section unit panel inner outer content top bottom left right main page site global form link links item items icon icons button buttons "
    "reader readers user users post posts article articles header title body placeholder zone skip".split()
)
HEADER_WORDS = frozenset("header head topper".split())
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section article main center dl ul ol blockquote".split())
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
KEEP, DROP, HEADER = range(3)


def judge(node: Node) -> int:
    """What a node's own markup says of it."""
    if node.tag in GONE_TAGS:
        return DROP
    if node.tag == "header":
        return HEADER
    if not node.attrs:
        return KEEP
    a = node.attributes()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return DROP
    if a.get("role", "").lower() in GONE_ROLES:
        return DROP
    if node.tag in ("html", "body", "main"):
        return KEEP
    out = KEEP
    for token in [*a.get("class", "").split(), a.get("id", "")]:
        found = [w.lower() for w in WORD.findall(token)]
        words = {*found, "".join(found)} if "".join(found) in GONE_WORDS else set(found)
        own = {w for w in words if len(w) > 2 and not w.isdigit() or w == "ad"} - FILLERS
        if own and (own <= GONE_WORDS or "".join(found) in GONE_WORDS):
            return DROP
        if words & HEADER_WORDS and not own - HEADER_WORDS:
            out = HEADER
    return out


def hashed(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h  # as a long


def blocks(root: Node, at: dict[int, int], wrapped: bool) -> list[tuple[int, str, int, bool]]:
    """(path's hash, text, template node, in an article) of every block that the markup leaves, in page order. at is the template
    node of an element; others belong to their parent's. On a wrapped page any header can be an article's own."""
    state: dict[int, tuple[int, int, int, bool]] = {}
    out = []
    for node, i in walk(root):
        if i == 0:
            path, verdict, number, inside = state[id(node.parent)] if node.parent else (0, KEEP, -1, False)
            if verdict != DROP:
                own = judge(node)
                inside = inside or node.tag == "article" or node.tag == "main" or "main" in node.attrs and node.attributes().get("role", "") == "main"
                if own == HEADER:
                    verdict = HEADER if inside or wrapped else DROP
                elif own == DROP:
                    verdict = DROP
                elif verdict == HEADER and node.tag in HEADINGS:
                    verdict = KEEP
            state[id(node)] = (hashed(f"{path}/{node.tag}.{classes(node)}"), verdict, at.get(id(node), number), inside)
        path, verdict, number, inside = state[id(node)]
        if verdict == KEEP and (text := run_text(node, i)):
            out.append((path, text, number, inside))
    return out


def heading(root: Node) -> tuple[str, ...]:
    """The page's title and first heading, or without either all its text: what tells articles apart."""
    found, every = {"title": "", "h1": ""}, []
    for node, i in walk(root):
        if text := run_text(node, i):
            if node.tag in found:
                found[node.tag] = found[node.tag] or text
            every.append(text)
    return tuple(found.values()) if any(found.values()) else tuple(every)


def layout(root: Node) -> int:
    """What pages of one layout share: the paths of elements that hold others, down to articles. Never 0, which is the host's own."""
    paths, stack = set(), [(root, 0)]
    while stack:
        node, path = stack.pop()
        path = hashed(f"{path}/{node.tag}.{classes(node)}")
        if node.children:
            paths.add(path)
        if node.tag not in ("article", "main"):
            stack.extend((c, path) for c in node.children)
    return hashed(" ".join(map(str, sorted(paths)))) or 1


def induce(sources: list[str], agree: int = AGREE) -> str | None:
    """The template of these pages as JSON: [parent, element, classes, repeated] of its nodes, parents first."""
    trees: dict[tuple, Node] = {}
    for s in sources:
        tree = parse(s)
        trees.setdefault(heading(tree), tree)
    shapes = [fold(trees[h]) for h in sorted(trees)]
    if len(shapes) < agree:
        return None
    met: dict[tuple[int, int], Matching] = {(i, j): Matching(shapes[i], shapes[j]) for i in range(len(shapes)) for j in range(len(shapes)) if i != j}
    seed = max(range(len(shapes)), key=lambda i: (sum(met[i, j].total for j in range(len(shapes)) if j != i), -i))
    have: dict[int, int] = {}
    for j in range(len(shapes)):
        if j != seed:
            for a, _ in met[seed, j].pairs():
                have[id(a)] = have.get(id(a), 0) + 1
    out, stack = [], [(shapes[seed], -1)]
    while stack:
        shape, parent = stack.pop()
        if 2 * have.get(id(shape), 0) >= len(shapes) - 1:
            out.append([parent, shape.tag, shape.classes, shape.repeated])
            stack.extend((k, len(out) - 1) for k in reversed(shape.kids))
    return json.dumps(out)


def template_of(packed: str) -> Shape:
    made: list[Shape] = []
    for n, (parent, tag, cls, repeated) in enumerate(json.loads(packed)):
        made.append(Shape(tag, cls, [], [], repeated))
        made[-1].number = n
        if parent >= 0:
            made[parent].kids.append(made[-1])
    return made[0]


def content_nodes(packed: str, varying: dict[int, int]) -> list[int]:
    """The nodes of a template whose slots are the article; varying is the amount of each node's varying text, over all pages."""
    nodes = json.loads(packed)
    total = [varying.get(i, 0) for i in range(len(nodes))]
    kids: list[list[int]] = [[] for _ in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i][0]] += total[i]
        kids[nodes[i][0]].insert(0, i)
    at, heads, gone = 0, [], []
    while total[at] and nodes[at][1] != "article":
        large = [k for k in kids[at] if nodes[k][1] in CONTAINERS and not nodes[k][3] and total[k] >= LARGE * total[at]]
        running = varying.get(at, 0) + sum(total[k] for k in kids[at] if nodes[k][1] in TEXT and nodes[k][1] not in HEADINGS or nodes[k][1] in CONTAINERS and nodes[k][3])
        outer = nodes[at][1] in ("", "html", "body")
        if len(large) != 1 or total[large[0]] < MOST * total[at] or running >= BESIDE * total[at] and not outer:
            if outer and large:
                gone = [k for k in kids[at] if nodes[k][1] in CONTAINERS and k not in large]
            break
        heads += [k for k in _below(kids, kids[at][: kids[at].index(large[0])]) if nodes[k][1] == "h1"]
        at = large[0]
    lost = set(_below(kids, gone))
    return sorted({*heads, *(k for k in _below(kids, [at]) if k not in lost)})


def _below(kids: list[list[int]], roots: list[int]) -> list[int]:
    out, stack = [], list(roots)
    while stack:
        out.append(stack.pop())
        stack.extend(kids[out[-1]])
    return out


def page_blocks(root: Node, packed: str | None, cache: dict[str, Shape] | None = None) -> list[tuple[int, str, int, bool]]:
    """A page's blocks with template nodes; cache keeps templates that were unpacked."""
    at: dict[int, int] = {}
    if packed:
        cache = cache if cache is not None else {}
        if packed not in cache:
            if len(cache) > 2000:
                cache.clear()
            cache[packed] = template_of(packed)
        for shape, node in Matching(fold(root), cache[packed]).pairs():
            at.update((id(n), node.number) for n in shape.nodes)
    return blocks(root, at, packed is not None)


def main_text(source: str) -> str:
    """The text of a page without a template."""
    found = page_blocks(parse(source), None)
    some = any(inside for *_, inside in found)
    return "\n".join(text for _, text, _, inside in found if inside or not some)


SIGNED = "host string, h long, layout long, article long, size long"


def signed_pages(own: DataFrame) -> DataFrame:
    """SIGNED for every page with a host."""

    def run(batch):
        out = []
        for source in texts(batch, "html"):
            root = parse(source)
            out.append((layout(root), hashed("\n".join(heading(root))), len(source)))
        columns = [batch.column("host"), batch.column("h"), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))]
        yield pa.record_batch(columns, ["host", "h", "layout", "article", "size"])

    return map_batches(own.where("host <> ''").select("host", "h", "html"), run, SIGNED).dropDuplicates(["host", "h"])


def induce_templates(own: DataFrame, agree: int = AGREE) -> DataFrame:
    """(host, layout, template) of every layout with agree different articles, and as layout 0 of every such host."""
    signed = materialize(signed_pages(own), "signed-pages")
    totals = signed.select("host", "layout", "article").distinct().groupBy("host", "layout").agg(F.count("*").alias("n")).where(F.col("n") >= agree).select("host", "layout")
    totals = materialize(totals, "layouts")
    both = signed.join(F.broadcast(totals) if totals.count() <= NEAR_ROWS else totals, ["host", "layout"], "left_semi").unionByName(signed.withColumn("layout", F.lit(0).cast("long")))
    # of the articles of each slot one page, small ones first
    best = F.min(F.struct((F.col("size") > 200_000).alias("large"), "article", "h"))
    chosen = both.groupBy("host", "layout", F.pmod(F.xxhash64("article"), F.lit(EXEMPLARS)).alias("slot")).agg(best.alias("b")).select("host", "layout", F.col("b.h").alias("h"))
    chosen = materialize(chosen, "exemplars")
    side = F.broadcast(chosen) if chosen.count() <= NEAR_ROWS else chosen
    rows = own.select("host", "h", "html").join(side, ["host", "h"]).select("host", "layout", "html").distinct()

    def wrap(group: pa.Table) -> pa.Table:
        found = [x for x in [induce(sorted(group["html"].to_pylist()), agree)] if x]
        return pa.table({"host": pa.array(group["host"].to_pylist()[: len(found)], pa.string()), "layout": pa.array(group["layout"].to_pylist()[: len(found)], pa.int64()), "template": pa.array(found, pa.string())})

    out = materialize(rows.groupBy("host", "layout").applyInArrow(wrap, "host string, layout long, template string"), "templates")
    discard(chosen, totals)
    out._verdigris_signed = signed
    return out


PARSED = "page_id long, url string, host string, layout long, article long, texts array<string>, keys array<long>, nodes array<int>, inside array<boolean>"


def aligned_pages(own: DataFrame, templates: DataFrame, near_bytes: int = NEAR_BYTES) -> DataFrame:
    """PARSED for every row of own (page_id, url, host, h, html); layout is that of the template used, null without one."""
    size = templates.agg(F.coalesce(F.sum(F.length("template") + F.length("host") + 64), F.lit(0))).first()[0]
    columns, shared = ["page_id", "url", "host", "html"], None
    if size <= near_bytes:
        shared = own.sparkSession.sparkContext.broadcast({(r["host"], r["layout"]): r["template"] for r in templates.toLocalIterator()})
        rows = own.select(columns)
    else:
        of_page = templates._verdigris_signed.select("host", "h", "layout")
        exact = of_page.join(templates, ["host", "layout"], "left").select("host", "h", F.when(F.col("template").isNotNull(), F.col("layout")).otherwise(0).alias("layout"), F.col("template").alias("t"))
        used = exact.join(templates, ["host", "layout"], "left").select("host", "h", F.when(F.col("template").isNotNull(), F.col("layout")).alias("layout"), "template")
        rows = own.join(used, ["host", "h"], "left").select(*columns, "layout", "template")

    def run(batch):
        cache: dict[str, Shape] = {}
        hosts, out = batch.column("host").to_pylist(), []
        given = list(zip(batch.column("layout").to_pylist(), batch.column("template").to_pylist(), strict=True)) if shared is None else None
        for k, source in enumerate(texts(batch, "html")):
            root = parse(source)
            if given is None:
                name = layout(root) if (hosts[k], 0) in shared.value else 0
                name = name if (hosts[k], name) in shared.value else 0
                packed = shared.value.get((hosts[k], name))
            else:
                name, packed = given[k]
            found = page_blocks(root, packed, cache)
            some = any(inside for *_, inside in found)
            out.append((name if packed else None, hashed("\n".join(heading(root))), [t for _, t, _, _ in found], [hashed(f"{p}\n{t}") for p, t, _, _ in found], [n for _, _, n, _ in found], [x or not some for *_, x in found]))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
        got = [batch.column(c) for c in ("page_id", "url", "host")] + [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        yield pa.record_batch(got, ["page_id", "url", "host", "layout", "article", "texts", "keys", "nodes", "inside"])

    return map_batches(rows, run, PARSED)


def wrappers_of(parsed: DataFrame, templates: DataFrame, agree: int = AGREE) -> DataFrame:
    """(host, layout, content array<int>, constants array<long>) of every template; counted over all pages."""
    seen = parsed.where("layout is not null").select("host", "layout", "article", F.explode(F.arrays_zip("keys", "nodes", F.transform("texts", lambda t: F.length(t)).alias("size"), F.transform("texts", lambda t: ~t.contains(" ")).alias("single"))).alias("b"))
    seen = materialize(seen.select("host", "layout", "article", F.col("b.keys").alias("key"), F.col("b.nodes").alias("node"), F.col("b.size").alias("size"), F.col("b.single").alias("single")).distinct(), "blocks-seen")
    counts = materialize(seen.groupBy("host", "layout", "node", "key", "single", "size").agg(F.count("*").alias("n")), "block-counts")
    of_host = seen.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("host_total"))
    on_host = seen.select("host", "key", "article").distinct().groupBy("host", "key").agg(F.count("*").alias("m")).where(F.col("m") >= agree)
    having = seen.select("host", "layout", "node", "article").distinct().groupBy("host", "layout", "node").agg(F.count("*").alias("having"))
    often = counts.join(on_host, ["host", "key"]).join(having, ["host", "layout", "node"]).join(of_host, "host")
    constant = materialize(often.where(((F.col("n") >= agree) & (2 * F.col("n") > F.col("having"))) | (2 * F.col("m") > F.col("host_total"))).select("host", "layout", "node", "key", "single"), "constants")
    # single words go only where a node has nothing else than constants
    different = counts.groupBy("host", "layout", "node").agg(F.count("*").alias("different"))
    fixed = constant.groupBy("host", "layout", "node").agg(F.count("*").alias("fixed"))
    alone = constant.where("single").join(fixed, ["host", "layout", "node"]).join(different, ["host", "layout", "node"]).where("fixed = different")
    found = constant.where("not single").select("host", "layout", "key").unionByName(alone.select("host", "layout", "key"))
    keys = found.groupBy("host", "layout").agg(F.collect_set("key").alias("constants"))
    slots = counts.join(constant.select("host", "layout", "node", "key"), ["host", "layout", "node", "key"], "left_anti").groupBy("host", "layout", "node").agg(F.sum(F.col("n") * F.col("size")).alias("amount"))
    slots = slots.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "amount")).alias("slots"))  # at most one for each template node

    def choose(batch):
        own = [content_nodes(t, {x["node"]: x["amount"] for x in s or ()}) for t, s in zip(batch.column("template").to_pylist(), batch.column("slots").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("host"), batch.column("layout"), pa.array(own, pa.list_(pa.int32()))], ["host", "layout", "content"])

    content = map_batches(templates.join(slots, ["host", "layout"]).select("host", "layout", "template", "slots"), choose, "host string, layout long, content array<int>")
    out = materialize(content.join(keys, ["host", "layout"], "left"), "wrappers")
    discard(seen, counts, constant)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", agree: int = AGREE, near_bytes: int = NEAR_BYTES) -> DataFrame:
    """(page_id, url, text) of every row."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))).withColumn("h", F.xxhash64("html"))
    templates = induce_templates(own, agree)
    parsed = materialize(aligned_pages(own, templates, near_bytes), "aligned-pages")
    wrappers = wrappers_of(parsed, templates, agree)
    discard(templates._verdigris_signed, templates)
    side = F.broadcast(wrappers) if wrappers.agg(F.coalesce(F.sum(F.size("content") + F.coalesce(F.size("constants"), F.lit(0))), F.lit(0))).first()[0] <= NEAR_ROWS else wrappers
    joined = parsed.join(side, ["host", "layout"], "left")
    fresh = F.filter(F.arrays_zip("texts", "keys", "nodes", "inside"), lambda b: ~F.coalesce(F.array_contains("constants", b["keys"]), F.lit(False)))
    own_text = F.array_join(F.transform(F.filter(fresh, lambda b: F.coalesce(F.array_contains("content", b["nodes"]), F.lit(False))), lambda b: b["texts"]), "\n")
    marked = F.array_join(F.transform(F.filter(fresh, lambda b: b["inside"]), lambda b: b["texts"]), "\n")
    return joined.select("page_id", "url", F.when(own_text != "", own_text).otherwise(marked).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: page_id, url, text, n_chars."""
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
