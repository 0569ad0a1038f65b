"""Main text of pages: subtrees that recur across a host's pages are its template and go.

Two passes over the pages, with one shuffle of small counts between them:

1. Each page is parsed once. Every block element with text, inside and outside an article mark, gives a 64-bit key
   (of host, tags, classes, normalised text and whether it lies inside the mark), its place (the path to it and its number
   among its siblings, from either end) and a witness: a hash of the page's text outside the element. A row for each key of a batch holds the
   number of pages, a 64-bit map of their witnesses, and sums of signs, +1 or -1 by bits of the witness and of the two
   places. Spark adds all of that up before the shuffle, so neither a hot host nor a hot subtree gathers its rows anywhere.
2. From those sums follows how alike the pages of a subtree are. If all n agree a sum is n or -n, if all differ about
   the root of n; the mean square over n squared estimates how often two of the pages agree. A subtree recurs if
   ``least`` pages that differ in their other text have it: copies of one article, edited or not, agree too often. Inside an
   article mark two more tests hold, unless the subtree is mostly links: nearly all pages have it at the same place, and
   the host has it far more often than a Poisson law with the rate of all other hosts allows. So sentences of the language, which
   stand anywhere on many hosts, are kept however large a host is, and a notice that a host puts at one place goes.
3. Pages are parsed again: recurring subtrees are deleted, then those that their tag, role or class names as menu,
   header, footer, sidebar, notice, advert, form or reader comments; scripts, styles and comments of the
   markup never count as text. What is left is cut into blocks. The keys that recur are broadcast if their written
   size allows it; else each chunk of ``chunk_rows`` neighbouring pages is joined with the keys that it has.

The mark of an article (``article`` or ``main``) is a check made after that: text outside it goes. Inside it the witness is the
least hash of the other texts inside, longer ones first, so that copies with an edited passage mostly agree. Pages without such a
mark keep the blocks of the body. The sums estimate: a subtree that recurs on barely enough pages may be missed.

A null or empty html gives an empty text. A null or odd url is a host of its own ("" ). Repeated rows are judged each
for itself. Empty tables give empty results. Other columns pass through, result names are replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillrank.llm.frames import BROADCAST_BYTES, add_columns, small_enough, table, without
from quillrank.llm.registry import query
from quillrank.llm.url_filter import url_host
from quillrank.sources.shared import materialise

LEAST = 4
CHUNK_ROWS = 1_024
SHORT = 20  # characters
INSIDE = 6  # pages that must have a subtree of an article at one place
SIGNS, PLACES = 8, 4  # sums of signs, of witnesses and of each of the two places
DIFFER = 0.75  # of the pages, where their witnesses can be counted by the map
SAME_PLACE = 0.6  # of pairs of pages
UNUSUAL = 5.0  # standard deviations above what other hosts have

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^>]*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
DROPPED = frozenset(
    "nav aside footer header form button select textarea script style noscript template title head iframe object embed svg math"
    " canvas audio video dialog menu fieldset input label datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices notification alert sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead"
    " comment comments disqus replies share sharing social newsletter subscribe subscription popup modal overlay related login"
    " signup search pagination pager widget skip toolbar".split()
)
CORE = frozenset(["article", "main"])
# An opening tag of the first kind ends an open element of the second kind.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
BARRIERS = {
    "li": frozenset(["ul", "ol", "menu"]),
    "dt": frozenset(["dl"]),
    "dd": frozenset(["dl"]),
    "tr": frozenset(["table"]),
    "td": frozenset(["tr", "table"]),
    "th": frozenset(["tr", "table"]),
    "option": frozenset(["select"]),
}


class Node:
    __slots__ = ("tag", "names", "dropped", "children", "core", "shown")

    def __init__(self, tag: str, names: str = "", dropped: bool = False):
        self.tag, self.names, self.dropped = tag, names, dropped
        self.children: list[Node | str] = []
        self.core = self.shown = False


def parse(source: str) -> Node:
    """The element tree; unclosed and misplaced tags are mended as browsers mostly do."""
    root = Node("html")
    stack = [root]
    open_at: dict[str, list[int]] = {}  # where elements of a tag lie on the stack; so an end tag is found at once
    block_at = [0]

    def close(k: int) -> None:
        for node in stack[k:]:
            open_at[node.tag].pop()
        del stack[k:]
        while block_at[-1] >= k:
            block_at.pop()

    at, end = 0, len(source)
    while at < end:
        found = TOKEN.search(source, at)
        if found is None:
            stack[-1].children.append(source[at:])
            break
        if found.start() > at:
            stack[-1].children.append(source[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            k = open_at[tag][-1] if open_at.get(tag) else 0
            if k and (tag in BLOCK or k > block_at[-1]):  # an inline end tag does not end a block
                close(k)
            continue
        attributes = found[3]
        if tag in BLOCK or tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k].tag
                if (open_tag == "p" and tag in BLOCK) or open_tag in CLOSES.get(tag, ()):
                    close(k)
                    break
                if open_tag in BARRIERS.get(tag, ()) or (open_tag in BLOCK and tag not in CLOSES):
                    break
        node = new_node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = ended.end() if ended else end
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path", "use")):
            open_at.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                block_at.append(len(stack))
            stack.append(node)
    return root


def new_node(tag: str, attributes: str) -> Node:
    if "=" not in attributes and "hidden" not in attributes:
        return Node(tag, "", tag in DROPPED)
    names, dropped = [], tag in DROPPED
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words = re.split(r"[^a-z0-9]+", re.sub(r"\d+", "", value))
            if name == "class":
                names += words
            if tag not in ("html", "body", "article", "main") or "comment" in words:
                dropped = dropped or not NAMED.isdisjoint(words)
        elif name == "role":
            dropped = dropped or value in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            dropped = True
    return Node(tag, " ".join(sorted(names)), dropped)


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def note_hashes(root: Node, has_core: bool, sink: list[tuple[Node, int, int, int, tuple[int, int]]]) -> list[int]:
    """Note (element, hash, characters, characters in links, span) of each block element of a page.

    Returns the hashes of the texts that count as the page's content; a span is the range of those inside the element.
    """
    pieces: list[int] = []
    stack = [(root, iter(root.children), [root.tag, root.names], [0, 0], 0)]
    while True:
        current, rest, parts, sums, first = stack[-1]
        for child in rest:
            if isinstance(child, str):
                text = " ".join(child.split())
                if text:
                    parts.append(text)
                    sums[0] += len(text)
                    if current.tag == "a":
                        sums[1] += len(text)
                    if current.core if has_core else current.shown:
                        # Short texts come last in the order: many pages have them, so they tell pages apart badly.
                        pieces.append(hash64(text) >> 1 | (len(text) < SHORT) << 63)
            else:
                stack.append((child, iter(child.children), [child.tag, child.names], [0, 0], len(pieces)))
                break
        else:
            stack.pop()
            value = hash64("\x00".join(parts))
            if current.tag == "a":
                sums[1] = sums[0]
            if sums[0] and current.tag in BLOCK:
                sink.append((current, value, sums[0], sums[1], (first, len(pieces))))
            if not stack:
                return pieces
            stack[-1][2].append(f"{value:016x}")
            stack[-1][3][0] += sums[0]
            stack[-1][3][1] += sums[1]


def mark_core(root: Node) -> bool:
    """Mark everything inside an article or main element that is not itself dropped; whether there is one."""
    found = False
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.dropped and not (inside and node.tag == "header"):
            continue
        inside = inside or node.tag in CORE
        found = found or inside
        node.core, node.shown = inside, True
        stack += [(child, inside) for child in node.children if not isinstance(child, str)]
    return found


def site_key(site: int, value: int, core: bool) -> int:
    """One 64-bit number of a host, a subtree's hash and whether it lies inside an article."""
    return ((site ^ value) * 0x9E3779B97F4A7C15 + (value >> 7) + core) & (2**64 - 1)


def subtrees(root: Node, has_core: bool) -> tuple[list, list[int]]:
    """The subtrees that may be deleted when they recur, as ``note_hashes`` notes them, and the hashes of the content."""
    sink: list = []
    pieces = note_hashes(root, has_core, sink)
    return [found for found in sink if found[0].tag not in ("html", "body", "head") and not (found[0].core and found[0].tag in CORE)], pieces


def witnesses(found: list, pieces: list[int]) -> list[int | None]:
    """For each subtree a hash of the content outside it, None if there is none: inside the core the least, else the sum."""
    n = len(pieces)
    sums, before, after = [0] * (n + 1), [None] * (n + 1), [None] * (n + 1)
    for k, piece in enumerate(pieces):
        sums[k + 1] = sums[k] + piece
        before[k + 1] = piece if before[k] is None else min(before[k], piece)
    for k in range(n - 1, -1, -1):
        after[k] = pieces[k] if after[k + 1] is None else min(after[k + 1], pieces[k])
    out = []
    for node, _, _, _, (first, last) in found:
        if last - first == n:
            out.append(None)
        elif node.core:
            out.append(min(x for x in (before[first], after[last]) if x is not None))
        else:
            out.append((sums[n] - sums[last] + sums[first]) & (2**64 - 1))
    return out


def places(root: Node) -> dict[int, tuple[int, int]]:
    """Of each element, hashes of the path to it with its number among its siblings from the first and from the last."""
    out: dict[int, tuple[int, int]] = {}
    stack = [(root, "")]
    while stack:
        node, path = stack.pop()
        path = f"{path}/{node.tag}"[-200:]
        inside = [child for child in node.children if not isinstance(child, str)]
        for k, child in enumerate(inside):
            out[id(child)] = (hash64(f"{path}/{child.tag}#{k}"), hash64(f"{path}/{child.tag}#{k - len(inside)}"))
            stack.append((child, path))
    return out


def template_nodes(root: Node, has_core: bool, site: int, recurring) -> set[int]:
    """The elements that recur on the host."""
    return {id(node) for node, value, *_ in subtrees(root, has_core)[0] if site_key(site, value, node.core) in recurring}


def blocks(root: Node, has_core: bool, deleted: set[int]) -> list[str]:
    out: list[str] = []
    current: list[str] = []

    def end_block() -> None:
        if current:
            text = " ".join(entities.unescape("".join(current)).split())
            if text:
                out.append(text)
            current.clear()

    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            current.append(item)
        else:
            if id(item) in deleted or (item.dropped and not (item.core and item.tag == "header")):
                current.append(" ")
                continue
            if item.tag in ("br", "td", "th", "img"):
                current.append(" ")
            block = item.tag in BLOCK
            if block:
                end_block()
                stack.append(None)
            keep = item.core or not has_core
            stack += [c for c in reversed(item.children) if keep or not isinstance(c, str)]
    end_block()
    return out


def page_keys(source: str | None, site: int) -> dict[int, tuple]:
    """The key of each subtree of a page, with (witness, places, value, inside an article, mostly links)."""
    if not source:
        return {}
    root = parse(source)
    found, pieces = subtrees(root, mark_core(root))
    place = places(root)
    return {
        site_key(site, value, node.core): (witness, place[id(node)], value, node.core, 2 * linked > size)
        for (node, value, size, linked, _), witness in zip(found, witnesses(found, pieces), strict=True)
        if node is not root
    }


def main_text(source: str | None, recurring, site: int = 0) -> str:
    """The text without the subtrees whose keys recur."""
    if not source:
        return ""
    root = parse(source)
    has_core = mark_core(root)
    return "\n".join(blocks(root, has_core, template_nodes(root, has_core, site, recurring) if recurring else set()))


def signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


SUMS = [f"w{k}" for k in range(SIGNS)] + [f"p{k}" for k in range(PLACES)] + [f"q{k}" for k in range(PLACES)]


def signs(witness: int, place: tuple[int, int]) -> list[int]:
    """+1 or -1 for each sum."""
    return [2 * (number >> k & 1) - 1 for number, n in ((witness, SIGNS), (place[0], PLACES), (place[1], PLACES)) for k in range(n)]


def counted(pages: DataFrame, host: str, html: str) -> DataFrame:
    """A row for each subtree of a host: pages, map and sums."""
    schema = ", ".join(["subtree long, site long, value long, core boolean, links boolean, n long, seen long", *(f"{c} long" for c in SUMS)])

    def kernel(batches):
        for batch in batches:
            rows: dict[int, list] = {}
            for site, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key, (witness, place, value, core, links) in page_keys(source, site & (2**64 - 1)).items():
                    if witness is None:
                        continue
                    row = rows.setdefault(key, [site, value, core, links, 0, 0, *([0] * len(SUMS))])
                    row[4] += 1
                    row[5] |= 1 << (witness >> 50 & 63)
                    for k, sign in enumerate(signs(witness, place), 6):
                        row[k] += sign
            columns = list(zip(*rows.values(), strict=True)) or [()] * (6 + len(SUMS))
            arrays = [signed(list(rows)), pa.array(columns[0], pa.int64()), signed(columns[1]), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.bool_())]
            arrays += [pa.array(columns[4], pa.int64()), signed(columns[5]), *[pa.array(c, pa.int64()) for c in columns[6:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["subtree", "site", "value", "core", "links", "n", "seen", *SUMS])

    seen = pages.select(F.col(host), F.col(html)).mapInArrow(kernel, schema)
    sums = [F.sum(c).alias(c) for c in SUMS]
    return seen.groupBy("subtree", "site", "value", "core").agg(F.max("links").alias("links"), F.sum("n").alias("n"), F.bit_or("seen").alias("seen"), *sums)


def alike(names: list[str]) -> Column:
    """How often two of the pages agree, from sums of signs."""
    squares = sum((F.col(c).cast("double") * F.col(c) for c in names), F.lit(0.0))
    return squares / len(names) / (F.col("n").cast("double") * F.col("n"))


def site_templates(pages: DataFrame, host: str, html: str, least: int) -> DataFrame:
    """The keys of the subtrees that recur across a host's pages."""
    rows = materialise(counted(pages, host, html), "subtrees")
    # By linear counting; a full map says that there are many.
    empty = 64 - F.bit_count("seen")
    distinct = F.when(empty > 16, -64 * F.log(empty / 64)).otherwise(F.col("n"))
    differ = (distinct >= F.greatest(F.lit(least) - 0.5, DIFFER * F.col("n"))) & (alike(SUMS[:SIGNS]) <= 4 / F.col("n"))
    recurring = rows.where((F.col("n") >= least) & differ)
    anywhere = recurring.where(~F.col("core") | F.col("links")).select("subtree")

    one_place = F.greatest(alike(SUMS[SIGNS : SIGNS + PLACES]), alike(SUMS[SIGNS + PLACES :])) >= SAME_PLACE
    inside = recurring.where(F.col("core") & ~F.col("links") & (F.col("n") >= INSIDE) & one_place)
    inside = small_enough(materialise(inside.select("subtree", "site", "value", "n"), "inside"))
    everywhere = rows.where("core").join(inside.select("value").distinct(), "value", "left_semi").groupBy("value").agg(F.sum("n").alias("all"))
    sizes = pages.groupBy(F.col(host).alias("site")).agg(F.count(F.lit(1)).alias("pages"))
    total = sizes.agg(F.sum("pages").alias("p")).select("p").scalar()
    known = inside.join(everywhere, "value").join(sizes, "site")
    others = F.greatest(total - F.col("pages"), F.lit(1))
    usual = F.col("pages") * (F.col("all") - F.col("n")) / others
    own = known.where(F.col("n") - usual >= least + UNUSUAL * F.sqrt(usual)).select("subtree")
    return anywhere.unionByName(own)


def extract_main_text(
    pages: DataFrame, url: str = "url", html: str = "html", least: int = LEAST, chunk_rows: int = CHUNK_ROWS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The pages without html, with ``text`` (the main text) and ``n_chars``."""
    frame = without(pages, ["_site", "_chunk"]).withColumn("_site", F.xxhash64(url_host(F.col(url))))
    recurring = materialise(site_templates(frame, "_site", html, least), "templates")
    added = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extracted(sources, sites, keys: set[int]) -> list[pa.Array]:
        texts = [main_text(source.as_py(), keys, site.as_py() & (2**64 - 1)) for source, site in zip(sources, sites, strict=True)]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    if 8 * recurring.count() <= broadcast_bytes:
        shared = frame.sparkSession.sparkContext.broadcast(recurring.toArrow().column("subtree").to_numpy().view(np.uint64))

        def kernel(batches):
            keys = set(shared.value.tolist())
            for batch in batches:
                yield batch, extracted(batch.column(html), batch.column("_site"), keys)

        return add_columns(frame, kernel, added).drop(html, "_site")

    def chunk_keys(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            pairs = list({(chunk, key) for chunk, site, source in rows for key in page_keys(source, site & (2**64 - 1))})
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.int64()), signed([k for _, k in pairs])], names=["_chunk", "subtree"])

    try:
        frame = frame.withColumn("_chunk", F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / chunk_rows)))
    except AnalysisException:  # not a table of files
        frame = materialise(frame, "pages")
        frame = frame.withColumn("_chunk", F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / chunk_rows)))
    needed = frame.select("_chunk", "_site", html).mapInArrow(chunk_keys, "_chunk long, subtree long").distinct().join(recurring, "subtree", "left_semi")
    taken = {"text", "n_chars", html.lower(), "_site", "_chunk"}
    schema = T.StructType([f for f in frame.schema.fields if f.name.lower() not in taken] + list(added.fields))
    target = to_arrow_schema(schema)

    def by_chunk(rows: pa.Table, keys: pa.Table) -> pa.Table:
        keys = set(keys.column("subtree").to_numpy().view(np.uint64).tolist())
        columns = [rows.column(f.name) for f in schema.fields[:-2]] + extracted(rows.column(html), rows.column("_site"), keys)
        return pa.table([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return frame.groupBy("_chunk").cogroup(needed.groupBy("_chunk")).applyInArrow(by_chunk, schema)


@query("op1_site_template_removal")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
