"""Main text of web pages by templates deduced from the pages of a host.

Tokens are opened elements, told apart by their path of names and classes, and blocks of text at their path. A token's
occurrence vector says how often each page of the host has it; only a fingerprint of it travels (sums of a hash of page and
count), so tokens with equal vectors are found by grouping. Such an equivalence class is valid where its tokens come in one
order on a page, and is nested by the paths of its tokens in another class. What lies between tokens of the nested classes are
slots. A host's slots are weighed over all its pages (characters, links, what their elements mean) and those of the main
text are chosen; a page gives the blocks in these slots, less the texts that are themselves tokens of the class of whole pages.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.markup import FULL, HEADINGS, ROOT, TEXTS, Block, read, text_path
from flowgrid.llm.shared import materialize, pick

#: A template has the elements that a tenth of a host's pages have; its texts are on all of at least so many pages.
RARE, LEAST_PAGES = 10, 10
#: Slots with a larger share of link text aren't main text (headings may be links).
MOST_LINKS = 0.7
#: A kind of main element counts if it holds this share of the text outside menus and the like.
LEAST_SHARE = 0.25
#: Tokens a task holds before it passes them on.
HELD = 200_000

_TOKEN = "host string, kind int, id long, pages long, s0 long, s1 long, place long, chain array<long>, names array<string>, level int, chars long, links long"
_LOW = (1 << 32) - 1


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the host of the url in lower case (empty if there is none)."""
    found = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return pick(pages, "page_id", "url", "html").withColumn("host", found)


def _tokens(batches):
    """A task's tokens by host: pages that have them, sums of the vector's hashes, place, and what is known of the element."""
    held: dict[tuple, list] = {}

    def rows():
        keys, values = list(held), list(held.values())
        columns = list(zip(*keys)) + list(zip(*values))
        names = [c.split()[0] for c in _TOKEN.split(", ")]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for b in batches:
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            html = html or ""
            opened, blocks = read(html)
            page = xxhash.xxh64_intdigest(html)
            where = {path: k for k, (path, _, _) in reversed(list(enumerate(opened)))}
            counts = Counter(path for path, _, _ in opened)
            known = {path: (node, name) for path, node, name in opened}
            seen: dict[int, list[int]] = defaultdict(lambda: [0, 0])
            texts: Counter = Counter()
            for x in blocks:
                if x.node.use == FULL:
                    seen[x.node.path][0] += len(x.text)
                    seen[x.node.path][1] += x.links
                    texts[text_path(x.node, x.text)] += 1
            for kind, found in ((0, {ROOT.path: 1} | counts), (1, texts)):
                for token, n in found.items():
                    h = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed=page)
                    row = held.get((host, kind, token))
                    if row is None:
                        node, name = known.get(token, (ROOT, ""))
                        chain, names, level = (None, None, 0) if kind else (list(node.chain), list(node.names), node.level)
                        if not kind and name != node.name:  # an element inside a line
                            chain, names = [*chain, token], [*names, name]
                        row = held[host, kind, token] = [0, 0, 0, 0, chain, names, level, 0, 0]
                    row[0] += 1
                    row[1] += h & _LOW
                    row[2] += h >> 32
                    row[3] += where.get(token, 0)
                    if not kind and token in seen:
                        row[7] += seen[token][0]
                        row[8] += seen[token][1]
        if len(held) > HELD:
            yield rows()
            held.clear()
    if held:
        yield rows()


def choose(slots: list[tuple[int, list[int], list[str], int, int, int]]) -> list[int]:
    """The slots of the main text among (slot, chain, names, level, characters, link characters).

    Slots in article elements, else in main ones, if they hold enough of the text; else the slots in the element whose paragraphs,
    lists and tables have the most text outside links.
    """
    total = sum(s[4] for s in slots)
    read_on = [s for s in slots if s[4] and (s[5] <= MOST_LINKS * s[4] or s[2] and s[2][-1] in HEADINGS)]
    for level in (2, 1):
        if total and sum(s[4] for s in slots if s[3] >= level) >= LEAST_SHARE * total:
            return [s[0] for s in read_on if s[3] >= level]
    weight: Counter = Counter()
    for slot, chain, names, _, chars, links in read_on:
        k = len(names)
        while k and names[k - 1] in TEXTS:
            k -= 1
        weight[chain[k - 1] if k else ROOT.path] += chars - links
    if not weight:
        return []
    best = min(weight, key=lambda c: (-weight[c], c))
    return [s[0] for s in read_on if best == ROOT.path or best in s[1]]


def _nested(tokens: dict[int, tuple[int, list[int]]]) -> dict[int, int]:
    """The class of each token, told apart by the class that encloses it: tokens (id to class and chain) of a class nest in one other."""
    parts = {}
    for token, (own, chain) in tokens.items():
        around = next((tokens[c][0] for c in reversed(chain[:-1]) if c in tokens and tokens[c][0] != own), 0)
        parts[token] = xxhash.xxh64_intdigest(f"{own} {around}") >> 1
    return parts


def _template(rows: pd.DataFrame) -> pd.DataFrame:
    """A host's template from its frequent tokens: elements in order with their class, main slots, repeated texts."""
    tags, texts = rows[rows.kind == 0], rows[rows.kind == 1]
    tags = tags.assign(mean=tags.place / tags.pages).sort_values(["mean", "id"])
    classes = _nested({t: (c, list(chain)) for t, c, chain in zip(tags.id, tags["class"], tags.chain)})
    main = choose([(t, list(c), list(n), lv, ch, li) for t, c, n, lv, ch, li in zip(tags.id, tags.chain, tags.names, tags.level, tags.chars, tags.links)])
    order = [int(t) for t in tags.id]
    return pd.DataFrame({"host": [rows.host.iloc[0]], "tags": [order], "classes": [[classes[t] for t in order]], "main": [main], "texts": [sorted(map(int, texts.id))]})


def templates(pages: DataFrame) -> DataFrame:
    """The template of each host of ``pages`` (page_id, url, html, host).

    host, tags (paths of elements that a tenth of its pages have, in the order of the pages), classes (the equivalence class of
    each), main (those whose slot belongs to the main text) and texts (blocks that all pages have once). Characters in
    elements that few pages have count for the nearest frequent element around them. A host has as many rows before the
    last step as ten of its pages have elements, however many pages it has.
    """
    partial = pages.select("host", "html").mapInArrow(_tokens, _TOKEN)
    sums = {c: F.sum(c).alias(c) for c in ("pages", "s0", "s1", "place", "chars", "links")}
    tokens = materialize(partial.groupBy("host", "kind", "id").agg(*sums.values(), *[F.any_value(c).alias(c) for c in ("chain", "names", "level")]), "page-tokens")
    whole = tokens.filter((F.col("kind") == 0) & (F.col("id") == ROOT.path)).select("host", F.col("pages").alias("all"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
    alike = (F.col("pages") == F.col("all")) & (F.col("s0") == F.col("t0")) & (F.col("s1") == F.col("t1"))
    frequent = F.when(F.col("kind") == 0, F.col("pages") * RARE >= F.col("all")).otherwise(alike & (F.col("all") >= LEAST_PAGES))
    kept = tokens.filter(F.col("id") != ROOT.path).filter((F.col("kind") == 0) | (F.col("pages") >= LEAST_PAGES)).join(whole, "host").filter(frequent)
    kept = materialize(kept.withColumn("class", F.xxhash64("pages", "s0", "s1")), "page-template")
    tags = kept.filter("kind = 0").groupBy("host").agg(F.collect_set("id").alias("tags"))
    near = F.try_element_at(F.filter("chain", lambda c: F.array_contains("tags", c)), F.lit(-1))
    texts = tokens.filter("kind = 0 AND chars > 0").join(tags, "host").select("host", F.coalesce(near, F.lit(ROOT.path)).alias("id"), "chars", "links")
    texts = texts.groupBy("host", "id").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")).withColumn("kind", F.lit(0))
    weighed = kept.drop("chars", "links").join(texts, ["host", "kind", "id"], "left").fillna(0, ["chars", "links"])
    return weighed.groupBy("host").applyInPandas(_template, "host string, tags array<long>, classes array<long>, main array<long>, texts array<long>")


def main_blocks(html: str, tags: list[int], classes: list[int], main: set[int], texts: set[int]) -> list[str]:
    """The blocks of a page's main text by its host's template.

    A page has the tokens of a class equally often; if it doesn't have them in the template's order, or fills no slot of the main
    text, it stands outside of the template and its own elements are weighed. Blocks in elements that few pages have are in the
    slot of the nearest element of the template. Repeated texts go unless they are more than half of what is found: then pages are copies rather than alike.
    """
    opened, blocks = read(html)
    first = {path: k for k, (path, _, _) in reversed(list(enumerate(opened)))}
    members: dict[int, list[int]] = defaultdict(list)
    for t, c in zip(tags, classes):
        if t in first:
            members[c].append(t)
    valid = {t for found in members.values() for t in found}
    ordered = all(at == sorted(at) for at in ([first[t] for t in found] for found in members.values()))
    free = [x for x in blocks if x.node.use == FULL]

    def slot(x: Block) -> int:
        return next((p for p in reversed(x.node.chain) if p in valid), ROOT.path)

    found = [x for x in free if slot(x) in main] if ordered else []
    if not found and free:
        own: dict[int, list] = {}
        for x in free:
            row = own.setdefault(x.node.path, [x.node.path, x.node.chain, x.node.names, x.node.level, 0, 0])
            row[4] += len(x.text)
            row[5] += x.links
        chosen = set(choose([tuple(r) for r in own.values()]))
        found = [x for x in free if x.node.path in chosen]
    alike = [x for x in found if texts and text_path(x.node, x.text) in texts]
    if 2 * sum(len(x.text) for x in alike) <= sum(len(x.text) for x in found):
        gone = set(map(id, alike))
        found = [x for x in found if id(x) not in gone]
    return [x.text for x in found]


def _extracted(batches):
    kept: dict[str, tuple] = {}
    for b in batches:
        texts = []
        columns = [b.column(c) for c in ("tags", "classes", "main", "texts")]
        for k, (host, html) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist())):
            if host not in kept:
                if len(kept) > 1000:
                    kept.clear()
                tags, classes, main, alike = (c[k].as_py() or [] for c in columns)
                kept[host] = (tags, classes, set(main), set(alike))
            texts.append("\n\n".join(main_blocks(html or "", *kept[host])))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks of the main text, two line feeds between) and n_chars for each row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without main text, give an empty text. Pages without a url are one host. Repeated rows each
    give a row; other columns are ignored; an empty table gives no rows. A page alone on its host is its own template.

    Pages are read twice, to deduce templates and to apply them, and don't travel unless the table of templates (a row a host) is too
    large for Spark to broadcast; then a host of very many pages is a skewed join key, which Spark splits.
    """
    rows = with_host(pages)
    known = materialize(templates(rows), "templates")
    kinds = dict(rows.dtypes)
    return rows.join(known, "host", "left").mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
