"""Conversation repair, page extraction and token alignment against brute force, and the pipeline's columns."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowgrid.llm import crosstok, langid, markup, pages, queries, repair

TURNS = "conv_id long, turn long, role string, text string"

# 11: conversations


def cheapest(rows):
    """(cost, audit, lines) by trying all edits from each row and state on; rows: (role, text, fault)."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        steps = []
        if inserted < 3:
            steps += [(3, "I", i, c, f"{r}:", inserted + 1) for c, r in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((4, "D", i + 1, None, None, 0))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                steps.append((more, "K", i + 1, role[:1], f"{role}:{text}", 0))
                steps += [(3 + more, "R", i + 1, c, f"{r}:{text}", 0) for c, r in (("u", "user"), ("a", "assistant"))]
        for cost, edit, to, letter, line, n in steps:
            after = state if letter is None else follows.get((state, letter))
            if after is not None and (rest := best(to, after, n)):
                found.append((cost + rest[0], edit + rest[1], ((line,) if line is not None else ()) + rest[2]))
        return min(found) if found else None

    return best(0, "", 0)


def repaired(table):
    convs = {}
    for c, t, role, text in table:
        rows = convs.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            marked.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        cost, audit, lines = cheapest(tuple(marked))
        letters = [role[:1] for role, *_ in marked]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = Counter(f for *_, f in marked)
        out[c] = (gaps, *(faults[k] for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_turns():
    random.seed(3)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"], ["Hi.", "ok", "What?", "", " \n", None, "yes! ", "no", "Ünd ."]
    return [(c, random.choice([t, t, t, None, t + 1]), random.choice(roles), random.choice(texts)) for c in [*range(150), None] for t in range(random.randint(0, 9)) for _ in range(random.choice([1, 1, 2]))]


@pytest.mark.parametrize("block", [3, repair.BLOCK])
def test_repair_against_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)  # three rows: most conversations are chains of blocks
    table = random_turns()
    df = spark.createDataFrame(table, TURNS).withColumns({c: F.lit(1) for c in ("part", "nth", "sign", "kind", "copy", "block")})
    assert {r[0]: tuple(r)[1:] for r in repair.repair(df).collect()} == repaired(table)


def test_repair_query(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, sf).collect()} == repaired(table)


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 16)
    sys.setrecursionlimit(20_000)
    rows = [(7, t, ("user", "assistant")[t % 2] if t % 11 else "tool", f"Line {t % 90}{'.' if t % 5 else ''}") for t in range(600)]
    got = repair.repair(spark.createDataFrame(rows, TURNS).repartition(6)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == repaired(rows)


def test_repair_of_nothing(spark):
    assert repair.repair(spark.createDataFrame([], TURNS)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repair.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]


# 12: pages


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "text", "tags", "main", "texts")})
    return {r.page_id: (r.text, r.n_chars) for r in pages.extract(df).collect()}


def test_pages_query_gives_the_articles(spark, sf):
    import html

    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in queries.op12_html_extraction(spark, sf).collect()}
    assert want and got == want


def test_layouts_without_an_article_element(spark):
    """A site of divs: the slot with the most text outside links is the main one; menus, notices, sidebars, comments and forms go."""
    rows, want = [], {}
    for k in range(14):
        paragraphs = [f"Sentence {k} of paragraph {j} tells &amp; retells what number {k * j} means to its neighbours." for j in range(1 + k % 4)]
        body = f"""<div class="topbar menu"><a href=/>Home</a> <a href=/{k}>Item {k}</a></div><div class="cookie-notice">We use cookies {k}</div>
            <div class=wrap><div class="body-text"><h2>Heading {k}</h2>{''.join(f'<p>{p}<br>' for p in paragraphs)}<ul><li>point {k}<li>other <b>po</b>int of {k}</ul></div>
            <div id="sidebar"><p>Long sidebar text about sponsors and friends, the same words and more {k}.</div>
            <div class="links-block"><a href=/1>One more story {k}</a> <a href=/2>And another longer story title {k}</a></div></div>
            <form><p>Name <input name=q> please</form><section class="comments"><p>I disagree with {k} strongly and at great length, dear author!</section>
            <script>if (a < b) document.write("<p>no</p>")</script><p hidden>secret {k}</p><footer>(c) 2020</footer>"""
        rows.append((k, f"https://Site.Example:8080/{k}", page(body)))
        want[k] = "\n\n".join([f"Heading {k}", *(p.replace("&amp;", "&") for p in paragraphs), f"point {k}", f"other point of {k}"])
    got = extracted(spark, rows)
    assert {k: t for k, (t, _) in got.items()} == want and all(n == len(t) for t, n in got.values())


def test_repeated_texts_and_copies(spark):
    """A line on all pages of a host goes, a passage on some stays, and pages that are copies of each other keep their text."""
    shared = "A passage of some length that a third of the pages share, word for word, as passages do."
    rows = [(k, "http://a.org/x", page(f"<article><p>Read on our app today.</p><h1>Title {k}</h1><p>Own text {k} with several words.</p>{f'<p>{shared}</p>' if k % 3 == 0 else ''}</article>")) for k in range(30)]
    rows += [(100 + k, "http://b.org/", page("<article><h1>One</h1><p>The same text on all pages.</p></article>")) for k in range(12)]
    got = extracted(spark, rows)
    assert all(got[k][0] == "\n\n".join([f"Title {k}", f"Own text {k} with several words."] + [shared] * (k % 3 == 0)) for k in range(30))
    assert {got[100 + k] for k in range(12)} == {("One\n\nThe same text on all pages.", 32)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no url at all", ""), (3, "http://x.org", "plain &lt;text&gt; only"), (4, "http://y.org", "<p>un<i>clos</i>ed <a href='>'>link</a> and text < here"), (5, "http://z.org", "<nav><p>menu</p></nav>"), (None, "http://x.org/2", "<article><header><h1>Head</h1><p>by me</p></header>a<br/>b&nbsp;c<!-- no --><style>p{}</style><p>d</article>"), (6, "http://w.org", "<script>never closed <p>x</p>"), (6, "http://w.org", "<div>" * 3000 + "deep")]
    got = extracted(spark, rows[:-1] + [(7, "http://w.org", rows[-1][2])])
    assert {k: t for k, (t, _) in got.items()} == {1: "", 2: "", 3: "plain <text> only", 4: "unclosed link and text < here", 5: "", None: "Head\n\na b c\n\nd", 6: "", 7: "deep"}
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_vectors_make_classes():
    tokens = {1: (10, [1]), 2: (10, [1, 2]), 3: (20, [1, 2, 3]), 4: (20, [1, 2, 3, 4]), 5: (20, [1, 5])}
    parts = pages._nested(tokens)
    assert parts[1] == parts[2] and parts[3] == parts[4] == parts[5] and parts[1] != parts[3]
    opened, blocks = markup.read("<ul><li>a<li>b<ul><li>c</ul></ul><p>d<p>e")
    assert [b.text for b in blocks] == ["a", "b", "c", "d", "e"] and len({b.node.path for b in blocks}) == 3


# 13: tokens of two vocabularies


def aligned(v, text):
    """(A ids, B ids, groups as text, linked pairs) by sets of ends, or None."""
    if not text:
        return None
    a, b, raw = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text), (" " + text).encode()
    if any(b"".join(names[i] for i in ids) != raw for names, ids in ((v.bytes_a, a), (v.bytes_b, b))):
        return None
    ends_a, ends_b = (np.cumsum([len(names[i]) for i in ids]).tolist() for names, ids in ((v.bytes_a, a), (v.bytes_b, b)))
    groups, links, x, y = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
        links.append((a[p - 1], b[q - 1]))
        x, y = p, q
    return a, b, ";".join(groups), links


def test_alignment_against_whole_texts(spark, docs):
    random.seed(1)
    letters = [*"ab cde  \n\n\t  .,!?'s't1290 éßñ日本語ü", *" 　\r\x0b▁\x00😀​\x1ć", "<s>", "<|endoftext|>", "'ll", "  "]
    texts = ["".join(random.choice(letters[:34] if random.random() < 0.8 else letters) for _ in range(random.randint(0, 30))) for _ in range(400)]
    texts += [None, "", " ", "\n", "same text", "same text", "a▁b", "x" * 3000, "word " * 5000] + [r.text for r in docs.limit(20).collect()]
    v = crosstok.vocabularies(*crosstok.default_paths())
    want = [aligned(v, t) for t in texts]
    counts = Counter(pair for w in want if w for pair in w[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(3) for c in ("n_a", "pairs", "times", "n")}).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in crosstok.align_tokens(df).collect()}
    for k, w in enumerate(want):
        row = (0,) * 6 + ("",) if w is None else (len(w[0]), len(w[1]), w[2].count(";") + 1, len(w[3]), sum(counts[p] == most[p[1]] for p in w[3]), sum(counts[p] for p in w[3]), hashlib.sha256(w[2].encode()).hexdigest())
        assert got[k] == row, (texts[k] or "")[:80]
    assert sum(w is None for w in want) > 20


def test_small_caches_and_odd_tables(spark, monkeypatch):
    v = crosstok.vocabularies(*crosstok.default_paths())
    chunks = crosstok.Chunks(v, keep=5)
    for texts in (["one two three", "four five six seven"], ["one two", "seven eight nine ten eleven"]):
        at, upto, fine = chunks.align(texts)
        for k, t in enumerate(texts):
            assert fine[k] and ";".join(chunks.text[i] for i in at[upto[k] : upto[k + 1]]) == aligned(v, t)[2]
        chunks.forget()
        assert len(chunks.index) == len(chunks.text) == 5
    none = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.align_tokens(none).count() == 0
    got = crosstok.align_tokens(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert [r.doc_id for r in got] == [None, None] and {r.count_sum for r in got} == {2}


def test_groups_break_where_a_start_reaches_the_maximum():
    a, b = crosstok.coalesce(np.array([0, 2, 5, 6]), np.array([2, 5, 6, 9]), np.array([0, 1, 5, 7]), np.array([1, 5, 7, 9]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 0, 1, 1]


# the pipeline's columns


def test_any_column_goes_through_the_stages(spark, sf):
    rows = [(k, f"A line of its own, number {k}.\nThe line that all of these documents have in common here.", "en", "s", 1, f"kept {k}", -7, k) for k in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, n_lines long, `n_removed` long"
    docs = spark.createDataFrame(rows, schema).withColumn("line_links", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("document", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all(r["a.b"] == f"kept {r.doc_id}" and r.n_lines == -7 and r.n_removed == r.doc_id and r.line_links == "mine" for r in out.collect())
    cut = {r.doc_id: r for r in corpus_pipeline.remove_lines(spark, docs, sf).collect()}
    assert "in common" in cut[0].text and all("in common" not in cut[k].text and cut[k].n_chars == len(cut[k].text) for k in range(1, 6))


def test_numerals_are_no_letters(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["² ½ Ⅷ ①", "12 … _", "² a"])] + [(10 + k, "some words here") for k in range(9)], "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") > 9, "en"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.train(df)).collect()}
    assert (got[0], got[1], got[2]) == ("und", "und", "en")
