"""Each text operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowgrid.functions.storage import fresh_path
from flowgrid.llm import align, chat, decontam, langid, licenses, line_dedup, packing, quality, queries, simhash, store, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = tokens.default_path()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and blank texts, repeated rows and ids, a long text, and columns with the operators' own names."""
    long = " ".join(f"word{k % 3000}" for k in range(60_000))
    rows = [(1, "the cat sat on the mat\nthe cat sat on the mat", "en"), (1, "another text with the same id here", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "en"), (None, "no id here at all", "en"), (5, long, "en"), (6, "le chat est là", "fr"), (6, "le chat est là", "fr"), (7, "… ¿ 日本語", None)]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in ("rank", "fp", "score", "part", "block", "words", "lines", "n", "h", "s", "at", "key", "text_hash", "n_lines")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# 1: language


def code_length(training, text):
    """Bit units of the shortest-context-first definition, byte by byte over dictionaries."""
    counts = [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
    pad = b" " * langid.ORDER
    for t in training:
        b = pad + t.lower().encode()
        for i in range(langid.ORDER, len(b)):
            for k in range(langid.ORDER + 1):
                counts[k][b[i - k : i]][b[i]] += 1
    total, b = 0, pad + text.lower().encode()
    for i in range(langid.ORDER, len(b)):
        for k in range(langid.ORDER, -1, -1):
            seen = counts[k].get(b[i - k : i])
            if seen and b[i] in seen:
                total += round(-langid.BIT * math.log2(seen[b[i]] / (sum(seen.values()) + len(seen))))
                break
            if seen:
                total += round(-langid.BIT * math.log2(len(seen) / (sum(seen.values()) + len(seen))))
        else:
            total += 8 * langid.BIT
    return total


def test_ppm_code_lengths():
    training = {"x": ["the cat sat", "on the mat"], "y": ["le chat là", "çà et là"]}
    texts = ["the mat là", "zzz ß 日", "", "a"]
    got = langid.PPM(training).code_lengths(texts)
    assert got.tolist() == [[code_length(training[k], t) for k in "xy"] for t in texts]


def test_key_table_finds_colliding_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    t = langid.KeyTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1 << 63)) == -1).all()


def test_language_held_out(spark, docs):
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_language_odd_rows(odd, none):
    got = langid.identify(odd, langid.train(odd)).collect()
    assert len(got) == 10 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    assert langid.identify(none, langid.train(none)).count() == 0


def test_samples_are_bounded_by_rows(spark):
    """One doc_id with very many rows, equal and different ones, gives no more rows than the bound."""
    i = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(str(i).encode()) % 4 != 2)
    same = spark.range(20_000).select(F.lit(i).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    other = spark.range(3_000).select(F.lit(i).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    few = spark.range(60, 90).select(F.col("id").alias("doc_id"), F.lit("un texte").alias("text"), F.lit("fr").alias("lang"))
    docs = same.unionByName(other).unionByName(few)
    got = Counter(r.lang for r in langid.training_sample(docs, 40).collect())
    assert got["en"] == 40 and 0 < got["fr"] <= 30
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("lang") == "en").cast("int").alias("toxic"))
    kinds = Counter(r.toxic for r in toxicity.training_sample(docs, labels, 40).collect())
    assert kinds[1] == 40 and 0 < kinds[0] <= 30


# 2: lines


def brute_lines(rows):
    """Lines kept by text, by comparing every line with all earlier sets that share a word."""
    out, sets, by_word, seen = {}, [], defaultdict(list), set()
    for i, t in sorted(rows):
        keep = []
        for line in t.split("\n"):
            w = frozenset(WORD.findall(line.lower()))
            if not w:
                keep.append(line)
                continue
            shared = Counter(k for x in w for k in by_word[x])
            if not any(9 * n >= 4 * (len(w) + len(sets[k])) for k, n in shared.items()):
                keep.append(line)
            if w not in seen:
                seen.add(w)
                sets.append(w)
                for x in w:
                    by_word[x].append(len(sets) - 1)
        out[i] = "\n".join(keep)
    return out


def test_lines_against_brute_force(spark, docs):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(texts_of(docs))


def test_lines_of_a_dense_group(spark):
    r = np.random.default_rng(3)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.integers(0, 6)):
            w[r.integers(0, 40)] = f"x{r.integers(0, 30)}"
        rows.append((i, " ".join(w) + "\nlast " + str(i % 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df, links=True).collect()
    assert {x.doc_id: x.text for x in got} == brute_lines(rows)
    sets = {i: frozenset(t.split("\n")[0].split()) for i, t in rows}
    want = {i: sum(9 * len(a & b) >= 4 * (len(a) + len(b)) for b in set(sets.values()) - {a}) for i, a in sets.items()}
    assert {x.doc_id: y.n_links for x in got for y in x.line_links if y.line_no == 0} == want
    stored = line_dedup.materialize(line_dedup.line_sets(df), "test-sets")
    blocks, _ = line_dedup.family_blocks(line_dedup.materialize(line_dedup.line_classes(stored, line_dedup.rarity(stored)), "test-classes"))
    assert 1 < blocks.agg(F.max(F.size("members"))).first()[0] <= line_dedup.BLOCK


def test_every_link_of_a_line_is_counted(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(60):
        w = [f"w{k}" for k in range(20)]
        for _ in range(r.integers(0, 4)):
            w[r.integers(0, 20)] = f"x{r.integers(0, 9)}"
        rows.append((i, " ".join(w) + f"\nalone{i} {i}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line_links", F.lit(1))
    got = line_dedup.dedup_lines(df, links=True).collect()
    assert {x.doc_id: x.text for x in got} == brute_lines(rows)
    sets = {(i, n): frozenset(line.split()) for i, t in rows for n, line in enumerate(t.split("\n"))}
    want = {k: sum(9 * len(a & b) >= 4 * (len(a) + len(b)) for b in set(sets.values()) - {a}) for k, a in sets.items()}
    assert {(x.doc_id, y.line_no): y.n_links for x in got for y in x.line_links} == want and max(want.values()) > 10
    class_of = {(x.doc_id, y.line_no): y.class_id for x in got for y in x.line_links}
    assert len(set(class_of.values())) == len({(class_of[k], a) for k, a in sets.items()}) == len(set(sets.values()))


def test_edits_in_a_family_leave_a_line_with_another(spark):
    # 20 words, one replaced at each place and by three words: with one family of the four least hashes, those edited there stood alone
    rows = [(3 * i + j, " ".join(f"y{i}{j}" if k == i else f"w{k}" for k in range(20))) for i in range(20) for j in range(3)]
    sets = line_dedup.materialize(line_dedup.line_sets(spark.createDataFrame(rows, "doc_id long, text string")), "test-sets")
    classes = line_dedup.materialize(line_dedup.line_classes(sets, line_dedup.rarity(sets)), "test-classes")
    blocks, _ = line_dedup.family_blocks(classes)
    assert blocks.filter("size(members) > 1").agg(F.sum(F.size("members"))).first()[0] >= 50
    assert line_dedup.class_links(classes, sets).agg(F.sum("n_links"), F.min("n_links")).first() == (60 * 59, 59)


def test_line_query_gives_links(spark, sf):
    assert "line_links" in queries.op2_line_dedup(spark, sf).columns


def test_lines_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == 10
    assert [r.text for r in got if r.doc_id == 2] == [None] and [r.text for r in got if r.doc_id == 1 and r.n_lines == 2] == ["the cat sat on the mat"]
    assert [r.text for r in got if r.doc_id == 6] == ["le chat est là"] * 2
    assert line_dedup.dedup_lines(none).count() == 0


# 3: benchmark copies


def test_local_alignment():
    assert align.align([1, 2, 3, 4], [9, 1, 2, 3, 4, 9], -5, 6)[:2] == (8, 4)
    assert align.align([1, 2, 3, 4, 5], [1, 2, 9, 4, 5], -5, 5)[:2] == (7, 4)
    assert align.align([1], [2], -1, 1) == (0, 0, 0, 0, 0, 0)
    # against the full table
    r = np.random.default_rng(5)
    for _ in range(30):
        a, b = r.integers(0, 4, 9).tolist(), r.integers(0, 4, 12).tolist()
        h = np.zeros((10, 13))
        for i in range(9):
            for j in range(12):
                h[i + 1, j + 1] = max(0, h[i, j] + (align.MATCH if a[i] == b[j] else align.MISMATCH), h[i, j + 1] + align.GAP, h[i + 1, j] + align.GAP)
        assert align.align(a, b, -20, 20)[0] == h.max()


def test_copies_and_edited_copies(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    whole = {(i, k) for i, t in texts_of(docs) for k, b in items if " ".join(re.findall(r"\w+", b.lower())) in " ".join(re.findall(r"\w+", t.lower()))}
    assert whole and whole <= got
    words = items[0][1].split()
    edited = [w if k % 6 else f"changed{k}" for k, w in enumerate(words)]
    planted = spark.createDataFrame([(1, "before it " + " ".join(edited) + " after it"), (2, "nothing of the kind here"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(planted, bench).collect()} == {(1, items[0][0])}


@pytest.mark.parametrize(("step", "matched"), [(4, 30), (5, 32)])
def test_frequent_edited_copies(spark, step, matched):
    words = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    edited = "before " + " ".join(f"changed{k}" if k % step == step - 1 else w for k, w in enumerate(words)) + " after"
    rows = [(k, edited if k < 20 else f"filler text number {k}") for k in range(1000)]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.n_matched) for r in got} == {(k, matched) for k in range(20)}


def test_whole_alignment_against_the_band_of_all_diagonals():
    r = np.random.default_rng(6)
    for _ in range(60):
        a, b = r.integers(0, 4, 9), r.integers(0, 4, r.integers(0, 14))
        want = align.align(a.tolist(), b.tolist(), -9, len(b))
        got = align.align_whole(a, b, 1)
        assert (got is None and want[0] == 0) or got[0] == want[0]
        least = align.align_whole(a, b, 5)
        assert least is None or (least[1] >= 5 and least[0] <= want[0])
        assert want[1] < 5 or least[0] == want[0]
    assert align.align_whole(np.arange(6), np.array([0, 1, 2, 9, 9, 3, 4, 5, 9]), 3) == (10, 6, 0, 8)


def test_copies_whose_parts_drift_apart(spark):
    words = [f"w{k}" for k in range(45)]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    between = lambda k: [f"comment{k}x{j}" for j in range(15)]
    drifted = ["before", *words[:15], *between(1), *words[15:30], *between(2), *words[30:], "after"]
    df = spark.createDataFrame([(1, " ".join(drifted)), (2, " ".join(["far"] * 400 + drifted)), (3, " ".join(words[:15]))], "doc_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.score, r.n_matched, r.begin_word, r.end_word) for r in got} == {(1, 60, 45, 1, 76), (2, 60, 45, 401, 476)}


def test_windows_lose_no_alignment():
    r = np.random.default_rng(11)
    for _ in range(20):
        item = [f"w{k}" for k in r.integers(0, 30, 20)]
        text = [f"w{k}" for k in r.integers(0, 60, 300)]
        at = int(r.integers(0, 250))
        text[at : at + 20] = [w if r.random() < 0.75 else "x" for w in item]
        block = decontam.Items([(1, " ".join(item))])
        held = align.align(item, text, -len(item), len(text))
        got = [(x[2], x[4]) for x in block.matches([" ".join(text)])]
        assert held[1] < 10 or got[0] >= held[:2]  # of equal scores the one with more matches
        assert not got or (got[0][0] <= held[0] and got[0][1] >= 10)


def test_query_against_whole_tables(spark, docs, sf):
    """Every text against every item with the whole alignment table: the copies of the query and no others."""
    items = [(r.item_id, re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    number = {w: k for k, w in enumerate(dict.fromkeys(w for _, x in items for w in x))}
    want = {}
    for i, t in texts_of(docs):
        text = re.findall(r"\w+", (t or "").lower())
        b = np.array([number.get(w, -1) for w in text], np.int64)
        held = Counter(text)
        for k, x in items:
            if sum(min(n, held[w]) for w, n in Counter(x).items()) >= math.ceil(len(x) / 2):
                found = align.align_whole(np.array([number[w] for w in x]), b, decontam.least_matches(len(x)))
                if found:
                    want[i, k] = found[:2]
    got = {(r.doc_id, r.item_id): (r.score, r.n_matched) for r in queries.op3_decontamination(spark, sf).collect()}
    assert want and got == want


@pytest.mark.parametrize("share", [0.1, 0.2, 1 / 3, 0.4])
@pytest.mark.parametrize("how", ["replaced", "inserted", "spread"])
def test_no_edit_breaks_all_seeds(spark, share, how):
    """Items with a share of their words replaced (evenly or anywhere) or with as many words put between: all are found."""
    r = np.random.default_rng(int(100 * share))
    common = [f"c{k}" for k in range(25)]
    items, rows = [], []
    for k in range(30):
        words = [str(w) for w in r.choice(common, 30)] if k % 2 else [f"i{k}w{j}" for j in range(30)]
        items.append((k, " ".join(words)))
        n = int(share * 30)
        if how == "inserted":
            out = [x for j, w in enumerate(words) for x in ([w, f"new{j}"] if j * share % 1 + share >= 1 else [w])]
        else:
            gone = set(np.linspace(0, 29, n).astype(int).tolist()) if how == "spread" else set(r.choice(30, n, replace=False).tolist())
            out = [f"new{j}" if j in gone else w for j, w in enumerate(words)]
        rows.append((k, " ".join(["far"] * int(r.integers(0, 200)) + out + ["off"] * 30)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {(k, k) for k in range(30)} <= got


def test_subsequence_bound():
    r = np.random.default_rng(3)

    def common(a, b):
        h = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                h[j + 1], before = before + 1 if x == y else max(h[j + 1], h[j]), h[j + 1]
        return h[-1]

    block = decontam.Items([(k, " ".join(f"w{x}" for x in r.integers(0, 9, n))) for k, n in enumerate((150, 64, 12))])
    for _ in range(60):
        k, text = int(r.integers(0, 3)), r.integers(-1, len(block.vocabulary), int(r.integers(1, 300)))
        key = np.where(text >= 0, k * len(block.vocabulary) + text, -1)
        row = np.minimum(np.searchsorted(block.placed, key), len(block.placed) - 1)
        masks = np.where((block.placed[row] == key)[:, None], block.places[row], np.uint64(0))
        assert block._common(masks, np.array([0]), np.array([len(text)]), block.size[[k]])[0] == common(block.items[k], text.tolist())


def test_short_items_and_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "one two three"), (5, "only two"), (6, "alpha beta gamma delta")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x one two three y"), (2, "only two"), (3, "alpha beta gamma"), (4, "two only")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_matched) for r in decontam.contaminated(df, bench).collect()} == {(1, None, 3), (2, 5, 2), (3, 6, 3)}


def test_copies_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench).collect()} == {(1, 1)}
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0
    assert decontam.without_copies(odd, bench).columns == odd.columns


def test_blocks_of_items_give_the_same(spark, docs, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {tuple(r) for r in decontam.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontam, "blocks", lambda b, real=decontam.blocks: real(b, 300))
    assert {tuple(r) for r in decontam.contaminated(docs, bench).collect()} == one


# 4: chat


def test_rotation_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    sql = con.sql(queries.OP4_SQL)
    want = sorted(tuple(map(str, r)) for r in con.sql(f"select {', '.join(sorted(sql.columns))} from ({queries.OP4_SQL})").fetchall())
    got = queries.op4_chat_rotation(spark, sf)
    assert sorted(tuple(map(str, r)) for r in got.select(*sorted(got.columns)).collect()) == want


def test_rotation_masks_and_odd_rows(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, None, "é"), (2, None, "ann", "loose"), (None, 0, "ann", "x"), (3, 0, "system", "alone"), (4, 1, "ann", "a"), (4, 1, "ann", "a")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, speaker int")
    got = chat.rotate(df).collect()
    assert {(r.conv_id, r.speaker) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "ann"), (4, "ann")}
    ann = next(r for r in got if (r.conv_id, r.speaker) == (1, "ann"))
    assert [ann.text[s.begin : s.end] for s in ann.spans] == ["hi < |end|>\n<|end|>"] and ann.text.count("<|assistant|>") == 1
    assert next(r for r in got if r.conv_id == 4).n_turns == 2
    assert chat.rotate(df.limit(0)).count() == 0
    parts = chat.rotate(spark.createDataFrame([(1, k, "ab"[k % 2], "t") for k in range(10)], "conv_id long, turn long, role string, text string"), part_turns=4)
    assert sorted((r.speaker, r.part, r.n_turns) for r in parts.collect()) == [(s, p, n) for s in "ab" for p, n in ((0, 4), (1, 4), (2, 2))]


# 5: toxicity


def test_gradients_are_right():
    w, net = toxicity.Words(["the idiot went home", "a b c d e f " * 9, ""]), toxicity.Network()
    r = np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) + r.standard_normal(v.shape) * 0.1 for k, v in net.p.items()}
    win, doc, _ = w.windows()
    y = np.array([1.0, 0.0, 0.0])[doc]
    g = net.gradients(w, win, y)

    def loss():
        s = 1 / (1 + np.exp(-net.forward(w.features(net.p["word"], net.p["char"]), win)))
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old = v[at]
        v[at] = old + 1e-3
        up = loss()
        v[at] = old - 1e-3
        down = loss()
        v[at] = old
        assert abs(g[k][at] - (up - down) / 2e-3) < 1e-4 * max(1, abs(g[k][at])), k


def test_windows_cover_every_word():
    w = toxicity.Words([" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 31, 32, 33, 56, 57, 200)])
    win, doc, n = w.windows()
    first = np.cumsum(w.count) - w.count
    for d, size in enumerate(w.count):
        seen = set(win[doc == d].ravel().tolist()) - {-1}
        assert seen == set(w.index[first[d] : first[d] + size].tolist())


def test_scores_against_one_window_at_a_time():
    net, r = toxicity.Network(), np.random.default_rng(8)
    net.p = {k: (v + r.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in net.p.items()}
    texts = [" ".join(f"w{int(x)}" for x in r.integers(0, 50, n)) for n in (1, 20, 33, 90, 300)]
    for text, got in zip(texts, net.score(texts)):
        words = text.split()
        starts = range(0, max(1, -(-(len(words) - toxicity.WINDOW) // toxicity.STRIDE) + 1) * toxicity.STRIDE, toxicity.STRIDE)
        alone = [float(net.score([" ".join(words[k : k + toxicity.WINDOW])])[0]) for k in starts]
        assert abs(max(alone) - got) < 1e-5


def test_the_last_window_of_a_long_text_trains():
    clean, bad = " ".join(["calm"] * 6000), " ".join(["calm"] * 5980 + ["vile"] * 20)
    net = toxicity.Network()
    net.fit([clean, bad] * 6, [0, 1] * 6, 40)
    assert net.score([bad])[0] > net.score([clean])[0] + 0.2


def test_toxicity_learns(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    net = toxicity.train(docs, labels)
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), net).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    bad, good = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert np.mean(bad) > 0.85 and np.mean(good) < 0.05


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    net = toxicity.train(odd, labels)
    got = toxicity.score(odd, net).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, net).count() == 0 and toxicity.without_toxic(odd, net).columns == odd.columns


# 6: licenses


def test_every_template_is_found_and_measured(spark):
    rows = [(k, f"Some words before. {text}\nAnd after it") for k, (_, _, text) in enumerate(licenses.TEMPLATES)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for k, (name, lic, text) in enumerate(licenses.TEMPLATES):
        hit = [r for r in got if r.doc_id == k and r.template == name]
        assert len(hit) == 1 and hit[0].coverage == 1 and hit[0].license == lic
        assert rows[k][1][hit[0].begin : hit[0].end].lower() == text.lower().rstrip("./")


def test_edited_license_and_lines_in_the_corpus(spark, docs):
    text = licenses.TEMPLATES[1][2].replace("governing", "that governs").replace("agreed to", "settled")
    got = licenses.scan(spark.createDataFrame([(1, text), (2, "no license here"), (3, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.template) for r in got} == {(1, "apache-2.0-line"), (1, "apache-2.0-header")}
    want = {(i, n) for i, t in texts_of(docs) for n, _, x in licenses.TEMPLATES if x.rstrip(".").lower() in t.lower()}
    assert want <= {(r.doc_id, r.template) for r in licenses.scan(docs).collect()}


@pytest.mark.parametrize(
    ("text", "license"),
    [
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ],
)
def test_relatives_come_out_under_their_own_name(text, license):
    index = licenses.Index()
    assert {index.templates[x[0]][1] for x in index.scan([f"before {text} after"])[0]} == {license}


def test_no_template_comes_out_under_another_name():
    index = licenses.Index()
    for (name, lic, _), found in zip(index.templates, index.scan([t for _, _, t in index.templates]), strict=True):
        assert {index.templates[x[0]][1] for x in found} == {lic}, name


def test_spans_count_the_text_as_given():
    index, text = licenses.Index(), "İİİİ notes. Released under the MIT License. End"
    ((_, _, _, begin, end),) = index.scan([text])[0]
    assert text[begin:end] == "Released under the MIT License"


def test_inserts_stay_one_place():
    words = next(t for n, _, t in licenses.TEMPLATES if n == "mit-permission").split()
    put = ["six", "quite", "other", "words", "stand", "here"]
    text = " ".join(["start", *words[:25], *put, *words[25:50], *put, *words[50:], "stop"])
    index = licenses.Index()
    found = [x for x in index.scan([text])[0] if index.templates[x[0]][0] == "mit-permission"]
    assert len(found) == 1 and found[0][1] == 1 and text[found[0][3] : found[0][4]] == " ".join(text.split()[1:-1]).rstrip(".")


def test_a_text_s_licenses_depend_on_nothing_else(docs):
    index, texts = licenses.Index(), [t or "" for _, t in sorted(texts_of(docs))]
    assert index.scan(texts) == [index.scan([t])[0] for t in texts]


def test_licenses_against_whole_alignments(docs):
    """Every template against every whole text without a band: what is found there and shares a run of four words is found."""
    index = licenses.Index()
    for _, t in sorted(texts_of(docs))[:60]:
        t = (t or "") + "\nReleased under the MIT License.\n"
        words, got = [w.lower() for w in licenses.WORD.findall(t)], index.scan([t])[0]
        places, runs = {(x[0]) for x in got}, {tuple(words[k : k + 4]) for k in range(len(words) - 3)}
        for k, a in enumerate(index.words):
            if runs & {tuple(a[j : j + 4]) for j in range(len(a) - 3)}:
                found = align.align(a, words, -len(a), len(words))
                covered = any(2 * found[1] - len(a) <= 2 * x[2] - len(index.words[x[0]]) for x in got)
                assert found[1] < licenses.COVERAGE * len(a) or k in places or covered


def test_licenses_odd_rows(odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


# 7 and 9: tokens


def encoded(texts, end):
    from tokenizers import Tokenizer

    return [np.array([*e.ids, end], "<u4") for e in Tokenizer.from_file(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_chunks_encode_like_whole_texts():
    texts = ["a.<|endoftext|>, b<|ENDOFTEXT|>. ÀÉ, x.. ...,., É. 1, _,", "Ünï  don't 'S  \x1cx y z é ́a Σς ΑΣ", "", "  ", "İ I'LL 12.5 ²x", "the, The. THE the"]
    for keep in (0, 3, 1000):
        ids, at = tokens.ChunkEncoder(VOCABULARY, keep).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e[:-1].tolist() for e in encoded(texts, 0)]


def test_the_encoder_forgets_chunks_that_did_not_come_again():
    code, want = tokens.ChunkEncoder(VOCABULARY, 8), encoded(texts := [f"once{k} again{k // 40 % 2} often, a.b" for k in range(80)], 0)
    for t, ids in zip(texts, want):
        assert code.encode([t])[0].tolist() == ids[:-1].tolist() and code.chunks == len(code.index) <= 8
    assert {"often,", "a.b", "again1"} <= set(code.index) and sorted(code.index.values()) == list(range(code.chunks))


def test_few_texts_of_an_arrow_batch_are_strings_at_once():
    import pyarrow as pa

    texts = ["é" * 30, None, "", "x" * 500, *["ab"] * 100, None]
    got = list(tokens.text_batches(pa.array(texts).slice(0), 100))
    assert [t for *_, some in got for t in some] == [t or "" for t in texts]
    assert [lo for lo, *_ in got] == [0, *(hi for _, hi, _ in got[:-1])] and got[-1][1] == len(texts) and len(got) == 4
    assert all(len(some) == 1 or sum(len(t.encode()) for t in some) <= 100 for *_, some in got)
    assert list(tokens.text_batches(pa.array([], pa.string()))) == []
    assert [t for *_, some in tokens.text_batches(pa.array(texts).slice(3, 5), 100) for t in some] == texts[3:8]
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    packed = list(packing._pieces(VOCABULARY, 4096, 1)([docs]))
    assert [i for b in packed for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))


def test_fuzzed_texts_encode_like_the_library(tmp_path):
    r = np.random.default_rng(12)
    parts = [*"aZéÉÜñÅŸŊǅŉǰİıſßΣσς.,'-3²٣\u0301\u0307\u0328\u0344\u212b\ufb01日한", "\u1112\u1161\u11ab", "<|endoftext|>", "<|", "'S", "I'LL", " ", " ", "  ", "\n", "\t", "\x0b", "\x85", "\u00a0", "\u2003", "\u3000"]
    texts = ["".join(parts[k] for k in r.integers(0, len(parts), r.integers(1, 14))) for _ in range(20_000)] + ["3Aİ\u0327", "a İ. b", "Ǆ. ŉ. ẞ,"]
    want = [e[:-1].tolist() for e in encoded(texts, 0)]
    ids, at = tokens.ChunkEncoder(VOCABULARY).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    # a vocabulary that keeps case is told by its rules and encodes whole texts
    import json

    rules = json.loads(open(VOCABULARY, encoding="utf-8").read())
    rules["normalizer"]["normalizers"] = rules["normalizer"]["normalizers"][:2]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    from tokenizers import Tokenizer

    ids, at = tokens.ChunkEncoder(str(path)).encode(texts[:300])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(texts[:300], add_special_tokens=False)]


def test_token_files_round_trip(spark, docs):
    path = fresh_path(spark, "test-tokens")
    store.write_tokens(docs, path, VOCABULARY)
    got = store.digest(store.read_tokens(spark, path)).orderBy("doc_id").collect()
    rows, at = sorted(texts_of(docs)), 0
    for r, (i, _), ids in zip(got, rows, encoded([t for _, t in rows], 2), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    some = store.read_tokens(spark, path, 10, 12, ids=False)
    assert [(r.doc_id, r.start) for r in some.orderBy("doc_id").collect()] == [(r.doc_id, r.start) for r in got if 10 <= r.doc_id <= 12]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in some._jdf.queryExecution().toString() and "ids" not in some.columns


def test_token_file_layout(spark, docs, tmp_path):
    store.write_tokens(docs, f"file://{tmp_path}/t", VOCABULARY)
    group = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    ids = next(c for p, c in columns.items() if p.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


def test_token_files_odd_rows(spark, odd, none):
    path = fresh_path(spark, "test-tokens")
    store.write_tokens(odd, path, VOCABULARY)
    got = store.read_tokens(spark, path).collect()
    assert len(got) == 10 and [r.ids for r in got if r.doc_id in (2, 3)] == [[2], [2]]
    assert sorted(r.start for r in got)[0] == 0 and len({r.start for r in got}) == 10
    store.write_tokens(none, path, VOCABULARY)
    assert store.read_tokens(spark, path).count() == 0


def is_packed(pieces, capacity):
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs):
    got = packing.pack_documents(docs, VOCABULARY).collect()
    rows = texts_of(docs)
    ids = dict(zip([i for i, _ in rows], encoded([t for _, t in rows], 1)))
    assert sum(p.length for p in got) == sum(map(len, ids.values()))
    for p in got:
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length]) == p.ids_crc32 and p.start == p.piece * 4096
    n, least = is_packed(got, 4096), -(-sum(p.length for p in got) // 4096)
    assert least <= n <= least + max(1, least // 50)


def best_fit_one_by_one(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_plan_is_best_fit(spark):
    r = np.random.default_rng(2)
    for _ in range(40):
        cap = int(r.integers(5, 60))
        lengths = r.integers(1, cap + 1, r.integers(1, 200)).tolist()
        hist = Counter(lengths)
        slots = packing.plan_slots(dict(hist), cap)
        assert len({s[3] + k for s in slots for k in range(-(-s[2] // s[4]))}) == best_fit_one_by_one(lengths, cap)
        assert all(sum(s[2] for s in slots if s[0] == x) == n for x, n in hist.items())


def test_packing_odd_rows(odd, none):
    got = packing.pack_documents(odd, VOCABULARY).collect()
    assert is_packed(got, 4096) and {p.doc_id for p in got} == {1, 2, 3, 4, 5, 6, 7, None}
    assert packing.pack_documents(none, VOCABULARY).count() == 0


# 8: simhash


def brute_fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_triples_cover_all_choices_of_four():
    from itertools import combinations

    assert len(simhash.triples()) == 20
    assert all(any(set(t) <= set(four) for t in simhash.triples()) for four in combinations(range(8), 4))


def test_simhash_against_brute_force(spark, docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts_of(docs)}
    assert {i: f"{f:016x}" for i, f in fps.items()} == {i: r.fingerprint for i, r in got.items()}
    group = {i: i for i in fps}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    assert {i: root(i) for i in ids} == {i: r.component_id for i, r in got.items()}


def test_links_near_the_limit(spark):
    r = np.random.default_rng(4)
    base = [int(x) for x in r.integers(0, 1 << 62, 40)]
    fps = {b ^ sum(1 << int(k) for k in r.choice(64, n, replace=False)) for b in base for n in (0, 1, 3, 4, 5)}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert got == want and want


def test_one_of_a_group_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7, 8), (2, "a b c d e", 9, 1), (None, "a b c d e", 1, 1)], "doc_id long, text string, _place int, stays int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.filter("doc_id is null or doc_id = 1").collect()))


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    kept = simhash.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6, 7]
    assert simhash.near_duplicates(none).count() == 0


# 10: quality


def brute_base(text):
    w = WORD.findall(text or "")
    tri, inside = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if tri[tuple(w[k : k + 3])] > 1:
            inside |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_quality_base_and_ratio(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    counts = quality.bucket_counts(docs, quality.trusted_ids(labels))
    ratios = quality.log_ratios(counts)
    got, texts = {r.doc_id: r for r in quality.judge(docs, ratios).collect()}, dict(texts_of(docs))
    trusted = {r.doc_id for r in quality.trusted_ids(labels).collect()}
    raw = sum(max(0, 2 * len(WORD.findall(t)) - 1) for t in texts.values())
    assert counts.agg(F.sum("raw")).first()[0] == raw
    assert counts.agg(F.sum("target")).first()[0] == sum(max(0, 2 * len(WORD.findall(t)) - 1) for i, t in texts.items() if i in trusted)
    for i, t in texts.items():
        r = got[i]
        assert base(r) == brute_base(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.log_ratio >= quality.THRESHOLD)
    # every ratio again, from words and pairs hashed one by one
    import xxhash

    def grams(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(t or "")]
        pairs = [xxhash.xxh64_intdigest(w.encode(), a) for a, w in zip(h, WORD.findall(t or "")[1:])]
        return [((x + (1 << 63)) % (1 << 64) - (1 << 63)) % quality.BUCKETS for x in h + pairs]

    all_of, of_trusted = Counter(), Counter()
    for i, t in texts.items():
        all_of.update(grams(t))
        of_trusted.update(grams(t) if i in trusted else [])
    n, m = sum(all_of.values()), sum(of_trusted.values())
    share = [(all_of[b] + 1) / (n + quality.BUCKETS) for b in range(quality.BUCKETS)]
    assert ratios == [round(quality.MICRO * math.log((of_trusted[b] + quality.PRIOR * share[b]) / (m + quality.PRIOR) / share[b])) for b in range(quality.BUCKETS)]
    for i, t in texts.items():
        g = grams(t)
        assert abs(got[i].log_ratio - (sum(ratios[b] for b in g) / len(g) / quality.MICRO if g else 0)) < 2e-9


def test_repeated_windows(spark):
    texts = ["a b c d a b c", "a a a a", "a a a", "x y z", "a b c a b c a b c", "q w e r t y q w e r t", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: base(r) for r in quality.judge(df, [0] * quality.BUCKETS).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality(odd, labels).collect()
    assert len(got) == 10 and all(r.base_failed and not r.kept for r in got if r.doc_id in (2, 3, 4))
    assert quality.quality(none, labels).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    from flowgrid.functions.storage import materialize

    for name, stage in p.STAGES[:-1]:
        out = materialize(stage(spark, now, sf), "test-stage")
        assert out.columns == docs.columns, name
        before, after = dict(texts_of(now)), dict(texts_of(out))
        assert set(after) <= set(before)
        if name == "line dedup":
            assert after == brute_lines(list(before.items()))
        if name == "simhash near-dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(now).collect()}
            assert set(after) == {i for i, c in groups.items() if i == c}
        now = out
    packed = p.STAGES[-1][1](spark, now, sf).collect()
    assert {x.doc_id for x in packed} == set(after) and is_packed(packed, 4096)


def test_pipeline_stages_on_odd_rows(spark, odd, none, sf):
    import corpus_pipeline as p

    for docs in (none, odd):
        now = docs
        for name, stage in p.STAGES[:-1]:
            now = line_dedup.materialize(stage(spark, now, sf), "test-odd")
            assert now.columns == docs.columns, name
        packed = p.STAGES[-1][1](spark, now, sf).collect()
        assert {x.doc_id for x in packed} == {r.doc_id for r in now.select("doc_id").collect()}
    assert {2, 5, 6, 7, None} <= {x.doc_id for x in packed}
