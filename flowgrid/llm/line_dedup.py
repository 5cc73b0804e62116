"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. Words are ordered by how rare they are in the corpus; two sets of
Jaccard similarity ``SIMILARITY`` or more share a word among the first few (the prefix). Pairs that meet there are cut
down by length and by the places where they meet, then verified on whole sets, and every line that matches an
earlier one is removed. All of it is column expressions: no Python runs on the executors.

Equal sets are one class from the start, so a line that is copied very often counts once in the join. Classes of a
large family of near copies (equal least, or equal greatest, word hashes) go through the join in blocks of up to ``BLOCK``, so that its
pairs are checked inside few rows and only counts come out. Which classes make a block decides nothing but speed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.shared import discard, materialize, pick

#: Jaccard similarity from which lines match, as a ratio of whole numbers so that ties are exact.
NUMERATOR, DENOMINATOR = 4, 5
#: Buckets that word frequencies are counted in: the order of rarity needs no exact counts, only that it is the same
#: everywhere. And the 64-bit words of the bit maps that spare shuffles.
FREQUENCY_BUCKETS, MAP_WORDS = 1 << 17, 1 << 14
#: Classes from which a family is put in blocks, classes of a block at most, and in how many bits they may differ from its first.
FAMILY, BLOCK, RADIUS = 8, 32, 24
NULL_DOC = -(1 << 63)


def _ratio(n: str, up: int, down: int) -> str:
    """ceil(n * up / down) in whole numbers."""
    return f"(({n} * {up} + {down - 1}) div {down})"


def _overlap(both: str) -> str:
    """Words that two sets must share to be similar enough; ``both``: the sum of their sizes."""
    return _ratio(both, NUMERATOR, NUMERATOR + DENOMINATOR)


def word_set(line: str) -> Column:
    """The 64-bit hashes of a line's distinct words, ascending."""
    text = F.lower(line)
    for blank in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    hashes = F.transform(F.split(text, " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit(""))))


def line_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, s (the word set), id and more_id (128 bits of its hash) of every line with a word.

    Lines are cut at line feeds.
    """
    rows = pick(docs, "doc_id", "text").filter(F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text_hash", "line_no", word_set("line").alias("s"))
    return rows.withColumns({"id": F.xxhash64("s"), "more_id": F.xxhash64(F.lit(1), "s")})


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(FREQUENCY_BUCKETS - 1)).cast("int")


def rarity(sets: DataFrame) -> list[int]:
    """For every bucket a number from 0 to 127 that grows with how many lines hold its words."""
    out = [0] * FREQUENCY_BUCKETS
    for r in sets.select(F.explode("s").alias("h")).groupBy(_bucket(F.col("h")).alias("bucket")).count().toLocalIterator():  # one row a bucket at most
        out[r.bucket] = min(127, int(3 * math.log2(r["count"])))
    return out


def line_classes(sets: DataFrame, rank: list[int]) -> DataFrame:
    """One row for each distinct set: no (a number of its own), its first line in the order of doc_id, line number and
    text hash, n (words), bits and more_bits (each of the 128 is the parity of its share of the words), families (hashes of its four least and
    of its four greatest words), and prefix (its rarest words, rarest first).

    Sets of up to three words have no prefix: nothing but an equal set can be that similar to them.
    """
    # a word's place in the order: its bucket's rank above 56 bits of its hash
    ranks = F.from_json(F.lit(str(rank)), "array<tinyint>")
    key = lambda h: F.shiftleft(F.get(ranks, _bucket(h)).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))
    ordered = F.sort_array(F.transform("s", key))
    size = f"case when size(s) <= 3 then 0 else size(s) - {_ratio('size(s)', NUMERATOR, DENOMINATOR)} + 1 end"
    parity = lambda half: F.expr(f"aggregate(s, 0L, (b, x) -> if(x & 64 = {64 * half}, b ^ shiftleft(1L, cast(x & 63 as int)), b))")
    at = F.struct(F.coalesce("doc_id", F.lit(NULL_DOC)).alias("doc"), F.col("line_no").alias("line"), "text_hash")
    rows = sets.select("id", "more_id", at.alias("at"), F.size("s").alias("n"), parity(0).alias("bits"), parity(1).alias("more_bits"), F.expr("array(xxhash64(slice(s, 1, 4)), xxhash64(1, slice(s, greatest(1, size(s) - 3), 4)))").alias("families"), ordered.alias("o"))
    rows = rows.withColumn("prefix", F.expr(f"transform(slice(o, 1, {size.replace('size(s)', 'n')}), x -> cast(x & 2147483647 as int))")).drop("o")
    rows = rows.groupBy("id", "more_id").agg(F.min("at").alias("at"), *[F.any_value(c).alias(c) for c in ("n", "bits", "more_bits", "families", "prefix")])
    return rows.withColumn("no", F.monotonically_increasing_id())


def _in_map(hashes: DataFrame, h: Column) -> Column:
    """Whether ``h`` may be among the hashes (column h): a map of 64 * MAP_WORDS bits lets them all pass, and few others."""
    rows = hashes.select(F.pmod(F.shiftright("h", 6), F.lit(MAP_WORDS)).cast("int").alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    out = [0] * MAP_WORDS
    for r in rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # MAP_WORDS rows at most
        out[r["at"]] = r.bits
    bits = F.get(F.from_json(F.lit(str(out)), "array<bigint>"), F.pmod(F.shiftright(h, 6), F.lit(MAP_WORDS)).cast("int"))
    return bits.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))) != 0


def family_blocks(classes: DataFrame) -> tuple[DataFrame, Column]:
    """(blocks, a condition that all their classes meet): block, members (no, n, bits, more_bits, prefix) and radius.

    A class belongs to the larger of its two families, so that an edit in the words of one leaves it the other. Families of
    FAMILY classes or more are cut into blocks of up to BLOCK by hash; classes whose bits are far from those of their block's
    first one stand alone, as do other classes that meet the condition.
    """
    sized = classes.filter("size(prefix) > 0").select(F.explode("families").alias("family")).groupBy("family").agg(F.count("*").alias("size")).filter(F.col("size") >= FAMILY)
    sized = materialize(sized, "families")
    inside = [_in_map(sized.select(F.col("family").alias("h")), F.expr(f"families[{k}]")) for k in range(2)]
    maybe = (inside[0] | inside[1]) & (F.size("prefix") > 0)
    of = lambda k: sized.select(F.col("family").alias(f"family{k}"), F.col("size").alias(f"size{k}"))
    rows = classes.filter(maybe).withColumns({f"family{k}": F.expr(f"families[{k}]") for k in range(2)}).join(of(0), "family0", "left").join(of(1), "family1", "left")
    rows = rows.withColumns({"size": F.greatest("size0", "size1"), "family": F.when(F.coalesce(F.col("size0") >= F.col("size1"), F.col("size1").isNull()), F.col("family0")).otherwise(F.col("family1"))})
    member = F.struct("no", "n", "bits", "more_bits", "prefix")
    alone = F.col("size").isNull()
    slot = F.when(alone, F.col("no")).otherwise(F.pmod("more_id", F.ceil(F.col("size") * 2 / BLOCK)))
    rows = rows.groupBy("family", slot.alias("slot")).agg(F.array_sort(F.collect_list(member)).alias("m"))
    rows = rows.select(F.explode(F.expr(f"transform(sequence(0, (size(m) - 1) div {BLOCK}), i -> slice(m, i * {BLOCK} + 1, {BLOCK}))")).alias("m"))
    away, most = "bit_count(x.bits ^ m[0].bits) + bit_count(x.more_bits ^ m[0].more_bits)", f"least({RADIUS}, 2 * m[0].n - 2 * {_overlap('2 * m[0].n')} + 4)"
    rows = rows.withColumns({"near": F.expr(f"filter(m, x -> {away} <= {most})"), "far": F.expr(f"filter(m, x -> {away} > {most})")})
    rows = rows.select(F.explode(F.expr("concat(array(near), transform(far, x -> array(x)))")).alias("m"))
    radius = F.expr(f"array_max(transform(m, x -> {away}))").alias("radius")
    return materialize(rows.select(F.expr("m[0].no").alias("block"), F.col("m").alias("members"), radius), "blocks"), maybe


def candidates(classes: DataFrame, blocks: DataFrame, maybe: Column) -> DataFrame:
    """x, y (x < y): all pairs of blocks that length, place and map of words leave, each once. A class outside ``blocks`` is a block.

    What holds for pairs of classes is asked of the most favourable sizes and places that the two blocks have.
    """
    # before: the word before this one in a class's prefix, -1 if there is none or in a block of several
    ordered = "transform({0}, (w, i) -> named_struct('place', i, 'word', w, 'before', if(i = 0, -1, {0}[i - 1])))"
    alone = classes.filter(~maybe & (F.size("prefix") > 0)).select(F.col("no").alias("block"), F.col("n").alias("low"), F.col("n").alias("high"), "bits", "more_bits", F.lit(0).alias("radius"), F.lit(None).cast("array<int>").alias("all_words"), F.expr(f"inline({ordered.format('prefix')})"))
    words = f"if(size(members) = 1, {ordered.format('members[0].prefix')}, transform(array_distinct(flatten(members.prefix)), w -> named_struct('place', 0, 'word', w, 'before', -1)))"
    grouped = blocks.select("block", F.expr("array_min(members.n)").alias("low"), F.expr("array_max(members.n)").alias("high"), F.expr("members[0].bits").alias("bits"), F.expr("members[0].more_bits").alias("more_bits"), "radius", F.expr("if(size(members) > 1, array_distinct(flatten(members.prefix)), null)").alias("all_words"), F.expr(f"inline({words})"))
    meet = alone.unionByName(grouped).select("word", "before", "all_words", "block", "bits", "more_bits", F.expr("shiftleft(cast(low as bigint), 32) | high").alias("size"), F.expr("shiftleft(cast(place as bigint), 8) | radius").alias("at"))
    low, high, place, radius = "shiftright({0}.size, 32)", "({0}.size & 4294967295)", "shiftright({0}.at, 8)", "({0}.at & 255)"
    x, y = ([v.format(k) for v in (low, high, place, radius)] for k in "xy")
    need = _overlap(f"({x[0]} + {y[0]})")
    # a pair with the same word before this one has met there already, at better places, and so has a block that holds
    # the other's word before; two blocks of several meet at their least common word
    meets = f"""x.word = y.word and x.block < y.block and (x.before < 0 or x.before != y.before) and {x[0]} * {NUMERATOR} <= {y[1]} * {DENOMINATOR} and {y[0]} * {NUMERATOR} <= {x[1]} * {DENOMINATOR}
        and bit_count(x.bits ^ y.bits) + bit_count(x.more_bits ^ y.more_bits) <= {x[1]} + {y[1]} - 2 * {need} + {x[3]} + {y[3]}
        and least({x[1]} - {x[2]}, {y[1]} - {y[2]}) >= {need}
        and not coalesce(array_contains(x.all_words, y.before) or array_contains(y.all_words, x.before), false)
        and coalesce(x.word = array_min(array_intersect(x.all_words, y.all_words)), true)"""  # every bit that differs is a word that only one set has
    return meet.alias("x").join(meet.alias("y"), F.expr(meets)).select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()


def block_sets(ends: DataFrame, classes: DataFrame, blocks: DataFrame, maybe: Column, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, m (no, at and s of each of its classes) of the blocks in ``ends`` (column block, each once); a helper table).

    A bit map of the wanted sets' hashes lets their lines through before the shuffle, and a join drops what else got through.
    """
    inside = blocks.join(ends, "block", "left_semi").select("block", F.explode("members.no").alias("no"))
    wanted = classes.filter(~maybe).join(ends.select(F.col("block").alias("no")), "no", "left_semi").select(F.col("no").alias("block"), "no", "at", "id", "more_id")
    wanted = wanted.unionByName(classes.filter(maybe).join(inside, "no").select("block", "no", "at", "id", "more_id"))
    wanted = materialize(wanted, "wanted")
    found = sets.select("id", "more_id", "s").filter(_in_map(wanted.select(F.col("id").alias("h")), F.col("id")))
    found = found.groupBy("id", "more_id").agg(F.any_value("s").alias("s"))
    return materialize(wanted.join(found, ["id", "more_id"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("no", "at", "s"))).alias("m")), "block-sets"), wanted


def class_links(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """no, n_links (other classes that match, verified on whole sets) and later (one of them is earlier) of every class with a match."""
    blocks, maybe = family_blocks(classes)
    met = materialize(candidates(classes, blocks, maybe), "met")
    own = blocks.filter("size(members) > 1").select(F.col("block").alias("x"), F.col("block").alias("y"))
    ends = met.select(F.explode(F.array("x", "y")).alias("block")).union(own.select("x")).distinct()
    whole, wanted = block_sets(ends, classes, blocks, maybe, sets)
    side = lambda k: whole.select(F.col("block").alias(k), F.col("m").alias(f"m{k}"))
    both = met.unionByName(own).join(side("x"), "x").join(side("y"), "y")
    # shared / (n + m - shared) >= NUMERATOR / DENOMINATOR; for each class of one side: are its partners of the other earlier?
    partners = lambda a, b: f"transform({a}, a -> transform(filter({b}, b -> a.no != b.no and size(array_intersect(a.s, b.s)) * {NUMERATOR + DENOMINATOR} >= (size(a.s) + size(b.s)) * {NUMERATOR}), b -> b.at < a.at))"
    count = "transform({0}, f -> named_struct('n', size(f), 'later', array_contains(f, true)))"
    both = both.select("x", "y", F.expr(f"transform(mx, a -> a.no)").alias("nx"), F.expr(f"transform(my, a -> a.no)").alias("ny"), F.expr(partners("mx", "my")).alias("fx"), F.expr(f"if(x = y, array(), {partners('my', 'mx')})").alias("fy"))
    both = materialize(both.select("x", "y", "nx", "ny", F.expr(count.format("fx")).alias("cx"), F.expr(count.format("fy")).alias("cy")), "verified")
    for done in (met, whole, wanted):
        discard(done)
    per_side = both.select(F.col("x").alias("block"), F.col("nx").alias("no"), F.col("cx").alias("c")).unionByName(both.filter("x != y").select(F.col("y").alias("block"), F.col("ny").alias("no"), F.col("cy").alias("c")))
    # sums by a class's place in its block, so that a block takes one row from each task
    single = per_side.filter("size(no) = 1").groupBy("block").agg(F.sum(F.expr("c[0].n")).alias("n_links"), F.max(F.expr("c[0].later")).alias("later")).withColumnRenamed("block", "no")
    sums = [F.sum(F.expr(f"get(c, {i}).n")).alias(f"n{i}") for i in range(BLOCK)] + [F.max(F.expr(f"get(c, {i}).later")).alias(f"l{i}") for i in range(BLOCK)]
    several = per_side.filter("size(no) > 1").groupBy("block", "no").agg(*sums)
    several = several.select(F.posexplode("no").alias("i", "no"), F.array(*[f"n{i}" for i in range(BLOCK)]).alias("n"), F.array(*[f"l{i}" for i in range(BLOCK)]).alias("l"))
    several = several.select("no", F.expr("n[i]").alias("n_links"), F.expr("l[i]").alias("later"))
    out = materialize(single.unionByName(several).filter("n_links > 0"), "links")
    for done in (both, blocks):
        discard(done)
    return out


def dedup_lines(docs: DataFrame, links: bool = False) -> DataFrame:
    """``docs`` with every line removed that matches an earlier one, and n_lines (with a word) and n_removed added.

    Earlier: by doc_id, line number, then the text's hash. Equal sets match, and so do sets of Jaccard similarity 0.8 or
    more. All matches with earlier lines count, whether or not those are removed themselves. Lines without a word stay.
    Null texts stay null with no lines; null doc_ids come before all others. Repeated rows of one doc_id and text are one
    document here: all get the same lines. Other columns stay as they are, except columns called n_lines or n_removed,
    which are replaced.

    With ``links`` the column line_links is added (or replaced): line_no, class_id (equal for equal sets) and n_links of
    each line with a word, where n_links counts all other classes, earlier or later, that the line's class matches.

    Words are compared by 64-bit hash and sets are classes by 128-bit hash.
    """
    sets = materialize(line_sets(docs), "line-sets", {"parquet.dictionary.page.size": str(16 << 20)})
    classes = materialize(line_classes(sets, rarity(sets)), "line-classes")
    found = class_links(classes, sets)
    added = ["n_lines", "n_removed", *(["line_links"] if links else [])]
    # from here on without word sets and prefixes
    known = materialize(classes.select("no", "id", "more_id", F.col("at").alias("first")).join(found, "no", "left").drop("no"), "known")
    lines = materialize(sets.drop("s"), "lines")
    for done in (classes, found, sets):
        discard(done)
    at = F.struct(F.coalesce("doc_id", F.lit(NULL_DOC)).alias("doc"), F.col("line_no").alias("line"), "text_hash")
    rows = lines.join(known, ["id", "more_id"])
    gone = F.coalesce("later", F.lit(False)) | (at != F.col("first"))
    one = F.struct("line_no", F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")) if links else None
    of_lines = [F.sort_array(F.collect_set(one)).alias("line_links")] if links else []
    per_doc = rows.groupBy("doc_id", "text_hash").agg(F.size(F.collect_set("line_no")).cast("long").alias("n_lines"), F.collect_set(F.when(gone, F.col("line_no"))).alias("removed"), *of_lines)
    per_doc = materialize(per_doc, "per-doc")
    discard(known)
    discard(lines)
    # one row of the input, however its columns are called
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("d"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).alias("k")
    out = keyed.join(per_doc.alias("p"), F.expr("k.doc_id <=> p.doc_id and k.text_hash = p.text_hash"), "left")
    parts = F.split("d.text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("p.removed"), i)), "\n")
    text = F.when(F.size("p.removed") > 0, kept).otherwise(F.col("d.text"))
    columns = [text.alias(c) if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in added]
    return out.select(*columns, F.coalesce("p.n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("p.removed"), F.lit(0)).cast("long").alias("n_removed"), *(["p.line_links"] if links else []))
