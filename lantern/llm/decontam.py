"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A seed is a fixed mask over a run of tokens: the hash of the tokens it selects, whatever stands at the others. Seeds
of all positions of all documents are joined with those of the benchmark; each hit names a document, an item and an
alignment. Around the hits, aligned tokens are compared one by one, and windows that agree but for a few
substitutions are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import BROADCAST_ROWS, broadcast_if_small, read, written

#: Tokens of a window that must agree, but for so many substitutions.
WINDOW, SUBSTITUTIONS = 13, 2
#: Positions that are hashed from one part of a text.
PART = 512
#: Items of fewer tokens are not looked for. A benchmark whose items may be everyday words calls for more.
LEAST_TOKENS = 1
_WORD = r"[\p{L}\p{M}\p{N}]"
# Fixed masks: the positions that each selects. However two tokens of thirteen differ, one of these, somewhere in the
# thirteen, selects neither; a test goes through all cases.
MASKS = ((0, 2, 6, 7, 8, 10, 11), (0, 1, 2, 3, 5, 7, 8), (0, 1, 3, 4, 7, 8, 9))


def tokens(text: Column) -> Column:
    """Hashes of the words of a text in lower case; words are runs of letters, marks and digits."""
    words = F.split(F.lower(F.regexp_replace(text, r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "")), r"[^\p{L}\p{M}\p{N}]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(tokens_col: str, at: Column) -> Column:
    own = F.col(tokens_col)
    return F.array(*(F.xxhash64(F.lit(k), *(F.get(own, at + p) for p in mask)) for k, mask in enumerate(MASKS)))


def _placed(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each position that a mask fits at, and for each mask: keep, at, seed.

    Tokens are first cut into overlapping parts, so that a position's row carries a part and not the whole text.
    """
    least, span = min(max(m) for m in MASKS), max(max(m) for m in MASKS)
    cut = F.transform(F.sequence(F.lit(0), F.size("h") - least - 1, F.lit(PART)), lambda b: F.struct(b.alias("base"), F.slice("h", b + 1, F.lit(PART + span)).alias("part")))
    parts = df.where(F.size("h") > least).select(*keep, F.explode(cut).alias("c")).select(*keep, "c.base", "c.part")
    spots = parts.select(*keep, "base", "part", F.explode(F.sequence(F.lit(0), F.least(F.lit(PART), F.size("part") - least) - 1)).alias("local"))
    seeds = spots.select(*keep, (F.col("base") + F.col("local")).alias("at"), "local", F.size("part").alias("n"), F.posexplode(_seeds("part", F.col("local"))).alias("mask", "seed"))
    return seeds.where(F.col("local") + F.get(F.array(*(F.lit(max(m)) for m in MASKS)), F.col("mask")) < F.col("n")).drop("local", "n")


def known_seeds(placed: DataFrame, known: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of placed whose seed is in known.

    Up to a counted bound known is broadcast. Beyond it a bitmap of 2 ** 28 bits, in at most 2 ** 20 rows whatever
    the benchmark's size, is broadcast first; only what it lets through is joined by a shuffle.
    """
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return placed.join(F.broadcast(known), "seed")
    word, part, bit = f"seed & {(1 << 20) - 1}", "shiftrightunsigned(seed, 20) & 3", "shiftleft(1L, cast(shiftrightunsigned(seed, 22) & 63 as int))"
    bitmap = written(known.groupBy(F.expr(word).alias("word")).agg(*(F.expr(f"bit_or(if(({part}) = {j}, {bit}, 0L))").alias(f"bits{j}") for j in range(4))))
    stored = "case {} when 0 then bits0 when 1 then bits1 when 2 then bits2 else bits3 end".format(part)
    likely = placed.withColumn("word", F.expr(word)).join(F.broadcast(bitmap), "word").where(F.expr(f"(({stored}) & {bit}) <> 0"))
    return likely.select(*placed.columns).join(known, "seed")


def _coverage(same: str = "same") -> Column:
    """(first, last, covered, matched) of an alignment, whose tokens agree (1) or not (0): the first and last window that
    agrees, and how many positions such windows cover and how many of those agree. One step a token, with a state of
    fixed size."""
    token = F.col(same)
    start = F.struct(*(F.lit(v).alias(k) for k, v in (("held", 0), ("since", 0), ("end", 0), ("first", -1), ("last", -1), ("covered", 0), ("matched", 0))))

    def step(acc: Column, i: Column) -> Column:
        # held: agreeing tokens in the window that ends here; since: those after the covered part
        now = F.get(token, i)
        held = acc["held"] + now - F.when(i >= WINDOW, F.get(token, i - WINDOW)).otherwise(0)
        since, from_ = acc["since"] + now, i - (WINDOW - 1)
        hit = (i >= WINDOW - 1) & (held >= WINDOW - SUBSTITUTIONS)
        pick = lambda yes, no: F.when(hit, yes).otherwise(no)
        return F.struct(
            held.alias("held"),
            pick(F.lit(0), since).alias("since"),
            pick(i + 1, acc["end"]).alias("end"),
            pick(F.when(acc["first"] < 0, from_).otherwise(acc["first"]), acc["first"]).alias("first"),
            pick(from_, acc["last"]).alias("last"),
            (acc["covered"] + pick(i + 1 - F.greatest(from_, acc["end"]), F.lit(0))).alias("covered"),
            (acc["matched"] + pick(F.when(acc["end"] > from_, since).otherwise(held), F.lit(0))).alias("matched"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(token) - 1), start, step)


def _whole(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    """Overlaps with items of fewer tokens than a window: all of the item's tokens stand in the document."""
    lengths = sorted(r.n for r in items.select(F.size("item").alias("n")).distinct().collect())  # fewer than WINDOW values
    if not lengths:
        return None
    spots = docs.select("doc_id", "key", "h", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.size("h") >= F.col("n"))
    spots = spots.select("doc_id", "key", "h", "n", F.explode(F.expr("sequence(0, size(h) - n)")).alias("at")).select("doc_id", "key", "at", F.expr("slice(h, at + 1, n)").alias("own")).withColumn("seed", F.xxhash64("own"))
    seeded = written(items.withColumn("seed", F.xxhash64("item")))
    likely = known_seeds(spots, seeded.select("seed").distinct(), broadcast_rows)
    found = likely.join(broadcast_if_small(seeded, broadcast_rows), "seed").where("own = item")
    n = F.size("item").cast("long")
    return found.dropDuplicates(["doc_id", "key", "item_id", "item", "at"]).select("doc_id", "item_id", F.col("at").cast("long").alias("doc_start"), (F.col("at") + n).alias("doc_end"), n.alias("n_matched"), n.alias("n_covered"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(doc_id, item_id, doc_start, doc_end, n_matched, n_covered): each overlap of a document with an item.

    An overlap is one alignment's windows of 13 tokens that agree in at least 11: doc_start and doc_end (exclusive)
    bound them in the document's tokens, n_covered counts the item's tokens in them and n_matched those that agree.
    Substitutions only, no insertions. Of items of fewer than 13 tokens all must stand in the document, in order and
    side by side. Items of fewer than `least_tokens` (by default none) are left out, and so are those without a word. Null
    and empty texts have no overlap. Documents with a null id are reported with it; rows that repeat both id and text are reported once;
    items likewise. Extra columns are not read. Benchmark seeds are broadcast up to a counted bound; beyond it a bitmap
    of fixed size keeps most of the documents' seeds from the shuffle.
    """
    items = written(benchmark.where(F.col(item_text_col).rlike(_WORD)).select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("item")).where(F.size("item") >= least_tokens).distinct())
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    keyed = source.withColumn("key", F.xxhash64("text"))
    hashed = keyed.select("doc_id", "key", tokens(F.col("text")).alias("h"))
    short = _whole(hashed, items.where(F.size("item") < WINDOW), broadcast_rows)
    items = items.where(F.size("item") >= WINDOW)

    seeds = written(_placed(items.select("item_id", F.col("item").alias("h")), "item_id").select("seed", "item_id", F.col("at").alias("item_at")))
    hits = known_seeds(_placed(hashed, "doc_id", "key"), written(seeds.select("seed").distinct()), broadcast_rows)
    hits = written(hits.groupBy("doc_id", "key", "seed").agg(F.collect_list("at").alias("ats")))
    aligned = hits.join(broadcast_if_small(seeds.select("seed", "item_id", "item_at")), "seed").select("doc_id", "key", "item_id", F.explode("ats").alias("at"), "item_at").select("doc_id", "key", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    by_doc = written(aligned.groupBy("doc_id", "key", "item_id").agg(F.collect_list("shift").alias("shifts")))
    keys = broadcast_if_small(written(by_doc.select(F.col("key").alias("hit_key")).distinct()))
    texts = keyed.join(keys, F.col("key") == F.col("hit_key"), "left_semi").dropDuplicates(["doc_id", "key"])
    texts = texts.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), tokens(F.col("text")).alias("h"))
    both = by_doc.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).join(
        broadcast_if_small(items.select(F.col("item_id").alias("i"), "item"), 100_000), F.col("item_id").eqNullSafe(F.col("i"))
    )
    # each alignment takes along only the document's tokens beside the item, never the whole document
    beside = lambda s: F.slice("h", F.greatest(s, F.lit(0)) + 1, F.greatest(F.size("item") + F.least(s, F.lit(0)), F.lit(0)))
    each = both.select("doc_id", "item_id", "item", F.explode(F.transform("shifts", lambda s: F.struct(s.alias("shift"), beside(s).alias("own")))).alias("a"))
    each = each.select("doc_id", "item_id", "item", "a.shift", "a.own")
    at = lambda i: i + F.least(F.col("shift"), F.lit(0))
    same = F.transform("item", lambda w, i: F.coalesce((F.get(F.col("own"), at(i)) == w) & (at(i) >= 0), F.lit(False)).cast("int"))
    # written, so that the filter below does not take the comparison along into each of its steps
    compared = written(each.select("doc_id", "item_id", "shift", same.alias("same")))
    walked = compared.select("doc_id", "item_id", "shift", _coverage().alias("w")).where("w.first >= 0")
    shifted = lambda x: (x + F.col("shift")).cast("long")
    long = walked.select(
        "doc_id",
        "item_id",
        shifted(F.col("w.first")).alias("doc_start"),
        shifted(F.col("w.last") + WINDOW).alias("doc_end"),
        F.col("w.matched").cast("long").alias("n_matched"),
        F.col("w.covered").cast("long").alias("n_covered"),
    )
    return long if short is None else long.unionByName(short)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without any overlap, with all their columns. Null texts and null ids stay unless they overlap."""
    found = overlaps(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(broadcast_if_small(written(found)), docs[id_col].eqNullSafe(F.col("__hit")), "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark: one row per overlap."""
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP10_SQL = f"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') as w from (select distinct doc_id, text from documents where text is not null)),
 b as (select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') as w from (select distinct item_id, text from benchmark where text is not null)),
 dt as (select k, doc_id, unnest(w) as w, unnest(range(len(w))) as p from d),
 bt as (select item_id, len(w) as n, unnest(w) as w, unnest(range(len(w))) as i from b where len(w) >= {LEAST_TOKENS}),
 m as (select k, doc_id, item_id, n, p - i as shift, i from dt join bt using (w)),
 g as (select k, doc_id, item_id, n, shift from m group by all having count(*) >= case when n < {WINDOW} then n else {WINDOW - SUBSTITUTIONS} end),
 mm as (select m.k, m.item_id, m.shift, m.i from m join g using (k, item_id, shift)),
 s as (select k, doc_id, item_id, n, shift, unnest(range(greatest(n - {WINDOW}, 0) + 1)) as st from g),
 sw as (select s.k, s.doc_id, s.item_id, s.n, s.shift, st from s join mm using (k, item_id, shift) where mm.i between st and st + {WINDOW - 1} group by all having count(*) >= case when n < {WINDOW} then n else {WINDOW - SUBSTITUTIONS} end),
 c as (select distinct k, doc_id, item_id, shift, st + o as i from sw, (select unnest(range({WINDOW})) as o) where o < n)
select c.doc_id, c.item_id, min(c.i) + c.shift as doc_start, max(c.i) + 1 + c.shift as doc_end, count(mm.i) as n_matched, count(*) as n_covered
from c left join mm on mm.k = c.k and mm.item_id = c.item_id and mm.shift = c.shift and mm.i = c.i
group by c.k, c.doc_id, c.item_id, c.shift
"""
