"""Spelling variants: words one edit apart, found by a pigeonhole join of even segments, and the common form each of them goes back to.

A word of length l is cut into two segments, of l // 2 code points and the rest. One edit leaves a segment as it is, so two words one
edit apart, of equal length or one longer, share the first segment as their beginnings or the last as their ends: every word is put
into an index by its two segments, and probes that of its own length and of one less by its own beginnings and ends, shifted for
the longer word. What meets is verified to be one edit apart.

A segment that many words share (a common stem or ending) would make all pairs of them. Such a bucket is cut again in the same way:
its words are known to agree at both ends, so the edit is in the middle, whose even halves are two narrower segments, until few words
share a bucket or one code point is open. No pair is lost by that, and no bucket grows beyond a bound: with one open code point it
has a word for each letter, and all of its words are near each other. A pair can meet in both buckets of a cut; it counts in that of
the ends only if the words differ before it, so a pair counts once and pairs need no shuffle to be distinct.

All of it is DataFrame operations. Counts of words are added map-side first; texts are read once.

Defined cases: a null text has no words; a null doc_id is "" in what decides on a deletion; repeated rows are counted as often; of
near words with the same number of occurrences the smallest is the form; no documents or no frequent words give no rows; other columns aren't read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, small
from mnemo.llm.sharding import crc32_sql

#: Letters of a word.
LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, LEAST, RATIO = 6, 5, 5
#: Runs whose crc32 this divides lose a code point: made slips, so that there is something to find.
SLIP_EVERY = 199
#: Pairs that a bucket may make before it is cut again.
BUCKET_PAIRS = 1024


def lowered(run: Column) -> Column:
    """A-Z in lower case, nothing else."""
    exact = F.translate(run, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.rlike(run, F.lit(r"[À-Þ]")), exact).otherwise(F.lower(run))


def occurrences(docs: DataFrame, shortest: int = SHORTEST, slip_every: int | None = SLIP_EVERY) -> DataFrame:
    """word of every occurrence of at least shortest code points, with the made slips; slip_every None makes none."""
    # A shorter run makes no word; a run of at least this length is matched whole.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    runs = runs.select("name", lowered(F.col("run")).alias("word"))
    if slip_every:
        runs = runs.withColumn("h", F.crc32(F.concat("name", F.lit(":"), "word")))
        at = F.pmod("h", F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(F.col("h") % slip_every == 0, less).otherwise(F.col("word")))
    return runs.where(F.length("word") >= shortest).select("word")


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, slip_every: int | None = SLIP_EVERY) -> DataFrame:
    """word and n of the words that occur often enough."""
    return occurrences(docs, shortest, slip_every).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, own, l, a, b, c) with the hash of what a bucket's words share: a code points at the beginning and b at the end."""
    size = F.length("word")
    ends = F.xxhash64(F.substring("word", F.lit(1), F.col("a")), F.substring("word", size - F.col("b") + 1, F.col("b")))
    return rows.withColumn("key", ends)


def _cut(rows: DataFrame) -> DataFrame:
    """Each row in the two buckets that its own is cut into; c is the length of beginning that words of a bucket of ends must not share."""
    half = F.col("a") + F.floor((F.col("l") - F.col("a") - F.col("b")) / 2).cast("int")
    first = F.struct(half.alias("a"), F.col("b").alias("b"), F.col("c").alias("c"))
    last = F.struct(F.col("a").alias("a"), (F.col("l") - half).alias("b"), half.alias("c"))
    return _keyed(rows.withColumn("to", F.explode(F.array(first, last))).select("word", "n", "own", "l", "to.a", "to.b", "to.c"))


def near_pairs(words: DataFrame, scratch: Scratch, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """word, n, other and other_n of each pair of words (word, n) one edit apart, once. words is read several times: a written table."""
    shortest = words.agg(F.min(F.length("word"))).first()[0] or 0
    size = F.length("word")
    sides = F.array(F.struct(F.lit(True).alias("own"), size.alias("l")), F.struct(F.lit(False).alias("own"), (size - 1).alias("l")))
    begun = words.withColumn("side", F.explode(sides)).select("word", "n", "side.own", "side.l", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(None).cast("int").alias("c"))
    rows, bucket, found = _cut(begun.where(F.col("l") >= shortest)), ["l", "a", "b", "key"], None
    step = 0
    while True:
        rows = scratch.table(rows, f"rows-{step}")
        counts = rows.groupBy(*bucket).agg(F.sum(F.col("own").cast("long")).alias("owned"), F.count("*").alias("every"))
        # Buckets of one word, or of probes alone, have no pair.
        counts = scratch.table(counts.where("owned > 0 and every > 1").withColumn("wide", (F.col("owned") * F.col("every") > bucket_pairs) & (F.col("l") - F.col("a") - F.col("b") > 1)), f"counts-{step}")
        live, wide = counts.agg(F.count("*"), F.coalesce(F.sum(F.col("wide").cast("long")), F.lit(0))).first()
        kept = rows.join(small(counts.select(*bucket, "wide"), live, 192), bucket)
        pairs = scratch.table(_verified(kept.where("not wide").drop("wide"), bucket), f"pairs-{step}")
        found = pairs if found is None else found.unionByName(pairs)
        if not wide:
            return found
        rows = _cut(kept.where("wide").drop("wide"))
        step += 1


def _verified(rows: DataFrame, bucket: list[str]) -> DataFrame:
    one = rows.where("own").select(*bucket, "c", "word", "n")
    two = rows.select(*bucket, F.col("own").alias("other_own"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = one.join(two, bucket).where("word <> other and (not other_own or word < other)")
    begins = lambda w, k: F.substring(w, F.lit(1), k)
    ends = lambda w: F.substring(w, F.length(w) - F.col("b") + 1, F.col("b"))
    met = met.where(F.col("c").isNull() | (begins("word", F.col("c")) != begins("other", F.col("c"))))
    met = met.where((begins("word", F.col("a")) == begins("other", F.col("a"))) & (ends("word") == ends("other")))
    return met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root for rows (word, form), following forms to one that has none. Chains are short, as each form is RATIO times as frequent."""
    step, state = 0, scratch.table(forms.select("word", F.col("form").alias("root")), "roots-0")
    while True:
        links = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = scratch.table(links.join(state.select("root").distinct(), "root", "left_semi"), f"links-{step}")
        count = links.count()
        if not count:
            return state
        step += 1
        state = scratch.table(state.join(small(links, count, 256), "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{step}")


def variants(words: DataFrame, ratio: int = RATIO, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """word, form, root, n, n_near and form_n of words (word, n)."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.table(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words, scratch, bucket_pairs)
    both = pairs.select(F.explode(F.array(F.struct("word", F.col("other").alias("x"), F.col("other_n").alias("x_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("x"), F.col("n").alias("x_n")))).alias("p")).select("p.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x_n")).alias("less"), F.col("x"))).alias("best"))
    met = words.join(near, "word", "left").withColumn("has", F.coalesce(-F.col("best.less") >= F.col("n") * ratio, F.lit(False)))
    met = met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.x")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n"))
    met = scratch.table(met, "formed")
    ends = roots(met.where("form is not null").select("word", "form"), scratch)
    return met.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """The frequent words of documents with their forms."""
    return variants(vocabulary(docs))


def oracle_sql() -> str:
    """DuckDB counts edits by byte, so letters beyond ASCII are first replaced by signs that no word has."""
    wide = "".join(map(chr, range(0xC0, 0x100)))
    signs = "".join(c for c in map(chr, range(32, 127)) if not c.islower() and c not in "'\\")[: len(wide)]
    return rf"""with recursive runs as (
  select coalesce(doc_id::varchar, '') as name, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as run from documents),
coded as (select run, {crc32_sql("name || ':' || run")} as h from runs where length(run) >= {SHORTEST}),
made as (
  select case when h % {SLIP_EVERY} = 0 then substring(run, 1, (h % length(run))::bigint) || substring(run, (h % length(run))::bigint + 2) else run end as word from coded),
words as (
  select word, translate(word, '{wide}', '{signs}') as plain, length(word) as l, count(*) as n from made where length(word) >= {SHORTEST} group by word having count(*) >= {LEAST}),
near as (
  select a.word, a.n, b.word as other, b.n as other_n from words a join words b on b.l between a.l - 1 and a.l + 1 and a.word <> b.word
  where levenshtein(a.plain, b.plain) = 1),
best as (
  select word, count(*) as n_near, first(other order by other_n desc, encode(other)) as other, first(other_n order by other_n desc, encode(other)) as other_n from near group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= {RATIO} * w.n then other end as form, case when other_n >= {RATIO} * w.n then other_n end as form_n
  from words w left join best b on b.word = w.word),
chain as (
  select word, word as root, form as next from formed
  union all
  select c.word, f.word, f.form from chain c join formed f on f.word = c.next)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from formed f join chain c on c.word = f.word and c.next is null"""
