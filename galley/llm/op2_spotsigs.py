"""Document fingerprints by SpotSigs, in DataFrame functions throughout.

A text's words are runs of letters and digits, lower-cased. Common words are anchors, all others content. Each content word
right after an anchor starts a signature: the anchor, the word and the next CHAIN - 1 content words, DISTANCE apart, hashed.
The set of signatures, sorted and joined, is the fingerprint; likeness is the Jaccard coefficient of two sets. A text with
words but without such a place has one signature, of all its words.

alike() finds classes of documents whose sets are alike. Equal fingerprints are one representative. Sets are partitioned by
length in steps of the threshold, so only neighbouring partitions can meet; within them sets meet through their rarest
signatures, as many as a set alike must share one of, and the Jaccard coefficient is worked out only where the sizes allow
the threshold.

Defined cases: an empty table gives an empty one, and texts are read whole, however
long; a null text is empty; a text without words has an empty set and an empty fingerprint. Two empty sets have
likeness 1, an empty and another 0. Rows are in order of doc_id (null first), then text; the row after the last is the first,
so a single row follows itself. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.components import components
from galley.llm.scratch import Scratch

#: Content words in a chain, and the steps between them.
CHAIN, DISTANCE = 3, 1
#: Hex digits of a signature.
DIGITS = 12
#: Likeness from which sets are alike.
ALIKE = 0.75
#: Common words that serve as anchors: the most frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from have in is it of on or that the this to was were with "
    "als auch auf das dem den der des die ein eine für ich im ist mit nicht sich und von zu "
    "au avec ce dans du elle en est et il la le les ne par pas pour que qui sur un une "
    "con de del el los las lo no o por se su una y"
).split()
#: Buckets of rows in order, for each shuffle partition, and at most.
BUCKETS, MOST_BUCKETS = 2, 100_000

_ANCHOR = "|".join(sorted(dict.fromkeys(ANCHORS)))


def signatures(text: Column) -> list[tuple[str, Column]]:
    """Columns that lead from a text to its sorted set of signatures, the last; each step uses those before by name."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    units = F.split(F.trim(F.regexp_replace("_words", rf"(?<= )({_ANCHOR}) ", "$1_")), " ")
    content = F.transform("_units", lambda u: F.substring_index(u, "_", -1))

    def chain(unit: Column, i: Column) -> Column:
        rest = [F.get("_content", i + k * DISTANCE) for k in range(1, CHAIN)]
        joined = F.concat_ws(" ", F.substring_index(unit, "_", -2), *(F.nullif(w, F.lit("")) for w in rest))
        return F.when(F.contains(unit, F.lit("_")) & ~F.endswith(unit, F.lit("_")), F.substring(F.md5(joined), 1, DIGITS))

    spots = F.array_sort(F.array_distinct(F.array_compact(F.transform("_units", chain))))
    whole = F.when(F.trim("_words") == "", F.array().cast("array<string>")).otherwise(F.array(F.substring(F.md5(F.trim("_words")), 1, DIGITS)))
    return [("_words", words), ("_units", units), ("_content", content), ("_spots", spots), ("_set", F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(whole))]


def with_set(frame: DataFrame, text: str, name: str) -> DataFrame:
    """The frame with a text's set of signatures."""
    kept = frame.columns
    for step, column in signatures(F.col(text)):
        frame = frame.withColumn(step, column)
    return frame.select(*kept, F.col("_set").alias(name))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard coefficient of two sets; empty sets need no intersection."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _range(cuts: list[int]) -> Column:
    """How many cuts lie below doc_id, by way of every so-manieth of them."""
    step = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if not rows:
        return F.lit(0)
    longs = lambda x: F.lit(x).cast("array<bigint>")
    below = lambda some: F.size(F.filter(some, lambda c: c < F.col("doc_id")))
    row = F.greatest(below(longs([r[0] for r in rows])) - 1, F.lit(0))
    return row * step + below(F.get(F.array(*map(longs, rows)), row))


def in_order(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (doc_id, text) with bucket and guard, and a window in which each row without guard is followed by the next.

    Buckets are ranges of doc_id from approximate quantiles, a few for each partition. The first rows of a bucket also
    stand at the end of the bucket before, as guards; those of the first at the end of the last.
    """
    spark = docs.sparkSession
    n = min(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("q")).first().q
    docs = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(_range(sorted(set(cuts or [])))))
    low = docs.groupBy("bucket").agg(F.min("doc_id").alias("low"))
    lows = sorted(low.collect(), key=lambda r: r.bucket)  # MOST_BUCKETS + 1 rows at most
    rows = [(r.bucket, r.low, lows[i - 1].bucket) for i, r in enumerate(lows)]
    first = F.broadcast(spark.createDataFrame(rows, "bucket int, low long, ahead int"))
    docs = docs.join(first, "bucket")
    own, guard = F.struct("bucket", F.lit(0).alias("guard")), F.struct(F.col("ahead").alias("bucket"), F.lit(1).alias("guard"))
    docs = docs.withColumn("at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("low")), F.array(own, guard)).otherwise(F.array(own))))
    docs = docs.select("doc_id", "text", "at.bucket", "at.guard")
    return docs, Window.partitionBy("bucket").orderBy("guard", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text) and of their edited texts, with their likeness."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs, window = in_order(docs)
    docs = docs.withColumn("next", F.lead("text").over(window))
    docs = with_set(docs, "text", "own")
    docs = docs.withColumn("next_set", F.lead("own").over(window)).where("guard = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    docs = with_set(docs.select("doc_id", n.cast("long").alias("n_chars"), "edited", "own", "next_set"), "edited", "changed")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("changed", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_set")).alias("near_next"),
    )


def alike(docs: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """(doc_id, class_id, n_links) of documents (doc_id, text): the smallest doc_id that links of alike sets lead to, and
    the number of other fingerprints alike. Documents without words are alone."""
    scratch = Scratch(docs.sparkSession)
    docs = with_set(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "text", "own")
    docs = scratch.table(docs.select("doc_id", "own", F.md5(F.array_join("own", "")).alias("print")))
    reps = docs.where("size(own) > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    sets = scratch.table(docs.join(reps, ["print", "doc_id"], "left_semi").dropDuplicates(["print"]).select("doc_id", "own", F.size("own").alias("n")))
    each = sets.select("doc_id", "n", F.explode("own").alias("sig"))
    ranked = each.join(each.groupBy("sig").agg(F.count("*").alias("df")), "sig").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("all"))
    must = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")
    step = F.floor(F.ln("n") / F.lit(-1) / F.ln(F.lit(threshold)) + 1e-9).cast("int")
    index = ranked.select("doc_id", "n", step.alias("part"), F.explode(F.slice("all", F.lit(1), must)).alias("s")).select("doc_id", "n", "part", "s.sig")
    near = index.select(F.col("doc_id").alias("other"), F.col("n").alias("m"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "sig")
    met = index.join(near, ["sig", "part"]).where((F.col("m") <= F.col("n")) & (F.col("m") >= threshold * F.col("n")) & ((F.col("m") < F.col("n")) | (F.col("other") < F.col("doc_id"))))
    met = met.select("doc_id", "other").distinct()
    met = met.join(sets.select("doc_id", "own"), "doc_id").join(sets.select(F.col("doc_id").alias("other"), F.col("own").alias("theirs")), "other")
    links = scratch.table(met.where(likeness(F.col("own"), F.col("theirs")) >= threshold).select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    classes = components(links, scratch)
    degree = links.union(links.select("b", "a")).groupBy("a").agg(F.count("*").alias("n_links"))
    named = reps.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(degree.withColumnRenamed("a", "doc_id"), "doc_id", "left")
    named = named.select("print", F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = docs.withColumn("print", F.when((F.size("own") > 0) & F.col("doc_id").isNotNull(), F.col("print"))).join(named, "print", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same in DuckDB: words in rows, chains by window functions."""
    anchors = ", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS))
    leads = ", ".join(f"lead(w, {k * DISTANCE}) over (partition by side, id order by pos) as w{k}" for k in range(1, CHAIN))
    chain = " || ".join(["anchor || '_' || w", *(f"coalesce(' ' || w{k}, '')" for k in range(1, CHAIN))])
    return f"""
with base as (select row_number() over (order by doc_id nulls first, coalesce(text, '')) as id, doc_id, coalesce(text, '') as text from documents),
doc as (select *, coalesce(lead(text) over (order by id), first_value(text) over (order by id)) as next, length(text) as n from base),
ed as (select *, substring(text, 1, n - n // 2) || substring(next, 1, n // 2) as edited from doc),
side as (select 0 as side, id, text from ed union all select 1, id, edited from ed),
norm as (select side, id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as t from side),
word as (select side, id, unnest(string_split(t, ' ')) as w, generate_subscripts(string_split(t, ' '), 1) as pos from norm where t <> ''),
mark as (select *, w in ({anchors}) as stop, lag(w) over (partition by side, id order by pos) as anchor from word),
content as (select side, id, w, anchor, anchor in ({anchors}) as spot, {leads} from mark where not stop),
sig as (select distinct side, id, substring(md5({chain}), 1, {DIGITS}) as s from content where spot),
spots as (select side, id, list_sort(list(s)) as own from sig group by side, id),
sets as (select side, id, coalesce(own, case when t = '' then [] else [substring(md5(t), 1, {DIGITS})] end) as own from norm left join spots using (side, id)),
pair as (select e.doc_id, e.n, e.edited, a.own as a, b.own as b, coalesce(c.own, f.own) as c
  from ed e join sets a on a.side = 0 and a.id = e.id join sets b on b.side = 1 and b.id = e.id
  left join sets c on c.side = 0 and c.id = e.id + 1 join sets f on f.side = 0 and f.id = 1)
select doc_id, n as n_chars, sha256(edited) as edited_sha256, array_to_string(a, '') as fingerprint, array_to_string(b, '') as edited_fingerprint,
  case when len(a) + len(b) = 0 then 1.0::double else len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) end as near_edited,
  case when len(a) + len(c) = 0 then 1.0::double else len(list_intersect(a, c))::double / (len(a) + len(c) - len(list_intersect(a, c))) end as near_next
from pair"""


QUERIES = {"op2_spotsigs": op2_spotsigs}
ORACLES = {"op2_spotsigs": _sql()}
