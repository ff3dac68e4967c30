"""Mixing sources to target weights by Pareto order sampling.

Each source's target may ask for a multiple of its words. The whole part of
target / size is allocated to every document as certain copies. For the rest,
documents carry an inclusion probability p and a seeded uniform u; they are ranked
by the odds of u divided by the odds of p (Pareto order sampling), and the sample
is fixed in words: the longest prefix of that ranking that fits what is left of the
target. Two more rounds rank the documents that still fit the remainder. Last, of
all documents below `most` copies, one more copy of that one is taken that brings
the source nearest to its target, if any brings it nearer. The rounds and the last
copy favour short documents by some long document's words a source: noticeable where
a source has tens of documents, not where it has thousands.

p falls with a document's length, so that what is repeated in part is spread over
many texts. With c the fractional part, p = c + c (1 - c) t, where t in (-1, 1) is
1 / (1 + size / mean size), in 1024ths, less its mean over the source's words. Each p
is in (0, 1), and as the sizes times t add up to 0, the expected words are c of the source's.

The prefix is found without sorting a source in one task: words are summed in
4096 bins of the rank, only the bin where the budget ends is cut again, and only
that bin's rows are ordered. A round leaves one row a source, the place where its
prefix stops; whether a document is taken follows from its own place and those
stops, so no table of taken documents is made. Equal rows are numbered and drawn
one by one. Null texts have size 0; null sources form one source; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, read, word_count

MOST = 3  # copies of a document
WEIGHTS = 3  # sources weigh 1, 2, ... up to this, again and again
BINS = 4096
ROUNDS = 3
EDGE = 2.0**-52  # nearest that a probability comes to 0 or 1, against rounding
SALTS = 64  # parts of a source where sources are too many to broadcast


def targets(rows: DataFrame, most: int = MOST, weights: int = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, documents (its rows), target.

    Targets share all words by weight, but none exceeds `most` times its source.
    Ordered by cap / weight, the sources that reach their cap come first; the
    level is the first at which the next source stays below its own.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    ranked = sums.withColumn("weight", (F.pmod(place - 1, F.lit(weights)) + 1).cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        ((F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"),
        F.row_number().over(order).alias("turn"),
    )
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("turn", "level"))).over(everything)
    return level.select("source", "source_size", "documents", F.least("cap", F.coalesce(fits["level"], F.lit(0.0)) * F.col("weight")).alias("target"))


def uniform(*key: str, seed: int) -> Column:
    """A number in (0, 1) that depends on the key's values and the seed only: 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (source, key, copy, ...) and what `sources`, a written table with a row a source, knows of theirs; others go.
    That table is broadcast where its size allows; else a source's rows are dealt to SALTS tasks."""
    salted = sources.withColumnRenamed("source", "_source").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("key", "copy"), F.lit(SALTS)).cast("int")
    return rows.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (salt == F.col("_salt"))).drop("_source", "_salt")


def _ends(rows: DataFrame, cell: Column) -> DataFrame:
    """Of rows (source, size, budget): source, bin (the first cell that its budget doesn't hold whole),
    rest (of the budget where that cell begins). Sources that fit whole have no row."""
    sums = rows.groupBy("source", cell.alias("bin")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))  # at most BINS + 1 rows a source
    over = sums.withColumn("rest", F.col("budget") - running).where("rest < 0")
    first = over.groupBy("source").agg(F.min(F.struct("bin", (F.col("rest") + F.col("words")).alias("rest"))).alias("end"))
    return materialize(first.select("source", "end.*"), "ends")


def stops(rows: DataFrame) -> DataFrame:
    """Of rows (source, key, copy, size, rank in (0, 1), place, budget): source, stop (the first place beyond the
    longest prefix within the budget) and rest (of the budget before it). Sources that fit whole have no row."""
    one = F.floor(F.col("rank") * BINS).cast("int")
    two = F.floor((F.col("rank") * BINS - one) * BINS).cast("int")
    ends = _ends(rows, one)
    edge = _with_source(rows.drop("budget"), ends).where(one == F.col("bin")).withColumnRenamed("rest", "budget").drop("bin")
    edge = materialize(edge, "edge")
    inner = _ends(edge, two)
    last = _with_source(edge.drop("budget"), inner).where(two == F.col("bin"))
    last = last.withColumn("running", F.sum("size").over(Window.partitionBy("source").orderBy("place")))
    held = F.col("running") <= F.col("rest")
    found = last.groupBy("source").agg(F.min(F.when(~held, F.col("place"))).alias("stop"), (F.first("rest") - F.coalesce(F.max(F.when(held, F.col("running"))), F.lit(0))).alias("rest"))
    out = materialize(found, "stops")
    discard(ends, edge, inner)
    return out


def shortness() -> Column:
    """1024 / (1 + size / mean size of the source), rounded down: whole numbers, whose sums don't depend on an order."""
    return F.expr("(1024 * source_size) div greatest(1, source_size + documents * size)")


def inclusion() -> Column:
    """Inclusion probability of a row in what its source's whole copies leave, from chance, shortness and short_words."""
    t = (shortness().cast("double") - F.col("short_words").cast("double") / F.col("source_size").cast("double")) / 1024.0
    p = F.col("chance") + F.col("chance") * (1.0 - F.col("chance")) * t
    return F.least(F.greatest(p, F.lit(EDGE)), F.lit(1.0 - EDGE))


def mix(rows: DataFrame, key: str, seed: int = 42, most: int = MOST, weights: int = WEIGHTS) -> DataFrame:
    """rows: key, source, size; equal rows may repeat. Adds copy (numbers equal
    rows), source_size, target and copies, the times the mix takes the row."""
    counted = rows.select(F.col(key).alias("key"), "source", "size").groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    numbered = counted.select("key", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(ratio).cast("long")
    budget = F.floor(F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")).cast("long")  # sizes are whole numbers
    goal = targets(rows, most, weights).select("*", whole.alias("whole"), (ratio - whole).alias("chance"))
    pool = materialize(numbered.withColumn("u", uniform("key", "source", "copy", seed=seed)), "drawn")
    begun = materialize(goal.select("*", budget.alias("budget0")), "sources")
    same = F.col("source").eqNullSafe(F.col("_source"))
    short = _with_source(pool, begun).groupBy(F.col("source").alias("_source")).agg(F.sum(F.col("size") * shortness()).alias("short_words"))
    state = materialize(begun.join(short, same, "left").drop("_source"), "sources")
    discard(begun)
    odds = (F.col("u") / (1.0 - F.col("u"))) / (F.col("p") / (1.0 - F.col("p")))
    rank = F.when(F.col("chance") > 0, odds / (1.0 + odds))

    def ranked() -> DataFrame:
        p = F.when(F.col("chance") > 0, inclusion())
        return _with_source(pool, state).withColumn("p", p).withColumn("rank", rank)

    place = F.struct("rank", "key", "copy", "size")
    taken = F.lit(False)
    for i in range(ROUNDS):
        b, stop = F.col(f"budget{i}"), F.col(f"stop{i}")
        left = F.col("rank").isNotNull() & (F.col("budget0") > 0) & ~taken
        if i:
            left &= F.coalesce(F.col("size") <= b, F.lit(False))
        rest = ranked().where(left).select("key", "source", "size", "copy", "rank", place.alias("place"), b.alias("budget"))
        found = stops(rest)
        ends = found.select(F.col("source").alias("_source"), F.col("stop").alias(f"stop{i}"), F.col("rest").alias(f"budget{i + 1}"))
        later = materialize(state.join(ends, same, "left").drop("_source"), "sources")
        discard(state, found)
        state = later
        taken |= left & F.coalesce(place < stop, F.lit(True))
    words = F.coalesce(F.sum(F.when(taken, F.col("size"))), F.lit(0))
    held = materialize(ranked().groupBy(F.col("source").alias("_source")).agg(words.alias("held")), "held")
    later = materialize(state.join(held, same, "left").drop("_source"), "sources")
    discard(state, held)
    state = later
    copies, over = F.col("whole") + taken.cast("long"), F.abs(F.col("size") - F.col("lacking"))
    nearer = F.col("rank").isNotNull() & (copies < most) & (over < F.col("lacking"))
    lacking = ranked().withColumn("lacking", F.col("budget0") - F.col("held")).where(nearer)
    edge = lacking.groupBy(F.col("source").alias("_source")).agg(F.min(F.struct(over.alias("over"), taken.alias("again"), place.alias("place"))).alias("edge"))
    edge = materialize(edge.select("_source", F.col("edge.place").alias("edge")), "edge")
    later = materialize(state.join(edge, same, "left").drop("_source"), "sources")
    discard(state, edge)
    state = later
    copies += (F.col("edge").isNotNull() & place.eqNullSafe(F.col("edge"))).cast("long")
    return ranked().select(F.col("key").alias(key), "source", "size", "copy", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The documents of the mix, each as often as it is taken. Rows are told apart by all
    their columns, of which 128 hash bits stand for a row; which kind of column is null counts too."""
    row, taken, n = (free_name(docs, x) for x in ("_row", "_taken", "_n"))
    parts = [F.col(f"`{c}`") for c in docs.columns]
    flags = [x.isNull() for x in parts]
    key = F.concat_ws(":", *[F.xxhash64(F.lit(i), *parts, *flags).cast("string") for i in (1, 2)])
    marked = docs.withColumn(row, key)
    light = materialize(marked.select(F.col(row).alias("key"), "source", word_count().alias("size")), "sizes")
    copies = mix(light, "key", seed).groupBy(F.col("key").alias(taken)).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    whole = marked.dropDuplicates([row]).join(copies, F.col(row) == F.col(taken))
    copy = free_name(docs, "_copy")
    return whole.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias(copy)).drop(copy)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 by source, in words."""
    light = materialize(read(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size")), "sizes")
    mixed = mix(light, "doc_id")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def _round_sql(i: int) -> str:
    before = "".join(f" UNION ALL SELECT * FROM taken{j}" for j in range(i))[len(" UNION ALL ") :]
    if not i:
        left = "SELECT *, budget AS b FROM pool WHERE rank IS NOT NULL AND budget > 0"
    else:
        left = f"""SELECT * FROM (SELECT p.*, p.budget - coalesce(w.words, 0) AS b FROM pool p
            LEFT JOIN (SELECT source, sum(size) AS words FROM ({before}) GROUP BY source) w ON p.source IS NOT DISTINCT FROM w.source
            WHERE p.rank IS NOT NULL AND p.budget > 0 AND p.row NOT IN (SELECT row FROM ({before}))) WHERE size <= b"""
    return f"""taken{i} AS (SELECT row, source, size FROM (SELECT row, source, size, b,
        sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, copy, size ROWS UNBOUNDED PRECEDING) AS running FROM ({left})) WHERE running <= b)"""


ORACLE = {
    "op5_mixing": f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM sized),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS documents FROM sized GROUP BY source),
ranked AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1 AS DOUBLE) AS weight, {MOST}.0::DOUBLE * source_size AS cap FROM sums),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
goal AS (SELECT source, source_size, documents, least(cap, coalesce((SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1), 0.0) * weight) AS target FROM levels),
joined AS (SELECT n.*, source_size, target, (1024 * source_size) // greatest(1, source_size + documents * size) AS shortness, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0), 0.0) AS ratio,
    (CAST('0x' || substr(md5(concat_ws('|', '42', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(n.source, ''), CAST(copy AS VARCHAR))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM numbered n JOIN goal g ON n.source IS NOT DISTINCT FROM g.source),
split AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, ratio - floor(ratio) AS chance,
    (CAST(shortness AS DOUBLE) - CAST(sum(size * shortness) OVER (PARTITION BY source) AS DOUBLE) / CAST(source_size AS DOUBLE)) / 1024.0::DOUBLE AS t FROM joined),
odd AS (SELECT *, CASE WHEN chance > 0 THEN least(greatest(chance + chance * (1.0::DOUBLE - chance) * t, '{EDGE!r}'::DOUBLE), '{1 - EDGE!r}'::DOUBLE) END AS p FROM split),
drawn AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS odds FROM odd),
pool AS (SELECT *, row_number() OVER () AS row, odds / (1 + odds) AS rank, floor(target - CAST(whole * source_size AS DOUBLE)) AS budget FROM drawn),
{", ".join(_round_sql(i) for i in range(ROUNDS))},
took AS (SELECT row FROM taken0 UNION ALL SELECT row FROM taken1 UNION ALL SELECT row FROM taken2),
held AS (SELECT *, row IN (SELECT row FROM took) AS taken FROM pool),
lack AS (SELECT *, whole + CAST(taken AS BIGINT) AS n, budget - coalesce(sum(CASE WHEN taken THEN size END) OVER (PARTITION BY source), 0) AS lacking FROM held),
edge AS (SELECT row, row_number() OVER (PARTITION BY source ORDER BY abs(size - lacking), taken, rank, doc_id NULLS FIRST, copy, size) AS place
    FROM lack WHERE rank IS NOT NULL AND n < {MOST} AND abs(size - lacking) < lacking),
copied AS (SELECT *, n + CASE WHEN row IN (SELECT row FROM edge WHERE place = 1) THEN 1 ELSE 0 END AS copies FROM lack)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM copied"""
}
QUERIES = {"op5_mixing": op5_mixing}
