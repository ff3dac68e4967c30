"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark column expressions. Shallow trees grown on labelled rows
give conjunctive rules (the paths from the root to every node); a lasso logistic
regression over the rules keeps a few with weights; these compile into one Spark
column expression that scores any number of rows.

Nulls: a null text counts as empty; labels that are null or of unknown
documents are left out, of repeated labels the largest holds. Empty texts score
like others. Without labels of both classes the score is the share of ones
among the labels, 0.5 if there are none. A null doc_id isn't held out. Repeated rows score alike; no rows give
no rows; columns beside the named ones are left out or passed on untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, read, word_count

TRAIN_ROWS = 20_000  # labelled rows to learn from, at most about; drawn by a hash of doc_id
TREES, DEPTH = 24, 3
LASSO = 0.0005


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, chars, ""))


def statistics(df: DataFrame, text: str = "text", prefix: str = "s_") -> DataFrame:
    """df with its statistics in columns prefix + name.

    They come out of a generator, so that filters on them aren't pushed below
    and every statistic is computed once per row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    size, words = F.length(t), word_count(t)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)
    tokens = F.split(t, r"[\x20\x09-\x0D]+")
    letters = size - _without(t, r"\p{L}+")
    stats = {
        "chars": F.log1p(size.cast("double")),
        "words": F.log1p(words.cast("double")),
        "word_length": _share(size, words),
        "letters": _share(letters, size),
        "capitals": _share(size - _without(t, r"\p{Lu}+"), size),
        "digits": _share(size - _without(t, r"[0-9]+"), size),
        "spaces": _share(size - _without(t, r"[\x20\x09-\x0D]+"), size),
        "commas_stops": _share(size - _without(t, "[.,;:?']+"), size),
        "symbols": _share(size - _without(t, r"[^\p{L}\p{N}\x20\x09-\x0D.,;:?']+"), size),
        "line_length": _share(size, F.size(lines)),
        "lines_distinct": _share(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_distinct": _share(F.size(F.array_distinct(tokens)), F.size(tokens)),
    }
    row = F.struct(*[v.alias(prefix + k) for k, v in stats.items()])
    return df.select("*", F.inline(F.array(row)))


STATISTICS = ("chars", "words", "word_length", "letters", "capitals", "digits", "spaces", "commas_stops", "symbols", "line_length", "lines_distinct", "words_distinct")


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics: (name, above, at most), either None."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self, prefix: str = "s_") -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low is not None:
                out = out & (F.col(prefix + name) > F.lit(low))
            if high is not None:
                out = out & (F.col(prefix + name) <= F.lit(high))
        return out


@dataclass(frozen=True)
class RuleModel:
    """The score is the logistic function of intercept plus the weights of the rules that hold."""

    intercept: float = 0.0
    weighted: tuple[tuple[Rule, float], ...] = ()
    constant: float | None = None
    tried: int = field(default=0, compare=False)

    def score(self, prefix: str = "s_") -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            total = total + F.when(rule.column(prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _paths(node, names: tuple[str, ...], bounds: dict[str, tuple[float | None, float | None]]) -> list[Rule]:
    """The rule of every node below a node of a Spark tree."""
    found = [Rule(tuple((n, *bounds[n]) for n in names if n in bounds))] if bounds else []
    if node.getClass().getSimpleName() != "InternalNode":
        return found
    split = node.split()
    name, at = names[split.featureIndex()], split.threshold()
    low, high = bounds.get(name, (None, None))
    left = bounds | {name: (low, at if high is None else min(at, high))}
    right = bounds | {name: (at if low is None else max(at, low), high)}
    return found + _paths(node.leftChild(), names, left) + _paths(node.rightChild(), names, right)


def drawn_labels(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and label (0.0 or 1.0) of documents that aren't held out, `most` at most about."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    share = min(1.0, most / max(1, known.count()))
    return known if share == 1 else known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Statistics and label of the documents of drawn_labels(), one row a doc_id (of unlike texts under it the least): only theirs are computed."""
    known = F.broadcast(drawn_labels(labels, most).withColumnRenamed("doc_id", "_id"))  # `most` rows
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return statistics(rows.select("doc_id", "label", "text")).select("label", "doc_id", *[f"s_{n}" for n in STATISTICS])


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(train: DataFrame) -> RuleModel:
    """train: label and statistics of a bounded number of rows."""
    train = materialize(train, "train").coalesce(1).sortWithinPartitions("doc_id", *[f"s_{n}" for n in STATISTICS])
    train = train.select("label", array_to_vector(F.array(*[f"s_{n}" for n in STATISTICS])).alias("x"), *[f"s_{n}" for n in STATISTICS]).cache()
    counts = dict(train.groupBy("label").count().collect())
    if len(counts) < 2:
        train.unpersist()
        return RuleModel(constant=float(next(iter(counts), 0.5)))
    # the rarer class counts as much as the other while trees look for splits
    weight = F.when(F.col("label") == 1, F.lit(1.0 / counts[1.0])).otherwise(F.lit(1.0 / counts[0.0])) * float(sum(counts.values()))
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", weightCol="w", numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="onethird").fit(train.withColumn("w", weight))
    rules = sorted({r for tree in forest.trees for r in _paths(tree._call_java("rootNode"), STATISTICS, {})}, key=repr)
    held = train.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("x"))
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(held)
    train.unpersist()
    kept = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w)
    return RuleModel(float(lasso.intercept), kept, tried=len(rules))


def scored(docs: DataFrame, model: RuleModel, column: str) -> DataFrame:
    """docs with the score of each text: computed once for a row, below any filter on it."""
    prefix = "s_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return statistics(docs, prefix=prefix).select(*docs.columns, F.inline(F.array(F.struct(model.score(prefix).alias(column)))))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score `threshold` or more."""
    score = free_name(docs, "_score")
    return scored(docs, fit(training_rows(docs, labels)), score).where(F.col(score) >= threshold).drop(score)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, read(spark, sf_dir, "labels")))
    out = scored(docs, model, "score").select("doc_id", held_out().alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op1_quality": op1_quality}
ORACLE: dict[str, str] = {}
