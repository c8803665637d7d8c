"""Itemsets, their measures, vectors and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import analysis as A
from textloom.storage import placed


def pair_support(baskets: DataFrame, basket: str, item: str, least: int) -> DataFrame:
    """(a, b, support): pairs of items that share at least so many baskets. Infrequent items leave before pairs are formed."""
    rows = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    often = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("item")
    rows = rows.join(often, "item", "left_semi")
    pairs = rows.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    each = pairs.select(F.posexplode("items").alias("i", "a"), "items").select("a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    return each.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def frequent_itemsets(baskets: DataFrame, basket: str, item: str, min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Frequent itemsets of any size, and association rules, by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    rows = baskets.groupBy(basket).agg(F.collect_set(item).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    return model.freqItemsets, model.associationRules


def pair_measures(pairs: DataFrame, items: DataFrame, n: int | None = None) -> DataFrame:
    """confidence, lift, entropy and Gini index of the rule a -> b. items: (item, n); pairs: (a, b, support); n__ is the number of baskets."""
    left = items.select(F.col("item").alias("a"), F.col("n").alias("n_a"))
    right = items.select(F.col("item").alias("b"), F.col("n").alias("n_b"))
    p = F.col("support") / F.col("n_a")
    entropy = F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "support", F.round(p, 6).alias("confidence"), F.round(p * F.col("n__") / F.col("n_b"), 6).alias("lift"), F.round(entropy, 6).alias("entropy"), F.round(1 - p * p - (1 - p) * (1 - p), 6).alias("gini"))


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str):
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, pos, mean): each class's mean vector, in one shuffle of partial means."""
    each = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("pos", "x"))
    return each.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def split_baskets(words: DataFrame, key: str, splits: list) -> DataFrame:
    """(key, basket, items): each document's terms in order (key, word, term), cut into baskets at some terms, which are in none."""
    marked = words.withColumn("cut", F.col("term").isin(splits).cast("int"))
    numbered = marked.withColumn("basket", F.sum("cut").over(Window.partitionBy(key).orderBy("word").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("cut = 0").groupBy(key, "basket").agg(F.array_sort(F.collect_set("term")).alias("items"))


def window_baskets(words: DataFrame, key: str, size: int, step: int = 1, around: list | None = None) -> DataFrame:
    """(key, basket, items): the terms in each window of ``size`` words, a new one beginning every ``step`` words; around: only windows that hold one of some terms."""
    low = F.greatest(F.ceil((F.col("word") - size + 1) / step), F.lit(0)).cast("bigint")
    each = words.withColumn("basket", F.explode(F.sequence(low, F.floor(F.col("word") / step).cast("bigint")))).where(F.col("basket") * step + size > F.col("word"))
    baskets = each.groupBy(key, "basket").agg(F.array_sort(F.collect_set("term")).alias("items"))
    return baskets.where(F.arrays_overlap("items", F.array(*map(F.lit, around)))) if around else baskets


def itemset_rankings(itemsets: DataFrame, items: DataFrame, n_baskets: int) -> DataFrame:
    """itemsets (items, support) with how far they are from chance: log_likelihood and surprise against the support that independent items would have, entropy and gini of the items' shares, length and total_freq. items: (item, n)."""
    each = itemsets.select("items", "support", F.explode("items").alias("item")).join(items, "item")
    share = F.col("n") / F.lit(float(n_baskets))
    sums = each.groupBy("items", "support").agg(F.sum(F.log(share)).alias("l"), F.sum(-share * F.log2(share)).alias("entropy"), (1 - F.sum(share * share)).alias("gini"), F.count("*").alias("length"), F.sum("n").alias("total_freq"))
    expected = F.exp("l") * n_baskets
    mean = (expected + F.col("support")) / 2
    g2 = 2 * (expected * F.log10(expected / mean) + F.col("support") * F.log10(F.col("support") / mean))
    return sums.select("items", "support", F.when(F.col("support") < expected, -g2).otherwise(g2).alias("log_likelihood"), (F.lit(float(n_baskets)) / expected * F.col("support")).alias("surprise"), "entropy", "gini", "length", "total_freq")


def supports_for(baskets: DataFrame, basket: str, item: str, least_itemsets: int, least_rules: int = 0, confidence: float = 0.5, rounds: int = 12) -> tuple[float, DataFrame, DataFrame]:
    """(support, itemsets, rules): the largest support, found by halving in at most ``rounds`` rounds, that gives so many itemsets of two items or more and so many rules."""
    low, high, best = 0.0, 1.0, None
    for _ in range(rounds):
        support = (low + high) / 2
        sets, rules = frequent_itemsets(baskets, basket, item, support, confidence)
        if sets.where("size(items) > 1").count() >= least_itemsets and (not least_rules or rules.count() >= least_rules):
            low, best = support, (support, sets, rules)
        else:
            high = support
    if best is None:
        sets, rules = frequent_itemsets(baskets, basket, item, 0.0, confidence)
        best = 0.0, sets, rules
    return best


def renumbered(vectors: DataFrame, term: str = "term_id") -> tuple[DataFrame, DataFrame]:
    """(vectors with dense attribute numbers from 1 in order of the terms, the table (term, number) that undoes it)."""
    numbers = placed(vectors.select(term).distinct(), term, name="number")
    return vectors.join(numbers, term), numbers


def limited_vectors(vectors: DataFrame, key: str, terms: DataFrame, local: tuple = (None, None), recs: tuple = (None, None), occs: tuple = (None, None), top: int | None = None) -> DataFrame:
    """Vectors (key, term, occs) with the terms whose occurrences in the document (local), documents (recs) and occurrences in all (occs) lie within bounds, those included; top: of each document the most frequent ones."""
    rows = vectors.join(terms.select("term", "n_recs", "n_occs"), "term")
    for column, (least, most) in (("occs", local), ("n_recs", recs), ("n_occs", occs)):
        rows = rows if least is None else rows.where(F.col(column) >= least)
        rows = rows if most is None else rows.where(F.col(column) <= most)
    if top is not None:
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("occs"), "term"))
        rows = rows.withColumn("place__", place).where(F.col("place__") <= top).drop("place__")
    return rows.select(key, "term", "occs")


def libsvm_lines(vectors: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """(key, line): vectors (key, number, occs) and labels (key, label) in the sparse text form."""
    pairs = F.array_sort(F.collect_list(F.struct("number", "occs")))
    lists = vectors.groupBy(key).agg(F.transform(pairs, lambda x: F.concat_ws(":", x["number"].cast("string"), x["occs"].cast("string"))).alias("x"))
    return lists.join(labels.select(key, "label"), key).select(key, F.concat_ws(" ", F.col("label").cast("string"), F.array_join("x", " ")).alias("line"))


def transactions(vectors: DataFrame, key: str) -> DataFrame:
    """(key, line): each vector's attributes as a line of numbers in order."""
    return vectors.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("number")).cast("array<string>"), " ").alias("line"))


def classified(docs: DataFrame, labels: DataFrame, label: str, method: str, n_features: int = 1 << 12, **options) -> DataFrame:
    """(doc_id, prediction) by a classifier over hashed word counts, learnt from the labelled rows.

    ``method``: bayes, svm (linear), perceptron (log loss without regularisation
    and intercept scaling, at most 100 rounds), or network (one hidden layer, back propagation).
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes
    from pyspark.ml.feature import HashingTF

    rows = docs.select("doc_id", F.coalesce(A.words("text"), F.array().cast("array<string>")).alias("tokens"))
    vectors = HashingTF(inputCol="tokens", outputCol="features", numFeatures=n_features).transform(rows)
    known = vectors.join(labels.select("doc_id", F.col(label).cast("double").alias("label")).where("label is not null"), "doc_id")
    if method == "bayes":
        model = NaiveBayes(**options)
    elif method == "svm":
        model = LinearSVC(**({"maxIter": 20} | options))
    elif method == "perceptron":
        model = LogisticRegression(**({"maxIter": 100, "standardization": False} | options))
    elif method == "network":
        hidden = options.pop("hidden", 8)
        model = MultilayerPerceptronClassifier(**({"layers": [n_features, hidden, 2], "maxIter": 20, "seed": 1} | options))
    else:
        raise ValueError(f"no classifier called {method}")
    return model.fit(known).transform(vectors).select("doc_id", F.col("prediction").cast("int").alias("prediction"))
