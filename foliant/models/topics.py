"""Topics of short texts: vectors reduced by PCA, clustered, and named by class-based TF-IDF; coherence, diversity and outliers. The reference
method's density clustering isn't available to Spark: bisecting k-means takes its place, and the farthest rows of a cluster are the outliers (topic -1)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clean import counted_words
from ..operators.quantiles import quantiles

OUTLIER = -1


def hashed_vectors(tokens: DataFrame, column: str = "tokens", size: int = 256, out: str = "embedding") -> DataFrame:
    """Texts as unit vectors of hashed word counts: the embedding that needs no model. Others may be joined in its place."""
    own = HashingTF(numFeatures=size, inputCol=column, outputCol="__tf").transform(tokens)
    return Normalizer(inputCol="__tf", outputCol="__unit").transform(own).withColumn(out, vector_to_array("__unit", "float32")).drop("__tf", "__unit")


@dataclass
class TopicModel:
    """A model with its parameters in sections, set by section__name; an own one needs train() and set() alone."""

    parameters: dict = field(default_factory=lambda: {"reduce": {"n_components": 5}, "cluster": {"n_topics": 8, "min_cluster_size": 10, "outlier_share": 0.05, "seed": 42}, "words": {"min_df": 0.005, "top_n_words": 10}})

    def set(self, **flat) -> "TopicModel":
        """section__name=value; ValueError for names that aren't there."""
        for k, v in flat.items():
            section, _, name = k.partition("__")
            if name not in self.parameters.get(section, {}):
                raise ValueError(f"no parameter {k}")
            self.parameters[section][name] = v
        return self

    def check(self) -> None:
        p = self.parameters
        if p["reduce"]["n_components"] < 1 or p["cluster"]["n_topics"] < 2 or p["cluster"]["min_cluster_size"] < 1:
            raise ValueError("n_components and min_cluster_size must be at least 1, n_topics at least 2")
        if not 0 <= p["cluster"]["outlier_share"] < 1 or not 0 <= p["words"]["min_df"] < 1 or p["words"]["top_n_words"] < 1:
            raise ValueError("outlier_share and min_df must lie in [0, 1), top_n_words be at least 1")

    def train(self, rows: DataFrame, key: str, text: str, embedding: str = "embedding") -> dict[str, DataFrame]:
        """assigned (key, topic), words (topic, rank, word, score), sizes (topic, n, share)."""
        self.check()
        p = self.parameters
        vectors = rows.select(key, array_to_vector(embedding).alias("__v"))
        small = PCA(k=p["reduce"]["n_components"], inputCol="__v", outputCol="features").fit(vectors).transform(vectors).select(key, "features")
        c = p["cluster"]
        model = BisectingKMeans(k=c["n_topics"], minDivisibleClusterSize=float(c["min_cluster_size"]), seed=c["seed"]).fit(small)
        centers = model.clusterCenters()
        at = model.transform(small).withColumn("__x", vector_to_array("features"))
        center: Column = F.element_at(F.array(*(F.array(*(F.lit(float(x)) for x in m)) for m in centers)), F.col("prediction") + 1)
        far = at.select(key, F.col("prediction").alias("topic"), F.sqrt(F.aggregate(F.zip_with("__x", center, lambda a, b: (a - b) ** 2), F.lit(0.0), lambda s, x: s + x)).alias("distance"))
        if c["outlier_share"]:
            limit = quantiles(far, ["distance"], [1 - c["outlier_share"]], ["topic"]).select(F.col("topic").alias("__t"), F.col("q0").alias("limit"))
            far = far.join(limit, F.col("topic") == F.col("__t")).withColumn("topic", F.when(F.col("distance") > F.col("limit"), OUTLIER).otherwise(F.col("topic"))).drop("__t", "limit")
        assigned = far.select(key, "topic")
        words = class_words(rows.select(key, text).join(assigned, key), text, p["words"]["min_df"])
        return {"assigned": assigned, "words": top_words(words, p["words"]["top_n_words"]), "sizes": sizes(assigned)}


def class_words(rows: DataFrame, text: str, least: float = 0.0) -> DataFrame:
    """topic, word, score: term frequency in the topic times ln(1 + words a topic / frequency of the word in all), of words in at least the share `least` of texts. Outliers have none."""
    each = rows.filter(F.col("topic") != OUTLIER).select("topic", F.explode(F.array_distinct(counted_words(F.col(text)))).alias("word"))
    total = rows.agg(F.count("*").alias("n_texts"))
    common = each.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(total)).filter(F.col("df") >= F.col("n_texts") * least).select("word")
    uses = rows.filter(F.col("topic") != OUTLIER).select("topic", F.explode(counted_words(F.col(text))).alias("word")).join(common, "word", "left_semi").groupBy("topic", "word").agg(F.count("*").alias("n"))
    of_topic = uses.groupBy("topic").agg(F.sum("n").alias("in_topic"))
    average = of_topic.agg(F.avg("in_topic").alias("mean"))
    of_word = uses.groupBy("word").agg(F.sum("n").alias("in_all"))
    met = uses.join(of_topic, "topic").join(of_word, "word").join(F.broadcast(average))
    return met.select("topic", "word", (F.col("n") / F.col("in_topic") * F.log1p(F.col("mean") / F.col("in_all"))).alias("score"))


def top_words(words: DataFrame, n: int = 10, vocabulary: DataFrame | None = None, dropped: tuple[str, ...] = ("mr", "ms")) -> DataFrame:
    """topic, rank, word, score: the n best words of each topic, of the vocabulary (column word) where one is given."""
    own = words.filter(~F.col("word").isin(*dropped))
    own = own if vocabulary is None else own.join(vocabulary.select("word").distinct(), "word", "left_semi")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "word")))
    return ranked.filter(F.col("rank") <= n).select("topic", "rank", "word", "score")


def sizes(assigned: DataFrame) -> DataFrame:
    """topic, n, share of all rows; the outliers' share is that of topic -1."""
    counts = assigned.groupBy("topic").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("topic", "n", (F.col("n") / F.col("total")).alias("share"))


def diversity(words: DataFrame, top: int = 10) -> DataFrame:
    """One row: distinct words among the topics' best ones, as a share of them."""
    own = words.filter(F.col("rank") <= top)
    return own.agg((F.count_distinct("word") / F.count("*")).alias("diversity"))  # some words a topic


def coherence(words: DataFrame, tokens: DataFrame, column: str = "tokens", top: int = 10, window: int = 110, smooth: float = 1e-12) -> DataFrame:
    """topic, npmi (mean over pairs of its best words), c_v (mean cosine of each word's NPMI vector to the sum of all), by co-occurrence in sliding windows of the
    texts' tokens (a shorter text is one window)."""
    best = words.filter(F.col("rank") <= top).select("topic", "word")
    vocabulary = best.select("word").distinct()
    n = F.size(column)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - window))
    own = tokens.filter(n > 0).select(F.monotonically_increasing_id().alias("d"), column)
    windows = own.select("d", F.posexplode(F.transform(starts, lambda s: F.array_distinct(F.slice(F.col(column), s + 1, F.lit(window))))).alias("w", "words"))
    total = windows.agg(F.count("*").alias("n"))
    # Texts and their windows are read again with the same numbers only within one job; the pairs are made inside a window's row.
    held = windows.select("words").join(F.broadcast(vocabulary.agg(F.collect_set("word").alias("v")))).select(F.array_sort(F.array_intersect("words", "v")).alias("x"))  # top words of the topics only
    single = held.select(F.explode("x").alias("word")).groupBy("word").agg(F.count("*").alias("n1"))
    pairs = held.select(F.explode(F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.*").groupBy("a", "b").agg(F.count("*").alias("n2"))
    wanted = best.select("topic", F.col("word").alias("i")).join(best.select("topic", F.col("word").alias("j")), "topic")  # top words of a topic: top * top rows
    met = wanted.join(pairs, (F.least("i", "j") == F.col("a")) & (F.greatest("i", "j") == F.col("b")), "left")
    met = met.join(single.withColumnsRenamed({"word": "i", "n1": "ni"}), "i", "left").join(single.withColumnsRenamed({"word": "j", "n1": "nj"}), "j", "left").join(F.broadcast(total))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    pij = F.when(F.col("i") == F.col("j"), count("ni") / F.col("n")).otherwise(count("n2") / F.col("n")) + smooth
    pi, pj = count("ni") / F.col("n"), count("nj") / F.col("n")
    npmi = F.when((pi > 0) & (pj > 0), F.log(pij / (pi * pj)) / F.when(pij < 1, -F.log(pij)).otherwise(F.lit(smooth))).otherwise(0.0)
    cells = met.select("topic", "i", "j", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), npmi)).alias("x"))
    whole = cells.groupBy("topic", "j").agg(F.sum("x").alias("s"))
    cosine = cells.join(whole, ["topic", "j"]).groupBy("topic", "i").agg((F.sum(F.col("x") * F.col("s")) / F.nullif(F.sqrt(F.sum(F.col("x") ** 2)) * F.sqrt(F.sum(F.col("s") ** 2)), F.lit(0.0))).alias("cos"))
    mean = cells.filter("i < j").groupBy("topic").agg(F.avg("x").alias("npmi"))
    return cosine.groupBy("topic").agg(F.avg("cos").alias("c_v")).join(mean, "topic", "left").select("topic", "npmi", "c_v")
