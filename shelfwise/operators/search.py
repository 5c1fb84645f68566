"""Product and note search: AND-matched full text, BM25, cosine similarity, and their blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# BM25 constants, blend weights and cut, catalog phrases.
BM25_K1 = 1.2
BM25_B = 0.75
TEXT_WEIGHT = 0.4
VECTOR_WEIGHT = 0.6
HYBRID_CUT = 0.2
WINTER_SEASONS = ["winter"]
WINTER_CATEGORIES = ["outerwear"]
WINTER_NAMES = ["parka", "jacket", "fleece", "hoodie", "coat"]
WINTER_PHRASE = "warm insulated cold-weather layer for winter warmth"
PLAIN_PHRASE = "apparel"


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+")
    return F.filter(words, lambda w: w != "")


def query_terms(query: str) -> list[str]:
    cleaned = "".join(c if "a" <= c <= "z" else " " for c in query.lower())
    return sorted(set(cleaned.split()))


def _count_of(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term)).cast("double")


def _term_counts(words: Column, terms: list[str]) -> Column:
    """Occurrences of each term. The long token array is read once, to keep the query's words;
    the terms are counted on that short rest."""
    return F.array(*[_count_of(words, t) for t in terms])


def search_text() -> Column:
    """Description of a product from its attributes and a phrase for winter goods."""
    fields = {"seasonality": WINTER_SEASONS, "category": WINTER_CATEGORIES, "product_name": WINTER_NAMES}
    winter = F.lit(False)
    for name, words in fields.items():
        text = F.lower(F.coalesce(F.col(name), F.lit("")))
        for word in words:
            winter = winter | text.contains(word)
    phrase = F.when(winter, WINTER_PHRASE).otherwise(PLAIN_PHRASE)
    return F.concat_ws(" ", "product_name", "category", "seasonality", phrase)


def product_catalog(position: DataFrame) -> DataFrame:
    """One row per product from the positions (the one of the smallest store), with its text and
    the most stock any store holds."""
    facts = F.struct("product_name", "category", "seasonality", "price_usd")
    return (
        position.where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.min_by(facts, "store_id").alias("_row"), F.max("on_hand_units").alias("most_on_hand"))
        .select("product_id", "_row.*", "most_on_hand")
        .withColumn("description", search_text())
    )


def fulltext_search(catalog: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """Products whose name and description hold every query word. Rank: the words' share of the
    text. Ties by product."""
    terms = query_terms(query)
    words = tokens(F.concat_ws(" ", "product_name", "description"))
    hits = F.filter(F.col("_words"), lambda w: w.isin(terms))
    counts = _term_counts(F.col("_hits"), terms)
    found = (
        catalog.withColumn("_words", words)
        .withColumn("_hits", hits)
        .withColumn("_counts", counts)
        .where(F.forall("_counts", lambda n: n > 0))
        .withColumn("rank", F.size("_hits") / F.size("_words"))
        .withColumn("on_hand_units", F.coalesce("most_on_hand", F.lit(0)))
        .select("product_id", "product_name", "category", "price_usd", "on_hand_units", "rank")
        .orderBy(F.desc("rank"), "product_id")
    )
    return found if limit is None else found.limit(limit)


def text_stats(docs: DataFrame, terms: list[str], extra: list[str] | None = None) -> DataFrame:
    """Per document its length and the count of each query term. Narrow: the text stays behind."""
    hits = F.filter(F.col("_words"), lambda w: w.isin(terms))
    return (
        docs.withColumn("_words", tokens(F.col("text")))
        .withColumn("_hits", hits)
        .select(
            "doc_id", *(extra or []), F.size("_words").cast("double").alias("length"),
            _term_counts(F.col("_hits"), terms).alias("counts"),
        )
    )


def bm25(stats: DataFrame, terms: list[str]) -> DataFrame:
    """BM25 of every document (0 without a match) from its text_stats. The corpus numbers are a
    scalar subquery over the same narrow table."""
    found = [F.sum((F.get("counts", F.lit(i)) > 0).cast("double")) for i in range(len(terms))]
    corpus = stats.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg"), F.array(*found).alias("df")
        ).alias("corpus")
    ).scalar()
    score = F.lit(0.0)
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("length") / F.col("_c.avg"))
    for i in range(len(terms)):
        tf, df = F.get("counts", F.lit(i)), F.get("_c.df", F.lit(i))
        idf = F.log(F.lit(1.0) + (F.col("_c.n") - df + F.lit(0.5)) / (df + F.lit(0.5)))
        score = score + idf * tf * F.lit(BM25_K1 + 1) / (tf + norm)
    return stats.withColumn("_c", corpus).withColumn("bm25", score).drop("_c")


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def with_similarity(vectors: DataFrame, wanted: Column) -> DataFrame:
    """Similarity of every stored vector to the wanted one; rows without a vector drop out."""
    return (
        vectors.where(F.col("embedding").isNotNull())
        .withColumn("_wanted", wanted)
        .withColumn("similarity", cosine(F.col("embedding"), F.col("_wanted")))
        .drop("_wanted")
    )


def cosine_topk(vectors: DataFrame, wanted: Column, k: int, key: str = "doc_id") -> DataFrame:
    """The k stored vectors closest to the wanted one, by exact scan."""
    return with_similarity(vectors, wanted).orderBy(F.desc("similarity"), key).limit(k)


def hybrid_search(scored: DataFrame, wanted: Column, limit: int = 8) -> DataFrame:
    """Blend of BM25, relative to its maximum over all documents, and cosine similarity, for the
    documents that have a vector. ``scored`` has doc_id, bm25, embedding."""
    best = F.nullif(scored.agg(F.max("bm25")).scalar(), F.lit(0.0))
    blend = TEXT_WEIGHT * (F.col("bm25") / best) + VECTOR_WEIGHT * F.col("similarity")
    return (
        with_similarity(scored, wanted)
        .withColumn("hybrid_score", F.round(blend, 4))
        .where(F.col("hybrid_score") > HYBRID_CUT)
        .orderBy(F.desc("hybrid_score"), "doc_id")
        .limit(limit)
    )


def note_search(positions: DataFrame, phrases: list[str]) -> DataFrame:
    """Positions whose note holds one of the phrases."""
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.col("merch_note_text").contains(phrase)
    return positions.where(hit)
