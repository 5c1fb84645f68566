"""Postings: which documents hold a term and how often, as a table that queries read by term.

The table has a row per term and document, sorted by term and block of documents, so that a filter on the
terms of a query reads their row groups and no others. A frequent term spans several files, as the
block is part of the range key. Beside it lies a small table of blocks: per term and block the number
of documents and the most that the term can add to a BM25 score there. Searches use it to start from
the rarest term, and to leave out blocks that cannot hold one of the best documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.search import BM25_B, BM25_K1, tokens
from shelfwise.sources.scratch import stage

BLOCK_DOCS = 1024
SEED_BLOCKS = 4
FEW_KEYS = 1_000_000


@dataclass(frozen=True)
class Index:
    """The written tables: postings (term, block, doc, tf, length, part), blocks (term, block, docs,
    top), and corpus, one row of n and average length."""

    postings: DataFrame
    blocks: DataFrame
    corpus: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession


def counted(words: str) -> Column:
    """Each term of a sorted array of words, with how often it occurs: the lengths of the runs."""
    word = lambda i: F.get(words, i)
    new = lambda i: (i == 0) | (word(i) != word(i - 1))
    starts = F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), new)).otherwise(F.array().cast("array<int>"))
    ends = F.concat(F.slice(starts, 2, F.size(words)), F.array(F.size(words)))
    runs = F.zip_with(starts, ends, lambda i, end: F.struct(word(i).alias("term"), (end - i).cast("int").alias("tf")))
    return F.filter(runs, lambda run: run["term"].isNotNull())  # without a word there is an end, but no run


def build(docs: DataFrame, key: str, text: Column, path: str, block_docs: int = BLOCK_DOCS, files: int | None = None) -> Index:
    """Index the documents and write it below a path, in so many files or as Spark sizes them. Keys are
    unique; rows that repeat a key and a length count as one document in the postings. Documents without a word have
    no postings but count in the corpus; a NULL text has no words. ``part`` is a posting's share of BM25, to be
    multiplied by the term's weight."""
    spark = docs.sparkSession
    sorted_words = docs.select(F.col(key).alias("doc"), F.sort_array(tokens(text)).alias("_words"))
    # a document's terms are counted in its row: the one shuffle to come moves a row per document and term
    worded = sorted_words.select("doc", F.size("_words").cast("double").alias("length"), counted("_words").alias("terms"))
    worded = stage(worded, "words")
    corpus = worded.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    corpus = spark.read.parquet(f"{path}/corpus")
    count, average = corpus.select("n").scalar(), corpus.select("avg_length").scalar()
    each = worded.select("doc", "length", F.inline("terms"))
    if not worded.groupBy("doc", "length").count().where(F.col("count") > 1).isEmpty():
        each = each.groupBy("doc", "length", "term").agg(F.sum("tf").cast("int").alias("tf"))
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / average)
    dealt = F.pmod(F.xxhash64("doc"), F.greatest(F.lit(1), F.ceil(count / block_docs)))
    made = each.select("term", dealt.cast("int").alias("block"), "doc", "tf", "length")
    part = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)
    order = ["term", "block"]
    spread = [files, *order] if files else order
    made.repartitionByRange(*spread).withColumn("part", part).sortWithinPartitions(*order, "doc").write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    summed = postings.groupBy(*order).agg(F.count(F.lit(1)).alias("docs"), F.max("part").alias("top"))
    summed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/blocks")
    return Index(postings, spark.read.parquet(f"{path}/blocks"), corpus)


def of_terms(table: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of these terms: a filter that the scan answers from its statistics."""
    return table.where(F.col("term").isin(terms))


def weights(index: Index, terms: list[str]) -> DataFrame:
    """term, weight: the inverse document frequency from the counts of the blocks. One row a term."""
    df = of_terms(index.blocks, terms).groupBy("term").agg(F.sum("docs").cast("double").alias("df"))
    n = index.corpus.select("n").scalar()
    return df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))


def bm25(index: Index, terms: list[str], blocks: DataFrame | None = None) -> DataFrame:
    """doc, bm25 of every document that holds one of the terms, or of those in some blocks."""
    found = of_terms(index.postings, terms)
    if blocks is not None:
        found = found.join(F.broadcast(blocks), "block", "left_semi")
    weighted = found.join(F.broadcast(weights(index, terms)), "term")  # a row for each term of the query
    return weighted.groupBy("doc").agg(F.sum(F.col("weight") * F.col("part")).alias("bm25"))


def bm25_topk(index: Index, terms: list[str], k: int) -> DataFrame:
    """The k best documents (ties by doc). A few of the most promising blocks are scored first; their
    k-th score is a bound, and of the other blocks only those are read that can reach it."""
    best = of_terms(index.blocks, terms).join(F.broadcast(weights(index, terms)), "term")
    bounds = best.groupBy("block").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), F.max("docs").alias("docs"))
    bounds = stage(bounds, "bounds")
    first = bounds.orderBy(F.desc("bound"), "block").limit(SEED_BLOCKS).select("block")
    first = stage(first, "first-blocks")
    scored = stage(bm25(index, terms, first).orderBy(F.desc("bm25"), "doc").limit(k), "first-scores")
    # with fewer than k documents so far, every block may hold one of the best
    bound = scored.agg(F.when(F.count(F.lit(1)) >= k, F.min("bm25"))).scalar()
    can = (F.col("bound") * (1 + 1e-9) >= bound) | bound.isNull()
    rest = bounds.where(can).select("block").join(F.broadcast(first), "block", "left_anti")
    return scored.unionByName(bm25(index, terms, rest)).orderBy(F.desc("bm25"), "doc").limit(k)


def every_term(index: Index, terms: list[str]) -> DataFrame:
    """doc, hits, length of the documents that hold all terms. The blocks tell the rarest term and
    the blocks that hold all of them; the other terms' postings meet only the documents of the
    rarest."""
    held = of_terms(index.blocks, terms)
    counts = held.groupBy("term").agg(F.sum("docs").alias("n")).orderBy("n", "term").collect()  # a row a term
    if len(counts) < len(set(terms)):
        return of_terms(index.postings, terms[:1]).limit(0).select("doc", F.col("tf").cast("long").alias("hits"), "length")
    rarest, few = counts[0].term, counts[0].n
    shared = held.groupBy("block").agg(F.count(F.lit(1)).alias("terms")).where(F.col("terms") == len(counts)).select("block")
    start = of_terms(index.postings, [rarest]).join(shared, "block", "left_semi")
    if len(counts) == 1:
        return start.select("doc", F.col("tf").cast("long").alias("hits"), "length")
    keys = start.select("block", "doc")
    rest = of_terms(index.postings, [r.term for r in counts[1:]])
    near = rest.join(F.broadcast(keys) if few <= FEW_KEYS else keys, ["block", "doc"], "left_semi")
    columns = ["term", "doc", "tf", "length"]
    return (
        start.select(*columns).unionByName(near.select(*columns))
        .groupBy("doc")
        .agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("hits"), F.first("length").alias("length"))
        .where(F.col("terms") == len(counts))
        .select("doc", "hits", "length")
    )
