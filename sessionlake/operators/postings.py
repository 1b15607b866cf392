"""An inverted index for lexical search: postings by term, written in folders by the first letters of terms, and appended to.

A query reads the folders of its own terms, and in them the row groups whose
terms it asks for; the texts of items are never read. A posting holds the length
of its item, so a score needs no join.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.functions import porter, text
from sessionlake.operators import search

#: Terms are dealt to folders by so many first letters, hashed; a folder's terms to files by their items, so that no term is one task's.
HEAD_LETTERS, FOLDERS, FILES = 2, 64, 4

PLACED = "array<struct<term string, places array<int>>>"


def _placed(stemmed: bool):
    @F.pandas_udf(PLACED)
    def placed(words: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(own) -> list[dict] | None:
            if own is None:
                return None
            places: dict[str, list[int]] = {}
            for k, word in enumerate(own):
                term = (known.get(word) or known.setdefault(word, porter.stem(word))) if stemmed else word
                places.setdefault(term, []).append(k)
            return [{"term": term, "places": at} for term, at in places.items()]

        return words.map(one)

    return placed


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, HEAD_LETTERS)), F.lit(FOLDERS)).cast("int")


def postings(items: DataFrame, stemmed: bool = True) -> DataFrame:
    """(item_id, len, term, tf, places): one row per term of an item (item_id, text), with the places of its words. A null text has no terms."""
    words = text.search_words(F.coalesce("text", F.lit("")))
    spread = items.select("item_id", F.size(words).alias("len"), F.explode(_placed(stemmed)(words)).alias("p"))
    return spread.select("item_id", "len", "p.term", F.size("p.places").alias("tf"), "p.places")


def _phrases(places: str, many: int) -> Column:
    """How often the words whose places are in the struct's fields w0, w1, ... follow each other."""

    def stands(p: Column) -> Column:
        here = F.lit(True)
        for n in range(1, many):
            here &= F.coalesce(F.array_contains(F.col(f"{places}.w{n}"), p + n), F.lit(False))
        return here

    return F.when(F.col(f"{places}.w0").isNull(), 0).otherwise(F.size(F.filter(F.col(f"{places}.w0"), stands)))


class Index:
    """The written index of a folder. Items are added in batches, each once; a batch counts when its figures are written, last."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = True):
        self.spark, self.path, self.stemmed = spark, path.rstrip("/"), stemmed

    def _batches(self) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/figures")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(hadoop) if fs.exists(f.getPath().suffix("/_SUCCESS"))) if fs.exists(hadoop) else []

    def _read(self, name: str) -> DataFrame | None:
        found = [f"{self.path}/{name}/{b}" for b in self._batches()]
        return self.spark.read.parquet(*found) if found else None

    def append(self, items: DataFrame) -> int:
        """Adds the items (item_id, text) that the index does not have; how many these are. Of repeated ids one counts."""
        own = items.select("item_id", "text").dropDuplicates(["item_id"])
        held = self._read("units")
        if held is not None:
            own = own.join(held.select("item_id"), "item_id", "left_anti")
        batch = uuid.uuid4().hex
        rows = own.select("item_id", "text", F.size(text.search_words(F.coalesce("text", F.lit("")))).alias("len"))
        rows.select("item_id", "len").write.parquet(f"{self.path}/units/{batch}")
        dealt = postings(own, self.stemmed).withColumn("folder", _folder(F.col("term")))
        dealt.repartition("folder", F.pmod(F.xxhash64("item_id"), F.lit(FILES))).sortWithinPartitions("folder", "term", "item_id").write.partitionBy("folder").parquet(f"{self.path}/postings/{batch}")
        figures = self.spark.read.parquet(f"{self.path}/units/{batch}").agg(F.count("*").alias("items"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
        figures.coalesce(1).write.parquet(f"{self.path}/figures/{batch}")
        return self.spark.read.parquet(f"{self.path}/figures/{batch}").first()["items"]

    def units(self) -> DataFrame:
        """(item_id, len) of all items."""
        held = self._read("units")
        return held if held is not None else self.spark.createDataFrame([], "item_id string, len int")

    def _postings(self) -> DataFrame:
        batches = self._batches()
        schema = "item_id string, len int, term string, tf int, places array<int>, folder int"
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/postings/{b}") for b in batches]
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def found(self, query: str) -> tuple[DataFrame | None, int]:
        """((item_id, len, tf0, tf1, ...) of the items with any term of a query, number of terms); a term's count is that of its beginning, its word or its phrase."""
        terms = search.parse(query)
        if not terms:
            return None, 0
        wanted, heads, columns = F.lit(False), set(), []
        for k, term in enumerate(terms):
            words = [porter.stem(w) if self.stemmed else w for w in term["words"]]
            if len(words) == 1:
                here = F.col("term").startswith(words[0]) if term["prefix"] else F.col("term") == words[0]
                heads.add(words[0] if not term["prefix"] or len(words[0]) >= HEAD_LETTERS else None)
                wanted |= here
                columns.append(F.coalesce(F.sum(F.when(here, F.col("tf"))), F.lit(0)).alias(f"tf{k}"))
            else:
                for w in words:
                    wanted |= F.col("term") == w
                    heads.add(w)
                columns.append(F.struct(*[F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"w{n}") for n, w in enumerate(words)]).alias(f"tf{k}"))
        rows = self._postings().filter(wanted)
        if None not in heads:
            folders = [r[0] for r in self.spark.createDataFrame([(h,) for h in sorted(heads)], "h string").select(_folder(F.col("h"))).distinct().collect()]  # a few numbers
            rows = rows.filter(F.col("folder").isin(folders))
        by = rows.groupBy("item_id").agg(F.max("len").alias("len"), *columns)
        for k, term in enumerate(terms):
            many = len(term["words"])
            if many > 1:
                by = by.withColumn(f"tf{k}", _phrases(f"tf{k}", many))
        return by, len(terms)

    def matches(self, query: str, any_term: bool = False) -> DataFrame:
        """(item_id, score) of all items that match all terms of a query (or any), by BM25."""
        by, n = self.found(query)
        if by is None:
            return self.spark.createDataFrame([], "item_id string, score double")
        hit = [F.col(f"tf{k}") > 0 for k in range(n)]
        wanted = hit[0]
        for h in hit[1:]:
            wanted = (wanted | h) if any_term else (wanted & h)
        held = self._read("figures")
        if held is None:
            return self.spark.createDataFrame([], "item_id string, score double")
        corpus = held.agg(F.sum("items").alias("_n"), (F.sum("words") / F.sum("items")).alias("_avg"))
        spread = by.agg(*[F.count_if(h).alias(f"_df{k}") for k, h in enumerate(hit)])
        score = F.lit(0.0)
        for k in range(n):
            idf = F.greatest(F.lit(1e-6), F.log((F.col("_n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5)))
            score += idf * F.col(f"tf{k}") * (search.K1 + 1) / (F.col(f"tf{k}") + search.K1 * (1 - search.B + search.B * F.col("len") / F.col("_avg")))
        # one row of figures on the side of the broadcast
        return by.filter(wanted).crossJoin(F.broadcast(corpus.crossJoin(spread))).select("item_id", score.alias("score"))

    def lexical(self, query: str, any_term: bool = False, limit: int = search.SEMANTIC_MOST) -> DataFrame:
        """(item_id, score, rank) of the best matches, ties to the lesser item_id. Only these are ranked."""
        order = [F.desc("score"), F.col("item_id")]
        top = self.matches(query, any_term).orderBy(*order).limit(limit)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def opened(spark: SparkSession, path: str, items: DataFrame, stemmed: bool = True) -> Index:
    """The index of a folder, with all the items in it."""
    index = Index(spark, path, stemmed)
    index.append(items)
    return index


def lacking(index: Index, items: DataFrame) -> DataFrame:
    """Items that the index does not have: the work of a delta."""
    return items.join(index.units().select("item_id"), "item_id", "left_anti")
