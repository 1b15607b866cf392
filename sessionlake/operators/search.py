"""Lexical, vector and hybrid search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from sessionlake.functions import porter, text

# Weights and constants of ranking.
K1, B = 1.2, 0.75
RRF, USER_WEIGHT, OTHER_WEIGHT, SEMANTIC_WEIGHT = 60, 1.0, 0.88, 0.98
RANK_BUCKET, SEMANTIC_MOST, FETCH_TIMES, FETCH_LEAST = 3, 4096, 50, 200
PREFIX_LETTERS, SNIPPET_WORDS, SEMANTIC_PREVIEW = 4, 24, 240
# Words of a query that stand for one idea, and the beginnings that texts of that idea hold.
CONCEPTS = [
    (["billing", "bill", "charge", "charged", "fee", "fees", "money", "payment", "payments", "stripe"], ["billing", "charge", "fee", "money", "payment", "stripe"]),
    (["crash", "crashed", "died"], ["crash", "died"]),
    (["database", "databases", "db"], ["database", "db"]),
    (["bug", "bugs", "fail", "failed", "failing", "failure", "failures", "fix", "fixes", "fixed", "issue", "issues", "error", "errors"], ["bug", "error", "fail", "fix", "issue"]),
    (["label", "labels", "name", "names", "summary", "summaries", "title", "titles"], ["label", "name", "summar", "title"]),
    (["process", "processed", "processing"], ["process"]),
    (["remote", "remotes"], ["remote"]),
    (["replicate", "replicated", "replication", "sync", "synced", "syncing"], ["replic", "sync"]),
    (["tap", "tapped", "tapping"], ["tap"]),
    (["thread", "threads", "conversation", "conversations"], ["conversation", "thread"]),
]
# Phrases for what went wrong, their idea, and the beginnings that make an idea one of labels.
WENT_WRONG = ["did not go through", "didn't go through", "does not go through", "did not process", "didn't process", "does not process", "failed to process"]
WRONG = ["bug", "error", "fail", "fix", "issue", "process"]
OF_LABELS = ["label", "name", "summar", "title"]


def parse(query: str) -> list[dict]:
    """Terms of a query: parts of letters, digits, _ and -; four or more characters match by their beginning."""
    return [{"text": t, "words": re.findall(r"[a-z0-9]+", t.lower()), "prefix": len(t) >= PREFIX_LETTERS and re.fullmatch(r"[A-Za-z0-9]+", t) is not None} for t in re.findall(r"[A-Za-z0-9_-]+", query) if re.search(r"[A-Za-z0-9]", t)]


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Each word's stem; words are stemmed once in a batch."""
    known: dict[str, str] = {}
    return words.map(lambda ws: None if ws is None else [known.get(w) or known.setdefault(w, porter.stem(w)) for w in ws])


def indexed(items: DataFrame, stemmed: bool = True) -> DataFrame:
    """Adds toks, the index tokens of the text, and len, how many."""
    found = text.search_words(F.col("text"))
    toks = items.withColumn("toks", stems(found) if stemmed else found)
    return toks.withColumn("len", F.size("toks"))


def _hits(term: dict, stemmed: bool) -> Column:
    """How often a term stands in toks: by prefix, as a word, or as a phrase of neighbouring words."""
    words = [porter.stem(w) if stemmed else w for w in term["words"]]
    if len(words) == 1:
        if term["prefix"]:
            return F.size(F.filter("toks", lambda t: t.startswith(words[0])))
        return F.size(F.filter("toks", lambda t: t == words[0]))

    def found(toks: Column) -> Column:
        def stands(k: Column) -> Column:
            here = F.get(toks, k) == words[0]
            for n, w in enumerate(words[1:], 1):
                here &= F.get(toks, k + n) == w
            return here

        last = F.size(toks) - len(words)
        return F.when(last >= 0, F.size(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stands))).otherwise(0)

    # bound by a lambda, so that no plan works out toks anew for each position
    return F.element_at(F.transform(F.array("toks"), found), 1)


def matches(index: DataFrame, query: str, any_term: bool = False, stemmed: bool = True) -> DataFrame:
    """All items that match all terms (or any), with their BM25 score.

    Term frequencies are counted where the items are; only one row of corpus
    figures (items, average length, items per term) is sent to every task.
    """
    terms = parse(query)
    if not terms:
        return index.withColumn("score", F.lit(0.0)).limit(0)
    counted = index
    for k, term in enumerate(terms):
        counted = counted.withColumn(f"_tf{k}", _hits(term, stemmed))
    found = [F.col(f"_tf{k}") > 0 for k in range(len(terms))]
    figures = counted.agg(F.count("*").alias("_n"), F.avg("len").alias("_avg"), *[F.count_if(f).alias(f"_df{k}") for k, f in enumerate(found)])
    wanted = found[0]
    for f in found[1:]:
        wanted = (wanted | f) if any_term else (wanted & f)
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5)))
        score += idf * F.col(f"_tf{k}") * (K1 + 1) / (F.col(f"_tf{k}") + K1 * (1 - B + B * F.col("len") / F.col("_avg")))
    return counted.filter(wanted).crossJoin(F.broadcast(figures)).withColumn("score", score).drop("_n", "_avg", *[f"_{x}{k}" for k in range(len(terms)) for x in ("tf", "df")])


def lexical(index: DataFrame, query: str, any_term: bool = False, limit: int = SEMANTIC_MOST, stemmed: bool = True) -> DataFrame:
    """The best matches with score and rank from 1; ties to the lesser item_id. Only these are ranked, so the ranking is of a bounded table."""
    order = [F.desc("score"), F.col("item_id")]
    top = matches(index, query, any_term, stemmed).orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def snippet(content: Column, query: str, words: int = SNIPPET_WORDS) -> Column:
    """So many words around the first that begins like a term, dots where text is left out."""
    split = F.split(text.one_spaced(content), " ")
    starts = [t["words"][0] for t in parse(query)]
    hit = lambda w: F.exists(F.array(*map(F.lit, starts)), lambda s: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+", "")).startswith(s))
    at = F.coalesce(F.array_position(F.transform(split, hit), True), F.lit(1))
    first = F.greatest(F.lit(1), F.least(at - 4, F.size(split) - words + 1)).cast("int")
    cut = F.array_join(F.slice(split, first, F.lit(words)), " ")
    return F.concat(F.when(first > 1, "...").otherwise(""), cut, F.when(first + words - 1 < F.size(split), "...").otherwise(""))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int, vec_id: str = "vec_id", vector: str = "embedding", keep: Column | None = None, filter_first: bool = False) -> DataFrame:
    """The k nearest by Euclidean distance, rank from 1. keep applies to those k, so fewer may be left; filter_first applies it before."""
    k = min(k, SEMANTIC_MOST)
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(F.size(vector) == len(query))
    if keep is not None and filter_first:
        rows = rows.filter(keep)
    top = rows.withColumn("distance", F.sqrt(squared_distance(F.col(vector), q))).orderBy("distance", vec_id).limit(k)
    if keep is not None and not filter_first:
        top = top.filter(keep)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", vec_id)))


def semantic_text(content: Column) -> Column:
    """Long enough to mean something: 80 characters and 8 words with a letter or digit."""
    return (F.char_length(F.trim(content)) >= 80) & (F.size(F.filter(F.split(content, r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))) >= 8)


def concepts(query: str) -> list[list[str]]:
    """The ideas of a query, each as the beginnings that texts of it hold, in the order of the query."""
    lower, found = query.lower(), []
    of_word = {word: variants for words_, variants in CONCEPTS for word in words_}
    ideas = [of_word[w] for w in re.findall(r"[a-z0-9]+", lower) if w in of_word] + [WRONG] * any(p in lower for p in WENT_WRONG)
    for idea in ideas:
        if idea not in found:
            found.append(idea)
    return found


def expanded(query: str) -> str:
    """The query and its ideas' words, each once, as text to embed."""
    return " ".join([query, *dict.fromkeys(w for idea in concepts(query) for w in idea)])


def passes_concepts(content: Column, query: str) -> Column:
    """With fewer than two ideas all pass; with one of labels one is enough; else two are needed."""
    found = concepts(query)
    if len(found) < 2:
        return F.lit(True)
    lower = F.lower(content)
    met = sum((F.exists(F.array(*map(F.lit, idea)), lambda w: F.contains(lower, w)).cast("int") for idea in found), F.lit(0))
    return met >= (1 if any(w in OF_LABELS for idea in found for w in idea) else 2)


def fuse(lexical_hits: DataFrame, semantic_hits: DataFrame) -> DataFrame:
    """One row per item of either list: key, both ranks, score and match_type. Lists: key, rank, kind, content, occurred_at."""
    sides = ["rank", "kind", "content", "occurred_at"]
    first = lexical_hits.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("rank"))).filter("_r = 1").select("key", *[F.col(c).alias(f"l_{c}") for c in sides])
    both = first.join(semantic_hits.select("key", *[F.col(c).alias(f"s_{c}") for c in sides]), "key", "full")
    weight = F.when(F.col("l_kind") == "user", USER_WEIGHT).otherwise(OTHER_WEIGHT)
    score = F.coalesce(weight / (RRF + F.col("l_rank")), F.lit(0.0)) + F.coalesce(SEMANTIC_WEIGHT / (RRF + F.col("s_rank")), F.lit(0.0))
    kind = F.when(F.col("l_rank").isNotNull() & F.col("s_rank").isNotNull(), "hybrid").when(F.col("l_rank").isNotNull(), "lexical").otherwise("semantic")
    return both.select("key", F.col("l_rank").alias("lexical_rank"), F.col("s_rank").alias("semantic_rank"), *[F.coalesce(f"l_{c}", f"s_{c}").alias(c) for c in sides[1:]], score.alias("score"), kind.alias("match_type"))


def recency(score: Column, occurred_at: Column, as_of: str, bias: float) -> Column:
    """A score raised for what is recent; without a time it stays."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(occurred_at)) / 86400.0)
    return F.when(occurred_at.isNull(), score).otherwise(score * (1 + min(1.0, max(0.0, bias)) / (1 + age / 30)))


def result_order(sort: str = "relevance") -> list[Column]:
    """Relevance: lexical hits first, by threes of their ranks, then score, best rank and key. Newest has null times last, oldest first."""
    if sort == "newest":
        return [F.desc_nulls_last("occurred_at"), F.desc("score"), F.col("key")]
    if sort == "oldest":
        return [F.asc_nulls_first("occurred_at"), F.desc("score"), F.col("key")]
    return [F.col("lexical_rank").isNull(), F.floor((F.col("lexical_rank") - 1) / RANK_BUCKET), F.desc("score"), F.least("lexical_rank", "semantic_rank"), F.col("key")]


def collapse(results: DataFrame, limit: int, sort: str = "relevance") -> DataFrame:
    """Results in order, one per normalised content with the keys of its duplicates; then the limit."""
    ranked = results.withColumn("place", F.row_number().over(Window.orderBy(*result_order(sort)))).withColumn("_c", F.lower(text.one_spaced(F.col("content"))))
    same = Window.partitionBy("_c").orderBy("place")
    groups = ranked.groupBy("_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda s: s["key"]).alias("keys"))
    first = ranked.withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    return first.join(groups, "_c").orderBy("place").limit(limit).select(*results.columns, "place", F.expr("slice(keys, 2, size(keys))").alias("duplicates"))


def fetch_size(limit: int) -> int:
    return max(limit * FETCH_TIMES, FETCH_LEAST)


def hybrid(items: DataFrame, vectors: DataFrame | None, query: str, vector: list[float] | None, limit: int = 25, sort: str = "relevance", recency_bias: float = 0.0, as_of: str | None = None, stemmed: bool = True, index=None) -> tuple[DataFrame, str | None]:
    """(results, why vectors were left out or None): both searches, fused, biased, sorted, collapsed, cut, in this order.

    items: item_id, text, kind, occurred_at. vectors: item_id, embedding. index:
    a postings.Index of the items; without one, which is for small tables, the
    items are indexed() and scanned. Only fetch_size() hits of each search, whose
    number does not grow with the items, meet their texts.
    """
    size = fetch_size(limit)
    ranked = index.lexical(query, limit=size) if index is not None else lexical(indexed(items, stemmed), query, limit=size, stemmed=stemmed)
    hits = items.join(F.broadcast(ranked.select("item_id", "rank")), "item_id").select(F.col("item_id").alias("key"), "rank", "kind", snippet(F.col("text"), query).alias("content"), "occurred_at")
    reason = None
    if vectors is None or vector is None:
        reason = "no embedder"
    elif not vectors.filter(F.size("embedding") == len(vector)).limit(1).count():
        reason = "no vectors of these dimensions"
    if reason:
        near = hits.limit(0)
    else:
        rows = nearest(vectors, vector, min(size, SEMANTIC_MOST), vec_id="item_id").select("item_id", "distance")
        near = items.join(F.broadcast(rows), "item_id").filter(semantic_text(F.col("text")) & passes_concepts(F.col("text"), query)).withColumn("rank", F.row_number().over(Window.orderBy("distance", "item_id"))).select(F.col("item_id").alias("key"), "rank", "kind", text.preview(F.col("text"), SEMANTIC_PREVIEW).alias("content"), "occurred_at")
    fused = fuse(hits, near)
    if as_of and recency_bias:
        fused = fused.withColumn("score", recency(F.col("score"), F.col("occurred_at"), as_of, recency_bias))
    return collapse(fused, limit, sort), reason


def hash_embedding(content: Column, dims: int = 256) -> Column:
    """Signed feature hashing of a text's words, of length one; it means nothing and is there for tests."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def summed(features: pd.Series) -> pd.Series:
        def one(hashes: np.ndarray) -> list[float] | None:
            if hashes is None:
                return None
            h = np.asarray(hashes, np.int64)
            v = np.bincount(h % dims, np.where(h < 0, -1.0, 1.0), dims)
            norm = np.linalg.norm(v)
            return (v / norm if norm else v).tolist()

        return features.map(one)

    return summed(F.transform(text.search_words(content), lambda w: F.xxhash64(w)))


def hash_vector(content: str, dims: int = 256) -> list[float]:
    """hash_embedding() of one text, on the driver."""
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in re.findall(r"[^\W_]+", content.lower())], np.uint64).view(np.int64)
    v = np.bincount(hashes % dims, np.where(hashes < 0, -1.0, 1.0), dims)
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).tolist()


def missing_embeddings(items: DataFrame, embeddings: DataFrame, model_id: str) -> DataFrame:
    """Items that may be embedded and have no vector of the model for their present text."""
    have = embeddings.filter(F.col("model_id") == model_id).select(F.col("unit_id").alias("item_id"), "text_hash")
    return items.filter((F.char_length(F.trim("text")) >= 80) & (F.col("semantic_policy") != "never")).join(have, ["item_id", "text_hash"], "left_anti")


class Batch:
    """How many texts go to an embedder at once: halved while memory is low, doubled again after a run of calm batches, and none when it is critical at the least size.

    Free memory is in MiB; None is unknown and calm.
    """

    # Batch sizes, free memory, and calm batches before a step up.
    LEAST, MOST, CRITICAL, LOW, CALM = 1, 64, 768, 1536, 6

    def __init__(self) -> None:
        self.size, self.calm, self.reductions = self.MOST, 0, 0

    def next(self, free: int | None) -> int:
        """The size of the next batch; 0 defers the work."""
        if free is not None and free < self.CRITICAL and self.size == self.LEAST:
            return 0
        if free is not None and free < self.LOW:
            if self.size > self.LEAST:
                self.size, self.reductions = max(self.LEAST, self.size // 2), self.reductions + 1
            self.calm = 0
        else:
            self.calm += 1
            if self.calm >= self.CALM and self.size < self.MOST:
                self.size, self.calm = min(self.MOST, self.size * 2), 0
        return self.size


def free_memory() -> int | None:
    """Free memory of this machine in MiB, or None where it is not told."""
    try:
        with open("/proc/meminfo") as lines:
            return next((int(line.split()[1]) // 1024 for line in lines if line.startswith("MemAvailable")), None)
    except OSError:
        return None


EMBEDDED = "unit_id string, text_hash string, model_id string, dims int, vector array<float>"


def embed(items: DataFrame, embedder, model_id: str, dims: int, most_chars: int = 8192, memory=free_memory) -> DataFrame:
    """EMBEDDED of items by a function from a list of texts to a list of vectors, called on the executors in batches that follow their free memory.

    Texts that memory leaves no room for are left out; missing_embeddings() has
    them again the next time. A vector of other dimensions stops the task.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = Batch()
        for frame in frames:
            at = 0
            while at < len(frame) and (size := batch.next(memory())):
                part = frame.iloc[at : at + size]
                vectors = [list(map(float, v)) for v in embedder([(t or "")[:most_chars] for t in part["text"]])]
                if len(vectors) != len(part) or any(len(v) != dims for v in vectors):
                    raise ValueError(f"an embedder of {dims} dimensions gave others")
                yield pd.DataFrame({"unit_id": part["unit_id"].to_numpy(), "text_hash": part["text_hash"].to_numpy(), "model_id": model_id, "dims": dims, "vector": vectors})
                at += size

    return items.select(F.col("item_id").alias("unit_id"), "text_hash", "text").mapInPandas(work, EMBEDDED)


def projected_vectors(embeddings: DataFrame, items: DataFrame, model_id: str, dims: int) -> DataFrame:
    """(item_id, text_hash, embedding): what a vector search looks through, the vectors of the model and dimensions that belong to an item's present text and may be searched for."""
    own = embeddings.filter((F.col("model_id") == model_id) & (F.col("dims") == dims) & (F.size("vector") == dims)).select(F.col("unit_id").alias("item_id"), "text_hash", F.col("vector").alias("embedding")).dropDuplicates(["item_id", "text_hash"])
    return own.join(items.filter("semantic_policy <> 'never'").select("item_id", "text_hash"), ["item_id", "text_hash"], "left_semi")


def refreshed_vectors(held: DataFrame, embeddings: DataFrame, items: DataFrame, model_id: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """(vectors to add, item_id of vectors to take away) that bring a projection up to its items: texts that changed or went, and vectors that came."""
    key = ["item_id", "text_hash"]
    wanted = items.filter("semantic_policy <> 'never'").select(*key)
    return projected_vectors(embeddings, items, model_id, dims).join(held.select(*key), key, "left_anti"), held.select(*key).join(wanted, key, "left_anti").select("item_id")
