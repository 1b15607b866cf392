"""URL verdicts: rules first, and for the rest naive Bayes on segmented names.

Words and their counts come from the text of all pages. A host's labels, often
words run together, are split by the most likely sequence of words (Viterbi over
unigrams). Pages that a rule decides teach a multinomial naive Bayes model which
tokens of hosts and paths go with which verdict; it decides the others.

All words are counted, whatever their length, and none leaves the executors:
each different name is split once, in a row that holds the counts of the words
that stand in it, and splits are joined back to the pages. The driver holds and
sends 2 * BUCKETS counts alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake import cluster

#: Tokens are counted in so many hashed buckets.
BUCKETS = 1 << 16
#: Words that a task counts before it sends its counts on.
HELD_WORDS = 300_000
SMOOTHING = 1.0
#: Log-odds are added as whole numbers of this part of one, so that sums are the same in any order.
GRAIN = 1e-9

_TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>")
_LETTERS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(text: str, verdict: str) -> Rule:
    """From a host and a path that begins with a slash, as in net/es/."""
    host, slash, rest = text.partition("/")
    return Rule(host, slash + rest, verdict)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): from the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


class Rules:
    """The longest rule that fits a host or a domain above it, and the start of the path; among equals a blocking one."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text)):
            self.by_host.setdefault(r.host, []).append(r)

    def find(self, host: str, path: str) -> Rule | None:
        labels, fits = host.split("."), []
        for k in range(len(labels)):
            fits += [r for r in self.by_host.get(".".join(labels[k:]), ()) if path.startswith(r.path)][:1]
        return min(fits, key=lambda r: (-len(r.text), r.verdict != "block", r.text), default=None)


class Segmenter:
    """Splits a name into the words that are likeliest together; letters that no word covers cost as rare words."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.unknown = math.log(total) + 8.0
        self.lengths = sorted({len(w) for w in counts}, reverse=True)

    def split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            at, least = end - 1, best[end - 1] + self.unknown
            for size in self.lengths:
                if size > end:
                    continue
                cost = self.cost.get(name[end - size : end])
                if cost is not None and best[end - size] + cost < least:
                    at, least = end - size, best[end - size] + cost
            best.append(least)
            back.append(at)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return tuple(words[::-1])


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) over the text of all pages, tags, scripts and styles left out, lower-cased."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            for value in batch.column(0):
                held.update(_LETTERS.findall(_TAGS.sub(" ", value.as_py() or "").lower()))
                if len(held) > HELD_WORDS:
                    yield rows()
        yield rows()

    return pages.select(F.col(html).alias("html")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def names(host: str, path: str) -> tuple[list[str], list[str]]:
    """What a host and a path have to split, numbers of the path included."""
    return _TOKENS.findall(host), _TOKENS.findall(path.lower())


def substrings(distinct: DataFrame, lengths: list[int]) -> DataFrame:
    """(name, word): the substrings of names (name) that have the length of some word, once each, where letters stand together."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[str] = []
            found: list[str] = []
            for name in batch.column(0).to_pylist():
                parts = {run[k : k + size] for run in _LETTERS.findall(name) for size in lengths if size <= len(run) for k in range(len(run) - size + 1)}
                own += [name] * len(parts)
                found += parts
                if len(own) > HELD_WORDS:
                    yield pa.RecordBatch.from_pydict({"name": pa.array(own, pa.string()), "word": pa.array(found, pa.string())})
                    own, found = [], []
            yield pa.RecordBatch.from_pydict({"name": pa.array(own, pa.string()), "word": pa.array(found, pa.string())})

    return distinct.mapInArrow(cut, "name string, word string")


def splits(distinct: DataFrame, counted: DataFrame) -> DataFrame:
    """(name, words): each name (name) split by the words and counts of word_counts(); a number, and a name without a word, are one word each or letters."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    lengths = [r["l"] for r in counted.select(F.char_length("word").alias("l")).distinct().collect()]  # at most as many as the longest word has letters
    met = substrings(distinct, sorted(lengths)).join(counted, "word").groupBy("name").agg(F.collect_list("word").alias("own"), F.collect_list("n").alias("counts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [Segmenter(dict(zip(own or (), counts or ())), total).split(name) for name, own, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(c) for c in cut], pa.list_(pa.string()))], names=["name", "words"])

    return distinct.join(met, "name", "left").select("name", "own", "counts").mapInArrow(work, "name string, words array<string>")


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token) % BUCKETS


PARSED = "row long, page_id long, host string, path string, rule string, verdict string"


@dataclass
class Split:
    """pages: PARSED of every page, numbered. tokens: (row, bucket) of each token of a page."""

    pages: DataFrame
    tokens: DataFrame


def split_pages(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html") -> Split:
    """Every page's url taken apart, with the longest rule that fits, and the tokens of its host and path.

    Words of a host's labels and of a path are told apart; a number of a path
    counts as a number. Pages and splits are written to the shared folder, as
    they are read again.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Rules(rules)
        for batch in batches:
            rows = []
            for value in batch.column(2):
                host, path = parts(value.as_py())
                found = own.find(host, path)
                rows.append((host, path, found.text if found else None, found.verdict if found else None))
            cells = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in cells)], names=[c.split()[0] for c in PARSED.split(", ")])

    numbered = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    parsed = cluster.materialize(numbered.mapInArrow(parse, PARSED), "urls")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(row, kind, name) for row, host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()) for kind, own in zip("hp", names(host, path)) for name in own]
            cells = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.string(), pa.string()))], names=["row", "kind", "name"])

    every = parsed.select("row", "host", "path").mapInArrow(named, "row long, kind string, name string")
    # a name that most pages hold is a row of each of them: how often each page has it travels, not each place
    placed = cluster.materialize(every.groupBy("row", "kind", "name").agg(F.count("*").alias("times")), "url-names")
    counted = cluster.materialize(word_counts(pages, html), "words")
    split = cluster.materialize(splits(placed.select("name").distinct(), counted), "splits")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(kind, name, bucket(f"{kind}:{'#' if kind == 'p' and name.isdigit() else w}")) for kind, name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()) for w in ([name] if kind == "p" and name.isdigit() else own)]
            cells = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.string(), pa.int64()))], names=["kind", "name", "bucket"])

    of_name = placed.select("kind", "name").distinct().join(split, "name").select("kind", "name", "words").mapInArrow(hashed, "kind string, name string, bucket long")
    # written, so that Spark knows its size and a name that most pages hold can be split
    listed = cluster.materialize(of_name.groupBy("kind", "name").agg(F.collect_list("bucket").alias("buckets")), "name-buckets")
    tokens = placed.join(listed, ["kind", "name"]).select("row", "times", F.explode("buckets").alias("bucket"))
    return Split(parsed, cluster.materialize(tokens, "url-tokens"))


@dataclass
class Model:
    block: np.ndarray  # log-odds of blocking for a token of each bucket
    prior: float


def train(split: Split) -> Model:
    """Token counts over all pages that a rule decides."""
    told = {r["verdict"]: r["count"] for r in split.pages.filter("verdict is not null").groupBy("verdict").count().collect()}
    counted = split.tokens.join(split.pages.filter("verdict is not null").select("row", "verdict"), "row").groupBy("verdict", "bucket").agg(F.sum("times").alias("n")).collect()  # 2 * BUCKETS rows at most
    seen = np.zeros((2, BUCKETS))
    for r in counted:
        seen[int(r["verdict"] == "block"), r["bucket"]] = r["n"]
    used = max(1, int((seen.sum(axis=0) > 0).sum()))
    likely = np.log((seen + SMOOTHING) / (seen.sum(axis=1, keepdims=True) + SMOOTHING * used))
    return Model(likely[1] - likely[0], math.log((told.get("block", 0) + 1) / (told.get("allow", 0) + 1)))


def judge(split: Split, model: Model) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds) of every row.

    verdict is that of the longest rule that fits, else block if the model's
    log-odds of blocking are above zero, else allow. A null url, or one without
    ://, has an empty host and path. Rows that repeat and null ids stay; other
    columns are left out; an empty table gives no rows. Without pages that rules
    decide, the model allows.
    """
    grains = np.round(model.block / GRAIN).astype(np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grains[batch.column(2).to_numpy()] * batch.column(1).to_numpy())], names=["row", "odds"])

    odds = split.tokens.select("row", "times", "bucket").mapInArrow(weigh, "row long, odds long").groupBy("row").agg(F.sum("odds").alias("odds"))
    total = F.coalesce("odds", F.lit(0)) + F.lit(int(round(model.prior / GRAIN)))
    return split.pages.join(odds, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(total > 0, "block").otherwise("allow")).alias("verdict"), (total * F.lit(GRAIN)).alias("log_odds"))
