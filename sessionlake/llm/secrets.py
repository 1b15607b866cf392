"""Secret scans over an incremental blob ledger.

A text is a blob, named by its SHA-256. The ledger holds one row for each pair
of blob and rule version that has been scanned, with what was found. A scan
names every version of every path, leaves out the pairs that the ledger has,
scans each remaining blob once, and joins the findings back to all paths.

Blobs travel compressed, and a task sends each blob that it meets once, so a
blob that a third of all paths share costs one text per task and thin rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import cluster

# The kinds of the base rules, in the order in which spans with one start are listed.
BASE = ["assign", "access", "hex"]
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
# A key from its first line to the END line of the same label, or without one to the end of the base64 block; line ends may be escaped.
_KEY_LINES = r"(?:(?:\s|\\[rn])*(?:Proc-Type|DEK-Info):[^\n\\]*)*(?:(?:\s|\\[rn])*[A-Za-z0-9+/]{16,}={0,2})+(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/]{1,15}={0,2}(?=\s*\n|\\|[\"']|\s*\Z))?"
PRIVATE_KEY = rf"-----BEGIN ([A-Z ]{{0,40}})PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----|{_KEY_LINES})?"
#: Kinds that are found besides: a string that any match holds, and the pattern.
MORE = {
    "private_key": ("PRIVATE KEY-----", PRIVATE_KEY),
    "github": ("gh", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    "jwt": ("eyJ", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
KINDS = [*BASE, *MORE]
LEAST = {"assign": 8, "access": 16}

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.ASCII | re.IGNORECASE), re.compile(ACCESS), re.compile(HEX)
_MORE = {kind: (sign, re.compile(pattern)) for kind, (sign, pattern) in MORE.items()}
_SIGNS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Names the rules: other rules are another version, and every blob is scanned anew for them.
RULE_VERSION = hashlib.sha256(repr((ASSIGN, ACCESS, HEX, MORE, LEAST)).encode()).hexdigest()[:16]

SPANS = "array<struct<kind string, start long, end long>>"
LEDGER = f"blob binary, rule_version string, spans {SPANS}"

#: Digests that a task remembers as sent; beyond them it forgets, and a blob may be sent again.
REMEMBERED = 500_000


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all matches, ordered, in code points."""
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    lower = text.lower()
    if any(sign in lower for sign in _SIGNS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    for kind, (sign, pattern) in _MORE.items():
        if sign in text:
            found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, packed) of each text that this task meets for the first time."""
    sent: set[bytes] = set()
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        blobs, packed = [], []
        for value in batch.column(0).cast(pa.binary()):
            data = value.as_py() or b""
            blob = hashlib.sha256(data).digest()
            if blob not in sent:
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(blob)
                blobs.append(blob)
                packed.append(squeeze(data))
        yield pa.RecordBatch.from_pydict({"blob": pa.array(blobs, pa.binary()), "packed": pa.array(packed, pa.binary())})


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ledger rows of a partition's blobs; all copies of a blob are in one partition, so the first is scanned."""
    seen: set[bytes] = set()
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        blobs, spans = [], []
        for blob, packed in zip(batch.column(0), batch.column(1)):
            if (name := blob.as_py()) in seen:
                continue
            seen.add(name)
            blobs.append(name)
            spans.append([{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in find(expand(packed.as_py()).decode("utf-8", "replace"))])
        yield pa.RecordBatch.from_pydict({"blob": pa.array(blobs, pa.binary()), "rule_version": [RULE_VERSION] * len(blobs), "spans": pa.array(spans, _SPAN_TYPE)}, schema=pa.schema([("blob", pa.binary()), ("rule_version", pa.string()), ("spans", _SPAN_TYPE)]))


def blob_name(text: Column) -> Column:
    """A text's content address; a null text is the empty one."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


@dataclass
class Scan:
    """paths: (path columns, spans) of every row. added: the ledger's new rows. ledger: all rows of this rule version."""

    paths: DataFrame
    added: DataFrame
    ledger: DataFrame


def scan(docs: DataFrame, path: list[str], text: str = "text", ledger: DataFrame | None = None) -> Scan:
    """Find secrets in every row's whole text, scanning only blobs that the ledger does not have for these rules.

    path: the columns that name a row in the result, such as a document's id or
    a file's name and commit; they may be null and may repeat, and each row
    stays. A null text is empty. Other columns are left out. spans is never
    null: an array of (kind, start, end), ordered, in code points, end
    exclusive. An empty table gives no rows. The new ledger rows are written to
    the shared folder; append them to the ledger to make the next scan
    incremental.

    With a ledger, texts are first named and the names that it lacks are found;
    only the texts of those are read, sent and scanned. While they are few, the
    join with their names is a broadcast, which Spark chooses by their size, and
    no known text moves.
    """
    own = docs.select(F.col(text).cast("string").alias("text"))
    known = None
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", "spans")
        named = own.withColumn("_own", blob_name(F.col("text")))
        unseen = cluster.materialize(named.select(F.col("_own").alias("blob")).distinct().join(known.select("blob"), "blob", "left_anti"), "unseen-blobs")
        own = named.join(unseen, F.col("_own") == F.col("blob"), "left_semi").select("text")
    blobs = own.mapInArrow(_pack, "blob binary, packed binary")
    added = cluster.materialize(blobs.repartition("blob").mapInArrow(_scan, LEDGER), "secret-ledger")
    whole = added if known is None else known.unionByName(added)
    hits = whole.filter(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    paths = docs.select(*[F.col(c) for c in path], blob_name(F.col(text).cast("string")).alias("_own"))
    joined = paths.join(hits, F.col("_own") == F.col("_blob"), "left").select(*[F.col(c) for c in path], F.coalesce("_spans", F.array().cast(SPANS)).alias("spans"))
    return Scan(joined, added, whole)


def history(versions: DataFrame, path: list[str], commit: str, commits: list[str], text: str = "text", ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(path columns, commit, spans of every version, the ledger after, the new ledger rows of each commit): commits scanned one after the other, in the given order.

    A commit scans the blobs that neither the ledger nor an earlier commit has.
    Versions of commits that are not in the list are left out.
    """
    held = empty_ledger(versions.sparkSession) if ledger is None else ledger
    out, added = None, []
    for name in commits:
        one = scan(versions.filter(F.col(commit) == name), [*path, commit], text, held)
        held = one.ledger
        added.append(one.added)
        out = one.paths if out is None else out.unionByName(one.paths)
    return out, held, added


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def covered(spans: Column) -> Column:
    """Spans as intervals without overlaps, in order."""
    span = "array<struct<start:bigint,end:bigint>>"

    def add(held: Column, s: Column) -> Column:
        last = F.element_at(held, -1)
        joins = (F.size(held) > 0) & (s["start"] <= F.try_element_at(held, F.lit(-1))["end"])
        grown = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(joins, grown).otherwise(F.concat(held, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    return F.aggregate(spans, F.array().cast(span), add)


def redacted(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """A text with each found span, overlapping ones together, replaced by a mark."""
    cover = covered(spans)
    whole = F.array(cover)

    def parts(held: Column) -> Column:
        def piece(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(held, k - 1)["end"].cast("int"))
            end = F.when(k < F.size(held), F.get(held, k)["start"].cast("int")).otherwise(F.char_length(text))
            return F.substring(text, start + 1, end - start)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(held)), piece), mark)

    return F.when(F.size(spans) == 0, text).otherwise(F.element_at(F.transform(whole, parts), 1))
