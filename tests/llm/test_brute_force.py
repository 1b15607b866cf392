"""Queries that SQL cannot express, against plain versions of their contracts."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sessionlake.llm import bpe, chat, neighbours, packing, registry, secrets, similar, simhash, tiff, toxicity, urls

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tiktoken_multi(ranks_path):
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def run(spark, name, sf_dir=SF):
    return registry.QUERIES[name](spark, sf_dir).collect()


# op1


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_op1(spark, texts):
    for r in run(spark, "op1_secret_scan"):
        want = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{secrets.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*(sum(k == n for _, k, _ in want) for n in range(3)), hashlib.sha256(listed.encode()).hexdigest())
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "apiKey", "'", '"', " ", ":", "=", "abcdef", "12345678", "AKIA", "ABCDEFGHIJKL", "0" * 20, "deadbeef", "é", "\n"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_secret_rules(parts):
    text = "".join(parts)
    assert [s for s in secrets.find(text) if s[1] < 3] == plain_spans(text)


def test_ledger_scans_only_unseen_blobs(spark):
    first = spark.createDataFrame([("v1/a", "token=abcdefgh1"), ("v1/b", "nothing")], "path string, text string")
    scan = secrets.scan(first, ["path"])
    again = secrets.scan(first.union(spark.createDataFrame([("v2/a", "token=abcdefgh1"), ("v2/b", "secret: 12345678")], first.schema)), ["path"], ledger=scan.ledger)
    assert scan.added.count() == 2 and again.added.count() == 1
    assert {r.path: len(r.spans) for r in again.paths.collect()} == {"v1/a": 1, "v1/b": 0, "v2/a": 1, "v2/b": 1}
    stale = scan.ledger.withColumn("rule_version", F.lit("older"))
    assert secrets.scan(first, ["path"], ledger=stale).added.count() == 2


def test_commits_scan_what_earlier_ones_lack(spark):
    rows = [("a", "c1", "token=abcdefgh1"), ("b", "c1", "plain"), ("a", "c2", "token=abcdefgh1"), ("b", "c2", "secret: 12345678"), (None, "c2", None), ("a", "c3", "plain"), ("z", "c4", "left out")]
    versions = spark.createDataFrame(rows, "path string, revision string, text string")
    found, ledger, added = secrets.history(versions, ["path"], "revision", ["c1", "c2", "c3"])
    assert [a.count() for a in added] == [2, 2, 0] and ledger.count() == 4
    assert {(r.path, r.revision): len(r.spans) for r in found.collect()} == {("a", "c1"): 1, ("b", "c1"): 0, ("a", "c2"): 1, ("b", "c2"): 1, (None, "c2"): 0, ("a", "c3"): 0}
    again = secrets.history(versions, ["path"], "revision", ["c2"], ledger=ledger)[2]
    assert again[0].count() == 0


def test_redaction_joins_overlaps(spark):
    text = "x token=deadbeefdeadbeefdeadbeefdeadbeef y AKIAABCDEFGHIJKL"
    df = spark.createDataFrame([(text,), ("clean",)], "text string")
    out = secrets.scan(df, ["text"]).paths.select(secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert sorted(r.t for r in out) == ["clean", "x <SECRET> y <SECRET>"]


# op2


def test_op2(spark, texts, tiktoken_multi):
    for r in run(spark, "op2_byte_bpe"):
        ids = tiktoken_multi.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab's  \n\t19!?'té.中٣𝟗ſ\x1c\x85​'revelltmd")), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=600, deadline=None)
def test_bpe_equals_the_library(text):
    vocab = bpe.vocabulary("ranks", path("byte_bpe_multi_50k.tiktoken"))
    reference = _library(path("byte_bpe_multi_50k.tiktoken"))
    ids = vocab.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert vocab.decode(ids) == text.encode() and vocab.offsets(ids)[-1] == len(text.encode())


_LIBRARY = {}


def _library(file):
    if file not in _LIBRARY:
        with open(file, "rb") as lines:
            _LIBRARY[file] = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    return _LIBRARY[file]


@given(st.lists(st.text(alphabet="a b'srel\n\t1!é　", max_size=80), max_size=5))
@settings(max_examples=300, deadline=None)
def test_pieces_equal_the_pattern(texts_):
    joined, starts, first = bpe.boundaries(texts_)
    pieces = [joined[a:b] for a, b in zip(starts, starts[1:])]
    assert [pieces[a:b] for a, b in zip(first, first[1:])] == [regex.findall(PATTERN, t) for t in texts_]


def test_long_pieces_and_merge_files():
    vocab, library = bpe.vocabulary("ranks", path("byte_bpe_multi_50k.tiktoken")), _library(path("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(3)
    for text in ["a" * 5000, "".join(rng.choices("abcdé", k=4000)), " " * 3000, "\n" * 999 + "x", "ab" * 24, "ab" * 25]:
        assert np.frombuffer(vocab.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
    own, tokenizer = bpe.vocabulary("merges", path("byte_bpe_50k.json")), Tokenizer.from_file(path("byte_bpe_50k.json"))
    for text in ["Hello there, it's 2024!", "für  die\n\nWelt", "", "x" * 300]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# op3


def test_op3(spark, texts):
    codecs = set()
    for r in run(spark, "op3_tiff_pages"):
        data = texts[r.doc_id].encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media, size = tiff.store(data)
        samples = np.frombuffer(payload, np.uint8)
        assert (r.media_bytes, r.media_sha256, size) == (len(media), hashlib.sha256(media).hexdigest(), len(payload))
        assert np.allclose(list(map(float, r.feature.split(","))), [samples.mean(), samples.std(), (samples > 127).mean()], atol=2e-6)
        assert r.n_pages == len(list(tiff.pages(media))) == -(-len(payload) // (tiff.ROW * tiff.PAGE_ROWS))
        codecs.add(r.codec)
    assert codecs == {f"{c}/{p}/{kind}" for c in tiff.STORED for p in (1, 2) for kind in ("strips", "tiles")}


def test_kept_columns_are_on_each_page(spark):
    image = np.arange(12, dtype=np.uint8).reshape(3, 4, 1)
    df = spark.createDataFrame([(1, bytearray(tiff.write([image, image[:2]])), "a", None), (2, None, "b", [1, 2])], "file_id long, data binary, label string, list array<int>")
    rows = tiff.read_pages(df, keep=["label", "list"]).collect()
    assert [(r.file_id, r.page, r.label, r.list) for r in rows] == [(1, 0, "a", None), (1, 1, "a", None), (2, None, "b", [1, 2])]


@pytest.mark.parametrize("compression", sorted(tiff.UNPACK))
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trips(compression, order):
    rng = np.random.default_rng(0)
    for predictor, block, samples in itertools.product((1, 2), (1, 7, 64, (16, 16), (32, 16)), (1, 3)):
        images = [rng.integers(0, 4 if k else 256, (h, w, samples), dtype=np.uint8) for k, (h, w) in enumerate([(5, 7), (33, 20), (64, 48)])]
        read = list(tiff.pages(tiff.write(images, compression, predictor, block, order)))
        assert [p.pixels for p in read] == [i.tobytes() for i in images] and [p.index for p in read] == [0, 1, 2]


@given(st.binary(max_size=3000))
@settings(max_examples=150, deadline=None)
def test_unpacking_inverts_packing(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data and tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_lzw_beyond_a_full_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data


def test_page_rows_and_broken_files(spark):
    image = np.arange(12, dtype=np.uint8).reshape(3, 4, 1)
    good = tiff.write([image, image[:2]])
    loop = bytearray(tiff.write([image]))
    loop[-4:] = loop[4:8]  # the chain of directories leads back to its beginning
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"GIF89a..")), (3, None), (4, bytearray(good[:-40])), (5, loop)], "file_id long, data binary")
    rows = tiff.read_pages(df).collect()
    assert [(r.page, r.height) for r in rows if r.file_id == 1] == [(0, 3), (1, 2)] and [r.page for r in rows if r.file_id == 5] == [0]
    assert all(r.error for r in rows if r.file_id in (2, 3)) and any(r.error for r in rows if r.file_id == 4)


# op5


def test_op5(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    rows = run(spark, "op5_url_filter")
    assert len(rows) == len(pages)
    for r in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r.page_id])
        host, where = m[1].lower(), m[2]
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and where.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=None)
        assert (r.host, r.path, r.rule) == (host, where, best and best[0]) and r.verdict == (best[1] if best else r.verdict) and r.verdict in ("allow", "block")
    assert {r.verdict for r in rows if r.rule is None} == {"allow", "block"}


def test_op5_verdicts_by_a_plain_model(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    counts = Counter(w for p in pages for w in re.findall(r"[^\W\d_]+", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", p.html or "").lower()))
    segmenter = urls.Segmenter(counts)
    rows = {r.page_id: r for r in run(spark, "op5_url_filter")}

    def tokens(r):
        own = [f"h:{w}" for label in re.findall(r"[^\W_]+", r.host) for w in segmenter.split(label)]
        return own + [f"p:{'#' if t.isdigit() else w}" for t in re.findall(r"[^\W_]+", r.path.lower()) for w in ([t] if t.isdigit() else segmenter.split(t))]

    seen, told = {"allow": Counter(), "block": Counter()}, Counter()
    for r in rows.values():
        if r.rule is not None:
            told[r.verdict] += 1
            seen[r.verdict].update(xxhash.xxh64_intdigest(t) % urls.BUCKETS for t in tokens(r))
    used = len(set(seen["allow"]) | set(seen["block"]))
    weight = lambda verdict, b: np.log((seen[verdict][b] + 1) / (sum(seen[verdict].values()) + used))
    for r in rows.values():
        own = [xxhash.xxh64_intdigest(t) % urls.BUCKETS for t in tokens(r)]
        odds = np.log((told["block"] + 1) / (told["allow"] + 1)) + sum(weight("block", b) - weight("allow", b) for b in own)
        assert abs(odds - r.log_odds) < 1e-6 and (r.rule is not None or r.verdict == ("block" if odds > 0 else "allow"))


def test_segmentation_equals_all_splits():
    counts = {"cheap": 50, "pills": 40, "the": 900, "he": 100, "a": 300, "pill": 90, "s": 60}
    segmenter = urls.Segmenter(counts)

    def best(name):
        if not name:
            return 0.0, ()
        options = []
        for k in range(1, len(name) + 1):
            cost = segmenter.cost.get(name[:k], segmenter.unknown if k == 1 else None)
            if cost is not None:
                rest = best(name[k:])
                options.append((cost + rest[0], (name[:k], *rest[1])))
        return min(options)

    for name in ["cheappills", "thecheap", "xhe", "", "aaspills", "theapills"]:
        split = segmenter.split(name)
        assert "".join(split) == name and abs(sum(segmenter.cost.get(w, segmenter.unknown) for w in split) - best(name)[0]) < 1e-9


# op6


def test_op6(spark, texts):
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = run(spark, "op6_nnls_packing")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) / (2048 * len(sequences)) > 0.98


@pytest.mark.parametrize("text", ["a<|endoftext|>b <|endoftext|>", "a" + " " * 3_000 + "b", "\n\t " * 4_000, "x" * 20_000, "ab" * 5_000 + " <|endoftext|>" + "é" * 4_000, " " * 2_500 + "<|endoftext|>" + " " * 2_500 + "a", "　" * 3_000 + "end", "1" * 2_500 + "!" * 2_500])
def test_ids_of_odd_texts_are_the_tokenizers(tokenizer_path, text):
    assert packing.encoder(tokenizer_path)(text).tolist() == Tokenizer.from_file(tokenizer_path).encode(text, add_special_tokens=False).ids


def test_every_token_by_itself_is_the_tokenizers(tokenizer_path):
    tokenizer, own = Tokenizer.from_file(tokenizer_path), packing.encoder(tokenizer_path)
    texts_ = [t for data in bpe.vocabulary("merges", tokenizer_path).tokens.values() if (t := data.decode("utf-8", "ignore"))]
    assert [own(t).tolist() for t in texts_] == [e.ids for e in tokenizer.encode_batch(texts_, add_special_tokens=False)]


def test_very_long_white_space_and_words_are_packed(spark, tokenizer_path):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "a" * 400_000), (3, "x " * 300_000)], "doc_id long, text string")
    rows = packing.pack_documents(docs, tokenizer_path).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3} and all(r.offset + r.length <= 2048 for r in rows)


def test_combinations_and_least_squares():
    want = {tuple(sorted(x)) for k in range(1, 5) for x in itertools.product(range(1, 11), repeat=k) if sum(x) == 10}
    assert {tuple(int(y) for y in x if y) for x in packing.combinations(10, 4)} == want
    rng = np.random.default_rng(2)
    for _ in range(20):
        members = packing.combinations(12, 3)
        target = np.append(0, rng.integers(0, 50, 12)).astype(float)
        x = packing.nnls(members, target)
        columns = np.array([np.bincount(m, minlength=13) for m in members], float).T
        columns[0] = 0
        gradient = columns.T @ (columns @ x - target)
        assert (x >= 0).all() and gradient.min() > -1e-3 and abs(gradient[x > 1e-9]).max(initial=0) < 1e-3  # the conditions of a minimum
    histogram = np.bincount(np.minimum(256, rng.gamma(2, 40, 50_000).astype(int) + 1), minlength=257)
    used = np.zeros(257, int)
    for own, n in packing.plan(histogram):
        assert sum(own) == 256
        for k in own:
            used[k] += n
    assert (used <= histogram).all() and used.sum() > 0.99 * histogram.sum()


# op7


def test_op7_on_held_out_rows(spark):
    rows = run(spark, "op7_toxicity", "/root/testdata/sf0.1")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.95 and sum(s >= 0.5 for s in good) <= 0.01 * len(good)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            following.append(min(row[j] + 1, following[-1] + 1, row[j - 1] + (x != y)))
        row = following
    return row[-1]


def test_automaton_equals_edit_distances():
    terms = [toxicity.Term(t, s, w) for t, s, w in (("idiot", False, 1.0), ("scum", False, 0.9), ("disgusting", False, 0.8), ("trash", False, 0.7), ("lowei", True, 0.6), ("moron", False, 0.5), ("trashy", False, 0.45))]
    automaton, rng = toxicity.LexiconAutomaton(terms), random.Random(1)
    for _ in range(8000):
        word = list(rng.choice(terms).text)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(word))
            if rng.random() < 0.4:
                word.insert(k, rng.choice("idotscumrash1é"))
            elif k < len(word):
                word[k : k + 1] = rng.choice(["", rng.choice("idotscumrash1é")])
        word = "".join(word)
        want = max([t.weight for t in terms if t.stem and word.startswith(t.text)] + [t.weight / (1 + e) for t in terms if not t.stem and (e := _distance(word, t.text)) <= toxicity.allowed_edits(len(t.text))], default=0)
        found = automaton.match(word)
        assert abs((found[0] if found else 0) - want) < 1e-12, word


def test_quotation_counts_less():
    cache = toxicity._Cache(toxicity.LexiconAutomaton([toxicity.Term("idiot", False, 1.0)]))
    of = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, cache)))
    said, meant = of('the report said "idiot" was the word'), of("you are an idiot")
    assert said["quoted"] > 0 == said["exact"] and meant["exact"] > 0 == meant["quoted"] and said["reported"] and meant["addressed"] and said["share"] < meant["share"]
    assert of("an idiiot")["near"] > 0 and not any(of("nothing here").values()) and not any(of("").values())


# op9


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= 2):
            a, b = root(k), root(k + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return [ids[root(k)] for k in range(len(ids))]


def test_op9(spark, texts):
    ids = sorted(texts)
    fps = np.array([plain_fingerprint(texts[i]) for i in ids], np.uint64)
    want = {(i, f"{int(f):016x}", c) for i, f, c in zip(ids, fps, plain_components(ids, fps))}
    assert {tuple(r[:3]) for r in registry.QUERIES["op9_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()} == want


@pytest.mark.parametrize("heavy", [1 << 16, 8])
def test_links_of_planted_fingerprints(spark, heavy):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 15, dtype=np.uint64)
    fps = base[rng.integers(0, 15, 900)]
    for _ in range(5):
        fps = fps ^ np.where(rng.random(900) < 0.5, np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64), np.uint64(0))
    fps = np.unique(fps)
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    from sessionlake.operators import graphs

    got = {r.node: r.label for r in graphs.components(simhash.links(nodes, heavy=heavy)).collect()}
    signed = np.sort(fps.view(np.int64))
    want = plain_components(signed.tolist(), signed.view(np.uint64))
    assert [got.get(int(f), int(f)) for f in signed] == want


def test_similar_texts_are_all_found(spark, texts):
    rng, rows = random.Random(5), []
    for n, text in enumerate(list(texts.values())[:120]):
        words = text.split()[:400]
        rows.append((len(rows), " ".join(words)))
        for _ in range(n % 4):
            copy = [w if rng.random() > 0.02 else "changed" for w in words]
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(similar.shingle_set(t, 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][1] == rows[b][1] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
            label[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.doc_id: r.kept_id for r in similar.groups(docs).collect()} == {k: root(k) for k in range(len(rows))}


# op10


def test_op10_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for k in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[k]
        score[k] = -9
        want[int(ids[k])] = [int(ids[j]) for j in np.lexsort((ids, -score))[:5]]
    rows = run(spark, "op10_nearest", "/root/testdata/sf0.1")
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    recall = sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want))
    compared = sum({r.query_id: r.verified for r in rows}.values()) / len(want) / len(ids)
    print(f"recall {recall:.4f}, compared in full {compared:.4f} of the vectors")
    assert set(got) == set(want) and recall >= 0.97 and compared < 0.1


def test_shards_agree_with_one_and_ties_go_to_lesser_ids(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(600, 8)).round(1)
    vectors[100:400] = vectors[0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 50 = 0")
    whole, parts = (sorted(map(tuple, neighbours.nearest(df, asked, shard=s).collect())) for s in (65_536, 100))
    assert [v for q, _, v, *_ in whole if q == 0] == [100, 101, 102, 103, 104] and [v for q, _, v, *_ in parts if q == 0] == [100, 101, 102, 103, 104]
    assert len({r[:4] for r in whole} & {r[:4] for r in parts}) >= 0.9 * len(whole)


def test_scores_and_ranks_of_neighbours_are_exact(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(400, 16)).astype(np.float32)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for q, rank, v, score, many in sorted(map(tuple, neighbours.nearest(df, df.filter("vec_id % 50 = 0"), shard=150).collect())):
        x, y = vectors[q].astype(float), vectors[v].astype(float)
        assert rank == len(got[q]) + 1 and abs(score - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-12 and 5 <= many <= 399
        got[q].append((-score, v))
    assert len(got) == 8 and all(len(own) == 5 and own == sorted(own) for own in got.values())


def test_repeated_vectors_and_queries_count_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [1.0, 0.2]), (18, [1.0, 0.1]), (18, [1.0, 0.1]), (18, [0.0, 1.0]), (15, [1.0, 0.3]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size in (65_536, 2):
        got = sorted(map(tuple, neighbours.nearest(df, df.filter("vec_id = 0"), shard=size).collect()))
        assert [(q, r, v) for q, r, v, *_ in got] == [(0, 1, 18), (0, 2, 15), (0, 3, 9)]


# op8


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "\\n", "a\nb"]), st.lists(st.sampled_from([*chat.CONTROL, "<", "[", "\\", "\\\\", "s>", "/INST]", "|im_end|>", "x", "\n", "é"]), max_size=8).map("".join)), min_size=1, max_size=4))
@settings(max_examples=25, deadline=None)
def test_chats_read_back(spark, turns):
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))
    row = out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.learned(F.col("formatted"), F.col("loss_spans"))).first()
    assert [(t.role, t.text) for t in row.turns] == turns and row.loss == "".join(t for r, t in turns if r == "assistant")


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3), ("odd", "kept", None, None, None, None, None)]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.format_chats(df).first()
    assert row.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|>kept<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.turn_index, a.type, a.uri, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 63), (0, "document", "c.pdf", 1536)] and row.expanded_tokens == 1602


# pipeline


def test_pipeline_against_plain_stages(spark, texts):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    cache = toxicity._Cache(toxicity.LexiconAutomaton(model.terms))
    kept = {i: t for i, t in texts.items() if model.beta[0] + np.dot(toxicity.features(t, cache), model.beta[1:]) < 0}
    sets = {i: set(similar.shingle_set(t, 5).tolist()) for i, t in kept.items()}
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    label = {i: i for i in kept}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in by_shingle[x] if j > i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                label[max(root(i), root(j))] = min(root(i), root(j))
    same = {}
    for i in sorted(kept):
        j = same.setdefault(kept[i], i)
        label[max(root(i), root(j))] = min(root(i), root(j))
    left = {i: t for i, t in kept.items() if root(i) == i}
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = {}
    for i, t in left.items():
        out, at = "", 0
        for a, _, b in secrets.find(t):
            if a >= at:
                out += t[at:a] + "<SECRET>"
            at = max(at, b)
        want[i] = len(tokenizer.encode(out + t[at:], add_special_tokens=False).ids) + 1
    assert {r.doc_id: r.doc_tokens for r in rows} == want
