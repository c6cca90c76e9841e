"""The training-data operators against plain re-computation, on hand-made documents with every odd case."""

import base64
import collections
import hashlib
import io
import itertools
import math
import random
import re
import tracemalloc
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from epitally.llm import (
    byte_bpe,
    compact_windows,
    components,
    context_tree,
    decontamination,
    kneser_ney,
    line_dedup,
    multiprobe_lsh,
    pii_spans,
    simhash_dedup,
    warc,
    zip_archive,
)

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BLANKS = " \t\n\x0b\x0c\r"
# Extra columns named like the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, version long, doc string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage = sentence(rng, 70)
    long = sentence(rng, 6000)
    out = [None, "", " \t\n ", "One", "two words", "a b c", "A  b\tC", long, long.replace(" ", "\n", 40)]
    out += [f"Shared line\n{sentence(rng, 30)}\n  SHARED LINE \nend {i}" for i in range(12)]
    out += [sentence(rng, 40) + " " + passage + " " + sentence(rng, 40) for _ in range(3)]
    near = sentence(rng, 300).split()
    for i in (0, 20, 40):
        out.append(" ".join(w if j != i else "changed" for j, w in enumerate(near)))
    return out + [out[-1], "\x1f naïve café 漢字 😀 don't  stop\r\n", "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "s", None, 1, 2, "z") for i, t in enumerate(texts)]
    rows += [(None, "no id here", "en", None, 3, 1, 2, None), (None, None, None, None, None, None, None, None)]
    rows += [rows[10], rows[10], (5, "another text under five", "en", "s", 1, 1, 2, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def local(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text.translate(UPPER))


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


# Line dedup

def test_lines(docs, empty):
    rows = local(docs)
    seen = collections.defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            if line.strip(BLANKS):
                seen[line.strip(BLANKS).translate(UPPER)].add(i)
    want = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(seen.get(x.strip(BLANKS).translate(UPPER), ())) < 10]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [tuple(r) for r in line_dedup.drop_repeated_lines(docs).select(
        "row.doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) >= 24
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_runs_that_span_batches_and_partitions():
    """The stream gives the same whatever its batches; keys at the ends are reported, not decided."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    rows = sorted((int(rng.integers(0, 9)), 0, int(rng.integers(0, 30)), False, 0, p) for p in range(400))
    names = "h1 h2 doc no_id version pos".split()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32()]

    def batches(step):
        for s in range(0, len(rows), step):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[s:s + step]), types)], names=names)

    docs_of = {k: len({r[2] for r in rows if r[0] == k}) for k in range(9)}
    for least in (3, 22, 40):
        want = sorted((r[0], r[2], r[5]) for r in rows if docs_of[r[0]] >= least)
        for step in (1, 7, 50, 1000):
            out = [r for b in line_dedup.repeated_lines(least)(batches(step)) for r in b.to_pylist()]
            edges = {r["h1"]: r["docs"] for r in out if r["kind"] == line_dedup.EDGE}
            assert edges == {0: docs_of[0], 8: docs_of[8]}
            got = sorted((r["h1"], r["doc"], r["pos"]) for r in out if r["kind"] == line_dedup.DROP)
            assert got == want


# SimHash

def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, empty):
    rows = local(docs)
    prints = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    of = classes(len(rows), pairs)
    least = {c: min((rows[i][0] for i in range(len(rows)) if of[i] == c and rows[i][0] is not None), default=None) for c in of}
    want = [(rows[i][0], prints[i], least[of[i]]) for i in range(len(rows))]
    got = [(r[0], r[1] % 2**64, r[2]) for r in simhash_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    first = simhash_dedup.first_of_each(docs)
    assert first.columns == docs.columns and first.count() == len(set(of))
    assert simhash_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("most", [2, 1000])
def test_links_of_long_posting_lists(spark, most):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(20)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash_dedup.index_edges(spark.createDataFrame([(p,) for p in signed], "fp long"), most_tallied=most)
    at = {p: i for i, p in enumerate(signed)}
    found = [(at[r.a], at[r.b]) for r in edges.collect()]
    want = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in found)
    assert classes(len(prints), found) == classes(len(prints), want)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(25)]
    edges += [(7, 7), (500, 300), (300, 500)]
    of = classes(600, edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: of[i] for i in range(600) if of.count(of[i]) > 1} == got


# BPE

def test_byte_pairs(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pairs = byte_bpe.byte_pairs(spark, path, public_tokenizers.PATTERN)
    out = byte_bpe.encoded(docs, pairs).withColumn("back", byte_bpe.decoded(pairs, F.col("ids")))
    for r in out.select("text", "ids", "back").collect():
        assert r.ids == known.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert byte_bpe.encoded(empty, pairs).count() == 0
    both = byte_bpe.coded(docs.withColumn("ids", F.col("text")).withColumn("c0", F.lit("x")), pairs)
    assert both.columns == [c for c in docs.columns if c != "text"] + ["c0", "ids", "decoded"]
    want = [(r.doc_id, tuple(known.encode_ordinary(r.text or "")), (r.text or "").encode(), "x") for r in docs.collect()]
    got = [(r.doc_id, tuple(r.ids), bytes(r.decoded), r.c0) for r in both.collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert byte_bpe.coded(empty, pairs).count() == byte_bpe.coded(docs.select("text"), pairs).count() - docs.count() == 0
    table, rng = byte_bpe.BytePairs(ranks, public_tokenizers.PATTERN), random.Random(1)
    odd = ["abc'sdtrevml 012 \t\n\x0b\x1c.,!?-_", "aé ß漢²Ⅷ½　 \x85́'sll d12 \n😀", "aßñµªº²½¼×÷ \x85\xa0\xad'll 1\n"]
    many = ["".join(rng.choice(odd[i % 3]) for _ in range(rng.randrange(50))) for i in range(900)] + ["ab" * 2000 + "é" * 700]
    for text, ids in zip(many, table.encode_texts(many, byte_bpe.PieceCache())):
        assert ids.tolist() == known.encode_ordinary(text)


# Context trees

def block(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def tree_log2(train, text, depth):
    """Weighting done by recursion over all contexts, for one byte's eight decisions each."""
    end = b"\xff"
    counts = collections.Counter()
    for t in train:
        raw = end * depth + t.encode() + end
        for i in range(depth, len(raw)):
            for d in range(depth + 1):
                for bit in range(8):
                    counts[raw[i - d:i], raw[i] >> (7 - bit) + 1 | 1 << bit, raw[i] >> (7 - bit) & 1] += 1

    def weighted(context, node):
        own = block(counts[context, node, 0], counts[context, node, 1])
        if len(context) == depth:
            return own, own, 0.0
        below = sum(weighted(bytes([c]) + context, node)[0] for c in range(256) if any(counts[bytes([c]) + context, node, b] for b in (0, 1)))
        return math.log(0.5) + np.logaddexp(own, below), own, below

    raw, total = end * depth + text.encode() + end, 0.0
    for i in range(depth, len(raw)):
        for bit in range(8):
            node, value = raw[i] >> (7 - bit) + 1 | 1 << bit, raw[i] >> (7 - bit) & 1
            p, left = 0.0, 1.0
            for d in range(depth + 1):
                context = raw[i - d:i]
                a, b = counts[context, node, 0], counts[context, node, 1]
                all_, own, _ = weighted(context, node)
                share = 1.0 if d == depth else math.exp(own + math.log(0.5) - all_)
                p += left * share * ((a, b)[value] + 0.5) / (a + b + 1)
                left *= 1 - share
                deeper = raw[i - d - 1:i]
                if d < depth and not any(counts[deeper, n, v] for n in range(1, 256) for v in (0, 1)):
                    p += left * 0.5
                    break
            total += math.log10(p)
    return total


@pytest.mark.parametrize("depth,chunk_chars", [(1, 1), (2, 10**6), (3, 40), (5, 10**6)])
def test_context_tree_is_the_weighted_one(spark, depth, chunk_chars):
    """Scores through the operator, held-out texts with unseen contexts and bytes among them."""
    train, held = ["abab", "abba cab", "b", "", "caf\u00e9 cab", "abab"], ["ab", "", "cabz", "\u6f22\u00e9 abba"]
    rows = [(i, t, i >= len(train)) for i, t in enumerate(train + held)] + [(None, None, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(3)
    got = {r.doc_id: (r.score, r.n_bytes) for r in
           context_tree.scored(docs, held_out=F.col("h"), depth=depth, chunk_chars=chunk_chars).collect()}
    for i, t, _ in rows:
        score, size = got[i]
        assert score == pytest.approx(tree_log2(train, t or "", depth), rel=1e-9) and size == len((t or "").encode())


def test_repeats_among_a_chunks_parts_are_not_held():
    """Twelve parts with the same codes take little more room than one; all twelve at once are 29 MB and as much to sort."""
    part = np.random.default_rng(3).permutation(300_000).astype(np.uint64)
    tracemalloc.start()
    found = context_tree.distinct_codes(part for _ in range(12))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, np.arange(300_000)) and peak < 40e6


def test_a_chunks_codes_and_words_are_placed_in_all_of_it():
    texts = [pa.array(["b a b", ""]), pa.array([""]), pa.array(["c A", "d b a"])]
    parts = [context_tree.codes(*context_tree.padded(t.to_pylist(), 3), 3) for t in texts]
    every = context_tree.distinct_codes(iter(parts))
    assert np.array_equal(every, np.unique(np.concatenate(parts)))
    values = np.arange(len(every)) / 7
    assert all(np.array_equal(context_tree.looked_up(every, values, part), [values[list(every).index(c)] for c in part])
               for part in parts)
    order, _ = context_tree.in_buckets(every, 16)
    assert np.array_equal(every[order], sorted(every, key=lambda c: (context_tree.bucket_of(np.array([c]), 16)[0], c)))
    found, words_in = context_tree.encoded_words(texts)
    common = pa.array(["a"])
    assert found.filter(pc.invert(pc.is_in(found, common))).equals(context_tree.rare_words(texts, common))
    assert [(found.take(pa.array(at)).to_pylist(), owner.tolist()) for at, owner in words_in] == [
        (["b", "a", "b"], [0, 0, 0]), ([], []), (["c", "a", "d", "b", "a"], [0, 0, 1, 1, 1])]


def test_few_rows_are_dealt_to_buckets(spark, monkeypatch):
    counts = spark.createDataFrame([(i % 3, 100 - i, i) for i in range(100)], "bucket long, code long, n long").coalesce(1)
    every = [(i % 3, 100 - i, i) for i in range(100)]
    for packed, most in ((500_000, 3), (1, 100)):
        monkeypatch.setattr(context_tree, "PACKED", packed)
        rows = context_tree.bucket_lists(counts).collect()
        assert len(rows) <= most and all(r.codes == sorted(r.codes) for r in rows)
        assert sorted((r.bucket, c, n) for r in rows for c, n in zip(r.codes, r.times)) == sorted(every)


def test_bytes_sum_to_one_after_any_context(spark):
    docs = spark.createDataFrame([("the cat sat on the mat " * 20,), ("dogs",)], "text string")
    tree = context_tree.train(docs, "text", depth=3, bucket_codes=1)
    assert tree.buckets > 16
    counts = [tuple(r) for r in tree.counts.collect()]
    for before in (b"the", b"zzz", b"xhe", b"zxe", b"\xff\xff\xff"):
        code = np.array([sum(b << 8 * (i + 1) for i, b in enumerate(before[::-1])) | b for b in range(256)], np.uint64)
        bucket = int(context_tree.bucket_of(code[:1], tree.buckets)[0])
        mine = [(c, n) for b, c, n in counts if b == bucket]
        paths = list(tree.top)
        if mine:
            keys, times = (np.array(x) for x in zip(*mine))
            paths += context_tree.paths_of(context_tree.lower_levels(keys.astype(np.uint64), times, 3, 3), 3, paths[-1])
        assert (10.0 ** context_tree.code_logs(code, paths)).sum() == pytest.approx(1.0, abs=1e-12)


def test_scores(docs, empty):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False
    rows = local(docs)
    counts = collections.Counter(w for i, t in rows if not held(i) for w in [*words(t), " "])
    n, v = counts.total(), len(counts)
    want = [(i, held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), " "]), n,
             round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), " "]), 6)) for i, t in rows]
    condition = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    for hot in (1 / 65536, 0.02):
        out = context_tree.scored(docs, held_out=condition, hot_share=hot).collect()
        got = [(*tuple(r)[:5], round(r.base_score, 6)) for r in out]
        assert sorted(got, key=key) == sorted(want, key=key)
        assert all(r.score < 0 and (r.bits_per_byte is None) == (r.n_bytes == 0) for r in out)
    assert context_tree.scored(empty).count() == 0


# Kneser-Ney

def test_kneser_ney_sums_to_one_and_knows_its_text(spark):
    sample = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat sat", "the cat ran", "a dog sat there"] * 4)], "doc_id long, text string")
    levels = kneser_ney.train(sample)
    for before in (b"\xff\xff\xff\xff", b"the ", b"zzzz", b"t th"):
        code = sum(b << 8 * (len(before) - i) for i, b in enumerate(before))
        p = 10 ** kneser_ney.log_probs(levels, np.array([code | b for b in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-9)
    logs, sizes = kneser_ney.score_texts(levels, ["the cat sat", "xq%%%zv##", ""])
    assert sizes.tolist() == [12, 10, 1] and logs[0] / 12 > logs[1] / 10 + 0.5


def test_quality(spark, docs, empty):
    rng = random.Random(9)
    clean = [(1000 + i, sentence(rng, 60), "en") for i in range(60)]
    junk = [(2000 + i, "%%% ".join(sentence(rng, 60).upper().split()), "en") for i in range(5)]
    table = spark.createDataFrame(clean + junk + [(None, None, None)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(1000 + i,) for i in range(50)] + [(None,)], "doc_id long")
    out = {r.doc_id: r.keep for r in kneser_ney.classified(table, trusted).collect()}
    assert not any(out[2000 + i] for i in range(5)) and sum(out[1000 + i] for i in range(60)) >= 57
    kept = kneser_ney.kept(table, trusted)
    assert kept.columns == table.columns and kept.count() == sum(out.values())
    nobody = trusted.where("doc_id < 0")
    assert kneser_ney.kept(docs, nobody).count() == docs.count()
    assert kneser_ney.kept(empty, trusted).count() == 0


@pytest.mark.parametrize("most_grams", [kneser_ney.MOST_GRAMS, 40])
def test_all_trusted_texts_train(spark, monkeypatch, most_grams):
    """Half of 13,000 trusted documents, whether the model is sent whole or asked for what is rare."""
    monkeypatch.setattr(kneser_ney, "MOST_GRAMS", most_grams)
    rng = random.Random(10)
    rows = [(i, sentence(rng, 4), "en") for i in range(13_000)] + [(None, "é %% \u6f22", "de"), (20_000, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    trusted = table.where("doc_id < 13000").select("doc_id")
    learnt = table.join(trusted, "doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    assert learnt.count() > 6_000
    logs, sizes = kneser_ney.score_texts(kneser_ney.train(learnt), [t or "" for _, t, _ in rows])
    got = {r.doc_id: r for r in kneser_ney.classified(table, trusted).collect()}
    for (i, _, _), log, size in zip(rows, logs.tolist(), sizes.tolist()):
        assert got[i].n_symbols == size and got[i].log10_prob == pytest.approx(log, rel=1e-9)


# Decontamination

def test_contained_items(spark, docs, empty, texts):
    w = texts[7].split()
    items = [(1, " ".join(w[100:130])), (2, " ".join(w[100:130]).upper()), (3, " ".join([*w[200:225], "not", "in", "there"])),
             (4, " ".join([*w[300:310], "x y z", *w[313:320]])), (5, None), (6, ""), (7, "Two  WORDS"), (8, "never"), (None, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def runs(t):
        x = words(t)
        return {" ".join(x[i:i + 5]) for i in range(max(1, len(x) - 4))} if x else set()

    by = collections.defaultdict(list)
    for i, t in items:
        if runs(t or ""):
            by[frozenset(runs(t or ""))].append(i)
    want = []
    for i, t in local(docs):
        for k, ids in by.items():
            if len(k & runs(t)) >= 0.8 * len(k) - 1e-9:
                want.append((i, min((x for x in ids if x is not None), default=None), len(ids), len(k & runs(t)), len(k)))
    found = decontamination.contained_items(docs, bench)
    got = [(None if r.no_id else r.doc, r.item_id, r.n_items, r.n_shared, r.n_shingles) for r in found.collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) >= 3
    bad = {w[0] for w in want}
    rest = decontamination.without_items(docs, bench)
    assert rest.columns == docs.columns and rest.count() == sum(i not in bad or t == "another text under five" for i, t in local(docs))
    assert decontamination.without_items(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.without_items(empty, bench).count() == 0


# Passages

def test_passages(docs, empty):
    out = collections.defaultdict(list)
    for r in compact_windows.shared_passages(docs).collect():
        out[r.doc_id].append((r.start_word, r.end_word))
        assert r.end_word - r.start_word >= 50 and r.similarity >= 0.8
    grams = collections.defaultdict(set)
    rows = [(i, words(t)) for i, t in local(docs)]
    for n, (i, w) in enumerate(rows):
        for s in range(len(w) - 49):
            grams[" ".join(w[s:s + 50])].add(n)
    for n, (i, w) in enumerate(rows):
        for s in range(len(w) - 49):
            if len(grams[" ".join(w[s:s + 50])]) > 1:
                assert any(a <= s and s + 50 <= b for a, b in out[i]), (i, s)
    assert len(out) < len(rows)
    assert compact_windows.shared_passages(empty).count() == 0


def test_passages_of_hot_hashes(docs, monkeypatch):
    plain = sorted(map(str, compact_windows.shared_passages(docs).collect()))
    for name, value in (("SAMPLED", 1), ("HOT_TEXTS", 2), ("SALTS", 3)):
        monkeypatch.setattr(compact_windows, name, value)
    assert sorted(map(str, compact_windows.shared_passages(docs).collect())) == plain


def test_longer_passages_under_a_common_phrase(spark):
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, want = [], []
    for lead in (0, 8, 16) * 4:
        phrase, rest = fresh(44), fresh(16)
        pair = {len(rows) + int(i) for i in rng.choice(60, 2, replace=False)}
        want.append(pair)
        for _ in range(60):
            middle = rest[:lead] + phrase + rest[lead:] if len(rows) in pair else phrase
            rows.append((len(rows), " ".join(fresh(80) + middle + fresh(80))))
    found = compact_windows.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.partner_id) for r in found if r.end_word - r.start_word >= 60}
    assert got == {(a, b) for pair in want for a in pair for b in pair - {a}}


def test_every_pair_that_meets_is_linked(spark):
    """All texts share a passage between other words, and some of them a second one in two words apart."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, rows = fresh(60), []
    for i in range(40):
        near = passage[:20 + i] + fresh(1) + passage[21 + i:] if i % 2 else passage
        rows.append((i, " ".join(fresh(70) + near + fresh(70))))
    rows.append((40, rows[0][1]))
    got = collections.Counter()
    for r in compact_windows.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if (r.start_word, r.end_word) != (0, 200):
            got[r.doc_id] += r.n_links
    grams = [words(t) for _, t in rows[:40]]

    def alike(a, b):
        return bool(compact_windows.verified(*(compact_windows.tokens(" ".join(x), 5, compact_windows.WordHashes()) for x in (a, b)),
                                             46, 0.8))

    want = [sum(alike(a, b) for b in grams if b is not a) for a in grams]
    assert [got[i] for i in range(40)] == want and got[40] == want[0] and min(want[::2]) >= 19


def test_pairs_under_common_crossings(spark, monkeypatch):
    rng = np.random.default_rng(13)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    phrases = [fresh(70) for _ in range(3)]
    rows = [(i, " ".join(sum((phrases[k][:30 + i % 7 * 5] + fresh(1) + phrases[k][31 + i % 7 * 5:] + fresh(30) for k in {i % 3, i % 2}), [])))
            for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(str, compact_windows.shared_passages(docs).collect()))
    for name, value in (("MANY_RUNS", 3), ("TILE", 5), ("MATRIX", 64), ("CHUNK_PAIRS", 50), ("CHUNK_CHARS", 2000), ("BUCKET_CHARS", 500)):
        monkeypatch.setattr(compact_windows, name, value)
    assert sorted(map(str, compact_windows.shared_passages(docs).collect())) == plain and len(plain) >= 60


def test_pairs_are_verified_in_the_jvm_as_plainly(spark):
    """Texts with few words, with edits, repeats and parts in another order; no pair goes through Python."""
    rng = np.random.default_rng(14)
    base, texts = [f"w{x}" for x in rng.integers(0, 60, 150)], []
    for i in range(45):
        t = [w if rng.random() > 0.01 * (i % 6) else f"W{rng.integers(0, 10**(1 + i % 4))}" for w in base]
        x, y, z = sorted(rng.integers(0, 150, 3).tolist())
        texts.append([t, t[x:] + t[:x], t[:y] + t[x:z] + t[y:], t[x:z + 20] * 2, t[:x] + t[z:]][i % 5])
    named = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "version long, text string")
    pairs = spark.createDataFrame([(a, b, a % 3) for a in range(45) for b in range(a + 1, 45)], "a long, b long, first long")
    for n_words, shortest, functions, min_shared, similarity in ((2, 9, 5, 2, 0.8), (1, 12, 3, 2, 0.6), (3, 20, 2, 1, 0.8)):
        meeting = compact_windows.all_windows(named, n_words, shortest + n_words - 1, functions)
        crossed = compact_windows.crossings(functions, min_shared, shortest, meeting)
        runs = named.select(F.col("version").alias("run"), F.col("text").alias("words")).join(crossed.drop("crossings"), "run")
        links = compact_windows.run_links(runs, pairs, n_words, functions, min_shared, shortest, similarity)
        assert "InArrow" not in links._jdf.queryExecution().executedPlan().toString()
        plain = {r.run: compact_windows.Run(r.words, n_words, compact_windows.WordHashes(), np.frombuffer(r.keys, np.int64),
                                            np.frombuffer(r.places, np.int32)) for r in runs.collect()}
        want = []
        for a, b in itertools.combinations(sorted(plain), 2):
            for a1, a2, b1, b2, alike in plain[a].passages(plain[b], functions, min_shared, shortest, similarity):
                want += [(a, a1, a2, b, alike), (b, b1, b2, a, alike)]
        asked = pairs.join(runs.select(F.col("run").alias("a")), "a").join(runs.select(F.col("run").alias("b")), "b")
        links = compact_windows.run_links(runs, asked, n_words, functions, min_shared, shortest, similarity)
        assert sorted(map(tuple, links.collect())) == sorted(want) and len(want) > 500


def test_tiles_hold_a_runs_crossings_once_a_chunk(spark, monkeypatch):
    """All runs have the same crossings; what is dealt grows with their number, not with its square."""
    crossed = spark.createDataFrame([(i, list(range(120))) for i in range(40)], "run long, crossings array<long>")
    dealt, real = [], type(crossed).mapInArrow

    def counted(df, func, *args):
        if func.__name__ == "tile":
            lists = F.col(next(f.name for f in df.schema if f.dataType.typeName() == "array"))
            dealt.append(df.agg(F.sum(F.when(lists.isNotNull(), F.size(lists)))).first()[0])
        return real(df, func, *args)

    monkeypatch.setattr(type(crossed), "mapInArrow", counted)
    found = sorted((r.a, r.b) for r in compact_windows.run_pairs(crossed).collect())
    assert found == [(a, b) for a in range(40) for b in range(a + 1, 40)]
    assert len(dealt) == 1 and dealt[0] <= 16 * 40 * 120


def test_runs_by_content_stand_for_all():
    rng = np.random.default_rng(12)
    for _ in range(60):
        left, right = (rng.integers(0, 9, 24) for _ in range(2))
        found = compact_windows.longest_of_all(left, right, 5, 0.8)
        want = brute_passages(left.tolist(), right.tolist(), 5, 0.8)
        assert (found[1] - found[0] if found else 0) == want


def brute_passages(left, right, shortest, similarity):
    """The longest run of ``left`` alike enough to one of ``right``, both with shared ends, by trying all pairs of runs."""
    every = lambda x: [(x[i], x[j - 1], j - i, set(x[i:j])) for i in range(len(x)) for j in range(i + shortest, len(x) + 1)]
    best, others = 0, every(right)
    for first, last, n, mine in every(left):
        if n > best and any(len(mine & o) >= similarity * len(mine | o) and {first, last} <= o and {c, d} <= mine
                            for c, d, _, o in others):
            best = n
    return best


def test_near_passages_in_unrelated_text():
    rng = np.random.default_rng(7)
    fresh = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    for n in (46, 50, 60, 76):
        passage = fresh(n)
        near = passage.copy()
        near[n // 2 - 2: n // 2 + 2] = fresh(4)
        stray = fresh(3)
        left = np.concatenate([stray[:1], fresh(300), passage, fresh(200), stray[1:]])
        right = np.concatenate([fresh(100), stray[1:2], fresh(150), near, stray[:1], fresh(120), stray[2:]])
        found = compact_windows.alike_passages(left, right, [[0, len(left) - 1, 0, len(right) - 1, 301, 251]], 46, 0.8)
        assert [x[:4] for x in found] == [(301, 301 + n, 251, 251 + n)]


def test_two_near_passages_in_one_window():
    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    one, two = fresh(60), fresh(50)
    near = lambda x: np.concatenate([x[:20], fresh(4), x[24:]])
    left = np.concatenate([fresh(90), one, fresh(80), two, fresh(70)])
    right = np.concatenate([fresh(30), near(two), fresh(110), near(one), fresh(20)])
    found = compact_windows.alike_passages(left, right, [[0, len(left) - 1, 0, len(right) - 1, 0, 0]], 46, 0.8)
    assert sorted(x[:4] for x in found) == [(90, 150, 190, 250), (230, 280, 30, 80)]


def test_passages_are_found_where_any_are():
    rng = np.random.default_rng(9)
    for _ in range(150):
        # Few distinct values, so that repeats and stray matches are common.
        most = int(rng.integers(8, 40))
        left, right = (rng.integers(1, most, rng.integers(6, 26)).astype(np.uint64) for _ in range(2))
        at = int(rng.integers(0, 4))
        right[at: at + 8] = left[at: at + 8] if len(left) >= at + 8 <= len(right) else right[at: at + 8]
        found = compact_windows.verified(left, right, 5, 0.8)
        want, got = brute_passages(left.tolist(), right.tolist(), 5, 0.8), max((x[1] - x[0] for x in found), default=0)
        assert bool(want) == bool(found) and got <= want
        # With repeats, ends at shingles that stand once come first.
        assert got == want or len(set(left.tolist())) < len(left) or len(set(right.tolist())) < len(right)
        for a1, a2, b1, b2, alike in found:
            x, y = set(left[a1:a2].tolist()), set(right[b1:b2].tolist())
            assert alike == pytest.approx(len(x & y) / len(x | y)) and alike >= 0.8


def test_windows_hold_every_run_once():
    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 2**63, 60).astype(np.uint64), np.zeros(60, np.uint64)):
        found = compact_windows.windows(values, 10)
        for i in range(60):
            for j in range(i + 9, 60):
                at = [(low, c, high) for low, c, high in found if low <= i <= c <= j <= high]
                assert len(at) == 1 and values[at[0][1]] == values[i:j + 1].min()


def test_windows_of_many_texts_at_once():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (10, 11, 60, 400, 10, 37)]
    for mixer in compact_windows.mixers(3):
        text, l, c, r, key = compact_windows.windows_of_all(texts, mixer, 10)
        for i, values in enumerate(texts):
            hashes = compact_windows.mixed(values, mixer)
            mine = text == i
            assert sorted(zip(l[mine].tolist(), c[mine].tolist(), r[mine].tolist())) == sorted(
                compact_windows.windows(hashes, 10))
            assert (key[mine] == hashes[c[mine]]).all()


# WARC

def test_archives(spark):
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(["<p>a</p>", "", None, "<p>a</p>", "é" * 5000, "", "b"])]
    pages += [(3, "http://x/3", "<p>a</p>"), (None, None, "b"), (None, "u\r\nv", "only")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(3)
    groups = collections.defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    want = []
    for i, _, h in pages:
        last = max((x for x in groups[h or ""] if x is not None), default=None)
        raw = (h or "").encode()
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                     "response" if i == last else "revisit", None if i == last else last))
    for size in (1, 64 << 20):
        out = warc.read_archives(warc.write_archives(df, archive_bytes=size)).collect()
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
        assert sorted(got, key=key) == sorted(want, key=key)
        assert {bytes(r.payload).decode() for r in out if r.payload is not None} == {h or "" for _, _, h in pages}
    least = warc.read_archives(warc.write_archives(df, min_bytes=2)).where("payload_bytes < 2 AND record_type = 'revisit'")
    assert least.count() == 0
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


@pytest.mark.parametrize("limit", [zipfile.ZIP64_LIMIT, 10])
def test_zip_directories(monkeypatch, limit):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3 if limit == 10 else 0xFFFF)
    buffer = io.BytesIO(b"")
    with zipfile.ZipFile(buffer, "w") as z:
        for i in range(5):
            z.writestr(zipfile.ZipInfo(f"dir/é{i}.bin"), bytes([i]) * (20 + i))
        z.comment = b"a comment PK\x05\x06 with a mark"
    data = buffer.getvalue()
    read_at = lambda at, n: data[at:at + n]
    members = zip_archive.directory(read_at, len(data))
    assert [m.name for m in members] == [f"dir/é{i}.bin" for i in range(5)]
    for i, m in enumerate(members):
        assert read_at(zip_archive.stored_at(read_at, m), m.size) == bytes([i]) * (20 + i)
    with pytest.raises(ValueError):
        zip_archive.directory(read_at, 10)


# Nearest vectors

def test_nearest(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 12)).astype(np.float32)
    rows = [(i, v.tolist(), None) for i, v in enumerate(base)]
    rows += [(1000 + i, base[20].tolist(), 1) for i in range(60)]
    rows += [(40, base[40].tolist(), 2), (2000, None, 1), (2020, [0.0] * 12, 1), (2040, [float("nan")] * 12, 1),
             (2060, [1.0, None] * 6, 1), (2080, [1.0], 1), (None, base[1].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket int").repartition(3)
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and i < 2000]
    got = collections.defaultdict(list)
    for r in multiprobe_lsh.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=100, most_together=40).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    queries = {i: v for i, v in good if i % 20 == 0}
    assert set(got) == set(queries)
    hits = total = 0
    for q, v in queries.items():
        others = list(good)
        others.remove(next(x for x in others if x[0] == q))
        best = sorted(((-(w * v).sum(), i) for i, w in others))[:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i in best} & {i for _, i, _ in found})
        total += 20
    assert hits / total >= 0.9
    assert multiprobe_lsh.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = multiprobe_lsh.nearest(df.where("vec_id in (0, 3, 5)"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["rank"] for r in few] == [1, 2]


def recall(spark, folder, vectors, every):
    """Share of the true nearest that queries find through the operator, and rows per query."""
    table = pa.table({"vec_id": np.arange(len(vectors)), "embedding": pa.FixedSizeListArray.from_arrays(vectors.ravel(), vectors.shape[1]).cast(pa.list_(pa.float64()))})
    pq.write_table(table, f"{folder}/vectors.parquet", row_group_size=5000)
    found = collections.defaultdict(set)
    for r in multiprobe_lsh.nearest(spark.read.parquet(folder), F.col("vec_id") % every == 0).collect():
        found[r.query_id].add(r.vec_id)
    scores = vectors[::every] @ vectors.T
    scores[np.arange(len(scores)), np.arange(0, len(vectors), every)] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    return np.mean([len(found[i * every] & set(b.tolist())) / 20 for i, b in enumerate(best)]), min(map(len, found.values()))


@pytest.mark.parametrize("n,every", [(10_000, 100), (50_000, 1000)])
def test_recall_does_not_fall_with_size(spark, folder, n, every):
    vectors = np.random.default_rng(7).normal(size=(n, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    share, least = recall(spark, folder, vectors, every)
    assert share >= 0.95 and least == 20


@pytest.mark.parametrize("lengths", [{3: 100.0}, {3: 5.0, 4: 1e-9}, "spread", {i: 1e-170 for i in range(600)}])
def test_recall_with_unequal_norms(spark, folder, lengths):
    """A few vectors much longer or shorter than all others, norms over many powers of two, and squares that vanish."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(6000, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    factors = np.exp(rng.normal(size=6000) * 2) if lengths == "spread" else np.ones(6000)
    if lengths != "spread":
        factors[list(lengths)] = list(lengths.values())
    share, least = recall(spark, folder, vectors * factors[:, None], 60)
    assert share >= 0.95 and least == 20


def test_queries_with_few_candidates_look_everywhere(spark):
    """Cells so narrow that a query meets hardly any vector."""
    units = np.random.default_rng(9).normal(size=(900, 8))
    rows = list(enumerate((units / np.linalg.norm(units, axis=1)[:, None]).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multiprobe_lsh.nearest(df, F.col("vec_id") % 300 == 0, width=0.01, shard_rows=200).collect()
    vectors = np.array([v for _, v in rows])
    for q in (0, 300, 600):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(-scores)[:20].tolist()


def test_ties_go_to_the_smaller_id(spark):
    # 80 distinct vectors with the same product: signs that agree with the query's in 14 of 16 places.
    rng = np.random.default_rng(3)
    flips = [(i, j) for i in range(16) for j in range(i)][:80]
    query = rng.choice([-1.0, 1.0], 16)
    ids = rng.permutation(np.arange(1, 81)).tolist()
    rows = [(0, query.tolist())]
    for n, (i, j) in zip(ids, flips):
        v = query.copy()
        v[[i, j]] *= -1
        rows.append((n, v.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    # Cells so wide that all are visited.
    got = multiprobe_lsh.nearest(df, F.col("vec_id") == 0, width=100.0, shard_rows=20, most_together=8).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 12.0) for i in range(1, 21)]


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(PATTERNS.items(), 1):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 12 <= len(number) <= 19 and luhn(number), "phone": lambda: 9 <= len(number) <= 15}[kind]():
                out.append((m.start(), place, m.end(), kind))
    return sorted(out)


def test_personal_data(spark, empty):
    rng = random.Random(8)
    chars = "ab.@%+-_01 5(9)\n,é😀"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(120))) for _ in range(300)]
    texts += [None, "", "a@b.com_x@y.org.", "x@y 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "+1 (999) 555-1234 ", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "é😀 me@x.io", 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" end', "1 " * 3000, "a" * 5000 + "@",
              "9" * 4000, "tel 555-123-4567 or joe (at) site (dot) org", "1234567890123 " * 40]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x"), (None, "me@x.io", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(3)
    got = pii_spans.personal_spans(df).collect()
    want = [(i, base_spans(t or "")) for i, t, _ in rows]
    mine = [(r.doc_id, [tuple(s)[:4] for s in r.spans if s["base"]]) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    more = {r.doc_id: [s["kind"] for s in r.spans if not s["base"]] for r in got}
    assert "secret" in more[texts.index('token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" end')]
    assert pii_spans.personal_spans(empty).count() == 0
    plan = pii_spans.personal_spans(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_unreliable_labelers_weigh_less():
    rng, counts, right = random.Random(1), collections.Counter(), {}
    for _ in range(4000):
        y = rng.random() < 0.3
        votes = tuple((1 if y == (rng.random() < p) else -1) for p in (0.95, 0.9, 0.9, 0.55, 0.5))
        counts["secret", votes] += 1
        right["secret", votes] = right.get(("secret", votes), 0) + (1 if y else -1)
    truth = pii_spans.estimated(counts)
    agree = sum(n for p, n in counts.items() if (truth[p] > 0.5) == (right[p] > 0))
    assert agree / 4000 > 0.95


# Pipeline

def test_stages(spark, docs):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    assert [f for _, f in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
    left = now.collect()
    assert len({r.doc_id for r in left if r.doc_id is not None}) <= docs.count()
    assert all("shared line" not in (r.text or "").lower() for r in left)
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() == len(left)
