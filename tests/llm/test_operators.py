"""Every training-data operator against a brute-force version, on a table with nulls, empty and
long texts, ties, repeated rows and columns whose names clash with those used inside."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evlens.llm import (byte_bpe, common, components, decontaminate, exact_dedup, jaccard_forest, line_dedup, prefix_counts,
                        recompression, resampling, suffix_dedup, token_files)

CLASH = ["n", "id", "a", "b", "row", "kept", "label", "body", "salt", "vertex", "doc", "place", "line", "digest", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def make_rows():
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abdeiklmnorstu") for _ in range(rnd.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, passage = [prose(120) for _ in range(6)], prose(60)
    texts = [prose(rnd.randint(1, 150)) for _ in range(25)]
    for b in base:
        texts += [b, b]
        for _ in range(4):
            words = b.split()
            for _ in range(rnd.randint(1, 6)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            texts.append(" ".join(words))
    texts += [prose(20) + "\n" + passage + "\n" + prose(rnd.randint(5, 40)) for _ in range(8)]
    texts += ["Menu | Home\n" + prose(15) + "\n  Menu | Home  \n\nfooter " + str(k) for k in range(7)]
    texts += [None, None, "", "", " ", "\n\n", "one two", "one two", "one two three four", "la " * 300, "la " * 90,
              "ab" * 400, "x" * 250, "x" * 120, "é à 漢字 🙂" * 30, "été\x85　 ñ" * 20, prose(9000)]
    rows = [(k, t, "en", f"s{k % 3}" if k % 11 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s0", 1), (None, "a text without an id", "en", "s1", 1), (None, None, None, None, None)]
    return [r + ("clash",) * len(CLASH) for r in rows]


ROWS = make_rows()
UNIQUE = [r for r in ROWS if r[0] is not None][:-1]  # ids are unique here


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame(UNIQUE, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# 1. Line dedup

def lines_brute(rows, ratio, least):
    pages, having = Counter(r[3] for r in rows), defaultdict(Counter)
    for r in rows:
        for line in {x.strip(" ") for x in (r[1] or "").split("\n")} - {""}:
            having[r[3]][line] += 1
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        bad = {x for x, n in having[r[3]].items() if n > 1 and n > ratio * pages[r[3]] and pages[r[3]] >= least}
        lines = r[1].split("\n")
        left = [x for x in lines if x.strip(" ") not in bad]
        out.append((r[0], "\n".join(left), len(lines), len(lines) - len(left)))
    return Counter(out)


@pytest.mark.parametrize("ratio,least", [(0.03, 3), (0.06, 3), (0.01, 1000)])
def test_line_dedup(docs, ratio, least):
    got = line_dedup.drop_boilerplate(docs, ratio=ratio, min_pages=least)
    assert got.columns == docs.columns + ["n_dropped", "n_lines"]
    rows = got.select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, rows)) == lines_brute(ROWS, ratio, least)
    assert (sum(r.n_dropped for r in rows) > 0) == (least == 3)


def test_line_dedup_plan_has_no_python(docs):
    plan = line_dedup.drop_boilerplate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# 2. Jaccard join

def shingle_set(text, n=5):
    words = (text or "").encode().split()
    return {tuple(words[k:k + min(n, len(words))]) for k in range(max(1, len(words) - n + 1))} if words else set()


def links_brute(rows, threshold=0.8):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            common_ = len(sets[a] & sets[b])
            if a < b and common_ and common_ >= threshold * (len(sets[a]) + len(sets[b]) - common_) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    label = {a: a for a in sets}
    for _ in sets:
        for a in links:
            label[a] = min(label[a], *(label[b] for b in links[a]))
    size = Counter(label.values())
    return {a: (label[a], len(links[a]), size[label[a]]) for a in sets}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(unique, monkeypatch, block):
    monkeypatch.setattr(jaccard_forest, "BLOCK_DOCS", block)
    got = {r.doc_id: (r.class_id, r.n_links, r.class_size) for r in jaccard_forest.near_duplicates(unique).collect()}
    want = links_brute(UNIQUE)
    assert got == want
    assert sum(n > 0 for _, n, _ in want.values()) > 20


def test_near_duplicates_nulls_and_repeats(docs, empty):
    rows = jaccard_forest.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r.class_id, r.n_links) for r in rows if r.doc_id == 5} == {(5, 1)}
    assert jaccard_forest.near_duplicates(empty).count() == 0


def test_prefix_length_reaches_the_recall():
    d = jaccard_forest.prefix_length(0.8)
    assert 1 - (1 - 0.8 ** d) ** jaccard_forest.TREES >= jaccard_forest.RECALL
    assert 1 - (1 - 0.8 ** (d + 1)) ** jaccard_forest.TREES < jaccard_forest.RECALL


def test_links_across_components(spark, monkeypatch):
    """Vertices that the stars leave apart are still compared with each other."""
    rnd = random.Random(3)
    base = [str(rnd.random()) for _ in range(400)]
    texts = [" ".join(base[s:s + 300]) for s in range(0, 100, 7)]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.class_size) for r in jaccard_forest.near_duplicates(df).collect()}
    assert got == links_brute(rows)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "u long, v long")
    got = {r.v: r.label for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


# 3. Byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_byte_bpe(docs, empty):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), bytes(r.decoded)) for r in rows)
    want = Counter()
    for r in ROWS:
        ids = lib.encode_ordinary(r[1] or "")
        want[r[0], len(ids), tuple(ids), (r[1] or "").encode()] += 1
    assert got == want
    both = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_offsets=False, with_decoded=True).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), bytes(r.decoded)) for r in both) == want
    for r in rows:  # offsets cover the text in order and meet at whole characters
        text = bytes(r.decoded).decode()
        assert all(0 <= s < e <= len(text) for s, e in zip(r.char_start, r.char_end))
        whole = [(s, e, i) for s, e, i in zip(r.char_start, r.char_end, r.ids)]
        for s, e, i in whole:
            piece = lib.decode_single_token_bytes(i)
            assert piece in text[s:e].encode()
    assert byte_bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_query_covers_the_offsets(spark, tmp_path):
    from evlens.llm.queries import op3_byte_bpe
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    spark.createDataFrame(UNIQUE, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = []
    for r in UNIQUE:
        raw, at, start, end = (r[1] or "").encode(), 0, [], []
        heads = np.cumsum([0, *[b & 0xC0 != 0x80 for b in raw]]).tolist()
        for piece in lib.decode_tokens_bytes(lib.encode_ordinary(r[1] or "")):
            start.append(heads[at + 1] - 1)
            end.append(heads[at := at + len(piece)])
        rows.append((r[0], start, end))
    want = spark.createDataFrame(rows, "doc_id long, s array<int>, e array<int>").select("doc_id", F.xxhash64("s", "e").alias("h"))
    got = op3_byte_bpe(spark, str(tmp_path)).select("doc_id", "offsets_hash")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_byte_bpe_random_text():
    rnd, enc = random.Random(2), byte_bpe._encoder(RANKS, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    alphabet = "aaabcé漢🙂́'’ st re ll 12  \t\n\n\r\x85　----====<|endoftext|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    assert [np.frombuffer(x, "<i4").tolist() for x in enc.encode(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_decode_joins_split_characters_and_refuses_unknown_ids(spark):
    tokens = byte_bpe.token_bytes(RANKS)
    single = [tokens.index(bytes([b])) for b in "漢".encode()]
    df = spark.createDataFrame([(1, single, "x"), (2, None, "x"), (3, [], "x")], "doc_id long, ids array<int>, decoded_not string")
    assert [bytes(r.decoded) for r in byte_bpe.decode_documents(df, RANKS).orderBy("doc_id").collect()] == ["漢".encode(), b"", b""]
    bad = spark.createDataFrame([(1, [len(tokens)])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode_documents(bad, RANKS).collect()


# 4. Suffix dedup

def suffix_brute(rows, width):
    seen, out = set(), {}
    for key, text in sorted((r[0], (r[1] or "").encode()) for r in rows):
        gone = bytearray(len(text))
        for k in range(len(text) - width + 1):
            if text[k:k + width] in seen:
                gone[k:k + width] = b"\1" * width
            seen.add(text[k:k + width])
        rest = bytes(x for x, g in zip(text, gone) if not g)
        spans = sum(g and not p for p, g in zip(b"\0" + bytes(gone), gone))
        out[key] = (len(text), sum(gone), spans, sha(rest))
    return out


def test_suffix_dedup(unique):
    rows = suffix_dedup.remove_repeats(unique).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    want = suffix_brute(UNIQUE, 100)
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 30 and any(v[2] > 1 for v in want.values())
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in rows if r.kept is not None)


def test_suffix_dedup_edges_of_edited_repeats(spark):
    """Copies that begin, end or are edited at every distance from a sampled suffix, and texts of few letters."""
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    texts = [base]
    for k in range(40):
        at, n = rnd.randrange(500), rnd.randrange(90, 200)
        noise = ["".join(rnd.choice("ijklmnop ") for _ in range(rnd.randrange(80))) for _ in range(2)]
        part = list(base[at:at + n])
        if k % 3 == 0:
            part[rnd.randrange(len(part))] = "#"
        texts.append(noise[0] + "".join(part) + noise[1])
    texts += ["ab" * 90, "ba" * 70 + "c" + "ab" * 80, "a" * 260, "a" * 99 + "b" + "a" * 120]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    want = suffix_brute(rows, 100)
    assert got == want
    assert sum(0 < v[1] < v[0] for v in want.values()) > 20


def test_suffix_dedup_ranges_cover_every_start():
    flags = [1] * 300
    for p in (0, 5, 56, 57, 150, 298, 330):
        code = suffix_dedup.ranges_of(np.array(flags), np.array([p]))
        first, last = suffix_dedup.starts_of(code, 300)
        covered = sorted(w for x, y in zip(first, last) for w in range(x, y + 1))
        assert covered == list(range(max(0, p - suffix_dedup.PERIOD + 1), min(p, 299) + 1))


def test_suffix_dedup_nulls_and_repeats(docs, empty):
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    assert len({tuple(r) for r in rows if r.doc_id == 5}) == 1
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_null_ids_come_first(spark):
    rnd = random.Random(21)
    t, u = (" ".join("w%d" % rnd.randrange(5000) for _ in range(60)) for _ in range(2))
    rows = [(5, t), (-7, u[:30] + t[20:220] + u), (None, t), (None, t), (9, u)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()]
    brute = suffix_brute([(-100 if i is None else i, text) for i, text in [*rows[:3], rows[4]]], 100)
    want = [(None if i == -100 else i, *v) for i, v in brute.items()]
    assert Counter(got) == Counter([*want, *(w for w in want if w[0] is None)])
    assert {x[0]: x[2] for x in got}[None] == 0 and {x[0]: x[2] for x in got}[5] == len(t)


def test_cover_meets_every_shift():
    p, cover = suffix_dedup.PERIOD, suffix_dedup.COVER
    assert {(x - y) % p for x in cover for y in cover} == set(range(p))


def test_sliding_min():
    values = np.random.default_rng(1).integers(0, 99, 200).astype(np.uint64)
    for width in (1, 7, 64, 200):
        assert suffix_dedup.sliding_min(values, width).tolist() == [values[k:k + width].min() for k in range(201 - width)]


# 5. Recompression

def windows_brute(rows, width):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[k:k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = Counter()
    for key, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone[k:k + width] = [True] * width
        out[key, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("width,low,high", [(35, 5, 7), (12, 2, 4), (35, 1, 12)])
def test_recompression(docs, width, low, high):
    rows = recompression.remove_repeats(docs, width=width, low=low, high=high).collect()
    want = windows_brute(ROWS, width)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want
    assert sum(k[2] > 0 for k in want) > 25
    assert all(sha(r.kept) == r.kept_sha256 for r in rows if r.kept is not None)


def test_recompression_empty(empty):
    assert recompression.remove_repeats(empty).count() == 0


# 6. Token files

FILE_TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def test_token_files(unique, spark, tmp_path):
    lib = Tokenizer.from_file(FILE_TOKENS)
    index = token_files.write_token_files(unique, FILE_TOKENS, f"file://{tmp_path}/t", width=64, shards=4)
    got = {r.doc: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(index).collect()}
    start, want = 0, {}
    for key, text in sorted((r[0], r[1] or "") for r in UNIQUE):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 0]
        want[key] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert got == want
    by_shard = defaultdict(list)
    for r in index.orderBy("shard", "seq").collect():
        by_shard[r.path].append(r)
    texts = {r[0]: r[1] or "" for r in UNIQUE}
    for path, rows in by_shard.items():  # sequences and masks by random access, without a copy
        reader = token_files.ShardReader(path)
        flat = [i for r in rows for i in [*lib.encode(texts[r.doc], add_special_tokens=False).ids, 0]]
        total = -(-len(flat) // 64)
        for k in random.Random(1).sample(range(total), min(5, total)):
            seq, mask = reader.sequence(k), reader.mask(k)
            assert len(seq) == 64 and seq[mask].tolist() == flat[k * 64:(k + 1) * 64] and not seq[~mask].any()
        before = pa.total_allocated_bytes()
        reader.sequence(0)
        assert pa.total_allocated_bytes() == before


def test_token_files_nulls_and_empty(docs, empty, tmp_path):
    index = token_files.write_token_files(docs, FILE_TOKENS, f"file://{tmp_path}/n", shards=3)
    rows = token_files.read_token_files(index).orderBy("start").collect()
    assert len(rows) == len(ROWS) and [r.doc for r in rows[:2]] == [None, None]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    none = token_files.write_token_files(empty, FILE_TOKENS, f"file://{tmp_path}/e", shards=3)
    assert token_files.read_token_files(none).count() == 0


# 7. Importance resampling

def test_resampling_separates_and_selects(spark):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["the", "of", "and", "river", "stone", "light", "over", "hill"]) for _ in range(60))
    junk = lambda: " ".join(rnd.choice(["$$$", "WIN!!", "casino", "###", "free", "|"]) for _ in range(60))
    rows = [(k, good() if k % 4 else junk(), 1 if k % 4 else 0) for k in range(400)]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(None, None), (1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows if k < 200] + [(None, 1)], "doc_id long, quality int")
    ratio = resampling.fit(df, labels, buckets=256)
    out = resampling.resample(df, ratio).collect()
    held_out = [r for r in out if r.doc_id is not None and r.doc_id >= 200]
    assert all(r.kept == (r.doc_id % 4 != 0) for r in held_out)
    one = resampling.resample(df, ratio, keep=50)
    keys = sorted((r.gumbel_key for r in out), reverse=True)
    assert {r.gumbel_key for r in one.filter("kept").collect()} == {k for k in keys if k >= keys[49]}
    assert resampling.resample(df, ratio, keep=0).filter("kept").count() == 0
    assert len({(r.log_weight, r.gumbel_key, r.kept) for r in out if r.doc_id == 1}) == 1
    assert [r.log_weight for r in out if r.text is None] == [0.0]


def test_resampling_weights_are_the_models_ratio(docs, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    ratio = resampling.fit(docs, labels, buckets=512)
    raw, target = np.zeros(512), np.zeros(512)
    per_doc = []
    for r in ROWS:
        _, b = resampling.ngram_buckets(pa.array([r[1]], pa.string()), 512)
        raw += np.bincount(b, minlength=512)
        if r[0] is not None and r[0] < 40 and r[0] % 2:
            target += np.bincount(b, minlength=512)
        per_doc.append(b)
    want = np.log(target + 10) - np.log(raw * target.sum() / raw.sum() + 10)
    assert np.allclose(ratio.ratio, want)
    got = sorted(r.w for r in docs.select(resampling.log_weight(F.col("text"), ratio).alias("w")).collect())
    assert np.allclose(got, sorted(want[b].sum() / max(1, len(b) / resampling.PASSAGE) for b in per_doc))


def test_resampling_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert not resampling.fit(docs, none).ratio.any()
    ratio = resampling.fit(empty, none)
    assert resampling.resample(empty, ratio).count() == 0
    out = resampling.resample(docs, ratio)
    assert out.columns == [*docs.columns, "log_weight", "gumbel_key"]
    assert out.count() == len(ROWS)


def test_resampling_decides_alike_at_every_size(spark):
    """One document to reject and one to keep, in tables of different sizes."""
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("aeiourstln") for _ in range(5)) for _ in range(400)]
    good = lambda: " ".join(rnd.choice(vocab) for _ in range(120))
    bad = lambda: " ".join(rnd.choice(vocab[:4]) + "!!$ #win" for _ in range(60))
    clean, junk = good(), bad()
    for n in (80, 300, 1200):
        rows = [(k, good() if k % 4 else bad()) for k in range(n)] + [(n, clean), (n + 1, junk)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, n, 2)], "doc_id long, quality int")
        out = {r.doc_id: r.kept for r in resampling.resample(df, resampling.fit(df, labels)).collect()}
        assert (out[n], out[n + 1]) == (True, False), n


# 8. Decontamination

@pytest.mark.parametrize("least", [0.5, 0.7])
def test_decontamination_reaches_every_insertion_the_score_allows(least):
    """Words inserted at one place or all over, up to the most that the score admits, against whole-text alignment."""
    rnd = random.Random(2)
    item = " ".join(f"w{k}" for k in range(20))
    items = decontaminate.Items([("x", item)])
    noise = lambda n: [f"n{rnd.randrange(10 ** 6)}" for _ in range(n)]
    seen = set()
    for more in range(0, decontaminate.insertions(20, least) + 3):
        for at in (3, 9, 10, 16):
            for spread in (0, 1, 3):
                w, left = item.split(), more
                w[at:at] = noise(max(0, more - spread * 4))
                for k in range(min(spread * 4, more)):
                    w.insert(len(w) - 2 * k - 1, *noise(1))
                text = " ".join(noise(40) + w + noise(40))
                doc = decontaminate.words(text)
                score = decontaminate.align(items.words[0], doc)[0]
                got = decontaminate.find(doc, items, least)
                assert [round(g[1], 9) for g in got] == ([round(score, 9)] if score >= least else []), (more, at, spread)
                seen.add(score >= least)
    assert seen == {True, False}


def test_decontamination(spark):
    rnd = random.Random(9)
    vocab = ["w%d" % k for k in range(3000)]
    prose = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, prose(rnd.randint(15, 50))) for k in range(30)] + [(30, ["zeta", "eta"]), (31, []), (None, prose(20))]
    rows, want = [], {}
    for k in range(200):
        words = prose(rnd.randint(20, 300))
        if k % 5 == 0:
            item, body = items[k // 5 % 30]
            body, kind = list(body), k // 5 % 4
            if kind == 1:  # edited: every seventh word
                body = [rnd.choice(vocab) if j % 7 == 3 else w for j, w in enumerate(body)]
            if kind == 2:  # case and punctuation
                body = [w.upper() + "," for w in body]
            if kind == 3:  # words left out and put in
                body = [x for j, w in enumerate(body) for x in ([] if j % 9 == 4 else [w, "extra"] if j % 9 == 8 else [w])]
            at = rnd.randrange(len(words))
            words[at:at] = body
            want[k] = (item, at, kind)
        rows.append((k, " ".join(words), "x", "y"))
    rows += [(500, None, "x", "y"), (501, "", "x", "y"), (None, "Zeta... eta!", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item string, score string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(40, None)], "item_id long, text string")
    got = defaultdict(dict)
    for r in decontaminate.contaminated(df, bench).collect():
        got[r.doc_id][r.item_id] = r
    assert {k: v[0] for k, v in want.items()} == {k: next(iter(v)) for k, v in got.items() if k is not None}
    for k, (item, at, kind) in want.items():
        r = got[k][item]
        assert abs(r.first_word - at) <= 1
        assert (r.score == 1.0) == (kind in (0, 2))
    assert list(got[None]) == [30]
    none = spark.createDataFrame([], df.schema)
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_alignment_against_plain_dynamic_programming():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randint(1, 15))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        score, start, end = decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == max(map(max, h)) / (2 * len(a)) and 0 <= start <= end <= len(b)


def test_benchmark_in_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    items = [" ".join("q%d" % rnd.randrange(500) for _ in range(20)) for _ in range(12)]
    df = spark.createDataFrame([(k, "start " + t + " end") for k, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == {(k, k) for k in range(12)}


def test_edited_copies_that_are_more_frequent_than_the_exact_one(spark):
    """However often an item's n-grams stand in the documents, each of them is a seed."""
    rnd = random.Random(6)
    item = ["q%d" % k for k in range(21)]
    edited = ["other%d" % k if k % 5 == 4 else w for k, w in enumerate(item)]
    around = lambda: ["s%d" % rnd.randrange(5000) for _ in range(rnd.randint(5, 60))]
    rows = [(k, " ".join(around() + (edited if k else item) + around())) for k in range(21)]
    rows.append((21, " ".join(around() + item[:3] + around())))  # three of its words alone are no copy
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.contaminated(df, bench).collect()}
    assert sorted(got) == list(range(21)) and got[0] == 1
    assert all(abs(got[k] - 15 / 21) < 1e-9 for k in range(1, 21))


def test_bounds_and_order_of_work_change_no_result():
    """Few words, so that windows are many and joined: all windows aligned in order give the same."""
    rnd = random.Random(12)
    for _ in range(60):
        vocab = ["w%d" % k for k in range(rnd.choice([4, 12, 60]))]
        prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
        rows = [(k, prose(rnd.randint(0, 14))) for k in range(8)]
        doc = decontaminate.words(" ".join([prose(rnd.randint(0, 80)), *(r[1] for r in rows if rnd.random() < 0.4), prose(30)]))
        items = decontaminate.Items(rows)
        plain = decontaminate.find(doc, items, 0.5)
        ranked = items.rank(np.array([rnd.randint(1, 99) for _ in items.distinct], dtype=np.int64))
        assert decontaminate.find(doc, ranked, 0.5) == plain
        whole = {k: decontaminate.align(w, doc)[0] for k, w in enumerate(items.words) if len(w)}
        assert all(score <= whole[k] for k, score, _, _ in plain)
        assert {k for k, score in whole.items() if score == 1} <= {k for k, score, _, _ in plain if score == 1}


# 9. Exact dedup

def copies_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(-1 if r[0] is None else r[0])
    out = Counter()
    for r in rows:
        g = groups[r[1] or ""]
        best = None if max(g) < 0 else max(g)
        out[r[0], best, len(g), r[0] == best, sha(r[1] or "")] += 1
    return out


@pytest.mark.parametrize("split", [0, 40, 1000])
def test_exact_dedup(docs, split):
    late = F.coalesce(F.col("doc_id") >= split, F.lit(False))
    out = exact_dedup.exact_dedup(docs.filter(~late), docs.filter(late))
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in out.collect())
    assert got == copies_brute(ROWS)


def test_exact_dedup_tells_colliding_digests_apart(docs):
    weak = lambda text: F.encode(F.lpad(F.pmod(F.length(text), F.lit(3)).cast("string"), 8, "0"), "UTF-8")
    out = exact_dedup.exact_dedup(docs.filter("doc_id < 40"), docs.filter("doc_id >= 40 or doc_id is null"), digest=weak)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect())
    want = Counter()
    for key, n in copies_brute(ROWS).items():
        want[key[:4]] += n
    assert got == want


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty, empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_binary_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    built = exact_dedup.build_filter(np.concatenate([keys, keys[:3]]))
    assert exact_dedup.may_contain(keys, *built).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert exact_dedup.may_contain(others, *built).mean() < 0.02
    assert n < 1000 or len(built[3]) < 1.4 * n + 2000


# 10. Prefix counts

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_prefix_counts(docs, empty):
    lib = Tokenizer.from_file(WORDS)
    tables = prefix_counts.prefix_tables(docs, WORDS)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in prefix_counts.answer(tables, 50).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert prefix_counts.answer(prefix_counts.prefix_tables(empty, WORDS), 5).count() == 0


def test_every_prefix_is_exact():
    rnd, counter = random.Random(8), prefix_counts.WordCounter(WORDS)
    alphabet = "abcdeéÉßΣσςİıñ'’!?<|>endoftext startoftext\n\t 12²½漢字한국é̀क्षि\x1c\x85 🙂ﬁǅ'relves"
    for _ in range(400):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25)))
        if rnd.random() < 0.4:
            text += rnd.choice(["<|endoftext|>", "<|startoftext|>!!", "!!<|endoftext|>'re", "don't we'll THEY'VE"]) + text[:4]
        want = [len(counter.library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        unit, table = counter.tables([text])[0]
        assert np.cumsum(prefix_counts.changes(unit, table)).tolist() == want
        for budget in (0, 1, 3, 7):
            fit = [k + 1 for k, n in enumerate(want) if n <= budget]
            assert prefix_counts.longest_within(unit, table, budget) == (fit[-1] if fit else 0)


def test_every_prefix_of_long_runs_out_of_normal_form_is_exact(monkeypatch):
    rnd, counter = random.Random(18), prefix_counts.WordCounter(WORDS)
    marks = ["e\u0301", "\u0301", "\u0323\u0301", "a\u0301\u0323", "\u1112\u1161\u11ab", "\u1161", "\ud55c\u11a8", "\uf900",
             "\u0130", "I\u0307", "\u212b", "\u0344", "\u0f73", "'\u0301", "=\u0338", "1\u0301", "'re\u0301", "'r", "'", "s\u0323\u0307", "\u09c7\u09be"]
    for k in range(500):
        monkeypatch.setattr(prefix_counts, "LONG", rnd.choice([2, 5, 64]))
        runs = ["the", "xyzzy", "!!", "?", "12", "漢字", "'", "été", "q" * 70, "=" * 70, "漢" * 70]
        text = "".join(rnd.choice(marks if rnd.random() < 0.5 else runs) for _ in range(rnd.randint(1, 9)))
        want = [len(counter.library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        unit, table = counter.tables([text])[0]
        assert np.cumsum(prefix_counts.changes(unit, table)).tolist() == want, ascii(text)


@pytest.mark.parametrize("odd", ["e\u0301", "\uf900", "\u0130", "\u1112\u1161\u11ab"])
def test_a_long_run_is_never_sent_as_all_its_prefixes(odd):
    counter, rnd, sent = prefix_counts.WordCounter(WORDS), random.Random(4), []

    class Library:
        normalizer = counter.library.normalizer

        def encode_batch(self, texts, **_):
            sent.append(sum(map(len, texts)))
            assert sent[-1] < 1_000_000, "quadratic memory"
            return library.encode_batch(texts, **_)

    library, counter.library = counter.library, Library()
    text = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(10_000)) + odd
    text += "".join(rnd.choice("abcdefghij0123456789+/ABCXYZ") for _ in range(10_000)) + odd * 500
    unit, table = counter.tables([text])[0]
    counts = np.cumsum(prefix_counts.changes(unit, table))
    assert len(counts) == len(text)
    for k in [1, 9_999, 10_000, 10_001, 10_002, 10_003, 15_000, len(text) - 2, len(text) - 1, len(text)]:
        assert counts[k - 1] == len(library.encode(text[:k], add_special_tokens=False).ids)


def test_wide_tables(monkeypatch):
    counter = prefix_counts.WordCounter(WORDS)
    monkeypatch.setattr(counter, "deltas", lambda chunk: [0, 300, -300][:len(chunk)])
    assert counter.tables(["abc ab"]) == [(4, np.array([0, 300, -300, 0, 0, 300], dtype="<i4").tobytes())]


# Shared helpers

def test_key_filter_passes_all_keys(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    may = common.key_filter(keys.filter("k % 2 = 0"), "k")
    rows = keys.select("k", may("k").alias("in")).collect()
    assert all(r["in"] for r in rows if r.k % 2 == 0) and sum(r["in"] for r in rows if r.k % 2) < 20
