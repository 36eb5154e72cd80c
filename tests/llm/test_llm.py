"""The ten corpus operators against brute force, and on awkward input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, chat, maxent_lm, minhash, mixing, piece_table, piece_viterbi, pivot_index, quality, queries, storage, textvec, token_counts, token_files, toxicity
from quarry.llm.components import UnionFind, _forest, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
#: Names that the operators use inside.
CLASHING = "size int, tie string, src string, bucket int, seq int, key long, id long, a long, b long, h long, rid long, kept boolean, in_text string, row string, whole string, units string, `pass` int, v string, n long, c long, uri string, keep string, component string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}" for k in range(60_000))
AWKWARD = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n\x0b ", None, None, 5), (4, "one", "en", None, 3), (5, "one", "en", "", 3), (5, "one", "en", "", 3), (6, LONG, "en", "s", len(LONG)),
    (7, "Tab\tand\nline  é ▁ 你好 \U0001F600 <|endoftext|> <|im_end|>", "xx", "t", 9), (None, "no id at all", "en", "s", 12), (None, "no id at all", "en", "s", 12), (8, "same id one " * 9, "en", "u", 1), (8, "other text two " * 9, "en", "u", 1),
    (9, " ".join(f"q{k}" for k in range(40)), "en", "s", 1), (10, " ".join(f"q{k}" for k in range(40)), "de", "t", 1), (11, " ".join(f"q{k}" for k in range(39)) + " z", "en", "s", 1), (12, "x" * 200_000, "en", "s", 1),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    n = len(CLASHING.split(","))
    return spark.createDataFrame([(*r, *[None] * n) for r in AWKWARD], f"{DOCUMENTS}, {CLASHING}")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def words(text):
    return WORD.findall(text or "")


# words and pieces

def thue_morse(size):
    """A word whose polynomial hash equals that of its complement, whatever the base."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_collide_under_polynomials(spark, size):
    from tokenizers import Tokenizer

    pair = thue_morse(size)
    rows = [(1, pair[0], "en", "s"), (2, pair[1], "en", "s"), (3, f"{pair[0]} {pair[1]} x", "en", "s"), (4, f"{pair[1]} {pair[0]} x", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    hashes, _ = textvec.words(pa.array(pair), True)
    assert hashes[0] != hashes[1]
    plain = Tokenizer.from_file(byte_bpe.vocabulary_path())
    ids = {i: plain.encode(t, add_special_tokens=False).ids for i, t, _, _ in rows}
    for r in token_files.tokens_on_disk(docs).collect():
        assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]) + 1, zlib.crc32(np.array([*ids[r.doc_id], 2], "<u4").tobytes()))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {i: len(x) for i, x in ids.items()}
    assert all(r.kept and r.n_shingles == (1 if r.doc_id < 3 else 2) for r in minhash.near_duplicates(docs, size=2).collect())
    assert all(r.round_trip for r in piece_viterbi.encoding_digests(docs).collect())


def test_pieces_that_share_a_hash():
    """With seven hashes in all, the bytes still tell pieces apart."""
    draw = np.random.default_rng(0)
    words = [bytes(draw.integers(97, 100, draw.integers(1, 30)).astype(np.uint8)) for _ in range(300)] + [b"x" * 600, b"x" * 601, b"x" * 600]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    table = piece_table.PieceTable("<u4")

    def encode(at):
        found = [[sum(words[k]), len(words[k])] for k in at]
        return np.array([x for f in found for x in f], "<u4"), np.full(len(at), 2)

    for _ in range(3):
        ids, upto = table.expand(textvec.hash_spans(raw, starts, ends, False) % np.uint64(7), raw, starts, ends, encode)
        assert ids.reshape(-1, 2).tolist() == [[sum(w), len(w)] for w in words] and upto.tolist() == [2 * k + 2 for k in range(len(words))]


def test_shared_folder(spark):
    path = storage.shared_dir(spark, "probe")
    storage.write_file(f"{path}/x", [b"0123456789"])
    assert bytes(storage.read_range(f"{path}/x", 3, 4)) == b"3456" and bytes(storage.read_range(f"{path}/x", 8, 9)) == b"89"
    import os

    assert storage.clean_up(spark) >= 1 and not os.path.exists(path.removeprefix("file:"))
    assert storage.clean_up(spark) == 0


@pytest.mark.parametrize("name", ["base_quality_statistics", "base_maxent_scores", "base_mixing_targets"])
def test_base_columns_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


# 1 quality rules

def brute_statistics(text):
    w = words(text)
    seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    covered = {i for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for i in range(k, k + 8)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_statistics(spark, documents, texts, awkward):
    for frame, of in ((documents, list(texts.items())), (awkward, [(r[0], r[1]) for r in AWKWARD])):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(frame).collect())
        want = Counter()
        for doc_id, text in of:
            s = brute_statistics(text)
            want[doc_id, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]] += 1
        assert got == want


def brute_kneser_ney(texts, least=1):
    """Modified Kneser-Ney over 5-grams of code points, as a function of a 5-gram."""
    levels = {5: Counter(p[k:k + 5] for p in ("\0" * 4 + t for t in texts) for k in range(len(p) - 4))}
    for k in (4, 3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discount, total, kinds = {}, {}, {}
    for k, level in levels.items():
        n = [sum(v == i for v in level.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        discount[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if i < 4 and n[i] and n[1] else 0.5 * i, 0.05 * i), 0.95 * i) for i in (1, 2, 3)]
        total[k], kinds[k] = Counter(), {}
        for g, c in level.items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]] = kinds[k].get(g[:-1], 0) + less(discount[k], c, k, least)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(levels[1]) + 1)
        c, h = levels[k][g], g[:-1]
        if not total[k][h]:
            return p(g[1:])
        return (c - less(discount[k], c, k, least) if c else 0) / total[k][h] + kinds[k][h] / total[k][h] * p(g[1:])

    return p


def less(discount, c, order, least):
    return c if order == 5 and c < least else min(discount[min(c, 3)], c)


def test_quality_perplexity_is_kneser_ney(spark, monkeypatch):
    rows = [(1, "the cat sat on the mat. The cat!", "en"), (2, " a cat is a cat, not 12 cats\nand so on", "en"), (3, "le chat", "fr"), (4, "zzzz qqqq 99", "en"), (5, "猫在垫子上 猫在睡觉 \U0001F600", "zh"), (6, "кот сидит на коврике", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for least in (1, 2):
        models = {lang: brute_kneser_ney([t for _, t, other in rows if other == lang], least) for lang in {r[2] for r in rows}}
        for part in (1 << 20, 7):  # a text in parts
            monkeypatch.setattr(quality, "PART", part)
            monkeypatch.setattr(quality, "SHARD_ENTRIES", 64 if part == 7 else 1 << 21)
            path, bits = quality.train(docs, least)
            assert (bits > 0) == (part == 7)
            scores = quality.Scores(path, bits)
            for doc_id, text, lang in rows:
                padded = "\0" * 4 + text
                want = [math.log10(models[lang](padded[k:k + 5])) for k in range(len(text))]
                batch = pa.record_batch({"lang": pa.array([lang], pa.string()), "text": pa.array([text])})
                for _ in range(2):
                    got = np.concatenate([scores.log10(lang, b.hi, b.lo) for _, b in quality.blocks(batch)])
                    assert got == pytest.approx(want, rel=1e-4)
                if part > 7:
                    units = len(words(text)) + (text[0] == " ")
                    found = quality.score(docs, path, bits).where(F.col("doc_id") == doc_id).first()
                    assert found.perplexity == pytest.approx(10 ** (-sum(want) / units), rel=1e-3)
        p = models["en"]
        for context in ["\0\0\0\0", "the ", "cat ", "zzzz", "q?!."]:
            symbols = {c for _, t, lang in rows for c in t if lang == "en"}
            assert sum(p(context + w) for w in symbols) + p(context + "\U0010FFFF") == pytest.approx(1)


def test_quality_rejects_by_band(spark):
    import random

    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("aeiou" if k % 2 else "bdklmnrst") for k in range(draw.randrange(3, 8))) for _ in range(300)]
    clean = [" ".join(draw.choices(vocabulary, k=200)) for _ in range(150)]
    noise = ["".join(draw.choice("qxzjvwk#%!?0123456789 ") for _ in range(1500)) for _ in range(3)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(clean + noise)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert sum(kept[k] for k in range(150)) >= 146 and not any(kept[k] for k in range(150, 153))  # 2.5 deviations


# 2 SentencePiece

def test_quality_rejects_labelled_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs).where("NOT base_failed").join(labels, "doc_id").where("quality IS NOT NULL").select("lang", "quality", "kept").collect()
    share = lambda flag, lang: np.mean([r.kept for r in rows if r.quality == flag and lang in (r.lang, "")])
    assert share(0, "") < 0.35 and share(0, "en") < 0.45 and all(share(0, lang) < 0.3 for lang in ("de", "es", "fr"))
    assert share(1, "") > 0.99 and all(share(1, lang) > 0.98 for lang in ("de", "en", "es", "fr"))


def brute_viterbi(coder, text):
    if not text:
        return 0.0
    points = [piece_viterbi.LITERAL if ord(c) == piece_viterbi.SPACE else piece_viterbi.SPACE if c == " " else ord(c) for c in " " + text]
    shown = "".join("\0" if p == piece_viterbi.LITERAL else chr(p) for p in points)
    pieces = {coder.pieces.names[i]: float(coder.pieces.score[i]) for i in coder.pieces.plain}
    best = [0.0]
    for j in range(1, len(points) + 1):
        found = best[j - 1] + len(coder._fallback(points[j - 1])) * coder.byte_score
        for size in range(1, min(16, j) + 1):
            part = shown[j - size:j]
            if part in pieces and "\0" not in part:
                found = max(found, best[j - size] + pieces[part])
        best.append(found)
    return best[-1]


def test_viterbi(spark, documents, texts, awkward, empty):
    coder = piece_viterbi.Encoder()
    for text in [t[:300] for t in list(texts.values())[:25]] + ["a", "  a b  ", "▁ x ▁▁", "\n\n é", "你好", "\U0010FFFF\U0001F600", "\0 a", "don't   stop."]:
        ids = coder.encode(text)
        assert float(coder.pieces.score[ids].sum()) == pytest.approx(brute_viterbi(coder, text), abs=1e-6)
        assert coder.decode(ids) == text
    for frame, n in ((documents, len(texts)), (awkward, len(AWKWARD)), (empty, 0)):
        rows = piece_viterbi.encoding_digests(frame).collect()
        assert len(rows) == n and all(r.round_trip for r in rows)
    by_id = {r.doc_id: r for r in piece_viterbi.encoding_digests(documents).collect()}
    for doc_id in list(texts)[:20]:
        ids = coder.encode(texts[doc_id])
        assert (by_id[doc_id].n_tokens, by_id[doc_id].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


# 3 maximum entropy

def brute_base(rows):
    tokens = [[*words((t or "").translate(LOWER)), None] for _, t in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for ws, out in zip(tokens, held) if not out for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, out, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (i, _), ws, out in zip(rows, tokens, held)]


def test_maxent(spark, documents, texts, awkward, empty):
    for frame, rows in ((documents, list(texts.items())), (awkward, [(r[0], r[1]) for r in AWKWARD])):
        got = sorted(((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in maxent_lm.score_documents(frame, most=100, rounds=2).collect()))
        want = sorted((i or -1, *rest) for i, *rest in brute_base(rows))
        for one, other in zip(got, want, strict=True):
            assert one[:5] == other[:5] and one[5] == pytest.approx(other[5], rel=1e-9, abs=1e-9)
    assert maxent_lm.score_documents(empty).count() == 0


def slow_maxent(rows, most, rounds):
    """The model with dictionaries, one choice of one token at a time; returns log10 scores."""
    def hashed(text):
        found, _ = maxent_lm._tokens(pa.array([text], pa.string()))
        return found.tolist()

    tokens = [hashed(t) for _, t, _ in rows]
    fold = [zlib.crc32(str(i).encode()) % 10 for i, _, _ in rows]
    group = [zlib.crc32(lang.encode()) % maxent_lm.GROUPS for _, _, lang in rows]
    counts = Counter(h for ws, f in zip(tokens, fold) if f for h in ws)
    by_group = Counter((h, g) for ws, f, g in zip(tokens, fold, group) if f for h in ws)
    of = {h: max((n, g) for (x, g), n in by_group.items() if x == h)[1] for h in counts}
    head = sorted((h for h in counts if counts[h] >= 2 or h == maxent_lm.END_HASH), key=lambda h: (of[h], -counts[h], h))
    assert len(head) <= most
    tail_n, tail_v = sum(counts.values()) - sum(counts[h] for h in head), len(counts) - len(head)
    place = {h: k + 1 for k, h in enumerate(head)}
    masses = [max(1, tail_n)] + [counts[h] for h in head]
    first, key, near, sign, bias = maxent_lm.choices(np.array(masses, float))
    # Each path's choices again, from the classes: halves of the most equal mass.
    for k in range(len(masses)):
        low, high, path = 0, len(masses), []
        while high - low > 1:
            m = min(range(low + 1, high), key=lambda c: (abs(2 * sum(masses[low:c]) - sum(masses[low:high])), -c))
            right = k >= m
            path.append((1 if right else -1, math.log(sum(masses[m:high]) / sum(masses[low:m]))))
            low, high = (m, high) if right else (low, m)
        assert [(s, pytest.approx(s * b, abs=1e-5)) for s, b in zip(sign[first[k]:first[k + 1]], bias[first[k]:first[k + 1]])] == path
    bits = maxent_lm.table_bits(sum(counts.values()))
    weights = {}

    def walk(ws, sums=None):
        ids = [place.get(h, 0) for h in ws]
        feats = maxent_lm.features(np.array(ids), np.array([0, len(ids)]))
        total = 0.0
        for t, i in enumerate(ids):
            for c in range(first[i], first[i + 1]):
                slots = []
                for f in feats:
                    x = int(f[t]) ^ int(key[c])
                    x = x * 0x9E3779B1 % 2 ** 32
                    x ^= x >> 15
                    x = x * 0x85EBCA77 % 2 ** 32
                    slots.append(((x >> 32 - bits) + int(near[c])) % 2 ** bits)
                z = float(bias[c]) + float(sign[c]) * sum(weights.get(s, 0.0) for s in slots)
                p = 1 / (1 + math.exp(-z))
                total += math.log(p)
                if sums is not None:
                    for s in slots:
                        g, h = sums.get(s, (0.0, 0.0))
                        sums[s] = g + (1 - p) * float(sign[c]), h + p * (1 - p)
        return total

    for k in range(rounds):
        sums = {}
        for ws, f in zip(tokens, fold):
            if f and f % rounds == k:
                walk(ws, sums)
        for s, (g, h) in sums.items():
            weights[s] = weights.get(s, 0.0) + max(-maxent_lm.MOST_STEP, min(maxent_lm.MOST_STEP, g / (maxent_lm.FEATURES * (h + maxent_lm.RIDGE))))
    d = maxent_lm.DISCOUNT
    inside = lambda h: 0.0 if h in place else math.log10((counts[h] - d if counts[h] else d * tail_v) / tail_n)
    return [walk(ws) / math.log(10) + sum(map(inside, ws)) for ws in tokens]


def test_maxent_score_equals_the_slow_model(spark, texts):
    rows = [(i, t[:400], "en" if i % 3 else "fr") for i, t in list(texts.items())[:60]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in maxent_lm.score_documents(frame, most=5000, rounds=3).collect()}
    for (i, _, _), want in zip(rows, slow_maxent(rows, 5000, 3)):
        assert got[i] == pytest.approx(want, rel=2e-3)


def test_maxent_training_uses_all_cores():
    # Of the tables of 0.1 and 0.5 GB; one task trained on the larger before.
    assert [maxent_lm.training_tasks(n, 3, 6) for n in (0, 1, 24_000_000, 121_000_000, 7_000_000_000)] == [1, 1, 2, 6, 6]


def test_maxent_sums_of_frequent_contexts_stay_finite():
    sums = np.zeros(8, np.complex64)
    sums[[1, 2, 5]] = 3e5 + 4e5j, -2.5 + 0.75j, -7e4 + 2e5j
    g, h = np.zeros(8), np.zeros(8)
    for _ in range(2):
        maxent_lm.add_packed(maxent_lm.pack(sums), g, h)
    assert np.allclose(g, 2 * sums.real, rtol=2e-3) and np.allclose(h, 2 * sums.imag, rtol=2e-3)
    small = np.array([0.5 + 0.25j], np.complex64)
    one = np.zeros(1), np.zeros(1)
    maxent_lm.add_packed(maxent_lm.pack(small), *one)
    assert (one[0][0], one[1][0]) == (0.5, 0.25) and maxent_lm.pack(np.zeros(8, np.complex64)) == b""


def test_maxent_training_in_several_tasks_leaves_one_file(spark, documents, monkeypatch):
    docs = documents.limit(200).cache()
    v = maxent_lm.vocabulary(maxent_lm.count_tokens(docs), 500)
    head = spark.sparkContext.broadcast(v)
    encoded = maxent_lm.encode(docs.repartition(4), head).cache()
    alone, bits = maxent_lm.train(encoded, v, head)
    monkeypatch.setattr(maxent_lm, "TASK_TOKENS", 1 + v.n // 12)
    assert maxent_lm.training_tasks(v.n, 3, 4) == 4
    uri, _ = maxent_lm.train(encoded, v, head)
    a, b = (maxent_lm.read_weights(x).astype(float) for x in (alone, uri))
    assert a.any() and np.abs(a - b).max() < 0.05
    fs, path = storage.filesystem(uri.rpartition("/")[0])
    assert [x.base_name for x in fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if x.is_file and not x.base_name.startswith(".")] == ["3.weights"]


def test_token_files_leave_one_table_of_one_file(spark, documents, tmp_path):
    manifest = token_files.write_tokens(documents.repartition(8), str(tmp_path / "out"))
    rows = manifest.orderBy("part").collect()
    assert [r["base"] for r in rows] == [sum(x["n_ids"] for x in rows[:i]) for i in range(len(rows))]
    assert [x.name for x in (tmp_path / "out").iterdir() if x.is_dir()] == ["manifest"]
    assert len(list((tmp_path / "out" / "manifest").glob("*.parquet"))) == 1


def test_a_cut_trims_the_driver(spark, monkeypatch):
    said = []
    real = storage.trim_driver
    monkeypatch.setattr(storage, "trim_driver", lambda s: said.append(real(s)))
    assert storage.cut(spark.range(3), "trimmed").count() == 3 and said == [True]


def plain_walk(paths, weights, bits, places, feats, sums):
    """The walk over choices laid out one after the other."""
    first, key, near, sign, bias = paths
    n = first[places + 1] - first[places]
    at, row = piece_table.ranges(first[places], n), np.repeat(np.arange(len(n)), n)
    slots = []
    for f in feats:
        h = (f[row] ^ key[at]) * np.uint32(0x9E3779B1)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
        slots.append((h.astype(np.int64) + near[at]) & ((1 << bits) - 1))
    x = bias[at] + sign[at] * sum(weights[s].astype(np.float32) for s in slots)
    other = 1 / (1 + np.exp(x))
    for s in slots:
        np.add.at(sums, s, (other * sign[at] + 1j * other * (1 - other)).astype(np.complex64))
    return np.add.reduceat(-np.logaddexp(0, -x.astype(float)), np.cumsum(n) - n)


def test_maxent_walks_rows_of_choices_with_fewer_lookups(monkeypatch):
    """The same numbers as choice by choice.  Lookups cost most of the CPU time: 8 a choice
    before, and in the first round as in others."""
    rng = np.random.default_rng(1)
    counts = rng.zipf(1.3, 30_000).clip(1, 10 ** 6).astype(float)
    paths = maxent_lm.choices(counts)
    v = maxent_lm.Vocabulary(None, None, None, *maxent_lm.laid_out(*paths), 2, 0, 0, 0, 0)
    places = rng.choice(len(counts), 8192, p=counts / counts.sum())
    n = int(np.diff(paths[0])[places].sum())
    feats = [rng.integers(0, 2 ** 32, 8192).astype(np.uint32) for _ in range(maxent_lm.FEATURES)]
    weights = np.clip(rng.normal(size=1 << 16), -6, 6).astype(np.float16)
    weights[::5] = 0
    looked, take = [], np.take
    monkeypatch.setattr(np, "take", lambda a, at, *rest, **more: looked.append(np.size(at)) or take(a, at, *rest, **more))
    for table, most in ((weights, 7.5), (None, 2.5)):
        sums, want_sums = np.zeros(1 << 16, np.complex64), np.zeros(1 << 16, np.complex64)
        want = plain_walk(paths, weights if table is not None else np.zeros_like(weights), 16, places, feats, want_sums)
        looked.clear()
        assert np.allclose(maxent_lm.walk(v, table, 16, places, feats), want, rtol=1e-5, atol=1e-5) and sum(looked) < most * n
        assert maxent_lm.walk(v, table, 16, places, feats, sums) is None and np.allclose(sums, want_sums, rtol=1e-4, atol=1e-4)


def test_maxent_paths_stay_in_few_cache_lines():
    first, key, near, *_ = maxent_lm.choices(np.random.default_rng(2).zipf(1.5, 5000).clip(1, 10 ** 6).astype(float))
    assert sorted(maxent_lm.ORDER) == list(range(2 ** maxent_lm.NEARBY - 1))
    for a, b in zip(first, first[1:]):
        for at in range(a, b, maxent_lm.NEARBY):
            part = near[at: min(b, at + maxent_lm.NEARBY)].astype(int).tolist()
            assert len(set(key[at: at + len(part)])) == 1 and all(other - one in (1, 2) for one, other in zip(part[::2], part[1::2]))


def test_maxent_stores_tail_words_once(spark, awkward, monkeypatch):
    stored = []
    monkeypatch.setattr(maxent_lm, "cut", lambda df, label: stored.append(df.columns) or storage.cut(df, label))
    assert maxent_lm.score_documents(awkward, most=20).count() == len(AWKWARD)
    assert sum("tail" in columns for columns in stored) == 1


def test_maxent_packed_places_are_the_lists(spark, awkward, empty):
    counts = maxent_lm.count_tokens(awkward)
    head = spark.sparkContext.broadcast(maxent_lm.vocabulary(counts, 20))
    lists, packed = (maxent_lm.encode(awkward.coalesce(1), head, packed=p).toArrow().column("ids").combine_chunks() for p in (False, True))
    assert packed.type == pa.binary() and lists.type == pa.list_(pa.int32()) and len(lists)
    for one, other in zip(maxent_lm._places(lists), maxent_lm._places(packed), strict=True):
        assert one.tolist() == other.tolist()
    part = maxent_lm._places(packed.slice(2, 3))
    assert [part[1][a:b].tolist() for a, b in zip(part[0], part[0][1:])] == lists.slice(2, 3).to_pylist()
    assert [x.tolist() for x in maxent_lm._places(packed.slice(0, 0))] == [[0], []]


def test_maxent_sums_to_one(spark, documents):
    counts = maxent_lm.count_tokens(documents)
    rng = np.random.default_rng(0)
    for most in (50, 1 << 17):
        v = maxent_lm.vocabulary(counts, most)
        assert len(v.hashes) <= most + 1 and v.tail_n + v.counts.sum() == v.n
        every = np.arange(len(v.first) - 1)
        weights = rng.normal(size=1 << 16).astype(np.float32)
        for context in rng.integers(0, 2 ** 32, (3, maxent_lm.FEATURES)):
            feats = [np.full(len(every), f, np.uint32) for f in context]
            assert np.exp(maxent_lm.walk(v, weights, 16, every, feats)).sum() == pytest.approx(1, rel=1e-4)


def test_maxent_beats_a_bigram_model(spark):
    """Held-out text against an interpolated bigram model with absolute discount over the same
    words, whose tail costs the same."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    v = maxent_lm.vocabulary(maxent_lm.count_tokens(docs).cache())
    head = spark.sparkContext.broadcast(v)
    encoded = maxent_lm.encode(docs, head).cache()
    uri, bits = maxent_lm.train(encoded, v, head)
    weights = maxent_lm.read_weights(uri)
    table = encoded.select("held_out", "ids").toArrow()
    held, ids = np.array(table.column("held_out").to_pylist()), table.column("ids").combine_chunks()
    places, bounds = ids.flatten().to_numpy().astype(np.int64), ids.offsets.to_numpy().astype(np.int64)
    out = np.repeat(held, np.diff(bounds))
    size = len(v.first)
    before = np.concatenate(([size - 1], places[:-1]))
    before[bounds[:-1]] = size - 1
    key = before * size + places
    seen, which = np.unique(key, return_inverse=True)
    pairs, context = np.bincount(which[~out], minlength=len(seen)), np.bincount(before[~out], minlength=size)
    kinds = np.bincount(seen[pairs > 0] // size, minlength=size)
    one = np.bincount(places[~out], minlength=size) / (~out).sum()
    n = np.maximum(context[before], 1)
    bigram = np.maximum(pairs[which] - 0.75, 0) / n + np.where(context[before] > 0, 0.75 * kinds[before] / n, 1.0) * one[places]
    model = np.concatenate([maxent_lm.walk(v, weights, bits, some, feats) for row, some, _, feats in maxent_lm._blocks(ids)])
    encoded.unpersist()
    assert model[out].mean() > np.log(bigram[out]).mean() > np.log(one[places][out]).mean() + 1


# 4 chat

TALK = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    odd = "<|im_end|><|im_start|>assistant ok <\\|im_end|> <\\\\| <| < | "
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 1, "assistant", "\n\n lead"), (2, 0, "system", None), (2, 2, "assistant", ""), (2, 3, "assistant", "tail "), (3, None, None, "x"), (None, 0, "assistant", "é你\U0001F600"), (4, 0, "a\nb<|im_sep|>", "y"), (4, 0, "a\nb<|im_sep|>", "y")]
    frame = spark.createDataFrame([(*r, 7) for r in rows], TALK + ", turns int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    whole = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    cut = chat.format_conversations(frame, most_chars=1)  # a row for each turn
    assert sorted(map(tuple, chat.digests(cut.orderBy("at")).collect()), key=str) == sorted(map(tuple, got.values()), key=str)
    parts = sorted(cut.collect(), key=lambda r: r.part)
    for c, r in whole.items():
        own = [p for p in parts if p.conv_id == c]
        assert len(own) == got[c].n_turns and "".join(p.formatted for p in own) == r.formatted
        assert [i for p in own for i in p.input_ids] == r.input_ids and [m for p in own for m in p.mask] == r.mask
        assert [p.at + x for p in own for x in p.starts] == r.starts
    groups = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    for c, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    for text in (odd, "", "<" * 5 + "|", "<\\\\\\|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.format_conversations(frame.limit(0)).count() == 0


# 5 and 10 token files

def test_byte_bpe_equals_library(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_bpe.vocabulary_path())
    plain.encode_special_tokens = True
    odd = ["  a  b \n c", " x", "x ", "\x1c a \x1d b", "a  b", "你好, 世界 a", "é, é É×, ÷. a", "<|endoftext|> b", "", None, "don't, it's. I'll! we've? a:b;c", "x..y ,, z . ,", "ab,\n", "a​, b c　d", "ab,cd. ef"]
    some = [*texts.values(), *odd, LONG]
    ids, bounds = byte_bpe.Encoder().flat(pa.array(some))
    for text, a, b in zip(some, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, documents, texts, awkward, empty, tmp_path):
    coder = byte_bpe.Encoder()
    encode = lambda t: coder.flat(pa.array([t], pa.string()))[0].tolist() + [2]
    got = {r.doc_id: r for r in token_files.tokens_on_disk(documents).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = encode(texts[doc_id])
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = f"file://{tmp_path}/set"
    rows = token_files.read_documents(token_files.write_tokens(awkward, path)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in AWKWARD), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert sorted(token_files.fetch(spark, path, 8)) == sorted([encode(AWKWARD[10][1]), encode(AWKWARD[11][1])]) and token_files.fetch(spark, path, 99) == []
    assert token_files.tokens_on_disk(empty).count() == 0


def test_separator_scan(spark, documents, texts, awkward, empty, tmp_path):
    coder = byte_bpe.Encoder()
    for block in (7, 1000, 1 << 20):
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents, block_ids=block).collect()}
        assert got == {i: len(coder.flat(pa.array([t]))[0]) for i, t in texts.items()}
    assert Counter(r.doc_id for r in token_counts.token_counts(awkward, block_ids=50).collect()) == Counter(r[0] for r in AWKWARD)
    assert token_counts.token_counts(empty).count() == 0
    ids = [1, 2, 9, 9, 3, 4, 5, 9, 6, 7]
    path = f"file://{tmp_path}/flat.ids"
    token_counts.write_file(path, [np.array(ids, "<u2").tobytes()])
    files = spark.createDataFrame([(path, len(ids)), ("file:///none", 0)], "uri string, n_ids long")
    for block in range(1, 12):
        rows = token_counts.scan(files, separator=9, block_ids=block).orderBy("ordinal").collect()
        assert [(r.ordinal, r.start, r.n_tokens, r.ended) for r in rows] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, True), (3, 8, 2, False)]


# 6 toxicity

def test_toxicity(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95 and got[got.toxic == 1].predicted.mean() > 0.8
    few = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    for frame, n in ((awkward, len(AWKWARD)), (empty, 0)):
        for marks in (few, few.limit(0)):
            rows = toxicity.toxicity(frame, marks).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
            assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept = toxicity.kept_documents(awkward, few)
    assert kept.columns == awkward.columns and kept.dtypes == awkward.dtypes


def slow_features(text):
    """Feature counts of a text: each word, and its first 5, 6 and 7 bytes, lower-cased."""
    found = Counter()
    own = [w.translate(LOWER).encode() for w in words(text)]
    for k, size in enumerate(toxicity.PREFIXES):
        for w in own:
            part = np.frombuffer(w[:size], np.uint8)
            h = textvec.hash_spans(part, np.array([0]), np.array([len(part)]), False)
            found[int(textvec.mix(h + np.uint64(7919 * k))[0]) >> 64 - toxicity.BITS] += 1
    return {i: math.log1p(c * 200 / max(len(own), 50)) for i, c in found.items()}


def slow_fit(positive, unlabelled, prior, hidden):
    """The clamped risk by dense gradient steps; weights by feature id, and the bias."""
    ids = sorted({i for row in [*positive, *unlabelled] for i in row})
    dense = lambda rows: np.array([[row.get(i, 0.0) for i in ids] for row in rows])
    xp, xu = dense(positive), dense(unlabelled)
    error = np.sqrt((xp.var(axis=0) + 1 / len(xp)) / len(xp) + (xu.var(axis=0) + 1 / len(xu)) / len(xu))
    keep = np.abs(xp.mean(axis=0) - xu.mean(axis=0)) > toxicity.SCREEN * error
    xp, xu, ids = xp[:, keep], xu[:, keep], [i for i, k in zip(ids, keep) if k]
    w, b, m, v = np.zeros(len(ids)), math.log(prior / (1 - prior)), np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, toxicity.STEPS + 1):
        pp, pu = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
        negative = -np.log(1 - pu).mean() + hidden * np.log(1 - pp).mean()
        if negative >= 0:  # the whole risk goes down, else what the negative part has overfitted goes up
            gp, gu = (prior * (pp - 1) - hidden * pp) / len(xp), pu / len(xu)
        else:
            gp, gu = hidden * pp / len(xp), -pu / len(xu)
        g = np.append(xp.T @ gp + xu.T @ gu + toxicity.RIDGE / len(xp) * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = toxicity.RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return dict(zip(ids, w)), b


def test_toxicity_equals_the_slow_model(spark):
    import random

    draw = random.Random(5)
    plain, bad = [f"word{k}" for k in range(40)], ["vile", "Nasty", "grim-é"]
    texts = {i: " ".join(draw.choices(plain, k=30) + (draw.choices(bad, k=6) if i % 3 == 0 else [])) for i in range(150)} | {150: "", 151: None}
    labels = {i: int(i % 3 == 0) for i in range(0, 150, 2)}
    docs = spark.createDataFrame([*texts.items(), (0, texts[0])], "doc_id long, text string")
    marks = spark.createDataFrame([*labels.items(), (3, None)], "doc_id long, toxic int")
    train = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    sure = [i for i in texts if train(i) and labels.get(i) == 1]
    rest = [i for i in texts if train(i) and labels.get(i) != 1]
    seen = [i for i in labels if train(i)]
    n_docs = sum(train(i) for i in [*texts, 0])
    prior = sum(labels[i] for i in seen) / len(seen)
    hidden = prior * (n_docs - len(seen)) / (n_docs - len(sure))
    weights, bias = slow_fit([slow_features(texts[i]) for i in sure], [slow_features(texts[i]) for i in rest], prior, hidden)
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(texts) + 1 and len(weights) > 3
    for r in got:
        want = 1 / (1 + math.exp(-bias - sum(weights.get(i, 0.0) * x for i, x in slow_features(texts[r.doc_id]).items())))
        assert r.score == pytest.approx(want, abs=1e-3) and r.held_out == (not train(r.doc_id))


def test_non_negative_risk_learns():
    rng = np.random.default_rng(1)

    def rows(n, toxic):
        bounds, ids = [0], []
        for _ in range(n):
            own = set(rng.integers(100, 400, 30).tolist()) | ({int(rng.integers(0, 5))} if toxic else set())
            ids += sorted(own)
            bounds.append(len(ids))
        return np.array(bounds), ids

    join = lambda *parts: toxicity.Sparse(np.cumsum([0, *np.concatenate([np.diff(b) for b, _ in parts])]), np.array([i for _, ids in parts for i in ids]), np.ones(sum(len(ids) for _, ids in parts)))
    model = toxicity.non_negative_pu(join(rows(200, True)), join(rows(90, True), rows(810, False)), 0.1, 0.1)
    weights = np.zeros(1 << toxicity.BITS)
    weights[model.ids] = model.weights
    test = join(rows(100, True), rows(100, False)).times(weights) + model.bias
    assert (test[:100] > 0).mean() > 0.95 and (test[100:] > 0).mean() < 0.05


# 7 MinHash

def slow_super_minhash(elements, positions):
    """The sequential form with its histogram and early stop."""
    out, best, histogram, a = [None] * positions, [positions - 1] * positions, [0] * positions, positions - 1
    histogram[positions - 1] = positions
    for e in elements:
        order, j = list(range(positions)), 0
        while j <= a:
            offset, value = minhash._draw(np.array([e], np.uint64), j, positions)
            k = j + int(offset[0])
            order[j], order[k] = order[k], order[j]
            place = order[j]
            if out[place] is None or int(value[0]) < out[place]:
                level = min(best[place], positions - 1)
                out[place] = int(value[0])
                if j < level:
                    histogram[level] -= 1
                    histogram[j] += 1
                    best[place] = j
                    while histogram[a] == 0:
                        a -= 1
            j += 1
    return out


def test_super_minhash_equals_sequential():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64)) for n in (1, 2, 5, 40, 300)]
    bounds = np.cumsum([0, *map(len, sets)])
    got = minhash.super_minhash(np.concatenate(sets), bounds, 16)
    for k, s in enumerate(sets):
        assert got[k].tolist() == slow_super_minhash(s, 16)


def test_super_minhash_estimates():
    rng = np.random.default_rng(4)
    hits = []
    for _ in range(60):
        pool = rng.integers(1, 1 << 62, 120).astype(np.uint64)
        one, other = np.unique(pool[:100]), np.unique(pool[20:])
        s = minhash.super_minhash(np.concatenate((one, other)), np.array([0, len(one), len(one) + len(other)]))
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - 80 / 120) < 0.03


def brute_components(rows, size, percent=80):
    sets, u = {}, UnionFind()
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets.setdefault(i, []).append(frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    flat = [(i, s) for i, group in sets.items() for s in group if s and i is not None]
    for x, (i, s) in enumerate(flat):
        for j, t in flat[:x]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                u.union(i, j)
    return sets, u


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, documents, texts, awkward, empty, size):
    for frame, rows in ((documents, list(texts.items())), (awkward, [(r[0], r[1]) for r in AWKWARD])):
        sets, u = brute_components(rows, size)
        got = minhash.near_duplicates(frame, size, 80).collect()
        assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(s)) for i, group in sets.items() for s in group)
        for r in got:
            assert r.component_id == (None if r.doc_id is None else u.find(r.doc_id)) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert minhash.near_duplicates(empty, size).count() == 0
    kept = minhash.kept_documents(awkward, size)
    assert kept.dtypes == awkward.dtypes and Counter(r.doc_id for r in kept.collect())[None] == 2


def test_hidden_hub(spark):
    """Copies that only their original links, and stragglers that nothing links."""
    import random

    draw = random.Random(7)
    base = [f"w{k}" for k in range(200)]

    def edited(n):
        out = list(base)
        for k in draw.sample(range(200), n):
            out[k] = f"e{draw.random()}"
        return " ".join(out)

    rows = [(k, edited(9)) for k in range(60)] + [(60, " ".join(base))] + [(k, edited(16)) for k in range(61, 80)]
    old = minhash.OUTSIDE_BLOCK, minhash.MEMBER_BLOCK
    minhash.OUTSIDE_BLOCK, minhash.MEMBER_BLOCK = 4, 8
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    finally:
        minhash.OUTSIDE_BLOCK, minhash.MEMBER_BLOCK = old
    _, u = brute_components(rows, 2)
    assert got == {i: u.find(i) for i, _ in rows} and got[30] == 0


def test_components(spark):
    import random

    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, k) for k in range(5001, 5100)]
    u = UnionFind()
    for a, b in edges:
        u.union(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: u.find(i) for e in edges for i in e if e[0] != e[1] or i in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    batches = [pa.record_batch({"a": pa.array([a]), "b": pa.array([b])}) for a, b in edges]
    for most in (1, 50, 1 << 20):
        again = UnionFind()
        for batch in _forest(iter(batches), most):
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                again.union(a, b)
        assert all(again.find(i) == u.find(i) for e in edges for i in e)


# 8 vectors

def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 64))
    rows = [b for b in base]
    for k in range(200):  # cosines from 0.9 upwards
        b = base[k % 20] / np.linalg.norm(base[k % 20])
        w = rng.normal(size=64)
        w -= w @ b * b
        c = rng.uniform(0.9, 1.0)
        rows.append(c * b + math.sqrt(1 - c * c) * w / np.linalg.norm(w))
    rows += [base[0]] * 5 + [base[1] * 3]
    x = np.array(rows, np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    table = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [1.0, None] * 32), (905, [float("inf")] * 64), (906, [1.0] * 3), (None, [1.0] * 64)]
    frame = spark.createDataFrame([*table, *((i, v, None) for i, v in odd)], "vec_id long, embedding array<double>, label int")
    for block in (1024, 16):
        got = {r.vec_id: r for r in pivot_index.near_vectors(frame, block=block).collect()}
        assert len(got) == len(table) + len(odd)
        found = sum(got[k].n_links for k in range(len(x)))
        assert 0.9 * link.sum() <= found <= link.sum() and all(got[k].n_links <= link[k].sum() for k in range(len(x)))
        assert all(got[k].n_links >= 5 for k in (0, len(x) - 2))
        for i, _ in odd:
            assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
        assert got[60].component_id == 0 and not got[60].kept
    assert pivot_index.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3_000, 12_000])
def test_near_vectors_in_a_large_group(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(size, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    group = size // 3  # around one centre, at cosines of about 0.91 to 0.98
    x[:group] = x[0] + np.sqrt(1 / rng.uniform(0.92, 0.98, size=(group, 1)) - 1) * x[1: group + 1]
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x[:group] @ x[:group].T >= 0.9).sum(axis=1) - 1
    frame = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivot_index.near_vectors(frame).collect()}
    found = np.array([got[k] for k in range(group)])
    assert (found <= link).all() and found.sum() >= 0.95 * link.sum()
    pivots = pivot_index.choose_pivots(frame.selectExpr("vec_id id", "embedding v", "size(embedding) dim", "xxhash64(embedding) d1", "0L d2"))[64]
    assert len(pivots) == math.ceil(2 * math.sqrt(size)) and (pivots @ pivots.T - np.eye(len(pivots))).max() < pivot_index.APART


def test_near_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    rows = []
    for dim in (3, 64, 65):  # of each vector a near one and an equal one
        for v in rng.normal(size=(30, dim)):
            rows += [v, v * (1 + 1e-3 * rng.normal(size=dim)), v]
    frame = spark.createDataFrame([(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in pivot_index.near_vectors(frame, block=8).collect()}
    units = [np.float32(v).astype(np.float64) for v in rows]
    units = [v / np.linalg.norm(v) for v in units]
    for i, v in enumerate(units):
        n = sum(len(w) == len(v) and w @ v >= 0.9 for w in units) - 1
        assert 2 <= got[i].n_links <= n and got[i].component_id <= i // 3 * 3
        assert len(v) == 3 or got[i].n_links == n


@pytest.mark.parametrize("pivots, recall", [(45, 0.99), (1000, 0.97), (4096, 0.97), (pivot_index.MOST_PIVOTS, 0.97)])
def test_near_vectors_share_a_pivot(pivots, recall):
    """The chance that a pair of cosine 0.9, the least near that links, meets in a list."""
    rng = np.random.default_rng(pivots)
    scaled = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a, p = scaled(rng.normal(size=(1000, 64))), scaled(rng.normal(size=(pivots, 64)))
    w = rng.normal(size=a.shape)
    b = 0.9 * a + math.sqrt(1 - 0.81) * scaled(w - (w * a).sum(axis=1)[:, None] * a)
    one, other = pivot_index.permutations(a, p), pivot_index.permutations(b, p)
    assert (one[:, :, None] == other[:, None, :]).any(axis=(1, 2)).mean() >= recall


# 9 mixing

def test_mixing(spark, documents, awkward, empty):
    for frame in (documents, awkward):
        rows = mixing.taken_words(frame).collect()
        source = {}
        for r in frame.select("source", "text").collect():
            source[r.source] = source.get(r.source, 0) + len(words(r.text))
        names = sorted((s for s in source if s is not None)) + [None] * (None in source)
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
        rest, target = 1.5 * sum(source.values()), {}
        while True:
            open_ = [s for s in names if s not in target]
            part = sum(weight[s] for s in open_)
            over = [s for s in open_ if weight[s] * rest / part > 2 * source[s]] if part else []
            if not over:
                break
            for s in over:
                target[s] = 2.0 * source[s]
            rest -= sum(target[s] for s in over)
        target |= {s: weight[s] * rest / part for s in names if s not in target}
        assert len(rows) == frame.count() and all(r.taken <= 2 * r.size for r in rows)
        assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted({(source[s], round(target[s], 6)) for s in names})
        assert rows and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.taken_words(frame).collect()), key=str)
    taken = mixing.taken_words(documents).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= max(0.06 * r.target, 3 * mixing.BLOCK_WORDS) for r in taken)
    assert mixing.taken_words(empty).count() == 0


def test_mixing_takes_the_words_of_its_blocks(spark, documents):
    """Every word of every source laid out by hand, and counted as often as its block is taken."""
    size, options = 32, {"block_words": 32, "shard_slots": 64}
    sources, pieces, filled = mixing.mix(documents, **options)
    of = {r.src: r for r in sources.collect()}
    blocks = {s: math.ceil(r.source_size / size) for s, r in of.items()}
    times, by_pass, shards = Counter(), Counter(), Counter()
    for r in filled.collect():
        times[r.src, r.block] += 1
        by_pass[r.src, r["pass"], r.block] += 1
        shards[r.shard] += 1
        assert r.slot // blocks[r.src] == r["pass"]
    assert max(by_pass.values()) == 1 and max(times.values()) <= 2 and max(shards.values()) <= 64
    taken, place = {}, Counter()
    rows = documents.select("doc_id", mixing._source_key(F.col("source")).alias("src"), mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    for r in sorted(mixing.place(rows).collect(), key=lambda r: (r.src, r.bucket, r.seq)):
        taken[r.doc_id] = sum(times[r.src, (place[r.src] + k) // size] for k in range(r.size))
        place[r.src] += r.size
    assert place == Counter({s: r.source_size for s, r in of.items()})
    assert {r.doc_id: r.taken for r in mixing.taken_words(documents, **options).collect()} == taken
    # All slots of a shard drawn: the same means, wider.
    plain = mixing.slots(sources, 64, size, stratified=False).groupBy("src").agg(F.count("*").alias("n")).collect()
    expected = {s: r.target / size for s, r in of.items()}
    assert all(abs(r.n - expected[r.src]) <= 5 * math.sqrt(expected[r.src]) + 2 for r in plain)


def test_mixing_permutation(spark):
    for n in (1, 2, 3, 10, 97):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
        assert sorted(got) == list(range(n))


def test_mixed_documents(spark, documents, awkward, empty):
    for frame in (documents, awkward):
        out = mixing.mixed_documents(frame)
        assert out.dtypes == frame.dtypes
        size = lambda df: Counter({k: n for k, n in ((r.doc_id, r.n) for r in df.collect()) if n})
        got = size(out.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")))
        want = size(mixing.taken_words(frame).groupBy("doc_id").agg(F.sum("taken").alias("n")))
        assert got == want
    full = {r.doc_id: r.text for r in documents.collect()}
    assert any(r.text == full[r.doc_id] for r in mixing.mixed_documents(documents).collect())
    assert mixing.mixed_documents(empty).count() == 0


# pipeline

def test_pipeline(spark, awkward, empty):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality_rules", "minhash_near_dedup", "source_mixing", "sentencepiece_encoding"]
    coder = piece_viterbi.Encoder()
    out = pipeline.run(spark, SF).collect()
    assert out and all(r.n_tokens == len(r.ids) for r in out)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.dtypes == docs.dtypes, name
        if name != "source_mixing":
            assert after.exceptAll(docs).count() == 0
        docs = pipeline.cut(after, "test")
    assert Counter(coder.decode(r.ids) for r in out) == Counter(r.text for r in docs.collect())
    for frame in (awkward, empty):
        for name, stage in pipeline.STAGES:
            frame = pipeline.cut(stage(spark, frame, SF), "test")


def test_pipeline_keeps_columns_of_any_name(spark, awkward):
    import corpus_pipeline as pipeline

    odd = awkward.withColumns({"a b": F.lit(1), "a.b": F.lit("x"), "a`b": F.lit(2.0), "in_row": F.lit(3)})
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, odd, SF)
        assert after.dtypes == odd.dtypes, name
        assert all(r["a b"] == 1 and r["a.b"] == "x" and r["a`b"] == 2.0 for r in pipeline.cut(after, "odd").collect())
    assert pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()
