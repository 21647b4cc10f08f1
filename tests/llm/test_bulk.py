"""Operators over bulk bytes against the libraries and against brute force."""

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.llm import bytescan, minhash_dedup, piece_lattice, token_wavelet
from flowloom.llm.queries import op2_token_wavelet, op3_piece_lattice, op6_minhash_dedup, tokenizer_file

ODD = ["", None, " ", "\n\n", "a", "a  b\t c\n\n d  ", "é  x", "　 y  z", "日本語のテキスト です", "▁▁ under ▁x", "<|endoftext|> a <s> b", "x" * 300, "=" * 200 + " tail", "word " * 400, "ab\r\nc\x1c d", "🙂🙂 ok", "Ünïcode, don't 'll 123 4567"]
def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


# words of which a hash that is linear modulo 2^64 can't tell one from its complement
TWINS = [x for n in (1024, 2048) for t in (thue_morse(n),) for x in (t, t.translate(str.maketrans("ab", "ba")))]
ODD += [*TWINS, *(f"{t} one two three four" for t in TWINS), "tok" * 4000, "=" * 9000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_follow_words(monkeypatch):
    texts = pa.array(ODD + ["alpha beta", "beta alpha", None, "gamma" * 50])
    seen = {}
    for size in (1 << 20, 16):
        b, at = bytescan.text_bytes(texts)
        monkeypatch.setattr(bytescan.segments, "__defaults__", (size,))
        h, begins = bytescan.word_hashes(b, at)
        assert np.diff(begins).tolist() == [len(words(t)) for t in texts.to_pylist()]
        flat = [w for t in texts.to_pylist() for w in words(t)]
        for w, x in zip(flat, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [0, 1, 64, 1000])
def test_wavelet_matrix(n):
    a = np.random.default_rng(1).integers(0, 300, n)
    a[n // 2 :] = 7
    m = token_wavelet.WaveletMatrix.build(a, 9)
    assert m.all().tolist() == a.tolist() and m.access(np.arange(n)).tolist() == a.tolist()
    for t in (0, 7, 299, 511, 600):
        assert m.occurrences(t).tolist() == np.flatnonzero(a == t).tolist()
        assert m.count(t) == (a == t).sum() and m.count(t, n // 4, n // 3) == (a[n // 4 : n // 3] == t).sum()


def expected_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def check_tokens(rows, texts):
    start = 0
    for r, ids in zip(sorted(rows, key=lambda r: r["doc_id"]), expected_ids(texts), strict=True):
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_tokens_of_odd_texts(spark, tmp_path):
    check_tokens(op2_token_wavelet(spark, documents(spark, ODD, tmp_path)).collect(), ODD)


def test_tokens_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    check_tokens(op2_token_wavelet(spark, sf).collect(), [d["text"] for d in docs])


def test_tokens_small_segments(monkeypatch):
    monkeypatch.setattr(bytescan.segments, "__defaults__", (40,))
    code = token_wavelet.PieceEncoder(tokenizer_file("byte_bpe_50k.json"))
    found, n = code.encode(pa.array(ODD))
    assert found.tolist() == [t for x in expected_ids(ODD) for t in x[:-1]] and n.tolist() == [len(x) - 1 for x in expected_ids(ODD)]


def test_tokens_of_no_documents(spark, tmp_path):
    assert op2_token_wavelet(spark, documents(spark, [], tmp_path)).count() == 0


@pytest.mark.parametrize("frequent", [0, 50, 100_000])
def test_pieces_equal_the_library(spark, sf, frequent):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").select("doc_id", "text").union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    coded, ids = piece_lattice.encode(docs, model, frequent=frequent)
    for r in coded.withColumn("back", piece_lattice.decode(model)(F.col(ids))).collect():
        assert list(r[ids]) == lib.encode(r["text"] or ""), r["text"]
        assert r["back"] == lib.decode(list(r[ids]))


def test_piece_query(spark, tmp_path):
    rows = op3_piece_lattice(spark, documents(spark, ODD, tmp_path)).collect()
    assert len(rows) == len(ODD) and all(r["round_trip"] for r in rows)
    empty = tmp_path / "none"
    assert op3_piece_lattice(spark, documents(spark, [], empty)).count() == 0


def test_viterbi_against_brute_force(spark):
    pieces = piece_lattice.Pieces(tokenizer_file("piece_bpe_32k.model"))
    pieces.normal = [("a", 10, -2.0), ("b", 11, -2.5), ("ab", 12, -3.0), ("ba", 13, -4.2), ("aba", 14, -5.5), ("bb", 15, -4.0)]
    pieces.longest, pieces.unigram = 3, True
    score = {p: (s, i) for p, i, s in pieces.normal}

    @functools.cache
    def best(w):
        return min(((0.0, ()),) if not w else ((-score[w[:k]][0] + c, (score[w[:k]][1], *r)) for k in range(1, min(3, len(w)) + 1) if w[:k] in score for c, r in [best(w[k:])]))

    sample = ["a", "ab", "aba", "abba", "bbaab", "abababba", "abba" * 30]
    coded = piece_lattice.encode_words(spark.createDataFrame([(w,) for w in sample], "word string"), pieces).collect()
    for r in coded:
        assert sum(-s for p, i, s in pieces.normal for x in r["ids"] if x == i) == pytest.approx(best(r["word"])[0])
    assert len(coded) == len(sample)


def brute_components(texts, percent=85):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts():
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 60)]
    out = list(ODD) + ["One two THREE", "one two three", "one two"]
    for _ in range(60):  # a chain of short near copies of which the first isn't like the last
        base = list(base)
        base[rng.integers(0, 60)] = f"x{rng.integers(0, 9)}"
        out.append(" ".join(base))
    for n in (50, 100, 200):
        long = [f"v{i}" for i in rng.integers(0, 900, n)]
        out += [" ".join(long), " ".join(long).upper(), " ".join([*long[:-2], "e", "f"]), " ".join([*long[: n // 2], "m", *long[n // 2 :]])]
    return out


def test_near_copies_against_brute_force(spark, tmp_path):
    texts = near_texts()
    rows = op6_minhash_dedup(spark, documents(spark, texts, tmp_path)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == brute_components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_copies_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    rows = op6_minhash_dedup(spark, sf).orderBy("doc_id").collect()
    want = brute_components([d["text"] for d in docs])
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == [(n, docs[i]["doc_id"]) for n, i in want]


def test_near_filter_keeps_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "A b c d e f g", None), (None, None, "y"), (3, "other words stand here now", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near string")
    kept = minhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert minhash_dedup.drop_near_copies(docs.limit(0)).count() == 0


def test_kinds_differ_by_bytes(monkeypatch):
    monkeypatch.setattr(bytescan, "span_hashes", lambda b, s, e: (e - s).astype(np.uint64) % 3)
    texts = ODD[:20] + ["one two one six six two ten"]
    code = token_wavelet.PieceEncoder(tokenizer_file("byte_bpe_50k.json"))
    for _ in range(2):  # the second time from the cache
        found, n = code.encode(pa.array(texts))
        assert found.tolist() == [t for x in expected_ids(texts) for t in x[:-1]]
    words = pa.array(["ab", "ba", "abc", "cba"])
    known = piece_lattice.Dictionary(words, pa.array([[1], [2], [3], [4]], pa.list_(pa.int32())))
    b = np.frombuffer(b"abbaabccba", np.uint8)
    s, e = np.array([0, 2, 4, 7]), np.array([2, 4, 7, 10])
    at = known.find(bytescan.span_hashes(b, s, e), b, s, e)
    assert at.tolist() == [1, -1, 0, -1] and known.flat[known.first[at[:1]]].tolist() == [1]


def test_linear_collisions_are_none():
    hashes = {int(bytescan.span_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in [*TWINS, *(t[:256] for t in TWINS[:2])]}
    assert len(hashes) == len(TWINS) + 2
