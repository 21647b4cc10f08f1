import random

import pyarrow as pa

from flowloom.llm import piece_lattice, token_wavelet
from flowloom.llm.queries import op3_piece_lattice, tokenizer_file
from tests.llm.test_bulk import ODD


def test_pieces_are_decoded_by_the_worker_that_encodes(spark, sf):
    plan = op3_piece_lattice(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_texts_of_any_ids():
    surface = piece_lattice.Pieces(tokenizer_file("piece_bpe_32k.model")).surface
    r = random.Random(7)
    lists = [None if r.random() < 0.1 else [r.randrange(300 if r.random() < 0.3 else len(surface)) for _ in range(r.choice((0, 1, 2, 40)))] for _ in range(500)]
    plain = [None if x is None else b"".join(surface[i] for i in x)[1:].decode(errors="replace") for x in lists]
    known = [k for k, (x, t) in enumerate(zip(lists, plain, strict=True)) if x is None or "�" not in t]
    assert any("�" in (t or "") for t in plain)
    for some in (range(len(lists)), known, []):
        ids = pa.array([lists[k] for k in some], pa.list_(pa.int32()))
        assert piece_lattice._Surface(surface).texts(ids).to_pylist() == [plain[k] for k in some]
        assert piece_lattice._Surface(surface).texts(ids[3:]).to_pylist() == [plain[k] for k in some][3:]


class Counted:
    """A tokenizer that counts the texts it encodes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch(texts, **options)


def test_new_pieces_are_encoded_in_rows():
    r = random.Random(3)
    signs = [" ", " ", "  ", "\n", "\t ", "\x1c", "\x85", "\xa0", "\u3000", "\u2009", "'s", "'", "ll", "é", "ß", "日本", "😀", "<|endoftext|>", "a", "Bc", "7", "42", "...", ","]
    texts = list(ODD) + ["".join(r.choices(signs, k=r.randrange(60))) for _ in range(2000)]
    plain = ["".join(r.choices("abcdefgh", k=5)) for _ in range(20_000)]
    path = tokenizer_file("byte_bpe_50k.json")
    for odd in (False, True):
        code = token_wavelet.PieceEncoder(path)
        lib, code.tokenizer = code.tokenizer, Counted(code.tokenizer)
        if odd:  # a vocabulary whose tokens' bytes aren't known
            code.bytes[:] = 2
        for some in (texts, [" ".join(plain)]):
            tokens, n = code.encode(pa.array(some, pa.string()))
            want = [lib.encode(t or "", add_special_tokens=False).ids for t in some]
            assert n.tolist() == [len(x) for x in want] and tokens.tolist() == [i for x in want for i in x]
        before = code.tokenizer.texts
        code.encode(pa.array([" ".join(x + "z" for x in plain)]))
        assert (code.tokenizer.texts - before > 10_000) == odd
