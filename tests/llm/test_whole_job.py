"""Cases of which an earlier version did only a part."""

import math

import numpy as np

import corpus_pipeline
from flowloom.llm import minhash_dedup, quality_cnn, quote_chat


def similar(other: int) -> list[str]:
    """Two texts of 100 shingles each, of which `other` differ."""
    words = [f"w{i}" for i in range(104)]
    return [" ".join(words), " ".join(words[:-other] + [f"x{i}" for i in range(other)])]


def test_near_stage_drops_from_eighty_percent(spark):
    texts = [*similar(10), *(t.replace("w", "v") for t in similar(12))]  # 90/110 = 0.818 and 88/112 = 0.786
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()) == [0, 2, 3]
    assert minhash_dedup.drop_near_copies(docs).count() == 4


SHORT = [
    ("a", 0, "user", "Can you come?\nBring the report."),
    ("a", 1, "user", "> Can you come?\nYes."),
    ("a", 2, "user", "> Bring the report.\n> Can you come?\nI will."),
    ("b", 0, "user", "The first one is here. Take two of them! Then go on; nothing else is left.\n「一つ。二つ。」"),
    ("b", 1, "user", "> take two\n> of them!\nDone."),
    ("b", 2, "user", "> Take two of them! Then go on;\n> nothing else is left.\nDone as well."),
    ("b", 3, "user", "> 二つ。」\nはい"),
    ("b", 4, "user", "> Take three of them!\nNobody said so."),
    ("c", 0, "user", "Well.\nThis line is long enough to tell."),
    ("c", 1, "user", "Yes, of course.\nWe can."),
    ("c", 2, "user", "> Yes, of course.\n> and a word\n> This line is long enough to tell.\nThe long line goes first."),
]


def test_short_lines_and_sentences_find_their_message(spark):
    parsed = quote_chat.parse_messages(spark.createDataFrame(SHORT, "conv_id string, turn long, role string, text string"))
    turn = {r["row"]: (r["conv"], r["turn"]) for r in parsed.collect()}
    got = {turn[r["row"]]: turn[r["parent"]] for r in quote_chat.link_replies(parsed).where("NOT outside").collect()}
    assert got == {("a", 1): ("a", 0), ("a", 2): ("a", 0), ("b", 1): ("b", 0), ("b", 2): ("b", 0), ("b", 3): ("b", 0), ("c", 2): ("c", 0)}


def test_signatures_lose_next_to_no_pair():
    for percent in (80, 85, 95):
        t, least = percent / 100, minhash_dedup.least_agreeing(percent)
        lost = sum(math.comb(128, k) * t**k * (1 - t) ** (128 - k) for k in range(least))
        assert lost <= 1e-13


def test_the_original_lies_in_the_second_conversation(spark):
    rows = [("a", 0, "user", "> the passage in question\nFirst."), ("a", 1, "user", "the passage in question"), ("b", 0, "user", "the passage in question"), ("c", 0, "user", "> the passage in question\nThird.")]
    parsed = quote_chat.parse_messages(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    turn = {r["row"]: (r["conv"], r["turn"]) for r in parsed.collect()}
    got = {turn[r["row"]]: (turn[r["parent"]], r["outside"]) for r in quote_chat.link_replies(parsed).collect()}
    assert got == {("a", 0): (("b", 0), True), ("c", 0): (("a", 1), True)}


def test_filters_see_the_text_after_a_step():
    m, rng = quality_cnn.ByteCNN(), np.random.default_rng(4)
    padded = rng.integers(1, 256, 3 * 512 * quality_cnn.BLOCK + 5 * quality_cnn.BLOCK).astype(np.uint8)
    assert np.allclose(m._maxima(padded), m._responses(padded).max(axis=1), atol=1e-4)
