"""The classifiers on held-out rows, quotation linking against planted threads, and the pipeline against brute force."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from flowloom.llm import quality_cnn, quote_chat, toxicity_gru
from flowloom.llm.queries import op1_quality_cnn, op4_toxicity_gru, tokenizer_file
from tests.llm.test_bulk import ODD, brute_components, documents


def numeric_gradient(loss, x, k, eps=1e-2):
    flat = x.reshape(-1)
    was, out = flat[k], []
    for d in (eps, -eps):
        flat[k] = was + d
        out.append(loss())
    flat[k] = was
    return (out[0] - out[1]) / (2 * eps)


def check_gradients(model, grads, loss, names):
    rng = np.random.default_rng(2)
    for name in names:
        for k in rng.choice(np.flatnonzero(np.abs(grads[name]).reshape(-1) > 1e-3), 3) if (np.abs(grads[name]) > 1e-3).any() else []:
            assert abs(numeric_gradient(loss, model.p[name], k) - grads[name].reshape(-1)[k]) < 0.05 * abs(grads[name].reshape(-1)[k]) + 2e-3, name


def log_loss(p, y):
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def test_cnn_gradients():
    m, texts, y = quality_cnn.ByteCNN(), pa.array(["some words here", "###" * 200, "", "more of it " * 90]), np.array([1, 0, 1, 0], np.float32)
    m.p["w2"][:] = np.linspace(-1, 1, len(m.p["w2"]))
    check_gradients(m, m._gradients(texts, y), lambda: log_loss(m.score(texts).astype(float), y), ["w1", "w2", "b1", "b2", "bias", "filters"])


def test_gru_gradients():
    m = toxicity_gru.WindowGRU()
    buckets, _, at, spans = m.tokens(pa.array(["a bad word stands here", "nothing of the kind in this longer line " * 2, ""]))
    odds, y = np.random.default_rng(0).normal(0, 1, buckets.shape).astype(np.float32), np.array([1, 0, 1], np.float32)
    which, upto = m.windows(at)
    chosen = which[upto[:-1]]

    def loss():
        x, w, _ = m._window_inputs(chosen, odds, spans)
        return log_loss(1 / (1 + np.exp(-m._forward(x, w)[0].astype(float))), y)

    check_gradients(m, m._gradients(chosen, odds, spans, y), loss, ["out", "att", "wxf", "whf", "wxb", "whb", "cf", "chars"])


def test_scores_cover_whole_texts():
    clean, m = "these are plain words of a text " * 400, toxicity_gru.WindowGRU()
    texts = [f"plain words stand here number {i} and go on" for i in range(60)] + [f"plain words you idiot number {i} and go on" for i in range(60)]
    m.fit(texts, np.repeat([0, 1], 60).astype(np.float32), prior=0.5)
    low, high, none = m.score(pa.array([clean, f"{clean} you idiot {clean}", None]))
    assert high > 0.5 > low and 0 <= none <= 1
    q = quality_cnn.ByteCNN().fit(["plain text of words " * 20, "*** $$$ ### %%% " * 20] * 40, np.tile([1, 0], 40).astype(np.float32))
    good, bad, late, empty = q.score(pa.array(["plain text of words " * 300, "*** $$$ ### %%% " * 300, "plain text of words " * 300 + "*** $$$ ### %%% " * 300, ""]))
    assert good > 0.7 > 0.3 > bad and late < good and 0 <= empty <= 1


def test_models_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, label, least in ((op1_quality_cnn, "quality", 0.9), (op4_toxicity_gru, "toxic", 0.85)):
        rows = query(spark, sf).collect()
        assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
        held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
        assert sum(r["predicted"] == labels[r["doc_id"]][label] for r in held) / len(held) >= least


def test_fits_do_not_depend_on_files(spark, tmp_path):
    src = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{src}/documents.parquet"), spark.read.parquet(f"{src}/labels.parquet")
    seen = {}
    for files in (1, 3, 7):
        path = f"{tmp_path}/{files}"
        docs.repartition(files).write.parquet(f"{path}/documents.parquet")
        labels.repartition(files).write.parquet(f"{path}/labels.parquet")
        for query in (op1_quality_cnn, op4_toxicity_gru):
            scores = {r["doc_id"]: r["score"] for r in query(spark, path).collect()}
            first = seen.setdefault(query.__name__, scores)
            assert max(abs(scores[k] - first[k]) for k in first) <= 1e-5, (query.__name__, files)


def test_scores_against_a_plain_version():
    """Both networks, text by text and step by step."""
    rng, texts = np.random.default_rng(8), ["", "You utter fool, stop it! " * 9, "Plain words that go on and on. " * 40, "é ü ñ", "###" * 300]
    g = toxicity_gru.WindowGRU(3)
    g.odds = rng.normal(0, 1, g.odds.shape).astype(np.float32)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def plain_gru(text):
        buckets, chars, at, _ = g.tokens(pa.array([text]))
        x = [np.concatenate((g.odds[np.arange(len(b)), b], c)) for b, c in zip(buckets.T, chars, strict=True)]
        n, half, best = len(x), toxicity_gru.WINDOW // 2, -np.inf
        for w in range(max(1, -(-(n - half) // half))):
            own = [x[i] if (i := w * half + t) < n else np.zeros(toxicity_gru.INPUTS) for t in range(toxicity_gru.WINDOW)]
            states = []
            for d, order in (("f", range(16)), ("b", range(15, -1, -1))):
                h, out = np.zeros(toxicity_gru.HIDDEN), {}
                for t in order:
                    a, u = own[t] @ g.p[f"wx{d}"] + g.p[f"c{d}"], h @ g.p[f"wh{d}"]
                    z, r = sig(a[:8] + u[:8]), sig(a[8:16] + u[8:16])
                    new = np.tanh(a[16:] + r * u[16:])
                    h = out[t] = (1 - z) * new + z * h
                states.append(out)
            s = np.array([np.concatenate((states[0][t], states[1][t])) for t in range(16)])
            e = np.exp(3 * np.tanh(s @ g.p["att"]))
            best = max(best, float((e / e.sum()) @ s @ g.p["out"] + g.p["bias"][0]))
        return sig(best)

    q = quality_cnn.ByteCNN(3)
    q.p["w2"] = rng.normal(0, 1, len(q.p["w2"])).astype(np.float32)

    def plain_cnn(text):
        b, size = text.encode(), quality_cnn.BLOCK
        blocks = -(-(len(b) + 8) // size)
        padded = np.frombuffer(b + bytes(blocks * size - len(b) + 8), np.uint8)
        seen = np.array([[q.p["embed"][padded[i : i + 8]].ravel() @ q.p["filters"] for i in range(k * size, (k + 1) * size, 2)] for k in range(blocks)]).max(axis=1)
        chunks = np.array([np.maximum(seen[2 * c : 2 * c + 4].max(axis=0) + q.p["bias"], 0) for c in range(max(1, -(-(blocks - 2) // 2)))])
        h = np.tanh(np.concatenate((chunks.mean(axis=0), chunks.max(axis=0))) @ q.p["w1"] + q.p["b1"])
        return sig(h @ q.p["w2"] + q.p["b2"][0])

    for model, plain in ((g, plain_gru), (q, plain_cnn)):
        assert np.allclose(model.score(pa.array(texts)), [plain(t) for t in texts], atol=2e-4), plain.__name__


def test_models_of_odd_and_no_rows(spark, tmp_path):
    for k, texts in enumerate((ODD, [])):
        path = documents(spark, texts, tmp_path / str(k))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        for query in (op1_quality_cnn, op4_toxicity_gru):
            assert [r["score"] for r in query(spark, path).collect()] == [0.5] * len(texts)


FIRST = "Shall we meet on Monday?\n\nThe room by the lake is free all day, and so am I."
THREAD = [
    ("c", 0, "user", FIRST),
    ("c", 1, "assistant", "> Shall we meet on Monday?\n\nYes, gladly."),
    ("c", 2, "user", "On Monday Ann wrote:\n> The room by the lake is free\n> all day, and so am I.\n\nThen I bring the food."),
    ("c", 3, "assistant", ">> Shall we meet on Monday?\n> Yes, gladly.\n\nGood to hear from you."),
    ("c", 4, "user", "A new matter: who has the key?"),
    ("c", 5, None, "> who said this? nobody here did\nI don't know."),
    ("d", 0, "user", "> Then I bring the food.\nNice."),
    ("e", None, "user", "> Yes, gladly.\nno turn"),
    (None, 0, "user", None),
]


def test_parsing():
    own, passages = quote_chat.parse("Hi\nOn Monday Ann wrote:\n> a\n>> b\n> > c\n\nrest\n> d")
    assert own == "Hi\n\nrest" and passages == [(1, ["a"]), (2, ["b", "c"]), (1, ["d"])]
    assert quote_chat.parse(None) == ("", []) and quote_chat.parse("> \n>") == ("", [])


def test_threads(spark):
    parsed = quote_chat.parse_messages(spark.createDataFrame(THREAD, "conv_id string, turn long, role string, text string").coalesce(1))
    turn = {r["row"]: (r["conv"], r["turn"]) for r in parsed.collect()}
    links = quote_chat.link_replies(parsed)
    got = {turn[r["row"]]: (turn[r["parent"]], r["outside"]) for r in links.collect()}
    assert got == {("c", 1): (("c", 0), False), ("c", 2): (("c", 0), False), ("c", 3): (("c", 1), False), ("d", 0): (("c", 2), True)}
    depth = {turn[r["row"]]: (turn[r["root"]], r["depth"]) for r in quote_chat.thread_places(links).collect()}
    assert depth == {("c", 1): (("c", 0), 1), ("c", 2): (("c", 0), 1), ("c", 3): (("c", 0), 2)}


def test_chats(spark):
    rows = quote_chat.chats(spark.createDataFrame(THREAD, "conv_id string, turn long, role string, text string"), size=4).collect()
    c = {r["part"]: r for r in rows if r["conv"] == "c"}
    assert (c[0]["n_messages"], c[1]["n_messages"], c[0]["n_replies"]) == (4, 2, 3)
    assert c[0]["chat"].startswith(f"<|user|>\n{FIRST}\n<|assistant|>\nYes, gladly.\n<|user|>\nThen I bring the food.\n") and ">" not in c[0]["chat"].replace("|>", "")
    assert sorted((str(r["conv"]), r["n_messages"]) for r in rows if r["conv"] != "c") == [("None", 1), ("d", 1), ("e", 1)]
    assert quote_chat.chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_long_chain_and_a_common_passage(spark):
    chain = [("long", i, "user", (f"> message number {i - 1} says this and more\n" if i else "") + f"message number {i} says this and more") for i in range(70)]
    same = [("same", i, "user", "> the very same words again\nthe very same words again") for i in range(70)]
    parsed = quote_chat.parse_messages(spark.createDataFrame(chain + same, "conv_id string, turn long, role string, text string"))
    links = quote_chat.link_replies(parsed)
    depth = {r["depth"] for r in quote_chat.thread_places(links).collect()}
    assert links.count() == 138 and max(depth) == 69
    rows = quote_chat.chats(spark.createDataFrame(chain + same, "conv_id string, turn long, role string, text string"), size=70)
    (long,) = [r["chat"] for r in rows.collect() if r["conv"] == "long"]
    assert long == "".join(f"<|user|>\nmessage number {i} says this and more\n" for i in range(70))


def plain_chats(rows, size):
    """The chats of (conv, turn, role, text) with distinct turns in a conversation, message by message."""
    parsed = [(c, t, role or "user", *quote_chat.parse(x)) for c, t, role, x in rows]
    key = lambda c: "0" if c is None else "1" + c
    holds = {}
    for k, (c, t, _, own, _) in enumerate(parsed):
        for h in quote_chat.own_hashes(own) if t is not None else []:
            here = holds.setdefault(h, {})
            here[key(c)] = min(here.get(key(c), (t, k)), (t, k))
    parent = {}
    for k, (c, t, _, _, passages) in enumerate(parsed):
        found = []
        for q in quote_chat.quote_hashes(passages) if t is not None else []:
            by_conv = holds.get(q["hash"], {})
            near = by_conv.get(key(c))
            if near and near[0] < t:
                found.append((False, q["level"], q["kind"], -near[0], near[1]))
            elif far := [by_conv[x] for x in sorted(by_conv)[:2] if x != key(c)]:
                found.append((True, q["level"], q["kind"], float("-inf"), far[0][1]))
        if found:
            parent[k] = min(found)

    def place(k):
        if k not in parent or parent[k][0]:
            return k, 0
        root, depth = place(parent[k][4])
        return root, depth + 1

    out = []
    for c in {p[0] for p in parsed}:
        own = [k for k, p in enumerate(parsed) if p[0] == c]
        none = lambda t: (t is not None, t or 0)
        own.sort(key=lambda k: (none(parsed[place(k)[0]][1]), place(k)[0], place(k)[1], none(parsed[k][1])))
        for lo in range(0, len(own), size):
            part = own[lo : lo + size]
            out.append((c, lo // size, len(part), sum(k in parent for k in part), sum(parent[k][0] for k in part if k in parent), "".join(f"<|{parsed[k][2]}|>\n{parsed[k][3]}\n" for k in part)))
    return sorted(out, key=str)


def chats_of(spark, rows, size):
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").coalesce(1)
    return sorted((tuple(r) for r in quote_chat.chats(df, size=size).collect()), key=str)


def test_chats_against_a_plain_version(spark):
    rng = np.random.default_rng(6)
    lines = [f"sentence number {i} stands here. It goes on." if i % 3 else f"short {i}" for i in range(25)]
    rows = []
    for c in (None, "", "a", "b", "c"):
        for t in rng.permutation(30).tolist():
            own = [lines[i] for i in rng.integers(0, 25, rng.integers(0, 3))]
            quoted = [">" * int(rng.integers(1, 3)) + " " + lines[i] for i in rng.integers(0, 25, rng.integers(0, 4))]
            rows.append((c, t if t else None, [None, "user", "assistant"][t % 3], "\n".join(quoted + own)))
    assert chats_of(spark, rows, 8) == plain_chats(rows, 8)


def test_chats_of_the_conversations(spark, sf):
    rows = [(str(r["conv_id"]), r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    assert chats_of(spark, rows, 64) == plain_chats(rows, 64)


def test_pipeline(spark, sf):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        tables.append([r.asDict() for r in now.collect()])
    kept, exact, near, mixed, coded = tables
    assert all(set(t[0]) == set(docs.columns) for t in tables[:-1])
    first = {}
    for r in sorted(kept, key=lambda r: r["doc_id"]):
        first.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(first.values())
    order = sorted(exact, key=lambda r: r["doc_id"])
    roots = {order[i]["doc_id"] for _, i in brute_components([r["text"] for r in order], corpus_pipeline.NEAR_PERCENT)}
    assert {r["doc_id"] for r in near} == roots and len(near) == len(roots)
    assert {r["doc_id"] for r in mixed} <= roots and len(coded) == len(mixed)
    texts = {r["doc_id"]: r["text"] for r in near}
    assert all(list(r["ids"]) == lib.encode(texts[r["doc_id"]]) for r in coded)
    assert corpus_pipeline.run(spark, sf).count() == len(coded)


def test_stages_of_odd_and_no_rows(spark, tmp_path):
    """Null and empty texts, repeated rows, further columns with clashing names, and empty tables, each stage called alone."""
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, long, "en", "a", 9, "x", 1), (1, long, "en", "a", 9, "x", 1), (2, long.upper(), None, "a", 9, None, 2), (None, None, None, None, None, None, None), (3, "", "en", "b", 0, "y", 3), (4, long + " end", "en", None, 9, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, near string, ids int")
    want = {"quality rules": 3,  # the text in capitals stands alone
             "exact dedup": 3, "near dedup": 3, "encoding": 6}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert name == "encoding" or out.columns == docs.columns
        got = out.collect()
        assert name not in want or len(got) == want[name], name
        assert name != "encoding" or [list(r["ids"]) for r in got if r["doc_id"] in (None, 3)] == [[], []]
        assert stage(spark, docs.limit(0), "").count() == 0


def test_stages_remove_what_earlier_ones_left(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    left = list(corpus_pipeline._left)
    assert left and corpus_pipeline.exact(spark, kept, sf).count() > 0 and set(left) <= set(corpus_pipeline._left)  # kept is still read
    kept.write.parquet(f"{tmp_path}/kept")
    again = corpus_pipeline.exact(spark, spark.read.parquet(f"{tmp_path}/kept"), sf)
    assert not set(left) & set(corpus_pipeline._left) and again.count() > 0
