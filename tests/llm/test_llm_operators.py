"""Small fixtures with nulls, empties, ties, repeats and clashing columns, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quillon.llm import html_text, jaccard_join, maxent_lm, media_jpeg, pfair_mix, pii, piece_bpe, token_orc, topk_mips, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, score double, block long"


def documents(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, f"s{i % 3}" if i is not None and i % 5 else None, len(t or ""), "x", 0.5, 7) for i, t in zip(ids, texts)], SCHEMA)


AWKWARD = [None, "", "   \n ", "one", "two words", "A b c d", "a B c d", "a b c d", "é漢字 ▁ \t x\x00", "word " * 4000, "x" * 3000, "<s> <0x0A> <|endoftext|>", "'s DON'T 1२3"]


def near_brute(texts, n, num, den):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_components_match_brute_force(spark, n, num, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 5 if n == 3 else 16)  # 16: components of one to three are small
    rng = random.Random(n)
    base = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(60)) for _ in range(3)]
    texts = list(AWKWARD)
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(["zz", "yy", "xx"])
            texts.append(" ".join(w))
    docs = documents(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(docs, n, num, 100).collect()}
    assert got == near_brute(list(enumerate(texts)), n, num, 100)


def test_jaccard_empty_table_and_repeated_rows(spark):
    assert jaccard_join.near_components(documents(spark, []).limit(0)).count() == 0
    docs = documents(spark, ["a b c d", "a b c d", None, "q"], [5, 5, 6, None])
    got = jaccard_join.near_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == [(5, 2, 5), (5, 2, 5), (6, 0, 6), (None, 1, None)]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    v = [[float(x) for x in rng.normal(size=8)] for _ in range(300)]
    v[7] = v[8] = v[50]
    bad = [(900, None), (950, [None] * 8), (1000, [float("nan")] * 8), (1050, [float("inf")] * 8), (None, v[0])]
    df = spark.createDataFrame([*[(i, x) for i, x in enumerate(v)], *bad, (3, v[3])], "vec_id long, embedding array<float>")
    q = np.floor(np.array(v, np.float32).astype(float) * 256).astype(np.int64)
    want = []
    for i in range(0, 300, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(order)]
    got = topk_mips.top_k(df).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want
    assert topk_mips.top_k(df.limit(0)).count() == 0


def test_html_structure_and_unique_runs(spark):
    article = '<nav>x</nav><div class="ad">buy</div><article><h1>T &amp; t</h1><p>a\n b<br>c<p class="comment">no</p><p>d</article><footer>f</footer>'
    loose = [f"<div>Home About us here and more menu words of this site</div><p>unique {i} text {i * 7}</p>" for i in range(4)]
    rows = [(1, "http://h/a", article), (2, "http://h/b", None), (3, None, ""), (4, "http://h/c", "<article>cut &am"), *[(10 + i, "http://l/", x) for i, x in enumerate(loose)]]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "T & t\na b c\nd" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].text == "" and got[4].text == "cut &am"
    assert "Home" not in got[11].text and "7" in got[11].text
    assert len(got) == len(rows)


def test_language_model_counts_base_and_sums(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "of", "And", "w%d" % rng.randrange(30)]) for _ in range(rng.randrange(40))) for _ in range(60)] + AWKWARD
    docs = documents(spark, texts)
    from pyspark.sql import functions as F

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    got = {r.doc_id: r for r in maxent_lm.fit_and_score(docs, ~held, ["doc_id"]).collect()}
    count = Counter()
    words = {i: (t or "").encode().lower().split() + [None] for i, t in enumerate(texts)}
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            count.update(w)
    total, v = sum(count.values()), len(count)
    for i, w in words.items():
        base = sum(np.log10((count[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(count[x] > 0 for x in w), total)
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0
    vocab = maxent_lm.vocabulary(maxent_lm.count_words(docs))
    c, w = maxent_lm._start(vocab)
    assert np.exp(c[-1] - np.log(np.exp(c[-1]).sum())).sum() == pytest.approx(1)


def test_pii_spans(spark):
    t = "mail a.b@x.org, 10.0.0.256 10.0.0.25 card 4111 1111 1111 1111, +1 (736) 555-2678; iban DE89 3704 0044 0532 0130 00"
    base, every = pii.all_spans(t)
    assert [k for *_, k in base] == ["email", "ip", "card", "phone"]
    assert [k for *_, k in every][-1] == "iban"
    assert pii.redact("é x@y.z!") == "é [EMAIL]!"
    got = pii.span_digests(documents(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(r.spans == "" for r in got)
    assert [r.text for r in pii.redacted(documents(spark, [None, "", "q"])).orderBy("doc_id").collect()] == [None, "", "q"]


def test_media_round_trip(spark):
    rng = random.Random(2)
    loads = [media_jpeg.payload_bytes(x) for x in (b"", bytes(range(256)) * 3, b"\xff" * 2000, b" " * 4000, bytes(rng.randrange(256) for _ in range(5000)))]
    files = media_jpeg.encode(loads)
    z, lay, n = media_jpeg.coefficients(files)
    assert media_jpeg.payloads_of(z, lay, n) == loads
    assert media_jpeg.encode(loads[1:2]) == files[1:2]
    assert media_jpeg.decode_rgb(files[:1])[0].shape == (16, 32, 3)
    got = media_jpeg.media_digests(media_jpeg.stored_media(documents(spark, AWKWARD))).collect()
    assert sorted(r.payload_bytes % 576 for r in got) == [0] * len(AWKWARD)
    assert len({r.media_sha256 for r in got if r.n_bytes == 0}) == 1


def test_toxicity_learns_and_survives_edges(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice("alpha beta gamma delta eps".split()) for _ in range(40)]
        if i % 4 == 0:
            w[3] = w[9] = "foulword"
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    docs = documents(spark, texts + AWKWARD)
    lab = spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, lab), ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)
    assert len(got) == len(texts) + len(AWKWARD) and all(0 <= s <= 1 for s in got.values())
    none = toxicity.fit(docs, lab.limit(0))
    assert {r.score for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.0}


def test_token_files_match_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    out = f"file://{tmp_path}/orc"
    token_orc.write_token_orc(documents(spark, AWKWARD), path, out, partitions=3)
    got = token_orc.read_token_orc(spark, out).orderBy("doc_id").collect()
    tok, start = Tokenizer.from_file(path), 0
    for r, t in zip(got, AWKWARD, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        start += len(ids)


def test_mixing_deviates_by_less_than_a_block(spark):
    for weights, blocks in [([1, 2, 5], [40, 10, 7]), ([3, 3], [1, 9]), ([1000], [3]), ([7, 1, 1, 1], [2, 0, 5, 5])]:
        phases, slots = pfair_mix.schedule(weights, blocks)
        assert sum(r[3] - r[2] for r in phases) == sum(blocks)
        by = defaultdict(dict)
        for phase, s, j, at, release, deadline in slots:
            assert release <= at < deadline
            by[phase][at] = s
        for phase, order in by.items():
            live = {s for s in order.values()}
            total = sum(weights[s] for s in live)
            seen = Counter()
            for t in range(total):
                seen[order[t]] += 1
                assert all(abs(seen[s] - (t + 1) * weights[s] / total) < 1 for s in live)
    docs = documents(spark, AWKWARD * 3, list(range(3 * len(AWKWARD))))
    got = pfair_mix.mixed(docs, block_rows=2).collect()
    assert sorted(r.doc_id for r in got) == list(range(3 * len(AWKWARD)))
    assert len({(r.slot, r.place) for r in got}) == len(got)
    assert sorted(r.doc_id for r in pfair_mix.in_mixed_order(docs).collect()) == list(range(3 * len(AWKWARD)))


def test_pieces_match_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = piece_bpe.PieceModel(open(path, "rb").read())
    rng = random.Random(4)
    texts = [t or "" for t in AWKWARD] + ["".join(rng.choice("ab cd\n é漢▁<s>  ") for _ in range(rng.randrange(30))) for _ in range(2000)]
    for t in texts:
        ids = sp.encode(t)
        assert model.encode(t) == ids
        assert model.decode(ids) == sp.decode(ids)
    for _ in range(500):
        ids = [rng.randrange(3, 32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(8)]
        assert model.decode(ids) == sp.decode(ids)
    got = piece_bpe.encode_texts(documents(spark, AWKWARD), path).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [sp.encode(t or "") for t in AWKWARD]
