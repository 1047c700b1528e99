"""Nulls, empty tables, repeated rows, clashing columns and long texts, for operators and stages, against brute force."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import _util as U
from quillon.llm import html_text, jaccard_join, maxent_lm, media_jpeg, pfair_mix, pii, piece_bpe, token_orc, topk_mips, toxicity

from test_llm_operators import AWKWARD, SCHEMA, documents

WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def pii_brute(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_pii_agrees_with_the_patterns(spark):
    rng = random.Random(5)
    bits = list("ab1290.@+-() %_é\n") + ["10.0.0.1", "a.b@c.de", "4111 1111 1111 1111", "+1 (736) 555-2678", "@x.y", "256.1.1.1", "token = "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    got = {r.doc_id: r for r in pii.span_digests(documents(spark, texts + AWKWARD)).collect()}
    for i, t in enumerate(texts):
        want = pii_brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(w.startswith(k) for w in want) for k in pii.BASE_KINDS]
        assert set(want) <= set(filter(None, got[i].spans.split(",")))


def test_pii_added_kinds_need_validator_and_context():
    kinds = lambda t: [k for *_, k in pii.all_spans(t)[1]]
    assert kinds('x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y') == ["secret"]
    assert kinds("04dbebab91ab85687d33eeaaf9ac699e1188f962 is the commit") == []
    assert kinds("0123456789abcdef is our password") == ["secret"]
    assert kinds("token aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1") == []
    assert kinds("ssn 219-09-9999") == ["national_id"] and kinds("ssn 666-09-9999") == [] and kinds("219-09-9999") == []
    assert kinds("call 212-555-0182") == ["local_phone"] and kinds("call 112-555-0182") == []


def test_digests_of_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(6)
    texts = [*AWKWARD, *("".join(rng.choice("abcstdvreLM 's't'rl019!<|>é\u00c9ß\u0301д中 \n") for _ in range(rng.randrange(60))) for _ in range(400))]
    out = f"file://{tmp_path}/orc"
    docs = documents(spark, [*texts, "again", "again"], [*range(len(texts)), 3, None])
    token_orc.write_token_orc(docs, WORD_BPE, out, partitions=3)
    got = token_orc.ids_crc(token_orc.read_token_orc(spark, out)).collect()
    assert len(got) == len(texts) + 2
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))) in by[i]
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_token_files_prune_by_id(spark, tmp_path):
    import pyarrow.orc as orc

    out = f"{tmp_path}/orc"
    token_orc.write_token_orc(documents(spark, ["a b c"] * 50), WORD_BPE, f"file://{out}", partitions=4)
    rows = token_orc.read_token_orc(spark, f"file://{out}").where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in rows._jdf.queryExecution().toString().replace("`", "")
    assert rows.count() == 1
    files = [f for f in __import__("os").listdir(out) if f.endswith(".orc")]
    assert len(files) == 4 and all(orc.ORCFile(f"{out}/{f}").nstripes == 1 for f in files)


def test_a_long_text_is_encoded_in_stretches(monkeypatch):
    from tokenizers import Tokenizer
    import numpy as np

    text = " ".join(f"Wörd{i}'s x{i % 7}" for i in range(3000))
    data = open(WORD_BPE, encoding="utf-8").read()
    monkeypatch.setattr(token_orc, "SLICE_BYTES", 1000)
    raw = (text + "\n").encode()
    ids, n = token_orc.ChunkEncoder(data).encode(np.frombuffer(raw, np.uint8), np.array([len(raw) - 1]))
    assert ids.tolist() == Tokenizer.from_str(data).encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]


def test_piece_digests(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    texts = [*AWKWARD, "q" * 5000, "long unbroken" * 400, "dup", "dup"]
    for r in piece_bpe.encode_digests(documents(spark, texts), PIECE_BPE).collect():
        ids = sp.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_every_operator_takes_an_empty_table(spark, tmp_path):
    docs = documents(spark, ["x"]).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 0
    assert maxent_lm.fit_and_score(docs, F.lit(True), ["doc_id"]).count() == 0
    assert pii.span_digests(docs).count() == pii.redacted(docs).count() == 0
    assert media_jpeg.media_digests(media_jpeg.stored_media(docs)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")), ["doc_id"]).count() == 0
    token_orc.write_token_orc(docs, WORD_BPE, f"file://{tmp_path}/e", partitions=2)
    assert pfair_mix.mixed(docs).count() == pfair_mix.in_mixed_order(docs).count() == 0
    assert piece_bpe.encode_digests(docs, PIECE_BPE).count() == piece_bpe.encode_texts(docs, PIECE_BPE).count() == 0


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, _slot long, _place int, _id long, _file string, position long, component_id long, _hash_ long, _stays boolean, text_hash long"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_clashing_columns_nulls_repeats_and_no_rows(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    texts = [*AWKWARD, "same words in both of these rows", "same words in both of these rows", "mail a@b.cd"]
    ids = [*range(len(AWKWARD)), 100, 100, None]
    rows = [(i, t, None, None if (i or 0) % 4 else "s", len(t or ""), 0.9, 3, 4, 5, "f", 6, 7, 8, True, 9) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, CLASH)
    out = stage(spark, docs, sf)
    n = out.count()
    if name == "pieces":
        assert n == len(rows)
    else:
        assert out.columns == docs.columns
        if name in ("personal_data", "mix_sources"):
            assert n == len(rows)
        if name == "near_duplicates":  # "A b c d", "a B c d", "a b c d" and the repeated row go to one each
            assert n == len(rows) - 3
            assert {r.doc_id for r in out.collect()} >= {0, 1, 2, 100}
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b = "one two three four five six seven eight", "other words that make a longer line here"
    docs = documents(spark, [a, b, a, a, None, None, b], [7, 7, 7, 3, 3, 3, None])
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.first_of_each(docs, 5, 80, 100).collect()), key=str)
    assert got == sorted([(3, a), (7, b), (3, None), (3, None)], key=str)


def test_common_counts_in_column_blocks(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 25)).astype(np.uint64) for _ in range(9)]
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    want = [[len(np.intersect1d(x, y)) if i != j else None for j, y in enumerate(rows)] for i, x in enumerate(rows)]
    got = jaccard_join._common(rows)
    assert all(want[i][j] is None or got[i, j] == want[i][j] for i in range(9) for j in range(9))


def test_repeated_mixing_places(spark):
    docs = documents(spark, ["a", "b", "a", "c"], [4, 4, 4, 5])
    first = [tuple(r) for r in pfair_mix.in_mixed_order(docs).select("doc_id", "text").collect()]
    again = [tuple(r) for r in pfair_mix.in_mixed_order(docs.repartition(3)).select("doc_id", "text").collect()]
    assert sorted(first) == sorted(again) and len(first) == 4


def test_spans_cover_every_row():
    import pyarrow as pa

    col = pa.array(["a" * 5, None, "", "b" * 50, "c", "d"])
    got = list(U.spans(col, 8))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(6)) and (3, 4) in got
    assert list(U.spans(pa.array([], pa.string()))) == []


def test_top_k_counts_an_id_with_many_vectors_once(spark):
    hot = [(7, [10.0, 0.1 * i]) for i in range(9)]  # nine different long vectors of one id
    df = spark.createDataFrame([(50, [1.0, 0.0]), *hot, *[(i, [1.0 + i / 100, 0.0]) for i in range(100, 106)]], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id) for r in topk_mips.top_k(df, k=5).where("query_id = 50").orderBy("rank").collect()]
    assert got == [(1, 7), (2, 105), (3, 104), (4, 103), (5, 102)]


def test_language_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "SHARD_BYTES", 4_000)
    monkeypatch.setattr(maxent_lm, "COMMON", 40)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(80)}"]) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + AWKWARD
    docs = documents(spark, texts)
    got = [{r.doc_id: tuple(r) for r in maxent_lm.fit_and_score(docs.repartition(n), F.col("doc_id") % 10 != 0, ["doc_id"]).collect()} for n in (2, 7)]
    assert got[0] == got[1] and len(got[0]) == len(texts)


def test_language_model_scores_by_hand(spark):
    import numpy as np

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(900)}"]) for _ in range(60)) for _ in range(60)]
    docs = documents(spark, texts)
    counts = maxent_lm.count_words(docs)
    m = maxent_lm.train(docs, maxent_lm.vocabulary(counts))
    c = counts.toPandas()
    words = c["h"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, n = words[order], c["c"].to_numpy()[order]
    got = maxent_lm.log10_scores(m, [t.encode() for t in texts[:3]], words, n)[3]
    of = dict(zip(words.tolist(), n.tolist()))
    v = m.vocabulary
    head = dict(zip(v.head.tolist(), zip(v.head_class.tolist(), v.head_place.tolist())))
    for i, t in enumerate(texts[:3]):
        row, h, tail = maxent_lm.sequence([t.encode()])
        one, two = maxent_lm.contexts(row, h)
        total = 0.0
        for j in range(len(h)):
            cls, spot = head.get(int(h[j]), (maxent_lm.HEAD_CLASSES + int(tail[j]), -1))
            z = sum(m.by_class[r[0]].astype(float) for r in maxent_lm.class_rows(one[j : j + 1], two[j : j + 1]))
            total += z[cls] - np.log(np.exp(z).sum())
            if spot >= 0:
                z = sum(m.by_word[r[0]].astype(float) for r in maxent_lm.word_rows(one[j : j + 1], np.array([cls])))
                total += z[spot] - np.log(np.exp(z).sum())
            else:
                k = cls - maxent_lm.HEAD_CLASSES
                total += np.log((of.get(int(h[j]), 0) + 0.1) / (v.tail_total[k] + 0.1 * (v.tail_distinct[k] + 1)))
        assert got[i] == pytest.approx(total / np.log(10), rel=1e-4)


@pytest.mark.parametrize("big", [1.0, 30_000.0])
def test_top_k_in_small_blocks_with_unequal_lengths(spark, monkeypatch, big):
    import numpy as np

    for name, value in {"HEAD": 16, "BLOCK": 40, "QUERIES": 3, "BANDS": 6, "STEP": 8}.items():
        monkeypatch.setattr(topk_mips, name, value)
    rng = np.random.default_rng(11)
    v = [[float(x) * big * (1 + i % 7) for x in rng.normal(size=3 + i % 4) - 0.4] for i in range(420)]
    v[60] = v[61] = v[100]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    whole = [[int(np.floor(x * 256)) for x in row] for row in v]
    want = []
    for i in range(0, 420, 50):
        scored = sorted((-sum(a * b for a, b in zip(whole[i], w)), j) for j, w in enumerate(whole) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    got = topk_mips.top_k(df).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want
