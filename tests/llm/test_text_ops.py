"""Line dedup, token counts, BPE, token files and language ID against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from verdigris.llm import bpe_codec, language_id, line_dedup, token_count, token_file
from verdigris.llm.bpe_units import FastEncoder, Units, read_spec
from verdigris.llm.cuckoo import CuckooFilter

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(n=3000, seed=4):
    rng = random.Random(seed)
    alphabet = [*"abAB12'! \n\t\r\x1c\x85\xa0é́Σİ½日\U0001f642<|aaa", "<|endoftext|>", "'s", "'LL", "  "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def expected_lines(pairs, least):
    where = {}
    cut = [(t or "").split("\n") for _, t in pairs]
    key = lambda line: line.encode().lower().strip(b" \t\n\x0b\x0c\r")
    for i, lines in enumerate(cut):
        for k in {key(x) for x in lines}:
            where.setdefault(k, set()).add(i)
    gone = {k for k, v in where.items() if k and len(v) >= least}
    return sorted([(d, "\n".join(x for x in lines if key(x) not in gone), len(lines), sum(key(x) in gone for x in lines)) for (d, _), lines in zip(pairs, cut, strict=True)], key=str)


def test_line_dedup_paths_agree_with_brute_force(docs, none):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    for least in (1, 2, 5):
        index = line_dedup.LineIndex.build(docs, least)
        want = expected_lines(pairs, least)
        for limit in (64 << 20, 40, 0):  # exact keys near, filters near, filters routed
            got = index.drop(docs, broadcast_bytes=limit)
            assert rows(got.select("doc_id", "text", "n_lines", "n_dropped")) == want
            assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_index_is_reversible(spark, docs):
    base = line_dedup.LineIndex.build(docs, 3)
    more = spark.createDataFrame([(20 + i, f"End\nnew {i}\nonly here") for i in range(4)], "doc_id long, text string")
    grown = base.insert(more)
    whole = docs.select("doc_id", "text").unionByName(more)
    assert rows(grown.drop(whole)) == rows(line_dedup.LineIndex.build(whole, 3).drop(whole))
    assert len(grown.levels) == 2 and grown.levels[0] is base.levels[0]  # what was there is not written again
    back = grown.delete(more)
    assert rows(back.counts) == rows(base.counts)
    assert rows(back.drop(docs)) == rows(base.drop(docs))
    with pytest.raises(ValueError):  # all of its lines are there, the document is not
        back.delete(spark.createDataFrame([(1, "End\nshared line")], "doc_id long, text string"))
    with pytest.raises(ValueError):
        back.delete(more)


def test_levels_are_merged_and_filters_grow(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEVELS", 2)
    parts = [spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(40 * k + 40))) for i in range(2)], "doc_id long, text string") for k in range(3)]
    index, whole = line_dedup.LineIndex.build(parts[0], 3), parts[0]
    for more in parts[1:]:
        index, whole = index.insert(more), whole.unionByName(more)
    assert len(index.levels) == 1 and rows(index.counts) == rows(line_dedup.LineIndex.build(whole, 3).counts)
    assert rows(index.drop(whole)) == rows(line_dedup.LineIndex.build(whole, 3).drop(whole))


def test_filters_are_asked_at_any_size(spark, docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "ROUTED", 3)  # many groups to a shard
    index = line_dedup.LineIndex.build(docs, 2)
    full = rows(index.drop(docs, broadcast_bytes=0).select("doc_id", "text", "n_dropped"))
    assert full == rows(index.drop(docs).select("doc_id", "text", "n_dropped")) and any(r[2] for r in full)
    index.filters = index.filters.where("false")  # no filter lets a key through
    for limit in (64 << 20, 0, -1):
        assert all(r.n_dropped == 0 for r in index.drop(docs, broadcast_bytes=limit).collect())


def test_cuckoo_filter_holds_all_and_forgets_deleted():
    k = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, (5000, 2))
    f = CuckooFilter.of(k[:, 0].copy(), k[:, 1].copy())
    assert f.contains(k[:, 0].copy(), k[:, 1].copy()).all()
    other = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, (20000, 2))
    assert f.contains(other[:, 0].copy(), other[:, 1].copy()).mean() < 0.002
    f.delete(k[:2500, 0].copy(), k[:2500, 1].copy())
    assert f.contains(k[2500:, 0].copy(), k[2500:, 1].copy()).all() and f.contains(k[:2500, 0].copy(), k[:2500, 1].copy()).mean() < 0.01


def test_token_counts_equal_the_library(spark, docs, none):
    t = library(WORD)
    texts = odd_texts()
    assert token_count.Counter(read_spec(WORD)).count(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    got = rows(token_count.count_tokens(docs, WORD))
    want = sorted([(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()], key=str)
    assert got == want
    assert token_count.count_tokens(none, WORD).collect() == []


def test_files_of_another_form_are_counted_by_the_library():
    t, texts = library(BYTE), odd_texts(200)
    assert token_count.Counter(read_spec(WORD)).model is not None
    assert token_count.Counter(read_spec(BYTE)).count(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_rank_synchronous_merges_overlap_left_to_right():
    vocab = {s: i for i, s in enumerate(token_count.byte_symbols())} | {"aa": 300, "aaa": 301, "aaaa": 302}
    m = token_count.Model({"vocab": vocab, "merges": [["a", "a"], ["aa", "aa"], ["aa", "a"]]})
    assert token_count.merge_counts([b"a" * n for n in (0, 1, 2, 3, 4, 5, 7, 9)], m).tolist() == [0, 1, 1, 1, 1, 2, 2, 3]


def test_units_and_fast_encoder_equal_the_library():
    spec, t, texts = read_spec(BYTE), library(BYTE), odd_texts(seed=5)
    units, fast = Units(spec), FastEncoder(spec)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert fast.core is not None and [fast.ids(x).tolist() for x in texts] == want
    assert [[i for ids in units.encode(units.units(x)) for i in ids] for x in texts] == want
    assert all("".join(units.units(x)) == x for x in texts)


def test_bpe_round_trip_equals_the_library(docs, none, monkeypatch):
    t = library(BYTE)
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe_codec.encode_decode(docs, BYTE).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe_codec.encode_decode(none, BYTE).collect() == []
    pieces = bpe_codec.Pieces(read_spec(BYTE))
    broken = np.array([t.encode("é", add_special_tokens=False).ids[0], 50256, 5], np.uint32)
    for ids in (broken, np.array([222, 96, 64], np.uint32)):
        assert pieces.decode(ids) == t.decode(ids.tolist(), skip_special_tokens=False)


def test_token_files_give_back_every_token(docs, none):
    t = library(BYTE)
    table = token_file.write_tokens(docs, BYTE)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_file.read_tokens(table).collect()]
    coded = []
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        coded.append((r.doc_id is not None, r.doc_id or 0, xxhash.xxh3_64_intdigest(np.array(ids, "<u2").tobytes()) >> 1, r.doc_id, ids))
    want, start, flat = [], 0, []
    for _, _, _, doc, ids in sorted(coded, key=lambda c: c[:3]):
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        flat += ids
    assert sorted(got, key=lambda x: x[1]) == want
    assert [token_file.token_at(table, i) for i in (0, 1, len(flat) // 2, len(flat) - 1)] == [flat[i] for i in (0, 1, len(flat) // 2, len(flat) - 1)]
    for out in (-1, len(flat)):
        with pytest.raises(IndexError):
            token_file.token_at(table, out)
    assert token_file.read_tokens(token_file.write_tokens(none, BYTE)).collect() == []


def test_one_token_is_read_without_decoding_others(spark, monkeypatch):
    monkeypatch.setattr(token_file, "SEGMENT_TOKENS", 50)
    df = spark.createDataFrame([(i, "word " * (i % 30)) for i in range(200)] + [(7, "same id")] * 40, "doc_id long, text string")
    table = token_file.write_tokens(df, BYTE)
    flat = [x for r in sorted(token_file.read_tokens(table).collect(), key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()]
    assert table.count() > 50 and len(flat) == table.agg({"tokens": "sum"}).first()[0]
    monkeypatch.setattr(token_file.Segment, "ids", None)  # no segment is decoded
    assert [token_file.token_at(table, i) for i in range(0, len(flat), 499)] == flat[::499]


@pytest.mark.parametrize("n", [1_000_000, 10_000_000])
def test_very_long_white_space_equals_the_library(spark, n):
    t, fast = library(BYTE), FastEncoder(read_spec(BYTE))
    blanks = [" " * n]
    if n == 1_000_000:
        blanks += ["\n" * n, "a" + " " * n + "b c", "a \t" + "\t \n" * (n // 3) + "<|endoftext|> x" + " " * n + "é" + "\u3000" * n]
    for text in blanks:
        assert fast.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids
    if n == 1_000_000:
        df = spark.createDataFrame(list(enumerate(blanks)), "doc_id long, text string")
        assert all(r.decoded == blanks[r.doc_id] and r.n_tokens == len(fast.ids(r.decoded)) for r in bpe_codec.encode_decode(df, BYTE).collect())
        assert sum(r.n_tokens for r in token_file.read_tokens(token_file.write_tokens(df, BYTE)).collect()) == sum(1 + len(fast.ids(x)) for x in blanks)


def test_segment_random_access_and_damage():
    ids = [np.random.default_rng(i).integers(0, 2**k, n).astype(np.uint32) for i, (n, k) in enumerate([(0, 1), (1, 8), (5, 16), (3000, 16), (700, 31), (600, 7)])]
    data = token_file.write_segment([5, None, 7, 8, 9, 10], ids)
    s, flat = token_file.Segment(data), np.concatenate(ids)
    assert (s.ids() == flat).all() and all(s.token(i) == flat[i] for i in range(0, len(flat), 7))
    assert [(d, len(x)) for d, _, x in s.documents()] == [(5, 0), (None, 1), (7, 5), (8, 3000), (9, 700), (10, 600)]
    with pytest.raises(ValueError):
        token_file.Segment(data[:50] + b"\xff" + data[51:])
    with pytest.raises(IndexError):
        s.token(len(flat))


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    lengths, k = np.array([1, 5, 64, 65, 200, 130, 700]), 3
    scores, t, s0 = rng.normal(size=(lengths.sum(), k)).astype(np.float32) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
    got, at = language_id.forward_backward(scores, lengths, t, s0), 0
    for n in lengths:
        e, a, b = np.exp(scores[at : at + n].astype(float)), np.zeros((n, k)), np.ones((n, k))
        for i in range(n):
            a[i] = (np.exp(s0) if i == 0 else a[i - 1] @ np.exp(t)) * e[i]
            a[i] /= a[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = np.exp(t) @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        g = a * b
        assert np.abs(g / g.sum(axis=1, keepdims=True) - got[at : at + n]).max() < 1e-5
        at += n


def test_training_takes_whole_texts_whatever_the_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "train", lambda pieces: seen.extend(pieces))
    long = " ".join(f"w{chr(97 + i % 26)}" for i in range(700)) + " end"
    rows = [(None, "un deux trois", "fr"), (None, "un deux trois", "fr"), (None, "eins zwei", "de"), (7, "vier", "de"), (7, "fünf", "de"), (8, None, "de"), (9, "x", None), (10, long, "en")]
    df = spark.createDataFrame([*rows, *[(None, f"six {i}", "fr") for i in range(300)]], "doc_id long, text string, lang string").repartition(4)
    language_id.learn(df, rows=20)
    assert {lang: sum(x == lang for x, _ in seen) for lang in ("de", "fr")} == {"de": 3, "fr": 20}
    assert [w for x, ws in seen if x == "en" for w in ws] == language_id.words_of(long)


def test_language_and_score_equal_a_slow_crf(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    model = language_id.learn(d)

    def emission(word):
        out = np.zeros(len(model.langs))
        for n in (2, 3, 4):
            padded = "\n" + word + "\n"
            for i in range(len(padded) - n + 1):
                if n < 4 or i == 0 or i == len(padded) - n:
                    code = np.uint64(ord(padded[i]))
                    for c in padded[i + 1 : i + n]:
                        code = code * np.uint64(1_000_003) + np.uint64(ord(c))
                    out += model.weights[language_id.mix(np.array([code + np.uint64(n)]))[0]]
        whole = np.uint64(0)
        for place, c in enumerate("\n" + word + "\n"):
            whole += np.uint64(ord(c) + 1) * np.uint64(place * place + 40_503) * np.uint64(2_654_435_761)
        out += model.weights[language_id.mix(np.array([whole + np.uint64(7)]))[0]]
        return out + sum(model.lexicon_weights[i] * (model.lexicon.get(word, 0) >> i & 1) for i in range(len(model.langs)))

    texts = [t for t in (r.text for r in d.collect()) if t and len(t) < 4000][:12]
    got = list(zip(*model.label(texts), strict=True))
    for text, (lang, score) in zip(texts, got, strict=True):
        e = np.array([emission(w) for w in language_id.words_of(text)])
        a, b, t = np.zeros_like(e), np.ones_like(e), np.exp(model.transitions.astype(float))
        e = np.exp(e - e.max(axis=1, keepdims=True))
        for i in range(len(e)):
            a[i] = (np.exp(model.start) if i == 0 else a[i - 1] @ t) * e[i]
            a[i] /= a[i].sum()
        for i in range(len(e) - 2, -1, -1):
            b[i] = t @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        mean = (a * b / (a * b).sum(axis=1, keepdims=True)).mean(axis=0)
        assert lang == model.langs[int(mean.argmax())] and score == pytest.approx(mean.max(), abs=1e-3)


@pytest.mark.parametrize("k", [2, 3, 4])
def test_words_without_a_language_are_dropped_for_any_number_of_languages(spark, k):
    zero = lambda *n: np.zeros(n, np.float32)
    model = language_id.Crf([f"l{i}" for i in range(k)], zero(language_id.BUCKETS, k), {"here": 1}, zero(k, k), zero(k, k), zero(k))
    model.lexicon_weights[0, 0] = 20
    docs = spark.createDataFrame([(1, "even words"), (2, "here here"), (3, "12")], "doc_id long, text string")
    assert [r.doc_id for r in language_id.keep_identified(docs, model).collect()] == [2]


def test_language_id_labels_switches_and_held_out_documents(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(d.where(~language_id.held_out()))
    got = language_id.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    one = {r.lang: r.text for r in d.where("length(text) > 400 and doc_id % 5 = 2").collect()}
    switched = language_id.words_of(one["en"])[:40] + language_id.words_of(one["es"])[:40]
    table = model.emissions(switched)
    labels = language_id.forward_backward(table, np.array([80]), model.transitions, model.start).argmax(axis=1)
    assert (labels[:35] == model.langs.index("en")).mean() > 0.9 and (labels[45:] == model.langs.index("es")).mean() > 0.9
    odd = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (7, "und", 0.0)} <= odd
    assert language_id.learn(docs).langs == ["de", "en", "es"]  # a language needs words; null and repeated ids train as well
    assert language_id.predict(none, model).collect() == [] and language_id.learn(none) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {3, 4, 7} & {r.doc_id for r in kept.collect()} == set()


def test_queries_hash_what_operators_return(spark):
    got = {r.doc_id: r for r in bpe_codec.query(spark, "/root/testdata/sf0.001").collect()}
    t = library(BYTE)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
