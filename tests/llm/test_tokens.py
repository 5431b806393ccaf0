"""Tokenizers, token files, packing and rollups against the libraries and plain Python."""

from __future__ import annotations

import copy
import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from clickloom.llm import bitpack, licenses, packing, queries, sp_codec, text_ids, token_rollup
from clickloom.llm.shared import sliced
from clickloom.llm.text_ids import encoder

SF = "/root/testdata/sf0.001"
SP, BYTE, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = [*" \n\t ab'sé1.!\x1c　́日😀<|>\x00▁tßÀ×µΣσ᠎​\x85 Kİ", "the", "ing", "    ", "abc"]


def _texts(odd):
    rng = np.random.default_rng(4)
    fixed = ["  a  b \n\n c\t\td  ", "it's we'll  'd x", " \n \n", "\x85  x", "日本語 テキスト\n", "👩‍👩‍👧 x", "a" * 500 + " b", "ab" * 80, " " * 60]
    return [r["text"] or "" for r in odd.select("text").collect()] + fixed + ["".join(rng.choice(ALPHABET, 40)) for _ in range(800)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")


def _library(path):
    own = Tokenizer.from_file(path)
    return lambda t: own.encode(t, add_special_tokens=False).ids


ADDED = ["<|endoftext|>", "<|startoftext|>"]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_text_encoder(odd, path, monkeypatch):
    rng = np.random.default_rng(5)
    texts = _texts(odd) + ["".join(rng.choice([*ALPHABET, *ADDED, "<|end", "'ll", "’", "œ", "ſ", "²", "ª", "\xa0", "\u2009"], n)) for n in rng.integers(1, 60, 1500)]
    texts += [f"a {x} b" for x in ADDED] + [x * 2 + "b" + x for x in ADDED] + ["<|endoftext|><|startoftext|> ", " x <|endoftext|>  <|endoftext|>\n"]
    whole = _library(path)
    encode, want = encoder(path), [whole(t) for t in texts]
    assert encode.short is not None
    assert [x.tolist() for x in encode(texts)] == want
    monkeypatch.setattr("clickloom.llm.text_ids._CACHED", 50)  # starts anew all the time
    monkeypatch.setattr("clickloom.llm.text_ids._SEGMENT", 7)
    for _ in range(2):
        assert [x.tolist() for x in encode(texts)] == want
    assert list(encode([])) == []


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_plain_characters_are_of_the_library_s_classes(path):
    """Every plain character beside letters, digits, blanks and marks: the parting is the library's."""
    plain = [chr(c) for c in range(0x2100) if text_ids._PLAIN(chr(c))]
    texts = [f"ab{c}cd {c}{c} 1{c}2{c}. {c}" for c in plain]
    whole = _library(path)
    assert [x.tolist() for x in encoder(path)(texts)] == [whole(t) for t in texts]


def test_other_vocabularies_go_to_the_library(tmp_path):
    other = Tokenizer.from_file(BYTE)
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    own = encoder(str(tmp_path / "other.json"))
    assert own.short is None and own.encode("some words <|endoftext|>").tolist() == other.encode("some words <|endoftext|>", add_special_tokens=False).ids


BIG = [(None, "a b"), ((1 << 60) + 1, "c <|endoftext|> d"), ((1 << 60) + 3, "mit license"), (5, None)]


def test_ids_are_exact(spark, tmp_path):
    """A null beside ids that no double holds, in one batch."""
    docs = spark.createDataFrame(BIG, "doc_id long, text string").coalesce(1)
    bitpack.write_tokens(docs, str(tmp_path / "t"), WORDS, 49_408, 2)
    found = [sp_codec.round_trip(docs, SP), bitpack.read_tokens(spark, str(tmp_path / "t")), packing.pack(docs, BYTE), licenses.scan(docs)]
    for df in found:
        assert Counter(r["id"] for r in df.collect()) == Counter(i for i, _ in BIG)
    assert {r["doc_id"] for r in token_rollup.count_tokens(docs, BYTE, "v").collect()} == {i for i, _ in BIG}


def test_batches_make_no_difference(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    key, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    for n in ("7", "10000"):
        spark.conf.set(key, n)
        found.append(sorted(map(tuple, packing.pack(docs, BYTE).collect())))
    spark.conf.set(key, before)
    assert found[0] == found[1]


def test_slices():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (3, 0, 50, 1, 1, 1)] + [None], "n": range(7)})
    parts = list(sliced([batch], most=10))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and len(parts) == 2
    assert list(sliced([batch.slice(0, 0)])) == []


def test_sentencepiece(odd):
    texts, library, own = _texts(odd) + ["▁▁ a ▁", "aaaaaaaaaaaaaaaaaaaa"], sentencepiece.SentencePieceProcessor(model_file=SP), sp_codec.codec(SP)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == [*library.encode(text), library.eos_id()]
        assert own.decode(ids) == library.decode(ids.tolist())
        assert own.decimals(ids).decode() == " ".join(map(str, ids))
    rng = np.random.default_rng(6)
    for k in range(300):
        ids = rng.integers(0, 32_000 if k % 2 else 300, 12)
        assert own.decode(ids) == library.decode(ids.tolist())


def test_merges_one_by_one_agree(odd):
    v = sp_codec.codec(SP).vocabulary
    rng = np.random.default_rng(8)
    symbols = v.char_symbols[rng.integers(0, len(v.char_symbols), 4000)]
    word = np.sort(rng.integers(0, 300, 4000))
    a, b = v.merge(symbols.copy(), word.copy()), v.merge(symbols.copy(), word.copy(), one=True)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


@pytest.mark.parametrize("least", [2, 10])
def test_merges_by_rank_agree(monkeypatch, least):
    monkeypatch.setattr(sp_codec, "_LONG_WORD", least)
    v = sp_codec.codec(SP).vocabulary
    rng = np.random.default_rng(9)
    for symbols in (v.char_symbols[rng.integers(0, len(v.char_symbols), 6000)], v.char_symbols[np.searchsorted(v.chars, rng.choice([ord(c) for c in "aeinrst"], 6000))]):
        word = np.sort(rng.integers(0, 200, 6000))
        a, b = v.merge(symbols.copy(), word.copy()), v.merge(symbols.copy(), word.copy(), one=True)
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_order_of_merges_that_matters():
    """abc is a piece by a + bc, which ranks before ab: ab + c must win at once, before the next ab is merged."""
    v = copy.copy(sp_codec.codec(SP).vocabulary)
    a, b, c, ab, bc, abc, abca = range(7)
    found = sorted([(a << 32 | b, 5, ab), (ab << 32 | c, 2, abc), (abc << 32 | a, 1, abca)])
    v.pairs, v.rank, v.whole = (np.array(x, np.int64) for x in zip(*found, strict=True))
    v.known = {}
    symbols, word = np.array([a, b, c, a, b, c, a, b] * 50), np.zeros(400, np.int64)
    want = v.merge(symbols.copy(), word, one=True)[0].tolist()
    assert want[:4] == [abca, b, c, ab]
    assert v.merge(symbols[:8].copy(), word[:8])[0].tolist() == v.merge(symbols[:8].copy(), word[:8], one=True)[0].tolist() and v.merge(symbols.copy(), word)[0].tolist() == want


def test_long_unbroken_texts():
    """Exact, and in time that grows about as the text does."""
    library, own = sentencepiece.SentencePieceProcessor(model_file=SP), sp_codec.codec(SP)
    rng = np.random.default_rng(10)
    took = []
    for n in (50_000, 400_000):
        text = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), n))
        began = time.process_time()
        (ids,) = own.encode([text])
        took.append(time.process_time() - began)
        assert ids.tolist() == [*library.encode(text), library.eos_id()]
    assert took[1] < 24 * took[0]


def test_op2(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = {r["doc_id"]: r for r in queries.op2_sentencepiece(spark, SF).collect()}
    for i, text in zip(documents["doc_id"], documents["text"], strict=True):
        ids = library.encode(text, add_eos=True)
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_op6(spark, documents):
    whole, at = _library(WORDS), 0
    got = {r["doc_id"]: r for r in queries.op6_token_files(spark, SF).collect()}
    assert len(got) == len(documents)
    for i, text in zip(documents["doc_id"], documents["text"], strict=True):
        ids = [*whole(text), 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    packed = bitpack.pack_ids(ids, width)
    assert len(packed) == (1000 * width + 7) // 8
    for start, count in ((0, 1000), (333, 77), (999, 1), (5, 0)):
        assert np.array_equal(bitpack.unpack_ids(packed, width, start, count), ids[start : start + count])


def test_width():
    assert [bitpack.width_of(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_token_files_edges(spark, odd, tmp_path):
    for name, docs in (("odd", odd), ("none", odd.limit(0))):
        bitpack.write_tokens(docs, str(tmp_path / name), WORDS, 49_408, 2)
        rows = bitpack.read_tokens(spark, str(tmp_path / name)).orderBy("start").collect()
        assert Counter(r["id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
        assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]]).tolist()[: len(rows)]
        ids = [r["id"] for r in rows if r["id"] is not None]
        assert ids == sorted(ids) and all(r["id"] is None for r in rows[: len(rows) - len(ids)])


def test_copies_of_one_row_are_dealt_out(spark, tmp_path):
    docs = spark.range(0, 4000, 1, 8).selectExpr("7L AS doc_id", "'the same words' AS text")
    bitpack.write_tokens(docs, str(tmp_path / "t"), WORDS, 49_408, 2)
    files = [r["n"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("file").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert sum(files) == 4000 and len(files) > 1 and max(files) < 2500
    rows = bitpack.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["start"] for r in rows] == list(range(0, 4 * 4000, 4))


def _check_packing(rows, texts):
    """rows by id, piece; texts: (id, text), ids distinct."""
    whole, by_id, sequences = _library(BYTE), {}, {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_id.keys() == {i for i, _ in texts}
    total = 0
    for i, text in texts:
        ids = np.array([*whole(text), 0], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_id[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            assert 0 < r["length"] <= 2048 and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids) and (len(ids) > 2048 or len(by_id[i]) == 1)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(sequences), total / 2048


def test_op7(spark, documents):
    rows = queries.op7_best_fit_packing(spark, SF).collect()
    used, least = _check_packing(rows, list(zip(documents["doc_id"], documents["text"], strict=True)))
    assert used <= 1.05 * least + 1


def test_packing_edges(spark, odd):
    packed = packing.pack(odd, BYTE)
    assert Counter(r["id"] for r in packed.where("piece = 0").collect()) == Counter(r["doc_id"] for r in odd.collect())
    assert packing.pack(odd.limit(0), BYTE).count() == 0
    assert packing.pieces_of(2048) == [(0, 2048)] and packing.pieces_of(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def test_best_fit_is_best_and_bounded():
    rng = np.random.default_rng(9)
    bins, free = packing.BestFit(100, 8), {}
    for n in rng.integers(1, 101, 2000).tolist():
        fits = [space for space in free.values() if space >= n]
        number, offset = bins.place(n)
        if fits:
            assert free[number] == min(fits) and offset == 100 - min(fits)
        else:
            assert number not in free and offset == 0
            if len(free) >= 8:
                fullest = min(free.values())
                closed = free.keys() - {x for b in bins.bins for x in b} - {number}
                assert [free.pop(x) for x in closed] == [fullest]
        free[number] = free.get(number, 100) - n
        if not free[number]:
            del free[number]
        assert len(free) == bins.open <= 8


def test_op5(spark, documents):
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in queries.op5_token_rollup(spark, SF).collect()}
    want: dict = {}
    for path, version in ((BYTE, "byte_bpe_50k"), (WORDS, "word_bpe_49k")):
        whole = _library(path)
        for r in documents.itertuples():
            if r.text:
                a, b, c = want.get((r.source, r.lang, version), (0, 0, 0))
                want[r.source, r.lang, version] = a + 1, b + len(whole(r.text)), c + len(r.text)
    assert got == want


def test_rollup_batches(spark, odd, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path))
    assert rollup.names().collect() == [] and rollup.totals().collect() == []
    counts = token_rollup.count_tokens(odd, BYTE, "v1")
    assert counts.count() == odd.count()
    total = counts.agg(F.sum("n_tokens")).first()[0]
    assert rollup.commit("a", token_rollup.signed(counts, 1)) and not rollup.commit("a", token_rollup.signed(counts, 1))
    assert rollup.totals().agg(F.sum("n_docs"), F.sum("n_tokens")).first()[:] == (odd.count(), total)
    with pytest.raises(ValueError, match="other rows"):
        rollup.commit("a", token_rollup.signed(counts, -1))
    new = counts.withColumn("tokenizer_version", F.lit("v2")).withColumn("n_tokens", F.col("n_tokens") + 1)
    assert rollup.commit("b", token_rollup.revised(counts, new))
    assert {r["tokenizer_version"] for r in rollup.totals().collect()} == {"v2"}
    rollup.commit("c", token_rollup.signed(new, -1))
    assert rollup.totals().collect() == []
    with pytest.raises(ValueError, match="batch name"):
        rollup.commit("../x", token_rollup.signed(counts, 1))
    bare = token_rollup.count_tokens(odd.select("doc_id", "text"), BYTE, "v1")
    assert bare.first()["source"] is None and token_rollup.count_tokens(odd.limit(0), BYTE, "v1").count() == 0


def _change(spark, n, source="s"):
    return spark.createDataFrame([(source, "en", "v", 1, n, n)], token_rollup.SCHEMA)


def _tokens(rollup):
    return sum(r["n_tokens"] for r in rollup.totals().collect())


def test_rollup_keeps_totals(spark, tmp_path):
    """Batches move into a base; totals, names, repeats and conflicts are the same before and after."""
    rollup = token_rollup.Rollup(spark, str(tmp_path), compact_every=3)
    for k in range(7):
        assert rollup.commit(f"b{k}", _change(spark, 10**k))
    assert _tokens(rollup) == 1_111_111 and len(rollup.pending()) == 1
    assert sorted(r["batch"] for r in rollup.names().collect()) == [f"b{k}" for k in range(7)]
    assert len(list((tmp_path / "commits").glob("b*"))) < 7  # those of the base before are gone
    assert not rollup.commit("b0", _change(spark, 1)) and not rollup.commit("b6", _change(spark, 10**6))
    with pytest.raises(ValueError, match="other rows"):
        rollup.commit("b0", _change(spark, 2))
    assert _tokens(rollup) == 1_111_111


def test_rollup_after_a_crash(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path))
    rollup.commit("a", _change(spark, 1))
    _change(spark, 50).write.parquet(f"{tmp_path}/data/left")  # no commit file came of it
    (tmp_path / "commits" / "b").write_text("")  # created, not written
    rollup.compact()
    whole = next((tmp_path / "bases").iterdir())
    broken = tmp_path / "bases" / "000000009-x"  # a base that was not written to its end
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(next(whole.glob("part-*.parquet")).read_bytes())
    assert _tokens(rollup) == 1 and rollup.pending() == []
    assert rollup.commit("b", _change(spark, 3)) and _tokens(rollup) == 4


def test_two_committers(spark, tmp_path, monkeypatch):
    one, two = (token_rollup.Rollup(spark, str(tmp_path)) for _ in range(2))
    claim = one._claim

    def late(batch, data, own):  # the other one commits between this one's write and its claim
        two.commit("a", _change(spark, 5))
        return claim(batch, data, own)

    monkeypatch.setattr(one, "_claim", late)
    assert not one.commit("a", _change(spark, 5)) and _tokens(one) == 5
    two = token_rollup.Rollup(spark, str(tmp_path / "other"))
    one.folder = two.folder
    with pytest.raises(ValueError, match="other rows"):
        one.commit("a", _change(spark, 6))
    assert _tokens(two) == 5


def test_a_confirmed_batch_stays(spark, tmp_path, monkeypatch):
    """Another committer of the same name, with other rows, just before and just after this one's claim is in place."""
    from clickloom.sources import shared

    one, two = (token_rollup.Rollup(spark, str(tmp_path)) for _ in range(2))
    look = shared._file_system
    done = []

    class Late:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, source, target):
            if done:
                return self.fs.rename(source, target)
            done.append(True)
            assert two.commit("a", _change(spark, 5))  # after this one has seen the name free
            return self.fs.rename(source, target)

    monkeypatch.setattr(shared, "_file_system", lambda spark, at: Late(look(spark, at)))
    with pytest.raises(ValueError, match="other rows"):
        one.commit("a", _change(spark, 7))
    assert _tokens(one) == 5 and _tokens(two) == 5
    monkeypatch.undo()
    assert one.commit("b", _change(spark, 10))
    with pytest.raises(ValueError, match="other rows"):
        two.commit("b", _change(spark, 20))
    assert _tokens(one) == 15 and not two.commit("b", _change(spark, 10))


def test_a_slow_committer(spark, tmp_path, monkeypatch):
    """A batch is committed, moved into a base and its claim removed while another committer of it still works."""
    one, two = (token_rollup.Rollup(spark, str(tmp_path), compact_every=1) for _ in range(2))
    claim = one._claim

    def late(batch, data, own):
        for name, n in (("a", 5), ("b", 1), ("c", 1)):
            two.commit(name, _change(spark, n))
        return claim(batch, data, own)

    monkeypatch.setattr(one, "_claim", late)
    with pytest.raises(ValueError, match="other rows"):
        one.commit("a", _change(spark, 7))
    assert _tokens(two) == 7 and _tokens(one) == 7


def test_many_committers_at_a_time(spark, tmp_path):
    import threading

    won = []
    each = [threading.Thread(target=lambda k=k: won.append(token_rollup.Rollup(spark, str(tmp_path)).commit("a", _change(spark, 5)))) for k in range(6)]
    for t in each:
        t.start()
    for t in each:
        t.join()
    assert sorted(won) == [False] * 5 + [True] and _tokens(token_rollup.Rollup(spark, str(tmp_path))) == 5
