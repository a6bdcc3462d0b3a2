"""Token files and BPE against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from helpers import awkward, frame, order, sha
from veilsight.llm import bpe, token_files
from veilsight.llm.pretokens import ids_of, load
from veilsight.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def raw(values):
    return np.array(values, "<u4").tobytes()


def test_bpe_rows_match_the_library(spark, library):
    rows = awkward()
    got = sorted((tuple(r) for r in bpe.digests(frame(spark, rows), tokenizer_path()).collect()), key=repr)
    want = []
    for d, t in rows:
        i = ids(library, t)
        want.append((d, len(i), sha(raw(i)), sha(library.decode(i, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)


def test_bpe_of_odd_characters(library):
    pieces = bpe._build(load(tokenizer_path()))
    rng = random.Random(1)
    signs = "ab'sStTrRe vVmMlLdD 1²́eé̸<ΣσςİI ​\x1c\x0b\x85한ㄱ՘ᲊ꟱"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) + rng.choice(["", "", "<|endoftext|>x<|startoftext|>"]) for _ in range(3000)]
    for text, got in zip(texts, pieces.texts(texts), strict=True):
        assert ids_of(got).tolist() == ids(library, text), repr(text)


def test_bpe_of_all_assigned_letters_of_the_basic_plane(library):
    pieces = bpe._build(load(tokenizer_path()))
    texts = ["x" + "".join(map(chr, range(a, a + 16))) + "y" for a in range(0x80, 0xD800, 16)]
    for text, got in zip(texts, pieces.texts(texts), strict=True):
        assert ids_of(got).tolist() == ids(library, text), repr(text)


def test_repeated_pairs_merge_from_the_left(library):
    encoder = bpe.Encoder(load(tokenizer_path()))
    rng = random.Random(2)
    texts = ["".join(rng.choice("aol") for _ in range(rng.randint(1, 30))) for _ in range(2000)] + ["o" * 5000]
    for text, got in zip(texts, encoder.words(texts), strict=True):
        assert ids_of(got).tolist() == ids(library, text)


def test_old_pieces_are_kept(monkeypatch, library):
    from veilsight.llm import pretokens

    monkeypatch.setattr(pretokens, "KEPT_PIECES", 3)
    monkeypatch.setattr(pretokens, "KEPT_WORDS", 2)
    pieces = bpe._build(load(tokenizer_path()))
    for text in ["one two three four five", "one six seven", "eight one nine ten", "two one"]:
        assert ids_of(pieces.texts([text])[0]).tolist() == ids(library, text)


def test_bpe_query(spark, sf_dir, library):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    got = {r.doc_id: r for r in QUERIES["op7_bpe"](spark, sf_dir).collect()}
    for d, t in zip(table["doc_id"], table["text"], strict=True):
        assert got[d].ids_sha256 == sha(raw(ids(library, t)))


def expected(library, rows):
    out, start = [], 0
    for _, _, d, t in sorted((d is not None, order(d), d or 0, t or "") for d, t in rows):
        i = [*ids(library, t), 2]
        out.append((start, len(i), zlib.crc32(raw(i))))
        start += len(i)
    return out


def test_token_files_of_awkward_rows(spark, library, monkeypatch):
    rows = awkward()
    monkeypatch.setattr(token_files, "SHARD_BYTES", 2000)
    got = token_files.token_digests(frame(spark, rows), tokenizer_path()).orderBy("start").collect()
    assert [order(r.doc_id) for r in got] == sorted(order(d) for d, _ in rows)
    assert sum(r.n_tokens for r in got) == sum(len(ids(library, t)) + 1 for _, t in rows)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    by_id = lambda found: sorted((order(d), n, c) for d, n, c in found)
    assert by_id((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == by_id((d, len(i := [*ids(library, t), 2]), zlib.crc32(raw(i))) for d, t in rows)


def test_token_files_query(spark, sf_dir, library):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    got = QUERIES["op1_token_files"](spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == expected(library, list(zip(table["doc_id"], table["text"], strict=True)))


def test_pieces_are_met_again_in_either_table(monkeypatch, library):
    monkeypatch.setattr(token_files, "KEPT_PIECES", 3)
    pieces = token_files.LibraryPieces(load(tokenizer_path()))
    texts = ["one Two three't four, five", "one six İstanbul ΣΑΣ 7a8", "e\u0301 \u00e9 e\u0301\u0323x \U0001fae8a", "one\x1ctwo <|endoftext|> x", "", None, "two ... one"]
    for text in [*texts, *texts]:
        assert ids_of(pieces.texts([text])[0]).tolist() == ids(library, text)
    assert [ids_of(i).tolist() for i in pieces.texts(texts)] == [ids(library, t) for t in texts]


def test_one_document_is_read_by_its_frame(spark, tmp_path, library):
    docs = spark.createDataFrame([(i, f"some text number {i} with words") for i in range(200)] + [(500, "long " * 30000)], "doc_id long, text string")
    token_files.write_tokens(docs, str(tmp_path / "t"), tokenizer_path())
    assert token_files.read_document(spark, str(tmp_path / "t"), 77) == [*ids(library, "some text number 77 with words"), 2]
    assert token_files.read_document(spark, str(tmp_path / "t"), 9999) is None
    assert spark.read.parquet(str(tmp_path / "t/dictionary")).first()["hash"]


def test_another_dictionary_is_refused():
    block = token_files.pack([token_files.compressor(b"").compress(raw([1, 2]))], b"")
    assert token_files.frame(block, 0, b"").tolist() == [1, 2]
    with pytest.raises(ValueError, match="dictionary"):
        token_files.frame(block, 0, b"other")
    with pytest.raises(ValueError, match="version"):
        token_files.index(b"x" * 100, b"")


def test_documents_are_read_in_bounded_stretches():
    assert list(token_files.reads([])) == []
    assert list(token_files.reads([1, 2, 3], 12)) == [(0, 2), (2, 3)]
    assert list(token_files.reads([100, 1, 100, 1, 1], 12)) == [(0, 1), (1, 2), (2, 3), (3, 5)]


def test_very_repetitive_documents_come_back(spark, tmp_path):
    """A block of very small frames holds far more ids than bytes."""
    rows = [(i, "so " * 400_000) for i in range(12)]
    path = str(tmp_path / "t")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, tokenizer_path())
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in token_files.read_tokens(spark, path).drop("ids").collect()) == [(i, i * 400_001, 400_001) for i in range(12)]


def test_pieces_of_all_assigned_letters_and_spaces(library):
    """Arrow cuts texts where the library does; words reach it normalised and in byte letters."""
    pieces = token_files.LibraryPieces(load(tokenizer_path()))
    texts = ["x" + "".join(map(chr, range(a, a + 16))) + " y" for a in range(0, 0xD800, 16)]
    for text, got in zip(texts, pieces.texts(texts), strict=True):
        assert ids_of(got).tolist() == ids(library, text), repr(text)


def test_known_pieces_take_few_bytes(monkeypatch):
    """A worker's table holds a column of short pieces and one of ids, not objects; a long piece is not kept."""
    import tracemalloc

    import pyarrow as pa

    pieces = token_files.LibraryPieces(load(tokenizer_path()))
    texts = [" ".join(f"word{k}" for k in range(a, a + 1000)) for a in range(0, 40_000, 1000)] + ["q" * 1_000]
    pieces.texts(["warm up"])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    pieces.texts(texts)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 80 * 40_000
    assert len(pieces.known) == 40_002
    monkeypatch.setattr(token_files, "KEPT_PIECES", 1000)
    pieces.texts(["word1 word2"])
    pieces.texts(["word2 word3"])
    assert len(pieces.known) < 1000
