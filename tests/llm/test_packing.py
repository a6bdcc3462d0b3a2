"""Packing against the tokenizers library and against its own rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from helpers import awkward, frame, order
from veilsight.llm import bytebpe, packing
from veilsight.llm.packing import Limits, Packer
from veilsight.llm.pretokens import load
from veilsight.llm.queries import QUERIES, tokenizer_path

FILE = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def power(n):
    return n & (n - 1) == 0


def padding(sequences, full):
    return sum(0 if power(n) else full - n for n in sequences)


def checked(rows, documents, limits, cut=True):
    """Pieces cover each document once, sequences are gapless and within the limits; gives the tokens of each sequence."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    used = {}
    for s, parts in by_sequence.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= limits.tokens and len(parts) <= limits.segments and sum(p[2] for p in parts) <= limits.loss
        used[s] = at
    for r in rows:
        by_doc[r.doc_id].append((r.start, bytes(r.ids), r.length, r.doc_tokens))
    for doc, ids in documents.items():
        parts = sorted(by_doc[doc])
        assert b"".join(p[1] for p in parts) == np.array(ids, "<u4").tobytes()
        assert [p[0] for p in parts] == np.cumsum([0, *[p[2] for p in parts]])[:-1].tolist()
        assert {p[3] for p in parts} == {len(ids)}
        if not cut and len(ids) < limits.tokens:
            assert len(parts) == 1
    assert set(by_doc) == set(documents)
    return used


def test_ids_are_the_librarys(library):
    known = bytebpe.encoding(load(FILE), bytebpe.pattern_of())
    rng = random.Random(1)
    signs = "ab's'S 'll\n\t 1²́eé̸<ΣσςİI ​\x1c\x0b\x85한ㄱ՘ᲊ꟱ 😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>x", " <|endoftext|>"]) for _ in range(3000)]
    texts += ["x" + "".join(map(chr, range(a, a + 16))) + "y" for a in range(0x80, 0xD800, 16)] + ["a" * 50_000, " " * 50_000, "\n" * 5_000 + "b"]
    for t in texts:
        assert known.encode(t, allowed_special="all") == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_documents(spark, library):
    rows = [(i, t) for i, t in dict(awkward()).items() if i is not None]
    got = packing.pack_documents(frame(spark, rows), FILE).collect()
    docs = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    used = checked(got, docs, Limits())
    assert padding(used.values(), 2048) == 0


def test_repeated_and_null_ids(spark, library):
    rows = awkward()
    got = packing.pack_documents(frame(spark, rows), FILE).collect()
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in got) == want
    assert {order(r.doc_id) for r in got} == {order(d) for d, _ in rows}
    assert packing.pack_documents(frame(spark, rows).limit(0), FILE).collect() == []


def test_query(spark, sf_dir, library):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in zip(table["doc_id"], table["text"], strict=True)}
    got = QUERIES["op12_packing"](spark, sf_dir).collect()
    used, covered = defaultdict(int), defaultdict(int)
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        used[r.sequence_id] += r.length
        covered[r.doc_id] += r.length
    assert covered == {d: len(i) for d, i in ids.items()}
    assert max(used.values()) <= 2048 and padding(used.values(), 2048) == 0


class Row:
    def __init__(self, **values):
        self.__dict__.update(values)


def packer_rows(examples, limits, cut):
    p = Packer(limits, cut)
    for doc, ids, loss in examples:
        p.add(doc, ids, loss)
    while p.pool:
        p.pack(last=True)
    return [Row(**r) for r in p.rows().to_pylist()]


def examples(seed, n, longest, bearing=0.5):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(longest, rng.lognormal(4, 1.3, n).astype(int) + 1)
    return [(i, rng.integers(0, 99, s).astype(np.uint32), rng.random(s) < bearing * rng.random() * 2) for i, s in enumerate(sizes.tolist())]


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("limits", [Limits(256, 4, 100), Limits(256, 64, 256), Limits(64, 1, 64), Limits(128, 3, 1)])
def test_all_limits_hold(limits, cut, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 64)
    some = examples(3, 400, 3000)
    rows = packer_rows(some, limits, cut)
    used = checked(rows, {d: i.tolist() for d, i, _ in some}, limits, cut=True)
    if cut:
        assert padding(used.values(), limits.tokens) == 0


def test_whole_examples_are_packed_tightly():
    """Instruction data is not cut; the heuristic needs few sequences more than the limits force."""
    limits = Limits(2048, 16, 900)
    some = examples(5, 4000, 2000, 0.35)
    some = [(d, i, m) for d, i, m in some if m.sum() <= limits.loss and len(i) < limits.tokens]
    used = checked(packer_rows(some, limits, False), {d: i.tolist() for d, i, _ in some}, limits, cut=False)
    least = max(sum(len(i) for _, i, _ in some) / limits.tokens, len(some) / limits.segments, sum(int(m.sum()) for _, _, m in some) / limits.loss)
    assert len(used) <= 1.05 * least + 1
    first_fit = []
    for _, i, m in sorted(some, key=lambda e: -len(e[1])):
        need = np.array([len(i), 1, m.sum()])
        for b in first_fit:
            if (b + need <= limits).all():
                b += need
                break
        else:
            first_fit.append(need.copy())
    assert len(used) <= 1.03 * len(first_fit) + 1


def test_very_short_examples_fill_up_with_long_ones():
    short = [(i, np.ones(3, np.uint32), np.ones(3, bool)) for i in range(3000)]
    long = [(5000 + i, np.ones(5000, np.uint32), np.ones(5000, bool)) for i in range(40)]
    used = checked(packer_rows(short + long, Limits(), True), {d: i.tolist() for d, i, _ in short + long}, Limits())
    assert padding(used.values(), 2048) == 0


def test_bad_limits():
    with pytest.raises(ValueError, match="positive"):
        Packer(Limits(0, 1, 1), True)


def test_conversations(spark, sf_dir, library):
    import pyarrow.parquet as pq

    limits = Limits(512, 8, 300)
    rows = pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = packing.pack_conversations(turns, FILE, limits).collect()
    docs, loss = defaultdict(list), 0
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"], r["role"] or "", r["text"] or "")):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        docs[r["conv_id"]] += ids
        loss += len(ids) * (r["role"] == "assistant")
    checked(got, docs, limits, cut=True)
    assert sum(r.loss_tokens for r in got) == loss > 0


def test_conversations_with_nulls_and_of_very_many_turns(spark, monkeypatch):
    monkeypatch.setattr(packing, "TURNS", 10)
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(100)] + [(None, None, None, None)] * 3 + [(2, None, "user", "x"), (None, 4, "assistant", "y"), (3, 1, None, "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = packing.pack_conversations(df, FILE).collect()
    assert {r.conv_id if hasattr(r, "conv_id") else r.doc_id for r in got} == {1, 2, 3, None}
    assert len([r for r in got if r.doc_id == 1]) == 10
    assert packing.pack_conversations(df.limit(0), FILE).collect() == []


def test_sequences(spark):
    rows = [(i, "some words and more of them " * (i % 90)) for i in range(300)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), FILE)
    whole = packing.sequences(pieces).collect()
    assert sum(r.n_tokens for r in whole) == sum(len(r.ids) // 4 for r in whole) == sum(r.length for r in pieces.collect())
    assert max(r.n_segments for r in whole) <= 64 and max(r.n_tokens for r in whole) == 2048
