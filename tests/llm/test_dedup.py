"""Exact, substring, near and line deduplication against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import Union, awkward, frame, lower, near_groups, order, repeated_words, rows_of, sha
from veilsight.llm import components, exact_dedup, line_dedup, simhash, substring_dedup
from veilsight.llm.common import sorted_runs
from veilsight.llm.queries import QUERIES


def words(rng, n, of):
    return " ".join(rng.choice(of) for _ in range(n))


# --- exact


def exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    return sorted(((d, max(groups[lower(t)], key=order), len(groups[lower(t)]), sha(lower(t))) for d, t in rows), key=repr)


def test_exact_groups_match(spark):
    rows = awkward()
    out = exact_dedup.exact_duplicates(frame(spark, rows))
    assert rows_of(out, "doc_id", "keep_id", "group_size", "text_sha256") == exact(rows)
    kept = [r for r in out.collect() if r.kept]
    assert len(kept) == len({lower(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_stage_keeps_one_row_with_all_columns(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len({lower(t) for _, t in rows})
    assert (got[0].kept, got[0].row) == ("a", "c")


def test_chunks_join_to_the_text_and_survive_an_edit(spark):
    rng = random.Random(1)
    text = words(rng, 4000, ["stand", "mask", "tree", "a", "noon.", "über"]) + "\n" * 3000
    edited = text[:900] + "changed " + text[900:]
    got = [r[0] for r in spark.createDataFrame([(text,), (edited,)], "t string").select(exact_dedup.chunks("t")).collect()]
    assert ["".join(g) for g in got] == [text, edited]
    assert max(map(len, got[0])) <= exact_dedup.MOST_CHUNK + 1
    assert len(set(got[0]) & set(got[1])) > 0.7 * len(set(got[0]))


def test_chunk_hashes_that_clash_are_found(spark):
    parts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "h long, chunk string")
    assert [r.h for r in exact_dedup.unverified(parts).collect()] == [1]


def test_exact_dedup_plan_has_no_python(spark):
    plan = exact_dedup.exact_duplicates(frame(spark, awkward()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- near


def test_near_groups_match(spark):
    rng = random.Random(3)
    rows = awkward()
    base = words(rng, 300, [f"w{i}" for i in range(500)])
    for i in range(40):
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edit"
        rows.append((200 + i, " ".join(w)))
    out = simhash.near_duplicates(frame(spark, rows))
    assert rows_of(out, "doc_id", "fingerprint", "component_id") == sorted(near_groups(rows), key=repr)


@pytest.mark.parametrize("direct", [3, 20_000])
def test_links_connect_what_is_within_four_bits(spark, direct):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 30, np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(20):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 9)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64).view(np.int64)
    want, got = Union(), Union()
    for i, a in enumerate(fps.tolist()):
        want.find(a)
        for b in fps[:i].tolist():
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                want.join(a, b)
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps.tolist()], "fp long")).collect()
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        got.join(a, b)
    assert [got.find(x) for x in fps.tolist()] == [want.find(x) for x in fps.tolist()]
    some = np.unique(np.int64(0x1234567800000000) + np.random.default_rng(1).integers(0, 1 << 20, 400))
    one, two = Union(), Union()
    for a, b in simhash.forest(some):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            one.join(x, y)
    for a, b in simhash.split_forest(some, direct):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            two.join(x, y)
    assert [one.find(x) for x in some.tolist()] == [two.find(x) for x in some.tolist()]


def test_near_stage_keeps_one_of_each_component(spark):
    rows = [(d, t) for d, t in awkward() if d is not None]
    docs = frame(spark, rows)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in near_groups(rows)})


def test_stages_with_ids_that_clash_across_groups(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (9, b), (5, a.upper()), (7, None), (7, ""), (3, c), (None, "x y z"), (None, "other words of no id at all")]
    got = sorted(((r.doc_id, lower(r.text)) for r in exact_dedup.drop_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, a), (9, b), (7, ""), (3, c), (None, "x y z"), (None, "other words of no id at all")], key=repr)
    near = [(5, a), (5, b), (2, b), (5, c), (8, c), (6, None), (6, ""), (None, "x y z"), (None, "other words of no id at all"), (None, "X Y Z")]
    got = sorted(((r.doc_id, lower(r.text)) for r in simhash.drop_near_duplicates(frame(spark, near)).collect()), key=repr)
    assert got == sorted([(5, a), (2, b), (5, c), (6, ""), (None, "x y z"), (None, "other words of no id at all")], key=repr)


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    u = Union()
    for a, b in links:
        if a is not None and a != b:
            u.join(a, b)
    got = components.components(spark.createDataFrame(links, "a long, b long"), "test").collect()
    assert {r.node: r.component for r in got} == {x: u.find(x) for x in u.up}
    assert len(got) == len(u.up)


# --- substring


@pytest.mark.parametrize("hot", [1_000, 2])
def test_repeated_passages_match(spark, hot):
    rng = random.Random(6)
    rows = awkward()
    few = ["a", "b", "c"]
    rows += [(300 + i, words(rng, rng.randint(1, 120), few)) for i in range(25)]
    base = [f"v{i}" for i in range(90)]
    rows += [(390, " ".join(base)), (390, " ".join(base)), (390, " ".join(base[:40] + ["other"] + base[40:])), (390, "shift " + " ".join(base)), (None, " ".join(base[10:70]))]
    rows += [(400 + i, " ".join(base[rng.randint(0, 40) : rng.randint(50, 90)] + [f"own{i}"] + base[5:30])) for i in range(25)]
    out = substring_dedup.remove_repeats(frame(spark, rows), hot)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept.decode()) for r in out.collect()), key=repr)
    assert got == sorted(repeated_words(rows), key=repr)


def test_automaton_statistics():
    rng = random.Random(8)
    for _ in range(200):
        texts = [[rng.choice("ab") for _ in range(rng.randint(1, 12))] for _ in range(3)]
        automaton = substring_dedup.Automaton()
        for t in texts:
            automaton.add(t)
        query = [rng.choice("abc") for _ in range(12)]
        known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max((n for n in range(1, e + 2) if tuple(query[e + 1 - n : e + 1]) in known), default=0) for e in range(12)]
        assert automaton.statistics(query) == want


# --- lines


def plain_lines(rows):
    lines = []
    for d, t in rows:
        lines += [(order(d), d, k, " ".join(x.split())) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = sorted({x[3] for x in lines})
    shingles = {t: {t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts}
    u = Union()
    for i, a in enumerate(texts):
        u.find(a)
        for b in texts[:i]:
            if len(a) >= 5 and len(b) >= 5 and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                u.join(a, b)
    first = {}
    for o, _, k, t in lines:
        r = u.find(t)
        first[r] = min(first.get(r, (o, k)), (o, k))
    return {(d, k): first[u.find(t)] == (o, k) for o, d, k, t in lines}


def test_similar_lines_match(spark):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("str", "plo", "gri", "fen") for b in ("ax", "oth", "ine", "umb", "ery")]
    base = [words(rng, rng.randint(8, 20), vocabulary) for _ in range(25)]
    rows = [(1, None), (2, ""), (3, " \n\n"), (4, "ab\nab\n a b\nabc"), (None, base[0]), (5, base[0] + "\n" + base[0])]
    for i in range(60):
        picked = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "x"
            picked.append(" ".join(w))
        rows.append((10 + i, "\n".join(picked)))
    want = plain_lines(rows)
    got = {r.doc_id: r for r in line_dedup.remove_similar_lines(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    wrong = 0
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if want.get((d, k), True))
        wrong += kept != got[d].kept
        assert got[d].n_lines == sum(1 for x in lines if x.strip())
    assert wrong <= 2  # banding may miss a pair just above the threshold


def test_large_companies_keep_every_link(spark):
    rng = random.Random(12)
    rows = [(i, f"this is line number {rng.randrange(1000)} of the same frame, which is long enough that one number more or less is a small part of its shingles") for i in range(80)]
    own = spark.createDataFrame([(d, d, t) for d, t in rows], "k long, doc_id long, text string")
    one, two = (sorted(map(tuple, line_dedup.similar_lines(own, most).collect())) for most in (20_000, 4))
    assert one == two and len({c for _, c in one}) < 10 and len(one) > 60


def test_large_companies_go_in_pairs_of_blocks(spark):
    rows = [(1, i, True) for i in range(300)] + [(2, i, False) for i in range(3)] + [(3, i, True) for i in range(5)] + [(4, 9, True)]
    groups = {}
    for r in line_dedup.companies(spark.createDataFrame(rows, "key long, id long, large boolean"), 100).collect():
        groups.setdefault(r.key, set()).add(r.id)
    assert max(map(len, groups.values())) < 150  # two blocks of 50 by hash
    met = {(a, b) for g in groups.values() for a in g for b in g}
    assert met == {(a, b) for a in range(300) for b in range(300)}
    assert {0, 1, 2} in groups.values() and {0, 1, 2, 3, 4} in groups.values()


def test_long_runs_come_in_pieces():
    keys = np.repeat([1, 2, 3, 4], [3, 50, 2, 1])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 7]), pa.array(np.arange(len(keys))[k : k + 7])], names=["key", "id"]) for k in range(0, len(keys), 7)]
    whole, pieces = [], []
    for starts, ends, c in sorted_runs(iter(batches), "key", 20):
        if starts is None:
            assert set(c["key"]) == {2} and len(c["id"]) < 35
            pieces += c["id"].tolist()
        else:
            whole += [c["id"][s:e].tolist() for s, e in zip(starts, ends, strict=True)]
    assert whole == [[0, 1, 2], [53, 54]] and pieces == list(range(3, 53))
    assert max(len(c["id"][s:e]) for starts, ends, c in sorted_runs(iter(batches), "key") for s, e in zip(starts, ends, strict=True)) == 50


def test_companies_hashed_at_once_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(line_dedup, "LETTERS", 100)
    got = list(line_dedup.at_once(np.array([0, 2, 5, 7]), np.array([2, 4, 7, 9]), np.array([40, 10, 20, 20, 999, 500, 1, 30, 30])))
    assert got == [(0, 2), (2, 3), (3, 4)]


def test_band_recall_at_the_threshold():
    rng = random.Random(10)
    found = n = 0
    while n < 300:
        a = "".join(rng.choice("abcdefgh") for _ in range(200))
        b = list(a)
        for _ in range(4):
            b[rng.randrange(200)] = "z"
        b = "".join(b)
        x, y = ({t[i : i + 5] for i in range(196)} for t in (a, b))
        if len(x & y) / len(x | y) < 0.8:
            continue
        n += 1
        keys = line_dedup.band_keys([a, b])
        found += bool((keys[0] == keys[1]).any())
    assert found >= 0.97 * n


@pytest.mark.parametrize("name", ["op1_token_files", "op2_substring_dedup", "op3_exact_dedup", "op4_simhash", "op5_quality", "op7_bpe", "op8_line_dedup", "op10_decontaminate"])
def test_empty_tables(spark, tmp_path, name):
    for t, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_companies_are_verified_in_one_table(monkeypatch):
    """The pairs of a small company are counted at once; the links connect the same lines as those found one by one."""
    rng = random.Random(8)
    for _ in range(60):
        base = [rng.randrange(60) for _ in range(40)]
        sets = [np.unique(np.array([x if rng.random() > 0.06 else rng.randrange(60) for x in base], np.uint64)) for _ in range(rng.randint(2, 9))]
        calls = []
        real = line_dedup._near_table
        monkeypatch.setattr(line_dedup, "_near_table", lambda *a: calls.append(real(*a)) or calls[-1])
        groups = []
        for most in (1 << 20, 0):
            monkeypatch.setattr(line_dedup, "TABLE", most)
            parent = {}
            for i, j in line_dedup.similar(sets):
                components.unite(parent, i, j)
            groups.append([components.find(parent, k) for k in range(len(sets))])
        monkeypatch.setattr(line_dedup, "_near_table", real)
        assert groups[0] == groups[1] and calls[0] is not None and calls[1] is None


def test_lines_of_no_company_are_not_moved(spark):
    """Bits tell most lines that are near to none; no line of a company is left out."""
    rng = np.random.default_rng(3)
    ids, others = rng.integers(-(1 << 63), 1 << 63, 3000, np.int64), rng.integers(-(1 << 63), 1 << 63, 100_000, np.int64)
    bits = line_dedup.marks(spark.createDataFrame([(int(i),) for i in ids], "id long"))
    assert line_dedup.marked(ids, bits).all()
    assert line_dedup.marked(others, bits).mean() < 0.1
    none = line_dedup.marks(spark.createDataFrame([], "id long"))
    assert not line_dedup.marked(others, none).any()


def test_band_rows_are_sorted_by_key_alone():
    """Rows of a key come in any order of ids, and more than once."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2, 2, 3, 4, 4, 4]), pa.array([9, 5, 9, 7, 7, 1, 5, 9, 5])], names=["key", "id"])
    got = [tuple(r.values()) for b in line_dedup._shared(10)(iter([batch])) for r in b.to_pylist()]
    assert sorted(i for _, i, _ in got) == [5, 5, 9, 9] and len({k for k, _, _ in got}) == 1


def test_shingles_are_those_of_each_line():
    lines = ["", "a", "abcd", "abcde", "abcdefg", "\U0001f600bcdef", ""]
    hashed, bounds = line_dedup.shingles(lines)
    assert np.diff(bounds).tolist() == [1, 1, 1, 1, 3, 2, 1]
    for k, line in enumerate(lines):
        alone, _ = line_dedup.shingles([line])
        assert hashed[bounds[k] : bounds[k + 1]].tolist() == alone.tolist()
    sets = line_dedup.distinct(hashed.copy(), bounds)
    assert [s.tolist() for s in sets] == [sorted(set(hashed[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_op8_links_of_an_index_connect_what_brute_force_connects(monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(line_dedup, "TABLE", 0)
    for trial in range(150):
        monkeypatch.setattr(line_dedup, "SHARED", rng.choice([5, 1 << 21]))
        most, base, sets = rng.choice([8, 40, 300]), set(range(rng.randrange(1, 25))), []
        for _ in range(rng.randrange(1, 50)):
            one = {x for x in base if rng.random() < 0.9} if rng.random() < 0.6 else set()
            sets.append(one | {rng.randrange(most) for _ in range(rng.randrange(1, 8))})
        found = list(line_dedup.similar([np.array(sorted(x), np.uint64) for x in sets]))
        near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
        assert {(max(p), min(p)) for p in found} <= set(near)
        parent = {}
        for i, j in found:
            components.unite(parent, i, j)
        assert all(components.find(parent, i) == components.find(parent, j) for i, j in near), trial


def test_op8_near_copies_are_compared_by_what_they_differ_in(monkeypatch):
    rng = np.random.default_rng(5)
    base, read = np.arange(500), []

    class Counted(line_dedup._Shared):
        def of(self, one, rest, left):
            out = super().of(one, rest, left)
            read.append(len(self.places))
            return out

    monkeypatch.setattr(line_dedup, "_Shared", Counted)
    sets = []
    for i in range(600):  # a twentieth of the lines differ in too much to be linked to any
        lost = rng.choice(500, 90 if i % 20 == 0 else 10, replace=False)
        sets.append(np.r_[np.delete(base, lost), 1_000 + 100 * i + np.arange(len(lost))].astype(np.uint64))
    sets = [np.sort(x) for x in sets]
    assert len(list(line_dedup.similar(sets))) == 569
    # The company has 300,000 shingles; each of the linked lines was compared with those of all lines left.
    assert max(read) < 600 * 500 // 10 and sorted(read)[len(read) // 2] < 30 * 500
