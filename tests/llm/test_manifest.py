"""The Merkle manifest against plain Python."""

import random
import zlib

import pytest

from helpers import awkward, frame, order, sha
from veilsight.llm import manifest

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root of a list of digests, and the siblings of each leaf, level by level."""
    paths = [[] for _ in nodes]
    spans = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_spans = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k in range(len(run)):
                for i in spans[a + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            up.append(sha("".join(run)))
            up_spans.append(sum(spans[a : a + 3], []))
        nodes, spans = up, up_spans
    return (nodes or [None])[0], paths


def fold(value, path):
    for left, right in path:
        value = sha("".join([*left, value, *right]))
    return value


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in sources:
        groups[s].sort(key=lambda r: (order(r[0]), leaf_of(r)))
        tops[s] = climb([leaf_of(r) for r in groups[s]])
    root, above = climb([tops[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for row, path in zip(groups[s], tops[s][1], strict=True):
            path = [*path, *above[k]]
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                now = (*row[:4], row[4].replace("\n", ""))
            top = fold(leaf_of(now), path)
            out.append((row[0], leaf_of(row), tops[s][0], root, sha("".join("".join([*a, *b]) for a, b in path)), top, top == root))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_documents_of_many_sources(spark, levels):
    rng = random.Random(levels)
    sources = [None, "", "web", "Web", "é", "z", "s", "-"] + [f"site{i}" for i in range(20)]
    rows = [(rng.randrange(500), "hot" if rng.random() < 0.5 else rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "a\nb", f"text {i}\n"])) for i in range(700)]
    rows += [rows[0]] * 5 + [(None, "hot", None, None, None)] * 30 + [(None, None, None, None, f"{i}\n") for i in range(5)]
    got = result(manifest.audited(documents(spark, rows), levels))
    assert got == expected(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 29, 82, 243, 244, 250])
def test_every_size_of_a_source(spark, n):
    rows = [(i, "only", "en", 1, f"t{i}") for i in range(n)]
    assert result(manifest.audited(documents(spark, rows), 2)) == expected(rows)


def test_lone_rows(spark):
    row = (5, None, None, None, None)
    (got,) = manifest.audited(documents(spark, [row])).collect()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.proof_sha256 == sha("")
    assert manifest.audited(documents(spark, [])).collect() == []


def test_awkward_rows(spark):
    rows = awkward()
    got = result(manifest.audited(frame(spark, rows)))
    assert got == expected([(i, "s", "en", len(t or ""), t) for i, t in rows])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 26, 27])
def test_appending_extends_open_witnesses(n):
    """After each append, a leaf's partial witness is what its siblings so far give."""
    tree = manifest.Appender(3)
    digests = [sha(str(i)) for i in range(n)]
    for k, d in enumerate(digests):
        tree.append(d)
        run = digests[k - k % 3 : k + 1]
        if len(run) < 3:
            assert [(x.left, x.right) for x in tree.open[0]] == [("".join(run[:j]), "".join(run[j + 1 :])) for j in range(len(run))]
    root = tree.close(alone=True)
    want, paths = climb(digests)
    assert root == want
    assert [list(zip(*w, strict=True)) for w in tree.witnesses()] == [[("".join(a), "".join(b)) for a, b in p] for p in paths]


def test_a_hot_source_is_spread(spark):
    """No task counts or folds more than its stretch or its block of a source."""
    rows = [(i, "hot" if i % 3 else f"s{i}", "en", 1, f"t{i}") for i in range(3000)]
    placed = manifest.ranked(documents(spark, rows).selectExpr("source AS g", "doc_id", "sha2(text, 256) AS digest"), ["doc_id", "digest"], "test")
    hot = placed.filter("g = 'hot'")
    assert sorted(r.i for r in hot.collect()) == list(range(2000)) and {r.total for r in hot.collect()} == {2000}
    assert [r.doc_id for r in hot.orderBy("i").collect()] == sorted(r.doc_id for r in hot.collect())
