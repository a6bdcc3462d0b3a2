"""Quality, WARC fixity, HTML layout, decontamination and the pipeline."""

import os
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from helpers import awkward, contaminated, fingerprint, frame, lower, near_groups, rows_of, sha
from veilsight.llm import decontaminate, html_layout, quality, warc_audit
from veilsight.llm.queries import QUERIES

# --- quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 5 <> 0"))
    rated = quality.rate(docs.select("doc_id", "text"), model).select("row.doc_id", "kept", "expected_grade")
    rows = rated.join(labels.filter("doc_id % 5 = 0"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    toxic = [r.kept for r in rows if r.toxic == 1]
    low = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(toxic) < 0.1 and np.mean(low) < 0.1
    assert (np.diff(model.thresholds) > 0).all()


def test_ordinal_fit_orders_grades():
    index = np.array([1, 2, 3] * 5)
    model = quality.fit_ordinal(index, np.arange(16), np.array([0, 1, 2] * 5))
    tails = model.tails(np.array([1, 2, 3]), np.arange(4))
    assert tails.sum(axis=1).tolist() == sorted(tails.sum(axis=1).tolist())
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_quality_of_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None), (4, 1, None), (5, None, 1), (6, 0, 0), (6, 1, 0), (7, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.id: r.grade for r in quality.graded(labels).collect()} == {4: 2, 5: 0, 6: 1, 7: 2, 999: 1}
    out = quality.quality(docs, labels)
    assert out.count() == len(rows)
    none = quality.quality(docs, labels.limit(0)).collect()
    assert all(r.kept and r.tail_probability == 0.5 for r in none)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out.collect())


def test_labels_of_unknown_documents_use_up_no_sample(spark):
    docs = frame(spark, [(i, ("good words here " if i % 2 else "bad stuff there ") * 3) for i in range(40)])
    known = [(i, i % 2, 0) for i in range(40)]
    labels = spark.createDataFrame(known + [(1000 + i, 0, 1) for i in range(2000)], "doc_id long, quality int, toxic int")
    one, two = quality.fit(docs, labels, 40), quality.fit(docs, spark.createDataFrame(known, labels.schema), 40)
    assert (one.weights == two.weights).all() and one.weights.any()


def test_stage_rates_documents_without_labels(spark, sf_dir):
    import corpus_pipeline as P

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi").withColumn("doc_id", docs["doc_id"] + 10**9)
    n = bad.count()
    assert n > 0 and P.quality_classifier(spark, bad, sf_dir).count() < 0.2 * n


# --- decontamination


@pytest.mark.parametrize("most_grams", [400_000, 40])
def test_contamination_matches(spark, most_grams):
    rng = random.Random(3)
    rows = awkward()
    say = lambda n: " ".join(rng.choice(["Ab", "cd", "é", "7", "fg"]) for _ in range(n))
    items = [(i, say(rng.randint(0, 40))) for i in range(12)] + [(3, "one"), (4, None), (None, say(14)), (5, "..."), (6, say(13)), (6, say(13))]
    for i in range(30):
        item = rng.choice(items)[1] or ""
        rows.append((100 + i, say(rng.randint(0, 60)) + "; " + item.upper().replace(" ", "--") + " " + say(rng.randint(0, 300))))
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, gram string")
    out = decontaminate.contamination(frame(spark, rows), benchmark, most_grams)
    want = [(d, n, hit, len(found), sha(",".join(found)), bad) for d, n, hit, found, bad in contaminated(rows, items)]
    assert rows_of(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    clean = decontaminate.drop_contaminated(frame(spark, rows), benchmark, most_grams)
    assert clean.columns == frame(spark, rows).columns
    assert rows_of(clean, "doc_id") == sorted(((w[0],) for w in want if not w[-1]), key=repr)


def test_grams_of_many_items_are_spread_over_blocks(spark):
    frame_ = " ".join(f"w{i}" for i in range(13))
    benchmark = spark.createDataFrame([(i, frame_) for i in range(600)] + [(None, frame_)], "item_id long, text string")
    found = decontaminate.grams(benchmark)
    sizes = [r["count"] for r in found.groupBy(decontaminate.block_of(6).alias("b")).count().collect()]
    assert sum(sizes) == 601 and len(sizes) == 6 and max(sizes) < 200
    one, more = (decontaminate.contamination(frame(spark, [(1, frame_), (2, "clean")]), benchmark, n).collect() for n in (400_000, 100))
    assert sorted(one) == sorted(more) and {r.doc_id: (r.n_hit, r.n_items) for r in one} == {1: (13, 600), 2: (0, 0)}


def test_spans_are_removed(spark):
    item = "the quick brown fox jumps over the lazy dog while nobody looks at"
    rows = [(1, f"Before. {item.title()}! After."), (2, "clean"), (3, None)]
    out = decontaminate.remove_spans(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert rows_of(out, "doc_id", "text") == [(1, "Before. ! After."), (2, "clean"), (3, "")]


def test_empty_benchmark_leaves_all_clean(spark):
    out = decontaminate.contamination(frame(spark, awkward()), spark.createDataFrame([], "item_id long, text string"))
    assert not any(r.contaminated for r in out.collect())


# --- WARC


PAGES = [(i, f"http://h/{i}", f"<p>page {i}</p>" * (i % 7)) for i in range(300)] + [(None, None, None), (7, "http://h/a b", "é" * 50), (7, "http://h/a b", "é" * 50), (400, "u", "x\r\n\r\nWARC/1.0 no")]


def replicas(spark, tmp_path, monkeypatch, rows=PAGES):
    monkeypatch.setattr(warc_audit, "FILE_RECORDS", 25)
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, file string").coalesce(2)
    out = [str(tmp_path / x) for x in "ab"]
    for path in out:
        warc_audit.write_warc(pages, path, "2024-01-31T00:00:00Z")
    return out


def parts(path):
    return sorted(f"{path}/{x}" for x in os.listdir(path) if x.startswith("part-"))


def test_equal_replicas_are_intact(spark, tmp_path, monkeypatch):
    a, b = replicas(spark, tmp_path, monkeypatch)
    rows = warc_audit.audit(spark, a, b).collect()
    assert len(rows) == len(PAGES) and all(r.intact for r in rows)
    assert sorted(r.payload_sha256 for r in rows) == sorted(sha(h or "") for _, _, h in PAGES)
    assert len({r.file for r in rows}) > 2


def test_damage_is_located(spark, tmp_path, monkeypatch):
    a, b = replicas(spark, tmp_path, monkeypatch)
    c = tmp_path / "c"
    c.mkdir()
    names = [os.path.basename(p) for p in parts(b)]
    listed = warc_audit.catalogue(spark, a).collect()
    ids = sorted({r.file for r in listed})
    last, tail = ids[-1], ids[2]
    assert len(ids) == len(names) > 5
    change = {last: {r.offset for r in listed if r.file == last}}
    for k, name in enumerate(names[:-1]):  # the last file is missing
        with open(f"{b}/{name}", "rb") as f:
            packed = f.read()
        data = bytearray(warc_audit.inflate(packed))
        records = [r for r in listed if r.file == ids[k]]
        if k == 0:
            data[records[5].offset + 3] ^= 1
            change[ids[0]] = {records[5].offset}
        elif k == 1:
            del data[-2:]
            change[ids[1]] = {records[-1].offset}
        elif k == 2:
            data += b"tail"
        elif k == 3:  # in the packed bytes; what is behind is lost
            data = packed[: len(packed) // 2]
            whole = len(warc_audit.inflate(data))
            change[ids[3]] = {r.offset for r in records if r.offset + r.length > whole}
        (c / name).write_bytes(data)
    got = {(r.file, r.first) for r in warc_audit.damaged_ranges(spark, a, str(c), warc_audit.catalogue(spark, a)).collect()}
    sizes = {r.file: max(x.offset + x.length for x in listed if x.file == r.file) for r in listed}
    assert got == {(f, o) for f, at in change.items() for o in at} | {(tail, sizes[tail]), (last, sizes[last])}
    bad = {(r.file, r.offset) for r in warc_audit.audit(spark, a, str(c)).collect() if not r.intact}
    assert bad == {(f, o) for f, at in change.items() for o in at}


def test_only_differing_branches_lead_down():
    data = bytes(range(256)) * 40
    ranges = [(k * 10, k * 10 + 10) for k in range(len(data) // 10)]
    other = bytearray(data)
    other[5555] ^= 1
    one, two = warc_audit.tree_of(data, ranges), warc_audit.tree_of(bytes(other), ranges)
    assert [sum(x != y for x, y in zip(p, q, strict=True)) for p, q in zip(one, two, strict=True)] == [1] * len(one)


def test_audit_of_no_pages(spark, tmp_path, monkeypatch):
    a, b = replicas(spark, tmp_path, monkeypatch, [])
    assert warc_audit.audit(spark, a, b).collect() == []


# --- HTML


CASES = [
    (None, ""), ("", ""), ("  \n ", ""), ("plain", "plain"), ("a<br>b", "a\nb"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<p>one\n two   <b>three</b></p>", "one two three"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<ol reversed start=2><li>a<li>b</ol>", "2. a\n1. b"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<pre>\n a\n  b</pre>", " a\n  b"), ("<p>x</p><script>if (a</b) {}</script><style>p{}</style><p>y", "x\n\ny"),
    ("<div hidden>no</div>yes<span style='display: none'>no</span>", "yes"), ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"), ("<template>no</template><noscript>no</noscript>x", "x"),
    ("<title>no</title><p>&lt;x&gt; &amp;amp; &eacute;</p>", "<x> &amp; é"), ("a</b></p>b", "a\n\nb"), ("<textarea>a <b>\n c</textarea>", "a <b>\n c"),
    ("<table><tr><th>n<th>value<tr><td>long name<td>1</table>", "n          value\nlong name  1"),
    ("<table><caption>c</caption><tbody><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "c\nab     c\nd   e  f"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><td>x</table>after", "x\n\nafter"),
    ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>", "i  j  k"), ("<blockquote>q</blockquote>x", "  q\n\nx"), ("<img alt='pic'> <img alt=''>", "pic"),
    ("a <math><semantics><mrow><mi>x</mi> <mo>=</mo>\n<mn>1</mn></mrow><annotation encoding='application/x-tex'>no</annotation></semantics></math>b", "a x=1b"),
    ("<math><msup><mn>2</mn><mn>10</mn></msup><mo>&lt;</mo><mfrac><mi>a</mi><mi>b</mi></mfrac><mtext>if <b>so</b></mtext></math>", "2 10< a b if so"),
    ("<math display=block><mi>x</mi><annotation-xml encoding='MathML-Content'><ci>no</ci></annotation-xml></math>y", "x\ny"), ("<p><math><mi>x</mi><p>y", "x\n\ny"),
    ("<p>a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><style>no</style>no<text x=1>one <tspan>two</tspan></text><g><text>three</text></g></svg>b", "a one two three b"),
    ("<svg><title/><defs/><path d='M0'/><a href=/x/><text>label</text></a></svg>", "label"), ("<svg><script/><text display=none>no</text><text/><text>yes</text></svg>", "yes"),
    ("<svg><switch><foreignObject><div>html</div></foreignObject><text>no</text></switch></svg>", "html"), ("<svg><path><p>x</p>", "x"), ("<div hidden><svg><text>no</text></svg><math><mi>no</mi></math></div>x", "x"),
    ("<table><tr><td><svg><text>a</text></svg><td><math><mn>1</mn></math></table>", "a  1"), ("<svg><text>a</text><text visibility=hidden>no</text></svg>", "a"),
    ("<form><input type=submit value=Go><input type=RESET value='Clear all'><input type=button value=More>x<input type=text value=no><input type=hidden value=no></form>", "Go Clear all More x"),
    ("<input type=submit><input type=submit value=no hidden><input type=image alt=Find><input type=submit value=no style='visibility:hidden'>", "Find"),
    ("<!-- a > b --><p>x<!-- open", "x"), ("<p title='a>b'>x", "x"), ("a<b", "a"), ("1 < 2", "1 < 2"), ("<select><option>a<option>b</select>", "a\nb"),
]


DEEP = {
    "quotes": "<blockquote>x" * 10_000, "lists": "<ul><li>x" * 5_000, "wide cells": "<table>" + "<tr><td colspan=1000>x" * 8_000, "wide and high": "<table>" + "<tr><td colspan=1000 rowspan=9>x<td>x" * 2_000,
    "high cells": "<table>" + "<tr><td rowspan=65534>x" * 2_000, "spans": "<span>" * 8_000 + "<li>x</span>" * 8_000, "tables": "<table><tr><td>x<td>" * 3_000, "one column": "<table><tr><td>x" * 3_000,
    "tables in quotes": "<blockquote><table><tr><td>x<td>" * 2_000, "headings": "<div><h1>x" * 4_000,
}


@pytest.mark.parametrize("name", DEEP)
def test_deep_pages_grow_in_proportion(name):
    page, start = DEEP[name], time.process_time()
    text = html_layout.render(page)
    assert time.process_time() - start < 2
    assert text.count("x") == page.count("x") and len(text) < 30 * len(page)


def test_columns_without_cells_take_no_room():
    assert html_layout.render("<table><tr><td colspan=1000>a<td>b<tr><td colspan=1000>cc<td>d</table>") == "a   b\ncc  d"
    assert html_layout.render("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"


@pytest.mark.parametrize(("page", "text"), CASES)
def test_layout(page, text):
    assert html_layout.render(page) == text


TABLES = ["<table><tr><td>x<td>y</table>", "<table><td>x</table>", "<table><caption>c</caption><thead><tr><th>x<tbody><tr><td>y<table><td>z</table></table>"]


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize(
    ("before", "after"),
    [("<div hidden>", "</div>"), ("<div style='display:none'>", "</div>"), ("<template>", "</template>"), ("<details><summary>s</summary>", "</details>"), ("<dialog>", "</dialog>"),
     ("<object>", "</object>"), ("<table hidden><tr><td>", "</table>"), ("<table><tr hidden><td>", "</table>"), ("<canvas>", "</canvas>"), ("<video>", "</video>")],
)
def test_unrendered_tables(table, before, after):
    seen = "s\n\n" if "summary" in before else ""
    assert html_layout.render(before + table + after + "<p>a</p><p>b</p>") == seen + "a\n\nb"
    assert html_layout.render(table.replace("<table>", "<table hidden>", 1) + "a") == "a"


class Words(HTMLParser):
    """Words in the body that are not in an unseen element; the pages here hide nothing by style."""

    def __init__(self):
        super().__init__()
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style", "head", "noscript", "template")

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style", "head", "noscript", "template")

    def handle_data(self, data):
        if not self.depth:
            self.out += [w for w in re.split(r"[ \t\n\r\f]+", data) if w]


def test_words_of_pages_match_an_event_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r.text for r in QUERIES["op9_html_layout"](spark, sf_dir).collect()}
    squeeze = lambda words: "".join(words)
    for p in pages:
        if "hidden" in p.html or "display:none" in p.html:
            continue
        plain = Words()
        plain.feed(p.html)
        plain.close()
        lines = [re.sub(r"^ *(- |\d+\. )", "", x) if "<li" in p.html else x for x in got[p.page_id].split("\n")]
        assert squeeze(squeeze(lines).split()) == squeeze(squeeze(re.sub(r"^(- |\d+\. )", "", w) for w in plain.out).split())


def test_awkward_pages(spark):
    rows = [(1, None, "x"), (None, "<p>a", "x"), (2, "<div>" * 50_000 + "deep", "x"), (2, "<div>" * 50_000 + "deep", "x"), (3, "<table>" * 500 + "t", "x"), (4, "<a b='" * 20_000, "x")]
    out = html_layout.visible_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in out)[:5] == [(0, "a"), (1, ""), (2, "deep"), (2, "deep"), (3, "t")]
    assert html_layout.visible_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


# --- pipeline


def test_pipeline_matches_plain_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from veilsight.llm.queries import tokenizer_path

    good = {r.doc_id for r in QUERIES["op5_quality"](spark, sf_dir).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.doc_id in good]
    last = {}
    for d, t in rows:
        last[lower(t)] = max(d, last.get(lower(t), d))
    rows = [(d, t) for d, t in rows if last[lower(t)] == d]
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, near_groups(rows), strict=True) if c == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r, found in zip(rows, contaminated(rows, items), strict=True) if not found[-1]]
    library = Tokenizer.from_file(tokenizer_path())
    want = []
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False))))
    assert rows_of(P.run(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert fingerprint("") == 0


def test_stages_take_awkward_and_empty_documents(spark, sf_dir):
    import corpus_pipeline as P

    for rows in ([], awkward()):
        docs = frame(spark, rows)
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            assert out.count() <= len(rows)
        assert P.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)
