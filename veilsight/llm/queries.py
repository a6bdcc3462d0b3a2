"""The operators of this folder as queries over the given tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import bpe, decontaminate, exact_dedup, html_layout, line_dedup, manifest, packing, quality, simhash, spelling, substring_dedup, token_files, warc_audit
from .common import read


AS_OF = "2024-01-31T00:00:00Z"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files in two replicas. In the second, the last sign of some records has been damaged."""
    pages = read(spark, sf_dir, "pages")
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"

    def damage(page_id, record):
        hit = (F.pmod(page_id, F.lit(97)) == 13) & record.endswith(">")
        return F.when(hit, F.concat(F.regexp_replace(record, ">$", ""), F.lit("#"))).otherwise(record)

    warc_audit.write_warc(pages, f"{path}/a", AS_OF)
    warc_audit.write_warc(pages, f"{path}/b", AS_OF, damage)
    found = warc_audit.audit(spark, f"{path}/a", f"{path}/b")
    page_id = F.regexp_extract("record_id", r"page:(-?\d+)", 1).cast("long")
    return found.select(page_id.alias("page_id"), "payload_length", "payload_sha256", "intact")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_similar_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_layout.visible_text(read(spark, sf_dir, "pages"))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audited(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_substring_dedup, op3_exact_dedup, op4_simhash, op5_quality, op6_warc_audit, op7_bpe, op8_line_dedup,
        op9_html_layout, op10_decontaminate, op11_spelling_variants, op12_packing, op13_manifest,
    )
}

#: ASCII lower case in DuckDB: only A-Z change.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 as a macro can't be part of one statement: the table of a byte's remainders, and the fold over a text's bytes.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)"""


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text, where crc_table's t is at hand."""
    code = f"list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({code}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _levels(name: str, first: str, group: str, depth: int) -> str:
    """SQL of a tree of runs of three over first({group}, i, h), of at most 3 ** depth digests a group: {name}0 to {name}{depth},
    with the number of digests in a group, the run's other digests, and the digest above. A lone one stays."""
    out = [f"{name}0 AS (SELECT {group}, i, h FROM {first})"]
    for k in range(depth):
        out.append(
            f"{name}{k}n AS (SELECT {group}, i, h, count(*) OVER (PARTITION BY {group}) AS n FROM {name}{k}),\n"
            f"{name}{k + 1} AS (SELECT {group}, i // 3 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k}n GROUP BY {group}, i // 3)"
        )
    return ",\n".join(out)


def _up(name: str, rows: str, group: str, depth: int) -> str:
    """SQL that takes rows(id, {group}, i, x, w, p) up the tree: x is the digest folded so far, w the siblings so far."""
    out, before = [], rows
    for k in range(depth):
        step = f"{name}_{k}"
        left, right = (f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.i) FROM {name}{k}n s WHERE s.{group} IS NOT DISTINCT FROM r.{group} AND s.i // 3 = r.i // 3 AND s.i {o} r.i), '')" for o in "<>")
        out.append(
            f"{step}s AS (SELECT id, r.{group}, r.i, x, w, n, {left} AS l, {right} AS r FROM {before} r JOIN {name}{k}n m ON m.{group} IS NOT DISTINCT FROM r.{group} AND m.i = r.i),\n"
            f"{step} AS (SELECT id, {group}, i // 3 AS i, CASE WHEN n = 1 THEN x ELSE sha256(l || x || r) END AS x, CASE WHEN n = 1 THEN w ELSE w || l || r END AS w FROM {step}s)"
        )
        before = step
    return ",\n".join(out)


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


#: A tree of 3 ** 14 rows a source, and 3 ** 6 sources.
_DEEP, _WIDE = 14, 6

ORACLE = {
    "op11_spelling_variants": f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+') AS w FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(w) AS run FROM d) WHERE length(run) >= 6 GROUP BY doc_id, run),
c AS (SELECT doc_id, run, n, {_crc32("doc_id || ':' || run")} AS h FROM u, crc_table),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM c),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n AS b_n FROM cut a JOIN cut b USING (i, less) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY b_n DESC, encode(b)) AS b, max(b_n) AS b_n FROM near GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 5 * n THEN b END AS form, CASE WHEN b_n >= 5 * n THEN b_n END AS form_n
      FROM words LEFT JOIN best ON a = word),
up AS (WITH RECURSIVE r(word, cur, k) AS (
         SELECT word, word, 0 FROM f UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN f ON f.word = r.cur WHERE f.form IS NOT NULL)
       SELECT word, max_by(cur, k) AS root FROM r GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN up USING (word)""",
    "op13_manifest": f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('s' || source, '') AS g, {" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))} AS head, text, {_crc32("CAST(doc_id AS VARCHAR)")} AS crc
      FROM documents, crc_table),
e AS (SELECT doc_id, g, sha256(head || {_field("text")}) AS h,
             CASE WHEN crc % 2 = 0 THEN sha256(head || {_field("replace(text, chr(10), '')")}) ELSE sha256(head || {_field("text")}) END AS x FROM d),
leaves AS (SELECT doc_id, g, h, x, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM e),
{_levels("a", "leaves", "g", _DEEP)},
subroots AS (SELECT 0 AS z, g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM a{_DEEP}),
{_levels("b", "subroots", "z", _WIDE)},
low AS (SELECT doc_id AS id, g, i, x, '' AS w FROM leaves),
{_up("a", "low", "g", _DEEP)},
mid AS (SELECT id, 0 AS z, s.i, x, w FROM a_{_DEEP - 1} m JOIN subroots s USING (g)),
{_up("b", "mid", "z", _WIDE)}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(t.w) AS proof_sha256, t.x AS folded_root, t.x = r.h AS verified
FROM leaves l JOIN subroots s USING (g) JOIN b_{_WIDE - 1} t ON t.id = l.doc_id, b{_WIDE} r""",
    "op6_warc_audit": """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_length, sha256(coalesce(html, '')) AS payload_sha256,
       NOT (page_id % 97 = 13 AND coalesce(html, '') LIKE '%>') AS intact
FROM pages""",
    "op2_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM x) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
n AS (SELECT doc_id, count(*) AS n_removed, list(p) AS ps FROM c GROUP BY doc_id),
u AS (SELECT doc_id, word, p FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d)),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u ANTI JOIN c USING (doc_id, p) GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
    "op10_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM g),
win AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
h AS (SELECT a.doc_id, a.k, a.i, g.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM win) a JOIN g USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
