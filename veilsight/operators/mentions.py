"""Mentions of a lexicon that is too large for one pattern.

Between word edges a name starts and ends where a piece of text does: a word, or a single
other character. A bitmap of bounded size holds the hashes of all names and of their first
pieces. Runs of pieces that it rejects are no names and never leave their row; the others
are joined to the names by their text, so nothing the bitmap lets through by chance
remains. A text is read once, and what is shuffled is about as much as there are mentions.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SNIPPET_CHARS
from ..functions.arrays import empty_array, let, running
from ..functions.textmatch import WORD, translated
from ..functions.windows import text_chunks, window_text

_SPAN = "s int, e int, raw string, snippet string"
#: A bitmap has about so many bits a name, and no more than 8 MB in all; a larger lexicon lets more through to the join.
BITS_A_NAME, MOST_BITS = 32, 1 << 26
#: Pieces whose lengths are added up at once, and characters of a chunk that snippets are cut from.
_BLOCK, _CHUNK = 16, 128
_PIECE = rf"([{WORD}]+|[^{WORD}])"


@cache
def _folds() -> tuple[str, str]:
    """Characters whose case-insensitive form isn't their lower case: upper-cased first they meet another letter's."""
    odd = {"İ": "i"}
    for code in range(128, 0x2FFF):
        char = chr(code)
        upper = char.upper() if len(char.upper()) == 1 else char
        lower = upper.lower() if len(upper.lower()) == 1 else "i"
        if lower != char.lower() and len(char) == len(lower):
            odd[char] = lower
    return "".join(odd), "".join(odd.values())


def folded(text: Column) -> Column:
    """Text as patterns see it that ignore case; as many characters as before."""
    odd, plain = _folds()
    # the ends of words matter to lower(), so a last sigma is exchanged afterwards
    return translated(F.lower(translated(text, odd, plain)), "ς", "σ")


def _is_word(char: Column) -> Column:
    return char.rlike(rf"^[{WORD}]")


def pieces_in(text: Column) -> Column:
    """Of how many pieces a text is."""
    return F.size(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1)))


def runs_of(text: Column, sizes: Column) -> Column:
    """(s, h): where each run of so many pieces (an array of numbers) starts, and the hash of its folded text."""
    ddl = "struct<s:int,p:string>"

    def step(at, piece):
        return at + F.length(piece), F.array(F.struct(at.alias("s"), folded(piece).alias("p")))

    def hashes(places):
        def of(size):
            n = F.size(places) - size + 1
            return F.when(
                n > 0,
                F.transform(
                    F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: F.struct(
                        F.get(places, i - 1)["s"].alias("s"),
                        F.xxhash64(F.array_join(F.transform(F.slice(places, i, size), lambda x: x["p"]), "")).alias("h"),
                    ),
                ),
            ).otherwise(empty_array("struct<s:int,h:bigint>"))

        return F.flatten(F.transform(sizes, of))

    return let(running(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1)), F.lit(0), ddl, step), hashes)


def name_bitmap(names: DataFrame, bits: int) -> Column:
    """One value, an array of longs: two bits set for each name and for its first piece, `bits` (a power of two) in all."""
    first = F.regexp_extract("name", rf"^{_PIECE}", 1)
    hashes = names.select(F.explode(F.array(F.xxhash64("name"), F.xxhash64(first))).alias("h"))
    ones = hashes.select(F.explode(F.array(*_bits_of(F.col("h"), bits))).alias("at"))
    set_words = ones.select(F.shiftright("at", 6).alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int")).alias("w"))
    clear = names.sparkSession.range(bits // 64).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("w"))
    words = set_words.union(clear).groupBy("k").agg(F.bit_or("w").alias("w"))  # MOST_BITS / 64 rows
    return words.agg(F.sort_array(F.collect_list(F.struct("k", "w")))["w"].alias("words")).scalar()


def _bits_of(h: Column, bits: int) -> list[Column]:
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def _may_be(bitmap: Column, h: Column, bits: int) -> Column:
    def both(h):
        one, two = [F.bit_get(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1 for at in _bits_of(h, bits)]
        return one & two

    return let(h, both)


def candidates(text: Column, sizes: list[int], bitmap: Column, bits: int, blank_first: bool = True) -> Column:
    """(s, e, name, raw, snippet) of runs of pieces between word edges that a bitmap lets through; name is the folded text.

    Without ``blank_first`` no name starts with a blank, and those, half of all pieces, are not looked up.
    """

    def in_pieces(pieces, bitmap):
        def first(p):
            found = _may_be(bitmap, F.xxhash64(p), bits)
            return found if blank_first else (p != " ") & found

        likely = F.filter(F.transform(pieces, lambda p, i: F.when(first(p), i)), lambda i: i.isNotNull())

        def runs(i):
            of = F.array(*[F.when(i + n <= F.size(pieces), F.array_join(F.slice(pieces, i + 1, F.lit(n)), "")) for n in sizes])
            return F.transform(F.filter(of, lambda t: t.isNotNull() & _may_be(bitmap, F.xxhash64(t), bits)), lambda t: F.struct(i.alias("i"), t.alias("name")))

        return F.flatten(F.transform(likely, runs))

    def edged(pieces, x):
        # pieces are whole words or single other characters: only beside the latter an edge may be missing
        def word(i):
            return F.coalesce(_is_word(F.get(pieces, i)), F.lit(False))

        end = x["i"] + pieces_in(x["name"])
        return (word(x["i"] - 1) != word(x["i"])) & (word(end - 1) != word(end))

    def placed(found, pieces, chunks):
        last = F.floor(F.size(pieces) / _BLOCK).cast("int")
        lengths = F.transform(F.sequence(F.lit(0), last), lambda k: F.length(F.array_join(F.slice(pieces, k * _BLOCK + 1, F.lit(_BLOCK)), "")))
        before = running(lengths, F.lit(0), "int", lambda at, n: (at + n, F.array(at)))

        def one(x, starts):
            block = F.floor(x["i"] / _BLOCK).cast("int")
            inner = F.length(F.array_join(F.slice(pieces, block * _BLOCK + 1, x["i"] - block * _BLOCK), ""))
            return let(F.struct((F.get(starts, block) + inner).alias("s"), F.length(x["name"]).alias("n")), lambda at: cut(x["name"], at["s"], at["n"]))

        def cut(name, s, n):
            low = F.greatest(s - SNIPPET_CHARS, F.lit(0))
            return let(window_text(chunks, low, s + n + SNIPPET_CHARS, _CHUNK), lambda around: F.struct(
                s.alias("s"), (s + n).alias("e"), name.alias("name"), F.substring(around, s - low + 1, n).alias("raw"), around.alias("snippet")
            ))

        return let(before, lambda starts: F.transform(F.filter(found, lambda x: edged(pieces, x)), lambda x: one(x, starts)))

    pieces = F.regexp_extract_all(folded(text), F.lit(_PIECE), F.lit(1))
    # nothing more is computed for a text without a likely run
    nothing = empty_array("struct<s:int,e:int,name:string,raw:string,snippet:string>")
    return let(pieces, lambda p: let(let(bitmap, lambda b: in_pieces(p, b)), lambda found: F.when(
        F.size(found) > 0, let(text_chunks(text, _CHUNK), lambda chunks: placed(found, p, chunks))
    ).otherwise(nothing)))


def _repeats(df: DataFrame, key: str) -> bool:
    """Whether a key occurs twice; only the keys are read."""
    return not df.groupBy(key).count().filter("count > 1").isEmpty()


def occurrences_by_join(articles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Leftmost-longest mentions: (article_idx, s, e, raw, snippet).

    ``articles`` has article_idx and normalised ``_text`` (null has no mentions); ``lexicon``
    has ``name``, in any case; null and empty names and repeated ones count for nothing.
    """
    names = lexicon.select(folded(F.col("name")).alias("name")).filter("name <> ''").distinct()
    size = names.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(pieces_in(F.col("name")))).alias("sizes"), F.max(F.col("name").startswith(" ")).alias("blank_first")).first()  # lengths of names, in pieces
    if not size.n:
        return articles.select("article_idx", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _SPAN.split(", "))]).limit(0)
    bits = min(MOST_BITS, 1 << max(12, (size.n * BITS_A_NAME - 1).bit_length()))
    found = candidates(F.col("_text"), size.sizes, F.col("_bitmap"), bits, size.blank_first)
    # a subquery: sent once to each task; a row of a text carries it (8 MB at most) no further than to its runs
    with_bitmap = articles.select("article_idx", "_text", name_bitmap(names, bits).alias("_bitmap"))
    likely = with_bitmap.select("article_idx", F.explode_outer(found).alias("h")).filter("h is not null").select("article_idx", "h.*")
    exact = likely.join(names, "name", "left_semi").select("article_idx", "s", "e", "raw", "snippet")
    if size.sizes == [1] and not _repeats(articles, "article_idx"):
        return exact  # different pieces of one text don't overlap, so nothing is to be brought together by article
    ordered = F.array_sort(F.collect_list(F.struct("s", (-F.col("e")).alias("back"), "raw", "snippet")))  # bounded by the text of one article

    def step(last_end, h):
        free = h["s"] >= last_end
        kept = F.array(F.struct(h["s"].alias("s"), (-h["back"]).alias("e"), h["raw"].alias("raw"), h["snippet"].alias("snippet")))
        return F.when(free, -h["back"]).otherwise(last_end), F.when(free, kept).otherwise(empty_array(f"struct<{_SPAN}>"))

    hits = running(F.col("_found"), F.lit(0), f"struct<{_SPAN}>", step)
    grouped = exact.groupBy("article_idx").agg(ordered.alias("_found"))
    return grouped.select("article_idx", F.explode_outer(hits).alias("h")).filter("h is not null").select("article_idx", "h.*")


def edges(w: Column) -> Column:
    """Whether what stands in a window at b, n long, has word edges on both sides."""
    first, last = F.substring(w["t"], w["b"] + 1, F.lit(1)), F.substring(w["t"], w["b"] + w["n"], F.lit(1))
    before = F.when(w["b"] > 0, F.substring(w["t"], w["b"], F.lit(1))).otherwise("")
    after = F.substring(w["t"], w["b"] + w["n"] + 1, F.lit(1))
    return (_is_word(before) != _is_word(first)) & (_is_word(last) != _is_word(after))
