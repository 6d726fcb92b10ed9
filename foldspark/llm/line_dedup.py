"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only (operator 10).

A line is a run of words between line breaks.  Two lines are copies within the edit bound if one becomes the other by
at most one word edit (substitution, insertion, deletion); lines shorter than ``near_words`` words must be equal, and
lines of fewer than ``min_words`` words (1: every line with a word counts) are never removed.  A line goes if an earlier
one, in the order of places (doc_id, text, line number), is a copy of it, whether or not that one stays.

1. Equal lines meet by a 128-bit hash; only the hash, place and pigeonhole keys of a line are shuffled.
2. One edit leaves the first or the last ``m`` words as they are, for any ``m`` up to half the words.  Lines that
   share neither with another line cannot have a copy and leave (``m`` depends on the power of two below the words).
3. Of the rest, all variants are emitted as hashed keys: the line itself and the line without each one of its words
   (outside a shared half: an edit cannot lie in it).
   Equal variants with the same gap differ in one word at most; a line that equals a variant of another lacks one.
4. For each key only the earliest holder is kept (aggregated before the shuffle); every other holder is compared with it,
   so a key held by many lines costs a row per holder, never a pair of holders.  The words are compared exactly.

Cases: null text or null doc_id: nothing is removed and nothing counted; empty lines and lines of white space stay; rows
that repeat doc_id and text count as one; rows that repeat a doc_id with another text are texts of their own, told
apart by ``text_id`` (0 where a doc_id has one text); very long texts are read whole, their lines are rows; an empty
table gives an empty result; other columns, whatever their names, are kept by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import materialise, with_text_id

#: Columns of a place, in their order.
_PLACE = ["doc_id", "text_id", "line_no"]


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_words(line: Column) -> Column:
    """Words between spaces and tabs."""
    return F.array_remove(F.split(F.translate(line, "\t", " "), " "), "")


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit("second"), line)


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _half_length(n: Column, below: Column) -> Column:
    """Words of a half: half the power of two at or under ``n``, or half of that where ``below`` is 1."""
    return F.pow(F.lit(2), F.floor(F.log2(n.cast("double")) + 1e-9) - 1 - below).cast("int")


def _half_keys(words: Column, n: Column, m: Column) -> list[Column]:
    """Hashes of the first and of the last ``m`` words."""
    return [F.xxhash64(F.lit(1), m, F.slice(words, F.lit(1), m)), F.xxhash64(F.lit(2), m, F.slice(words, n - m + 1, m))]


def distinct_lines(documents: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """(h1, h2, doc_id, text_id, line_no, n, halves): every different line with its earliest place and its keys of step 2.

    A line of a power of two words also meets lines with one word less, whose halves are half as long: it has both
    lengths' keys, first and last words in turn.
    """
    def read(line: Column) -> Column:   # once for each line: the words are used many times below
        h1, h2 = _hashes(line)
        return F.struct(h1.alias("h1"), h2.alias("h2"), line_words(line).alias("words"))

    lines = documents.filter("doc_id is not null and text is not null").select(
        "doc_id", "text_id", F.posexplode(F.transform(split_lines(F.col("text")), read)).alias("line_no", "line"))
    lines = lines.select(*_PLACE, "line.*").withColumn("n", F.size("words")).filter(F.col("n") >= min_words)
    words, n = F.col("words"), F.col("n")
    m, less = _half_length(n, F.lit(0)), _half_length(n, F.lit(1))
    halves = F.when(n < near_words, None).when(n == 2 * m, F.array(*_half_keys(words, n, m), *_half_keys(words, n, less))) \
        .otherwise(F.array(*_half_keys(words, n, m)))
    keyed = lines.select("h1", "h2", *_PLACE, "n", halves.alias("halves"))
    return keyed.groupBy("h1", "h2").agg(
        F.min(F.struct(*_PLACE)).alias("first"), F.first("n").alias("n"),
        F.first("halves").alias("halves")).select("h1", "h2", "first.*", "n", "halves")


def near_candidates(distinct: DataFrame) -> DataFrame:
    """(doc_id, text_id, line_no, first_gap, last_gap): lines that share a half with another, and where an edit can be."""
    halves = distinct.filter("halves is not null").select(
        *_PLACE, "n", F.posexplode("halves").alias("kind", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("holders")).filter("holders > 1").select("half")
    m = _half_length(F.col("n"), F.floor(F.col("kind") / 2))
    first = F.col("kind") % 2 == 0
    return halves.join(shared, "half").groupBy(*_PLACE).agg(
        F.min(F.when(first, m + 1).otherwise(1)).alias("first_gap"),
        F.max(F.when(first, F.col("n")).otherwise(F.col("n") - m)).alias("last_gap"))


def line_variants(lines: DataFrame) -> DataFrame:
    """(variant, left, gap, doc_id, text_id, line_no): the line (gap 0) and the line without its word number ``gap``."""
    hashed, n = F.col("hashed"), F.size("hashed")
    whole = F.struct(F.xxhash64("hashed").alias("variant"), n.alias("left"), F.lit(0).alias("gap"))
    without = F.transform(F.sequence(F.col("first_gap"), F.col("last_gap")), lambda i: F.struct(
        F.xxhash64(F.slice(hashed, F.lit(1), i - 1), F.slice(hashed, i + 1, n)).alias("variant"),
        (n - 1).alias("left"), i.alias("gap")))
    rows = lines.select(*_PLACE, "first_gap", "last_gap", _word_hashes(F.col("words")).alias("hashed"))
    return rows.select(*_PLACE, F.explode(F.concat(F.array(whole), without)).alias("v")) \
        .select("v.variant", "v.left", "v.gap", *_PLACE)


def _without(words: Column, gap: Column) -> Column:
    return F.when(gap == 0, words).otherwise(F.concat(
        F.slice(words, F.lit(1), F.greatest(gap - 1, F.lit(0))), F.slice(words, gap + 1, F.size(words))))


def near_copies(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """(place, kept place): first places of lines with an earlier line one word edit away, and the earliest such line."""
    wanted = materialise(near_candidates(distinct), "near-lines")
    by_doc = wanted.groupBy("doc_id", "text_id").agg(
        F.collect_set(F.struct("line_no", "first_gap", "last_gap")).alias("numbers"))  # at most the lines of a document
    texts = documents.filter("doc_id is not null and text is not null").select("doc_id", "text_id", "text")
    # the same plan at every size: the texts are dealt by document, the list of lines is never broadcast
    lines = texts.hint("merge").join(by_doc.hint("merge"), ["doc_id", "text_id"]).select(
        "doc_id", "text_id", F.inline("numbers"), split_lines(F.col("text")).alias("lines"))
    lines = lines.select(*_PLACE, "first_gap", "last_gap",
                         line_words(F.element_at("lines", F.col("line_no") + 1)).alias("words"))
    lines = materialise(lines.dropDuplicates(_PLACE), "candidate-lines")
    variants = materialise(line_variants(lines), "variants")
    lines = lines.select(*_PLACE, "words")
    place = F.struct(*_PLACE)
    # same words around the same gap: the earliest holder stands for the key
    gaps = variants.filter("gap > 0")
    leader = gaps.groupBy("variant", "left", "gap").agg(F.min(place).alias("k"), F.count("*").alias("holders")) \
        .filter("holders > 1").drop("holders")
    edits = gaps.join(leader, ["variant", "left", "gap"]).filter(place > F.col("k")).select(
        place.alias("p"), F.col("gap").alias("own_gap"), "k", F.col("gap").alias("kept_gap"))
    # a whole line and the lines that have one word more
    whole = variants.filter("gap = 0").select("variant", "left", place.alias("w"))
    lacks = gaps.join(whole, ["variant", "left"])
    later = place > F.col("w")
    lacks = lacks.select(
        F.when(later, place).otherwise(F.col("w")).alias("p"), F.when(later, F.col("gap")).otherwise(0).alias("own_gap"),
        F.when(later, F.col("w")).otherwise(place).alias("k"), F.when(later, 0).otherwise(F.col("gap")).alias("kept_gap"))
    kept_place = ["kept_" + c for c in _PLACE]
    found = edits.unionByName(lacks).distinct().select(
        "p.*", "own_gap", *[F.col(f"k.{c}").alias(f"kept_{c}") for c in _PLACE], "kept_gap")
    kept = lines.select(*[F.col(c).alias(f"kept_{c}") for c in _PLACE], F.col("words").alias("kept_words"))
    found = found.join(lines, _PLACE).join(kept, kept_place)
    exact = _without(F.col("words"), F.col("own_gap")) == _without(F.col("kept_words"), F.col("kept_gap"))
    return found.filter(exact).groupBy(*_PLACE).agg(F.min(F.struct(*kept_place)).alias("k")).select(*_PLACE, "k.*")


def removed_lines(documents: DataFrame, min_words: int = 1, near_words: int = 8) -> DataFrame:
    """Every line that goes: (doc_id, text_id, line_no, edits, kept_doc_id, kept_text_id, kept_line_no) (operator 10).

    edits 0: an equal line came before, at the place kept; edits 1: no equal line came before, but one within one
    word edit did, the earliest at the place kept.
    """
    documents = with_text_id(documents.select("doc_id", "text")).withColumnRenamed("__text", "text_id")
    return _removed(documents, min_words, near_words)


def _removed(documents: DataFrame, min_words: int, near_words: int) -> DataFrame:
    distinct = materialise(distinct_lines(documents, min_words, near_words), "distinct-lines")
    near = near_copies(documents, distinct).withColumn("edits", F.lit(1))
    lines = documents.filter("doc_id is not null and text is not null").select(
        "doc_id", "text_id", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    h1, h2 = _hashes(F.col("line"))
    # shorter lines have too few words; those left that are no line of step 1 find no partner
    places = lines.filter(F.length("line") >= 2 * min_words - 1).select(*_PLACE, h1.alias("h1"), h2.alias("h2"))
    first = distinct.select("h1", "h2", *[F.col(c).alias(f"kept_{c}") for c in _PLACE])
    kept_place = [f"kept_{c}" for c in _PLACE]
    again = places.join(first, ["h1", "h2"]).filter(F.struct(*_PLACE) != F.struct(*kept_place)) \
        .select(*_PLACE, F.lit(0).alias("edits"), *kept_place).distinct()
    return again.unionByName(near)


def dedup_lines(documents: DataFrame, min_words: int = 1, near_words: int = 8) -> DataFrame:
    """The documents without the lines that go; all columns are kept, and ``n_chars`` follows the text if present."""
    named = with_text_id(documents)
    gone = _removed(named.select("doc_id", "text", F.col("__text").alias("text_id")), min_words, near_words)
    by_doc = materialise(gone.groupBy(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__own"))
                         .agg(F.collect_set("line_no").alias("__gone")), "gone-lines")
    joined = named.join(by_doc, (F.col("doc_id") == F.col("__doc")) & (F.col("__text") == F.col("__own")), "left")
    stays = F.filter(split_lines(F.col("text")), lambda line, i: ~F.array_contains(F.col("__gone"), i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    columns = [F.col(c) if c not in ("text", "n_chars") else
               (text.alias(c) if c == "text" else
                F.when(F.col("__gone").isNull(), F.col(c)).otherwise(F.length(text)).cast(documents.schema[c].dataType)
                .alias(c)) for c in documents.columns]
    return joined.select(*columns)


ORACLE = """
with docs as (select distinct doc_id, text from documents where doc_id is not null and text is not null),
numbered as (select doc_id, text, row_number() over (partition by doc_id order by text) as t from docs),
lines as (select doc_id, t, unnest(range(len(l))) as no, unnest(l) as line
          from (select doc_id, t, string_split(text, chr(10)) as l from numbered)),
worded as (select doc_id, t, no, line, list_filter(regexp_split_to_array(line, '[ \t]+'), lambda w: w <> '') as ws from lines),
usable as (select * from worded where len(ws) >= 1),
firsts as (select line, any_value(ws) as ws, min({'d': doc_id, 't': t, 'n': no}) as f from usable group by line),
near as (select f, ws, unnest(range(1, len(ws) + 1)) as gap from firsts where len(ws) >= 8),
variants as (select f, gap, list_concat(ws[1:gap - 1], ws[gap + 1:]) as v from near),
pairs as (select a.f as late, b.f as early from variants a join variants b on a.v = b.v and a.gap = b.gap and a.f > b.f
          union select greatest(a.f, b.f), least(a.f, b.f) from variants a join firsts b on a.v = b.ws
                where len(b.ws) >= 8 and a.f <> b.f)
select u.doc_id, u.no::int as line_no, 0 as edits, f.f.d as kept_doc_id, f.f.n::int as kept_line_no
from usable u join firsts f using (line) where {'d': u.doc_id, 't': u.t, 'n': u.no} <> f.f
union all
select late.d, late.n::int, 1, min(early).d, min(early).n::int from pairs group by late
"""
