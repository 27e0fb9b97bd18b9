"""Line deduplication by content-defined chunks of lines, in DataFrame functions only.

A text is cut into lines; a rolling hash over the hashes of two neighbouring
lines decides from the lines alone whether a chunk ends there, so an insertion
shifts no boundary but the nearest ones. A chunk of several lines that occurs
again anywhere in the corpus is removed; its first occurrence stays.

The pipeline goes by passages instead, wherever chunks end: every repeated run
of lines that is long enough is the union of short windows of lines, each found
again by its hash and compared by its bytes, so whole runs go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, id_and_text
from .exact import filter_bits, is_set

#: A chunk ends after a pair of lines whose rolling hash is divisible by this; the factor of that hash.
DIVISOR, FACTOR = 3, 31
#: A chunk counts from so many lines and so many characters.
MIN_LINES, MIN_CHARS = 2, 40
#: A single line is a passage from so many words; no window has more lines than SPAN (each newline is a character).
LONG_WORDS, SPAN = 50, MIN_CHARS + 1


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row.

    A plain projection would be merged into the lambdas that read the column
    and be computed again for each of their elements; a generator is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def chunked(rows: DataFrame, text: Column | None = None, name: str = "chunks") -> DataFrame:
    """Adds the column ``name``, array<struct<body, n_lines>>; joined by newlines, the bodies are the text."""
    held = _held(rows, "__lines", F.split(F.col("text") if text is None else text, "\n", -1))
    held = _held(held, "__hashes", F.transform("__lines", _line_hash))
    # An end at i (counted from 1) puts lines up to i in one chunk; the last line always ends one.
    pairs = F.zip_with(
        "__hashes", F.concat(F.array(F.lit(None).cast("long")), "__hashes"), lambda h, before: F.pmod(before * FACTOR + h, F.lit(DIVISOR)) == 0
    )
    ends = F.filter(
        F.transform(F.slice(pairs, 1, F.size("__hashes")), lambda end, i: F.when(end | (i + 1 == F.size("__hashes")), i + 1)),
        lambda i: i.isNotNull(),
    )
    held = _held(held, "__ends", ends)
    chunks = F.zip_with(
        F.concat(F.array(F.lit(0)), F.slice("__ends", 1, F.size("__ends") - 1)),
        "__ends",
        lambda start, end: F.struct(F.array_join(F.slice("__lines", start + 1, end - start), "\n").alias("body"), (end - start).alias("n_lines")),
    )
    return _held(held, name, chunks).drop("__lines", "__hashes", "__ends")


def _repeated(places: DataFrame, keys: DataFrame) -> DataFrame:
    """A table of the rows of ``places`` whose key repeats among ``keys``, and a few more, without a shuffle of places.

    Keys are summed before they shuffle: a passage of a third of all rows is
    one row a task. Those that repeat are written, and packed into bitmaps of
    16 MB together at most, which go to all tasks; a full bitmap lets more rows
    through, which the comparison of bodies sorts out.
    """
    seen = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "seen")
    at = F.pmod("key", F.lit(filter_bits(seen.count()))) + 1
    maps = seen.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bitmap"))
    rows = places.join(F.broadcast(maps), F.bitmap_bucket_number(at) == F.col("__bucket"))
    bodies = cut(rows.where(is_set(F.col("__bitmap"), at - 1)).select(*places.columns), "bodies")
    discard(seen)
    return bodies


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __chunks (all chunks of each text) and __left (those that stay)."""
    last = F.lit((1 << 63) - 1)
    base = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    places = chunked(base).select(
        F.coalesce("doc_id", last).alias("doc"), "text_key", F.posexplode("chunks").alias("at", "chunk")
    )
    places = places.where((F.col("chunk.n_lines") >= MIN_LINES) & (F.length("chunk.body") >= MIN_CHARS)).select(
        "doc", "text_key", "at", F.col("chunk.body").alias("body"), F.xxhash64("chunk.body").alias("key")
    )
    bodies = _repeated(places, places.select("key"))
    first = bodies.groupBy("key", "body").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select(F.col("key").alias("k"), F.col("body").alias("b"), "first_doc"), "first")
    marks = (
        bodies.join(first, (F.col("key") == F.col("k")) & (F.col("body") == F.col("b")))
        .groupBy(F.col("doc").alias("__doc"), F.col("text_key").alias("__marked"))
        .agg(F.collect_set(F.struct("at", (F.col("doc") > F.col("first_doc")).alias("later"))).alias("__marks"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = (F.coalesce(F.col(id_col).cast("long"), last) == F.col("__doc")) & (F.xxhash64(text) == F.col("__marked"))
    out = docs.join(marks, own, "left").drop("__doc", "__marked")
    out = chunked(out, text, "__chunks")
    out = _held(out, "__bodies", F.transform("__chunks", lambda c: c["body"]))
    later = F.transform(F.filter("__marks", lambda m: m["later"]), lambda m: m["at"])
    # Within the first document itself only the first place of a chunk stays.
    again = F.filter("__marks", lambda m: ~m["later"] & (F.array_position("__bodies", F.get("__bodies", m["at"])) - 1 < m["at"]))
    out = _held(out, "__gone", F.coalesce(F.concat(later, F.transform(again, lambda m: m["at"])), F.array().cast("array<int>")))
    left = F.filter("__chunks", lambda c, i: ~F.array_contains(F.col("__gone"), i))
    return _held(out, "__left", left).drop("__marks", "__bodies", "__gone")


def _text(chunks: str) -> Column:
    return F.array_join(F.transform(chunks, lambda c: c["body"]), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (what is left), n_lines, n_removed (lines).

    A chunk of at least MIN_LINES lines and MIN_CHARS characters is removed
    wherever it is not the first occurrence, by ascending doc_id, then place.
    Bodies are grouped by their bytes, not by a hash alone. Null texts count
    as empty; an empty text has one empty line. Null ids come last. Rows with
    the same id count as one document: each keeps the first occurrence. An
    empty table gives an empty result. Other columns are not read.
    """
    lines = lambda a: F.aggregate(a, F.lit(0), lambda s, c: s + c["n_lines"]).cast("long")
    out = _marked(id_and_text(docs, id_col, text_col), "doc_id", "text")
    return out.select(
        "doc_id", _text("__left").alias("text"), lines("__chunks").alias("n_lines"), (lines("__chunks") - lines("__left")).alias("n_removed")
    )


def _enough(lines: Column) -> Column:
    """Of how many of the first lines a window consists: the fewest that make a passage; null if all are too few."""
    whole = lambda s: (s["n"] >= MIN_LINES) & (s["chars"] >= MIN_CHARS)
    return F.aggregate(
        lines,
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("chars")),
        lambda s, line: F.when(whole(s), s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["chars"] + 1 + F.length(line)).alias("chars"))),
        lambda s: F.when(whole(s), s["n"]),
    )


def windowed(rows: DataFrame) -> DataFrame:
    """Adds __lines and __spans, the windows of ``text`` as array<long>: first line (from 0) * (SPAN + 1) + number of lines.

    There is the shortest passage from each line on, the shortest up to each
    line, and each line of LONG_WORDS words. A run of lines that makes a passage
    is covered by those inside it, and these depend on nothing outside it.
    """
    held = _held(rows, "__lines", F.split("text", "\n", -1))
    held = _held(held, "__sizes", F.transform("__lines", F.length))
    pair = lambda i: F.get("__sizes", i) + F.get("__sizes", i + 1) + 1 >= MIN_CHARS
    code = lambda at, n: (at * (SPAN + 1) + n).cast("long")
    onward = F.transform("__lines", lambda _, i: code(i, F.when(pair(i), 2).otherwise(_enough(F.slice("__lines", i + 1, SPAN)))))
    # Where two neighbours suffice, the window up to the second is the one from the first on.
    start = lambda i: F.greatest(i + 1 - SPAN, F.lit(0))
    back = lambda i: _enough(F.reverse(F.slice("__lines", start(i) + 1, i + 1 - start(i))))
    upto = F.transform("__lines", lambda _, i: F.when(pair(i - 1), None).otherwise(F.transform(F.array(back(i)), lambda n: code(i + 1 - n, n))[0]))
    long = lambda line: (F.length(line) >= 2 * LONG_WORDS - 1) & (F.regexp_count(line, F.lit(r"\S+")) >= LONG_WORDS)
    single = F.transform("__lines", lambda line, i: F.when(long(line), code(i, F.lit(1))))
    return _held(held, "__spans", F.filter(F.array_union(F.array_union(onward, upto), single), lambda s: s.isNotNull())).drop("__sizes")


def _at(span: Column) -> Column:
    return F.floor(span / (SPAN + 1)).cast("int")


def _lines_of(span: Column) -> Column:
    return F.pmod(span, F.lit(SPAN + 1)).cast("int")


def _body(span: Column) -> Column:
    return F.array_join(F.slice("__lines", _at(span) + 1, _lines_of(span)), "\n")


def _repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__doc, __marked, __gone) of the texts with repeats: id, text hash, and runs of lines to remove as struct<first, last>."""
    base = id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("text_key"), "text"
    )
    base = windowed(base).drop("text")
    keys = base.select(F.explode(F.transform("__spans", lambda s: F.xxhash64(_body(s)))).alias("key"))
    # Sorted, a window stands behind the one before it in its own text that has the same bytes.
    own = F.sort_array(F.transform("__spans", lambda s: F.struct(F.xxhash64(_body(s)).alias("key"), _body(s).alias("body"), _at(s).alias("at"), _lines_of(s).alias("n"))))
    own = _held(base.where(F.size("__spans") > 0), "__own", own)
    before = F.transform("__own", lambda w, i: F.struct(w.alias("w"), F.when(F.get("__own", i - 1)["body"] == w["body"], F.get("__own", i - 1)["at"]).alias("before")))
    places = own.select("doc", "text_key", F.explode(before).alias("p")).select(
        "doc", "text_key", F.col("p.w.key").alias("key"), F.col("p.w.body").alias("body"), F.col("p.w.at").alias("at"), F.col("p.w.n").alias("n"), F.col("p.before").alias("before")
    )
    bodies = _repeated(places, keys)
    first = bodies.groupBy("key", "body").agg(F.min("doc").alias("first_doc"), F.count("*").alias("found")).where("found > 1")
    first = cut(first.select(F.col("key").alias("k"), F.col("body").alias("b"), "first_doc"), "first")
    # Within the first document a window's lines go if it stood before, but never a line of that earlier place.
    begin = F.when(F.col("doc") > F.col("first_doc"), F.col("at")).otherwise(F.greatest(F.col("at"), F.col("before") + F.col("n")))
    return (
        bodies.join(first, (F.col("key") == F.col("k")) & (F.col("body") == F.col("b")))
        .where("doc > first_doc or before is not null")
        .groupBy(F.col("doc").alias("__doc"), F.col("text_key").alias("__marked"))
        .agg(F.collect_set(F.struct(begin.alias("first"), (F.col("at") + F.col("n") - 1).alias("last"))).alias("__gone"))
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without the passages that occurred before, by ascending doc_id, then place.

    A passage is a run of at least MIN_LINES lines and MIN_CHARS characters, or
    a line of LONG_WORDS words or more; every repeated one goes whole, wherever
    it stands. The first occurrence of each line stays. Nulls and repeated
    ids are treated as by :func:`line_dedup`.
    """
    last = F.lit((1 << 63) - 1)
    marks = _repeated_lines(docs, id_col, text_col)
    # All of a row but its text goes as one column, so that none of its names can clash with those below.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("__row")
    rows = docs.select(row, F.coalesce(F.col(id_col).cast("long"), last).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    out = rows.join(marks, (F.col("__id") == F.col("__doc")) & (F.xxhash64("__text") == F.col("__marked")), "left")
    out = _held(out, "__lines", F.when(F.col("__gone").isNotNull(), F.split("__text", "\n", -1)))
    gone = F.flatten(F.transform("__gone", lambda r: F.sequence(r["first"], r["last"])))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone)
    out = _held(out, "__left", F.when(F.col("__gone").isNotNull(), left))
    kept = F.array_join(F.transform("__left", lambda i: F.get("__lines", i)), "\n")
    whole = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(kept)
    return out.select(*[(whole if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns])
