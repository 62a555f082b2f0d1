"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines of at least ``min_chars`` characters take part; with ``short_lines`` all
shorter lines that have a word do so too, as exact repeats only.  Within edit distance
``threshold``, one of the shorter line's ``threshold + 1`` even segments must
occur unchanged in the other, at a place that the difference of lengths narrows
down to a few starts.  So each line is indexed by the hashes of its segments,
under its length, and probes the indexes of its own and up to ``threshold``
shorter lengths with the substrings that could match.

Texts are not shuffled.  A first pass reduces each key to the least and the
largest line hash seen under it, which also folds the copies of a line
together; nearly all keys belong to one line.  A second pass keeps the rows of
keys that two lines share, and texts are fetched for those lines alone.
Where very many lines share a segment, those are dealt out further by the
segments of what stands around it.  Candidates whose counts of letters and
digits differ too much are dropped inside the join; the others are verified by a
banded bit-parallel edit distance.

Lines are told apart by 128 bits: a 64-bit hash, a 32-bit hash and the length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, materialize, settled, shuffled

MIN_CHARS = 40
THRESHOLD = 2
#: Length from which the registered query and the pipeline link lines by edits: two edits are a tenth of it.
LINK_CHARS = 20
# Letters and digits whose counts make a line's profile.
_LETTERS = ("etaonirshldu", "0123456789cm")
_LINE = ["h1", "h2"]
#: Pairs under one key from which its lines are dealt out further, and how often.  Results don't depend on them.
_HOT_PAIRS = 4096
_LEVELS = 5


def _takes_part(line: Column, min_chars: int, short_lines: bool) -> Column:
    long = F.length(line) >= min_chars
    return long | line.rlike(r"[^\x20\x09-\x0D]") if short_lines else long


def _lines(docs: DataFrame, id_column: str, text_column: str, min_chars: int, short_lines: bool) -> DataFrame:
    """``doc, doc_hash, pos, line, n_chars, h1, h2`` of every line that takes part."""
    text = F.col(text_column).cast("string")
    lines = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text).alias("doc_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).filter(_takes_part(F.col("line"), min_chars, short_lines)).withColumn("n_chars", F.length("line"))
    second = F.shiftleft(F.col("n_chars").cast("long"), 32) + F.hash("line").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", second)


def _places(threshold: int) -> Column:
    """Array of ``probes, i, shorter, shift``: index key i of a line, or probe for segment i of a line so much shorter, moved so far."""
    k = threshold + 1
    places = [(False, i, 0, 0) for i in range(k)]
    for shorter in range(k):
        for i in range(k):
            after = threshold - i
            places += [(True, i, shorter, shift) for shift in range(max(-i, shorter - after), min(i, shorter + after) + 1)]
    names = ("probes", "i", "shorter", "shift")
    return F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(p, names, strict=True))) for p in places))


def _spans(threshold: int) -> tuple[Column, Column, Column]:
    """Length of the indexed line, start and width of the segment, for a line of ``n_chars`` at one of ``_places``."""
    k = threshold + 1
    n = F.col("n_chars") - F.col("shorter")
    base = F.call_function("div", n, F.lit(k)).cast("int")  # whole numbers; a length below zero, which no line has, matches nothing either way
    rest = n - base * k
    extra = rest + F.col("i") - k
    return n, base * F.col("i") + F.greatest(F.lit(0), extra) + F.col("shift") + 1, base + (extra >= 0).cast("int")


def _hashed(line: Column, threshold: int, *salt: Column) -> Column:
    """Key of the segment at one of ``_places``; characters of an ASCII line are its bytes, which are found faster, and the hashes are the same."""
    n, start, width = _spans(threshold)
    part = lambda text: F.xxhash64(*salt, "i", n, F.substring(text, start, width))
    return F.when(F.octet_length(line) == F.col("n_chars"), part(line.cast("binary"))).otherwise(part(line))


def _keyed(lines: DataFrame, columns: list[str], threshold: int) -> DataFrame:
    """``columns, key, probes`` for every index key and probe key of ``lines(line, n_chars)``: hashes of segment number, length and substring.

    A segment starts where as many edits before it (at most its number) and
    after it (at most the rest) as remain can move it.  A line of n characters
    has segments of n / (threshold + 1) characters, the last ones longer by one if that
    isn't whole.
    """
    rows = lines.select(*columns, "line", "n_chars", F.inline(_places(threshold)))
    return rows.select(*columns, _hashed(F.col("line"), threshold).alias("key"), "probes")


def _without_segment(rows: DataFrame, threshold: int) -> DataFrame:
    """``rows`` at one of ``_places`` with ``line`` and ``n_chars`` of what stands around the segment."""
    _, start, width = _spans(threshold)
    around = F.concat(F.substring("line", F.lit(1), start - 1), F.substring(F.col("line"), start + width, F.length("line")))
    return rows.withColumn("around", around).select(*_LINE, "key", "probes", "shorter", F.col("around").alias("line"), F.length("around").alias("n_chars"))


def _hot(met: DataFrame) -> DataFrame:
    """Keys under which more than ``_HOT_PAIRS`` pairs of lines meet."""
    sizes = met.groupBy("key").agg(F.count_if("probes").alias("a"), F.count_if(~F.col("probes")).alias("b"))
    return materialize(sizes.filter(F.col("a") * F.col("b") > _HOT_PAIRS).select("key"))


def _refined(met: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """``met`` with the rows of hot keys dealt out by further keys.

    Lines that share a segment and lie within ``threshold`` edits of each other also
    do so without it, so one of the segments of what is left must match in turn.
    That goes on, for the keys that are still hot, as long as there is something left.
    """
    hot = _hot(met)
    if hot.isEmpty():
        return met
    out = met.join(bounded(hot), "key", "left_anti").select("key", "probes", *_LINE)
    rows = texts.select(*_LINE, "line", F.length("line").alias("n_chars"), F.inline(_places(threshold)))
    rows = rows.withColumn("key", _hashed(F.col("line"), threshold)).join(bounded(hot), "key", "left_semi")
    for level in range(_LEVELS):
        rows = materialize(_without_segment(rows, threshold))
        # an index key goes on as one, a probe for shorter lines as a probe for lines shorter by as much
        fits = F.filter(_places(threshold), lambda p: (p["probes"] == F.col("own_probes")) & (p["shorter"] == F.col("own_shorter")))
        rows = rows.withColumnsRenamed({"probes": "own_probes", "shorter": "own_shorter", "key": "parent"}).select(*_LINE, "line", "n_chars", "parent", F.inline(fits))
        rows = materialize(rows.withColumn("key", _hashed(F.col("line"), threshold, F.col("parent"))).drop("parent"))
        found = rows.select("key", "probes", *_LINE).distinct()
        hot = _hot(found)
        if level == _LEVELS - 1 or hot.isEmpty():
            return out.union(found).distinct()
        out = out.union(found.join(bounded(hot), "key", "left_anti"))
        rows = rows.join(bounded(hot), "key", "left_semi")


def _profile(counted: str) -> Column:
    """Counts of some characters modulo 10, as five-bit codes whose neighbours differ in one bit.

    An edit changes at most two counts by one, so it changes at most two bits of all profiles together.
    """
    codes = F.array(*(F.lit((1 << c) - 1 if c <= 5 else 31 ^ ((1 << c - 5) - 1)).cast("long") for c in range(10)))
    letters = F.array(*map(F.lit, counted))

    def add(total: Column, j: Column) -> Column:
        count = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.get(letters, j), F.lit("")))
        return total * 32 + F.get(codes, count % 10)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(counted) - 1)), F.lit(0).cast("long"), add)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two texts whose lengths differ by at most ``threshold``; more than that if it exceeds ``threshold``.

    The cells of a column within ``threshold`` rows of the diagonal are one word of
    2 * threshold + 1 bits for vertical steps up and one for steps down; a
    character of the shorter text moves the whole word along the diagonal.  The
    longer text must have at least ``threshold`` characters.
    """
    k, width = threshold, 2 * threshold + 1
    mask = F.lit((1 << width) - 1).cast("long")
    invert = lambda x: x.bitwiseXOR(mask)
    bit = lambda x, r: F.call_function("shiftright", x, r).bitwiseAND(F.lit(1))
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    # four bytes a character, with characters that match nothing around the longer text
    pad = F.unhex(F.lit("FFFFFFFF" * k))
    texts = F.struct(F.concat(pad, F.encode(longer, "UTF-32"), pad).alias("rows"), F.encode(shorter, "UTF-32").alias("columns"), F.length(longer).alias("m"), F.length(shorter).alias("n"))
    start = F.struct(F.lit(((1 << k + 1) - 1) << k).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(k).alias("distance"))

    def whole(t: Column) -> Column:
        def step(state: Column, j: Column) -> Column:
            up, down = state["up"], state["down"]

            def matches(here: Column) -> Column:
                return sum((F.when(F.substring(t["rows"], 4 * (j + r) + 1, F.lit(4)) == here, F.lit(1 << r)).otherwise(0) for r in range(width)), F.lit(0)).cast("long")

            def moved(x: Column) -> Column:
                diagonal = (((x.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(x).bitwiseOR(down)).bitwiseAND(mask)
                return _let(diagonal, lambda d: _let(down.bitwiseOR(invert(d.bitwiseOR(up))), lambda right: following(d, right)))

            def following(diagonal: Column, right: Column) -> Column:
                left, shifted = diagonal.bitwiseAND(up), F.shiftright(diagonal, 1)
                # first along the band's lower edge, then along the last row
                row = (t["m"] - 1 + k - j).cast("int")
                change = F.when(j < t["m"] - k, 1 - bit(diagonal, F.lit(width - 1))).otherwise(bit(right, row) - bit(left, row))
                return F.struct(left.bitwiseOR(invert(shifted.bitwiseOR(right))).alias("up"), shifted.bitwiseAND(right).alias("down"), (state["distance"] + change.cast("int")).alias("distance"))

            return _let(F.substring(t["columns"], 4 * j + 1, F.lit(4)), lambda here: _let(matches(here), moved))

        return F.when(t["n"] > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(t["n"], F.lit(1)) - 1), start, step, lambda s: s["distance"])).otherwise(t["m"])

    return _let(texts, whole)


def edit_links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``a < b`` (structs of h1 and h2) of the distinct ``lines(line, n_chars, h1, h2)`` within ``threshold`` edits, each once with its ``distance``.

    Copies of a line may be among the lines; they fold together.
    """
    rows = _keyed(lines, _LINE, threshold)
    live = rows.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most"), F.bool_or("probes").alias("probed"), F.bool_and("probes").alias("unindexed"))
    live = materialize(live.filter("least < most and probed and not unindexed").select("key"))
    met = materialize(rows.join(bounded(live), "key", "left_semi").distinct().select("key", "probes", *_LINE))
    few = bounded(materialize(met.select(*_LINE).distinct()))
    texts = materialize(lines.join(few, _LINE, "left_semi").groupBy(*_LINE).agg(F.first("line").alias("line")).withColumns({"p": _profile(_LETTERS[0]), "q": _profile(_LETTERS[1])}))
    met = _refined(met, texts, threshold)
    sided = materialize(met.join(shuffled(texts), _LINE).select("key", "probes", F.struct(*_LINE).alias("id"), "p", "q", "line"))
    side = lambda probes, name: sided.filter(F.col("probes") == probes).select("key", F.col("id").alias(name), F.col("p").alias(f"p{name}"), F.col("q").alias(f"q{name}"), F.col("line").alias(f"line_{name}"))
    a, b = F.col("a"), F.col("b")
    # of two lines of one length each probes the other; h2 starts with the length
    once = (F.shiftright(a["h2"], 32) < F.shiftright(b["h2"], 32)) | (a < b)
    close = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) + F.bit_count(F.col("qa").bitwiseXOR(F.col("qb"))) <= 2 * threshold
    found = side(False, "a").join(shuffled(side(True, "b")), "key").filter((a != b) & once & close)
    pairs = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.first("line_a").alias("line_a"), F.first("line_b").alias("line_b"))
    distance = banded_distance(F.col("line_a"), F.col("line_b"), threshold)
    return materialize(pairs.select("a", "b", distance.alias("distance"))).filter(F.col("distance") <= threshold)


def line_decisions(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, threshold: int = THRESHOLD, short_lines: bool = False) -> DataFrame:
    """``doc, doc_hash, dropped, n_links, earlier_docs`` of the documents that hold a repeated or linked line.

    Lines are ordered by id (null first), then position.  Of equal lines only
    the first stays, and that goes too if an earlier line lies within
    ``threshold`` edits of it.  Lines shorter than ``min_chars`` have no links; with
    ``short_lines`` all but the first of those that are equal and have a word go.  ``dropped`` are the sorted positions of lines that go,
    ``n_links`` the links of the document's lines to other texts, and
    ``earlier_docs`` the sorted ids that hold the earliest such line.
    """
    lines = _lines(docs, id_column, text_column, min_chars, short_lines)
    here = F.struct("doc", "pos", "doc_hash")
    once = materialize(lines.groupBy(*_LINE).agg(F.min(here).alias("first"), F.count("*").alias("n")))
    links = settled(lambda: edit_links(lines.filter(F.col("n_chars") >= min_chars), threshold).select("a", "b"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.select(F.col("a.h1").alias("h1"), F.col("a.h2").alias("h2"), F.col("b.h1").alias("o1"), F.col("b.h2").alias("o2"))
    others = once.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("other"))
    partners = materialize(both.join(others, ["o1", "o2"]).groupBy(*_LINE).agg(F.count("*").alias("n_links"), F.min("other").alias("other")))
    known = once.join(partners, _LINE, "left").filter((F.col("n") > 1) | F.col("n_links").isNotNull())
    known = known.select(*_LINE, "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("other") < F.col("first"), F.lit(False)).alias("near"), "other")
    found = lines.select("doc", "doc_hash", "pos", *_LINE).join(bounded(materialize(known)), _LINE)
    goes = F.col("near") | (here != F.col("first"))
    earlier = F.when(F.col("near"), F.least("other", "first")).otherwise(F.col("first"))["doc"]
    return found.groupBy("doc", "doc_hash").agg(F.array_sort(F.collect_set(F.when(goes, F.col("pos")))).alias("dropped"), F.sum("n_links").alias("n_links"), F.array_sort(F.collect_set(F.when(goes, earlier))).alias("earlier_docs"))


def dedup_report(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, threshold: int = THRESHOLD, short_lines: bool = False) -> DataFrame:
    """``id, n_lines, n_checked, n_dropped, n_links, dropped, earlier_docs`` for every row of ``docs``.

    A null text has no lines, an empty text one empty line.  Rows with the same
    id and text are one document and get the same answer; rows with the same id
    and different texts are told apart.  Other columns are not read; an empty
    table gives an empty result.
    """
    decisions = materialize(line_decisions(docs, id_column=id_column, text_column=text_column, min_chars=min_chars, threshold=threshold, short_lines=short_lines))
    text = F.col(text_column).cast("string")
    split = F.split(text, "\n", -1)
    count = lambda lines: F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    counted = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("hash"), count(split).alias("n_lines"), count(F.filter(split, lambda x: _takes_part(x, min_chars, short_lines))).alias("n_checked"))
    joined = counted.join(shuffled(decisions), F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("doc_hash")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select(F.col("id").alias(id_column), "n_lines", "n_checked", F.size(dropped).cast("long").alias("n_dropped"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), dropped.alias("dropped"), F.coalesce("earlier_docs", F.array().cast(dict(decisions.dtypes)["earlier_docs"])).alias("earlier_docs"))


def dedup_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, threshold: int = THRESHOLD, short_lines: bool = False) -> DataFrame:
    """``docs`` with the dropped lines cut out of their texts; all columns and rows stay."""
    decisions = materialize(line_decisions(docs, id_column=id_column, text_column=text_column, min_chars=min_chars, threshold=threshold, short_lines=short_lines).filter(F.size("dropped") > 0))
    text = F.col(text_column).cast("string")
    doc, digest, dropped = (fresh(docs, n) for n in ("doc", "hash", "dropped"))
    at = decisions.select(F.col("doc").alias(doc), F.col("doc_hash").alias(digest), F.col("dropped").alias(dropped))
    joined = docs.join(bounded(at), F.col(id_column).eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(digest)), "left")
    lines = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped)), lambda i: F.get(lines, i))
    return joined.withColumn(text_column, F.when(F.col(dropped).isNotNull(), F.array_join(kept, "\n")).otherwise(text)).select(docs.columns)
