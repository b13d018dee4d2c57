"""Line dedup by a segment-partition edit join.

Different lines are compared once each. A line of ``min_chars`` characters or more is cut into ``errors`` + 1 segments of
nearly equal length; two lines within ``errors`` edits share a whole segment, at places that differ by less than their
edits allow. So each line posts its segments under number, line length and content, and probes the lines that are as
long or up to ``errors`` characters shorter with the substrings that could be their segments (the choice of places is the
multi-match-aware one). The lines that meet under a key are first compared with two leaders of it, which is two pairs for
each line. Linked lines form classes, found by least labels. Only lines of different classes that still meet are compared
with each other, and only if the parities of their letters and letter pairs differ in no more places than ``errors``
edits can change; so a large group of like lines makes no rows for its pairs unless they may be links.

Pairs are verified by a banded bit-parallel edit distance: for each number of errors a few bits tell which diagonals
within the band can be reached.

Everything is built of DataFrame functions. Classes, not pairs of occurrences, are carried back to the documents: of each
class the occurrence with the least (doc_id, line number) stays, all others are dropped.

Defined cases: lines without a word are neither counted nor dropped; shorter lines are only dropped when equal; null text
has no lines; null doc_ids come first; rows that repeat id and text are one document and give equal rows; other columns
play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm.common import has_word, let, saved

ERRORS, MIN_CHARS = 2, 24


def segments(n: Column, parts: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of each segment of a line of n characters; the last ones are longer by one."""
    short = F.floor(n / parts).cast("int")
    longer = (n % parts).cast("int")
    out = []
    for i in range(parts):
        extra = F.greatest(F.lit(0), F.lit(i) - (parts - longer))
        out.append((short * i + extra, short + (F.lit(i) >= parts - longer).cast("int")))
    return out


def line_keys(line: Column, n: Column, errors: int) -> list[tuple[bool, Column]]:
    """Keys of the substrings that may be a segment of a line that is shorter by 0 to ``errors`` characters, and whether they are a segment of the line itself.

    Substrings are taken of four bytes a character, in which places are found without counting characters. One that
    reaches beyond the line can equal no segment and does no harm.
    """
    wide = F.encode(line, "UTF-32")
    out = []
    for less in range(errors + 1):
        m = n - less
        for i, (start, size) in enumerate(segments(m, errors + 1)):
            # left edits before the segment are at most i, right ones at most errors - i
            low = max(-i, less - (errors - i))
            high = min(i, less + (errors - i))
            for shift in range(low, high + 1):
                piece = F.substring(wide, (start + shift) * 4 + 1, size * 4)
                out.append((less == 0 and shift == 0, F.xxhash64(F.lit(i), m.cast("int"), piece)))
    return out


def parities(line: Column) -> Column:
    """Struct of two longs, of which one edit changes at most two and four bits: parities of the numbers of letters and of letter pairs."""
    def of_codes(codes: Column) -> Column:
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int"))
        pairs = F.transform(codes, lambda c, i: bit(F.hash(c, F.get(codes, i + 1))))
        parity = lambda bits: F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
        return F.struct(parity(F.transform(codes, bit)).alias("ones"), parity(F.slice(pairs, 1, F.size(pairs) - 1)).alias("twos"))

    return let(F.transform(F.split(line, ""), F.ascii), of_codes)


def may_be_near(a: Column, b: Column, errors: int) -> Column:
    """Whether parities differ in no more places than ``errors`` edits can change."""
    return (F.bit_count(a["ones"].bitwiseXOR(b["ones"])) <= 2 * errors) & (F.bit_count(a["twos"].bitwiseXOR(b["twos"])) <= 4 * errors)


def within_errors(a: Column, b: Column, errors: int) -> Column:
    """Whether the edit distance of two strings is at most ``errors``; linear in their length.

    Bit d of r[e] says that after j characters of b, j + d - errors characters of a can be consumed with e edits.
    """
    mask = (1 << (2 * errors + 1)) - 1
    start = F.array(*[F.lit(sum(1 << (errors + k) for k in range(e + 1)) & mask) for e in range(errors + 1)])

    def of_letters(x: Column) -> Column:
        def step(r: Column, letter: Column, j: Column) -> Column:
            match = reduce(lambda p, q: p.bitwiseOR(q), [F.when(F.get(x, j + (d - errors)) == letter, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(2 * errors + 1)])

            def of_match(hit: Column) -> Column:
                rows: list[Column] = []
                for e in range(errors + 1):
                    row = F.get(r, F.lit(e)).bitwiseAND(hit)
                    if e:
                        before = F.get(r, F.lit(e - 1))
                        row = row.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(rows[-1], 1))
                    rows.append(row.bitwiseAND(F.lit(mask)))
                return F.array(*rows)

            return let(match, of_match)

        letters = F.transform(F.split(b, ""), lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        return F.aggregate(letters, start, lambda r, s: step(r, s["c"], s["j"]))

    last = let(F.split(a, ""), of_letters)
    end = F.length(a) - F.length(b) + errors
    return F.when(F.abs(F.length(a) - F.length(b)) > errors, F.lit(False)).otherwise(F.get(last, F.lit(errors)).bitwiseAND(F.call_function("shiftleft", F.lit(1), end)) != 0)


def chunks_agree(a: Column, b: Column, errors: int, chunks: int = 12) -> Column:
    """Whether all but ``errors`` of the chunks of a are in b near their place, as must be within ``errors`` edits."""
    size = F.greatest(F.lit(1), F.floor(F.length(a) / chunks).cast("int"))
    held = F.lit(0)
    for k in range(chunks):
        start = size * k
        low = F.greatest(F.lit(0), start - errors)
        held = held + F.contains(F.substring(b, low + 1, start - low + size + errors), F.substring(a, start + 1, size)).cast("int")
    return held >= chunks - errors


def line_id(line: Column) -> Column:
    return F.unhex(F.substring(F.sha2(line, 256), 1, 32))


def segment_table(lines: DataFrame, errors: int, min_chars: int) -> tuple[DataFrame, list[str], list[str]]:
    """Keys of each different line, written once, and the names of all and of the posted ones; short is a 64-bit hash of the line.

    Lines are reduced to their keys before they are dealt, so their texts aren't shuffled.
    """
    long = lines.filter(F.length("line") >= min_chars).select("line", F.length("line").alias("n"))
    keys = line_keys(F.col("line"), F.col("n"), errors)
    names = [f"k{i}" for i in range(len(keys))]
    each = long.select(F.xxhash64("line").alias("short"), *[k.alias(c) for c, (_, k) in zip(names, keys, strict=True)])
    table = saved(each.groupBy("short").agg(*[F.first(c).alias(c) for c in names]), "segments")
    return table, names, [c for c, (own, _) in zip(names, keys, strict=True) if own]


def fetch_lines(lines: DataFrame, wanted: DataFrame, small: int = 500_000) -> DataFrame:
    """(short, line) of the wanted hashes; equal hashes of different lines give several rows.

    Up to ``small`` hashes, of 8 bytes each, are broadcast, which leaves all other lines where they are; more are joined
    by shuffle.
    """
    side = F.broadcast(wanted) if wanted.count() <= small else wanted
    return lines.select(F.xxhash64("line").alias("short"), "line").join(side, "short", "left_semi").distinct()


def linked(pairs: DataFrame, texts: DataFrame, errors: int) -> DataFrame:
    """Of the pairs of hashes x, y those whose lines are within ``errors`` edits, with the lines' ids: x, y, a, b."""
    left = texts.select(F.col("short").alias("x"), F.col("line").alias("line_x"), F.col("parity").alias("p_x"))
    right = texts.select(F.col("short").alias("y"), F.col("line").alias("line_y"), F.col("parity").alias("p_y"))
    met = pairs.join(left, "x").join(right, "y").filter(may_be_near(F.col("p_x"), F.col("p_y"), errors))
    # most pairs that share a segment only by chance are told apart by their chunks, which costs far less
    near = met.filter(chunks_agree(F.col("line_x"), F.col("line_y"), errors)).filter(within_errors(F.col("line_x"), F.col("line_y"), errors))
    return near.select("x", "y", line_id(F.col("line_x")).alias("a"), line_id(F.col("line_y")).alias("b"))


def ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def meetings(lines: DataFrame, errors: int, min_chars: int) -> DataFrame:
    """(key, short, posted, lead, top): lines that meet another one under a key; lead and top are the ends of those posted."""
    table, names, own = segment_table(lines, errors, min_chars)
    flat = lambda cols: F.explode(F.array(*[F.struct(F.col(c).alias("key"), F.lit(c in own).alias("posted")) for c in cols]))
    ends = table.select("short", flat(own).alias("k")).groupBy("k.key").agg(F.min("short").alias("lead"), F.max("short").alias("top"))
    probes = table.select("short", flat(names).alias("k")).select("short", "k.*")
    return saved(probes.join(ends, "key").filter("short <> lead OR top <> lead"), "meetings")


def similar_lines(lines: DataFrame, errors: int, min_chars: int) -> DataFrame:
    """lines: line, repeats allowed -> (a, b): ids of different lines within ``errors`` edits, enough pairs to connect all that are linked."""
    met = meetings(lines, errors, min_chars)
    first = met.select("short", F.explode(F.array("lead", "top")).alias("one")).filter("short <> one")
    pairs = saved(first.select(*ordered(F.col("short"), F.col("one"))).distinct(), "line_pairs")
    ends = saved(pairs.select(F.explode(F.array("x", "y")).alias("short")).distinct(), "line_ends")
    texts = saved(fetch_lines(lines.filter(F.length("line") >= min_chars), ends).withColumn("parity", parities(F.col("line"))), "line_texts")
    links = saved(linked(pairs, texts, errors), "line_links")

    # what still meets under a key with several posted lines, but isn't connected
    named = classes_of(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    several = met.filter("top <> lead").select("key", "short", "posted").distinct()
    placed = several.join(named.withColumnRenamed("id", "short"), "short", "left").withColumn("class", F.coalesce("class", "short"))
    placed = saved(placed, "line_meetings")
    mixed = saved(placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key"), "mixed_keys")
    rest = placed.join(mixed, "key", "left_semi").join(texts.select("short", "parity"), "short")
    rest = saved(rest, "line_rest")
    p, q = rest.alias("p"), rest.filter("posted").alias("q")
    apart = (F.col("p.class") != F.col("q.class")) & may_be_near(F.col("p.parity"), F.col("q.parity"), errors)
    again = p.join(q, (F.col("p.key") == F.col("q.key")) & apart).select(*ordered(F.col("p.short"), F.col("q.short"))).distinct()
    return links.unionByName(linked(saved(again, "line_pairs"), texts, errors)).select("a", "b").distinct()


def classes_of(edges: DataFrame) -> DataFrame:
    """(id, class): of each end of an edge the least id that it is connected with. Labels only fall, so the rounds end."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "line_edges")
    nodes = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("class")), "line_labels")
    while True:
        heard = both.join(nodes, both["a"] == nodes["id"]).groupBy(F.col("b").alias("id")).agg(F.min("class").alias("heard"))
        near = nodes.join(heard, "id").select("id", F.col("class").alias("old"), F.least("class", "heard").alias("class"))
        far = nodes.select(F.col("id").alias("class"), F.col("class").alias("far"))
        new = saved(near.join(far, "class").select("id", "old", F.least("class", "far").alias("class")), "line_labels")
        nodes = new.select("id", "class")
        if new.filter("class <> old").isEmpty():
            return nodes


def repeated_lines(docs: DataFrame, errors: int = ERRORS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, dropped (numbers of the lines, from 0), n_near (dropped ones that differ from the one that stays)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "text").withColumns({"text_key": line_id(text), "lines": F.split(text, "\n")})
    at = rows.select("doc_id", "text_key", F.posexplode("lines").alias("number", "line")).filter(has_word(F.col("line")))
    places = saved(at.select("doc_id", "text_key", "number", line_id(F.col("line")).alias("id")), "line_places")
    named = classes_of(saved(similar_lines(at.select("line"), errors, min_chars), "similar_lines"))
    # null ids come first
    placed = places.join(named, "id", "left").select("doc_id", "text_key", "number", "id", F.coalesce("class", "id").alias("class"))
    counted = placed.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").isNull()).alias("no_id"), F.min("doc_id").alias("least")).filter("n > 1")
    # written, so that both sides are dealt for the join and Spark can split the rows of a frequent line
    several = saved(counted.select("class", F.when(~F.col("no_id"), F.col("least")).alias("least")), "line_classes")
    met = saved(placed.join(several, "class"), "repeated_lines")
    ends = met.filter(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("class").agg(F.min(F.struct("text_key", "number", "id")).alias("first"))
    ends = saved(ends, "line_firsts")
    first = F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("number") == F.col("first.number"))
    dropped = met.join(ends, "class").filter(~first)
    gone = dropped.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("number")).alias("dropped"), F.size(F.collect_set(F.when(F.col("id") != F.col("first.id"), F.col("number")))).alias("n_near"))  # lines of one document
    gone = gone.withColumnRenamed("doc_id", "gone_id")
    counts = rows.select("doc_id", "text_key", F.size(F.filter("lines", has_word)).cast("long").alias("n_lines"))
    out = counts.join(gone, (counts["doc_id"].eqNullSafe(F.col("gone_id"))) & (counts["text_key"] == gone["text_key"]), "left")
    none = F.array().cast("array<int>")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("dropped", none).alias("dropped"))


def without_lines(text: Column, dropped: Column) -> Column:
    """text without the lines of the given numbers."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(dropped, i)), "\n")
