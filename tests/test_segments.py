"""Segments of bundled files against plain Python."""

import difflib
import random
import re

from litspark.operators import segments
from litspark.plans.structure import BUNDLES

WANTED = "Deep Rivers of the North"
CHAPTER = re.compile(r"^第[一二三]章|^[0-9]{1,2} \S")


def canonical(title):
    return re.sub(r"[^0-9A-Za-z一-鿿]+", "", title).lower()


def score(wanted, title):
    a, b = canonical(wanted), canonical(title)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 6 and (a in b or b in a):
        return 0.85
    r = difflib.SequenceMatcher(None, a, b).ratio()
    return r if r >= 0.72 else 0.0


def brute(lines):
    """lines: texts from number 0."""
    heads = [(n, len(m[1]), m[2].strip()) for n, t in enumerate(lines) if (m := re.match(r"^(#{1,6})\s+(\S.*)$", t))]
    valid = [h for h in heads if len(canonical(h[2])) >= 2]
    ones = [h for h in valid if h[1] == 1]
    last = len(lines) - 1

    def end(h):
        later = [x for x in (ones if h[1] == 1 else heads) if x[0] > h[0] and x[1] <= h[1]]
        return later[0][0] - 1 if later else last

    def best(found):
        ranked = sorted(found, key=lambda h: (-score(WANTED, h[2]), h[0]))
        top = score(WANTED, ranked[0][2])
        second = score(WANTED, ranked[1][2]) if len(ranked) > 1 else 0.0
        tied = [h for h in ranked if score(WANTED, h[2]) == top]
        return ranked[0], top, top >= 0.72 and top - second >= 0.15, top >= 0.72 and len(tied) > 1 and len({canonical(h[2]) for h in tied}) == 1

    if not ones:
        return (0, last, None, None, "no_heading")
    marked = any(m in canonical(h[2]) for h in ones for m in segments.DEGREE_MARKS)
    degree = marked and (any(CHAPTER.match(h[2]) for h in ones) or any(CHAPTER.match(h[2]) for h in heads if h[1] > 1 and h[0] > ones[-1][0]))
    h, top, ahead, shared = best(ones)
    if len(ones) == 1 and top >= 0.72:
        return (0, last, 1, h[2], "title_fuzzy" if top < 0.85 else None)
    if len(ones) > 1 and (ahead or (shared and degree)):
        span = (0, last) if degree else (h[0], end(h))
        return (*span, 1, h[2], "title_fuzzy" if top < 1 else None)
    n, _, ok, _ = best(valid)
    if ok and n[1] > 1:
        return (n[0], end(n), n[1], n[2], "other_level")
    return (0, last, 1, h[2], "identity_mismatch") if len(ones) == 1 else (None, None, None, None, "scope_ambiguous")


def test_bundles_against_plain_python(spark):
    r = random.Random(12)
    files = {d: [r.choice([*BUNDLES, "## 1 Methods", "## x", "# !", "text of a section"]) for _ in range(r.randrange(1, 9))] for d in range(300)}
    files |= {900: ["# Unrelated", "## " + WANTED, "text", "### part", "## next", "text"], 901: ["text only"], 902: ["# " + WANTED, "a", "# 学位论文", "# 第一章 x", "# " + WANTED]}
    lines = spark.createDataFrame([(d, n, t) for d, ts in files.items() for n, t in enumerate(ts)], "doc int, n int, t string").repartition(3)
    papers = spark.createDataFrame([(d, WANTED) for d in [*files, 999]], "doc int, title string")
    got = {x.doc: (x.start_line, x.end_line, x.level, x.title, x.code) for x in segments.select_segments(lines, papers, "doc", "n", "t").collect()}
    assert got.pop(999) == (None, None, None, None, "no_lines")
    for d, ts in files.items():
        assert got[d] == brute(ts), (d, ts)
    assert {x[4] for x in got.values()} == {None, "title_fuzzy", "other_level", "identity_mismatch", "scope_ambiguous", "no_heading"}


def test_bound_is_never_below_the_ratio(spark):
    r = random.Random(5)
    pairs = [("".join(r.choice("abcde") for _ in range(r.randrange(1, 20))), "".join(r.choice("abcde") for _ in range(r.randrange(1, 20)))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", segments.ratio_bound(df.a, df.b).alias("bound")).collect():
        assert x.bound >= difflib.SequenceMatcher(None, x.a, x.b).ratio() - 1e-12
