"""Where bodies begin: windows against a state machine in plain Python, on drawn titles and on typical documents."""

import random

from pyspark.sql import functions as F

from litspark.operators import body
from litspark.plans.structure import TITLES


def machine(rows, journal=False):
    """rows: features of the headings of one document in order -> area, role, reason of each, read one by one."""
    out, waiting, area, locked = [], [], "start", False

    def give_up():
        for i in waiting:
            out[i] = (*out[i][:1], "front_matter", "body_not_confirmed")
        waiting.clear()

    def confirms(r, n):
        if r["family"] == "arabic_main":
            return n["family"] in ("arabic_paren", "decimal_path")
        child = n["family"] == "decimal_path" and len(n["path"]) > len(r["path"] or []) and n["path"][:-1] == r["path"]
        return r["family"] == "decimal_path" and (child or n["family"] in ("arabic_paren", "cn_paren"))

    def locks(r, ahead):
        if r["family"] == "chapter_cn" or (r["family"] == "arabic_main" and (journal or r["words"] in body.BODY_STARTS)):
            return True
        if r["family"] == "cn_main":
            return any(n["family"] in ("cn_paren", "arabic_main", "decimal_path") for n in ahead)
        if r["family"] == "plain":
            return r["words"] in body.BODY_STARTS and (area not in ("references", "appendix", "acknowledgements") or any(n["family"] in ("plain", *body.NUMBERED) for n in ahead))
        return any(confirms(r, n) for n in ahead)

    for i, r in enumerate(rows):
        if locked:
            if r["tail"]:
                out.append((r["tail"], r["tail"], "tail_after_body"))
            elif r["misplaced"]:
                out.append(("body", "front_matter", "front_matter_after_body"))
            else:
                out.append(("body", "body", "in_body"))
            continue
        if r["opens"]:
            give_up()
            area = "contents"
            out.append((area, "contents", "contents"))
        elif area == "contents" and r["entry"]:
            out.append((area, "front_matter", "contents_entry"))
        elif r["front"] and r["front"] != area:
            give_up()
            area = r["front"]
            out.append((area, "front_matter", "opens_part"))
        elif locks(r, rows[i + 1 : i + 3]):
            for k in waiting:
                out[k] = ("body", "body", "waited_for_body")
            waiting.clear()
            locked = True
            out.append(("body", "body", "locks_body"))
        elif r["words"] in body.BODY_STARTS if r["family"] == "plain" else r["family"] in body.NUMBERED:
            out.append((area, "front_matter", "body_not_confirmed"))
            waiting.append(i)
            if len(waiting) > body.PENDING:
                waiting.pop(0)
        else:
            give_up()
            out.append((area, "front_matter", "before_body"))
    return out


def features(df):
    f = body.heading_features(df, "title", "content")
    t = F.col("__title")
    f = f.select("doc", "n", F.col("__family").alias("family"), F.col("__path").alias("path"), F.col("__words").alias("words"), F.col("__front").alias("front"), F.col("__tail").alias("tail"), F.col("__entry").alias("entry"), t.isin(body.CONTENTS).alias("opens"), (body.is_front_title(t) | t.isin(body.BEFORE_BODY)).alias("misplaced"))
    docs = {}
    for r in sorted(f.collect(), key=lambda r: (r.doc, r.n)):
        docs.setdefault(r.doc, []).append(r.asDict())
    return docs


def test_drawn_titles_against_the_machine(spark):
    r = random.Random(11)
    rows = [(d, n, r.choice(TITLES), r.choice(["", "prose of a section", "1.2 3 4-5"])) for d in range(250) for n in range(r.randrange(1, 14))]
    df = spark.createDataFrame(rows, "doc int, n int, title string, content string")
    got = {}
    for x in body.lock_body(df, "doc", "n", "title", "content", F.col("doc") % 2 == 1).collect():
        got.setdefault(x.doc, []).append((x.n, x.area, x.role, x.reason))
    for doc, rows_of in features(df).items():
        assert [x[1:] for x in sorted(got[doc])] == machine(rows_of, doc % 2 == 1), [x for x in rows if x[0] == doc]


def test_thesis_and_journal(spark):
    thesis = ["某某大学", "独创性声明", "摘要", "Abstract", "目录", "第一章 绪论 ..... 1", "1.1 背景 ..... 2", "第一章 绪论", "1.1 背景", "第二章 方法", "参考文献", "附录A", "致谢", "作者简介"]
    paper = ["A title", "摘要", "1 概况", "2 数据", "2.1 来源", "结论", "References"]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(thesis)] + [("p", i, x) for i, x in enumerate(paper)], "doc string, n int, title string")
    got = {(x.doc, x.n): (x.role, x.reason) for x in body.lock_body(df, "doc", "n", "title").collect()}
    assert [got["t", i][0] for i in range(len(thesis))] == ["front_matter"] * 4 + ["contents", "front_matter", "front_matter", "body", "body", "body", "references", "appendix", "acknowledgements", "references"]
    assert [got["p", i][1] for i in range(len(paper))] == ["before_body", "opens_part", "locks_body", "in_body", "in_body", "in_body", "tail_after_body"]
    assert body.lock_body(df.limit(0), "doc", "n", "title").count() == 0
    odd = spark.createDataFrame([("x", 0, None), ("x", 1, ""), ("x", 2, "引言")], "doc string, n int, title string")
    assert [x.role for x in body.lock_body(odd, "doc", "n", "title").orderBy("n").collect()] == ["front_matter", "front_matter", "body"]
