"""Language identification by fusing evidence as probabilities.

For each language the logarithms of four kinds of evidence are added:

* the text: a multinomial model of byte trigrams, hashed to ``BUCKETS`` features, over the whole text. Its logarithm
  counts as ``TRUST`` trigrams at most, since neighbouring trigrams aren't independent;
* the language that the markup declares, and the suffix of the address (a language segment of the path, else the last
  label of the host), each by its probability given the language;
* the prior of the host, smoothed towards that of its domain (last two labels), which is smoothed towards that of all.

The languages are all that any labelled row with a text has. The text model is fitted on ``fit_rows`` labelled texts at most of each
language, those with the least hashes; with little text the model of a language is mostly its smoothing. All other probabilities are
ratios of sums over all rows, grouped by host, domain, declaration and suffix: each row adds its probabilities by the
text alone, as whole millionths, so the sums don't depend on the order of rows. Tables by host may be large and are
joined by shuffle; rows of a host that has a third of all are dealt over tasks by Spark's skewed join.

Defined cases: null or empty text has no evidence, null declarations, suffixes and hosts are values of their own; a row
without any evidence gets the most frequent language; equal probabilities go to the first language by name; repeated rows
count as often as they occur; without labelled rows the language is null; other columns play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.llm.common import saved
from litspark.llm.html_text import host_of

BUCKETS = 1 << 14
TRUST = 60
SALTS = 64
MILLION = 1_000_000
#: Pseudo-counts of a row's parent distribution, and of declarations and suffixes.
PRIOR_WEIGHT, SMOOTH = 20.0, 5.0
#: What opens a tag, a comment or an element whose content isn't seen, and what closes it.
OPENS = re.compile(r"<(?:(script|style|head)\b|(!--))?", re.IGNORECASE)
CLOSES = {"!--": re.compile("-->")} | {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "head")}


def visible(page: str) -> str:
    """A page with a space for each tag, comment, script, style and head, in one pass: a closing that isn't found is never looked for again."""
    out, at, missing = [], 0, set()
    while m := OPENS.search(page, at):
        kind, end = (m[1] or m[2] or "").lower(), -1
        if kind and kind not in missing:
            if close := CLOSES[kind].search(page, m.end()):
                end = close.end()
            else:
                missing.add(kind)
        if end < 0 and (end := page.find(">", m.start()) + 1) == 0:
            break
        out += page[at : m.start()], " "
        at = end
    return "".join([*out, page[at:]])


def trigrams(text: str) -> np.ndarray:
    """Feature numbers of the byte trigrams of a text, A-Z as a-z, digits left out."""
    b = np.frombuffer(f" {text} ".encode(), np.uint8).astype(np.uint32)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    b = b[(b < 48) | (b > 57)]
    h = (b[:-2] * np.uint32(40503) + b[1:-1] * np.uint32(2654435) + b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(18)).astype(np.int64)


def fit_text_model(labelled: DataFrame, fit_rows: int) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each feature (rows) in each language (columns).

    What comes to the driver is one count for each language and feature, at most BUCKETS a language.
    """
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").withColumn("hash", F.xxhash64("text"))
    # only hashes are sorted, in salted parts first; one number a language comes back. Copies count once.
    keys = known.select("lang", "hash").distinct().withColumn("salt", F.pmod("hash", F.lit(SALTS)))
    least = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("hash"))
    few = keys.withColumn("n", least("lang", "salt")).filter(F.col("n") <= fit_rows)
    few = few.withColumn("n", least("lang")).filter(F.col("n") <= fit_rows)
    last = few.groupBy("lang").agg(F.max("hash").alias("last"))
    # one row for each language
    rows = known.join(F.broadcast(last), "lang").filter(F.col("hash") <= F.col("last")).dropDuplicates(["hash", "lang"]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                n = np.bincount(trigrams(text), minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "feature", "n"])

    sums = rows.mapInArrow(count, "lang string, feature bigint, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    langs = sorted({r["lang"] for r in sums})
    n = np.full((BUCKETS, len(langs)), 0.1)
    for r in sums:
        n[r["feature"], langs.index(r["lang"])] += r["n"]
    return langs, np.log(n / n.sum(axis=0)) if langs else n


def text_evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """rows with column text replaced by text_log, the log likelihoods by language less their greatest."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marked in zip(batch.column("text").to_pylist(), batch.column("marked").to_pylist(), strict=True):
                text = html.unescape(visible(text or "")) if marked else text or ""
                f = trigrams(text) if text.strip() else np.zeros(0, np.int64)
                score = np.bincount(f, minlength=BUCKETS) @ model * min(1.0, TRUST / max(1, len(f)))
                out.append(score - score.max())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kinds], pa.array(out, pa.list_(pa.float64()))], names=[*kinds, "text_log"])

    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", text_log array<double>")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, doc_id, text, marked, host, domain, declared, suffix) of web pages."""
    host = host_of(F.col("url"))
    tag = F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?is)<html\b([^<>]*)>", 1)
    declared = F.regexp_extract(tag, r"""(?i)(?:^|\s)(?:xml:)?lang\s*=\s*["']?([a-z]+)""", 1)
    segment = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    return pages.select(
        "page_id",
        F.lit(None).cast("bigint").alias("doc_id"),
        F.col("html").alias("text"),
        F.lit(True).alias("marked"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.lower(declared).alias("declared"),
        F.when(segment != "", F.lower(segment)).otherwise(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """The same of plain documents: their source is the host, and nothing is declared."""
    none = F.lit("")
    return docs.select(F.lit(None).cast("bigint").alias("page_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(False).alias("marked"), F.concat(F.lit("source:"), F.coalesce("source", none)).alias("host"), F.lit("source:").alias("domain"), none.alias("declared"), none.alias("suffix"))


def normalised(logs: Column) -> Column:
    """Probabilities from logarithms of which the greatest is 0."""
    powers = F.transform(logs, lambda x: F.exp(x))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def identify(evidence: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """One row per row of evidence: page_id, doc_id, language, confidence, text_language."""
    if not langs:
        none = F.lit(None).cast("string")
        return evidence.select("page_id", "doc_id", none.alias("language"), F.lit(None).cast("double").alias("confidence"), none.alias("text_language"))
    k = range(len(langs))
    rows = saved(text_evidence(evidence, model), "language")
    shares = rows.withColumn("p", normalised(F.col("text_log"))).withColumns({f"p{i}": F.round(F.col("p")[i] * MILLION).cast("long") for i in k})

    def sums(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in k])

    hosts = saved(sums(shares, "host", "domain", "declared", "suffix"), "language_sums")
    total = sums(hosts).select(*[((F.coalesce(f"p{i}", F.lit(0)) + MILLION) / sum((F.coalesce(f"p{j}", F.lit(0)) + MILLION for j in k), F.lit(0.0))).alias(f"all{i}") for i in k])
    count = lambda: sum((F.col(f"p{j}") for j in k), F.lit(0.0)) / MILLION

    def prior(df: DataFrame, by: str, above: str, to: str) -> DataFrame:
        return df.select(by, *[((F.col(f"p{i}") / MILLION + PRIOR_WEIGHT * F.col(f"{above}{i}")) / (count() + PRIOR_WEIGHT)).alias(f"{to}{i}") for i in k])

    domain = prior(sums(hosts, "domain").crossJoin(F.broadcast(total)), "domain", "all", "dom")  # total is one row
    host = sums(hosts, "host", "domain").join(domain, "domain")
    host = prior(host, "host", "dom", "host")

    def given(by: str) -> DataFrame:
        """Log probability of a value given the language, smoothed towards its share in all."""
        each = sums(hosts, by)
        whole = each.agg(*[F.sum(f"p{i}").alias(f"t{i}") for i in k])
        both = each.crossJoin(F.broadcast(whole))  # whole is one row
        share = count() * MILLION / sum((F.col(f"t{j}") for j in k), F.lit(0.0))
        return both.select(by, *[F.log((F.col(f"p{i}") / MILLION + SMOOTH * share) / (F.col(f"t{i}") / MILLION + SMOOTH)).alias(f"{by}{i}") for i in k])

    met = rows.join(host, "host", "left").join(given("declared"), "declared", "left").join(given("suffix"), "suffix", "left")
    logs = F.array(*[F.col("text_log")[i] + F.log(F.coalesce(f"host{i}", F.lit(1.0))) + F.coalesce(f"declared{i}", F.lit(0.0)) + F.coalesce(f"suffix{i}", F.lit(0.0)) for i in k])
    met = met.select("page_id", "doc_id", "text_log", logs.alias("logs"))
    met = met.withColumn("p", normalised(F.transform("logs", lambda x: x - F.array_max("logs"))))
    name = lambda values: F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(values, F.array_max(values)).cast("int"))
    return met.select("page_id", "doc_id", name(F.col("logs")).alias("language"), F.round(F.array_max("p"), 6).alias("confidence"), name(F.col("text_log")).alias("text_language"))


def identify_languages(pages: DataFrame, docs: DataFrame, fit_rows: int = 2000) -> DataFrame:
    """Languages of all pages (page_id) and all documents (doc_id); the text model is fitted on the documents' labels."""
    langs, model = fit_text_model(docs, fit_rows)
    return identify(page_evidence(pages).unionByName(document_evidence(docs)), langs, model)
