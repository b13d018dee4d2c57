"""Plain-Python twins of the draw and of the fusion of evidence, and inputs made to be slow or to clash."""

import html
import math
import random
import re
import time
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from litspark.llm import html_text, language, mixing, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string"


# mixing


def spark_hash(seed, doc_id, text):
    h = 42
    for raw in (seed.to_bytes(4, "little"), doc_id.to_bytes(8, "little", signed=True), text if text is None else text.encode()):
        h = h if raw is None else xxhash.xxh64_intdigest(raw, h)
    return h


def brute_draw(rows, target, source_size, seed=17):
    """(epochs, drawn ids) of one source by sorting all its documents."""
    epochs = math.floor(target / source_size) if source_size else 0
    keyed = []
    for i, text in rows:
        words = WORD.findall(text or "")
        visible = [c for c in text or "" if c not in mixing.SPACES]
        share = 1 - sum(c in "#*$%&|<>0123456789!?=" for c in visible) / max(len(visible), 1)
        weight = max(0.1, share * min(1.0, (len(words) + 10) / 60))
        u = ((spark_hash(seed, i, text) >> 11) + 0.5) / 2.0**53
        tie = spark_hash(seed + 1, i, text)
        keyed.append((u ** (1 / weight), tie - 2**64 * (tie >= 2**63), len(words), i))
    drawn, held, rest = set(), 0, target - epochs * source_size
    for _, _, size, i in sorted(keyed, key=lambda k: (-k[0], k[1])):
        if held + size > rest:
            if size and held + size / 2 <= rest:
                drawn.add(i)
            break
        if size:
            drawn.add(i)
        held += size
    return epochs, drawn


def test_draw_against_sorting(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["word", "#$%", "a1", "x"]) for _ in range(r.randrange(0, 150))) if i % 19 else None, "en", r.choice("aaaabbc") if i % 7 else None) for i in range(600)]
    got = {x.doc_id: x for x in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    for source in {x[3] for x in rows}:
        mine = [x for x in rows if x[3] == source]
        first = got[mine[0][0]]
        epochs, drawn = brute_draw([x[:2] for x in mine], first.target, first.source_size)
        assert {got[x[0]].epochs for x in mine} == {epochs}
        assert {x[0] for x in mine if got[x[0]].drawn} == drawn
    assert {x.epochs for x in got.values()} != {0}


def test_sources_without_words(spark):
    def check(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        got = {x.doc_id: x for x in mixing.mix(df).collect()}
        assert len(got) == len(rows)
        for i, text, *_ in rows:
            assert got[i].taken == got[i].size == len(WORD.findall(text or ""))
        assert Counter(x.doc_id for x in mixing.repeat_rows(df).collect()) == Counter(i for i, t, *_ in rows if WORD.search(t or ""))

    tables = [[(1, "a b", "en", "x"), (2, None, "en", "y")], [(1, None, "en", "x"), (2, " \n", "en", None)], [(1, "", "en", "x")]]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(check, tables))


def test_mix_carries_columns_of_any_name(spark):
    names = ["__rank", "__size", "__tie", "__sid", "__plan", "__copy", "__w", "rank", "size", "tie", "sid", "row", "u", "end", "tie_end", "epochs", "a.b"]
    rows = [(i, f"text of {i} words", "en", "s", *[1000 * i + k for k in range(len(names))]) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` long" for n in names))
    out = mixing.repeat_rows(df)
    assert out.columns == df.columns and {tuple(x) for x in out.collect()} == set(rows)


def test_pipeline_of_nothing_and_of_clashing_names(spark):
    import corpus_pipeline as p

    r = random.Random(3)
    names = ["__rank", "key", "row", "n", "grp", "digest", "c0", "shingle"]
    rows = [(i, " ".join(r.choice("abcdefghij") * r.randrange(1, 5) + r.choice("xyz") for _ in range(60)) if i else None, "en", f"s{i % 2}" if i % 3 else None, *[i] * len(names)) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` long" for n in names))
    def through(kept):
        for name, stage in p.STAGES[:-1]:
            kept = stage(spark, kept, "")
            assert kept.columns == df.columns, name
            assert all(x[4:] == (x[0],) * len(names) for x in map(tuple, kept.collect())), name
        encoded = p.STAGES[-1][1](spark, kept, "").collect()
        assert len(encoded) == kept.count() and all(x.lossless for x in encoded)
        return len(encoded)

    with ThreadPoolExecutor(2) as pool:  # side by side, as most of their time is planning
        sizes = list(pool.map(through, [df, df.limit(0)]))
    assert sizes[0] > 0 and sizes[1] == 0


# language


def test_visible_text_equals_the_expression():
    hidden = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    r = random.Random(5)
    pieces = ["<", ">", "<!--", "-->", "<!-->", "<script>", "</script >", "<SCRIPT x", "</style>", "<style>", "<head>", "</head\n>", "<header>", "text", " ", "é", "</", "<b>", "</b>"]
    for _ in range(4000):
        page = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        assert language.visible(page) == hidden.sub(" ", page), page


@pytest.mark.parametrize("bit", ["<!--", "<", "<script", "<style>", "<!--<script", "</script <head "])
def test_ten_million_hostile_characters(bit):
    page, began = bit * (10_000_000 // len(bit)), time.time()
    assert language.visible(page).strip() in ("", page.strip())
    assert time.time() - began < 10


@pytest.mark.parametrize("bit", ["eyJ", "eyJ.", "eyJa.eyJb ", "password ", "password=", "AKIA", "ghp_", "a0"])
def test_ten_million_characters_that_look_secret(bit):
    text, began = bit * (10_000_000 // len(bit)), time.time()
    secrets.find_secrets(text, secrets.automaton())
    assert time.time() - began < 30


def test_web_tokens_after_runs_without_points(spark):
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    text = f"eyJeyJeyJ {token} eyJa.eyJb {token}, eyJ"
    spans = [s for s in secrets.find_secrets(text, secrets.automaton()) if secrets.KINDS[s[1]] == "jwt"]
    assert [text[a:b] for a, _, b in spans] == [token, token]


def test_secrets_of_long_and_repeated_rows_with_more_columns(spark):
    text = "word " * 200_000 + "password = hunter22"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, "token: abcdef", "y"), (None, None, None)], "doc_id long, text string, spans string")
    got = Counter((x.doc_id, x.n_assign, x.spans) for x in secrets.digest(secrets.scan_secrets(df)).collect())
    assert got == {(1, 1, f"assign:1000000:{len(text)}"): 2, (2, 1, "assign:0:13"): 1, (None, 0, ""): 1}


def brute_fusion(rows, langs, model):
    """rows: key, text (visible), host, domain, declared, suffix -> key: (language, confidence)."""
    k = range(len(langs))
    logs, shares = [], []
    for _, text, *_ in rows:
        f = language.trigrams(text) if text.strip() else np.zeros(0, np.int64)
        score = np.bincount(f, minlength=language.BUCKETS) @ model * min(1.0, language.TRUST / max(1, len(f)))
        logs.append(score - score.max())
        p = np.exp(logs[-1])
        shares.append(np.round(p / p.sum() * 1_000_000))
    sums = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(4)]
    for row, p in zip(rows, shares, strict=True):
        for by, name in zip(sums, row[2:], strict=True):
            by[name] += p
    total = sum(shares)
    every = (total + 1_000_000) / (total + 1_000_000).sum()
    hosts, domains, declared, suffixes = sums
    smooth = lambda n, parent: (n / 1e6 + language.PRIOR_WEIGHT * parent) / (n.sum() / 1e6 + language.PRIOR_WEIGHT)
    given = lambda n: np.log((n / 1e6 + language.SMOOTH * n.sum() / total.sum()) / (total / 1e6 + language.SMOOTH))
    out = {}
    for (key, _, h, d, c, s), log in zip(rows, logs, strict=True):
        x = log + np.log(smooth(hosts[h], smooth(domains[d], every))) + given(declared[c]) + given(suffixes[s])
        p = np.exp(x - x.max())
        out[key] = (langs[int(np.argmax(x))], float((p / p.sum()).max())) if k else (None, None)
    return out


def languages_fixture():
    words = {"xx": ["foo", "bar", "baz", "fob", "oof"], "yy": ["ümlaut", "größe", "schön", "weiß", "foo"], "zz": ["kivik", "pukap", "bar", "mivuk"]}
    text = lambda lang, i, n: " ".join(random.Random(i).choices(words[lang], k=n))
    fit = [(i, text(x, i, 30), x, "s") for i in range(40) for x in words]
    pages = [(100 * k + i, f"http://h{i % 3}.{x}.org/{x if i % 2 else 'p'}/{i}", f'<html lang="{x if i % 4 else "yy"}"><script>{text("zz", i, 20)}</script><body>&eacute; {text(x, 900 + i, 1 + i % 12)}</body></html>') for i in range(20) for k, x in enumerate(words)]
    return words, fit, pages


def test_fusion_against_plain_python(spark):
    words, fit, pages = languages_fixture()
    pages += [(1000, "http://yy.example.org/", ""), (1001, None, None), (1002, "http://h0.xx.org/xx/1", "<!--" * 5000)]
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in fit], SCHEMA + ", host string, p0 string").repartition(3)
    df = spark.createDataFrame([(*x, "clash", "clash") for x in pages], "page_id long, url string, html string, text_log string, all0 string").repartition(3)
    langs, model = language.fit_text_model(docs, 2000)
    evidence = language.page_evidence(df).unionByName(language.document_evidence(docs))
    rows = []
    for e in evidence.collect():
        text = html.unescape(language.visible(e.text or "")) if e.marked else e.text or ""
        rows.append(((e.page_id, e.doc_id, e.text), text, e.host, e.domain, e.declared, e.suffix))
    # rows whose host is null meet no host: their prior is 1
    want = brute_fusion([x for x in rows if x[2] is not None], langs, model)
    got = language.identify_languages(df, docs).collect()
    by_page = {p[0]: p[2] for p in pages}
    by_doc = defaultdict(list)
    for x in fit:
        by_doc[x[0]].append(x[1])
    for x in got:
        for text in [by_page[x.page_id]] if x.page_id is not None else by_doc[x.doc_id]:
            if (x.page_id, x.doc_id, text) in want and x.page_id is not None:
                name, confidence = want[x.page_id, x.doc_id, text]
                assert x.language == name and x.confidence == pytest.approx(confidence, abs=2e-6)
    held = {x.page_id: x.language for x in got if x.page_id is not None and x.page_id < 300}
    right = sum(held[100 * k + i] == x for i in range(20) for k, x in enumerate(words))
    assert right >= 57, right  # of 60, held out


def test_languages_of_repeated_rows(spark):
    _, fit, pages = languages_fixture()
    docs, df = spark.createDataFrame(fit, SCHEMA), spark.createDataFrame([*pages, pages[0], pages[0]], "page_id long, url string, html string")
    got = Counter((x.page_id, x.doc_id) for x in language.identify_languages(df, docs).collect())
    assert got[pages[0][0], None] == 3 and sum(got.values()) == len(fit) + len(pages) + 2


# HTML


def test_headers_outside_of_articles_are_dropped(spark):
    pages = [
        (1, "http://one.org/", "<header>Site menu</header><div><p>Story text</p></div>"),
        (2, "http://two.org/", "<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Body</p></article></body>"),
    ]
    got = {x.page_id: x.text for x in html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "Story text", 2: "Title Body"}


def wrapped(spark, pages):
    return {x.page_id: x.text for x in html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def framed(i, lead, story):
    return f"<html><body><div class='top'>Site name</div><div class='lead'>{lead}</div><div class='story'><p>told {i}</p><p>{story}</p></div><div class='end'>Imprint</div></body></html>"


def test_wrappers_count_all_pages_of_a_host(spark):
    story = lambda i: " ".join(f"word{i * k}" for k in range(20))
    # a lead that varies on one page of 40 is no template, though six pages could all have the same
    pages = [(i, "http://a.org/", framed(i, "Other lead" if i == 17 else "Same lead", i * 7)) for i in range(40)]
    # rare layouts have slots too: three pages of 60 are notes
    pages += [(100 + i, "http://b.org/", framed(i, "Same lead", story(i))) for i in range(57)]
    pages += [(160 + i, "http://b.org/", f"<html><body><div class='top'>Site name</div><section class='note'><p>noted {i}</p><p>{story(i + 60)}</p></section><div class='by'>By writer {i}</div></body></html>") for i in range(3)]
    got = wrapped(spark, pages)
    assert all("Site name" not in x and "Imprint" not in x for x in got.values())
    assert [got[i] for i in range(40)] == [f"{'Other lead' if i == 17 else 'Same lead'} told {i} {i * 7}" for i in range(40)]
    assert [got[100 + i] for i in range(57)] == [f"told {i} {story(i)}" for i in range(57)]
    assert [got[160 + i] for i in range(3)] == [f"noted {i} {story(i + 60)}" for i in range(3)]


def test_copies_and_odd_pages_in_wrappers(spark):
    odd = "<html><body><p>Not found</p></body></html>"
    texts = [framed(i, f"Lead {i}", f"more {i * 7}") for i in range(4)]
    # copies count once, so that a page with 30 of them is no template; short and empty pages aren't bases
    pages = [(k, "http://c.org/", texts[0]) for k in range(30)] + [(30 + i, "http://c.org/", x) for i, x in enumerate([*texts[1:], odd, "", None])]
    got = wrapped(spark, pages)
    assert {got[k] for k in range(30)} == {"Lead 0 told 0 more 0"}
    assert [got[30 + i] for i in range(6)] == [*(f"Lead {i} told {i} more {i * 7}" for i in (1, 2, 3)), "Not found", "", ""]


def test_wrappers_on_spark_equal_those_in_memory(spark):
    r = random.Random(5)
    part = lambda c, n: "".join(f"<div class='{c}'>{r.choice(['same', 'this', str(r.random())]) if n else 'fixed'}<p>{r.randrange(n + 1)}</p></div>" for _ in range(r.randrange(3)))
    for n in range(3):
        hosts = {f"h{n}{k}.org": list({f"<html><body>{part('a', 0)}<div class='top'>x</div>{part('b', 5)}{part('article-body', 9)}{part('c', k)}</body></html>" for _ in range(30)}) for k in range(4)}
        rows = [(h, p) for h, found in hosts.items() for p in found]
        df = spark.createDataFrame(rows, "host string, html string").withColumn("key", F.xxhash64("html"))
        facts = df.select("host", "html", "key", html_text.layout_of(F.col("html")).alias("layout")).collect()
        want = {}
        for host, found in hosts.items():
            mine = [x for x in facts if x.host == host]
            many = Counter(x.layout for x in mine)
            base = min(mine, key=lambda x: (-many[x.layout], x.layout, len(x.html), x.key)).html
            want[host] = html_text.induce([base, *(p for p in found if p != base)])
        got = {x.host: (sorted(x.slots), sorted(x.fixed)) for x in html_text.wrappers(df.union(df).repartition(7)).collect()}
        assert got == want and any(f for _, f in want.values()) and any(s for s, _ in want.values())


def test_slots_of_few_pages_keep_the_rest_of_others(spark):
    # most pages have nearly all of their text in one paragraph, in which the innermost container is; one page in six shows that the rest is content too
    long = lambda i: f"<p><b>{' '.join(f'word{i * k}' for k in range(40))}</b> end</p>"
    pages = [(i, "http://d.org/", f"<body><div class='story'><h1>Title {i}</h1>{long(i)}<p>last {i}</p></div></body>") for i in range(5)]
    pages.append((5, "http://d.org/", "<body><div class='story'><h1>Title of five words</h1><p>told</p><p>last</p></div></body>"))
    got = wrapped(spark, pages)
    assert [got[i][: len("Title 0")] for i in range(5)] == [f"Title {i}" for i in range(5)] and all(got[i].endswith(f"end last {i}") for i in range(5))
    assert got[5] == "Title of five words told last"
