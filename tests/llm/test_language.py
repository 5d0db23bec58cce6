import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cadenza.llm.language import SUFFIXES, declared_language, identify, train, url_host, visible_text
from cadenza.llm.queries import QUERIES

WORDS = {"en": "the and of with from that have this were their which".split(), "de": "der die und nicht eine auf werden über können schön".split(), "fr": "le la et une dans pour était être français même".split()}


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 40))), lang, f"www.{lang}{i % 3}.example.{'de' if lang == 'de' else 'com'}", i % 7))
    return out


SCHEMA = "doc_id long, text string, lang string, host string, confidence int"


def trigrams(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    return [((a | b << 8 | c << 16) * 2654435761 % 2**32) >> 20 for a, b, c in zip(raw, raw[1:], raw[2:])]


def brute(labelled, pages):
    """{id: (language, confidence, text_language, accepted)} by the fusion written out: trigrams, markup, suffix, host > domain > all."""
    counts = defaultdict(lambda: Counter())
    for text, lang in labelled:
        if lang is not None and len((text or "").encode()) >= 3 and text.strip(" \t\n\v\f\r"):
            counts[lang].update(trigrams(text))
    languages = sorted(counts)
    classes = [*languages, "und"]
    logp = {c: (lambda g, n=counts[c], t=sum(counts[c].values()): math.log((n[g] + 0.5) / (t + 2048))) if c != "und" else (lambda g: -math.log(4096)) for c in classes}
    ll, filled, by_text = {}, {}, {}
    for i, text, _, _ in pages:
        grams = trigrams(text or "") if (text or "").strip(" \t\n\v\f\r") else []
        filled[i] = len(grams)
        ll[i] = [sum(logp[c](g) for g in grams) * min(1, 60 / max(1, len(grams))) for c in classes]
        raw = [sum(logp[c](g) for g in grams) for c in classes]
        by_text[i] = classes[raw.index(max(raw))] if grams else None
    domain_of = lambda h: None if h is None else ".".join(h.split(".")[-2:]) if h.count(".") and all(h.split(".")[-2:]) else h
    seen, hosts, domains = Counter(), defaultdict(Counter), defaultdict(Counter)
    for i, _, _, host in pages:
        if by_text[i] is not None:
            seen[by_text[i]] += 1
            hosts[host][by_text[i]] += 1
            domains[domain_of(host)][by_text[i]] += 1
    base = [(seen[c] + 1) / (sum(seen.values()) + len(classes)) * 0.99 if c != "und" else 0.01 for c in classes]
    smooth = lambda n, prior: [(n[c] + 50 * p) / (sum(n.values()) + 50) for c, p in zip(classes, prior, strict=True)]

    def says(value, trust):
        if value not in languages:
            return [0.0] * len(classes)
        rest = math.log((1 - trust) / max(1, len(languages) - 1))
        return [math.log(trust) if c == value else -math.log(len(languages)) if c == "und" else rest for c in classes]

    out = {}
    for i, _, declared, host in pages:
        prior = smooth(hosts[host], smooth(domains[domain_of(host)], base)) if host is not None and host in hosts else base
        suffix = SUFFIXES.get(host.rsplit(".", 1)[-1]) if host and "." in host else None
        logs = [sum(x) for x in zip(ll[i], map(math.log, prior), says(declared and declared.lower(), 0.8), says(suffix, 0.7), strict=True)]
        top = max(logs)
        p = [math.exp(x - top) for x in logs]
        best = max(p) / sum(p)
        language = classes[p.index(max(p))]
        out.setdefault(i, []).append((language, best, by_text[i], filled[i] > 0 and language != "und" and best >= 0.5))
    return out


def same(found, want):
    assert len(found) == sum(map(len, want.values()))
    for r in found:
        language, confidence, text_language, accepted = want[next(iter(r.asDict().values()))][0]
        assert (r.language, r.text_language, r.accepted) == (language, text_language, accepted) and abs(r.confidence - confidence) < 1e-9


def test_fusion_against_plain_python(spark):
    """Hosts of one, several and no labels, suffixes that speak for a language and others, wrong and unknown declarations."""
    r, words = random.Random(6), sorted(sum(WORDS.values(), []))
    docs = [(i, t, lang) for i, t, lang, *_ in rows(120, 5)] + [(900, None, "en"), (901, "no label here", None), (902, " \n ", "de")]
    hosts = [None, "localhost", "a.example.de", "b.example.de", "www.x.fr", "shop.example.com", "x.mx", "y..z", "one.two.three.de"]
    pages = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30))), r.choice([None, "de", "FR", "xx", "en"]), r.choice(hosts)) for i in range(200)]
    pages += [(300, None, "de", "a.example.de"), (301, "  ", None, None), (302, "ab", "de", None), (303, "0123456789" * 9, None, None), (304, "THE AND OF" * 5000, "de", "x.mx")]
    model = train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), id_col="doc_id", text_col="text", label_col="lang")
    table = spark.createDataFrame(pages, "page_id long, text string, declared string, host string")
    found = identify(table, model, id_col="page_id", declared=F.col("declared"), host=F.col("host")).collect()
    same(found, brute([(t, lang) for _, t, lang in docs], pages))


def test_query_against_plain_python(spark):
    """The registered query on the small tables: all its rows."""
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", visible_text(F.col("html")), declared_language(F.col("html")), url_host(F.col("url"))).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()
    same(QUERIES["op9_language_id"](spark, sf).collect(), brute(map(tuple, docs), [tuple(p) for p in pages]))


def test_held_out_accuracy(spark):
    model = train(spark.createDataFrame(rows(300, 1), SCHEMA), id_col="doc_id", text_col="text", label_col="lang")
    held_out = spark.createDataFrame(rows(200, 2), SCHEMA)
    truth = {r.doc_id: r.lang for r in held_out.collect()}
    alone = identify(held_out, model).collect()
    assert sum(r.text_language == truth[r.doc_id] for r in alone) >= 0.95 * len(truth)
    fused = identify(held_out, model, declared=F.col("lang"), host=F.col("host")).collect()
    assert sum(r.language == truth[r.doc_id] and r.accepted for r in fused) >= 0.98 * len(truth)


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train_on, held_out = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    model = train(train_on, id_col="doc_id", text_col="text", label_col="lang")
    got = held_out.select("doc_id", "lang").join(identify(held_out, model, host=F.col("source")), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) > 0.97 * len(got)
    assert sum(r.accepted for r in got) > 0.97 * len(got)


def test_evidence_and_rejection(spark, no_docs):
    model = train(spark.createDataFrame(rows(300, 1), SCHEMA), id_col="doc_id", text_col="text", label_col="lang")
    odd = [(1, None, "en", None, 1), (2, "", "de", "h", 1), (3, " \n", None, "h", 1), (4, "#%&!! 0x7f ~~~ @@@ ^^^ 99182 {}{}[]" * 5, "en", "h", 1), (5, "dd", "de", "a.de", 1), (5, "dd", "DE", "a.de", 1), (None, "der die und nicht", "xx", None, 1)]
    got = identify(spark.createDataFrame(odd, SCHEMA), model, declared=F.col("lang"), host=F.col("host")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(odd) and not any(r.accepted for i in (1, 2, 3, 4) for r in by[i])
    assert {r.language for r in by[5]} == {"de"} and by[None][0].language == "de" and by[None][0].accepted
    assert by[4][0].language == "und" and by[1][0].text_language is None
    assert identify(no_docs, model, host=F.col("source")).count() == 0
    assert train(no_docs, id_col="doc_id", text_col="text", label_col="lang")[0] == []
    assert not any(r.accepted for r in identify(spark.createDataFrame(odd, SCHEMA), ([], model[1][:0])).collect())


def test_evidence_of_pages(spark):
    cases = [
        ("https://me@WWW.Tion.example.DE:8080/en/1?u=//x.fr", '<!-- <html lang="fr"> --><!DOCTYPE html><HTML data-a=" lang=es >" Lang=\'de-AT\'><p title="a>b">Sch&ouml;n &#252;ber &#xfc;b &amp;amp; &nix; AT&T</p><script>var t="</p>";</script>', "www.tion.example.de", "de", "Sch\u00f6n \u00fcber \u00fcb &amp; &nix; AT&T"),
        ("http://a.b.fr./x", '<html xml:lang="fr"><style>p{}</style>un<br>deux<!-- open', "a.b.fr", "fr", "un deux"),
        ("not an address", "<html><body lang=en>2 < 3", None, None, "2 < 3"),
        (None, None, None, None, None),
        ("//x.org", "", "x.org", None, ""),
    ]
    table = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, url string, html string")
    got = table.select("i", url_host(F.col("url")), declared_language(F.col("html")), visible_text(F.col("html"))).orderBy("i").collect()
    for (_, host, declared, text), case in zip(got, cases, strict=True):
        assert (host, declared, text and " ".join(text.split())) == case[2:]


def test_every_page_is_identified(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html.split('<html lang="')[1][:2] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op9_language_id"](spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    assert sum(r.language == pages[r.page_id] and r.accepted for r in got) > 0.97 * len(pages)


def test_every_label_is_learnt(spark):
    r = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02}": ["".join(r.choice(alphabet) for _ in range(6)) for _ in range(8)] for i in range(70)}
    made = [(i, " ".join(r.choice(words[k]) for _ in range(12)), k) for i, k in enumerate(k for k in words for _ in range(2 if k != "l69" else 1))]
    made += [(1000 + i, "the and of with from that have this", "often") for i in range(6000)] + [(9000, " \t\n ", "none"), (9001, None, "none")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = train(docs, id_col="doc_id", text_col="text", label_col="lang", rows_per_label=50)
    assert model[0] == [*sorted(words), "often"]
    assert (model[1].max(1) > model[1].min(1)).all()
    held_out = [(i, " ".join(r.choice(words[k]) for _ in range(12)), k) for i, k in enumerate(words)]
    got = identify(spark.createDataFrame(held_out, "doc_id long, text string, lang string"), model).collect()
    assert sum(g.text_language == held_out[g.doc_id][2] for g in got) > 0.9 * len(got)
