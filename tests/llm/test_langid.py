import math
import random
import re
from collections import Counter
from urllib.parse import urlsplit

import pytest

from botsift.llm.langid import TextModel, fit_text_model, fuse, trigram_bins, visible_text

PAGES = "page_id bigint, url string, html string, host string"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return fit_text_model(spark.read.parquet(f"{SF}/documents.parquet"))


def test_languages_and_accuracy_on_held_out_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_text_model(d.filter("doc_id % 2 = 0"))
    assert model.languages == ["de", "en", "es", "fr"]
    held = d.filter("doc_id % 2 = 1 AND length(text) > 200").select("text", "lang").collect()
    right = sum(model.languages[int(model.score(r["text"])[1].argmax())] == r["lang"] for r in held)
    assert right >= 0.97 * len(held)


def test_pages_follow_their_text(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in fuse(pages, model).collect()}
    truth = {r["page_id"]: r["html"].split('lang="')[1][:2] for r in pages.collect() if 'lang="' in r["html"]}
    assert len(got) == pages.count()
    assert sum(got[i]["lang"] == t for i, t in truth.items()) >= 0.95 * len(truth)


def test_evidence_decides_without_text(spark, model):
    en = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' AND length(text) > 500").first()["text"]
    rows = [(i, f"http://www.site.example.com/{i}", f'<html lang="en"><p>{en[i:i + 400]}</p>', "x") for i in range(40)]
    rows += [(100, "http://www.site.example.com/q", "", "x"), (101, "http://other.example.net/q", '<html lang="en"></html>', "x"),
             (102, None, None, "x"), (103, "not an address", None, "x"), (None, "http://www.site.example.com/z", None, "x"),
             (104, "https://u@neu.de:80/x", None, "x"), (105, "http://www.site.example.com/q", "", "x"),
             (105, "http://www.site.example.com/q", "", "x")]
    got = fuse(spark.createDataFrame(rows, PAGES), model).collect()
    assert len(got) == len(rows)
    lang = {r["page_id"]: r for r in got}
    assert lang[100]["lang"] == lang[101]["lang"] == "en" and lang[100]["text_lang"] is None
    assert lang[104]["host"] == "neu.de" and lang[102]["host"] == ""
    assert all(0 < r["confidence"] <= 1 for r in got)


def posterior(rows, model):
    """Every page's language and its posterior, page by page in plain Python.

    A level's share of a language is (pages of it, without the page itself,
    + 8 pages dealt as the level above says) / (all its pages + 8); the top
    is all pages plus one per language, half of it moved to the country's
    language under a country's suffix that has one.
    """
    langs = model.languages
    country = {"de": "de", "at": "de", "fr": "fr", "mx": "es", "uk": "en", "jp": "ja"}
    pages = []
    for page_id, url, page, _ in rows:
        try:
            host = urlsplit((url or "").lower()).hostname or ""
        except ValueError:
            host = ""
        grams, ll = model.score(visible_text(page or ""))
        ll = [float(x) for x in ll]
        said = re.search(r"<html[^>]*lang=\"([a-z]+)", page or "")
        parts = host.split(".")
        pages.append({"id": page_id, "host": host, "domain": ".".join(parts[-2:]), "suffix": parts[-1],
                      "declared": said[1] if said else None, "ll": ll, "text": ll.index(max(ll)) if grams else None})
    seen = [p for p in pages if p["text"] is not None]
    total = Counter(p["text"] for p in seen)
    out = []
    for p in pages:
        base = [(total[i] + 1) / (len(seen) + len(langs)) for i in range(len(langs))]
        home = country.get(p["suffix"])
        if home in langs:
            base = [b / 2 + (0.5 if lang == home else 0) for b, lang in zip(base, langs)]
        for key in ("suffix", "domain", "host"):
            n = Counter(q["text"] for q in seen if q is not p and p["host"] and q["host"] and q[key] == p[key])
            base = [(n[i] + 8 * b) / (sum(n.values()) + 8) for i, b in enumerate(base)]
        score = [ll + math.log(b) for ll, b in zip(p["ll"], base)]
        if p["declared"]:
            n = Counter(q["text"] for q in seen if q is not p and q["declared"] == p["declared"])
            share = (sum(n.values()) + 1) / (len(seen) + 2)
            score = [s + math.log((n[i] + 20 * share) / (total[i] + 20)) for i, s in enumerate(score)]
        top = max(score)
        out.append((p["id"], langs[score.index(top)], 1 / sum(math.exp(s - top) for s in score)))
    return out


def test_posterior_is_that_of_brute_force(spark, model):
    rng = random.Random(3)
    texts = {lang: [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter(
        f"lang = '{lang}' AND length(text) > 300").limit(5).collect()] for lang in ("de", "en", "fr", "es")}
    hosts = ["www.a.de", "b.a.de", "news.x.com", "y.x.com", "z.fr", "q.mx", "k.jp", "localhost", "m.at"]
    rows = []
    for i in range(150):
        said, lang = rng.choice(["de", "en", "fr", "es", "xx", None]), rng.choice(["de", "en", "fr", "es"])
        start = rng.randrange(200)
        text = rng.choice(["", "ab", texts[lang][i % 5][start:start + rng.choice([4, 12, 60])]])
        html = f"<html{f' lang={chr(34)}{said}{chr(34)}' if said else ''}><p>{text}</p></html>"
        rows.append((i, rng.choice([None, "", f"https://{rng.choice(hosts)}/{i}", f"http://u@{rng.choice(hosts)}:81/"]), html, "x"))
    got = {r["page_id"]: r for r in fuse(spark.createDataFrame(rows, PAGES), model).collect()}
    assert len({r["lang"] for r in got.values()}) == 4
    for page_id, lang, confidence in posterior(rows, model):
        assert got[page_id]["confidence"] == pytest.approx(confidence, abs=2e-6)
        assert got[page_id]["lang"] == lang


def test_empty(spark, model):
    none = spark.createDataFrame([], PAGES)
    assert fuse(none, model).count() == 0
    d = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    empty = fit_text_model(d)
    assert isinstance(empty, TextModel) and empty.languages == []
    page = spark.createDataFrame([(1, "http://a.b/", "<p>text here</p>", "x")], PAGES)
    assert [r["lang"] for r in fuse(page, empty).collect()] == [None]


def test_text_helpers():
    assert "".join(visible_text("<p>a<!-- <b> --><script>x</script>&eacute;</p>").split()) == "aé"
    assert len(trigram_bins("ab")) == 0 and len(trigram_bins("A  bc")) == 2
