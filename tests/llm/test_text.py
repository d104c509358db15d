import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import gather, messy_rows, table, words
from tickframe.llm import decontaminate, html_text, language, quality, toxicity
from tickframe.llm.labelled_pages import PAGES, START, STOP
from tickframe.llm.labels import labelled_sample

SF = "/root/testdata/sf0.01"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- decontamination ----

def contamination_by_hand(rows, items, window=10):
    split = lambda t: WORD.findall((t or "").translate(AZ))
    out = Counter()
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            own = split(text)
            size = min(window, len(own))
            wins = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found |= {str(item)} - {"None"}
        listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d, len(w), len(hit), len(found), listed, bool(hit)] += 1
    return out


def benchmark(spark, rng):
    long = [words(rng, n, 30) for n in (9, 10, 11, 25, 40, 3, 1)]
    items = [(i, t) for i, t in enumerate(long)]
    items += [(90, None), (91, ""), (92, "…"), (93, "ONE"), (94, "É ß, é"), (95, "É ß, é"), (None, "w1 w2 w3 w4"), (96, "w5 " * 30), (96, "w6 w7")]
    return items, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block_words", [200_000, 12])
def test_contamination(spark, block_words):
    rng = random.Random(2)
    items, frame = benchmark(spark, rng)
    rows = messy_rows() + [(3000 + i, words(rng, 5, 30) + ". " + (t or "").upper().replace(" ", ", ") + "\n" + words(rng, 5, 30))
                           for i, (_, t) in enumerate(items)]
    rows += [(4000, (items[3][1] + " ") * 3), (4001, " ".join(items[4][1].split()[5:20])), (4002, "w5 " * 200), (4000, (items[3][1] + " ") * 3)]
    docs = table(spark, rows)
    got = decontaminate.digest(decontaminate.contamination(docs, frame, block_words=block_words))
    want = contamination_by_hand(rows, items)
    assert Counter(gather(got)) == want
    kept = decontaminate.clean_documents(docs, frame, block_words=block_words)
    assert kept.columns == docs.columns
    assert Counter(r[0] for r in gather(kept.select("doc_id"))) == Counter({d: 0 for d in ()}) + sum(
        (Counter({k[0]: n}) for k, n in want.items() if not k[5]), Counter())


def test_long_and_repeated_items_are_dealt_in_parts(spark):
    rng = random.Random(8)
    long = words(rng, 700, 60)
    items = [(1, long)] * 30 + [(2, words(rng, 12, 60)), (3, "w1 w2"), (None, long), (4, "w1 w2")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    parts = decontaminate._parts(frame.selectExpr("cast(item_id as string) item", "text"), 10, 50).collect()
    assert max(r["n_words"] for r in parts) == 59 and len(parts) == 2 * 14 + 3
    held = [sum(len(t.split()) for _, t in b) for b in decontaminate._blocks(frame, "item_id", "text", 10, 100)]
    assert len(held) > 8 and max(held) < 300
    split = long.split()
    rows = [(i, " ".join(split[a: a + n])) for i, (a, n) in enumerate([(0, 700), (45, 10), (49, 10), (50, 9), (640, 60), (90, 30)])] + [(9, "x w1 w2 x")]
    got = decontaminate.digest(decontaminate.contamination(table(spark, rows), frame, block_words=100))
    assert Counter(gather(got)) == contamination_by_hand(rows, items)


def test_contamination_without_rows(spark):
    items, frame = benchmark(spark, random.Random(2))
    assert gather(decontaminate.contamination(table(spark, []), frame)) == []
    got = decontaminate.digest(decontaminate.contamination(table(spark, messy_rows()), frame.limit(0)))
    assert {r[2:] for r in gather(got)} == {(0, 0, hashlib.sha256(b"").hexdigest(), False)}


def test_the_rarest_shingle_is_the_prefix():
    block = decontaminate.Windows([("1", b"a b c d")], 4, 2)
    block.order({(b"a", b"b"): 5, (b"b", b"c"): 1, (b"c", b"d"): 9})
    assert block.prefix == {(b"b", b"c"): {(1, 4)}}


# ---- language ----

def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", F.col("doc_id") % 4 == 2)
    model = language.fit(docs.filter("NOT held"))
    scored = docs.filter("held").select("lang", language.language_column(model, F.col("text")).alias("f"))
    right, n, ok = scored.agg(F.count_if(F.expr("f.lang = lang")), F.count("*"), F.count_if("f.accepted")).first()
    assert right >= 0.98 * n and ok >= 0.98 * n
    assert all(0 <= r[0] <= 1 for r in scored.select("f.score").collect())
    far = spark.createDataFrame([("Это русский текст о погоде на завтра. " * 30,), ("qzx vkw jjq xxq zzv " * 60,)], "text string")
    assert [r[0] for r in far.select(language.language_column(model, F.col("text")).accepted).collect()] == [False, False]


def test_language_awkward_texts(spark):
    docs = table(spark, [*((i, "the and of that was", "en") for i in range(30)), *((i, "der die und das ist", "de") for i in range(30)),
                         (1, None, "en"), (2, "x", None), (3, "", "de"), (4, "123", "fr")])
    model = language.fit(docs)
    got = table(spark, messy_rows()).select("doc_id", "text", language.language_column(model, F.col("text")).alias("f")).collect()
    assert len(got) == len(messy_rows())
    for r in got:
        has = any(c.isalpha() for c in r["text"] or "")
        assert (r["f"]["lang"] == "und") == (not has) and 0 <= r["f"]["score"] <= 1 and (has or not r["f"]["accepted"])
    assert model.predict("und das")[0] == "de"
    nothing = language.fit(table(spark, []))
    assert nothing.predict("the") == ("und", 0.0, False)


def test_language_of_few_texts_in_many_copies(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 20), "aa") for i in range(200)]
    for k in range(20):  # 20 languages, each one text of own letters in 40 copies
        rows += [(1000 + k, " ".join(chr(0x4E00 + 50 * k + j) * 3 for j in range(9)), f"l{k:02}")] * 40
    rows += [(2000, "123", "none")] * 5
    model = language.fit(table(spark, rows), sample=44)
    # The old draw gave each language either all its copies or no centroid at all.
    assert Counter(model.languages[i] for i in model.of) == Counter({"aa": 2}) + Counter(f"l{k:02}" for k in range(20))
    assert all(model.predict(t)[0] == lang for _, t, lang in rows[200:-5])


def test_language_learns_from_every_text(spark):
    """Centroids and least cosines are those of all different texts, as found in memory; a sample of 2,000 missed most."""
    rng = random.Random(15)
    rows = [(i, words(rng, 12, 40) if i % 2 else " ".join(f"z{rng.randrange(40)}q" for _ in range(12)), "ab"[i % 2]) for i in range(3000)]
    model = language.fit(table(spark, rows * 2))
    own = {x: list(dict.fromkeys(t for _, t, lang in rows if lang == x)) for x in "ab"}
    assert sum(map(len, own.values())) > 2900
    near = []
    for k, x in enumerate("ab"):
        v = np.stack([language.vector(language.counts(t), model.idf) for t in own[x]])
        want, got = language.cluster(v, 3), model.centroids[model.of == k]
        assert got.shape == want.shape and (got @ want.T).max(axis=1).min() > 0.9999
        near += [(language.length_class(language.counts(t)), c) for t, c in zip(own[x], (v @ got.T).max(axis=1))]
    for c in {c for c, _ in near if sum(d == c for d, _ in near) >= 20}:
        lowest = min(np.quantile([x for d, x in near if d == e], 0.01) for e in {d for d, _ in near} if e >= c and sum(d == e for d, _ in near) >= 20)
        assert abs(model.floor[c] - language.REJECT * lowest) < 1e-5


def test_packed_counts_of_any_size():
    rows = [np.bincount([3, 3, 4000], minlength=4096), np.bincount([7] * 300 + [9], minlength=4096)]
    for some in (rows[:1], rows):
        mask, tf = language.unpacked(*map(list, zip(*map(language.packed, some))))
        assert [np.flatnonzero(m).tolist() for m in mask] == [[3, 4000], [7, 9]][: len(some)]
        assert tf.tolist() == [2, 1, 300, 1][: 2 * len(some)]


def test_more_languages_than_the_sample(spark):
    rows = [(k, "".join(chr(0x4E00 + 50 * k + j) for j in range(9)), f"l{k:02}") for k in range(30) for _ in range(31 - k)]
    model = language.fit(table(spark, rows), sample=12)
    assert model.languages == [f"l{k:02}" for k in range(12)] and len(model.of) == 12


def test_nearest_centroid_by_hand(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, 12, 40) if i % 2 else " ".join(f"z{rng.randrange(40)}q" for _ in range(12)), "ab"[i % 2]) for i in range(80)]
    model = language.fit(table(spark, rows))
    n, df = len(rows), Counter()
    for _, t, _ in rows:
        df.update(np.flatnonzero(language.counts(t)).tolist())
    for _, t, _ in rows[:20]:
        tf = language.counts(t)
        v = {h: math.log1p(int(tf[h])) * (math.log((1 + n) / (1 + df[h])) + 1) for h in np.flatnonzero(tf).tolist()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x / norm * float(c[h]) for h, x in v.items()) for c in model.centroids]
        lang, score, _ = model.predict(t)
        assert lang == model.languages[model.of[int(np.argmax(cos))]] and abs(score - max(cos)) < 1e-4


def test_clusters_have_length_one():
    x = np.random.default_rng(1).random((40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = language.cluster(x, 3)
    assert c.shape == (3, 8) and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert language.cluster(x[:1], 3).shape == (1, 8)


# ---- page text ----

def blocks_of(marked):
    import html

    cut = re.split(r"</?(?:p|h1|h2|h3|div|article|ul|li|blockquote|table|t[rdh]|fig[a-z]*)\b[^>]*>", marked)
    return "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"</?(?:[abi]|img)\b[^>]*>", "", x).replace("<br>", " ")).split()) for x in cut)))


@pytest.mark.parametrize("page", PAGES)
def test_labelled_pages_are_read_back(page):
    marked = page[page.index(START) + len(START): page.index(STOP)]
    assert html_text.main_text(page) == blocks_of(marked)


def test_pages_of_the_test_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        marked = re.search(r"(?s)<article>(.*?)(</article>|<footer|\Z)", r["html"])
        assert got[r["page_id"]]["text"] == blocks_of(marked[1] if marked else "")
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just words here", "just words here"), ("<p>a &amp b &lt;c&gt; &#233;&nbsp; d", "a & b <c> é d"),
    ("<body><p>one<p>two <b>three</b><br>four</body>", "one\ntwo three four"), ("<div><script>x('</p>')</script><p>y</p>", "y"),
    ("<p>a < b and 3 > 2</p>", "a < b and 3 > 2"), ("<!-- unclosed <p>x</p>", ""), ("<p title='>'>q</p>", "q"),
    ("<article><p>first words of it</p><div class='ad'>buy this now</div><p>last words</p></article>", "first words of it\nlast words"),
    ("<article><header><h1>Title</h1></header><p>words that follow</p><aside>no</aside></article>", "Title\nwords that follow"),
    ("<article><p>words</p><div hidden>secret</div><div style='display:none'>secret</div></article>", "words"),
    ("<article><div class='entry-header'>Title</div><p>words here</p><div class='post-comments'>me too</div></article>", "Title\nwords here"),
    ("<div class='overflow-hidden has-sidebar'><p>some words</p></div><div class='CookieBar'>we use them</div>", "some words"),
    ("</div></p><p>x y z</p></section>", "x y z"), ("<article><p>" + "w " * 30000 + "</p></article>", ("w " * 30000).strip())])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    *((f"<p>first words</p><{x}/><p>last words</p>", "first words\nlast words") for x in ("svg", "math", "object", "template", "noscript")),
    *((f"<div><p>first words</p><div><{x} a='b'></div><p>last words</p></div>", "first words\nlast words")
      for x in ("svg", "math", "object", "template", "noscript")),
    *((f"<p>first words</p><{x}><p>last words</p>", "first words\nlast words") for x in ("svg", "math", "object", "template", "noscript")),
    *((f"<p>first words</p><{x}><i>no</i> more</{x}><p>last words</p>", "first words\nlast words") for x in ("svg", "template", "noscript")),
    ("<p>first words</p><svg><svg><text>a</text></svg><text>b</text></svg><p>last words</p>", "first words\nlast words"),
    ("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "where x=2 holds"),
    ("<div>first words <math><mi>x</div>last words", "first words x\nlast words"),
    ("<article><p>first words</p><object data='a'><param name='b'><p>instead of it</p></object></article>", "first words\ninstead of it"),
    ("<p>first words</p><svg>" + "<path d=''/><g></g>" * 50 + "<script/></svg><p>last words</p>", "first words\nlast words")])
def test_embedded_elements_end_where_they_should(page, text):
    assert html_text.main_text(page) == text


ARTICLE = "<h1>A title</h1>" + "<p>Plain words that make a line of the article.</p>" * 4
TEXT = "A title" + "\nPlain words that make a line of the article." * 4


@pytest.mark.parametrize("start,end", [
    ("<div class='layout-with-sidebar'>", "</div>"), ("<div class='wrapper menu-open'>", "</div>"),
    ("<div id='header-and-content'>", "</div>"), ("<form id='aspnetForm' action='x'>", "</form>"), ("<header>", "</header>")])
def test_wrappers_do_not_delete_the_article(start, end):
    inner = [f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>"]
    for x in inner if start == "<header>" else [*inner, f"<div>{ARTICLE}</div>"]:
        assert html_text.main_text(f"<body>{start}{x}<div class='cookie-bar'>we use them</div>{end}<footer>legal words</footer></body>") == TEXT


def test_parts_beside_the_article_stay_out():
    for part in ("<div class='comments'><article><p>me too, very much so</p></article></div>", "<form><p>your name here</p></form>",
                 "<aside><article><p>another story</p></article></aside>"):
        assert html_text.main_text(f"<body><article>{ARTICLE}</article>{part}</body>") == TEXT
    assert html_text.main_text(f"<div hidden><main>{ARTICLE}</main></div>") == ""


FEW = " ".join(f"w{i}" for i in range(21))
MANY = "<div class='comments'>" + "".join(f"<p>{'me too ' * 20}</p>" for _ in range(5)) + "</div>"


@pytest.mark.parametrize("page", [
    f"<body><article><p>{FEW}</p></article>{MANY}</body>", f"<body><article><p>{FEW}</p>{MANY}</article></body>",
    f"<body><p>{FEW}</p>{MANY}</body>", f"<body><div class='post'><p>{FEW}</p></div>{MANY}</body>",
    f"<body><div class='post comments-open'><p>{FEW}</p></div>{MANY}</body>",
    f"<body><div class='cookie-notice'><p>{'we use cookies ' * 33}</p></div><p>{FEW}</p></body>",
    f"<body><p>{FEW}</p><form><p>{'your name ' * 15}</p></form></body>",
    f"<body><p>{FEW}</p><div id='comments' class='comments-area'><article class='comment-body'><p>{'w ' * 60}</p></article></div></body>",
    f"<body><div class='page layout-with-sidebar'><p>{FEW}</p><div class='sidebar'><p>more of it</p></div></div><div class='site-footer'><p>legal words</p></div></body>"])
def test_comments_notices_and_forms_stay_out_however_long(page):
    assert html_text.main_text(page) == FEW
    assert html_text.main_text(f"<body>{MANY}</body>") == ""


@pytest.mark.parametrize("tag", ["<img alt=don't>", '<img alt="5" tall">', '<img title="x>', "<img title='x>", "<img data-a = '>' alt>"])
def test_quotes_count_only_after_an_equals_sign(tag):
    assert html_text.main_text(f"<article><p>one two three</p>{tag}<p>four five six</p></article>") == "one two three\nfour five six"


def test_an_article_keeps_its_list():
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(30))
    page = f"<body><nav><a href='/'>home</a></nav><article><p>first words of it</p><ul>{links}</ul><p>last words of it</p></article><footer><p>legal</p></footer></body>"
    assert html_text.main_text(page).split("\n") == ["first words of it", *(f"link {i}" for i in range(30)), "last words of it"]


@pytest.mark.parametrize("page", ["<div>" * 20000 + "<p>x y z" + "</p>" * 2000, "<svg><g>" * 10000 + "<p>x y z" + "</svg>" * 2000,
                                  '<a title="' * 20000 + "<p>x y z" + "</p class='" * 2000, "<div class='menu-open'><article>" * 10000 + "x y z"])
def test_deep_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 1


def test_best_region():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice([-2, -1, 0, 1, 2]) for _ in range(rng.randrange(9))]
        a, b = html_text.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a</p>", "y")],
                                  "page_id long, url string, html string, text string")
    assert Counter(gather(html_text.extract(pages))) == Counter({(1, "u", "", 0): 2, (None, None, "a", 1): 1})
    assert gather(html_text.extract(pages.limit(0))) == []


# ---- quality and toxicity ----

def held_out(spark, label):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return docs, labels, labelled_sample(docs, labels.filter(~held), label, 2500), docs.join(labels, "doc_id").filter(held)


def test_quality_held_out(spark):
    docs, labels, sample, test = held_out(spark, "quality")
    model = quality.fit(sample, quality.unlabelled_sample(docs, labels, 2500))
    got = test.select("quality", quality.score_column(model, F.col("text")).alias("s")).toPandas()
    hit = (got.s >= 0.5).astype(int)
    assert (hit == got.quality).mean() > 0.93
    assert hit[got.quality == 1].mean() > 0.95 and hit[got.quality == 0].mean() < 0.2


def test_toxicity_held_out(spark):
    _, _, sample, test = held_out(spark, "toxic")
    model = toxicity.fit(sample)
    got = test.select("toxic", toxicity.score_column(model, F.col("text")).alias("s")).toPandas()
    hit = (got.s >= 0.5).astype(int)
    assert (hit == got.toxic).mean() > 0.95
    assert model.score("you are such an idiot, a moron and a loser") > 0.5 > model.score("the and of that was")


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_awkward_texts(spark, module, label):
    docs = table(spark, messy_rows())
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(50)] + [(None, 1, 1), (3, None, None), (4, 1, 1), (9999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1 AND toxic = 1")):
        sample = labelled_sample(docs, some, label, 40)
        assert sample.count() <= 40
        model = module.fit(sample, quality.unlabelled_sample(docs, some, 30)) if module is quality else module.fit(sample)
        scores = [r[0] for r in docs.select(module.score_column(model, F.col("text"))).collect()]
        assert len(scores) == len(messy_rows()) and all(0 <= s <= 1 for s in scores)
        assert model.score(None) == model.score("")
    assert gather(table(spark, []).select(module.score_column(model, F.col("text")))) == []


def test_samples_take_one_row_of_an_id(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(7, f"hot {i}") for i in range(500)] + [(8, "same")] * 300
    docs, labels = table(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 1000).collect()
    assert len(got) == 50 and len(labelled_sample(docs, labels, "quality", 20).collect()) == 20
    assert sum(r["text"].startswith("hot") or r["text"] == "text 7" for r in got) == 1
    # Every document has a label: all count as unlabelled.
    assert quality.unlabelled_sample(docs, labels, 30).count() == 30
    assert quality.unlabelled_sample(docs, labels.filter("doc_id < 40"), 1000).count() == 10
    assert quality.unlabelled_sample(docs.limit(0), labels, 30).count() == 0


def test_the_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(5)
    for prior in (0.5, 0.8):
        n = int(2000 * prior)
        positive, mixed = (np.zeros((2000, len(quality.features(""))), np.float32) for _ in range(2))
        for x in (positive, mixed):
            x[:, :8] = rng.normal(0, 1, (2000, 8))
        mixed[n:, 3] += 6
        rng.shuffle(mixed)
        assert abs(quality.estimated_prior(positive, mixed) - prior) < 0.06
    assert quality.estimated_prior(positive[:0], mixed) == 0.5


def test_quality_risk_by_hand():
    """The same steps on plain lists: risks, gradients and moments written out."""
    rng = random.Random(9)
    texts = [[" ".join(words(rng, 6)) for _ in range(8)], [rng.choice(["!!! ### ", "ok then "]) * rng.randrange(1, 6) for _ in range(12)]]
    p, u = (np.stack([quality.features(t) for t in ts]) for ts in texts)
    model = quality.fit_arrays(p, u, 0.4, steps=3)
    k = p.shape[1]
    mean, scale = u.mean(axis=0), np.maximum(u.std(axis=0), 1e-4)
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    w, b, m, v = np.zeros(k), math.log(0.4 / 0.6), np.zeros(k + 1), np.zeros(k + 1)
    for t in (1, 2, 3):
        gp, gu = [float(x @ w + b) for x in zp], [float(x @ w + b) for x in zu]
        soft = lambda g: math.log1p(math.exp(g))
        s = lambda g: 1 / (1 + math.exp(-g))
        negative = sum(map(soft, gu)) / 12 - 0.4 * sum(map(soft, gp)) / 8
        grad = np.zeros(k + 1)
        for x, g in zip(zu, gu):
            grad += np.append(x, 1) * s(g) / 12 * (1 if negative >= 0 else -1)
        for x, g in zip(zp, gp):
            grad += np.append(x, 1) * ((0.4 * (s(g) - 1) - 0.4 * s(g)) if negative >= 0 else 0.4 * s(g)) / 8
        grad[:k] += quality.RIDGE * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = quality.RATE * (1 - t / 4) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:k], b - step[k]
    for t in texts[0] + texts[1]:
        z = float(np.clip((quality.features(t) - mean) / scale, -8, 8) @ w + b)
        assert abs(model.score(t) - 1 / (1 + math.exp(-z))) < 0.03  # steps follow the sign of a gradient, which rounding may turn


def test_toxicity_by_hand(spark):
    """Log-count ratios counted with sets, and a score that is the logistic sum of the grams a text has."""
    rng = random.Random(10)
    rows = [(words(rng, 6) + (" rude fool" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"), features=300)
    n = [sum(label == c for _, label in rows) for c in (0, 1)]
    has = [Counter(), Counter()]
    for t, label in rows:
        has[label].update(set(toxicity.features(t).tolist()))
    used = np.flatnonzero(model.weights)
    assert 0 < len(used) <= 300
    for h in used.tolist():  # the learned weight times the ratio: a gram of toxic texts must not speak for clean ones
        ratio = math.log((has[1][h] + 1) / (n[1] + 2)) - math.log((has[0][h] + 1) / (n[0] + 2))
        if abs(ratio) > 3:
            assert model.weights[h] * ratio > 0
    for t, label in rows:
        z = model.bias + sum(float(model.weights[h]) for h in set(toxicity.features(t).tolist()))
        assert abs(model.score(t) - 1 / (1 + math.exp(-z))) < 1e-5 and (model.score(t) > 0.5) == bool(label)


def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(3)
    positive, mixed, fresh = (np.zeros((1000, len(quality.features(""))), np.float32) for _ in range(3))
    for x in (positive, mixed, fresh):
        x[:, :8] = rng.normal(0, 1, (1000, 8))
    for x in (mixed, fresh):
        x[:400, 3] += 5  # the unlabelled rows that are negative
    model = quality.fit_arrays(positive, mixed, 0.6)
    z = (fresh - model.mean) / model.scale @ model.weights + model.bias
    assert (z[:400] < 0).mean() > 0.85 and (z[400:] > 0).mean() > 0.95
