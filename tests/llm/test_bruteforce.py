"""Operators against plain Python on small made-up tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.llm import chat_format, decontaminate, fingerprint, html_text, jaccard_join, lm_score, mixing, registry, shared, substring_dedup, toxicity, url_rules

DATA = "/root/testdata/sf0.001"


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def invented(rng, n, words=40):
    return [" ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(0, 60))) for _ in range(n)]


# 1


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 7)
    rng = random.Random(1)
    texts = [*invented(rng, 50), "", None, "ä" * 10, "one"]
    texts.append(texts[0])
    rows = {r.doc_id: r for r in fingerprint.with_edits(docs_of(spark, texts)).collect()}
    assert len(rows) == len(texts)
    order = sorted(rows, reverse=True)

    def jaccard(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        keys = set(a) | set(b)
        return 1.0 if not keys else sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)

    errors = []
    for i, d in enumerate(order):
        own, following = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(own) // 3
        edited = own[: len(own) - cut] + following[:cut]
        assert rows[d].n_chars == len(own)
        assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [rows[d].near_edited - jaccard(own, edited), rows[d].near_next - jaccard(own, following)]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06
    assert rows[0].fingerprint == rows[len(texts) - 1].fingerprint
    assert rows[50].fingerprint == rows[51].fingerprint == fingerprint.EMPTY


def test_collision_rate_is_weighted_similarity():
    cws = fingerprint.Sampler()
    a, b = b"x " * 5 + b"y " * 2 + b"z", b"x " * 3 + b"y " * 4 + b"q"
    rates = []
    for salt in range(60):  # other words, same weights
        one, two = (re.sub(rb"[a-z]", lambda m: m[0] + str(salt).encode(), t) for t in (a, b))
        rates.append(fingerprint.likeness(cws.signature(one), cws.signature(two)))
    assert abs(np.mean(rates) - 5 / 11) < 0.02


# 2


def test_url_rules(spark):
    rng = random.Random(2)
    labels = ["a", "b", "c", "net"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))

    rules = list({(host(), rng.choice(["/", "/x/", "/x/y", ""])): None for _ in range(25)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{host().upper() if rng.random() < 0.2 else host()}{rng.choice(['', '/', '/x/', '/x/y/z', '/x?y', '#x'])}" for _ in range(300)] + [None, "", "no scheme", "http://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.partition("://")[2] if u and "://" in u else ""
        h, p = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        h = h.lower()
        fits = [r for r in rules if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
        best = min(fits, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1], r[2]), default=None)
        assert (got[i].host, got[i].path) == (h, p)
        assert got[i].rule == (best and best[0] + best[1])
        assert got[i].verdict == (best[2] if best else "allow")


# 3


def context_tree(texts, learn, depth):
    """log10 probability of each text by the definition of context-tree weighting."""
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        data = b"\0" * depth + text.lower() + b"\0"
        for i in range(depth, len(data)):
            for k in range(8):
                yield data[i - depth : i], (data[i] >> (8 - k), k), data[i] >> (7 - k) & 1

    for t, y in zip(texts, learn, strict=True):
        for context, node, bit in steps(t) if y else ():
            for d in range(depth + 1):
                counts[context[depth - d :], node][bit] += 1
    children = defaultdict(set)
    for context, node in list(counts):
        if context:
            children[context[1:], node].add(context)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    known = {}

    def weighted(context, node):
        if (context, node) not in known:
            own = kt(*counts.get((context, node), (0, 0)))
            if len(context) == depth:
                known[context, node] = own
            else:
                known[context, node] = math.log(0.5) + np.logaddexp(own, sum(weighted(c, node) for c in children.get((context, node), ())))
        return known[context, node]

    def predict(context, node, bit, d):
        a = counts.get((context[depth - d :], node), (0, 0))
        own = (a[bit] + 0.5) / (a[0] + a[1] + 1)
        if d == depth:
            return own
        stop = math.exp(math.log(0.5) + kt(*a) - weighted(context[depth - d :], node))
        return stop * own + (1 - stop) * predict(context, node, bit, d + 1)

    return [sum(math.log10(predict(c, n, b, 0)) for c, n, b in steps(t)) for t in texts]


def test_lm_scores(spark):
    texts = ["the cat sat", "The cat ran", "", None, "a dog ran", "ža ža", "the the the", "zebra"]
    held = [i % 3 == 2 for i in range(len(texts))]
    rows = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held_out boolean")
    plain = {r.doc_id: r for r in lm_score.score_texts(rows).collect()}
    blocks = {r.doc_id: r for r in lm_score.score_texts(rows, top_words=2, block=20).collect()}
    wanted = context_tree([(t or "").encode() for t in texts], [not h for h in held], lm_score.DEPTH)
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for t in texts]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    for i in range(len(texts)):
        for got in (plain[i], blocks[i]):
            assert got.score == pytest.approx(wanted[i], rel=1e-5)
            assert got.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in tokens[i]))
            assert (got.n_tokens, got.n_known, got.train_tokens) == (len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), sum(c.values()))


def test_lm_without_training_texts(spark):
    rows = spark.createDataFrame([(1, "ab", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r for r in lm_score.score_texts(rows).collect()}
    assert got[1].base_score == 0 and got[1].n_known == 0
    assert got[1].score == pytest.approx(3 * 8 * math.log10(0.5)) and got[2].score == pytest.approx(8 * math.log10(0.5))


# 4


PAGE = """<html><head><title>no</title><script>if (a < b) "</p>"</script></head><body><nav><li>menu</nav>
<div class="cookie-notice">no</div><article><h1>Title &amp; more</h1><p>One&nbsp;<b>two</b>
three<br>four<p>Five<aside>no</aside><div id="comments"><p>no</p></div><form><p>no</form></article><footer>no</footer></body></html>"""


def test_markup():
    assert [t for t, _ in html_text.lines_of(PAGE)] == ["Title & more", "One two three four", "Five"]
    assert html_text.lines_of("") == [] and html_text.lines_of("plain <b>text") == [("plain text", False)]
    assert [t for t, _ in html_text.lines_of("<p>a<script>never closed")] == ["a"]


@pytest.mark.parametrize(
    "page",
    [
        "<html class='no-banner'><body class='has-sidebar'><p>text</p></body></html>",
        "<body class='sidebar'><main class='content-with-sidebar'><p>text</p></main></body>",
        "<body id='search'><article id='login-guide' class='comments'><p>text</p></article></body>",
        "<div class='post search-result'><p>text</p></div>",
        "<div class='social'><div class='sidebar'><article class='post'><p>text</p></article></div></div>",
        "<div class='popup'><main><p>text</p></main></div>",
        "<article><p>text</p></article><div class='related'><article><p>no</p></article></div><div class='ad-slot-1 x'>no</div><div id='siteFooter'>no</div>",
        "<article><p>text</p><article class='comment'><p>no</p></article></article><div class='grid sidebar'>no</div>",
    ],
)
def test_class_words_rule_out_parts_only(page):
    assert [t for t, _ in html_text.lines_of(page)] == ["text"]


def test_page_differencing(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BLOCK_ROWS", 2)
    site = "<div>Welcome to the site</div><p>{}</p><div>All our offers</div>"
    pages = [(i, f"http://h.org/n/{i}", site.format(f"story {i}")) for i in range(6)]
    pages += [(6, "http://h.org/n/5", site.format("story 5")), (7, "http://alone.org/", site.format("x")), (8, None, None), (9, "http://h.org/z", PAGE)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"story {i}" for i in range(5)]
    assert got[5] == "story 5"
    # equal pages are one in the order, so their neighbours are other pages
    assert got[6] == "story 5"
    assert got[7] == "Welcome to the site\nx\nAll our offers" and got[8] == ""
    assert got[9].startswith("Title & more\n")


def test_differencing_spares_articles(spark):
    site = "<div>By {0}</div><div>Hello</div><main><article><p>Share this story</p><h1>T{0}</h1><p>story {0}</p><div>Get our letters</div></article></main>"
    pages = [(i, f"http://h.org/n/{i}", site.format(i)) for i in range(4)]
    # the same article twice, once with an edited line, beside other site lines
    whole = "<div>{}</div><div>Hello</div><article>" + "".join(f"<p>paragraph {i} of the article</p>" for i in range(5)) + "<p>{}</p></article>"
    pages += [(10, "http://i.org/a/1", whole.format("one", "end")), (11, "http://i.org/a/1", whole.format("two", "END")), (12, "http://alone.org/", whole.format("x", "end"))]
    got = {r.page_id: r.text.split("\n") for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [[f"By {i}", "Share this story", f"T{i}", f"story {i}", "Get our letters"] for i in range(4)]
    article = [f"paragraph {i} of the article" for i in range(5)]
    assert got[10] == ["one", *article, "end"] and got[11] == ["two", *article, "END"]
    assert got[12] == ["x", "Hello", *article, "end"]


def test_lines_that_articles_share_stay(spark):
    """A short sentence of every article, articles that share some or nearly all lines; the
    lines beside them go by alignment alone, no word list names them."""
    page = "<div>Our site</div><div>{0} only here</div><article><p>Yes.</p>{1}<p>Les.</p></article><div>Ask us</div>"
    parts = [[f"s{i}", *(f"p{k}" for k in range(shared))] for i, shared in enumerate((0, 2, 5, 9, 9))]
    rows = [(i, f"http://h.org/{i}", page.format(i, "".join(f"<p>{t}</p>" for t in p))) for i, p in enumerate(parts)]
    got = {r.page_id: r.text.split("\n") for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == [f"{i} only here", "Yes.", *p, "Les."] for i, p in enumerate(parts))


def test_many_equal_pages(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BLOCK_ROWS", 3)
    site = "<div>Welcome</div><p>{}</p><div>Offers</div>"
    rows = [(i, f"http://h.org/n/{i:03}", site.format("the same" if i % 3 else f"story {i}")) for i in range(60)] + [(100, "http://h.org/n/100", site.format("same twice"))] * 2
    rows += [(7, "http://h.org/n/007", site.format("other text, same id"))]
    got = sorted((r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    wanted = [(i, "the same" if i % 3 else f"story {i}") for i in range(60)] + [(100, "same twice")] * 2 + [(7, "other text, same id")]
    assert got == sorted(wanted)


def aligned(a, b):
    """A longest common subsequence by the full table: which lines of ``a`` are in it."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = 1 + n[i + 1][j + 1] if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_whole_pages_by_brute_force(spark, monkeypatch):
    """Pages built from parts of known kind; every line by its kind, pairing and table."""
    monkeypatch.setattr(html_text, "BLOCK_ROWS", 4)
    rng = random.Random(44)
    pages, built = [], {}
    for i in range(80):
        host, path = f"h{i % 3}.org", f"/{rng.choice('ab')}/{rng.randrange(40)}"
        body = [(f"line {i} {k}", True, False) for k in range(rng.randrange(0, 5))]
        if rng.random() < 0.5:
            body.insert(rng.randrange(len(body) + 1), ("Share this", True, False))
        lines = [("Menu", False, True), *([(f"Item {i}", False, True)] if i % 2 else []), ("By the staff", False, False), *body, (f"note {i}", True, True), ("Offers", False, False), ("Imprint", False, True)]
        tags = {(False, True): "<nav>{}</nav>", (False, False): "<div>{}</div>", (True, False): "<p>{}</p>", (True, True): "<div class='comments'><p>{}</p></div>"}
        cut = [tags[own, out].format(t) for t, own, out in lines]
        inside = [k for k, x in enumerate(lines) if x[1]]
        cut[inside[0]] = "<article>" + cut[inside[0]]
        cut[inside[-1]] += "</article>"
        pages.append((i, f"http://{host}{path}", "<body>" + "".join(cut)))
        built[i] = (host, path, lines)
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    order = sorted(built, key=lambda i: (*built[i][:2], pages[i][1], f"{i:>20}"))
    decided = 0
    for at, i in enumerate(order):
        host, path, lines = built[i]
        near = [built[j] for j in (order[at - 1] if at else None, order[at + 1] if at + 1 < len(order) else None) if j is not None and built[j][0] == host]
        near.sort(key=lambda x: -next((k for k in range(min(len(x[1]), len(path))) if x[1][k] != path[k]), min(len(x[1]), len(path))))
        left = [k for k, x in enumerate(lines) if not x[2]]
        article = {k for k in left if lines[k][1]}
        gone = set()
        for _, _, other in near:
            both = aligned([(t, out) for t, _, out in lines], [(t, out) for t, _, out in other])
            if not article and both.issuperset(left):
                continue
            gone = both - article
            break
        decided += bool(gone)
        assert got[i] == "\n".join(lines[k][0] for k in left if k not in gone), i
    assert decided > 70


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        found = html_text.common(a, b)
        best = max(n for n in range(len(a) + 1) for pick in itertools.combinations(a, n) if (lambda it: all(x in it for x in pick))(iter(b)))
        assert len(found) == best
        it = iter(b)
        assert all(a[i] in it for i in sorted(found))


# 5


def repeats(texts, window):
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return words, out


@pytest.mark.parametrize(("window", "anchor", "hot"), [(5, 2, 1000), (5, 2, 1), (6, 5, 2), (35, 12, 1000)])
def test_substring_dedup(spark, monkeypatch, window, anchor, hot):
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", hot)
    rng = random.Random(window)
    passage = " ".join(f"p{i}" for i in range(2 * window))
    texts = invented(rng, 40, 4) + [f"{t} {passage} {t}" for t in invented(rng, 5)] + ["a " * (3 * window), "a b " * (2 * window), passage, passage, None, "", " ".join(f"u{i}" for i in range(5000))]
    got = {r.doc_id: r for r in substring_dedup.dedup_digest(docs_of(spark, texts), window, anchor).collect()}
    kept = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs_of(spark, texts), window, anchor).collect()}
    words, left = repeats(texts, window)
    for i in range(len(texts)):
        assert (got[i].n_words, got[i].n_removed) == (len(words[i]), len(words[i]) - len(left[i])), i
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(left[i]).encode()).hexdigest()
        assert (kept[i] or "").split() == left[i]
        if len(words[i]) == len(left[i]):
            assert kept[i] == texts[i]


# 6


def test_chat_round_trip(spark):
    rng = random.Random(6)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "␛", "␛1", "␛0", "<", "[", "a", "\n", "user"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys<s>tem", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randrange(8)))])) for c in range(30) for t in range(rng.randrange(1, 5))]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chats.withColumn("loss", chat_format.masked(F.col("formatted"), F.col("loss_spans"))).collect()}
    for c in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [(t.role, t.text) for t in got[c].turns] == turns
        masked = "".join(got[c].formatted[s.start : s.end] for s in got[c].loss_spans)
        for plain, coded in reversed(chat_format.ESCAPES):
            masked = masked.replace(coded, plain)
        assert masked == got[c].loss == "".join(t for r, t in turns if r == "assistant")
    plain = chat_format.render_turns(spark.createDataFrame([(1, 1, "user", "no <b> conflict [x]")], "conv_id long, turn long, role string, text string")).first()
    assert not plain.escaped and "no <b> conflict [x]" in plain.rendered


def test_a_reading_that_differs_fails(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "ESCAPES", ())  # nothing is escaped: the second reading differs too
    rows = spark.createDataFrame([(1, 1, "user", "</s>")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="does not read back"):
        chat_format.format_chats(rows).collect()


def test_mask_counts_code_points(spark):
    rows = spark.createDataFrame([(1, 1, "user", "😀é"), (1, 2, "assistant", "a😀 </s>東"), (1, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(rows).select(chat_format.masked(F.col("formatted"), F.col("loss_spans")).alias("x")).first()
    assert got.x == "a😀 </s>東"


def test_grammar_rejects(spark):
    bad = ["x", "<s>[INST]u[/INST]a", "<s>[INST]u[/INST]a</s>x", "<s>[INST][/INST]a[INST]</s>", "x<s>[INST]u[/INST]a</s>", "<s>x[INST]u[/INST]a</s>"]
    rows = spark.createDataFrame([(b,) for b in bad], "f string").select(chat_format.parse(F.col("f")).alias("t")).collect()
    assert all(r.t is None for r in rows)


# 7


def test_mixing_targets(spark):
    rng = random.Random(7)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([1, 5, 50, 1000, 0]) for i in range(rng.randrange(1, 8))} | {None: 7}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        names = [*sorted(s for s in sizes if s is not None), None]
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        total, fixed = sum(sizes.values()), {}
        while True:
            free = [s for s in names if s not in fixed]
            rest = total - sum(fixed.values())
            share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 3 * sizes[s]]
            if not over:
                break
            fixed |= {s: 3 * sizes[s] for s in over}
        assert got == pytest.approx(fixed | share)


def test_mixing_takes_budgets(spark):
    rng = random.Random(70)
    rows = [(i, " ".join("w" * rng.randrange(30)), rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, range_rows=20).collect()
    assert mixed and sorted(map(tuple, mixed), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    taken = Counter()
    for r in mixed:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for r in mixed:
        assert taken[r.source] == math.floor(r.target + 0.5)
    words = Counter()
    for r in mixing.emit(docs).collect():
        words[r.source] += len(r.text.split())
    assert words == taken


# 8


def test_toxicity_learns_and_is_fair(spark):
    rng = random.Random(8)
    plain, rude = [f"w{i}" for i in range(200)], ["loser", "idiot", "scum"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = rng.choices(plain, k=30)
        if toxic:
            words.insert(rng.randrange(30), rng.choice(rude))
        if rng.random() < (0.6 if toxic else 0.05):  # groups are named more in toxic texts
            words.insert(rng.randrange(30), rng.choice(["muslim", "jewish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fair, unfair = toxicity.train(docs, marked), toxicity.train(docs, marked, fairness=0.0)
    right = sum((s >= 0.3) == bool(y) for s, (_, y) in zip(fair.scores([t.encode() for _, t in rows]), labels, strict=True))
    assert right >= 590
    neutral = [f"w1 w2 {g} w3".encode() for g in ("muslim", "jewish", "christian", "hindu")]
    spread = [np.ptp(np.log(np.array(m.scores(neutral)) / (1 - np.array(m.scores(neutral))))) for m in (fair, unfair)]
    assert spread[0] < 0.3 * spread[1]
    assert toxicity.train(docs, marked.filter("toxic = 0")).scores([b"idiot"])[0] < 0.3


def test_toxicity_by_brute_force(spark):
    """Features, loss and steps written out with dense tables."""
    rng = random.Random(88)
    rows, labels = [], []
    for i in range(160):
        toxic = i % 3 == 0
        words = [f"w{rng.randrange(40)}" for _ in range(12)] + (["loser", "Idiotic"] if toxic and rng.random() < 0.9 else []) + (["muslim"] if rng.random() < (0.5 if toxic else 0.1) else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))

    def feats(words):
        return {f for w in words for f in (w + " ", *[w[:n] for n in (3, 4, 5, 6) if len(w) >= n])}

    def split(t):
        return set(re.findall(r"[0-9a-z]+", t.lower()))

    y = np.array([v for _, v in labels], dtype=float)
    own = [split(t) for _, t in rows]
    has = [feats(w) for w in own]
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    kept = []
    for f in sorted(set().union(*has)):
        a, b = sum(f in h for h, v in zip(has, y, strict=True) if v), sum(f in h for h, v in zip(has, y, strict=True) if not v)
        rate, ratio = (a + b) / len(y), 0.0
        for x, n in ((a, pos), (b, neg)):
            ratio += (x * math.log(x / n / rate) if x else 0) + ((n - x) * math.log((1 - x / n) / (1 - rate)) if n - x else 0)
        if a + b >= 5 and a / pos > b / neg and ratio > 12:
            kept.append(f)
    kind = {t: [x for x in g if x != t] for g in toxicity.IDENTITY for t in g}
    ascii_terms = {f for w in kind for f in feats({w}) if w.isascii()}
    names = sorted(set(kept) | ascii_terms)
    dense = lambda sets: np.array([[f in s for f in names] for s in sets], dtype=float)
    pairs = []
    for i, w in enumerate(own):
        named = sorted(x for x in w if x in kind)
        if named:
            pairs.append((i, feats(w - set(named))))
            pairs += [(i, feats({kind[x][k % len(kind[x])] if x in named else x for x in w})) for k in range(max(len(kind[x]) for x in named))]
    x, twin, of = dense(has), dense([s for _, s in pairs]), [i for i, _ in pairs]
    share = (pos + 0.5) / (len(y) + 1)
    weight = np.where(y == 1, share / pos, (1 - share) / neg)
    theta, m, v = np.append(np.zeros(len(names)), math.log(share / (1 - share))), 0.0, 0.0
    for step in range(1, toxicity.STEPS + 1):
        w, b = theta[:-1], theta[-1]
        error = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        gap = (x[of] - twin) @ w
        g = np.append(x.T @ error + 2 * toxicity.RIDGE * w + toxicity.FAIRNESS * 2 / len(pairs) * (x[of] - twin).T @ gap, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    wanted = 1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1])))
    assert model.scores([t.encode() for _, t in rows]) == pytest.approx(wanted, abs=5e-3)
    assert set(kept) <= set(f.decode() for f in model.weights)


def test_toxicity_query(spark):
    q = registry.queries()["op8_toxicity"]
    rows = q(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


# 9


def linked(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(spark, k, num):
    rng = random.Random(k)
    texts = invented(rng, 40)
    for base in range(6):
        words = [f"b{base}x{i}" for i in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(2, 14)):
            copy = [*words]
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(40)}"
            texts.append(" ".join(copy))
    texts += ["", None, "one", "One", "one two", texts[45], texts[50].upper()]
    rng.shuffle(texts)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs_of(spark, texts), k, num, 100).collect()}
    sets, labels = linked(texts, k, num, 100)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), labels[i])
    kept = {r.doc_id for r in jaccard_join.keep_one(docs_of(spark, texts), k, num, 100).collect()}
    assert kept == set(labels)


def test_join_of_rows_with_equal_ids(spark):
    """Every row by itself, whatever rows share its id; one row of each group stays."""
    rng = random.Random(99)
    texts = invented(rng, 12)
    for base in range(5):
        words = [f"b{base}x{i}" for i in range(50)]
        for _ in range(6):
            copy = [*words]
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(50)] = f"e{rng.randrange(20)}"
            texts.append(" ".join(copy))
    texts += [texts[20], texts[20], "", None]
    rows = [(rng.choice([None, *range(9)]), t) for t in texts]
    rows += rows[5:9]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, labels = linked([t for _, t in rows], 3, 70, 100)
    groups = defaultdict(list)
    for (d, t), s, g in zip(rows, sets, labels, strict=True):
        groups[g if s else (d, t)].append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    wanted = [(d, len(s), least[g if s else (d, t)]) for (d, t), s, g in zip(rows, sets, labels, strict=True)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, 3, 70, 100).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    kept = jaccard_join.keep_one(docs, 3, 70, 100).collect()
    of = {(d, t): g if s else (d, t) for (d, t), s, g in zip(rows, sets, labels, strict=True)}
    assert sorted((str(of[r.doc_id, r.text]), str(r.doc_id)) for r in kept) == sorted((str(g), str(d)) for g, d in least.items())


def test_join_of_a_large_group(spark):
    rng = random.Random(9)
    words, texts = [f"x{i}" for i in range(120)], []
    for _ in range(250):
        copy = [*words]
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(120)] = f"e{rng.randrange(30)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs_of(spark, texts), 3, 90, 100).collect()}
    assert [got[i] for i in range(250)] == linked(texts, 3, 90, 100)[1]


def test_sketches_bound_intersections():
    rng = np.random.default_rng(9)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 4000, rng.integers(1, 900), dtype=np.uint64)) for _ in range(2))
        assert jaccard_join.most_common(jaccard_join.sketch_of(a), jaccard_join.sketch_of(b)) >= len(np.intersect1d(a, b))


# 10


@pytest.mark.parametrize("window", [3, 13])
def test_decontamination(spark, window):
    rng = random.Random(10)
    items = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 30)))) for i in range(12)] + [(20, "w1, W2!"), (21, None), (22, "")]
    texts = invented(rng, 60, 12) + [f"{t} {items[i][1]} tail" for i, t in enumerate(invented(rng, 8))] + [None, "", "!?"]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    windows = defaultdict(set)
    for n, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(n))
    for blocks in (10**6, 20):
        got = {r.doc_id: r for r in decontaminate.find_hits(docs_of(spark, texts), bench, window, blocks).collect()}
        for i, t in enumerate(texts):
            w = words(t)
            hit, met = set(), set()
            for g, names in windows.items():
                for at in range(len(w) - len(g) + 1):
                    if tuple(w[at : at + len(g)]) == g:
                        hit |= set(range(at, at + len(g)))
                        met |= names
            assert (got[i].n_words, got[i].n_hit, got[i].items) == (len(w), len(hit), sorted(met))
            assert {x for s in got[i].spans for x in range(s.start, s.end)} == hit


def test_cutting_spans(spark):
    passage = " ".join(f"q{i}" for i in range(14))
    docs = docs_of(spark, [f"Keep, this! {passage.upper()}... and that.", "clean Text"])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, cut=True).collect()}
    assert got[0].text == "Keep, this! ... and that." and got[0].n_chars == len(got[0].text) and got[1].text == "clean Text"
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [1]


def test_tables_are_dropped(spark):
    t = shared.table(spark.range(3).toDF("x"), "probe")
    assert t.count() == 3
    shared.drop_tables(spark)
    with pytest.raises(Exception, match=r"(?i)not.?(found|exist)|no such file"):
        t.count()
