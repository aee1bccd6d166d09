"""Operators against plain Python and the known results of their definitions."""

import hashlib
import json
import math
import random
import unicodedata
import uuid
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rillmark.functions import hashing, vectors
from rillmark.functions import text as T
from rillmark.operators import answers, cache, dense, fusion, ingest, lexical, planning, ranking, understanding
from rillmark.plans import search
from rillmark.sources import html_pages, statutes
from rillmark.streaming import ingestion


def values(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


# Text ----------------------------------------------------------------------


def test_fold_drops_diacritics(spark):
    texts = ["Žluťoučký KŮŇ", "Ünïcode É", "plain", "áb", "Łódź", "straße"]
    plain = ["".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)) for t in texts]
    assert values(spark, T.fold, *texts) == plain
    assert values(spark, T.normalize, "  Více\t\nmezer ") == ["vice mezer"]


def test_tokens(spark):
    assert values(spark, T.tokens, "Zákon č. 89/2012") == [["zakon", "c", "89", "2012"]]
    assert values(spark, T.bm25_tokens, "a bc 1234567 x1y2") == [["bc", "123456", "7", "1", "2"]]
    assert values(spark, lambda c: T.words(c, 2), "Zaměstnanec má dům_1") == [["Zaměstnanec", "dům_1"]]


def test_citations_and_paragraphs(spark):
    assert values(spark, T.paragraphs, "§ 73a a §§52, § 73a") == [["73a", "52"]]
    assert values(spark, T.citations, "zákon č. 262 / 2006 Sb. a 89/2012") == [["local:sb/2006/262", "local:sb/2012/89"]]
    assert values(spark, T.iri_of_citation, "40/2009 Sb.", "Ústava ČR") == ["local:sb/2009/40", "local:sb/_stava__R"]
    assert values(spark, T.iri_to_filename, "local:sb/2009/40", "other") == ["40/2009 Sb.", "other"]
    assert values(spark, T.parse_query, " PARAGRAF 52  zák. 262 / 2006") == ["§ 52 zák. 262/2006"]
    assert values(spark, T.is_bare_paragraph, "§ 52a", "§ 52 x") == [True, False]
    assert values(spark, T.fragment_number, "local:sb/2006/262/77", "x") == [77, None]
    got = spark.range(1).select(T.payload_paragraphs(F.lit("5"), F.lit("podle § 6 a § 5"), F.lit("a/par_7b/8"))).first()[0]
    assert got == ["5", "6", "7b"]


def test_penalties(spark):
    lines = ["1. zákon č. 65/1965 Sb., zákoník práce", "21. Část první zákona č. 367/2000 Sb.", "HLAVA II", "DOVOLENÁ", "Zaměstnavatel je povinen vyplatit mzdu.", "§ 52 odst. 2 a § 54", "", "zákon č. 5/1999 Sb. platí"]
    got = [round(x, 6) for x in values(spark, T.structural_penalty, *lines)]
    assert got == [0.55, 0.55, 0.85, 0.5, 0.0, 0.25, 0.0, 0.35]
    assert [round(x, 6) for x in values(spark, T.cross_encoder_penalty, "HLAVA II", "DOVOLENÁ", "§ 52 odst. 2 a § 54")] == [0.9, 0.55, 0.0]
    assert values(spark, T.is_substantive, "HLAVA II " + "x" * 40, "ruší-li se zaměstnavatel nebo jeho část", "krátké", "1. zákon č. 65/1965 Sb., zákoník práce", "slova bez slovesa a bez čísel v této větě") == [False, True, False, False, False]


def test_pieces(spark):
    assert values(spark, lambda c: T.preview(c, 10), "abc  def ghi jkl", "short") == ["abc def...", "short"]
    assert values(spark, T.facts, "A. B; C\nD", "  ") == [["A", "B", "C", "D"], [""]]
    assert values(spark, T.sentences, "Short. " + "x" * 30 + "! Tail.") == [["x" * 30 + "!"]]
    assert values(spark, T.cut, "a" * 700) == ["a" * 600 + " …"]


# Hashes and vectors --------------------------------------------------------


def test_hashes(spark):
    words = ["zakon", "příliš", ""]
    assert values(spark, hashing.token_index, *words) == [int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") for w in words]
    names = [f"local:sb/2012/89/{i}:0" for i in range(40)]
    assert values(spark, hashing.uuid5, *names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    key = spark.range(1).select(hashing.canonical_key(b=F.lit(1), a=F.lit("x"), n=F.lit(None).cast("string"))).first()[0]
    assert key == hashlib.sha256(json.dumps({"a": "x", "b": 1, "n": None}, separators=(",", ":")).encode()).hexdigest()


def embed(text, dim):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.strip().lower()) if not unicodedata.combining(c))
    import re

    v = [0.0] * dim
    for t in re.findall(r"\w+", plain) or [plain or "__empty__"]:
        h = hashlib.sha256(t.encode()).digest()
        v[int.from_bytes(h[:4], "big") % dim] += (1 if h[4] % 2 == 0 else -1) * (1 + h[5] / 255)
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def test_hash_embedding(spark):
    texts = ["Zákon o dani a dani", "zakon o dani a dani", "", "!!", "jiný text"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    got = {r.chunk_id: r.embedding for r in dense.dense_vectors(rows, 48).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(embed(t, 48))
    assert got[0] == pytest.approx(got[1])


def test_nearest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 3)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], i % 3) for i in range(60)] + [(60, [0.0] * 8, 0)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, g int")
    asked = df.filter("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in dense.nearest(df, asked, 4, "g").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 5) if n else 0.0

    for q, e, g in rows:
        if q % 7 == 0:
            assert got[q] == [i for i, v, h in sorted((r for r in rows if r[2] == g), key=lambda r: (-cosine(e, r[1]), r[0]))][:4]
    assert spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] == 0


# Lexical and fusion --------------------------------------------------------


def test_bm25(spark):
    texts = ["alpha beta beta", "alpha gamma", "delta", "", "beta"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "beta alpha beta"), (2, "unseen"), (3, "")], "query_id long, text string")
    docs = [t.split() for t in texts]
    n, avg = 4, sum(map(len, docs)) / 4
    df = Counter(t for d in docs for t in set(d))

    def idf(t):
        return math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) if df[t] >= 2 else math.log((n + 0.5) / 1.5 + 1)

    def score(d):
        tf = Counter(d)
        return sum(idf(t) ** 2 * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in {"beta", "alpha"} if tf[t])

    got = {(r.query_id, r.chunk_id): r.score for r in lexical.search(rows, asked, 10).collect()}
    assert got == pytest.approx({(1, i): score(d) for i, d in enumerate(docs) if score(d)}, abs=1e-5)
    assert lexical.search(rows, asked, 1).count() == 1


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, c, i + 1, 1.0 / (i + 1)) for i, c in enumerate((5, 6, 7))], "query_id int, chunk_id int, rank int, score double")
    b = spark.createDataFrame([(1, c, i + 1, 1.0 / (i + 1)) for i, c in enumerate((7, 8))], "query_id int, chunk_id int, rank int, score double")
    one = {r.chunk_id: r.rrf_score for r in fusion.rrf(a, b).collect()}
    assert one == {r.chunk_id: r.rrf_score for r in fusion.rrf(b, a).collect()}
    assert one[7] == pytest.approx(1 / 63 + 1 / 61, abs=1e-9) and fusion.rrf(a, b).filter("rank = 1").first().chunk_id == 7


def test_lexical_match_outranks_denser(spark):
    """The golden case: a matching hit of .55 beats an unrelated one of .92."""
    rows = [(1, 1, 1, 0.92, "kupní smlouva", "jiny.txt", "zdroj", "Nesouvisející obsah o počasí."), (1, 2, 2, 0.55, "kupní smlouva", "obcansky.txt", "zdroj", "Kupní smlouva podle § 2079 zavazuje prodávajícího.")]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, score double, query string, filename string, source string, text string")
    got = fusion.generic_fused(df).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1] and got[0].phrase_match and got[0].overlap_ratio == 1.0
    f = fusion.features(fusion.generic_fused(df), 2).first()
    assert f.top_dense_score == 0.92 and f.supporting_chunks == 1 and f.score_gap > 0


def test_keyed_merge_takes_first_values(spark):
    rows = [(1, 1, 2, 0.5, 0.0, False, "late"), (1, 1, 1, 0.1, 0.7, True, ""), (1, 2, 3, 0.2, 0.0, None, None)]
    got = {r.chunk_id: r for r in fusion.keyed_merge(spark.createDataFrame(rows, "query_id int, chunk_id int, source_order int, dense_score double, sparse_score double, exact_match boolean, note string"), ("note",)).collect()}
    assert (got[1].dense_score, got[1].sparse_score, got[1].exact_match, got[1].note) == (0.5, 0.7, True, "late") and got[2].note is None and got[2].exact_match is False


# Understanding and plans ---------------------------------------------------

ASKED = [
    ("§ 52 zákoník práce", "exact_lookup", "employment"),
    ("výpověď podle zákona č. 262/2006 Sb.", "law_constrained_search", "employment"),
    ("daň z příjmů fyzických osob", "domain_search", "tax"),
    ("počasí zítra", "broad_search", "unknown"),
]


def test_modes_and_plans(spark):
    rows = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(ASKED)], "query_id int, query string")
    got = planning.build(understanding.understand(rows)).orderBy("query_id").collect()
    for r, (_, mode, domain) in zip(got, ASKED, strict=True):
        assert (r.mode, r.domain) == (mode, domain)
    assert got[0].paragraph_filter == ["52"] and got[0].law_filter == ["local:sb/2006/262"] and got[0].plan_mode == "exact" and got[0].candidate_k == 80
    assert got[1].plan == "topic" and got[1].window == 2 and got[1].candidate_k == 100
    assert got[2].preferred_laws == ["local:sb/1992/586"] and "daň z příjmů fyzických osob § 2 § 3 § 6" in got[2].expanded
    assert got[3].law_filter == [] and got[3].expanded is None
    wide = planning.broaden(planning.build(understanding.understand(rows))).orderBy("query_id").collect()
    assert [r.plan_mode for r in wide][:2] == ["constrained", "constrained"] and wide[0].candidate_k == 90 and wide[3].plan_mode == "broad" and wide[3].exact_boost == 0.42
    forced = planning.build(understanding.understand(rows).withColumns({"forced_paragraph": F.lit(7), "forced_law": F.lit("x")})).filter("query_id = 3").first()
    assert forced.plan_mode == "exact" and forced.paragraph_filter == ["7"] and forced.law_filter == ["x"]


def test_query_types(spark):
    rows = [(1, "§ 52 zákoník práce"), (2, "jaká je strategie sporu"), (3, "rozsudek soudu sp. zn. 21 Cdo 1/2010"), (4, "co je nájem"), (5, "статья 15 кодекс")]
    got = {r.query_id: r for r in understanding.query_context(spark.createDataFrame(rows, "query_id int, query string").withColumn("country", F.lit(None).cast("string"))).collect()}
    assert [got[i].query_type for i in (1, 2, 3, 4)] == ["exact_statute", "strategy", "case_lookup", "semantic_law"]
    assert [got[i].request_domain for i in (1, 2, 3, 4)] == ["law", None, "courts", "law"]
    assert got[5].jurisdiction == "russia" and got[4].jurisdiction == "czechia"
    assert got[4].query_hash == hashlib.sha256("co je nájem".encode()).hexdigest() and got[1].citation_patterns == ["§ 52"]


# Ranking -------------------------------------------------------------------


def test_diversify_drops_after_the_last_primary(spark):
    rows = [(1, i, i + 1, g) for i, g in enumerate("aaabbbcd")]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, g string")
    assert [r.chunk_id for r in ranking.diversify(df, 4, F.col("g")).orderBy("rank").collect()] == [0, 1, 3, 4]
    assert [r.chunk_id for r in ranking.diversify(df, 7, F.col("g")).orderBy("rank").collect()] == [0, 1, 3, 4, 6, 7, 2]


def test_cross_encoder_reorders_the_head_or_fails_open(spark):
    df = spark.createDataFrame([(1, i, i + 1, "Text je dlouhý.", s) for i, s in enumerate((0.1, 0.9, 0.5, 0.95))], "query_id int, chunk_id int, rank int, text string, s double")
    assert [r.chunk_id for r in ranking.cross_encoder_order(df, F.col("s"), 3).orderBy("rank").collect()] == [1, 2, 0, 3]
    broken = F.when(F.col("chunk_id") != 1, F.col("s"))
    assert [r.chunk_id for r in ranking.cross_encoder_order(df, broken, 3).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_neighbors_first_anchor_wins(spark):
    chunks = spark.createDataFrame([(f, i, f * 10 + i) for f in (1, 2) for i in range(4)], "fragment_id int, chunk_index int, chunk_id int")
    anchored = chunks.filter("chunk_id in (11, 12)").withColumns({"query_id": F.lit(1), "ordinal": F.col("chunk_id")})
    got = {r.chunk_id: r.anchor_id for r in ranking.neighbors(anchored, chunks).collect()}
    assert got == {10: 11, 12: 11, 11: 12, 13: 12}
    assert ranking.neighbors(anchored, chunks, 1, 2).count() == 2


def test_score_filter_and_best_per_chunk(spark):
    df = spark.createDataFrame([(1, 1, 0.95, 1, None, 0), (1, 2, 0.1, 2, ["no_result"], 0), (1, 3, 0.1, 3, ["x"], 0), (1, 3, 0.4, 4, ["x"], 0)], "query_id int, chunk_id int, score double, rank int, tags array<string>, chunk_index int")
    assert sorted(r.chunk_id for r in ranking.score_filter(df).collect()) == [1, 2]
    assert [(r.chunk_id, r.score) for r in ranking.best_per_chunk(df).orderBy("rank").collect()] == [(1, 0.95), (3, 0.4), (2, 0.1)]


# Answers -------------------------------------------------------------------


def test_gate_golden_rows(spark):
    rows = [("exact_statute", 0.9, 0.08, 0.66, False, True, 1), ("semantic_law", 0.6, 0.01, 0.42, False, False, 0), ("strategy", None, None, None, None, None, None), ("semantic_law", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "query_type string, top_fused_score double, score_gap double, keyword_coverage double, phrase_match boolean, citation_match boolean, supporting_chunks long")
    got = [(r.level, r.use_llm, r.response_type, r.reason_codes) for r in answers.gate(df).collect()]
    assert got[0] == ("high", False, "citation_answer", ["citation_match", "keyword_coverage", "score_gap"])
    assert got[1] == ("medium", True, "semantic_explanation", ["semantic_needs_llm"])
    assert got[2] == ("medium", True, "strategy_answer", ["strategy_requires_llm"])
    assert got[3] == ("low", True, "semantic_explanation", ["no_results"])


def test_prompt_and_strategy(spark):
    p = spark.range(1).select(answers.prompt(F.lit("co?"), F.lit("czechia"), F.lit(None).cast("string"), F.array(F.struct(F.lit("f").alias("filename"), F.lit(1.5).alias("score"), F.lit("t").alias("text"))))).first()[0]
    assert p.startswith("DOTAZ: co?\nJURISDIKCE: czechia  |  DOMÉNA: law\n\nZDROJE (1):\n[1] f  (score: 1.500)\n    \"t\"") and "zdrojů [1]–[1] odpověz" in p
    df = spark.createDataFrame([(1, 12, ["a"], [], False, False, ["h1", "h2", "h3"])], "n_laws int, n_courts int, law_points array<string>, court_points array<string>, has_case boolean, has_documents boolean, hints array<string>")
    r = answers.strategy(df).first()
    assert r.summary == "a" and r.recommended_actions == [answers.ALIGN % "the applicable statutes", answers.ADD_COURTS]
    assert r.confidence == 0.95 and len(r.risks) == 1 and len(r.arguments_against) == 2 and r.missing_documents[:2] == ["h1", "h2"] and r.arguments_for == ["Build the primary line of argument on: a"]


# Ingestion and sources -----------------------------------------------------


def test_splitter():
    rng = random.Random(5)
    text = "".join(rng.choice(["slovo ", "věta. ", "\n", "\n\n", "; "]) for _ in range(900))
    parts = ingest.split_text(text, 200, 40, ingest.LEGAL_SEPARATORS)
    assert all(0 < len(p) <= 200 for p in parts)
    words = set(text.split())
    assert all(set(p.split()) <= words for p in parts) and set(" ".join(parts).split()) == words
    assert len(ingest.split_text("jedna dvě tři čtyři pět šest sedm osm devět deset jedenáct", 20, 5, ingest.PLAIN_SEPARATORS)) >= 2
    assert ingest.split_text("x" * 50, 20, 5, ingest.PLAIN_SEPARATORS)[0] == "x" * 20


def test_chunks_keep_ids(spark):
    df = spark.createDataFrame([("f/1", " krátký "), ("f/2", "slovo " * 500), ("f/3", "")], "fragment_id string, text string")
    got = ingest.chunks(df).orderBy("fragment_id", "chunk_index").collect()
    assert got[0].text == "krátký" and got[0].chunk_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "f/1:0"))
    assert [r.chunk_index for r in got[1:]] == list(range(len(got) - 1)) and all(len(r.text) <= 1200 for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, ingest.chunks(df).collect()))


STATUTE = {
    "metadata": {"predpisCislo": "40/2009 Sb.", "rocnik": 2009, "castkaCislo": 11, "datumUcinnostiZneniOd": "2010-01-01"},
    "fragmenty": [
        {"fragmentId": "1", "typ": "Prefix", "xhtml": "pryč", "hloubka": 0},
        {"fragmentId": "2", "typ": "Paragraf", "xhtml": "<p>§ 7a</p>", "hloubka": 1},
        {"fragmentId": "3", "typ": "Odstavec_Dc", "xhtml": "<b>Text</b> &amp; více", "hloubka": 2},
        {"fragmentId": "4", "typ": "Paragraf", "xhtml": "bez čísla", "hloubka": 1},
        {"fragmentId": "5", "typ": "Odstavec_Dc", "xhtml": "", "hloubka": 1},
        {"fragmentId": "6", "typ": "Nadpis_nad", "xhtml": "nadpis § 9", "hloubka": 1},
        {"fragmentId": "7", "typ": "Odstavec_Dc", "xhtml": "dál", "hloubka": 1},
    ],
}


def test_statutes(spark, tmp_path):
    (tmp_path / "law.json").write_text(json.dumps(STATUTE))
    want = [("local:sb/2009/40/2", "7a"), ("local:sb/2009/40/3", "7a"), ("local:sb/2009/40/4", None), ("local:sb/2009/40/6", "9"), ("local:sb/2009/40/7", "9")]
    rows = statutes.fragments(statutes.collections(spark, str(tmp_path / "law.json"))).orderBy("pos").collect()
    assert [(r.fragment_id, r.paragraph) for r in rows] == want and rows[1].text == "Text &amp; více"
    with zipfile.ZipFile(tmp_path / "Sb_2009_40_2010_IZ.zip", "w") as z:
        z.writestr("a/readme.json", "{}")
        z.writestr("a/Sb_2009_40_IZ.json", json.dumps(STATUTE))
    files = statutes.archives(spark, str(tmp_path / "*.zip"))
    assert [(r.fragment_id, r.paragraph) for r in statutes.archive_fragments(files).orderBy("pos").collect()] == want
    assert statutes.archive_laws(files).first().law_iri == "local:sb/2009/40"


def test_documents_of_every_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.json").write_text('{"foo": "bar"}')
    (tmp_path / "c.json").write_text(json.dumps(STATUTE))
    (tmp_path / "d.xyz").write_text("?")
    (tmp_path / "e.zip").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w:document>")
    got = {r.path.rpartition("/")[2]: r for r in statutes.documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "plain" and json.loads(got["b.json"].text) == {"foo": "bar"} and "\n  " in got["b.json"].text
    assert got["c.json"].text.split("\n\n")[0].endswith("Legal collection item: 40/2009 Sb./2009 Sb.\nCollection issue number: 11\nEffective wording date: 2010-01-01")
    assert "[Odstavec_Dc | depth=2 | id=3]\nText & více" in got["c.json"].text
    assert got["d.xyz"].error and got["e.zip"].error and got["f.docx"].text == "One\nTwo"


def test_sections_skip_bad_lines(spark, tmp_path):
    (tmp_path / "terms.jsonl").write_text('{"id": "1", "name": "x]"}\nnot json {\n{"id": "2", "name": "{y"}\n')
    assert [r.id for r in statutes.section(spark, str(tmp_path / "terms.jsonl"), "terms").orderBy("id").collect()] == ["1", "2"]


def test_markup_lines():
    assert html_pages.lines_of("<div>a <b>b</b></div><p>c &amp; d<br>e</p>") == "a b\nc & d\ne"
    assert html_pages.lines_of(None) == html_pages.lines_of("  \n") == html_pages.lines_of("<!-- open <p>a") == ""
    assert html_pages.lines_of('<P title="1 > 0">a</P ><!-- <p>x</p> -->b\nc<hr/>1 < 2 &lt;p&gt;') == "a\nb\nc\n1 < 2 <p>"
    assert html_pages.lines_of("<b>a</b> <i>b</i>\n<i>c</i><script>if (x) '<p>'</script><style>y") == "abcif (x) '<p>'y"
    assert len(html_pages.lines_of("<a '<a \"" * 200_000)) > 0


def test_uploads(spark):
    files = spark.createDataFrame([("x/a b.txt", 3), ("x/b.exe", 3), ("x/c.pdf", 0)], "path string, length long")
    got = statutes.uploads(files, F.current_timestamp()).collect()
    assert [r.filename for r in got] == ["a_b.txt"] and uuid.UUID(got[0].id)


# Caches and streams --------------------------------------------------------


def test_semantic_cache_threshold(spark):
    e = spark.createDataFrame([("k1", [1.0, 0.2], "law", None), ("k2", [1.0, 0.0], "courts", None)], "cache_key string, embedding array<double>, domain string, prompt_version string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "law", None)], "query_id int, embedding array<double>, domain string, prompt_version string")
    assert cache.semantic_lookup(q, e).first().entry_key == "k1"
    assert cache.semantic_lookup(q, e, 0.99).count() == 0


def test_semantic_cache_against_all_pairs(spark):
    import itertools
    import random

    import numpy as np

    rng = random.Random(5)
    vector = lambda: rng.choice([None, [], [0.0, 0.0], [1.0], *[[rng.choice([-1.0, 0.5, 1.0]), rng.choice([0.0, 1.0])] for _ in range(8)]])
    entries = [(f"k{i % 50}" if i else None, vector(), rng.choice(["law", None, "x"]), rng.choice([1, None])) for i in range(70)]
    asked = [(i, vector(), rng.choice(["law", None, "x"]), rng.choice([1, None]), rng.choice([None, f"k{i}"])) for i in range(40)]
    e = spark.createDataFrame(entries, "cache_key string, embedding array<double>, domain string, prompt_version int").repartition(5)
    q = spark.createDataFrame(asked, "query_id int, embedding array<double>, domain string, prompt_version int, own string")
    best = {}
    for (i, a, *tags, own), (key, b, *held) in itertools.product(asked, entries):
        if key is None or key == own or tags != held or len(a or []) != len(b or []) or (a is None) != (b is None):
            continue
        size = np.linalg.norm(a or [0]) * np.linalg.norm(b or [0])
        alike = round(max(0.0, float(np.dot(a, b) / size)), 6) if size else 0.0
        if alike >= 0.5:
            best[i] = min(best.get(i, (9, "")), (-alike, key))
    found = cache.semantic_lookup(q, e, 0.5, but="own").collect()
    assert len(best) > 5 and {r.query_id: (-r.similarity, r.entry_key) for r in found} == best
    assert cache.semantic_lookup(q.limit(0), e).count() == 0 and cache.semantic_lookup(q, e.limit(0)).count() == 0


def test_exact_cache_expires(spark):
    e = spark.sql("SELECT 'k' cache_key, 'old' response_payload, timestamp'2024-01-01 00:00:00' created_at UNION ALL SELECT 'k', 'new', timestamp'2024-01-01 00:30:00'").withColumn("expires_at", cache.expires_at(F.col("created_at"), cache.EXACT_TTL))
    q = spark.createDataFrame([(1, "k")], "query_id int, cache_key string")
    assert cache.exact_lookup(q, e, F.lit("2024-01-01 01:10:00").cast("timestamp")).first().response_payload == "new"
    assert cache.exact_lookup(q, e, F.lit("2024-01-01 02:00:00").cast("timestamp")).count() == 0


def test_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "chunk_id int, t string")
    assert cache.write_version(spark, rows, str(tmp_path), "docs") == "docs__v1"
    assert cache.reindex(spark, rows.filter("chunk_id = 2"), str(tmp_path), "docs") == "docs__v2"
    assert spark.table("docs").count() == 1 and spark.read.parquet(f"{tmp_path}/docs__v1").count() == 2
    profile = spark.createDataFrame([("a", "b", "hash", "hash", 64, 64, "r", "r"), ("a", "b", "hash", "model", 64, 64, "r", "r"), ("a", "a", "x", "y", 1, 2, "r", "s")], "fingerprint string, wanted_fingerprint string, provider string, wanted_provider string, dimension int, wanted_dimension int, revision string, wanted_revision string")
    assert [r[0] for r in profile.select(cache.usable(profile)).collect()] == [True, False, True]


def test_collections_are_made_checked_and_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "chunk_id int, t string")
    assert cache.ensure(spark, str(tmp_path), "laws", rows.schema) == "laws__v1"
    assert spark.read.parquet(f"{tmp_path}/laws__v1").count() == 0
    assert cache.reindex(spark, rows, str(tmp_path), "laws", keep=False) == "laws__v2"
    assert [r.collection for r in cache.collections(spark, str(tmp_path)).collect()] == ["laws__v2"]
    assert cache.ensure(spark, str(tmp_path), "laws", rows.schema) == "laws__v2"
    with pytest.raises(ValueError, match="other columns"):
        cache.ensure(spark, str(tmp_path), "laws", rows.drop("t").schema)


def test_cache_patterns(spark):
    e = spark.createDataFrame([(k,) for k in ("a:1", "a:12", "b:1", "a.1", None)], "cache_key string")
    left = lambda p: sorted(r.cache_key or "" for r in cache.without(e, p).collect())
    assert left("a:*") == ["", "a.1", "b:1"]
    assert left("?:1") == ["", "a.1", "a:12"]
    assert left("a.1") == ["", "a:1", "a:12", "b:1"]
    assert left("*") == [""]


def test_requests_are_in_compatibility_form(spark):
    df = spark.createDataFrame([("\ufb01ne  \u2460 Cafe\u0301 \uff21",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.query_normalize(F.col("t"))).collect()] == ["fine 1 caf\u00e9 a", None, ""]


def test_stream_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = spark.createDataFrame([(1, "a", "t")], "id long, g string, text string")
    schema.write.parquet(f"{src}/x")
    run = lambda: ingestion.upsert_into(ingestion.distinct_texts(ingestion.source(spark, src, "x", schema.schema), "g", "text"), out, state, "id").awaitTermination()
    run()
    spark.createDataFrame([(2, "a", "t "), (3, "a", "new")], schema.schema).write.mode("append").parquet(f"{src}/x")
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3]


def test_upsert_across_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, g string")
    first.write.parquet(f"{src}/x")
    run = lambda: ingestion.upsert_into(ingestion.source(spark, src, "x", first.schema), out, state, "id").awaitTermination()
    run()
    spark.createDataFrame([(2, "again"), (3, "c")], first.schema).write.mode("append").parquet(f"{src}/x")
    run()
    assert sorted((r.id, r.g) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "c")]


# Whole plans ---------------------------------------------------------------


def test_law_filter_comes_before_the_cut(spark):
    """150 better chunks of other laws do not push out those of the law asked for; without
    a filter, preferred laws have a leg of their own."""
    rows = [(i, "local:sb/2012/89", "nájem nájem nájem bytu") for i in range(150)] + [(1000 + i, "local:sb/2006/262", f"nájem a mnoho jiných slov o práci {i}") for i in range(3)]
    corpus = spark.createDataFrame(rows, "chunk_id long, law_iri string, text string")
    plans = spark.createDataFrame(
        [(1, "nájem bytu", ["local:sb/2006/262"], []), (2, "nájem bytu", [], ["local:sb/2006/262"]), (3, "nájem bytu", [], [])], "query_id long, clean string, law_filter array<string>, preferred_laws array<string>"
    ).withColumns({"expanded": F.lit(None).cast("string"), "candidate_k": F.lit(50)})
    found, asking = search.searchable(corpus, plans, 64), search.legs(plans)
    assert sorted((r.query_id, r.laws, r.k) for r in asking.collect()) == [(2, ["local:sb/2006/262"], 50), (4, [], 50), (5, ["local:sb/2006/262"], 25), (6, [], 50)]
    hits = search._one_of_legs(lexical.ranked(found.matches, asking.select("query_id", "text", "laws", "k"), "k", ("laws", "law_iri")))
    by = {q: {r.chunk_id for r in hits.filter(f"query_id = {q}").collect()} for q in (1, 2, 3)}
    assert by[1] == {1000, 1001, 1002} and by[2] == set(range(50)) | {1000, 1001, 1002} and by[3] == set(range(50))
    vectors = dense.dense_vectors(asking.select(F.col("query_id").alias("chunk_id"), F.col("clean").alias("text")), 64).withColumnRenamed("chunk_id", "query_id")
    near = dense.nearest(found.vectors, asking.select("query_id", "laws", "k").join(vectors, "query_id"), "k", within=("laws", "law_iri"))
    assert {r.chunk_id for r in near.filter("query_id = 2").collect()} == {1000, 1001, 1002} and near.filter("query_id = 6").count() == 50


def test_neighbors_by_plan(spark):
    chunks = spark.createDataFrame([(i, "f", i) for i in range(9)], "chunk_id long, fragment_id string, chunk_index int")
    anchored = spark.createDataFrame([(1, 4, 0, "f", 4, 2, 10), (2, 4, 0, "f", 4, 3, 4)], "query_id long, chunk_id long, ordinal int, fragment_id string, chunk_index int, reach int, most int")
    got = ranking.neighbors(anchored, chunks, F.col("reach"), F.col("most")).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got if r.query_id == 1] == [2, 3, 5, 6] and [r.chunk_id for r in got if r.query_id == 2] == [1, 2, 3, 5]


def test_exact_search_finds_the_paragraph(spark):
    laws = [(i, f"local:sb/2006/262/{i}", "local:sb/2006/262", str(50 + i // 3), t, i, "262/2006 Sb.") for i, t in enumerate(["§ 50", "Výpověď musí být písemná a doručená, jinak je neplatná podle zákona.", "Další text o výpovědi z pracovního poměru, který platí v roce 2020.", "§ 51", "Výpovědní doba činí 2 měsíce a začíná prvním dnem.", "jiné"])]
    laws += [(100 + i, f"local:sb/2012/89/{i}", "local:sb/2012/89", str(50 + i), f"Občanský zákoník odstavec {i} upravuje kupní smlouvu a nájem.", i, "89/2012 Sb.") for i in range(6)]
    corpus = spark.createDataFrame(laws, "chunk_id long, fragment_id string, law_iri string, paragraph string, text string, chunk_index int, filename string")
    asked = spark.createDataFrame([(1, "§ 51 zákoník práce"), (2, "kupní smlouva občanský zákoník"), (3, "xyzzy qwertz"), (4, "§ 52")], "query_id long, query string")
    got = {}
    for r in search.hybrid(corpus, asked, 3, 64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert got[1][0].law_iri == "local:sb/2006/262" and {r.chunk_id for r in got[1]} >= {"4"}
    assert {r.law_iri for r in got[2]} == {"local:sb/2012/89"}
    assert [r.chunk_id for r in got[3]] in (["irrelevant_query"], ["no_result"])
    assert [r.chunk_id for r in got[4]] == ["clarification:message", "clarification:suggestion:local:sb/2006/262:52", "clarification:suggestion:local:sb/2012/89:52"]


def test_answers_come_from_caches(spark):
    corpus = spark.createDataFrame([(1, "law", "f1", "s", "Nájem bytu upravuje občanský zákoník v § 2235. Další věta."), (2, "law", "f2", "s", "Daně.")], "chunk_id long, law_iri string, filename string, source string, text string")
    asked = spark.createDataFrame([(1, "nájem bytu"), (2, "jaká je strategie sporu")], "query_id long, query string")
    none = spark.createDataFrame([], "cache_key string, response_payload string, created_at timestamp, expires_at timestamp")
    semantic = spark.createDataFrame([], "cache_key string, response_payload string, created_at timestamp, expires_at timestamp, jurisdiction string, domain string, query_type string, embedding array<double>")
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    first = {r.query_id: r for r in search.answer_with_caches(corpus, asked, none, semantic, now, "c__v1", "f", dimension=64).collect()}
    assert {r.served_from for r in first.values()} == {"computed"} and "Nájem bytu" in json.loads(first[1].payload)["answer"] and not first[2].may_store
    exact = spark.createDataFrame([(first[1].cache_key, "kept")], "cache_key string, response_payload string").withColumns({"created_at": now, "expires_at": cache.expires_at(now, 3600)})
    again = {r.query_id: (r.served_from, r.payload) for r in search.answer_with_caches(corpus, asked, exact, semantic, now, "c__v1", "f", dimension=64).collect()}
    assert again[1] == ("exact", "kept") and again[2][0] == "computed"
    vector = dense.dense_vectors(asked.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), 64).filter("chunk_id = 1").first().embedding
    close = spark.createDataFrame([("k", "near", "czechia", "law", "semantic_law", vector)], "cache_key string, response_payload string, jurisdiction string, domain string, query_type string, embedding array<double>").withColumns({"created_at": now, "expires_at": F.lit(None).cast("timestamp")})
    got = {r.query_id: (r.served_from, r.payload) for r in search.answer_with_caches(corpus, asked, none, close, now, "c__v1", "f", dimension=64).collect()}
    assert got[1] == ("semantic", "near") and got[2][0] == "computed"


def test_strategy_chain(spark):
    rows = spark.createDataFrame([(1, "law", "f1", "s", "Nájem bytu upravuje občanský zákoník v paragrafu 2235. Krátká."), (2, "law", "f2", "s", "Daně a poplatky se platí podle jiného zákona o daních.")], "chunk_id long, law_iri string, filename string, source string, text string")
    asked = spark.createDataFrame([(1, "nájem bytu. spor", None, [])], "query_id long, query string, case_id string, document_ids array<string>")
    r = search.strategy(rows, rows.limit(0), asked, ("smlouva",), dimension=64).first()
    assert r.facts == ["nájem bytu", "spor"] and r.n_laws == 2 and r.n_courts == 0 and r.confidence == 0.41
    assert r.law_points[0].startswith("Nájem bytu") and r.court_points == [] and r.missing_documents[0] == "smlouva" and len(r.risks) == 1


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
