"""What a query asks for: laws, paragraphs, domain, mode, keywords, expansions.

The signal lists are small dimension tables.  A query batch meets them by array
expressions over literal lists, so understanding adds columns and moves no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions import text as T

#: Names of laws and what they cite.
LAW_ALIASES = (
    ("zakonik prace", "262", "2006"),
    ("obcansky zakonik", "89", "2012"),
    ("trestni zakonik", "40", "2009"),
    ("trestni rad", "141", "1961"),
    ("obcansky soudni rad", "99", "1963"),
    ("spravni rad", "500", "2004"),
    ("ustava ceske republiky", "1", "1993"),
    ("zakon o danich z prijmu", "586", "1992"),
    ("zakon o obchodnich korporacich", "90", "2012"),
    ("zakon o zvlastnich rizenich soudnich", "292", "2013"),
)
#: The domain of a law.
LAW_DOMAINS = {
    "local:sb/2006/262": "employment",
    "local:sb/2012/89": "civil",
    "local:sb/1963/99": "civil",
    "local:sb/2013/292": "civil",
    "local:sb/2009/40": "criminal",
    "local:sb/1961/141": "criminal",
    "local:sb/1992/586": "tax",
    "local:sb/2004/500": "administrative",
    "local:sb/1993/1": "constitutional",
    "local:sb/2012/90": "corporate",
}
#: Phrases that point to a domain, with weights.
PHRASES = {
    "employment": {"pracovni pomer": 4.0, "vypoved z pracovniho pomeru": 6.0, "okamzite zruseni": 4.0, "zakonik prace": 5.0},
    "civil": {"obcansky zakonik": 5.0, "najemni smlouva": 4.0, "kupni smlouva": 4.0, "nahrada skody": 4.0},
    "criminal": {"trestni zakonik": 5.0, "trestni rad": 5.0, "trestny cin": 4.0, "trestni stihani": 4.0},
    "tax": {"dan z prijmu": 5.0, "danove priznani": 4.0, "zakon o danich z prijmu": 5.0},
    "administrative": {"spravni rizeni": 4.0, "spravni rad": 5.0, "spravni organ": 3.0},
    "constitutional": {"ustava ceske republiky": 5.0, "ustavni poradek": 4.0, "zakladni prava": 4.0},
    "corporate": {"obchodni korporace": 5.0, "spolecnost s rucenim omezenym": 4.0, "akciova spolecnost": 4.0},
}
#: Word stems that point to a domain, with weights, in order.
STEMS = {
    "employment": {"prac": 2.5, "pomer": 2.0, "zamestnan": 3.0, "zamestnav": 3.0, "vypoved": 3.5, "odstupn": 2.5, "dovolen": 3.0, "mzda": 2.0, "zkusebn": 2.5},
    "civil": {"smlouv": 2.5, "najem": 2.5, "vlastnict": 2.5, "dedic": 2.0, "manzel": 2.0, "obcansk": 2.0, "zavaz": 3.0},
    "criminal": {"trestn": 3.0, "obvin": 2.5, "obzal": 2.5, "delikt": 2.0, "zkusebn": 1.0},
    "tax": {"dan": 2.0, "prijm": 2.5, "financn": 1.5},
    "administrative": {"spravn": 3.0, "rizen": 1.5, "urad": 1.5},
    "constitutional": {"ustav": 3.0, "zakladn": 1.5, "prav": 1.0},
    "corporate": {"korporac": 3.0, "spolecnost": 2.0, "jednatel": 1.5, "valna": 1.5},
}
DOMAINS = tuple(PHRASES)
#: Stems of words that are no keywords.
STOP_STEMS = ("zakon", "ustanov", "odstav", "pism", "podle", "nebo", "ktery", "ktera", "ktere", "cesk", "republik")
#: What a topic adds to the query's sparse side.  Triggers are folded.
EXPANSIONS = (
    ("vypoved z pracovniho pomeru", "výpověď § 50 § 52 § 53 § 54 § 55"),
    ("okamzite zruseni", "okamžité zrušení § 55 § 56 § 57"),
    ("skonceni pracovniho pomeru", "skončení pracovního poměru § 48 § 49 § 50"),
    ("pracovni pomer na dobu urcitou", "pracovní poměr § 39 § 65"),
    ("zkusebni doba", "zkušební doba § 35"),
    ("vypoved zakonik", "výpověď § 50 § 52 § 53"),
    ("vypoved zamestnanec", "výpověď zaměstnanec § 50 § 52"),
    ("vypoved zamestnavatel", "výpověď zaměstnavatel § 52"),
    ("vypoved", "výpověď § 50 § 52 § 53"),
    ("odstupne podmink", "odstupné § 67 § 68 § 73a podmínky"),
    ("odstupne zamestnanec", "odstupné § 67 § 68"),
    ("odstupne", "odstupné § 67 § 68 § 73a"),
    ("dovolena delka", "dovolená délka § 213 § 215 § 216"),
    ("dovolena narok", "dovolená nárok § 211 § 212"),
    ("dovolena zakonik", "dovolená § 211 § 212 § 213 § 214 § 215"),
    ("dovolena", "dovolená § 211 § 212 § 213"),
    ("nemocenska", "nemocenská § 192 § 194 dočasná pracovní neschopnost"),
    ("prace pres cas", "přesčas § 93 § 114"),
    ("minimalni mzda", "minimální mzda § 111"),
    ("pracovni smlouva nalezitosti", "pracovní smlouva § 33 § 34 náležitosti"),
    ("pracovni smlouva", "pracovní smlouva § 33 § 34 § 36"),
    ("dohoda o pracovni cinnosti", "dohoda o pracovní činnosti § 76 § 77"),
    ("dohoda o provedeni prace", "dohoda o provedení práce § 75 § 77"),
    ("kupni smlouva obcansky", "kupní smlouva § 2079 § 2080 § 2085 § 2099"),
    ("kupni smlouva", "kupní smlouva § 2079 § 2080 § 2085"),
    ("najemni smlouva", "nájemní smlouva § 2201 § 2202 § 2203"),
    ("najem bytu", "nájem bytu § 2235 § 2236 § 2237"),
    ("nahrada skody obcansky", "náhrada škody § 2910 § 2913 § 2914 § 2952"),
    ("nahrada skody", "náhrada škody § 2910 § 2913 § 2914"),
    ("bezduvodne obohaceni", "bezdůvodné obohacení § 2991 § 2992 § 2993"),
    ("smlouva o dilo", "smlouva o dílo § 2586 § 2587 § 2591"),
    ("dedicke rizeni", "dědické řízení § 1475 § 1476 § 1670"),
    ("spolecne jmeni", "společné jmění manželů § 708 § 709 § 710"),
    ("vydrzeni", "vydržení § 1089 § 1090"),
    ("smluvni pokuta", "smluvní pokuta § 2048 § 2049 § 2050"),
    ("zapujcka", "zápůjčka § 2390 § 2391 § 2395"),
    ("vrazda trest", "vražda § 140 trest odnětí svobody"),
    ("vrazda", "vražda § 140 § 141"),
    ("kradez trest", "krádež § 205 trest"),
    ("kradez", "krádež § 205 § 206"),
    ("podvod trestni", "podvod § 209 § 210 trest"),
    ("trestni odpovednost", "trestní odpovědnost § 13 § 15 § 16"),
    ("podmineny trest", "podmíněné odsouzení § 81 § 82 § 83"),
    ("promlceni trestni", "promlčení § 34 § 35 trestní"),
    ("spolecnost s rucenim", "společnost s ručením omezeným § 132 § 133 § 148"),
    ("akciova spolecnost", "akciová společnost § 243 § 244 § 245"),
    ("dan z prijmu fyzickych", "daň z příjmů fyzických osob § 2 § 3 § 6"),
    ("dan z prijmu pravnickych", "daň z příjmů právnických osob § 17 § 18 § 21"),
    ("odpisy majetku", "odpisy § 26 § 27 § 28 § 29 § 30"),
)
#: Fixed value: below this a domain stays unknown; a law of the domain adds LAW_WEIGHT.
LEAST_DOMAIN, LAW_WEIGHT = 2.5, 5.0

#: Words that tell the type of a request.
STRATEGY_WORDS = "strategie strategy spor sporu sporni argument argumenty obrana obhajoba riziko risk claim позиция спор иск аргумент".split()
LAW_WORDS = "zakon zakonik ustanoveni obcansky codex law article section paragraf статья закон кодекс".split()
COURT_WORDS = "soud soudni rozsudek usneseni judikatura rozhodnuti court judgment decision case суд решение постановление".split()
CITATION_PATTERNS = (r"(?iU)§\s*\d+[a-zA-Z]*", r"(?iU)\b(?:cl\.|čl\.|article|art\.)\s*\d+[a-zA-Z]*")
CASE_PATTERN = r"(?iU)\bsp\.\s*zn\.|\bč\.\s*j\.|\bcase\s+no\.?\b|\b\d+\s*[a-z]{1,4}\s*\d+/\d{2,4}\b"

CITED_LAW = r"(?iU)(?:z[aá]kon(?:a|u|em|ě)?(?:\s+č\.?)?\s+)?(\d{1,4})\s*/\s*(\d{4})(?:\s+Sb\.?)?"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def law_refs(raw: Column, folded: Column) -> Column:
    """Iris of the laws a query cites by number, then by name."""
    alias = F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(name)), F.lit(f"local:sb/{year}/{number}")) for name, number, year in LAW_ALIASES]))
    return F.array_distinct(F.concat(T.citations(raw), alias))


def cleaned(raw: Column) -> Column:
    """Without citations and paragraphs; the query itself if nothing is left."""
    text = T.collapse(F.regexp_replace(F.regexp_replace(raw, CITED_LAW, " "), r"§+\s*[0-9]+[a-zA-Z]?", " "))
    return F.when(text != "", text).otherwise(T.collapse(raw))


def keywords(c: Column) -> Column:
    stops = "^(?:" + "|".join(STOP_STEMS) + ")"
    return F.array_distinct(F.filter(T.tokens(c), lambda t: ~t.rlike(stops) & (F.length(t) >= 3)))


def domain_score(domain: str, folded: Column, words: Column, laws: Column) -> Column:
    """Phrases contained, the first matching stem of every keyword, and laws cited."""
    phrase = sum((F.when(F.contains(folded, F.lit(p)), w).otherwise(0.0) for p, w in PHRASES[domain].items()), F.lit(0.0))

    def stem(t: Column) -> Column:
        found = None
        for s, w in STEMS[domain].items():
            hit = F.startswith(t, F.lit(s)) | F.startswith(F.lit(s), t)
            found = F.when(hit, w) if found is None else found.when(hit, w)
        return found.otherwise(0.0)

    stems = F.aggregate(F.transform(words, stem), F.lit(0.0), lambda a, b: a + b)
    of = [iri for iri, d in LAW_DOMAINS.items() if d == domain]
    return phrase + stems + F.size(F.array_intersect(laws, _strings(of))) * LAW_WEIGHT


def mode(laws: Column, paragraphs: Column, domain: Column) -> Column:
    return F.when((F.size(laws) > 0) & (F.size(paragraphs) > 0), "exact_lookup").when(F.size(laws) > 0, "law_constrained_search").when(domain != "unknown", "domain_search").otherwise("broad_search")


def expansion(folded: Column, clean: Column) -> Column:
    """The cleaned query with the words of the longest trigger it contains, or null."""
    found = None
    for trigger, words in sorted(EXPANSIONS, key=lambda x: -len(x[0])):
        hit = F.contains(folded, F.lit(trigger))
        found = F.when(hit, F.lit(words)) if found is None else found.when(hit, F.lit(words))
    return F.trim(F.concat(clean, F.lit(" "), found))


def understand(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, query) with laws, paragraphs, clean, keywords, domain,
    domain_confidence, mode and expanded."""
    rows = queries.withColumn("_folded", T.normalize(F.col("query")))
    rows = rows.withColumns({"laws": law_refs(F.col("query"), F.col("_folded")), "paragraphs": T.paragraphs(F.col("query")), "clean": cleaned(F.col("query"))})
    rows = rows.withColumn("keywords", keywords(F.col("clean")))
    # best first; the fixed order of domains settles ties
    scored = F.array(*[F.struct((-domain_score(d, F.col("_folded"), F.col("keywords"), F.col("laws"))).alias("minus"), F.lit(i).alias("i"), F.lit(d).alias("domain")) for i, d in enumerate(DOMAINS)])
    rows = rows.withColumn("_ranked", F.array_sort(scored))
    best, second = -F.col("_ranked")[0]["minus"], -F.col("_ranked")[1]["minus"]
    known = best >= LEAST_DOMAIN
    rows = rows.withColumns(
        {
            "domain": F.when(known, F.col("_ranked")[0]["domain"]).otherwise("unknown"),
            "domain_confidence": F.when(known, best / F.greatest(best + second, F.lit(1.0))).otherwise(0.0),
            "expanded": expansion(F.col("_folded"), F.col("clean")),
        }
    )
    return rows.withColumn("mode", mode(F.col("laws"), F.col("paragraphs"), F.col("domain"))).drop("_folded", "_ranked")


def query_type(normalized: Column, terms: Column) -> Column:
    """strategy, exact_statute, case_lookup or semantic_law."""
    cites = normalized.rlike(CITATION_PATTERNS[0]) | normalized.rlike(CITATION_PATTERNS[1])
    return (
        F.when(F.arrays_overlap(terms, _strings(STRATEGY_WORDS)), "strategy")
        .when(cites, "exact_statute")
        .when(normalized.rlike(CASE_PATTERN) | F.arrays_overlap(terms, _strings(COURT_WORDS)), "case_lookup")
        .otherwise("semantic_law")
    )


def request_domain(normalized: Column, terms: Column, kind: Column) -> Column:
    law = normalized.rlike(CITATION_PATTERNS[0]) | normalized.rlike(CITATION_PATTERNS[1]) | F.arrays_overlap(terms, _strings(LAW_WORDS))
    court = normalized.rlike(CASE_PATTERN) | F.arrays_overlap(terms, _strings(COURT_WORDS))
    return F.when(kind == "strategy", F.lit(None).cast("string")).when(law & ~court, "law").when(court & ~law, "courts").when(kind == "case_lookup", "courts").otherwise("law")


def query_context(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, query, country) with normalized, query_hash, terms,
    query_type, request_domain, jurisdiction and citation_patterns."""
    rows = queries.withColumn("normalized", T.query_normalize(F.col("query")))
    rows = rows.withColumns({"query_hash": F.sha2(F.col("normalized").cast("binary"), 256), "terms": T.words(T.fold(F.col("normalized")), 2)})
    rows = rows.withColumn("query_type", query_type(F.col("normalized"), F.col("terms")))
    found = F.concat(*[F.regexp_extract_all("normalized", F.lit(p), F.lit(0)) for p in CITATION_PATTERNS])
    return rows.withColumns({"request_domain": request_domain(F.col("normalized"), F.col("terms"), F.col("query_type")), "jurisdiction": T.script_country(F.col("query"), F.col("country")), "citation_patterns": found})
