"""The classifier of quality, the divergence audit and the repair of conversations against
plain Python and brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.llm import chat_repair, divergence, quality, toxicity

DATA = "/root/testdata/sf0.001"

# 8


def test_toxic_labels_without_their_texts(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, "more")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (8, 1), (9, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.prior <= 0.01 and toxicity.keep_clean(docs, model).count() == 2


# 11


def plain_or_junk(rng, n):
    """Sentences, and texts of capitals, symbols or one word."""
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 60))]
        kind = i % 10
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [words[0]] * len(words)
        elif kind == 2:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words) + ".", int(kind > 2)))
    return rows


def test_quality_of_held_out_texts(spark):
    rows = plain_or_junk(random.Random(3), 3_000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    # half of the good texts are known to be good; nothing is known of the others
    labels = spark.createDataFrame([(i, 1) for i, _, y in rows if y and i % 2], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert abs(model.prior - 0.7) < 0.05
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    good, bad = np.array([got[i] for i, _, y in rows if y]), np.array([got[i] for i, _, y in rows if not y])
    assert (good[:, None] > bad).mean() > 0.995
    assert (good >= quality.THRESHOLD).mean() > 0.99 and (bad >= quality.THRESHOLD).mean() < 0.05


def test_negative_risk_steps_back():
    """Where unlabelled texts lose less as negatives than the prior allows, the fit steps
    back instead of driving the loss below zero."""
    rng = np.random.default_rng(5)
    good, web = rng.integers(0, 50, (30, 3)) + np.array([0, 50, 100]), rng.integers(0, 50, (30, 3)) + np.array([0, 50, 100])
    w, b = quality.nonnegative_fit(good, web, np.full(30, 1 / 30), np.full(30, 1 / 30), 150, 0.9)
    z, u = w[good].sum(1) + b, w[web].sum(1) + b
    risk = np.logaddexp(0, u).mean() - 0.9 * np.logaddexp(0, z).mean()
    assert risk > -0.2 and np.isfinite(w).all()


def test_shares_of_pieces(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["word", "Word.", "ÄÖÜ", "x!!", "|", "a,"]) for _ in range(3_000)).encode()
    whole = quality.shares(text)
    monkeypatch.setattr(quality, "PIECE", 500)
    pieces = quality.shares(text)
    # only repeats and runs over the edge of a piece are lost
    assert np.abs(whole - pieces).max() < 0.05 and np.isclose(whole[:10], pieces[:10]).all()
    words = text.decode().split()
    repeats = sum(a == b for a, b in itertools.pairwise(words)) / len(words)
    assert np.isclose(whole[18], repeats) and quality.shares(None).sum() == quality.shares(b"").sum()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a text."), (1, "a text."), (2, None), (3, ""), (None, "no id"), (4, "x" * 3_000_000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 0), (9, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.train(docs, none)
    extra = docs.withColumns({"score": F.lit(7), "good": F.lit("mine"), "any": F.lit("mine")})
    got = quality.score(extra, model)
    assert {r.score for r in got.collect()} == {0.5} and got.columns == ["doc_id", "text", "good", "any", "score"]
    some = quality.train(extra, spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int"))
    rows = quality.score(docs, some).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score and rows[2].score == rows[3].score
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, none)).collect() == []


# 12


def audit_by_hand(rows, least_docs, most):
    """(lang, source, part, item, value, rank) in whole numbers of Python."""
    words = defaultdict(Counter)
    in_docs, groups = defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        words[lang, source].update(found)
        in_docs[lang].update(set(found))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]
        share = {}
        for s in sources:
            total = sum(words[lang, s][t] for t in kept) + len(kept)
            share[s] = {t: 1 + 1_000_000_000 * (words[lang, s][t] + 1) // total for t in kept}
        every = {t: sum(words[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 1_000_000_000 * (every[t] + 1) // (sum(every.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in sources if o != s]
            terms = [(-((share[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if words[lang, s][t] and share[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:most])):
                out |= {(lang, s, part, i, -v, r) for r, (v, i) in enumerate(sorted(values, key=lambda x: (x[0], x[1].encode())), 1)}
    return out


def texts_by_source(rng, n, sources):
    return [
        (rng.choice(["en", "de", None]), rng.choice(sources), None if rng.random() < 0.05 else " ".join(rng.choice(["Ab", "ab", "Ünd", "x1y", "naïve", "z"] + [f"w{chr(97 + i)}" for i in range(20)]) for _ in range(rng.randrange(30))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("blocks", [(200_000, 256), (7, 2)])
def test_divergence(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "BLOCK", blocks[0])
    monkeypatch.setattr(divergence, "SOURCES", blocks[1])
    rows = texts_by_source(random.Random(6), 150, ["a", "b", "B", None, "é"])
    rows += [("fr", "empty", ""), ("fr", "other", "1 2"), ("it", "one", "solo " * 3), ("it", "two", "solo"), ("it", "two", "solo")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("mine") for c in ("term", "n", "docs", "total", "part", "side", "item", "value")})
    got = {tuple(r) for r in divergence.audit(docs, 3, 4).collect()}
    assert got == audit_by_hand(rows, 3, 4)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice(["one", "two", "three" * 30]) for _ in range(400))
    want = Counter(text.split())
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert divergence._long(text.encode()) == want


def test_equal_hashes_are_told_apart():
    words = [b"abc", b"abd", b"abc", b"longer than eight", b"longer than eighT", b"x", b"abd", b"longer than eight"]
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for hash_of in (lambda t: 7, lambda t: len(t) % 2, divergence.xxhash.xxh64_intdigest):
        number, first = divergence.grouped(data, starts, ends, hash_of)
        assert [words[first[n]] for n in number] == words
        assert len(set(number)) == len(set(words))


# 13

EDITS = re.compile(r"(s?(ua)+)?")


def damage_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def repair_by_hand(rows):
    """All edits tried in order of cost and audit, with at most three insertions at a place."""
    seen, kinds = set(), []
    count = Counter()
    for _, role, text in rows:
        full = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else None
        seen.add((role, text))
        count[fault] += 1
        kinds.append(fault)

    def more(states, steps):
        out = {}
        for got in states:
            for cost, letter, turn in steps(got):
                new = (got[0] + cost, got[1] + letter, got[2] + ((turn,) if turn else ()))
                key = "".join(t[0][:1] for t in new[2])
                # what a prefix of turns may become hangs on its first and last letter only
                if re.fullmatch(r"s?(ua)*u?", key):
                    place = (key[:1] == "s" and len(key) == 1, key[-1:], bool(key))
                    if place not in out or new[:2] < out[place][:2]:
                        out[place] = new
        return list(out.values())

    def inserts(states):
        held = {}
        for _ in range(4):
            for got in states:
                key = "".join(t[0][:1] for t in got[2])
                place = (key[:1] == "s" and len(key) == 1, key[-1:], bool(key))
                if place not in held or got[:2] < held[place][:2]:
                    held[place] = got
            states = more(list(held.values()), lambda g: [(3, "I", ("user", "")), (3, "I", ("assistant", ""))])
        for got in states:
            key = "".join(t[0][:1] for t in got[2])
            place = (key[:1] == "s" and len(key) == 1, key[-1:], bool(key))
            if place not in held or got[:2] < held[place][:2]:
                held[place] = got
        return list(held.values())

    states = inserts([(0, "", ())])
    for (_, role, text), fault in zip(rows, kinds, strict=True):
        extra = 3 if fault == "truncated" else 0

        def steps(_got, role=role, text=text, fault=fault, extra=extra):
            yield 4, "D", None
            if fault not in ("blank", "duplicate"):
                yield extra, "K", (role, text)
                yield 3 + extra, "R", ("user", text)
                yield 3 + extra, "R", ("assistant", text)

        states = inserts(more(states, steps))
    done = [s for s in states if EDITS.fullmatch("".join(t[0][:1] for t in s[2]))]
    cost, audit, turns = min(done, key=lambda s: s[:2])
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    text = "\n".join(f"{r}:{t}" for r, t in turns)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def same_repairs(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("copy", "first", "figures", "fate", "audit", "place")})
    got = {r.conv_id: tuple(r)[1:] for r in chat_repair.digests(chat_repair.damaged(turns), turns).collect()}
    want = {c: repair_by_hand(r) for c, r in damage_by_hand(rows).items()}
    assert set(got) == set(want)
    for c in want:
        assert got[c] == want[c], (c, damage_by_hand(rows)[c])
    return turns, got


def test_repair(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "s", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 5, None]), role, rng.choice(["Yes.", "no", "ok!", " ", None, f"text {turn}.", f"cut {turn}", "?"])))
    rows += [(None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b.")]
    turns, got = same_repairs(spark, rows)
    heads = chat_repair.audits(chat_repair.damaged(turns), turns)
    texts = defaultdict(list)
    for r in sorted(chat_repair.repaired(chat_repair.damaged(turns), heads).collect(), key=lambda r: (str(r.conv_id), r.place)):
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(texts[c]).encode()).hexdigest() == g[-1] for c, g in got.items())


def test_repair_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same_repairs(spark, rows)


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    long = [(5_000, i, "user" if i % 2 else "assistant", f"text {i}.") for i in range(4_000)]
    same_repairs(spark, [(gone, 0, "user", "all that there is."), (7, 3, "user", "x" * 2_000_000), *long])
    empty = spark.createDataFrame([], schema)
    assert chat_repair.digests(chat_repair.damaged(empty), empty).collect() == []


def test_automaton_is_small():
    machine, rng = chat_repair.Automaton(), random.Random(2)
    for _ in range(300):
        machine.repair(bytes(rng.randrange(9) for _ in range(200)))
    assert len(machine.vectors) < 300
    assert machine.repair(b"") == (0, "")


def test_cheapest_of_all_edits():
    """The trace against every sequence of edits, up to four rows."""
    machine = chat_repair.Automaton()
    for n in range(4):
        for kinds in itertools.product([0, 1, 2, 3, 4, 5, 7], repeat=n):
            best = {}
            todo = {("", chat_repair.NOTHING): 0}
            for kind in [*kinds, None]:
                for _ in range(3):
                    for (audit, state), cost in list(todo.items()):
                        if not audit.endswith("III"):
                            for x, a, b, c in chat_repair.INSERTS:
                                if a == state:
                                    todo[audit + x, b] = min(todo.get((audit + x, b), 99), cost + c)
                if kind is None:
                    break
                after = {}
                for (audit, state), cost in todo.items():
                    for x, a, b, c in chat_repair.ARCS[kind]:
                        if a == state and cost + c <= 4 * n + 12:
                            after[audit + x, b] = min(after.get((audit + x, b), 99), cost + c)
                todo = after
            for (audit, state), cost in todo.items():
                if state in (chat_repair.NOTHING, chat_repair.ASSISTANT):
                    best[audit] = min(best.get(audit, 99), cost)
            assert machine.repair(bytes(kinds)) == min((c, a) for a, c in best.items())
