import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from llm_cases import LONG, TEXTS, documents, empty, prose
from pyspark.sql import functions as F

from ledgerscope.llm.disclosure import (KINDS, NEAR_CHARS, NEAR_WORDS, contexts, disclosure, general_form,
                                        revealing_terms, running, sanitise, written)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
         "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}")
EDGE = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def accepted(kind, m):
    digits = re.sub(r"[^0-9]", "", m)
    return {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.split(".")) if kind == "ip" else None,
            "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def base(text):
    found = [(m.start(), i, m.end(), k, m.group()) for i, k in enumerate(KINDS) for m in PLAIN[k].finditer(text)
             if accepted(k, m.group())]
    return sorted(found)


def named(kind, value):
    return f"{kind}:" + (value.translate(LOWER) if kind == "email" else value if kind == "ip" else re.sub(r"[^0-9]", "", value))


def brute(rows, threshold=0.8, support=3):
    """``(base, spans, sanitised)`` of every text."""
    texts = [t or "" for _, t in rows]
    near, holds = [], []
    for text in texts:
        pairs = set()
        for kind in KINDS:
            matches = [m for m in PLAIN[kind].finditer(text)
                       if kind != "card" or 14 <= len(re.sub(r"[^0-9]", "", m.group())) <= 19]
            for i, m in enumerate(matches):
                if not accepted(kind, m.group()):
                    continue
                before = text[matches[i - 1].end() if i else 0:m.start()]
                after = text[m.end():matches[i + 1].start() if i + 1 < len(matches) else len(text)]
                if len(before) > NEAR_CHARS:
                    before = re.sub(f"^{EDGE}", "", before[-NEAR_CHARS:])
                if len(after) > NEAR_CHARS:
                    after = re.sub(f"{EDGE}$", "", after[:NEAR_CHARS])
                words = []
                for part, last in ((before, True), (after, False)):
                    for k in ("phone", "email", "ip"):
                        part = PLAIN[k].sub(" ", part)
                    w = WORD.findall(part.translate(LOWER))
                    words += w[-NEAR_WORDS:] if last else w[:NEAR_WORDS]
                e = named(kind, m.group())
                pairs |= {(e, "")} | {(e, w) for w in words}
        near.append(pairs)
        holds.append(set(WORD.findall(text.translate(LOWER))))
    together, in_texts = Counter(), defaultdict(set)
    for text, pairs in zip(texts, near):
        together.update(pairs)
        for p in pairs:
            in_texts[p].add(text)
    word_rows = Counter(w for h in holds for w in h)
    form = lambda t: t[:(len(t) + 1) // 2] + "*"
    form_rows, form_near = Counter(), Counter()
    for w, n in word_rows.items():
        form_rows[form(w)] += n
    for (e, t), n in together.items():
        if t:
            form_near[e, form(t)] += n

    def given(n, of, e):
        p = together[e, ""]
        return 1 - math.log(n / of) / math.log(p / len(rows)) if p < len(rows) else 0.0

    reveal = {}
    for (e, t), n in together.items():
        if t and len(in_texts[e, t]) >= support and given(n, word_rows[t], e) >= threshold:
            g = form(t)
            reveal[e, t] = g if given(form_near[e, g], form_rows[g], e) < threshold else ""
    out = []
    for text, pairs in zip(texts, near):
        mine = {}
        for p in pairs:
            if p in reveal:
                mine[p[1]] = min(mine.get(p[1], "~"), reveal[p])
        found = base(text)
        low = text.translate(LOWER)
        if mine:
            for m in re.finditer(EDGE, low):
                if m.group() in mine and not any(b[0] < m.end() and m.start() < b[2] for b in found[:]):
                    found.append((m.start(), len(KINDS), m.end(), "term", m.group()))
        found.sort()
        made, at = "", 0
        for start, _, end, kind, value in found:
            if start >= at:
                made += text[at:start] + (mine[value] if kind == "term" else f"[{kind.upper()}]")
            at = max(at, end)
        out.append((base(text), found, made + text[at:]))
    return out


def corpus(n=220, seed=6):
    """People whose names stand by their address and hardly anywhere else, among prose and lone data."""
    rng = random.Random(seed)
    people = [("Jonas Quellberg", "j.quellberg@firm.example.org"), ("Mira Otavsky", "+44 20 7946 0958"),
              ("Pell", "10.20.30.40"), ("Anselm", "4111 1111 1111 1111")]
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(3, 40), alphabet="abcdef")
        if i % 6 == 0:
            name, data = people[i // 6 % 4]
            text = f"{prose(rng, rng.randint(0, 30))} {name} {rng.choice(['writes', 'calls', 'is'])} {data.upper() if '@' in data else data}, {text}. {name}!"
        elif i % 7 == 0:
            text += f" lone.{i}@mail.example.com {text[:20]} 192.168.{i % 256}.{i % 300} jon pelle"
        else:
            text += " who writes and calls"
        rows.append((i, text))
    return rows + [(3, rows[6][1])] * 20 + [(None, rows[0][1]), (n, None), (n + 1, "")]


TRICKY = ["a@b.c_d@e.f-.g", "x@y x@.z x@y..z q@w.e", "999.1.1.1.1 1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1 1.2.3", "4111-1111 1111--1111 4111111111111111",
          "41111111111111110000 4111 1111 1111 1111 5", "+1 (559) 555-3817+44 20 7946 0958-", "+123 456 (78) 90 1 2 3 4 5 6", "++1.5.5.5.5.5.5.5.5.5.5 +1 555 123-4567a@b.co",
          "é😀 a@b.c 😀4111111111111111é", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", "+1234567890@x.org", "a" * 30_000 + "@b", "1.1." * 20_000, "0 " * 30_000,
          "x@" + "a." * 20_000 + "b", "+" + "1-" * 20_000, "a@b.c " * 3_000, "a%@b.c\n+49\n(30) 1234567"]


def check(out, rows, **how):
    want = brute(rows, **how)
    assert len(out) == len(rows)
    for r, (b, s, made) in zip(out, want):
        assert [tuple(x) for x in r["base"]] == b, (r["text"] or "")[:200]
        assert [tuple(x) for x in r["spans"]] == s
        assert r["sanitised"] == made
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[3] == k for x in b) for k in KINDS]


def ordered(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("at", F.monotonically_increasing_id())


def test_base_spans_of_tricky_texts(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY + TEXTS)]
    check(sanitise(ordered(spark, rows)).orderBy("at").collect(), rows)


@pytest.mark.parametrize("threshold, support", [(0.8, 3), (0.5, 2), (1.0, 1)])
def test_against_brute_force(spark, threshold, support):
    rows = corpus()
    check(sanitise(ordered(spark, rows), threshold=threshold, support=support).orderBy("at").collect(), rows,
          threshold=threshold, support=support)


def test_names_go_and_common_words_stay(spark):
    rows = corpus()
    out = sanitise(ordered(spark, rows)).collect()
    text = " ".join(r["sanitised"] for r in out)
    for gone in ("Quellberg", "Otavsky", "quellberg", "7946"):
        assert gone not in text
    terms = {x["value"] for r in out for x in r["spans"] if x["kind"] == "term"}
    assert {"jonas", "quellberg", "mira", "otavsky"} <= terms and not terms & {"writes", "calls", "lone", "jon"}
    assert all(r["spans"] == r["base"] for r in out if "lone." in (r["text"] or ""))


def test_a_general_form_is_used_where_it_discloses_less(spark):
    """'quell*' holds common words too, 'otav*' nobody else."""
    rows = [(i, f"word{i % 5} plain text quelle quelldorf") for i in range(60)]
    rows += [(100 + i, f"text Quellberg x@y.org Otavsky {i}") for i in range(5)]
    out = sanitise(spark.createDataFrame(rows, SCHEMA)).where("n_email > 0").collect()
    assert all(r["sanitised"] == f"text quell* [EMAIL]  {r['doc_id'] - 100}" for r in out)


def test_copies_are_no_support(spark):
    rows = [(i, f"filler {i}") for i in range(50)] + [(100 + i, "Otavsky x@y.org") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    held = contexts(docs)
    assert {(r["entity"], r["term"], r["rows"]) for r in held.collect()} == {("email:x@y.org", "", 30), ("email:x@y.org", "otavsky", 30)}
    assert revealing_terms(docs, held).count() == 0
    assert revealing_terms(docs, held, support=1).count() == 1


def test_disclosure_and_running(spark):
    r = spark.range(1).select(disclosure(F.lit(5), F.lit(5), F.lit(5), 100).alias("all"),
                              disclosure(F.lit(5), F.lit(100), F.lit(5), 100).alias("none"),
                              disclosure(F.lit(5), F.lit(5), F.lit(100), 100).alias("known"),
                              general_form(F.lit("abcde")).alias("form")).first()
    assert r["all"] == 1 and abs(r["none"]) < 1e-12 and r["known"] == 0 and r["form"] == "abc*"
    df = spark.createDataFrame([(list(range(1, 1200)),), ([],), ([7],)], "v array<int>")
    sums = [x[0] for x in df.select(running(F.col("v"), lambda a, b: a + b)).collect()]
    assert sums == [[n * (n + 1) // 2 for n in range(1, 1200)], [], [7]]


def test_plan_is_native(spark):
    plan = sanitise(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_awkward_documents(spark):
    docs = documents(spark, extra=True).withColumns({c: F.lit("own") for c in ("base", "sanitised", "n_ip", "digest", "entity", "term", "rows")})
    out = sanitise(docs).collect()
    assert len(out) == len(TEXTS) + 1
    assert all(r["sanitised"] == (r["text"] or "") and r["spans"] == [] and r["digest"] == "own" for r in out)
    assert sanitise(empty(spark)).count() == 0
    assert LONG in {r["sanitised"] for r in out}


def test_query(spark):
    from ledgerscope.llm.queries import queries
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries()["op12_pii_disclosure"](spark, folder).collect()}
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in spans)
    assert len(got) == len(rows)
    for (doc, _), (b, s, _) in zip(rows, brute(rows)):
        assert tuple(got[doc]) == (doc, *[sum(x[3] == k for x in b) for k in KINDS],
                                   hashlib.sha256(line(b).encode()).hexdigest(), line(s))


def test_sql_agrees_on_people_and_tricky_texts():
    """The oracle's statement over planted people, against the brute-force version: terms and all."""
    import duckdb
    import pyarrow as pa
    from ledgerscope.llm.queries import PII_SQL
    short = [t for t in TRICKY if len(t) < 1000]
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(short)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())}))
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in spans)
    want = [(doc, *[sum(x[3] == k for x in b) for k in KINDS], hashlib.sha256(line(b).encode()).hexdigest(), line(s))
            for (doc, _), (b, s, _) in zip(rows, brute(rows))]
    got = con.execute(PII_SQL).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum("term:" in r[-1] for r in got) > 20
