import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import pii

# the plain patterns of the contract
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, m):
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    d = re.sub("[^0-9]", "", m)
    return 16 <= len(d) <= 19 and luhn(d) if kind == "card" else 8 <= len(d) <= 15


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if valid(k, m.group())] for k, p in PLAIN.items()}


ODD = [
    None, "", "a@b.c_d@e.f", "a@b.c.@d.e", "a@b@c.d", "1.2.3.4.5.6 999.1.1.1 0001.2.3.4 255.255.255.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (706) 555-3138. +123 +1234567890123456",
    "\U0001f600 me@mail.co \U0001f600 +49 30 1234567 é", "a@b.c" * 50, "1" * 5000, "1.1" * 3000, "+1" + "(" * 5000, "a." * 20000 + "@b.c", "5 5 5 5", "12  34 1.2.3.4@x.y", "-@-.-.-", "4111111111111111 " * 700,
    "x@" + "y." * 9000 + "z", "٣.1.2.3.4", "+1\n2345678", "0000.0.0.0", "+12345678+12345678",
]


def test_base_spans_equal_the_plain_patterns(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("email", F.lit(1)).withColumn("_key", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op2_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        b = base(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for k in PLAIN for s, e in b[k])
        assert [got[i][f"n_{k}"] for k in PLAIN] == [len(b[k]) for k in PLAIN], (i, b)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and got[i]["spans"].startswith(joined)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"notes number{i} about common things and common people, nothing more to say here") for i in range(60)]
    rows += [(100 + i, f"as they said{i}, Quixotania wrote to quix@home.org today{i} about common things") for i in range(4)]
    rows += [(200, "somewhere else Quixotania, and quixotania again; Quixotanian isn't it"), (201, None), (201, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_disclose_an_entity_are_found_everywhere(corpus):
    got = {r["doc_id"]: r for r in pii.spans_of(corpus).collect()}
    found = lambda i: [(s["start"], s["end"]) for s in [*got[i]["remove"], *got[i]["generalise"]]]
    text = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert [text[200][s:e] for s, e in found(200)] == ["Quixotania", "quixotania"]
    assert all("Quixotania" in [text[i][s:e] for s, e in found(i)] for i in range(100, 104))
    assert not any(found(i) for i in range(60)) and not found(201)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(corpus).collect()}
    assert "<email>" in clean[100] and "Quixotania" not in clean[100] and clean[3] == text[3] and clean[201] is None


def brute_terms(rows):
    """Shares by the definition, from sets of row numbers."""
    word = lambda t: {w for w in re.split(r"[^a-zäöüß]+", t.lower()) if len(w) >= pii.LETTERS}
    kind_value = lambda k, v: v.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", v)
    holds, contexts, stands = {}, {}, {}
    for i, t in enumerate(rows):
        for w in word(t):
            stands.setdefault(w, set()).add(i)
        for k, p in PLAIN.items():
            cuts = [m.span() for m in re.finditer(p, t)]
            for j, (a, b) in enumerate(cuts):
                if valid(k, t[a:b]):
                    e = (k, kind_value(k, t[a:b]))
                    before = t[cuts[j - 1][1] if j else 0 : a][-pii.CONTEXT :]
                    after = t[b : cuts[j + 1][0] if j + 1 < len(cuts) else len(t)][: pii.CONTEXT]
                    holds.setdefault(e, set()).add(i)
                    contexts.setdefault(e, {}).setdefault(i, set()).add((before, after))
    out = {}
    for e, own in holds.items():
        for w, at in stands.items():
            both = own & at
            unlike = min(len({f(contexts[e][i]) for i in both}) for f in (min, max)) if both else 0  # documents, not mentions
            if unlike >= pii.SUPPORT and len(own) < len(rows):
                share = math.log2(len(both) * len(rows) / (len(own) * len(at))) / math.log2(len(rows) / len(own))
                if share >= pii.GENERALISE:
                    out[w] = max(out.get(w, 0), share)
    return out


def test_disclosing_terms_equal_a_brute_force_version(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("kalo", "mir", "zen", "tup") for b in ("ba", "do", "fi", "gu") for c in ("n", "rt", "s", "x")]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(3, 25)))
        if i % 6 == 0:
            who = rng.randint(0, 5)
            text += f" firm{'abcdef'[who] * 3} called m{who}@mail.org twice" + rng.choice([" m0@mail.org", " 10.0.0.7", " +49 30 1234567", ""]) + " " + rng.choice(words)
        rows.append(text)
    rows += rows[:12]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["term"]: r["share"] for r in pii.disclosing_terms(docs, pii.entities(docs)).collect()}
    want = brute_terms(rows)
    assert set(got) == set(want) and any(w.startswith("firm") for w in want)
    assert all(got[w] == pytest.approx(want[w]) for w in want)


def test_a_name_far_from_the_entity_is_found_and_generalised(spark):
    filler = " ".join(["word"] * 60)
    rows = [(i, f"Quixotania{'' if i else ' x'} {filler} number{i} {filler} q@home.org today{i}") for i in range(5)]
    rows += [(50 + i, "Quixotania elsewhere") for i in range(2)] + [(100 + i, f"plain word number{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    # five of its seven rows hold the address: between the thresholds, so it is generalised everywhere
    assert clean[50] == "Quixo* elsewhere" and clean[3].startswith("Quixo* ") and "<email>" in clean[3]


def test_secrets_are_entities(spark):
    key = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    rows = [(1, f'see token = "{key}" there'), (2, "aaaaaaaaaaaaaaaaaaaaaaaaaaa1 " + "x" * 60), (3, "averyveryverylongwordwithoutdigits"), (4, f"https://h.org/{key[:19]}/x"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["secret"]] for r in pii.spans_of(docs).collect()}
    assert got == {1: [(13, 53)], 2: [], 3: [], 4: [], 5: []}
    assert {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}[1] == 'see token = "<secret>" there'


def test_copies_of_one_text_prove_nothing(spark):
    rows = [(i, "only here Zanzibaria wrote to z@z.org indeed, with plain words around it") for i in range(5)] + [(9 + i, f"plain words number{i}") for i in range(30)]
    got = pii.spans_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 35 and not any(r["remove"] or r["generalise"] for r in got) and sum(len(r["email"]) for r in got) == 5


def test_documents_count_once_and_not_their_mentions(spark):
    """Copies that name an entity three times, copies edited elsewhere or at one mention, and a document alone."""
    thrice = "on Monday Zanzibaria wrote 4111 1111 1111 1111 again, {} then 4111 1111 1111 1111 came and 4111 1111 1111 1111 went"
    rows = [(i, thrice.format("late")) for i in range(3)] + [(3, thrice.format("late") + " edited at the end"), (4, thrice.format("soon"))]
    rows += [(5, "elsewhere Zanzibaria lies"), (6, "alone Quixotania told me@here.org and me@here.org, and later me@here.org")]
    rows += [(9 + i, f"plain words number{i}") for i in range(60)]
    got = {r["doc_id"]: r for r in pii.spans_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r["remove"] or r["generalise"] for r in got.values()) and len(got[0]["card"]) == 3
    # three unlike documents do prove something
    rows += [(200 + i, f"{w} {w} Quixotania told me@here.org {w} {w}") for i, w in enumerate(("north", "south", "west"))]
    got = {r["doc_id"]: r for r in pii.spans_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r["remove"] or r["generalise"] for i, r in got.items() if i in (6, 200, 201, 202))
    assert not any(r["remove"] or r["generalise"] for i, r in got.items() if i not in (6, 200, 201, 202))


def test_plan_is_native_and_empty_tables_are_fine(spark, corpus):
    plan = pii.spans_of(corpus)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert pii.spans_of(corpus.limit(0)).count() == 0
