import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weftline.llm import disclosure

# The plain patterns of the four kinds.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def base(t):
    out = []
    for no, (k, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 14 <= len(d) <= 19 and luhn(d) or k == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), no, m.end(), k))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def check(rows, got):
    by = {r["doc_id"]: r for r in got}
    for k, t in rows:
        assert by[k]["base_sha256"] == hashlib.sha256(base(t or "").encode()).hexdigest(), t


def terms(t):
    return re.findall(r"[^\W_]+(?:['\u2019-][^\W_]+)*", t or "")


def test_same_as_plain_patterns(spark, docs, texts):
    rng = random.Random(3)
    parts = ["a@b.co", "x", "@", "1.2.3.4", ".", "+", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111111", " ", "-", "é", "\U0001f600", "999.1.1.1", "_", "a.b", "0", "12", "\n", "00001.2.3.4"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(1500)] + [(9000, None), (9001, "a@" + "b." * 20000 + "c"), (9002, "+1" + "2 " * 20000)]
    check(rows, disclosure.digest(disclosure.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    check(texts, disclosure.digest(disclosure.find_spans(docs)).collect())


def test_terms_that_stand_for_an_entity(spark):
    fill = ["plain words about weather", "other notes on cooking", "some lines about trains", "a report on rivers", "thoughts about music"]
    rows = [(i, f"{fill[i % 5]} number{i} the zanzibar project of joe@example.com said {fill[(i + 2) % 5]}") for i in range(5)]
    rows += [(10 + i, f"{fill[i % 5]} and said more") for i in range(40)]
    rows += [(100, "the zanzibar project here")]
    got = {r["doc_id"]: r["spans"] for r in disclosure.digest(disclosure.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    text = rows[0][1]
    at = text.index("zanzibar")
    assert f"term:{at}:{at + 8}" in got[0] and "email" in got[0]
    assert "said" in text and f"term:{text.index('said')}" not in got[0]
    assert not any(got[10 + i] for i in range(40)) and got[100] == ""
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[-1][1]


def test_copies_prove_nothing(spark):
    rows = [(i, "the zanzibar project of joe@example.com said so") for i in range(9)] + [(20 + i, "plain") for i in range(30)]
    got = disclosure.digest(disclosure.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert not any("term" in r["spans"] for r in got)


def test_odd_rows(odd_docs, no_docs):
    got = disclosure.digest(disclosure.find_spans(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert (by[10]["n_email"], by[10]["n_phone"], by[10]["n_ip"]) == (1, 1, 1) and by[4]["spans"] == ""
    clean = disclosure.sanitise(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[10] == "mail me at [EMAIL] or [PHONE] or [IP]" and texts[4] is None and texts[5] == ""
    assert disclosure.sanitise(no_docs).count() == 0


def test_terms_of_classes_far_away_and_short(spark):
    fill = "plain words about the weather and other notes on cooking and some lines about trains and a report on rivers that say little "
    rows = [(i, f"Kai wrote to {name}@acme-labs.org {chr(97 + i) * 5} {fill}{fill}and unit X-7 agreed with kai") for i, name in enumerate(["ann", "ben", "cid", "dov"])]
    rows += [(10 + i, f"{fill}{i}") for i in range(60)] + [(200, "kai was here")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in disclosure.digest(disclosure.find_spans(table)).collect()}
    for i in range(4):
        text = rows[i][1]
        for at, size in ((0, 3), (text.index("X-7"), 3), (text.rindex("kai"), 3)):
            assert f"term:{at}:{at + size}" in got[i]
        assert not any(f"term:{m.start()}:{m.end()}" in got[i] for m in re.finditer("weather|ann|acme|labs", text))
    assert got[200] == [""]


def test_shares_by_brute_force(spark):
    """Which terms disclose, by counting in plain Python: the sentences of every class, every term of them, PMI over information."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    limits = disclosure.Thresholds(support=2, generalise=0.3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    spans = disclosure.cut(disclosure.base_spans(disclosure.cut(disclosure.found(docs.filter("text is not null"), "doc_id", "text"))))
    named = disclosure.cut(disclosure.classed(spans, limits))
    got = {(r["class"], r["term"]): r["reveals"] for r in disclosure.disclosing(docs, "text", named, limits).collect()}
    hashed = spark.createDataFrame([(w,) for w in {w for _, t in rows for w in terms(t)}], "w string").selectExpr("w", "xxhash64(lower(w)) as k").collect()
    key = {r["w"]: r["k"] for r in hashed}
    n, n_term = len(rows), Counter(k for _, t in rows for k in {key[w] for w in terms(t)})
    for r in spans.collect():
        assert not re.search(r"[.!?]", r["sentence"]) and r["sentence"].count("\n") == 1
    places, texts, of = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in named.collect():
        of[r["class"]].add(r["row"])
        for k in {key[w] for w in terms(r["sentence"])}:
            places[r["class"], k].add(r["place"])
            texts[r["class"], k].add(r["row"])
    both, n_class = {x: len(t) for x, t in texts.items()}, {c: len(t) for c, t in of.items()}
    want = {}
    for (c, k), p in places.items():
        if len(p) >= limits.support and n_class[c] < n:
            share = math.log2(n * both[c, k] / (n_class[c] * n_term[k])) / math.log2(n / n_class[c])
            if share >= limits.generalise:
                want[c, k] = share
    assert want and set(got) == set(want) and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in want)


def test_terms_occur_on_the_tables(spark):
    """With the default thresholds the method adds spans to rows with personal data, and to no others."""
    got = disclosure.digest(disclosure.find_spans(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))).collect()
    marked = [r for r in got if "term:" in r["spans"]]
    print(f"{len(marked)} rows with terms")
    assert marked and all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] > 0 for r in marked)


def test_columns_with_the_operators_own_names(spark):
    rows = [(1, "write to joe@example.com now", "a", "k"), (None, None, None, None), (1, "", "b", "l")]
    table = spark.createDataFrame(rows, "doc_id long, text string, __tag string, cuts string")
    clean = disclosure.sanitise(table)
    assert clean.columns == table.columns
    assert sorted(map(str, clean.collect())) == sorted(map(str, spark.createDataFrame([(1, "write to [EMAIL] now", "a", "k"), *rows[1:]], table.schema).collect()))
