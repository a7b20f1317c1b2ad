"""Mixing, URL filters, personal data: against SQL and plain programs."""

import hashlib
import random
import re

import pytest
from compare import duck, duck_rows, spark_rows

from hitpath.llm import mixing, pii, queries, urls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_against_sql(spark, name, sf):
    assert spark_rows(queries.queries()[name](spark, sf)) == duck_rows(duck(sf), queries.oracle_sql()[name])


def test_mixing_meets_targets_and_keeps_rows(spark, make_docs):
    rows = [(i, "w " * (i % 50 + 1), "en", ["a", "b", None][min(i % 9, 2)]) for i in range(3000)] + [(None, None, None, "b")]
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == 3001
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= 50 and target <= 3 * size
    assert abs(sum(t for _, t in by) - sum(r.size for r in got)) < 1e-6
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    taken = {}
    for r in mixing.mixed(docs.withColumnRenamed("n_chars", "target")).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {r.doc_id: r.copies for r in got if r.copies}


def test_documents_of_a_source_differ_in_their_odds(make_docs):
    """A long document is taken about twice as often as a short one; targets are met all the same."""
    rows = [(i, "w " * (120 if i % 2 else 30), "en", "abcd"[i % 8 // 2]) for i in range(6000)]
    got = mixing.mix(make_docs(rows)).collect()
    by = {}
    for r, (i, _, _, source) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        assert r.copies <= 3 and r.taken == r.copies * r.size
        by.setdefault(source, {}).setdefault(r.size, []).append(r.copies)
        by[source].setdefault("target", r.target)
    odds = 0
    for sizes in by.values():
        assert abs(sum(sum(c) * n for n, c in sizes.items() if n != "target") - sizes["target"]) <= 60
        long_, short = (sum(sizes[n]) / len(sizes[n]) for n in (120, 30))
        assert long_ > short
        if long_ < 2.9:
            odds += 1
            assert 1.8 < long_ / short < 2.2
            # Both kinds are drawn: neither all nor none get a copy more.
            assert all(len(set(sizes[n])) == 2 for n in (120, 30))
    assert odds >= 2


def test_mixing_keeps_columns_of_its_own_names(make_docs):
    docs = make_docs([(i, "w " * (i % 200), "en", "ab"[i % 2]) for i in range(300)])
    named = docs.selectExpr("*", "doc_id AS _copy", "doc_id AS size", "doc_id AS target", "doc_id AS _mix_source", "1 AS left_long")
    got = mixing.mixed(named)
    assert got.columns == named.columns and all(r._copy == r.size == r.target == r.doc_id for r in got.collect())
    want = {r.doc_id: r.copies for r in mixing.mix(named).collect() if r.copies}
    taken = {}
    for r in got.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == want
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_of_nothing(empty, odd):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd).count() == odd.count()


def test_urls(spark):
    given = ["http://WWW.Example.com/en/x?y", "http://a.example.com/en/", "http://myexample.com/en/", "no host", None,
             "http://x.net/es/1", "http://x.net/ES/1", "http://x.net", "x://x.org/buy/cheap-pills.html#a/b", "http://a.com:80/",
             "http://com/", "", "http://x.org/Casino", "http://x.org/casinos", "a://b://c.com/"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").selectExpr("*", "url AS rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("com/", "allow")
    assert got[3] == got[4] == got[11] == ("", "", None, "allow")
    assert [got[i][2:] for i in (5, 6, 7)] == [("net/es/", "block"), (None, "allow"), (None, "allow")]
    assert got[8] == ("x.org", "/buy/cheap-pills.html", None, "block") and got[9] == ("a.com:80", "/", None, "allow")
    assert got[10][2] == "com/" and got[12][3] == "block" and got[13][3] == "allow" and got[14][0] == "b:"
    assert urls.judge(pages.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    filed = urls.index(urls.RULES, {"example": 9, "com": 9, "en": 5, "www": 3, "net": 2, "es": 7, "fr": 1})
    assert {t: [r.name for r in rs] for t, rs in filed.items()} == {
        "com": ["com/"], "en": ["example.com/en/"], "www": ["www.example.com/en/"], "net": ["net/es/"], "fr": ["net/fr/"],
    }
    assert urls.site_rule("block", "a.org", "/part").tokens == ("a", "org")


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    double = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in double)) % 10 == 0


def plain(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            ):
                found.append((kind, m.start(), m.end()))
    return found


HARD = [
    "a@b.c_d@e.f.g", "x@@y.z a.b@c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.004 1.2.3", "4111 1111-1111 1111 and 4111111111111112",
    "+1 (234) 555-0199. +12((( +4 9 é +123456789012345678", "\U0001f600 me@x.org \U0001f600 10.0.0.1", "0" * 16 + " " + "9" * 30000,
    "a" * 50000 + "@b" + ".c" * 20000, "1-" * 30000, "%@a-.b a@-.-", "+1 +2 +33333333", "4111 1111 1111 1111 +1 222 333 4444",
    "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 DE89 3704 0044 0532 0130 01",
]


@pytest.mark.parametrize("table", ["documents", "odd", "empty", "hard"])
def test_personal_data(request, make_docs, table):
    docs = make_docs(list(enumerate(HARD))) if table == "hard" else request.getfixturevalue(table)
    want = []
    for r in docs.collect():
        found = plain(r.text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        count = [sum(k == kind for k, _, _ in found) for kind in BASE]
        want.append((r.doc_id, *count, hashlib.sha256(listed.encode()).hexdigest()))
    got = pii.report(docs).collect()
    assert sorted((tuple(r[:6]) for r in got), key=str) == sorted(want, key=str)
    if table == "hard":
        spans = {r.doc_id: r.spans for r in got}
        assert spans[12].endswith("iban:5:32,iban:34:56")


def test_redaction(make_docs):
    rows = [(1, "to \U0001f600 me@x.org, or +1 (234) 555-0199!"), (2, None), (3, "none"), (4, "4111 1111 1111 1111"), (5, "a@b.c")]
    docs = make_docs(rows).withColumnRenamed("n_chars", "pii_email")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.pii_email for r in got.collect()} == {r.doc_id: r.pii_email for r in docs.collect()}
    assert {r.doc_id: r.text for r in got.collect()} == {
        1: "to \U0001f600 [email], or [phone]!", 2: None, 3: "none", 4: "[card]", 5: "[email]",
    }


def test_words_near_a_number_decide(make_docs):
    """A routing number counts only with a word that says so; an account number scores higher with one."""
    texts = ["ref 021000021 end", "routing 021000021 end", "routing 021000022 end", "bank " + "x " * 30 + "021000021", "a +021000021 bank",
             "zzz DE89370400440532013000 zzz", "iban DE89370400440532013000 zzz"]
    got = {r.doc_id: (r.spans, r.scores) for r in pii.report(make_docs(list(enumerate(texts)))).collect()}
    assert got[0] == got[2] == got[3] == ("", "") and got[1] == ("routing:8:17", "0.8")
    assert "routing" not in got[4][0]
    assert got[5] == ("iban:4:26", "0.8") and got[6] == ("iban:5:27", "1.0")


def test_account_numbers_have_the_length_of_their_country(make_docs):
    rows = [(1, "AT611904300234573201 BIC here"), (2, "AT611904300234573201, then"), (3, "AT61 1904 3002 3457 3201 X"), (4, "ATAT611904300234573201"), (5, "NO9386011117947 NO")]
    got = {r.doc_id: r.spans for r in pii.report(make_docs(rows)).collect()}
    assert got == {1: "iban:0:20", 2: "iban:0:20", 3: "iban:0:24", 4: "", 5: "iban:0:15"}


def plain_spans(text):
    """Added spans by plain loops: every place, its check, and words within forty code points."""
    found = []
    for i in range(len(text)):
        if i and text[i - 1].isascii() and text[i - 1].isalnum():
            continue
        for n, countries in pii.ACCOUNT_LENGTHS.items():
            if text[i : i + 2] in countries.split():
                taken, at = "", i
                while at < len(text) and len(taken) < n:
                    if text[at] == " " and taken and text[at - 1] != " ":
                        at += 1
                        continue
                    if not re.match("[A-Z0-9]", text[at]):
                        break
                    taken, at = taken + text[at], at + 1
                ends = at == len(text) or not re.match("[A-Za-z0-9]", text[at])
                if len(taken) == n and taken[2:4].isdigit() and ends:
                    turned = "".join(str(int(c, 36)) for c in taken[4:] + taken[:4])
                    if int(turned) % 97 == 1:
                        found.append(("iban", i, at))
    for m in re.finditer(r"(?<![0-9A-Za-z+.-])[0-9]{9}(?![0-9A-Za-z]|[.-][0-9])", text):
        d = [int(c) for c in m[0]]
        near = text[max(0, m.start() - 40) : m.start()] + " " + text[m.end() : m.end() + 40]
        words = re.search(r"routing|\baba\b|bank|account|transfer|konto|compte|virement|cuenta", near.lower())
        if (3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5] + d[8]) % 10 == 0 and any(d) and words:
            found.append(("routing", *m.span()))
    return found


def test_added_spans_against_plain_loops(make_docs):
    rng = random.Random(12)
    bits = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "AT611904300234573201", "021000021", "011401533", "bank", "routing", "ABC", "x", ",", "12", "-", "Konto", "é"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 12)))) for i in range(400)]
    got = {r.doc_id: r.spans for r in pii.report(make_docs(rows)).collect()}
    hits = 0
    for i, text in rows:
        added = [x for x in got[i].split(",") if x.startswith(("iban", "routing"))]
        want = [":".join(map(str, s)) for s in plain_spans(text)]
        hits += len(want)
        assert added == want, text
    assert hits > 100


def test_rules_that_tie():
    """Of fitting rules of the same length the last by name, of patterns the blocking one, in whatever order they come."""
    rules = [urls.site_rule("allow", "a.com", "/xy"), urls.site_rule("block", "com", "/xy/z"), urls.Rule("allow", None, "xy", ("xy",)), urls.Rule("block", None, "x", ())]
    for some in (rules, rules[::-1]):
        filed = {t: [(r, re.compile(r.pattern)) for r in rs] for t, rs in urls.index(some, {}).items()}
        assert urls.verdict("a.com", "/xy/z", filed) == ("com/xy/z", "block")
        filed = {t: [(r, re.compile(r.pattern)) for r in rs] for t, rs in urls.index(some[2:] if some is rules else some[:2], {}).items()}
        assert urls.verdict("a.com", "/xy", filed) == (None, "block")
