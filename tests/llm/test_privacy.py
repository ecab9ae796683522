import hashlib
import random
import re

from tables import documents, sf  # noqa: F401

from stagewise.llm import privacy as P

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    found = [(kind, m.start(), m.end()) for kind, rule in RULES.items() for m in re.finditer(rule, text or "") if valid(kind, m.group())]
    counts = tuple(sum(f[0] == kind for f in found) for kind in RULES)
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()), found


TEXTS = [
    None,
    "",
    "a@b.c_d@e.f x@y.z.",
    "é Mail: jo.do+x%y-z@mail-1.example.com, ...@a.b..c@d",
    "a@b",
    "@@@ a@@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.255 1.2.3 .9.9.9.9 999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111 4111111111111111 5 5",
    "4111  1111 1111 1111, 6304000000000000000",
    "+49 (0)30 123-45.67 +1 +1234567 +12345678 +1234567890123456 ++49 170 1234567-",
    "tel:+1(202)555-0133.ip 10.0.0.1 card 4111111111111111 mail a@b.co +",
    "x" * 5000 + "@" + "y." * 3000 + "z",
    "9." * 4000 + "9",
    "😀 ü a@b.de 😀 +4917012345678 😀",
    "a@b.c" * 40,
]


def test_base_spans_match_brute_force(spark, documents):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a@b.co"), (3, TEXTS[3]), (3, TEXTS[3])]
    got = sorted((tuple(r) for r in P.digest(documents(rows).selectExpr("*", "1 AS hash", "2 AS term")).collect()), key=str)
    want = sorted(((k, *brute(t)[0], ",".join(f"{a}:{b}:{c}" for a, b, c in brute(t)[1])) for k, t in rows), key=str)
    assert got == want


def telling_corpus():
    rows = [(k, f"ordinary words of document {k} without anybody in them") for k in range(200)]
    for k in range(4):
        rows.append((300 + k, f"so {k}th note by Zaphod about mail to zb@ship.example soon{k} then"))
    rows += [(400, "later on, ZAPHOD spoke again"), (401, "and notebook zaphodian stays")]
    return rows + [(500 + k, "copied text with rareword next to copy@x.example in it") for k in range(6)]


def test_telling_terms_are_found_everywhere(spark, documents):
    docs = documents(telling_corpus())
    found = {r["id"]: r["term"] for r in P.spans(docs).collect()}
    place = telling_corpus()[200][1].index("Zaphod")
    assert (place, place + 6) in [(s["start"], s["stop"]) for s in found[300]]
    assert [(s["start"], s["stop"]) for s in found[400]] == [(10, 16)]
    assert not found[401] and not any(found[k] for k in range(200)) and not found[500]
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(docs).collect()}
    assert "Zaphod" not in clean[300] and "[EMAIL]" in clean[300] and "ZAPHOD" not in clean[400]
    assert clean[7] == telling_corpus()[7][1] and clean[500] == "copied text with rareword next to [EMAIL] in it"


def test_words_at_the_ends_of_a_text_are_whole(spark, documents):
    rows = [(k, f"ordinary words of document {k} without anybody in them") for k in range(200)]
    rows += [(300 + k, f"variant{k} of a note by Zaphod about mail to zb@ship.example soon{k}") for k in range(4)]
    rows += [(310 + k, f"Smithson smith@x.example has letter{k} of the day") for k in range(4)]
    rows += [(320 + k, f"the letter{k} came with mail a@b.example Trillian") for k in range(4)]
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(documents(rows)).collect()}
    assert not [t for t in clean.values() if any(name in t for name in ("Zaphod", "Smithson", "Trillian"))]


def test_only_words_cut_by_the_window_are_left_out(spark, documents):
    mail, edge = "a@b.example", "w" * 40
    texts = [f"Adams {edge} {mail} {edge} Brown", f"x Adam {edge}! {mail} !{edge} Jones y", f"x Adams {edge}! {mail} !{edge} Brown", f"x Adamson {edge}! {mail} !{edge} Browning"]
    rows = P.entities(documents(texts)).select("id", "seen.around").collect()
    got = {r["id"]: r["around"][0] for r in rows}
    # The whole text, edges at a word's border, and words cut by both edges.
    assert got[0] == f"Adams {edge} \n {edge} Brown"
    assert got[1] == f" Adam {edge}! \n !{edge} Jones"
    assert got[2] == f"Adams {edge}! \n !{edge} Brown"
    assert got[3] == f" {edge}! \n !{edge} "


def test_terms_far_from_the_entity_and_short_ones(spark, documents):
    far = "and then the text goes on for quite a while before anything else is said in it, "
    rows = [(k, f"ordinary words of document {k} without anybody in them, {far}") for k in range(200)]
    rows += [(300 + k, f"Trillian came on day{k}, {far} mail to tm@ship.example, {far} so Ng and Li said on day{k}") for k in range(4)]
    rows += [(400, "Trillian again, with Li and Ng")]
    docs = documents(rows)
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(docs).collect()}
    assert not [t for t in clean.values() if any(name in t for name in ("Trillian", "Ng", "Li"))]
    assert clean[7] == rows[7][1] and far in clean[300]
    # The parts of an entity are no terms of its own.
    mail = rows[200][1].index("tm@")
    assert not [s for r in P.spans(docs).where("id = 300").collect() for s in r["term"] if mail <= s["start"] < mail + 15]


def test_every_context_counts(spark, documents):
    shared = "regards from Slartibart at sb@fjord.example of the Magrathean office for coasts\n"
    rows = [(k, f"ordinary words of document {k} without anybody in them") for k in range(200)]
    rows += [(300 + k, f"{shared}in the letter{k} now Slartibart wrote sb@fjord.example for the reply{k}") for k in range(2)]
    rows += [(310, "first Prosser wrote mail pr@x.example there. second, so Prosser gave pr@x.example again. third, Prosser left pr@x.example here with Hapax")]
    terms = {r["term"] for r in P.telling_terms(P.entities(documents(rows)), documents(rows).selectExpr("doc_id AS id", "text", "xxhash64(text) AS hash")).collect()}
    # One signature and two texts; three mentions in one document; not a word that stands once beside them.
    assert {"slartibart", "prosser"} <= terms and "hapax" not in terms


def test_recall_of_planted_names(spark, documents):
    """Thirty people, each with an address, in four letters each among others: their names are found, other words are left."""
    r = random.Random(8)
    vocab = [f"word{k}" for k in range(300)]
    some = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    names = [f"Person{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(30)]
    rows = [(k, some(r.randrange(20, 60))) for k in range(400)]
    for k, name in enumerate(names):
        for j in range(4):
            rows.append((1000 + 10 * k + j, f"{some(12)} {name} {some(r.randrange(2, 14))} {name.lower()}@mail.example {some(9)}"))
    docs = documents(rows)
    clean = {x["doc_id"]: x["text"] for x in P.sanitise(docs).collect()}
    kept = sum(name in clean[1000 + 10 * k + j] for k, name in enumerate(names) for j in range(4))
    assert kept <= 0.1 * 4 * len(names)
    left = sum(clean[d] == t for d, t in rows if d < 1000)
    assert left >= 0.95 * 400


def test_sanitise_keeps_rows_and_columns(spark, documents):
    docs = documents([(1, None), (1, "mail a@b.co and 1.2.3.4"), (1, "mail a@b.co and 1.2.3.4"), (None, "")]).selectExpr("*", "1 AS cut")
    out = P.sanitise(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["text"]) for r in out.collect()) == ["", "None", "mail [EMAIL] and [IP]", "mail [EMAIL] and [IP]"]
    assert P.digest(documents([])).count() == 0


def test_query(spark, sf):
    import pyarrow.parquet as pq

    from stagewise.llm.queries import QUERIES

    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in QUERIES["op10_privacy"](spark, sf).collect()}
    assert got == {r["doc_id"]: brute(r["text"])[0] for r in rows}


def test_plan_has_no_python(spark, sf):
    plan = P.spans(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
