import hashlib
import random
import re

from graphloom.llm.pii import find, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    r = random.Random(8)
    parts = ["a.b@c.de", "x@y", "@", "a_b@c.d_e@f.g", "1.2.3.4", "256.1.1.1", "01.002.3.0000000000000000000004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "79927398713",
             "5500005555555559 12", "+1 (202) 555-0100", "+12", "+1(((((((", "é😀", " ", "  ", "\n", "word", "-", "7", ".", "0000 0000 0000 0000", "12345678901234567890"]
    return ["", None, *parts, *("".join(r.choice(parts) for _ in range(r.randrange(2, 12))) for _ in range(1500)), "9" * 5000, "a" * 50_000 + "@b.c", "1 " * 20_000, "+1" * 10_000, "a.b" * 3000, "x@" + "a." * 5000 + "b"]


def test_fixed_kinds_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in find(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, spans int").repartition(4)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        listed = ",".join(x for kind in PATTERNS for x in want[kind])
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in PATTERNS), text
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


def labelled():
    rows = [(i, f"name x tel: +1 (202) 555-01{i:02d} rest") for i in range(10, 40)]
    rows += [(i, f"some page = {i}77 and time: 10:{i}") for i in range(50, 80)]
    return rows + [(100, "é tel: 555-0123, then"), (101, "tel: nothing here"), (102, 'mail = "a@b.cd"'), (103, "page = 12345"), (None, "tel: 555-7777"), (104, "TEL:5550199")]


def test_confident_labels_discover_values(spark):
    got = {r.doc_id: r for r in find(spark.createDataFrame(labelled(), "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:7:15" and (got[100].n_phone, got[100].n_added) == (0, 1)
    assert got[None].spans == "phone:5:13" and got[104].spans == "phone:4:11"
    assert got[101].spans == "" and got[103].spans == ""  # no digit; a label without seeds
    assert sum(r.n_added for r in got.values()) == 3
    assert got[102].spans == "email:8:14"


def test_redact(spark):
    docs = spark.createDataFrame([(*r, len(r[1]), "en") for r in labelled()] + [(200, None, 0, "x"), (201, "a@b.cd 1.2.3.4é 4111111111111111", 9, "x"), (201, "a@b.cd 1.2.3.4é 4111111111111111", 9, "x")], "doc_id long, text string, n_chars long, found string")
    got = redact(docs)
    assert got.columns == docs.columns
    text = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert got.count() == docs.count()
    assert text[100][0] == "é tel: [PHONE], then" and text[201] == ("[EMAIL] [IP]é [CARD]", 20)
    assert text[200] == (None, 0) and text[103] == ("page = 12345", 12) and text[10][0] == "name x tel: [PHONE] rest"


def running_text():
    rows = [(i, f"Hello, call me on +49 30 1234{i} today") for i in range(10, 30)] + [(i, f"you can reach me at a{i}@b.de or so") for i in range(30, 50)]
    rows += [(i, f"a {w} saw it on +49 30 5555{i} then") for i, w in enumerate("abcdefghij", 50)] + [(i, f"a {w} saw it on {w}day then") for i, w in enumerate("klmnopqrstuvwxyzabcdefghij", 60)]
    return rows + [(200, "é: please call me on 030 555-0123, ok"), (201, "Reach me at jane(at)example.com."), (202, "call me on monday or so"), (203, "a b saw it on 555 0199 then")]


def test_phrases_in_running_text_discover_values(spark):
    got = {r.doc_id: r for r in find(spark.createDataFrame(running_text(), "doc_id long, text string").repartition(3)).collect()}
    assert got[200].spans == "phone:21:33" and got[201].spans == "email:12:31"
    assert got[202].spans == "" and got[203].spans == ""  # a word; a phrase beside which words stand as well
    assert sum(r.n_added for r in got.values()) == 2


def test_labelled_values_run_to_their_delimiter(spark):
    rows = [(i, f"mail: a{i}@b.de") for i in range(30)] + [(100, "mail: jane(at)example.com, then"), (101, "mail: " + "x" * 100 + "1" * 50 + "; rest"), (102, "mail: nobody")]
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[100], got[101], got[102]) == ("mail: [EMAIL], then", "mail: [EMAIL]; rest", "mail: nobody")


def test_many_spans_and_clashing_columns(spark):
    text = " ".join(f"u{i}@b.de x 10.0.{i % 256}.{i // 256}" for i in range(3000))
    docs = spark.createDataFrame([(1, text, 1, "y", "z")], "doc_id long, text string, span_id int, _span_id string, span_list string")
    row = find(docs).first()
    assert (row.n_email, row.n_ip) == (3000, 3000)
    assert row.base_sha256 == hashlib.sha256(",".join(x for k in PATTERNS for x in brute(text)[k]).encode()).hexdigest()
    out = redact(docs).first()
    assert out.text == " ".join(["[EMAIL] x [IP]"] * 3000) and tuple(out)[2:] == (1, "y", "z")


def test_long_labels(spark):
    rows = [(i, f"{'very_long_' * 5}mail = a{i}@b.de") for i in range(30)] + [(100, f"{'very_long_' * 5}mail = jane(at)example.com")]
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == f"{'very_long_' * 5}mail = [EMAIL]"


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert find(none).collect() == [] and redact(none).collect() == []
