"""What the models of op8 and op9 add, on planted rows whose answer is known."""

import base64
import random
import string

from reqsieve.llm import pii, secret_scan

SCHEMA = "doc_id long, text string"
WORDS = "request handler session manager customer account balance update service factory response parser user index".split()


def prose(r, n):
    return " ".join("".join(r.choice("aeioutnshrdl") for _ in range(r.randint(2, 9))) for _ in range(n))


def rates(found, planted):
    """Precision and recall of (doc, start, end) spans."""
    right = len(found & planted)
    return right / max(len(found), 1), right / len(planted)


def planted_texts(r, makers, n):
    rows, places = [], set()
    for i in range(n):
        before, after = prose(r, r.randint(3, 30)) + " ", " " + prose(r, r.randint(3, 30))
        cue, span, counts = r.choice(makers)(r)
        rows.append((i, before + cue + span + after))
        if counts:
            at = len(before) + len(cue)
            places.add((i, at, at + len(span)))
    return rows, places


def random_text(letters, low, high):
    return lambda r: ("", "".join(r.choice(letters) for _ in range(r.randint(low, high))), True)


SECRETS = [
    random_text(string.ascii_letters + string.digits, 24, 44), random_text(string.ascii_uppercase + string.digits, 26, 40),
    lambda r: ("key ", base64.b64encode(bytes(r.randrange(256) for _ in range(30))).decode().rstrip("="), True),
    lambda r: ("", "".join(r.choice("0123456789ABCDEF") for _ in range(40)), True),
    lambda r: ("ghp_"[:0], "".join(r.choice(string.ascii_letters + string.digits + "_-") for _ in range(36)), True),
]
ORDINARY = [
    lambda r: ("", "_".join(r.choice(WORDS) for _ in range(4)), False),
    lambda r: ("", "".join(w.title() for w in r.choices(WORDS, k=4)), False),
    lambda r: ("", "/".join(r.choices(WORDS, k=5)) + "/index_page", False),
    lambda r: ("", "-".join(r.choices(WORDS, k=4)) + "-2024", False),
    lambda r: ("", "".join(r.choices(WORDS, k=4)), False),
]


def test_random_strings_among_identifiers(spark):
    """Trained on what the patterns label elsewhere in the table, none of the planted strings."""
    r = random.Random(9)
    rows, places = planted_texts(r, SECRETS + ORDINARY, 600)
    letters = string.ascii_letters + string.digits + "+/"
    labelled = [
        (1000 + i, f"{prose(r, 10)} token = {''.join(r.choice(letters) for _ in range(40))} {'_'.join(r.choices(WORDS, k=4))}") for i in range(400)
    ]
    found = secret_scan.scan(spark.createDataFrame(rows + labelled, SCHEMA)).where("doc_id < 1000").collect()
    spans = {(x.doc_id, s.start, s.stop) for x in found for s in x.markov}
    precision, recall = rates(spans, places)
    print(f"op9 precision {precision:.3f} recall {recall:.3f}")
    assert precision >= 0.95 and recall >= 0.9


def digits(r, n):
    return "".join(r.choice("0123456789") for _ in range(n))


def card(r, sep):
    while True:
        d = "4" + digits(r, 15)
        if pii.luhn(d):
            return sep.join(d[i : i + 4] for i in range(0, 16, 4))


PERSONAL = [
    lambda r: ("call ", f"({r.randint(200, 989)}) {r.randint(200, 999)}-{digits(r, 4)}", True),
    lambda r: ("phone: ", f"{r.randint(200, 989)}-{r.randint(200, 999)}-{digits(r, 4)}", True),
    lambda r: ("card ", card(r, "."), True),
    lambda r: ("mail ", f"{prose(r, 1)}.{prose(r, 1)} (at) {prose(r, 1)} (dot) com", True),
]
OTHER = [
    lambda r: ("order ", f"{r.randint(200, 989)}-{r.randint(200, 999)}-{digits(r, 4)}", False),
    lambda r: ("serial ", f"0{digits(r, 2)} {digits(r, 3)} {digits(r, 4)}", False),
    lambda r: ("version ", ".".join(digits(r, 4) for _ in range(4)), False),
    lambda r: ("build ", f"1{digits(r, 2)}.{digits(r, 3)}.{digits(r, 4)}", False),
    lambda r: ("", prose(r, 3), False),
]


def test_looser_personal_data(spark):
    """Looser forms with and without a cue, beside rows that the fixed patterns catch."""
    r = random.Random(8)
    rows, places = planted_texts(r, PERSONAL + OTHER, 600)
    strict = [lambda r: ("call ", f"+1 {digits(r, 3)} {digits(r, 3)} {digits(r, 4)}", True), lambda r: ("card ", card(r, " "), True),
              lambda r: ("mail ", f"{prose(r, 1)}@{prose(r, 1)}.com", True)]
    more = [(1000 + i, t) for i, t in planted_texts(r, strict, 300)[0]]
    found = pii.find(spark.createDataFrame(rows + more, SCHEMA)).where("doc_id < 1000").collect()
    spans = {(x.doc_id, s.start, s.stop) for x in found for s in x.spans if not s.base}
    precision, recall = rates(spans, places)
    print(f"op8 precision {precision:.3f} recall {recall:.3f}")
    assert precision >= 0.9 and recall >= 0.8
