"""Text expressions against Python's own string, URL and regex functions."""

import re
import urllib.parse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from reqsieve.functions import masks, text
from reqsieve.operators import normalize, parse, tokens

URLISH = st.text(alphabet="ab%2Ff5C3é+=& ?;/", max_size=24)
BATCH = st.lists(URLISH, min_size=30, max_size=60)
FEW = settings(
    max_examples=5, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True
)


def pairs(value):
    return [(p.k, p.v) for p in value]


def py_params(q):
    out = {}
    for k, v in urllib.parse.parse_qs(q, keep_blank_values=True).items():
        out[urllib.parse.unquote_plus(k)] = urllib.parse.unquote_plus(v[-1])
    return list(out.items())


def test_strip_and_split_use_unicode_blanks(one):
    values = ["", "  a b ", "  x　", "\x1c\x1dq\x1f", "a b", "\x85", "\t a\r\n"]
    assert one(values, text.strip) == [v.strip() for v in values]
    assert one(values, text.ws_split) == [v.split() for v in values]
    assert one(values, text.is_blank) == [v.strip() == "" for v in values]


def test_safe_int(one):
    values = ["", "0", "12", " 7 ", "+5", "-3", "1_000", "1__0", "_1", "12.5", "x", "-", "9" * 30]
    assert one(values, text.safe_int) == [0, 0, 12, 7, 5, -3, 1000, 0, 0, 0, 0, 0, 0]


def test_decode_url_cases(one):
    values = ["100%", "%zz%41", "%%41", "%C3", "%ff%fe", "%252F", "a+b%20c", "", "%C3%A9", "%4"]
    assert one(values, text.decode_url) == [urllib.parse.unquote_plus(v) for v in values]


def test_query_params_cases(one):
    values = ["", "a=1&a=2&b", "=x&&a==b", "a%2520=1&a%20=2&a%2520=3", "x=1;y=2", "q=%2527+OR+1", "b=1&a=2&b=3&c"]
    assert [pairs(v) for v in one(values, parse.query_params)] == [py_params(v) for v in values]


def test_many_parameters_stay_whole(one):
    value = "&".join(f"k{i % 700}={i}" for i in range(5000))
    assert pairs(one([value], parse.query_params)[0]) == py_params(value)


@FEW
@given(values=BATCH)
def test_decode_url_like_python(one, values):
    assert one(values, text.decode_url) == [urllib.parse.unquote_plus(v) for v in values]


@FEW
@given(values=BATCH)
def test_query_params_like_python(one, values):
    assert [pairs(v) for v in one(values, parse.query_params)] == [py_params(v) for v in values]


SPLIT = re.compile(r"([/?=&:#.;,\[\]{}()<>\-_'\"|`~!@^*+\\])")


def py_tokens(s):
    return [p for p in SPLIT.split(s) if p and not p.isspace()]


@FEW
@given(values=st.lists(st.text(alphabet="aZ 9/?='\"\\[]-_.é😀क  \t\n", max_size=30), min_size=30, max_size=60))
def test_tokens_like_python(one, values):
    assert one(values, tokens.tokens_of) == [py_tokens(v) for v in values]


def test_token_cases(one):
    values = ["", "   ", " ", "' OR '1'='1", "a\\b", "😀/x", "हेलो दुनिया"]
    assert one(values, tokens.tokens_of) == [py_tokens(v) for v in values]


MASKED = {
    "0123456789abcde": "0123456789abcde",
    "0123456789abcdef": "{HASH}",
    "256.1.1.1": "256.1.1.1",
    "from 10.0.0.1.": "from {IP}.",
    "x10.0.0.1": "x10.0.0.1",
    "session=1.2.3.4": "session={IP}",
    "Token=ab.c-9 sid=": "Token={SESSION} sid=",
    "mysid=abc": "mysid=abc",
    "2024-01-02T03:04:05Z x": "{TIMESTAMP} x",
    "2024-01-02 03:04:05+02:00": "{TIMESTAMP}",
    "3f2504e0-4f89-11d3-9a0c-0305e82c3301": "{UUID}",
    "%2Fa%2eB": "/a.B",
    "é0123456789abcdef": "é0123456789abcdef",
    "": "",
}


def test_mask_values(one):
    assert one(list(MASKED), masks.mask_values) == list(MASKED.values())


PATHS = {
    "/A//B/": "/a/b/",
    "/12/": "/12/",
    "/123/": "/{USER_ID}/",
    "/123/456/": "/{USER_ID}/{USER_ID}/",
    "/api/123": "/api/{USER_ID}",
    "/x%2F%2e%2E/y": "/x/../y",
    "/10.1.2.3/a": "/{IP}/a",
    "/h/0123456789ABCDEF0": "/h/{HASH}",
    "/٣٤٥/": "/{USER_ID}/",
    "123/": "123/",
    "": "",
}


def test_mask_path(one):
    assert one(list(PATHS), masks.mask_path) == list(PATHS.values())


PY_MASKS = [
    (re.compile(r"\b20\d{2}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})?\b"), "{TIMESTAMP}"),
    (re.compile(r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"), "{IP}"),
    (re.compile(r"\b(session|token|auth|sid|sessionid|jwt)=([A-Za-z0-9._-]+)", re.I), r"\1={SESSION}"),
    (re.compile(r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"), "{UUID}"),
    (re.compile(r"\b[0-9a-fA-F]{16,}\b"), "{HASH}"),
]
PIECES = st.sampled_from(
    ["2024-01-02T03:04:05Z", "2021-12-31 23:59:59", "10.0.0.1", "999.1.1.1", "SID=", "token=", "sessionid=a1",
     "ſid=x", "0123456789abcdef", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "é", "क", " ", "/", ".", "-", "a", "7", "ab"]
)


@FEW
@given(values=st.lists(st.lists(PIECES, max_size=9).map("".join), min_size=40, max_size=60))
def test_mask_values_like_python(one, values):
    want = []
    for v in values:
        for pattern, to in PY_MASKS:
            v = pattern.sub(to, v)
        want.append(v)
    assert one(values, masks.mask_values) == want


def test_normal_params_sorts_lowers_and_folds(one):
    values = ["B=2&a=1", "Q=1&q=2", "q=2&Q=1", "x=10.0.0.1&X=&y=a", "Ab=1&aB=2&AB=3"]
    got = one(values, lambda c: normalize.normal_params(parse.query_params(c)))
    assert [pairs(v) for v in got] == [
        [("a", "1"), ("b", "2")],
        [("q", "2")],
        [("q", "1")],
        [("x", ""), ("y", "a")],
        [("ab", "3")],
    ]
