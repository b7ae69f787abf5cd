"""The secret scan: base spans against plain patterns, added spans against cases written by hand."""

import hashlib
import random
import re
from collections import Counter

import pytest

from dossier.llm import secrets

SF = "/root/testdata/sf0.001"
EMPTY = "doc_id long, text string"
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = ("assign", "access", "hex").index
    return sorted(out, key=lambda s: (s[1], rank(s[0])))


def joined(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def check(spark, docs):
    got = secrets.report(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    base = {t: plain(t or "") for t in {r.text for r in rows}}
    count = lambda t, k: sum(s[0] == k for s in base[t])
    want = Counter((r.doc_id, count(r.text, "assign"), count(r.text, "access"), count(r.text, "hex"), hashlib.sha256(joined(base[r.text]).encode()).hexdigest()) for r in rows)
    assert want == Counter(tuple(r)[:5] for r in got)
    return got


def test_report_against_plain_patterns(spark):
    random.seed(5)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(spark, docs)
    pieces = ["password", "Token", "API_KEY", "apikey", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "é", "日本", "\n", "x", "==", "Passwd", "ſecret", "-", "<", "#", "--"]
    made = ["".join(random.choice(pieces) for _ in range(random.randint(1, 25))) for _ in range(3000)]
    check(spark, spark.createDataFrame(list(enumerate(made)), EMPTY))


def test_report_on_odd_rows(spark):
    long = "word " * 60_000 + 'password = "hunter2hunter2"\n' + "ab" * 40_000
    rows = [(1, None), (2, ""), (3, long), (4, "token=abcdefgh"), (4, "token=abcdefgh"), (None, "token=abcdefgh"), (5, "AKIA" + "A" * 16), (6, "AKIA"), (7, "x=")]
    docs = spark.createDataFrame([(i, t, 1, "s", "t") for i, t in rows], "doc_id long, text string, n_assign int, spans string, `e.f` string")
    got = check(spark, docs)
    assert len(got) == len(rows)
    assert secrets.report(spark.createDataFrame([], EMPTY)).count() == 0
    red = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert red[4].text == "<assign>" and red[1].text is None and red[4]["e.f"] == "t" and red[5].text == "<access>" and "hunter2" not in red[3].text


def literals(text):
    import pyarrow as pa

    from dossier.llm.kernels import slices

    (piece,) = slices(pa.array([text]))
    found = secrets.find_in(piece).get(0, ([], []))[1]
    return [text[a:b] for kind, a, b in found if kind == "literal"]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('db_pwd := "kX9!vq#72Lm"', ["kX9!vq#72Lm"]),
        ('String clientSecret = "Zq8$kw*Lp20!";', ["Zq8$kw*Lp20!"]),
        ("const char privateKey[] = 'mN4&tt!Q9wZ8';", ["mN4&tt!Q9wZ8"]),
        ('{"credentials": "R7w!pL0qXz9#"}', ["R7w!pL0qXz9#"]),
        ('config["accessKey"] = "u8Fh2kLs0PqW"', ["u8Fh2kLs0PqW"]),
        ('#define SIGNING_KEY "u8Fh2kLs0PqW"', ["u8Fh2kLs0PqW"]),
        ("deploy --passphrase u8Fh2kLs0PqW --verbose", ["u8Fh2kLs0PqW"]),
        ('first = "u8Fh2kLs0P" + middle\nmiddle = "Aw83jd0Qk2"\npwd = first', ["u8Fh2kLs0P", "Aw83jd0Qk2"]),
        ("signing_key: QUJDREVGR0hJSktM+a/b12==", ["QUJDREVGR0hJSktM+a/b12=="]),
        ("<connection><pwd>u8Fh2kLs0PqW</pwd></connection>", ["u8Fh2kLs0PqW"]),
        ('<add key="EncryptionKey" value="u8Fh2kLs0PqW"/>', ["u8Fh2kLs0PqW"]),
        ('dsn = "Server=db1;Uid=app;Pwd=u8Fh2kLs0PqW;"', ["u8Fh2kLs0PqW"]),
        ("url: 'https://app:u8Fh2kLs0PqW@db.local/x'", ["u8Fh2kLs0PqW"]),
        ("pwd: str = 'é日本u8Fh2kLs0PqW'", ["é日本u8Fh2kLs0PqW"]),
        # constants, in several steps, in any order, and joined
        ('DEFAULT = "u8Fh2kLs0PqW"\nfallback = DEFAULT\nconnect(host, pwd=fallback)', ["u8Fh2kLs0PqW"]),
        ('connect(pwd=DEFAULT)\nDEFAULT = "u8Fh2kLs0PqW"', ["u8Fh2kLs0PqW"]),
        ('first = "u8Fh2kLs0P"\nclient_secret = first + "Xw93kd02Za"', ["u8Fh2kLs0P", "Xw93kd02Za"]),
        ('export BASE="u8Fh2kLs0PqW"\nexport DB_PWD="${BASE}"', ["u8Fh2kLs0PqW"]),
        ('x = "u8Fh2kLs0PqW"\nx = "harmless words"\npwd = x', []),
        ("a = b\nb = a\npwd = a", []),
        # names that only sound alike, place-holders, calls and prose
        ('color = "u8Fh2kLs0PqW"', []),
        ('pwd = os.getenv("DATABASE_PWD_2024")', []),
        ('pwd = "<your pwd here>"', []),
        ('pwd_hint = "u8Fh2kLs0PqW"', []),
        ('max_pwd_length = "u8Fh2kLs0PqW"', []),
        ('pwd == "u8Fh2kLs0PqW"', []),
        ("He said: the pwd is not written here, for good reasons.", []),
        ('key = "sort_order"', []),
        ('# pwd = "u8Fh2kLs0PqW"', []),
    ],
)
def test_added_literals(text, found):
    assert literals(text) == found


def test_added_spans_never_meet_base_spans():
    text = 'token = "u8Fh2kLs0PqW", pwd = "u8Fh2kLs0PqW", signing_key = "00112233445566778899aabbccddeeff"'
    assert literals(text) == ["u8Fh2kLs0PqW"]


def test_long_lines_end():
    unclosed = 'x = "' + '\\"' * 100_000
    chain = "\n".join(f"pwd{i + 1} = pwd{i}" for i in range(20_000))
    for text in ('pwd = "' * 30_000, "a=" * 100_000, "[" * 100_000 + "]=", "]=" * 50_000, "<a>" * 50_000, "a.b." * 50_000 + "=", "--a b " * 50_000, 'x = "a" + ' * 20_000, unclosed, chain):
        assert isinstance(literals(text), list)
