"""Secret scan against the plain patterns and against keys encoded here, on texts with odd cases."""

import base64
import hashlib
import json
import pathlib
import random
import re
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from gridloom.llm import secret_scan  # noqa: E402

RSA, EC, ED25519 = "2a864886f70d010101", "2a8648ce3d0201", "2b6570"


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def integer(value):
    return der(2, value.to_bytes(value.bit_length() // 8 + 1, "big"))


def oid(text):
    return der(6, bytes.fromhex(text))


def rsa_key(rng, bits=1024):
    return der(0x30, integer(0), *(integer(rng.getrandbits(bits) | 1 << bits - 1) for _ in range(8)))


def ec_key(rng):
    return der(0x30, integer(1), der(4, rng.randbytes(32)), der(0xA0, oid("2a8648ce3d030107")), der(0xA1, der(3, b"\0" + rng.randbytes(65))))


def wrapped(kind, inner, parameters=b""):
    return der(0x30, integer(0), der(0x30, oid(kind), parameters), der(4, inner))


def openssh(rng, cipher=b"none", kdf=b"none"):
    string = lambda x: len(x).to_bytes(4, "big") + x
    public = string(b"ssh-ed25519") + string(rng.randbytes(32))
    check = rng.randbytes(4)
    secret = check + check + public + string(rng.randbytes(64)) + string(b"me@home")
    secret += bytes(range(1, 9))[: -len(secret) % 8]
    return b"openssh-key-v1\0" + string(cipher) + string(kdf) + string(b"") + (1).to_bytes(4, "big") + string(public) + string(secret)


def encrypted(rng):
    return der(0x30, der(0x30, oid("2a864886f70d01050d"), der(0x30, rng.randbytes(20))), der(4, rng.randbytes(64)))


def public_key(rng):
    return der(0x30, der(0x30, oid(RSA), der(5)), der(3, b"\0" + der(0x30, integer(rng.getrandbits(1024)), integer(65537))))


def b64(data):
    return base64.b64encode(data).decode()


def lines(text, width=64, end="\n"):
    return end.join(text[i : i + width] for i in range(0, len(text), width))


def token(rng, header, size):
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    return ".".join([part(json.dumps(header).encode()), part(b'{"sub":"1"}'), part(rng.randbytes(size))])


def keys(text):
    return [(s, e, f) for s, e, kind, f in secret_scan.secrets(text) if kind == "key"]


def keys_by_kind():
    rng = random.Random(3)
    return [
        ("pkcs1", rsa_key(rng)), ("sec1", ec_key(rng)), ("pkcs8", wrapped(RSA, rsa_key(rng), der(5))), ("pkcs8", wrapped(EC, ec_key(rng))),
        ("pkcs8", wrapped(ED25519, der(4, rng.randbytes(32)))), ("dsa", der(0x30, integer(0), *(integer(rng.getrandbits(160)) for _ in range(5)))),
        ("openssh", openssh(rng)), ("openssh", openssh(rng, b"aes256-ctr", b"bcrypt")), ("pkcs8-encrypted", encrypted(rng)),
    ]


@pytest.mark.parametrize("kind, data", keys_by_kind())
def test_a_key_is_found_to_its_last_character(kind, data):
    flat = b64(data)
    for body in (flat, lines(flat), lines(flat, 76, "\r\n"), lines(flat, 64, "\\n")):
        for before, after in (("", ""), ("-----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----\n"), ("é key: ", "\nHello there"), ('"a\\n', '\\nb"')):
            text = before + body + after
            assert keys(text) == [(len(before), len(before + body), kind)]
    for run in (data.hex(), data.hex().upper()):
        assert keys(f"x={run}zz") == [(2, 2 + len(run), kind)]


@pytest.mark.parametrize("kind, data", keys_by_kind())
def test_a_spoilt_key_is_none(kind, data):
    assert not keys(b64(data[:-3])) and not keys(data[:-1].hex())
    at = 15 if kind == "openssh" else 1
    wrong = bytearray(data)
    wrong[at + 3 if kind == "openssh" else at] ^= 0x15
    assert not keys(b64(bytes(wrong)))


def test_what_only_looks_like_a_key_is_none():
    rng = random.Random(4)
    assert not keys(b64(public_key(rng))) and not keys(public_key(rng).hex())
    assert not keys(b64(wrapped(RSA, ec_key(rng), der(5))))  # an algorithm with another one's key
    assert not keys(b64(der(0x30, *(integer(7) for _ in range(9)))))  # version 7
    assert not keys(b64(wrapped(ED25519, rng.randbytes(34))))
    for _ in range(300):
        assert not keys("MI" + b64(rng.randbytes(200))) and not keys("3082" + rng.randbytes(300).hex())
    assert not keys("b3BlbnNzaC1rZXktdjEA" + b64(rng.randbytes(300)))


def test_signed_tokens():
    rng = random.Random(6)
    good = [({"alg": "HS256", "typ": "JWT"}, 32), ({"typ": "JWT", "alg": "ES512"}, 132), ({"alg": "RS256"}, 256), ({"alg": "none"}, 0), ({"alg": "X1"}, 9)]
    for header, size in good:
        text = f"Bearer {token(rng, header, size)}, next"
        assert [s for s in secret_scan.secrets(text) if s[2] == "signed"] == [(7, len(text) - 6, "signed", header["alg"])]
    for header, size in [({"alg": "HS256"}, 31), ({"alg": "RS256"}, 64), ({"typ": "JWT"}, 32), ({"alg": 5}, 32), ({"alg": "none"}, 3), ({"alg": "X1"}, 0), (["alg"], 32)]:
        assert not [s for s in secret_scan.secrets(token(rng, header, size)) if s[2] == "signed"]
    assert not secret_scan.secrets("eyJhbGciOiJIUzI1.eyJ.abc eywwwwwwwwww.a.b")


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(7)
    parts = ["password", "Secret", "toKen", "api_key", "APIKEY", "passwd", "=", ":", " ", "'", '"', "AKIA", "A9Z", "AKIA" + "Q" * 16, "0123abcf" * 3, "deadbeef", "x", "\n", "é", "ſecret", "a.b-c", "toKen=secret: "]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        want = [(m.start(), m.end(), "assign") for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        got = [s[:3] for s in secret_scan.secrets(text) if s[2] in secret_scan.BASE]
        assert got == sorted(want, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_whole_tables(spark):
    rng = random.Random(8)
    rsa = lines(b64(rsa_key(rng)))
    rows = [
        (1, f"token = 'abcdef' {rsa}", "x"), (2, None, "x"), (3, "", "x"), (None, "AKIA" + "Z" * 16, "x"), (5, "no secret here", "x"), (5, "no secret here", "x"),
        (6, "é" * 200_000 + "password: hunter22", "x"), (7, "a" * 500_000 + " " + "M" * 300_000, "x"), (8, "token" + " " * 200_000 + "= abc", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string").repartition(3)
    got = {(r.doc_id, len(r.secrets), tuple((s.start, s.end, s.kind) for s in r.secrets)) for r in secret_scan.find_secrets(docs).collect()}
    assert got == {(i, len(f), tuple(f)) for i, f in ((i, [s[:3] for s in secret_scan.secrets(t or "")]) for i, t, _ in rows)}
    assert secret_scan.find_secrets(docs).count() == len(rows)
    safe = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert safe[1] == "[secret]' [secret]" and safe[2] is None and safe[5] == "no secret here" and safe[None] == "[secret]"
    assert secret_scan.redact(docs).columns == docs.columns
    none = docs.where("false")
    assert secret_scan.find_secrets(none).count() == 0 and secret_scan.redact(none).count() == 0


def test_query(spark):
    from gridloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op13_secret_scan"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = secret_scan.secrets(texts[r.doc_id] or "")
        base = [s for s in spans if s[2] in secret_scan.BASE]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base) for k in secret_scan.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k, _ in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)
